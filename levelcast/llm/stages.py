"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and works on all rows of ``docs``, a table with the columns of
documents and perhaps others. In every stage: null texts are empty ones; an empty table gives an
empty table; other columns, whatever their names, pass through in one struct (packing has columns of its own); very long texts are read whole;
reruns over the same rows give the same rows. What a stage does with nulls elsewhere, ties and repeated
rows is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing, packing, pii, quality, simhash
from .queries import tokenizer_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The one column in which those that are not of documents pass a stage.
CARRIED = "levelcast_carried"


def carrying(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``docs`` with all columns but ``COLUMNS`` put in one, and out of it again; their names cannot meet those used inside."""
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    more = [c for c in docs.columns if c not in COLUMNS]
    if not more:
        return step(docs)
    own = [c for c in docs.columns if c in COLUMNS]
    out = step(docs.select(*own, F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(more)]).alias(CARRIED)))
    names = {c: F.col(CARRIED)[f"c{i}"].alias(c) for i, c in enumerate(more)}
    return out.select(*[names[c] if c in names else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    Empty texts go. A null language or source is a group of its own. A value on a fence is kept;
    repeated rows are kept or go together.
    """
    return carrying(docs, quality.kept_documents)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar, 0.8 or more.

    That of the smallest id stays, null ids last, of one id that of the smallest digest of its text; of
    repeated rows one. All empty texts are alike.
    """
    return carrying(docs, simhash.one_of_each)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; null texts stay null, every row stays."""
    return carrying(docs, pii.redacted)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of sources takes them.

    Documents without words stay once; null sources are a source; repeated rows are documents of their own.
    """
    return carrying(docs, mixing.mixed)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids.

    An empty text gives its end id; a null source is a queue of its own; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs, with_ids=True, **tokenizer_files())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written and read again, and the one before it deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
