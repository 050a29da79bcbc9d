"""Quality rules with adaptive thresholds per language and source.

Each document is measured; each measure of each (language, source) group is summarised in a
mergeable quantile sketch (DDSketch, Masson et al., 2019): counts of logarithmic buckets, so
merging is adding, any quantile has a bounded relative error, and the result does not depend
on the order or number of partitions. The sketch is built by one grouped count that Spark
combines before the shuffle, over the documents that pass the base rules. The verdict is the
sketches' alone: a document goes if a measure lies beyond its group's far fences, quartiles
and so many interquartile ranges. The quartiles of a group are drawn towards its language's,
and these towards those of all documents, by ``PRIOR`` documents, so that small groups follow
their parents without a switch. The cutoffs, a few rows per group, are joined to the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_stutter", "n_marks", "n_distinct")
#: Ratio of a sketch's bucket bounds, and the least value that is told from zero.
GAMMA, LEAST = 1.01, 1e-4
#: Documents that a parent's quartiles count for in a group's.
PRIOR = 40
#: A cutoff lies so many interquartile ranges beyond a quartile; a group whose values lie close together has
#: at least so much of its parent's range.
FENCE, PARENT_RANGE = 5.0, 0.125
#: Measures, and whether low values are bad too. All vary among clean documents, so that quartiles say something.
MEASURES = {"mark_ratio": False, "word_length": True, "sameness": False, "stutter_ratio": False, "dup_line_ratio": False}
#: One is added to a share's part, and so much to its whole.
SMOOTH = {"mark_ratio": 50, "stutter_ratio": 50, "dup_line_ratio": 2}


def measure(text: str | None) -> tuple[int, ...]:
    """The five base counts; the lines with a word, the words equal to the word before, the marks, the different words.

    Words are runs of characters other than ASCII white space; a null text has none.
    n_repeat_words counts words inside a 3-word window that occurs at least twice in the text.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    more = len(lines), int((ids[1:] == ids[:-1]).sum()), len(raw) - len(raw.translate(None, MARKS)), len(number)
    if n < 4:
        return n, chars, symbols, dup_lines, 0, *more
    if len(number) < 2_000_000:
        k = len(number)
        window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    often = np.zeros(n - 2, bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    cover = np.zeros(n, bool)
    cover[:-2] |= often
    cover[1:-1] |= often
    cover[2:] |= often
    return n, chars, symbols, dup_lines, int(cover.sum()), *more


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the measurements of each row's whole text (columns prefixed ``q_``)."""
    common.missing_columns(docs, "text", *keep)
    names = [f"q_{c}" for c in (*COUNTS, *MORE)]
    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} long" for n in names])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names)))], names=[*keep, *names])

        return each

    text = docs.select(F.col("text").cast("string").alias("q_text"), *keep)
    return common.map_arrow(text, make, kinds)


def _measures() -> dict[str, Column]:
    """The measures of a row that passes the base rules, from its counts.

    Shares are smoothed by ``SMOOTH``, so that a group in which most have none of something does not
    reject the first document that has one. sameness is 0 if all words differ and 1 if all are
    equal, on a logarithmic scale that hardly depends on the length.
    """
    c = lambda name: F.col(f"q_{name}").cast("double")
    share = lambda part, whole, m: (c(part) + 1) / (c(whole) + SMOOTH[m])
    return {
        "mark_ratio": share("n_marks", "word_chars", "mark_ratio"),
        "word_length": c("word_chars") / c("n_words"),
        "sameness": 1 - F.log(c("n_distinct")) / F.log(c("n_words") + 1),
        "stutter_ratio": share("n_stutter", "n_words", "stutter_ratio"),
        "dup_line_ratio": share("n_dup_lines", "n_lines", "dup_line_ratio"),
    }


def base_failed() -> Column:
    """Whether a measured row fails the base rules: under 50 words, or over half of them in repeated windows."""
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def sketches(rows: DataFrame, groups: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sketch of each measure in each group: (groups..., measure, bucket, n)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("x")) for m, c in measures.items()])
    bucket = F.when(F.col("m.x") <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(F.col("m.x") / LEAST) / math.log(GAMMA)).cast("int"))
    return rows.select(*groups, F.explode(pairs).alias("m")).groupBy(*groups, F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts of equal buckets are added."""
    return sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of each group and measure, and its count ``n``."""
    by = Window.partitionBy(*groups, "measure")
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (GAMMA + 1))
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    return ranked.withColumn("value", value).groupBy(*groups, "measure").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("value"))).alias(a) for a, q in qs.items()])


def cutoffs(rows: DataFrame) -> DataFrame:
    """(q_lang, q_source, low_<measure>, high_<measure>...): the fences of each group with a row that passes the base rules."""
    good = rows.filter(~base_failed())
    fine = common.staged(sketches(good, ["q_lang", "q_source"], _measures()), "quality-sketch")
    ask = {"q25": 0.25, "q75": 0.75}
    keys = {"own": ["q_lang", "q_source"], "lang": ["q_lang"], "every": []}
    found = {k: quantiles(fine if k == "own" else merged(fine, by), by, ask).select(*by, "measure", *[F.col(c).alias(f"{k}_{c}") for c in ("n", "q25", "q75")]) for k, by in keys.items()}
    cut = found["own"].join(found["lang"], ["q_lang", "measure"]).join(found["every"], "measure")
    # no range is told that is below the sketch's own error
    spread = lambda k: F.greatest(F.col(f"{k}_q75") - F.col(f"{k}_q25"), (GAMMA - 1) * F.col(f"{k}_q75"))
    cut = cut.withColumn("range", spread("every"))
    for k, parent in (("lang", "every"), ("own", "lang")):
        drawn = {q: (F.col(f"{k}_n") * F.col(f"{k}_{q}") + PRIOR * F.col(f"{parent}_{q}")) / (F.col(f"{k}_n") + PRIOR) for q in ask}
        cut = cut.withColumns({f"{k}_{q}": c for q, c in drawn.items()}).withColumn("range", F.greatest(spread(k), PARENT_RANGE * F.col("range")))
    fences = {"low": F.col("own_q25") - FENCE * F.col("range"), "high": F.col("own_q75") + FENCE * F.col("range")}
    wide = [F.max(F.when(F.col("measure") == m, fences[e])).alias(f"{e}_{m}") for m, both in MEASURES.items() for e in (("low", "high") if both else ("high",))]
    return cut.groupBy("q_lang", "q_source").agg(*wide)


def judged(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, the base counts, base_failed and kept, for every row.

    A row is kept if it has at least 50 words, at most half of them in repeated 3-word windows,
    and no measure beyond its group's fences; a value on a fence is kept. Null language or source is
    a group of its own; a null or empty text has no words and is rejected; repeated rows are judged
    alike; an empty table gives no rows. Columns of ``keep`` pass through untouched.
    """
    common.missing_columns(docs, "lang", "source")
    wide = docs.select("*", common.key("lang").alias("q_lang"), common.key("source").alias("q_source"))
    rows = common.staged(measured(wide, (*keep, "q_lang", "q_source")), "quality-rows")
    cuts = common.staged(cutoffs(rows), "quality-cuts")
    cuts = common.sized(cuts, cuts.count())
    good = ~base_failed()
    for m, x in _measures().items():
        good = good & F.when(base_failed(), False).otherwise((x <= F.col(f"high_{m}")) & (x >= F.col(f"low_{m}") if MEASURES[m] else F.lit(True)))
    joined = rows.join(cuts, ["q_lang", "q_source"], "left")
    return joined.select(*keep, *[F.col(f"q_{c}") for c in COUNTS], base_failed().alias("q_base_failed"), good.alias("q_kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    found = judged(docs.select("doc_id", "text", "lang", "source"), ("doc_id",))
    return found.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judged(docs, tuple(docs.columns)).filter("q_kept").select(*docs.columns)
