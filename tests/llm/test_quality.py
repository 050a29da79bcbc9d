import re
from collections import Counter

import numpy as np
import pandas as pd

from levelcast.llm import common, quality
from levelcast.llm.queries import op3_quality

from .fixtures import awkward, clashing, empty, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup, before = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in before
            before.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_measures():
    texts = [None, "", " \n", "a", "a b c a b c", "a b c d a b c", "x\nx\n x\n\n\nx", "#|<>&%$* é 漢字", prose(3, 500), "w " * 3000, "a\x1cb c d"]
    for t in texts:
        assert quality.measure(t)[:5] == brute(t), t


def test_query_counts_and_verdicts(spark):
    found = op3_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    want = pd.DataFrame([brute(t) for t in docs.text], index=docs.index, columns=quality.COUNTS).loc[found.index]
    assert (found[list(quality.COUNTS)] == want).all().all()
    failed = (want.n_words < 50) | (100 * want.n_repeat_words > 50 * want.n_words)
    assert (found.base_failed == failed).all() and not found.kept[failed].any()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")
    both = found.join(labels, how="inner")
    both = both[~both.base_failed]
    assert both.kept[both.quality == 1].mean() > 0.99 and both.kept[both.quality == 0].mean() < 0.05


def test_more_measures():
    n_lines, stutter, marks, distinct = quality.measure("a a, b!\n\n(a) a é a~ a")[5:]
    assert (n_lines, stutter, marks, distinct) == (2, 0, 5, 6)


def cuts_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", common.key("lang").alias("q_lang"), common.key("source").alias("q_source"))
    return {r.q_source: r for r in quality.cutoffs(quality.measured(wide, ("q_lang", "q_source"))).collect()}


def test_verdicts_change_as_a_groups_data_shift(spark):
    """The same documents are kept among their like and rejected among others: no constant decides."""
    marked = lambda k: re.sub(" ", lambda m: "," * (1 + m.start() % 3) + " ", prose(k, 100))
    same = [(i, marked(i), "en", "x", 1) for i in range(20)]
    few = [(1000 + i, prose(i, 100).replace(" ", ". ", 5 + i % 9), "en", "x", 1) for i in range(300)]
    many = [(2000 + i, marked(i + 50), "en", "x", 1) for i in range(300)]
    kept = [set(quality.kept_documents(spark.createDataFrame(same + rest, "doc_id long, text string, lang string, source string, n_chars long")).toPandas().doc_id) for rest in (few, many)]
    assert not kept[0] & set(range(20)) and len(kept[1] & set(range(20))) >= 15
    low, high = (cuts_of(spark, same + rest)["=x"].high_mark_ratio for rest in (few, many))
    assert low < 0.6 * high


def test_every_group_has_its_own_cutoffs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wide = docs.select("*", common.key("lang").alias("q_lang"), common.key("source").alias("q_source"))
    cuts = quality.cutoffs(quality.measured(wide, ("q_lang", "q_source"))).toPandas()
    for c in ("high_mark_ratio", "low_word_length", "high_word_length", "high_sameness", "high_stutter_ratio"):
        assert cuts[c].nunique() > 0.9 * len(cuts)


def test_small_groups_follow_their_parents(spark):
    rows = [(i, prose(i, 100), "en", "big", 1) for i in range(400)] + [(1000 + i, "longwordsofonesort " * 1 + prose(i + 9, 60), "en", "small", 1) for i in range(2)]
    cuts = cuts_of(spark, rows)
    assert abs(cuts["=small"].high_word_length / cuts["=big"].high_word_length - 1) < 0.15


def test_cutoffs_follow_the_group(spark):
    rows = [(i, prose(i, 100), "en", "plain", 1) for i in range(300)]
    rows += [(1000 + i, re.sub(" ", "# ", prose(i, 100)), "en", "code", 1) for i in range(300)]
    rows += [(2000 + i, re.sub(" ", "# ", prose(i + 7, 100)), "en", "plain", 1) for i in range(3)]
    kept = set(quality.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas().doc_id)
    assert all(1000 + i in kept for i in range(300)) and not any(2000 + i in kept for i in range(3)) and len(kept) == 600


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.random(5000), np.zeros(200)])
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(x), "x": x}))
    from pyspark.sql import functions as F

    parts = [quality.sketches(df.filter(c), ["g"], {"m": F.col("x")}) for c in ("x < 0.3", "x >= 0.3")]
    q = quality.quantiles(quality.merged(parts[0].unionByName(parts[1]), ["g"]), ["g"], {"lo": 0.25, "hi": 0.9}).first()
    assert q.n == len(x) and abs(q.lo - np.quantile(x, 0.25)) < 0.01 and abs(q.hi - np.quantile(x, 0.9)) < 0.02


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = quality.quality_report(clashing(docs)).toPandas()
    assert len(found) == docs.count() and not found[found.doc_id.isin([100, 101, 102])].kept.any()
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and quality.kept_documents(clashing(docs)).count() == kept.count() == int(found.kept.sum())


def test_empty_table(spark):
    assert quality.quality_report(empty(spark)).count() == 0
