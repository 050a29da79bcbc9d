import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from levelcast.llm import mixing, pii, quality, stages
from levelcast.llm.queries import queries, tokenizer_files

from . import fixtures
from .fixtures import awkward, empty
from .test_packing import check
from .test_simhash import groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "quality rules":
            good = quality.quality_report(docs).filter("kept").select("doc_id")
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in good.collect())
        elif name == "near-duplicates":
            rows = sorted(docs.select("doc_id", "text").collect())
            few, many = (len(set(groups([r.text for r in rows], s))) for s in (0.7, 0.86))
            found = [r[0] for r in after.select("doc_id").collect()]
            assert few <= len(found) <= many and len(set(found)) == len(found)
            firsts = {rows[i].doc_id for i in set(groups([r.text for r in rows], 0.7))}
            assert firsts <= set(found)
        elif name == "personal data":
            assert all(not pii.base_spans(r.text) for r in after.collect())
        elif name == "mixing":
            taken = {r.doc_id: r.m_copies for r in mixing.copies(docs, ("doc_id",)).collect() if r.m_copies}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == taken
        else:
            check(after.toPandas(), [r.text for r in docs.collect()])
        docs = after


def test_run_is_registered_and_repeats(spark):
    assert "pipeline" in queries() and corpus_pipeline.ORACLE_SQL is None
    key = ["doc_id", "start", "length", "ids_crc32"]
    a, b = (sorted(map(tuple, queries()["pipeline"](spark, SF).select(*key).collect())) for _ in range(2))
    assert a == b and len(a)


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables(spark, tmp_path, make):
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() == 0) == (make is empty)


def test_tables_of_finished_stages_are_deleted(spark):
    import os

    from levelcast.llm import common

    common.release(spark)
    corpus_pipeline.run(spark, SF).count()
    left = os.listdir(f"{common.shared_dir(spark)}/levelcast/{spark.sparkContext.applicationId}")
    assert sorted(x.rsplit("-", 1)[0] for x in left) == ["mixing", "pack-ids", "pack-parts"]


def test_every_query_is_registered():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(tokenizer_files()) == {"json_path", "ranks_path", "pattern"}


def test_staged_tables_can_be_released(spark):
    import os

    from levelcast.llm import common

    table = common.staged(spark.range(5).toDF("x"), "test")
    folder = f"{common.shared_dir(spark)}/levelcast/{spark.sparkContext.applicationId}"
    assert table.count() == 5 and os.path.isdir(folder)
    common.release(spark)
    assert not os.path.exists(folder)


ODD = ["q_lang", "q_source", "q_text", "q_n_words", "q_kept", "m_copies", "m_size", "l_size", "row", "a.b", "a`b", "levelcast_carried", "hash", "fp", "text_hash"]


@pytest.mark.parametrize("stage", [f for _, f in stages.STAGES], ids=[n for n, _ in stages.STAGES])
def test_columns_of_any_name_pass(spark, stage):
    docs = fixtures.awkward(spark).withColumns({c: F.lit(c) for c in ODD})
    out = stage(spark, docs, "")
    if stage is not stages.packing_sequences:
        assert set(out.columns) == set(docs.columns)
        plain = stage(spark, fixtures.awkward(spark), "")
        assert out.count() == plain.count()
        assert {tuple(r[c] for c in ODD) for r in out.collect()} == {tuple(ODD)}
    else:
        assert out.count() > 0
