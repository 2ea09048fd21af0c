"""The pipeline's stages keep their columns, survive awkward rows, and do what their names say."""

import pytest

import __spark_entry__
import corpus_pipeline
from quire.llm import queries

STRANGE = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (3, "x" * 70_000, "en", "s", 70_000), (4, "two words", None, "s", 9)]
    for name, stage in corpus_pipeline.STAGES:
        for n in (5, 0):
            out = stage(spark, spark.createDataFrame(rows[:n], STRANGE), sf)
            assert out.count() <= n, name
            assert set(STRANGE.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)


def test_pipeline_masks_and_drops(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(out) < 200 and out.doc_id.is_unique
    assert not out.text.str.contains(r"@mail[0-9]\.example").any()
    assert (out.n_tokens == out.ids.map(lambda b: len(b) // 4)).all()


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op3_url_filter", "op4_quality_classifier", "op7_pii_spans"])
def test_queries_return_a_row_each(spark, name):
    sf = "/root/testdata/sf0.001"
    table = "pages" if name == "op3_url_filter" else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
