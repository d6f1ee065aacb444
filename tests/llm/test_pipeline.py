"""Each stage of the corpus pipeline: nulls, empty and long texts, repeats, clashing columns, empty tables, and its effect."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import PHRASE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labels and a benchmark of a few rows, as tables of their own."""
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, int(i in (3, 4)), int(300 <= i < 360)) for i in (3, 4, 5, 6, *range(300, 420))]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, PHRASE), (2, None), (3, "")], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_at_the_edges(spark, edge_docs, no_docs, sf_dir, name, stage):
    out = stage(spark, edge_docs, sf_dir)
    rows = out.collect()
    if name != "packing":
        assert out.columns == edge_docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in edge_docs.schema]
        assert {r.doc_id for r in rows} <= {r.doc_id for r in edge_docs.collect()}
    assert rows and stage(spark, no_docs, sf_dir).collect() == []


def test_toxic_documents_go(spark, sf_dir):
    calm = ["a calm plain word of the day", "some quiet text about the sea", "we walk home in the rain"]
    text = lambda k: f"{calm[k % 3]} {k % 7} " + ("you stupid idiot " if k < 60 else calm[(k + 1) % 3])
    docs = spark.createDataFrame([(300 + k, text(k)) for k in range(120)] + [(500, calm[0] + " y0u $tupid id10t"), (501, calm[1]), (502, None), (503, "")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    assert kept == {*range(360, 420), 501, 502, 503}


def test_repeated_passages_go_and_lengths_follow(spark, edge_docs, sf_dir):
    run = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"First.\n{run}\nEnd.", 0), (2, f"Second.\n{run}\nOther end.", 0), (3, None, 7), (4, "short", 5)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert got == {1: (f"First.\n{run}\nEnd.", 0), 2: ("Second.\nOther end.", 18), 3: (None, 7), 4: ("short", 5)}


def test_one_of_each_group_stays(spark, edge_docs, sf_dir):
    rows = corpus_pipeline.keep_one_of_near_duplicates(spark, edge_docs, sf_dir).collect()
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    assert ids == [0, 3, 5, 6, 8, 10, 11, 11, 12, 13] and [r.text for r in rows if r.doc_id is None] == ["no id"]


def test_contaminated_documents_go(spark, edge_docs, sf_dir):
    rows = corpus_pipeline.drop_contaminated(spark, edge_docs, sf_dir).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2, 3, 4, 8, 9, 10, 11, 11, 12, 12]


def test_stages_one_by_one_are_the_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    ran = corpus_pipeline.run(spark, SMALL)
    whole = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    assert whole(ran) == whole(docs) and all(n == tokens for _, tokens, n in whole(ran)) and len(key(ran)) == ran.count()
