"""The pipeline stage by stage against brute force, and the registered llm queries over whole tables."""

from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, docs

import corpus_pipeline
from tessera.llm import queries as L
from tessera.llm import secret_scan


def test_stages(spark, sf):
    texts = ["the quick brown fox jumps over the lazy dog again"] * 3 + ["12 34 -- 56", None, "password = abcdefghijklmnop the cat sat on the mat", "the end of the story is near and so on it goes"]
    df = docs(spark, texts).select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.keep_languages(spark, df, sf)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 5, 6} and tuple(kept.columns) == corpus_pipeline.COLUMNS
    one = corpus_pipeline.drop_near_copies(spark, kept, sf)
    assert {r["doc_id"] for r in one.collect()} == {0, 5, 6}
    masked = corpus_pipeline.mask_secrets(spark, one, sf)
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert text[5] == "[SECRET] the cat sat on the mat" and text[0] == texts[0]
    packed = corpus_pipeline.pack(spark, masked, sf)
    assert {r["doc_id"] for r in packed.collect()} == {0, 5, 6}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "packing"]


def test_tiny_and_unlabelled_texts_stay(spark, sf):
    texts = ["the cat sat on the mat and then went home again " * 40, "Z", "12 34", None, "漢字仮名交文章例題" * 8]
    df = docs(spark, texts).select(*corpus_pipeline.COLUMNS)
    labelled = df.withColumn("lang", F.when(F.col("doc_id") < 4, F.col("lang")))
    assert {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, labelled, sf).collect()} == {0, 1}
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, nothing, sf).collect()} == {0, 1, 4}


def test_near_copies_go_by_row(spark, sf):
    """Rows share ids, repeat, and lack ids: one row of each group stays, and nothing else goes."""
    base = [f"w{k}" for k in range(30)]
    near, nearer = " ".join([*base[:-1], "x"]), " ".join([*base[:-1], "y"])
    base = " ".join(base)
    other, clean, twice = "here is a text of its own that stays", "and another one that has nothing to do with it", "this row comes two times in the table as it is"
    rows = [(1, base), (1, other), (2, near), (2, clean), (3, base), (3, base), (None, nearer), (9, twice), (9, twice), (None, ""), (None, "")]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).select(*corpus_pipeline.COLUMNS)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect())
    assert got == Counter([(1, base), (1, other), (2, clean), (9, twice), (None, ""), (None, "")])


def test_empty(spark, sf):
    df = docs(spark, ["x"]).select(*corpus_pipeline.COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
    assert df.count() == 0


def test_run_keeps_one_of_each_group(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    _, roots = brute_components([r["text"] for r in rows], 80, 100, 5)
    heads = {rows[c]["doc_id"] for c in roots}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == heads


@pytest.mark.parametrize("name", sorted(L.QUERIES))
def test_registered_queries_cover_the_table(spark, sf, name):
    df = L.QUERIES[name](spark, sf)
    if name in L.ORACLE_SQL:
        assert compare.difference(spark, compare.connect(sf), sf, L.QUERIES[name], L.ORACLE_SQL[name]) is None
        return
    ids = Counter(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert set(r["doc_id"] for r in df.select("doc_id").collect()) == set(ids)


def test_no_secret_is_left(spark, sf):
    masked = secret_scan.mask(spark.read.parquet(f"{sf}/documents.parquet"))
    left = secret_scan.scan(masked).where(F.col("n_assign") + F.col("n_access") + F.col("n_hex") > 0)
    assert left.count() == 0
