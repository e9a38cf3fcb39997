"""Every query beside its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_top_k_is_planned_as_one(spark):
    from skein.plans.vector_queries import vector_exact_topk

    plan = vector_exact_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_whole_texts_are_decoded(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from skein.plans import text_queries as Q

    rows = [(i, "a" * 500 + end) for i, end in enumerate(["ä 日本", "ä 日本", "ä", "", "", "日本"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda: {r["doc_id"]: r["same"] for r in Q.decode_text(spark, str(tmp_path)).collect()}
    assert got() == dict.fromkeys(range(6), True)
    decode = Q.E.decode_text
    monkeypatch.setattr(Q.E, "decode_text", lambda c: F.substring(decode(c), 1, 400))
    assert got() == dict.fromkeys(range(6), False)


def test_queries_without_sql_over_a_table(spark, duck):
    import hashlib
    import re

    import numpy as np

    from skein.plans import text_queries as Q
    from skein.sources.extract import html_text

    vectors = dict(duck.execute("select vec_id, embedding from embeddings").fetchall())
    got = {r["key"]: r["sha256"] for r in Q.vector_checksum(spark, SF).collect()}
    assert got == {k: hashlib.sha256(np.array(v, np.float32).astype("<f2").tobytes()).hexdigest() for k, v in vectors.items()}
    sums = {r["page_id"]: r for r in Q.html_documents(spark, SF).collect()}
    pages = dict(duck.execute("select page_id, html from pages").fetchall())
    assert {k: r["n_chars"] for k, r in sums.items()} == {k: len(html_text(v)) for k, v in pages.items()} and len(sums) > 10
    anchors = {r["passage_id"]: r["n_anchors"] for r in Q.match_anchors(spark, SF).collect()}
    bodies = duck.execute(registry.ORACLES["snippet"]).fetchall()
    assert set(anchors) == {k for k, _ in bodies} and all(0 <= n <= 12 for n in anchors.values()) and any(anchors.values())
    assert all(anchors[k] > 0 for k, text in bodies if re.search(r"\bering\b", text) and len(text) > 60)


def beside_sql(spark, at, name):
    """Rows of a query and of its SQL over the tables in a folder."""
    c = duckdb.connect()
    for f in glob.glob(f"{at}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}/*.parquet'")
    df = registry.QUERIES[name](spark, at)
    rel = c.sql(registry.ORACLES[name])
    order = [rel.columns.index(n) for n in df.columns]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.collect()), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())


def test_markdown_lines_keep_their_ends(spark, tmp_path):
    texts = ["0 zero 0", "a\n\n b 6\n c 7 \n8 d\n9", "  x  ", r"\\ \_ \[a](b) \|", "* a\r* | b\u2028~~c\u0085d~~\n|e|\u2028", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, wanted = beside_sql(spark, str(tmp_path), "markdown_to_text")
    assert got == wanted


def test_texts_that_begin_with_or_are_words(spark, tmp_path):
    texts = ["or a b c d e", "OR a b c d e", "Or, a or or or or", "or", "", None, "- a b", "a b c OR or oR", "! ? b"]
    rows = [(2 * i + k, t) for i, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, wanted = beside_sql(spark, str(tmp_path), "parse_query")
    assert got == wanted


def test_files_of_any_size_are_read_whole(spark, tmp_path, monkeypatch):
    from skein.plans import text_queries as Q

    texts = ["", "", None, "a\n\nb", "c " * 300, "last", "end\n", "ä日本", *["copy"] * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q.E, "CHARACTERS", 100)  # what is bigger is cut elsewhere
    monkeypatch.setattr(Q.E, "SOURCE_BYTES", 200)
    got, wanted = beside_sql(spark, str(tmp_path), "read_text")
    assert got == wanted
