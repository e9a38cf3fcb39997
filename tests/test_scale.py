"""What queries do that would grow faster than their tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["near_dup_groups", "semantic_counts", "match_anchors", "semantic_excerpt"])
def test_queries_over_passages_make_no_index_of_words(spark, monkeypatch, name):
    from skein.operators import inverted
    from skein.plans import corpus, registry

    def never(*_):
        raise AssertionError("the index was made")

    monkeypatch.setattr(corpus, "_kept", {})
    monkeypatch.setattr(inverted, "write", never)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Passages are dealt by ranges, and a task makes and writes the postings of its own, sorted, some passages at a time."""
    from pyspark.sql import functions as F

    from skein.operators import inverted as I

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.concat(F.lit("w"), ((F.col("id") * 7 + k * k) % 3000).cast("string"))), " ")
    rows = spark.range(3000).select(F.col("id").alias("passage_id"), F.concat(F.lit("s"), "id").alias("source_id"), words.alias("body"), F.lit("f.txt").alias("filename"), F.lit("a title").alias("title"), F.lit("/x").alias("folder"), F.lit("/x/f.txt").alias("path"))
    plan = I.postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # the plan's top comes first
    monkeypatch.setattr(I, "AT_ONCE", 500)
    I.write(rows, str(tmp_path / "at"))
    got = spark.read.schema(I.POSTINGS).parquet(str(tmp_path / "at/postings"))
    assert got.count() > 150_000
    own = [(r["bucket"], r["term"], r["passage_id"]) for r in I.placed(rows.limit(400).coalesce(1)).collect()]
    assert own == sorted(own) and all(b == I.bucket_of(t) for b, t, _ in own)
    assert I.Index.read(spark, str(tmp_path / "at")).counts == I.statistics(rows).first().asDict()
    terms = lambda df: sorted(tuple(r) for r in df.select("bucket", "term", *I._FREQUENCIES).collect())
    assert terms(spark.read.parquet(str(tmp_path / "at/terms"))) == terms(I.dictionary(got))


def test_first_words_are_those_of_the_whole_text(spark):
    from pyspark.sql import functions as F

    from skein.functions.text import first_words

    texts = ["", " ", None, "one", " a\tb\nc ", "a b c d e f", "a b c d e f ", "  a b c d e f g h", "x" * 5000, "日 本 語 x", "a\n\nb  c d\re f g"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 6), " ")
    assert all(r[0] == r[1] for r in rows.select(first_words(F.col("text"), 6), whole).collect())


def test_files_go_to_the_parser_by_the_hundred(spark):
    """Arrow would hold thousands of files and their texts in each worker at once."""
    from skein.plans import registry
    from skein.sources import extract

    rows = spark.createDataFrame([(1, b"ab", "rtf"), (2, None, "rtf"), (3, b"x", "xyz"), (4, b"cd", None)], "id int, content binary, extension string")
    got = extract.extract_structured(rows, lambda data, ext: (data.decode(), None) if ext == "rtf" else (None, "unsupported"))
    assert [tuple(r) for r in got.select("id", "text", "error").orderBy("id").collect()] == [(1, "ab", None), (2, None, "missing"), (3, None, "unsupported"), (4, None, "unsupported")]
    for df in (got, registry.QUERIES["extract_structured"](spark, SF)) if os.path.isdir(SF) else (got,):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_engine_makes_only_what_its_searches_read(spark, monkeypatch):
    """Semantic searches need no postings, and text searches no vectors."""
    from skein.operators import inverted, quantised
    from skein.plans import corpus, registry

    def never(*_):
        raise AssertionError("it was made")

    for module, name, rows in ((inverted, "engine_lane", 20), (quantised, "engine_search", 1)):
        with monkeypatch.context() as patch:
            patch.setattr(corpus, "_kept", {})
            patch.setattr(module, "write", never)
            assert registry.QUERIES[name](spark, SF).count() >= rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_texts_are_read_once_for_both_lanes(spark, monkeypatch):
    from skein.plans import corpus, engine_queries

    read, documents = [], engine_queries.documents
    monkeypatch.setattr(corpus, "_kept", {})
    monkeypatch.setattr(engine_queries, "documents", lambda *a: read.append(1) or documents(*a))
    assert engine_queries.engine_lane(spark, SF).count() == 20 and len(read) == 1


def test_an_index_without_words_changes_and_merges_as_one_with_them(spark, tmp_path):
    from skein.engine import Engine, SearchRequest

    kind = "source_id string, root_id string, path string, filename string, extension string, modified_at timestamp_ntz, size long, availability string, text string"
    row = lambda i, text: (f"s{i}", "r", f"/r/f{i}.txt", f"f{i}.txt", "txt", None, len(text), "available", text)
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    gone = spark.createDataFrame([("s3",)], "source_id string")
    found = {}
    for words in (True, False):
        e = Engine(spark, str(tmp_path / f"{words}"))
        e.index(rows(*(row(i, f"stone wall {'budget ' * i}") for i in range(8))), words=words)
        e.embed()
        e.apply(rows(row(1, "budget stone"), row(9, "stone")), gone)
        e.embed()
        near = lambda: [(h["source_id"], round(h["score"], 9)) for h in e.search(SearchRequest("stone", "semantic", exact=True)).collect()]  # noqa: B023, E731
        before = near()
        assert e.compact().words == words and near() == before and len(before) == 8
        found[words] = before, e.log.current().counts["n"]
    assert found[True] == found[False]
    assert not any("postings" in f for f, _, _ in os.walk(tmp_path / "False"))
    for mode in ("text", "hybrid"):
        with pytest.raises(LookupError, match="without words"):
            e.search(SearchRequest("stone", mode))
    publish, first = e.log.publish, []

    def late(manifest):  # another writer builds anew with words, before a change of the index without is published
        if not first:
            first.append(1)
            Engine(spark, e.base).index(rows(row(20, "granite")))
        return publish(manifest)

    e.log.publish = late
    e.apply(rows(row(21, "granite stone"), row(22, "wall")))
    assert sorted(h["source_id"] for h in e.search(SearchRequest("granite")).collect()) == ["s20", "s21"]
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.index(rows(row(20, "granite"), row(21, "granite stone"), row(22, "wall")))
    assert e.log.current().counts == whole.log.current().counts


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_words_are_made_once_by_the_merge(spark, tmp_path, monkeypatch):
    """An index loaded by several changes: no segment's words are made that the merge would make again."""
    from skein.engine import Engine, SearchRequest
    from skein.operators import inverted
    from skein.plans import registry

    made, write = [], inverted.write
    with monkeypatch.context() as patch:
        patch.setattr(inverted, "write", lambda *a: made.append(1) or write(*a))
        patch.setattr(inverted, "dictionary", lambda *_: pytest.fail("terms of what is gone were counted"))
        assert registry.QUERIES["engine_compact"](spark, SF).count() > 0 and len(made) == 1
    kind = "source_id string, root_id string, path string, filename string, extension string, modified_at timestamp_ntz, size long, availability string, text string"
    rows = lambda *r: spark.createDataFrame([(f"s{i}", "r", f"/r/f{i}.txt", f"f{i}.txt", "txt", None, len(t), "available", t) for i, t in r], kind)
    found = []
    for words in (True, False):
        e = Engine(spark, str(tmp_path / f"{words}"))
        e.index(rows(*((i, f"stone wall {'budget ' * i}") for i in range(8))), words=words)
        e.apply(rows((1, "budget stone"), (9, "stone")), spark.createDataFrame([("s3",)], "source_id string"))
        m = e.compact(words=True)
        assert m.words and len(m.segments) == 1
        e.apply(rows((10, "granite wall")), spark.createDataFrame([("s2",)], "source_id string"))
        found.append((m.counts, e.log.current().counts, [(h["source_id"], round(h["score"], 9)) for h in e.search(SearchRequest("budget OR wall")).collect()]))
    assert found[0] == found[1] and len(found[0][2]) == 7
