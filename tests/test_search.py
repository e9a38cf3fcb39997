"""Scenarios of the parser, the chunker, ranking, fusion, filters and upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine, SearchRequest, StaleCursor, effective_mode
from skein.functions import text as T
from skein.functions.anchors import anchors
from skein.functions.chunking import chunk
from skein.operators import filters as X
from skein.operators import lexical as L
from skein.operators import maintenance as M
from skein.operators import vectors as V
from skein.operators.query import QueryError, Term, parse


def test_parser():
    q = parse('"quarterly report" budget* -draft')
    assert q.positives == (Term(("quarterly", "report")), Term(("budget",), None, True))
    assert q.negatives == (Term(("draft",)),)
    assert parse("name:report").positives[0].field == "filename"
    assert parse("foo:bar").positives[0].words == ("foobar",)
    assert parse("don't").positives[0].words == ("dont",)
    assert parse("a OR b").any_of
    for bad in ("", "-only", '""', "OR"):
        with pytest.raises(QueryError):
            parse(bad)


def test_chunker():
    parts = chunk(" ".join(f"word{i}" for i in range(30)), 10, 2)
    assert len(parts) == 4 and "word9" in parts[0] and "word8" in parts[1]
    assert chunk(None) == [] and chunk(" \n ") == []


def passages(spark, rows):
    """rows: (path, title, body)."""
    out = [(i, f"s{i}", p, p.rsplit("/", 1)[-1], t, p.rsplit("/", 1)[0], b) for i, (p, t, b) in enumerate(rows)]
    return spark.createDataFrame(out, "passage_id long, source_id string, path string, filename string, title string, folder string, body string")


def best(spark, rows, query, search=L.search):
    return [rows[int(r["source_id"][1:])][0] for r in search(passages(spark, rows), parse(query)).collect()]


FILLER = [(f"/d/other{i}.txt", f"other {i}", f"nothing of that kind number {i}") for i in range(12)]


def test_content_before_name(spark):
    rows = [("/d/Love Song.mp3", "Love Song", ""), ("/d/Research Notes.pdf", "Research", "People love products that make difficult work feel effortless."), *FILLER]
    assert best(spark, rows, "love")[0].endswith("Notes.pdf")


@pytest.mark.parametrize("search", [L.search, L.search_v2])
def test_coverage_before_repetition(spark, search):
    rows = [("/udi/license.txt", "license", "license " * 80), ("/d/Maryland ID.pdf", "Udi Maryland License", "Maryland driver's license issued to Udi Falkson"), *FILLER]
    assert best(spark, rows, "udi license", search)[0].endswith("ID.pdf")


def test_near_before_far(spark):
    rows = [("/d/a.txt", "a", "udi " + "unrelated " * 160 + "license " * 4), ("/d/b.txt", "b", "udi license"), *FILLER]
    assert best(spark, rows, "udi license")[0].endswith("b.txt")


def test_span_is_the_smallest(spark):
    rng = random.Random(4)
    for _ in range(6):
        words = [rng.choice("abcxyz") for _ in range(40)]
        at = {w: [i for i, x in enumerate(words) if x == w] for w in "abc"}
        expected = min(max(p) - min(p) for p in ((i, j, k) for i in at["a"] for j in at["b"] for k in at["c"])) if all(at.values()) else None
        row = spark.createDataFrame([(words,)], "t array<string>")
        assert row.select(L.span((("a",), ("b",), ("c",)), F.col("t"))).first()[0] == expected


def test_weight_turns_fusion(spark):
    a, b = (spark.createDataFrame([(x, 1)], "source_id string, position long") for x in ("lexical", "semantic"))
    top = lambda w: V.fuse(a, b, w, 5).first()["source_id"]
    assert (top(0.2), top(0.8)) == ("lexical", "semantic")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "key long, embedding array<float>")
    top = V.exact_top(v, [0.9, 0.1, 0.0], 3).collect()
    assert [r["key"] for r in top] == [1, 2, 3] and top[2]["score"] == 0
    fast = {r["key"]: r["s"] for r in v.select("key", V.cosine_to([0.9, 0.1, 0.0])("embedding").alias("s")).collect()}
    assert all(abs(fast[r["key"]] - r["score"]) < 1e-9 for r in top)
    s, d, act = (spark.createDataFrame(x, k) for x, k in (([(11, 0.9), (22, 0.5)], "key long, score double"), ([(22, 0.7)], "key long, score double"), ([(22,)], "key long")))
    assert [tuple(r) for r in V.merge(s, d, act, 5).collect()] == [(22, 0.7)]


def test_pictures_only_where_asked(spark):
    m = spark.createDataFrame([(1, 0.68), (2, 0.49)], "passage_id long, score double")
    p = spark.createDataFrame([(1, "a", "image", "png"), (2, "b", "page", "pdf")], "passage_id long, source_id string, location_kind string, extension string")
    find = lambda where, images: [r["source_id"] for r in V.semantic_search(m, p, where, images, 5).collect()]
    assert find(F.lit(True), False) == ["b"] and find(F.col("extension") == "png", True) == ["a"]


def test_policy(spark):
    from skein.plans.file_queries import policy_cases

    got = {(r["path"], r["root"]): r["x"] for r in policy_cases(spark).withColumn("x", X.Policy(home="/home/me", prefixes=("/home/me/skip",)).excluded(F.col("path"), F.col("root"))).collect()}
    kept = {k for k, v in got.items() if not v}
    assert kept == {("/home/me/Documents/notes.txt", "/home/me"), ("/home/me/Library/CloudStorage/Drive/report.txt", "/home/me"), ("/home/me/go/pkg/mod/x/doc.txt", "/home/me/go/pkg/mod"), ("/home/me/venv.md", "/home/me")}
    wide = spark.createDataFrame([("/r/ｎｏｄｅ＿ｍｏｄｕｌｅｓ/a.txt", "/r"), ("/r/NODE_MODULES/a.txt", "/r"), ("/r/ｎotes/a.txt", "/r")], "path string, root string")
    assert [r["x"] for r in wide.coalesce(1).select(X.Policy().excluded(F.col("path"), F.col("root")).alias("x")).collect()] == [True, True, False]
    code = spark.createDataFrame([("/r/a.swift", "/r"), ("/r/b.txt", "/r")], "path string, root string")
    assert code.filter(~X.Policy(exclude_source_code=False).excluded(F.col("path"), F.col("root"))).count() == 2


def test_embedding_queue_order(spark):
    f = spark.createDataFrame([(n, n, n, t) for n, t in (("md", 400), ("pdf", 300), ("txt", 100), ("xlsx", 600), ("csv", 500))], "source_id string, filename string, extension string, t int").withColumn("modified_at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    rows = [(1, "md", 0, None), (2, "md", 1, None), (3, "pdf", 0, None), (4, "txt", 0, None), (5, "xlsx", 0, None), (6, "csv", 0, None)]
    p = spark.createDataFrame([(*r, "text") for r in rows], "passage_id long, source_id string, ordinal int, embedding_model string, body string")
    order = lambda x: [r["source_id"] for r in M.embedding_queue(x, f, "m", 9).collect()]
    assert order(p) == ["md", "pdf", "txt", "xlsx", "csv"]
    assert order(p.withColumn("embedding_model", F.when(F.col("passage_id") == 1, "m")))[0] == "pdf"


def test_history(spark):
    x = spark.createDataFrame([(1, "Joanna", "2024-01-01 10:00:00"), (2, "  JOANNA  ", "2024-01-01 11:00:00"), (3, "jo", "2024-01-01 23:59:59"), (4, "joe", "2024-01-02 00:00:00")], "id long, query string, t string")
    x = x.select("id", "query", M.normalise_query(F.col("query")).alias("normalized_query"), F.col("t").cast("timestamp_ntz").alias("searched_at"))
    assert sorted(r["id"] for r in M.coalesce_history(x).collect()) == [2, 4]


def test_reconcile_needs_a_complete_scan(spark):
    f = spark.createDataFrame([("a", True), ("b", False)], "source_id string, bad boolean")
    gone = lambda complete: sorted(r["source_id"] for r in M.reconcile(f, f.filter("false"), complete, F.col("bad")).collect())
    assert gone(False) == ["a"] and gone(True) == ["a", "b"]


def test_log_replay(spark):
    log = spark.createDataFrame([("s", 1, "upsert"), ("s", 2, "delete"), ("t", 1, "upsert")], "source_id string, generation long, operation string")
    ops = lambda c: {(r["source_id"], r["operation"]) for r in M.replay(log, c, 2).collect()}
    assert ops(1) == {("s", "delete")} and ops(-1) == ops(9) == {("s", "delete"), ("t", "upsert")}


def test_texts(spark):
    md = "# Report\n\n| Name | Value |\n|---|---|\n| [Alpha](http://x) | **42** |"
    df = spark.createDataFrame([(md, "日é ÉCOLE ecole")], "md string, t string")
    r = df.select(T.markdown_to_text(F.col("md")).alias("m"), T.highlights(F.col("t"), ["ecole"]).alias("h"), T.fnv1a_key(F.lit("")).cast("string").alias("k")).first()
    assert r["m"] == "Report\n\nName\tValue\n\nAlpha\t42"
    assert [tuple(h) for h in r["h"]] == [(3, 5), (9, 5)]
    assert int(r["k"]) == 14695981039346656037 | 1 << 63
    of = lambda snippet, mark: spark.range(1).select(anchors(F.lit(snippet), F.lit(mark))).first()[0]
    assert of("one two three four five six seven … x", "four")[0] == "one two three four five six seven"
    long = " ".join(f"w{i:02d}" for i in range(60))
    got = of(f"some other words here ... {long}", "w30")
    assert len(got) == 12 and len(set(got)) == 12 and all("w30" in a and a in long for a in got)
    assert [len(a.split()) for a in got] == [18] * 3 + [12] * 3 + [8] * 3 + [5] * 3
    assert of("a b", "a") == [] and all(len(a) <= 180 for a in of("x" * 100 + " " + "y" * 100 + " zz", "zz"))


def test_folding_of_any_letter(spark):
    df = spark.createDataFrame([("Łódź āőž ĞIŞ Ａｂｃ１２ é", r"a \* b \*c\* **d** \# x")], "t string, md string")
    r = df.select(T.fold(F.col("t")).alias("f"), T.fold_width(F.col("t")).alias("w"), T.markdown_to_text(F.col("md")).alias("m")).first()
    assert r["f"].startswith("łodz aoz gis") and r["w"] == "Łódź āőž ĞIŞ Abc12 é" and r["m"] == "a * b *c* d # x"
    assert parse("Łódź").positives[0].words == ("łodz",)
    assert df.select(M.normalise_query(F.lit("  ＡＢc  É "))).first()[0] == "abc e"
    assert chunk(" ".join(map(str, range(40))), 10, 9)[1].split()[0] == "5"


def test_unmarked_utf16_is_read(spark):
    from skein.sources.extract import decode_text

    for code in ("utf-16-le", "utf-16-be", "utf-16", "utf-8", "latin-1"):
        df = spark.createDataFrame([(bytearray("Grüße an alle".encode(code)),)], "c binary")
        assert df.select(decode_text(F.col("c"))).first()[0] == "Grüße an alle", code


def test_roots_below_hidden_folders_are_listed(spark, tmp_path):
    from skein.sources.discovery import discover

    root = tmp_path / ".hid" / "docs"
    (root / ".secret").mkdir(parents=True)
    (root / "a.txt").write_text("x")
    (root / ".secret" / "b.txt").write_text("x")
    assert [r["filename"] for r in discover(spark, str(root)).collect()] == ["a.txt"]


def test_page_budget(spark):
    from skein.sources.extract import page_budget

    p = spark.createDataFrame([(1, 1, "Aé日"), (1, 2, "BCDE"), (1, 3, "ignored")], "doc int, page int, text string")
    assert [r["text"] for r in page_budget(p, 5).orderBy("page").collect()] == ["Aé日", "BC", ""]


def test_formats():
    import io
    import zipfile

    from skein.plans.text_queries import make_docx
    from skein.sources.extract import html_text, parse, rtf_text

    assert parse(make_docx(["One", "", "Two & 3"]), "docx") == ("One\n\nTwo & 3", None)
    assert rtf_text(rb"{\rtf1{\fonttbl{\f0 X;}}Caf\'e9\par two\tab x}") == "Café\ntwo\tx"
    assert html_text("<p>a<script>no</script></p><p>b &amp; c</p>") == "a\nb & c"
    assert parse(b"junk", "docx") == (None, "malformed") and parse(b"", "bin") == (None, "unsupported")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c><v>1</v></c><c t="inlineStr"><is><t>b</t></is></c></row></sheetData></worksheet>')
    assert parse(out.getvalue(), "xlsx") == ("1\tb", None)


def test_engine(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "node_modules").mkdir(parents=True)
    (docs / "plan.txt").write_text("The quarterly operating budget includes a research allocation.")
    (docs / "node_modules" / "x.txt").write_text("quarterly budget")
    (docs / "other.md").write_text("Nothing to see here.\n\nA garden in spring.")
    e = Engine(spark, str(tmp_path / "index"))
    assert e.index_folder(str(docs), "r") == 1
    hits = e.search(SearchRequest("quarterly budget")).collect()
    assert [h["filename"] for h in hits] == ["plan.txt"] and "research allocation" in hits[0]["snippet"]
    assert not e.ready() and effective_mode("hybrid", False) == "text"
    e.embed()
    assert [h["filename"] for h in e.search(SearchRequest("garden in spring", "semantic", limit=1)).collect()] == ["other.md"]
    assert e.search(SearchRequest("garden", "hybrid", X.Filters(extensions=frozenset({"md"})))).first()["filename"] == "other.md"
    assert e.health().first()["n_files"] == 2
    assert e.search(SearchRequest("garden", cursor=e.cursor(1))).count() == 0
    with pytest.raises(StaleCursor):
        e.search(SearchRequest("garden", cursor="7:0"))
    assert SearchRequest("x", limit=999).limit == 200
    with pytest.raises(LookupError):
        Engine(spark, str(tmp_path / "none")).search(SearchRequest("x"))


def test_engine_follows_changes(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in (("a.txt", "alpha budget report"), ("b.txt", "beta budget garden"), ("c.txt", "gamma stone")):
        (docs / name).write_text(text)
    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    e.embed()
    names = lambda q, mode="text", **k: [h["filename"] for h in e.search(SearchRequest(q, mode, **k)).collect()]
    assert sorted(names("budget")) == ["a.txt", "b.txt"]
    (docs / "b.txt").write_text("beta stone wall, changed")
    (docs / "a.txt").unlink()
    (docs / "d.txt").write_text("delta budget new")
    m = e.reconcile(str(docs), "r")
    assert names("budget") == ["d.txt"] and sorted(names("stone")) == ["b.txt", "c.txt"] and m.counts["n"] == 3
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.index_folder(str(docs), "r")
    assert e.log.current().counts == whole.log.current().counts
    scores = lambda x: sorted((h["filename"], round(h["score"], 9)) for h in x.search(SearchRequest("stone")).collect())
    assert scores(e) == scores(whole)
    assert "d.txt" not in names("delta budget new", "semantic")  # not embedded yet
    e.embed()
    assert names("delta budget new", "semantic", limit=1) == ["d.txt"] and "a.txt" not in names("alpha", "semantic")
    before = e.log.current().generation
    e.compact()
    assert e.log.current().generation == before + 1 and len(e.log.current().segments) == 1 and scores(e) == scores(whole)
    e.embed()
    assert names("delta budget new", "semantic", limit=1) == ["d.txt"]
    one = [h["filename"] for h in e.search(SearchRequest("stone budget", "hybrid", limit=1)).collect()]
    two = [h["filename"] for h in e.search(SearchRequest("stone budget", "hybrid", limit=1, cursor=e.cursor(1))).collect()]
    assert one and two and one != two
    e.embed_cards(spark.createDataFrame([(r["source_id"], "zebra crossing" if r["filename"] == "c.txt" else "other") for r in e.files().collect()], "source_id string, text string"))
    assert "c.txt" in names("zebra crossing", "semantic", limit=2)
    assert names("stone", ranker=2, limit=5)


def test_engine_keeps_history_and_searches(spark, tmp_path):
    import time

    e = Engine(spark, str(tmp_path / "index"))
    for q in ("Budget", "  budget ", "garden"):
        e.record(q)
        time.sleep(2.1)
    assert [r["query"] for r in e.history().collect()] == ["garden", "  budget "]
    e.save_search("b", SearchRequest("x"))
    e.save_search("A", SearchRequest("y", filters=X.Filters(extensions=frozenset({"md"}))))
    e.save_search("z", SearchRequest("z"), pinned=True)
    e.save_search("b", SearchRequest("x"), deleted=True)
    assert [r["name"] for r in e.saved_searches().collect()] == ["z", "A"]
    e.clear_history()
    assert e.history().count() == 0


def test_hits_that_the_policy_leaves_out_and_copies(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    words = " ".join(f"word{i}" for i in range(40))
    for name in ("plan.txt", "plan copy.txt", "other.txt"):
        (docs / name).write_text(f"budget {words}")
    base = str(tmp_path / "index")
    Engine(spark, base).index_folder(str(docs), "r")
    later = Engine(spark, base, X.Policy(prefixes=(str(docs / "other.txt"),)))
    hits = later.search(SearchRequest("budget", group_copies=True)).collect()
    assert sorted(h["filename"] for h in hits) == ["plan copy.txt", "plan.txt"] and len({h["primary"] for h in hits}) == 1


def test_command_line():
    from skein.cli import parser, render, request

    r = request(parser().parse_args(["search", "a", "b", "--mode", "text", "--type", ".PDF,md", "-n", "5", "--after", "2024-01-02", "--jsonl"]))
    assert (r.query, r.mode, r.limit, r.filters.extensions, r.filters.after) == ("a b", "text", 5, frozenset({"pdf", "md"}), "2024-01-02")
    row = {"path": "/a.md", "filename": "a.md", "extension": "md", "modified_at": None, "score": 1.0, "snippet": "x  y"}
    assert render([row], "paths", r, "text") == "/a.md" and '"text": "x y"' in render([row], "jsonl", r, "text")
    with pytest.raises(SystemExit):
        parser().parse_args(["q", "--limit", "201"])


def test_last_events_win_over_all_batches(spark, tmp_path):
    from skein.streaming import changes as S

    at = lambda hour: f"2024-01-0{1 + hour // 24} {hour % 24:02}:00:00"
    write = lambda rows: spark.createDataFrame(rows, "path string, event_id long, kind string, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    told = []

    def step():
        out = S.newest_ever(S.read(spark, str(tmp_path / "in")), "2 hours").writeStream.outputMode("update")
        out.foreachBatch(lambda batch, n: told.append(sorted((r["path"], r["event_id"], r["kind"]) for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [r for rows in told for r in rows], told.clear()

    write([("/a", 5, "delete", at(10)), ("/a", 4, "upsert", at(10)), ("/b", 2, "upsert", at(10)), ("/b", None, "delete", at(10))])
    assert step()[0] == [("/a", 5, "delete"), ("/b", 2, "upsert")]
    write([("/a", 3, "upsert", at(10)), ("/b", 7, "delete", at(10)), ("/c", 6, "upsert", at(10))])  # an older event of /a in a later batch
    assert step()[0] == [("/b", 7, "delete"), ("/c", 6, "upsert")]
    write([("/d", 8, "upsert", at(30))])
    step()
    write([("/a", 1, "upsert", at(10)), ("/d", 9, "upsert", at(31))])  # later than state is kept: left out
    assert step()[0] == [("/d", 9, "upsert")]
    write([("/a", 10, "upsert", at(31))])
    assert step()[0] == [("/a", 10, "upsert")]


def test_a_log_is_read_on_after_the_last_event_committed(spark, tmp_path):
    import json

    from skein.sources import change_log as LOG
    from skein.streaming import changes as S

    log = tmp_path / "log"
    log.mkdir()

    def write(name, events, end="\n", mode="w"):
        with open(log / name, mode) as f:
            f.write("\n".join(json.dumps({"id": i, "path": p, "flags": k, "at": 1.7e9 + i}) for i, p, k in events) + end)

    def step(since=0):
        q = S.read_log(spark, str(log), since).writeStream.format("parquet").option("path", str(tmp_path / f"out{since}")).option("checkpointLocation", str(tmp_path / f"cp{since}")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["event_id"], r["path"], r["kind"]) for r in spark.read.schema(S.SCHEMA).parquet(str(tmp_path / f"out{since}")).collect())

    write("1.jsonl", [(3, "/a", 0), (4, "/b", LOG.REMOVED)])
    write("2.jsonl", [(6, "/c", LOG.REMOVED | LOG.KERNEL_DROPPED)])
    first = [(3, "/a", "upsert"), (4, "/b", "delete"), (6, "/c", "recover")]
    assert step() == first
    write("2.jsonl", [(7, "/d", 0), (8, "/half", 0)], end="", mode="a")  # the last line isn't whole
    write("3.jsonl", [(9, "/e", 0)])
    write(".hidden", [(99, "/x", 0)])
    later = [(7, "/d", "upsert"), (9, "/e", "upsert")]
    assert step() == first + later  # each event once
    assert step() == first + later
    assert step(6) == later


def test_keys_are_found_in_nested_documents(spark):
    import json

    from skein.sources.extract import nested_text

    rng = random.Random(6)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([1, "x", None, True, 2.5, "ä"])
        if kind < 0.5:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: tree(depth - 1) for k in rng.sample(["a", "b", "key", "zz"], rng.randint(0, 3))}

    def first(node):
        if isinstance(node, dict) and node.get("key") is not None:
            return node["key"]
        below = [node[k] for k in sorted(node)] if isinstance(node, dict) else node if isinstance(node, list) else []
        return next((v for x in below if (v := first(x)) is not None), None)

    rows = [(i, json.dumps(tree(5)), i) for i in range(120)] + [(500, "not json", 1), (501, None, 1), (502, "", 1), (503, '{"key": "one"}', 1), (503, '{"key": "one"}', 1)]
    got = nested_text(spark.createDataFrame(rows, "id long, d string, value long"), "d", "key")
    assert got.columns == ["id", "d", "value", "found"]
    say = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    want = sorted((i, say(first(json.loads(t))) if t and t != "not json" else None) for i, t, _ in rows)
    assert sorted((r["id"], r["found"]) for r in got.collect()) == want
    assert nested_text(spark.createDataFrame([], "d string"), "d", "key").count() == 0


def test_highlights_in_code_points_and_utf16_units(spark):
    import re

    rng = random.Random(4)
    texts = ["😀ab 𝒳ab", "ab", "", None, "AB😀", "äb😀", *("".join(rng.choice("ab😀𝒳é ") for _ in range(30)) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", T.with_utf16(T.highlights(F.col("t"), ["ab", "b"]), F.col("t")).alias("h")).collect()
    units = lambda s: len(s.encode("utf-16-le")) // 2
    for r in rows:
        t = r["t"]
        if t is None:
            assert r["h"] == []
            continue
        low = t.lower().replace("é", "e").replace("ä", "a")
        want = sorted((m.start(), len(w)) for w in ("ab", "b") for m in re.finditer(w, low))
        assert [(h["location"], h["length"]) for h in r["h"]] == want
        assert [(h["location16"], h["length16"]) for h in r["h"]] == [(units(t[:a]), units(t[a : a + n])) for a, n in want]


def test_a_listener_knows_how_far_a_stream_is(spark, tmp_path):
    from skein.streaming import changes as S
    from skein.streaming.progress import Progress

    listener = Progress()
    spark.streams.addListener(listener)
    try:
        for k, n in enumerate((3, 5)):
            spark.createDataFrame([(f"/{i}", 10 * k + i, "upsert", "2024-01-01 00:00:00") for i in range(n)], "path string, event_id long, kind string, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = S.read(spark, str(tmp_path / "in"), 1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        state = listener.wait(q.id)
        assert (state.phase, state.found, state.done, state.batches, state.fraction) == ("finished", 8, 8, 2, 1.0)
        bad = S.read(spark, str(tmp_path / "in"), 1).writeStream.foreachBatch(lambda b, n: 1 / 0).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            bad.awaitTermination()
        assert listener.wait(bad.id).phase == "failed" and listener.state(bad.id).done == 0
    finally:
        spark.streams.removeListener(listener)
    assert listener.state("none").fraction == 1.0


def test_page_routing(spark):
    from skein.sources.extract import route_pages

    p = spark.createDataFrame([(1, 0, "text", False, "v", True), (1, 1, " ", False, "x" * 40, True), (1, 2, None, True, "v", True), (1, 200, "t", True, "v", True)], "doc int, page int, structured string, needs_ocr boolean, viewer string, has_ink boolean")
    assert [r["route"] for r in route_pages(p).orderBy("page").collect()] == ["structured", "viewer", "ocr", "viewer"]


def test_stream_of_changes_reaches_searches(spark, tmp_path):
    from skein.streaming import changes as S

    docs = tmp_path / "docs"
    docs.mkdir()
    for name in ("a.txt", "b.txt"):
        (docs / name).write_text(f"budget of {name[0]}")
    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    load = lambda paths: e.read_folder(str(docs), "r").join(paths, "path", "left_semi")
    write = lambda rows: spark.createDataFrame(rows, "path string, event_id long, kind string, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    names = lambda q: sorted(h["filename"] for h in e.search(SearchRequest(q)).collect())
    (docs / "a.txt").write_text("garden now")
    (docs / "c.txt").write_text("budget of c")
    at = "2024-01-01 00:00:00"
    write([(f"{docs}/a.txt", 1, "upsert", at), (f"{docs}/b.txt", 2, "delete", at)])
    S.follow(S.read(spark, str(tmp_path / "in")), e, load, str(tmp_path / "cp")).awaitTermination()
    assert names("budget") == [] and names("garden") == ["a.txt"]
    (docs / "b.txt").unlink()
    write([(str(docs), 3, "recover", at)])
    S.follow(S.read(spark, str(tmp_path / "in")), e, load, str(tmp_path / "cp")).awaitTermination()
    assert names("budget") == ["c.txt"]
    m = e.log.current()
    assert e.apply(e.read_folder(str(docs), "r"), batch=m.batch).generation == m.generation  # a batch that comes again


def test_late_changes_are_left_out(spark, tmp_path):
    from skein.streaming import changes as S

    write = lambda rows: spark.createDataFrame(rows, "path string, event_id long, kind string, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def step():
        q = S.counts_by_time(S.read(spark, str(tmp_path / "in")), "10 minutes", "5 minutes").writeStream.outputMode("append").format("parquet")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    write([("/a", 1, "upsert", "2024-01-01 00:01:00"), ("/b", 2, "upsert", "2024-01-01 01:00:00")])
    step()
    write([("/c", 3, "upsert", "2024-01-01 00:02:00"), ("/d", 4, "upsert", "2024-01-01 00:58:00"), ("/e", 5, "upsert", "2024-01-01 03:00:00")])
    step()
    rows = spark.read.schema("window struct<start:timestamp,end:timestamp>, kind string, n long").parquet(str(tmp_path / "out")).collect()
    assert sorted((r["window"]["start"].hour, r["window"]["start"].minute, r["n"]) for r in rows) == [(0, 0, 1), (0, 55, 1), (1, 0, 1)]


def test_recent_rates_are_those_of_all_values(spark):
    rng = random.Random(2)
    rows = [(k, i, v) for k in range(3) for i, v in enumerate([0.0, 0.0] + [rng.random() for _ in range(40)])] + [(3, i, float(i == 0)) for i in range(4000)]
    got = {r["k"]: r["rate"] for r in M.recent_rates(spark.createDataFrame(rows, "k long, i long, v double"), "k", "i", "v").collect()}
    for k in range(4):
        rate = 0.0
        for _, _, v in sorted(r for r in rows if r[0] == k):
            rate = v if rate == 0 else rate * 0.75 + v * 0.25
        assert abs(got[k] - rate) < 1e-12


def test_prefixes_phrases_and_fields_are_looked_up(spark, tmp_path):
    from skein.operators import inverted as I

    rng = random.Random(7)
    vocabulary = ["alpha", "alphabet", "beta", "bet", "gamma", "del", "délta"]
    rows = [(f"/d{i % 3}/{rng.choice(vocabulary)} {i}.txt", " ".join(rng.choice(vocabulary) for _ in range(3)), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    p = passages(spark, rows)
    I.write(p, str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    for q in ("alpha", "alph*", '"alpha beta"', '"alpha bet" OR gamma', "title:beta -gamma", "name:alpha gamma", "path:d1 delta", "a*", '"beta beta" delta', "alpha beta gamma"):
        query = parse(q)
        close = lambda df: sorted((r["source_id"], round(r["score"], 9), r["best_passage"]) for r in df.collect())
        assert close(I.search(index, query, 200)) == close(L.search(p, query, 200)), q
        assert close(I.search_v2(index, p, query, 200)) == close(L.search_v2(p, query, 200)), q


def test_journal(spark, tmp_path):
    from skein.sources import journal as J

    at = str(tmp_path / "journal")
    rows = spark.createDataFrame([(1, 1, False, [0.5, 1.0]), (1, 2, False, [0.25, 2.0]), (2, 3, False, [1.0, 1.0]), (2, 4, True, None)], "key long, seq long, tombstoned boolean, embedding array<float>")
    J.append(rows, at)
    broken = '{"key":1,"seq":9,"tombstoned":false,"payload":"AAA=","sha256":"x"}'
    spark.createDataFrame([(broken,), ("{",), ('{"key":',)], "value string").write.mode("append").text(at)
    snapshot = spark.createDataFrame([(3, 0, False, [3.0])], "key long, seq long, tombstoned boolean, embedding array<float>")
    got = sorted((r["key"], r["seq"], r["tombstoned"], r["embedding"]) for r in J.replay(spark, at, snapshot).collect())
    assert got == [(1, 2, False, [0.25, 2.0]), (2, 4, True, None), (3, 0, False, [3.0])]


def read_rows(df):
    """The rows, and how many the scans gave after row groups and pages were skipped."""

    def given(plan):
        name = plan.getClass().getSimpleName()
        if name.startswith("AdaptiveSparkPlan"):
            return given(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return given(plan.plan())
        if name.startswith("FileSourceScan"):
            return plan.metrics().apply("numOutputRows").value()
        return sum(given(plan.children().apply(i)) for i in range(plan.children().size()))

    return df.collect(), given(df._jdf.queryExecution().executedPlan())


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    from skein.operators import inverted as I

    rng = random.Random(3)
    vocabulary = ["stone", "wall", "river", "hill", "cloud"]
    rows = [(f"/d{i % 7}/f{i}.txt", "", "common " * (9 if i // 100 == 20 else 1) + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) + (" seldom" if i // 50 == 70 else "")) for i in range(6000)]
    p = passages(spark, rows)
    for name, value in (("BLOCK", 5), ("PAGE", 32), ("SWEPT", 0)):
        monkeypatch.setattr(I, name, value)
    I.write(p, str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    whole = I.Index(index.rows, index.counts)
    assert index.blocks.filter("term = 'common'").count() > 150
    close = lambda df: [(r["source_id"], round(r["score"], 9), r["best_passage"]) for r in df.collect()]
    for q in ("common", "seldom", "common seldom", "common OR seldom", "common -stone", "stone wall", "stone OR wall", "title:common", "common nothere", 'common "stone wall"', "f20 OR common", "name:f2001 common"):
        assert close(I.search(index, parse(q), 3)) == close(I.search(whole, parse(q), 3)), q
    from pyspark.sql import functions as F

    some = p.select("source_id", "filename")
    where = F.col("filename").rlike("[05].txt$")
    assert close(I.search(index, parse("common"), 5, some, where)) == close(I.search(whole, parse("common"), 5, some, where))
    found, read = read_rows(I.best_passages(index, parse("common"), 30))
    every, all_read = read_rows(I.best_passages(whole, parse("common"), 30))
    key = lambda r: (r["passage_id"], round(r["rank"], 9))
    assert list(map(key, found)) == list(map(key, every))
    assert all_read >= 6000 and read < all_read / 5, (read, all_read)
    _, read = read_rows(I.best_passages(index, parse("common seldom"), 30))
    assert read < 1000


def test_dictionary_stays_exact_under_changes(spark, tmp_path):
    from skein.engine import Engine
    from skein.operators import inverted as I

    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(12):
        (docs / f"f{i}.txt").write_text(f"common {'seldom' if i % 5 == 0 else 'other'} words {i}")
    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    (docs / "f0.txt").unlink()
    e.reconcile(str(docs), "r")
    (docs / "f1.txt").write_text("seldom garden")
    (docs / "f2.txt").unlink()
    e.reconcile(str(docs), "r")
    (docs / "f0.txt").write_text("common again")
    e.reconcile(str(docs), "r")
    gone = e.files().filter("filename in ('f1.txt', 'f3.txt')").select("source_id").collect()
    gone = spark.createDataFrame(gone, "source_id string")
    e.apply(None, gone)  # f1 has a tombstone of an earlier change already
    assert e.apply(None, gone) == e.log.current() and sorted(h["filename"] for h in e.search(SearchRequest("seldom")).collect()) == ["f10.txt", "f5.txt"]

    def rows(terms):
        kept = terms.groupBy("term").agg(*(F.sum(c).alias(c) for c in terms.columns if c.startswith("df")))
        return sorted(tuple(r) for r in kept.collect() if any(r[1:]))

    from pyspark.sql import functions as F

    m = e.log.current()
    assert len(m.segments) == 3
    exact = rows(I.dictionary(e.index_of(m).rows))
    assert rows(e.index_of(m).terms) == exact
    assert e.index_of(m).frequencies(["seldom", "none"])["seldom"]["df"] == 2 and e.index_of(m).frequencies(["none"])["none"]["df"] == 0
    m = e.compact()
    assert rows(e.index_of(m).terms) == exact


def test_expressions_nest(spark, tmp_path):
    from skein.operators import expression as E
    from skein.operators import inverted as I
    from skein.operators.query import QueryError, split_words

    assert E.parse("a b") == E.Group((E.Leaf(("a",)), E.Leaf(("b",)))) and E.parse("(((a)))") == E.Leaf(("a",))
    assert E.parse('title:(x OR "y z"~2)^2') == E.Group((), (E.Leaf(("x",), "title"), E.Leaf(("y", "z"), "title", 2)), boost=2.0)
    assert E.parse("a OR b c OR -d") == E.Group((), (E.Leaf(("a",)), E.Group((E.Leaf(("b",)), E.Leaf(("c",))))), (E.Leaf(("d",)),))
    assert E.parse("+a OR b").must == (E.Leaf(("a",)),) and E.parse("http://x.y") == E.Leaf(("http", "x", "y"))
    for odd in ("", "()", "-", "OR", "^2", '""', "-a"):
        with pytest.raises(QueryError):
            E.parse(odd)
    for odd in ("title:", "a)", "(a", 'a "b', "a ^3 b", "((a OR ) b", "a AND AND b", ") a ("):
        assert E.parse(odd)

    rng = random.Random(11)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] for _ in range(90)]
    p = passages(spark, [(f"/d/{rng.choice(vocabulary)}.txt", rng.choice(vocabulary), " ".join(t)) for t in texts])
    I.write(p, str(tmp_path / "i"))
    index = I.Index.read(spark, str(tmp_path / "i"))
    stored = {r["passage_id"]: {f: split_words(r[f] or "") for f in E.FIELDS} for r in p.collect()}

    def count(leaf, words):
        def fits(at):
            end = at
            for w in leaf.words[1:]:
                end = next((k for k in range(end + 1, len(words)) if words[k] == w), None)
                if end is None:
                    return False
            return end - at - (len(leaf.words) - 1) <= leaf.slop

        return sum(words[k] == leaf.words[0] and fits(k) for k in range(len(words)))

    def holds(node, row):
        if isinstance(node, E.Leaf):
            return any(count(node, row[f]) for f in E.FIELDS if node.field in (None, f))
        if any(holds(x, row) for x in node.never):
            return False
        return all(holds(x, row) for x in node.must) if node.must else any(holds(x, row) for x in node.may)

    def made(depth=2):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["", "", "title:", "filename:"]) + rng.choice(vocabulary)
        if kind < 0.5:
            return f'"{rng.choice(vocabulary)} {rng.choice(vocabulary)}"' + rng.choice(["", "~1", "~4"])
        parts = [rng.choice(["", "", "", "-", "+"]) + made(depth - 1) for _ in range(rng.randint(2, 3))]
        return "(" + rng.choice([" ", " OR ", " AND "]).join(parts) + ")" + rng.choice(["", "^2"])

    for _ in range(14):
        text = made()
        try:
            node = E.parse(text)
        except QueryError:
            continue
        got = {r["passage_id"]: r["bm25"] for r in E.scored(index, node).collect()}
        assert set(got) == {k for k, row in stored.items() if holds(node, row)}, text
    one, two = (E.scored(index, E.parse(q)).collect() for q in ("alpha", "alpha^2"))
    assert {r["passage_id"]: round(2 * r["bm25"], 9) for r in one} == {r["passage_id"]: round(r["bm25"], 9) for r in two}


def test_postings_of_a_passage_are_made_in_its_row(spark, tmp_path, monkeypatch):
    from skein.operators import inverted as I

    bodies = ["b a b Ä", "", "a 日本 b", "c " * 5, None, "x1 y2 x1"]
    rows = spark.createDataFrame([(10 * i, f"s{i}", b, f"f{i}.txt", "A title a", "/x", f"/x/f{i}.txt") for i, b in enumerate(bodies)], "passage_id long, source_id string, body string, filename string, title string, folder string, path string")
    monkeypatch.setattr(I, "AT_ONCE", 2)
    plan = I.postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange rangepartitioning") == 1
    own = {f: T.tokens(F.col(f)) for f in I.FIELDS}
    wanted = {}
    for r in rows.select("passage_id", *(c.alias(f) for f, c in own.items())).collect():
        for f, k in I.FIELDS.items():
            for i, t in enumerate(r[f]):
                wanted.setdefault((t, r["passage_id"]), []).append((k << I.SHIFT) + i)
    I.write(rows, str(tmp_path / "at"))
    index = I.Index.read(spark, str(tmp_path / "at"))
    got = {(r["term"], r["passage_id"]): r["at"] for r in index.rows.collect()}
    assert got == wanted and index.rows.count() == len(wanted)
    assert index.counts == I.statistics(rows).first().asDict()
