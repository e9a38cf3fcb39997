"""The engine: cheap rescans, several writers, errors of a listing, versions of recipes and models, the quantised index."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.engine import Engine, SearchRequest
from skein.operators import filters as X
from skein.operators import quantised as Q
from skein.sources import discovery, extract
from skein.sources.manifest import Conflict, Log, Manifest


def names(e, q, mode="text", **k):
    return sorted(h["filename"] for h in e.search(SearchRequest(q, mode, **k)).collect())


def counting(folder):
    """A parser that leaves a file for each call, as it runs in other processes."""
    os.makedirs(folder, exist_ok=True)

    def parse(data, ext):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return extract.parse(data, ext)

    return parse, lambda: len(os.listdir(folder))


@pytest.fixture
def docs(tmp_path):
    at = tmp_path / "docs"
    (at / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "alpha budget"), ("b.txt", "beta budget"), ("sub/c [1].txt", "gamma stone"), ("sub/d*.txt", "delta stone")):
        (at / name).write_text(text)
    return at


def test_only_changed_files_are_read_and_idle_scans_publish_nothing(spark, tmp_path, docs):
    e = Engine(spark, str(tmp_path / "index"))
    parse, calls = counting(str(tmp_path / "calls"))
    e.index_folder(str(docs), "r", parse)
    assert calls() == 4
    m = e.log.current()
    assert e.reconcile(str(docs), "r", parse) == m and e.log.current() == m and calls() == 4
    cursor = e.cursor(0)
    assert e.search(SearchRequest("budget", cursor=cursor)).count() == 2  # still good after an idle scan
    (docs / "sub/c [1].txt").write_text("gamma budget, changed")
    assert len(e.reconcile(str(docs), "r", parse).segments) == 2 and calls() == 5
    assert names(e, "budget") == ["a.txt", "b.txt", "c [1].txt"] and names(e, "stone") == ["d*.txt"]
    assert not [f for f in os.listdir(tmp_path / "index") if f.startswith("scan-")]
    (docs / "a.txt").unlink()
    after = e.reconcile(str(docs), "r", parse)
    assert calls() == 5 and after.counts["n"] == 3 and names(e, "alpha") == []


def test_many_changed_files_are_read_by_a_scan(spark, tmp_path, docs, monkeypatch):
    import skein.engine

    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    monkeypatch.setattr(skein.engine, "NAMED", 1)
    for name in ("a.txt", "b.txt", "e.txt"):
        (docs / name).write_text("omega stone wall")
    e.reconcile(str(docs), "r")
    assert names(e, "omega") == ["a.txt", "b.txt", "e.txt"] and names(e, "budget") == []


def test_a_scan_with_errors_removes_nothing(spark, tmp_path, docs):
    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    (docs / "a.txt").unlink()
    here = os.getcwd()
    os.chdir(docs)
    try:
        for _ in range(18):  # a path too long to be opened
            os.mkdir("x" * 250)
            os.chdir("x" * 250)
    finally:
        os.chdir(here)
    rows = {r["kind"]: r for r in discovery.scan(spark, str(docs), "r").collect()}
    assert set(rows) == {"file", "error"} and "long" in rows["error"]["error"]
    e.reconcile(str(docs), "r")
    assert names(e, "alpha") == ["a.txt"]
    (docs / "e.txt").write_text("epsilon")
    assert Engine(spark, e.base, X.Policy(prefixes=(str(docs / "b.txt"),))).reconcile(str(docs), "r").counts["n"] == 4  # new ones come, excluded ones go
    assert names(e, "epsilon") == ["e.txt"] and names(e, "alpha") == ["a.txt"] and names(e, "beta") == []
    os.rename(docs, tmp_path / "away")  # a root that isn't there, as when its volume is not mounted
    assert e.reconcile(str(docs), "r").counts["n"] == 4
    os.rename(tmp_path / "away", docs)
    os.rename(docs / ("x" * 250), tmp_path / "long")
    e.reconcile(str(docs), "r")
    assert names(e, "alpha") == []


def test_listing_tells_links_placeholders_and_hidden_files(spark, tmp_path):
    at = tmp_path / "d"
    (at / "one" / "two").mkdir(parents=True)
    (at / "Skipped").mkdir()
    (at / ".hidden").mkdir()
    for name in ("f", "one/f", "one/two/f", "Skipped/f", ".hidden/f", ".f"):
        (at / name).write_text("x")
    os.link(at / "f", at / "hard")
    os.symlink(at / "f", at / "soft")
    os.symlink(at, at / "one" / "loop")
    with open(at / "away", "wb") as f:
        f.truncate(1 << 20)  # a size without blocks
    for tasks in (1, 2, 64):
        rows = {r["path"][len(str(at)) + 1 :]: r for r in discovery.listing(spark, str(at), ("skipped",), tasks).collect()}
        assert {p: r["kind"] for p, r in rows.items()} == {"f": "file", "hard": "file", "away": "file", "one/f": "file", "one/two/f": "file", "soft": "link", "one/loop": "link"}
        assert rows["f"]["inode"] == rows["hard"]["inode"] and rows["f"]["links"] == 2 and rows["away"]["placeholder"] and not rows["f"]["placeholder"]
    scanned = {r["path"]: r for r in discovery.scan(spark, str(at), "r").collect()}
    read = {r["path"]: r for r in discovery.discover(spark, str(at), "r").collect()}
    assert scanned[f"{at}/away"]["availability"] == "waitingForDownload"
    for p, r in read.items():
        if "loop" not in p and "soft" not in p:
            assert [r[c] for c in ("source_id", "modified_at", "size", "filename")] == [scanned[p][c] for c in ("source_id", "modified_at", "size", "filename")]
    one = lambda p: discovery.scan_one(spark, str(at / p), str(at), "r", X.Policy()).count()
    assert [one(p) for p in ("f", "gone", "soft", ".f", ".hidden/f", "one", "../x")] == [1, 0, 0, 0, 0, 0, 0]


def test_two_writers_lose_nothing(spark, tmp_path, docs):
    base = str(tmp_path / "index")
    e = Engine(spark, base)
    e.index_folder(str(docs), "r")
    m = e.log.current()
    log = Log(spark, base)
    log.publish(m.after())
    with pytest.raises(Conflict):
        log.publish(m.after())
    assert not [f for f in os.listdir(f"{base}/manifests") if "draft" in f and not f.endswith(".crc")]
    row = lambda name: e.read_folder(str(docs), "r", paths=[f"{docs}/{name}"])
    (docs / "e.txt").write_text("epsilon")
    (docs / "f.txt").write_text("zeta")
    publish, first = log.publish, []

    def late(manifest):  # another writer comes between reading the newest generation and publishing
        if not first:
            first.append(1)
            Engine(spark, base).apply(row("e.txt"))
        return publish(manifest)

    e.log.publish = late
    e.apply(row("f.txt"), spark.createDataFrame([(r["source_id"],) for r in e.files().filter("filename = 'a.txt'").collect()], "source_id string"))
    assert names(e, "epsilon") == ["e.txt"] and names(e, "zeta") == ["f.txt"] and names(e, "alpha") == []
    whole = Engine(spark, str(tmp_path / "whole"))
    (docs / "a.txt").unlink()
    whole.index_folder(str(docs), "r")
    assert e.log.current().counts == whole.log.current().counts


def test_recipes_retries_and_policies(spark, tmp_path, docs):
    (docs / "x.rtf").write_text(r"{\rtf1 rich text}")
    base = str(tmp_path / "index")
    parse, calls = counting(str(tmp_path / "calls"))
    failing = lambda data, ext: (None, "panic") if ext == "rtf" else extract.parse(data, ext)
    e = Engine(spark, base)
    e.index_folder(str(docs), "r", failing)
    assert names(e, "rich") == [] and e.issues().first()["path"].endswith("x.rtf")
    e.reconcile(str(docs), "r", parse)
    assert calls() == 0
    e.reconcile(str(docs), "r", parse, retry=True)
    assert calls() == 1 and names(e, "rich") == ["x.rtf"]
    Engine(spark, base, recipes={"rtf": 1}).reconcile(str(docs), "r", parse)
    assert calls() == 1
    newer = Engine(spark, base, recipes={"rtf": 2})
    newer.reconcile(str(docs), "r", parse)
    assert calls() == 2 and newer.reconcile(str(docs), "r", parse) == newer.log.current() and calls() == 2
    left = Engine(spark, base, X.Policy(prefixes=(str(docs / "sub"),)))
    assert left.purge().counts["n"] == 3 and left.purge() == left.log.current()


def test_models_are_not_mixed_and_generations_are_trimmed(spark, tmp_path, docs):
    e = Engine(spark, str(tmp_path / "index"))
    e.index_folder(str(docs), "r")
    m = e.embed()
    assert e.embed() == m  # nothing to do
    short = lambda texts: [[float("stone" in t), float("budget" in t), 0.1] for t in texts]
    e.embed(short, "short")
    assert {len(r["embedding"]) for r in e._vectors(e.log.current()).collect()} == {3}
    hits = e.search(SearchRequest("stone", "semantic", limit=2), short).collect()
    assert {h["filename"] for h in hits} == {"c [1].txt", "d*.txt"}
    rows = [(r["source_id"], r["filename"]) for r in e.files().collect()]
    e.embed_cards(spark.createDataFrame(rows, "source_id string, text string"), short)
    e.embed_cards(spark.createDataFrame([(rows[0][0], "stone")], "source_id string, text string"), short)
    assert spark.read.parquet(f"{e.base}/{e.log.current().cards}").count() == 4  # one is put in place, the others stay
    assert e.reset_embeddings().model is None and not e.ready() and e.reset_embeddings() == e.log.current()
    e.compact()
    assert len(Log(spark, e.base).generations()) == 2 and len([f for f in os.listdir(e.base) if f.startswith("segment")]) == 2
    assert Manifest() == Log(spark, str(tmp_path / "none")).current()


# --- the quantised index ------------------------------------------------------------------------------------------------


def clustered(n, width=64, seed=5):
    """Vectors round ten centres, with more noise than centre, as the embeddings of the tables are."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(10, width))[rng.integers(0, 10, n)] * 0.45 + rng.normal(size=(n, width))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n", [20_000, 60_000])
def test_recall_at_a_twentieth_of_the_bytes(spark, tmp_path, n):
    import pyarrow as pa

    m = clustered(n)
    lists = pa.ListArray.from_arrays(np.arange(0, n * 64 + 1, 64, dtype=np.int32), m.reshape(-1))
    rows = spark.createDataFrame(pa.table({"key": np.arange(n), "embedding": lists, "name": [f"n{i}" for i in range(n)]}))
    Q.write(rows.repartition(6), str(tmp_path / "i"))
    index = Q.Index(spark, str(tmp_path / "i"))
    assert index.number == n and index.vectors().select("key").distinct().count() == n
    codes = {r["coarse"]: r["n"] for r in index._codes.groupBy("coarse").agg(F.sum(F.length("codes")).alias("n")).collect()}
    assert sum(codes.values()) == n * 16  # a byte for four dimensions of each vector
    found, read = 0, []
    for key in range(0, n, n // 20):
        q = m[key].astype(np.float64)
        exact = set(np.argsort(-(m @ q), kind="stable")[:10].tolist())
        hits = index.search(q.tolist(), 10).collect()
        assert [h["name"] for h in hits] == [f"n{h['key']}" for h in hits]
        found += len(exact & {h["key"] for h in hits})
        base, _ = index.quantiser.tables(q)
        read.append(sum(codes.get(c, 0) for c in index.quantiser.folders(base, Q.SHARE)) + max(210, n // Q.PART) * 256)
    assert found >= 0.95 * 10 * len(read), found  # recall at 10
    assert np.mean(read) <= 0.05 * n * 256  # bytes of codes and of candidates beside those of all vectors
    exactly = [h["key"] for h in index.search(m[7].tolist(), 25, exact=True).collect()]
    assert exactly == np.argsort(-(m @ m[7].astype(np.float64)), kind="stable")[:25].tolist()


def test_small_odd_and_hot_vectors(spark, tmp_path):
    same = [(i, [1.0, 0.0, 0.5]) for i in range(3000)]  # one cell, several blocks
    rows = spark.createDataFrame([*same, (5000, [0.0, 0.0, 0.0]), (5001, [0.0, 1.0, 0.0]), (5002, None)], "key long, embedding array<float>")
    assert Q.write(rows, str(tmp_path / "a")) == 3002
    index = Q.Index(spark, str(tmp_path / "a"))
    assert [r["key"] for r in index.search([0.0, 1.0, 0.0], 1, most=5).collect()] == [5001]
    assert [r["key"] for r in index.search([1.0, 0.0, 0.5], 2000).collect()] == list(range(2000))
    gone = index.search([0.0, 1.0, 0.0], 3, most=1, alive=lambda r: r.filter("key < 10")).collect()
    assert [r["key"] for r in gone] == [0, 1, 2]  # more candidates are looked at
    assert Q.write(rows.filter("key > 9000"), str(tmp_path / "b")) == 0
    assert Q.Index(spark, str(tmp_path / "b")).search([1.0], 3).count() == 0
    with pytest.raises(Exception, match="3 components"):
        Q.write(rows.filter("key < 5002").unionByName(spark.createDataFrame([(9, [1.0])], "key long, embedding array<float>")), str(tmp_path / "c"))


def test_pages_are_parts_of_one_list(spark, tmp_path):
    texts = [" ".join(["pine"] * (1 + i % 7) + ["oak"] * (1 + i % 5) + [f"w{j}" for j in range(i % 90)]) + (" pine" if i % 3 else " rare pine") for i in range(400)]
    rows = [(f"s{i}", "r", f"/r/f{i}.txt", f"f{i}.txt", "txt", None, len(t), "available", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "source_id string, root_id string, path string, filename string, extension string, modified_at timestamp_ntz, size long, availability string, text string")
    e = Engine(spark, str(tmp_path / "index"))
    e.index(docs)
    page = lambda k, n, depth: [r["source_id"] for r in e.search(SearchRequest("pine oak rare OR", limit=n, cursor=e.cursor(k, depth))).collect()]
    whole = page(0, 90, 0)
    assert len(whole) == 90 and page(0, 30, 90) == whole[:30] and page(60, 30, 90) == whole[60:]


def test_equal_cosines_are_ties_and_close_ones_are_not(spark, tmp_path):
    """Scores are SQL's to the last digit where a model counts: ties go by source, at the cut of candidates too."""
    from math import sqrt

    from skein.plans.engine_queries import letters

    rng = np.random.default_rng(5)
    counted = lambda *n: "".join(c * int(k) for c, k in zip("aionst", n))
    texts = [counted(*rng.permutation([1, 2, 3, 4, 5]), 6) for _ in range(200)]  # the query has these letters once and two t
    texts += [counted(*[3001] * 5, n) for n in range(6000, 6040)]
    texts += ["station"] * 600  # more than there are candidates
    ids = [f"s{x:04d}" for x in rng.permutation(len(texts))]
    rows = spark.createDataFrame([(i, "r", f"/r/{i}.txt", f"{i}.txt", "txt", None, len(t), "available", t) for i, t in zip(ids, texts)], "source_id string, root_id string, path string, filename string, extension string, modified_at timestamp_ntz, size long, availability string, text string")
    q = letters(["station"])[0]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    score = lambda t: dot(v := letters([t])[0], q) / (sqrt(dot(v, v)) * sqrt(dot(q, q)))
    best = sorted((-score(t), i) for i, t in zip(ids, texts))
    for part, name in ((rows, "all"), (rows.filter("text <> 'station'"), "some")):
        e = Engine(spark, str(tmp_path / name))
        e.index(part.repartition(3), words=False)
        e.embed(letters, "letters")
        got = [(-h["score"], h["source_id"]) for h in e.search(SearchRequest("station", "semantic", limit=200, exact=True), letters).collect()]
        assert got == [b for b in best if name == "all" or texts[ids.index(b[1])] != "station"][:200]
