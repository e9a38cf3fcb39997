"""The thin queries' contracts, and the defined cases of every operator and stage: empty tables, nulls, repeated rows, clashing names."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontamination, language_id, quality, queries, subwords, toxicity
from tests.llm.test_llm import ODD, prose, table

LABELS = "doc_id long, quality int, toxic int, lang string"


def remainder(i, modulus):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus


def corpus():
    """Documents with languages, and labels that the texts tell."""
    rng = random.Random(8)
    good, bad = prose(150, 21, 300), ["zz qq " * rng.randint(5, 30) for _ in range(150)]
    texts = [t if i % 2 else b for i, (t, b) in enumerate(zip(good, bad))] + [f"{t} vile muck {t}" for t in prose(150, 22, 300)] + ODD
    lang = ["en" if i % 3 else "de" for i in range(len(texts))]
    texts = [t if lang[i] == "en" or not t else t.translate(str.maketrans("eacd", "öäßü")) for i, t in enumerate(texts)]
    labels = [(i, int("zz" not in (t or "")), int("vile" in (t or "") or "vilö" in (t or "")), lang[i]) for i, t in enumerate(texts)]
    return texts, lang, labels


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables; and the same with all that no score may depend on changed."""
    texts, lang, labels = corpus()
    rows = [(i, t, lang[i], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "null id", "en", None, 7), (5, texts[5], lang[5], "s", 1)]
    out = []
    for changed in (None, 3, 4, 5):
        at = str(tmp_path_factory.mktemp("tables"))
        held = {3: 1, 4: 2, 5: 0}.get(changed)
        hide = lambda i: changed and remainder(i, changed) == held
        docs = [(i, t, ("xx" if changed == 4 else x) if hide(i) else x, "other" if hide(i) else s, n) for i, t, x, s, n in rows]
        known = [(i, 1 - q, 1 - x, "xx") if hide(i) else (i, q, x, g) for i, q, x, g in labels]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(known, LABELS).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(0, "none such words here at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out.append(at)
    return dict(zip((None, 3, 4, 5), out))


@pytest.mark.parametrize("name, modulus, held, limit", [("op2_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3), ("op5_language_id", 4, 2, None)])
def test_queries_of_classifiers_keep_their_contract(spark, folders, name, modulus, held, limit):
    texts, lang, labels = corpus()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    got = sorted(queries.QUERIES[name](spark, folders[None]).collect(), key=key)
    again = sorted(queries.QUERIES[name](spark, folders[modulus]).collect(), key=key)
    assert got == again  # labels, languages and sources of rows held out change nothing
    assert len(got) == len(texts) + 2 and got[5] == got[6]
    for r in got:
        assert r["held_out"] == (remainder(r["doc_id"], modulus) == held) and 0 <= r["score"] <= 1
        if limit:
            assert r["predicted"] == int(r["score"] >= limit)
    own = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300 + 150]
    if limit:
        truth = {i: (x if name == "op2_toxicity" else q) for i, q, x, _ in labels}
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]) > 0.9
    else:
        wordy = [r for r in own if "zz" not in texts[r["doc_id"]]]
        assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in wordy]) > 0.9
        assert {r["lang_pred"] for r in got if r["doc_id"] is not None and not any(c.isalpha() for c in texts[r["doc_id"]] or "")} == {"und"}


def test_pipeline_is_its_stages_by_brute_force(spark, folders):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folders[None]}/documents.parquet")
    texts, _, _ = corpus()
    toxic = toxicity.learn(docs, spark.read.parquet(f"{folders[None]}/labels.parquet"), F.lit(True))
    rows = {i: t for i, t in [*enumerate(texts), (None, "null id")]}
    left = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t) and toxic.score([t])[0] < p.TOXIC}
    from tests.llm.test_llm import sets

    s = dict(zip(left, sets(left.values(), 5)))
    kept = [i for i in sorted(left, key=lambda i: (i is None, i)) if i is not None]
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i for i in kept if find(i) == i} | ({None} if None in left else set())
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    got = p.run(spark, folders[None]).collect()
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert len(left) == 1 and "pipeline-bpe" in left.pop()  # no other work table stays
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables_give_empty_results(spark, tmp_path, name):
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert queries.QUERIES[name](spark, at).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("pipeline", "op8_decontamination")])
def test_repeated_rows_and_null_ids_give_a_row_each(spark, tmp_path, name):
    at = str(tmp_path)
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (7, "something else"), (None, "a null id"), (None, None), (8, "")]
    table(spark, [t for _, t in rows], [i for i, _ in rows], ["en"] * len(rows)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, 1, 0, "en"), (8, 0, 1, "en")], LABELS).write.parquet(f"{at}/labels.parquet")
    got = queries.QUERIES[name](spark, at)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _ in rows)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    at = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_sql_of_decontamination_counts_rows_and_short_items(spark, tmp_path):
    at = str(tmp_path)
    docs = [(0, "x one two y"), (0, "x one two y"), (1, "a b c d e f"), (2, "one"), (None, "one two"), (3, None)]
    items = [(8, "one two"), (9, "A b c d e f"), (9, "a b c d e f"), (10, ""), (None, "one")]
    table(spark, [t for _, t in docs], [i for i, _ in docs]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    want = con.execute(decontamination.ORACLE).fetchall()
    got = [tuple(r) for r in queries.op8_decontamination(spark, at).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 9


def test_items_are_partitioned_by_the_size_of_their_sets():
    texts = [" ".join(f"w{k}x{i}" for k in range(n)) for i, n in enumerate((10, 12, 2, 400))]
    items = decontamination.Items(list(range(4)), texts, 5, 0.8)
    assert {k: sorted(set(v[2].tolist())) for k, v in items.partitions.items()} == {(2, 0): [2], (5, 2): [0], (5, 3): [1], (5, 8): [3]}
    assert list(items.find(["z " + texts[0] + " z", texts[3]])) == [(0, 0, 6), (1, 3, 396)]


def test_many_languages_are_told_apart():
    names = [f"l{k:03d}" for k in range(150)]
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "aeioubcd") for k in range(150)]
    model = language_id.fit(texts, names)
    got, _ = model.predict(texts)
    assert got == names


def test_foreign_scripts_are_told_by_the_learnt_ones():
    model = language_id.fit(["plain words only here", "ganz andere worte da"], ["en", "de"])
    assert model.foreign(["plain words", "слова тут", "plain слова", None, "12"]).tolist() == [0, 1, 0.5, 0, 0]


def test_scripts_of_rare_blocks():
    model = language_id.fit(["plain words only here", "ganz andere worte da"], ["en", "de"])
    assert model.foreign(["ⰀⰁⰂ ⰃⰄ", "ⲀⲂ", "ⴰⴱⴳ", "𐌰𐌱", "한국어", "ខ្មែរ"]).tolist() == [1] * 6
    assert model.foreign(["Tiếng Việt ṩẇ ⱥⱦ", "— “…” →", "😀 😀", "plain ⰀⰁⰂⰃⰄ"]).tolist() == [0, 0, 0, 0.5]
    letter = lambda c: language_id.scripts(np.frombuffer((c + "     ").encode(), np.uint8))[0]
    assert [letter(c) for c in "aéαἀяքאعกあ漢𠀀가ⰀጀⲀ"] == [1, 1, 2, 2, 3, 4, 5, 6, 8, 9, 10, 10, 11, 12, 12, 12]
    assert [letter(c) for c in "—→ 1、😀"] == [0] * 6


def test_word_scores_are_sums_over_their_ngrams():
    rng = random.Random(9)
    make = lambda v: " ".join(rng.choice(v) for _ in range(200))
    model = language_id.fit([make(["alpha", "beta", "gäm", "d"]), make(["omega", "psi", "слово"])], ["aa", "bb"])
    texts = ["alpha psi", "  слово ", None, "d\tgäm 12", "unseen"]
    buffer = subwords.Buffer([t or "" for t in texts])
    scores, letters = model.word_scores(buffer)
    tables = {n: {} for n in language_id.SIZES}
    for n in language_id.SIZES:  # the bucket of each n-gram, by what it is in a text of its own
        for w in " ".join(t or "" for t in texts).split():
            data = f" {w} ".encode()
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if n == 1 and gram == b" " or n == 2 and gram.strip() == b"":
                    continue
                one = subwords.Buffer(["x"])
                one.bytes = np.frombuffer(gram + b"          ", np.uint8)
                one.space = one.bytes == 32
                tables[n][gram] = int(one.ngrams(n, language_id.BITS)[0][0])
    k, at = 0, [w for t in texts for w in (t or "").split()]
    assert len(scores) == len(at)
    for word, got, n_letters in zip(at, scores, letters):
        data = f" {word} ".encode()
        want = [sum(float(model.tables[n][lang][tables[n][data[i : i + n]]]) for n in language_id.SIZES for i in range(len(data) - n + 1) if not (n == 1 and data[i : i + 1] == b" ")) for lang in range(2)]
        assert n_letters == sum(c.isalpha() for c in word)
        script = {True: 3, False: 1}["с" in word or "о" in word]
        off = [0 if model.allowed[script][lang] else -100.0 for lang in range(2)]
        assert got.tolist() == pytest.approx([w + o if n_letters else got[i] for i, (w, o) in enumerate(zip(want, off))], abs=1e-3), word


def test_spans_are_a_column_of_the_query(spark, folders):
    texts, _, _ = corpus()
    rows = queries.op5_language_id(spark, folders[None]).collect()
    for r in rows:
        n = len((texts[r["doc_id"]] if r["doc_id"] is not None else "null id") and (texts[r["doc_id"]] if r["doc_id"] is not None else "null id").split() or [])
        if r["lang_pred"] == "und":
            assert r["spans"] == []
        else:
            assert r["spans"][0]["first"] == 0 and r["spans"][-1]["end"] == n and all(a["end"] == b["first"] and a["lang"] != b["lang"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_small_samples_are_fitted():
    for texts, y in (["a b", "c d", "e f", "g h", "fine"], [1, 1, 1, 1, 0]), ([" ", " "], [0, 1]), (["bad", "good"], [1, 0]), ([" ", "bad", "bad", "bad"], [0, 1, 1, 1]):
        s = toxicity.fit(texts, np.array(y)).score([*texts, None, ""])
        assert ((s >= 0) & (s <= 1)).all()
    for texts, y in (["good text", "bad"], [1, 0]), (["x"], [1]), ([], []), (["a", "b", "c"], [0, 0, 1]):
        s = quality.fit(texts, np.array(y, np.int64)).score([*texts, None, ""])
        assert ((s >= 0) & (s <= 1)).all()


def test_samples_stay_within_their_bounds(spark):
    texts = ["same " * 50] * 1000 + ["long " * 2000] * 20 + [f"row {k}" for k in range(200)]
    ids = [1] * 1000 + list(range(2, 22)) + list(range(100, 300))
    docs = table(spark, texts, ids, ["en"] * len(ids))
    labels = spark.createDataFrame([(i, i % 2, i % 2, "en") for i in sorted(set(ids))], LABELS)
    got, y = subwords.labelled(docs, labels, "toxic", F.lit(True), 60, 30_000)
    assert got.count("same " * 50) <= 1 and max(map(len, got)) <= 1500 and len(got) <= 60
    assert all(sum(len(t) for t, v in zip(got, y) if v == k) <= 15_000 for k in (0, 1)) and set(y) == {0, 1}
    kept = subwords.fetch_texts(subwords.one_text(docs.filter("doc_id < 300"), ["lang", "doc_id"]), ["lang", "doc_id"], 50, 3_000, 11)
    assert 0 < len(kept) <= 50 and sum(len(t) for *_, t in kept) <= 3_000 and len({i for _, i, _ in kept}) == len(kept)
