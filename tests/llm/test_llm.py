"""The operators beside brute force, exact round trips and held-out accuracy; and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, fingerprints, jaccard_join, language_id, license_scan, lm_scoring, quality, queries, token_files, toxicity
from skein.llm.common import COUNTERS, Words, filter_rows, id_remainder, mix
from skein.llm.components import _by_rounds, components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, block string"
ODD = [None, "", " \n\t", "x", "Ärger İ Σ 日本 😀", "a " * 3000, "same words here and there", "same words here and there", "́ 1.2 <|endoftext|>", "no" * 5000]


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


def table(spark, texts, ids=None, langs=None):
    """documents with extra columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (langs or [None] * len(texts))[k], None, None, "s", "n", "b") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(n, seed=1, vocabulary=60):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(v[min(int(rng.expovariate(0.1)), vocabulary - 1)] for _ in range(rng.randint(1, 60))) for _ in range(n)]


# --- 1: language-model scoring -----------------------------------------------------------------------------------------


def brute_lm(texts, training, order=3):
    docs = [words(t) + ["</s>"] for t in texts]
    n_grams = {k: Counter() for k in range(1, order + 1)}
    hashes = {"</s>": lm_scoring.END} | {w: Words([w]).hashes[0] for d in docs for w in d[:-1]}

    def bigram(a, b):
        with np.errstate(over="ignore"):
            return int(mix(np.array([hashes[a] * np.uint64(0xD6E8FEB86659FD93) + hashes[b]]))[0]) & (1 << COUNTERS) - 1

    counters = Counter()
    for d, learn in zip(docs, training):
        if learn:
            for a, b in zip(["</s>", *d], d):
                counters[bigram(a, b)] += 1
    common = lambda a, b: counters[bigram(a, b)] > 5  # noqa: E731  # the usual counter is 0 in so few texts

    def arc(h, w):
        """Whether the words h, then w, can be an arc of their state."""
        return len(h) == 1 or (h[-1] != "</s>" and common(*h) and common(h[-1], w))

    def history(d, i, k):
        line = ["</s>", *d]
        h = tuple(line[max(0, i + 1 - k) : i + 1])
        return h if len(h) == k else None

    for d, learn in zip(docs, training):
        for i, w in enumerate(d):
            if learn:
                n_grams[1][(w,)] += 1
                for k in range(1, order):
                    if (h := history(d, i, k)) and arc(h, w):
                        n_grams[k + 1][(*h, w)] += 1
    n, v = sum(n_grams[1].values()), len(n_grams[1])
    ds = {k: lm_scoring.discounts(*(sum(x == c for x in g.values()) for c in (1, 2, 3, 4))) for k, g in n_grams.items()}
    spare = sum(ds[1][min(c, 3)] for c in n_grams[1].values()) / n if n else 1
    left = {k: Counter() for k in range(1, order)}  # of each state, what its arcs leave
    for k in range(1, order):
        for g, c in n_grams[k + 1].items():
            left[k][g[:-1]] += min(c, ds[k + 1][min(c, 3)]) - c

    def p(h, w):
        if not h:
            c = n_grams[1][(w,)]
            return (max(c - ds[1][min(c, 3)], 0) / n if n else 0) + spare / (v + 1)
        whole = n_grams[len(h)][h]
        if not whole or (len(h) > 1 and (h[-1] == "</s>" or not common(*h))):
            return p(h[1:], w)
        c = n_grams[len(h) + 1][(*h, w)]
        return max(c - ds[len(h) + 1][min(c, 3)], 0) / whole + (whole + left[len(h)][h]) / whole * p(h[1:], w)

    out = []
    for d in docs:
        base = sum(math.log10((n_grams[1][(w,)] + 1) / (n + v + 1)) for w in d)
        score = sum(math.log10(p(next(h for k in range(order - 1, 0, -1) if (h := history(d, i, k))), w)) for i, w in enumerate(d))
        out.append((len(d), sum(n_grams[1][(w,)] > 0 for w in d), n, base, score))
    known = [w for (w,) in n_grams[1]]
    states = [h for k in range(1, order) for h in list({g[:-1] for g in n_grams[k + 1]})[:5]]
    sums = [sum(p(h, w) for w in known) + spare / (v + 1) * math.prod((n_grams[len(x)][x] + left[len(x)][x]) / n_grams[len(x)][x] for x in (h[i:] for i in range(len(h)))) for h in states]
    return out, sums


@pytest.mark.parametrize("chars, order", [(300, 3), (10**7, 3), (2000, 2)])
def test_lm_scores_are_the_models(spark, chars, order):
    texts = prose(150) + ["one of the usual lines", "one of the usual words"] * 8 + ODD
    training = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in lm_scoring.score(table(spark, texts), id_remainder(7) != 2, chars, 2000, order).collect()}
    want, sums = brute_lm(texts, training, order)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not training[i])
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    assert sums == pytest.approx([1] * len(sums)) and len(sums) >= 5 * (order - 1)
    assert (sum(r["n_long_arcs"] for r in got.values()) > 100) == (order > 2)


def test_lm_cases(spark):
    assert lm_scoring.score(table(spark, []), id_remainder(7) != 2).count() == 0
    r = lm_scoring.score(table(spark, ["a b"]), F.lit(False)).first()
    assert (r["n_known"], r["base_score"], r["score"], r["held_out"]) == (0, 0.0, 0.0, True)
    assert lm_scoring.score(table(spark, ["a", "a"], [None, None]), id_remainder(7) != 2).filter("held_out").count() == 0
    with pytest.raises(ValueError):
        lm_scoring.score(table(spark, ["a"]), F.lit(True), order=1)


# --- 2, 5, 10: classifiers ----------------------------------------------------------------------------------------------


def test_bounds_of_toxic_and_clean_runs_are_parameters(monkeypatch):
    texts, seen, train = prose(400, 4, 300), [], toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda ids, inside, at, y, *a: seen.append(y) or train(ids, inside, at, y, *a))
    y = np.array([0, 1] * 200)
    toxicity.fit(texts, y, epochs=1)
    toxicity.fit(texts, y, epochs=1, toxic_runs=10, clean_runs=20)
    assert all(y.sum() > 10 and (y == 0).sum() > 30 for y in seen[:2])
    assert len(seen) == 4 and all(y.sum() == 10 and 20 <= (y == 0).sum() <= 30 for y in seen[2:])


def test_toxicity_finds_misspellings(spark):
    clean, others = (prose(1600, 3, 400)[k] for k in (slice(900), slice(900, None)))  # of one vocabulary
    rng = random.Random(5)
    bad = ["worthless", "disgusting", "pathetic"]
    toxic = []
    for t in others:
        w = t.split()
        w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        toxic.append(" ".join(w))
    model = toxicity.fit([x for p in zip(clean[:700], toxic) for x in p], np.array([0, 1] * 700))
    assert (model.score(["a bc disgustingg d", "b worthles a"]) > 0.5).all()
    assert (model.score(clean[700:]) > 0.5).mean() < 0.1
    long = " ".join(clean[700:800]) + " pathetic " + " ".join(clean[800:])
    assert model.score([long])[0] > 0.5
    got = toxicity.score(table(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit([], np.array([], int)).score([None, "x"]).tolist() == pytest.approx([0, 0], abs=1e-9)


LANGS = {"en": "the of and to in that is was for on with as his they", "de": "der die und in den von zu das mit sich des auf für ist", "fr": "le la de et les des en un une du que dans qui sur", "ru": "и в не на я быть он с что это по"}


def test_language_spans():
    rng = random.Random(2)
    make = lambda k, n: " ".join(rng.choice(LANGS[k].split()) for _ in range(n))
    names = [k for k in LANGS for _ in range(40)]
    model = language_id.fit([make(k, 30) for k in names], names)
    for k in LANGS:
        assert model.predict([make(k, 25)])[0] == [k]
    spans = model.spans(make("en", 30) + " " + make("de", 30))
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - 30) <= 2
    names, share = model.predict(ODD + ["123 !?", "слово"])
    assert names[:3] == ["und"] * 3 and names[-2:] == ["und", "ru"] and all(0 <= s <= 1 for s in share)
    assert language_id.fit([], []).predict(["x", None]) == (["und", "und"], pytest.approx([0, 0]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 5, 7, 3])
    first = np.concatenate(([0], np.cumsum(counts)))
    scores = rng.normal(0, 2, (counts.sum(), 3))
    path = language_id.viterbi(scores, first, counts, 1.5)
    value = lambda p, s: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(first, first[1:]):
        if b > a:
            from itertools import product

            best = max(value(p, scores[a:b]) for p in product(range(3), repeat=b - a))
            assert value(path[a:b].tolist(), scores[a:b]) == pytest.approx(best)


def test_quality_by_compression(spark):
    good = prose(300, 6, 300)
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in prose(300, 7, 300)]
    model = quality.fit([x for p in zip(good[:200], bad[:200]) for x in p], np.array([1, 0] * 200))
    s = model.score(good[200:] + bad[200:])
    assert (s[:100] >= 0.3).mean() > 0.9 and (s[100:] >= 0.3).mean() < 0.1
    got = quality.score(table(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.fit([], np.array([], int)).score([None]).tolist() == [0.5]
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


# --- 3, 4: tokens -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def noise(n, seed):
    rng = random.Random(seed)
    parts = [" ", "\n", "  ", "a", "the", "ing", "'s", "É", "ß", "日本", "😀", "1", "!", ".", "\t", "\xa0", "\x1c", "<|endoftext|>", "<", "Σ", "́", "\r"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_bpe_is_the_librarys(spark, library):
    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = ODD + noise(300, 1) + ["".join(random.Random(k).choice("aeinrst") for _ in range(4000)) for k in range(3)]
    got = {r["doc_id"]: r for r in bpe.round_trip(table(spark, texts), path).collect()}
    rows = {r["doc_id"]: r for r in bpe.encode_rows(table(spark, texts), path).collect()}
    h = library["word_bpe_49k.json"]
    for i, t in enumerate(texts):
        ids = h.encode(t or "", add_special_tokens=False).ids
        decoded = hashlib.sha256(h.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["decoded_sha256"]) == (len(ids), decoded)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["ids"] == ids and rows[i]["decoded_sha256"] == decoded
    readable = "hello wörld 😀 "
    assert bpe.round_trip(table(spark, ["Hello wörld 😀"]), path).first()["readable_sha256"] == hashlib.sha256(readable.encode()).hexdigest()
    clash = table(spark, ["a b"]).withColumns({c: F.lit("x") for c in bpe.MADE})
    assert bpe.encode_rows(clash, path).select("n_tokens", "source").first() == (2, None)
    back = bpe.decode(bpe.encode(table(spark, ["Hello wörld 😀"]), path), path).first()["text"]
    assert back == "hello wörld 😀 "
    assert bpe.round_trip(table(spark, []), path).count() == 0


def test_every_code_point_is_read_as_the_library_reads_it(library):
    t, h = bpe.Tokenizer(queries.tokenizer_path("word_bpe_49k.json")), library["word_bpe_49k.json"]
    for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 997)]:
        x = f"a{chr(c)}b {chr(c)}. A{chr(c)}"
        assert t.encode(x) == h.encode(x, add_special_tokens=False).ids, hex(c)


def test_words_pass_the_transducer_and_the_state_machine(spark, monkeypatch):
    path, seen = queries.tokenizer_path("word_bpe_49k.json"), []
    stream, text = bpe.Transducer.stream, bpe.TextDecoder.text
    monkeypatch.setattr(bpe.Transducer, "stream", lambda self, s, w: seen.append("e") or stream(self, s, w))
    monkeypatch.setattr(bpe.TextDecoder, "text", lambda self, ids: seen.append("d") or text(self, ids))
    t = bpe.Tokenizer(path)
    parts = [p for own in t.pieces("Two wörds\t" + "long " * 30_000 + "z" * 5000) for p in zip(*own)]
    assert sum(p[2] for p in parts) == 30_000 + 2 + len(t.encode("z" * 5000)) + t.encode("Two wörds").__len__() - 2
    assert seen.count("d") == 4 and seen.count("e") >= 4
    assert "".join(p[4] for p in parts) == "two wörds " + "long " * 30_000 + "z" * 5000 + " "


def test_streamed_words_are_whole_words():
    t = bpe.Tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(3)
    for n in (1300, 5000):
        w = "".join(rng.choice("aaabers") for _ in range(n))
        ids = [t.plain[c] for c in w[:-1]] + [t.last[w[-1]]]
        assert t.word(w) == t.transducer.merge(ids)


def test_token_files(spark, library):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ODD + noise(200, 2)
    ids = [None, *range(1, len(texts))]
    got = token_files.written_checksums(table(spark, texts, ids), path).collect()
    h = library["byte_bpe_50k.json"]
    expected, start = [], 0
    for i, t in zip(ids, texts):
        own = [*h.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == expected
    assert token_files.written_checksums(table(spark, []), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 8192, 30_000])
def test_frames(n):
    tokens = (np.random.default_rng(n).zipf(1.4, n) % 50_000).astype("<u4")
    data = token_files.encode_frame(tokens)
    assert (token_files.decode_frame(data) == tokens).all()
    if n > 8192:
        assert (token_files.decode_frame(data, slice(1, 3)) == tokens[8192 : 3 * 8192]).all()
        assert len(data) < 2 * n * 2
        with pytest.raises(ValueError):
            token_files.decode_frame(data[:-10] + bytes([data[-10] ^ 1]) + data[-9:])


# --- 6, 7, 8, 9 ---------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    texts = [t * 4 for t in prose(30, 8)] + ODD
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    n = len(texts)
    prints = lambda t: fingerprints.winnow([t.encode()])[0][0]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i - 1) % n] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] if len(t) // 2 else t
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.as_text(prints(t)) and r["edited_fingerprint"] == fingerprints.as_text(prints(e))
        assert r["near_edited"] == fingerprints.likeness(prints(t), prints(e)) and r["near_next"] == fingerprints.likeness(prints(t), prints(nxt))
    assert fingerprints.compare_edited(table(spark, [])).count() == 0
    assert fingerprints.compare_edited(table(spark, ["ab"])).first()["near_next"] == 1.0


def test_winnowing_keeps_the_rightmost_smallest():
    data = (" ".join(prose(3, 9)) * 3).encode()
    h = fingerprints._kgrams(np.frombuffer(data.lower(), np.uint8)).tolist()
    kept = []
    for i in range(len(h) - fingerprints.W + 1):
        w = h[i : i + fingerprints.W]
        p = i + max(j for j, x in enumerate(w) if x == min(w))
        if not kept or kept[-1] != p:
            kept.append(p)
    hashes, places = fingerprints.winnow([data])[0]
    assert places.tolist() == kept and hashes.tolist() == [h[p] for p in kept]


def test_edited_short_texts_keep_a_hash(spark):
    whole = " ".join(prose(200, 31, 900))
    texts = [whole[i * 260 : i * 260 + n] for i, n in enumerate(n for n in (30, 60, 90, 126, 180, 253) for _ in range(3))]
    assert len(texts[-1]) == 253
    rows = fingerprints.compare_edited(table(spark, texts)).collect()
    assert len(rows) == len(texts) and all(r["near_edited"] > 0 for r in rows)


def test_more_notices_are_known(spark):
    gnu = "This %s is free software%s you can redistribute it and/or modify\nit under the terms of the GNU %s as published by\nthe Free Software Foundation%s either version %s of the License, or\n(at your option) any later version.\n"
    bsd = ["conditions", "source", "binary", "endorse"]
    want = {
        gnu % ("program", ":", "General Public License", ",", "3"): "GPL-3.0-or-later", gnu % ("program", ";", "General Public License", ";", "2"): "GPL-2.0-or-later",
        gnu % ("library", ";", "Lesser General Public License", ";", "2.1"): "LGPL-2.1-or-later", gnu % ("program", ":", "Affero General Public License", ",", "3"): "AGPL-3.0-or-later",
        (gnu % ("program", ":", "General Public License", ",", "3")).replace("\n", " "): "GPL-3.0-or-later",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
        "// SPDX-License-Identifier: LGPL-3.0-or-later\n#include <a.h>": "LGPL-3.0-or-later", "# SPDX-License-Identifier: MIT": "MIT",
    }
    texts = [*want, "\n".join(license_scan.SENTENCES[f"bsd-{k}"].capitalize() + "." for k in bsd)]
    got = {r["doc_id"]: r["licences"].split() for r in license_scan.report(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(want))] == [[x] for x in want.values()] and got[len(want)] == ["BSD-3-Clause"]


def test_license_scan(spark):
    mit = license_scan.SENTENCES["mit-grant"].capitalize() + ".\n" + license_scan.SENTENCES["mit-notice"] + "."
    wrapped = "Licensed under the Apache License,\nversion 2.0. All rights reserved."
    r = {x["doc_id"]: x for x in license_scan.report(table(spark, [mit, wrapped, license_scan.SENTENCES["mit-notice"], *ODD])).collect()}
    assert r[0]["licences"] == "MIT" and r[1]["licences"] == "Apache-2.0 all-rights-reserved" and r[2]["licences"] == "" and r[2]["n_sentences"] == 1
    assert all(r[i]["n_sentences"] == 0 for i in range(3, 3 + len(ODD)))
    triggers = license_scan.triggers_of(license_scan.SENTENCES)
    assert len(triggers) < 12 and all(any(t in s for t in triggers) for s in license_scan.SENTENCES.values())
    own = license_scan.scan(table(spark, ["Do as you like. Really."]), {"free": "do as you like"}, [("Free", ["free"])]).first()
    assert own["licences"] == ["Free"] and [f["place"] for f in own["found"]] == [0]
    other = "Redistribution and use in source and binary forms, with or without modification, are permitted.\nReleased under the new BSD licence.\nThis package is licensed under the GPLv3 License!"
    assert license_scan.scan(table(spark, [other])).first()["licences"] == ["BSD-3-Clause", "GPL-3.0"]
    plan = license_scan.report(table(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_rules_do_not_reach_across_what_was_taken(spark):
    known = license_scan.SENTENCES
    say = lambda *ids: "\n".join(known[i].capitalize() + "." for i in ids)
    bsd = ("bsd-conditions", "bsd-source", "bsd-binary")
    texts = [say("mit-grant", *bsd, "mit-notice"), say("mit-grant", "mit-notice", *bsd), "Released under the Apache license.", "Released under the Apache License 2.0.", "A text of some words.\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n  Not a title."]
    got = {r["doc_id"]: r["licences"] for r in license_scan.report(table(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == ["BSD-2-Clause", "BSD-2-Clause MIT", "Apache", "Apache-2.0", "GPL-3.0"]
    bodies = {r["doc_id"]: r["licences"] for r in license_scan.report(table(spark, [t.capitalize() + "." for t in license_scan.BODIES.values()])).collect()}
    assert [bodies[i] for i in range(len(bodies))] == list(license_scan.BODIES)


def sets(texts, width):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def test_decontamination(spark):
    items = prose(25, 10) + ["one two", "", None]
    rng = random.Random(1)
    docs = []
    for t in prose(60, 11):
        own = (rng.choice(items) or "").split()
        if own and rng.random() < 0.3:
            own[rng.randrange(len(own))] = "edited"
        docs.append(f"{t} {' '.join(own)} {t}")
    docs += ["x one two y", *ODD]
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    expected = set()
    for i, s in enumerate(sets(items, 5)):
        w = len(next(iter(s))) if s else 0
        for d, t in enumerate(docs):
            x = words(t)
            own = {tuple(x[k : k + w]) for k in range(len(x) - w + 1)}
            if s and len(s & own) * 10 >= 8 * len(s):
                expected.add((d, i, len(s), len(s & own)))
    for group in (20_000, 4):
        got = {tuple(r)[:4] for r in decontamination.find(table(spark, docs), it, group_items=group).collect()}
        assert got == expected
        kept = decontamination.remove(table(spark, docs), it, group_items=group)
        assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, *_ in expected}
    assert decontamination.find(table(spark, docs), it.limit(0)).count() == 0


def near_copies(seed):
    rng = random.Random(seed)
    base = prose(25, seed, 300)
    line = " ".join(prose(1, seed + 1, 300)[0].split()[:30])
    out = [line + "\n" + t for t in base]
    for t in base[:10]:
        for _ in range(rng.randint(1, 9)):
            w = (t + " " + t[::-1]).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(99)}"
            out.append(" ".join(w))
    return out + out[:7] + ODD


@pytest.mark.parametrize(("width", "over", "family"), [(4, 85, 10**8), (5, 80, 10**8), (4, 85, 20_000)])
def test_jaccard_join(spark, width, over, family):
    texts = near_copies(over + width)
    s = sets(texts, width)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= over * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r for r in jaccard_join.join(table(spark, texts), width, over, 100, 3000, 5000, family).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s[i]), find(i)) for i in range(len(texts))]
    assert sum(find(i) != i for i in range(len(texts))) > 10


def test_jaccard_cases(spark):
    assert jaccard_join.join(table(spark, [])).count() == 0
    got = jaccard_join.join(table(spark, ["a b c d e", "a b c d e", "a b c d e", None], [5, 5, None, 7])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (7, 7)]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    links = spark.createDataFrame(pairs, "a long, b long")
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    for df in (components(links), components(links, bound=0), _by_rounds(links)):
        got = {r["node"]: r["label"] for r in df.collect()}
        assert {k: v for k, v in got.items() if k in linked} == {x: find(x) for x in linked}


# --- shared, and the pipeline -------------------------------------------------------------------------------------------


def test_hashed_shingles():
    texts = prose(20, 12) + ODD
    w = Words(texts)
    for width in (1, 4):
        h, number = w.shingles(width)
        ends = np.cumsum(number)
        for t, a, b, s in zip(texts, ends - number, ends, sets(texts, width)):
            assert len(set(h[a:b].tolist())) == len(s)


def test_filter_keeps_columns(spark):
    docs = table(spark, ODD)
    kept = filter_rows(docs, "text", lambda texts: [t is not None for t in texts])
    assert kept.schema == docs.schema and kept.count() == len(ODD) - 1


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["language_id", "toxicity", "jaccard_join", "decontamination", "bpe"]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, sf).columns == docs.columns
    kept = {r["doc_id"] for r in p.near_copies(spark, docs, sf).collect()}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, 5, 80, 100).collect()}
    assert kept == {d for d, c in groups.items() if d == c} and len(kept) < len(texts)
    out = p.run(spark, sf)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert len(ids) == out.count() and ids <= kept | ids and 0.6 * len(texts) < len(ids) < len(texts)
    twice = docs.unionByName(docs.limit(3))
    assert p.near_copies(spark, twice, sf).count() == len(kept)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = c.sql(queries.ORACLES[name])
    at = [rel.columns.index(x) for x in sorted(df.columns)]
    assert sorted(tuple(r[x] for x in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
