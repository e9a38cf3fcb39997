"""Hard negatives, the filter audit and line dedup beside plain Python, with their defined cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from skein.llm import filter_audit, hard_negatives, line_dedup
from tests.llm.test_llm import LOWER, ODD, WORDS, prose, table

# --- 11: hard negatives ------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, k string, v string, low long, rank string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "k", "v", 3, "r", "n") for r in rows], VECTORS).repartition(3)


def brute_negatives(rows):
    own = []
    for vec_id, x, label in rows:
        if None not in (vec_id, x, label) and all(c is not None and math.isfinite(c) for c in x):
            bound = hard_negatives.BOUND
            own.append((vec_id, math.fmod(label + 1, 10) if vec_id % 7 == 0 else label, [math.floor(max(min(256 * float(np.float32(c)), bound), -bound)) for c in x]))
    out = []
    for a, label, q in (r for r in own if r[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(q, v)), i, g == label) for i, g, v in own]
        positives = sorted(s[:2] for s in scored if s[2] and s[1] != a)[:5]
        for p, pid in positives:
            fit = sorted((s, i) for s, i, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:10])]
    return out


def some_vectors(n, seed=1, width=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [(i, [rng.gauss(c, 0.5) for c in centres[i % 11]], i % 11 % 4 + (i % 5 == 0)) for i in range(n)]


def test_hard_negatives_are_those_of_brute_force(spark):
    rows = some_vectors(700)
    rows += [(701, None, 1), (702, [1.0] * 6, None), (None, [1.0] * 6, 1), (703, [1.0, None], 1), (704, [float("nan")] * 6, 2), (705, [float("inf")] * 6, 2)]
    rows += [(800, [], 2), (900, [0.0] * 6, 1), (1000, [3e4, -3e4, 1.0], 1), (1001, [2e4], 2), (1002, [1.5e4], 1), (1003, [0.5] * 9, -13)]
    rows += [rows[100], rows[200], rows[3], rows[3], rows[4]] + [(5000 + i, rows[8][1], 3) for i in range(30)] + [(6000 + i, rows[8][1], 1) for i in range(30)]  # repeated rows and ties
    want = Counter(brute_negatives(rows))
    assert sum(want.values()) > 200
    for blocks in ({}, {"rows": 37, "anchors": 2}):
        got = hard_negatives.mine(vectors(spark, rows), **blocks)
        assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want


def test_hard_negatives_of_one_label_and_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(1, 120) if i % 7])).count() == 0
    assert hard_negatives.mine(vectors(spark, []).limit(0)).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1)])).count() == 0


def test_sliced_search_drops_only_what_cannot_qualify():
    rng = np.random.default_rng(3)
    for width, scale in ((1, 3), (5, 300), (64, 90), (70, 1 << 21)):
        x, q = rng.integers(-scale, scale, (900, width)), rng.integers(-scale, scale, (7, width))
        exact = q @ x.T
        low = np.stack([np.full(7, hard_negatives.LEAST), np.quantile(exact, 0.3, axis=1).astype(np.int64), np.full(7, 5), exact[:, 4]], 1)
        high = np.stack([np.full(7, hard_negatives.MOST), np.quantile(exact, 0.8, axis=1).astype(np.int64), np.full(7, 1), exact[:, 4]], 1)
        ids = rng.permutation(900) // 2  # ties of ids too
        off = rng.random((7, 900)) < 0.8
        for sparse in (0.0, 0.125, 1.0):
            got = hard_negatives.sliced_search(x, ids, np.arange(900), q, lambda a, r: off[a, r], low, high, 10, strip=3, sparse=sparse)
            want = []
            for a in range(7):
                for s in range(4):
                    fit = sorted((-exact[a, j], ids[j], j) for j in range(900) if off[a, j] and low[a, s] <= exact[a, j] <= high[a, s])
                    want += [(a, s, *t) for t in fit[:10]]
            assert list(map(tuple, got.tolist())) == [tuple(map(int, w)) for w in want]


# --- 12: the audit of filters ---------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    judged = []
    for i, t, part in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {x for x, f in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])) if f}
        judged.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                here = [j for j in left if x in j[0]]
                left = [j for j in left if x not in j[0]]
                shapley[x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(x in j[0] for j in gone), sum(j[0] == {x} for j in own), sum(j[1] for j in here), sum(j[2] for j in here), x]
                gone = gone + here
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = shapley[out[k][-1]]
    return out


def test_audit_is_that_of_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "Bb", "CCC", "d", "é", "x#", *map(str, range(200))]) for _ in range(rng.choice([3, 99, 100, 101, 160]))) for _ in range(120)]
    texts += [" ".join(map(str, range(100))), "\x0b".join(["w", "W"] * 60), " ".join(["A"] * 12), "ABC", "ABCDEFGHI" + "j" * 81, "A" + "j" * 9, "AA" + "j" * 17, "| x" * 40] + ODD
    texts = texts + texts[:40] + texts[5:25] + [texts[7]] * 30
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    ids[3] = ids[150] = None
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[0], (rows[1][0], texts[1], "xx"), (rows[2][0], "another text", "en"), (None, texts[7], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = table(spark, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]).withColumnsRenamed({"node": "mask", "block": "part", "score": "good"})
    known = spark.createDataFrame([(*x, "a", "b") for x in labels], "doc_id long, quality int, toxic int, digest string, lang string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, known).collect()}
    assert got == brute_audit(rows, labels)
    none = known.limit(0)
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    assert {tuple(r) for r in filter_audit.audit(docs, none).select("good_lost", "toxic_lost").collect()} == {(0, 0)}


def test_parity_sums_invert_to_the_masks(spark):
    rng = random.Random(2)
    rows = [("p", rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 15), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(300)]
    cells = filter_audit.inverted(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, good int, toxic int, mask int, passed long, failed long"))).first()["cells"]
    want = defaultdict(lambda: [0, 0, 0])
    for _, good, toxic, mask, passed, failed in rows:
        for m, n in ((mask, passed), (mask | 16, failed)):
            for k, f in enumerate((1, good, toxic)):
                want[m][k] += n * f
    assert [list(c) for c in cells] == [[m, *want[m]] for m in range(32)]


# --- 13: line dedup -----------------------------------------------------------------------------------------------------


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = {k: held[k] - {None} for k in map(key, lines)}
        kept = [x for x in lines if len(key(x)) < 20 or len(own[key(x)]) < 3 or max(own[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def lined(seed=4):
    rng = random.Random(seed)
    pool = [f"{x} and so on it goes {k}" for k, x in enumerate(prose(30, 3))] + ["ÄRGER IST DAS ÄRGSTE übel der Welt", "ärger ist das ärgste übel der welt", "x" * 19, "x" * 20, "é" * 20, "short"]
    twist = [lambda s: s, lambda s: s.upper() if s.isascii() else s, lambda s: f"  {s}\t\r", lambda s: f" {s}"]
    texts = ["\n".join(rng.choice(twist)(pool[min(int(rng.expovariate(0.12)), len(pool) - 1)]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["\n".join([pool[0]] * 50), f"\n\n{pool[0]}\n", pool[1], "\n", "\r\n", f"a\r\n{pool[2]}\r\n\x85", "a line of one text only, long enough", "\n".join(f"line number {i} of a long text" for i in range(5000))] + ODD
    return texts


@pytest.mark.parametrize("hot", [5_000, 4])
def test_line_dedup_is_that_of_brute_force(spark, hot):
    texts = lined()
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    rows += [rows[0]] * 5 + [(rows[1][0], "another text of the same id\n" + texts[0]), (None, texts[0]), (None, texts[0]), (None, texts[150]), (10**12, texts[150])]
    docs = table(spark, [r[1] for r in rows], [r[0] for r in rows]).withColumnsRenamed({"node": "lines", "block": "place", "score": "kept"})
    maps = line_dedup.keep_bitmaps(docs, hot=hot)
    for sent in (10**9, 0):  # bitmaps sent, or joined
        left = line_dedup.apply_bitmaps(docs, maps, sent)
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in left.collect())
        assert got == brute_lines(rows)
    assert Counter(map(tuple, line_dedup.report(docs).collect())) == brute_lines(rows)
    runs = {(r.doc_id, r.tie): r for r in maps.collect()}
    assert len(runs) == maps.count() and all(sum(s.length for s in r.kept) < r.n_lines for r in runs.values())


def test_line_dedup_of_very_long_texts_and_of_nothing(spark):
    line = "this line is in each of three texts"
    long = "\n".join(f"line {i} is in one text only, as it has a number" for i in range(250_000))  # 11 MB
    rows = [(1, long + "\n" + line), (2, line), (3, line + "\n" + "z" * 12_000_000), (4, None)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(table(spark, [r[1] for r in rows], [r[0] for r in rows])).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (250_001, 1, sha(long)), 2: (1, 1, sha("")), 3: (2, 0, sha(rows[2][1])), 4: (1, 0, sha(""))}
    assert line_dedup.report(table(spark, ["x"]).limit(0)).count() == 0
