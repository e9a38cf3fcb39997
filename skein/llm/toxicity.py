"""Operator 2, toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into runs of `WINDOW` words. A run's vector is the average of the embeddings of its words' byte n-grams
(hashed to 2**BITS rows), and a softmax over it tells toxic from clean; an unseen misspelling shares most n-grams with
what it misspells. A text's evidence is that of its most toxic run, so a few words count in a long text as in a short
one; a logistic fit on texts held back from the embeddings turns it into a score. Labels are of whole texts: rounds of
training keep, of each toxic text, only the runs that the round before found most toxic.

The model is fitted on a bounded sample: at most `rows` labelled rows and `chars` characters, whatever the corpus. Of its
runs a round trains on at most `toxic_runs` toxic ones, drawn at random from those that were kept, on as many clean ones as
these, the most toxic by the round before, and on at most `clean_runs` clean ones drawn at random. A run's
softmax is linear in its average, so scoring needs one number a bucket; texts of any length are scored whole.

Defined cases: a text that is null or without words has one empty run, whose logit is the offset; without both labels in
the sample every score is under 1e-17 (or over 1 - 1e-17, if all are toxic), and without words in texts of both every
score is about the share of toxic ones; a sample too small to hold texts of both labels back is calibrated on itself; repeated rows give a row each; an empty table gives an empty result;
null ids are never held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks
from .subwords import Buffer, labelled, platt

BITS, SIZES, DIM, WINDOW = 17, (3, 4, 5), 8, 12
ROWS, CHARS = 8_000, 18_000_000
TOXIC_RUNS, CLEAN_RUNS = 15_000, 40_000


def _number(counts: np.ndarray) -> np.ndarray:
    """Runs of a text: the last one takes what is left over, a short text is one run."""
    return np.where(counts > 0, np.maximum(counts // WINDOW, 1), 0)


def _windows(buffer: Buffer) -> np.ndarray:
    """The index of the first word of each run."""
    number = _number(buffer.counts)
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return within * WINDOW + np.repeat(buffer.first[:-1], number)


class Model:
    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def window_logits(self, buffer: Buffer) -> np.ndarray:
        size = len(buffer.bytes) - 6
        total, number = np.zeros(size, np.float32), np.zeros(size, np.uint8)
        for n in SIZES:
            ids, inside = buffer.ngrams(n, BITS)
            total += np.where(inside, self.weights[ids], np.float32(0))
            number += inside
        first = _windows(buffer)
        if not len(first):
            return np.zeros(0)
        at = buffer.starts[first] - 1
        return np.add.reduceat(total, at).astype(float) / np.maximum(np.add.reduceat(number, at, dtype=np.int64), 1) + self.offset

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        buffer = Buffer([t or "" for t in texts])
        logits = self.window_logits(buffer)
        number = _number(buffer.counts)
        out = np.full(len(texts), self.offset)
        has = number > 0
        if has.any():
            out[has] = np.maximum.reduceat(logits, (np.cumsum(number) - number)[has])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.shift, -40, 40)))


def fit(texts: list[str], y: np.ndarray, rounds: int = 2, epochs: int = 4, seed: int = 5, toxic_runs: int = TOXIC_RUNS, clean_runs: int = CLEAN_RUNS) -> Model:
    """Train embeddings and softmax together; calibrate on every fifth text, which they don't see."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 40.0 if len(y) and y[0] else -40.0)
    held = np.arange(len(y)) % 5 == 4
    worded = np.array([bool(t.split()) for t in texts])
    if any(not (worded & (y == label)).any() for label in (0, 1)):  # nothing tells the labels apart
        return Model(np.zeros(1 << BITS, np.float32), 0.0, *platt(np.zeros(len(y)), y))
    if any(not (worded & ~held & (y == label)).any() for label in (0, 1)) or len(set(y[held].tolist())) < 2:
        seen, own, held = texts, y, np.ones(len(y), bool)  # too few to hold any back: calibrated on what was seen
    else:
        seen, own = [t for t, h in zip(texts, held) if not h], y[~held]
    telling = _telling(seen, own)
    look = lambda buffer: _most_telling(buffer, telling)
    limit, model = 5.0, None
    for _ in range(rounds):
        logits, text_of = map(np.concatenate, zip(*((look(b), np.repeat(k, _number(b.counts))) for k, b in _parts(seen))))
        toxic = own[text_of] == 1
        if model:
            limit = float(np.quantile(logits[~toxic], 0.9995))
        best = np.full(len(seen), -np.inf)
        np.maximum.at(best, text_of, logits)
        positive = np.flatnonzero(toxic & ((logits >= best[text_of]) | (logits > limit)))
        positive = positive if len(positive) <= toxic_runs else np.sort(rng.choice(positive, toxic_runs, replace=False))
        clean = np.flatnonzero(~toxic)
        hard = clean[np.argsort(-logits[clean], kind="stable")[: len(positive)]]
        negative = np.union1d(hard, rng.choice(clean, min(len(clean), clean_runs), replace=False))
        runs = _runs(seen, np.union1d(positive, negative))
        weights, offset = _train(*runs, toxic[np.union1d(positive, negative)].astype(int), rng, epochs)
        model = Model(weights, offset, 1.0, 0.0)
        look = model.window_logits
    a, b = platt(model.evidence([t for t, h in zip(texts, held) if h]), y[held])
    return Model(model.weights, model.offset, max(a, 0.0), b)


def _parts(texts: list[str], size: int = 1_000_000):
    """The texts' indices and words, about `size` characters at a time."""
    sizes = np.cumsum([len(t) for t in texts])
    part = sizes // size
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        yield own, Buffer([texts[i] for i in own])


def _telling(texts: list[str], y: np.ndarray) -> np.ndarray:
    """How far each bucket is from occurring in as many clean texts as toxic ones, in standard deviations."""
    found = np.zeros((2, 1 << BITS))
    for own, buffer in _parts(texts):
        parts = [buffer.ngrams(n, BITS) for n in SIZES]
        for k, i in enumerate(own):
            a, b = buffer.begins[k] - 1, buffer.begins[k + 1] - 1
            found[y[i], np.unique(np.concatenate([ids[a:b][inside[a:b]] for ids, inside in parts]))] += 1
    n = np.bincount(y, minlength=2)
    p = found.sum(0) / n.sum()
    return ((found[1] / n[1] - found[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[1] + 1 / n[0]))).astype(np.float32)


def _most_telling(buffer: Buffer, telling: np.ndarray) -> np.ndarray:
    """Where to look first: of each run, the figure of its most telling bucket."""
    most = np.zeros(len(buffer.bytes) - 6, np.float32)
    for n in SIZES:
        ids, inside = buffer.ngrams(n, BITS)
        np.maximum(most, np.where(inside, telling[ids], np.float32(0)), out=most)
    first = _windows(buffer)
    return np.maximum.reduceat(most, buffer.starts[first] - 1) if len(first) else most[:0]


def _runs(texts: list[str], chosen: np.ndarray):
    """Buckets, whether they count, and begins of the chosen runs, which are numbered through all texts."""
    pieces, done = [], 0
    for _, buffer in _parts(texts):
        at = np.append(buffer.starts[_windows(buffer)] - 1, len(buffer.bytes) - 6)
        data = buffer.bytes.tobytes()
        for w in chosen[(chosen >= done) & (chosen < done + len(at) - 1)] - done:
            pieces.append(" ".join(data[at[w] : at[w + 1]].decode().split()))
        done += len(at) - 1
    buffer = Buffer(pieces)
    parts = [buffer.ngrams(n, BITS) for n in SIZES]
    return np.stack([p[0] for p in parts], axis=1), np.stack([p[1] for p in parts], axis=1), buffer.begins - 1


def _train(ids, inside, at, y, rng, epochs: int):
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    u = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    e_square, u_square = np.full(1 << BITS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    runs = np.arange(len(y))
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for k in range(0, len(order), 256):
            own = order[k : k + 256]
            spans = [inside[at[w] : at[w + 1]] for w in runs[own]]
            flat = np.concatenate([ids[at[w] : at[w + 1]][s] for w, s in zip(runs[own], spans)])
            sizes = np.array([int(s.sum()) for s in spans])
            good = sizes > 0
            own, sizes = own[good], sizes[good]
            if not len(own):
                continue
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(e[flat], starts, axis=0) / sizes[:, None]
            z = mean @ u + c
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            g_u, g_c = mean.T @ p / len(own), p.mean(0)
            g_mean = (p @ u.T) / sizes[:, None]
            keys, inverse = np.unique(flat, return_inverse=True)
            rows = np.repeat(np.arange(len(own)), sizes)
            g_e = np.stack([np.bincount(inverse, weights=g_mean[rows, d], minlength=len(keys)) for d in range(DIM)], axis=1).astype(np.float32)
            e_square[keys] += (g_e**2).mean(1)
            e[keys] -= 0.3 * g_e / np.sqrt(e_square[keys])[:, None]
            u_square += g_u**2
            u -= (0.1 * g_u / np.sqrt(u_square)).astype(np.float32)
            c -= 0.1 * g_c
    return (e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(c[1] - c[0])


def score(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """docs -> the columns of `keep`, which are passed on, and score."""
    names = [c.split()[0] for c in keep.split(", ")]
    schema = f"_row struct<{', '.join(c.replace(' ', ':', 1) for c in keep.split(', '))}>, score double"

    def run(batches):
        for rows, texts in in_blocks(batches, 1_500_000, 2):
            kind = pa.struct([pa.field(n, _KINDS[c.split()[1]]) for n, c in zip(names, keep.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(model.score(texts))], ["_row", "score"])

    return docs.select(F.struct(*names).alias("_row"), "text").mapInArrow(run, schema).select("_row.*", "score")


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def learn(docs: DataFrame, labels: DataFrame, usable, rows: int = ROWS, chars: int = CHARS, toxic_runs: int = TOXIC_RUNS, clean_runs: int = CLEAN_RUNS) -> Model:
    return fit(*labelled(docs, labels, "toxic", usable, rows, chars), toxic_runs=toxic_runs, clean_runs=clean_runs)
