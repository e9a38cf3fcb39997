"""Operator 10, quality: a compression classifier with zstandard dictionaries.

One dictionary is trained on good labelled texts and one on bad ones. A text that resembles the good ones compresses
better with their dictionary; the difference of the two compressed sizes, divided by their sum, is calibrated to a score
by an isotonic fit, with a little of a logistic one, on labelled texts that neither dictionary saw. Long texts are compressed in pieces of `PIECE`
bytes, whole, and the sizes added up, so a dictionary tells on every piece and memory stays bounded.

Dictionaries and calibration are fitted on a bounded sample: at most `rows` labelled rows and `chars` characters.

Defined cases: a text that is null or empty has difference 0 and gets that difference's score; without both labels in the
sample every score is 0.12 or 0.88, by the label there is, or 0.5 without any; a sample too small to hold a third back is
calibrated on itself; repeated rows give a row each; an empty
table gives an empty result; null ids count as the id ""; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .subwords import labelled, platt
from .toxicity import _KINDS

DICTIONARY, LEVEL, PIECE = 112_640, 3, 512
ROWS, CHARS = 8_000, 10_000_000


def _pieces(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def train_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the texts' pieces; the pieces themselves where there are too few to train one."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, offset: float = 0.0, steps=((), ())):
        self.good, self.bad, self.slope, self.offset, self.steps = good, bad, slope, offset, steps

    def _compressors(self):
        def kind(dictionary: bytes):
            if not dictionary:
                return zstandard.ZstdCompressor(level=LEVEL)
            own = zstandard.ZstdCompressionDict(dictionary)
            own.precompute_compress(level=LEVEL)  # else each call digests it again
            return zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_dict_id=False)

        return kind(self.good), kind(self.bad)

    def differences(self, texts: list[str | None], compressors=None) -> np.ndarray:
        """(bad - good) / (bad + good) of each text's compressed sizes."""
        good, bad = compressors or self._compressors()
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                pieces = _pieces(t)
                g = sum([len(good.compress(p)) for p in pieces])
                b = sum([len(bad.compress(p)) for p in pieces])
                out[i] = (b - g) / (b + g)
        return out

    def score(self, texts: list[str | None], compressors=None) -> np.ndarray:
        d = self.differences(texts, compressors)
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * d + self.offset, -40, 40)))
        if not len(self.steps[0]):
            return smooth
        return 0.95 * np.interp(d, *self.steps) + 0.05 * smooth  # the logistic part orders what the steps leave level


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function closest to y over x (pool adjacent violators), as points to interpolate between."""
    names, place = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum, weight, sum of x * weight
    for s, w, at in zip(np.bincount(place, weights=y), np.bincount(place), names):
        blocks.append([s, w, at * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    s, w, at = np.array(blocks).T
    return at / w, (s + 0.5 * s.sum() / w.sum()) / (w + 0.5)  # shrunk a little, so that no small block is certain


def fit(texts: list[str], y: np.ndarray) -> Model:
    held = np.arange(len(y)) % 3 == 2
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", 0.0, 0.0 if not len(y) else 2.0 if y.mean() > 0.5 else -2.0)
    few = len(set(y[~held].tolist())) < 2 or not held.any()
    if few:
        held = np.ones(len(y), bool)
    pick = lambda label: [t for t, v, h in zip(texts, y, held) if v == label and (few or not h)]
    model = Model(train_dictionary(pick(1)), train_dictionary(pick(0)))
    d = model.differences([t for t, h in zip(texts, held) if h])
    a, b = platt(d, y[held])
    return Model(model.good, model.bad, max(a, 0.0), b, isotonic(d, y[held]))


def learn(docs: DataFrame, labels: DataFrame, usable, rows: int = ROWS, chars: int = CHARS) -> Model:
    return fit(*labelled(docs, labels, "quality", usable, rows, chars))


def score(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """docs -> the columns of `keep`, which are passed on, and score."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        compressors = model._compressors()
        for b in slices(batches):
            scores = model.score(b.column(len(names)).to_pylist(), compressors)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores)], [*names, "score"])

    casts = [F.col(n).cast(k) for n, k in (c.split() for c in keep.split(", "))]
    return docs.select(*casts, "text").mapInArrow(run, f"{keep}, score double")
