"""Operator 5, language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's script is read off its bytes; the languages of which at least a hundredth of the training letters are in that
script are its candidates. A word's score for a language is the sum of smoothed log-probabilities of its byte n-grams
(hashed tables). The best path over a text's words pays `SWITCH` for each change of language, so single odd words don't
break a span and mixed texts get several: (first word, word after the last, language). A text's language is the one with most
letters on the path; its score is that share of the letters.

The tables are fitted on a bounded sample, `rows` rows and `chars` characters of each language and `total` characters in
all, whatever the corpus (`learn`); more than `MOST` languages are refused, and each takes a megabyte of the model, which the
driver holds. Texts of any length are labelled whole.

Defined cases: a text that is null or has no letter is `und` with score 0 and no spans, as is any text if nothing could be learnt; ties
go to the language first in the alphabet; repeated rows give a row each; null ids are never held out; rows without a
language teach nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks
from .subwords import Buffer, fetch_texts, one_text
from .toxicity import _KINDS

BITS, SIZES, SWITCH = 16, (1, 2, 3, 4), 12.0
ROWS, CHARS, TOTAL, MOST = 1_500, 3_000_000, 100_000_000, 2_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

# Scripts by the first byte of a letter's UTF-8 form, some told apart by the second or third byte.
LATIN, GREEK, CYRILLIC, ARMENIAN, HEBREW, ARABIC, INDIC, THAI, KANA, HAN, HANGUL, OTHER = range(1, 13)


def _scripts() -> np.ndarray:
    lead = np.zeros(256, np.uint8)
    lead[65:91] = lead[97:123] = LATIN
    for first, last, script in ((0xC3, 0xC9, LATIN), (0xCD, 0xCF, GREEK), (0xD0, 0xD3, CYRILLIC), (0xD4, 0xD6, ARMENIAN), (0xD7, 0xD7, HEBREW), (0xD8, 0xDD, ARABIC), (0xE0, 0xE0, INDIC), (0xE1, 0xE1, OTHER), (0xE3, 0xE3, KANA), (0xE4, 0xE9, HAN), (0xEA, 0xED, HANGUL)):
        lead[first : last + 1] = script
    return lead


_SCRIPT = _scripts()


def scripts(data: np.ndarray) -> np.ndarray:
    """Of each byte, the script of the letter that begins there, or 0. Letters of rarer blocks are OTHER, signs are none."""
    out = _SCRIPT[data]
    if (data >= 0xE0).any():
        after = np.append(data[1:], np.uint8(0))
        third = np.append(data[2:], np.zeros(2, np.uint8))[: len(data)]
        out = np.where((data == 0xE0) & (after >= 0xB8), np.uint8(THAI), out)
        out = np.where((data == 0xE1) & (after >= 0xB8), np.where(after < 0xBC, np.uint8(LATIN), np.uint8(GREEK)), out)  # U+1E00, U+1F00
        out = np.where((data == 0xE3) & (after >= 0x90), np.uint8(HAN), out)
        out = np.where((data == 0xE2) | ((data == 0xE3) & (after < 0x81)), np.uint8(0), out)
        rare = (data == 0xE2) & (after >= 0xB0) & (after < 0xB8)  # U+2C00 to U+2DFF: Glagolitic, Latin C, Coptic, Tifinagh, supplements
        out = np.where(rare, np.where((after == 0xB1) & (third >= 0xA0), np.uint8(LATIN), np.uint8(OTHER)), out)
        out = np.where((data == 0xF0) & (after != 0x9F), np.where(after >= 0xA0, np.uint8(HAN), np.uint8(OTHER)), out)  # U+1F000 on are pictures
    return out


class Model:
    def __init__(self, languages: list[str], tables: dict[int, np.ndarray], allowed: np.ndarray):
        self.languages, self.tables = languages, tables
        self.learnt = allowed.any(1)  # the scripts that some language is written in; a word in another one is anyone's
        self.allowed = allowed | ~self.learnt[:, None]

    def word_scores(self, buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """[word, language] scores, and letters of each word."""
        size = len(buffer.bytes) - 6
        ids = {}
        for n in SIZES:
            at, inside = buffer.ngrams(n, BITS)
            ids[n] = np.where(inside, at, np.uint32(1 << BITS))  # the last row is all 0
        words = []
        for k in range(len(self.languages)):  # one at a time: a language's sums are as long as the texts
            total = np.zeros(size, np.float32)
            for n in SIZES:
                total += self.tables[n][k][ids[n]]
            words.append(buffer.word_sums(total))
        script = scripts(buffer.bytes[:size])
        letters = buffer.word_sums((script > 0).astype(np.int64))
        own = np.maximum.reduceat(script, buffer.starts - 1) if len(buffer.starts) else script[:0]
        scores = np.stack(words, axis=1)
        scores = np.where(letters[:, None] > 0, scores, 0)
        return scores + np.where(self.allowed[own], 0, -100.0), letters

    def paths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, Buffer]:
        """The language's index of each word, its letters, and the words."""
        buffer = Buffer([t or "" for t in texts])
        scores, letters = self.word_scores(buffer)
        return viterbi(scores, buffer.first, buffer.counts, SWITCH), letters, buffer

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of a text's spans."""
        return [tuple(x.values()) for x in self.label([text])[2].to_pylist()[0]]

    def foreign(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, the share of letters in words of a script that no learnt language is written in; 0 without letters."""
        buffer = Buffer([t or "" for t in texts])
        script = scripts(buffer.bytes[: len(buffer.bytes) - 6])
        letters = buffer.word_sums((script > 0).astype(np.int64))
        own = np.maximum.reduceat(script, buffer.starts - 1) if len(buffer.starts) else script[:0]
        owner = np.repeat(np.arange(len(texts)), buffer.counts)
        total = np.bincount(owner, weights=letters, minlength=len(texts))
        odd = np.bincount(owner, weights=np.where(self.learnt[own], 0, letters), minlength=len(texts))
        return odd / np.maximum(total, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language, and its share of the letters."""
        return self.label(texts)[:2]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, pa.Array]:
        """Languages, shares, and the spans of each text."""
        names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, share, pa.array([[]] * len(texts), SPANS)
        path, letters, buffer = self.paths(texts)
        k = len(self.languages)
        owner = np.repeat(np.arange(len(texts)), buffer.counts)
        votes = np.bincount(owner * k + path, weights=letters, minlength=len(texts) * k).reshape(-1, k)
        best, total = votes.argmax(1), votes.sum(1)
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        for i in np.flatnonzero(lettered):
            names[i] = self.languages[best[i]]
            share[i] = votes[i, best[i]] / total[i] if total[i] else 1.0 / k
        begin = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        end = np.append(begin[1:], len(path))
        begin, end = begin[lettered[owner[begin]]], end[lettered[owner[begin]]]
        first = np.cumsum(buffer.counts) - buffer.counts
        parts = [pa.array((x - first[owner[begin]]).astype(np.int32)) for x in (begin, end)]
        spoken = pa.DictionaryArray.from_arrays(pa.array(path[begin].astype(np.int32)), pa.array(self.languages)).dictionary_decode()
        ends = np.cumsum(np.bincount(owner[begin], minlength=len(texts)))
        return names, share, pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays([*parts, spoken], ["first", "end", "lang"]))


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best path through each text's words, all texts side by side: longest first, so those still running are a prefix."""
    words, k = scores.shape
    path = np.zeros(words, np.int32)
    came = np.full(words, -1, np.int32)  # where a switch into any language came from
    stays = np.ones((words, k), bool)
    order = np.argsort(-counts, kind="stable")
    begin = first[:-1][order]
    running = len(counts) - np.searchsorted(np.sort(counts), np.arange(1, counts.max(initial=0) + 1))
    value = None
    for t, n in enumerate(running):
        at = begin[:n] + t
        if t == 0:
            value = scores[at].copy()
            continue
        value = value[:n]
        best = value.max(1)
        came[at] = value.argmax(1)
        switched = (best - switch)[:, None]
        stay = value >= switched
        stays[at] = stay
        value = np.where(stay, value, switched) + scores[at]
        if t + 1 < len(running) and running[t + 1] < n:
            path[at[running[t + 1] :]] = value[running[t + 1] :].argmax(1)
        elif t + 1 == len(running):
            path[at] = value.argmax(1)
    ones = begin[np.sort(counts)[::-1] == 1]
    path[ones] = scores[ones].argmax(1)
    for t in range(len(running) - 1, 0, -1):
        at = begin[: running[t]] + t
        now = path[at]
        path[at - 1] = np.where(stays[at, now], now, came[at])
    return path


def fit(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    tables = {n: np.zeros((len(names), (1 << BITS) + 1), np.float32) for n in SIZES}
    letters = np.zeros((len(names), 16))
    raw = {n: np.zeros((len(names), 1 << BITS)) for n in SIZES}
    for k, name in enumerate(names):
        buffer = Buffer([t for t, x in zip(texts, languages) if x == name])
        letters[k] = np.bincount(scripts(buffer.bytes), minlength=16)
        for n in SIZES:
            ids, inside = buffer.ngrams(n, BITS)
            raw[n][k] = np.bincount(ids[inside], minlength=1 << BITS)
    for n in SIZES:
        prior = raw[n].sum(0) + 0.1
        prior /= prior.sum()
        p = (raw[n] + 2_000 * prior) / (raw[n].sum(1, keepdims=True) + 2_000)
        tables[n][:, :-1] = np.log(p) - np.log(prior)  # only differences between languages count
    letters[:, 0] = 0
    share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    return Model(names, tables, (share >= 0.01).T)


def learn(docs: DataFrame, usable, rows: int = ROWS, chars: int = CHARS, total: int = TOTAL) -> Model:
    """Fit on docs(doc_id, text, lang): of each language at most `rows` rows and `chars` characters, `total` in all, by a hash of the id.

    Texts of over a twentieth of `chars` are left out, and rows that share an id and a language count once. Languages are
    counted first; then a row stays if its hash is within the share that gives a fifth more rows than wanted.
    """
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"))
    number = counts.count()
    if number > MOST:
        raise ValueError(f"more than {MOST} languages")
    chars = min(chars, total // max(1, number))
    share = (F.xxhash64("doc_id", F.lit(11)).cast("double") / 2.0**64 + 0.5) * F.col("_n") <= 1.2 * rows + 20
    drawn = known.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").filter(share & F.length("text").between(1, max(1, chars // 20)))
    kept = fetch_texts(one_text(drawn, ["lang", "doc_id"]), ["lang", "doc_id"], rows, chars, 11)
    return fit([text for _, _, text in kept], [lang for lang, _, _ in kept])


def identify(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """docs -> the columns of `keep`, which are passed on, lang_pred, score and spans."""
    names = [c.split()[0] for c in keep.split(", ")]
    schema = f"_row struct<{', '.join(c.replace(' ', ':', 1) for c in keep.split(', '))}>, lang_pred string, score double, spans array<struct<first:int, end:int, lang:string>>"
    size = 16_000_000 // max(16, len(model.languages))  # characters at a time: a word has a score for each language

    def run(batches):
        kind = pa.struct([pa.field(n, _KINDS[c.split()[1]]) for n, c in zip(names, keep.split(", "))])
        for rows, texts in in_blocks(batches, size, 2):
            languages, share, spans = model.label(texts)
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(languages), pa.array(share), spans], ["_row", "lang_pred", "score", "spans"])

    return docs.select(F.struct(*names).alias("_row"), "text").mapInArrow(run, schema).select("_row.*", "lang_pred", "score", "spans")
