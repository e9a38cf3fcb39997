"""Operator 3, BPE encoding and decoding: a streaming transducer with bounded lookahead.

The merge list fixes how far to the right of a token a merge can still matter: `sufficient_lookahead` follows chains of
ever earlier merges through it. `Transducer` reads symbols, keeps at most a window of them, and emits a token once at
least that many symbols (and one longest token) follow it, since no continuation can change it then. So words of any
length are encoded in constant memory; a word that ends within the first window is stable at its end. What recent words
became is kept in a bounded table. `TextDecoder` turns ids back into text one by one, a state machine that holds only the
bytes of an unfinished character; `TokenDecoder` gives the tokenizer's own decoding, token strings with spaces between.

Texts are encoded as the tokenizer's file says: special strings first, then NFC, white space, lower case, the split
pattern, bytes, merges, with the word-end mark on a word's last symbol. What a letter is and its lower case are the
library's where a text isn't ASCII. The file is a parameter and read where it lies. A text is read in stretches that end at
white space, so beside the text itself only a stretch is held.

Defined cases: a null or empty text has no tokens and decodes to the empty text; a null id, repeated rows and ties need
nothing special, each row gives one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tokenizers import Tokenizer as Library

from .common import WHITE, slices

_SPACES = re.compile(f"[{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")
_ID, _NONE = (1 << 24) - 1, 1 << 62
KEPT, KEPT_IN_STAGES = 500_000, 60_000  # words in a generation of the table; fewer where other operators' workers share the memory


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token that can still undo it.

    A merge (a, b) is forestalled only if b's left part goes to the right first, by an earlier merge (b, c), whose c must
    itself not be forestalled, and so on: a chain of ever earlier merges. One pass in the order of the list gives the
    longest chain's symbols.
    """
    reach: dict[str, int] = {}
    most = 0
    for a, b in merges:
        far = len(b) + reach.get(b, 0)
        most = max(most, far)
        reach[a] = max(reach.get(a, 0), far)
    return most


class Transducer:
    """Symbols in, token ids out as soon as they are stable. A pair's merge is one number: its rank, then the new id."""

    def __init__(self, ranks: dict[tuple[int, int], int], lookahead: int, longest: int):
        self.ranks, self.margin = ranks, lookahead + longest
        self.window = 4 * self.margin

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a short sequence."""
        if len(ids) > 40:
            return self._merge_long(ids)
        rank = self.ranks.get
        pairs = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != _NONE:
            at = pairs.index(best)
            ids[at : at + 2] = [best & _ID]
            del pairs[at]
            if at:
                pairs[at - 1] = rank((ids[at - 1], ids[at]), _NONE)
            if at < len(pairs):
                pairs[at] = rank((ids[at], ids[at + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links."""
        n, ranks, ids = len(ids), self.ranks, list(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], right[i] = best & _ID, True, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, g in zip(ids, gone) if not g]

    def stream(self, symbols, width):
        """Token ids of an endless sequence of symbols; width(id) is a token's number of symbols."""
        source, held = iter(symbols), []
        while True:
            held += islice(source, self.window - len(held))
            if len(held) < self.window:  # the end: all is stable
                yield from self.merge(held)
                return
            end, limit = 0, len(held) - self.margin
            for t in self.merge(list(held)):
                if end + width(t) > limit:
                    break
                end += width(t)
                yield t
            del held[:end]


class Tokenizer:
    """Reads the tokenizer's file and encodes as it says."""

    def __init__(self, path: str, most: int = KEPT):
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.end_mark = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        bare = [tuple(x.removesuffix(self.end_mark) if self.end_mark else x for x in m) for m in merges]
        ids = {(self.vocab[a], self.vocab[b]): rank << 24 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.bytes = byte_symbols()
        self.of_symbol = {c: b for b, c in self.bytes.items()}
        self.plain = {c: self.vocab[c] for c in self.of_symbol}
        self.last = {c: self.vocab[c + self.end_mark] for c in self.of_symbol}
        self.raw = {i: self._bytes(t) for i, t in self.surface.items()}
        longest = max(len(t.removesuffix(self.end_mark)) if self.end_mark else len(t) for t in self.vocab)
        self.transducer = Transducer(ids, sufficient_lookahead(bare), longest)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = re.compile(pattern.replace(r"\s", WHITE).replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")).findall  # of ASCII
        library = Library.from_file(path)
        self.normal, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.reader = TextDecoder(self)
        self.old: dict[str, tuple] = {}
        self.kept = _Kept(self)

    def _bytes(self, surface: str) -> bytes:
        """What a token stands for; the end of a word is a space."""
        if surface in self.special:
            return surface.encode()
        ended = bool(self.end_mark) and surface.endswith(self.end_mark)
        return bytes(self.of_symbol[c] for c in (surface.removesuffix(self.end_mark) if ended else surface)) + b" " * ended

    def width(self, token: int) -> int:
        return len(self.surface[token].removesuffix(self.end_mark)) if self.end_mark else len(self.surface[token])

    def word(self, word: str) -> list[int]:
        """The ids of one word of the split, given as the stand-ins of its bytes."""
        plain = self.plain
        symbols = [plain[c] for c in word[:-1]]
        symbols.append(self.last[word[-1]])
        return list(self.transducer.stream(symbols, self.width))

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a stretch without white space."""
        out: list[int] = []
        for part in self.is_special.split(chunk) if self.is_special and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    for w, _ in self.words(self.normal(part)):
                        out += self.word(w)
                    continue
                part = part.lower()
                core = part.rstrip(".,:;!?")
                if core.isalpha():  # letters and what ends a sentence: the split is plain
                    out += self.word(core)
                    if len(core) < len(part):
                        out += self.word(part[len(core) :])
                else:
                    for w in self.split(part):
                        out += self.word(w if w.isprintable() else w.translate(self.bytes))
        return out

    def chunks(self, text: str) -> list[str]:
        return text.split() if not _ODD.search(text) else [c for c in _SPACES.split(text) if c]

    def encode(self, text: str | None) -> list[int]:
        return [i for part in stretches(text or "") for c in self.chunks(part) for i in self.chunk(c)]

    def pieces(self, text: str | None):
        """For each stretch of the text, what its chunks became: their ids as text, decoded, numbers, ids as 32-bit integers, readable."""
        for part in stretches(text or ""):
            columns = tuple(zip(*map(self.kept.__getitem__, self.chunks(part))))
            if columns and 0 in columns[2]:
                columns = tuple(zip(*(p for p in zip(*columns) if p[2])))
            if columns:
                yield columns
            if len(self.kept) > self.most:
                self.old, self.kept = self.kept, _Kept(self)
                self.old.tokenizer = None


def stretches(text: str, size: int = 60_000):
    """The text in parts that end at white space."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else next((m.end() for m in [_SPACES.search(text, at + size)] if m), len(text))
        yield text if end - at == len(text) else text[at:end]
        at = end


class _Kept(dict):
    """What recent chunks became. The table before this one serves as its second generation."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str):
        t = self.tokenizer
        if (got := dict.get(t.old, chunk)) is None:
            ids = t.chunk(chunk)
            got = (" ".join(map(str, ids)), TokenDecoder(t).text(ids), len(ids), array("i", ids).tobytes(), t.reader.text(ids))
        if len(chunk) < 64:
            self[chunk] = got
        return got


class TokenDecoder:
    """Ids to the tokenizer's own decoding, one by one: token strings with a space between any two."""

    def __init__(self, tokenizer: Tokenizer):
        self.surface, self.begun = tokenizer.surface, False

    def feed(self, token: int) -> str:
        out = f" {self.surface[token]}" if self.begun else self.surface[token]
        self.begun = True
        return out

    def text(self, ids) -> str:
        out = " ".join(map(self.surface.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun = self.begun or bool(out)
        return out


class TextDecoder:
    """Ids to readable text, one by one: bytes of an unfinished character are held back, word ends become spaces."""

    def __init__(self, tokenizer: Tokenizer):
        self.raw, self.state = tokenizer.raw, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.state.decode(self.raw[token])

    def text(self, ids) -> str:
        """What all the ids become, and the end; the next id begins another text."""
        out = self.state.decode(b"".join([self.raw[i] for i in ids]), True)
        self.state.reset()
        return out


@lru_cache(2)
def tokenizer(path: str, most: int = KEPT) -> Tokenizer:
    """One for all tasks of a worker, which then share its table."""
    return Tokenizer(path, most)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids."""

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches):
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, readable: bool = True) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text: readable, or as the tokenizer's own decoding."""

    def run(batches):
        t = tokenizer(path)
        kind = TextDecoder if readable else TokenDecoder
        for b in slices(batches):
            texts = [kind(t).text(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


class Digest:
    """SHA-256 of parts with `gap` between any two."""

    def __init__(self, gap: str = ""):
        self.gap, self.begun, self.state = gap, False, hashlib.sha256()

    def add(self, parts) -> None:
        self.state.update(((self.gap if self.begun else "") + self.gap.join(parts)).encode("utf-8", "surrogatepass"))
        self.begun = True


def round_trip(docs: DataFrame, path: str, carry: str = "doc_id long") -> DataFrame:
    """Encode and decode each text and keep the digests: the columns of `carry`, n_tokens, ids_sha256, decoded_sha256, readable_sha256.

    decoded is the tokenizer's own decoding, readable the text of the state machine. Digests are fed stretch by stretch.
    """
    names = [c.split()[0] for c in carry.split(", ")]
    kinds = ["ids_sha256", "decoded_sha256", "readable_sha256"]

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches):
            counts, hexes = [], ([], [], [])
            for text in b.column(len(names)).to_pylist():
                ids, decoded, readable = digests = Digest(" "), Digest(" "), Digest()
                n = 0
                for own in t.pieces(text):
                    ids.add(own[0])
                    decoded.add(own[1])
                    readable.add(own[4])
                    n += sum(own[2])
                counts.append(n)
                for to, d in zip(hexes, digests):
                    to.append(d.state.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(counts, pa.int64()), *map(pa.array, hexes)], [*names, "n_tokens", *kinds])

    return docs.select(*names, "text").mapInArrow(run, f"{carry}, n_tokens long, " + ", ".join(f"{k} string" for k in kinds))


MADE = ("ids", "n_tokens", "decoded_sha256")


def encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, n_tokens and decoded_sha256 in place of the text; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("text", *MADE)]

    def run(batches):
        t = tokenizer(path, KEPT_IN_STAGES)
        for b in slices(batches):
            values, counts, decoded = [], [], []
            for text in b.column(len(names)).to_pylist():
                digest, own_ids = Digest(" "), []
                for own in t.pieces(text):
                    own_ids += own[3]
                    digest.add(own[1])
                values.append(b"".join(own_ids))
                counts.append(len(values[-1]) // 4)
                decoded.append(digest.state.hexdigest())
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], ids, pa.array(counts, pa.int64()), pa.array(decoded)], [*names, *MADE])

    schema = StructType([*(docs.schema[n] for n in names), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded_sha256", StringType())])
    return docs.select(*names, "text").mapInArrow(run, schema)
