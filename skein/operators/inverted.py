"""The stored inverted index, and the two rankers over it.

`postings` has a row for each term of each passage, with the places where it stands: a field's number and a position in one
integer. A task makes the postings of a range of passages, `AT_ONCE` of them at a time, sorted by a bucket of the term's first
letters, term and passage, and writes them as they come, in small row groups: a search reads the groups and pages of its own
terms, by prefix too. A search never sees a text: matching, BM25, coverage and proximity come from places and from the
lengths that each row carries. Statistics of the corpus are one row.

`terms` is the dictionary: how many passages hold a term, in each field and in all that the first ranker counts. A search
looks its words up there, so the weights of words are numbers in its plan, and postings are read once.

`blocks` has, for each run of postings of a term, its passages' range, the greatest weighted frequency and the least length:
no passage of the run scores more than a passage with both. A search for the best passages sweeps over the blocks' ranges,
reads the most promising ones first, and then only ranges that can still reach the k-th best score, of all its words: row
groups and pages outside are skipped. What is skipped can't be among the best, so rows are those of a search of everything.

Building shuffles the passages, by ranges, and never their postings, which are many times as many; what is sorted at once is
bounded. A term that every passage holds is spread over all tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import tokens

from . import lexical as L
from .query import Query, Term

BUCKETS, SHIFT = 64, 24
FIELDS = {"body": 0, "filename": 1, "title": 2, "folder": 3, "path": 4}
FIRST, SECOND = ("body", "filename", "title", "folder"), ("body", "filename", "title", "path")
_LENGTHS = [f"len_{f}" for f in FIELDS]
POSTINGS = "term string, passage_id long, source_id string, at array<int>, " + ", ".join(f"{n} int" for n in _LENGTHS) + ", fields int, weight double, bucket int, block long"
_FREQUENCIES = [*(f"df_{f}" for f in FIELDS), "df"]
TERMS = "bucket int, term string, " + ", ".join(f"{c} long" for c in _FREQUENCIES)
BLOCKS = "bucket int, term string, block long, first long, last long, n long, most double, least int"
AT_ONCE, AT_ONCE_BYTES, HANDED = 8192, 1 << 26, 1 << 16  # passages, or bytes of terms, whose postings are made at once, about; rows handed on at once
GROUP = 4 << 20  # bytes of a row group, about
LEAD = 1 << len(FIELDS)  # in `fields`, beside a bit for each field that holds the term: a row that stands for its passage
BLOCK, PAGE, TERM_BLOCKS = 10, 1024, 1 << 15  # bits of a block's rows at least, rows of a page, blocks that a term may have
SWEPT, RANGES, AHEAD = 50_000, 200, 8  # postings from which blocks are used, ranges of passages in a scan, postings read first for each wanted one


def bucket_of(term: str) -> int:
    """A number by the first two letters, or that of one letter by itself."""
    code = lambda c: ord(c) if c else 0
    return (code(term[:1]) * 31 + code(term[1:2])) % BUCKETS


def _place(part: pa.RecordBatch) -> pa.RecordBatch:
    """passage_id, source_id and the terms of each field -> POSTINGS but for blocks, by bucket, term and passage."""
    lists = part.columns[2:]
    lengths = [np.diff(x.offsets.to_numpy()) for x in lists]
    terms = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    heads = pc.utf8_slice_codeunits(terms.dictionary, 0, 2).dictionary_encode()
    buckets = np.array([bucket_of(h) for h in heads.dictionary.to_pylist()], np.int32)[heads.indices.to_numpy()]
    sorted_ = pc.sort_indices(pa.table({"bucket": buckets, "term": terms.dictionary}), [("bucket", "ascending"), ("term", "ascending")]).to_numpy()
    rank = np.empty(len(sorted_), np.int64)
    rank[sorted_] = np.arange(len(sorted_))
    owner = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in lengths])
    field = np.repeat(np.arange(len(lengths), dtype=np.int32), [n.sum() for n in lengths])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths]).astype(np.int32) + (field << SHIFT)
    key = rank[terms.indices.to_numpy()] * part.num_rows + owner
    order = np.argsort(key, kind="stable")  # fields come in order, and each one's places too
    key, field = key[order], field[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    own, code = key[first] % part.num_rows, sorted_[key[first] // part.num_rows]
    fields = np.bitwise_or.reduceat(1 << field, first) if len(first) else np.zeros(0, np.int32)
    fields[np.unique(own, return_index=True)[1]] |= LEAD
    weight = np.add.reduceat(np.array([_weight(f) if f in FIRST else 0.0 for f in FIELDS])[field], first) if len(first) else np.zeros(0)
    rows = pa.array(own)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order]))
    sizes = [pa.array(n.astype(np.int32)).take(rows) for n in lengths]
    more = [pa.array(fields.astype(np.int32)), pa.array(weight), pa.array(buckets[code])]
    columns = [terms.dictionary.take(pa.array(code)), part.column(0).take(rows), part.column(1).take(rows), places, *sizes, *more]
    return pa.RecordBatch.from_arrays(columns, ["term", "passage_id", "source_id", "at", *_LENGTHS, "fields", "weight", "bucket"])


def placed(indexed: DataFrame) -> DataFrame:
    """indexed(passage_id, source_id, body, filename, title, folder, path), a row for each passage -> POSTINGS without blocks, a run of passages after the other."""
    at_once, at_most, handed = AT_ONCE, AT_ONCE_BYTES, HANDED

    def made(parts):
        rows = _place(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
        for i in range(0, rows.num_rows, handed):
            yield rows.slice(i, handed)

    def run(batches):
        held = []
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                held.append(b.slice(i, at_once))
                if sum(x.num_rows for x in held) >= at_once or sum(x.nbytes for x in held) >= at_most:
                    yield from made(held)
                    held = []
        if held:
            yield from made(held)

    rows = indexed.select(F.col("passage_id").cast("long"), "source_id", *(tokens(F.col(f)).alias(f) for f in FIELDS))
    return rows.mapInArrow(run, POSTINGS.removesuffix(", block long"))


def postings(indexed: DataFrame) -> DataFrame:
    """The same, the passages dealt by ranges before."""
    return placed(indexed.select("passage_id", "source_id", *FIELDS).repartitionByRange("passage_id").sortWithinPartitions("passage_id"))


def statistics(indexed: DataFrame) -> DataFrame:
    """One row: passages, and terms by field."""
    return indexed.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.size(tokens(F.col(f)))), F.lit(0)).alias(f"len_{f}") for f in FIELDS))


def write(indexed: DataFrame, path: str) -> None:
    """The index of passages: postings, the dictionary, the blocks' bounds and the statistics, all from one pass over the texts."""
    spark, n = indexed.sparkSession, indexed.count()
    bits = max(BLOCK, (n // TERM_BLOCKS).bit_length())
    blocked = postings(indexed).withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits))
    blocked.write.option("parquet.page.row.count.limit", PAGE).option("parquet.block.size", GROUP).parquet(f"{path}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    lengths = stored.filter(F.col("fields").bitwiseAND(LEAD) > 0).agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in _LENGTHS))
    lengths.select(F.lit(n).cast("long").alias("n"), *_LENGTHS).coalesce(1).write.parquet(f"{path}/statistics")
    bounds(stored).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "block").write.parquet(f"{path}/blocks")
    found = spark.read.parquet(f"{path}/blocks").groupBy("bucket", "term").agg(*(F.sum(c).alias(c) for c in _FREQUENCIES))
    found.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.parquet(f"{path}/terms")


def _held() -> list[Column]:
    """How many rows have the term in each field, and in any of the first ranker's."""
    count = lambda bits: F.count_if(F.col("fields").bitwiseAND(bits) > 0)
    return [*(count(1 << k).alias(f"df_{f}") for f, k in FIELDS.items()), count(sum(1 << FIELDS[f] for f in FIRST)).alias("df")]


def dictionary(rows: DataFrame) -> DataFrame:
    """TERMS of postings: how many passages hold a term in each field, and in any of the first ranker's."""
    return rows.groupBy("bucket", "term").agg(*_held())


def bounds(rows: DataFrame) -> DataFrame:
    """BLOCKS of postings, and what the dictionary counts in each."""
    short = rows.select("bucket", "term", "block", "passage_id", "fields", "weight", _sum(F.col(f"len_{f}") for f in FIRST).alias("length"))
    by = short.groupBy("bucket", "term", "block")
    return by.agg(F.min("passage_id").alias("first"), F.max("passage_id").alias("last"), F.count("*").alias("n"), F.max("weight").alias("most"), F.min("length").alias("least"), *_held())


def _weight(field: str) -> float:
    return L.WEIGHTS["path" if field == "folder" else field]


class Index:
    """Postings and statistics that a search reads; the dictionary and the blocks, where there are such."""

    def __init__(self, rows: DataFrame, counts: dict[str, int], terms: DataFrame | None = None, blocks: DataFrame | None = None):
        self.rows, self.counts, self.terms, self.blocks = rows, counts, terms, blocks

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return cls(table("postings", POSTINGS), spark.read.parquet(f"{path}/statistics").first().asDict(), table("terms", TERMS), table("blocks", BLOCKS))

    def frequencies(self, words: list[str]) -> dict[str, dict[str, int]]:
        """What the dictionary has of some words: a row of each segment."""
        out = {w: dict.fromkeys(_FREQUENCIES, 0) for w in words}
        for r in self.terms.filter(_listed(words)).collect():
            out[r["term"]] = {k: v + r[k] for k, v in out[r["term"]].items()}
        return out

    def average(self, *fields: str) -> float:
        return sum(self.counts[f"len_{f}"] for f in fields) / self.counts["n"] if self.counts["n"] else 0.0


def _listed(words: list[str]) -> Column:
    """Whether a row's term is one of some words; the buckets are named for the scan."""
    return reduce(lambda a, b: a | b, ((F.col("bucket") == bucket_of(w)) & (F.col("term") == w) for w in words), F.lit(False))


def _wanted(query: Query, ranking: bool) -> list[tuple[str, bool]]:
    """The words to look up, and whether each is the beginning of a word."""
    out: dict[tuple[str, bool], None] = {}
    for t in (*query.positives, *query.negatives):
        for k, w in enumerate(t.words):
            out.setdefault((w, t.prefix and k == len(t.words) - 1))
    for p in query.ranking if ranking else ():
        for w in p:
            out.setdefault((w, False))
    return list(out)


def _is(word: str, prefix: bool) -> Column:
    return F.startswith("term", F.lit(word)) if prefix else F.col("term") == word


def _looked_up(index: Index, words: list[tuple[str, bool]], ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """A row for each passage (of some ranges) that holds some word: lengths, and w0, w1, ... the places of each word."""
    one = lambda w, p: (F.col("bucket") == bucket_of(w)) & _is(w, p) if len(w) > 1 or not p else _is(w, p)
    hits = index.rows.filter(reduce(lambda a, b: a | b, (one(w, p) for w, p in words)))
    if ranges is not None:
        hits = hits.filter(" or ".join(f"passage_id between {a} and {b}" for a, b in ranges) or "false")
    places = [F.flatten(F.collect_list(F.when(_is(w, p), F.col("at")))) if p else F.coalesce(F.first(F.when(_is(w, p), F.col("at")), True), F.array().cast("array<int>")) for w, p in words]
    return hits.groupBy("passage_id").agg(F.first("source_id").alias("source_id"), *(F.first(n).alias(n) for n in _LENGTHS), *(c.alias(f"w{k}") for k, c in enumerate(places)))


class _Places:
    """Columns over looked-up rows."""

    def __init__(self, words: list[tuple[str, bool]]):
        self.number = {w: k for k, w in enumerate(words)}

    def starts(self, words: tuple[str, ...], prefix: bool = False) -> Column:
        """Where a phrase begins, in any field."""
        own = [F.col(f"w{self.number[w, prefix and k == len(words) - 1]}") for k, w in enumerate(words)]
        return self._follow(own)

    @staticmethod
    def _follow(own: list[Column]) -> Column:
        if len(own) == 1:
            return own[0]
        return F.filter(own[0], lambda x: reduce(lambda a, b: a & b, (F.array_contains(c, x + k) for k, c in enumerate(own[1:], 1))))

    def frequency(self, term: Term, field: str) -> Column:
        if term.field not in (None, "path" if field == "folder" else field):
            return F.lit(0)
        low, high = FIELDS[field] << SHIFT, (FIELDS[field] + 1) << SHIFT
        return F.size(F.filter(self.starts(term.words, term.prefix), lambda x: (x >= low) & (x < high)))

    def body(self, phrase: tuple[str, ...]) -> Column:
        return F.filter(self.starts(phrase), lambda x: x < 1 << SHIFT)

    def heading(self, phrase: tuple[str, ...]) -> Column:
        """Where a phrase begins in title and file name as one text."""
        low, mid, high = FIELDS["filename"] << SHIFT, FIELDS["title"] << SHIFT, FIELDS["folder"] << SHIFT

        def own(w: str) -> Column:
            inside = F.filter(F.col(f"w{self.number[w, False]}"), lambda x: (x >= low) & (x < high))
            return F.transform(inside, lambda x: F.when(x >= mid, x - mid).otherwise(x - low + F.col("len_title")))

        return self._follow([own(w) for w in phrase])


def _matched(rows: DataFrame, p: _Places, query: Query, fields) -> tuple[DataFrame, Column]:
    """rows with f{i}_{field}, the frequency of each positive term in each field; and the condition that the query matches."""
    rows = rows.select("*", *(p.frequency(t, f).alias(f"f{i}_{f}") for i, t in enumerate(query.positives) for f in fields))
    rows = rows.withColumns({f"f{i}": _sum(F.col(f"f{i}_{f}") for f in fields) for i in range(len(query.positives))})
    join = (lambda a, b: a | b) if query.any_of else (lambda a, b: a & b)
    found = reduce(join, (F.col(f"f{i}") > 0 for i in range(len(query.positives))))
    for t in query.negatives:
        found = found & (_sum(p.frequency(t, f) for f in fields) == 0)
    return rows, found


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _simple(index: Index, query: Query) -> bool:
    """Whether the dictionary knows how many passages hold each term: words, not phrases or beginnings."""
    return index.terms is not None and all(len(t.words) == 1 and not t.prefix for t in query.positives)


def _field(name: str | None) -> str:
    return "folder" if name == "path" else name  # the first ranker's path


def _document_frequencies(index: Index, query: Query) -> list[int]:
    """Of each positive term, by the first ranker's fields."""
    known = index.frequencies([t.words[0] for t in query.positives])
    return [known[t.words[0]]["df" if t.field is None else f"df_{_field(t.field)}"] if t.field is None or _field(t.field) in FIRST else 0 for t in query.positives]


def _idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def scored(index: Index, query: Query, ranges: list[tuple[int, int]] | None = None, dfs: list[int] | None = None) -> DataFrame:
    """Matching passages (of some ranges) by the first ranker: bm25, body_hits, rank, and what signals need."""
    words = _wanted(query, True)
    p = _Places(words)
    rows, found = _matched(_looked_up(index, words, ranges), p, query, FIRST)
    n, out = index.counts["n"], rows.filter(found)
    if dfs is None and _simple(index, query):
        dfs = _document_frequencies(index, query)
    if dfs is not None:
        weights = [F.lit(_idf(n, df)) for df in dfs]
    else:
        df = rows.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(query.positives))))
        out = out.crossJoin(F.broadcast(df))  # one row
        weights = [F.greatest(F.log((F.lit(n) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6)) for i in range(len(query.positives))]
    length = _sum(F.col(f"len_{f}") for f in FIRST)
    score = F.lit(0.0)
    for i, idf in enumerate(weights):
        f = _sum(F.col(f"f{i}_{name}") * F.lit(_weight(name)) for name in FIRST)
        score = score + idf * f * (L.K1 + 1) / (f + L.K1 * (1 - L.B + L.B * length / F.lit(index.average(*FIRST))))
    out = out.withColumn("bm25", score).withColumn("body_hits", _sum(F.col(f"f{i}_body") for i in range(len(query.positives))))
    return out.withColumn("rank", F.col("bm25") * F.when(F.col("body_hits") > 0, 1.0).otherwise(L.METADATA_ONLY))


class Sweep:
    """Over the blocks of a query's words: ranges of passages, and what no score within each exceeds."""

    def __init__(self, index: Index, query: Query, dfs: list[int]):
        words = [t.words[0] for t in query.positives]
        rows = index.blocks.filter(_listed(words)).select("term", "first", "last", "n", "most", "least").collect()  # TERM_BLOCKS of a word and segment at most
        self.total = sum(r["n"] for r in rows)
        if self.total < SWEPT:
            return
        n, average = index.counts["n"], index.average(*FIRST)
        edges = np.unique(np.array([x for r in rows for x in (r["first"], r["last"] + 1)], np.int64))
        self.begin, self.end = edges[:-1], edges[1:] - 1
        bound, self.size, every = np.zeros(len(self.begin)), np.zeros(len(self.begin)), np.ones(len(self.begin), bool)
        for w, df in zip(words, dfs):
            own = [r for r in rows if r["term"] == w]
            f, short = np.array([r["most"] for r in own]), np.array([r["least"] for r in own], float)
            part = _idf(n, df) * f * (L.K1 + 1) / (f + L.K1 * (1 - L.B + L.B * short / average)) if own else np.zeros(0)
            a, b = (np.searchsorted(edges, np.array([r["first"] for r in own], np.int64)), np.searchsorted(edges, np.array([r["last"] + 1 for r in own], np.int64)))
            at = np.concatenate([np.arange(i, j) for i, j in zip(a, b)]).astype(int) if own else np.zeros(0, int)
            most = np.zeros(len(self.begin))
            np.maximum.at(most, at, np.repeat(part, b - a))
            np.add.at(self.size, at, np.repeat(np.array([r["n"] for r in own]) / np.maximum(b - a, 1), b - a))
            bound, every = bound + most, every & (most > 0)
        self.bound = bound if query.any_of else np.where(every, bound, 0.0)

    def best(self, rows: int) -> list[tuple[int, int]]:
        """The most promising ranges, until they have so many postings."""
        order = np.argsort(-self.bound, kind="stable")
        order = order[self.bound[order] > 0]
        return self._merged(np.sort(order[: int(np.searchsorted(np.cumsum(self.size[order]), rows)) + 1]))

    def reaching(self, score: float) -> list[tuple[int, int]]:
        """The ranges that can hold a score of at least so much, but for the last digits of sums."""
        return self._merged(np.flatnonzero((self.bound > 0) & (self.bound >= score - 1e-9 * abs(score))))

    def _merged(self, at: np.ndarray) -> list[tuple[int, int]]:
        """Ranges in order; those with the smallest gaps are joined until there are few."""
        if not len(at):
            return []
        begin, end = self.begin[at].tolist(), self.end[at].tolist()
        gaps = [b - a for a, b in zip(end, begin[1:])]  # exact: ids may lie far apart
        cut = sorted(sorted((k for k, g in enumerate(gaps) if g > 1), key=lambda k: -gaps[k])[: RANGES - 1])
        return list(zip([begin[0], *(begin[k + 1] for k in cut)], [*(end[k] for k in cut), end[-1]]))


def best_passages(index: Index, query: Query, k: int, files: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """The k best matching passages by rank; blocks that can't hold one of them aren't read."""
    top = lambda ranges, dfs: allowed(scored(index, query, ranges, dfs), files, where).orderBy(F.desc("rank"), "passage_id").limit(k)
    if not _simple(index, query):
        return top(None, None)
    dfs = _document_frequencies(index, query)
    if index.blocks is None:
        return top(None, dfs)
    sweep = Sweep(index, query, dfs)
    if sweep.total < SWEPT:
        return top(None, dfs)
    first = top(sweep.best(AHEAD * k), dfs).agg(F.count("*"), F.min("rank")).first()
    return top(sweep.reaching(first[1] if first[0] == k else 0.0), dfs)


def with_signals(rows: DataFrame, query: Query) -> DataFrame:
    """cover, the numbers of the phrases that body or heading hold, and multiplier."""
    p, phrases = _Places(_wanted(query, True)), query.ranking
    n = len(phrases)
    rows = rows.withColumns({f"{k}{i}": at(w) for i, w in enumerate(phrases) for k, at in (("_b", p.body), ("_h", p.heading))})
    held = {k: F.array_compact(F.array(*(F.when(F.size(f"{k}{i}") > 0, F.lit(i)) for i in range(n)))) for k in ("_b", "_h")}
    rows = rows.withColumn("body_c", held["_b"]).withColumn("heading_c", held["_h"]).withColumn("cover", F.array_union("body_c", "heading_c"))
    if n < 2:
        return rows.withColumn("multiplier", F.lit(1.0))
    near = {k: F.coalesce(1 / (1 + L.span_of([F.col(f"{k}{i}") for i in range(n)]) / 8), F.lit(0.0)) for k in ("_b", "_h")}
    rows = rows.withColumns({"_body": F.size("body_c"), "_head": F.size("heading_c")})
    value = 1.0 + F.when(F.col("_body") == n, 4.0 + 3.0 * near["_b"]).otherwise(0.35 * F.col("_body") / n)
    value = value + F.when(F.col("_head") == n, 5.0 + 3.0 * near["_h"]).otherwise(F.col("_head") / n)
    both = (F.size("cover") == n) & (F.col("_body") < n) & (F.col("_head") < n)
    return rows.withColumn("multiplier", value + F.when(both, 2.5).otherwise(0.0))


def allowed(rows: DataFrame, files: DataFrame | None, where: Column | None) -> DataFrame:
    """Rows of the sources that a filter over files lets through."""
    return rows if where is None else rows.join(files.filter(where).select("source_id"), "source_id", "left_semi")


def search(index: Index, query: Query, limit: int = 20, files: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """source_id, score, best_passage of the best `limit` sources, as `lexical.search` gives them."""
    rows = best_passages(index, query, max(limit * 8, 200), files, where)
    return L.by_source(with_signals(rows, query).withColumn("score", F.col("rank") * F.col("multiplier")), query, limit)


def scored_v2(index: Index, query: Query) -> DataFrame:
    words = _wanted(query, False)
    p = _Places(words)
    rows, found = _matched(_looked_up(index, words), p, query, SECOND)
    n, score, out = index.counts["n"], F.lit(0.0), rows.filter(found)
    known = index.frequencies([t.words[0] for t in query.positives]) if _simple(index, query) else None
    if known is None:
        df = rows.agg(*(F.count_if(F.col(f"f{i}_{f}") > 0).alias(f"df_{i}_{f}") for i in range(len(query.positives)) for f in SECOND))
        out = out.crossJoin(F.broadcast(df))  # one row
    for i, t in enumerate(query.positives):
        for f in SECOND:
            tf = F.col(f"f{i}_{f}")
            if known is None:
                d = F.col(f"df_{i}_{f}")
                idf = F.log(1 + (F.lit(n) - d + 0.5) / (d + 0.5))
            else:
                d = known[t.words[0]][f"df_{f}"] if t.field in (None, f) else 0
                idf = F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5)))
            score = score + L.WEIGHTS[f] * idf * tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * F.col(f"len_{f}") / F.lit(index.average(f))))
    return out.withColumn("bm25", score)


def search_v2(index: Index, passages: DataFrame, query: Query, limit: int = 20, offset: int = 0, after: Column | None = None) -> DataFrame:
    """As `lexical.search_v2`; only candidates' texts are read."""
    best = scored_v2(index, query).orderBy(F.desc("bm25"), "passage_id").limit(L.candidates_v2(limit, offset)).select("passage_id", "bm25")
    rows = passages.join(F.broadcast(best), "passage_id")  # at most 20,000 rows
    rows = rows.withColumn("body_t", tokens(F.col("body")))
    return L.page(L.rerank_v2(rows if after is None else rows.filter(after), query), limit, offset)
