"""Lexical search: matching, BM25 over weighted fields, coverage, proximity, grouping by source.

Two rankers. `search` matches all terms over four fields, with the folder as the path field; `search_v2` has its own
length norm for each field and another reranking. BM25 is the formula of Robertson and Zaragoza (2009), k1 = 1.2,
b = 0.75. Matching is one pass of column expressions over the passages; only statistics (one row) and matches are
exchanged. Ties are broken by the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens

from .query import Query, Term

# Fixed values of the rankers.
WEIGHTS = {"body": 1.0, "filename": 5.0, "title": 3.0, "path": 0.7}
K1, B = 1.2, 0.75
METADATA_ONLY = 0.08
SHARES = (1.0, 0.15, 0.05)


def with_tokens(indexed: DataFrame, path: str = "folder") -> DataFrame:
    """A column of terms for each field: body_t, filename_t, title_t, path_t."""
    of = {"body": "body", "filename": "filename", "title": "title", "path": path}
    return indexed.withColumns({f"{f}_t": tokens(F.col(c)) for f, c in of.items()})


def starts(words: tuple[str, ...], terms: Column, prefix: bool = False) -> Column:
    """Positions, from 1, at which the phrase begins."""
    k = len(words)
    phrase = F.array(*map(F.lit, words))

    def here(i: Column) -> Column:
        if not prefix:
            return F.slice(terms, i, k) == phrase if k > 1 else F.element_at(terms, i) == words[0]
        last = F.startswith(F.element_at(terms, i + k - 1), F.lit(words[-1]))
        return last & (F.slice(terms, i, k - 1) == F.array(*map(F.lit, words[:-1]))) if k > 1 else last

    return F.when(F.size(terms) >= k, F.filter(F.sequence(F.lit(1), F.size(terms) - k + 1), here)).otherwise(F.array().cast("array<int>"))


def frequency(term: Term, field: str) -> Column:
    terms = F.col(f"{field}_t")
    if term.field not in (None, field):
        return F.lit(0)
    if len(term.words) == 1:
        word = term.words[0]
        return F.size(F.filter(terms, (lambda x: F.startswith(x, F.lit(word))) if term.prefix else (lambda x: x == word)))
    line = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    return F.regexp_count(line, F.lit(f"(?= {' '.join(term.words)}{'' if term.prefix else ' '})"))  # looks ahead, so overlaps count


def found(term: Term) -> Column:
    return reduce(lambda a, b: a + b, (frequency(term, f) for f in WEIGHTS)) > 0


def matches(query: Query) -> Column:
    """The boolean expression of a query over a passage."""
    join = (lambda a, b: a | b) if query.any_of else (lambda a, b: a & b)
    out = reduce(join, map(found, query.positives))
    return reduce(lambda a, t: a & ~found(t), query.negatives, out)


def _lengths(fields=WEIGHTS) -> Column:
    return reduce(lambda a, b: a + b, (F.size(f"{f}_t") for f in fields))


def matched(tokenised: DataFrame, query: Query, where: Column | None = None) -> DataFrame:
    """Matching passages with rank, the weighted BM25; statistics are of all passages, filtered or not."""
    named = tokenised.withColumn("len", _lengths())
    stats = named.agg(
        F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(found(t)).alias(f"df{i}") for i, t in enumerate(query.positives))
    )
    rows = named.filter(matches(query) if where is None else matches(query) & where)
    score = F.lit(0.0)
    for i, t in enumerate(query.positives):
        f = reduce(lambda a, b: a + b, (frequency(t, name) * F.lit(w) for name, w in WEIGHTS.items()))
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    in_body = reduce(lambda a, b: a + b, (frequency(t, "body") for t in query.positives))
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    return rows.withColumn("bm25", score).withColumn("body_hits", in_body).withColumn("rank", F.col("bm25") * F.when(F.col("body_hits") > 0, 1.0).otherwise(METADATA_ONLY))


def span(phrases, terms: Column) -> Column:
    """The smallest distance within which all phrases begin; null unless all occur."""

    return span_of([starts(p, terms) for p in phrases])


def span_of(places: list[Column]) -> Column:
    """The smallest distance within which each list has a place."""

    def begins(number: int) -> Column:
        return F.transform(places[number], lambda x: F.struct(x.alias("at"), F.lit(number).alias("term")))

    events = F.array_sort(F.concat(*map(begins, range(len(places)))))
    none = F.struct(F.array(*(F.lit(-1) for _ in places)).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == e["term"], e["at"]).otherwise(v))
        least = F.array_min(last)
        return F.struct(last.alias("last"), F.when(least >= 0, F.least(state["best"], e["at"] - least)).otherwise(state["best"]).alias("best"))

    return F.aggregate(events, none, step, lambda s: s["best"])


def proximity(phrases, terms: Column) -> Column:
    return F.coalesce(1 / (1 + span(phrases, terms) / 8), F.lit(0.0))


def proximity_v2(phrases, terms: Column) -> Column:
    return F.coalesce(1 + 1.5 / (1 + span(phrases, terms) / 4), F.lit(1.0)) if len(phrases) > 1 else F.lit(1.0)


def covered(phrases, terms: Column) -> Column:
    """The numbers of the phrases that occur."""
    return F.array_compact(F.array(*(F.when(F.size(starts(p, terms)) > 0, F.lit(i)) for i, p in enumerate(phrases))))


def with_signals(rows: DataFrame, query: Query) -> DataFrame:
    """body_c and heading_c, the covered phrases, and multiplier."""
    phrases = query.ranking
    n = len(phrases)
    heading = F.concat(F.col("title_t"), F.col("filename_t"))
    rows = rows.withColumn("body_c", covered(phrases, F.col("body_t"))).withColumn("heading_c", covered(phrases, heading))
    if n < 2:
        return rows.withColumn("multiplier", F.lit(1.0))
    body, head = F.size("body_c") / n, F.size("heading_c") / n
    value = 1.0 + F.when(F.size("body_c") == n, 4.0 + 3.0 * proximity(phrases, F.col("body_t"))).otherwise(0.35 * body)
    value = value + F.when(F.size("heading_c") == n, 5.0 + 3.0 * proximity(phrases, heading)).otherwise(head)
    both = (F.size(F.array_union("body_c", "heading_c")) == n) & (F.size("body_c") < n) & (F.size("heading_c") < n)
    return rows.withColumn("multiplier", value + F.when(both, 2.5).otherwise(0.0))


def roll_up(rows: DataFrame, score: str = "score", key: str = "source_id", tie: str = "passage_id") -> DataFrame:
    """A source's three best passages, weighted 1, 0.15 and 0.05."""
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie)))).filter("nth <= 3")
    share = F.element_at(F.array(*map(F.lit, SHARES)), F.col("nth"))
    return best.groupBy(key).agg(F.sum(F.col(score) * share).alias("total"), F.max(F.when(F.col("nth") == 1, F.col(tie))).alias("best_passage"))


def coverage_factor(phrases, number: Column) -> Column:
    n = len(phrases)
    return F.when(number == n, 1.8).otherwise(1.0 + 0.25 * number / n) if n > 1 else F.lit(1.0)


def document_coverage(rows: DataFrame, query: Query) -> DataFrame:
    """Of each source, over all its matched passages: the share of phrases covered, as a factor."""
    c = rows.groupBy("source_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.array_union("body_c", "heading_c"))))).alias("covered"))
    return c.withColumn("factor", coverage_factor(query.ranking, F.col("covered")))


def search(indexed: DataFrame, query: Query, limit: int = 20, where: Column | None = None) -> DataFrame:
    """source_id, score, best_passage of the best `limit` sources: candidates are the best passages by rank, before their multipliers."""
    candidates = matched(with_tokens(indexed), query, where).orderBy(F.desc("rank"), "passage_id").limit(max(limit * 8, 200))
    rows = with_signals(candidates, query).withColumn("score", F.col("rank") * F.col("multiplier")).withColumn("cover", F.array_union("body_c", "heading_c"))
    return by_source(rows, query, limit)


def by_source(rows: DataFrame, query: Query, limit: int) -> DataFrame:
    """Sources of scored passages (source_id, passage_id, score, cover): roll_up and document_coverage in one pass."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "passage_id"))
    rows = rows.select("source_id", "passage_id", "score", "cover", nth.alias("nth"))
    share = F.element_at(F.array(*map(F.lit, SHARES)), F.least("nth", F.lit(3)))
    out = rows.groupBy("source_id").agg(
        F.sum(F.when(F.col("nth") <= 3, F.col("score") * share)).alias("total"), F.max(F.when(F.col("nth") == 1, F.col("passage_id"))).alias("best_passage"),
        F.size(F.array_distinct(F.flatten(F.collect_set("cover")))).alias("covered"),
    )
    score = F.col("total") * coverage_factor(query.ranking, F.col("covered"))
    return out.select("source_id", score.alias("score"), "best_passage").orderBy(F.desc("score"), "source_id").limit(limit)


# --- the second ranker --------------------------------------------------------------------------------------------------


def matched_v2(tokenised: DataFrame, query: Query) -> DataFrame:
    """Matches with the sum of each field's BM25, boosted."""
    names = list(WEIGHTS)
    stats = tokenised.agg(
        F.count("*").alias("n"), *(F.avg(F.size(f"{f}_t")).alias(f"avg_{f}") for f in names),
        *(F.count_if(frequency(t, f) > 0).alias(f"df_{i}_{f}") for i, t in enumerate(query.positives) for f in names),
    )
    score = F.lit(0.0)
    for i, t in enumerate(query.positives):
        for f in names:
            tf, df = frequency(t, f), F.col(f"df_{i}_{f}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            score = score + WEIGHTS[f] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(f"{f}_t") / F.col(f"avg_{f}")))
    return tokenised.filter(matches(query)).crossJoin(F.broadcast(stats)).withColumn("bm25", score)


def rerank_v2(rows: DataFrame, query: Query) -> DataFrame:
    """score from bm25 and what share of the terms the text, the title and the name hold, as parts of words or whole."""
    from skein.functions.text import fold

    terms = [w for t in query.positives for w in t.words if len(w.encode()) > 1]
    if not terms:
        return rows.withColumn("score", F.col("bm25"))
    low = {f: fold(F.col(f)) for f in ("body", "filename", "title", "path")}
    everything = F.concat_ws(" ", low["body"], low["title"], low["filename"], low["path"])
    share = lambda text: reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in terms)) / len(terms)
    cover = share(everything)
    value = F.col("bm25") * (0.35 + 0.65 * cover) * F.when(cover == 1, 1.8).otherwise(1.0)
    value = value * F.when(share(low["body"]) == 1, 1.5 * proximity_v2([(t,) for t in dict.fromkeys(terms)], F.col("body_t"))).otherwise(1.0)
    return rows.withColumn("score", value * F.when(share(F.concat_ws(" ", low["filename"], low["title"])) == 1, 2.0).otherwise(1.0))


def candidates_v2(limit: int, offset: int) -> int:
    return min(max(min(max(limit + offset, 1), 200) * 40, 2000), 20000)


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of the sources of reranked passages."""
    out = roll_up(rows)
    return out.select("source_id", F.col("total").alias("score"), "best_passage").orderBy(F.desc("score"), "source_id").offset(offset).limit(limit)


def search_v2(indexed: DataFrame, query: Query, limit: int = 20, offset: int = 0, after: Column | None = None) -> DataFrame:
    """source_id, score, best_passage. Filters (`after`) apply after the cut of candidates."""
    candidates = matched_v2(with_tokens(indexed, "path"), query).orderBy(F.desc("bm25"), "passage_id").limit(candidates_v2(limit, offset))
    return page(rerank_v2(candidates if after is None else candidates.filter(after), query), limit, offset)
