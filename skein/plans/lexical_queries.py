"""Queries of lexical search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import expression as X
from skein.operators import inverted as I
from skein.operators import lexical as L
from skein.operators.query import parse

from . import corpus as C

PAIR = parse("ering onth")
EITHER, NOT, PHRASE, PREFIX, FIELD = parse("ering OR onth"), parse("ering -onth"), parse('"of the"'), parse("erin*"), parse("title:the")


def _tokens_sql(c: str) -> str:
    return f"coalesce(regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+'), [])"


def _tf(term, f: str) -> str:
    t = f"{f}_t"
    if term.field not in (None, f):
        return "0"
    if len(term.words) == 1:
        return f"len(list_filter({t}, lambda x: {f"starts_with(x, '{term.words[0]}')" if term.prefix else f"x = '{term.words[0]}'"}))"
    return f"len({_starts(term.words, t)})"


def _starts(words, t: str) -> str:
    k = len(words)
    return f"list_filter(range(1, len({t}) - {k} + 2), lambda i: {t}[i:i + {k - 1}] = [{', '.join(f"'{w}'" for w in words)}])"


def _found(term) -> str:
    return "(" + " + ".join(_tf(term, f) for f in L.WEIGHTS) + ") > 0"


def _matches(q) -> str:
    return "(" + (" or " if q.any_of else " and ").join(_found(t) for t in q.positives) + ")" + "".join(f" and not ({_found(t)})" for t in q.negatives)


def _tokenised(path: str = "folder") -> str:
    cols = ", ".join(f"{_tokens_sql(path if f == 'path' else f)} as {f}_t" for f in L.WEIGHTS)
    return f"toks as materialized (select *, {cols} from indexed)"


def _with(*parts: str, path: str = "folder") -> str:
    return C.with_(C.SQL_FILES, C.SQL_PASSAGES, C.SQL_INDEXED, _tokenised(path), *parts)


def _matched(q) -> str:
    """Common table expressions: stats and matched(rank)."""
    df = "".join(f", count(*) filter ({_found(t)}) as df{i}" for i, t in enumerate(q.positives))
    length = " + ".join(f"len({f}_t)" for f in L.WEIGHTS)
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_ / avg_len))" for i in range(len(q.positives))
    )
    fs = "".join(f", {' + '.join(f'{w} * {_tf(t, f)}' for f, w in L.WEIGHTS.items())} as f{i}" for i, t in enumerate(q.positives))
    body = " + ".join(_tf(t, "body") for t in q.positives)
    return f"""stats as (select count(*) as n, avg({length}) as avg_len{df} from toks),
hits as (select *, {length} as len_, {body} as body_hits{fs} from toks where {_matches(q)}),
matched as (select *, {score} as bm25, ({score}) * case when body_hits > 0 then 1.0 else 0.08 end as rank from hits, stats)"""


def _span(phrases, t: str) -> str:
    lists = [_starts(p, t) for p in phrases]
    inner = ", ".join(f"list_max(list_filter(p{i}, lambda q: q <= p))" for i in range(len(lists)))
    none = " or ".join(f"len(list_filter(p{i}, lambda q: q <= p)) = 0" for i in range(len(lists)))
    every = ", ".join(f"p{i}" for i in range(len(lists)))
    lets = ", ".join(f"{x} as p{i}" for i, x in enumerate(lists))
    return f"(select list_min(list_filter(list_transform(list_concat({every}), lambda p: case when {none} then null else p - list_min([{inner}]) end), lambda d: d is not null)) from (select {lets}))"


def _signals(q) -> str:
    """matched -> signals(multiplier, cover)."""
    ph, n = q.ranking, len(q.ranking)
    cov = lambda t: "list_filter([" + ", ".join(f"case when len({_starts(p, t)}) > 0 then {i} end" for i, p in enumerate(ph)) + "], lambda x: x is not null)"
    return f"""heads as (select *, list_concat(title_t, filename_t) as head_t from candidates),
signals as (
  select *, 1.0 + case when len(bc) = {n} then 4.0 + 3.0 * coalesce(1 / (1 + bspan / 8.0), 0) else 0.35 * len(bc) / {n} end
    + case when len(hc) = {n} then 5.0 + 3.0 * coalesce(1 / (1 + hspan / 8.0), 0) else len(hc) / {n} end
    + case when len(list_distinct(list_concat(bc, hc))) = {n} and len(bc) < {n} and len(hc) < {n} then 2.5 else 0 end as multiplier,
    list_distinct(list_concat(bc, hc)) as cover
  from (select *, {cov("body_t")} as bc, {cov("head_t")} as hc, {_span(ph, "body_t")} as bspan, {_span(ph, "head_t")} as hspan from heads))"""


def _roll(table: str, score: str) -> str:
    return f"""ranked as (select *, row_number() over (partition by source_id order by {score} desc, passage_id) as nth from {table}),
rolled as (
  select source_id, sum({score} * [1.0, 0.15, 0.05][nth]) as total, max(case when nth = 1 then passage_id end) as best_passage
  from ranked where nth <= 3 group by source_id)"""


_COVERAGE = """coverage as (
  select source_id, count(distinct u) as covered from (select source_id, unnest(cover) as u from signals) group by source_id)"""

CANDIDATES = "candidates as (select * from matched order by rank desc, passage_id limit 200)"
ALL = "candidates as (select * from matched)"
_V2_TERMS = [w for t in PAIR.positives for w in t.words]


def _v2() -> str:
    names = list(L.WEIGHTS)
    stats = ", ".join([*(f"avg(len({f}_t)) as avg_{f}" for f in names), *(f"count(*) filter ({_tf(t, f)} > 0) as df_{i}_{f}" for i, t in enumerate(PAIR.positives) for f in names)])
    score = " + ".join(
        f"{L.WEIGHTS[f]} * ln(1 + (n - df_{i}_{f} + 0.5) / (df_{i}_{f} + 0.5)) * {_tf(t, f)} * 2.2 / ({_tf(t, f)} + 1.2 * (0.25 + 0.75 * len({f}_t) / avg_{f}))" for i, t in enumerate(PAIR.positives) for f in names
    )
    share = lambda text: "(" + " + ".join(f"contains({text}, '{w}')::int" for w in _V2_TERMS) + f") / {len(_V2_TERMS)}"
    low = lambda c: f"strip_accents(lower({c}))"
    every = " || ' ' || ".join(low(c) for c in ("body", "title", "filename", "path"))
    return f"""stats as (select count(*) as n, {stats} from toks),
candidates as (select toks.*, {score} as bm25 from toks, stats where {_matches(PAIR)} order by bm25 desc, passage_id limit 2000),
reranked as (
  select *, bm25 * (0.35 + 0.65 * c) * case when c = 1 then 1.8 else 1.0 end
    * case when cb = 1 then 1.5 * coalesce(1 + 1.5 / (1 + bspan / 4.0), 1.0) else 1.0 end * case when ch = 1 then 2.0 else 1.0 end as score
  from (select *, {share(every)} as c, {share(low("body"))} as cb, {share(low("filename") + " || ' ' || " + low("title"))} as ch, {_span([(w,) for w in _V2_TERMS], "body_t")} as bspan from candidates))"""


def _toks(s, d, path="folder"):
    return L.with_tokens(C.stored_indexed(s, d), path)


def _match_query(q):
    return (lambda s, d: I.scored(C.store(s, d).index, q).select("passage_id", "source_id")), _with() + f"select passage_id, source_id from toks where {_matches(q)}"


def _candidates(s, d):
    return I.scored(C.store(s, d).index, PAIR).orderBy(F.desc("rank"), "passage_id").limit(200)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def tokenize(s, d):
    return C.table(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("tokens_md5"))


def _body_places(s, d):
    """Where each term stands in the bodies, from the stored index."""
    return C.store(s, d).index.rows.select("term", "passage_id", F.filter("at", lambda x: x < 1 << I.SHIFT).alias("at")).filter(F.size("at") > 0)


def postings(s, d):
    return _body_places(s, d).select("term", "passage_id", F.size("at").cast("long").alias("tf"), F.element_at("at", 1).cast("long").alias("first_position"), F.element_at("at", -1).cast("long").alias("last_position"))


def doc_freq(s, d):
    return _body_places(s, d).groupBy("term").agg(F.count("*").alias("df"))


def bm25(s, d):
    return I.scored(C.store(s, d).index, PAIR).select("passage_id", _r("bm25"))


def metadata_penalty(s, d):
    q = parse("doc the")
    return I.scored(C.store(s, d).index, q).select("passage_id", F.col("body_hits").cast("long").alias("body_hits"), _r("rank"))


def proximity(s, d):
    x = _toks(s, d).filter(L.matches(PAIR))
    return x.select("passage_id", L.span(PAIR.ranking, F.col("body_t")).cast("long").alias("span"), F.round(L.proximity(PAIR.ranking, F.col("body_t")), 6).alias("proximity"))


def proximity_v2(s, d):
    x = _toks(s, d).filter(L.matches(PAIR))
    return x.select("passage_id", F.round(L.proximity_v2(PAIR.ranking, F.col("body_t")), 6).alias("proximity"))


def passage_multiplier(s, d):
    return I.with_signals(I.scored(C.store(s, d).index, EITHER), EITHER).select("passage_id", _r("multiplier"))


def document_coverage(s, d):
    rows = I.with_signals(I.scored(C.store(s, d).index, EITHER), EITHER)
    return L.document_coverage(rows, EITHER).select("source_id", F.col("covered").cast("long").alias("covered"), _r("factor"))


def passage_rollup(s, d):
    return L.roll_up(_candidates(s, d), "rank").select("source_id", _r("total"), "best_passage")


def top3_passages(s, d):
    w = L.Window.partitionBy("source_id").orderBy(F.desc("rank"), "passage_id")
    return I.scored(C.store(s, d).index, EITHER).withColumn("nth", F.row_number().over(w).cast("long")).filter("nth <= 3").select("source_id", "nth", "passage_id")


def text_search(s, d):
    return I.search(C.store(s, d).index, PAIR).select("source_id", _r("score"), "best_passage")


def text_search_v2(s, d):
    x = C.store(s, d)
    return I.search_v2(x.index, x.indexed, PAIR).select("source_id", _r("score"), "best_passage")


NESTED = '(ering OR "of the"~3) +(filename:doc OR title:the^2) -(onth OR "in a")'


def match_nested(s, d):
    """A query of nested groups, with slop, weights and exclusions."""
    return X.scored(C.store(s, d).index, X.parse(NESTED)).select("passage_id", _r("bm25"))


def rerank_v2(s, d):
    x = C.store(s, d)
    best = I.scored_v2(x.index, PAIR).orderBy(F.desc("bm25"), "passage_id").limit(2000).select("passage_id", "bm25")
    rows = x.indexed.join(F.broadcast(best), "passage_id").withColumn("body_t", T.tokens(F.col("body")))
    return L.rerank_v2(rows, PAIR).select("passage_id", _r("score"))


def excerpt(s, d):
    return C.stored_passages(s, d).select("passage_id", T.excerpt(F.col("body"), ["ering", "onth"]).alias("excerpt"))


def semantic_excerpt(s, d):
    return C.stored_passages(s, d).select("passage_id", T.short_excerpt(F.col("body")).alias("excerpt"))


def highlights(s, d):
    x = C.table(s, d, "documents").select("doc_id", F.explode(T.highlights(F.col("text"), ["ering", "onth"])).alias("h"))
    return x.select("doc_id", F.col("h.location").cast("long").alias("location"), F.col("h.length").cast("long").alias("length"))


def highlights_utf16(s, d):
    """The same in UTF-16 units, over the documents with a letter beyond U+FFFF after each first word."""
    text = F.regexp_replace("text", r"^(\S+)", "$1 \U0001d4b3")
    x = C.table(s, d, "documents").select("doc_id", F.explode(T.with_utf16(T.highlights(text, ["ering", "onth"]), text)).alias("h"))
    return x.select("doc_id", *(F.col(f"h.{c}").cast("long").alias(c) for c in ("location", "location16", "length16")))


def snippet(s, d):
    x = C.stored_passages(s, d)
    return x.filter(F.arrays_overlap(T.tokens(F.col("body")), F.array(F.lit("ering")))).select("passage_id", T.snippet(F.col("body"), ["ering"]).alias("snippet"))


def chunk_passages(s, d):
    return C.passages(s, d).select("passage_id", "ordinal", F.md5("body").alias("body_md5"))


def chunk_counts(s, d):
    return C.passages(s, d).groupBy("source_id").agg(F.count("*").alias("n_passages"))


def match_reason(s, d):
    name = F.contains(F.lower("filename"), F.lit("doc_1"))
    body = F.arrays_overlap("body_t", F.array(F.lit("ering")))
    reason = F.when(name, "Filename match").when(body, "Text match").otherwise("Related content")
    return _toks(s, d).select("passage_id", reason.alias("reason"))


def _sloppy(words, t: str, slop: int) -> str:
    """Where the first of two words stands with the second one at most `slop` places beyond the next."""
    return f"list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{words[0]}' and list_contains({t}[i + 1:i + 1 + {slop}], '{words[1]}'))"


def _nested() -> str:
    """NESTED: frequencies by field, what matches, and the sum of its parts' scores."""
    fields = list(L.WEIGHTS)
    word = lambda w: lambda t: f"len(list_filter({t}, lambda x: x = '{w}'))"
    each = {  # name: its frequency in a field, the field it is limited to, its weight
        "e": (word("ering"), None, 1.0), "o": (lambda t: f"len({_sloppy(('of', 'the'), t, 3)})", None, 1.0), "d": (word("doc"), "filename", 1.0),
        "h": (word("the"), "title", 2.0), "n": (word("onth"), None, 0.0), "a": (lambda t: f"len({_starts(('in', 'a'), t)})", None, 0.0),
    }
    tf = ", ".join(f"{of(f'{f}_t') if own in (None, f) else '0'} as {k}_{f}" for k, (of, own, _) in each.items() for f in fields)
    has = {k: "(" + " + ".join(f"{k}_{f}" for f in fields) + ") > 0" for k in each}
    df = ", ".join(f"count(*) filter ({k}_{f} > 0) as df_{k}_{f}" for k in each for f in fields) + "".join(f", avg(len({f}_t)) as avg_{f}" for f in fields)
    score = " + ".join(f"{weight * L.WEIGHTS[f]} * ln(1 + (n - df_{k}_{f} + 0.5) / (df_{k}_{f} + 0.5)) * {k}_{f} * 2.2 / ({k}_{f} + 1.2 * (0.25 + 0.75 * len({f}_t) / avg_{f}))" for k, (_, _, weight) in each.items() if weight for f in fields)
    return f"""tfs as materialized (select *, {tf} from toks), stats as (select count(*) as n, {df} from tfs)
select passage_id, round({score}, 6) as bm25 from tfs, stats where ({has['e']} or {has['o']}) and ({has['d']} or {has['h']}) and not ({has['n']} or {has['a']})"""


_MD5 = "md5(array_to_string(t, ' '))"
QUERIES = {
    "tokenize": (tokenize, f"select doc_id, len(t) as n_tokens, {_MD5} as tokens_md5 from (select doc_id, {_tokens_sql('text')} as t from documents)"),
    "postings": (postings, C.WITH_PASSAGES + f"""select term, passage_id, count(*) as tf, min(pos) as first_position, max(pos) as last_position
from (select passage_id, unnest(t) as term, unnest(range(len(t))) as pos from (select passage_id, {_tokens_sql('body')} as t from passages)) group by 1, 2"""),
    "doc_freq": (doc_freq, C.WITH_PASSAGES + f"select term, count(*) as df from (select distinct passage_id, unnest({_tokens_sql('body')}) as term from passages) group by 1"),
    "match_and": _match_query(PAIR), "match_or": _match_query(EITHER), "match_not": _match_query(NOT),
    "match_phrase": _match_query(PHRASE), "match_prefix": _match_query(PREFIX), "match_field": _match_query(FIELD),
    "bm25": (bm25, _with(_matched(PAIR)) + "select passage_id, round(bm25, 6) as bm25 from matched"),
    "metadata_penalty": (metadata_penalty, _with(_matched(parse("doc the"))) + "select passage_id, body_hits, round(rank, 6) as rank from matched"),
    "proximity": (proximity, _with() + f"select passage_id, sp as span, round(coalesce(1 / (1 + sp / 8.0), 0.0), 6) as proximity from (select *, {_span(PAIR.ranking, 'body_t')} as sp from toks where {_matches(PAIR)})"),
    "proximity_v2": (proximity_v2, _with() + f"select passage_id, round(coalesce(1 + 1.5 / (1 + sp / 4.0), 1.0), 6) as proximity from (select *, {_span(PAIR.ranking, 'body_t')} as sp from toks where {_matches(PAIR)})"),
    "passage_multiplier": (passage_multiplier, _with(_matched(EITHER), ALL, _signals(EITHER)) + "select passage_id, round(multiplier, 6) as multiplier from signals"),
    "document_coverage": (document_coverage, _with(_matched(EITHER), ALL, _signals(EITHER), _COVERAGE) + "select source_id, covered, round(case when covered = 2 then 1.8 else 1.0 + 0.25 * covered / 2 end, 6)::double as factor from coverage"),
    "passage_rollup": (passage_rollup, _with(_matched(PAIR), CANDIDATES, _roll("candidates", "rank")) + "select source_id, round(total, 6) as total, best_passage from rolled"),
    "top3_passages": (top3_passages, _with(_matched(EITHER)) + "select source_id, nth, passage_id from (select source_id, passage_id, row_number() over (partition by source_id order by rank desc, passage_id) as nth from matched) where nth <= 3"),
    "text_search": (text_search, _with(_matched(PAIR), CANDIDATES, _signals(PAIR), "scored as (select *, rank * multiplier as score from signals)", _roll("scored", "score"), _COVERAGE) + "select source_id, round(total * case when covered = 2 then 1.8 else 1.0 + 0.25 * covered / 2 end, 6) as score, best_passage from rolled join coverage using (source_id) order by total * case when covered = 2 then 1.8 else 1.0 + 0.25 * covered / 2 end desc, source_id limit 20"),
    "text_search_v2": (text_search_v2, _with(_v2(), _roll("reranked", "score"), path="path") + "select source_id, round(total, 6) as score, best_passage from rolled order by total desc, source_id limit 20"),
    "rerank_v2": (rerank_v2, _with(_v2(), path="path") + "select passage_id, round(score, 6) as score from reranked"),
    "match_nested": (match_nested, _with(_nested().split("\nselect ")[0], path="path") + "select " + _nested().split("\nselect ")[1]),
    "excerpt": (excerpt, C.WITH_PASSAGES + """select passage_id, case when length(body) <= 500 then body else case when st > 0 then '… ' else '' end || substring(body, st + 1, 500) || case when st + 500 < length(body) then ' …' else '' end end as excerpt
from (select *, greatest(0, coalesce(least(nullif(strpos(strip_accents(lower(body)), 'ering'), 0), nullif(strpos(strip_accents(lower(body)), 'onth'), 0)), 1) - 101) as st from passages)"""),
    "semantic_excerpt": (semantic_excerpt, C.WITH_PASSAGES + "select passage_id, case when length(b) > 420 then substring(b, 1, 417) || '…' else b end as excerpt from (select passage_id, trim(regexp_replace(body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as b from passages)"),
    "highlights": (highlights, """with t as (select doc_id, strip_accents(lower(text)) as x from documents),
w as (select doc_id, x, unnest(['ering', 'onth']) as w from t),
p as (select doc_id, w, string_split(x, w) as ps from w)
select doc_id, (list_sum(list_transform(ps[1:k], lambda q: length(q))) + (k - 1) * length(w))::bigint as location, length(w) as length
from (select *, unnest(range(1, len(ps))) as k from p)"""),
    "highlights_utf16": (highlights_utf16, """with t as (select doc_id, strip_accents(lower(regexp_replace(text, '^(\\S+)', '\\1 𝒳'))) as x from documents),
w as (select doc_id, x, unnest(['ering', 'onth']) as w from t),
p as (select doc_id, w, string_split(x, w) as ps from w)
select doc_id, (list_sum(list_transform(ps[1:k], lambda q: length(q))) + (k - 1) * length(w))::bigint as location, length(w) as length16,
  (list_sum(list_transform(ps[1:k], lambda q: length(q) + length(regexp_replace(q, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))) + (k - 1) * length(w))::bigint as location16
from (select *, unnest(range(1, len(ps))) as k from p)"""),
    "snippet": (snippet, C.WITH_PASSAGES + f"""select passage_id, case when st > 1 then ' … ' else '' end || array_to_string(ws[st:st + 35], ' ') || case when st + 35 < len(ws) then ' … ' else '' end as snippet
from (select *, greatest(1, greatest(1, list_position(list_transform(ws, lambda w: list_contains({_tokens_sql('w')}, 'ering')), true)) - 6) as st
from (select passage_id, regexp_extract_all(body, '\\S+') as ws, {_tokens_sql('body')} as t from passages) where list_contains(t, 'ering'))"""),
    "chunk_passages": (chunk_passages, C.WITH_PASSAGES + "select passage_id, ordinal, md5(body) as body_md5 from passages"),
    "chunk_counts": (chunk_counts, C.WITH_PASSAGES + "select source_id, count(*) as n_passages from passages group by 1"),
    "match_reason": (match_reason, _with() + "select passage_id, case when contains(lower(filename), 'doc_1') then 'Filename match' when list_contains(body_t, 'ering') then 'Text match' else 'Related content' end as reason from toks"),
}
