"""Queries over vectors and their fusion with lexical hits; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import inverted as I
from skein.operators import lexical as L
from skein.operators import vectors as V
from skein.sources import journal as J
from skein.sources.storage import shared_folder

from . import corpus as C
from .lexical_queries import CANDIDATES, PAIR, _matched, _with
from .lexical_queries import _COVERAGE, _roll, _signals  # noqa: PLC2701

DIMS = 64


def probe(s, d, key: int = 0) -> list[float]:
    """The query's vector: one row of the table."""
    return [float(x) for x in C.vectors(s, d).filter(F.col("key") == key).first()["embedding"]]


SQL_V = "v as (select vec_id as key, embedding::double[] as e, label from embeddings), q as (select e as qe from v where key = 0)"
_COS = "coalesce(list_dot_product(e, qe) / nullif(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)), 0), 0)"


def cosine(s, d):
    return C.vectors(s, d).select("key", F.round(V.cosine(F.col("embedding"), V.literal(probe(s, d))), 6).alias("score"))


def vector_exact_topk(s, d):
    return V.exact_top(C.vectors(s, d), probe(s, d), 50).select("key", F.round("score", 6).alias("score"))


def vector_ann(s, d):
    """The ten nearest by the stored quantised index."""
    return C.stored_vectors(s, d).search(probe(s, d), 10).select("key", F.round("score", 6).alias("score"))


def _scored(s, d):
    return C.vectors(s, d).select("key", V.cosine(F.col("embedding"), V.literal(probe(s, d))).alias("score"))


def vector_merge(s, d):
    x = _scored(s, d)
    snapshot, delta = x.filter("key % 3 <> 0"), x.filter("key % 2 = 0").withColumn("score", F.col("score") + 0.01)
    return V.merge(snapshot, delta, x.filter("key % 5 <> 0").select("key"), 40).select("key", F.round("score", 6).alias("score"))


def tombstones(s, d):
    v = C.vectors(s, d).select("key", "label")
    return v.join(v.filter("key % 7 = 0").select("key"), "key", "left_anti")


def snapshot_active(s, d):
    k = C.vectors(s, d).select("key")
    return k.filter("key % 2 = 0").intersect(k.filter("key % 3 = 0"))


def snapshot_removed(s, d):
    k = C.vectors(s, d).select("key")
    return k.filter("key % 2 = 0").subtract(k.filter("key % 3 = 0"))


def rebuild_decision(s, d):
    x = C.vectors(s, d).agg(F.count_if(F.col("key") % 10 != 0).alias("snapshot"), F.count_if(F.col("key") % 10 == 0).alias("added"), F.count_if(F.col("key") % 100 == 1).alias("removed"))
    return x.withColumn("rebuild", V.rebuild_needed(F.col("snapshot"), F.col("added"), F.col("removed")))


def l2_normalize(s, d):
    x = C.vectors(s, d).select("key", F.posexplode(V.normalise(F.transform("embedding", lambda e: e * 3))).alias("i", "x"))
    return x.groupBy("key").agg(F.round(F.sum(F.col("x") * (F.col("i") + 1)), 4).alias("checksum"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("length"))


def int8_quantize(s, d):
    x = C.vectors(s, d).select("key", V.int8(F.transform("embedding", lambda e: F.round(e.cast("double"), 4))).alias("q"))
    return x.select("key", F.aggregate("q", F.lit(0), lambda a, b: a + b).cast("long").alias("total"), F.array_max("q").alias("largest"))


def similarity_matrix(s, d):
    """Every vector whose id is divisible by 100 beside every other one."""
    v = C.vectors(s, d).select("key", "embedding")
    return V.similarities(v.filter("key % 100 = 0"), v).filter("a <> b").select("a", "b", F.round("score", 6).alias("score"))


def embedding_input(s, d):
    title = F.regexp_replace(T.collapse(F.col("title")), "^$", "")
    t = F.concat(F.when(title != "", F.concat(F.lit("Document title: "), title, F.lit("\n\n"))).otherwise(""), F.lit("Document passage:\n"), T.collapse(F.col("body")))
    return C.stored_indexed(s, d).select("passage_id", F.md5(t).alias("input_md5"))


def embedding_query_input(s, d):
    t = F.concat(F.lit("Instruct: Find the passages that answer the query\nQuery: "), T.collapse(F.col("text")))
    return C.table(s, d, "benchmark").select("item_id", t.alias("input"))


def fnv1a_key(s, d):
    return C.files(s, d).select("source_id", T.fnv1a_key(F.col("source_id")).cast("string").alias("key"))


def rerank_softmax(s, d):
    x = C.table(s, d, "events").select("event_id", (F.col("value") / 10).alias("yes"), (F.col("user_id") % 7).cast("double").alias("no"))
    return x.select("event_id", F.round(V.softmax_yes(F.col("yes"), F.col("no")), 6).alias("score"))


def stale_vectors(s, d):
    return C.vectors(s, d).withColumn("format", (F.col("label") % 2).cast("int")).filter("format <> 1").select("key")


def _matches(s, d, k=500):
    top = V.exact_top(C.vectors(s, d), probe(s, d), k)
    return top.select((F.col("key") * 10000).alias("passage_id"), "score")


def _semantic(s, d, limit=20):
    return V.semantic_search(_matches(s, d), C.stored_indexed(s, d), F.col("extension").isin("txt", "md", "pdf", "png"), False, limit)


def semantic_search(s, d):
    return _semantic(s, d).select("source_id", "passage_id", F.round("score", 6).alias("score"))


SQL_SEM = f"""top as (select key, {_COS} as score from v, q order by score desc, key limit 500),
sem as (
  select source_id, passage_id, score from top join indexed on passage_id = key * 10000
  where extension in ('txt', 'md', 'pdf') and location_kind <> 'image' order by score desc, source_id limit 20)"""


def document_lane(s, d):
    """The document lane: one card a source, by label; the first passage stands for it."""
    lane = _scored(s, d).select(C.source_id("key").alias("source_id"), "score")
    first = L.Window.partitionBy("source_id").orderBy("ordinal", "passage_id")
    passages = C.stored_indexed(s, d).select("source_id", "passage_id", "ordinal")
    top = lane.join(passages.select("source_id"), "source_id", "left_semi").orderBy(F.desc("score"), "source_id").limit(30)
    p = passages.join(F.broadcast(top), "source_id")  # 30 rows
    p = p.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return p.orderBy(F.desc("score"), "source_id").limit(30).select("source_id", "passage_id", F.round("score", 6).alias("score"))


def lane_fusion(s, d):
    a = V.positions(_semantic(s, d))
    b = V.positions(_scored(s, d).select(C.source_id("key").alias("source_id"), "score").orderBy(F.desc("score"), "source_id").limit(20))
    return V.fuse(a, b, 0.5, 20).select("source_id", F.round("score", 8).alias("score"))


def hybrid_rrf(s, d):
    x = C.store(s, d)
    hits = I.search(x.index, PAIR)
    named = x.indexed.select(F.col("passage_id").alias("best_passage"), F.concat_ws("\n", F.lower("filename"), F.lower("body")).alias("seen")).join(F.broadcast(hits), "best_passage")  # at most 20 rows
    lexical = V.positions(named.select("source_id", "score", "seen"))
    exact = F.contains("seen", F.lit("onth"))
    return V.fuse(lexical, V.positions(_semantic(s, d)), 0.35, 20, exact).select("source_id", "exact", F.round("score", 8).alias("score"))


def snippet_merge(s, d):
    x = C.table(s, d, "documents").select("doc_id", F.slice(F.split("text", "\n"), 1, 2).alias("a"), F.slice(F.split("text", "\n"), 2, 3).alias("b"))
    return x.select("doc_id", F.md5(F.array_join(V.merge_snippets(F.col("a"), F.col("b")), "|")).alias("snippets_md5"))


def journal_replay(s, d):
    """A journal of the events, with lines that can't be read among them, and what is left of it."""
    e = C.table(s, d, "events").select((F.col("user_id") % 40).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tombstoned"), F.array(F.col("value").cast("float")).alias("embedding"))
    at = shared_folder(s, "journal")
    J.append(e, at)
    s.range(3).select(F.concat(F.lit('{"key": '), F.col("id").cast("string")).alias("value")).write.mode("append").text(at)
    return J.replay(s, at).select("key", "seq", "tombstoned")


_WV = C.with_(SQL_V)
_WS = C.with_(C.SQL_FILES, C.SQL_PASSAGES, C.SQL_INDEXED, SQL_V, SQL_SEM)
_LEX = (_matched(PAIR), CANDIDATES, _signals(PAIR), "scored as (select *, rank * multiplier as score from signals)", _roll("scored", "score"), _COVERAGE,
        "lex as (select *, row_number() over (order by score desc, source_id) as pos from (select source_id, total * case when covered = 2 then 1.8 else 1.0 + 0.25 * covered / 2 end as score, best_passage from rolled join coverage using (source_id) order by score desc, source_id limit 20))")
_SEMPOS = "sempos as (select *, row_number() over (order by score desc, source_id) as pos from sem)"
QUERIES = {
    "cosine": (cosine, _WV + f"select key, round({_COS}, 6) as score from v, q"),
    "vector_exact_topk": (vector_exact_topk, _WV + f"select key, round({_COS}, 6) as score from v, q order by {_COS} desc, key limit 50"),
    "vector_ann": (vector_ann, _WV + f"select key, round({_COS}, 6) as score from v, q order by {_COS} desc, key limit 10"),
    "vector_merge": (vector_merge, _WV + f"select key, round(max(score), 6) as score from (select key, {_COS} as score from v, q where key % 3 <> 0 union all select key, {_COS} + 0.01::double from v, q where key % 2 = 0) where key % 5 <> 0 group by key order by max(score) desc, key limit 40"),
    "tombstones": (tombstones, "select vec_id as key, label from embeddings where vec_id % 7 <> 0"),
    "snapshot_active": (snapshot_active, "select vec_id as key from embeddings where vec_id % 6 = 0"),
    "snapshot_removed": (snapshot_removed, "select vec_id as key from embeddings where vec_id % 2 = 0 and vec_id % 3 <> 0"),
    "rebuild_decision": (rebuild_decision, "select snapshot, added, removed, (added > 0 and (added >= 10000 or added >= snapshot * 0.05)) or (removed > 0 and (removed >= 10000 or removed >= snapshot * 0.05)) as rebuild from (select count(*) filter (vec_id % 10 <> 0) as snapshot, count(*) filter (vec_id % 10 = 0) as added, count(*) filter (vec_id % 100 = 1) as removed from embeddings)"),
    "l2_normalize": (l2_normalize, _WV + "select key, round(list_sum(list_transform(range(64), lambda i: n[i + 1] * (i + 1))), 4) as checksum, round(list_dot_product(n, n), 4) as length from (select key, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as n from v)"),
    "int8_quantize": (int8_quantize, _WV + "select key, list_sum(p)::bigint as total, list_max(p)::int as largest from (select key, list_transform(e, lambda x: greatest(-127, least(127, round(round(x, 4) * 127)::int))) as p from v)"),
    "similarity_matrix": (similarity_matrix, _WV + "select a.key as a, b.key as b, round(coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 0), 6) as score from v a join v b on a.key <> b.key where a.key % 100 = 0"),
    "embedding_input": (embedding_input, C.WITH_INDEXED + "select passage_id, md5(case when t <> '' then 'Document title: ' || t || chr(10) || chr(10) else '' end || 'Document passage:' || chr(10) || b) as input_md5 from (select passage_id, trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as t, trim(regexp_replace(body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as b from indexed)"),
    "embedding_query_input": (embedding_query_input, "select item_id, 'Instruct: Find the passages that answer the query' || chr(10) || 'Query: ' || trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as input from benchmark"),
    "fnv1a_key": (fnv1a_key, """with recursive h as (select source_id, 0 as i, 14695981039346656037::uhugeint as v from (select 'doc-' || lpad(doc_id::varchar, 8, '0') as source_id from documents)
union all select source_id, i + 1, ((xor(v, ascii(source_id[i + 1:i + 1])::uhugeint)) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint from h where i < length(source_id))
select source_id, (v | 9223372036854775808::uhugeint)::varchar as key from h where i = length(source_id)"""),
    "rerank_softmax": (rerank_softmax, "select event_id, round(1 / (1 + exp(n - y)), 6) as score from (select event_id, value / 10 as y, user_id % 7 as n from events)"),
    "stale_vectors": (stale_vectors, "select vec_id as key from embeddings where label % 2 <> 1"),
    "semantic_search": (semantic_search, _WS + "select source_id, passage_id, round(score, 6) as score from sem"),
    "document_lane": (document_lane, C.with_(C.SQL_FILES, C.SQL_PASSAGES, SQL_V) + f"select source_id, passage_id, round(score, 6) as score from (select 'doc-' || lpad(key::varchar, 8, '0') as source_id, {_COS} as score from v, q) join (select source_id, passage_id from passages where ordinal = 0) using (source_id) order by score desc, source_id limit 30"),
    "lane_fusion": (lane_fusion, C.with_(C.SQL_FILES, C.SQL_PASSAGES, C.SQL_INDEXED, SQL_V, SQL_SEM, _SEMPOS, f"lane as (select *, row_number() over (order by score desc, source_id) as pos from (select 'doc-' || lpad(key::varchar, 8, '0') as source_id, {_COS} as score from v, q order by score desc, source_id limit 20))") + "select source_id, round(coalesce(0.5 / (60 + a.pos), 0) + coalesce(0.5 / (60 + b.pos), 0), 8)::double as score from sempos a full join lane b using (source_id) order by coalesce(0.5 / (60 + a.pos), 0) + coalesce(0.5 / (60 + b.pos), 0) desc, source_id limit 20"),
    "hybrid_rrf": (hybrid_rrf, _with(*_LEX, SQL_V, SQL_SEM, _SEMPOS, "fused as (select coalesce(l.source_id, m.source_id) as source_id, coalesce(contains(lower(seen), 'onth'), false) as exact, coalesce(0.65::double / (60 + l.pos), 0) + coalesce(0.35::double / (60 + m.pos), 0) as score from (select lex.*, filename || chr(10) || body as seen from lex join indexed on passage_id = best_passage) l full join sempos m on l.source_id = m.source_id)") + "select source_id, exact, round(score, 8) as score from fused order by exact desc, fused.score desc, source_id limit 20"),
    "snippet_merge": (snippet_merge, "select doc_id, md5(array_to_string(list_concat(a, list_filter(b, lambda x: not list_contains(a, x)))[1:3], '|')) as snippets_md5 from (select doc_id, string_split(text, chr(10))[1:2] as a, string_split(text, chr(10))[2:4] as b from documents)"),
    "journal_replay": (journal_replay, "select user_id % 40 as key, max(event_id) as seq, arg_max(event_type = 'error', event_id) as tombstoned from events group by 1"),
}
