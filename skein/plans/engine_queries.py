"""Queries through the engine: its index of the documents, changes, merges, cursors, lanes and streams; each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skein.engine import Engine, SearchRequest
from skein.functions.text import extension, filename
from skein.sources.storage import shared_folder
from skein.streaming import changes as S

from . import corpus as C
from .lexical_queries import _COVERAGE, EITHER, _matched, _roll, _signals, _with  # noqa: PLC2701

EITHER_TEXT = "ering OR onth"
LETTERS = "aeioutns"


def letters(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: how often some letters occur, and one more number."""
    return [[*(float((t or "").count(c)) for c in LETTERS), 1.0] for t in texts]


def documents(s, d, where: str = "true"):
    """The documents, or some by their numbers, that hold any word, as files with their texts."""
    return C.files(s, d, text=True).filter(where).filter(F.col("text").rlike(r"\S")).drop("doc_id", "lang")


def _engine(s, d) -> Engine:
    """For text searches: without vectors."""

    def make():
        e = Engine(s, shared_folder(s, "engine"))
        e.index(documents(s, d))
        return e

    return C.kept(s, d, "engine", ("documents", "labels"), make)


def _lanes(s, d) -> Engine:
    """For semantic searches: passages and cards with their vectors, without words."""

    def make():
        e = Engine(s, shared_folder(s, "lanes"))
        e.index(documents(s, d), words=False)
        e.embed(letters, "letters")
        e.embed_cards(e.files().select("source_id", F.col("title").alias("text")), letters)  # as stored: texts aren't read again
        return e

    return C.kept(s, d, "lanes", ("documents", "labels"), make)


def engine_search(s, d):
    """Text search through the engine, with all that match among the candidates."""
    return _engine(s, d).search(SearchRequest(EITHER_TEXT, limit=200)).select("source_id", F.round("score", 6).alias("score"))


def engine_cursor(s, d):
    """Three pages of one list, each by the cursor after the one before."""
    e = _engine(s, d)
    pages = [e.search(SearchRequest(EITHER_TEXT, limit=60, cursor=e.cursor(60 * k, 180))).select(F.lit(k).alias("page"), "source_id", F.round("score", 6).alias("score")) for k in range(3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def engine_compact(s, d):
    """An index that grew by changes, whose segments were merged: the search of an index of what is left. Nothing is searched before, so words are made at the merge."""
    e = Engine(s, shared_folder(s, "engine"))
    part = lambda k: documents(s, d, k)
    gone = lambda k: C.table(s, d, "documents").filter(k).select(C.source_id().alias("source_id"))
    e.index(part("doc_id % 3 <> 0").withColumn("text", F.concat(F.lit("onth "), "text")), words=False)
    e.apply(part("doc_id % 3 = 0"), gone("doc_id % 15 = 1"))
    e.apply(part("doc_id % 3 <> 0 and doc_id % 15 <> 1"), gone("doc_id % 15 <> 1 and doc_id % 5 = 1"))
    e.apply(None, gone("doc_id % 5 = 1"))
    e.compact(words=True)
    return e.search(SearchRequest(EITHER_TEXT, limit=200)).select("source_id", F.round("score", 6).alias("score"))


def engine_lane(s, d):
    """Semantic search over passages and cards, every vector compared, both lanes fused by rank."""
    e = _lanes(s, d)
    hits = e.search(SearchRequest("station", "semantic", limit=20, exact=True), letters)
    return hits.select("source_id", F.round("score", 8).alias("score"))


def engine_follow(s, d):
    """The events as a stream of changes in three files, out of order, followed by an engine: each path's file is what its last event made of it."""
    base = shared_folder(s, "follow")
    rows = C.changes(s, d).select("path", "event_id", "kind", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(3):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").json(f"{base}/in")
    texts = C.table(s, d, "documents").select(F.concat(F.lit("/corpus/f"), F.col("doc_id").cast("string")).alias("path"), "text").filter("text is not null")

    def load(changed):
        own = changed.join(texts, "path", "left")
        return own.select(
            F.sha2("path", 256).alias("source_id"), F.lit("corpus").alias("root_id"), "path", filename(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"),
            F.lit(None).cast("timestamp_ntz").alias("modified_at"), F.col("event_id").alias("size"), F.lit("available").alias("availability"), F.coalesce("text", F.lit("none")).alias("text"),
        )

    e = Engine(s, f"{base}/index")
    S.follow(S.read(s, f"{base}/in", 1), e, load, f"{base}/checkpoint").awaitTermination()
    return e.files().select("path", F.col("size").alias("event_id"))


def _only(sql: str, where: str) -> str:
    """A query over some of the documents."""
    return re.sub(r"from documents( d\b)?", lambda m: f"from (select * from documents where {where}){m[1] or ' as documents'}", sql)


def _ranked(candidates: int) -> str:
    parts = (_matched(EITHER), f"candidates as (select * from matched order by rank desc, passage_id limit {candidates})", _signals(EITHER), "scored as (select *, rank * multiplier as score from signals)", _roll("scored", "score"), _COVERAGE)
    return _with(*parts, "ranked_sources as (select source_id, total * case when covered = 2 then 1.8 else 1.0 + 0.25 * covered / 2 end as score from rolled join coverage using (source_id))")


_SEARCH = _ranked(1600) + "select source_id, round(score, 6) as score from ranked_sources order by ranked_sources.score desc, source_id limit 200"
_PAGES = _ranked(1440) + "select ((row_number() over (order by score desc, source_id) - 1) // 60)::int as page, source_id, round(score, 6) as score from ranked_sources qualify row_number() over (order by ranked_sources.score desc, source_id) <= 180"


def _count(column: str) -> str:
    return "[" + ", ".join(f"(length({column}) - length(replace({column}, '{c}', '')))::double" for c in LETTERS) + ", 1.0]"


_QUERY = letters(["station"])[0]
_COSINE = f"list_dot_product(e, {_QUERY}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_QUERY}, {_QUERY})))"
_LANE = (
    C.with_(
        C.SQL_FILES, C.SQL_PASSAGES,
        f"near as (select source_id, passage_id, {_COSINE} as score from (select source_id, passage_id, {_count('body')} as e from passages) order by score desc, passage_id limit 500)",
        "best as (select n.source_id, max(score) as score from near n join files f using (source_id) where extension <> 'png' group by 1 order by 2 desc, 1 limit 20)",
        f"cards as (select source_id, {_COSINE} as score from (select source_id, {_count('title')} as e from files where regexp_matches(text, '\\S')) order by score desc, source_id limit 20)",
        "a as (select source_id, row_number() over (order by score desc, source_id) as pos from best)", "b as (select source_id, row_number() over (order by score desc, source_id) as pos from cards)",
        "fused as (select source_id, coalesce(0.5::double / (60 + a.pos), 0) + coalesce(0.5::double / (60 + b.pos), 0) as score from a full join b using (source_id))",
    )
    + "select source_id, round(score, 8) as score from fused order by fused.score desc, source_id limit 20"
)
QUERIES = {
    "engine_search": (engine_search, _SEARCH),
    "engine_cursor": (engine_cursor, _PAGES),
    "engine_compact": (engine_compact, _only(_SEARCH, "doc_id % 5 <> 1")),
    "engine_lane": (engine_lane, _LANE),
    "engine_follow": (engine_follow, C.WITH_CHANGES + "select path, event_id from (select path, max(event_id) as event_id, arg_max(kind, event_id) as kind from changes group by 1) where kind <> 'delete'"),
}
