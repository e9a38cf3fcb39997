"""The corpus behind the queries: files, passages, vectors, changes and history from the driver's tables.

`SQL` has the same tables as common table expressions for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.chunking import chunk_rows
from skein.functions.text import first_words, parent
from skein.operators import inverted, quantised
from skein.sources.storage import shared_folder

# File types by document number.
EXTENSIONS = ["txt", "md", "pdf", "docx", "csv", "xlsx", "html", "png"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_id(doc_id: str = "doc_id"):
    return F.concat(F.lit("doc-"), F.lpad(F.col(doc_id).cast("string"), 8, "0"))


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    out = docs.join(labels, "doc_id", "left").select(
        source_id().alias("source_id"), "doc_id", F.col("source").alias("root_id"), ext.alias("extension"), "lang",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        first_words(F.col("text"), 6).alias("title"),
        F.when(F.col("doc_id") % 97 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("modified_at"),
        F.col("n_chars").alias("size"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "extractionFailed").otherwise("available").alias("availability"),
        "text",
    )
    return out if text else out.drop("text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_rows(docs, "doc_id", "text").select(
        (F.col("doc_id") * 10000 + F.col("ordinal")).alias("passage_id"), source_id().alias("source_id"), "doc_id", "ordinal", "body",
        F.when(F.col("doc_id") % 8 == 7, "image").otherwise("section").alias("location_kind"),
        F.when((F.col("doc_id") * 10000 + F.col("ordinal")) % 3 == 0, "core").alias("embedding_model"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with their files' names and dates."""
    f = files(spark, sf_dir).select("source_id", "root_id", "path", "filename", "title", "extension", "modified_at", "availability", parent(F.col("path")).alias("folder"))
    return passages(spark, sf_dir).join(f, "source_id")


@dataclass(frozen=True)
class Store:
    """The corpus indexed once: passages with their files' names as a table, and the inverted index over them."""

    indexed: DataFrame
    index: inverted.Index


_kept: dict[tuple, object] = {}


def tables_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """The files of some tables with their sizes and times: what was made of them is good as long as this stays."""
    out = []
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = system.listStatus(at) if system.exists(at) else []
        out += [(name, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in status]
    return tuple(out)


def kept(spark: SparkSession, sf_dir: str, what: str, names: tuple[str, ...], make):
    """What `make` gives, made once for a session and a state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, what, tables_state(spark, sf_dir, *names))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def build_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut the texts of the tables in a folder, and store the passages by their numbers."""
    at = shared_folder(spark, "passages")
    indexed(spark, sf_dir).repartitionByRange("passage_id").sortWithinPartitions("passage_id").write.parquet(at)
    return spark.read.parquet(at)


def stored_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored passages with their files' names and dates; no index of their words is made for them."""
    return kept(spark, sf_dir, "passages", ("documents", "labels"), lambda: build_indexed(spark, sf_dir))


def build_store(spark: SparkSession, sf_dir: str) -> Store:
    """Index the tables in a folder."""
    rows, at = stored_indexed(spark, sf_dir), shared_folder(spark, "store")
    inverted.write(rows, at)
    return Store(rows, inverted.Index.read(spark, at))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The stored index of the tables in a folder; built at the first search, kept for the session's later ones."""
    return kept(spark, sf_dir, "store", ("documents", "labels"), lambda: build_store(spark, sf_dir))


def build_vectors(spark: SparkSession, sf_dir: str) -> quantised.Index:
    """Index the vectors of a folder's tables."""
    at = shared_folder(spark, "vectors")
    quantised.write(vectors(spark, sf_dir), at)
    return quantised.Index(spark, at)


def stored_vectors(spark: SparkSession, sf_dir: str) -> quantised.Index:
    return kept(spark, sf_dir, "vectors", ("embeddings",), lambda: build_vectors(spark, sf_dir))


def stored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages as they are stored; `passages` cuts the texts anew."""
    return stored_indexed(spark, sf_dir).select("passage_id", "source_id", "doc_id", "ordinal", "body", "location_kind", "embedding_model")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "recover").when(F.col("event_type") == "signup", "delete").otherwise("upsert")
    return e.select("event_id", F.concat(F.lit("/corpus/f"), (F.col("user_id") % 50).cast("string")).alias("path"), kind.alias("kind"), "ts")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    query = F.concat(F.col("event_type"), F.lit(" "), (F.col("user_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("id"), query.alias("query"), F.lower(query).alias("normalized_query"), F.col("ts").alias("searched_at"))


SQL_FILES = """files as (
  select 'doc-' || lpad(d.doc_id::varchar, 8, '0') as source_id, d.doc_id, d.source as root_id,
    ['txt','md','pdf','docx','csv','xlsx','html','png'][d.doc_id % 8 + 1] as extension, d.lang,
    '/corpus/' || d.source || '/' || d.lang || '/doc_' || d.doc_id || '.' || ['txt','md','pdf','docx','csv','xlsx','html','png'][d.doc_id % 8 + 1] as path,
    'doc_' || d.doc_id || '.' || ['txt','md','pdf','docx','csv','xlsx','html','png'][d.doc_id % 8 + 1] as filename,
    array_to_string(regexp_extract_all(d.text, '\\S+')[1:6], ' ') as title,
    case when d.doc_id % 97 <> 0 then timestamp '2024-01-01' + to_hours(d.doc_id::int) end as modified_at,
    d.n_chars as size,
    case when l.quality = 0 and l.toxic = 1 then 'extractionFailed' else 'available' end as availability, d.text
  from documents d left join labels l on l.doc_id = d.doc_id)"""

SQL_PASSAGES = """split_lines as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_extract_all(p, '\\S+')), lambda a: len(a) > 0) as ps from documents),
fold as (
  select doc_id, ps, 0 as i, []::varchar[] as w, []::varchar[][] as chunks from split_lines
  union all
  select doc_id, ps, i + 1,
    case when n < 384 then w1 when (n - 384) % 320 = 0 then [] else w1[m * 320 + 1:] end,
    list_concat(chunks, flushed, list_transform(range(m), lambda k: w1[k * 320 + 1:k * 320 + 384]))
  from (select *, len(w1) as n, case when len(w1) >= 384 then (len(w1) - 384) // 320 + 1 else 0 end as m from (
    select doc_id, ps, i, chunks,
      case when len(w) > 0 and len(w) + len(ps[i + 1]) > 384 then ps[i + 1] else list_concat(w, ps[i + 1]) end as w1,
      case when len(w) > 0 and len(w) + len(ps[i + 1]) > 384 then [w] else []::varchar[][] end as flushed
    from fold where i < len(ps)))),
chunked as (
  select doc_id, case when len(w) > 0 then list_concat(chunks, [w]) else chunks end as cs from fold where i = len(ps)),
passages as (
  select doc_id * 10000 + o as passage_id, 'doc-' || lpad(doc_id::varchar, 8, '0') as source_id, doc_id, o::int as ordinal, array_to_string(c, ' ') as body,
    case when doc_id % 8 = 7 then 'image' else 'section' end as location_kind,
    case when (doc_id * 10000 + o) % 3 = 0 then 'core' end as embedding_model
  from (select doc_id, unnest(cs) as c, unnest(range(len(cs))) as o from chunked))"""

SQL_INDEXED = """indexed as (
  select p.*, f.root_id, f.path, f.filename, f.title, f.extension, f.modified_at, f.availability, regexp_replace(f.path, '/[^/]*$', '') as folder
  from passages p join files f using (source_id))"""

SQL_CHANGES = """changes as (
  select event_id, '/corpus/f' || (user_id % 50) as path,
    case when event_type = 'error' then 'recover' when event_type = 'signup' then 'delete' else 'upsert' end as kind, ts from events)"""

SQL_HISTORY = """history as (
  select event_id as id, event_type || ' ' || (user_id % 7) as query, lower(event_type || ' ' || (user_id % 7)) as normalized_query, ts as searched_at from events)"""


def with_(*parts: str) -> str:
    """The common table expressions for a query."""
    return "with recursive " + ",\n".join(parts) + "\n"


WITH_FILES = with_(SQL_FILES)
WITH_PASSAGES = with_(SQL_FILES, SQL_PASSAGES)
WITH_INDEXED = with_(SQL_FILES, SQL_PASSAGES, SQL_INDEXED)
WITH_CHANGES = with_(SQL_CHANGES)
WITH_HISTORY = with_(SQL_HISTORY)
