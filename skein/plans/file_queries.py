"""Queries over files: filters, joins, aggregates, order, sets; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import filters as X
from skein.operators import maintenance as M

from . import corpus as C

NOW = "2024-02-01 00:00:00"


def roots(s):
    return s.createDataFrame([(f"src{i}", f"/corpus/src{i}", f"Source {i}") for i in range(20)], "root_id string, path string, display_name string")


SQL_ROOTS = "roots as (select 'src' || i as root_id, '/corpus/src' || i as path, 'Source ' || i as display_name from range(20) t(i))"
NESTED = [("src1", "/corpus/src1"), ("src1-en", "/corpus/src1/en"), ("src2", "/corpus/src2"), ("all", "/corpus")]
SQL_NESTED = "nested(matched_root, root_path) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in NESTED) + ")"
WITH_ROOTS = C.with_(C.SQL_FILES, C.SQL_PASSAGES, SQL_ROOTS)


def _filter(f: X.Filters, sql: str):
    return (lambda s, d: C.files(s, d).filter(f.column()).select("source_id", "path")), C.WITH_FILES + f"select source_id, path from files where {sql}"


def source_identity(s, d):
    return C.files(s, d).select("source_id", F.sha2(F.concat_ws(":", "root_id", "path"), 256).alias("identity"))


def filter_v2(s, d):
    f = X.Filters(frozenset({"src1", "src2"}), frozenset({"/corpus/src1/en", "/corpus/src2"}), frozenset({"TXT", "md"}), "1970-01-01", "2024-01-20")
    return C.files(s, d).filter(f.column_v2()).select("source_id")


def filter_modified(s, d):
    return C.files(s, d).filter(X.Filters(after="2024-01-03 02:00:00", before="2024-01-09 05:00:00").column()).select("source_id", "modified_at")


def resolve_roots(s, d):
    """Each source of the documents, and one like it that isn't a root."""
    known = C.table(s, d, "documents").select(F.col("source").alias("root_id"))
    wanted = known.unionByName(known.select(F.concat("root_id", F.lit("-gone")).alias("root_id"))).distinct()
    return X.resolve_roots(wanted, roots(s)).select("root_id", "prefix")


_CASES = [
    ("/home/me/Documents/notes.txt", "/home/me"), ("/home/me/project/node_modules/a/readme.md", "/home/me"), ("/home/me/go/pkg/mod/x/doc.txt", "/home/me"),
    ("/home/me/Library/Application Support/a.txt", "/home/me"), ("/home/me/Library/CloudStorage/Drive/report.txt", "/home/me"), ("/home/me/go/pkg/mod/x/doc.txt", "/home/me/go/pkg/mod"),
    ("/home/me/src/main.swift", "/home/me"), ("/other/a.txt", "/home/me"), ("/home/me/Keychains/k.txt", "/home/me"), ("/home/me/vendor/bundle/b.md", "/home/me"),
    ("/home/me/a/VENV/b.md", "/home/me"), ("/home/me/venv.md", "/home/me"), ("/home/me/skip/x.txt", "/home/me"),
]


def policy_cases(s):
    return s.createDataFrame(_CASES, "path string, root string")


def exclusion_policy(s, d):
    extra = C.files(s, d).select(F.regexp_replace("path", "/de/", "/tmp/").alias("path"), F.lit("/corpus").alias("root"))
    both = policy_cases(s).unionByName(extra)
    p = X.Policy(home="/home/me", prefixes=("/home/me/skip",))
    return both.select("path", "root", p.excluded(F.col("path"), F.col("root")).alias("excluded"))


_FOLDERS_SQL = "[" + ", ".join(f"'{f.lower()}'" for f in X.FOLDERS + X.COMPONENTS) + "]"
_CODE_SQL = "[" + ", ".join(f"'{f}'" for f in X.SOURCE_CODE) + "]"
EXCLUSION_SQL = C.WITH_FILES + f"""select path, root, coalesce(not starts_with(path, root || '/') or list_has_any(fs, {_FOLDERS_SQL})
  or contains(j, '/go/pkg/mod/') or contains(j, '/vendor/bundle/') or path = '/home/me/skip' or starts_with(path, '/home/me/skip/')
  or list_contains({_CODE_SQL}, lower(regexp_extract(path, '\\.([^./]+)$', 1)))
  or (root = '/home/me' and coalesce(fs[1], '') = 'library' and not coalesce(list_contains(['cloudstorage', 'mobile documents'], fs[2]), false)), false) as excluded
from (select *, '/' || array_to_string(fs, '/') || '/' as j from (select path, root, string_split(lower(path[length(root) + 2:]), '/')[:-2] as fs from (
  select regexp_replace(path, '/de/', '/tmp/', 'g') as path, '/corpus' as root from files union all values {", ".join(f"('{a}', '{b}')" for a, b in _CASES)})))"""


def longest_root_match(s, d):
    nested = s.createDataFrame(NESTED, "root_id string, path string")
    return X.longest_root(C.files(s, d).select("source_id", "path"), nested).select("source_id", "matched_root")


def semantic_no_images(s, d):
    return C.stored_passages(s, d).filter("location_kind <> 'image'").select("passage_id")


def semantic_eligible(s, d):
    return C.stored_passages(s, d).select("passage_id", (F.length(F.trim("body")) > 0).alias("eligible"))


def _snapshot(s, d):
    f = C.files(s, d).withColumn("extraction_version", (F.col("doc_id") % 3).cast("int"))
    scan = C.files(s, d).withColumn("size", F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).filter("doc_id % 11 <> 0")
    return f.filter("doc_id % 7 <> 0"), scan.select("source_id", "doc_id", "path", "size", "modified_at", "extension")


def _recipes(s):
    return s.createDataFrame([("docx", 2), ("xlsx", 2), ("pdf", 1)], "extension string, version int")


def needs_extraction(s, d):
    f, scan = _snapshot(s, d)
    return M.needs_extraction(scan, f, _recipes(s)).select("source_id")


def outdated_extractions(s, d):
    f, _ = _snapshot(s, d)
    known = f.select("extension", "extraction_version", "root_id").join(F.broadcast(roots(s)), "root_id", "left_semi").select("extension", "extraction_version").distinct()
    return known.join(_recipes(s), "extension").filter("extraction_version < version").select("extension", "extraction_version", "version")


def date_presets(s, d):
    """What each preset means at the time of each event."""
    return C.table(s, d, "events").select("event_id", F.explode(X.date_presets(F.col("ts").cast("timestamp_ntz"))).alias("preset", "earliest"))


def type_group_counts(s, d):
    return C.files(s, d).groupBy(X.type_group(F.col("extension")).alias("type_group")).agg(F.count("*").alias("n"))


def folder_usage(s, d):
    return M.folder_usage(C.files(s, d), C.stored_passages(s, d), roots(s), 50)


def embedding_queue(s, d):
    return M.embedding_queue(C.stored_passages(s, d), C.files(s, d), "core", 40)


def _done(s, d):
    return C.files(s, d).filter("doc_id % 2 = 0").select("source_id")


def pending_documents(s, d):
    return M.pending_documents(C.files(s, d), C.stored_passages(s, d), _done(s, d)).select("source_id", "filename")


def document_card_input(s, d):
    return M.pending_documents(C.files(s, d), C.stored_passages(s, d), _done(s, d)).select("source_id", F.md5("text").alias("text_md5"))


def reconcile_deletions(s, d):
    f = C.files(s, d)
    return M.reconcile(f, f.filter("doc_id % 10 <> 3").select("source_id"), True, X.Policy().excluded(F.regexp_replace("path", "/fr/", "/Cache/"), F.lit("/corpus"))).select("source_id", "reason")


def cascade_delete(s, d):
    return M.cascade(C.files(s, d).filter("root_id = 'src3'").select("source_id"), C.files(s, d), C.stored_passages(s, d))[2]


def remove_root(s, d):
    return C.files(s, d).filter("root_id <> 'src3'").groupBy("root_id").agg(F.count("*").alias("n_files"))


def retry_candidates(s, d):
    return C.files(s, d).filter("availability = 'extractionFailed' or doc_id % 50 = 0").join(F.broadcast(roots(s).withColumnRenamed("path", "root_path")), "root_id").select("source_id", "path", "root_path")


def semantic_counts(s, d):
    return C.stored_passages(s, d).agg(F.count_if(F.length(F.trim("body")) > 0).alias("total"), F.count_if((F.length(F.trim("body")) > 0) & (F.coalesce("embedding_model", F.lit("")) == "core")).alias("embedded"))


def document_counts(s, d):
    p = C.stored_passages(s, d)
    return p.agg(F.countDistinct("source_id").alias("n_sources"), F.countDistinct(F.when(F.col("embedding_model") == "core", F.col("source_id"))).alias("n_embedded"))


def index_health(s, d):
    errors = s.createDataFrame([("src1", 2), ("src2", 3)], "root_id string, discovery_error_count long")
    f = C.files(s, d)
    return M.health(f, C.stored_passages(s, d), f.filter("doc_id % 4 = 0"), errors)


def index_issues(s, d):
    failed = F.when(F.col("doc_id") % 40 == 0, "extractionFailed").otherwise(F.col("availability"))
    return M.issues(C.files(s, d).withColumn("availability", failed), 25)


def scan_count(s, d):
    return C.files(s, d).groupBy("root_id").agg(F.count("*").alias("n"))


def disk_estimate(s, d):
    return M.disk_estimate(C.files(s, d), ["txt", "md", "pdf", "docx"])


def disk_reserve(s, d):
    return C.table(s, d, "documents").agg(F.sum("n_chars").alias("t")).select(M.disk_reserve(F.col("t")).alias("small"), M.disk_reserve(F.col("t") * 100_000).alias("large"))


def near_dup_groups(s, d):
    p = C.stored_passages(s, d).filter("ordinal = 0").select("source_id", F.col("body").alias("snippet"), "doc_id")
    f = C.files(s, d).select("source_id", F.regexp_replace("path", r"doc_\d+", "doc").alias("path"), "extension")
    hits = p.join(f, "source_id").withColumn("position", F.col("doc_id"))
    return M.near_duplicates(hits).select("source_id", "primary", "copy")


def ewma_rate(s, d):
    e = C.table(s, d, "events").select((F.col("user_id") % 10).alias("worker"), "event_id", "value")
    return M.recent_rates(e, "worker", "event_id", "value").select("worker", F.round("rate", 6).alias("rate"))


EWMA_SQL = """with recursive o as (select user_id % 10 as worker, value, row_number() over (partition by user_id % 10 order by event_id) as k from events),
r as (select worker, k, case when 0 = 0 then value end as rate from o where k = 1
  union all select o.worker, o.k, case when r.rate = 0 then o.value else r.rate * 0.75 + o.value * 0.25 end from r join o on o.worker = r.worker and o.k = r.k + 1)
select worker, round(arg_max(rate, k), 6) as rate from r group by worker"""


def changes_latest(s, d):
    return M.latest(C.changes(s, d), ["path"], [F.desc("event_id")]).select("path", "event_id", "kind")


def change_actions(s, d):
    x = M.change_actions(C.changes(s, d), F.col("kind") != "delete", F.endswith("path", F.lit("0")))
    return x.select("path", "event_id", "action")


def indexing_priority(s, d):
    f = C.files(s, d).withColumn("supported", F.col("extension").isin("txt", "md", "pdf", "docx"))
    return f.orderBy(F.desc("supported"), F.col("modified_at").desc_nulls_last(), "size", "path").limit(100).select("source_id", "supported")


def _saved(s, d):
    """Saved searches made of the benchmark's texts; some without a limit, some with one out of bounds."""
    limit = F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 5 * 100 - 50).cast("int"))
    name = F.when(F.col("item_id") % 2 == 0, F.translate(F.substring("text", 1, 12), "aeiou", "AEIOU")).otherwise(F.substring("text", 1, 12))
    return C.table(s, d, "benchmark").select(F.col("item_id").alias("id"), name.alias("name"), (F.col("item_id") % 4 == 1).alias("pinned"), F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"))).alias("request"))


SQL_SAVED = """with saved as (select item_id as id, case when item_id % 2 = 0 then translate(substring(text, 1, 12), 'aeiou', 'AEIOU') else substring(text, 1, 12) end as name, item_id % 4 = 1 as pinned,
  text as query, case when item_id % 3 > 0 then (item_id % 5 * 100 - 50)::int end as most from benchmark) """


def saved_searches(s, d):
    from pyspark.sql import Window

    return _saved(s, d).select("id", "name", F.row_number().over(Window.orderBy(F.desc("pinned"), F.lower("name"), "id")).cast("long").alias("place"))


def saved_search_json(s, d):
    r = F.from_json("request", "query string, limit int")
    return _saved(s, d).select("id", r["query"].alias("query"), F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(r["limit"], F.lit(20)))).alias("limit"))


def history_dedup(s, d):
    return M.coalesce_history(C.history(s, d)).select("id", "query", "searched_at")


def history_migrate(s, d):
    return M.latest(C.history(s, d), ["normalized_query"], [F.desc("searched_at"), F.desc("id")]).select("id", "normalized_query")


def normalize_query(s, d):
    return C.table(s, d, "benchmark").select("item_id", M.normalise_query(F.col("text")).alias("normalized"))


def purge_excluded(s, d):
    return M.purge(C.files(s, d), X.Policy().excluded(F.regexp_replace("path", "/es/", "/node_modules/"), F.lit("/corpus"))).select("source_id")


def keyset_page(s, d):
    return C.files(s, d).filter("source_id > 'doc-00000100'").orderBy("source_id").limit(250).select("source_id", "path")


def cursor_page(s, d):
    return C.files(s, d).orderBy(F.desc("size"), "source_id").offset(40).limit(20).select("source_id", "size")


def excluded_paths_union(s, d):
    f = C.files(s, d)
    return f.filter("doc_id % 3 = 0").select("path").union(f.filter("doc_id % 5 = 0").select("path")).distinct()


def path_parts(s, d):
    p = F.col("path")
    return C.files(s, d).select("source_id", T.filename(p).alias("filename"), T.extension(p).alias("extension"), T.stem(p).alias("stem"), T.parent(p).alias("parent"))


def canonical_path(s, d):
    f = C.files(s, d).select("source_id", F.concat(F.lit("/private/var/"), F.regexp_replace("path", "/doc_", "//./doc_"), F.lit("/")).alias("raw"))
    return f.select("source_id", T.canonical_path(F.col("raw")).alias("path"))


def merge_upsert(s, d):
    f = C.files(s, d).select("source_id", "size")
    return M.upsert(f.filter("size % 3 <> 0"), f.filter("size % 2 = 0").withColumn("size", F.col("size") + 1), ["source_id"])


def upsert_files(s, d):
    p = C.stored_passages(s, d).select("source_id", "passage_id")
    new = p.filter("passage_id % 2 = 0").withColumn("passage_id", F.col("passage_id") + 1_000_000_000)
    return M.upsert(p, new, ["source_id"])


def _event_state(s, d):
    """Of each root, what was known up to the middle of the events, and what came after."""
    e = C.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("root_id"))
    half = e.agg(F.max("event_id")).first()[0] // 2
    state = lambda rows: rows.groupBy("root_id").agg(F.max("event_id").alias("last_event_id"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_reconciled_at"))
    return state(e.filter((F.col("event_id") <= half) & (F.col("root_id") != "r3"))), state(e.filter((F.col("event_id") > half) & (F.col("root_id") != "r7")))


def event_state_merge(s, d):
    return M.merge_event_state(*_event_state(s, d))


EVENT_SQL = """with e as (select event_id, ts, event_type, 'r' || (user_id % 12) as root_id, event_id <= (select max(event_id) // 2 from events) as early from events),
o as (select root_id, max(event_id) as e, max(ts) filter (event_type = 'error') as t from e where early and root_id <> 'r3' group by 1),
n as (select root_id, max(event_id) as e, max(ts) filter (event_type = 'error') as t from e where not early and root_id <> 'r7' group by 1)
select root_id, greatest(o.e, n.e) as last_event_id, coalesce(n.t, o.t)::timestamp as last_reconciled_at from o full join n using (root_id)"""


def _log(s, d):
    return C.changes(s, d).filter("kind <> 'recover'").select(F.col("path").alias("source_id"), F.col("event_id").alias("generation"), F.col("kind").alias("operation"))


def oplog_replay(s, d):
    return M.replay(_log(s, d), 400, 10**9).select("source_id", "generation", "operation")


def lexical_sync(s, d):
    p = C.stored_passages(s, d).select("source_id", "passage_id")
    ops = C.files(s, d).filter("doc_id % 4 = 0").select("source_id", F.when(F.col("doc_id") % 8 == 0, "delete").otherwise("upsert").alias("operation"))
    return M.sync_index(p.filter("passage_id % 3 <> 0"), ops, p)


def mark_embedded(s, d):
    p = C.stored_passages(s, d)
    done = p.filter("passage_id % 5 = 0").select("passage_id")
    return p.join(done.withColumn("now_done", F.lit(True)), "passage_id", "left").select("passage_id", F.when(F.col("now_done"), "core").otherwise(F.col("embedding_model")).alias("embedding_model"))


def preferences(s, d):
    """Preferences as JSON, one for each document: some are empty, some leave one out, paths aren't tidy."""
    folders = F.array(F.concat(F.lit("/"), "source", F.lit("//"), "lang", F.lit("/")), F.concat(F.lit("/private/tmp/./"), "lang"))
    value = F.when(F.col("doc_id") % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit(False)).alias("excludeSourceCode"), folders.alias("excludedFolderPaths"))))
    p = F.from_json(value, "excludeSourceCode boolean, excludedFolderPaths array<string>")
    return C.table(s, d, "documents").select("doc_id", F.coalesce(p["excludeSourceCode"], F.lit(True)).alias("exclude_source_code"), F.coalesce(F.array_join(F.transform(p["excludedFolderPaths"], T.canonical_path), ","), F.lit("")).alias("folders"))


def stable_reads(s, d):
    f = C.files(s, d).select("source_id", "size", "modified_at", "doc_id")
    after = f.filter("doc_id % 9 <> 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return M.stable_reads(f, after).select("source_id", "stable")


def reconcile_due(s, d):
    return C.files(s, d).select("source_id", M.reconcile_due(F.col("modified_at"), F.lit("2024-01-05 07:30:00").cast("timestamp_ntz")).alias("due"))


def progress(s, d):
    e = C.table(s, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("root")).agg(F.count("*").alias("discovered"), F.count_if(F.col("event_type") != "error").alias("done")).withColumn("fraction", F.col("done") / F.col("discovered"))


_CUT = f"timestamp '{NOW}'"
QUERIES = {
    "source_identity": (source_identity, C.WITH_FILES + "select source_id, sha256(root_id || ':' || path) as identity from files"),
    "filter_extension": _filter(X.Filters(extensions=frozenset({"TXT", "md"})), "lower(extension) in ('txt', 'md')"),
    "filter_root": _filter(X.Filters(root_ids=frozenset({"src1", "src7"})), "root_id in ('src1', 'src7')"),
    "filter_path_prefix": _filter(X.Filters(path_prefixes=frozenset({"/corpus/src1"})), "starts_with(path, '/corpus/src1/')"),
    "filter_location_or": _filter(X.Filters(root_ids=frozenset({"src1"}), path_prefixes=frozenset({"/corpus/src2/en"})), "root_id = 'src1' or starts_with(path, '/corpus/src2/en/')"),
    "filter_v2": (filter_v2, C.WITH_FILES + "select source_id from files where root_id in ('src1', 'src2') and (starts_with(path, '/corpus/src1/en/') or starts_with(path, '/corpus/src2/')) and extension in ('txt', 'md') and coalesce(modified_at, timestamp '1970-01-01') between timestamp '1970-01-01' and timestamp '2024-01-20'"),
    "filter_modified": (filter_modified, C.WITH_FILES + "select source_id, modified_at from files where modified_at between timestamp '2024-01-03 02:00:00' and timestamp '2024-01-09 05:00:00'"),
    "resolve_roots": (resolve_roots, "with " + SQL_ROOTS + ", w as (select distinct source as root_id from documents union select distinct source || '-gone' from documents) select root_id, path as prefix from w left join roots using (root_id)"),
    "exclusion_policy": (exclusion_policy, EXCLUSION_SQL),
    "longest_root_match": (longest_root_match, C.with_(C.SQL_FILES, SQL_NESTED) + "select source_id, arg_max(matched_root, length(root_path)) as matched_root from files join nested on starts_with(path, root_path || '/') group by source_id"),
    "semantic_no_images": (semantic_no_images, C.WITH_PASSAGES + "select passage_id from passages where location_kind <> 'image'"),
    "semantic_eligible": (semantic_eligible, C.WITH_PASSAGES + "select passage_id, length(trim(body)) > 0 as eligible from passages"),
    "needs_extraction": (needs_extraction, C.WITH_FILES + """select n.source_id from files n left join (select * from files where doc_id % 7 <> 0) o using (source_id)
left join (values ('docx', 2), ('xlsx', 2), ('pdf', 1)) r(extension, version) on r.extension = n.extension
where n.doc_id % 11 <> 0 and (o.path is null or n.doc_id % 5 = 0 or o.doc_id % 3 < coalesce(version, 0))"""),
    "outdated_extractions": (outdated_extractions, C.WITH_FILES + """select distinct f.extension, (doc_id % 3)::int as extraction_version, version from files f
join (values ('docx', 2), ('xlsx', 2), ('pdf', 1)) r(extension, version) on r.extension = f.extension where doc_id % 7 <> 0 and doc_id % 3 < version"""),
    "date_presets": (date_presets, "select event_id, preset, (case preset when 'day' then ts - interval 1 day when 'week' then ts - interval 7 days when 'month' then ts - interval 1 month else ts - interval 1 year end)::timestamp as earliest from events, (select unnest(['day', 'week', 'month', 'year']) as preset)"),
    "type_group_counts": (type_group_counts, C.WITH_FILES + "select case extension when 'pdf' then 'PDF' when 'docx' then 'DOC / DOCX' when 'xlsx' then 'XLS / XLSX' when 'md' then 'MD' when 'txt' then 'TXT' when 'png' then 'PNG' else 'other' end as type_group, count(*) as n from files group by 1"),
    "folder_usage": (folder_usage, WITH_ROOTS + """select root_id, r.path || '/' || lang as folder, lang as name, count(*) as n_files, sum(coalesce(n, 0))::bigint as n_passages, sum(coalesce(b, 0))::bigint as text_bytes
from files f left join (select source_id, count(*) as n, sum(strlen(body)) as b from passages group by 1) using (source_id) join roots r using (root_id) group by 1, 2, 3 order by text_bytes desc, n_files desc, folder limit 50"""),
    "embedding_queue": (embedding_queue, C.WITH_PASSAGES + """select passage_id, source_id, filename from (
  select p.*, f.filename, f.extension, f.modified_at, row_number() over (partition by p.source_id order by ordinal, passage_id) as k from passages p join files f using (source_id)
  where length(trim(body)) > 0 and coalesce(embedding_model, '') <> 'core') left join (select source_id, count(*) as e from passages where embedding_model = 'core' group by 1) using (source_id)
where k = 1 order by (extension in ('csv', 'xlsx'))::int, coalesce(e, 0), coalesce(modified_at, timestamp '1970-01-01') desc, passage_id limit 40"""),
    "pending_documents": (pending_documents, C.WITH_PASSAGES + "select source_id, filename from files where doc_id % 2 <> 0 and source_id in (select source_id from passages where length(trim(body)) > 0)"),
    "document_card_input": (document_card_input, C.WITH_PASSAGES + "select source_id, md5(substring(string_agg(body, chr(10) order by ordinal), 1, 18000)) as text_md5 from passages where doc_id % 2 <> 0 and length(trim(body)) > 0 group by 1"),
    "reconcile_deletions": (reconcile_deletions, C.WITH_FILES + "select source_id, case when lang = 'fr' then 'excluded' else 'missing' end as reason from files where lang = 'fr' or doc_id % 10 = 3"),
    "cascade_delete": (cascade_delete, C.WITH_PASSAGES + "select 'document' as lane, source_id as key from files where root_id = 'src3' union all select 'passage', passage_id::varchar from passages join files using (source_id) where root_id = 'src3'"),
    "remove_root": (remove_root, "select source as root_id, count(*) as n_files from documents where source <> 'src3' group by 1"),
    "retry_candidates": (retry_candidates, C.with_(C.SQL_FILES, SQL_ROOTS) + "select source_id, f.path, r.path as root_path from files f join roots r using (root_id) where availability = 'extractionFailed' or doc_id % 50 = 0"),
    "semantic_counts": (semantic_counts, C.WITH_PASSAGES + "select count(*) filter (length(trim(body)) > 0) as total, count(*) filter (length(trim(body)) > 0 and embedding_model = 'core') as embedded from passages"),
    "document_counts": (document_counts, C.WITH_PASSAGES + "select count(distinct source_id) as n_sources, count(distinct case when embedding_model = 'core' then source_id end) as n_embedded from passages"),
    "index_health": (index_health, C.WITH_PASSAGES + "select count(*) as n_files, count(*) filter (availability = 'extractionFailed') as n_failed, count(*) filter (availability = 'filenameOnly') as n_filename_only, (select count(*) from passages) as n_passages, (count(*) filter (doc_id % 4 = 0) * 420)::bigint as working_bytes, 5::bigint as n_errors from files"),
    "index_issues": (index_issues, C.WITH_FILES + "select source_id, root_id, path, 'Text extraction failed' as message from files where doc_id % 40 = 0 or availability = 'extractionFailed' order by lower(filename), lower(path), source_id limit 25"),
    "scan_count": (scan_count, "select source as root_id, count(*) as n from documents group by 1"),
    "disk_estimate": (disk_estimate, C.WITH_FILES + "select n_files, content_bytes, index_bytes, index_bytes * 2 as rebuild_bytes from (select *, (n_files * 700 + floor(content_bytes * 0.35::double))::bigint as index_bytes from (select count(*) as n_files, sum(case when extension in ('txt', 'md', 'pdf', 'docx') then least(size, 104857600) else 0 end)::bigint as content_bytes from files))"),
    "disk_reserve": (disk_reserve, "select greatest(5000000000, floor(t / 20))::bigint as small, greatest(5000000000, floor(t * 100000 / 20))::bigint as large from (select sum(n_chars)::bigint as t from documents)"),
    "near_dup_groups": (near_dup_groups, C.WITH_PASSAGES + """, sig as (select p.source_id, p.doc_id, case when length(array_to_string(t, '')) >= 48 then 'doc|' || extension || '|' || array_to_string(t[1:32], ' ') else regexp_replace(path, 'doc_\\d+', 'doc') end as g
from (select *, regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}]+') as t from passages where ordinal = 0) p join files f using (source_id))
select source_id, first_value(source_id) over (partition by g order by doc_id) as primary, row_number() over (partition by g order by doc_id) - 1 as copy from sig"""),
    "ewma_rate": (ewma_rate, EWMA_SQL),
    "changes_latest": (changes_latest, C.WITH_CHANGES + "select path, max(event_id) as event_id, arg_max(kind, event_id) as kind from changes group by 1"),
    "change_actions": (change_actions, C.WITH_CHANGES + "select path, event_id, case when kind = 'recover' or path like '%0' then 'reconcile' when kind = 'delete' then 'delete' else 'upsert' end as action from (select path, max(event_id) as event_id, arg_max(kind, event_id) as kind from changes group by 1)"),
    "indexing_priority": (indexing_priority, C.WITH_FILES + "select source_id, extension in ('txt', 'md', 'pdf', 'docx') as supported from files order by supported desc, modified_at desc nulls last, size, path limit 100"),
    "saved_searches": (saved_searches, SQL_SAVED + "select id, name, row_number() over (order by pinned desc, lower(name), id) as place from saved"),
    "saved_search_json": (saved_search_json, SQL_SAVED + "select id, query, greatest(1, least(200, coalesce(most, 20)))::int as \"limit\" from saved"),
    "history_dedup": (history_dedup, C.WITH_HISTORY + """select id, query, searched_at from (select *, lead(normalized_query) over w as nq, lead(searched_at) over w as nt, row_number() over (partition by normalized_query order by searched_at desc, id desc) as k from history window w as (order by searched_at, id))
where k = 1 and not coalesce(nq <> normalized_query and nt - searched_at < interval 2 seconds, false)"""),
    "history_migrate": (history_migrate, C.WITH_HISTORY + "select id, normalized_query from history qualify row_number() over (partition by normalized_query order by searched_at desc, id desc) = 1"),
    "normalize_query": (normalize_query, "select item_id, trim(regexp_replace(strip_accents(lower(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as normalized from benchmark"),
    "purge_excluded": (purge_excluded, C.WITH_FILES + "select source_id from files where lang <> 'es'"),
    "keyset_page": (keyset_page, C.WITH_FILES + "select source_id, path from files where source_id > 'doc-00000100' order by source_id limit 250"),
    "cursor_page": (cursor_page, C.WITH_FILES + "select source_id, size from files order by size desc, source_id limit 20 offset 40"),
    "excluded_paths_union": (excluded_paths_union, C.WITH_FILES + "select distinct path from files where doc_id % 3 = 0 or doc_id % 5 = 0"),
    "path_parts": (path_parts, C.WITH_FILES + "select source_id, filename, extension, 'doc_' || doc_id as stem, '/corpus/' || root_id || '/' || lang as parent from files"),
    "canonical_path": (canonical_path, C.WITH_FILES + "select source_id, '/var' || path as path from files"),
    "merge_upsert": (merge_upsert, C.WITH_FILES + "select source_id, size + case when size % 2 = 0 then 1 else 0 end as size from files where size % 3 <> 0 or size % 2 = 0"),
    "upsert_files": (upsert_files, C.WITH_PASSAGES + "select source_id, passage_id from passages where source_id not in (select source_id from passages where passage_id % 2 = 0) union all select source_id, passage_id + 1000000000 from passages where passage_id % 2 = 0"),
    "event_state_merge": (event_state_merge, EVENT_SQL),
    "oplog_replay": (oplog_replay, C.WITH_CHANGES + "select path as source_id, max(event_id) as generation, arg_max(kind, event_id) as operation from changes where kind <> 'recover' group by 1 having max(event_id) > 400"),
    "lexical_sync": (lexical_sync, C.WITH_PASSAGES + "select source_id, passage_id from passages where (doc_id % 4 <> 0 and passage_id % 3 <> 0) or doc_id % 8 = 4"),
    "mark_embedded": (mark_embedded, C.WITH_PASSAGES + "select passage_id, case when passage_id % 5 = 0 then 'core' else embedding_model end as embedding_model from passages"),
    "preferences": (preferences, "select doc_id, case when doc_id % 3 > 0 and doc_id % 2 = 0 then false else true end as exclude_source_code, case when doc_id % 3 > 0 then '/' || source || '/' || lang || ',/tmp/' || lang else '' end as folders from documents"),
    "stable_reads": (stable_reads, C.WITH_FILES + "select source_id, doc_id % 9 <> 0 and doc_id % 6 <> 0 as stable from files"),
    "reconcile_due": (reconcile_due, C.WITH_FILES + "select source_id, modified_at is null or epoch(timestamp '2024-01-05 07:30:00') - epoch(modified_at) >= 86400 as due from files"),
    "progress": (progress, "select user_id % 10 as root, count(*) as discovered, count(*) filter (event_type <> 'error') as done, count(*) filter (event_type <> 'error') / count(*) as fraction from events group by 1"),
}
