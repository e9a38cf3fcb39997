"""Upkeep of the index as set operations: upserts, deletions, logs, queues, history, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import collapse, fold, fold_width

# Fixed values.
LOW_PRIORITY = ["csv", "tsv", "xls", "xlsx", "xlsm", "xlsb", "xlt", "xltx", "xltm", "ods", "numbers"]
STAGED_BYTES, FILE_BYTES, TEXT_SHARE, LARGEST = 420, 700, 0.35, 100 * 1024 * 1024
HISTORY_SECONDS, RECONCILE_SECONDS = 2, 86_400
RESERVE = 5_000_000_000
COPY_NAMES, COPY_WORDS, COPY_LETTERS = (" copy", " backup"), 32, 48
CARD_CHARACTERS = 18_000
FADED = 2_600  # 0.75 ** 2600 is below the smallest double


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_event_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The greatest event id of both, and the newer known time of reconciliation."""
    s = seen.select("root_id", F.col("last_event_id").alias("_e"), F.col("last_reconciled_at").alias("_r"))
    return state.join(s, "root_id", "full_outer").select("root_id", F.greatest("last_event_id", "_e").alias("last_event_id"), F.coalesce("_r", "last_reconciled_at").alias("last_reconciled_at"))


def reconcile(files: DataFrame, scanned: DataFrame, complete: bool, excluded: Column) -> DataFrame:
    """Files to remove: excluded ones always, missing ones only if the scan reached everything."""
    gone = files.join(scanned.select("source_id"), "source_id", "left_anti").withColumn("reason", F.when(excluded, "excluded").otherwise("missing"))
    out = gone if complete else gone.filter("reason = 'excluded'")
    here = files.join(scanned.select("source_id"), "source_id", "left_semi").filter(excluded).withColumn("reason", F.lit("excluded"))
    return out.unionByName(here)


def cascade(removed: DataFrame, files: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files and passages that stay, and the keys of vectors to drop in both lanes."""
    gone = passages.join(removed.select("source_id"), "source_id", "left_semi")
    keys = gone.select(F.lit("passage").alias("lane"), F.col("passage_id").cast("string").alias("key")).unionByName(removed.select(F.lit("document").alias("lane"), F.col("source_id").alias("key")))
    return files.join(removed, "source_id", "left_anti"), passages.join(removed, "source_id", "left_anti"), keys


def replay(log: DataFrame, committed: int, current: int) -> DataFrame:
    """Operations newer than what the derived index has, the latest of each source; everything if the index is ahead or new."""
    newest = latest(log, ["source_id"], [F.desc("generation")])
    return newest if committed < 0 or committed > current else newest.filter(F.col("generation") > committed)


def sync_index(index: DataFrame, operations: DataFrame, passages: DataFrame) -> DataFrame:
    """The derived index after operations: rows of touched sources go, upserted ones come back from the passages."""
    kept = index.join(operations.select("source_id"), "source_id", "left_anti")
    return kept.unionByName(passages.join(operations.filter("operation = 'upsert'").select("source_id"), "source_id", "left_semi").select(index.columns))


def needs_extraction(snapshot: DataFrame, files: DataFrame, recipes: DataFrame) -> DataFrame:
    """Files of a scan that are new or changed, or whose recipe is newer."""
    old = files.select("source_id", *(F.col(c).alias(f"_{c}") for c in ("path", "size", "modified_at", "extraction_version")))
    x = snapshot.join(old, "source_id", "left").join(recipes, "extension", "left")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    moved = F.coalesce(F.abs(seconds("modified_at") - seconds("_modified_at")) > 1, ~F.col("modified_at").eqNullSafe(F.col("_modified_at")))
    changed = F.col("_path").isNull() | (F.col("path") != F.col("_path")) | (F.col("size") != F.col("_size")) | moved
    return x.filter(changed | (F.col("_extraction_version") < F.coalesce("version", F.lit(0)))).select(snapshot.columns)


def embedding_queue(passages: DataFrame, files: DataFrame, model: str, limit: int) -> DataFrame:
    """The next passages to embed: one a source, prose before tables, sources with fewest vectors first, then the newest."""
    done = passages.filter(F.col("embedding_model") == model).groupBy("source_id").agg(F.count("*").alias("embedded"))
    open_ = passages.filter((F.length(F.trim("body")) > 0) & (F.coalesce("embedding_model", F.lit("")) != model))
    first = latest(open_.select("source_id", "passage_id", "ordinal"), ["source_id"], [F.asc("ordinal"), F.asc("passage_id")])
    x = first.join(files.select("source_id", "filename", "extension", "modified_at"), "source_id").join(done, "source_id", "left")
    low = F.lower(F.coalesce("extension", F.lit(""))).isin(*LOW_PRIORITY).cast("int")
    order = [low, F.coalesce("embedded", F.lit(0)), F.coalesce("modified_at", F.lit("1970-01-01").cast("timestamp_ntz")).desc(), F.col("passage_id")]
    return x.orderBy(*order).limit(max(1, limit)).select("passage_id", "source_id", "filename")


def pending_documents(files: DataFrame, passages: DataFrame, done: DataFrame) -> DataFrame:
    """Sources with text and without a document card: the input for one, at most 18,000 characters.

    A source's passages beyond those characters are left behind before any are collected.
    """
    waiting = files.join(done.select("source_id"), "source_id", "left_anti").select("source_id", "filename", "modified_at")
    order = Window.partitionBy("source_id").orderBy("ordinal", "passage_id").rowsBetween(Window.unboundedPreceding, -1)
    worded = passages.filter(F.length(F.trim("body")) > 0).withColumn("_before", F.coalesce(F.sum(F.length("body") + 1).over(order), F.lit(0)))
    text = worded.filter(F.col("_before") < CARD_CHARACTERS).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "passage_id", "body"))), lambda x: x["body"]), "\n").alias("text"))
    return waiting.join(text, "source_id").withColumn("text", F.substring("text", 1, CARD_CHARACTERS))


def normalise_query(query: Column) -> Column:
    return collapse(fold(fold_width(query)))


def coalesce_history(entries: DataFrame) -> DataFrame:
    """What stays of a history: an entry goes if another query follows within two seconds, or the same one later.

    The order of time needs the next entry only; the window runs within days, with each day's first entry lent to the day
    before.
    """
    order = [F.asc("searched_at"), F.asc("id")]
    day = entries.withColumn("_day", F.to_date("searched_at"))
    heads = latest(day, ["_day"], order).withColumn("_day", F.date_sub("_day", 1)).withColumn("_lent", F.lit(True))
    both = day.withColumn("_lent", F.lit(False)).unionByName(heads)
    w = Window.partitionBy("_day").orderBy("searched_at", "id")
    after, at = F.lead("normalized_query").over(w), F.lead("searched_at").over(w)
    gap = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("searched_at").cast("timestamp"))
    quick = F.coalesce((gap < HISTORY_SECONDS * 1_000_000) & (after != F.col("normalized_query")), F.lit(False))
    kept = both.withColumn("_quick", quick).filter("not _lent")
    newest = latest(kept, ["normalized_query"], [F.desc("searched_at"), F.desc("id")])
    return newest.filter("not _quick").drop("_day", "_lent", "_quick")


def folder_usage(files: DataFrame, passages: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Files, passages and bytes of text by the first folder below each root."""
    text = passages.groupBy("source_id").agg(F.count("*").alias("passages"), F.sum(F.octet_length("body").cast("long")).alias("bytes"))
    x = files.select("source_id", "root_id", "path").join(text, "source_id", "left").join(roots.select("root_id", F.col("path").alias("root_path"), "display_name"), "root_id")
    rest = F.split(F.substring(F.col("path"), F.length("root_path") + 2, F.length("path")), "/")
    inside = F.size(rest) > 1
    x = x.withColumn("folder", F.when(inside, F.concat_ws("/", "root_path", rest[0])).otherwise(F.col("root_path"))).withColumn("name", F.when(inside, rest[0]).otherwise(F.col("display_name")))
    out = x.groupBy("root_id", "folder", "name").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("passages", F.lit(0))).alias("n_passages"), F.sum(F.coalesce("bytes", F.lit(0))).alias("text_bytes"))
    return out.orderBy(F.desc("text_bytes"), F.desc("n_files"), "folder").limit(max(1, limit))


def health(files: DataFrame, passages: DataFrame, staged: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of counts."""
    f = files.agg(F.count("*").alias("n_files"), F.count_if(F.col("availability") == "extractionFailed").alias("n_failed"), F.count_if(F.col("availability") == "filenameOnly").alias("n_filename_only"))
    p = passages.agg(F.count("*").alias("n_passages"))
    s = staged.agg((F.count("*") * STAGED_BYTES).alias("working_bytes"))
    e = errors.agg(F.coalesce(F.sum("discovery_error_count"), F.lit(0)).alias("n_errors"))
    return f.crossJoin(p).crossJoin(s).crossJoin(e)  # one row each


def issues(files: DataFrame, limit: int) -> DataFrame:
    x = files.filter("availability = 'extractionFailed'").withColumn("message", F.lit("Text extraction failed"))
    return x.orderBy(F.lower("filename"), F.lower("path"), "source_id").limit(max(0, limit)).select("source_id", "root_id", "path", "message")


def disk_estimate(files: DataFrame, supported: list[str]) -> DataFrame:
    """Bytes that an index of these files is expected to take, and what a rebuild needs."""
    text = F.when(F.lower("extension").isin(*supported), F.least("size", F.lit(LARGEST))).otherwise(0)
    x = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(text), F.lit(0)).alias("content_bytes"))
    x = x.withColumn("index_bytes", F.col("n_files") * FILE_BYTES + F.floor(F.col("content_bytes") * TEXT_SHARE))
    return x.withColumn("rebuild_bytes", F.col("index_bytes") * 2)


def disk_reserve(total: Column) -> Column:
    return F.greatest(F.lit(RESERVE), F.floor(total / 20))


def near_duplicates(hits: DataFrame) -> DataFrame:
    """Hits (source_id, path, extension, snippet, position) with the source that leads their group: same stem, type and first 32 words."""
    from skein.functions.text import stem, tokens

    words, name = tokens(F.col("snippet")), F.lower(stem(F.col("path")))
    for ending in COPY_NAMES:
        name = F.replace(name, F.lit(ending), F.lit(""))
    sign = F.concat_ws("|", name, F.lower("extension"), F.array_join(F.slice(words, 1, COPY_WORDS), " "))
    sign = F.when(F.length(F.array_join(words, "")) >= COPY_LETTERS, sign).otherwise(F.col("path"))
    x = hits.withColumn("signature", sign)
    w = Window.partitionBy("signature").orderBy("position")
    return x.withColumn("primary", F.first("source_id").over(w)).withColumn("copy", (F.row_number().over(w) - 1).cast("long"))


def smoothed_rate(rates: Column, before: Column | None = None) -> Column:
    """Three quarters of the rate so far and a quarter of the new one, from the first rate on."""
    return F.aggregate(rates, F.lit(0.0) if before is None else before, lambda s, x: F.when(s == 0, x).otherwise(s * 0.75 + x * 0.25))


def recent_rates(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, rate: the smoothed rate of each key's values in order.

    What lies further back than `FADED` values has a weight that no double holds; a key's list is never longer. Whether there
    was any rate before these still counts. A key's rows are ranked in one task: keys are workers, not sources.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = rows.select(key, order, value).withColumn("_n", nth).filter(F.col("_n") <= FADED)
    lists = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_x"), F.count_if(F.col(value) != 0).alias("_own"))
    known = rows.groupBy(key).agg(F.count_if(F.col(value) != 0).alias("_all"))
    begun = F.when(F.col("_all") > F.col("_own"), F.lit(1e-300)).otherwise(F.lit(0.0))
    return lists.join(known, key).select(key, smoothed_rate(F.transform("_x", lambda r: r[value].cast("double")), begun).alias("rate"))


def change_actions(changes: DataFrame, present: Column, folder: Column) -> DataFrame:
    """What to do about each path's latest change."""
    newest = latest(changes, ["path"], [F.desc("event_id")])
    action = F.when((F.col("kind") == "recover") | folder, "reconcile").when(~present, "delete").otherwise("upsert")
    return newest.withColumn("action", action)


def stable_reads(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size and date were the same before and after they were read."""
    a = after.select("source_id", F.col("size").alias("_s"), F.col("modified_at").alias("_m"))
    return before.join(a, "source_id", "left").withColumn("stable", F.coalesce((F.col("size") == F.col("_s")) & F.col("modified_at").eqNullSafe(F.col("_m")), F.lit(False))).drop("_s", "_m")


def reconcile_due(last: Column, now: Column) -> Column:
    return last.isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) >= RECONCILE_SECONDS)


def purge(files: DataFrame, excluded: Column) -> DataFrame:
    return files.filter(~excluded)
