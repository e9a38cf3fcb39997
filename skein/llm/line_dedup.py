"""Operator 13, line dedup: lines that many documents hold stay in one document only. DataFrame functions throughout.

A line's key is the line without the white space at its ends, lower-cased in A-Z; keys are told apart by two 64-bit hashes.
Lines are written once as (hash, document, place). Hashes are dealt by range and sorted within it by document, largest id
first, and place; a pass over each range meets a key's documents in order, so the first one keeps its lines, and the others
lose theirs if there are at least `documents` of them. What is lost is gathered by document into runs, and returned as a
keep bitmap, run-length coded: the stretches of lines that stay. Texts are never dealt out: only documents with lost
lines have a bitmap, and the bitmaps are sent to the texts while they are few, else joined.

A key that more than 1 in 16,384 lines have (and 5,000 lines at least) would make its range too long. Counters, summed
before they are dealt, tell in which of 65,536 classes such keys are; only those classes' lines are counted by key. There
are at most 16,384 such keys: their documents are counted by key and document, and the answer is broadcast to the lines.

Defined cases: a null or empty text is one empty line; a document all of whose lines go is the empty text; rows that share
an id are one document (each with its own bitmap, if their texts differ), and repeated rows give a row each; rows with a
null id are no document of any key, yet lose what is repeated elsewhere; "\\r" before a line's end is white space;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHARS, DOCUMENTS = 20, 3
HOT, HOTTEST, CLASSES = 5_000, 1 << 14, 1 << 16
SENT = 32 << 20  # bytes of bitmaps that are sent to the texts


def _own(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def _split(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id, tie (of the text), n_lines, place and the two hashes of each line whose key has at least `chars` code points."""
    cut_up = _own(docs).select("doc_id", "tie", _split("text").alias("lines"))
    line = cut_up.select("doc_id", "tie", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    bare = line.withColumn("bare", F.btrim("line", F.lit(SPACE))).filter(F.char_length("bare") >= chars)
    plain = F.octet_length("bare") == F.char_length("bare")  # lower() knows other letters too
    low = bare.withColumn("low", F.when(plain, F.lower("bare")).otherwise(F.translate("bare", UPPER, LOWER)))
    return low.select("doc_id", "tie", "n_lines", "place", F.xxhash64("low").alias("high"), F.xxhash64(F.lit(1), "low").alias("deep"))


def _crowded(lines: DataFrame, least: int, documents: int) -> DataFrame:
    """The keys that more than `least` lines have: their largest document, and whether at least `documents` hold them."""
    place = F.pmod("high", F.lit(CLASSES))
    classes = lines.groupBy(place.alias("place")).count().filter(F.col("count") > least).select("place")
    some = lines.select("high", "deep", "doc_id", place.alias("place")).join(F.broadcast(classes), "place")  # CLASSES rows at most
    keys = some.groupBy("high", "deep").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.count_distinct("doc_id").alias("held"))
    return keys.filter(F.col("n") > least).select("high", "deep", "top", (F.col("held") >= documents).alias("many"))


def lost_lines(lines: DataFrame, documents: int = DOCUMENTS, hot: int = HOT) -> DataFrame:
    """The rows of `lines` whose key at least `documents` documents hold, but for those of the largest of them."""
    crowded = cut(_crowded(lines, max(hot, lines.count() // HOTTEST), documents), "crowded")  # HOTTEST rows at most
    columns = ["doc_id", "tie", "n_lines", "place"]
    often = lines.join(F.broadcast(crowded), ["high", "deep"]).filter(F.col("many") & ~F.col("doc_id").eqNullSafe(F.col("top")))
    ranges = lines.join(F.broadcast(crowded), ["high", "deep"], "left_anti").repartitionByRange("high", "deep")
    key = Window.partitionBy("high", "deep").orderBy(F.col("doc_id").desc_nulls_last(), "place")
    begins = F.lag("doc_id").over(key).eqNullSafe(F.col("doc_id"))
    passed = ranges.withColumn("new", F.when(begins | F.col("doc_id").isNull(), 0).otherwise(1))
    passed = passed.withColumn("nth", F.sum("new").over(key)).withColumn("held", F.max("nth").over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gone = passed.filter((F.col("held") >= documents) & ((F.col("nth") > 1) | F.col("doc_id").isNull()))
    return often.select(columns).unionByName(gone.select(columns))


def keep_bitmaps(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, hot: int = HOT) -> DataFrame:
    """doc_id, tie, n_lines, kept: the stretches (start, length) of lines that stay, of each document that loses any."""
    lines = cut(keyed_lines(docs, chars), "lines")
    lost = lost_lines(lines, documents, hot).dropDuplicates(["doc_id", "tie", "place"])
    one = ["doc_id", "tie", "n_lines"]
    stretch = F.col("place") - F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("place"))
    runs = lost.withColumn("stretch", stretch).groupBy(*one, "stretch").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    held = runs.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    after = lambda i: F.when(i > 0, F.try_element_at("runs", i)["last"] + 1).otherwise(0)  # noqa: E731  # what follows the i-th run
    between = F.transform("runs", lambda r, i: F.struct(after(i).alias("start"), (r["first"] - after(i)).alias("length")))
    end = F.element_at("runs", -1)["last"] + 1
    kept = F.concat(between, F.array(F.struct(end.alias("start"), (F.col("n_lines") - end).alias("length"))))
    return cut(held.select(*one, F.filter(kept, lambda s: s["length"] > 0).alias("kept")), "bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, sent: int = SENT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left of each row."""
    maps = bitmaps.select(F.col("doc_id").alias("its_id"), F.col("tie").alias("its_tie"), "kept")
    size = bitmaps.agg(F.sum(64 + 16 * F.size("kept").cast("long"))).first()[0] or 0  # as rows in memory
    maps = F.broadcast(maps) if size <= sent else maps
    own = _own(docs)
    both = own.join(maps, own.doc_id.eqNullSafe(maps.its_id) & (own.tie == maps.its_tie), "left")
    lines = both.select("doc_id", "text", "kept", _split("text").alias("lines"))
    left = F.array_join(F.flatten(F.transform("kept", lambda s: F.slice("lines", s["start"] + 1, s["length"]))), "\n")
    staying = F.aggregate("kept", F.lit(0), lambda n, s: n + s["length"])
    n_lines = F.size("lines").cast("long")
    return lines.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - staying).cast("long").alias("n_dropped"), F.when(F.col("kept").isNull(), F.col("text")).otherwise(left).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """How many lines each document has and loses, and the SHA-256 of what is left."""
    return apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
with own as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
cut as (select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as place from own),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from cut),
held as (select key, max(doc_id) as top from keyed where length(key) >= {CHARS} group by key having count(distinct doc_id) >= {DOCUMENTS}),
told as (select k.*, held.key is not null and k.doc_id is distinct from held.top as lost from keyed k left join held on k.key = held.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not lost), '')) as kept_sha256
from told group by r
"""
