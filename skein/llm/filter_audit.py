"""Operator 12, an audit of how filters interact: Walsh-Hadamard sums over the masks of filters that a document fails.

Five filters give each document a mask of five bits (bit i: the i-th letter's filter fails): A: under 100 words; B: under 80
distinct words in 100; C: over 10 capitals A-Z in 100 code points; D: any of #$%&*|; E: the text of a smaller id. Per part
and label the 32 signed parity sums W(s) = sum over documents of (-1)**|s & mask| are added up; they are sums, so tasks add
them up before anything is dealt. 32 * count(mask) = sum over s of (-1)**|s & mask| * W(s) gives them back as counts of masks
exactly, and all that an order of filters does follows from the 32 counts: what stands after k filters are the masks
without their bits. A filter's Shapley share needs no orders at all: a document that fails f filters is removed by each of
them in 120 / f of the 120 orders.

Texts meet their copies as SHA-256 digests, never as texts. Rows with the same digest, id, part and label are added up
first, then rows with the same digest, part and label keep their smallest id and its number: a text that a third of all rows
have is a few rows a task. Rows without an id are dealt out evenly beside the labels.

Defined cases: a null text is the empty text; rows that share the smallest id of a text are all first, so none of them fails
E; a row with a null id has no smaller id and is none, so it never fails E; repeated rows count each; several labels of an
id count as 1 where any is 1, labels that are null or missing as 0; a null language is the part "", as is the language "";
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = 120  # of five filters
SPACE = " \t\n\x0b\x0c\r"


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of A to D, of each row."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("bare"))
    words = own.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", "[ \\t\\n\\x0B\\f\\r]+")))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    n = words.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"), capitals.alias("capitals"))
    fails = [F.col("n") < 100, 100 * F.col("different").cast("long") < 80 * F.col("n").cast("long"), 100 * F.col("capitals").cast("long") > 10 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    return n.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)).alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With good and toxic; rows without an id, which no label has, are dealt out evenly."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(0)
    both = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return both.withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask of A to D, and how many documents pass and fail E."""
    kind = ["digest", "part", "good", "toxic", "mask"]
    rows = _labelled(masked(docs), labels).groupBy("doc_id", "spread", *kind).count()
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "count"))
    alike = rows.groupBy(*kind).agg(F.sum("count").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("count")).otherwise(0)).alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row a part and label
    passed = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.count")).otherwise(0)
    return alike.withColumn("passed", passed).select("part", "good", "toxic", "mask", "passed", (F.col("n") - F.col("passed")).alias("failed"))


def _sign(a: Column, b) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(counted: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed sums W(0), ..., W(31)."""
    last = CELLS >> 1  # the bit of E

    def signed(s: int) -> Column:
        weight = F.col("passed") - F.col("failed") if s & last else F.col("passed") + F.col("failed")
        return F.sum(_sign(F.col("mask"), F.lit(s & ~last)) * weight).alias(f"w{s}")

    sums = counted.groupBy("part", "good", "toxic").agg(*(signed(s) for s in range(CELLS)))
    return sums.select("part", "good", "toxic", F.array(*(f"w{s}" for s in range(CELLS))).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """part, cells: for each mask how many documents have it, how many of them are good, how many toxic."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    total = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda t, s: t + _sign(s, m) * F.element_at("sums", s + 1))
    counts = F.transform(every, lambda m: (total(m) / CELLS).cast("long"))
    flat = sums.select("part", "good", "toxic", F.posexplode(counts).alias("mask", "n"))
    cells = flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    cells = inverted(parity_sums(masks(docs, labels)))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = sum(F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS))
    before = sum(F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS))
    steps = steps.withColumns({"bit": bit, "before": before})

    def total(which, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda t, c: t + value(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda c: fails(c) & ~gone(c)
    return steps.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"), total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (ORDERS / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
ORACLE = rf"""
with own as (select row_number() over () as r, doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
counted as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  min(doc_id) over (partition by text) as least from own),
known as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by doc_id),
judged as (select r, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  map {{'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(counted.doc_id > least, false)}} as fails
  from counted left join known on known.doc_id = counted.doc_id),
orders(filter_order) as (values {_ORDERS}),
steps as (select filter_order, step, filter_order[step] as letter from orders, (select unnest(range(1, 6))::int as step)),
walked as (select part, filter_order, step, letter, good, toxic, fails[letter] as f,
    len(list_filter(range(1, step), lambda k: fails[filter_order[k]])) > 0 as gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 as alone
  from judged, steps),
summed as (select part, filter_order, step, letter, count(*) filter (where not f and not gone) as kept, count(*) filter (where f and not gone) as removed,
  count(*) filter (where f and gone) as redundant, count(*) filter (where f and alone) as unique_fails,
  count(*) filter (where f and not gone and good = 1) as good_lost, count(*) filter (where f and not gone and toxic = 1) as toxic_lost
  from walked group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from summed
"""
