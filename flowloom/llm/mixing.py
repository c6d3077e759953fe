"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, up to three times one after
another. An entry's virtual finish time is the words that its source has queued up to its
end over the source's target; so at time 1 each queue has given its target, and at any time
all have given the same share of it. The entries are sorted by finish time over all
sources, in ranges, and the sorted stream is cut where the budget, the words of all
documents, is full; of the entry at the cut only the words that still fit are taken.

A source may hold a third of all rows: its running total is made in slots of the shuffled
order, about as many as a slot has rows, and carried over from slot to slot. The sorted
stream is cut by the totals of its ranges; only the range of the cut is added up row by row.

Targets: sources weigh 1, 2, 3 and so on in turn in the order of their code points, null
last, and share the budget by weight; none gets more than three times its words, what is
above goes to the others by weight, until none is above.

Defined results: a null text has no words; documents without words are not queued and give
0 words. A null source is a source. A null key is shuffled by its text. Rows that repeat
are each queued; equal rows may change places. An empty table gives an empty mix. Long
texts count whole. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowloom.llm.batches import quoted
from flowloom.operators.ordering import carried, group_key, numbered, range_limits, sorted_table
from flowloom.session import forget, keep

WEIGHTS = (1, 2, 3)
#: Times that a document is used at most.
EPOCHS = 3


def word_count(text: Column) -> Column:
    """Words are runs of characters other than space, tab to carriage return."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(trimmed, r"[^ \t-\r]++[ \t-\r]*+", "x")).cast("long")


def shuffled_place(key: Column, text: Column, seed: str = "") -> Column:
    """60 bits of a digest of the key: the order of a source's queue."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), named).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """(queue, source_size, target) from (queue, size); the driver sees two sums a round."""
    none_last = [(F.col("queue") == "").asc(), F.col("queue").asc()]
    ranked, ordered = numbered(sizes.groupBy("queue").agg(F.sum("size").alias("source_size")), none_last, "rank", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = keep(ranked.select("queue", "source_size", weight.alias("weight")), "weights")
    forget(ordered)
    limit = F.col("source_size") * most
    share, capped = 0.0, -1
    while True:  # the share of a weight only grows, and each round but the last caps a source
        above = F.lit(share) * F.col("weight") > limit
        row = table.agg(
            F.sum("source_size").alias("budget"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("left"),
            F.count_if(above).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["left"]:
            break
        share, capped = (row["budget"] - row["given"]) / row["left"], row["capped"]
    return table.select("queue", "source_size", F.least(F.lit(share) * F.col("weight"), limit.cast("double")).alias("target"))


def queued(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS, carry: tuple[str, ...] = (), seed: str = "") -> DataFrame:
    """A kept table of the rows of ``df``: uid, key, source, size, place, queue, source_size,
    target, passed (words of the source's queue up to the row's end) and ``carry``, a struct."""
    taken = F.struct(*[F.col(quoted(c)).alias(c) for c in carry]) if carry else F.lit(None).cast("string")
    k, s, t = (F.col(quoted(c)) for c in (key, source, text))
    rows = keep(df.select(F.monotonically_increasing_id().alias("uid"), k.alias("key"), s.alias("source"), word_count(t).alias("size"), shuffled_place(k, t, seed).alias("place"), group_key(s).alias("queue"), taken.alias("carry")), "sizes")
    bits = math.ceil(math.log2(max(2, rows.count())) / 2)
    rows_in_slots = rows.withColumn("range", F.shiftright("place", 60 - bits))
    sums = rows_in_slots.groupBy("queue", "range").agg(F.sum("size").alias("__all"))
    before = carried(sums, "__all", "__before", ["queue"])
    slots = before.join(source_targets(rows, weights, most), "queue").drop("__all")
    inside = W.partitionBy("queue", "range").orderBy("place", "key", "size", "uid").rowsBetween(W.unboundedPreceding, 0)
    own = rows_in_slots.withColumn("__own", F.sum("size").over(inside))
    out = keep(own.join(slots, ["queue", "range"]).withColumn("passed", F.col("__before") + F.col("__own")).drop("range", "__own", "__before"), "queued")
    forget(rows)
    return out


def mix(queues: DataFrame, most: int = EPOCHS) -> DataFrame:
    """The mixed stream of a table from ``queued``: its rows in the order of their finish
    times (in ranges of files), with epoch, finish and taken, the words of the entry that count."""
    entries = queues.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(most)))))
    entries = entries.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("passed")) / F.col("target"))
    # when every queue has passed its target the budget is full: what finishes later is never reached
    full = entries.where("finish >= 1").groupBy("queue").agg(F.min("finish").alias("f")).agg(F.max("f"), F.count("*")).first()
    if full[0] is not None and full[1] == queues.where("size > 0").select("queue").distinct().count():
        entries = entries.where(F.col("finish") <= full[0] * (1 + 1e-9))
    order = ["finish", "queue", "epoch", "place", "key", "size", "uid"]
    stream = sorted_table(entries, order, "mix")
    budget = queues.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    totals = carried(stream.groupBy("range").agg(F.sum("size").alias("__all")), "__all", "__before", [])
    cut = totals.where(F.col("__before") + F.col("__all") >= budget).orderBy("range").select("range", "__before").first()
    if cut is None:
        return stream.withColumn("taken", F.col("size")).drop("range", "row", "__id")
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    last = stream.where(~range_limits(cut["range"]) & range_limits(cut["range"] + 1))
    room = F.lit(budget - cut["__before"]) - F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = last.withColumn("taken", F.least("size", room)).where("taken > 0")
    return stream.where(range_limits(cut["range"])).withColumn("taken", F.col("size")).unionByName(last).drop("range", "row", "__id")


def mixed_words(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **more) -> DataFrame:
    """Per row of ``df``: key, size, source_size, target and taken, the words of it in the mix."""
    queues = queued(df, key, source, text, **more)
    words = mix(queues).groupBy("uid").agg(F.sum("taken").alias("taken"))
    joined = queues.join(words, "uid", "left")
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same mix in SQL: targets by one pass over sources in the order in which they would be capped.
ORACLE = """
with docs as (
  select row_number() over () as uid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || md5(coalesce(doc_id::varchar, '-' || md5(coalesce(text, ''))))[1:15])::bigint as place
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight
  from docs group by source),
steps as (
  select *, sum(source_size) over () as budget,
         coalesce(sum(3 * source_size) over w, 0) as given, sum(weight) over () - coalesce(sum(weight) over w, 0) as left_weight,
         row_number() over (order by 3 * source_size / weight, source) as step
  from sources window w as (order by 3 * source_size / weight, source rows between unbounded preceding and 1 preceding)),
share as (
  select (budget - given)::double / left_weight as share from steps
  where 3 * source_size >= (budget - given)::double / left_weight * weight order by step limit 1),
targets as (select source, source_size, least(share * weight, 3.0::double * source_size) as target from sources, share),
passed as (
  select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by place, doc_id, size, uid) as passed
  from docs d join targets t on d.source is not distinct from t.source),
entries as (
  select uid, size, row_number() over (order by (epoch * source_size + passed)::double / target, source nulls first, epoch, place, doc_id, size, uid) as n
  from passed, (values (0), (1), (2)) e(epoch) where size > 0),
running as (select uid, size, coalesce(sum(size) over (order by n rows between unbounded preceding and 1 preceding), 0) as before from entries),
taken as (select uid, sum(greatest(0, least(size, (select sum(size) from docs) - before)))::bigint as taken from running group by uid)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken from passed left join taken using (uid)
"""
