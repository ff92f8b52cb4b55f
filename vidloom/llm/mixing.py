"""Mixing sources to target weights.

The mix is a row of slots of equal size. Slot i belongs to the source into whose
stretch of the cumulative weights the i-th golden-ratio point falls, so every
prefix of the mix is close to the target shares. The documents of a source are
laid out in hashed order on an endless tape that repeats them up to the allowed
number of times; the k-th slot of a source takes the k-th stretch of slot size of
its tape.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.identity import source_code
from ..session import Scratch

GOLDEN = (math.sqrt(5) - 1) / 2


def sized_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` code and ``size`` in tokens (UTF-8 bytes; a null text has 0), each document once."""
    d = documents.select("doc_id", source_code("source").alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return d.groupBy("doc_id", "source").agg(F.max("size").alias("size"))


def _shares(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.where("source is not null and target_share > 0").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("r")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("mix targets are a settings table of at most 10,000 sources")
    return sorted((r[0], float(r[1]), int(r[2])) for r in rows)


def mix(sized: DataFrame, targets: DataFrame, slot_tokens: int = 65_536, seed: int = 11, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``sized``: ``doc_id``, ``source``, ``size``; ``targets``: ``source``, ``target_share``, ``max_repeats``. The mix
    has the size of all documents of the sources in ``targets``. First result: one row per placed copy, ``slot``
    (position in the mix), ``source``, ``doc_id``, ``copy`` (from 0), ``at`` (place on the source's tape), ``size``.
    Second result: one row per source of ``targets`` with available, wanted and placed tokens, target and reached
    share and their ``deviation``, ``repeats`` used, ``largest_slot_tokens`` (a document belongs to the slot in which it
    starts, so a slot may hold more than its size) and ``short``: the source has nothing, or almost nothing, left for
    further turns of the schedule, and size times repeats is indeed below the target share of the total.

    A document is placed at most ``max_repeats`` times (null: once). Documents of size 0 or of other sources, and
    rows with nulls, have no place in a mix. A source without documents has size 0. Shares that don't sum to 1 are
    scaled for the schedule. Without documents both the mix is empty and the report has zeros. A source that holds
    any part of the rows is spread over 1,024 hash ranges, whose offsets come from a table of that many rows.
    """
    spark = sized.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    shares = _shares(targets)
    weights = spark.createDataFrame(shares, "source string, target_share double, max_repeats int")
    d = sized.where(F.col("doc_id").isNotNull() & (F.col("size") > 0)).join(F.broadcast(weights.select("source")), "source", "left_semi")
    h = F.xxhash64("doc_id", F.lit(seed))
    d = scratch.table(d.select("doc_id", "source", "size", h.alias("h"), F.shiftrightunsigned(h, 54).cast("int").alias("range")), "sized")
    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("tokens"))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("range")) - F.col("tokens")
    ranges = scratch.table(ranges.select("source", "range", "tokens", before.alias("base")), "ranges")
    have = {r[0]: int(r[1]) for r in ranges.groupBy("source").agg(F.sum("tokens")).collect()}
    total = sum(have.values())
    slots = math.ceil(total / slot_tokens)

    scale = sum(s for _, s, _ in shares) or 1.0
    edge, pick = 0.0, None
    point = F.pmod(F.col("id").cast("double") * F.lit(GOLDEN) + F.lit(0.5), F.lit(1.0))
    for name, share, _ in shares[:-1]:
        edge += share / scale
        pick = F.when(point < edge, name) if pick is None else pick.when(point < edge, name)
    last = F.lit(shares[-1][0]) if shares else F.lit(None).cast("string")
    chosen = last if pick is None else pick.otherwise(last)
    chunk = F.shiftright("id", 16)
    plan = spark.range(slots).select(F.col("id").alias("slot"), chosen.alias("source"), chunk.alias("chunk"))
    counts = plan.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = (F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("base")
    plan = plan.join(counts.select("source", "chunk", base), ["source", "chunk"])
    rank = F.col("base") + F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    plan = scratch.table(plan.select("slot", "source", rank.alias("turn")), "slots")
    wanted = {r[0]: int(r[1]) for r in plan.groupBy("source").count().collect()}

    facts = spark.createDataFrame([(s, have.get(s, 0), r, wanted.get(s, 0)) for s, _, r in shares], "source string, have long, max_repeats int, turns long")
    run = F.sum("size").over(W.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    tape = d.withColumn("run", run).join(F.broadcast(ranges.select("source", "range", "base")), ["source", "range"]).join(F.broadcast(facts), "source")
    turns_end = F.col("turns") * slot_tokens
    needed = F.least(F.col("max_repeats").cast("long"), F.ceil((turns_end - F.col("base") - F.col("run")) / F.col("have")))
    tape = tape.withColumn("copies", needed).where(F.col("copies") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    at = F.col("base") + F.col("run") + F.col("copy") * F.col("have")
    tape = tape.select("doc_id", "source", "size", "copy", at.alias("at"), F.floor(at / slot_tokens).alias("turn"))
    placed = scratch.table(tape.join(plan, ["source", "turn"]).select("slot", "source", "doc_id", "copy", "at", "size"), "mix")

    scratch.drop(d, ranges, plan)
    slot_sums = placed.groupBy("source", "slot").agg(F.sum("size").alias("held"), F.max("copy").alias("copy"))
    got = slot_sums.groupBy("source").agg(F.sum("held").alias("placed"), (F.max("copy") + 1).alias("repeats"), F.max("held").alias("largest"))
    # The turns of a source differ from its share of the slots by less than this (the points are of low discrepancy).
    slack = (4 + math.ceil(math.log2(slots + 1))) * slot_tokens
    report = facts.join(weights.select("source", "target_share"), "source").join(got, "source", "left")
    placed_c, all_placed = F.coalesce("placed", F.lit(0)), placed.agg(F.sum("size")).first()[0] or 0
    report = report.select(
        "source", "target_share", "max_repeats", F.col("have").alias("available_tokens"), (F.col("target_share") * total).alias("wanted_tokens"),
        placed_c.alias("placed_tokens"), (placed_c / F.lit(max(1, all_placed))).alias("reached_share"),
        (placed_c / F.lit(max(1, all_placed)) - F.col("target_share")).alias("deviation"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("largest", F.lit(0)).alias("largest_slot_tokens"),
        ((F.col("have") * F.col("max_repeats") - placed_c <= slack) & (F.col("have") * F.col("max_repeats") < F.col("target_share") * total)).alias("short"),
    )
    return placed, report
