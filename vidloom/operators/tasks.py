"""Stages of an analysis task, its inputs and its resumable pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

# Stages with their share of the work.
STAGES = (("scan", 12.0), ("cache", 8.0), ("features", 35.0), ("candidate", 8.0), ("compare", 30.0), ("report", 7.0))


def weighted_progress(stages: DataFrame, keys: list[str], weight: str = "weight", progress: str = "progress") -> DataFrame:
    """Progress of each task: stage progress weighted, two decimals; 0 without weight."""
    w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight), F.lit(0.0)))
    p = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col(progress), F.lit(0.0))))
    return stages.groupBy(*keys).agg(F.round(F.coalesce(F.sum(w * p) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)), 2).alias("progress"))


def elapsed(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the elapsed milliseconds of a task's stages, with what a running stage has taken so far (``now_ms``)."""
    running = F.when((F.col("status") == "running") & F.col("started_ms").isNotNull(), F.greatest(F.lit(0), F.col("now_ms") - F.col("started_ms"))).otherwise(0)
    return stages.groupBy(*keys).agg(F.sum(F.coalesce("elapsed_ms", F.lit(0)) + running).alias("elapsed_ms"))


def merge_stages(existing: DataFrame) -> DataFrame:
    """The six stages of every task: what is recorded, defaults for the rest. ``existing``: ``task``, ``id``, ..."""
    spark = existing.sparkSession
    base = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(STAGES)], "idx int, id string, default_weight double")
    grid = existing.select("task").distinct().crossJoin(F.broadcast(base))  # six rows a task
    j = grid.join(existing, ["task", "id"], "left")
    return j.select("task", "idx", "id", F.coalesce("weight", "default_weight").alias("weight"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("progress", F.lit(0.0)).alias("progress"))


def next_stage(stages: DataFrame) -> DataFrame:
    """Per task the first stage that isn't completed; null if all are."""
    return stages.groupBy("task").agg(F.min_by("id", F.when(F.col("status") != "completed", F.col("idx"))).alias("next_stage"))


def blocking_stages(stages: DataFrame, stage: str) -> DataFrame:
    """Per task the labels of the earlier stages that must be completed before ``stage`` may start."""
    at = [s for s, _ in STAGES].index(stage)
    open_ = F.when((F.col("idx") < at) & (F.col("status") != "completed"), F.struct("idx", "id"))
    return stages.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(open_)), lambda s: s["id"]).alias("blocking"))


def reset_from(stages: DataFrame, stage: str) -> DataFrame:
    """``stage`` and everything after it as pending."""
    at = [s for s, _ in STAGES].index(stage)
    late = F.col("idx") >= at
    return stages.withColumn("status", F.when(late, "pending").otherwise(F.col("status"))).withColumn("progress", F.when(late, 0.0).otherwise(F.col("progress")))


def replay_stages(events: DataFrame) -> DataFrame:
    """State of each stage after its events: status, progress and elapsed milliseconds.

    ``events``: ``task``, ``stage``, ``seq``, ``at_ms``, ``status``, ``progress``. Time counts from a change to running
    until the next change to paused, completed or failed; a repeated running changes nothing; completed means 100.
    """
    w = W.partitionBy("task", "stage").orderBy("seq")
    before = F.coalesce(F.lag("status").over(w), F.lit("pending"))
    e = events.withColumn("before", before)
    e = e.withColumn("begun", F.when((F.col("status") == "running") & (F.col("before") != "running"), F.col("at_ms")))
    e = e.withColumn("since", F.last("begun", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ended = F.col("status").isin("paused", "completed", "failed") & (F.col("before") == "running")
    e = e.withColumn("took", F.when(ended, F.greatest(F.lit(0), F.col("at_ms") - F.col("since"))).otherwise(0))
    shown = F.when(F.col("status") == "completed", 100.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("progress"))), 2))
    last = e.withColumn("shown", shown).groupBy("task", "stage").agg(F.max_by(F.struct("status", "shown"), "seq").alias("x"), F.sum("took").alias("elapsed_ms"))
    return last.select("task", "stage", F.col("x.status").alias("status"), F.col("x.shown").alias("progress"), "elapsed_ms")


def inputs_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether the fingerprints (``path``, ``size``, ``mtime_ms``) differ, with what was added and removed."""
    cols = [T.normalize_path("path").alias("path"), "size", "mtime_ms"]
    o, n = old.select(*cols).distinct().withColumn("o", F.lit(1)), new.select(*cols).distinct().withColumn("n", F.lit(1))
    j = o.join(n, ["path", "size", "mtime_ms"], "full_outer")
    facts = j.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count("o").alias("had"))
    return facts.select("added", "removed", ((F.col("added") + F.col("removed") > 0) & (F.col("had") > 0)).alias("changed"))


def comparison_progress(direction: Column, done: Column, total: Column, frames_a: Column, frames_b: Column, first: Column | None = None) -> Column:
    """``done``, ``total``, ``label`` of a pair while one direction of it is compared.

    Each side counts with its frames (at least 1); the direction of the smaller side comes first unless stated (``A`` if
    equal), and what the other one does is added to it.
    """
    at_least = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(0))).cast("long")
    a, b, steps = at_least(frames_a), at_least(frames_b), at_least(total)
    lead = F.when(a <= b, "A_to_B").otherwise("B_to_A")
    lead = lead if first is None else F.coalesce(first, lead)
    own = F.least(F.greatest(F.lit(0), F.coalesce(done, F.lit(0))).cast("long"), steps)
    moved = own + F.when(direction == lead, 0).when(lead == "A_to_B", a).otherwise(b)
    label = F.when(direction == "A_to_B", "A to B").otherwise("B to A")
    return F.struct(F.least(moved, a + b).alias("done"), (a + b).alias("total"), label.alias("label"))


def activate(recorded: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The six stages of each task that starts, and ``changed``: a task whose files differ from last time starts anew.

    ``recorded``: stages of tasks as in ``merge_stages``; ``old`` and ``new``: ``task``, ``path``, ``size``, ``mtime_ms``.
    A task is changed if it had files and they aren't the same; then all its stages are pending and its completed pairs
    don't count. Tasks are those of ``new`` and of ``recorded``; nulls in a fingerprint are values.
    """
    cols = ["task", "path", "size", "mtime_ms"]
    both = old.select(*cols).distinct().withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionByName(new.select(*cols).distinct().withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    same = both.groupBy(*cols).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    facts = same.groupBy("task").agg((F.max("o") == 1).alias("had"), F.max(F.when(F.col("o") != F.col("n"), True).otherwise(False)).alias("differs"))
    tasks_ = new.select("task").distinct().join(recorded, "task", "full_outer") if set(recorded.columns) - {"task"} else new.select("task").distinct()
    stages = merge_stages(tasks_).join(facts.select("task", (F.col("had") & F.col("differs")).alias("changed")), "task", "left")
    changed = F.coalesce("changed", F.lit(False))
    return stages.select("task", "idx", "id", "weight", F.when(changed, "pending").otherwise(F.col("status")).alias("status"), F.when(changed, 0.0).otherwise(F.col("progress")).alias("progress"), changed.alias("changed"))


def resume_state(states: DataFrame, own: str, signature: str) -> DataFrame:
    """The rows of the state from which a task goes on.

    ``states``: ``state`` (file name), ``signature``, ``pair_key``, ``modified_ms`` and others. Candidates are the task's
    own state and the first other one with an equal signature: its pending files come before the states of other tasks,
    newer ones first. Of the two the one with more pairs is taken, the own one if equal.
    """
    s = states.where(F.col("signature") == signature)
    facts = s.groupBy("state").agg(F.countDistinct("pair_key").alias("pairs"), F.max("modified_ms").alias("at"))
    kind = F.when(F.col("state") == own, 0).when(F.col("state").startswith(f"{own}.") & F.col("state").endswith(".pending"), 1).when(F.col("state").endswith(".state.json"), 2)
    facts = facts.withColumn("kind", kind).where("kind is not null")
    other = facts.where("kind > 0").orderBy("kind", F.desc("at"), "state").limit(1)
    best = facts.where("kind = 0").unionByName(other).orderBy(F.desc("pairs"), "kind").limit(1)
    return states.where(F.col("signature") == signature).join(F.broadcast(best.select("state")), "state", "left_semi")  # one row


#: The settings that make up the key by which a task is found again, in order.
MATCH_FIELDS = (
    "skipThreshold", "matchThreshold", "windowSize", "topK", "candidateLimit", "compareWorkers", "maxGapSec", "frameStep", "cropBlackBorders", "resizeMode", "inputSize", "portraitRotation", "force", "earlyStop", "device",
    "errorTolerancePreset", "errorToleranceSevereLimit", "errorToleranceMissingPictureLimit", "errorTolerancePreflightValidation", "analysisMode", "minSegmentDuration", "minSegmentMatches", "offsetTolerance",
)


def match_key(config: Column | str) -> Column:
    """The key of a task from the JSON text of its settings: the same settings and videos give the same key.

    Paths count in their normal form, an absent early stop as true, absent settings not at all; null for broken JSON.
    """
    c = F.col(config) if isinstance(config, str) else config
    get = lambda n: F.get_json_object(c, f"$.{n}")
    paths = F.coalesce(F.transform(F.from_json(get("videoPaths"), "array<string>"), T.normalize_path), F.array().cast("array<string>"))
    fields = [F.coalesce(get(n), F.lit("true")).alias(n) if n == "earlyStop" else get(n).alias(n) for n in MATCH_FIELDS]
    doc = F.to_json(F.struct(F.lit(1).alias("version"), T.normalize_path(get("videoDir")).alias("videoDir"), *fields, paths.alias("videoPaths")))
    return F.when(F.try_parse_json(c).isNotNull(), doc)


def task_config(text: Column | str) -> Column:
    """Settings as a map of texts; empty for broken JSON or anything but an object."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")), F.from_json(F.lit("{}"), "map<string,string>"))


def pair_key(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    """Unordered key of two files given as (path, size, time) column names."""
    left, right = (F.concat_ws("|", *[F.col(c).cast("string") for c in x]) for x in (a, b))
    return F.concat_ws("||", F.least(left, right), F.greatest(left, right))


def pending_pairs(candidates: DataFrame, store: DataFrame, signature: str) -> DataFrame:
    """Candidates whose ``pair_key`` isn't stored under the same parameter signature."""
    done = store.where(F.col("signature") == signature).select("pair_key")
    return candidates.join(done, "pair_key", "left_anti")


def resumed_pairs(candidates: DataFrame, store: DataFrame, signature: str) -> DataFrame:
    """Stored results that the candidates can reuse."""
    return upserted(store.where(F.col("signature") == signature)).join(candidates.select("pair_key").distinct(), "pair_key", "left_semi")


def upserted(store: DataFrame, key: str = "pair_key", version: str = "version") -> DataFrame:
    """The latest version of every key of an append-only store; a mergeable maximum."""
    return store.groupBy(key).agg(F.max_by(F.struct(*store.columns), version).alias("row")).select("row.*")


def richest_state(states: DataFrame, signature: str) -> DataFrame:
    """Of the stored states with a signature the one with the most pairs; ties go to the smaller name."""
    s = states.where(F.col("signature") == signature).groupBy("state").agg(F.countDistinct("pair_key").alias("pairs"))
    best = s.orderBy(F.desc("pairs"), "state").limit(1)
    return states.join(F.broadcast(best.select("state")), "state", "left_semi")  # one row


def is_fresh(actual: dict[str, Column], expected: dict[str, Column], tolerance: float = 1e-6) -> Column:
    """True if every expected value equals the actual one, numbers within a tolerance; a missing actual value is stale."""
    ok = F.lit(True)
    for k, want in expected.items():
        if k not in actual:
            return F.lit(False)
        have = actual[k]
        close = F.abs(have.try_cast("double") - want.try_cast("double")) <= tolerance
        ok = ok & (have.eqNullSafe(want) | F.coalesce(close, F.lit(False)))
    return ok


def smallest_unused(numbers: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The smallest positive integer that a group doesn't use."""
    used = numbers.where(F.col(n) > 0).select(*keys, F.col(n).alias("n")).distinct()
    w = W.partitionBy(*keys).orderBy("n")
    gap = used.withColumn("rank", F.row_number().over(w)).groupBy(*keys).agg(F.max(F.when(F.col("n") == F.col("rank"), F.col("n"))).alias("dense"))
    return numbers.select(*keys).distinct().join(gap, keys, "left").select(*keys, (F.coalesce("dense", F.lit(0)) + 1).alias("unused"))
