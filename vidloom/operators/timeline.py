"""Intervals on tracks: elementary intervals, what is active at a time, sequential placement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def elementary_intervals(clips: DataFrame, group: list[str] | None = None, bucket: float | None = None) -> DataFrame:
    """``start``, ``end``, ``active``: what is shown between each two consecutive boundaries.

    ``clips``: ``clip`` (id), ``track``, ``start``, ``end``. Boundaries are rounded to 6 decimals; intervals of up to a
    millionth and those without a clip are dropped; ``active`` is ordered by track and clip. A clip is active if it
    covers the middle of the interval. Clips meet intervals by time buckets (see ``_meet``), the narrowest of them the
    mean length of a clip unless given. Rows with null or NaN bounds don't take part.
    """
    keys = group or []
    c = clips.where("start is not null and end is not null and not isnan(start) and not isnan(end)")
    points = c.select(*keys, F.explode(F.array(F.round("start", 6), F.round("end", 6))).alias("at")).distinct()
    by = W.partitionBy(*keys).orderBy("at")
    spans = points.withColumn("to", F.lead("at").over(by)).where(F.col("to") - F.col("at") > 1e-6).withColumn("mid", (F.col("at") + F.col("to")) / 2)
    if bucket is None:
        bucket = max(1e-3, c.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1.0)
    j = _meet(spans, c, keys, "mid", bucket)
    active = F.transform(F.array_sort(F.collect_list(F.struct("track", "clip"))), lambda x: x["clip"])
    return j.groupBy(*keys, F.col("at").alias("begin"), F.col("to").alias("finish")).agg(active.alias("active")).withColumnsRenamed({"begin": "start", "finish": "end"})


def _meet(points: DataFrame, clips: DataFrame, keys: list[str], at: str, bucket: float) -> DataFrame:
    """``points`` with the clips of the same ``keys`` that cover their time ``at``: an equi join on buckets of time.

    The width of a clip's buckets is the narrowest one times a power of two, so that a clip of any length lies in at
    most five of them; a point is looked up once in each width that occurs.
    """
    c = clips.where("end > start")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("end") - F.col("start")) / (4 * bucket)))).cast("int")
    c = c.withColumn("__level", level)
    levels = sorted(r[0] for r in c.select("__level").distinct().collect())  # powers of two: a few dozen at most
    width = F.lit(float(bucket)) * F.pow(F.lit(2.0), F.col("__level"))
    c = c.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    p = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__b", F.floor(F.col(at) / width))
    return p.join(c, [*keys, "__level", "__b"]).where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("__b", "__level")


def active_at(clips: DataFrame, at: float | Column) -> DataFrame:
    """Clips that cover a time, by track and start."""
    t = F.lit(float(at)) if isinstance(at, (int, float)) else at
    return clips.where((F.col("start") <= t) & (t < F.col("end"))).orderBy("track", "start", "clip")


def points_in_intervals(points: DataFrame, clips: DataFrame, bucket: float) -> DataFrame:
    """Each point with the clips of its track that cover it."""
    return _meet(points, clips, ["track"], "at", bucket)


def sequential_starts(clips: DataFrame, track: str = "track", order: str = "clip", minimum: float = 0.01) -> DataFrame:
    """Places clips on their tracks: ``start`` as requested, else at the latest end so far on the track.

    ``clips``: ``track``, ``clip`` (order), ``requested`` (null: none), ``duration``. A clip's own place may depend on
    every earlier one, so this is a fold in order of clip; the state is one number per track. Durations below
    ``minimum`` and requested starts below 0 are raised.
    """
    rows = clips.select(track, order, F.col("requested").cast("double"), F.greatest(F.coalesce(F.col("duration").cast("double"), F.lit(0.0)), F.lit(minimum)).alias("duration"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cursor = object(), 0.0
        for x in batches:
            starts, ends = [], []
            for t, req, d in zip(x[track], x["requested"].to_numpy(), x["duration"].to_numpy()):
                if t != name:
                    name, cursor = t, 0.0
                s = cursor if req != req else max(0.0, req)
                cursor = max(cursor, s + d)
                starts.append(s)
                ends.append(s + d)
            yield pd.DataFrame({track: x[track], order: x[order], "start": starts, "end": ends})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (track, order)}
    placed = rows.where(F.col(track).isNotNull()).repartition(track).sortWithinPartitions(track, order)
    return placed.mapInPandas(fold, f"{track} {kinds[track]}, {order} {kinds[order]}, start double, end double")


def neighbours_on_track(clips: DataFrame) -> DataFrame:
    """Each clip with the one before and after it on its track."""
    w = W.partitionBy("track").orderBy("start", "clip")
    return clips.withColumn("previous", F.lag("clip").over(w)).withColumn("next", F.lead("clip").over(w))


def total_duration(*layers: DataFrame) -> DataFrame:
    """The latest end of any layer, 0 without one."""
    ends = layers[0].select("end")
    for x in layers[1:]:
        ends = ends.unionAll(x.select("end"))
    return ends.agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("duration"))


def even(x: Column) -> Column:
    """The even number at or below, at least 2."""
    return F.greatest(F.lit(2), x - x % 2).cast("int")


def grid_cells(clips: DataFrame, width: int, height: int, key: str = "interval", order: str = "position") -> DataFrame:
    """Cell of each clip of an interval: 2 columns for up to 4 clips, else 3; one clip fills the frame."""
    n = F.count(F.lit(1)).over(W.partitionBy(key)).cast("int")
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    cols = F.when(F.col("n") <= 4, 2).otherwise(3)
    rows = F.floor((F.col("n") + cols - 1) / cols)
    one = F.col("n") <= 1
    w = F.when(one, width).otherwise(even(F.floor(width / cols).cast("int")))
    h = F.when(one, height).otherwise(even(F.floor(height / rows).cast("int")))
    x = clips.withColumn("n", n).withColumn("i", i).withColumn("cell_width", w).withColumn("cell_height", h)
    return x.withColumn("x", (F.col("i") % cols) * F.col("cell_width")).withColumn("y", (F.floor(F.col("i") / cols) * F.col("cell_height")).cast("int")).drop("n", "i")


def nearest_snap(value: Column, candidates: Column, threshold: float) -> Column:
    """The candidate nearest to a value, the first among equals, if it is within the threshold; else the value."""
    near = F.filter(candidates, lambda c: F.abs(c - value) <= threshold)
    best = F.array_min(F.transform(near, lambda c, i: F.struct(F.abs(c - value).alias("d"), i.alias("i"), c.alias("c"))))
    return F.coalesce(best["c"], value)


def rectangles_overlap(a: Column, b: Column, epsilon: float = 0.001) -> Column:
    """True if two structs (x, y, width, height) overlap by more than epsilon."""
    return (a["x"] < b["x"] + b["width"] - epsilon) & (a["x"] + a["width"] > b["x"] + epsilon) & (a["y"] < b["y"] + b["height"] - epsilon) & (a["y"] + a["height"] > b["y"] + epsilon)


def normal_rectangle(r: Column) -> Column:
    """A rectangle (x, y, width, height) inside the unit square, its sides at least a twentieth."""
    w, h = (F.least(F.lit(1.0), F.greatest(F.lit(0.05), r[c].cast("double"))) for c in ("width", "height"))
    inside = lambda v, size: F.least(1 - size, F.greatest(F.lit(0.0), v.cast("double")))
    return F.struct(inside(r["x"], w).alias("x"), inside(r["y"], h).alias("y"), w.alias("width"), h.alias("height"))


def dragged_layout(rectangle: Column, others: Column, snap: bool, threshold: float) -> Column:
    """Where a dragged rectangle comes to lie among ``others`` (an array); null where it would overlap one of them.

    With ``snap`` its edges go to the nearest edge of the frame or of another rectangle within the threshold.
    """
    r = normal_rectangle(rectangle)
    if snap:

        def snapped(at: str, size: str) -> Column:
            edges = lambda o: F.array(o[at], o[at] + o[size], o[at] - r[size], o[at] + o[size] - r[size])
            return nearest_snap(r[at], F.concat(F.array(F.lit(0.0), 1 - r[size]), F.flatten(F.transform(others, edges))), threshold)

        r = normal_rectangle(F.struct(snapped("x", "width").alias("x"), snapped("y", "height").alias("y"), r["width"].alias("width"), r["height"].alias("height")))
    return F.when(~F.exists(others, lambda o: rectangles_overlap(r, o)), r)


def merge_graph(clips: DataFrame, width: int, height: int, fps: int = 30, background: str = "black", texts: DataFrame | None = None, audio: DataFrame | None = None, include_audio: bool = True) -> DataFrame:
    """``position``, ``filter``: the filter graph of one composition, a row per filter, in order.

    ``clips``: ``clip`` (number of the input), ``track``, ``start``, ``end`` (on the timeline), ``source_start``, ``has_audio``,
    ``muted``. What is shown in an interval is a layer over the canvas, in the cell of its grid; ``texts`` (``item``,
    ``text``, ``start``, ``duration``, ``x``, ``y``, ``size``) are drawn over that, blank ones left out; the sound of the clips
    and of ``audio`` (``input``, ``start``, ``source_start``, ``source_end``) is delayed and mixed. An input that is shown in
    several intervals is split. Encoding isn't part of this engine. One composition is a small table: its rows are
    numbered in one window.
    """
    w, h = (max(2, v - v % 2) for v in (width, height))
    fps = max(1, min(120, fps))
    spans = elementary_intervals(clips).select("start", "end", F.posexplode("active").alias("cell", "clip"))
    cells = grid_cells(spans.withColumn("interval", F.struct("start", "end")), w, h, "interval", "cell")
    own = clips.select("clip", F.col("start").alias("begins"), F.col("source_start").cast("double").alias("from"))
    cells = cells.join(own, "clip")
    by_clip = W.partitionBy("clip")
    n = F.row_number().over(W.orderBy("start", "cell")) - 1
    s = cells.withColumn("n", n).withColumn("branch", F.row_number().over(by_clip.orderBy("start")) - 1).withColumn("branches", F.count(F.lit(1)).over(by_clip))
    source = F.when(F.col("branches") > 1, F.format_string("[vsrc%d_%d]", F.col("clip").cast("int"), F.col("branch").cast("int"))).otherwise(F.format_string("[%d:v:0]", F.col("clip").cast("int")))
    at = F.col("from") + F.col("start") - F.col("begins")
    trim = F.concat(source, F.format_string(f"trim=start=%.6f:end=%.6f,setpts=PTS-STARTPTS,scale=%d:%d:force_original_aspect_ratio=decrease,pad=%d:%d:(ow-iw)/2:(oh-ih)/2,fps={fps},setsar=1,format=yuv420p,setpts=PTS+%.6f/TB[vseg%d]",
        at, at + F.col("end") - F.col("start"), "cell_width", "cell_height", "cell_width", "cell_height", F.col("start"), F.col("n").cast("int")))
    over = F.format_string("[canvas%d][vseg%d]overlay=x=%d:y=%d:eof_action=pass:shortest=0[canvas%d]", F.col("n").cast("int"), F.col("n").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), (F.col("n") + 1).cast("int"))
    place = lambda part, *order: F.struct(F.lit(part).alias("part"), *[c.cast("double").alias(f"o{i}") for i, c in enumerate((*order, F.lit(0), F.lit(0))[:2])]).alias("at")
    splits = s.where("branches > 1 and branch = 0").select(place(0, F.col("clip")), F.concat(F.format_string("[%d:v:0]split=%d", F.col("clip").cast("int"), F.col("branches").cast("int")),
        F.array_join(F.transform(F.sequence(F.lit(0), F.col("branches").cast("int") - 1), lambda b: F.format_string("[vsrc%d_%d]", F.col("clip").cast("int"), b)), "")).alias("filter"))
    none = clips.sparkSession.createDataFrame([], "item int, text string, start double, duration double, x double, y double, size double")
    t = (texts if texts is not None else none).where(F.trim("text") != "")
    t = t.select("item", F.trim("text").alias("text"), F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0))).alias("begin"), F.greatest(F.lit(0.05), F.coalesce("duration", F.lit(3.0))).alias("duration"),
        *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(d)))).alias(c) for c, d in (("x", 0.5), ("y", 0.82))], F.least(F.lit(240), F.greatest(F.lit(8), F.coalesce("size", F.lit(48.0)).cast("int"))).alias("size"))
    total = total_duration(clips, t.select((F.col("begin") + F.col("duration")).alias("end")))
    layers = s.agg(F.count(F.lit(1)).alias("layers"))
    canvas = total.select(place(1), F.format_string(f"color=c={'white' if background == 'white' else 'black'}:s={w}x{h}:r={fps}:d=%.6f[canvas0]", "duration").alias("filter"))
    t = t.withColumn("k", (F.row_number().over(W.orderBy("item")) - 1).cast("int")).crossJoin(layers)  # one row
    under = F.when(F.col("k") == 0, F.format_string("[canvas%d]", F.col("layers").cast("int"))).otherwise(F.format_string("[text%d]", F.col("k") - 1))
    drawn = F.concat(under, F.lit("drawtext=text='"), T.drawtext_escape("text"), F.format_string("':x=min(max(0\\,w*%.6f-text_w/2)\\,w-text_w):y=min(max(0\\,h*%.6f-text_h/2)\\,h-text_h):fontsize=%d:fontcolor=white:box=1:boxcolor=black@0.45:boxborderw=12:enable='between(t,%.6f,%.6f)'[text%d]",
        "x", "y", "size", "begin", F.col("begin") + F.col("duration"), "k"))
    last = layers.crossJoin(total).crossJoin(t.agg(F.count(F.lit(1)).alias("k")))  # one row each
    shown = F.when(F.col("k") > 0, F.format_string("[text%d]", F.col("k").cast("int") - 1)).otherwise(F.format_string("[canvas%d]", F.col("layers").cast("int")))
    out = [splits, canvas, s.select(place(2, F.col("n"), F.lit(0)), trim.alias("filter")), s.select(place(2, F.col("n"), F.lit(1)), over.alias("filter")), t.select(place(3, F.col("k")), drawn.alias("filter")), last.select(place(4), F.concat(shown, F.format_string("trim=duration=%.6f,format=yuv420p[vout]", "duration")).alias("filter"))]
    sound = clips.where(F.lit(include_audio) & F.coalesce("has_audio", F.lit(False)) & ~F.coalesce("muted", F.lit(False)))
    voices = sound.select(F.lit(0).alias("kind"), F.col("clip").cast("int").alias("input"), F.col("start").cast("double"), F.col("source_start").cast("double"), (F.col("source_start") + F.col("end") - F.col("start")).cast("double").alias("source_end"))
    if audio is not None:
        voices = voices.unionByName(audio.select(F.lit(1).alias("kind"), F.col("input").cast("int").alias("input"), F.col("start").cast("double"), F.col("source_start").cast("double"), F.col("source_end").cast("double")))
    voices = voices.withColumn("v", (F.row_number().over(W.orderBy("kind", "input", "start")) - 1).cast("int"))
    delay = F.greatest(F.lit(0), F.floor(F.col("start") * 1000)).cast("int")
    heard = F.format_string("[%d:a:0]atrim=start=%.6f:end=%.6f,asetpts=PTS-STARTPTS,aresample=48000,aformat=sample_fmts=fltp:channel_layouts=stereo,adelay=%d:all=1[a%d]", "input", "source_start", "source_end", delay, "v")
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.col("voices").cast("int") - 1), lambda v: F.format_string("[a%d]", v)), "")
    mixed = voices.agg(F.count(F.lit(1)).alias("voices")).where("voices > 0").crossJoin(total)  # one row each
    mixed = mixed.select(place(6), F.concat(names, F.format_string("amix=inputs=%d:duration=longest:normalize=0,atrim=duration=%.6f,asetpts=PTS-STARTPTS[aout]", F.col("voices").cast("int"), "duration")).alias("filter"))
    rows = out[0]
    for x in [*out[1:], voices.select(place(5, F.col("v")), heard.alias("filter")), mixed]:
        rows = rows.unionByName(x)
    return rows.select((F.row_number().over(W.orderBy("at")) - 1).alias("position"), "filter")


def filter_graph(intervals: DataFrame, width: int, height: int, fps: int = 30) -> DataFrame:
    """One row: the filter graph text that shows each interval's clips in a grid, one after another.

    ``intervals`` as from ``elementary_intervals``. Encoding itself isn't part of this engine.
    """
    n = F.row_number().over(W.orderBy("start")) - 1  # the intervals of one composition
    parts = F.transform("active", lambda c, i: F.format_string("[%s:v:0]trim=start=%.6f:end=%.6f,setpts=PTS-STARTPTS[v%d_%d]", c.cast("string"), F.col("start"), F.col("end"), F.col("n"), i))
    inputs = F.array_join(F.transform("active", lambda c, i: F.format_string("[v%d_%d]", F.col("n"), i)), "")
    stack = F.format_string(f"%sxstack=inputs=%d,scale={width}:{height},fps={fps}[s%d]", inputs, F.size("active"), F.col("n"))
    single = F.format_string(f"%sscale={width}:{height},fps={fps}[s%d]", inputs, F.col("n"))
    lines = intervals.withColumn("n", n).select("n", F.array_join(F.concat(parts, F.array(F.when(F.size("active") > 1, stack).otherwise(single))), ";").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    tail = F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda k: F.format_string("[s%d]", k)), "")
    return lines.agg(F.concat_ws(";", F.array_join(ordered, ";"), F.format_string("%sconcat=n=%d:v=1:a=0[out]", tail, F.count(F.lit(1)))).alias("graph"))
