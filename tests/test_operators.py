import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidloom.operators import candidates, duplicates, embed, logs, offsets, periods, report, sampling, scan, similarity, tasks, timeline
from vidloom.plans import analyze, presets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Periods


def brute_periods(items):
    out = []
    for key in {k for k, *_ in items}:
        spans = sorted((s, e) for k, s, e in items if k == key and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged] + [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 7, 50, 10_000])
def test_periods_equal_brute_force(spark, shard):
    rng = random.Random(shard)
    items = [(rng.choice(["x", "y", None]), s := rng.randint(-60, 200), s + rng.choice([-1, 0, 1, 2, 5, 30, 90])) for _ in range(300)]
    items += [("x", None, 3), ("x", 3, None), ("z", 5, 5)] + items[:20]
    df = spark.createDataFrame(items, "k string, s bigint, e bigint").withColumn("kind", F.lit("clash"))
    assert rows(periods.periods_and_gaps(df, ["k"], "s", "e", shard)) == brute_periods(items)


def test_periods_of_an_entity_that_covers_shards_whole(spark):
    items = [(1, 0, 1000), (1, 3, 4), (1, 1000, 1010), (1, 2000, 2001), (1, 2500, 9999), (1, 5000, 5001)]
    assert rows(periods.periods_and_gaps(spark.createDataFrame(items, "k int, s bigint, e bigint"), ["k"], "s", "e", 10)) == brute_periods(items)


def test_periods_of_nothing(spark):
    assert periods.periods_and_gaps(spark.createDataFrame([], "k int, s bigint, e bigint"), ["k"], "s", "e").count() == 0


def test_whole_ms(spark):
    got = [r[0] for r in spark.createDataFrame([(1.2346,), (math.nan,), (None,), (1e300,)], "x double").select(periods.whole_ms("x")).collect()]
    assert got == [1235, None, None, None]


# Offsets


def brute_clusters(offsets_, tol):
    out, total, n, part = [], 0.0, 0, -1
    for o in sorted(offsets_):
        if n and abs(o - total / n) <= tol:
            total, n = total + o, n + 1
        else:
            total, n, part = o, 1, part + 1
        out.append((o, part))
    return out


def match_frame(spark, offs, total=10):
    data = [("a", i, float(i), i + o, i, 0.5 + i / 1000, total) for i, o in enumerate(offs)]
    return spark.createDataFrame(data, "k string, src int, src_ts double, tgt_ts double, tgt int, sim double, total int")


@pytest.mark.parametrize("tol", [0.3, 1.0, 3.0])
def test_offset_clusters_equal_a_running_mean_fold(spark, tol):
    rng = random.Random(4)
    offs = [round(rng.uniform(0, 40), 1) for _ in range(300)]
    got = offsets.offset_clusters(match_frame(spark, offs), ["k"], tol).select("offset", "cluster").collect()
    assert sorted((r.offset, r.cluster) for r in got) == sorted(brute_clusters([round(i + o - i, 6) for i, o in enumerate(offs)], tol))


def test_segments_of_one_and_two_offsets(spark):
    one = offsets.segments(match_frame(spark, [5.0] * 6), ["k"]).collect()
    assert len(one) == 1 and one[0].match_count == 6 and one[0].duration == 5 and one[0].target_start == 5
    two = offsets.segments(match_frame(spark, [5.0] * 6 + [20.0] * 6), ["k"]).collect()
    assert len(two) == 2
    assert offsets.segments(match_frame(spark, [5.0] * 4), ["k"]).count() == 0
    assert offsets.segments(match_frame(spark, [5.0, 5.0]), ["k"], min_duration=0).count() == 0


def test_mirrored_segments_count_once(spark):
    data = [("a", i, float(i), i + 0.0, i, 0.9, 10) for i in range(7)] * 2
    assert offsets.segments(spark.createDataFrame(data, "k string, src int, src_ts double, tgt_ts double, tgt int, sim double, total int"), ["k"]).count() == 1


def test_coverage(spark):
    c = lambda offs, total: offsets.temporal_coverage(match_frame(spark, offs, total), ["k"], "total").first().coverage
    assert c([5.0] * 6, 12) == 0.5
    assert c([5.0] * 6 + [50.0] * 3, 12) == 0.5
    assert c([0.0, 100.0, 200.0, 300.0], 12) == 0.0
    assert c([5.0] * 6, 0) == 0.0 and c([5.0] * 6, 3) == 1.0
    assert offsets.temporal_coverage(match_frame(spark, []), ["k"], "total").count() == 0


def test_windows_are_gap_free(spark):
    data = [("a", 1, 10.0, 1.0, 1, 0.5), ("a", 2, 75.0, 9.0, 1, 0.7), ("a", 3, 70.0, 4.0, 1, 0.9)]
    df = spark.createDataFrame(data, "k string, src int, src_ts double, tgt_ts double, tgt int, sim double")
    w = sorted(offsets.fixed_windows(df, ["k"], 30.0).collect(), key=lambda r: r.window)
    assert [(r.source_start, r.matched_frame_count) for r in w] == [(10, 1), (40, 0), (70, 2)]
    assert w[1].avg_similarity == 0 and w[2].best_target_end == 9
    single = offsets.fixed_windows(df.where("src = 1"), ["k"], 30.0).collect()
    assert len(single) == 1 and single[0].source_end == 40
    longer = df.withColumn("d", F.lit(130.0))
    assert offsets.fixed_windows(longer, ["k"], 30.0, "d").count() == 4


# Similarity


def frames_of(spark, videos):
    data = [(v, i, i * 0.5, [float(x) for x in e]) for v, es in videos.items() for i, e in enumerate(es)]
    return spark.createDataFrame(data, "video_id string, frame_pos bigint, ts double, embedding array<double>")


def test_pair_similarities_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vids = {"a": rng.normal(size=(30, 8)), "b": rng.normal(size=(17, 8)), "c": np.zeros((2, 8))}
    frames = frames_of(spark, vids)
    got = similarity.pair_similarities(similarity.frame_blocks(frames, block=7), similarity.all_pairs(frames), 3)
    have = {(r.a, r.b, r.direction, r.src, r["rank"]): (r.tgt, r.sim) for r in got.collect()}
    unit = {k: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1) for k, v in vids.items()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        for d, x, y in (("A_to_B", a, b), ("B_to_A", b, a)):
            s = np.round(unit[x] @ unit[y].T, 6)
            for i in range(len(s)):
                want = sorted(((-v, j) for j, v in enumerate(s[i])))[:3]
                assert [have[a, b, d, i, r + 1] for r in range(len(want))] == [(j, -v + 0.0) for v, j in want]


def test_scenarios_of_whole_videos(spark):
    rng = np.random.default_rng(7)
    base, other = rng.normal(size=(20, 32)), rng.normal(size=(20, 32))
    vids = {"same1": base, "same2": base.copy(), "clip": base[5:15], "noise": other, "half": np.concatenate([base[:10], rng.normal(size=(10, 32))])}
    a = analyze.analyze(frames_of(spark, vids), presets.Preset(candidate_limit=0))
    got = {(r.a, r.b): r for r in a.pairs.collect()}
    assert got["same1", "same2"].relation == "near_duplicate_or_same_content" and got["same1", "same2"].a_in_b == 1
    assert got["clip", "same1"].relation == "A_is_likely_clip_of_B"
    assert got["noise", "same1"].relation == "different"
    assert got["half", "same1"].relation == "partial_overlap" and got["half", "same1"].a_in_b == 0.5
    assert a.segments.where("a = 'same1' and b = 'same2'").count() >= 1 and a.windows.count() > 0


def test_early_stop_skips_the_larger_side(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 64))
    frames = frames_of(spark, {"a": rng.normal(size=(5, 64)), "b": base, "c": base[:4] + 0.1})
    blocks, pairs = similarity.frame_blocks(frames, block=3), similarity.all_pairs(frames)
    s = similarity.pair_similarities(blocks, pairs, 2)
    early = similarity.early_stopped_similarities(blocks, pairs, 2, 0.65)
    have, every = set(rows(early)), set(rows(s))
    assert have < every and {(r[0], r[1], r[2]) for r in every - have} == {("a", "b", "B_to_A"), ("a", "c", "A_to_B")}
    best = [max(r.sim, 0) for r in s.where("rank = 1 and a = 'a' and b = 'b' and direction = 'A_to_B'").collect()]
    assert similarity.raw_stats(early).where("a = 'a' and b = 'b'").first().raw_p95 == pytest.approx(np.percentile(best, 95))
    few = similarity.pair_similarities(blocks, pairs, 2, least=0.65)
    assert rows(few.where("sim >= 0.65")) == rows(s.where("sim >= 0.65")) and few.where("rank = 1").count() == s.where("rank = 1").count()


def test_vectors_of_different_lengths(spark):
    bad = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [1.0])], "video_id string, frame_pos int, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        similarity.frame_blocks(bad).count()
    with pytest.raises(Exception, match="different lengths"):
        similarity.mean_vector(bad, ["video_id"]).count()


def test_mean_vectors_of_many_batches(spark):
    data = [(k, [float(i), float(-i)]) for k in ("x", None, "y") for i in range(300)] + [("x", None), ("x", []), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(data, "k string, embedding array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: list(r.mean_vector) for r in similarity.mean_vector(df, ["k"], normalize=False).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"x": [149.5, -149.5], None: [149.5, -149.5], "y": [149.5, -149.5], "z": [0.0, 0.0]}


def test_search_equals_sorting(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(400, 8)).round(1)
    e[50] = e[20]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(e)] + [(900, None), (901, []), (None, [1.0] * 8), (902, [1.0] * 9), (3, [float(x) for x in e[3]])]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>").withColumn("owner", F.lit("clash"))
    got = {}
    for r in similarity.search_top_k(df, df.where("vec_id < 30 or vec_id = 902"), 4, block=8).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.vec_id
    u = e.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert got.pop(902) == {1: 902}
    assert got == {i: dict(enumerate(sorted(range(400), key=lambda j: (-s[i, j], j))[:4], 1)) for i in range(30)}


def test_media_durations(spark):
    f = spark.createDataFrame([("a", 0, 3.0, 0.0, 9.5), ("a", 1, 4.0, None, None), ("b", 0, 2.0, -1.0, None), ("c", 0, None, None, math.nan)], "video_id string, frame_pos int, ts double, duration_sec double, retained_duration_sec double")
    assert rows(analyze.video_facts(f)) == [("a", 2, 9.5), ("b", 1, 2.0), ("c", 1, 0.0)]


def test_vector_statistics(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(12, 6))
    frames = frames_of(spark, {"a": e})
    s = similarity.embedding_stats(frames).first()
    n = np.linalg.norm(e, axis=1)
    assert (s.num_embeddings, s.embedding_dim) == (12, 6) and s.std_norm == pytest.approx(n.std())
    u = e / n[:, None]
    g = u @ u.T
    assert similarity.diversity(frames).first().mean_similarity == pytest.approx((g.sum() - 12) / 132)
    m = e.mean(axis=0)
    assert similarity.mean_vector(frames, ["video_id"]).first().mean_vector == pytest.approx(m / np.linalg.norm(m))


def test_candidates(spark):
    x, y, z = np.eye(4)[0], np.eye(4)[1], np.eye(4)[2]
    vids = {"a": [x, x, x, y, y, y], "b": [x, x, x, z, z, z], "c": [-x, -x, -y, -y, -z, -z]}
    frames = frames_of(spark, vids)
    assert rows(candidates.candidate_pairs(frames, 1, 0.8, 1, 1)) == [("a", "b")]
    assert len(rows(candidates.candidate_pairs(frames, 0, 0.8))) == 3 and len(rows(candidates.candidate_pairs(frames, 2, 0.8))) == 3


def test_candidates_by_forest_equal_exact_ones(spark):
    rng = np.random.default_rng(8)
    base = [rng.normal(size=(12, 16)) for _ in range(12)]
    vids = {f"v{i:02}": np.concatenate([base[i], base[i - 1][:6] + 0.05 * rng.normal(size=(6, 16))]) for i in range(12)}
    frames = frames_of(spark, vids)
    exact = rows(candidates.candidate_pairs(frames, 2, 0.8, method="exact"))
    assert rows(candidates.candidate_pairs(frames, 2, 0.8, method="forest", window=400)) == exact
    close = rows(candidates.candidate_pairs(frames, 2, 0.8, method="forest", window=40))
    assert {(f"v{i:02}", f"v{i + 1:02}") for i in range(11)} <= set(close) and len(set(close) & set(exact)) >= 0.7 * len(exact)


def test_candidates_are_exact_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [rng.normal(size=(12, 16)) for _ in range(12)]
    frames = frames_of(spark, {f"v{i:02}": np.concatenate([base[i], base[i - 1][:6] + 0.05 * rng.normal(size=(6, 16))]) for i in range(12)})
    whole = rows(candidates.candidate_pairs(frames, 2, 0.8, method="exact"))
    monkeypatch.setattr(candidates, "TILE", 100)
    assert rows(candidates.candidate_pairs(frames, 2, 0.8, block=30)) == whole
    with pytest.raises(ValueError):
        candidates.candidate_pairs(frames, 2, 0.8, method="auto")


def test_even_positions(spark):
    df = spark.createDataFrame([("a", 10), ("b", 2), ("c", 1)], "video_id string, n int")
    got = rows(candidates.even_positions(df, 4))
    assert [p for v, p in got if v == "a"] == [int(i) for i in np.linspace(0, 9, 4).astype(int)]
    assert [p for v, p in got if v == "b"] == [0, 1] and [p for v, p in got if v == "c"] == [0]


def test_embedder(spark):
    f = np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    df = spark.createDataFrame([("v", 1, bytearray(f.tobytes()), 20, 30), ("v", 2, None, 20, 30)], "video_path string, n int, pixels binary, height int, width int")
    got = {r.n: r.embedding for r in embed.embed_frames(df).collect()}
    assert got[2] is None and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)


# Sampling


def test_dynamic_sampling(spark):
    data = [("a", i, 0, 5) for i in range(12)] + [("b", 0, 0, 100), ("b", 1, -1, 100), ("b", 2, -1, 100), ("b", 3, 0, 100), (None, 1, 1, 1), ("c", None, 1, 1)]
    df = spark.createDataFrame(data, "v string, i bigint, h bigint, g int")
    assert rows(sampling.dynamic_sample(df, "v", "i", "h", "g").select("v", "i")) == [("a", 0), ("a", 10), ("a", 5), ("b", 0), ("b", 1), ("b", 3)]


def test_farthest_points():
    e = np.array([[1, 0], [0.99, 0.1], [0, 1], [-1, 0], [0.98, 0.2]], dtype=float)
    assert list(sampling.farthest_points(e, 3)) == [0, 2, 3]
    assert list(sampling.farthest_points(e[:2], 3)) == [0, 1]


# Duplicates


def test_duplicates(spark):
    data = [(1, 3, "abc"), (2, 3, "abc"), (3, 3, "xyz"), (4, 0, ""), (5, 0, ""), (6, None, None), (7, 3, "abc"), (7, 3, "abc"), (None, 3, "abc")]
    df = spark.createDataFrame(data, "id int, n int, c string")
    assert [tuple(r)[1:] for r in duplicates.duplicate_groups(df, "id", "n", "c").collect()] == [(3, 1, 6)]
    assert [p[1:3] for p in rows(duplicates.duplicate_pairs(df, "id", "n", "c"))] == [(1, 2), (1, 7), (2, 7)]
    assert [p[1:3] for p in rows(duplicates.duplicate_pairs(df, "id", "n", "c", most=2))] == [(1, 2), (1, 7)]
    assert sorted(r.id for r in duplicates.redundant_copies(df, "id", "n", "c").collect()) == [2, 7]


# Scans


def test_scan_filter_and_sort(spark):
    v = spark.createDataFrame([("/a/Clip 10.MP4", "Clip 10.MP4", "MP4", 5 << 20, 5), ("/a/clip 2.mkv", "clip 2.mkv", "mkv", 9 << 20, 1), ("/a/x.mov", "x.mov", ".mov", None, 3)], "path string, name string, extension string, size_bytes bigint, modified_at_ms bigint")
    m = spark.createDataFrame([("/A/clip 10.mp4/", True, 60.0, 25.0, 100, 50), ("/a/x.mov", False, 0.0, 0.0, 0, 0)], "path string, readable boolean, duration double, fps double, width int, height int")
    names = lambda df: [r.name for r in df.collect()]
    f = scan.ScanFilter(frozenset({"size", "name"}), min_size=6, size_unit="mb", name_prefixes="clip")
    assert names(scan.filter_scan(v, f)) == ["clip 2.mkv"]
    assert sorted(names(scan.filter_scan(v, scan.ScanFilter(frozenset({"extension"}), extensions="MOV,.mp4")))) == ["Clip 10.MP4", "x.mov"]
    assert names(scan.filter_scan(v, scan.ScanFilter(frozenset({"duration"}), min_duration=1, duration_unit="minute"), m)) == ["Clip 10.MP4"]
    assert len(names(scan.filter_scan(v, scan.ScanFilter(min_size=5)))) == 3
    assert names(scan.sort_scan(v)) == ["clip 2.mkv", "Clip 10.MP4", "x.mov"]
    j = scan.join_metadata(v, m)
    assert names(scan.sort_scan(j, "duration")) == names(scan.sort_scan(j, "duration", True))


# Timeline


def test_intervals_and_points(spark):
    clips = spark.createDataFrame([(1, 0, 0.0, 10.0), (2, 1, 5.0, 8.0), (3, 0, 12.0, 13.0), (4, 0, None, 3.0)], "clip int, track int, start double, end double")
    got = [(r.start, r.end, list(r.active)) for r in sorted(timeline.elementary_intervals(clips).collect(), key=lambda r: r.start)]
    assert got == [(0, 5, [1]), (5, 8, [1, 2]), (8, 10, [1]), (12, 13, [3])]
    assert [r.clip for r in timeline.active_at(clips, 5.0).collect()] == [1, 2] and timeline.active_at(clips, 10.0).count() == 0
    graph = timeline.filter_graph(timeline.elementary_intervals(clips), 640, 360).first().graph
    assert graph.endswith("[s0][s1][s2][s3]concat=n=4:v=1:a=0[out]") and "xstack=inputs=2" in graph


def test_sequential_placement(spark):
    c = spark.createDataFrame([("t", 1, None, 2.0), ("t", 2, 10.0, 1.0), ("t", 3, None, 1.0), ("t", 4, 0.0, 1.0), ("t", 5, None, 0.0), ("u", 1, -3.0, 1.0)], "track string, clip int, requested double, duration double")
    got = {(r.track, r.clip): r.start for r in timeline.sequential_starts(c).collect()}
    assert got == {("t", 1): 0.0, ("t", 2): 10.0, ("t", 3): 11.0, ("t", 4): 0.0, ("t", 5): 12.0, ("u", 1): 0.0}


def test_snapping(spark):
    r = spark.range(1).select(timeline.nearest_snap(F.lit(0.52), F.array(F.lit(0.5), F.lit(0.55)), 0.05), timeline.nearest_snap(F.lit(0.7), F.array(F.lit(0.5)), 0.05)).first()
    assert list(r) == [0.5, 0.7]


# Logs


def test_stream_validation(spark):
    lines = [("a", i, "[h264] Invalid NAL unit size (1 > 0).") for i in range(6)] + [("b", i, "missing picture in access unit") for i in range(19)]
    lines += [("c", 0, "moov atom not found"), ("c", 1, "Invalid NAL unit size"), ("d", 0, "  "), ("e", 0, "fine")]
    df = spark.createDataFrame(lines, "video string, line_no int, line string")
    got = {r.video: r for r in logs.validate_streams(df, "strict").collect()}
    assert got["a"].severe == 5 and "5 severe" in got["a"].verdict
    assert got["b"].verdict is None and got["b"].missing == 19 and got["c"].verdict == "moov atom not found" and got["c"].severe == 0
    assert "d" not in got and got["e"].verdict is None
    assert all(r.verdict is None for r in logs.validate_streams(df.where("video <> 'c'"), "failure_only").collect())
    assert {r.video for r in logs.validate_streams(df, "strict", severe_limit=0).where("verdict is not null").collect()} == {"c"}


def test_warning_summaries(spark):
    lines = [(1, i, "Invalid NAL unit size", "x", 1) for i in range(1203)] + [(1, 5000 + i, "missing picture in access unit", "y", 2) for i in range(50)] + [(2, i, "other", None, 0) for i in range(20)]
    df = spark.createDataFrame(lines, "stream int, line_no int, line string, context string, episode int")
    got = rows(logs.warning_summaries(df).select("stream", "episode", "kind", "total"))
    assert got == [(1, 1, "final", 1203), (1, 1, "running", 100), (1, 1, "running", 1000), (2, 0, "final", 20)]


def test_router_and_filters(spark):
    lines = ["ANALYSIS_VIDEO_CONTEXT|{}", "[h264 @ 1] x", "PROGRESS|scan|1|2|m", "Key x", "Error: Key", "", "plain"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(logs.route("line")).collect()] == ["context", "warning", "progress", "hidden", "log", "hidden", "log"]


# Tasks and reports


def test_task_stages(spark):
    s = spark.createDataFrame([("t", "scan", 12.0, "completed", 100.0), ("t", "cache", 8.0, "running", 50.0)], "task string, id string, weight double, status string, progress double")
    merged = tasks.merge_stages(s)
    assert merged.count() == 6 and tasks.next_stage(merged).first().next_stage == "cache"
    assert tasks.weighted_progress(merged, ["task"]).first().progress == 16.0
    assert tasks.blocking_stages(merged, "features").first().blocking == ["cache"]
    assert tasks.reset_from(merged, "scan").where("status = 'pending'").count() == 6
    e = spark.createDataFrame([("t", "scan", i, at, st, 10.0) for i, (at, st) in enumerate([(0, "running"), (5, "running"), (10, "paused"), (20, "running"), (25, "completed")])], "task string, stage string, seq int, at_ms bigint, status string, progress double")
    r = tasks.replay_stages(e).first()
    assert (r.status, r.progress, r.elapsed_ms) == ("completed", 100.0, 15)


def test_resume(spark):
    store = spark.createDataFrame([("a", "s", 1, "old"), ("a", "s", 2, "new"), ("b", "other", 1, "x")], "pair_key string, signature string, version int, v string")
    cand = spark.createDataFrame([("a",), ("b",), ("c",)], "pair_key string")
    assert sorted(r.pair_key for r in tasks.pending_pairs(cand, store, "s").collect()) == ["b", "c"]
    assert [r.v for r in tasks.resumed_pairs(cand, store, "s").collect()] == ["new"]
    n = spark.createDataFrame([("x", 1), ("x", 2), ("x", 4), ("y", 2)], "k string, n int")
    assert rows(tasks.smallest_unused(n, ["k"])) == [("x", 3), ("y", 1)]
    old = spark.createDataFrame([("/A", 1, 1), ("/b", 1, 1)], "path string, size int, mtime_ms int")
    new = spark.createDataFrame([("/a/", 1, 1), ("/c", 1, 1)], "path string, size int, mtime_ms int")
    assert tasks.inputs_changed(old, new).first()[:] == (1, 1, True) and not tasks.inputs_changed(old.limit(0), new).first().changed


def test_report_reader(spark):
    data = [(0, "A", "B", "/x/a", "/x/b", 90.0, 0.2, 0.55, "unknown", 3), (1, "B", "A", "/X/B/", "\\x\\a", 0.9, 0.2, None, "a_contains_b", 5), (2, "C 10", "D", None, None, None, math.nan, None, None, None)]
    df = spark.createDataFrame(data, "pair_id int, video_a string, video_b string, video_a_path string, video_b_path string, a_in_b double, b_in_a double, symmetric_similarity double, relation string, matched_segment_count int")
    n = report.normalize_pairs(df)
    got = {r.pair_id: r for r in n.collect()}
    assert got[0].a_in_b == 0.9 and got[0].relation == "A_is_likely_clip_of_B" and got[2].relation == "unknown" and got[2].pair_key == "c 10||d"
    assert {r.pair_id for r in report.dedupe_pairs(n).collect()} == {1, 2}
    s = report.summarize_pairs(n).first()
    assert (s.pairs, s.segments, s.partial_pairs) == (3, 8, 2)
    assert [r.pair_id for r in report.page(report.sort_pairs(n), 9, 2).collect()] == [2]
    assert report.page_numbers(5, 9) == [4, 5, 6] and report.page_numbers(1, 2) == [1, 2]
    assert {r.pair_id for r in report.filter_pairs(n, "clip").collect()} == {0, 1} and report.filter_pairs(n, query="c 1").count() == 1
    gone = spark.createDataFrame([("/x/B", "/x/A")], "video_a_path string, video_b_path string")
    assert [r.pair_id for r in report.delete_pairs(n, gone).collect()] == [2]
    with pytest.raises(ValueError):
        report.delete_pairs_checked(n, gone.where("false"))


def test_presets():
    p = presets.Preset(match_threshold=0.1, candidate_limit=-3, frame_step=0).clamped()
    assert (p.match_threshold, p.candidate_limit, p.frame_step) == (0.3, 0, 1)
    assert presets.Preset().signature() != presets.Preset(early_stop=False).signature() and set(presets.PRESETS) == {"ultra_fast", "fast", "normal", "precise", "perfect"}
