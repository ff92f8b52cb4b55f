import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidloom.operators import report, tasks
from vidloom.plans import catalog
from vidloom.sources import caches, files, reports, subtitles


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in (("b.MP4", 10), ("a.mkv", 20), ("note.txt", 5), ("sub/c.mov", 30)):
        (tmp_path / name).write_bytes(b"x" * size)
    df = files.scan_files(spark, str(tmp_path))
    assert [(r.name, r.size_bytes) for r in df.collect()] == [("a.mkv", 20), ("b.MP4", 10), ("c.mov", 30)]
    assert files.scan_files(spark, str(tmp_path), recursive=False).count() == 2
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(tmp_path / "none"), strict=True)
    listed = {r.name: r.error for r in files.explicit_files(spark, [str(tmp_path / "a.mkv"), str(tmp_path / "note.txt"), str(tmp_path / "gone.mp4")]).collect()}
    assert listed == {"a.mkv": None, "note.txt": "unsupported extension", "gone.mp4": "not a file"}


def test_catalogue_and_inventory(spark):
    f = spark.createDataFrame([("/r/x.json", "json", 5, 100), ("/r/x.csv", "CSV", 7, 300), ("/r/y.html", "html", 1, 200), ("/r/z.txt", "txt", 9, 900)], "path string, extension string, size_bytes bigint, modified_at_ms bigint")
    got = [(r.report_key, r.size_bytes, r.formats, r.path) for r in files.report_catalogue(f).collect()]
    assert got == [("x", 12, ["csv", "json"], "/r/x.json"), ("y", 1, ["html"], "/r/y.html")]
    inv = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 4)], "category string, name string, size_bytes bigint")
    total = [r for r in files.inventory(inv).collect() if r.level == 3]
    assert total[0].size_bytes == 7 and total[0].entries == 3


def test_probes(spark):
    text = "Duration: 00:01:02.50, start\n Stream #0:0: Video: h264, yuv420p, 1920x1080 [SAR]\n Stream #0:1: Audio: aac"
    r = files.probe_durations(spark.createDataFrame([("v", text), ("w", "")], "video string, text string")).collect()
    assert (r[0].duration, r[0].width, r[0].height, r[0].has_audio) == (62.5, 1920, 1080, True) and r[1].duration == 0.01
    p = spark.createDataFrame([(10, 1.0, 2.0, 5), (0, 2.0, 25.0, 5), (None, None, None, 7), (None, 0.0, 0.0, None)], "nb_frames int, duration double, fps double, decoder_frames int")
    assert [x.frame_count for x in files.frame_counts(p).collect()] == [10, 50, 7, 1]


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500 align:start\r\n<i>Hello</i> there\r\n\r\n2\r\n00:00:05,000 --> 00:00:04,000\r\nwrong\r\n\r\n3\r\n00:00:06.000 --> 00:00:07.0\r\n\r\n"
ASS = "[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.00,{\\b1}One\\Ntwo, three\nFormat: Text, Start, End\nDialogue: Only,0:01:00.5,0:01:01.0\nDialogue: x,bad,0:00:01.0"


def test_subtitles(spark):
    df = spark.createDataFrame([(1, SRT, "srt"), (2, "WEBVTT x\n\n00:01.000 --> 00:02.000\nHi\n", "vtt"), (3, ASS, "ass"), (4, None, "srt"), (5, "", "ssa")], "doc_id int, text string, extension string")
    got = sorted((r.doc_id, r.start, r.end, r.text) for r in subtitles.subtitle_cues(df).collect())
    assert got == [(1, 1.0, 2.5, "Hello there"), (2, 1.0, 2.0, "Hi"), (3, 1.0, 2.0, "One\ntwo, three"), (3, 60.5, 61.0, "Only")]


def pair(a, b, **more):
    return {"video_a": a, "video_b": b, "video_a_path": f"/v/{a}", "video_b_path": f"/v/{b}", "a_in_b": 0.9, "b_in_a": 0.95, "symmetric_similarity": 0.925, "relation": "unknown", "matched_segment_count": 1} | more


def test_report_round_trip(spark, tmp_path):
    doc = {"timestamp": "2024-01-01", "num_pairs": 2, "video_pairs": [pair("a", "b", segments=[{"source_start": 1, "source_end": 2, "confidence": 0.5}], matches_a_to_b=[{"source_frame_index": 1, "similarity": 0.9}], windows_a_to_b=[{"source_start": 0, "source_end": 30}], windows=[{"direction": "A_to_B", "source_start": 0, "source_end": 30}]), pair('c "x", <y>', "d", symmetric_similarity=0.99)]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (tmp_path / "one.json").write_text(json.dumps(pair("e", "f")))
    (tmp_path / "bad.json").write_text("{")
    p = reports.read_json(spark, str(tmp_path / "r.json"))
    assert [r.pair_id for r in p.collect()] == [0, 1] and reports.read_json(spark, str(tmp_path / "one.json")).first().video_a == "e"
    assert reports.pair_segments(p).first().a_start == 1 and reports.pair_windows(p).count() == 1 and reports.pair_matches(p).first().direction == "A_to_B"
    reports.write_csv(p, str(tmp_path / "csv"), with_paths=True)
    back = reports.read_report(spark, str(tmp_path / "bad.json"), str(tmp_path / "csv"))
    assert {r.video_a for r in back.collect()} == {"a", 'c "x", <y>'}
    with pytest.raises(ValueError):
        reports.read_report(spark, str(tmp_path / "bad.json"))
    n = report.normalize_pairs(p)
    assert {r.relation for r in n.collect()} == {"near_duplicate_or_same_content"}
    reports.write_html(n, str(tmp_path / "html"))
    html = [r.value for r in spark.read.text(str(tmp_path / "html")).collect()]
    assert any("c &quot;x&quot;, &lt;y&gt;" in x for x in html)
    reports.write_json(p, str(tmp_path / "out"), "2024-01-02", ["w"])
    assert reports.read_json(spark, str(tmp_path / "out")).count() >= 1
    found = spark.createDataFrame([("x", 0.5), ("y", 0.75)], "name string, similarity double")
    assert [r.text for r in reports.search_results(found, "q").orderBy("rank").collect()] == ["1. y (score: 0.7500)", "2. x (score: 0.5000)"]


def test_feature_cache(spark, tmp_path):
    f = spark.createDataFrame([("/V/a", 10, 0.9, [1.0]), ("/v/b", 20, 0.9, [2.0])], "path string, size bigint, skip_threshold double, embedding array<double>")
    caches.write_features(f, str(tmp_path / "c"), F.lit("k1"))
    cached = caches.read_features(spark, str(tmp_path / "c"), "k1")
    want = spark.createDataFrame([("/v/A/", 10, 0.9000001), ("/v/b", 21, 0.9)], "path string, size bigint, skip_threshold double")
    fresh = caches.fresh_features(cached, want)
    assert [r.path for r in fresh.collect()] == ["/V/a"] and [r.path for r in caches.missing_videos(want, fresh).collect()] == ["/v/b"]
    np.savez(tmp_path / "x.npz", video_path="v", frame_indices=[0, 5], timestamps=[0.0, 1.0], phashes=["00", "ff"], embeddings=np.eye(2, dtype=np.float32))
    (tmp_path / "broken.npz").write_bytes(b"no")
    assert [(r.frame_index, r.embedding) for r in caches.read_npz(spark, str(tmp_path)).orderBy("frame_pos").collect()] == [(0, [1.0, 0.0]), (5, [0.0, 1.0])]
    (tmp_path / "names.txt").write_text("a\n\nb\n")
    assert [(r.position, r["name"]) for r in caches.read_names(spark, str(tmp_path / "names.txt")).collect()] == [(0, "a"), (2, "b")]


def test_pair_store(spark, tmp_path):
    r = spark.createDataFrame([("a", 1), ("b", 1)], "pair_key string, v int")
    caches.append_pairs(r, str(tmp_path / "s"), "sig", 1)
    caches.append_pairs(r.where("pair_key = 'a'").withColumn("v", F.lit(2)), str(tmp_path / "s"), "sig", 2)
    assert {(x.pair_key, x.v) for x in caches.read_pairs(spark, str(tmp_path / "s"), "sig").collect()} == {("a", 2), ("b", 1)}
    rows = spark.createDataFrame([("a", "{}", "s"), ("b", "no", "s"), ("c", "{}", "t")], "pair_key string, pair_json string, signature string")
    old = spark.createDataFrame([("a", '{"v": 1}')], "pair_key string, pair_json string")
    assert [(x.pair_key, x.pair_json) for x in caches.load_states(rows, old, "s").collect()] == [("a", '{"v": 1}')]
    assert tasks.richest_state(spark.createDataFrame([("x", "s", "a"), ("y", "s", "a"), ("y", "s", "b")], "state string, signature string, pair_key string"), "s").count() == 2


def test_streams(spark, tmp_path):
    from vidloom.streaming import incremental, stateful

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    for n, part in enumerate(([("u", i, "", "Invalid NAL unit size") for i in range(60)], [("u", 60 + i, "", "Invalid NAL unit size") for i in range(60)] + [("u", 200, "ctx", "")])):
        spark.createDataFrame(part, "stream string, line_no bigint, marker string, line string").withColumn("marker", F.nullif("marker", F.lit(""))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream string, line_no bigint, marker string, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run_available(stateful.warning_stream(src, "string"), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted((r.kind, r.invalid_nal) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("final", 120), ("running", 100)]
    incremental.route_lines(src, str(tmp_path / "routed"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "routed")).count() == 121


def test_incremental_pairs_are_compared_once(spark, tmp_path):
    from vidloom.streaming import incremental

    seen = []

    def compare(df):
        seen.append(df.count())
        return df.withColumn("score", F.lit(1.0))

    def feed(keys):
        spark.createDataFrame([(k,) for k in keys], "pair_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pairs"))
        src = spark.readStream.schema("pair_key string").parquet(str(tmp_path / "pairs"))
        incremental.process_new_pairs(src, compare, str(tmp_path / "store"), "s", str(tmp_path / "cp"))

    feed(["a", "b"])
    feed(["b", "c"])
    assert seen == [2, 1] and sorted(r.pair_key for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b", "c"]


def test_registry():
    import importlib.util

    names = catalog.queries()
    assert "containment_relation" in names and set(catalog.oracle_sql()) <= set(names)
    import __spark_entry__

    assert set(names) <= set(__spark_entry__.queries()) and (importlib.util.find_spec("vidloom.llm") is None or "p1_found" in __spark_entry__.queries())
