import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidloom.operators import embed, logs, report, tasks, timeline
from vidloom.operators.running import running
from vidloom.sources import caches, documents, files, profiles


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_running_values_cross_partitions(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 2, 5]), rng.choice([None, None, "x", "y"])) for i in range(400)]
    want, state = [], {}
    for k, i, n, m in data:
        s, top, last, before = state.get(k, (None, None, None, None))
        s = s if n is None else (s or 0) + n
        top = n if top is None or (n is not None and n > top) else top
        want.append((k, i, s, top, m or last, before))
        state[k] = (s, top, m or last, n)
    df = spark.createDataFrame(random.Random(1).sample(data, 400), "k string, i int, n bigint, m string")
    got = running(df, ["k"], ["i"], {"s": F.col("n")}, {"top": F.col("n")}, {"last": F.col("m")}, {"before": F.col("n")}, parts=7)
    assert sorted((tuple(r) for r in got.select("k", "i", "s", "top", "last", "before").collect()), key=repr) == sorted(want, key=repr)
    assert running(df.limit(0), ["k"], ["i"], {"s": F.col("n")}).count() == 0
    with pytest.raises(ValueError):
        running(df, ["k"], ["i"], {"n": F.col("n")})


def test_context_and_quarantine_lines(spark):
    lines = ['ANALYSIS_VIDEO_CONTEXT|{"path": "/a.mp4", "phase": "decode"}', 'ANALYSIS_VIDEO_CONTEXT|{"path": " ", "phase": "x"}', "ANALYSIS_VIDEO_CONTEXT|{broken", "plain"]
    lines += [' ANALYSIS_VIDEO_QUARANTINED|{"originalPath": "/a", "destinationPath": "/q/a", "remainingVideos": 3, "removedVideos": 1, "moved": true}', 'ANALYSIS_VIDEO_QUARANTINED|{"originalPath": "/a"}', None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", logs.parse_context("line").alias("c"), logs.parse_quarantined("line").alias("q")).orderBy("i").collect()
    assert [(r.c and tuple(r.c)) for r in got] == [("/a.mp4", "decode"), None, None, None, None, None, None]
    assert [(r.q and tuple(r.q)) for r in got] == [None] * 4 + [("/a", "/q/a", 3, 1, True), None, None]


def test_progress_of_a_comparison(spark):
    data = [("A_to_B", 5, 10, 10, 20), ("B_to_A", 5, 20, 10, 20), ("A_to_B", 5, 30, 30, 20), ("B_to_A", 99, 20, 30, 20), ("B_to_A", None, None, None, 0)]
    df = spark.createDataFrame(data, "d string, done int, total int, a int, b int")
    got = df.select(tasks.comparison_progress(*[F.col(c) for c in df.columns]).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(5, 30, "A to B"), (15, 30, "B to A"), (25, 50, "A to B"), (20, 50, "B to A"), (1, 2, "B to A")]


def test_a_task_with_other_files_starts_anew(spark):
    stages = spark.createDataFrame([(t, "scan", 12.0, "completed", 100.0) for t in ("same", "other", "fresh")], "task string, id string, weight double, status string, progress double")
    schema = "task string, path string, size int, mtime_ms int"
    old = spark.createDataFrame([("same", "/a", 1, 1), ("other", "/a", 1, 1)], schema)
    new = spark.createDataFrame([("same", "/a", 1, 1), ("other", "/a", 2, 1), ("fresh", "/a", 1, 1), ("new", "/z", 1, None)], schema)
    got = {(r.task, r.id): (r.status, r.changed) for r in tasks.activate(stages, old, new).collect()}
    assert len(got) == 24 and got["same", "scan"] == ("completed", False) and got["other", "scan"] == ("pending", True) and got["fresh", "scan"] == ("completed", False) and got["new", "report"] == ("pending", False)


def test_resume_state_and_match_keys(spark):
    schema = "state string, signature string, pair_key string, modified_ms int"
    data = [("t.state.json", "s", "a", 1), ("t.state.json.1.pending", "s", "a", 5), ("t.state.json.1.pending", "s", "b", 5), ("u.state.json", "s", "a", 9), ("u.state.json", "s", "b", 9), ("u.state.json", "s", "c", 9), ("v.state.json", "other", "d", 99)]
    df = spark.createDataFrame(data, schema)
    assert {r.state for r in tasks.resume_state(df, "t.state.json", "s").collect()} == {"t.state.json.1.pending"}
    assert {r.state for r in tasks.resume_state(df.where("state not like '%pending'"), "t.state.json", "s").collect()} == {"u.state.json"}
    assert tasks.resume_state(df, "t.state.json", "none").count() == 0
    texts = ['{"videoDir": "\\\\X\\\\y\\\\", "topK": 5, "videoPaths": ["/A/"]}', '{"topK": 5, "videoDir": "/x/y", "earlyStop": true, "videoPaths": ["/a"]}', '{"topK": 6, "videoDir": "/x/y"}', "{broken", "[1]"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tasks.match_key("t").alias("k"), tasks.task_config("t").alias("m")).orderBy("i").collect()
    assert got[0].k == got[1].k != got[2].k and got[3].k is None and got[3].m == {} and got[4].m == {} and got[2].m["topK"] == "6"


def test_dragged_layouts(spark):
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    others = F.array(box(0.5, 0.0, 0.5, 0.5))
    one = lambda r, snap: spark.range(1).select(timeline.dragged_layout(r, others, snap, 0.05).alias("r")).first().r
    assert tuple(one(box(0.02, 0.53, 0.5, 0.5), True)) == (0.0, 0.5, 0.5, 0.5)
    assert one(box(0.4, 0.1, 0.3, 0.3), True) is None
    assert tuple(one(box(-3.0, 0.9, 0.01, 2.0), False)) == (0.0, 0.0, 0.05, 1.0)


def test_merge_graph(spark):
    clips = spark.createDataFrame([(0, 0, 0.0, 4.0, 1.0, True, False), (1, 1, 2.0, 4.0, 0.0, True, True)], "clip int, track int, start double, end double, source_start double, has_audio boolean, muted boolean")
    texts = spark.createDataFrame([(1, " it's 5:00 ", 1.0, 9.0, None, None, 500.0), (2, "  ", 0.0, 1.0, 0.5, 0.5, 20.0)], "item int, text string, start double, duration double, x double, y double, size double")
    audio = spark.createDataFrame([(2, 0.5, 0.0, 3.0)], "input int, start double, source_start double, source_end double")
    g = [r.filter for r in timeline.merge_graph(clips, 641, 360, 25, "white", texts, audio).orderBy("position").collect()]
    assert g[0] == "[0:v:0]split=2[vsrc0_0][vsrc0_1]" and g[1] == "color=c=white:s=640x360:r=25:d=10.000000[canvas0]"
    assert g[2].startswith("[vsrc0_0]trim=start=1.000000:end=3.000000,setpts=PTS-STARTPTS,scale=640:360") and g[3].startswith("[canvas0][vseg0]overlay=x=0:y=0")
    assert g[4].startswith("[vsrc0_1]trim=start=3.000000:end=5.000000") and g[6].startswith("[1:v:0]trim=start=0.000000:end=2.000000") and "overlay=x=320:y=0" in g[7]
    assert g[8].startswith("[canvas3]drawtext=text='it\\'s 5\\:00'") and "fontsize=240" in g[8] and g[9] == "[text0]trim=duration=10.000000,format=yuv420p[vout]"
    assert g[10].startswith("[0:a:0]atrim=start=1.000000:end=5.000000") and g[11].startswith("[2:a:0]atrim=start=0.000000:end=3.000000") and "adelay=500:all=1[a1]" in g[11]
    assert g[12].startswith("[a0][a1]amix=inputs=2") and len(g) == 13
    silent = [r.filter for r in timeline.merge_graph(clips, 640, 360, include_audio=False).orderBy("position").collect()]
    assert silent[-1] == "[canvas3]trim=duration=4.000000,format=yuv420p[vout]" and not [x for x in silent if "amix" in x]


def report_pairs(spark):
    data = [(i, f"a{i}", "b<1>", f"/x/a{i}", "/x/b", 0.9 - i / 10, 0.5, s, rel, 7, 3) for i, (s, rel) in enumerate([(0.4, "partial_overlap"), (0.8, "near_duplicate_or_same_content"), (None, "different")])]
    return spark.createDataFrame(data, "pair_id int, video_a string, video_b string, video_a_path string, video_b_path string, a_in_b double, b_in_a double, symmetric_similarity double, relation string, matched_segment_count int, matches_a_to_b_total int")


def test_json_documents(spark, tmp_path):
    p = report_pairs(spark)
    documents.write_json_document(p, f"{tmp_path}/r", "now", ["w\"1"], {"candidate_pairs": 9})
    doc = json.loads("".join(r.value for r in documents.json_document(p, "now", ["w\"1"], {"candidate_pairs": 9}).collect()))
    assert (doc["num_pairs"], doc["warnings"], doc["candidate_pairs"]) == (3, ['w"1'], 9) and [x["video_a"] for x in doc["video_pairs"]] == ["a1", "a0", "a2"]
    written = [f for f in os.listdir(f"{tmp_path}/r") if f.startswith("part")]
    assert len(written) == 1 and json.load(open(f"{tmp_path}/r/{written[0]}")) == doc
    assert json.loads("".join(r.value for r in documents.json_document(p.limit(0), "now").collect()))["video_pairs"] == []
    m = spark.createDataFrame([(0, "A_to_B", k, 0.5) for k in range(300)] + [(0, "B_to_A", 1, 0.9)], "pair_id int, direction string, source_frame_index int, similarity double")
    one = {r.pair_id: r for r in documents.pair_document(p, m).collect()}
    d = json.loads(one[0].document)
    assert d["matches_a_to_b_total"] == len(d["matches_a_to_b"]) == 300 and len(d["matches_b_to_a"]) == 1 and json.loads(one[2].document)["matches_a_to_b"] == [] and "relation: different" in one[2].summary


def test_html_documents_show_the_first_segments_and_windows(spark):
    p = report_pairs(spark)
    seg = spark.createDataFrame([(1, float(k), k + 1.0, 0.0, 1.0, 0.5, 0.7) for k in range(8)], "pair_id int, source_start double, source_end double, target_start double, target_end double, avg_similarity double, confidence double")
    win = spark.createDataFrame([(1, "A_to_B", float(k), k + 1.0, 0.5, 0.6) for k in range(6)], "pair_id int, direction string, source_start double, source_end double, matched_frame_ratio double, avg_similarity double")
    none = spark.createDataFrame([], "pair_id int, direction string, source_frame_index int, target_frame_index int, source_timestamp double, target_timestamp double, similarity double, match_id int")
    page = [r.value for r in documents.html_document(report.pair_rows(p, seg, win, none), "t<0>", ["w"]).collect()]
    assert "t&lt;0&gt;" in page[0] and "near duplicates 1, clips 0, partial overlaps 1, different 1" in page[0] and page[-1].endswith("</html>") and len(page) == 5
    first = page[1]
    assert first.startswith('<tr class="near-duplicate"><td>1</td><td title="/x/a1">a1</td>') and "b&lt;1&gt;" in first
    assert first.count("confidence") == 5 and "... 3 more segments" in first and first.count("A_to_B:") == 6 and "more windows" not in first
    assert "<td>2</td>" in page[2] and "Matched segments" not in page[2]
    dup = documents.duplicate_html(spark.createDataFrame([(3,), (2,)], "members int")).first().value
    assert "Groups: 2" in dup and "Pairs: 4" in dup


def test_rewritten_reports(spark, tmp_path):
    gone = spark.createDataFrame([("/X/B", "\\x\\a1")], "video_a_path string, video_b_path string")
    assert documents.rewrite_report(report_pairs(spark), gone, str(tmp_path), "now") == 2
    csv = spark.read.option("header", "true").csv(f"{tmp_path}/report.csv")
    assert csv.count() == 2 and csv.columns[3:5] == ["video_a_path", "video_b_path"] and csv.columns[-2:] == ["raw_similarity_p95", "matched_segment_count"] and len(csv.columns) == 18
    assert len(json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/report.json").collect()))["video_pairs"]) == 2
    with pytest.raises(ValueError):
        documents.rewrite_report(report_pairs(spark), gone.where("false"), str(tmp_path), "now")


def test_search_documents_and_first_values(spark):
    f = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.91239), ("z", "x", 0.1)], "query string, name string, similarity double")
    got = {r.query: r for r in documents.search_documents(f).collect()}
    assert got["q"].text.split("\n") == ["1. c (score: 0.9124)", "2. a (score: 0.5000)", "3. b (score: 0.5000)"]
    assert json.loads(got["q"].document)["results"][0] == {"rank": 1, "video": "c", "score": 0.9124} and json.loads(got["z"].document)["num_results"] == 1
    u = spark.createDataFrame([(3, " b "), (1, "c"), (2, "b"), (4, " "), (5, None)], "i int, v string")
    assert [r.v for r in report.unique_non_empty(u, "v", "i").collect()] == ["c", "b"]


def test_profile_folders(spark):
    key = "default__skip_0p82__gap_18s__step_6"
    made = json.dumps({"skip_threshold": 0.82, "max_gap_sec": 18, "frame_step": 6})
    folders = [("v", "2", json.dumps({"profile_key": key}), True), ("v", "10", made, True), ("v", "1", "{broken", True), ("w", key, None, True), ("x", "old", made, True), ("x", "1", None, False), ("y", "old", made, False), ("y", "1", None, True), ("y", "3", None, True)]
    f = spark.createDataFrame(folders, "video string, directory string, sidecar string, complete boolean")
    w = spark.createDataFrame([(v, key) for v in "vwxyz"] + [("y", "another"), ("v", key), (None, key)], "video string, profile_key string")
    got = {(r.video, r.profile_key): (r.directory, r.source) for r in profiles.locate_profiles(w, f).collect()}
    assert got == {("v", key): ("2", "numbered"), ("w", key): (key, "legacy"), ("x", key): ("old", "legacy"), ("y", "another"): ("2", "new"), ("y", key): ("4", "new"), ("z", key): ("1", "new")}
    side = json.loads(profiles.sidecars(spark.createDataFrame([(1, key)], "directory int, profile_key string")).first().sidecar)
    assert side["profile_key"] == key and len(side["profile_hash"]) == 16


def test_names_in_quarantine(spark):
    taken = spark.createDataFrame([("a.mp4",), ("a_2.mp4",), ("c",), ("c_1",), ("a_1.mkv",)], "name string")
    new = spark.createDataFrame([("/1/a.mp4", "a.mp4", "x"), ("/2/a.mp4", "a.mp4", "bad\n file"), ("/3/a.mp4", "a.mp4", "x"), ("/b.mp4", "b.mp4", "x"), ("/c", "c", "x"), ("/d", None, "x")], "path string, name string, reason string")
    got = {r.path: r.stored_as for r in caches.unique_names(new, taken).collect()}
    assert got == {"/1/a.mp4": "a_1.mp4", "/2/a.mp4": "a_3.mp4", "/3/a.mp4": "a_4.mp4", "/b.mp4": "b.mp4", "/c": "c_2", "/d": None}
    row = caches.quarantine_rows(new, taken, "/q/", "now").where("original_path = '/2/a.mp4'").first()
    assert (row.destination_path, row.reason) == ("/q/a_3.mp4", "bad file")


def test_vector_files_and_templates(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(3.0))
    np.save(tmp_path / "many.npy", np.arange(6.0).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"no")
    assert [tuple(r)[1:] for r in sorted(caches.read_npy(spark, str(tmp_path)).collect())] == [(0, [0, 1, 2]), (1, [3, 4, 5]), (0, [0, 1, 2])]
    t = spark.createDataFrame([("one", "scan", "first", "{}", "now")], "id string, kind string, name string, config string, updated_at string")
    caches.save_template(spark, f"{tmp_path}/t", t)
    caches.save_template(spark, f"{tmp_path}/t", t.withColumn("name", F.lit("second")))
    assert [r.name for r in caches.read_templates(spark, f"{tmp_path}/t").collect()] == ["second"]
    assert caches.delete_template(spark, f"{tmp_path}/t", "one") and not caches.delete_template(spark, f"{tmp_path}/t", "one")
    with pytest.raises(ValueError):
        caches.delete_template(spark, f"{tmp_path}/t", "../x")


def test_walk_skips_links_and_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    for p in ("z.mp4", "b/y.MKV", "b/c/x.mov", "b/n.txt"):
        (tmp_path / p).write_bytes(b"12345")
    os.symlink(tmp_path / "z.mp4", tmp_path / "link.mp4")
    os.symlink(tmp_path / "b", tmp_path / "again")
    found, skipped = files.walk_files(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["x.mov", "y.MKV", "z.mp4"] and skipped.count() == 0
    assert [r.name for r in files.walk_files(spark, str(tmp_path), recursive=False)[0].collect()] == ["z.mp4"]
    found, skipped = files.walk_files(spark, f"{tmp_path}/none")
    assert found.count() == 0 and skipped.count() == 1
    asked = files.explicit_files(spark, [f"{tmp_path}/z.mp4", f"{tmp_path}/b/n.txt", f"{tmp_path}/nope/q.mp4", f"{tmp_path}/q.mp4"])
    assert [(r.size_bytes, r.error) for r in asked.orderBy("path").collect()] == [(5, "unsupported extension"), (None, "not a file"), (None, "not a file"), (5, None)]


def test_index_of_videos_and_model_folders(spark, tmp_path):
    f = np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    data = [(f"/v/{v}.mp4", i, bytearray(np.roll(f, i, axis=1).tobytes()), 20, 30) for v in "ba" for i in range(5)] + [("/v/c.mp4", 0, None, 0, 0)]
    df = spark.createDataFrame(data, "video_path string, frame_pos int, pixels binary, height int, width int")
    got = embed.build_index(df, f"{tmp_path}/index", count=3)
    assert [r.name for r in got.collect()] == ["a.mp4", "b.mp4"] and caches.read_index(spark, f"{tmp_path}/index").count() == 2
    assert np.linalg.norm(got.first().vector) == pytest.approx(1)
    image = embed.as_images(df).where("frame_pos = 0 and video_path like '%a.mp4'").first().image
    assert (image.height, image.width, image.nChannels, image.mode) == (20, 30, 3, 16) and (np.frombuffer(image.data, np.uint8).reshape(20, 30, 3)[..., ::-1] == f).all()
    assert embed.as_images(df).where("image is null").count() == 1
    assert [embed.batch_size(*a) for a in (("cuda:0", 512), ("cuda", 336), ("CUDA", 224), ("cpu", 384), ("cpu", 224), ("cpu", 224, "7"), ("cpu", 224, "x"), ("cpu", 224, "-1"))] == [2, 4, 8, 16, 32, 7, 32, 1]
    hub = tmp_path / "root" / "hub"
    for n in ("old", "new"):
        (hub / "snapshots" / n).mkdir(parents=True)
        (hub / "snapshots" / n / "config.json").write_text("{}")
    find = lambda: embed.model_source([str(tmp_path / "none"), str(tmp_path / "root")], "model", ("config.json",), "org/model", "hub")
    os.utime(hub / "snapshots" / "old", (1, 1))
    assert find().endswith("/new")
    (hub / "refs").mkdir()
    (hub / "refs" / "main").write_text("old\n")
    assert find().endswith("/old")
    (tmp_path / "root" / "model").mkdir()
    (tmp_path / "root" / "model" / "config.json").write_text("{}")
    assert find().endswith("/root/model") and embed.model_source([], "m", ("x",), "org/model") == "org/model"


def test_heartbeat_of_silent_streams(spark, tmp_path):
    from vidloom.streaming.stateful import PROVIDER, heartbeat_stream

    src, out = f"{tmp_path}/in", []
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "stream string, n int").write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    lines = spark.readStream.schema("stream string, n int").parquet(src)
    q = heartbeat_stream(lines, idle_ms=1).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(90):
            if len({r.stream for r in out}) == 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert {(r.stream, r.rows) for r in out} == {("a", 2), ("b", 1)} and min(r.idle_ms for r in out) >= 1



def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from vidloom.session import scratch_root

    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    spark.conf = SimpleNamespace(get=lambda *a: "")
    with pytest.raises(ValueError):
        scratch_root(spark)
