import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidloom.functions import identity, image, relation, text, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<double>", bool: "boolean"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()))
    return row.select(column).first()[0]


def many(spark, column, name, kind, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"{name} {kind}").select(column).collect()]


def test_identity(spark):
    got = many(spark, identity.video_identity("p"), "p", "string", [" D:\\A\\B.MP4 ", "/x/y//", "/", "  ", None, "Küste/É.mkv"])
    assert got == ["d:/a/b.mp4", "/x/y", None, None, None, "küste/é.mkv"]


def test_relation_code(spark):
    assert many(spark, identity.relation_code("r"), "r", "string", [" Near-Duplicate or same content ", None]) == ["near_duplicate_or_same_content", None]


def test_usable(spark):
    assert many(spark, identity.usable("x"), "x", "double", [1.5, 0.0, -1.0, math.nan, None]) == [1.5, None, None, None, None]


def test_cosine_and_norms(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]
    assert one(spark, vectors.cosine_similarity("a", "b"), a=a, b=b) == pytest.approx(24 / 25)
    assert one(spark, vectors.cosine_similarity("a", "b"), a=a, b=[0.0, 0.0]) == 0
    assert one(spark, vectors.l2_normalize("a"), a=a) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize("a"), a=[0.0, 0.0]) == [0, 0]


def test_hash_similarity(spark):
    h = lambda x: vectors.hash_long(F.lit(x))
    got = spark.range(1).select(vectors.hash_similarity(h("f" * 16), h("0" * 16)), vectors.hash_similarity(h("8000000000000000"), h("0" * 16)), h("xyz")).first()
    assert list(got) == [0.0, 1 - 1 / 64, None]


@pytest.mark.parametrize(
    ("values", "label"),
    [
        ((1.0, 1.0, 10, 10, 0.0, 0.0), "near_duplicate_or_same_content"),
        ((0.3, 0.7, 100, 10, 0.0, 0.0), "B_is_likely_clip_of_A"),
        ((0.7, 0.3, 10, 10, 10.0, 100.0), "A_is_likely_clip_of_B"),
        ((0.6, 0.86, 10, 10, 0.0, 0.0), "B_is_likely_clip_of_A"),
        ((0.55, 0.75, 10, 10, 0.0, 0.0), "partial_overlap"),
        ((0.4, 0.4, 10, 10, 0.0, 0.0), "different"),
    ],
)
def test_engine_relation(spark, values, label):
    assert spark.range(1).select(relation.relation_engine(*values)).first()[0] == label


def test_report_relation(spark):
    r = relation.relation_report
    got = spark.range(1).select(r(0.55, 0.75), r(0.35, 0.2), r(0.2, 0.05), r(0.05, 0.05)).first()
    assert list(got) == ["B_is_likely_clip_of_A", "partial_overlap", "similar", "different"]
    n = relation.normalized_relation
    got = spark.range(1).select(n(F.lit("identical"), F.lit(0.1), F.lit(0.1)), n(F.lit("a_contains_b"), F.lit(0.1), F.lit(0.05)), n(F.lit("x"), F.lit(None).cast("double"), F.lit(0.1)), n(F.lit("unknown"), F.lit(0.9), F.lit(0.9))).first()
    assert list(got) == ["identical", "different", "x", "near_duplicate_or_same_content"]


def test_ratios_and_numbers(spark):
    assert many(spark, relation.normalized_ratio("x"), "x", "double", [0.5, 50.0, 1.0, 250.0, -1.0, None, math.nan]) == [0.5, 0.5, 1.0, 1.0, 0.0, None, None]
    assert many(spark, relation.number_value("x"), "x", "string", ["", " 2.5", "abc", None, "NaN"]) == [0.0, 2.5, None, None, None]
    assert many(spark, relation.format_percent("x"), "x", "double", [0.1234, None]) == ["12.3%", "-"]


def test_paths_and_names(spark):
    assert many(spark, text.normalize_path("p"), "p", "string", [" A\\B/ ", "///", ""]) == ["a/b", "-", "-"]
    assert many(spark, text.stem("p"), "p", "string", ["/a/b.c.json", ".hidden", "x"]) == ["b.c", ".hidden", "x"]
    assert many(spark, text.safe_name("p"), "p", "string", ["a b?.mp4", "...", "视频 1"]) == ["a_b_.mp4", "video", "视频_1"]
    assert spark.range(1).select(text.is_child_path(F.lit("/a"), F.lit("/a/b")), text.is_child_path(F.lit("/a"), F.lit("/ab"))).first()[:] == (True, False)
    assert one(spark, text.profile_key(F.lit("default"), F.lit(0.82), F.lit(18.0), F.lit(6)), x=1) == "default__skip_0p82__gap_18s__step_6"
    assert one(spark, text.filter_tokens("t"), t=" a, b；c、 d") == ["a", "b", "c", "d"]


def test_times_and_sizes(spark):
    assert many(spark, text.hhmmss("x"), "x", "double", [0.0, 3661.9, 360000.0, None, math.nan, -5.0]) == ["00:00:00", "01:01:01", "100:00:00", "-", "-", "00:00:00"]
    assert many(spark, text.clock("x"), "x", "double", [61.0, 3661.0]) == ["01:01", "01:01:01"]
    assert many(spark, text.file_size("x"), "x", "bigint", [0, 512, 1536, 5 * 1024**3, None]) == ["0 B", "512 B", "1.5 KB", "5 GB", "0 B"]
    assert many(spark, text.time_value("x"), "x", "string", ["1700000000", "1700000000000", "2024-01-01T00:00:00Z", "x"]) == [1700000000000, 1700000000000, 1704067200000, None]
    assert many(spark, text.subtitle_seconds("x"), "x", "string", ["01:02:03,5", "02:03.250", "nope"]) == [3723.5, 123.25, None]


def test_escapes(spark):
    assert many(spark, text.csv_cell("x"), "x", "string", ['a"b', "a,b", "ab", None]) == ['"a""b"', '"a,b"', "ab", ""]
    assert one(spark, text.html_escape("x"), x="<a b='1'>&") == "&lt;a b=&#39;1&#39;&gt;&amp;"
    assert one(spark, text.strip_ansi("x"), x="\x1b[31mred\x1b[0m\r") == "red"
    assert one(spark, text.compact_error("x"), x="a \n b") == "a b"
    assert one(spark, text.clean_subtitle("x"), x="<i>a</i>&nbsp;b\n\n c ") == "a b\nc"


def test_progress_protocol(spark):
    got = many(spark, text.parse_progress("x"), "x", "string", ["PROGRESS|compare|1|2|pair|3|4|sub", "PROGRESS|other|1|2|x", "hello", "PROGRESS|done|1|0|end"])
    assert got[0].asDict() == {"stage": "pair", "progress": 76.5, "sub_stage": "sub", "sub_progress": 75.0}
    assert got[1] is None and got[2] is None and got[3]["progress"] == 100.0


def test_natural_order(spark):
    names = ["clip 10", "clip 2", "Clip 1", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key("n"))
    assert [r.n for r in df.collect()] == [None, "Clip 1", "clip 2", "clip 10"]


@settings(max_examples=25, deadline=None)
@given(st.integers(8, 40), st.integers(8, 40))
def test_borders_and_fit(h, w):
    f = np.zeros((h, w, 3), np.uint8)
    assert image.black_borders(f) == (0, h, 0, w)
    f[2 : h - 2, 3 : w - 3] = 200
    assert image.black_borders(f) == (2, h - 2, 3, w - 3)
    assert image.fit(f, 16).shape == (16, 16, 3) and image.fit(f, 16, "letterbox").shape == (16, 16, 3)


def test_phash_is_stable_under_scale_and_noise(spark):
    y, x = np.mgrid[0:64, 0:96]
    f = (127 + 90 * np.sin(x / 9) * np.cos(y / 7)).astype(np.uint8)
    big = np.repeat(np.repeat(f, 2, 0), 2, 1)
    noisy = np.clip(f.astype(int) + np.random.default_rng(0).integers(-6, 7, f.shape), 0, 255).astype(np.uint8)
    a, b, c = (int(image.phash(z), 16) for z in (f, big, noisy))
    assert (a ^ b).bit_count() <= 8 and (a ^ c).bit_count() <= 14
    df = spark.createDataFrame([(bytearray(f.tobytes()), 64, 96), (None, 64, 96)], "p binary, h int, w int")
    got = [r[0] for r in df.select(image.phash_of("p", "h", "w")).collect()]
    assert got == [image.phash(f), None]


def test_rotation_and_channels():
    f = np.arange(24).reshape(4, 2, 3)
    assert image.rotate_portrait(f).shape == (2, 4, 3) and image.rotate_portrait(f, "none").shape == (4, 2, 3)
    assert (image.to_bgr(f)[..., 0] == f[..., 2]).all()
    with pytest.raises(ValueError):
        image.to_bgr(np.zeros((2, 2, 2)))
