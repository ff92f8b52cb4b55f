import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidloom.llm import chunking, mixing, packing, topn

# Top n


def test_top_n_equals_sorting(spark):
    rng = random.Random(2)
    data = [(rng.choice(["g", "h", None]), rng.choice([0.5, 0.6, 0.7, None, float("nan")]), rng.choice([1, 2, None]), i) for i in range(400)] + [("x", 1.0, 1, None)]
    df = spark.createDataFrame(data, "g string, score double, t bigint, id bigint").withColumn("heap", F.lit("clash")).repartition(5)
    got = {r.g: [e.id for e in r.heap] for r in topn.top_n(df.drop("heap"), ["g"], "score", ["t", "id"], 7).collect()}
    for g in ("g", "h", None):
        mine = [r for r in data if r[0] == g and r[1] is not None and r[1] == r[1]]
        want = sorted(mine, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))[:7]
        assert got[g] == [r[3] for r in want]
    assert "x" not in got and topn.top_n(df.limit(0), ["g"], "score", ["t", "id"], 3).count() == 0


def test_candidate_matches(spark):
    m = [(1, 1, "A", 5, 9, 0.91), (2, 1, "A", 5, 8, 91.0), (2, 1, "A", 5, 8, 91.0), (3, 1, "A", 5, 7, 0.5), (4, 1, "A", None, 1, 0.9), (5, 1, "A", 6, 1, None), (6, 2, "A", 5, 1, 0.2), (7, 9, "A", 5, 1, 0.9), (8, 1, "A", 5, None, 0.910004)]
    matches = spark.createDataFrame(m, "match_id bigint, pair_id bigint, direction string, source_frame_index bigint, target_frame_index bigint, similarity double")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "pair_id bigint, config_id int")
    configs = spark.createDataFrame([(1, 2), (2, 30)], "config_id int, candidate_limit int")
    got = sorted((r.match_id, r["rank"]) for r in topn.candidate_matches(matches, pairs, configs).collect())
    assert got == [(1, 2), (2, 1), (6, 1)]


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(1, 60))
def test_fill_is_the_best_subset_sum(lengths, room):
    counts = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    best = {0}
    for x in lengths:
        best |= {b + x for b in best if b + x <= room}
    got = packing.fill(room, sorted(counts, reverse=True), counts)
    assert sum(k * n for k, n in got.items()) == max(best) and all(n <= counts[k] for k, n in got.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), min_size=1, max_size=30))
def test_plan_places_every_item_once(histogram):
    left = dict(histogram)
    at = 0
    for first, times, inside in packing.plan(histogram, 100):
        assert first == at and times > 0 and sum(k * n for k, n in inside.items()) <= 100
        at += times
        for k, n in inside.items():
            left[k] -= n * times
    assert not any(left.values())


def test_pack(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([0, 1, 7, 7, 7, 30, 99, 100, 101, 250, None])) for i in range(900)] + [(5, 3), (None, 4)]
    df = spark.createDataFrame(data, "doc_id bigint, size bigint").withColumn("container", F.lit("clash"))
    got = packing.pack(df, 100).collect()
    sizes = {}
    for i, s in data:
        if i is not None:
            sizes[i] = max(sizes.get(i, 0), s or 0)
    by_doc, by_box, fills = {}, {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.part, r.start, r.tokens))
        by_box[r.container] = by_box.get(r.container, 0) + r.tokens
        fills.setdefault(r.container, set()).add(r.fill)
    assert set(by_doc) == set(sizes)
    for i, parts in by_doc.items():
        parts.sort()
        assert sum(p[2] for p in parts) == sizes[i] and [p[1] for p in parts] == [k * 100 for k in range(len(parts))]
        assert len(parts) == max(1, -(-sizes[i] // 100))
    assert all(v <= 100 and fills[k] == {v} for k, v in by_box.items())
    assert set(by_box) == set(range(len(by_box))) and len(by_box) <= sum(sizes.values()) / 100 * 1.05 + 2


def test_pack_of_nothing_and_of_empty_texts(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, size bigint"), 10).count() == 0
    got = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, size bigint"), 10).collect()
    assert [(r.container, r.tokens, r.fill) for r in got] == [(0, 0, 0)] * 2
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id bigint, size bigint"), 0)


# Mixing


def sized(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, source string, size bigint")


def test_mix_reaches_its_shares(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("aaab"), rng.randint(50, 150)) for i in range(3000)] + [(9001, "z", 50), (9002, None, 5), (9003, "a", 0), (9004, "a", None)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.49, 4), ("c", 0.01, 9)], "source string, target_share double, max_repeats int")
    placed, report = mixing.mix(sized(spark, data).withColumn("slot", F.lit("clash")), targets, slot_tokens=2000)
    rep = {r.source: r for r in report.collect()}
    got = placed.collect()
    assert rep["a"].reached_share == pytest.approx(0.5, abs=0.03) and rep["b"].reached_share == pytest.approx(0.49, abs=0.03)
    assert rep["c"].short and rep["c"].placed_tokens == 0 and not rep["a"].short and rep["b"].repeats in (2, 3)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and max(r.copy for r in got) < 4 and not [r for r in got if r.doc_id > 9000]
    total = sum(s for _, k, s in data if k in ("a", "b") and s)
    assert rep["a"].wanted_tokens == pytest.approx(total / 2)
    half = max(r.slot for r in got) // 2
    first = [r for r in got if r.slot < half]
    assert sum(r["size"] for r in first if r.source == "a") / sum(r["size"] for r in first) == pytest.approx(0.5, abs=0.06)


def test_mix_caps_repeats_and_handles_nothing(spark):
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, None)], "source string, target_share double, max_repeats int")
    placed, report = mixing.mix(sized(spark, [(1, "a", 100), (2, "b", 900)]), targets, slot_tokens=10)
    rep = {r.source: r for r in report.collect()}
    assert rep["a"].short and rep["a"].repeats == 2 and not rep["b"].short and placed.where("source = 'a'").count() == 2
    placed, report = mixing.mix(sized(spark, []), targets)
    assert placed.count() == 0 and [r.placed_tokens for r in report.collect()] == [0, 0]


def test_sized_documents(spark):
    data = [(1, "é", " Help-Page "), (1, "é", " Help-Page "), (2, None, "x y"), (3, "", None)]
    got = {tuple(r) for r in mixing.sized_documents(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()}
    assert got == {(1, "help_page", 2), (2, "x_y", 0), (3, None, 0)}


# Splitting


def check_pieces(raw, limit, overlap):
    ends = chunking.cuts(raw, limit, overlap)
    starts = [0, *ends[:-1]]
    assert ends[-1] == len(raw) and all(a < b for a, b in zip(starts, ends))
    for k, (s, e) in enumerate(zip(starts, ends)):
        o = chunking.overlap_start(raw, s, overlap) if k else s
        raw[o:e].decode()
        assert e - o <= limit and (k == 0 or min(overlap, s) <= s - o <= overlap + 3)
    return ends


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n字é🎬", min_size=70, max_size=600), st.integers(40, 64), st.integers(0, 16))
def test_pieces_cover_the_text(text, limit, overlap):
    raw = text.encode()
    if len(raw) > limit:
        check_pieces(raw, limit, overlap)


def test_pieces_end_at_lines_and_survive_edits():
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 90))) for _ in range(2000)]
    a = "\n".join(lines).encode()
    ends = check_pieces(a, 4096, 256)
    assert all(a[e - 1 : e] == b"\n" for e in ends[:-1])
    b = a[:50_000] + b"An inserted remark. " + a[50_000:]
    pieces = lambda raw, e: {raw[x:y] for x, y in zip([0, *e[:-1]], e)}
    before, after = pieces(a, ends), pieces(b, check_pieces(b, 4096, 256))
    assert len(before - after) <= 6 and len(before) > 25


def test_text_without_boundaries_is_cut_everywhere_alike():
    check_pieces(bytes(random.Random(1).choices(b"abcdef0123456789", k=50_000)), 4096, 256)
    check_pieces(b"a" * 50_000, 4096, 256)
    check_pieces(("字" * 20_000).encode(), 4096, 256)


def test_split_oversized(spark):
    long = "One sentence here. " * 400
    data = [(1, long), (2, "short"), (3, None), (4, ""), (5, "x" * 4096), (None, long)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("piece", F.lit("clash")).withColumn("start", F.lit(1))
    got = chunking.split_oversized(df, 4096, 256).collect()
    assert {r.doc_id for r in got} == {1, None}
    mine = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert "".join(r.text[r.repeats :] for r in mine) == long and all(r.tokens == len(r.text) <= 4096 for r in mine)
    assert all(a.text.endswith(b.text[: b.repeats]) and b.repeats == 256 for a, b in zip(mine, mine[1:]))
    assert chunking.split_oversized(df.limit(0), 4096, 256).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, 100, 90)
