import random

import pytest
from pyspark.sql import functions as F

from vidloom.llm import representative
from vidloom.llm.components import contract, linked_groups
from vidloom.llm.tables import same_content_links


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


def test_groups_equal_union_find(spark):
    rng = random.Random(5)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    hub = [("hub", f"h{i}") for i in range(200)]
    noise = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(50)]
    pairs = chain + hub + noise + chain[:10] + [(b, a) for a, b in hub[:20]] + [(None, "x"), ("x", None), ("self", "self")]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("root", F.lit(1)).withColumn("degree", F.lit("clash"))
    assert {tuple(r) for r in linked_groups(df, "a", "b").collect()} == union_find(pairs)


def test_groups_of_nothing_and_of_numbers(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert linked_groups(empty, "a", "b").count() == 0
    nums = spark.createDataFrame([(3, 2), (9, 3), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in linked_groups(nums, "a", "b").collect()} == {(2, 2), (3, 2), (9, 2)}


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    from vidloom.operators import skew

    pairs = [("hub", f"h{i:04}") for i in range(1500)] + [(f"x{i}", f"y{i}") for i in range(1500)]
    plain = skew.lookup
    monkeypatch.setattr("vidloom.llm.components.lookup", lambda *a, **k: plain(*a, **k | {"small": 10}))
    got = {tuple(r) for r in linked_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == union_find(pairs)


def test_contraction_ignores_nulls_and_loops(spark):
    from vidloom.session import Scratch

    df = spark.createDataFrame([(1, 1), (None, 2), (4, 5), (5, 4)], "a bigint, b bigint")
    roots = {r.v: r.root for r in contract(df, Scratch(spark, "t")).collect()}
    assert set(roots) == {4, 5} and roots[4] == roots[5]


def test_links_of_reports(spark):
    data = [("/A/x.mp4", "\\a\\y.mp4", " Near-Duplicate or same content "), ("/a/x.mp4", None, "identical"), ("p", "q", "similar"), (" ", "q", "identical"), ("p", "q", None)]
    df = spark.createDataFrame(data, "video_a_path string, video_b_path string, relation string")
    assert [tuple(r) for r in same_content_links(df).collect()] == [("/a/x.mp4", "/a/y.mp4")]


def test_latest_usable_value_counts(spark):
    data = [("/V", 1, 1, 10.0), ("/v/", 2, 2, float("nan")), ("/v", 3, None, 99.0), ("/v", 4, 2, 20.0), ("/v", 4, 2, 20.0), ("/w", 5, 1, 0.0), (None, 6, 1, 5.0)]
    df = spark.createDataFrame(data, "video_path string, scan_id int, at int, size_mb double")
    from vidloom.functions.identity import video_identity

    got = {r.member: r["size"] for r in representative.latest_usable(df, video_identity("video_path"), "at", "scan_id", {"size": "size_mb"}).collect()}
    assert got == {"/v": 20.0, "/w": None}


def test_survivor_by_size_then_duration_then_frames_then_name(spark):
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("g", "c"), ("h", "d"), ("h", "e"), ("i", "z"), ("i", "y")], "group string, member string")
    fields = spark.createDataFrame([("a", 5.0, 1.0, 1), ("b", 5.0, 2.0, None), ("c", 5.0, 2.0, 3), ("d", None, 9.0, 9), ("e", 0.1, None, None)], "member string, size double, duration double, frames bigint")
    got = {tuple(r) for r in representative.survivors(groups, fields).collect()}
    assert got == {("g", "c"), ("h", "e"), ("i", "y")}
    assert representative.survivors(groups.limit(0), fields).count() == 0


@pytest.mark.parametrize("block", [2, 50])
def test_token_consensus(spark, block):
    names = {"night drive take 1": 5.0, "night drive take 2": 1.0, "the night drive take 1": 1.0, "night ride take 1": 1.0, "something else": 1.0}
    data = [("g", k, w) for k, w in names.items()] + [("g", None, 9.0), (None, "x", 1.0), ("h", "only", 1.0), ("h", "only", 1.0), ("i", "", 1.0), ("j", "w", -1.0)]
    got = {r.group: r for r in representative.consensus_values(spark.createDataFrame(data, "k string, name string, weight double"), "k", "name", "weight", block).collect()}
    assert got["g"].value == "night drive take 1" and got["g"].values == 5
    assert got["h"].value == "only" and got["h"].distance == 0 and got["i"].value == "" and set(got) == {"g", "h", "i"}


def score(a, b, pairs):
    total = 0.0
    for i, j in pairs:
        if i >= 0 and j >= 0:
            same = sum(w * b[j].get(t, 0) for t, w in a[i].items() if t)
            total += same / (sum(a[i].values()) * sum(b[j].values())) + representative.SHARED
    return total


@pytest.mark.parametrize("cells", [1, 9, 10_000])
def test_alignment_is_the_best_one_however_it_is_divided(cells):
    rng = random.Random(cells)

    def best(a, b):
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + score(a, b, [(i, j)]))
        return table[-1][-1]

    for _ in range(60):
        a, b = ([{t: rng.randint(1, 4) for t in rng.sample(["x", "y", "z", ""], rng.randint(1, 3))} for _ in range(rng.randint(0, 7))] for _ in "ab")
        p = representative._pairs(a, b, cells)
        assert [i for i, _ in p if i >= 0] == list(range(len(a))) and [j for _, j in p if j >= 0] == list(range(len(b)))
        assert score(a, b, p) == pytest.approx(best(a, b))


def test_token_distance_is_exact():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in "ab")
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert representative.token_distance(a, b) == len(a) + len(b) - 2 * lcs[-1][-1]


def test_long_values_are_aligned_as_short_ones():
    a, b = "a b c d " * 300, "a b x d " * 300
    p = representative.profile_of([(a, 2.0), (b, 1.0)])
    assert "".join(representative.consensus_of(p)) == a and len(p[0]) == 2400
    assert representative._unpack(representative._pack(p)) == p and representative._unpack(representative._pack(([], 0.0))) == ([], 0.0)
    assert representative.token_distance(["a", "b"], ["a", "c"]) == 2
