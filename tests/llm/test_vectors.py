import numpy as np
import pytest
from pyspark.sql import functions as F

from vidloom.llm import forest, scenes
from vidloom.operators import sorted_arrays as A
from vidloom.session import Scratch

SCHEMA = "frame_id bigint, embedding array<float>"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def brute(ids, u, k, least):
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        for j in sorted(range(len(row)), key=lambda j: (-round(row[j], 6), ids[j]))[:k]:
            if row[j] >= least:
                out.add((ids[i], ids[j]))
    return out


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 64))
    close = base[:200] + rng.normal(size=(200, 64)) * 0.15
    return np.concatenate([base, close])


def test_neighbours_equal_brute_force_on_near_copies(spark, near_copies):
    df = table(spark, near_copies).withColumn("neighbour", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {(r.id, r.neighbour) for r in forest.neighbours(df, 5, 0.95, rows_per_part=300).collect()}
    want = brute(list(range(len(near_copies))), unit(near_copies), 5, 0.95)
    assert len(got & want) >= 0.99 * len(want) > 100 and not got - want


def test_neighbours_within_a_dense_group(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(4500, 64))
    rows[:1500] = unit(rng.normal(size=(1, 64))) + 0.15 * unit(rng.normal(size=(1500, 64)))  # median cosine 0.978
    rows[2000:2100] = rows[2100:2200] + 0.15 * rng.normal(size=(100, 64))
    u = unit(rows)
    got = {(r.id, r.neighbour) for r in forest.neighbours(table(spark, rows), 5, 0.95, trees=4, window=80, rows_per_part=2000).collect()}
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.95}
    assert len(want) >= 7_500 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_copies_norms_and_invalid_vectors(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=64), rng.normal(size=64)
    data = [(i, [float(x) for x in v * (i + 1)]) for i in range(9)] + [(i, [float(x) for x in v]) for i in range(3)] + [(20, [float(x) for x in w])]
    data += [(30, None), (31, []), (32, [1.0] * 63), (33, [0.0] * 64), (34, [float("nan")] + [1.0] * 63), (35, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (36, [1e-30] * 64), (37, [3e30] * 64)]
    got = {}
    for r in forest.neighbours(spark.createDataFrame(data, SCHEMA), 5, 0.9).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert {i: [n for _, n in sorted(x)] for i, x in got.items()} == {**{i: [j for j in range(9) if j != i][:5] for i in range(9)}, 36: [37], 37: [36]}
    assert forest.neighbours(spark.createDataFrame([], SCHEMA), 5).count() == 0
    assert forest.neighbours(spark.createDataFrame(data[:1], SCHEMA), 5).count() == 0


def test_all_trees_ascend_to_one_prefix_length():
    rng = np.random.default_rng(4)
    u = unit(rng.normal(size=(3000, 64))).astype(np.float32)
    u[:400] = unit(u[:1] + 0.002 * rng.normal(size=(400, 64)))  # they share more bits than the table counts
    h = A.planes(4, A.BITS, 64, 1)
    keys = [A.bit_strings(u, t) for t in h]
    small = forest.SmallForest(u, h, len(u))
    level = small.levels(keys, 200.0)
    share = lambda i, x: sum(int(((k >> (A.BITS - x)) == (k[i] >> (A.BITS - x))).sum()) for k in keys)
    for i in (0, 5, 399, 400, 1234, 2999):
        assert share(i, int(level[i])) >= 200 and (level[i] == A.BITS or share(i, int(level[i]) + 1) < 200)
    assert level[:400].min() > forest.TABLE_BITS > level[400:].max()
    order = np.argsort(keys[0])
    lo, hi = forest.reach(keys[0][order], np.arange(3000), level[order], 10_000)
    i = int(np.flatnonzero(order == 1234)[0])
    assert hi[i] - lo[i] == ((keys[0] >> (A.BITS - level[1234])) == (keys[0][1234] >> (A.BITS - level[1234]))).sum()
    lo, hi = forest.reach(keys[0][order], np.arange(3000), level[order], 5)
    assert (hi - lo).max() <= 11 and (lo <= np.arange(3000)).all() and (hi > np.arange(3000)).all()


def test_class_keys_tell_vectors_apart():
    rng = np.random.default_rng(8)
    u = unit(rng.normal(size=(20000, 64))).astype("<f4")
    v = u.copy()
    v[:, 7] += 2e-5
    k = forest._class_keys(A.binary(np.concatenate([u, v, u])))
    assert len(np.unique(k[:, 0])) == len(np.unique(k, axis=0)) == 40000 and (k[:20000] == k[40000:]).all()


def test_search_recall(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(6, 64))
    x = unit(centre[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 64)) * 0.8)
    q = spark.range(0, 3000, 100).select(F.col("id").alias("frame_id"))
    got = forest.search(table(spark, x), q, 5, share=0.4, rows_per_part=1500).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hits = sum(r.neighbour in set(np.argsort(-s[r.id])[:5]) for r in got)
    assert len(got) == 150 and hits / 150 >= 0.9


def test_ranges_split_a_hot_value():
    keys = np.array([5] * 1000 + list(range(10, 500)), dtype=np.int64)
    part = A.range_of(keys, A.borders(keys, 10), np.arange(len(keys)))
    assert np.bincount(part, minlength=10).max() < 0.25 * len(keys)


def test_binary_columns_survive_slices():
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    assert (A.matrix(A.binary(m).slice(1, 2), "<f4", 3) == m[1:3]).all() and A.matrix(A.binary(m[:0]), "<f4", 3).shape == (0, 3)


@pytest.fixture(scope="module")
def scene_data():
    rng = np.random.default_rng(11)
    means = np.linalg.qr(rng.normal(size=(64, 64)))[0][:6]
    rows, truth = [], []
    for k, n in enumerate((400, 150, 60, 25, 22, 12)):  # the last one is too small
        noise = unit(rng.normal(size=(n, 64)) - (rng.normal(size=(n, 64)) @ means[k])[:, None] * means[k])
        rows.append(unit(means[k] + 0.68 * noise) * rng.uniform(0.5, 20, size=(n, 1)))
        truth += [k] * n
    rows.append(rng.normal(size=(300, 64)))
    return np.concatenate(rows), np.array(truth + [-1] * 300)


def test_scenes_are_found_whole(spark, scene_data):
    x, truth = scene_data
    order = np.random.default_rng(0).permutation(len(x))
    df = table(spark, x[order])
    df = df.union(df.limit(50)).union(spark.createDataFrame([(9000, None), (9001, [0.0] * 64)], SCHEMA)).withColumn("cluster", F.lit("clash"))
    got = {r.id: r for r in scenes.scenes(df, rows_per_part=400).collect()}
    for k in range(5):
        ids = np.flatnonzero(truth[order] == k)
        m = unit(x[order][ids]).mean(axis=0)
        inside = [int(i) for i in ids if unit(x[order][i : i + 1])[0] @ m / np.linalg.norm(m) >= 0.7701]
        assert {got[i].cluster for i in inside} == {min(got[i].id for i in inside)} and got[inside[0]]["size"] >= len(inside)
    assert not [i for i in got if truth[order][i] in (5, -1)]
    top = scenes.describe(spark.createDataFrame([(r.id, r.cluster, r.similarity, r["size"]) for r in got.values()], "id bigint, cluster bigint, similarity double, size bigint"), 2).collect()
    assert len(top) == 10 and max(r["size"] for r in top) == max(r["size"] for r in got.values())


def test_the_only_scene_is_a_small_one(spark):
    rng = np.random.default_rng(0)  # the two bands of the first round miss it
    m = unit(rng.normal(size=(1, 64)))
    e = rng.normal(size=(20, 64))
    e -= (e @ m.T) * m
    x = np.concatenate([unit(m + 0.62 * unit(e)), rng.normal(size=(1500, 64))])
    got = {(r.id, r.cluster, r["size"]) for r in scenes.scenes(table(spark, x)).collect()}
    assert {(i, 0) for i in range(20)} == {(i, c) for i, c, _ in got if i < 20} and len(got) < 25


def test_scenes_of_nothing_and_of_copies(spark):
    assert scenes.scenes(spark.createDataFrame([], SCHEMA)).count() == 0
    copies = table(spark, np.ones((60, 64)))
    assert {(r.cluster, r["size"]) for r in scenes.scenes(copies).collect()} == {(0, 60)}


def test_minhash_values_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1, 64))
    b = a + 0.6 * rng.normal(size=(1, 64))
    s = scenes.signs(np.concatenate([a, b]).astype(np.float32), 1)
    same = (s[0] == s[1]).sum()
    jaccard = same / (2 * scenes.PROJECTIONS - same)
    hits = total = 0
    for seed in range(120):
        x, y = scenes.band_keys(s, seed)
        for v in range(scenes.VALUES):
            hits += (x >> 9 * v) & 511 == (y >> 9 * v) & 511
            total += 1
    assert hits / total == pytest.approx(jaccard, abs=0.06)


def test_stars_take_each_row_once():
    m = np.zeros((7, 7), bool)
    for i, j in ((0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (5, 3)):
        m[i, j] = m[j, i] = True
    np.fill_diagonal(m, True)
    got = scenes.stars(m, 2)
    members = [int(x) for _, t in got for x in t]
    assert len(members) == len(set(members)) and 6 not in members


def test_matches_reach_across_the_blocks_of_a_bucket():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    scene = np.arange(0, 6000, 300)
    x[scene] = unit(rng.normal(size=(1, 64))) + 0.6 * unit(rng.normal(size=(20, 64)))
    keys = np.arange(6000, dtype=np.int64)  # one bucket; its order leaves two members at most in each block
    batch = A.pa.RecordBatch.from_arrays([A.pa.array(keys), A.pa.array(keys), A.binary(A.quantized(x))], names=["key", "id", "q"])
    links = [t.to_pandas().dropna(subset="id") for t in scenes._matches(4, 0.53, 3, 1)(iter([batch])) if t.column("id").null_count == 0]
    largest = max(links[0].groupby("medoid")["id"].apply(set), key=len) if links else set()
    assert len(largest & set(scene)) >= 18 and largest <= set(scene)


def test_wider_bands_for_more_rows():
    assert scenes._bands(140_000) == (8, 4) and scenes._bands(1_000_000) == (18, 5) and scenes._bands(10**9)[1] == scenes.VALUES


def test_buckets_of_directions_stay_small_with_few_bands():
    u = unit(np.random.default_rng(4).normal(size=(20_000, 64))).astype(np.float32)
    for rows in (140_000, 1_000_000, 4_800_000):
        bands, axes = scenes._directions(rows)
        n = np.unique(scenes.buckets_of(u, axes, 1), return_counts=True)[1]
        assert bands <= 25 and rows * ((n * (n - 1)).sum() / len(u) ** 2) < 2 * scenes.BUCKET_ROWS  # the two bases depend on each other


def test_small_scenes_are_in_thorough_bands_and_a_few_near_copies_are_no_nuclei(spark):
    rng = np.random.default_rng(6)
    m, copies = unit(rng.normal(size=(10, 1, 64))), rng.normal(size=(40, 1, 64))
    e = rng.normal(size=(10, 20, 64))
    e -= (e * m).sum(axis=2, keepdims=True) * m
    e /= np.linalg.norm(e, axis=2, keepdims=True)
    x = unit(np.concatenate([(0.78 * m + 0.6258 * e).reshape(-1, 64), (copies + 0.05 * rng.normal(size=(40, 5, 64))).reshape(-1, 64), rng.normal(size=(2000, 64))]))
    df = spark.createDataFrame([(i, v.astype("<f4").tobytes()) for i, v in enumerate(x)], "id bigint, v binary")
    for rows in (140_000, 4_800_000):
        bands, axes = scenes._directions(rows)
        found = scenes._sets(df, list(range(bands)), axes, 2, 5, 500).select("sets").mapInArrow(scenes._set_matches(0.53, 3, 5), scenes.STARS)
        got = scenes._nuclei(found, 10, 0.72, Scratch(spark, "test"))
        of = got[1].toPandas().query("id < 200").groupby("k")["id"].apply(lambda s: set(s // 20))
        assert set.union(*of) == set(range(10)) and got[0].count() <= 12
        k, v = scenes._vectors_of(got[0], "k")
        assert (((unit(v) @ m[:, 0].T).max(axis=0)) > 0.9).all()


def test_small_groups_that_do_not_match_make_no_scene_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = unit(rng.normal(size=(40, 64)))
    e = rng.normal(size=(40, 64))
    e = unit(e - (e * a).sum(axis=1, keepdims=True) * a)
    centres = np.concatenate([a, 0.46 * a + np.sqrt(1 - 0.46**2) * e])  # each cosine 0.85 to the mean of its pair
    copies = unit(centres[:, None] + 0.02 * rng.normal(size=(80, 11, 64)))
    m = unit(rng.normal(size=(1, 64)))
    x = np.concatenate([unit(m + 0.08 * rng.normal(size=(30, 64))), copies.reshape(-1, 64)])
    rounds = []
    thorough = scenes._sets
    monkeypatch.setattr(scenes, "_sets", lambda *a: rounds.append(1) or thorough(*a))
    got = {(r.id, r.cluster) for r in scenes.scenes(table(spark, x)).collect()}
    assert got == {(i, 0) for i in range(30)} and len(rounds) <= 3


def test_pieces_of_a_scene():
    u = unit(np.eye(64)[[0] * 12 + [1] * 12] + 0.5)
    assert not scenes.in_one_piece(u, float(u[0] @ u[23]) + 0.01, 20) and scenes.in_one_piece(u, float(u[0] @ u[23]) - 0.01, 20)
    assert scenes.in_one_piece(u, 0.99, 12) and not scenes.in_one_piece(u[:0], 0.5, 1)
