"""One surviving record per group of duplicates.

``survivors`` judges whole records: every field is resolved to its most recent
usable value, and the record with the best resolved fields survives.
``consensus_values`` judges one text field: the values of a group are aligned
token by token, weighted tokens are voted per column, and the existing value
closest to the consensus is emitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import usable, video_identity
from ..operators.skew import lookup
from ..session import Scratch, rows_of


def latest_usable(df: DataFrame, key: Column, at: str, tie: str, fields: dict[str, str]) -> DataFrame:
    """Per ``key`` the latest usable value of each field (``fields``: name to column).

    Usable is a number above 0 that is not NaN. A row without a time is older than any other; of rows of the
    same time the one with the greater ``tie`` counts. Rows without a key are left out; a key without any
    usable value has null. The aggregation is mergeable, so a hot key is combined before the shuffle.
    """
    cols = [F.max(F.when(usable(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), usable(c).alias("v")))).alias(n) for n, c in fields.items()]
    rows = df.withColumn("__key", key).where(F.col("__key").isNotNull()).groupBy("__key").agg(*cols)
    return rows.select(F.col("__key").alias("member"), *[F.col(n)["v"].alias(n) for n in fields])


def video_fields(videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """``member`` (identity) with ``size``, ``duration`` and ``frames``, each its latest usable value."""
    sizes = latest_usable(videos, video_identity("video_path"), "scanned_at", "scan_id", {"size": "size_mb"})
    sides = F.explode(F.array(*[F.struct(F.col(f"video_{s}_path").alias("path"), F.col(f"duration_{s}").alias("d"), F.col(f"total_frames_{s}").alias("n")) for s in "ab"]))
    both = pairs.select("pair_id", "completed_at", sides.alias("side")).select("pair_id", "completed_at", "side.*")
    media = latest_usable(both, video_identity("path"), "completed_at", "pair_id", {"duration": "d", "frames": "n"})
    return sizes.join(media, "member", "full_outer")


def survivors(groups: DataFrame, fields: DataFrame, order: tuple[str, ...] = ("size", "duration", "frames"), group: str = "group", member: str = "member", keeper: str = "keeper") -> DataFrame:
    """The surviving member of every group: largest by ``order``, field after field, then the smallest key.

    ``groups`` gives ``group`` and ``member``; ``fields`` one row per ``member``. An absent value is the lowest.
    A member without fields takes part with all values absent; repeated memberships change nothing; no groups
    give no rows. A mergeable minimum, so a group of any size is combined before the shuffle.
    """
    f = fields.select(F.col("member").alias("__m"), *order)
    g = groups.select(F.col(group).alias("__g"), F.col(member).alias("__n"))
    rank = F.struct(*[(-F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(f"k{i}") for i, c in enumerate(order)], F.col("__n").alias("n"))
    best = g.join(f, g["__n"] == f["__m"], "left").groupBy("__g").agg(F.min(rank).alias("best"))
    return best.select(F.col("__g").alias(group), F.col("best")["n"].alias(keeper))


#: A profile as a column: number of tokens of each alignment column, tokens, weights, total weight.
PROFILE = "p struct<w:double,n:array<int>,t:array<string>,x:array<double>>"
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


#: Cells up to which a table of scores is kept whole; a larger alignment is divided first.
CELLS = 1_000_000
#: Unlike tokens share a column rather than open two.
SHARED = 0.05


def _holders(cols: list[dict[str, float]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each token the columns that hold it, with its share of their weight."""
    out: dict[str, tuple[list, list]] = {}
    for j, c in enumerate(cols):
        total = sum(c.values())
        for t, w in c.items():
            if t:
                at, x = out.setdefault(t, ([], []))
                at.append(j)
                x.append(w / total)
    return {t: (np.array(at), np.array(x)) for t, (at, x) in out.items()}


def _pairs(a: list[dict[str, float]], b: list[dict[str, float]], cells: int = CELLS) -> list[tuple[int, int]]:
    """Pairs of columns (-1: none) of a best alignment of two profiles.

    A pair of columns scores the chance that a vote of each is for the same token. A row of scores follows from the one
    before by a running maximum; a table of more than ``cells`` is divided where the best path crosses its middle row,
    so memory grows with the lengths, not with their product. The method is the same at any length.
    """
    held, n, m = _holders(b), len(a), len(b)
    weights = [sum(c.values()) for c in a]

    def same(i: int, j0: int, j1: int) -> np.ndarray:
        row = np.full(m, SHARED)
        for t, w in a[i].items():
            if t in held:
                at, x = held[t]
                row[at] += w * x / weights[i]
        return row[j0:j1]

    def scores(rows: range, j0: int, j1: int, back: bool) -> np.ndarray:
        f = np.zeros(j1 - j0 + 1)
        for i in rows:
            s = same(i, j0, j1)
            f[1:] = np.maximum(f[1:], f[:-1] + (s[::-1] if back else s))
            np.maximum.accumulate(f, out=f)
        return f

    def solve(i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
        if i0 == i1 or j0 == j1:
            return [(i, -1) for i in range(i0, i1)] + [(-1, j) for j in range(j0, j1)]
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > cells:
            mid = (i0 + i1) // 2
            ahead, behind = scores(range(i0, mid), j0, j1, False), scores(range(i1 - 1, mid - 1, -1), j0, j1, True)
            j = j0 + int(np.argmax(ahead + behind[::-1]))
            return solve(i0, mid, j0, j) + solve(mid, i1, j, j1)
        best, fit = np.zeros((i1 - i0 + 1, j1 - j0 + 1)), np.zeros((i1 - i0, j1 - j0))
        for i in range(i0, i1):
            fit[i - i0] = same(i, j0, j1)
            f = best[i - i0 + 1]
            np.maximum(best[i - i0][1:], best[i - i0][:-1] + fit[i - i0], out=f[1:])
            np.maximum.accumulate(f, out=f)
        out, i, j = [], i1 - i0, j1 - j0
        while i and j:
            if best[i, j] == best[i, j - 1]:
                j -= 1
                out.append((-1, j0 + j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
                out.append((i0 + i, -1))
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
        out += [(-1, j0 + k) for k in range(j - 1, -1, -1)] + [(i0 + k, -1) for k in range(i - 1, -1, -1)]
        return out[::-1]

    return solve(0, n, 0, m)


def merge_profiles(a: tuple[list, float], b: tuple[list, float]) -> tuple[list, float]:
    """Two profiles (columns of token weights, total weight) as one; ``""`` holds the weight of gaps."""
    (ca, wa), (cb, wb) = a, b
    cols = []
    for i, j in _pairs(ca, cb):
        col = dict(ca[i]) if i >= 0 else {"": wa}
        for t, w in (cb[j] if j >= 0 else {"": wb}).items():
            col[t] = col.get(t, 0.0) + w
        cols.append(col)
    return cols, wa + wb


def profile_of(values: list[tuple[str, float]]) -> tuple[list, float]:
    """Progressive alignment: heaviest value first, ties in order of the values."""
    out: tuple[list, float] | None = None
    for v, w in sorted(values, key=lambda x: (-x[1], x[0])):
        p = ([{t: float(w)} for t in tokens(v)], float(w))
        out = p if out is None else merge_profiles(out, p)
    return out or ([], 0.0)


def consensus_of(profile: tuple[list, float]) -> list[str]:
    picked = (max(c.items(), key=lambda t: (t[1], t[0]))[0] for c in profile[0])
    return [t for t in picked if t]


def token_distance(a: list[str], b: list[str]) -> int:
    """Insertions and deletions of tokens between two sequences.

    From the longest common subsequence, whose table is a row of bits: of any length it is exact.
    """
    at: dict[str, int] = {}
    for j, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for t in a:
        u = v & at.get(t, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) + len(b) - 2 * (len(b) - v.bit_count())


def consensus_values(values: DataFrame, group: str, value: str, weight: str, block: int = 48, scratch: Scratch | None = None) -> DataFrame:
    """Per group the existing value closest to the token consensus of all its values.

    Equal values of a group are added up before anything else. The distinct values of a group are aligned in
    blocks of about ``block``; the profiles of the blocks are then aligned with each other, block by block,
    until one is left, so that no task ever holds an unbounded group. Returns ``group``, ``consensus`` (the
    voted tokens), ``value``, ``distance`` in tokens and ``values``, the number of distinct ones. Of equally
    close values the heavier, then the smaller one is taken. Null groups, null values and weights that are
    null or not above 0 don't vote; the empty text is a value without tokens; no rows give no rows.
    """
    spark = values.sparkSession
    scratch = scratch or Scratch(spark, "consensus")
    v = values.select(F.col(group).alias("g"), F.col(value).alias("v"), F.col(weight).cast("double").alias("w"))
    v = v.where(F.col("g").isNotNull() & F.col("v").isNotNull() & (F.col("w") > 0)).groupBy("g", "v").agg(F.sum("w").alias("w"))
    v = scratch.table(v, "values")
    sizes = scratch.table(v.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = rows_of(v)
    spread = lookup(v.withColumn("g2", F.col("g")), "g", sizes, "g", "n", "n", total, "n")
    blocks = F.ceil(F.col("n") / block)
    spread = spread.select(F.col("g2").alias("g"), F.pmod(F.xxhash64("v"), blocks).alias("b"), "n", "v", "w")
    lists = spread.groupBy("g", "b").agg(F.max("n").alias("n"), F.collect_list(F.struct("v", "w")).alias("items"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"g": x["g"], "b": x["b"], "n": x["n"], "p": [_pack(profile_of([(i["v"], i["w"]) for i in items])) for items in x["items"]]})

    kind = v.schema["g"].dataType.simpleString()
    profiles = scratch.table(lists.mapInPandas(first, f"g {kind}, b bigint, n bigint, {PROFILE}"), "profiles")
    most = profiles.agg(F.max("b")).first()[0] or 0
    while most:

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                out = []
                for items in x["items"]:
                    p = None
                    for s in sorted(items, key=lambda i: i["b"]):
                        q = _unpack(s["p"])
                        p = q if p is None else merge_profiles(p, q)
                    out.append(_pack(p))
                yield pd.DataFrame({"g": x["g"], "b": x["b2"], "n": x["n"], "p": out})

        up = profiles.withColumn("b2", F.floor(F.col("b") / 16)).groupBy("g", "b2").agg(F.max("n").alias("n"), F.collect_list(F.struct("b", "p")).alias("items"))
        profiles = scratch.table(up.mapInPandas(again, f"g {kind}, b bigint, n bigint, {PROFILE}"), "profiles")
        most = profiles.agg(F.max("b")).first()[0] or 0

    @F.pandas_udf("array<string>")
    def voted(p: pd.DataFrame) -> pd.Series:
        return pd.Series([consensus_of(_unpack(r)) for r in p.to_dict("records")], dtype=object)

    @F.pandas_udf("int")
    def apart(text: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([token_distance(tokens(t), list(c)) for t, c in zip(text, want)], dtype="int32")

    made = scratch.table(profiles.select("g", "n", voted("p").alias("c")), "consensus")
    scratch.drop(profiles, sizes)
    near = lookup(v.withColumn("g2", F.col("g")), "g", made, "g", "c", "n", total, "c")
    near = near.withColumn("d", apart("v", "c"))
    best = near.groupBy("g2").agg(F.min(F.struct(F.col("d"), (-F.col("w")).alias("w"), F.col("v"))).alias("best"))
    return best.join(made, best["g2"] == made["g"]).select(F.col("g").alias("group"), F.concat_ws("", "c").alias("consensus"), F.col("best")["v"].alias("value"), F.col("best")["d"].alias("distance"), F.col("n").alias("values"))


def _pack(profile: tuple[list, float]) -> dict:
    cols, w = profile
    return {"w": w, "n": [len(c) for c in cols], "t": [t for c in cols for t in c], "x": [float(x) for c in cols for x in c.values()]}


def _unpack(p: dict) -> tuple[list, float]:
    ends = np.cumsum(np.asarray(p["n"], dtype=np.int64)).tolist()
    pairs = list(zip(p["t"], p["x"]))
    return [dict(pairs[a:z]) for a, z in zip([0, *ends], ends)], float(p["w"])
