"""Exact nearest neighbours and the minority rows made from them.

A tree of median splits cuts the points into blocks of bounded size; every block has a ball (centre and
radius) that holds all its points. Each point is first compared within its own block, then with the block
whose ball is closest; the distance found bounds where closer points can be, and by the triangle inequality
only blocks whose ball reaches within it are searched. Inside a task the same happens again over small
balls; what is left is sifted by a product of matrices that bounds every squared distance from below, and
only pairs that pass get their distance by differences. Copies of a vector are folded first, so that a
vector that makes up much of the table is compared once. The work per task is one block of points against
one part of the points that ask for it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import ordering
from panelspark.operators.sampling import unit_hash
from panelspark.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors get the functions with the task

#: Points that the driver splits to find the borders of the blocks, and blocks at most (a bigger block is dealt out).
SAMPLE_POINTS, MOST_BLOCKS = 65_536, 4096
FEWEST_ROWS, MOST_ROWS = 2048, 32_768  # rows of a block: a sixteenth of the points, but within these
SMALL_BALL, BALLS = 16, 64  # points that are compared without a further bound, at least; balls of a block
PAIRS_AT_ONCE = 4_000_000  # bounds that a task holds at once
ASKED_AT_ONCE = 65_536  # pairs of a row and a block that a task holds at once


def _fold_copies(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Distinct vectors, each with its k + 1 smallest keys: no point can need more of them."""
    first = Window.partitionBy("v").orderBy(key)
    rows = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return (
        rows.withColumn("__rn", F.row_number().over(first))
        .filter(F.col("__rn") <= k + 1)
        .groupBy("v")
        .agg(F.min(key).alias("vid"), F.sort_array(F.collect_list(key)).alias("ids"))
    )


def _axis(points: np.ndarray) -> np.ndarray:
    """Direction in which the points spread most, by a few power steps."""
    centred = points - points.mean(0)
    axis = centred[np.argmax((centred**2).sum(1))]
    for _ in range(8):
        new = centred.T @ (centred @ axis)
        norm = np.sqrt((new**2).sum())
        if norm == 0:
            break
        axis = new / norm
    return axis


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[np.ndarray, float, int, int]]:
    """Nodes ``(axis, median, left, right)`` that cut the points into about ``leaves`` parts of equal size; a child
    below 0 is the leaf of that number (-1 the first)."""
    nodes: list = []
    count = [0]

    def grow(own: np.ndarray, wanted: int) -> int:
        if wanted > 1 and len(own) > 1:
            axis = _axis(own)
            at = own @ axis
            median = float(np.median(at))
            left = at <= median
            if left.any() and not left.all():
                i = len(nodes)
                nodes.append(None)
                lower = grow(own[left], wanted // 2)
                nodes[i] = (axis, median, lower, grow(own[~left], wanted - wanted // 2))
                return i
        count[0] += 1
        return -count[0]

    grow(points, leaves)
    return nodes


def leaf_of(nodes: list, points: np.ndarray) -> np.ndarray:
    """Number of the leaf, from 0, that each point lies in."""
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1, np.int64)
    for i, (axis, median, left, right) in enumerate(nodes):  # a node stands before its children
        own = at == i
        if own.any():
            at[own] = np.where(points[own] @ axis <= median, left, right)
    return -at - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices, by differences to keep all digits."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _lifted(asking: np.ndarray, points: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Matrices whose product is a lower bound of each squared distance, in squares of the unit that follows; the
    last number is how far below it can be.

    A sum of n rounded products is off by at most n roundings of the sum of their sizes, here twice the two squared
    norms. This is taken off the norms, so no rounding lifts a bound above the distance.
    """
    centre = points.mean(0)
    a, b = asking - centre, points - centre
    unit = float(max(np.abs(a).max(), np.abs(b).max())) or 1.0
    a, b = a / unit, b / unit
    off = 4 * (a.shape[1] + 6) * float(np.finfo(kind).eps)
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.column_stack([-2 * a, np.ones(len(a)), a2 * (1 - off)]).astype(kind)
    right = np.column_stack([b, b2 * (1 - off), np.ones(len(b))]).astype(kind)
    return left, right, unit, 2 * off * float(a2.max() + b2.max()) + 1e-30


def _small_balls(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Members, centre and radius of small balls that hold all points."""
    leaf = leaf_of(split_tree(points, max(1, len(points) // max(SMALL_BALL, len(points) // BALLS))), points)
    out = []
    for n in np.unique(leaf):
        own = np.flatnonzero(leaf == n)
        centre = points[own].mean(0)
        out.append((own, centre, float(distances(points[own], centre[None])[:, 0].max()) * (1 + 1e-9)))
    return out


def _places(groups: np.ndarray) -> np.ndarray:
    """Number of each entry, from 0, within its run of equal values."""
    starts = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))


def closest(
    asking: np.ndarray, bound: np.ndarray, points: np.ndarray, weights: np.ndarray, want: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each row of ``asking`` the points within its bound that can be among the ``want`` nearest: numbers of row
    and point with their distance (ties at the end stay), and the number of distances worked out or bounded. A point
    counts ``weights`` times; a vector with a number that is not finite is near nothing."""
    known, seen = np.flatnonzero(np.isfinite(asking).all(1)), np.flatnonzero(np.isfinite(points).all(1))
    none = np.zeros(0, np.int64)
    if not len(known) or not len(seen):
        return none, none, np.zeros(0), 0
    asking, points, weights = asking[known], points[seen], np.minimum(weights[seen], want)
    balls = _small_balls(points)
    radii = np.array([r for _, _, r in balls])
    left, right, unit, _ = _lifted(asking, np.stack([c for _, c, _ in balls]), np.float64)
    to_centre = np.sqrt(np.maximum(left @ right.T, 0)) * unit
    counted = to_centre.size
    own = to_centre.argmin(1)
    to_centre -= radii
    left, right, unit, slack = _lifted(asking, points, np.float32)
    limit, best = bound[known], np.full((len(asking), want), np.inf)
    found = []
    visits = [(ball, True) for ball in range(len(balls))] + [(ball, False) for ball in range(len(balls))]
    for ball, first in visits:  # each row its nearest ball first, which bounds the rest
        members = balls[ball][0]
        near = np.flatnonzero(((own == ball) == first) & (to_centre[:, ball] <= limit * (1 + 1e-9) + 1e-12))
        step = max(1, PAIRS_AT_ONCE // len(members))
        for rows in (near[i : i + step] for i in range(0, len(near), step)):
            low = left[rows] @ right[members].T
            counted += low.size
            with np.errstate(over="ignore"):
                upto = (limit[rows] / unit) ** 2 * (1 + 1e-9) + 1e-30  # what is too small for a number of this kind
            if len(members) > want and np.isinf(upto).any():  # that many are as near as this
                upto = np.minimum(upto, np.partition(low, want - 1, 1)[:, want - 1].astype(float) + slack)
            row, who = np.nonzero(low <= np.nextafter(upto.astype(np.float32), np.float32(np.inf))[:, None])
            row, who = rows[row], members[who]
            far = np.empty(len(row))
            for i in range(0, len(row), SAMPLE_POINTS):
                d = asking[row[i : i + SAMPLE_POINTS]] - points[who[i : i + SAMPLE_POINTS]]
                far[i : i + SAMPLE_POINTS] = np.sqrt(np.einsum("ij,ij->i", d, d))
            inside = far <= limit[row]
            row, who, far = row[inside], who[inside], far[inside]
            if not len(row):
                continue
            order = np.lexsort((far, row))
            row, who, far = row[order], who[order], far[order]
            found.append((row, who, far))
            times = weights[who]
            r, d = np.repeat(row, times), np.repeat(far, times)
            place = _places(r)
            r, d, place = r[place < want], d[place < want], place[place < want]
            some, at = np.unique(r, return_inverse=True)
            new = np.full((len(some), want), np.inf)
            new[at, place] = d
            best[some] = np.sort(np.hstack([best[some], new]), 1)[:, :want]
            limit[some] = np.minimum(limit[some], best[some, -1])
    if not found:
        return none, none, np.zeros(0), counted
    row, who, far = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = far <= limit[row]
    return known[row[keep]], seen[who[keep]], far[keep], counted


def nearest_neighbours(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    block_rows: int | None = None,
    most_blocks: int = MOST_BLOCKS,
    seed: int = 42,
    counter=None,
) -> DataFrame:
    """The k nearest other rows of each row: ``(key, rank, neighbour, distance)``, ties by key.

    ``counter``: an accumulator that is told how many distances were worked out or bounded. Exact for any data; how
    many distances are saved depends on it: much where vectors lie near a surface of few dimensions or in
    clumps, nothing where all are about equally far from each other. Then every row goes to every block, so blocks
    are larger (``block_rows``) the more points there are, up to what a task holds easily.
    """
    points = materialize(_fold_copies(df, key, vector, k), "points")
    total = points.count()
    block_rows = block_rows or min(MOST_ROWS, max(FEWEST_ROWS, math.ceil(total / 16)))
    wanted = max(1, min(most_blocks, math.ceil(total / block_rows)))
    drawn = points.orderBy(F.xxhash64(F.col("vid"), F.lit(seed)), "vid").limit(min(SAMPLE_POINTS, 64 * wanted))
    sample = np.array([r["v"] for r in drawn.select("v").collect()], dtype=float)
    if not len(sample):
        return df.select(F.col(key), F.lit(1).alias("rank"), F.col(key).alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    nodes = split_tree(sample, wanted)
    key_type = df.schema[key].dataType.simpleString()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(cell=leaf_of(nodes, np.stack(part["v"].to_numpy())).astype("int32"))

    placed = points.mapInPandas(place, f"v array<double>, vid {key_type}, ids array<{key_type}>, cell int")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block
    blocks_of = {c: max(1, math.ceil(n / (1.25 * block_rows))) for c, n in sizes.items()}  # parts are of equal size but roughly
    count = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks_of.items() for x in (c, n)]), F.col("cell"))
    blocked = materialize(placed.withColumn("block", F.pmod(F.xxhash64("vid"), count).cast("int")), "blocks")

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per block the sum of the task's vectors, of which the centre is made."""
        kept: dict = {}
        for part in parts:
            v = np.stack(part["v"].to_numpy()) if len(part) else None
            for c in part["cell"].unique():
                own = v[part["cell"].to_numpy() == c]
                old = kept.get(c, (0.0, 0))
                kept[c] = (old[0] + own.sum(0), old[1] + len(own))
        if kept:
            yield pd.DataFrame({"cell": list(kept), "total": [s.tolist() for s, _ in kept.values()], "n": [n for _, n in kept.values()]})

    added = blocked.select("cell", "v").mapInPandas(sums, "cell int, total array<double>, n long").toPandas()  # tasks x blocks
    centre_of = {c: np.sum(list(g["total"].map(np.array)), axis=0) / g["n"].sum() for c, g in added.groupby("cell")}
    order = np.array(sorted(blocks_of))
    centres = np.stack([centre_of[c] for c in order])

    def reaches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                own = centres[np.searchsorted(order, part["cell"].to_numpy())]
                d = np.sqrt(((np.stack(part["v"].to_numpy()) - own) ** 2).sum(1))
                yield pd.DataFrame({"cell": part["cell"], "reach": d}).groupby("cell", as_index=False).max()

    radius_of = {
        r["cell"]: r["radius"]
        for r in blocked.select("cell", "v").mapInPandas(reaches, "cell int, reach double").groupBy("cell").agg(F.max("reach").alias("radius")).collect()
    }
    radii = np.array([radius_of[c] for c in order]) * (1 + 1e-9) + 1e-12
    block_counts = np.array([blocks_of[c] for c in order])
    found_schema = f"vid {key_type}, distance double, neighbour {key_type}"

    def search(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """Best k + 1 ids of one block within the bound of each asking vector (its own copies included)."""
        if not len(asking) or not len(block):
            return pd.DataFrame({"vid": [], "distance": [], "neighbour": []})
        bound = asking["bound"].to_numpy(dtype=float) if "bound" in asking else np.full(len(asking), np.inf)
        many = block["ids"].map(len).to_numpy()
        ids = np.concatenate(block["ids"].to_list())
        row, who, far, n = closest(np.stack(asking["v"].to_numpy()), bound, np.stack(block["v"].to_numpy()), many, k + 1)
        if counter is not None:
            counter.add(n)
        times = many[who]
        row, far = np.repeat(row, times), np.repeat(far, times)
        at = np.repeat((np.cumsum(many) - many)[who], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((rank[at], far, row))
        order = order[_places(row[order]) <= k]
        return pd.DataFrame({"vid": asking["vid"].to_numpy()[row[order]], "distance": far[order], "neighbour": ids[at[order]]})

    def best_of(found: DataFrame) -> DataFrame:
        """The k + 1 best of all that was found for a vector."""
        best = Window.partitionBy("vid").orderBy("distance", "neighbour")
        ranked = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
        return ranked.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("found"))

    def each(known: DataFrame) -> DataFrame:
        return known.select("vid", F.explode("found").alias("f")).select("vid", "f.distance", "f.neighbour")

    def bounded(found: DataFrame) -> DataFrame:
        bound = F.when(F.size("found") > k, F.element_at("found", -1)["distance"]).otherwise(F.lit(float("inf")))
        return materialize(blocked.select("vid", "v", "cell", "block").join(found.withColumn("bound", bound), "vid"), "bounds")

    rows_at_once = max(1, ASKED_AT_ONCE // int(block_counts.sum()))  # a row may ask all blocks

    def ask(first_only: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Name the blocks that may hold something closer than the bound: the nearest other cell, or the rest."""
            for part in (p.iloc[i : i + rows_at_once] for p in parts for i in range(0, len(p), rows_at_once)):
                d = distances(np.stack(part["v"].to_numpy()), centres)
                mine = np.searchsorted(order, part["cell"].to_numpy())
                reach = d - radii[None, :]
                may = reach <= part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                apart = reach.copy()
                apart[np.arange(len(part)), mine] = np.inf
                nearest = apart.argmin(1)
                seen = np.zeros_like(may)
                seen[np.arange(len(part)), mine] = block_counts[mine] == 1
                if first_only:
                    only = np.zeros_like(may)
                    only[np.arange(len(part)), nearest] = np.isfinite(apart[np.arange(len(part)), nearest])
                    may &= only
                else:
                    seen[np.arange(len(part)), nearest] = np.isfinite(apart[np.arange(len(part)), nearest])
                who, where = np.nonzero(may & ~seen)
                times = block_counts[where]
                row, cell = np.repeat(who, times), np.repeat(order[where], times)
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own = (part["cell"].to_numpy()[row] == cell) & (part["block"].to_numpy()[row] == block)
                row, cell, block = row[~own], cell[~own], block[~own]
                if len(row):
                    yield pd.DataFrame(
                        {"vid": part["vid"].to_numpy()[row], "v": part["v"].to_numpy()[row], "cell": cell, "block": block, "bound": part["bound"].to_numpy()[row]}
                    )

        return run

    def answers(known: DataFrame, first_only: bool) -> DataFrame:
        schema = f"vid {key_type}, v array<double>, cell int, block int, bound double"
        asked = known.select("vid", "v", "cell", "block", "bound").mapInPandas(ask(first_only), schema)
        parts = max(1, math.ceil(total / block_rows))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(parts)).cast("int"))
        asked = materialize(asked, "asked")
        wanted_parts = asked.select("cell", "block", F.col("part").alias("for_part")).distinct()
        served = blocked.select("vid", "v", "ids", "cell", "block").join(wanted_parts, ["cell", "block"])
        served = served.withColumn("part", F.col("for_part") + 0).drop("for_part")  # a column of its own for the cogroup
        by = ["cell", "block", "part"]
        return asked.groupBy(*by).cogroup(served.groupBy(*by)).applyInPandas(search, found_schema)

    found = blocked.groupBy("cell", "block").applyInPandas(lambda g: search(g[["vid", "v"]], g), found_schema)
    if sum(blocks_of.values()) > 1:
        known = bounded(best_of(found))
        if len(order) > 1:
            known = bounded(best_of(each(known).unionByName(answers(known, True))))
        found = each(known).unionByName(answers(known, False))
    lists = best_of(found).withColumnRenamed("found", "near")
    vids = points.select("v", "vid")
    rows = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v")).join(vids, "v").join(lists, "vid")
    others = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col(key)), 1, k)
    return rows.select(key, F.posexplode(others).alias("pos", "n")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance")
    )


def smote(
    minority: DataFrame,
    key: str,
    vector: str,
    wanted: int,
    k: int = 5,
    seed: int = 42,
    chunk: int = 1000,
    **blocks: int,
) -> DataFrame:
    """``wanted`` synthetic rows ``(base, copy, neighbour, vector)`` between minority rows and one of
    their k nearest minority neighbours.

    The copies are spread evenly over the minority rows; neighbour and position on the way are drawn
    from a seeded hash of row and copy number. Rows are handed out in chunks, so one minority row with
    very many copies is made by many tasks.
    """
    rows = minority.select(F.col(key).alias("base"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    size = rows.count()
    if size < 2 or wanted <= 0:
        return rows.select("base", F.lit(0).cast("long").alias("copy"), F.col("base").alias("neighbour"), F.col("x").alias("vector")).limit(0)
    near = nearest_neighbours(minority, key, vector, k, seed=seed, **blocks)
    choices = near.groupBy(F.col(key).alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    numbered = ordering.running_totals(rows.select("base").withColumn("one", F.lit(1)), [], "base", ["one"])
    i = F.col("one_before")
    share = (F.floor((i + 1) * wanted / size) - F.floor(i * wanted / size)).cast("long")
    plan = numbered.select("base", share.alias("copies")).filter(F.col("copies") > 0)
    chunks = plan.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))))
    spread = chunks.repartition("base", "start")
    upto = F.least(F.col("copies"), F.col("start") + chunk) - 1
    copies = spread.select("base", F.explode(F.sequence("start", upto)).alias("copy"))
    pick = F.floor(unit_hash(["base", "copy"], seed) * F.size("near")).cast("int")
    drawn = copies.join(choices, "base").select(
        "base", "copy", F.get("near", pick)["neighbour"].alias("neighbour"), unit_hash(["base", "copy"], seed + 1).alias("way")
    )
    ends = rows.select(F.col("base").alias("neighbour"), F.col("x").alias("y"))
    return drawn.join(rows, "base").join(ends, "neighbour").select(
        "base", "copy", "neighbour",
        F.zip_with("x", "y", lambda a, b: a + (b - a) * F.col("way")).alias("vector"),
    )


def smote_balance(df: DataFrame, key: str, columns: Sequence[str], categories: Sequence[str] = (), label: str = "tag", k: int = 5, seed: int = 42) -> DataFrame:
    """Features and label with synthetic faulty rows added until both classes are equal.

    Missing values are filled with the constants first, as the synthetic rows need numbers.
    """
    from panelspark.operators import clean

    names = [*categories, *columns]
    filled = clean.fill_constant(df, columns, categories).select(key, label, *[F.col(c).cast("double").alias(c) for c in names])
    sizes = filled.agg(F.count_if(F.col(label) == 1).alias("few"), F.count_if(F.col(label) != 1).alias("many")).first()
    minority = filled.filter(F.col(label) == 1).select(key, F.array(*names).alias("__v"))
    made = smote(minority, key, "__v", sizes["many"] - sizes["few"], k, seed)
    synthetic = made.select(F.lit(1).cast(df.schema[label].dataType).alias(label), *[F.col("vector")[i].alias(c) for i, c in enumerate(names)])
    return filled.drop(key).withColumn("synthetic", F.lit(False)).unionByName(synthetic.withColumn("synthetic", F.lit(True)))
