"""Brightest-first suppression inside tiles: what a tile can decide alone, and what the rest depends on.

A point is kept exactly if no kept point lies within the radius that is brighter.  A tile sees its own
points and, as halo, those of other tiles that reach into it.  Walking from the brightest down, each own
point is dropped beside a kept one, kept if nothing undecided is near, and otherwise depends on undecided
points.  If all of these say the same about one halo point, so does this one, turned round: a chain through the
tile shrinks to a single link from where it leaves to where it enters.  `follow` then runs along links
from tile to tile, twice as far each round.  Points near two independent open ones wait for the next pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.session import cut

CELLS_A_TILE = 256  # side of a tile, in cells that hold one kept point each
POINTS_A_TILE = 16_384  # tiles with more points are left to the rounds over cells
NEAR = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]


def settle_tiles(points: DataFrame, keys: Sequence[str], radius: float, inclusive: bool, shifted: bool) -> DataFrame:
    """(keys…, _id, _on, _on_if, _turned): kept points (`_on` true) and undecided ones (null); dropped ones are left out.

    An undecided point is kept exactly if `_on_if` is (if `_turned`: is not); one that names itself waits.
    `points` has keys…, _id, x, y, _p (brightness), _cy, _cx.
    """
    side = CELLS_A_TILE * radius / math.sqrt(2.0)
    offset, reach = side * (0.75 if shifted else 0.25), radius * 1.001  # the edge at 0 of a frame is no border of tiles

    def tiles(name: str) -> list:
        return [F.floor((F.col(name) + (d * reach + offset)) / side) for d in (0, -1, 1)]

    ys, xs = tiles("y"), tiles("x")
    seen_in = F.array_distinct(F.array(*[F.struct(y.alias("ty"), x.alias("tx")) for y in ys for x in xs]))
    placed = (
        points.select(*keys, "_id", "x", "y", "_p", "_cy", "_cx", ys[0].alias("_hy"), xs[0].alias("_hx"), F.explode(seen_in).alias("_t"))
        .select("*", F.col("_t.ty").alias("_ty"), F.col("_t.tx").alias("_tx"))
        .withColumn("_own", (F.col("_hy") == F.col("_ty")) & (F.col("_hx") == F.col("_tx"))).drop("_t", "_hy", "_hx")
    )
    tile = [*keys, "_ty", "_tx"]
    crowded = cut(placed.groupBy(*tile).count().filter(F.col("count") > POINTS_A_TILE).drop("count"))
    waiting = None
    if not crowded.isEmpty():
        alone = placed.join(crowded, tile, "left_semi").filter("_own")
        waiting = alone.select(
            *keys, "_id", F.lit(None).cast("boolean").alias("_on"), F.col("_id").alias("_on_if"), F.lit(False).alias("_turned")
        )
        placed = placed.join(crowded, tile, "left_anti")

    def settle(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.drop_duplicates("_id").sort_values(["_p", "y", "x", "_id"], ascending=[False, True, True, True])
        rows, on, source, turned = settle_points(
            ranked["_own"].to_numpy(), ranked[["y", "x"]].to_numpy(float), ranked[["_cy", "_cx"]].to_numpy(), radius, inclusive
        )
        ids = ranked["_id"].to_numpy()
        out = {name: [value] * len(rows) for name, value in zip(keys, group)}
        out |= {"_id": ids[rows], "_on": [True if o else None for o in on], "_on_if": ids[source], "_turned": turned}
        return pd.DataFrame(out)

    types = dict(points.dtypes)
    fields = [f"`{k}` {types[k]}" for k in keys]
    schema = ", ".join([*fields, f"_id {types['_id']}, _on boolean, _on_if {types['_id']}, _turned boolean"])
    found = placed.groupBy(*tile).applyInPandas(settle, schema)
    return found if waiting is None else found.unionByName(waiting)


def settle_points(
    own: np.ndarray, at: np.ndarray, cells: np.ndarray, radius: float, inclusive: bool
) -> tuple[list[int], list[bool], list[int], list[bool]]:
    """Rows (of points ranked by brightness) that are kept or undecided, whether they are kept, and what they depend on."""
    limit = float(radius) ** 2
    kept: dict[int, int] = {}
    waiting: dict[int, list[int]] = {}
    link: dict[int, tuple[int, bool]] = {}
    rows, on, source, turned = [], [], [], []
    ys, xs = at[:, 0].tolist(), at[:, 1].tolist()
    low = cells.min(axis=0)  # cells by number, rows far enough apart that steps never meet
    width = int(cells[:, 1].max() - low[1]) + 5
    numbers = ((cells[:, 0] - low[0]) * width + (cells[:, 1] - low[1])).tolist()
    steps = [a * width + b for a, b in NEAR]

    def near(i: int, j: int) -> bool:
        dx, dy = xs[i] - xs[j], ys[i] - ys[j]
        gap = dx * dx + dy * dy
        return gap <= limit if inclusive else gap < limit

    def beside_kept(i: int, cell: int) -> bool:
        for step in steps:
            j = kept.get(cell + step)
            if j is not None and near(i, j):
                return True
        return False

    def undecided_beside(i: int, cell: int) -> Iterator[tuple[int, bool]]:
        for step in steps:
            for j in waiting.get(cell + step, ()):
                if near(i, j):
                    yield link[j]

    for i, cell in enumerate(numbers):
        if beside_kept(i, cell):
            continue
        if not own[i]:
            link[i] = (i, False)
            waiting.setdefault(cell, []).append(i)
            continue
        links: set[tuple[int, bool]] = set()
        if waiting:
            for one in undecided_beside(i, cell):
                links.add(one)
                if len(links) == 2:
                    break
        if len(links) == 2 and len({j for j, _ in links}) == 1:
            continue  # beside a point and its opposite: one of the two is kept
        sure = not links
        if sure:
            kept[cell] = i
            link[i] = (i, False)
        else:
            first, opposite = links.pop()
            link[i] = (i, False) if links else (first, not opposite)
            waiting.setdefault(cell, []).append(i)
        rows.append(i)
        on.append(sure)
        source.append(link[i][0])
        turned.append(link[i][1])
    return rows, on, source, turned


def follow(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The undecided points of `settle_tiles` with `_on` filled in where their links end at a decided point.

    First every link to a point its own tile decided is read off (one that is missing was dropped), then links
    of links are taken among the undecided alone, so rounds grow with the logarithm of the tiles in a chain.
    """

    def step(rows: DataFrame, ends: DataFrame, absent_is_dropped: bool) -> DataFrame:
        there = ends.select(
            *keys, F.col("_id").alias("_on_if"), F.col("_on").alias("_end"), F.col("_on_if").alias("_next"), F.col("_turned").alias("_turn"),
            F.lit(True).alias("_there"),
        )
        joined = rows.join(there, [*keys, "_on_if"], "left")
        end = F.coalesce(F.col("_end"), F.when(F.col("_there").isNull(), F.lit(False))) if absent_is_dropped else F.col("_end")
        value = F.coalesce(F.col("_on"), end != F.col("_turned"))
        if absent_is_dropped:
            return joined.select(*keys, "_id", value.alias("_on"), "_on_if", "_turned")
        further = F.col("_on").isNull() & F.col("_end").isNull() & (F.col("_next") != F.col("_on_if"))
        return joined.select(
            *keys, "_id", value.alias("_on"), F.when(further, F.col("_next")).otherwise(F.col("_on_if")).alias("_on_if"),
            F.when(further, F.col("_turned") != F.col("_turn")).otherwise(F.col("_turned")).alias("_turned"),
            (further | (F.col("_on").isNull() & F.col("_end").isNotNull())).alias("_moved"),
        )

    undecided = state.filter(F.col("_on").isNull())
    undecided = cut(step(undecided, state, absent_is_dropped=True))
    while True:
        nearer = cut(step(undecided, undecided, absent_is_dropped=False))
        undecided = nearer.drop("_moved")
        if nearer.filter("_moved").isEmpty():
            return undecided
