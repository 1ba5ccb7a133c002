"""Positions of electrodes: nearest neighbours on the unit sphere, and interpolation weights inside a montage's hull."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwave.operators.order import stored

#: The longest distance of two points of the unit sphere.
DIAMETER = 2.0
CELL_COLUMNS = ["_cx", "_cy", "_cz"]


def on_sphere(df: DataFrame, prefix: str) -> DataFrame:
    """name and coordinates, scaled to length one, under prefixed names; positions at the origin have no direction and go."""
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return df.where(length > 0).select(F.col("name").alias(f"{prefix}_name"), *[(F.col(c) / length).alias(f"{prefix}_{c}") for c in "xyz"])


def cell(column: Column, width: float) -> Column:
    return F.floor(column / width).cast("int")


def nearest_on_sphere(montage: DataFrame, template: DataFrame) -> DataFrame:
    """(name, nearest, distance): the template position closest to each montage position, both as (name, x, y, z).

    Both are dealt to cubic cells. A position meets the 27 cells around it, which hold everything within a cell's width, so a
    neighbour within that width is the nearest. Positions without one search again in cells twice as wide; cells as
    wide as the sphere hold all. Among equal distances the smallest name counts. Exact, without a cross join.
    """
    t = stored(on_sphere(template, "t"), "template")
    left = stored(on_sphere(montage, "m"), "montage")
    n = t.count()
    done: DataFrame | None = None
    width = min(DIAMETER, math.sqrt(4 * math.pi / max(1, n)))  # about one template position a cell
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    while n:
        around = left
        for c, name in zip("xyz", CELL_COLUMNS, strict=True):
            around = around.withColumn("_o", F.explode(near)).withColumn(name, cell(F.col(f"m_{c}"), width) + F.col("_o")).drop("_o")
        dealt = t.select("*", *[cell(F.col(f"t_{c}"), width).alias(name) for c, name in zip("xyz", CELL_COLUMNS, strict=True)])
        apart = F.sqrt(sum(((F.col(f"t_{c}") - F.col(f"m_{c}")) ** 2 for c in "yz"), (F.col("t_x") - F.col("m_x")) ** 2))
        own = ["m_name", "m_x", "m_y", "m_z"]
        met = around.join(dealt, CELL_COLUMNS, "left").groupBy(*own).agg(F.min(F.when(F.col("t_name").isNotNull(), F.struct(apart.alias("distance"), F.col("t_name").alias("nearest")))).alias("n"))
        met = stored(met, "met")
        sure = F.lit(True) if width >= DIAMETER else F.coalesce(F.col("n.distance") <= width, F.lit(False))
        found = met.where(sure).select(F.col("m_name").alias("name"), "n.nearest", "n.distance")
        done = found if done is None else done.unionByName(found)
        left = met.where(~sure).drop("n")
        if left.isEmpty():
            break
        width = min(DIAMETER, 2 * width)
    return done if done is not None else left.select(F.col("m_name").alias("name"), F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("distance"))


def match_audit(matches: DataFrame) -> DataFrame:
    """Whether a naming by nearest positions is one-to-one: positions, names used, names taken more than once and by how many, the largest distance."""
    taken = matches.groupBy("nearest").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    several = F.col("n") > 1
    s = taken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_positions"), F.count("*").alias("n_names"), F.count_if(several).alias("n_shared"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.max("far").alias("worst"))
    return s.withColumn("one_to_one", F.col("n_shared") == 0)


# interpolation


def triangles(points: np.ndarray) -> np.ndarray:
    """A Delaunay triangulation of points of the plane (not all on a line), found edge by edge from the hull inwards."""
    n = len(points)
    cross = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    start = int(np.lexsort((points[:, 0], points[:, 1]))[0])
    away = points - points[start]
    angle = np.arctan2(away[:, 1], away[:, 0])
    angle[start] = np.inf
    second = min((i for i in range(n) if i != start), key=lambda i: (angle[i], away[i] @ away[i]))
    found, seen, todo = [], set(), [(start, second)]
    while todo:
        a, b = todo.pop()
        if (a, b) in seen:
            continue
        area = cross(points[a], points[b], points)
        scale = 1e-12 * max(1.0, float(np.abs(points).max()) ** 2)
        side = np.flatnonzero(area > scale)
        if not len(side):  # an edge of the hull
            seen.add((a, b))
            continue
        # the point that sees the edge under the largest angle lies on an empty circle with it
        cot = ((points[a] - points[side]) * (points[b] - points[side])).sum(1) / area[side]
        c = int(side[np.argmin(cot)])
        found.append((a, b, c))
        seen |= {(a, b), (b, c), (c, a)}
        todo += [e for e in ((b, a), (c, b), (a, c)) if e not in seen]
    return np.array(found, np.int64).reshape(-1, 3)


def barycentric(points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, point, weight) of the triangle that holds each cell; cells outside the hull have none."""
    t = points[triangles(points)] if len(points) > 2 else np.zeros((0, 3, 2))
    corners = triangles(points) if len(points) > 2 else np.zeros((0, 3), np.int64)
    rows = []
    for i, cell_ in enumerate(cells):
        a, b, c = t[:, 0], t[:, 1], t[:, 2]
        whole = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        wb = ((cell_[0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (cell_[1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / whole
        wc = ((b[:, 0] - a[:, 0]) * (cell_[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (cell_[0] - a[:, 0])) / whole
        w = np.stack([1 - wb - wc, wb, wc], 1)
        inside = np.flatnonzero(w.min(1) >= -1e-12)
        if len(inside):
            rows += [(i, int(p), float(v)) for p, v in zip(corners[inside[0]], w[inside[0]], strict=True)]
    at = list(zip(*rows, strict=True)) or [[], [], []]
    return np.asarray(at[0], np.int64), np.asarray(at[1], np.int64), np.asarray(at[2], float)


def hull_weights(positions: DataFrame, keys: list[str], channel: str, side: int) -> DataFrame:
    """(keys, cell, channel, w): barycentric weights of the cells of a side x side grid over the bounding box of each montage.

    positions: a row for each montage (keys) and channel with x, y; a task takes montages one after another. Cell i has
    column i % side and row i // side. A cell outside the convex hull has one row without a channel and weight 0.
    """
    kinds = dict(positions.dtypes)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(channel)
        xy = part[["x", "y"]].to_numpy(float)
        low, high = xy.min(0), xy.max(0)
        i = np.arange(side * side)
        cells = low + np.column_stack([i % side, i // side]) / (side - 1) * (high - low)
        at, point, w = barycentric(xy, cells)
        out = np.setdiff1d(i, at)
        head = {k: part[k].iloc[0] for k in keys}
        inside = pd.DataFrame({**head, "cell": at, channel: part[channel].to_numpy()[point], "w": w})
        outside = pd.DataFrame({**head, "cell": out, channel: None, "w": 0.0})
        return pd.concat([inside, outside]) if len(inside) and len(outside) else inside if len(inside) else outside

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", cell long, {channel} {kinds[channel]}, w double"
    return positions.dropna(subset=[channel, "x", "y"]).groupBy(*keys).applyInPandas(one, schema)


def project_inside_hull(values: DataFrame, weights: DataFrame, montage: list[str], keys: list[str], channel: str, value: str) -> DataFrame:
    """(montage, keys, cell, value): weighted sums of channel values in each cell, 0 outside the hull."""
    inside = values.join(weights.where(F.col(channel).isNotNull()), [*montage, channel]).groupBy(*montage, *keys, "cell").agg(F.sum(F.col("w") * F.col(value)).alias("value"))
    outside = values.select(*montage, *keys).distinct().join(weights.where(F.col(channel).isNull()).select(*montage, "cell"), montage)
    return inside.unionByName(outside.select(*montage, *keys, "cell", F.lit(0.0).alias("value")))
