"""Rectilinear grids: axes are small arrays on the driver, cells are rows of a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARTESIAN, SPHERICAL = "cartesian", "spherical"


@dataclass(frozen=True)
class Axis:
    """Coordinates of an axis in index order, from index 1. ``period`` is its length if it wraps."""

    coords: tuple[float, ...]
    period: float | None = None

    @classmethod
    def of(cls, coords: Sequence[float], period: float | None = None) -> Axis:
        axis = cls(tuple(float(x) for x in coords), None if period is None else float(period))
        gaps = np.diff(axis.coords)
        if len(axis.coords) == 0 or (len(gaps) and not (np.all(gaps > 0) or np.all(gaps < 0))):
            raise ValueError("an axis needs coordinates that rise or fall")
        return axis

    @classmethod
    def regular(cls, n: int, step: float = 1.0, start: float = 0.0, *, periodic: bool = False) -> Axis:
        return cls.of([start + step * i for i in range(n)], n * abs(step) if periodic else None)

    @property
    def n(self) -> int:
        return len(self.coords)

    @property
    def uniform(self) -> bool:
        gaps = np.diff(self.coords)
        if len(gaps) == 0:
            return True
        even = bool(np.allclose(gaps, gaps[0], rtol=1e-9, atol=0))
        return even and (self.period is None or math.isclose(self.period, self.n * abs(gaps[0]), rel_tol=1e-9))

    @property
    def step(self) -> float:
        """Signed spacing of a uniform axis; 1 for a single cell."""
        return (self.coords[-1] - self.coords[0]) / (self.n - 1) if self.n > 1 else 1.0

    @property
    def spacing(self) -> float:
        """Smallest distance of neighbours; infinite for a single cell."""
        gaps = np.abs(np.diff(self.coords)).tolist()
        if self.period is not None and self.n > 1:
            gaps.append(abs(self.period - abs(self.coords[-1] - self.coords[0])))
        return min(gaps, default=math.inf)

    @property
    def widths(self) -> np.ndarray:
        """Half the sum of the gaps on both sides; an end cell of a bounded axis has its one gap; a single cell has 1."""
        if self.n == 1:
            return np.ones(1)
        gaps = np.abs(np.diff(self.coords))
        if self.period is not None:
            seam = abs(self.period - abs(self.coords[-1] - self.coords[0]))
            gaps = np.concatenate([[seam], gaps, [seam]])
        else:
            gaps = np.concatenate([gaps[:1], gaps, gaps[-1:]])
        return (gaps[:-1] + gaps[1:]) / 2


@dataclass(frozen=True)
class Grid:
    """Axes with their index columns. Spherical axes are longitude, latitude[, radius] in radians."""

    axes: tuple[Axis, ...]
    dims: tuple[str, ...] = ("i", "j", "k")
    geometry: str = CARTESIAN
    radius: float = 1.0
    names: tuple[str, ...] = field(default=("x", "y", "z"))

    def __post_init__(self):
        if not 1 <= len(self.axes) <= 3:
            raise ValueError("a grid has one to three axes")
        object.__setattr__(self, "dims", tuple(self.dims[: len(self.axes)]))
        object.__setattr__(self, "names", tuple(self.names[: len(self.axes)]))
        if self.geometry == SPHERICAL:
            if len(self.axes) < 2:
                raise ValueError("a spherical grid has longitude and latitude")
            if len(self.axes) == 3 and self.axes[2].n < 2:
                raise ValueError("a shell needs two levels or more")
            lon = self.axes[0]
            if lon.period is None and lon.n > 1 and math.isclose(lon.n * abs(lon.step), 2 * math.pi, rel_tol=1e-9):
                object.__setattr__(self, "axes", (Axis(lon.coords, 2 * math.pi), *self.axes[1:]))
        elif self.geometry != CARTESIAN:
            raise ValueError(f"unknown geometry {self.geometry}")

    @classmethod
    def box(cls, *sizes: int, step: float | Sequence[float] = 1.0, periodic: bool | Sequence[bool] = False, **kw) -> Grid:
        steps = [step] * len(sizes) if isinstance(step, (int, float)) else step
        wraps = [periodic] * len(sizes) if isinstance(periodic, bool) else periodic
        return cls(tuple(Axis.regular(n, h, periodic=p) for n, h, p in zip(sizes, steps, wraps, strict=True)), **kw)

    @property
    def rank(self) -> int:
        return len(self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.n for a in self.axes)

    @property
    def spherical(self) -> bool:
        return self.geometry == SPHERICAL

    @property
    def uniform(self) -> bool:
        return all(a.uniform for a in self.axes)

    def at(self, values: Sequence[float], d: int) -> Column:
        """The entry of an array of an axis for each row's index; cheap arithmetic where it is affine."""
        values = [float(v) for v in values]
        if len(set(values)) == 1:
            return F.lit(values[0])
        if d < self.rank and values == list(self.axes[d].coords) and self.axes[d].uniform:
            a = self.axes[d]
            return F.lit(a.coords[0]) + (F.col(self.dims[d]) - 1) * F.lit(a.step)
        return F.element_at(F.array(*map(F.lit, values)), F.col(self.dims[d]).cast("int"))

    def coord(self, d: int) -> Column:
        return self.at(self.axes[d].coords, d)

    def measure(self) -> Column:
        """Length, area or volume of each row's cell."""
        widths = [self.at(a.widths, d) for d, a in enumerate(self.axes)]
        if not self.spherical:
            return reduce(lambda a, b: a * b, widths)
        lat = self.axes[1]
        r = self.coord(2) if self.rank == 3 else F.lit(float(self.radius))
        cosine = self.at(np.maximum(np.cos(lat.coords), 0.0), 1)
        along, across = r * cosine * widths[0], r * widths[1]
        if self.rank == 2:
            return across if self.axes[0].n == 1 else along if lat.n == 1 else along * across
        return along * across * widths[2]

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with index columns (int)."""
        out = None
        for dim, a in zip(self.dims, self.axes, strict=True):
            part = spark.range(1, a.n + 1).select(F.col("id").cast("int").alias(dim))
            out = part if out is None else out.crossJoin(part)
        return out

    def with_coords(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.coord(d) for d, name in enumerate(self.names)})

    def densify(self, df: DataFrame, values: Sequence[str], *, batch: Sequence[str] = (), active: str = "active") -> DataFrame:
        """Every cell of every batch; a missing cell or value is inactive and 0."""
        full = self.cells(df.sparkSession)
        if batch:
            full = df.select(*batch).distinct().crossJoin(full)
        joined = full.join(df.select(*batch, *self.dims, *values, *([active] if active in df.columns else [])), [*batch, *self.dims], "left")
        known = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in values))
        if active in df.columns:
            known = known & F.coalesce(F.col(active), F.lit(False))
        return joined.select(*batch, *self.dims, known.alias(active), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))

    def check(self, df: DataFrame, *, batch: Sequence[str] = ()) -> None:
        """Fail unless each batch holds every cell once."""
        cells = math.prod(self.shape)
        inside = reduce(lambda a, b: a & b, (F.col(d).between(1, n) for d, n in zip(self.dims, self.shape, strict=True)))
        keyed = df.groupBy(*batch, *self.dims).agg(F.count(F.lit(1)).alias("n"), F.max(inside).alias("inside"))
        bad = keyed.groupBy(*batch).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.min("inside").alias("inside")).filter((F.col("n") != cells) | (F.col("keys") != cells) | ~F.col("inside"))
        if not bad.isEmpty():
            raise ValueError(f"the cell table does not hold each of the {cells} cells of {self.shape} once")


def corner_areas(corners: DataFrame, geometry: str = CARTESIAN, radius: float = 1.0) -> DataFrame:
    """Areas (i, j, area) of quadrilateral cells from corner rows (ci, cj, x, y): shoelace, or spherical excess of two triangles."""
    own = corners.select(F.col("ci").alias("i"), F.col("cj").alias("j"), "x", "y")
    at = lambda di, dj, k: corners.select((F.col("ci") - di).alias("i"), (F.col("cj") - dj).alias("j"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    q = own.withColumnsRenamed({"x": "x0", "y": "y0"}).join(at(1, 0, 1), ["i", "j"]).join(at(1, 1, 2), ["i", "j"]).join(at(0, 1, 3), ["i", "j"])
    if geometry == CARTESIAN:
        cross = lambda a, b: F.col(f"x{a}") * F.col(f"y{b}") - F.col(f"x{b}") * F.col(f"y{a}")
        return q.select("i", "j", (F.abs(cross(0, 1) + cross(1, 2) + cross(2, 3) + cross(3, 0)) / 2).alias("area"))
    from ..functions.geometry import great_circle

    def side(a, b):
        return great_circle(F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}"), 1.0)

    def excess(a, b, c):
        p, r, s = side(a, b), side(b, c), side(c, a)
        half = (p + r + s) / 2
        product = F.tan(half / 2) * F.tan((half - p) / 2) * F.tan((half - r) / 2) * F.tan((half - s) / 2)
        return 4 * F.atan(F.sqrt(F.greatest(product, F.lit(0.0))))

    return q.select("i", "j", (F.lit(radius * radius) * (excess(0, 1, 2) + excess(0, 2, 3))).alias("area"))


def hull_areas(nodes: DataFrame, edges: DataFrame, *, key: str = "node", reach: float) -> DataFrame:
    """Planar Voronoi areas (key, area) of nodes with x, y: each cell is a square of half side ``reach`` cut by the bisectors with its neighbours.

    ``edges`` has (key, nbr) with enough neighbours of each node to close its cell.
    """
    here = nodes.select(F.col(key), F.col("x").alias("x0"), F.col("y").alias("y0"))
    there = nodes.select(F.col(key).alias("nbr"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = edges.join(here, key).join(there, "nbr").groupBy(key, "x0", "y0").agg(F.collect_list(F.struct((F.col("x1") - F.col("x0")).alias("x"), (F.col("y1") - F.col("y0")).alias("y"))).alias("near"))

    @F.pandas_udf("double")
    def area(near):
        out = []
        for offsets in near:
            cell = np.array([(-reach, -reach), (reach, -reach), (reach, reach), (-reach, reach)], float)
            for o in offsets:
                p = np.array((o["x"], o["y"]))
                side = cell @ p - p @ p / 2
                kept = []
                for a, b, sa, sb in zip(cell, np.roll(cell, -1, axis=0), side, np.roll(side, -1), strict=True):
                    if sa <= 0:
                        kept.append(a)
                    if sa * sb < 0:
                        kept.append(a + (b - a) * sa / (sa - sb))
                cell = np.array(kept).reshape(-1, 2)
                if not len(cell):
                    break
            x, y = cell[:, 0], cell[:, 1]
            out.append(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 if len(cell) else 0.0)
        import pandas as pd

        return pd.Series(out)

    return near.select(key, area("near").alias("area"))


def neighbours(grid_cells: DataFrame, dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """Edges (dims, n_dims) between cells whose indices differ by one along one dimension."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(s if k == d else 0).alias(f"s{k}") for k in range(len(dims)))) for d in range(len(dims)) for s in (-1, 1))))
    shifted = grid_cells.select(*dims, steps.alias("s")).select(*dims, *((F.col(c) + F.col(f"s.s{k}")).alias(f"n_{c}") for k, c in enumerate(dims)))
    return shifted.join(grid_cells.select(*(F.col(c).alias(f"n_{c}") for c in dims)), [f"n_{c}" for c in dims], "left_semi").select(*dims, *(f"n_{c}" for c in dims))
