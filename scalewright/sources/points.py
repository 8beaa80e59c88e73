"""Point sets: nodes, curvilinear meshes and cells of any grid, joined by distance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import euclid, great_circle, position
from .grids import CARTESIAN, SPHERICAL

#: Times that a cube as wide as the reach is halved in the search for nearest points, at most.
LEVELS = 24


@dataclass(frozen=True)
class Points:
    """Rows with key columns, coordinates and a measure.

    Spherical coordinates are longitude, latitude in radians [and radius]; with a radius
    the distance is the straight one. A Cartesian ``period`` tiles all images of a
    coordinate; on a sphere each point counts once.
    """

    keys: tuple[str, ...] = ("node",)
    coords: tuple[str, ...] = ("x", "y")
    area: str | None = "area"
    geometry: str = CARTESIAN
    radius: float = 1.0
    period: tuple[float | None, ...] | None = None

    def __post_init__(self):
        if self.geometry not in (CARTESIAN, SPHERICAL):
            raise ValueError(f"unknown geometry {self.geometry}")

    @property
    def spherical(self) -> bool:
        return self.geometry == SPHERICAL

    @property
    def rank(self) -> int:
        return len(self.coords)

    def measure(self) -> Column:
        return F.col(self.area).cast("double") if self.area else F.lit(1.0)

    def _flat(self, prefix: str = "") -> list[Column]:
        """Coordinates in which closeness is tested by buckets."""
        c = [F.col(prefix + name).cast("double") for name in self.coords]
        if not self.spherical:
            return c
        return list(position(c[0], c[1], c[2] if len(c) == 3 else self.radius))

    def _cube(self, reach: float) -> float:
        """The side of cubes of which those around a point's own hold all within ``reach``."""
        if not (math.isfinite(reach) and reach > 0):
            raise ValueError("the reach must be positive and finite")
        chord = reach
        if self.spherical and self.rank == 2:
            chord = 2 * self.radius * math.sin(min(reach / (2 * self.radius), math.pi / 2))
        return max(chord, 1e-12) * (1 + 1e-9)

    def _side(self, df: DataFrame, side: str, batch: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
        """Rows of sources (s) or targets (t): keys, coordinates and ``more`` with the side before their names."""
        return df.select(*batch, *(F.col(k).alias(f"{side}_{k}") for k in self.keys), *(F.col(c).cast("double").alias(f"{side}{d}") for d, c in enumerate(self.coords)), *more)

    def _dealt(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows dealt by keys over twice as many tasks as there are cores: a small file would be one task, and the work is in its pairs."""
        return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)

    def _images(self, source: DataFrame, reach: float) -> DataFrame:
        for d, p in enumerate(self.period or ()):
            if p is not None and not self.spherical:
                images = math.ceil(reach / p)
                source = source.withColumn("_image", F.explode(F.sequence(F.lit(-images), F.lit(images)))).withColumn(f"s{d}", F.col(f"s{d}") + F.col("_image") * p).drop("_image")
        return source

    def _within(self, joined: DataFrame, limit: Column, batch: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
        """Of joined targets and sources those within ``limit``, with d and delta."""
        keys = self.keys
        if self.spherical:
            flat = [replace_coords(self, side)._flat() for side in "ts"]
            d = great_circle(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"), self.radius) if self.rank == 2 else euclid(*(a - b for a, b in zip(*flat, strict=True)))
        else:
            d = euclid(*(F.col(f"s{k}") - F.col(f"t{k}") for k in range(self.rank)))
        delta = [F.col(f"s{k}") - F.col(f"t{k}") for k in range(self.rank)]
        if self.spherical:
            turn = 2 * math.pi
            delta[0] = delta[0] - turn * F.round(delta[0] / turn)
        found = joined.withColumn("d", d).filter(F.col("d") <= limit)
        return found.select(*batch, *(f"t_{k}" for k in keys), *(f"s_{k}" for k in keys), "d", F.array(*delta).alias("delta"), *more)

    def edges(self, df: DataFrame, reach: float, *, batch: Sequence[str] = (), targets: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """(batch, t_keys, s_keys, d, delta) of all pairs within ``reach``, each point with itself included.

        Space is cut into cubes as wide as ``reach``; a target looks into its own cube
        and those around it, so the join is on equal cubes and its size follows the
        density of points. ``delta`` is the array of coordinate differences, source less
        target, over the seam where that is nearer. Coordinates must not be null. Columns
        to ``carry`` come along from the source.
        """
        cube = self._cube(reach)
        source = self._images(self._side(df, "s", batch, carry), reach)
        target = self._dealt(self._side(df if targets is None else targets, "t", batch), [*batch, *(f"t_{k}" for k in self.keys)])
        source = source.withColumns({f"b{k}": F.floor(x / cube) for k, x in enumerate(replace_coords(self, "s")._flat())})
        own = replace_coords(self, "t")._flat()
        around = F.explode(F.array(*(F.struct(*(F.lit(s).alias(f"o{k}") for k, s in enumerate(shift))) for shift in product((-1, 0, 1), repeat=len(own)))))
        target = target.withColumns({f"c{k}": F.floor(x / cube) for k, x in enumerate(own)}).withColumn("o", around)
        target = target.withColumns({f"b{k}": F.col(f"c{k}") + F.col(f"o.o{k}") for k in range(len(own))}).drop("o", *(f"c{k}" for k in range(len(own))))
        joined = target.join(source, [*batch, *(f"b{k}" for k in range(len(own)))])
        return self._within(joined, F.lit(reach), batch, carry)

    def blocks(self, df: DataFrame, reach: float, *, batch: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
        """Rows by cubes (b0..) as wide as ``reach``: each in its own cube, where ``_own`` is true, and in those around.

        So a cube's rows hold all that are within reach of its own ones. Coordinates are
        x0.., keys and ``carry`` keep their names. Points with coordinates that are null or not finite are left out.
        """
        if self.spherical:
            raise ValueError("blocks serve Cartesian points")
        cube, dims = self._cube(reach), range(self.rank)
        rows = self._side(df, "s", batch, carry)
        rows = rows.filter(reduce(lambda a, b: a & b, [F.abs(f"s{k}") < math.inf for k in dims] + [F.col(c).isNotNull() for c in batch]))
        rows = self._images(rows.withColumns({f"h{k}": F.col(f"s{k}") for k in dims}), reach)
        around = F.explode(F.array(*(F.struct(*(F.lit(s).alias(f"o{k}") for k, s in enumerate(shift))) for shift in product((-1, 0, 1), repeat=self.rank))))
        own = reduce(lambda a, b: a & b, ((F.col(f"s{k}") == F.col(f"h{k}")) & (F.col(f"o.o{k}") == 0) for k in dims))
        return rows.withColumn("o", around).select(*batch, *((F.floor(F.col(f"s{k}") / cube) + F.col(f"o.o{k}")).alias(f"b{k}") for k in dims), own.alias("_own"), *(F.col(f"s_{k}").alias(k) for k in self.keys), *(F.col(f"s{k}").alias(f"x{k}") for k in dims), *carry)

    def nearest(self, df: DataFrame, k: int, reach: float, *, batch: Sequence[str] = ()) -> DataFrame:
        """The k nearest others of each point within ``reach``, with their rank; ties go to smaller keys.

        Cubes as wide as ``reach`` are halved up to ``LEVELS`` times. A point looks around in
        cubes of the finest level on which its own holds more than k points: k others are
        within a cube's diagonal, so none nearer is farther off, however wide the reach. If
        already the widest holds no more than k, it looks through the reach. At a place
        with many points only the k + 1 smallest keys can be among a point's nearest. So
        work follows the number of points, not of pairs, unless more than k places lie in
        one cube of the finest level. Points with coordinates that are null or not finite have no neighbours.
        """
        keys, cube = list(self.keys), self._cube(reach)
        dims = range(len(self._flat()))
        apart = math.sqrt(len(dims)) + 0.1  # A diagonal in cubes, with room for rounding; less than 2.
        at, cells = [f"_y{m}" for m in dims], ["_fine", *(f"_b{m}" for m in dims)]
        levels = F.explode(F.array(*(F.lit(1 << n) for n in range(LEVELS + 1))))

        def placed(rows: DataFrame, side: str) -> DataFrame:
            rows = rows.withColumns({f"_y{m}": x / cube for m, x in enumerate(replace_coords(self, side)._flat())})
            return rows.filter(reduce(lambda a, b: a & b, (F.abs(y) < math.inf for y in at)))

        def in_cells(rows: DataFrame) -> DataFrame:
            return rows.withColumns({f"_b{m}": F.floor(F.col(y) * F.col("_fine")) for m, y in enumerate(at)})

        target, source = placed(self._side(df, "t", batch), "t"), self._side(df, "s", batch)
        spot, whole = [f"s{d}" for d in range(self.rank)], reduce(lambda a, b: a & b, (F.col(f"s_{c}").isNotNull() for c in keys))
        source = source.withColumn("_whole", whole)
        source = source.withColumn("_first", F.dense_rank().over(Window.partitionBy(*batch, *spot, "_whole").orderBy(*(f"s_{c}" for c in keys)))).filter(F.col("_first") <= k + 1).drop("_first")

        # Beyond 2^44 cubes from the origin rounding would count: there levels are coarser.
        sound = (F.col("_fine") == 1) | reduce(lambda a, b: a & b, (F.abs(F.col(y) * F.col("_fine")) < float(1 << 44) for y in at))
        counted = in_cells(placed(self._dealt(source.filter("_whole"), [*batch, *spot]), "s").withColumn("_fine", levels).filter(sound))
        full = counted.select(*batch, *cells, *(f"s_{c}" for c in keys)).distinct().groupBy(*batch, *cells).count().filter(F.col("count") > k).drop("count")
        tried = in_cells(target.select(*batch, *at).distinct().withColumn("_fine", levels).filter(sound))
        finest = tried.join(full, [*batch, *cells]).groupBy(*batch, *at).agg(F.max("_fine").alias("_fine"))

        target = in_cells(target.join(finest, [*batch, *at], "left").withColumn("_fine", F.coalesce("_fine", F.lit(1))))
        around = F.explode(F.array(*(F.struct(*(F.lit(s).alias(f"o{m}") for m, s in enumerate(shift))) for shift in product(range(-2, 3), repeat=len(dims)))))
        target = self._dealt(target, [*batch, *(f"t_{c}" for c in keys)]).withColumn("_o", around).withColumns({f"_b{m}": F.col(f"_b{m}") + F.col(f"_o.o{m}") for m in dims})
        gaps = [F.greatest(F.col(f"_b{m}") - F.col(y) * F.col("_fine"), F.col(y) * F.col("_fine") - F.col(f"_b{m}") - 1, F.lit(0.0)) for m, y in enumerate(at)]
        target = target.filter(reduce(lambda a, b: a + b, (g * g for g in gaps)) <= apart * apart).drop("_o", *at)
        source = in_cells(placed(self._images(source.drop("_whole"), reach), "s").withColumn("_fine", levels)).drop(*at)

        limit = apart * cube / F.col("_fine")
        if self.spherical and self.rank == 2:
            limit = 2 * self.radius * F.asin(F.least(F.lit(1.0), limit / (2 * self.radius)))
        joined = target.join(source, [*batch, *cells]).filter(~reduce(lambda a, b: a & b, (F.col(f"t_{c}") == F.col(f"s_{c}") for c in keys)))
        others = self._within(joined, F.least(F.lit(float(reach)), limit), batch)
        by = Window.partitionBy(*batch, *(f"t_{c}" for c in keys)).orderBy("d", *(f"s_{c}" for c in keys))
        return others.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    def gradient(self, df: DataFrame, edges: DataFrame, columns: Sequence[str], *, batch: Sequence[str] = (), active: str | None = None) -> DataFrame:
        """``df`` with c_x and c_y of each column: weighted least squares over the edges, weights 1/d².

        On a sphere the differences are metres east and north. A point whose neighbours
        don't span the plane has gradient 0, as has an inactive one; inactive neighbours
        are left out.
        """
        keys = list(self.keys)
        value = df.select(*batch, *(F.col(k).alias(f"s_{k}") for k in keys), *([F.col(active).alias("_sa")] if active else []), *(F.col(c).alias(f"_s_{c}") for c in columns))
        own = df.select(*batch, *(F.col(k).alias(f"t_{k}") for k in keys), *([F.col(self.coords[1]).alias("_lat")] if self.spherical else []), *(F.col(c).alias(f"_t_{c}") for c in columns))
        joined = edges.filter(F.col("d") > 0).join(value, [*batch, *(f"s_{k}" for k in keys)]).join(own, [*batch, *(f"t_{k}" for k in keys)])
        if active:
            joined = joined.filter("_sa")
        dx, dy = F.col("delta")[0], F.col("delta")[1]
        if self.spherical:
            dx, dy = dx * F.cos("_lat") * self.radius, dy * self.radius
        joined = joined.withColumns({"_dx": dx, "_dy": dy}).withColumn("_w", 1 / (F.col("d") * F.col("d")))
        w, dx, dy = F.col("_w"), F.col("_dx"), F.col("_dy")
        sums = {"_xx": w * dx * dx, "_xy": w * dx * dy, "_yy": w * dy * dy}
        for c in columns:
            diff = F.col(f"_s_{c}") - F.col(f"_t_{c}")
            sums |= {f"_x_{c}": w * dx * diff, f"_y_{c}": w * dy * diff}
        got = joined.groupBy(*batch, *(F.col(f"t_{k}").alias(k) for k in keys)).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
        det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
        sound = det > 1e-12 * F.col("_xx") * F.col("_yy")
        fields = {}
        for c in columns:
            fields[f"{c}_x"] = F.when(sound, (F.col("_yy") * F.col(f"_x_{c}") - F.col("_xy") * F.col(f"_y_{c}")) / det).otherwise(0.0)
            fields[f"{c}_y"] = F.when(sound, (F.col("_xx") * F.col(f"_y_{c}") - F.col("_xy") * F.col(f"_x_{c}")) / det).otherwise(0.0)
        solved = got.select(*batch, *keys, *(v.alias(n) for n, v in fields.items()))
        back = df.join(solved, [*batch, *keys], "left")
        on = F.col(active) if active else F.lit(True)
        return back.withColumns({n: F.when(on, F.coalesce(F.col(n), F.lit(0.0))).otherwise(0.0) for n in fields})


def replace_coords(points: Points, side: str) -> Points:
    from dataclasses import replace

    return replace(points, coords=tuple(f"{side}{d}" for d in range(points.rank)))
