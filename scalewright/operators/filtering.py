"""Filters: weighted means over a kernel's footprint, as joins and aggregates.

All expressions of a call are filtered in one pass. ``zerofill`` divides by the weight of
all cells of the domain, ``deformable`` by that of the active ones; inactive targets and
empty footprints give 0.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import HighOrder, Kernel, TopHat, check_scale
from ..sources.grids import Grid
from ..sources.points import Points
from . import tiles

ZEROFILL, DEFORMABLE = "zerofill", "deformable"
#: Radius in cells above which a plane is filtered by tiles instead of a scatter of its footprint.
WIDE = 8
#: Cells of a plane from which separable kernels take tiles too.
TILED_CELLS = 1 << 15
#: Weights of footprints and axes that are broadcast at most, 24 bytes each.
BROADCAST_WEIGHTS = 2_000_000
ENGINES = ("banded", "separable", "prefix", "tiled", "ball")


def choose_engine(space: Grid | Points, kernel: Kernel, scale: float) -> str:
    """The engine for a space and a kernel: separable passes, tiles, a scatter of the footprint, or a ball join."""
    check_scale(scale)
    if isinstance(space, Points):
        if not kernel.radial:
            raise ValueError("a product kernel needs a rectilinear Cartesian grid")
        return "ball"
    if kernel.separable and not space.spherical:
        large = math.prod(space.shape) >= TILED_CELLS and tiles.fits(space, kernel, scale)
        return "tiled" if large else "separable"
    if not kernel.radial:
        raise ValueError("a product kernel needs a rectilinear Cartesian grid")
    if space.spherical:
        return "banded" if space.rank == 2 and space.uniform else "ball"
    if not space.uniform:
        return "ball"
    if kernel.radius(scale) / min(a.spacing for a in space.axes) > WIDE and tiles.fits(space, kernel, scale):
        return "tiled"
    return "banded"


def _check(strategy: str) -> None:
    if strategy not in (ZEROFILL, DEFORMABLE):
        raise ValueError(f"unknown mask strategy {strategy}")


def footprint(grid: Grid, kernel: Kernel, scale: float) -> list[tuple[tuple[int, ...], float]]:
    """Index offsets within the radius of a uniform Cartesian grid, and their weights."""
    r = kernel.radius(scale)
    steps = [abs(a.step) for a in grid.axes]
    limits = [math.floor(r / h + 1e-9) if a.n > 1 or a.period else 0 for h, a in zip(steps, grid.axes, strict=True)]
    out = []
    for off in product(*(range(-n, n + 1) for n in limits)):
        d2 = sum((o * h) ** 2 for o, h in zip(off, steps, strict=True))
        if d2 <= r * r and (w := kernel.weight(math.sqrt(d2), scale)) != 0.0:
            out.append((off, w))
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    if len(rows) > BROADCAST_WEIGHTS:
        raise ValueError(f"{len(rows)} weights are too many to broadcast: coarsen the grid or use another engine")
    return F.broadcast(spark.createDataFrame(rows, schema))


def _masked(df: DataFrame, exprs: Mapping[str, Column], active: str | None) -> tuple[list[Column], Column]:
    on = F.col(active) if active else F.lit(True)
    return [(F.when(on, e) if active else e).cast("double").alias(f"_e{n}") for n, e in enumerate(exprs.values())], on


def _finish(num: DataFrame, keys: Sequence[str], names: Sequence[str], strategy: str, active: str | None) -> DataFrame:
    """Quotients of columns _e*, _all, _on, by strategy; _here says whether the target is active."""
    den = F.col("_on") if strategy == DEFORMABLE else F.col("_all")
    here = F.col("_here") if active else F.lit(True)
    out = [F.when(here & (den != 0), F.coalesce(F.col(f"_e{n}"), F.lit(0.0)) / den).otherwise(0.0).alias(name) for n, name in enumerate(names)]
    return num.select(*keys, *([F.col("_here").alias(active)] if active else []), *out)


def _shift(grid: Grid, d: int, offset: Column) -> Column:
    at = F.col(grid.dims[d]) + offset
    return (F.pmod(at - 1, F.lit(grid.axes[d].n)) + 1 if grid.axes[d].period is not None else at).cast("int")


def _inside(grid: Grid, columns: Sequence[str], dims: Sequence[int]) -> Column:
    out = F.lit(True)
    for c, d in zip(columns, dims, strict=True):
        if grid.axes[d].period is None:
            out = out & F.col(c).between(1, grid.axes[d].n)
    return out


def _gather(scattered: DataFrame, keys: Sequence[str], count: int, active: str | None, weight: str = "_w") -> DataFrame:
    w = F.col(weight)
    sums = [F.sum(w * F.col(f"_e{n}")).alias(f"_e{n}") for n in range(count)]
    more = [F.sum(w).alias("_all"), (F.sum(F.when(F.col("_m"), w)) if active else F.sum(w)).alias("_on")]
    if active:
        more.append(F.max(F.when(F.col("_self"), F.col("_m"))).alias("_here"))
    return scattered.groupBy(*keys).agg(*sums, *more)


def _banded(df, grid, kernel, scale, exprs, batch, strategy, active):
    """Cells times footprint: each product goes to its target; sums are partly made before the shuffle."""
    spark = df.sparkSession
    values, on = _masked(df, exprs, active)
    cells = df.select(*batch, *grid.dims, on.alias("_m"), *values)
    if not grid.spherical:
        fp = footprint(grid, kernel, scale)
        table = _table(spark, [(*off, w) for off, w in fp], ", ".join(f"_d{d} int" for d in range(grid.rank)) + ", _w double")
        spread = cells.crossJoin(table)
        self_offset = F.lit(True)
        for d in range(grid.rank):
            self_offset = self_offset & (F.col(f"_d{d}") == 0)
        moved = spread.select(*batch, *(_shift(grid, d, F.col(f"_d{d}")).alias(dim) for d, dim in enumerate(grid.dims)), "_m", self_offset.alias("_self"), "_w", *(f"_e{n}" for n in range(len(values))))
    else:
        table = _table(spark, spherical_bands(grid, kernel, scale), "_js int, _jt int, _d0 int, _w double")
        spread = cells.join(table, F.col(grid.dims[1]) == F.col("_js"))
        moved = spread.select(*batch, _shift(grid, 0, F.col("_d0")).alias(grid.dims[0]), F.col("_jt").alias(grid.dims[1]), "_m", ((F.col("_d0") == 0) & (F.col("_js") == F.col("_jt"))).alias("_self"), "_w", *(f"_e{n}" for n in range(len(values))))
    moved = moved.filter(_inside(grid, grid.dims, range(grid.rank)))
    return _finish(_gather(moved, [*batch, *grid.dims], len(values), active), [*batch, *grid.dims], list(exprs), strategy, active)


def spherical_bands(grid: Grid, kernel: Kernel, scale: float) -> list[tuple[int, int, int, float]]:
    """(source latitude, target latitude, longitude offset, weight times area) on a uniform grid; each cell of a ring at most once."""
    lon, lat = grid.axes
    r, big = kernel.radius(scale), grid.radius
    phi = np.array(lat.coords)
    if lon.period is not None:
        offsets = np.arange(-((lon.n - 1) // 2), lon.n // 2 + 1)
    else:
        offsets = np.arange(-(lon.n - 1), lon.n)
    half = np.sin(offsets * lon.step / 2) ** 2
    area = big * big * np.maximum(np.cos(phi), 0.0) * lon.widths[0] * lat.widths
    if lon.n == 1 or lat.n == 1:
        area = area / (big * (lon.widths[0] * np.maximum(np.cos(phi), 0.0) if lon.n == 1 else lat.widths))
    out = []
    for t in range(lat.n):
        for s in range(lat.n):
            if big * abs(phi[t] - phi[s]) > r * (1 + 1e-12):
                continue
            d = 2 * big * np.arcsin(np.minimum(1.0, np.sqrt(np.sin((phi[t] - phi[s]) / 2) ** 2 + np.cos(phi[t]) * np.cos(phi[s]) * half)))
            out += [(s + 1, t + 1, int(o), kernel.weight(float(x), scale) * float(area[s])) for o, x in zip(offsets, d, strict=True) if x <= r]
    return out


def axis_weights(grid: Grid, d: int, kernel: Kernel, scale: float) -> list[tuple[int, int, float]]:
    """(source, target, weight) of one axis, or (0, offset, weight) of a uniform one; images of a wrapped axis add up."""
    a, r = grid.axes[d], kernel.radius(scale)
    if isinstance(kernel, HighOrder) and kernel.limb * scale < a.spacing and a.n > 1:
        warnings.warn(f"limbs are narrower than a cell of axis {d + 1}: their moments do not vanish on this grid", stacklevel=2)
    if a.n == 1:
        return [(0, 0, 1.0)]
    if a.uniform:
        h = abs(a.step)
        n = math.ceil(r / h)
        return [(0, o, w) for o in range(-n, n + 1) if (w := kernel.cell_average(o * h, h, scale) if isinstance(kernel, HighOrder) else kernel.profile(o * h, scale) if abs(o * h) <= n * h else 0.0) != 0.0]
    images = math.ceil(r / a.period) if a.period is not None else 0
    out = []
    for s in range(a.n):
        for t in range(a.n):
            w = sum(kernel.cell_average(x, a.widths[s], scale) * a.widths[s] for k in range(-images, images + 1) if abs(x := a.coords[s] + k * (a.period or 0.0) - a.coords[t]) <= r + a.widths[s])
            if w:
                out.append((s + 1, t + 1, float(w)))
    return out


def _separable(df, grid, kernel, scale, exprs, batch, strategy, active):
    """One pass for each axis; a product of axis sums is the weight of the whole domain."""
    spark = df.sparkSession
    values, on = _masked(df, exprs, active)
    names = [f"_e{n}" for n in range(len(values))]
    cells = df.select(*batch, *grid.dims, *values, *([F.when(on, 1.0).otherwise(0.0).alias("_on")] if active else []))
    if active:
        names.append("_on")
    total = F.lit(1.0)
    for d, dim in enumerate(grid.dims):
        a = grid.axes[d]
        rows = axis_weights(grid, d, kernel, scale)
        sums = np.zeros(a.n)
        for s, t, w in rows:
            if s:
                sums[t - 1] += w
            elif a.period is not None:
                sums += w
            else:
                lo, hi = max(0, t), max(0, min(a.n, a.n + t))
                sums[lo:hi] += w
        total = total * grid.at(sums, d)
        table = _table(spark, rows, "_s int, _t int, _g double")
        if rows[0][0]:
            moved = cells.join(table, F.col(dim) == F.col("_s")).select(*batch, *(F.col("_t").alias(dim) if x == dim else x for x in grid.dims), "_g", *names)
        else:
            moved = cells.crossJoin(table).select(*batch, *(_shift(grid, d, F.col("_t")).alias(dim) if x == dim else x for x in grid.dims), "_g", *names).filter(_inside(grid, [dim], [d]))
        cells = moved.groupBy(*batch, *grid.dims).agg(*(F.sum(F.col("_g") * F.col(n)).alias(n) for n in names))
    num = cells.withColumn("_all", total)
    if active:
        num = num.join(df.select(*batch, *grid.dims, F.col(active).alias("_here")), [*batch, *grid.dims])
    else:
        num = num.withColumn("_on", F.col("_all"))
    return _finish(num, [*batch, *grid.dims], list(exprs), strategy, active)


def _prefix(df, grid, kernel, scale, exprs, batch, strategy, active):
    """Top-hat by running sums along the first axis: each band takes its upper sum less its lower one.

    The table must be dense. The work is cells times bands, not times offsets.
    """
    if not isinstance(kernel, TopHat) or grid.rank != 2 or grid.spherical or not grid.uniform or any(a.period is not None for a in grid.axes):
        raise ValueError("prefix sums serve a top-hat on a bounded uniform two-dimensional grid")
    spark = df.sparkSession
    i, j = grid.dims
    n = grid.axes[0].n
    hx, hy = abs(grid.axes[0].step), abs(grid.axes[1].step)
    r = kernel.radius(scale)
    bands = [(dj, min(n, math.floor(math.sqrt(max(r * r - (dj * hy) ** 2, 0.0)) / hx + 1e-9))) for dj in range(-math.floor(r / hy + 1e-9), math.floor(r / hy + 1e-9) + 1)]
    values, on = _masked(df, exprs, active)
    by = Window.partitionBy(*batch, j).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_e{k}" for k in range(len(values))] + ["_all", "_on"]
    cells = df.select(*batch, i, j, *(F.coalesce(v, F.lit(0.0)).alias(f"_e{k}") for k, v in enumerate(values)), F.lit(1.0).alias("_all"), F.when(on, 1.0).otherwise(0.0).alias("_on"))
    sums = cells.select(*batch, i, j, *(F.sum(c).over(by).alias(c) for c in names))
    spread = sums.crossJoin(_table(spark, bands, "_dj int, _half int"))
    lower = F.array_compact(F.array(F.when(F.col(i) + F.col("_half") + 1 <= n, F.struct((F.col(i) + F.col("_half") + 1).alias("t"), F.lit(-1.0).alias("g")))))
    upper = F.when(F.col(i) < n, F.array_compact(F.array(F.when(F.col(i) - F.col("_half") >= 1, F.struct((F.col(i) - F.col("_half")).alias("t"), F.lit(1.0).alias("g")))))).otherwise(F.transform(F.sequence(F.greatest(F.lit(1), F.lit(n) - F.col("_half")), F.lit(n)), lambda t: F.struct(t.alias("t"), F.lit(1.0).alias("g"))))
    moved = spread.withColumn("_p", F.explode(F.concat(lower, upper))).select(*batch, F.col("_p.t").cast("int").alias(i), (F.col(j) + F.col("_dj")).cast("int").alias(j), F.col("_p.g").alias("_g"), *names).filter(_inside(grid, [j], [1]))
    num = moved.groupBy(*batch, i, j).agg(*(F.sum(F.col("_g") * F.col(c)).alias(c) for c in names))
    if active:
        num = num.join(df.select(*batch, i, j, F.col(active).alias("_here")), [*batch, i, j])
    return _finish(num, [*batch, i, j], list(exprs), strategy, active)


def as_points(grid: Grid) -> Points:
    period = tuple(a.period for a in grid.axes) if not grid.spherical else None
    return Points(grid.dims, tuple(f"_c{d}" for d in range(grid.rank)), "_area", grid.geometry, grid.radius, period)


def _ball(df, space, kernel, scale, exprs, batch, strategy, active, edges=None):
    """Join by distance, weights by kernel and measure; a top-hat on Cartesian points is summed by blocks instead."""
    if isinstance(space, Grid):
        df = df.withColumns({f"_c{d}": space.coord(d) for d in range(space.rank)} | {"_area": space.measure()})
        space = as_points(space)
    keys = list(space.keys)
    values, on = _masked(df, exprs, active)
    carried = [space.measure().alias("_area"), on.alias("_m"), *values]
    names = ["_area", "_m", *(f"_e{n}" for n in range(len(values)))]
    if edges is None:  # Values come along with the pairs: to join them by key afterwards would shuffle every pair.
        rows = df.select(*dict.fromkeys([*batch, *keys, *(c for c in space.coords if c not in names)]), *carried)
        if isinstance(kernel, TopHat) and not space.spherical:
            return _finish(tiles.ball_sums(rows, space, kernel.radius(scale), len(values), batch=batch, active=active), [*batch, *keys], list(exprs), strategy, active)
        joined = space.edges(rows, kernel.radius(scale), batch=batch, carry=names)
    else:
        joined = edges.join(df.select(*batch, *(F.col(k).alias(f"s_{k}") for k in keys), *carried), [*batch, *(f"s_{k}" for k in keys)])
    own = F.lit(True)
    for k in keys:
        own = own & (F.col(f"t_{k}") == F.col(f"s_{k}"))
    moved = joined.select(*batch, *(F.col(f"t_{k}").alias(k) for k in keys), (kernel.weight_column(F.col("d"), scale) * F.col("_area")).alias("_w"), "_m", own.alias("_self"), *(f"_e{n}" for n in range(len(values))))
    return _finish(_gather(moved, [*batch, *keys], len(values), active), [*batch, *keys], list(exprs), strategy, active)


def filter_exprs(df: DataFrame, space: Grid | Points, kernel: Kernel, scale: float, exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None, engine: str = "auto", edges: DataFrame | None = None) -> DataFrame:
    """Filtered expressions by target: batch and key columns, ``active`` if given, one column for each name.

    ``batch`` columns keep slices (levels, times) apart. A null value counts as 0 in the
    sum and still weighs in zerofill's divisor; use ``Grid.densify`` to make it inactive.
    """
    check_scale(scale)
    _check(strategy)
    chosen = choose_engine(space, kernel, scale) if engine == "auto" else engine
    if chosen not in ENGINES:
        raise ValueError(f"unknown engine {engine}")
    if chosen == "ball":
        if not kernel.radial:
            raise ValueError("a product kernel needs a rectilinear Cartesian grid")
        return _ball(df, space, kernel, scale, exprs, list(batch), strategy, active, edges)
    if isinstance(space, Points):
        raise ValueError("point sets are filtered by the ball engine")
    run = {"banded": _banded, "separable": _separable, "prefix": _prefix}.get(chosen)
    if chosen == "separable" and (not kernel.separable or space.spherical):
        raise ValueError("separable passes need a separable kernel on a Cartesian grid")
    if chosen == "tiled":
        return tiles.tiled_filter(df, space, kernel, scale, exprs, batch=batch, strategy=strategy, active=active)
    if chosen == "banded" and not space.uniform:
        raise ValueError("a footprint of offsets needs a uniform grid")
    return run(df, space, kernel, scale, exprs, list(batch), strategy, active)


def filter_field(df: DataFrame, space: Grid | Points, kernel: Kernel, scale: float, columns: Sequence[str] | str, **kw) -> DataFrame:
    """Filtered columns under their own names."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    return filter_exprs(df, space, kernel, scale, {c: F.col(c) for c in columns}, **kw)


def filter_slices(df: DataFrame, slice_key: str, spaces: Mapping[object, Grid], kernel: Kernel, scale: float, columns: Sequence[str], **kw) -> DataFrame:
    """Slices with grids of their own: those of equal grids go through one plan, keyed by slice."""
    groups: dict[Grid, list[object]] = {}
    for key, grid in spaces.items():
        groups.setdefault(grid, []).append(key)
    out = None
    for grid, keys in sorted(groups.items(), key=lambda g: -math.prod(g[0].shape) * len(g[1])):
        part = filter_field(df.filter(F.col(slice_key).isin(keys)), grid, kernel, scale, columns, batch=[slice_key], **kw)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there are no slices")
    return out
