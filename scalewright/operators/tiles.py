"""Filters by tiles: bands of rows with a margin go to NumPy, one task each.

Where a footprint holds hundreds of cells, sums over whole rows cost far less than a
product for each pair of cells. A tile is a run of rows (second axis) over the full first
axis; its margin is the kernel's reach, so tiles need nothing of each other, a task holds
one tile, and the shuffle is the table once and its margins.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import Kernel, TopHat, check_scale
from ..sources.grids import Grid
from ..sources.points import Points

#: Cells of a tile without its margin, about; a tile never has fewer rows than its margin.
TILE_CELLS = 500_000
#: Cells of a tile with its margin that one task may hold.
MAX_CELLS = 1 << 24
#: Pairs of points whose distances are taken together, at least one target's; they should fit in a core's cache.
PAIRS = 1 << 17


def fits(grid: Grid, kernel: Kernel, scale: float) -> bool:
    """Whether tiles serve this filter and stay within MAX_CELLS."""
    if grid.rank != 2 or grid.spherical or not grid.uniform:
        return False
    reach = _reach(grid, kernel, scale)
    return grid.axes[0].n * (_rows(grid, reach[1]) + 2 * reach[1]) <= MAX_CELLS


def _reach(grid: Grid, kernel: Kernel, scale: float) -> list[int]:
    r = kernel.radius(scale)
    if kernel.separable:
        return [math.ceil(r / abs(a.step)) if a.n > 1 else 0 for a in grid.axes]
    return [math.floor(r / abs(a.step) + 1e-9) if a.n > 1 or a.period else 0 for a in grid.axes]


def _rows(grid: Grid, reach: int) -> int:
    return min(grid.axes[1].n, max(1, reach, TILE_CELLS // grid.axes[0].n))


def _spread(x: np.ndarray, reach: int, wrap: bool) -> np.ndarray:
    """Columns with a margin on both sides: images of a wrapped axis, else zeros."""
    if not reach:
        return x
    if wrap:
        n = x.shape[1]
        return x[:, np.arange(-reach, n + reach) % n]
    return np.pad(x, ((0, 0), (reach, reach)))


def _sums(kernel: Kernel, grid: Grid, scale: float, reach: Sequence[int], wrap: bool):
    """A function from rows with margin to weighted sums over the footprint for the rows within."""
    rx, ry = reach
    hx, hy = (abs(a.step) for a in grid.axes)
    n = grid.axes[0].n
    if kernel.separable:
        weights = [np.array([kernel.cell_average(k * h, h, scale) for k in range(-r, r + 1)]) for r, h in ((rx, hx), (ry, hy))]

        def run(x: np.ndarray) -> np.ndarray:
            wide = _spread(x, rx, wrap)
            along = sum(w * wide[:, k : k + n] for k, w in enumerate(weights[0]))
            rows = x.shape[0] - 2 * ry
            return sum(w * along[k : k + rows] for k, w in enumerate(weights[1]))

        return run
    r = kernel.radius(scale)
    halves = [min(rx, math.floor(math.sqrt(max(r * r - (dj * hy) ** 2, 0.0)) / hx + 1e-9)) for dj in range(-ry, ry + 1)]
    if isinstance(kernel, TopHat):

        def run(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(_spread(x, rx, wrap), axis=1)
            total = np.concatenate([np.zeros((len(total), 1)), total], axis=1)
            rows = x.shape[0] - 2 * ry
            out = np.zeros((rows, n))
            for k, h in enumerate(halves):
                part = total[k : k + rows]
                out += part[:, rx + h + 1 : rx + h + 1 + n] - part[:, rx - h : rx - h + n]
            return out

        return run
    table = [[(di, kernel.weight(math.hypot(di * hx, dj * hy), scale)) for di in range(-h, h + 1)] for dj, h in zip(range(-ry, ry + 1), halves, strict=True)]

    def run(x: np.ndarray) -> np.ndarray:
        wide = _spread(x, rx, wrap)
        rows = x.shape[0] - 2 * ry
        out = np.zeros((rows, n))
        for k, line in enumerate(table):
            for di, w in line:
                out += w * wide[k : k + rows, rx + di : rx + di + n]
        return out

    return run


def tiled_filter(df: DataFrame, grid: Grid, kernel: Kernel, scale: float, exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = "zerofill", active: str | None = None) -> DataFrame:
    """Filtered expressions by target, as ``filter_exprs`` gives them, on a uniform Cartesian plane.

    Sums of a top-hat are differences of running sums, exact for integer fields.
    """
    check_scale(scale)
    if not fits(grid, kernel, scale):
        raise ValueError("tiles serve uniform Cartesian planes whose rows and margins fit a task")
    i, j = grid.dims
    nx, ny = grid.shape
    reach = _reach(grid, kernel, scale)
    rows, margin = _rows(grid, reach[1]), reach[1]
    tiles = math.ceil(ny / rows)
    wrap_i, wrap_j = (a.period is not None for a in grid.axes)
    on = F.col(active) if active else F.lit(True)
    values = [F.when(on, e).otherwise(0.0).cast("double").alias(f"_e{n}") for n, e in enumerate(exprs.values())]
    cells = df.select(*batch, F.col(i).cast("int").alias(i), F.col(j).cast("int").alias(j), on.alias("_m"), *values)
    if wrap_j:
        turns = math.ceil(margin / ny)
        cells = cells.withColumn("_jj", F.explode(F.transform(F.sequence(F.lit(-turns), F.lit(turns)), lambda k: (F.col(j) + k * ny).cast("int")))).filter(F.col("_jj").between(1 - margin, ny + margin))
    else:
        cells = cells.withColumn("_jj", F.col(j))
    first = F.greatest(F.lit(0), F.floor((F.col("_jj") - 1 - margin) / rows)).cast("int")
    last = F.least(F.lit(tiles - 1), F.floor((F.col("_jj") - 1 + margin) / rows)).cast("int")
    dealt = cells.filter(first <= last).withColumn("_tile", F.explode(F.sequence(first, last)))
    names = list(exprs)
    kinds = {f.name: f.dataType for f in dealt.schema}
    fields = [*(T.StructField(c, kinds[c]) for c in [*batch, i, j]), *([T.StructField(active, T.BooleanType())] if active else []), *(T.StructField(c, T.DoubleType()) for c in names)]
    total = _sums(kernel, grid, scale, reach, wrap_i)

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("_tile")[0].as_py()
        low, high = tile * rows + 1, min(ny, (tile + 1) * rows)
        height = high - low + 1 + 2 * margin
        at = (table.column("_jj").to_numpy() - (low - margin)) * nx + table.column(i).to_numpy() - 1

        def dense(column) -> np.ndarray:
            out = np.zeros(height * nx)
            out[at] = column
            return out.reshape(height, nx)

        mask = table.column("_m").to_numpy().astype(float)
        if strategy == "deformable":
            den = total(dense(mask))
        else:
            inside = np.zeros((height, nx))
            start = low - margin
            inside[max(0, 1 - start) : ny + 1 - start] = 1.0
            den = total(np.ones((height, nx)) if wrap_j else inside)
        here = dense(np.ones(len(mask)))[margin : height - margin].astype(bool).ravel()
        live = dense(mask)[margin : height - margin].astype(bool).ravel()
        den = den.ravel()
        sound = live & (den != 0)
        out = {}
        for k, name in enumerate(names):
            num = total(dense(table.column(f"_e{k}").to_numpy())).ravel()
            out[name] = np.where(sound, num / np.where(sound, den, 1.0), 0.0)[here]
        cell = np.flatnonzero(here)
        columns = [pa.repeat(table.column(c)[0], len(cell)) for c in batch]
        columns += [pa.array((cell % nx + 1).astype(np.int32)), pa.array((cell // nx + low).astype(np.int32))]
        columns += [pa.array(live[here])] if active else []
        columns += [pa.array(out[c]) for c in names]
        return pa.Table.from_arrays(columns, names=[f.name for f in fields])

    return dealt.groupBy(*batch, "_tile").applyInArrow(run, T.StructType(fields))


def within(targets: np.ndarray, sources: np.ndarray, values: np.ndarray, reach: float) -> np.ndarray:
    """Sums of the values of the sources within ``reach`` of each target, by straight distance."""
    order, back = np.argsort(sources[:, 0], kind="stable"), np.argsort(targets[:, 0], kind="stable")
    sources, values, targets = sources[order], values[order], targets[back]
    finite = np.isfinite(values).all(axis=1)
    sound = np.where(finite[:, None], values, 0.0)
    out = np.zeros((len(targets), values.shape[1]))
    step = max(1, min(128, PAIRS // max(1, len(sources))))
    for i in range(0, len(targets), step):
        part = targets[i : i + step]
        wide = reach * (1 + 1e-6) + 1e-12 * max(abs(part[0, 0]), abs(part[-1, 0]))
        low, high = np.searchsorted(sources[:, 0], part[0, 0] - wide), np.searchsorted(sources[:, 0], part[-1, 0] + wide, "right")
        square = np.zeros((len(part), high - low))
        for d in range(sources.shape[1]):
            gap = sources[low:high, d] - part[:, d, None]
            gap *= gap
            square += gap
        near = np.sqrt(square, out=square) <= reach
        sums = near.astype(float) @ sound[low:high]
        for k in low + np.flatnonzero(~finite[low:high]):
            sums[near[:, k - low]] += values[k]
        out[back[i : i + step]] = sums
    return out


def ball_sums(rows: DataFrame, space: Points, reach: float, count: int, *, batch: Sequence[str] = (), active: str | None = None) -> DataFrame:
    """Sums over the ball around each Cartesian point, equally weighted by distance: keys, _e*, _all, _on and _here.

    ``rows`` hold keys, coordinates, a measure _area, a mask _m and ``count`` values _e*. A
    task takes a cube's points and those around at once, so pairs are not rows.
    """
    names = ["_area", "_m", *(f"_e{n}" for n in range(count))]
    dealt = space.blocks(rows, reach, batch=batch, carry=names)
    keys, cells = [*batch, *space.keys], [*batch, *(f"b{d}" for d in range(space.rank))]
    sums = [*(f"_e{n}" for n in range(count)), "_all", "_on"]
    kinds = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in keys), T.StructField("_here", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in sums)])

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("_own"))
        if not len(own):
            return pa.Table.from_pylist([], schema=pa.schema([*(table.schema.field(c) for c in keys), ("_here", pa.bool_()), *((c, pa.float64()) for c in sums)]))
        place = lambda t: np.column_stack([t.column(f"x{d}").to_numpy() for d in range(space.rank)])
        area = table.column("_area").fill_null(0.0).to_numpy()
        values = [area * table.column(f"_e{n}").fill_null(0.0).to_numpy() for n in range(count)]
        mask = table.column("_m").fill_null(False).to_numpy()
        got = within(place(own), place(table), np.column_stack([*values, area, np.where(mask, area, 0.0)]), reach)
        return pa.Table.from_arrays([*(own.column(c) for c in keys), own.column("_m"), *(pa.array(got[:, n]) for n in range(len(sums)))], names=[*keys, "_here", *sums])

    return dealt.groupBy(*cells).applyInArrow(run, schema).groupBy(*keys).agg(F.max("_here").alias("_here"), *(F.sum(c).alias(c) for c in sums))
