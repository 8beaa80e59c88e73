"""Derivatives along grid axes by three-node stencils that stay within active runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grids import Grid


def _stencil(value, x, on) -> Column:
    """Weights of the quadratic through three active neighbours of the cell, of a line through two, or 0."""

    def three(a, b, c):
        # The slope at offset 0 of the parabola through offsets a, b, c.
        xa, xb, xc, x0 = x(a), x(b), x(c), x(0)
        return value(a) * (2 * x0 - xb - xc) / ((xa - xb) * (xa - xc)) + value(b) * (2 * x0 - xa - xc) / ((xb - xa) * (xb - xc)) + value(c) * (2 * x0 - xa - xb) / ((xc - xa) * (xc - xb))

    def two(a, b):
        return (value(b) - value(a)) / (x(b) - x(a))

    left, right = on(-1), on(1)
    return F.when(left & right, three(-1, 0, 1)).when(right & on(2), three(0, 1, 2)).when(left & on(-2), three(-2, -1, 0)).when(right, two(0, 1)).when(left, two(-1, 0)).otherwise(0.0)


def derivatives(df: DataFrame, grid: Grid, columns: Sequence[str], *, dims: Sequence[int] | None = None, batch: Sequence[str] = (), active: str | None = None, suffixes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``df`` with c_x, c_y, c_z: derivatives with respect to distance; inactive cells have 0.

    The table must be dense in each batch. On a sphere a derivative is divided by
    R cos(latitude), by R, or by 1 for the radius; at a pole the eastward one is 0. Wrapped
    axes are continued by copies of two cells beyond each seam, which go again. One
    window for each axis serves all columns.
    """
    out = df
    for d in dims if dims is not None else range(grid.rank):
        a, dim = grid.axes[d], grid.dims[d]
        names = [f"{c}_{suffixes[d]}" for c in columns]
        if a.n < 2:
            out = out.withColumns({n: F.lit(0.0) for n in names})
            continue
        work = out.withColumns({"_x": grid.coord(d), "_copy": F.lit(False)})
        if a.period is not None:
            sign = 1.0 if a.coords[-1] > a.coords[0] else -1.0
            k = min(2, a.n)
            ahead = work.filter(F.col(dim) <= k).withColumns({dim: F.col(dim) + a.n, "_x": F.col("_x") + sign * a.period, "_copy": F.lit(True)})
            behind = work.filter(F.col(dim) > a.n - k).withColumns({dim: F.col(dim) - a.n, "_x": F.col("_x") - sign * a.period, "_copy": F.lit(True)})
            work = work.unionByName(ahead).unionByName(behind)
        others = [x for e, x in enumerate(grid.dims) if e != d]
        by = Window.partitionBy(*batch, *others).orderBy(dim)

        def shifted(c: Column, k: int, by=by) -> Column:
            return c if k == 0 else F.lead(c, k).over(by) if k > 0 else F.lag(c, -k).over(by)

        on_here = F.col(active) if active else F.lit(True)
        moved = {}
        for k in (-2, -1, 1, 2):
            moved[f"_x{k}"] = shifted(F.col("_x"), k)
            moved[f"_m{k}"] = F.coalesce(shifted(on_here, k), F.lit(False))
            for n, c in enumerate(columns):
                moved[f"_v{n}_{k}"] = shifted(F.col(c), k)
        work = work.withColumns(moved)
        x = lambda k: F.col("_x") if k == 0 else F.col(f"_x{k}")
        on = lambda k: F.col(f"_m{k}")
        factor = F.lit(1.0)
        if grid.spherical and d < 2:
            r = grid.coord(2) if grid.rank == 3 else F.lit(float(grid.radius))
            cosine = grid.at(np.where(np.abs(np.cos(grid.axes[1].coords)) > np.sqrt(np.finfo(float).eps), np.cos(grid.axes[1].coords), 0.0), 1)
            factor = r * cosine if d == 0 else r
        fields = {}
        for n, (c, name) in enumerate(zip(columns, names, strict=True)):
            value = lambda k, n=n, c=c: F.col(c) if k == 0 else F.col(f"_v{n}_{k}")
            fields[name] = F.when(on_here & (factor != 0), _stencil(value, x, on) / factor).otherwise(0.0)
        work = work.withColumns(fields).filter(~F.col("_copy"))
        out = work.select(*out.columns, *names) if not set(names) & set(out.columns) else work.select(*(c for c in out.columns if c not in names), *names)
        out = out.withColumn(dim, F.col(dim).cast("int"))
    return out


def level_derivative(df: DataFrame, columns: Sequence[str], level: str, spacing: float, *, keys: Sequence[str], active: str | None = None) -> DataFrame:
    """c_z along a stack of levels of constant spacing, over the columns of cells with these keys."""
    by = Window.partitionBy(*keys).orderBy(level)
    on = F.col(active) if active else F.lit(True)
    fields = {}
    for c in columns:
        value = lambda k, c=c: F.col(c) if k == 0 else F.lead(c, k).over(by) if k > 0 else F.lag(c, -k).over(by)
        middle = (value(1) - value(-1)) / (2 * spacing)
        low = (-3 * value(0) + 4 * value(1) - value(2)) / (2 * spacing)
        high = (3 * value(0) - 4 * value(-1) + value(-2)) / (2 * spacing)
        pair = F.coalesce((value(1) - value(0)) / spacing, (value(0) - value(-1)) / spacing, F.lit(0.0))
        fields[f"{c}_z"] = F.when(on, F.coalesce(middle, low, high, pair)).otherwise(0.0)
    return df.withColumns(fields)
