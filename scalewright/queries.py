"""Queries of the field operators over grids that are derived from the tables, with SQL that computes the same.

Field values are small integers, so sums are exact; results are rounded to six digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Axis, Gaussian, Grid, HighOrder, HyperGaussian, Points, Setting, SharpSpectral, SmoothHat, TopHat, check_setup, coarse_grain, coarse_grain_profile, coarse_grain_slices
from .operators import diagnostics as D
from .operators import spectral as S
from .operators.derivatives import derivatives, level_derivative
from .operators.filtering import DEFORMABLE, ZEROFILL, filter_exprs, filter_field, filter_slices
from .plans.sweep import map_data, spectrum_data
from .sources import corner_areas, neighbours

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NX, NY = 50, 11
PLANE = Grid.box(NX, NY)
TORUS = Grid.box(NX, NY, periodic=True)
LINE = Grid.box(NX)
BOX = Grid.box(NX, NY, 3)

#: Cells from lineitem: quantity by discount, with integer fields and a block of inactive cells.
CELLS_SQL = """
cells AS (SELECT i, j, (a % 41 - 20)::DOUBLE AS u, (b % 37 - 18)::DOUBLE AS v, (c % 23 - 11)::DOUBLE AS w, (b % 29)::DOUBLE AS th, (c % 7 + 3)::DOUBLE AS rho, (a % 13 + 5)::DOUBLE AS p,
  NOT (i BETWEEN 12 AND 18 AND j BETWEEN 4 AND 6) AND i <> 1 AS active
  FROM (SELECT CAST(l_quantity AS INT) AS i, CAST(round(l_discount * 100) AS INT) + 1 AS j, sum(l_linenumber * 3 + l_suppkey % 7)::BIGINT AS a, sum(l_linenumber + l_partkey % 11)::BIGINT AS b, count(*)::BIGINT AS c FROM lineitem GROUP BY 1, 2) x)
"""


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fields(sums: DataFrame) -> DataFrame:
    part = lambda c, m, low: (F.col(c) % m - low).cast("double")
    return sums.withColumns({"u": part("a", 41, 20), "v": part("b", 37, 18), "w": part("c", 23, 11), "th": part("b", 29, 0), "rho": part("c", 7, -3), "p": part("a", 13, -5)}).drop("a", "b", "c")


def _sums(line: DataFrame, *keys: Column) -> DataFrame:
    return line.groupBy(*keys).agg(F.sum(F.col("l_linenumber") * 3 + F.col("l_suppkey") % 7).cast("long").alias("a"), F.sum(F.col("l_linenumber") + F.col("l_partkey") % 11).cast("long").alias("b"), F.count(F.lit(1)).alias("c"))


def _i() -> Column:
    return F.col("l_quantity").cast("int").alias("i")


def _j() -> Column:
    return (F.round(F.col("l_discount") * 100).cast("int") + 1).alias("j")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each cell of the 50 x 11 plane."""
    df = _fields(_sums(_read(spark, sf, "lineitem"), _i(), _j()))
    return df.withColumn("active", ~(F.col("i").between(12, 18) & F.col("j").between(4, 6)) & (F.col("i") != 1))


def sphere_cells(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """One row for each cell of 2n - 1 longitudes and n latitudes: quantity and discount by remainder, so every row of lineitem counts."""
    return _fields(_sums(_read(spark, sf, "lineitem"), (F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(2 * n - 1)) + 1).alias("i"), (F.pmod(F.round(F.col("l_discount") * 100).cast("int"), F.lit(n)) + 1).alias("j")))


def _sphere_sql(n: int, scale: float) -> str:
    """Least squares by harmonics below degree n, order by order, each degree times exp(-k (k + 1) scale^2 / 24)."""
    x = np.sin(math.pi / 2 - math.pi * (np.arange(n) + 0.5) / n)
    rows = []
    for m in range(n):
        p = np.array([(1 - x * x) ** (m / 2) * np.polynomial.Legendre.basis(k).deriv(m)(x) for k in range(m, n)]).T
        p /= np.linalg.norm(p, axis=0)
        w = p @ np.diag([math.exp(-k * (k + 1) * scale * scale / 24) for k in range(m, n)]) @ np.linalg.pinv(p)
        rows += [f"({m}, {a + 1}, {b + 1}, {float((1 if m == 0 else 2) * w[a, b] / (2 * n - 1))!r}::DOUBLE)" for a in range(n) for b in range(n)]
    sums = f"SELECT (CAST(l_quantity AS INT) - 1) % {2 * n - 1} + 1 AS i, CAST(round(l_discount * 100) AS INT) % {n} + 1 AS j, sum(l_linenumber * 3 + l_suppkey % 7)::BIGINT AS a FROM lineitem GROUP BY 1, 2"
    return f"WITH k(m, j, b, w) AS (VALUES {", ".join(rows)}), cells AS (SELECT i, j, (a % 41 - 20)::DOUBLE AS u FROM ({sums}) x), f AS (SELECT t.i, t.j, sum(k.w * cos(2 * pi() * k.m * (t.i - c.i) / {2 * n - 1}) * c.u) AS u FROM cells t JOIN k ON k.j = t.j JOIN cells c ON c.j = k.b GROUP BY 1, 2) SELECT i, j, {_rs('u')} FROM f"


def _r(df: DataFrame, *names: str, keys=("i", "j")) -> DataFrame:
    return df.select(*keys, *((F.round(n, 6) + 0.0).alias(n) for n in names))


def _rs(*names: str, of: str = "") -> str:
    return ", ".join(f"round({of}{n}, 6) + 0.0 AS {n}" for n in names)


def _register(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def sql_filter(exprs: dict[str, str], support: str, weight: str = "1.0", *, source: str = "cells", keys=("i", "j"), strategy: str = ZEROFILL, mask: bool = False) -> str:
    """A filter as a join of a table with itself; n is the neighbour, t the target."""
    on = "n.active" if mask else "true"
    den = f"sum(CASE WHEN {on} THEN {weight} END)" if strategy == DEFORMABLE else f"sum({weight})"
    here = "t.active" if mask else "true"
    columns = ", ".join(f"CASE WHEN {here} THEN coalesce(sum(CASE WHEN {on} THEN {weight} * ({e}) END) / nullif({den}, 0), 0) ELSE 0 END AS {k}" for k, e in exprs.items())
    group = ", ".join(f"t.{k}" for k in keys) + (", t.active" if mask else "")
    return f"SELECT {group}, {columns} FROM {source} t JOIN {source} n ON {support} GROUP BY {group}"


def sql_slope(f: str, by: str, part: str, *, step: str = "1.0", mask: bool = False) -> str:
    """The three-node slope along a column, within active runs."""
    w = f"OVER (PARTITION BY {part} ORDER BY {by})" if part else f"OVER (ORDER BY {by})"
    at = lambda k: f if k == 0 else f"{'lead' if k > 0 else 'lag'}({f}, {abs(k)}) {w}"
    a = "active" if mask else "true"
    on = lambda k: f"coalesce({'lead' if k > 0 else 'lag'}({a}, {abs(k)}) {w}, false)"
    return f"(CASE WHEN NOT {a} THEN 0 WHEN {on(-1)} AND {on(1)} THEN ({at(1)} - {at(-1)}) / 2 WHEN {on(1)} AND {on(2)} THEN (-3 * {f} + 4 * {at(1)} - {at(2)}) / 2 WHEN {on(-1)} AND {on(-2)} THEN (3 * {f} - 4 * {at(-1)} + {at(-2)}) / 2 WHEN {on(1)} THEN {at(1)} - {f} WHEN {on(-1)} THEN {f} - {at(-1)} ELSE 0 END / {step})"


def _dx(f: str, **kw) -> str:
    return sql_slope(f, "i", "j", **kw)


def _dy(f: str, **kw) -> str:
    return sql_slope(f, "j", "i", **kw)


def disk(scale: float) -> str:
    return f"(n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j) <= {scale * scale / 4}"


def square(kernel, scale: float, dims=("i", "j")) -> str:
    r = math.ceil(kernel.radius(scale))
    return " AND ".join(f"abs(n.{d} - t.{d}) <= {r}" for d in dims)


def gauss(scale: float, dims=("i", "j"), alpha: float = 6.0) -> str:
    d2 = " + ".join(f"(n.{d} - t.{d}) * (n.{d} - t.{d})" for d in dims)
    return f"exp(-{alpha} * ({d2}) / {scale * scale})"


_D = "sqrt((n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j))"


def _filter_query(grid: Grid, kernel, scale: float, *, strategy: str = ZEROFILL, mask: bool = True, engine: str = "auto", columns=("u",)) -> Query:
    def run(spark, sf):
        df = cells(spark, sf)
        return _r(filter_field(df, grid, kernel, scale, list(columns), strategy=strategy, active="active" if mask else None, engine=engine), *columns)

    return run


def _plain(body: str, *names: str, keys: str = "i, j", ctes: str = CELLS_SQL) -> str:
    return f"WITH {ctes}, f AS ({body}) SELECT {keys}, {_rs(*names)} FROM f"


def _build_filters() -> None:
    for name, strategy in (("zerofill", ZEROFILL), ("deformable", DEFORMABLE)):
        _register(f"filter_tophat_{name}", _filter_query(PLANE, TopHat(), 6.0, strategy=strategy), _plain(sql_filter({"u": "n.u"}, disk(6), strategy=strategy, mask=True), "u"))
        _register(f"filter_gaussian_{name}", _filter_query(PLANE, Gaussian(), 4.0, strategy=strategy), _plain(sql_filter({"u": "n.u"}, square(Gaussian(), 4), gauss(4), strategy=strategy, mask=True), "u"))
    _register("filter_tophat_prefix", _filter_query(PLANE, TopHat(), 9.0, engine="prefix"), _plain(sql_filter({"u": "n.u"}, disk(9), mask=True), "u"))
    images = f"{CELLS_SQL}, far AS (SELECT c.i + 50 * a.k AS i, c.j + 11 * b.k AS j, u FROM cells c, (VALUES (-1), (0), (1)) a(k), (VALUES (-1), (0), (1)) b(k))"
    body = f"SELECT t.i, t.j, avg(n.u) AS u FROM cells t JOIN far n ON {disk(6)} GROUP BY t.i, t.j"
    _register("filter_tophat_periodic", _filter_query(TORUS, TopHat(), 6.0, mask=False), _plain(body, "u", ctes=images))
    body = f"SELECT t.i, t.j, sum({gauss(4)} * n.u) / sum({gauss(4)}) AS u FROM cells t JOIN far n ON {square(Gaussian(), 4)} GROUP BY t.i, t.j"
    _register("filter_gaussian_periodic", _filter_query(TORUS, Gaussian(), 4.0, mask=False), _plain(body, "u", ctes=images))
    r = SmoothHat().radius(5.0)
    _register("filter_smoothhat", _filter_query(PLANE, SmoothHat(), 5.0), _plain(sql_filter({"u": "n.u"}, f"{_D} <= {r!r}", f"(0.5 * (1 - tanh(10.0 * (2 * {_D} / 5.0 - 1))))", mask=True), "u"))
    r = HyperGaussian().radius(5.0)
    _register("filter_hypergaussian", _filter_query(PLANE, HyperGaussian(), 5.0), _plain(sql_filter({"u": "n.u"}, f"{_D} <= {r!r}", f"exp(-pow(2 * {_D} / 5.0, 4))", mask=True), "u"))
    sinc = f"(CASE WHEN {_D} = 0 THEN 1.0 ELSE sin({math.pi!r} * {_D} / 1.5) / ({math.pi!r} * {_D} / 1.5) END)"
    _register("filter_sharp_sinc", _filter_query(PLANE, SharpSpectral(), 1.5, mask=False), _plain(sql_filter({"u": "n.u"}, f"{_D} <= 15", sinc), "u"))
    for order in (3, 5):
        kernel = HighOrder(order)
        edge = [0.0, 6.0] + [6.0 + 1.5 * (k + 1) for k in range(len(kernel.amplitudes))]
        heights = [1.0, *kernel.amplitudes]
        integral = lambda x: "(" + " + ".join(f"{h!r} * least(greatest(abs({x}) - {a!r}, 0), {b - a!r})" for h, a, b in zip(heights, edge, edge[1:], strict=False)) + f") * sign({x})"  # noqa: B023, E731
        g = lambda d: f"({integral(f'(n.{d} - t.{d} + 0.5)')} - {integral(f'(n.{d} - t.{d} - 0.5)')})"
        _register(f"filter_highorder{order}", _filter_query(PLANE, kernel, 12.0), _plain(sql_filter({"u": "n.u"}, square(kernel, 12), f"({g('i')}) * ({g('j')})", mask=True), "u"))

    def stretched(spark, sf):
        grid = Grid((Axis.of([x * x / 10 for x in range(1, NX + 1)]), Axis.of([float(y) for y in range(NY)])))
        return _r(filter_field(cells(spark, sf), grid, TopHat(), 6.0, "u", active="active"), "u")

    width = "(CASE WHEN n.i = 1 THEN 0.3 WHEN n.i = 50 THEN 9.9 ELSE (2 * n.i) / 10.0 END)"
    far = "(n.i * n.i - t.i * t.i) / 10.0"
    _register("filter_nonuniform_axis", stretched, _plain(sql_filter({"u": "n.u"}, f"sqrt({far} * {far} + (n.j - t.j) * (n.j - t.j)) <= 3.0", width, mask=True), "u"))

    def stretched_gauss(spark, sf):
        grid = Grid((Axis.of([x * x / 10 for x in range(1, NX + 1)]), Axis.of([float(y) for y in range(NY)])))
        return _r(filter_field(cells(spark, sf), grid, Gaussian(), 6.0, "u"), "u")

    body = sql_filter({"u": "n.u"}, f"abs({far}) < {Gaussian().radius(6.0) + 9.9!r} AND abs(n.j - t.j) <= {math.ceil(Gaussian().radius(6.0))}", f"exp(-6.0 * ({far} * {far} + (n.j - t.j) * (n.j - t.j)) / 36.0) * {width}")
    _register("filter_nonuniform_gaussian", stretched_gauss, _plain(body, "u"))

    def falling(spark, sf):
        grid = Grid((Axis.of([float(-x) for x in range(NX)]), Axis.of([float(y) for y in range(NY)])))
        return _r(derivatives(filter_field(cells(spark, sf), grid, TopHat(), 6.0, "u"), grid, ["u"], dims=[0]), "u", "u_x")

    _register("filter_descending_axis", falling, f"WITH {CELLS_SQL}, f AS ({sql_filter({'u': 'n.u'}, disk(6))}), g AS (SELECT i, j, u, -{_dx('u')} AS u_x FROM f) SELECT i, j, {_rs('u', 'u_x')} FROM g")

    def multi(spark, sf):
        f = filter_exprs(cells(spark, sf), PLANE, TopHat(), 4.0, {"ub": F.col("u"), "uu": F.col("u") * F.col("u"), "uv": F.col("u") * F.col("v")}, active="active")
        return _r(f, "ub", "uu", "uv")

    _register("filter_multi_field", multi, _plain(sql_filter({"ub": "n.u", "uu": "n.u * n.u", "uv": "n.u * n.v"}, disk(4), mask=True), "ub", "uu", "uv"))

    def one(spark, sf):
        df = _fields(_sums(_read(spark, sf, "lineitem"), _i()))
        return _r(filter_field(df, LINE, Gaussian(), 5.0, "u"), "u", keys=("i",))

    line = CELLS_SQL.replace("cells AS", "line AS").replace("CAST(round(l_discount * 100) AS INT) + 1 AS j,", "0 AS j,")
    _register("filter_1d", one, _plain(sql_filter({"u": "n.u"}, square(Gaussian(), 5, ("i",)), gauss(5, ("i",)), source="line", keys=("i",)), "u", keys="i", ctes=line))

    def volume(spark, sf):
        return _r(filter_field(volume_cells(spark, sf), BOX, TopHat(), 4.0, "u"), "u", keys=("i", "j", "k"))

    near3 = "(n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j) + (n.k - t.k) * (n.k - t.k) <= 4"
    _register("filter_3d", volume, _plain(sql_filter({"u": "n.u"}, near3, source="volume", keys=("i", "j", "k")), "u", keys="i, j, k", ctes=VOLUME_SQL))

    def levels(spark, sf):
        return _r(filter_field(volume_cells(spark, sf), PLANE, TopHat(), 4.0, ["u", "v"], batch=["k"]), "u", "v", keys=("i", "j", "k"))

    _register("filter_batch_levels", levels, _plain(sql_filter({"u": "n.u", "v": "n.v"}, disk(4) + " AND n.k = t.k", source="volume", keys=("i", "j", "k")), "u", "v", keys="i, j, k", ctes=VOLUME_SQL))

    def nodes(spark, sf):
        return _r(filter_field(supplier_nodes(spark, sf), NODES, TopHat(), 1500.0, "f"), "f", keys=("node",))

    near = "(n.x - t.x) * (n.x - t.x) + (n.y - t.y) * (n.y - t.y) <= 750.0 * 750.0"
    _register("filter_node_ball", nodes, _plain(sql_filter({"f": "n.f"}, near, "n.area", source="nodes", keys=("node",)), "f", keys="node", ctes=NODES_SQL))

    def curvilinear(spark, sf):
        df = cells(spark, sf).withColumns({"x": 2.0 * F.col("i") + 0.5 * F.col("j"), "y": 3.0 * F.col("j") - 0.25 * F.col("i"), "area": F.lit(6.125)})
        return _r(filter_field(df, Points(("i", "j")), TopHat(), 12.1, "u", active="active"), "u")

    gx, gy = "(2.0 * (n.i - t.i) + 0.5 * (n.j - t.j))", "(3.0 * (n.j - t.j) - 0.25 * (n.i - t.i))"
    _register("filter_curvilinear", curvilinear, _plain(sql_filter({"u": "n.u"}, f"sqrt({gx} * {gx} + {gy} * {gy}) <= 6.05", mask=True), "u"))

    def sphere(spark, sf):
        return _r(filter_field(cells(spark, sf), SPHERE, TopHat(), 30.0, "u"), "u")

    _register("filter_spherical_band", sphere, _plain(sql_filter({"u": "n.u"}, f"{ARC} <= 15.0", f"cos({LAT.format('n')})"), "u"))
    _register("filter_engine_ball", _filter_query(PLANE, TopHat(), 6.0, engine="ball"), _plain(sql_filter({"u": "n.u"}, disk(6), mask=True), "u"))


#: Longitude wraps over all 50 columns; latitudes from -50 to 50 degrees.
SPHERE = Grid((Axis.of([2 * math.pi * (x - 1) / NX for x in range(1, NX + 1)]), Axis.of([math.radians(10.0 * (y - 6)) for y in range(1, NY + 1)])), geometry="spherical", radius=60.0)
LAT = "radians(10.0 * ({0}.j - 6))"
ARC = f"(120.0 * asin(least(1.0, sqrt(pow(sin(({LAT.format('n')} - {LAT.format('t')}) / 2), 2) + cos({LAT.format('n')}) * cos({LAT.format('t')}) * pow(sin({math.pi / NX!r} * (n.i - t.i)), 2)))))"

VOLUME_SQL = CELLS_SQL.replace("cells AS", "volume AS").replace("SELECT i, j,", "SELECT i, j, k,", 1).replace("+ 1 AS j,", "+ 1 AS j, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS k,").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3").replace(" FROM (SELECT", " FROM (SELECT g.i, g.j, g.k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM (SELECT x.i, y.j, z.k FROM range(1, 51) x(i), range(1, 12) y(j), range(1, 4) z(k)) g LEFT JOIN (SELECT", 1).replace(") x)", ") s USING (i, j, k)) x)")


def volume_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of the 50 x 11 x 3 box; the third axis is the return flag, and a cell without rows has sums of 0."""
    level = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("k")
    sums = _sums(_read(spark, sf, "lineitem"), _i(), _j(), level)
    return _fields(BOX.cells(spark).join(sums, ["i", "j", "k"], "left").na.fill(0, ["a", "b", "c"]))


NODES = Points(("node",))
NODES_SQL = "nodes AS (SELECT s_suppkey::BIGINT AS node, s_acctbal AS x, ((s_suppkey * 7919) % 9973)::DOUBLE AS y, (s_suppkey % 5 + 1)::DOUBLE AS area, (s_nationkey % 13)::DOUBLE AS f FROM supplier)"


def supplier_nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf, "supplier").select(k.cast("long").alias("node"), F.col("s_acctbal").alias("x"), ((k * 7919) % 9973).cast("double").alias("y"), (k % 5 + 1).cast("double").alias("area"), (F.col("s_nationkey") % 13).cast("double").alias("f"))


FLUX = {"ub": "n.u", "vb": "n.v", "uu": "n.u * n.u", "uv": "n.u * n.v", "vv": "n.v * n.v"}


def _pi_sql(scale: float, source: str = "cells", extra: str = "", mask: bool = True, name: str = "pi") -> str:
    """CTEs f and pi, the plane flux of a top-hat, with extra key columns."""
    k = f"{extra}, " if extra else ""
    same = f" AND n.{extra} = t.{extra}" if extra else ""
    x = lambda f: sql_slope(f, "i", f"{k}j", mask=mask)
    y = lambda f: sql_slope(f, "j", f"{k}i", mask=mask)
    keys = ("i", "j", *([extra] if extra else []))
    return f"f AS ({sql_filter(FLUX, disk(scale) + same, source=source, keys=keys, mask=mask)}), {name} AS (SELECT *, -({x('ub')} * (uu - ub * ub) + ({y('ub')} + {x('vb')}) * (uv - ub * vb) + {y('vb')} * (vv - vb * vb)) AS pi FROM f)"


S_MASKED = Setting(PLANE, TopHat(), 6.0, active="active")
S_PLAIN = Setting(PLANE, TopHat(), 6.0)


def _build_derivatives() -> None:
    def slopes(spark, sf):
        return _r(derivatives(cells(spark, sf), PLANE, ["u"], active="active"), "u_x", "u_y")

    _register("ddx", lambda spark, sf: slopes(spark, sf).select("i", "j", "u_x"), f"WITH {CELLS_SQL} SELECT i, j, round({_dx('u', mask=True)}, 6) + 0.0 AS u_x FROM cells")
    _register("ddy", lambda spark, sf: slopes(spark, sf).select("i", "j", "u_y"), f"WITH {CELLS_SQL} SELECT i, j, round({_dy('u', mask=True)}, 6) + 0.0 AS u_y FROM cells")

    def wrapped(spark, sf):
        return _r(derivatives(cells(spark, sf), TORUS, ["u"], dims=[0]), "u_x")

    _register("ddx_periodic", wrapped, f"WITH {CELLS_SQL} SELECT t.i, t.j, round((r.u - l.u) / 2, 6) + 0.0 AS u_x FROM cells t JOIN cells r ON r.j = t.j AND r.i = t.i % 50 + 1 JOIN cells l ON l.j = t.j AND l.i = (t.i + 48) % 50 + 1")

    def stack(spark, sf):
        return _r(level_derivative(volume_cells(spark, sf), ["u"], "k", 2.0, keys=["i", "j"]), "u_z", keys=("i", "j", "k"))

    _register("ddz_stack", stack, f"WITH {VOLUME_SQL} SELECT i, j, k, round({sql_slope('u', 'k', 'i, j', step='2.0')}, 6) + 0.0 AS u_z FROM volume")

    def curved(spark, sf):
        return _r(derivatives(cells(spark, sf), SPHERE, ["u"], dims=[1]), "u_y")

    _register("ddy_spherical", curved, f"WITH {CELLS_SQL} SELECT i, j, round({_dy('u', step=repr(60.0 * math.radians(10.0)))}, 6) + 0.0 AS u_y FROM cells")

    mesh = Points(("i", "j"), area=None)

    def fitted(spark, sf):
        df = cells(spark, sf).withColumns({"x": 2.0 * F.col("i") + 0.5 * F.col("j"), "y": 3.0 * F.col("j") - 0.25 * F.col("i")})
        ends = neighbours(df)
        at = lambda p: df.select(F.col("i").alias(f"{p}_i"), F.col("j").alias(f"{p}_j"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
        e = ends.select(F.col("i").alias("t_i"), F.col("j").alias("t_j"), F.col("n_i").alias("s_i"), F.col("n_j").alias("s_j")).join(at("t"), ["t_i", "t_j"]).join(at("s"), ["s_i", "s_j"])
        dx, dy = F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty")
        e = e.select("t_i", "t_j", "s_i", "s_j", F.sqrt(dx * dx + dy * dy).alias("d"), F.array(dx, dy).alias("delta"))
        return _r(mesh.gradient(df, e, ["u"]), "u_x", "u_y")

    dx, dy = "(2.0 * (n.i - t.i) + 0.5 * (n.j - t.j))", "(3.0 * (n.j - t.j) - 0.25 * (n.i - t.i))"
    w = f"(1 / ({dx} * {dx} + {dy} * {dy}))"
    sums = ", ".join(f"sum({w} * {a} * {b}) AS {k}" for k, a, b in (("xx", dx, dx), ("xy", dx, dy), ("yy", dy, dy), ("xu", dx, "(n.u - t.u)"), ("yu", dy, "(n.u - t.u)")))
    _register("wlsq_gradient", fitted, f"WITH {CELLS_SQL}, s AS (SELECT t.i, t.j, {sums} FROM cells t JOIN cells n ON abs(n.i - t.i) + abs(n.j - t.j) = 1 GROUP BY t.i, t.j), f AS (SELECT i, j, (yy * xu - xy * yu) / (xx * yy - xy * xy) AS u_x, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS u_y FROM s) SELECT i, j, {_rs('u_x', 'u_y')} FROM f")

    def knn(spark, sf):
        e = NODES.nearest(supplier_nodes(spark, sf), 3, 20000.0)
        return e.select(F.col("t_node").alias("node"), F.col("s_node").alias("nbr"), F.col("rank").cast("int").alias("rank"), (F.round("d", 4) + 0.0).alias("d"))

    _register("knn_edges", knn, f"WITH {NODES_SQL}, p AS (SELECT t.node, n.node AS nbr, sqrt((n.x - t.x) * (n.x - t.x) + (n.y - t.y) * (n.y - t.y)) AS d FROM nodes t JOIN nodes n ON n.node <> t.node), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, nbr)::INT AS rank FROM p) SELECT node, nbr, rank, round(d, 4) + 0.0 AS d FROM r WHERE rank <= 3")

    def corners(spark, sf):
        at = spark.range(1, NX + 2).crossJoin(spark.range(1, NY + 2).withColumnRenamed("id", "cj")).select(F.col("id").cast("int").alias("ci"), F.col("cj").cast("int").alias("cj"))
        at = at.withColumns({"x": 2.0 * F.col("ci") + 0.01 * F.col("cj") * F.col("cj"), "y": 3.0 * F.col("cj") - 0.02 * F.col("ci") * F.col("ci")})
        return _r(corner_areas(at), "area")

    px, py = "(2.0 * ({0}) + 0.01 * ({1}) * ({1}))", "(3.0 * ({1}) - 0.02 * ({0}) * ({0}))"
    ring = [("i", "j"), ("i + 1", "j"), ("i + 1", "j + 1"), ("i", "j + 1")]
    shoelace = " + ".join(f"({px.format(*a)} * {py.format(*b)} - {px.format(*b)} * {py.format(*a)})" for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    _register("corner_areas", corners, f"SELECT i::INT AS i, j::INT AS j, round(abs({shoelace}) / 2, 6) + 0.0 AS area FROM range(1, 51) a(i), range(1, 12) b(j)")


def _build_diagnostics() -> None:
    add = _register
    add("pi_2d", lambda spark, sf: _r(D.energy_flux(cells(spark, sf), S_MASKED), "pi"), f"WITH {CELLS_SQL}, {_pi_sql(6)} SELECT i, j, {_rs('pi')} FROM pi")
    moments = {f"b{a}": f"n.{c}" for a, c in enumerate("uvw")} | {f"p{a}{b}": f"n.{c} * n.{d}" for a, c in enumerate("uvw") for b, d in enumerate("uvw") if a <= b}
    t = lambda a, b: f"(p{a}{b} - b{a} * b{b})"
    pi25 = f"-({_dx('b0')} * {t(0, 0)} + ({_dy('b0')} + {_dx('b1')}) * {t(0, 1)} + {_dy('b1')} * {t(1, 1)} + {_dx('b2')} * {t(0, 2)} + {_dy('b2')} * {t(1, 2)})"
    add("pi_25d", lambda spark, sf: _r(D.energy_flux(cells(spark, sf), S_PLAIN, "u", "v", "w"), "pi"), f"WITH {CELLS_SQL}, f AS ({sql_filter(moments, disk(6))}), g AS (SELECT i, j, {pi25} AS pi FROM f) SELECT i, j, {_rs('pi')} FROM g")

    def one(spark, sf):
        return _r(D.energy_flux(_fields(_sums(_read(spark, sf, "lineitem"), _i())), Setting(LINE, TopHat(), 6.0), "u", None), "pi", keys=("i",))

    line = CELLS_SQL.replace("cells AS", "line AS").replace("CAST(round(l_discount * 100) AS INT) + 1 AS j,", "0 AS j,")
    body = sql_filter({"ub": "n.u", "uu": "n.u * n.u"}, "abs(n.i - t.i) <= 3", source="line", keys=("i",))
    add("pi_1d", one, f"WITH {line}, f AS ({body}), g AS (SELECT i, -{sql_slope('ub', 'i', '')} * (uu - ub * ub) AS pi FROM f) SELECT i, {_rs('pi')} FROM g")

    near3 = "(n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j) + (n.k - t.k) * (n.k - t.k) <= 4"
    x3, y3, z3 = (lambda f: sql_slope(f, "i", "j, k")), (lambda f: sql_slope(f, "j", "i, k")), (lambda f: sql_slope(f, "k", "i, j"))
    pi3 = f"-({x3('b0')} * {t(0, 0)} + {y3('b1')} * {t(1, 1)} + {z3('b2')} * {t(2, 2)} + ({y3('b0')} + {x3('b1')}) * {t(0, 1)} + ({z3('b0')} + {x3('b2')}) * {t(0, 2)} + ({z3('b1')} + {y3('b2')}) * {t(1, 2)})"
    add("pi_3d", lambda spark, sf: _r(D.energy_flux(volume_cells(spark, sf), Setting(BOX, TopHat(), 4.0), "u", "v", "w"), "pi", keys=("i", "j", "k")), f"WITH {VOLUME_SQL}, f AS ({sql_filter(moments, near3, source='volume', keys=('i', 'j', 'k'))}), g AS (SELECT i, j, k, {pi3} AS pi FROM f) SELECT i, j, k, {_rs('pi')} FROM g")

    lon, lat = f"({2 * math.pi / NX!r} * (i - 1))", "radians(10.0 * (j - 6))"
    frame = f"SELECT *, sin({lon}) AS sl, cos({lon}) AS cl, sin({lat}) AS sp, cos({lat}) AS cp FROM "
    xyz = f"xyz AS (SELECT i, j, -u * sl - v * sp * cl AS u, u * cl - v * sp * sl AS v, v * cp AS w FROM ({frame} cells))"
    sphere = sql_filter(moments, f"{ARC} <= 15.0", f"cos({LAT.format('n')})", source="xyz")
    e, n = ("(-sl)", "cl", "0.0"), ("(-sp * cl)", "(-sp * sl)", "cp")
    local = lambda a, b: "(" + " + ".join(f"{a[p]} * {t(min(p, q), max(p, q))} * {b[q]}" for p in range(3) for q in range(3)) + ")"
    back = lambda a: "(" + " + ".join(f"b{p} * {a[p]}" for p in range(3)) + ")"
    tan = "(sp / cp / 60.0)"
    ring = lambda f: f"((CASE WHEN i = 50 THEN first_value({f}) OVER (PARTITION BY j ORDER BY i) ELSE lead({f}) OVER (PARTITION BY j ORDER BY i) END - CASE WHEN i = 1 THEN last_value({f}) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag({f}) OVER (PARTITION BY j ORDER BY i) END) / {4 * math.pi / NX!r} / (60.0 * cp))"
    north = lambda f: _dy(f, step=repr(60.0 * math.radians(10.0)))
    pis = f"-(({ring('ue')} - un * {tan}) * tee + ({north('ue')} + {ring('un')} + ue * {tan}) * ten + {north('un')} * tnn)"
    add("pi_spherical", lambda spark, sf: _r(D.energy_flux(cells(spark, sf), Setting(SPHERE, TopHat(), 30.0)), "pi"), f"WITH {CELLS_SQL}, {xyz}, f AS ({sphere}), h AS (SELECT i, j, cp, sp, {back(e)} AS ue, {back(n)} AS un, {local(e, e)} AS tee, {local(e, n)} AS ten, {local(n, n)} AS tnn FROM ({frame} f)), g AS (SELECT i, j, {pis} AS pi FROM h) SELECT i, j, {_rs('pi')} FROM g")

    xx, xy, yy = "(uu - ub * ub)", "(uv - ub * vb)", "(vv - vb * vb)"
    ux, uy, vx, vy = (f(c, mask=True) for f, c in ((_dx, "ub"), (_dy, "ub"), (_dx, "vb"), (_dy, "vb")))
    f = f"f AS ({sql_filter(FLUX, disk(6), mask=True)})"
    add("pi_strain_convergence", lambda spark, sf: _r(D.strain_convergence(cells(spark, sf), S_MASKED), "pi_strain", "pi_convergence", "pi"), f"WITH {CELLS_SQL}, {f}, g AS (SELECT i, j, ({yy} - {xx}) * ({ux} - {vy}) / 2 - {xy} * ({uy} + {vx}) AS pi_strain, ({yy} + {xx}) * ({ux} + {vy}) / 2 AS pi_convergence FROM f), h AS (SELECT *, pi_strain - pi_convergence AS pi FROM g) SELECT i, j, {_rs('pi_strain', 'pi_convergence', 'pi')} FROM h")

    parts = {"r0": "n.th", "r1": "n.w", "d0": "(n.u - n.th)", "d1": "(n.v - n.w)"}
    names = list(parts)
    exprs = {f"f{a}": parts[a] for a in names} | {f"f{a}{b}": f"{parts[a]} * {parts[b]}" for k, a in enumerate(names) for b in names[k:]}
    m = lambda a, b: f"(f{a}{b} - f{a} * f{b})" if f"f{a}{b}" in exprs else f"(f{b}{a} - f{a} * f{b})"
    tau = {"rr": {k: m(f"r{k[0]}", f"r{k[1]}") for k in ("00", "01", "11")}, "dd": {k: m(f"d{k[0]}", f"d{k[1]}") for k in ("00", "01", "11")}, "x": {k: f"({m(f'r{k[0]}', f'd{k[1]}')} + {m(f'd{k[0]}', f'r{k[1]}')})" for k in ("00", "01", "11")}}
    con = lambda p, q: f"(-({_dx(f'f{p}0')} * {tau[q]['00']} + ({_dy(f'f{p}0')} + {_dx(f'f{p}1')}) * {tau[q]['01']} + {_dy(f'f{p}1')} * {tau[q]['11']}))"
    add("pi_decomposed", lambda spark, sf: _r(D.flux_decomposed(cells(spark, sf), S_PLAIN, ["u", "v"], ["th", "w"]), "rotational", "cross", "divergent", "total"), f"WITH {CELLS_SQL}, f AS ({sql_filter(exprs, disk(6))}), g AS (SELECT i, j, {con('r', 'rr')} AS rotational, {con('d', 'dd')} AS divergent, {con('r', 'dd')} + {con('d', 'rr')} + {con('r', 'x')} + {con('d', 'x')} AS \"cross\" FROM f), h AS (SELECT *, rotational + divergent + \"cross\" AS total FROM g) SELECT i, j, {_rs('rotational', 'divergent', 'total')}, round(\"cross\", 6) + 0.0 AS \"cross\" FROM h")

    first = f"m AS ({sql_filter({'ub': 'n.u', 'vb': 'n.v'}, disk(6), mask=True)}), d AS (SELECT c.i, c.j, c.active, ub AS m0, vb AS m1, u - ub AS d0, v - vb AS d1 FROM cells c JOIN m USING (i, j))"
    four = ["m0", "m1", "d0", "d1"]
    exprs2 = {f"f{a}": f"n.{a}" for a in four} | {f"f{a}{b}": f"n.{a} * n.{b}" for k, a in enumerate(four) for b in four[k:]}
    m2 = lambda a, b: f"(f{a}{b} - f{a} * f{b})" if f"f{a}{b}" in exprs2 else f"(f{b}{a} - f{a} * f{b})"
    lcr = ", ".join(f"{v} AS {k}" for k, v in {**{f"l_{n}": m2(f"m{a}", f"m{b}") for n, a, b in (("xx", 0, 0), ("xy", 0, 1), ("yy", 1, 1))}, **{f"c_{n}": f"{m2(f'm{a}', f'd{b}')} + {m2(f'd{a}', f'm{b}')}" for n, a, b in (("xx", 0, 0), ("xy", 0, 1), ("yy", 1, 1))}, **{f"r_{n}": m2(f"d{a}", f"d{b}") for n, a, b in (("xx", 0, 0), ("xy", 0, 1), ("yy", 1, 1))}}.items())
    keep = [f"{p}_{n}" for p in "lcr" for n in ("xx", "xy", "yy")]
    add("tau_lcr", lambda spark, sf: _r(D.stress_decomposition(cells(spark, sf), S_MASKED), *keep), f"WITH {CELLS_SQL}, {first}, f AS ({sql_filter(exprs2, disk(6), source='d', mask=True)}), g AS (SELECT i, j, {lcr} FROM f) SELECT i, j, {_rs(*keep)} FROM g")

    tracer = {"ub": "n.u", "vb": "n.v", "tb": "n.th", "ut": "n.u * n.th", "vt": "n.v * n.th"}
    add("tracer_flux", lambda spark, sf: _r(D.tracer_flux(cells(spark, sf), S_MASKED, "th"), "pi_tracer"), f"WITH {CELLS_SQL}, f AS ({sql_filter(tracer, disk(6), mask=True)}), g AS (SELECT i, j, -((ut - ub * tb) * {_dx('tb', mask=True)} + (vt - vb * tb) * {_dy('tb', mask=True)}) AS pi_tracer FROM f) SELECT i, j, {_rs('pi_tracer')} FROM g")
    curl = f"{_dx('v', mask=True)} - {_dy('u', mask=True)}"
    add("vorticity", lambda spark, sf: _r(D.vorticity(cells(spark, sf), S_MASKED), "vorticity"), f"WITH {CELLS_SQL} SELECT i, j, round({curl}, 6) + 0.0 AS vorticity FROM cells")
    add("enstrophy_flux", lambda spark, sf: _r(D.enstrophy_flux(cells(spark, sf), S_MASKED), "enstrophy_flux"), f"WITH {CELLS_SQL}, o AS (SELECT i, j, active, u, v, {curl} AS th FROM cells), f AS ({sql_filter(tracer, disk(6), source='o', mask=True)}), g AS (SELECT i, j, -((ut - ub * tb) * {_dx('tb', mask=True)} + (vt - vb * tb) * {_dy('tb', mask=True)}) AS enstrophy_flux FROM f) SELECT i, j, {_rs('enstrophy_flux')} FROM g")
    add("favre_filter", lambda spark, sf: _r(D.favre_filter(cells(spark, sf), S_PLAIN, "rho", ["u"]), "u"), _plain(sql_filter({"u": "n.rho * n.u"}, disk(6)).replace("nullif(sum(1.0), 0)", "nullif(sum(n.rho), 0)"), "u"))
    budget = {"rb": "n.rho", "pb": "n.p", "ru": "n.rho * n.u", "rv": "n.rho * n.v", "b0": "n.u", "b1": "n.v", "ruu": "n.rho * n.u * n.u", "ruv": "n.rho * n.u * n.v", "rvv": "n.rho * n.v * n.v"}
    terms = f"-rb * ({_dx('ut')} * (ruu / rb - ut * ut) + ({_dy('ut')} + {_dx('vt')}) * (ruv / rb - ut * vt) + {_dy('vt')} * (rvv / rb - vt * vt)) AS pi, ({_dx('pb')} * (ru - rb * b0) + {_dy('pb')} * (rv - rb * b1)) / rb AS baropycnal, pb * ({_dx('b0')} + {_dy('b1')}) AS pressure_dilatation"
    add("favre_budget", lambda spark, sf: _r(D.compressible_flux(cells(spark, sf), S_PLAIN), "pi", "baropycnal", "pressure_dilatation"), f"WITH {CELLS_SQL}, f0 AS ({sql_filter(budget, disk(6))}), f AS (SELECT *, ru / rb AS ut, rv / rb AS vt FROM f0), g AS (SELECT i, j, {terms} FROM f) SELECT i, j, {_rs('pi', 'baropycnal', 'pressure_dilatation')} FROM g")

    def bands(spark, sf):
        b = D.band_energies(cells(spark, sf), S_MASKED, [4.0, 6.0], ["u", "v"])
        return b.select(*((F.round(c, 6) + 0.0).alias(c) for c in ("band_1", "band_2", "resolved", "total")))

    both = {"u": "n.u", "v": "n.v", "su": "n.u * n.u", "sv": "n.v * n.v"}
    add("band_energies", bands, f"WITH {CELLS_SQL}, a AS ({sql_filter(both, disk(4), mask=True)}), b AS ({sql_filter(both, disk(6), source='a', mask=True)}), r AS (SELECT (SELECT sum(su + sv - u * u - v * v) / 2 / count(*) FROM a WHERE active) AS band_1, (SELECT sum(su + sv - u * u - v * v) / 2 / count(*) FROM b WHERE active) AS band_2, (SELECT sum(u * u + v * v) / 2 / count(*) FROM b WHERE active) AS resolved) SELECT {_rs('band_1', 'band_2', 'resolved')}, round(band_1 + band_2 + resolved, 6) + 0.0 AS total FROM r")
    add("active_area", lambda spark, sf: D.area_mean(cells(spark, sf), S_MASKED, {"mean_u": F.col("u")}).select((F.round("mean_u", 6) + 0.0).alias("mean_u"), F.lit(D.active_area(cells(spark, sf), S_MASKED)).alias("area")), f"WITH {CELLS_SQL} SELECT round(avg(u), 6) + 0.0 AS mean_u, count(*)::DOUBLE AS area FROM cells WHERE active")

    def binned(spark, sf):
        flux = D.strain_convergence(cells(spark, sf), S_MASKED)
        got = D.conditional_mean(flux.withColumn("divergence", F.round("divergence", 6)), S_MASKED, "pi", "divergence", -4.0, 4.0, 8)
        return got.select(F.col("bin").cast("long").alias("bin"), "n", (F.round("mean", 5) + 0.0).alias("mean"))

    add("flux_by_divergence", binned, f"WITH {CELLS_SQL}, {_pi_sql(6)}, g AS (SELECT pi, active, round({ux} + {vy}, 6) AS d FROM pi) SELECT (CASE WHEN d < -4 THEN 0 WHEN d >= 4 THEN 9 ELSE floor(d + 4)::BIGINT + 1 END)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(pi), 5) + 0.0 AS mean FROM g WHERE active GROUP BY 1")


def _energy_sql(scales, source: str = "cells", extra: str = "", mask: bool = True) -> str:
    same = f" AND n.{extra} = t.{extra}" if extra else ""
    keys = ("i", "j", *([extra] if extra else []))
    one = lambda n, s: f"SELECT {n} AS scale_idx, {s!r} AS scale, {extra + ', ' if extra else ''}sum(ub * ub + vb * vb) / 2 / count(*) AS cumulative_energy FROM ({sql_filter({'ub': 'n.u', 'vb': 'n.v'}, disk(s) + same, source=source, keys=keys, mask=mask)}) q{' WHERE active' if mask else ''}{' GROUP BY ' + extra if extra else ''}"
    return " UNION ALL ".join(one(n, float(s)) for n, s in enumerate(scales, 1))


SCALES = [4.0, 6.0, 8.0]


def _build_pipelines() -> None:
    add = _register

    def energy(spark, sf):
        e = D.cumulative_energy(cells(spark, sf), S_MASKED, SCALES)
        return e.select("scale_idx", "scale", (F.round("cumulative_energy", 6) + 0.0).alias("cumulative_energy"))

    add("cumulative_energy", energy, f"WITH {CELLS_SQL}, e AS ({_energy_sql(SCALES)}) SELECT scale_idx, scale::DOUBLE AS scale, {_rs('cumulative_energy')} FROM e")

    def rounded(df, *keys):
        return df.select(*keys, "scale_idx", "scale", *((F.round(c, 6) + 0.0).alias(c) for c in ("wavenumber", "cumulative_energy", "filtering_spectrum")))

    by = lambda extra: f"({'PARTITION BY ' + extra if extra else ''} ORDER BY scale_idx)"
    slope = lambda extra: f"(coalesce(lead(cumulative_energy) OVER {by(extra)}, cumulative_energy) - coalesce(lag(cumulative_energy) OVER {by(extra)}, cumulative_energy)) / (coalesce(lead(1 / scale) OVER {by(extra)}, 1 / scale) - coalesce(lag(1 / scale) OVER {by(extra)}, 1 / scale))"
    spectrum = lambda extra: f"s AS (SELECT {extra + ', ' if extra else ''}scale_idx, scale::DOUBLE AS scale, 1 / scale::DOUBLE AS wavenumber, cumulative_energy, {slope(extra)} AS filtering_spectrum FROM e)"
    add("filtering_spectrum", lambda spark, sf: rounded(D.filtering_spectrum(cells(spark, sf), S_MASKED, SCALES, spectrum="force")), f"WITH {CELLS_SQL}, e AS ({_energy_sql(SCALES)}), {spectrum('')} SELECT scale_idx, scale, {_rs('wavenumber', 'cumulative_energy', 'filtering_spectrum')} FROM s")

    def sweep(spark, sf):
        r = coarse_grain(cells(spark, sf), PLANE, SCALES, active="active", spectrum="force")
        return r.flux.select("i", "j", "scale_idx", "scale", (F.round("pi", 6) + 0.0).alias("pi"))

    union = " UNION ALL ".join(f"(WITH {_pi_sql(s)} SELECT i, j, {n} AS scale_idx, {s!r}::DOUBLE AS scale, {_rs('pi')} FROM pi)" for n, s in enumerate(SCALES, 1))
    add("coarse_grain_sweep", sweep, f"WITH {CELLS_SQL} {union}")

    def spectrum_of(run):
        return lambda spark, sf: rounded(run(spark, sf).spectrum, "k")

    batch = lambda spark, sf: coarse_grain(volume_cells(spark, sf), PLANE, SCALES, batch=["k"], spectrum="force")
    volume = f"WITH {VOLUME_SQL}, e AS ({_energy_sql(SCALES, 'volume', 'k', False)}), {spectrum('k')} SELECT k, scale_idx, scale, {_rs('wavenumber', 'cumulative_energy', 'filtering_spectrum')} FROM s"
    add("coarse_grain_batch", spectrum_of(batch), volume)
    add("coarse_grain_batch_flux", lambda spark, sf: batch(spark, sf).flux.filter("scale_idx = 2").select("i", "j", "k", (F.round("pi", 6) + 0.0).alias("pi")), f"WITH {VOLUME_SQL}, {_pi_sql(6, 'volume', 'k', False)} SELECT i, j, k, {_rs('pi')} FROM pi")
    add("coarse_grain_profile", spectrum_of(lambda spark, sf: coarse_grain_profile(volume_cells(spark, sf), PLANE, SCALES, level="k", spectrum="force")), volume)

    def slices(spark, sf):
        narrow = Grid.box(NX, 8)
        df = volume_cells(spark, sf).filter((F.col("k") != 2) | (F.col("j") <= 8))
        return rounded(coarse_grain_slices(df, "k", {1: PLANE, 2: narrow, 3: PLANE}, SCALES, spectrum="force").spectrum, "k")

    add("coarse_grain_slices", slices, volume.replace(", e AS (", ", part AS (SELECT * FROM volume WHERE k <> 2 OR j <= 8), e AS (").replace("FROM volume t JOIN volume n", "FROM part t JOIN part n"))
    add("coarse_grain_map_data", lambda spark, sf: map_data(coarse_grain(cells(spark, sf), PLANE, [6.0], active="active", spectrum="none"), 1, PLANE).select("x", "y", (F.round("pi", 6) + 0.0).alias("pi"), (F.round("clim", 6) + 0.0).alias("clim")), f"WITH {CELLS_SQL}, {_pi_sql(6)} SELECT (i - 1)::DOUBLE AS x, (j - 1)::DOUBLE AS y, {_rs('pi')}, round(max(abs(pi)) OVER (), 6) + 0.0 AS clim FROM pi")
    add("spectrum_data", lambda spark, sf: spectrum_data(coarse_grain(cells(spark, sf), PLANE, SCALES, active="active", spectrum="force"), "cumulative").select((F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y")), f"WITH {CELLS_SQL}, e AS ({_energy_sql(SCALES)}) SELECT round(1 / scale::DOUBLE, 6) + 0.0 AS x, round(cumulative_energy, 6) + 0.0 AS y FROM e")
    add("check_setup", lambda spark, sf: check_setup(spark, PLANE, TopHat(), 6.0).select("engine", "resolvable", "supports_flux", "supports_spectrum", "supports_spectral_method"), "SELECT 'banded' AS engine, true AS resolvable, true AS supports_flux, false AS supports_spectrum, true AS supports_spectral_method")

    def events_masked(spark, sf):
        e = _read(spark, sf, "events")
        g = Grid.box(31, 24)
        dense = g.densify(e.groupBy(F.dayofmonth("ts").alias("i"), (F.hour("ts") + 1).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n")), ["n"])
        return _r(filter_field(dense, g, TopHat(), 4.0, "n", active="active", strategy=DEFORMABLE), "n")

    ev = "c AS (SELECT day(ts)::INT AS i, (hour(ts) + 1)::INT AS j, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), cells AS (SELECT a.i::INT AS i, b.j::INT AS j, coalesce(n, 0) AS n, n IS NOT NULL AS active FROM range(1, 32) a(i) CROSS JOIN range(1, 25) b(j) LEFT JOIN c ON c.i = a.i AND c.j = b.j)"
    add("filter_events_densified", events_masked, _plain(sql_filter({"n": "n.n"}, disk(4), strategy=DEFORMABLE, mask=True), "n", ctes=ev))


def _torus_pi(scale: float, n) -> str:
    """CTEs that end in pi{n}: the flux on the torus through the transform of a Gaussian, whose kernel is a product of two circulants."""
    g = lambda m: f"(SELECT d, sum(cos(2 * pi() * m * d / {m}) * exp(-pow(2 * pi() * least(m, {m} - m) / {m} * {scale!r}, 2) / 24.0)) / {m} AS g FROM range(0, {m}) a(m), range(0, {m}) b(d) GROUP BY d)"
    along = lambda by: ", ".join(f"sum({e} * {by}.g) AS {k}" for k, e in FLUX.items())
    again = ", ".join(f"sum(a.{k} * gj{n}.g) AS {k}" for k in FLUX)
    fields = f"gi{n} AS {g(NX)}, gj{n} AS {g(NY)}, a{n} AS (SELECT t.i, n.j, {along(f'gi{n}')} FROM (SELECT DISTINCT i FROM cells) t CROSS JOIN cells n JOIN gi{n} ON gi{n}.d = (n.i - t.i + 50) % 50 GROUP BY 1, 2), b{n} AS (SELECT a.i, t.j, {again} FROM (SELECT DISTINCT j FROM cells) t CROSS JOIN a{n} a JOIN gj{n} ON gj{n}.d = (a.j - t.j + 11) % 11 GROUP BY 1, 2)"
    near = f"b{n} t JOIN b{n} e ON e.j = t.j AND e.i = t.i % 50 + 1 JOIN b{n} w ON w.j = t.j AND w.i = (t.i + 48) % 50 + 1 JOIN b{n} o ON o.i = t.i AND o.j = t.j % 11 + 1 JOIN b{n} s ON s.i = t.i AND s.j = (t.j + 9) % 11 + 1"
    t = lambda x, y: f"(t.{x}{y} - t.{x}b * t.{y}b)"
    pi = f"-((e.ub - w.ub) / 2 * {t('u', 'u')} + ((o.ub - s.ub) / 2 + (e.vb - w.vb) / 2) * {t('u', 'v')} + (o.vb - s.vb) / 2 * {t('v', 'v')})"
    return f"{fields}, pi{n} AS (SELECT t.i, t.j, {pi} AS pi FROM {near})"


def _build_variants() -> None:
    """The same operators in more dimensions, on other geometries and through other entries."""
    add = _register
    x3, y3, z3 = (lambda f: sql_slope(f, "i", "j, k")), (lambda f: sql_slope(f, "j", "i, k")), (lambda f: sql_slope(f, "k", "i, j"))
    axes = (x3, y3, z3)
    near3 = lambda s: f"(n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j) + (n.k - t.k) * (n.k - t.k) <= {s * s / 4}"
    at3 = ("i", "j", "k")

    tracer = {f"b{a}": f"n.{c}" for a, c in enumerate("uvw")} | {"tb": "n.th"} | {f"p{a}": f"n.{c} * n.th" for a, c in enumerate("uvw")}
    body = " + ".join(f"(p{k} - b{k} * tb) * {axes[k]('tb')}" for k in range(3))
    add("tracer_flux_3d", lambda spark, sf: _r(D.tracer_flux(volume_cells(spark, sf), Setting(BOX, TopHat(), 4.0), "th", "u", "v", "w"), "pi_tracer", keys=at3), f"WITH {VOLUME_SQL}, f AS ({sql_filter(tracer, near3(4), source='volume', keys=at3)}), g AS (SELECT i, j, k, -({body}) AS pi_tracer FROM f) SELECT i, j, k, {_rs('pi_tracer')} FROM g")

    parts = {"r0": "n.th", "r1": "n.w", "r2": "n.rho", "d0": "(n.u - n.th)", "d1": "(n.v - n.w)", "d2": "(n.w - n.rho)"}
    names = list(parts)
    exprs = {f"f{a}": parts[a] for a in names} | {f"f{a}{b}": f"{parts[a]} * {parts[b]}" for k, a in enumerate(names) for b in names[k:]}
    m = lambda a, b: f"(f{a}{b} - f{a} * f{b})" if f"f{a}{b}" in exprs else f"(f{b}{a} - f{a} * f{b})"
    tau = {"rr": lambda a, b: m(f"r{a}", f"r{b}"), "dd": lambda a, b: m(f"d{a}", f"d{b}"), "x": lambda a, b: f"({m(f'r{a}', f'd{b}')} + {m(f'd{a}', f'r{b}')})"}

    def con(p: str, q: str) -> str:
        terms = [f"{axes[a](f'f{p}{a}')} * {tau[q](a, a)}" for a in range(3)] + [f"({axes[b](f'f{p}{a}')} + {axes[a](f'f{p}{b}')}) * {tau[q](a, b)}" for a in range(3) for b in range(a + 1, 3)]
        return f"(-({' + '.join(terms)}))"

    split = lambda spark, sf: _r(D.flux_decomposed(volume_cells(spark, sf), Setting(BOX, TopHat(), 4.0), ["u", "v", "w"], ["th", "w", "rho"]), "rotational", "cross", "divergent", "total", keys=at3)
    add("pi_decomposed_3d", split, f"WITH {VOLUME_SQL}, f AS ({sql_filter(exprs, near3(4), source='volume', keys=at3)}), g AS (SELECT i, j, k, {con('r', 'rr')} AS rotational, {con('d', 'dd')} AS divergent, {con('r', 'dd')} + {con('d', 'rr')} + {con('r', 'x')} + {con('d', 'x')} AS \"cross\" FROM f) SELECT i, j, k, {_rs('rotational', 'divergent')}, round(\"cross\", 6) + 0.0 AS \"cross\", round(rotational + divergent + \"cross\", 6) + 0.0 AS total FROM g")

    lon, lat = f"({2 * math.pi / NX!r} * (i - 1))", "radians(10.0 * (j - 6))"
    frame = f"SELECT *, sin({lon}) AS sl, cos({lon}) AS cl, sin({lat}) AS sp, cos({lat}) AS cp FROM "
    xyz = f"xyz AS (SELECT i, j, th, -u * sl - v * sp * cl AS u, u * cl - v * sp * sl AS v, v * cp AS w FROM ({frame} cells))"
    ring = lambda f: f"((CASE WHEN i = 50 THEN first_value({f}) OVER (PARTITION BY j ORDER BY i) ELSE lead({f}) OVER (PARTITION BY j ORDER BY i) END - CASE WHEN i = 1 THEN last_value({f}) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag({f}) OVER (PARTITION BY j ORDER BY i) END) / {4 * math.pi / NX!r} / (60.0 * cp))"
    north = lambda f: _dy(f, step=repr(60.0 * math.radians(10.0)))
    weight = f"cos({LAT.format('n')})"
    j = [f"(p{k} - b{k} * tb)" for k in range(3)]
    east, up = f"(-sl * {j[0]} + cl * {j[1]})", f"(-sp * cl * {j[0]} - sp * sl * {j[1]} + cp * {j[2]})"
    add("tracer_flux_spherical", lambda spark, sf: _r(D.tracer_flux(cells(spark, sf), Setting(SPHERE, TopHat(), 30.0), "th"), "pi_tracer"), f"WITH {CELLS_SQL}, {xyz}, f AS ({sql_filter(tracer, f'{ARC} <= 15.0', weight, source='xyz')}), g AS (SELECT i, j, -({east} * {ring('tb')} + {up} * {north('tb')}) AS pi_tracer FROM ({frame} f)) SELECT i, j, {_rs('pi_tracer')} FROM g")

    six = [f"{p}{k}" for p in "md" for k in range(3)]
    first = f"m AS ({sql_filter({f'm{k}': f'n.{c}' for k, c in enumerate('uvw')}, f'{ARC} <= 15.0', weight, source='xyz')}), d AS (SELECT i, j, m0, m1, m2, u - m0 AS d0, v - m1 AS d1, w - m2 AS d2 FROM xyz JOIN m USING (i, j))"
    second = {f"f{a}": f"n.{a}" for a in six} | {f"f{a}{b}": f"n.{a} * n.{b}" for k, a in enumerate(six) for b in six[k:]}
    mm = lambda a, b: f"(f{a}{b} - f{a} * f{b})" if f"f{a}{b}" in second else f"(f{b}{a} - f{a} * f{b})"
    kinds = {"l": lambda a, b: mm(f"m{a}", f"m{b}"), "c": lambda a, b: f"({mm(f'm{a}', f'd{b}')} + {mm(f'd{a}', f'm{b}')})", "r": lambda a, b: mm(f"d{a}", f"d{b}")}
    e, n = ("(-sl)", "cl", "0.0"), ("(-sp * cl)", "(-sp * sl)", "cp")
    local = lambda t, a, b: " + ".join(f"{a[p]} * {t(p, q)} * {b[q]}" for p in range(3) for q in range(3))
    keep = [f"{p}_{x}" for p in "lcr" for x in ("xx", "xy", "yy")]
    lcr = ", ".join(f"{local(t, a, b)} AS {p}_{x}" for p, t in kinds.items() for x, a, b in (("xx", e, e), ("xy", e, n), ("yy", n, n)))
    add("tau_lcr_spherical", lambda spark, sf: _r(D.stress_decomposition(cells(spark, sf), Setting(SPHERE, TopHat(), 30.0)), *keep), f"WITH {CELLS_SQL}, {xyz}, {first}, f AS ({sql_filter(second, f'{ARC} <= 15.0', weight, source='d')}), g AS (SELECT i, j, {lcr} FROM ({frame} f)) SELECT i, j, {_rs(*keep)} FROM g")

    def fitted(source: str, keys: tuple[str, ...], edges: str, dx: str, dy: str, on: str = "true") -> str:
        """CTE g: the plane flux of ``source`` by least squares over ``edges`` of t to n."""
        w = f"(1 / ({dx} * {dx} + {dy} * {dy}))"
        sums = ", ".join(f"sum({w} * {a} * {b}) AS {k}" for k, a, b in (("xx", dx, dx), ("xy", dx, dy), ("yy", dy, dy), ("xu", dx, "(n.ub - t.ub)"), ("yu", dy, "(n.ub - t.ub)"), ("xv", dx, "(n.vb - t.vb)"), ("yv", dy, "(n.vb - t.vb)")))
        key = ", ".join(f"t.{k}" for k in keys)
        det = "(xx * yy - xy * xy)"
        slope = lambda a, b, c, d: f"coalesce(CASE WHEN {det} > 1e-12 * xx * yy THEN ({a} * {b} - {c} * {d}) / {det} ELSE 0 END, 0)"
        ux, uy, vx, vy = slope("yy", "xu", "xy", "yu"), slope("xx", "yu", "xy", "xu"), slope("yy", "xv", "xy", "yv"), slope("xx", "yv", "xy", "xv")
        return f"s AS (SELECT {key}, {sums} FROM {edges} WHERE {on} GROUP BY {key}), g AS (SELECT {', '.join(keys)}, -({ux} * (uu - ub * ub) + ({uy} + {vx}) * (uv - ub * vb) + {vy} * (vv - vb * vb)) AS pi FROM {source} LEFT JOIN s USING ({', '.join(keys)}))"

    mesh = Points(("i", "j"))

    def curvilinear(spark, sf):
        df = cells(spark, sf).withColumns({"x": 2.0 * F.col("i") + 0.5 * F.col("j"), "y": 3.0 * F.col("j") - 0.25 * F.col("i"), "area": F.lit(6.125)})
        at = lambda p: df.select(F.col("i").alias(f"{p}_i"), F.col("j").alias(f"{p}_j"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
        ends = neighbours(df).select(F.col("i").alias("t_i"), F.col("j").alias("t_j"), F.col("n_i").alias("s_i"), F.col("n_j").alias("s_j")).join(at("t"), ["t_i", "t_j"]).join(at("s"), ["s_i", "s_j"])
        dx, dy = F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty")
        stencil = ends.select("t_i", "t_j", "s_i", "s_j", F.sqrt(dx * dx + dy * dy).alias("d"), F.array(dx, dy).alias("delta"))
        return _r(D.energy_flux(df, Setting(mesh, TopHat(), 12.1, active="active", stencil=stencil)), "pi")

    gx, gy = "(2.0 * (n.i - t.i) + 0.5 * (n.j - t.j))", "(3.0 * (n.j - t.j) - 0.25 * (n.i - t.i))"
    f = f"f AS ({sql_filter(FLUX, f'sqrt({gx} * {gx} + {gy} * {gy}) <= 6.05', mask=True)})"
    add("pi_curvilinear", curvilinear, f"WITH {CELLS_SQL}, {f}, {fitted('f', ('i', 'j'), 'f t JOIN f n ON abs(n.i - t.i) + abs(n.j - t.j) = 1', gx, gy, 'n.active AND t.active')} SELECT i, j, {_rs('pi')} FROM g")

    def node_flux(spark, sf):
        df = supplier_nodes(spark, sf).withColumns({"u": F.col("f"), "v": F.col("area")})
        got = D.energy_flux(df, Setting(NODES, TopHat(), 1500.0, stencil=NODES.nearest(df, 6, 20000.0)))
        return got.select("node", (F.round("pi", 4) + 0.0).alias("pi"))

    nodes = NODES_SQL.replace("AS f FROM supplier", "AS f, (s_nationkey % 13)::DOUBLE AS u, (s_suppkey % 5 + 1)::DOUBLE AS v FROM supplier")
    near = "(n.x - t.x) * (n.x - t.x) + (n.y - t.y) * (n.y - t.y)"
    f = f"b AS ({sql_filter(FLUX, f'{near} <= 750.0 * 750.0', 'n.area', source='nodes', keys=('node',))}), f AS (SELECT * FROM b JOIN (SELECT node, x, y FROM nodes) USING (node))"
    ranks = f"p AS (SELECT t.node AS t, n.node AS n, row_number() OVER (PARTITION BY t.node ORDER BY sqrt({near}), n.node) AS rank FROM nodes t JOIN nodes n ON n.node <> t.node)"
    add("pi_nodes", node_flux, f"WITH {nodes}, {f}, {ranks}, {fitted('f', ('node',), 'p JOIN f t ON t.node = p.t JOIN f n ON n.node = p.n', '(n.x - t.x)', '(n.y - t.y)', 'p.rank <= 6')} SELECT node, round(pi, 4) + 0.0 AS pi FROM g")

    narrow = Grid.box(NX, 8)
    ragged = lambda spark, sf: volume_cells(spark, sf).filter((F.col("k") != 2) | (F.col("j") <= 8))
    add("filter_slices", lambda spark, sf: _r(filter_slices(ragged(spark, sf), "k", {1: PLANE, 2: narrow, 3: PLANE}, TopHat(), 4.0, ["u", "v"]), "u", "v", keys=at3), f"WITH {VOLUME_SQL}, part AS (SELECT * FROM volume WHERE k <> 2 OR j <= 8), f AS ({sql_filter({'u': 'n.u', 'v': 'n.v'}, disk(4) + ' AND n.k = t.k', source='part', keys=at3)}) SELECT i, j, k, {_rs('u', 'v')} FROM f")

    line = CELLS_SQL.replace("cells AS", "line AS").replace("CAST(round(l_discount * 100) AS INT) + 1 AS j,", "0 AS j,")
    one = " UNION ALL ".join(f"(WITH f AS ({sql_filter({'ub': 'n.u', 'uu': 'n.u * n.u'}, f'abs(n.i - t.i) <= {x / 2}', source='line', keys=('i',))}), g AS (SELECT i, -{sql_slope('ub', 'i', '')} * (uu - ub * ub) AS pi FROM f) SELECT i, {n} AS scale_idx, {x!r}::DOUBLE AS scale, {_rs('pi')} FROM g)" for n, x in enumerate(SCALES, 1))
    add("coarse_grain_1d", lambda spark, sf: _r(coarse_grain(_fields(_sums(_read(spark, sf, "lineitem"), _i())), LINE, SCALES, "u", None, spectrum="force").flux, "pi", keys=("i", "scale_idx", "scale")), f"WITH {line} {one}")

    moments = {f"b{a}": f"n.{c}" for a, c in enumerate("uvw")} | {f"p{a}{b}": f"n.{c} * n.{d}" for a, c in enumerate("uvw") for b, d in enumerate("uvw") if a <= b}
    t = lambda a, b: f"(p{a}{b} - b{a} * b{b})"
    pi3 = f"-({x3('b0')} * {t(0, 0)} + {y3('b1')} * {t(1, 1)} + {z3('b2')} * {t(2, 2)} + ({y3('b0')} + {x3('b1')}) * {t(0, 1)} + ({z3('b0')} + {x3('b2')}) * {t(0, 2)} + ({z3('b1')} + {y3('b2')}) * {t(1, 2)})"
    three = " UNION ALL ".join(f"(WITH f AS ({sql_filter(moments, near3(x), source='volume', keys=at3)}), g AS (SELECT i, j, k, {pi3} AS pi FROM f) SELECT i, j, k, {n} AS scale_idx, {x!r}::DOUBLE AS scale, round(pi, 5) + 0.0 AS pi FROM g)" for n, x in enumerate([2.0, 4.0], 1))
    add("coarse_grain_3d", lambda spark, sf: coarse_grain(volume_cells(spark, sf), BOX, [2.0, 4.0], "u", "v", "w", spectrum="none").flux.select(*at3, "scale_idx", "scale", (F.round("pi", 5) + 0.0).alias("pi")), f"WITH {VOLUME_SQL} {three}")

    both = lambda n, x: f"SELECT {n} AS scale_idx, {x!r} AS scale, sum(ub * ub + vb * vb) / 2 / count(*) AS cumulative_energy FROM ({sql_filter({'ub': 'n.u', 'vb': 'n.v'}, square(Gaussian(), x), gauss(x), mask=True)}) q WHERE active"
    energies = " UNION ALL ".join(both(n, x) for n, x in enumerate(SCALES, 1))
    by = "OVER (ORDER BY scale_idx)"
    slope = f"(coalesce(lead(cumulative_energy) {by}, cumulative_energy) - coalesce(lag(cumulative_energy) {by}, cumulative_energy)) / (coalesce(lead(1 / scale) {by}, 1 / scale) - coalesce(lag(1 / scale) {by}, 1 / scale))"
    strict = lambda spark, sf: D.filtering_spectrum(cells(spark, sf), Setting(PLANE, Gaussian(), 4.0, active="active"), SCALES, spectrum="strict").select("scale_idx", "scale", *((F.round(c, 6) + 0.0).alias(c) for c in ("cumulative_energy", "filtering_spectrum")))
    add("filtering_spectrum_strict", strict, f"WITH {CELLS_SQL}, e AS ({energies}), s AS (SELECT scale_idx, scale::DOUBLE AS scale, cumulative_energy, {slope} AS filtering_spectrum FROM e) SELECT scale_idx, scale, {_rs('cumulative_energy', 'filtering_spectrum')} FROM s")

    def growing(spark, sf):
        """Part by discount: as many rows of cells as there are parts, so the field grows with the data."""
        sums = _sums(_read(spark, sf, "lineitem"), F.col("l_partkey").cast("int").alias("i"), _j())
        most = sums.agg(F.max("i")).first()[0]
        grid = Grid.box(most, NY)
        dense = grid.densify(_fields(sums).select("i", "j", "u"), ["u"])
        return _r(filter_field(dense, grid, TopHat(), 6.0, "u", active="active", strategy=DEFORMABLE), "u")

    sums = "SELECT l_partkey::INT AS i, CAST(round(l_discount * 100) AS INT) + 1 AS j, sum(l_linenumber * 3 + l_suppkey % 7)::BIGINT AS a FROM lineitem GROUP BY 1, 2"
    wide = f"c AS ({sums}), cells AS (SELECT x.i::INT AS i, y.j::INT AS j, coalesce(a % 41 - 20, 0)::DOUBLE AS u, a IS NOT NULL AS active FROM range(1, (SELECT max(i) + 1 FROM c)) x(i) CROSS JOIN range(1, {NY + 1}) y(j) LEFT JOIN c ON c.i = x.i AND c.j = y.j), rows3 AS (SELECT i + o.o AS ti, i, j, u, active FROM cells, (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) o(o))"
    here = "sum(CASE WHEN n.active AND (n.i - t.i) * (n.i - t.i) + (n.j - t.j) * (n.j - t.j) <= 9.0 THEN {} END)"
    add("filter_growing_grid", growing, f"WITH {wide}, f AS (SELECT t.i, t.j, CASE WHEN t.active THEN coalesce({here.format('n.u')} / {here.format('1.0')}, 0) ELSE 0 END AS u FROM cells t JOIN rows3 n ON n.ti = t.i GROUP BY t.i, t.j, t.active) SELECT i, j, {_rs('u')} FROM f")


def _build_transforms() -> None:
    add = _register
    def fft(spark, sf):
        return _r(S.fft_filter(cells(spark, sf), TORUS, Gaussian(), [5.0], {"u": F.col("u")}), "u")

    # The circulant kernel of the same transfer function, as a sum over modes along each axis.
    g = lambda n: f"(SELECT d, sum(cos(2 * pi() * m * d / {n}) * exp(-pow(2 * pi() * least(m, {n} - m) / {n} * 5.0, 2) / 24.0)) / {n} AS g FROM range(0, {n}) a(m), range(0, {n}) b(d) GROUP BY d)"
    add("spectral_fft", fft, f"WITH {CELLS_SQL}, gi AS {g(NX)}, gj AS {g(NY)}, a AS (SELECT t.i, n.j, sum(n.u * gi.g) AS u FROM (SELECT DISTINCT i FROM cells) t CROSS JOIN cells n JOIN gi ON gi.d = (n.i - t.i + 50) % 50 GROUP BY 1, 2), b AS (SELECT a.i, t.j, sum(a.u * gj.g) AS u FROM (SELECT DISTINCT j FROM cells) t CROSS JOIN a JOIN gj ON gj.d = (a.j - t.j + 11) % 11 GROUP BY 1, 2) SELECT i, j, {_rs('u')} FROM b")
    add("spectral_padded_fft", lambda spark, sf: _r(S.padded_fft_filter(cells(spark, sf), PLANE, TopHat(), [6.0], {"u": F.col("u")}, active="active"), "u"), _plain(sql_filter({"u": "n.u"}, disk(6), mask=True), "u"))
    add("pi_spectral", lambda spark, sf: _r(D.energy_flux(cells(spark, sf), replace(S_PLAIN, space=TORUS, kernel=Gaussian(), scale=5.0, transform=S.transform_setting(S.fft_filter))), "pi"), f"WITH {CELLS_SQL}, {_torus_pi(5.0, '')} SELECT i, j, {_rs('pi')} FROM pi")
    scales = [4.0, 5.0, 8.0]
    union = " UNION ALL ".join(f"SELECT i, j, {n} AS scale_idx, {x!r}::DOUBLE AS scale, {_rs('pi')} FROM pi{n}" for n, x in enumerate(scales, 1))
    sweep = f"WITH {CELLS_SQL}, {', '.join(_torus_pi(x, n) for n, x in enumerate(scales, 1))} {union}"

    def one_forward(spark, sf):
        return _r(S.analyze_sweep(cells(spark, sf), Setting(TORUS, Gaussian(), 5.0), scales), "pi", keys=("i", "j", "scale_idx", "scale"))

    add("analyze_sweep", one_forward, sweep)
    for method in ("spectral", "auto"):
        add(f"coarse_grain_{method}", lambda spark, sf, method=method: _r(coarse_grain(cells(spark, sf), TORUS, scales, kernel=Gaussian(), method=method).flux, "pi", keys=("i", "j", "scale_idx", "scale")), sweep)
    points = Points(("i", "j"), ("x", "y"), None)

    def ndft(spark, sf):
        df = cells(spark, sf).withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})
        return _r(S.node_transform_filter(df, points, Gaussian(), [5.0], {"u": F.col("u")}, modes=(NX, NY), lengths=(float(NX), float(NY))), "u")

    add("spectral_ndft", ndft, ORACLES["spectral_fft"])
    n = 6
    harmonic = Grid((Axis.of((2 * math.pi * np.arange(2 * n - 1) / (2 * n - 1)).tolist()), Axis.of((math.pi / 2 - math.pi * (np.arange(n) + 0.5) / n).tolist())), geometry="spherical", radius=1.0)

    def sht(spark, sf):
        return _r(S.sphere_grid_filter(sphere_cells(spark, sf, n), harmonic, Gaussian(), [1.0], {"u": F.col("u")}), "u")

    add("spectral_sht", sht, _sphere_sql(n, 1.0))

    def nusht(spark, sf):
        df = cells(spark, sf).withColumns({"lon": F.col("i") * (2 * math.pi / NX), "lat": F.asin((F.col("j") - 6) / 6.0)})
        return _r(S.sphere_node_filter(df, Points(("i", "j"), ("lon", "lat"), None, "spherical"), Gaussian(), [1.0], {"u": F.col("u")}), "u")

    # By the addition theorem, a sum over degrees of the angle between two nodes; degrees as many as the nodes bear.
    top = math.isqrt(NX * NY) - 1
    series = np.polynomial.legendre.leg2poly([math.exp(-k * (k + 1) / 24) * (2 * k + 1) / (NX * NY) for k in range(top + 1)])
    x = f"((n.j - 6) / 6.0 * (t.j - 6) / 6.0 + sqrt(greatest(0.0, (1 - pow((n.j - 6) / 6.0, 2)) * (1 - pow((t.j - 6) / 6.0, 2)))) * cos({2 * math.pi / NX!r} * (n.i - t.i)))"
    horner = reduce(lambda inner, c: f"({c!r}::DOUBLE + x * {inner})", [float(c) for c in series[-2::-1]], f"{float(series[-1])!r}::DOUBLE")
    add("spectral_nusht", nusht, f"WITH {CELLS_SQL}, pairs AS (SELECT t.i, t.j, n.u, {x} AS x FROM cells t CROSS JOIN cells n), f AS (SELECT i, j, sum(u * {horner}) AS u FROM pairs GROUP BY i, j) SELECT i, j, {_rs('u')} FROM f")


_build_filters()
_build_derivatives()
_build_diagnostics()
_build_pipelines()
_build_variants()
_build_transforms()


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The flux of every cell at several scales."""
    return QUERIES["coarse_grain_sweep"](spark, sf)
