"""Engines against each other and against plain sums; identities of the diagnostics."""

import math
from dataclasses import replace
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scalewright import DEFORMABLE, ZEROFILL, Axis, Gaussian, Grid, HighOrder, Points, Setting, SmoothHat, TopHat, check_setup, choose_engine, coarse_grain, coarse_grain_profile, coarse_grain_slices, filter_field, filter_slices
from scalewright.operators import diagnostics as D
from scalewright.operators import spectral as S
from scalewright.operators import tiles
from scalewright.operators.derivatives import derivatives
from scalewright.queries import QUERIES
from scalewright.sources import corner_areas, hull_areas


def array(df, column, grid):
    rows = df.toPandas().sort_values(list(reversed(grid.dims)))
    return rows[column].to_numpy().reshape(tuple(reversed(grid.shape)))


@pytest.fixture(scope="module")
def plane(spark):
    grid = Grid.box(13, 11)
    df = grid.cells(spark).withColumns({"f": ((F.col("i") * 7 + F.col("j") * F.col("j") * 3) % 11).cast("double"), "active": ~(F.col("i").between(4, 6) & F.col("j").between(3, 5)) & (F.col("i") != 1)})
    return grid, df.cache()


@pytest.fixture(scope="module")
def flow(spark):
    grid = Grid.box(24, 24)
    x, y = F.col("x"), F.col("y")
    df = grid.with_coords(grid.cells(spark)).withColumns({"u": F.sin(x / 3) * F.cos(y / 4) + 0.4 * F.cos(x), "v": F.cos(x / 5) * F.sin(y / 2), "w": F.sin(x / 4), "ur": F.sin(x / 3), "vr": F.cos(y / 2), "th": F.sin(x / 5) * F.cos(y / 6), "active": ~(F.col("i").between(10, 14) & F.col("j").between(8, 12))})
    return grid, df.cache()


def brute(grid, f, m, kernel, scale, strategy, square):
    ny, nx = f.shape
    r = kernel.radius(scale)
    out = np.zeros_like(f)
    for j in range(ny):
        for i in range(nx):
            num = den = 0.0
            for b in range(ny):
                for a in range(nx):
                    d = math.hypot(a - i, b - j)
                    near = max(abs(a - i), abs(b - j)) <= math.ceil(r) if square else d <= r
                    if near:
                        w = kernel.weight(d, scale)
                        num += w * f[b, a] * m[b, a]
                        den += w * (m[b, a] if strategy == DEFORMABLE else 1)
            out[j, i] = num / den if m[j, i] and den else 0
    return out


@pytest.mark.parametrize("strategy", [ZEROFILL, DEFORMABLE])
@pytest.mark.parametrize("kernel", [TopHat(), Gaussian(), SmoothHat()])
def test_engines_equal_plain_sums(plane, kernel, strategy, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_CELLS", 39)
    grid, df = plane
    want = brute(grid, array(df, "f", grid), array(df, "active", grid), kernel, 5.0, strategy, kernel.separable)
    engines = ["separable", "tiled"] if kernel.separable else ["banded", "tiled", "ball", *(["prefix"] if isinstance(kernel, TopHat) else [])]
    for engine in engines:
        got = array(filter_field(df, grid, kernel, 5.0, "f", strategy=strategy, active="active", engine=engine), "f", grid)
        assert np.allclose(got, want, atol=1e-12), engine


@pytest.mark.parametrize("kernel", [TopHat(), Gaussian()])
def test_periodic_engines_agree(spark, kernel):
    grid = Grid.box(9, 8, periodic=True)
    df = grid.cells(spark).withColumn("f", ((F.col("i") * 5 + F.col("j") * 3) % 7).cast("double"))
    scale = 22.0 if isinstance(kernel, TopHat) else 6.0  # wider than the domain: all images count
    got = [array(filter_field(df, grid, kernel, scale, "f", engine=e), "f", grid) for e in ("separable" if kernel.separable else "banded", "tiled")]
    assert np.allclose(*got, atol=1e-12)


def test_constants_stay_and_stencils_are_exact(spark):
    grid = Grid((Axis.of([0, 1, 2.5, 4, 7, 12, 19]), Axis.of([0, 0.5, 1.5, 3.5, 7.5])))
    df = grid.with_coords(grid.cells(spark)).withColumns({"c": F.lit(7.5), "q": F.col("x") * F.col("x") + F.col("y") * F.col("y")})
    for kernel in (Gaussian(), TopHat()):
        assert np.allclose(array(filter_field(df, grid, kernel, 5.0, "c"), "c", grid), 7.5)
    d = derivatives(df, grid, ["q"]).toPandas()
    assert np.allclose(d.q_x, 2 * d.x) and np.allclose(d.q_y, 2 * d.y)
    back = Grid((Axis.of([-c for c in grid.axes[0].coords]), grid.axes[1]))
    assert np.allclose(array(derivatives(df, back, ["q"], dims=[0]), "q_x", back), -array(derivatives(df, grid, ["q"], dims=[0]), "q_x", grid))


def test_derivative_order(spark):
    errors = []
    for n in (40, 80):
        grid = Grid.box(n, step=100 / n, periodic=True)
        df = grid.with_coords(grid.cells(spark)).withColumn("f", F.sin(F.col("x") * (2 * math.pi / 100)))
        d = derivatives(df, grid, ["f"]).toPandas()
        errors.append(np.abs(d.f_x - 2 * math.pi / 100 * np.cos(2 * math.pi * d.x / 100)).max())
    assert 1.8 < math.log2(errors[0] / errors[1]) < 2.2


def test_rotation_has_no_flux(spark):
    grid = Grid.box(21, 21, step=2.0)
    df = grid.with_coords(grid.cells(spark)).withColumns({"u": -1e-4 * (F.col("y") - 20), "v": 1e-4 * (F.col("x") - 20)})
    assert np.abs(array(D.energy_flux(df, Setting(grid, TopHat(), 10.0)), "pi", grid)[6:15, 6:15]).max() < 1e-20


def test_identities(flow):
    grid, df = flow
    s = Setting(grid, Gaussian(), 5.0, active="active")
    pi = array(D.energy_flux(df, s), "pi", grid)
    assert np.abs(pi).max() > 1e-3 and (pi[7:12, 9:14] == 0).all()
    split = D.strain_convergence(df, s)
    assert np.allclose(array(split, "pi", grid), pi, atol=1e-14)
    assert np.allclose(array(D.flux_decomposed(df, s, ["u", "v"], ["ur", "vr"]), "total", grid), pi, atol=1e-14)
    tau = D.stress_decomposition(df, s).filter("active").toPandas().sort_values(["j", "i"])
    want = D._moments(df, s, [F.col("u"), F.col("v")]).filter("active").toPandas().sort_values(["j", "i"])
    for k in ("xx", "xy", "yy"):
        assert np.allclose(tau[f"tau_{k}"], want[f"t_{k}"], atol=1e-14)
    z = array(D.enstrophy_flux(df, s), "enstrophy_flux", grid)
    assert np.array_equal(z, array(D.tracer_flux(D.vorticity(df, s), s, "vorticity"), "pi_tracer", grid))
    flat = D.compressible_flux(df.withColumns({"rho": F.lit(2.0), "p": F.col("th")}), replace(s, active=None))
    assert np.abs(array(flat, "baropycnal", grid)).max() < 1e-14
    assert np.allclose(array(D.favre_filter(df.withColumn("rho", F.lit(3.0)), replace(s, active=None), "rho", ["u"]), "u", grid), array(filter_field(df, grid, Gaussian(), 5.0, "u"), "u", grid))
    with pytest.raises(Exception, match="positive"):
        D.compressible_flux(df.withColumns({"rho": F.lit(-1.0), "p": F.col("th")}), s).collect()


def test_bands_sum_to_the_energy(spark):
    grid = Grid.box(16, 16, periodic=True)
    df = grid.with_coords(grid.cells(spark)).withColumns({"u": F.sin(F.col("x") * (6 * math.pi / 16)) * F.cos(F.col("y") * (4 * math.pi / 16)), "v": F.cos(F.col("x") * (2 * math.pi / 16)) * 0.7})
    got = D.band_energies(df, Setting(grid, Gaussian(), 1.0), [3.0, 6.0]).first()
    assert got.total == pytest.approx(df.agg(F.avg((F.col("u") ** 2 + F.col("v") ** 2) / 2)).first()[0], rel=1e-12)
    for bad in ([], [6.0, 3.0]):
        with pytest.raises(ValueError):
            D.band_energies(df, Setting(grid, Gaussian(), 1.0), bad)


def test_transforms(spark, plane):
    grid = Grid.box(16, 12, periodic=True)
    df = grid.with_coords(grid.cells(spark)).withColumn("f", F.sin(F.col("x") * (6 * math.pi / 16)) * F.cos(F.col("y") * (4 * math.pi / 12)))
    f = array(df, "f", grid)
    want = f * Gaussian().transfer(2 * math.pi * math.hypot(3 / 16, 2 / 12), 4.0)
    exprs = {"f": F.col("f")}
    assert np.allclose(array(S.fft_filter(df, grid, Gaussian(), [4.0], exprs), "f", grid), want)
    assert np.allclose(array(S.auto_filter(df, grid, Gaussian(), 4.0, exprs), "f", grid), want)
    points = Points(("i", "j"), ("x", "y"), None)
    assert np.allclose(array(S.node_transform_filter(df, points, Gaussian(), [4.0], exprs, modes=(16, 12), lengths=(16.0, 12.0)), "f", grid), want)
    bounded, masked = plane
    got = array(S.padded_fft_filter(masked, bounded, TopHat(), [5.0], exprs, active="active", strategy=DEFORMABLE), "f", bounded)
    assert np.allclose(got, array(filter_field(masked, bounded, TopHat(), 5.0, "f", strategy=DEFORMABLE, active="active"), "f", bounded))
    with pytest.raises(ValueError, match="periodic"):
        S.fft_filter(masked, bounded, Gaussian(), [4.0], exprs)
    n = 8
    ball = Grid((Axis.of((2 * math.pi * np.arange(2 * n - 1) / (2 * n - 1)).tolist()), Axis.of((math.pi / 2 - math.pi * (np.arange(n) + 0.5) / n).tolist())), geometry="spherical")
    harmonic = ball.with_coords(ball.cells(spark)).withColumn("f", F.sin("y") * F.cos("y") * F.cos("x"))
    assert np.allclose(array(S.sphere_grid_filter(harmonic, ball, Gaussian(), [1.0], exprs), "f", ball), array(harmonic, "f", ball) * math.exp(-6 / 24))


def test_sphere(spark):
    grid = Grid((Axis.of(np.radians(np.arange(0, 360, 20)).tolist()), Axis.of(np.radians(np.arange(-60, 61, 20)).tolist())), geometry="spherical", radius=6371.0)
    assert grid.axes[0].period == pytest.approx(2 * math.pi)
    df = grid.with_coords(grid.cells(spark)).withColumns({"u": 50 * F.cos("y"), "v": F.lit(0.0), "f": F.sin(2 * F.col("x")) * F.cos("y")})
    ring, join = (array(filter_field(df, grid, TopHat(), 6000.0, "f", engine=e), "f", grid) for e in ("banded", "ball"))
    assert np.allclose(ring, join, atol=1e-12)
    assert np.abs(array(D.energy_flux(df, Setting(grid, TopHat(), 6000.0)), "pi", grid)[2:-2]).max() < 1e-12
    total = df.agg(F.sum(grid.measure())).first()[0]
    assert 0.7 < total / (4 * math.pi * 6371.0**2) < 1.0


def test_shell_and_box(spark):
    shell = Grid((Axis.of(np.radians(np.arange(0, 360, 40)).tolist()), Axis.of(np.radians(np.arange(-40, 41, 20)).tolist()), Axis.of([6371.0, 6381.0, 6391.0])), geometry="spherical", radius=6371.0)
    df = shell.with_coords(shell.cells(spark)).withColumns({"u": 1e-3 * F.col("z") * F.cos("y"), "v": F.lit(0.0), "w": F.lit(0.0)})
    assert np.abs(array(D.energy_flux(df, Setting(shell, TopHat(), 500.0), "u", "v", "w"), "pi", shell)).max() < 1e-9
    box, flat = Grid.box(9, 9, 4), Grid.box(9, 9)
    df = box.with_coords(box.cells(spark)).withColumns({"u": F.sin(F.col("x") / 2) * F.cos("y"), "v": F.cos("x") * F.sin(F.col("y") / 3), "w": F.lit(0.0)})
    deep = array(D.energy_flux(df, Setting(box, Gaussian(), 3.0), "u", "v", "w"), "pi", box)
    thin = array(D.energy_flux(df.filter("k = 1"), Setting(flat, Gaussian(), 3.0)), "pi", flat)
    assert np.allclose(deep, thin[None], atol=1e-7)


def test_points(flow):
    grid, df = flow
    points = Points(("i", "j"), ("x", "y"), "area")
    df = df.withColumns({"area": F.lit(1.0), "h": 3 * F.col("x") - 2 * F.col("y")})
    assert np.allclose(array(filter_field(df, points, TopHat(), 6.0, "u"), "u", grid), array(filter_field(df, grid, TopHat(), 6.0, "u"), "u", grid))
    near = points.nearest(df, 4, 2.5)
    assert near.groupBy("t_i", "t_j").count().filter("count <> 4").count() == 0
    g = points.gradient(df, near, ["h"]).toPandas()
    assert np.allclose(g.h_x, 3) and np.allclose(g.h_y, -2)
    flux = D.energy_flux(df, Setting(points, TopHat(), 6.0, stencil=near))
    inner = array(flux, "pi", grid)[4:-4, 4:-4]
    assert np.allclose(inner, array(D.energy_flux(df, Setting(grid, TopHat(), 6.0)), "pi", grid)[4:-4, 4:-4], atol=1e-12)
    cells = hull_areas(df.select(F.expr("i * 100 + j").alias("node"), "x", "y"), points.nearest(df.withColumn("node", F.expr("i * 100 + j")), 8, 3.0).select(F.expr("t_i * 100 + t_j").alias("node"), F.expr("s_i * 100 + s_j").alias("nbr")), reach=2.0).toPandas()
    assert np.allclose(cells.area[cells.node.isin([505, 1212])], 1.0)


def test_corner_areas(spark):
    corners = spark.range(1, 4).crossJoin(spark.range(1, 4).withColumnRenamed("id", "cj")).select(F.col("id").alias("ci"), "cj", (2.0 * F.col("id")).alias("x"), (3.0 * F.col("cj")).alias("y"))
    assert [r.area for r in corner_areas(corners).collect()] == [6.0] * 4
    octant = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, math.pi / 4, 0.0), (2, 2, math.pi / 4, math.pi / 4), (1, 2, 0.0, math.pi / 4)], "ci int, cj int, x double, y double")
    # Great-circle sides: the upper one bulges poleward, so the cell is a little larger than its band.
    assert corner_areas(octant, "spherical", 2.0).first().area == pytest.approx(4 * math.pi / 4 * math.sin(math.pi / 4), rel=0.06)


def test_sweeps(spark, flow):
    grid, df = flow
    r = coarse_grain(df, grid, [3.0, 5.0, 7.0], kernel=Gaussian(), active="active", length=2.0, check=True)
    rows = r.spectrum.orderBy("scale_idx").collect()
    e, k = [x.cumulative_energy for x in rows], [x.wavenumber for x in rows]
    assert k == [2 / 3, 2 / 5, 2 / 7] and e == sorted(e, reverse=True)
    assert rows[1].filtering_spectrum == pytest.approx((e[2] - e[0]) / (k[2] - k[0])) and rows[0].filtering_spectrum == pytest.approx((e[1] - e[0]) / (k[1] - k[0]))
    assert r.flux.count() == 3 * 24 * 24
    with pytest.raises(ValueError, match="monotone"):
        coarse_grain(df, grid, [3.0])
    assert math.isnan(coarse_grain(df, grid, [3.0], spectrum="none").spectrum.first().filtering_spectrum)
    stack = df.withColumn("level", F.lit(1)).union(df.withColumns({"u": F.col("v"), "level": F.lit(2)}).select(*df.columns, "level"))
    profile = coarse_grain_profile(stack, grid, [5.0], kernel=Gaussian(), active="active")
    assert np.allclose(array(profile.slice(level=1).flux, "pi", grid), array(r.flux.filter("scale_idx = 2"), "pi", grid))
    small = Grid.box(10, 24)
    ragged = stack.filter("level = 1 OR i <= 10")
    parts = coarse_grain_slices(ragged, "level", {1: grid, 2: small}, [5.0], kernel=Gaussian())
    assert parts.flux.groupBy("level").count().orderBy("level").collect() == [(1, 576), (2, 240)]
    assert filter_slices(ragged, "level", {1: grid, 2: small}, TopHat(), 4.0, ["u"]).count() == 816
    with pytest.raises(ValueError, match="once"):
        grid.check(df.limit(5))


def test_uniform_flow(spark):
    grid = Grid.box(12, 12, step=2.0)
    df = grid.cells(spark).withColumns({"u": F.lit(0.5), "v": F.lit(0.3)})
    for row in coarse_grain(df, grid, [5.0, 9.0], kernel=Gaussian()).spectrum.collect():
        assert row.cumulative_energy == pytest.approx(0.17) and abs(row.filtering_spectrum) < 1e-12


def test_densify(spark):
    grid = Grid.box(3, 2)
    df = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 1, None), (2, 3, 2, 4.0)], "t int, i int, j int, f double")
    got = grid.densify(df, ["f"], batch=["t"]).collect()
    assert len(got) == 12 and sorted((r.t, r.i, r.j, r.f) for r in got if r.active) == [(1, 1, 1, 2.0), (2, 3, 2, 4.0)] and {r.f for r in got if not r.active} == {0.0}


def test_planner(spark):
    assert choose_engine(Grid.box(50, 50), TopHat(), 6.0) == "banded" and choose_engine(Grid.box(500, 500), TopHat(), 60.0) == "tiled"
    assert choose_engine(Grid.box(50, 50), Gaussian(), 6.0) == "separable" and choose_engine(Points(), TopHat(), 1.0) == "ball"
    with pytest.raises(ValueError, match="product"):
        choose_engine(Points(), HighOrder(), 1.0)
    grid = Grid.box(48, 48)
    report = check_setup(spark, grid, TopHat(), 6.0).first()
    assert report.resolvable and report.supports_flux and not report.supports_spectrum and report.boundary_buffer_cells == [3, 3]
    assert not check_setup(spark, grid, HighOrder(), 1.5).first().supports_flux and not check_setup(spark, grid, TopHat(), 1.5).first().resolvable
    with pytest.raises(ValueError):
        check_setup(spark, grid, TopHat(), 0.0)


def test_stream_of_slices(spark, tmp_path):
    from scalewright.streaming import sweep_stream

    grid = Grid.box(6, 6)
    for t in (1, 2):
        grid.cells(spark).withColumns({"t": F.lit(t), "u": F.col("i") * 1.0 * t, "v": F.col("j") * 1.0}).filter("i <> 2 OR j <> 2").coalesce(1).write.parquet(f"{tmp_path}/in/{t}")
    stream = spark.readStream.schema("i int, j int, t int, u double, v double").parquet(f"{tmp_path}/in/*")
    query = sweep_stream(stream, grid, [3.0], lambda r, n: r.flux.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), slice_key="t", checkpoint=f"{tmp_path}/check", kernel=Gaussian())
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/*").groupBy("t").count().orderBy("t").collect() == [(1, 36), (2, 36)]


def test_gaussian_wider_than_the_grid(spark):
    grid = Grid.box(30, 5)
    rng = np.random.default_rng(3)
    rows = [(i, j, float(rng.integers(-9, 9)), bool(i % 7)) for i in range(1, 31) for j in range(1, 6)]
    df = spark.createDataFrame(rows, "i int, j int, u double, active boolean")
    got = {(r.i, r.j): r.u for r in filter_field(df, grid, Gaussian(), 6.0, "u", active="active").collect()}
    for i, j, _, here in rows:
        w = [(math.exp(-6 * ((i - a) ** 2 + (j - b) ** 2) / 36), u if on else 0.0) for a, b, u, on in rows if abs(i - a) <= 12 and abs(j - b) <= 12]
        assert abs(got[i, j] - (sum(x * u for x, u in w) / sum(x for x, _ in w) if here else 0.0)) < 1e-12


def test_methods_of_a_sweep(spark):
    grid = Grid.box(8, 6, periodic=True)
    df = spark.createDataFrame([(t, i, j, float((i * j + t) % 5), float((i + 2 * j) % 3)) for t in (1, 2) for i in range(1, 9) for j in range(1, 7)], "t int, i int, j int, u double, v double")
    whole = coarse_grain(df, grid, [2.0, 3.0], kernel=Gaussian(), batch=["t"], method="auto")
    flux = {(r.t, r.i, r.j, r.scale_idx): r.pi for r in whole.flux.collect()}
    for n, scale in enumerate([2.0, 3.0], 1):
        alone = D.energy_flux(df, Setting(grid, Gaussian(), scale, ("t",), transform=S.transform_setting(S.fft_filter))).collect()
        assert all(abs(flux[r.t, r.i, r.j, n] - r.pi) < 1e-12 for r in alone)
    assert len(flux) == 192 and whole.spectrum.count() == 4
    with pytest.raises(ValueError, match="method"):
        coarse_grain(df, grid, [2.0], kernel=Gaussian(), batch=["t"], method="other")
    bounded = coarse_grain(df, Grid.box(8, 6), [2.0], kernel=Gaussian(), batch=["t"], method="auto").flux
    assert bounded.filter("scale = 2.0").count() == 96


def _joined_rows(df):
    """Rows that the joins of a DataFrame put out when it is collected, and the rows."""
    rows = df.collect()
    plans, made = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif "Join" in name:
            made += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(n) for n in range(children.size())]
    return made, rows


def test_nearest_takes_clusters_copies_and_gaps_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.uniform(0, 1000, (700, 2)), 500 + rng.normal(0, 0.01, (400, 2)).round(3), np.repeat([[250.0, 250.0]], 400, 0), [[90000.0, 90000.0], [-3000.0, 70.5]]])
    node = rng.permutation(len(xy))
    rows = [(int(n), float(x), float(y)) for n, (x, y) in zip(node, xy, strict=True)]
    df = spark.createDataFrame([*rows, (9001, None, 1.0), (9002, math.nan, 1.0), (9003, math.inf, 1.0)], "node long, x double, y double")
    made, got = _joined_rows(Points().nearest(df, 3, 50000.0).select("t_node", "rank", "s_node", "d"))
    want = []
    for n, p in zip(node, xy, strict=True):
        dx, dy = xy[:, 0] - p[0], xy[:, 1] - p[1]
        d = np.sqrt(dx * dx + dy * dy)
        order = [k for k in np.lexsort((node, d)) if node[k] != n and d[k] <= 50000.0][:3]
        want += [(int(n), r, int(node[k]), float(d[k])) for r, k in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert made < 600 * len(rows)


@pytest.mark.parametrize("points", [Points(period=(100.0, None)), Points(period=(30.0, 40.0)), Points(coords=("x", "y", "z")), Points(geometry="spherical", radius=100.0), Points(coords=("x", "y", "z"), geometry="spherical"), Points(keys=("node", "b"))], ids=str)
def test_nearest_equals_ranked_edges(spark, points):
    """On seams, spheres, in three dimensions, with repeated rows and slices: the first of all edges by distance and key."""
    turn = F.lit(2 * math.pi / 100 if points.spherical else 1.0)
    at = lambda a, m: F.pmod(F.col("id") * a, F.lit(m)).cast("double") * turn
    df = spark.range(160).select((F.col("id") % 150).alias("node"), (F.col("id") % 2).alias("b"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2).alias("t"), at(37, 97).alias("x"), (at(11, 23) - 11 * turn).alias("y"), (at(5, 13) + 20).alias("z"))
    reach = 60.0
    keys = list(points.keys)
    edges = points.edges(df, reach, batch=["t"]).filter(~reduce(lambda a, b: a & b, (F.col(f"t_{c}") == F.col(f"s_{c}") for c in keys)))
    by = Window.partitionBy("t", *(f"t_{c}" for c in keys)).orderBy("d", *(f"s_{c}" for c in keys))
    want = edges.withColumn("rank", F.row_number().over(by)).filter("rank <= 4")
    columns = ["t", *(f"t_{c}" for c in keys), "rank", *(f"s_{c}" for c in keys), "d"]
    assert sorted(map(tuple, points.nearest(df, 4, reach, batch=["t"]).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_node_flux_does_not_join_all_pairs(spark, tmp_path):
    n = 1500
    rows = spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"), (F.pmod(F.col("id") * 104729, F.lit(1099800)) / 100 - 999).alias("s_acctbal"))
    rows.write.parquet(str(tmp_path / "supplier.parquet"))
    made, got = _joined_rows(QUERIES["pi_nodes"](spark, str(tmp_path)))
    assert len(got) == n and made < n * n / 2


@pytest.mark.parametrize("period", [None, (40.0, None)], ids=str)
@pytest.mark.parametrize("strategy", ["zerofill", "deformable"])
def test_top_hat_on_nodes_joins_no_pairs(spark, period, strategy):
    """Sums by blocks give what a direct sum gives: seams, masks, gaps, repeated rows and values that are null or not finite."""
    rng = np.random.default_rng(8)
    at = rng.uniform(-30, 30, (300, 2)) if period is None else rng.uniform(0, 40, (300, 2))
    rows = [(n % 290, float(x), float(y), None if n % 41 == 0 else math.inf if n == 7 else float(n % 9), float(n % 4), n % 6 > 0) for n, (x, y) in enumerate(at)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0, True), (901, math.nan, 1.0, 1.0, 1.0, True), (902, 9000.0, 1.0, 5.0, 1.0, True)], "node long, x double, y double, f double, area double, on boolean")
    made, got = _joined_rows(filter_field(df, Points(period=period), TopHat(), 12.0, "f", strategy=strategy, active="on"))
    want = {}
    for n, x, y, _, _, on in [*rows, (902, 9000.0, 1.0, 5.0, 1.0, True)]:
        top, bottom, here = want.get(n, (0.0, 0.0, False))
        for _, a, b, f, area, live in [*rows, (902, 9000.0, 1.0, 5.0, 1.0, True)]:
            for turn in (-1, 0, 1) if period else (0,):
                if math.sqrt((a + turn * 40.0 - x) ** 2 + (b - y) ** 2) <= 6.0:
                    top += area * f if live and f is not None else 0.0
                    bottom += area if live or strategy == "zerofill" else 0.0
        want[n] = (top, bottom, here or on)
    assert made == 0 and {r.node for r in got} == set(want)
    for r in got:
        top, bottom, here = want[r.node]
        assert r.f == pytest.approx(top / bottom if here and bottom else 0.0)
