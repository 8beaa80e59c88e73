"""Cross-scale diagnostics: each is filtered expressions, their gradients, and column algebra.

Moments are M(a, b) = F(ab) - F(a)F(b). Inactive cells have 0 in every output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import from_planetary, tensor_to_local, to_planetary
from ..functions.kernels import Kernel, gate_spectrum
from ..sources.grids import Grid
from ..sources.points import Points
from .derivatives import derivatives
from .filtering import ZEROFILL, filter_exprs


@dataclass(frozen=True)
class Setting:
    """Where and how to filter. ``edges`` are joined pairs for a point set's filter, ``stencil`` those for its gradient."""

    space: Grid | Points
    kernel: Kernel
    scale: float
    batch: tuple[str, ...] = ()
    strategy: str = ZEROFILL
    active: str | None = None
    engine: str = "auto"
    edges: DataFrame | None = None
    stencil: DataFrame | None = None
    transform: object = None  # a function like filter_exprs, to filter by a transform instead

    @property
    def keys(self) -> list[str]:
        return [*self.batch, *(self.space.dims if isinstance(self.space, Grid) else self.space.keys)]

    @property
    def rank(self) -> int:
        return self.space.rank

    @property
    def spherical(self) -> bool:
        return self.space.spherical

    def filter(self, df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
        if self.transform is not None:
            return self.transform(df, self, exprs)
        return filter_exprs(df, self.space, self.kernel, self.scale, exprs, batch=self.batch, strategy=self.strategy, active=self.active, engine=self.engine, edges=self.edges)

    def place(self, filtered: DataFrame, df: DataFrame) -> DataFrame:
        """A point set's coordinates beside filtered columns; a grid has them by index."""
        if isinstance(self.space, Grid):
            return filtered
        # Filtered at several scales at once, a row has keys that the points don't have.
        keys = [k for k in self.keys if k in df.columns]
        own = df.select(*keys, *self.space.coords, *([self.space.area] if self.space.area else []))
        return filtered.join(own, keys)

    def coord(self, d: int) -> Column:
        return self.space.coord(d) if isinstance(self.space, Grid) else F.col(self.space.coords[d]).cast("double")

    def measure(self) -> Column:
        return self.space.measure()

    def gradient(self, df: DataFrame, columns: Sequence[str], dims: Sequence[int] | None = None) -> DataFrame:
        if isinstance(self.space, Grid):
            return derivatives(df, self.space, columns, dims=dims, batch=self.batch, active=self.active)
        edges = self.stencil if self.stencil is not None else self.edges
        if edges is None:
            raise ValueError("a point set's gradient needs edges: pass stencil, such as those of Points.nearest")
        return self.space.gradient(df, edges, columns, batch=self.batch, active=self.active)

    def on(self, value: Column) -> Column:
        return F.when(F.col(self.active), value).otherwise(0.0) if self.active else value

    def pick(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        return df.select(*self.keys, *([self.active] if self.active else []), *(self.on(v).alias(n) for n, v in columns.items()))


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _local(s: Setting) -> tuple[Column, Column]:
    return s.coord(0), s.coord(1)


def _pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(n), 2))


_LETTERS = "xyz"


def _moments(df: DataFrame, s: Setting, parts: Sequence[Column]) -> DataFrame:
    """b0.. the filtered velocity and t_xx.. the stress, in local axes; an upward part counts as 0 if there is none on a sphere."""
    n = len(parts)
    if not s.spherical:
        exprs = {f"b{a}": parts[a] for a in range(n)} | {f"p{a}{b}": parts[a] * parts[b] for a, b in _pairs(n)}
        f = s.place(s.filter(df, exprs), df)
        return f.withColumns({f"t_{_LETTERS[a]}{_LETTERS[b]}": F.col(f"p{a}{b}") - F.col(f"b{a}") * F.col(f"b{b}") for a, b in _pairs(n)})
    lon, lat = _local(s)
    xyz = to_planetary(parts[0], parts[1], parts[2] if n > 2 else None, lon, lat)
    work = df.withColumns({f"_q{k}": c for k, c in enumerate(xyz)})
    q = [F.col(f"_q{k}") for k in range(3)]
    exprs = {f"q{k}": q[k] for k in range(3)} | {f"p{a}{b}": q[a] * q[b] for a, b in _pairs(3)}
    f = s.place(s.filter(work, exprs), df)
    local = from_planetary(*(F.col(f"q{k}") for k in range(3)), lon, lat)
    stress = {f"{_LETTERS[a]}{_LETTERS[b]}": F.col(f"p{a}{b}") - F.col(f"q{a}") * F.col(f"q{b}") for a, b in _pairs(3)}
    tensor = tensor_to_local(stress, lon, lat)
    names = dict(zip(("ee", "en", "er", "nn", "nr", "rr"), ("xx", "xy", "xz", "yy", "yz", "zz"), strict=True))
    return f.withColumns({f"b{k}": s.on(local[k]) for k in range(3)} | {f"t_{names[k]}": v for k, v in tensor.items()})


def _strain(s: Setting, n: int, name: str = "b") -> dict[str, Column]:
    """The strain of columns name0.. from their gradient columns, with the terms of curved axes."""
    d = lambda k, axis: F.col(f"{name}{k}_{axis}")
    if s.rank == 1:
        return {"xx": d(0, "x")}
    out = {"xx": d(0, "x"), "yy": d(1, "y"), "xy": (d(0, "y") + d(1, "x")) / 2}
    if s.rank == 3:
        out |= {"zz": d(2, "z"), "xz": (d(0, "z") + d(2, "x")) / 2, "yz": (d(1, "z") + d(2, "y")) / 2}
    elif n > 2:
        out |= {"xz": d(2, "x") / 2, "yz": d(2, "y") / 2}
    if s.spherical:
        r = s.coord(2) if s.rank == 3 else F.lit(float(s.space.radius))
        lat = s.coord(1)
        slope = F.when(F.abs(F.cos(lat)) > 1e-12, F.tan(lat)).otherwise(0.0) / r
        u, v = F.col(f"{name}0"), F.col(f"{name}1")
        out["xx"] = out["xx"] - v * slope
        out["xy"] = (d(0, "y") + d(1, "x") + u * slope) / 2
        if s.rank == 3:
            w = F.col(f"{name}2")
            out["xx"], out["yy"] = out["xx"] + w / r, out["yy"] + w / r
            out["xz"] = (d(0, "z") + d(2, "x") - u / r) / 2
            out["yz"] = (d(1, "z") + d(2, "y") - v / r) / 2
    return out


def _contract(strain: Mapping[str, Column], stress) -> Column:
    return -_sum((1 if k[0] == k[1] else 2) * strain[k] * stress(k) for k in strain)


def _velocity(df: DataFrame, s: Setting, u: str, v: str | None, w: str | None) -> list[Column]:
    need = 1 if s.rank == 1 else 3 if s.rank == 3 else 2
    names = [c for c in (u, v, w) if c is not None]
    if len(names) < need or (need == 1 and len(names) > 1):
        raise ValueError(f"{need} velocity components are needed on a grid of rank {s.rank}")
    return [F.col(c) for c in names]


def energy_flux(df: DataFrame, s: Setting, u: str = "u", v: str | None = "v", w: str | None = None) -> DataFrame:
    """pi = -strain : stress, and the filtered velocity ub, vb, wb as given. On one axis pass v=None."""
    parts = _velocity(df, s, u, v, w)
    m = _moments(df, s, parts)
    n = 3 if s.spherical and (s.rank == 3 or w) else len(parts)
    g = s.gradient(m, [f"b{k}" for k in range(n)])
    strain = _strain(s, n)
    out = {"pi": _contract(strain, lambda k: F.col(f"t_{k}"))}
    out |= {name: F.col(f"b{k}") for k, name in enumerate(("ub", "vb", "wb")[: len(parts)])}
    return s.pick(g, out)


def active_area(df: DataFrame, s: Setting) -> float:
    """Measure of the active cells of one slice; an error if there is none."""
    on = F.col(s.active) if s.active else F.lit(True)
    total = df.agg(F.sum(F.when(on, s.measure()))).first()[0]
    if not total:
        raise ValueError("there is no active cell")
    return float(total)


def area_mean(df: DataFrame, s: Setting, columns: Mapping[str, Column], *, by: Sequence[str] = ()) -> DataFrame:
    """Means over active cells weighted by measure, for each slice."""
    on = F.col(s.active) if s.active else F.lit(True)
    a = F.when(on, s.measure())
    return df.groupBy(*by, *s.batch).agg(*((F.sum(a * v) / F.sum(a)).alias(n) for n, v in columns.items()))


def filtered_energy(flux: DataFrame, s: Setting, *, by: Sequence[str] = ()) -> DataFrame:
    """Half the mean square of ub, vb, wb as far as there."""
    square = _sum(F.col(c) * F.col(c) for c in ("ub", "vb", "wb") if c in flux.columns)
    return area_mean(flux, s, {"cumulative_energy": square / 2}, by=by)


def cumulative_energy(df: DataFrame, s: Setting, scales: Sequence[float], u: str = "u", v: str | None = "v", w: str | None = None) -> DataFrame:
    """(scale_idx, scale, cumulative_energy): energy left by the filter of each scale."""
    out = None
    for n, scale in enumerate(scales, 1):
        at = replace(s, scale=scale)
        m = _moments(df, at, _velocity(df, at, u, v, w))
        names = ("ub", "vb", "wb")[: sum(c is not None for c in (u, v, w))]
        e = filtered_energy(at.pick(m, {c: F.col(f"b{k}") for k, c in enumerate(names)}) if isinstance(s.space, Grid) else m.withColumns({c: F.col(f"b{k}") for k, c in enumerate(names)}), at)
        e = e.select(F.lit(n).alias("scale_idx"), F.lit(float(scale)).alias("scale"), *s.batch, "cumulative_energy")
        out = e if out is None else out.unionByName(e)
    return out


def spectral_density(energies: DataFrame, *, length: float = 1.0, batch: Sequence[str] = (), skip: bool = False) -> DataFrame:
    """With wavenumber = length / scale and filtering_spectrum: the secant slope of energy over the neighbours in order of scale_idx; NaN if skipped."""
    by = Window.partitionBy(*batch).orderBy("scale_idx") if batch else Window.partitionBy(F.lit(0)).orderBy("scale_idx")
    with_k = energies.withColumn("wavenumber", F.lit(float(length)) / F.col("scale"))
    near = lambda c, k: F.coalesce(F.lead(c, k).over(by) if k > 0 else F.lag(c, -k).over(by), F.col(c))
    dk = near("wavenumber", 1) - near("wavenumber", -1)
    slope = F.when(dk != 0, (near("cumulative_energy", 1) - near("cumulative_energy", -1)) / dk).otherwise(0.0)
    return with_k.withColumn("filtering_spectrum", F.lit(float("nan")) if skip else slope)


def filtering_spectrum(df: DataFrame, s: Setting, scales: Sequence[float], u: str = "u", v: str | None = "v", w: str | None = None, *, length: float = 1.0, spectrum: str = "strict") -> DataFrame:
    wanted = gate_spectrum(s.kernel, spectrum)
    return spectral_density(cumulative_energy(df, s, scales, u, v, w), length=length, batch=s.batch, skip=not wanted)


def _second(names: Sequence[str]) -> dict[str, tuple[str, str]]:
    return {f"{a}*{b}": (a, b) for a, b in combinations_with_replacement(names, 2)}


def _filter_products(df: DataFrame, s: Setting, names: Sequence[str]) -> tuple[DataFrame, object]:
    """Columns F(name) as f_name, and a function of two names for their moment."""
    products = _second(names)
    f = s.filter(df, {f"f_{n}": F.col(n) for n in names} | {f"ff_{a}_{b}": F.col(a) * F.col(b) for a, b in products.values()})

    def moment(a: str, b: str) -> Column:
        first, second = (a, b) if f"{a}*{b}" in products else (b, a)
        return F.col(f"ff_{first}_{second}") - F.col(f"f_{a}") * F.col(f"f_{b}")

    return s.place(f, df), moment


def stress_decomposition(df: DataFrame, s: Setting, u: str = "u", v: str = "v") -> DataFrame:
    """Leonard, cross and Reynolds parts (l_, c_, r_) and their sum (tau_), of xx, xy, yy; on a sphere of east and north."""
    if s.rank != 2:
        raise ValueError("the decomposition is two-dimensional")
    n = 3 if s.spherical else 2
    if s.spherical:
        lon, lat = _local(s)
        parts = to_planetary(F.col(u), F.col(v), None, lon, lat)
    else:
        parts = (F.col(u), F.col(v))
    work = df.withColumns({f"_q{k}": parts[k] for k in range(n)})
    mean = s.filter(work, {f"m{k}": F.col(f"_q{k}") for k in range(n)})
    both = work.drop(*(c for c in mean.columns if c in work.columns and c not in s.keys)).join(mean, s.keys).withColumns({f"d{k}": F.col(f"_q{k}") - F.col(f"m{k}") for k in range(n)})
    f, moment = _filter_products(both, s, [*(f"m{k}" for k in range(n)), *(f"d{k}" for k in range(n))])
    pieces = {}
    for name, of in (("l", lambda a, b: moment(f"m{a}", f"m{b}")), ("c", lambda a, b: moment(f"m{a}", f"d{b}") + moment(f"d{a}", f"m{b}")), ("r", lambda a, b: moment(f"d{a}", f"d{b}"))):
        t = {f"{_LETTERS[a]}{_LETTERS[b]}": of(a, b) for a, b in _pairs(n)}
        if s.spherical:
            e = tensor_to_local(t, *_local(s))
            t = {"xx": e["ee"], "xy": e["en"], "yy": e["nn"]}
        pieces |= {f"{name}_{k}": t[k] for k in ("xx", "xy", "yy")}
    pieces |= {f"tau_{k}": pieces[f"l_{k}"] + pieces[f"c_{k}"] + pieces[f"r_{k}"] for k in ("xx", "xy", "yy")}
    return s.pick(f, pieces)


def flux_decomposed(df: DataFrame, s: Setting, velocity: Sequence[str], rotational: Sequence[str]) -> DataFrame:
    """rotational, cross, divergent and total flux of a velocity split into a rotational part and the rest; Cartesian, in two or three dimensions."""
    n = len(velocity)
    if s.spherical or n != s.rank or n not in (2, 3) or len(rotational) != n:
        raise ValueError("a Cartesian grid of two or three dimensions and as many components are needed")
    work = df.withColumns({f"r{k}": F.col(c) for k, c in enumerate(rotational)} | {f"d{k}": F.col(c) - F.col(r) for k, (c, r) in enumerate(zip(velocity, rotational, strict=True))})
    f, moment = _filter_products(work, s, [*(f"r{k}" for k in range(n)), *(f"d{k}" for k in range(n))])
    f = f.withColumnsRenamed({f"f_r{k}": f"br{k}" for k in range(n)} | {f"f_d{k}": f"bd{k}" for k in range(n)})
    stress = {}
    for a, b in _pairs(n):
        mean = lambda p, q, a=a, b=b: F.col(f"ff_{min(f'{p}{a}', f'{q}{b}', key=_order)}_{max(f'{p}{a}', f'{q}{b}', key=_order)}") - F.col(f"b{p}{a}") * F.col(f"b{q}{b}")
        k = f"{_LETTERS[a]}{_LETTERS[b]}"
        stress[f"rr_{k}"], stress[f"dd_{k}"], stress[f"x_{k}"] = mean("r", "r"), mean("d", "d"), mean("r", "d") + mean("d", "r")
    g = s.gradient(f.withColumns(stress), [f"b{p}{k}" for p in "rd" for k in range(n)])
    sr, sd = _strain(s, n, "br"), _strain(s, n, "bd")
    t = lambda p: lambda k: F.col(f"{p}_{k}")
    rr, dd = _contract(sr, t("rr")), _contract(sd, t("dd"))
    cross = _contract(sr, t("dd")) + _contract(sd, t("rr")) + _contract(sr, t("x")) + _contract(sd, t("x"))
    return s.pick(g, {"rotational": rr, "cross": cross, "divergent": dd, "total": rr + cross + dd})


def _order(name: str) -> tuple[bool, str]:
    return name[0] != "r", name


def strain_convergence(df: DataFrame, s: Setting, u: str = "u", v: str = "v") -> DataFrame:
    """The flux as strain part less convergence part: pi_strain, pi_convergence, pi, and the filtered divergence and strain rate."""
    if s.spherical or s.rank != 2:
        raise ValueError("strain and convergence are split on a Cartesian plane")
    m = _moments(df, s, [F.col(u), F.col(v)])
    g = s.gradient(m, ["b0", "b1"])
    c = F.col
    normal, shear, div = c("b0_x") - c("b1_y"), c("b0_y") + c("b1_x"), c("b0_x") + c("b1_y")
    strain = (c("t_yy") - c("t_xx")) * normal / 2 - c("t_xy") * shear
    convergence = (c("t_yy") + c("t_xx")) * div / 2
    return s.pick(g, {"pi_strain": strain, "pi_convergence": convergence, "pi": strain - convergence, "divergence": div, "strain_rate": F.sqrt(normal * normal + shear * shear)})


def tracer_flux(df: DataFrame, s: Setting, tracer: str, u: str = "u", v: str = "v", w: str | None = None, name: str = "pi_tracer") -> DataFrame:
    """-Σ (F(u_j θ) - ū_j θ̄) ∂_j θ̄; on a sphere of two dimensions the upward part is left out."""
    parts = _velocity(df, s, u, v, w if s.rank == 3 else None)
    th = F.col(tracer)
    if s.spherical:
        lon, lat = _local(s)
        work = df.withColumns({f"_q{k}": c for k, c in enumerate(to_planetary(parts[0], parts[1], parts[2] if s.rank == 3 else None, lon, lat))})
        q = [F.col(f"_q{k}") for k in range(3)]
    else:
        work, q = df, parts
    f = s.place(s.filter(work, {"tb": th} | {f"b{k}": c for k, c in enumerate(q)} | {f"p{k}": c * th for k, c in enumerate(q)}), df)
    flux = [F.col(f"p{k}") - F.col(f"b{k}") * F.col("tb") for k in range(len(q))]
    if s.spherical:
        flux = list(from_planetary(*flux, *_local(s)))[: s.rank]
    f = f.withColumns({f"_j{k}": c for k, c in enumerate(flux)})
    g = s.gradient(f, ["tb"])
    return s.pick(g, {name: -_sum(F.col(f"_j{k}") * F.col(f"tb_{_LETTERS[k]}") for k in range(s.rank))})


def vorticity(df: DataFrame, s: Setting, u: str = "u", v: str = "v", name: str = "vorticity") -> DataFrame:
    """``df`` with ∂v/∂x - ∂u/∂y."""
    g = s.gradient(df, [u, v])
    return g.withColumn(name, s.on(F.col(f"{v}_x") - F.col(f"{u}_y"))).select(*df.columns, name)


def enstrophy_flux(df: DataFrame, s: Setting, u: str = "u", v: str = "v") -> DataFrame:
    """The tracer flux of vorticity."""
    return tracer_flux(vorticity(df, s, u, v, "_vorticity"), s, "_vorticity", u, v, name="enstrophy_flux")


def favre_filter(df: DataFrame, s: Setting, density: str, columns: Sequence[str]) -> DataFrame:
    """F(ρf) / F(ρ) of each column."""
    f = s.filter(df, {"_rho": F.col(density)} | {c: F.col(density) * F.col(c) for c in columns})
    return s.pick(f, {c: F.when(F.col("_rho") != 0, F.col(c) / F.col("_rho")).otherwise(0.0) for c in columns})


def compressible_flux(df: DataFrame, s: Setting, density: str = "rho", pressure: str = "p", u: str = "u", v: str = "v") -> DataFrame:
    """pi, baropycnal work, pressure dilatation, and the filtered density, pressure and Favre velocity; a Cartesian plane.

    An active density that isn't positive fails the query.
    """
    if s.spherical or s.rank != 2:
        raise ValueError("the budget is for a Cartesian plane")
    rho, p, a, b = F.col(density), F.col(pressure), F.col(u), F.col(v)
    rho = F.when(rho > 0, rho).otherwise(F.raise_error(F.lit("the density must be positive")).cast("double"))
    work = df.withColumn("_rho", F.when(F.col(s.active), rho).otherwise(0.0) if s.active else rho)
    rho = F.col("_rho")
    f = s.filter(work, {"rho_b": rho, "p_b": p, "ru": rho * a, "rv": rho * b, "b0": a, "b1": b, "ruu": rho * a * a, "ruv": rho * a * b, "rvv": rho * b * b})
    c = F.col
    over = lambda x: F.when(c("rho_b") != 0, x / c("rho_b")).otherwise(0.0)
    f = s.place(f, df).withColumns({"ut": over(c("ru")), "vt": over(c("rv"))})
    g = s.gradient(f, ["ut", "vt", "p_b", "b0", "b1"])
    txx, txy, tyy = over(c("ruu")) - c("ut") * c("ut"), over(c("ruv")) - c("ut") * c("vt"), over(c("rvv")) - c("vt") * c("vt")
    mx, my = c("ru") - c("rho_b") * c("b0"), c("rv") - c("rho_b") * c("b1")
    pi = -c("rho_b") * (c("ut_x") * txx + (c("ut_y") + c("vt_x")) * txy + c("vt_y") * tyy)
    return s.pick(g, {"pi": pi, "baropycnal": over(c("p_b_x") * mx + c("p_b_y") * my), "pressure_dilatation": c("p_b") * (c("b0_x") + c("b1_y")), "density": c("rho_b"), "pressure": c("p_b"), "u_favre": c("ut"), "v_favre": c("vt")})


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint where the cluster has a folder for it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def band_maps(df: DataFrame, s: Setting, scales: Sequence[float], columns: Sequence[str] = ("u", "v")) -> DataFrame:
    """band_1.. the energy that each filter of rising scale takes from what the one before left, and resolved, by cell."""
    scales = list(scales)
    if not scales or sorted(scales) != scales:
        raise ValueError("scales must be given, from fine to coarse")
    work = df.select(*s.keys, *([s.active] if s.active else []), *([] if isinstance(s.space, Grid) else [*s.space.coords, *([s.space.area] if s.space.area else [])]), *(F.col(c).alias(f"_f{k}") for k, c in enumerate(columns)))
    kept: list[str] = []
    for n, scale in enumerate(scales, 1):
        at = replace(s, scale=scale)
        f = at.filter(work, {f"_n{k}": F.col(f"_f{k}") for k in range(len(columns))} | {f"_s{k}": F.col(f"_f{k}") * F.col(f"_f{k}") for k in range(len(columns))})
        band = _sum(F.col(f"_s{k}") - F.col(f"_n{k}") * F.col(f"_n{k}") for k in range(len(columns))) / 2
        rest = work.select(*s.keys, *(c for c in work.columns if c not in s.keys and not c.startswith("_f") and c != s.active))
        work = _cut(f.withColumn(f"band_{n}", at.on(band)).select(*s.keys, *([s.active] if s.active else []), f"band_{n}", *(F.col(f"_n{k}").alias(f"_f{k}") for k in range(len(columns)))).join(rest, s.keys))
        kept.append(f"band_{n}")
    resolved = _sum(F.col(f"_f{k}") * F.col(f"_f{k}") for k in range(len(columns))) / 2
    return work.withColumn("resolved", s.on(resolved)).drop(*(f"_f{k}" for k in range(len(columns))))


def band_energies(df: DataFrame, s: Setting, scales: Sequence[float], columns: Sequence[str] = ("u", "v")) -> DataFrame:
    """Means of ``band_maps`` for each slice: band_1.., resolved and total."""
    maps = band_maps(df, s, scales, columns)
    names = [f"band_{n}" for n in range(1, len(list(scales)) + 1)]
    means = area_mean(maps, s, {n: F.col(n) for n in [*names, "resolved"]})
    return means.withColumn("total", _sum(F.col(n) for n in [*names, "resolved"]))


def conditional_mean(flux: DataFrame, s: Setting, value: str, by: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, mean) of a column over equal bins of another, as flux binned by divergence or strain rate."""
    on = F.col(s.active) if s.active else F.lit(True)
    return flux.filter(on).groupBy(F.width_bucket(F.col(by), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


