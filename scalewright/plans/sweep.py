"""Sweeps: flux maps and spectra over scales, slices, levels and ragged grids."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import STRICT, Kernel, TopHat, check_scale, gate_spectrum
from ..operators.diagnostics import Setting, energy_flux, filtered_energy, spectral_density
from ..operators.filtering import ZEROFILL
from ..operators.spectral import analyze_sweep, spectral_exact
from ..sources.grids import Grid
from ..sources.points import Points


REAL, SPECTRAL, AUTO = "real", "spectral", "auto"


@dataclass(frozen=True)
class Result:
    """flux: keys, scale_idx, scale, pi and the filtered velocity; spectrum: a row for each slice and scale."""

    flux: DataFrame
    spectrum: DataFrame

    def slice(self, **batch) -> Result:
        keep = lambda df: df.filter(" AND ".join(f"`{k}` = {v!r}" for k, v in batch.items()))
        return Result(keep(self.flux), keep(self.spectrum))


def coarse_grain(df: DataFrame, space: Grid | Points, scales: Sequence[float], u: str = "u", v: str | None = "v", w: str | None = None, *, kernel: Kernel | None = None, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None, engine: str = "auto", length: float = 1.0, spectrum: str = STRICT, edges: Mapping[float, DataFrame] | None = None, stencil: DataFrame | None = None, transform=None, rho0: float = 1.0, check: bool = False, method: str = REAL) -> Result:
    """Flux of every cell and energy of every slice, at each scale, in the order of ``scales``.

    ``batch`` columns are independent slices on the same grid: times, levels, members.
    ``method`` is REAL, SPECTRAL (all scales from one forward transform of each slice), or
    AUTO, which takes the transform where it gives the same operator.
    """
    kernel = kernel or TopHat()
    if not len(scales):
        raise ValueError("scales must be given")
    for scale in scales:
        check_scale(scale)
    wanted = gate_spectrum(kernel, spectrum)
    if check and isinstance(space, Grid):
        space.check(df, batch=batch)
    if method not in (REAL, SPECTRAL, AUTO):
        raise ValueError(f"unknown method {method}")
    flux = None
    base = Setting(space, kernel, float(scales[0]), tuple(batch), strategy, active, engine, None, stencil, transform)
    whole = method == SPECTRAL or (method == AUTO and transform is None and spectral_exact(space, kernel))
    if whole:
        flux = analyze_sweep(df, base, [float(x) for x in scales], u, v, w)
        flux = base.place(flux, df)
    for n, scale in enumerate([] if whole else scales, 1):
        s = replace(base, scale=float(scale), edges=(edges or {}).get(scale))
        one = energy_flux(df, s, u, v, w).withColumns({"scale_idx": F.lit(n), "scale": F.lit(float(scale))})
        if isinstance(space, Points):
            one = s.place(one, df)
        flux = one if flux is None else flux.unionByName(one)
    if rho0 != 1.0:
        flux = flux.withColumn("pi", F.col("pi") * rho0)
    energy = filtered_energy(flux, base, by=["scale_idx", "scale"])
    return Result(flux, spectral_density(energy, length=length, batch=batch, skip=not wanted))


def coarse_grain_profile(df: DataFrame, grid: Grid, scales: Sequence[float], *args, level: str = "level", **kw) -> Result:
    """A stack of levels, each filtered along the plane."""
    return coarse_grain(df, grid, scales, *args, batch=[level, *kw.pop("batch", ())], **kw)


def coarse_grain_slices(df: DataFrame, slice_key: str, spaces: Mapping[object, Grid], scales: Sequence[float], *args, **kw) -> Result:
    """Slices with grids of their own; those of equal grids share a plan, the largest work first."""
    groups: dict[Grid, list[object]] = {}
    for key, grid in spaces.items():
        groups.setdefault(grid, []).append(key)
    if not groups:
        raise ValueError("there are no slices")
    cost = lambda g: -len(g[1]) * len(scales) * max(1, math.prod(g[0].shape))
    parts = [coarse_grain(df.filter(F.col(slice_key).isin(keys)), grid, scales, *args, batch=[slice_key], **kw) for grid, keys in sorted(groups.items(), key=cost)]
    flux, spectrum = parts[0].flux, parts[0].spectrum
    for p in parts[1:]:
        flux, spectrum = flux.unionByName(p.flux), spectrum.unionByName(p.spectrum)
    return Result(flux, spectrum)


def map_data(result: Result, scale_idx: int, grid: Grid) -> DataFrame:
    """x, y, pi of one scale, and clim, the symmetric limit of its colours."""
    flux = result.flux.filter(F.col("scale_idx") == scale_idx)
    if flux.isEmpty():
        raise ValueError(f"there is no scale {scale_idx}")
    limit = flux.agg(F.max(F.abs("pi")).alias("clim"))
    return flux.select(grid.coord(0).alias("x"), grid.coord(1).alias("y"), "pi").crossJoin(F.broadcast(limit))


def spectrum_data(result: Result, which: str = "density") -> DataFrame:
    """(x, y): wavenumber against density or cumulative energy."""
    columns = {"density": "filtering_spectrum", "cumulative": "cumulative_energy"}
    if which not in columns:
        raise ValueError("which must be density or cumulative")
    return result.spectrum.select(F.col("wavenumber").alias("x"), F.col(columns[which]).alias("y"))
