"""Filters by transforms: a slice is gathered into an array and goes through NumPy once for all scales."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import Kernel, check_scale
from ..sources.grids import Grid
from ..sources.points import Points
from .filtering import DEFORMABLE, ZEROFILL

#: Smallest share of active weight by which a deformable filter still divides.
FLOOR = 0.01
#: Cells of a slice that one task takes at most.
MAX_SLICE = 1 << 24


def spectral_exact(space: Grid | Points, kernel: Kernel) -> bool:
    """Whether the transform gives the same operator: a uniform Cartesian grid, periodic along all axes, and a kernel with a transfer function."""
    if not isinstance(space, Grid) or space.spherical or not space.uniform or any(a.period is None for a in space.axes):
        return False
    try:
        kernel.transfer(1.0, 1.0)
    except ValueError:
        return False
    return True


def _slices(df: DataFrame, keys: Sequence[str], names: Sequence[str], batch: Sequence[str], exprs: Mapping[str, Column], active: str | None, work, scales: Sequence[float], carry: Mapping[str, Column] | None = None) -> DataFrame:
    on = F.col(active) if active else F.lit(True)
    cells = df.select(*batch, *keys, *([] if batch else [F.lit(1).alias("_all")]), on.alias("_m"), *(c.cast("double").alias(n) for n, c in (carry or {}).items()), *(F.when(on, e).otherwise(0.0).cast("double").alias(f"_e{n}") for n, e in enumerate(exprs.values())))
    kinds = {f.name: f.dataType for f in cells.schema}
    fields = [T.StructField(c, kinds[c]) for c in [*batch, *keys]] + ([T.StructField(active, T.BooleanType())] if active else [])
    fields += [T.StructField("scale_idx", T.IntegerType()), T.StructField("scale", T.DoubleType())] + [T.StructField(n, T.DoubleType()) for n in names]
    columns = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(reversed(keys))).reset_index(drop=True)
        if len(pdf) > MAX_SLICE:
            raise ValueError(f"a slice of {len(pdf)} cells is too large for one task: filter it in real space")
        parts = []
        for n, (scale, values) in enumerate(work(pdf), 1):
            part = pdf[[*batch, *keys]].copy()
            if active:
                part[active] = pdf["_m"]
            part["scale_idx"], part["scale"] = n, float(scale)
            for name, v in zip(names, values, strict=True):
                part[name] = np.where(pdf["_m"], v, 0.0)
            parts.append(part)
        return pd.concat(parts)[columns]

    return cells.groupBy(*(batch or ["_all"])).applyInPandas(run, T.StructType(fields))


def fft_filter(df: DataFrame, grid: Grid, kernel: Kernel, scales: Sequence[float], exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None) -> DataFrame:
    """Filtered expressions at each scale on a grid that is periodic along all axes: one forward transform, one inverse for each scale."""
    if grid.spherical or not grid.uniform or any(a.period is None for a in grid.axes):
        raise ValueError("the transform needs a uniform Cartesian grid that is periodic along all axes")
    scales = [check_scale(s) for s in scales]
    shape = tuple(reversed(grid.shape))
    waves = [2 * np.pi * np.fft.fftfreq(a.n, a.period / a.n) for a in reversed(grid.axes)]
    size = np.sqrt(sum(w**2 for w in np.meshgrid(*waves, indexing="ij")))
    levels, place = np.unique(size, return_inverse=True)
    factors = [np.array([kernel.transfer(float(k), s) for k in levels])[place].reshape(shape) for s in scales]
    count = len(exprs)

    def work(pdf):
        if len(pdf) != math.prod(shape):
            raise ValueError(f"a slice has {len(pdf)} of {math.prod(shape)} cells")
        spectra = [np.fft.fftn(pdf[f"_e{n}"].to_numpy().reshape(shape)) for n in range(count)]
        mask = np.fft.fftn(pdf["_m"].to_numpy(float).reshape(shape)) if strategy == DEFORMABLE and not pdf["_m"].all() else None
        for s, g in zip(scales, factors, strict=True):
            values = [np.fft.ifftn(x * g).real.ravel() for x in spectra]
            yield s, _renormalised(values, None if mask is None else np.fft.ifftn(mask * g).real.ravel())

    return _slices(df, grid.dims, list(exprs), batch, exprs, active, work, scales)


def padded_fft_filter(df: DataFrame, grid: Grid, kernel: Kernel, scales: Sequence[float], exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None) -> DataFrame:
    """The footprint's weighted mean by convolution: bounded axes are padded with zeros, periodic ones wrap."""
    from .filtering import footprint

    if grid.spherical or not grid.uniform:
        raise ValueError("padding serves uniform Cartesian grids")
    scales = [check_scale(s) for s in scales]
    shape = tuple(reversed(grid.shape))
    count = len(exprs)

    def work(pdf):
        if len(pdf) != math.prod(shape):
            raise ValueError(f"a slice has {len(pdf)} of {math.prod(shape)} cells")
        mask = pdf["_m"].to_numpy(float).reshape(shape)
        for s in scales:
            fp = footprint(grid, kernel, s)
            reach = [max((abs(o[d]) for o, _ in fp), default=0) for d in range(grid.rank)]
            full = tuple(n + (0 if a.period is not None else r) for n, a, r in zip(shape, reversed(grid.axes), reversed(reach), strict=True))
            weights = np.zeros(full)
            for off, w in fp:
                weights[tuple(o % n for o, n in zip(reversed(off), full, strict=True))] += w
            g = np.fft.rfftn(weights)
            cut = tuple(slice(0, n) for n in shape)
            mean = lambda x: np.fft.irfftn(np.fft.rfftn(x, full) * g, full)[cut].ravel()
            den = mean(mask if strategy == DEFORMABLE else np.ones(shape))
            sound = np.abs(den) > 1e-12 * np.abs(den).max(initial=0.0)
            yield s, [np.where(sound, mean(pdf[f"_e{n}"].to_numpy().reshape(shape)) / np.where(sound, den, 1.0), 0.0) for n in range(count)]

    return _slices(df, grid.dims, list(exprs), batch, exprs, active, work, scales)


def _modes(n: int, extent: tuple[float, float]) -> tuple[int, int]:
    """Even mode counts for n points, shared by the extents of the axes."""
    wide = max(2, round(math.sqrt(n * extent[0] / extent[1]) if extent[1] > 0 else n))
    wide += wide % 2
    high = max(2, round(n / wide))
    return wide, high + high % 2


def node_transform_filter(df: DataFrame, points: Points, kernel: Kernel, scales: Sequence[float], exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None, modes: tuple[int, int] | None = None, lengths: tuple[float, float] | None = None) -> DataFrame:
    """Nodes of a plane by a direct Fourier sum with about as many modes as nodes.

    It equals the grid transform on a lattice; nodes should be spread evenly. Without
    ``lengths`` a side is its extent and one more spacing.
    """
    if points.spherical or points.rank != 2:
        raise ValueError("this transform is for points of a plane; see sphere_node_filter")
    scales = [check_scale(s) for s in scales]
    count = len(exprs)

    def work(pdf):
        at = [pdf["_p0"].to_numpy(), pdf["_p1"].to_numpy()]
        extent = [float(np.ptp(a)) for a in at]
        m = modes or _modes(len(pdf), (extent[0], extent[1]))
        sides = lengths or tuple(e + e / max(k - 1, 1) for e, k in zip(extent, m, strict=True))
        k = [2 * np.pi * np.arange(-(c // 2), c - c // 2) / side for c, side in zip(m, sides, strict=True)]
        wave = [np.exp(1j * np.outer(kk, a - a.min())) for kk, a in zip(k, at, strict=True)]
        size = np.hypot(k[0][:, None], k[1][None, :])
        spectrum = lambda f: (wave[0].conj() * f) @ wave[1].conj().T
        back = lambda c: np.einsum("mn,mn->n", wave[0], c @ wave[1]).real / len(pdf)
        spectra = [spectrum(pdf[f"_e{n}"].to_numpy()) for n in range(count)]
        mask = spectrum(pdf["_m"].to_numpy(float)) if strategy == DEFORMABLE and not pdf["_m"].all() else None
        for s in scales:
            g = np.vectorize(lambda x, s=s: kernel.transfer(float(x), s))(size)
            yield s, _renormalised([back(c * g) for c in spectra], None if mask is None else back(mask * g))

    return _slices(df, points.keys, list(exprs), batch, exprs, active, work, scales, {f"_p{d}": F.col(c) for d, c in enumerate(points.coords)})


def _renormalised(values: list[np.ndarray], den: np.ndarray | None) -> list[np.ndarray]:
    if den is None:
        return values
    sound = np.abs(den) >= FLOOR
    return [np.where(sound, v / np.where(sound, den, 1.0), 0.0) for v in values]


def legendre(top: int, x: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions [degree, order, x], so that with cos and sin of longitude they are orthonormal on the sphere."""
    p = np.zeros((top + 1, top + 1, len(x)))
    p[0, 0] = math.sqrt(1 / (4 * math.pi))
    root = np.sqrt(np.maximum(1 - x * x, 0.0))
    for m in range(1, top + 1):
        p[m, m] = math.sqrt((2 * m + 1) / (2 * m)) * root * p[m - 1, m - 1]
    for m in range(top):
        p[m + 1, m] = math.sqrt(2 * m + 3) * x * p[m, m]
        for n in range(m + 2, top + 1):
            a = math.sqrt((4 * n * n - 1) / (n * n - m * m))
            b = math.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
            p[n, m] = a * (x * p[n - 1, m] - b * p[n - 2, m])
    return p


def sphere_grid_filter(df: DataFrame, grid: Grid, kernel: Kernel, scales: Sequence[float], exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None) -> DataFrame:
    """Spherical harmonics on N latitudes at the middles of equal angles and 2N - 1 longitudes: each degree is multiplied by the kernel's factor."""
    if not grid.spherical or grid.rank != 2:
        raise ValueError("a spherical grid of two dimensions is needed")
    lon, lat = grid.axes
    n, m = lat.n, lon.n
    middles = math.pi / 2 - math.pi * (np.arange(n) + 0.5) / n
    turns = 2 * math.pi * np.arange(m) / m
    rising = lat.coords[-1] > lat.coords[0]
    if m != 2 * n - 1 or not np.allclose(lat.coords, middles[::-1] if rising else middles, atol=1e-9) or not np.allclose(np.array(lon.coords) - lon.coords[0], turns, atol=1e-9):
        raise ValueError("latitudes must be the middles of N equal angles, longitudes 2N - 1 equal turns")
    scales = [check_scale(s) for s in scales]
    count = len(exprs)
    factors = [np.array([kernel.transfer_degree(k, s, grid.radius) for k in range(n)]) for s in scales]

    def work(pdf):
        if len(pdf) != n * m:
            raise ValueError(f"a slice has {len(pdf)} of {n * m} cells")
        p = legendre(n - 1, np.sin(np.array(lat.coords)))
        solve = [np.linalg.pinv(p[k:, k].T) for k in range(n)]

        def forward(f):
            waves = np.fft.rfft(f.reshape(n, m), axis=1)
            return [solve[k] @ waves[:, k] for k in range(n)]

        def backward(c, g):
            waves = np.zeros((n, m // 2 + 1), complex)
            for k in range(n):
                waves[:, k] = p[k:, k].T @ (c[k] * g[k:])
            return np.fft.irfft(waves, m, axis=1).ravel()

        spectra = [forward(pdf[f"_e{k}"].to_numpy()) for k in range(count)]
        mask = forward(pdf["_m"].to_numpy(float)) if strategy == DEFORMABLE and not pdf["_m"].all() else None
        for s, g in zip(scales, factors, strict=True):
            yield s, _renormalised([backward(c, g) for c in spectra], None if mask is None else backward(mask, g))

    return _slices(df, grid.dims, list(exprs), batch, exprs, active, work, scales)


def sphere_node_filter(df: DataFrame, points: Points, kernel: Kernel, scales: Sequence[float], exprs: Mapping[str, Column], *, batch: Sequence[str] = (), strategy: str = ZEROFILL, active: str | None = None) -> DataFrame:
    """Nodes on a sphere by the adjoint of the harmonic sum, up to the degree that the number of nodes bears."""
    if not points.spherical or points.rank != 2:
        raise ValueError("points on a sphere are needed")
    scales = [check_scale(s) for s in scales]
    count = len(exprs)

    def work(pdf):
        n = len(pdf)
        top = next((k for k in range(int(math.sqrt(n)) + 1) if (k + 1) * (2 * k + 1) == n), None)
        top = max(0, int(math.sqrt(n)) - 1) if top is None else top
        p = legendre(top, np.sin(pdf["_p1"].to_numpy()))
        lon = pdf["_p0"].to_numpy()
        basis, degree = [], []
        for k in range(top + 1):
            for m in range(k + 1):
                for wave in (np.cos(m * lon),) if m == 0 else (math.sqrt(2) * np.cos(m * lon), math.sqrt(2) * np.sin(m * lon)):
                    basis.append(p[k, m] * wave)
                    degree.append(k)
        basis, degree = np.array(basis), np.array(degree)
        spectra = [4 * math.pi / n * (basis @ pdf[f"_e{k}"].to_numpy()) for k in range(count)]
        mask = 4 * math.pi / n * (basis @ pdf["_m"].to_numpy(float)) if strategy == DEFORMABLE and not pdf["_m"].all() else None
        for s in scales:
            g = np.array([kernel.transfer_degree(k, s, points.radius) for k in range(top + 1)])[degree]
            yield s, _renormalised([(c * g) @ basis for c in spectra], None if mask is None else (mask * g) @ basis)

    return _slices(df, points.keys, list(exprs), batch, exprs, active, work, scales, {f"_p{d}": F.col(c) for d, c in enumerate(points.coords)})


def transform_setting(run):
    """A transform above in the form that ``Setting.transform`` takes."""

    def one(df: DataFrame, setting, exprs: Mapping[str, Column]) -> DataFrame:
        got = run(df, setting.space, setting.kernel, [setting.scale], exprs, batch=setting.batch, strategy=setting.strategy, active=setting.active)
        return got.drop("scale_idx", "scale")

    return one


def auto_filter(df: DataFrame, space: Grid | Points, kernel: Kernel, scale: float, exprs: Mapping[str, Column], **kw) -> DataFrame:
    """The transform where it gives the same operator, else the filter in real space."""
    from .filtering import filter_exprs

    if spectral_exact(space, kernel):
        return fft_filter(df, space, kernel, [scale], exprs, **kw).drop("scale_idx", "scale")
    return filter_exprs(df, space, kernel, scale, exprs, **kw)


def transform_of(space: Grid | Points):
    """The transform that serves a space: FFT or harmonics on a grid, direct sums on nodes."""
    if isinstance(space, Points):
        return sphere_node_filter if space.spherical else node_transform_filter
    return sphere_grid_filter if space.spherical else fft_filter


def analyze_sweep(df: DataFrame, setting, scales: Sequence[float], u: str = "u", v: str | None = "v", w: str | None = None, *, transform=None) -> DataFrame:
    """``energy_flux`` at all scales, with scale_idx and scale, from one forward transform of each field and product.

    ``transform`` is one of those above; without it the space's own is taken. The scale of
    ``setting`` doesn't matter.
    """
    from .diagnostics import energy_flux

    if not len(scales):
        raise ValueError("scales must be given")
    run = transform or transform_of(setting.space)

    def every(fields: DataFrame, at, exprs: Mapping[str, Column]) -> DataFrame:
        return run(fields, at.space, at.kernel, list(scales), exprs, batch=setting.batch, strategy=at.strategy, active=at.active)

    return energy_flux(df, replace(setting, scale=check_scale(scales[0]), batch=(*setting.batch, "scale_idx", "scale"), transform=every), u, v, w)
