"""A report on a setup before any data is touched."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import HighOrder, Kernel, check_scale
from ..operators.filtering import choose_engine
from ..sources.grids import Grid
from ..sources.points import Points

SCHEMA = "grid_kind string, grid_size array<int>, spacing array<double>, scale double, cells_per_scale array<double>, kernel string, mask_strategy string, method string, backend_requested string, backend_resolved string, engine string, resolvable boolean, supports_flux boolean, supports_spectrum boolean, supports_spectral_method boolean, boundary_buffer_cells array<int>, notes array<string>"


def check_setup(spark: SparkSession, space: Grid | Points, kernel: Kernel, scale: float, *, strategy: str = "zerofill", method: str | None = None) -> DataFrame:
    """One row on what a filter of this scale resolves, supports and costs."""
    check_scale(scale)
    notes = []
    grid = isinstance(space, Grid)
    spacing = [a.spacing for a in space.axes] if grid else []
    cells = [scale / h for h in spacing]
    resolvable = all(c > 2 for c in cells)
    if not resolvable:
        notes.append(f"the scale spans {[round(c, 2) for c in cells]} cells; at 2 or fewer the filter does nothing along that axis")
    reach = kernel.radius(scale)
    buffer = [math.ceil(reach / h) if math.isfinite(h) and h > 0 else 0 for h in spacing]
    if buffer:
        notes.append(f"cells within {buffer} of an edge or of inactive cells see a cut footprint; leave them out of means")
    flux = not kernel.negative(scale)
    if not flux:
        notes.append("the kernel takes negative values, so the stress need not be realisable: use TopHat or Gaussian for a flux")
    if not kernel.monotone:
        notes.append("the squared transfer is not monotone, so a spectral density may be negative: use Gaussian, or spectrum='force' or 'none'")
    try:
        kernel.transfer(1 / scale, scale)
        spectral = True
    except ValueError:
        spectral = False
        notes.append("the kernel has no isotropic transfer function, so it has no spectral method")
    if isinstance(kernel, HighOrder) and spacing and kernel.limb * scale < min(spacing):
        notes.append(f"a limb is {kernel.limb * scale / min(spacing):.2f} cells wide; below 1 its moments do not vanish")
    if not grid:
        notes.append(f"a point set has no axes: compare the scale with the usual distance of neighbours yourself (radius {reach:.4g})")
    try:
        engine = choose_engine(space, kernel, scale)
    except ValueError as e:
        engine = "none"
        notes.append(str(e))
    kind = f"{space.geometry} {'grid' if grid else 'points'} of rank {space.rank}"
    row = (kind, list(space.shape) if grid else [], [float(h) for h in spacing], float(scale), cells, repr(kernel), strategy, method or "default", "spark", "spark", engine, resolvable, flux, kernel.monotone, spectral, buffer, notes)
    return spark.createDataFrame([row], SCHEMA)
