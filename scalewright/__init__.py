"""Scale-dependent analysis of gridded and scattered fields on Spark DataFrames."""

from .functions.kernels import Gaussian, HighOrder, HyperGaussian, SharpSpectral, SmoothHat, TopHat
from .operators.diagnostics import Setting
from .operators.filtering import DEFORMABLE, ZEROFILL, choose_engine, filter_exprs, filter_field, filter_slices
from .plans.setup_report import check_setup
from .plans.sweep import Result, coarse_grain, coarse_grain_profile, coarse_grain_slices
from .sources import Axis, Grid, Points

__version__ = "0.1.0"
__all__ = ["DEFORMABLE", "ZEROFILL", "Axis", "Gaussian", "Grid", "HighOrder", "HyperGaussian", "Points", "Result", "Setting", "SharpSpectral", "SmoothHat", "TopHat", "check_setup", "choose_engine", "coarse_grain", "coarse_grain_profile", "coarse_grain_slices", "filter_exprs", "filter_field", "filter_slices"]
