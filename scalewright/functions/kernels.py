"""Filter kernels: weights, radii, transfer functions and admissibility. ``scale`` is a full width."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight at which a Gaussian-like tail is cut.
TRUNCATION = 1e-10


def check_scale(scale: float) -> float:
    if not (math.isfinite(scale) and scale > 0):
        raise ValueError(f"a scale must be positive and finite, not {scale}")
    return float(scale)


def bessel_j1(x: float) -> float:
    """J1 by the trapezoidal rule on its integral, which converges spectrally."""
    n = 64 + 2 * math.ceil(abs(x))
    t = (np.arange(n) + 0.5) * math.pi / n
    return float(np.mean(np.cos(t - x * np.sin(t))))


class Kernel:
    """A radial kernel. Weights are not normalised; filters divide by their sum."""

    separable = False
    radial = True
    monotone = False  # whether the squared transfer function falls monotonically

    def weight(self, d: float, scale: float) -> float:
        raise NotImplementedError

    def weight_column(self, d: Column, scale: float) -> Column:
        raise NotImplementedError

    def radius(self, scale: float) -> float:
        raise NotImplementedError

    def transfer(self, k: float, scale: float) -> float:
        raise ValueError(f"{self} has no isotropic transfer function")

    def transfer_degree(self, degree: int, scale: float, sphere: float) -> float:
        """Factor of a spherical harmonic degree on a sphere of this radius."""
        return self.transfer(math.sqrt(degree * (degree + 1)) / sphere, scale)

    def negative(self, scale: float) -> bool:
        r = self.radius(scale)
        return any(self.weight(r * i / 511, scale) < 0 for i in range(512))


@dataclass(frozen=True)
class TopHat(Kernel):
    def weight(self, d, scale):
        return 1.0 if d <= scale / 2 else 0.0

    def weight_column(self, d, scale):
        return F.when(d <= scale / 2, 1.0).otherwise(0.0)

    def radius(self, scale):
        return scale / 2

    def transfer(self, k, scale):
        x = k * scale / 2
        return 1.0 if x == 0 else 2 * bessel_j1(x) / x

    def transfer_degree(self, degree, scale, sphere):
        """A spherical cap of angular diameter scale / sphere."""
        if degree == 0:
            return 1.0
        x = 1 - 2 * math.sin(scale / (4 * sphere)) ** 2
        before, value, slope_before, slope = 1.0, x, 0.0, 1.0
        for n in range(1, degree):
            after = ((2 * n + 1) * x * value - n * before) / (n + 1)
            slope_after = slope_before + (2 * n + 1) * value
            before, value, slope_before, slope = value, after, slope, slope_after
        return (1 + x) * slope / (degree * (degree + 1))


@dataclass(frozen=True)
class Gaussian(Kernel):
    alpha: float = 6.0
    separable = True
    monotone = True

    def weight(self, d, scale):
        return math.exp(-self.alpha * (d / scale) ** 2)

    def weight_column(self, d, scale):
        return F.exp(-self.alpha * (d / scale) * (d / scale))

    def radius(self, scale):
        return scale * math.sqrt(-math.log(TRUNCATION) / self.alpha)

    def transfer(self, k, scale):
        return math.exp(-((k * scale) ** 2) / (4 * self.alpha))

    def profile(self, x, scale):
        return self.weight(abs(x), scale)

    def cell_average(self, x, width, scale):
        return self.profile(x, scale)


@dataclass(frozen=True)
class SharpSpectral(Kernel):
    monotone = True

    def weight(self, d, scale):
        x = math.pi * d / scale
        return 1.0 if x == 0 else math.sin(x) / x

    def weight_column(self, d, scale):
        x = F.lit(math.pi) * d / scale
        return F.when(d == 0, 1.0).otherwise(F.sin(x) / x)

    def radius(self, scale):
        return 10 * scale

    def transfer(self, k, scale):
        return 1.0 if k <= math.pi / scale else 0.0


@dataclass(frozen=True)
class SmoothHat(Kernel):
    steepness: float = 10.0

    def weight(self, d, scale):
        return 0.5 * (1 - math.tanh(self.steepness * (2 * d / scale - 1)))

    def weight_column(self, d, scale):
        return 0.5 * (1 - F.tanh(self.steepness * (2 * d / scale - 1)))

    def radius(self, scale):
        return scale / 2 * (1 + math.atanh(1 - 2 * TRUNCATION) / self.steepness)


@dataclass(frozen=True)
class HyperGaussian(Kernel):
    alpha: float = 1.0

    def weight(self, d, scale):
        return math.exp(-self.alpha * (2 * d / scale) ** 4)

    def weight_column(self, d, scale):
        return F.exp(-self.alpha * F.pow(2 * d / scale, F.lit(4.0)))

    def radius(self, scale):
        return scale / 2 * (-math.log(TRUNCATION) / self.alpha) ** 0.25


@dataclass(frozen=True)
class HighOrder(Kernel):
    """A box with side limbs that make moments vanish; in N dimensions the product of its axes."""

    order: int = 3
    limb: float = 0.125  # width of a limb in units of the scale
    separable = True
    radial = False

    def __post_init__(self):
        if self.order not in (3, 5):
            raise ValueError("the order must be 3 or 5")
        if not (math.isfinite(self.limb) and self.limb > 0):
            raise ValueError("limbs need a positive width")

    @property
    def amplitudes(self) -> tuple[float, ...]:
        b = self.limb
        if self.order == 3:
            return (-1 / ((1 + 2 * b) ** 3 - 1),)
        common = 4 * b * b * (192 * b**4 + 400 * b**3 + 340 * b**2 + 120 * b + 15)
        return (-(124 * b**3 + 88 * b**2 + 19 * b + 1) / common, (4 * b**3 + 8 * b**2 + 5 * b + 1) / common)

    def weight(self, d, scale):
        raise ValueError("this kernel is a product over axes and has no weight of a distance")

    weight_column = weight

    def radius(self, scale):
        return scale / 2 + len(self.amplitudes) * self.limb * scale

    def profile(self, x, scale):
        over = abs(x) - scale / 2
        if over < 0:
            return 1.0
        at = int(over // (self.limb * scale))
        return self.amplitudes[at] if at < len(self.amplitudes) else 0.0

    def integral(self, x, scale):
        """Of the profile from 0 to x; odd."""
        rest, total = abs(x), 0.0
        for height, width in [(1.0, scale / 2), *((a, self.limb * scale) for a in self.amplitudes)]:
            step = min(rest, width)
            total += height * step
            rest -= step
        return math.copysign(total, x)

    def cell_average(self, x, width, scale):
        return (self.integral(x + width / 2, scale) - self.integral(x - width / 2, scale)) / width

    def negative(self, scale):
        return min(self.amplitudes) < 0


#: What to do about a spectrum whose density need not be positive.
STRICT, FORCE, NONE = "strict", "force", "none"


def gate_spectrum(kernel: Kernel, policy: str) -> bool:
    """Whether to compute a spectrum; strict policy fails for a kernel whose transfer isn't monotone."""
    import warnings

    if policy == NONE:
        return False
    if policy not in (STRICT, FORCE):
        raise ValueError(f"unknown spectrum policy {policy}")
    if not kernel.monotone:
        if policy == STRICT:
            raise ValueError(f"the squared transfer of {kernel} is not monotone: use Gaussian(), or spectrum='force' or 'none'")
        warnings.warn(f"the squared transfer of {kernel} is not monotone; its density may be negative", stacklevel=3)
    return True
