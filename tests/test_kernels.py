import math

import pytest

from scalewright import Gaussian, HighOrder, HyperGaussian, SharpSpectral, SmoothHat, TopHat
from scalewright.functions.kernels import bessel_j1, check_scale, gate_spectrum


def test_weights_and_radii():
    assert TopHat().weight(3.0, 6.0) == 1 and TopHat().weight(3.0001, 6.0) == 0 and TopHat().radius(6) == 3
    assert Gaussian().weight(2.0, 4.0) == pytest.approx(math.exp(-1.5))
    for k in (Gaussian(), HyperGaussian()):
        assert k.weight(k.radius(7.0), 7.0) == pytest.approx(1e-10)
    assert SmoothHat().weight(2.0, 4.0) == 0.5 and SmoothHat().radius(1.0) == pytest.approx(0.5 * (1 + math.atanh(1 - 2e-10) / 10))
    assert SharpSpectral().weight(0.0, 2.0) == 1 and abs(SharpSpectral().weight(2.0, 2.0)) < 1e-15


def test_second_moments():
    n, scale = 4000, 2.0
    for kernel, want in ((TopHat(), scale**2 / 16), (Gaussian(), scale**2 / 12)):  # mean square along one axis of the plane
        r = kernel.radius(scale)
        d = [(i + 0.5) * r / n for i in range(n)]
        w = [kernel.weight(x, scale) * x for x in d]
        assert sum(a * x * x for a, x in zip(w, d, strict=True)) / sum(w) / 2 == pytest.approx(want, rel=1e-3)


def test_high_order_amplitudes_and_moments():
    assert HighOrder(3).amplitudes == pytest.approx((-64 / 61,))
    assert HighOrder(5).amplitudes == pytest.approx((-568 / 257, 200 / 257))
    for order in (3, 5):
        k = HighOrder(order)
        r, n = k.radius(1.0), 22000
        x = [(i + 0.5) * r / n for i in range(n)]
        for power in range(2, order + 1, 2):
            assert abs(sum(k.profile(a, 1.0) * a**power for a in x) * r / n) < 1e-4
        assert k.cell_average(0.0, 2 * r, 1.0) * 2 * r == pytest.approx(2 * k.integral(r, 1.0))
        with pytest.raises(ValueError, match="product"):
            k.weight(0.1, 1.0)
    for bad in ({"order": 4}, {"limb": 0.0}):
        with pytest.raises(ValueError):
            HighOrder(**bad)


def test_transfer():
    assert bessel_j1(3.8317059702075125) == pytest.approx(0, abs=1e-12) and bessel_j1(1.0) == pytest.approx(0.4400505857449335)
    assert TopHat().transfer(2 * 3.8317059702075125, 1.0) == pytest.approx(0, abs=1e-12)
    assert Gaussian().transfer(3.0, 2.0) == pytest.approx(math.exp(-36 / 24)) and SharpSpectral().transfer(math.pi, 1.0) == 1 and SharpSpectral().transfer(3.15, 1.0) == 0
    assert TopHat().transfer_degree(0, 1.0, 1.0) == 1 and TopHat().transfer_degree(3, 1e-3, 1.0) == pytest.approx(1, abs=1e-5)
    x = 1 - 2 * math.sin(0.25) ** 2
    assert TopHat().transfer_degree(2, 1.0, 1.0) == pytest.approx((1 + x) * 3 * x / 6)
    with pytest.raises(ValueError, match="transfer"):
        SmoothHat().transfer(1.0, 1.0)


def test_gates():
    assert gate_spectrum(Gaussian(), "strict") and not gate_spectrum(TopHat(), "none")
    with pytest.raises(ValueError, match="monotone"):
        gate_spectrum(TopHat(), "strict")
    with pytest.warns(UserWarning, match="monotone"):
        assert gate_spectrum(TopHat(), "force")
    for bad in (0, -1, math.inf, math.nan):
        with pytest.raises(ValueError):
            check_scale(bad)
    assert HighOrder().negative(1.0) and not Gaussian().negative(1.0) and SharpSpectral().negative(1.0)
