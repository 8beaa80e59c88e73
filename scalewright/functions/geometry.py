"""Distances and rotations as Column expressions; angles in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid(*differences: Column) -> Column:
    total = differences[0] * differences[0]
    for d in differences[1:]:
        total = total + d * d
    return F.sqrt(total)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    a, b = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + F.cos(lat1) * F.cos(lat2) * b * b)))


def position(lon: Column, lat: Column, r: Column | float) -> tuple[Column, Column, Column]:
    r = r if isinstance(r, Column) else F.lit(float(r))
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def _frame(lon: Column, lat: Column) -> tuple[tuple[Column, ...], ...]:
    """East, north and up as planetary vectors."""
    zero = F.lit(0.0)
    return ((-F.sin(lon), F.cos(lon), zero), (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)), (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)))


def to_planetary(u: Column, v: Column, w: Column | None, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """East, north and up components as planetary X, Y, Z."""
    e, n, r = _frame(lon, lat)
    return tuple(u * e[k] + v * n[k] + (w * r[k] if w is not None else F.lit(0.0)) for k in range(3))


def from_planetary(x: Column, y: Column, z: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Planetary X, Y, Z as east, north and up components."""
    return tuple(x * a[0] + y * a[1] + z * a[2] for a in _frame(lon, lat))


def tensor_to_local(t: dict[str, Column], lon: Column, lat: Column) -> dict[str, Column]:
    """A symmetric planetary tensor (xx, xy, xz, yy, yz, zz) in the local frame (ee, en, er, nn, nr, rr)."""
    m = ((t["xx"], t["xy"], t["xz"]), (t["xy"], t["yy"], t["yz"]), (t["xz"], t["yz"], t["zz"]))
    frame = dict(zip("enr", _frame(lon, lat), strict=True))

    def component(a, b):
        total = F.lit(0.0)
        for i in range(3):
            for j in range(3):
                total = total + frame[a][i] * m[i][j] * frame[b][j]
        return total

    return {a + b: component(a, b) for a, b in ("ee", "en", "er", "nn", "nr", "rr")}
