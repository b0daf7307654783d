"""Brightness of model sources at a distance from their centre, as columns; noise of a simulated background."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def disk(r: Column, amp: Column, radius: Column) -> Column:
    return F.when(r <= radius, amp).otherwise(F.lit(0.0))


def ring(r: Column, amp: Column, inner: Column, width: Column) -> Column:
    """Constant from ``inner`` to ``inner`` + ``width``, both included."""
    return F.when((r >= inner) & (r <= inner + width), amp).otherwise(F.lit(0.0))


def bubble(r: Column, amp: Column, inner: Column, width: Column, fill: float) -> Column:
    """A ring around a disk of a share ``fill`` of its brightness."""
    return F.when(r < inner, amp * fill).otherwise(ring(r, amp, inner, width))


def elliptical_disk(x: Column, y: Column, amp: Column, a: Column, b: Column, theta: Column) -> Column:
    """Constant within an ellipse of semi-axes a, b turned by theta (degrees)."""
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return F.when(((x * c + y * s) / a) ** 2 + ((y * c - x * s) / b) ** 2 <= 1, amp).otherwise(F.lit(0.0))


def sersic(r: Column, amp: Column, half_light: Column, index: float) -> Column:
    """Sérsic's law, ``amp`` at the half-light radius; b by its series for an index of half and more."""
    b = 2 * index - 1 / 3 + 4 / (405 * index) + 46 / (25515 * index**2)
    return amp * F.exp(-b * (F.pow(r / half_light, F.lit(1 / index)) - 1))


def noise(mean: float, rms: float, seed: int, *key: Column) -> Column:
    """Gaussian noise that is the same for the same key, whatever the partition (Box and Muller on two hashes)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return mean + rms * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
