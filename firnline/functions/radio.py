"""Radiometric arithmetic on trace columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Speed of light, relative permittivity and refractive index of ice, altitude regime limit.
LIGHT_M_S = 299_792_458.0
ICE_PERMITTIVITY = 3.17
ICE_INDEX = 1.78
HIGH_ALTITUDE_M = 3000.0


def detection_ceiling(surface_power: Column, twtt: Column, noise: Column, thickness: Column,
                      permittivity: float = ICE_PERMITTIVITY) -> Column:
    """Required SNR a trace would have if its bed peak equalled the noise floor."""
    r = F.lit(LIGHT_M_S / 2) * twtt
    bed = r + thickness / F.lit(math.sqrt(permittivity))
    return surface_power - noise + 20 * F.log10(r / bed)


def noise_reference(interp: Column, post_bed: Column) -> Column:
    return F.coalesce(interp, post_bed)


def heights() -> dict[str, Column]:
    """Ranges to the surface and the bed (straight and refracted), and the altitude regime."""
    h = F.col("elevation") - F.col("surface_elevation")
    return {
        "r_surf": h,
        "r_bed_geom": F.col("elevation") - F.col("bed_elevation"),
        "r_bed_refr": h + (F.col("surface_elevation") - F.col("bed_elevation")) / F.lit(ICE_INDEX),
        "regime": F.when(h >= HIGH_ALTITUDE_M, "high").otherwise("low"),
    }


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def speed_error(vx: Column, vy: Column, ex: Column, ey: Column) -> Column:
    """Component errors carried through the magnitude; at rest (or unknown speed) the plain norm."""
    moving = F.sqrt((vx * ex) * (vx * ex) + (vy * ey) * (vy * ey)) / speed(vx, vy)
    return F.when(speed(vx, vy) > 0, moving).otherwise(F.sqrt(ex * ex + ey * ey))


def pair_exponent(p1: Column, r1: Column, p2: Column, r2: Column) -> Column:
    # A pair at one range has no exponent; the optimizer may look at such pairs before a gap filter.
    return F.try_divide(p1 - p2, 10 * F.log10(F.try_divide(r2, r1)))


def clip_level(vpp: Column, gain_dB: Column) -> Column:
    return 20 * F.log10(F.coalesce(vpp, F.lit(2.0)) / 2) - gain_dB


def clip_confidence(level: Column, headroom: Column, n: Column) -> Column:
    return (
        F.when(level.isNull(), "unknown")
        .when(headroom.isNull() | (n < 100), "no-data")
        .when(headroom < 3, "validated-at-ceiling")
        .when(headroom < 6, "near-ceiling")
        .otherwise("inactive-bound")
    )


def spreading_difference(altitude: Column, thickness: Column, permittivity: float = ICE_PERMITTIVITY) -> Column:
    """Surface minus bed geometric spreading, 10 log10 of squared range ratio."""
    far = altitude + thickness / F.lit(math.sqrt(permittivity))
    return 10 * F.log10((far * far) / (altitude * altitude))
