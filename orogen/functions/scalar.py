"""Column functions of geostatistics, hydraulics and structural geology."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number from text with a comma or point and inner spaces; null where there is none or it isn't finite."""
    value = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"\s", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rotated(dx: Column, dy: Column, azimuth: float, anisotropy: float) -> Column:
    """Distance with the major axis along ``azimuth`` and the minor axis stretched by 1 / ``anisotropy``."""
    a = F.radians(F.lit(90.0 - azimuth))
    along, across = dx * F.cos(a) + dy * F.sin(a), (dy * F.cos(a) - dx * F.sin(a)) / anisotropy
    return F.sqrt(along * along + across * across)


def covariance(h: Column, kind: str, sill: float, reach: float, nugget: float = 0.0, ceiling: float = 9999.0) -> Column:
    """Covariance at distance ``h``; ranges of exponential and gaussian structures aren't practical ranges, the nugget stands at 0 only.

    For ``power``, ``reach`` is the exponent and ``ceiling`` the value the structure is taken from.
    """
    r = h / reach
    body = {
        "spherical": F.when(r < 1, sill * (1 - 1.5 * r + 0.5 * r * r * r)).otherwise(0.0),
        "exponential": sill * F.exp(-r),
        "gaussian": sill * F.exp(-r * r),
        "power": ceiling - sill * F.pow(h, F.lit(min(max(reach, 0.05), 1.999))),
    }[kind]
    return F.when(h == 0, F.lit(nugget + (ceiling if kind == "power" else sill))).otherwise(body)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Fixed values of the approximation.
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def exceedance(estimate: Column, error: Column, threshold: float, above: bool = True) -> Column:
    """Chance that the value lies above ``threshold``; a step where the error isn't positive."""
    p = F.when(error > 0, normal_cdf((estimate - threshold) / error)).otherwise(F.when(estimate > threshold, 1.0).otherwise(0.0))
    return p if above else 1 - p


def manning(area: Column, perimeter: Column, roughness: Column, slope: Column) -> Column:
    """Discharge of steady uniform flow; 0 unless all of its terms are positive."""
    flow = area / roughness * F.pow(area / perimeter, F.lit(2.0 / 3.0)) * F.sqrt(slope)
    return F.when((area > 0) & (perimeter > 0) & (roughness > 0) & (slope > 0), flow).otherwise(0.0)


def apparent_dip(dip: Column, azimuth: Column, section: Column) -> Column:
    """Slope of a bed in a section, negative downwards along it."""
    return -F.tan(F.radians(dip)) * F.cos(F.radians(azimuth - section))


def attitude(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """(dip, dip azimuth) in degrees of the plane with this normal, turned upwards."""
    up = F.when(nz < 0, -1.0).otherwise(1.0)
    n = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.degrees(F.acos(F.least(F.lit(1.0), up * nz / n))), F.pmod(F.degrees(F.atan2(up * nx, up * ny)), F.lit(360.0))


#: What tilt, curvature and strain of an interval grow by as it gets longer than 15 m.
TILT, CURVATURE, STRAIN = 0.1414, 0.1768, 0.3535


def reduction(length: Column, beta: float) -> Column:
    """Reduction of deformations with the interval's length, clipped to 15 to 45 m."""
    return 1 + beta * F.sqrt(F.least(F.greatest(length, F.lit(15.0)), F.lit(45.0)) / 15 - 1)


def strain_share(curvature: Column) -> Column:
    """The share of curvature times half-trough length that is horizontal strain; small curvatures count more."""
    # Fixed values of the method: 0.05, 1.8, 3.8, and the curvature of 1e-4 a metre that shares are measured by.
    ratio = F.abs(curvature) / 1e-4
    return 0.05 * F.when(ratio < 1, 1 + 1.8 * F.pow(1 - ratio, F.lit(3.8))).otherwise(1.0)


def strain(curvature: Column, length: Column) -> Column:
    """Horizontal strain of a curvature in a trough of half-length ``length``, with the curvature's sign."""
    return strain_share(curvature) * curvature * length


def half_trough(depth: Column, boundary: float = 55.0, full: float = 55.0) -> Column:
    """Half-length of a trough over workings at ``depth``, by the boundary angle and the angle of full subsidence in degrees."""
    return depth * (1 / math.tan(math.radians(boundary)) + 1 / math.tan(math.radians(full)))


#: The trough's settlement over its half-length, in steps of 0.05.
TROUGH = [
    1.000, 0.980, 0.950, 0.900, 0.840, 0.740, 0.655, 0.540, 0.440, 0.360, 0.290,
    0.235, 0.188, 0.150, 0.120, 0.093, 0.072, 0.052, 0.034, 0.017, 0.000,
]


def _monotone_slopes(y: list[float], step: float) -> list[float]:
    """Slopes at even nodes of the monotone cubic through them: flat at the first, one-sided at the last, harmonic means between."""
    d = [(b - a) / step for a, b in zip(y, y[1:], strict=False)]
    inner = [2 * a * b / (a + b) if a * b > 0 else 0.0 for a, b in zip(d, d[1:], strict=False)]
    return [0.0, *inner, d[-1]]


def trough_shape(z: Column) -> Column:
    """Settlement at a share ``z`` of the half-trough from its middle: 1 up to 0, 0 from 1 on, a monotone cubic through ``TROUGH`` between."""
    step = 1 / (len(TROUGH) - 1)
    held = F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))
    k = F.least(F.floor(F.round(held / step, 9)), F.lit(len(TROUGH) - 2)).cast("int")
    node = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), i + 1)
    slopes = _monotone_slopes(TROUGH, step)
    t = (held - k * step) / step
    return (
        (2 * t + 1) * (1 - t) * (1 - t) * node(TROUGH, k) + t * (1 - t) * (1 - t) * step * node(slopes, k)
        + t * t * (3 - 2 * t) * node(TROUGH, k + 1) + t * t * (t - 1) * step * node(slopes, k + 1)
    )


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by a rational approximation with a relative error of 1.15e-9; null outside (0, 1)."""
    # Fixed values of the approximation (Acklam).
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def horner(values, x):
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + v
        return out

    tail = lambda q: horner(c, q) / (horner(d, q) * q + 1)
    middle = p - 0.5
    square = middle * middle
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < 0.02425, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(horner(a, square) * middle / (horner(b, square) * square + 1))
    )


def gaussian_floor(nugget: float, sill: float, kind: str) -> float:
    """The nugget of a model, at least one hundredth of the sill where a gaussian structure would make systems singular."""
    return max(nugget, 0.01 * sill) if kind == "gaussian" else nugget


def nice_interval(low: float, high: float, parts: int = 10) -> float:
    """The step of 1, 2 or 5 times a power of ten that cuts a range into at most ``parts``; 0 for an empty or endless range."""
    if not (math.isfinite(low) and math.isfinite(high) and high > low):
        return 0.0
    raw = (high - low) / max(parts, 1)
    power = 10.0 ** math.floor(math.log10(raw))
    return min(k * power for k in (1.0, 2.0, 5.0, 10.0) if raw <= k * power)


def nice_ticks(low: float, high: float, count: int) -> list[float]:
    """Round marks between two values, by the step of 1, 2, 2.5, 5 or 10 times a power of ten that gives the number nearest to ``count``; the smallest of equals."""
    if not high > low or count < 2:
        return []
    power = 10.0 ** math.floor(math.log10((high - low) / (count - 1)))

    def marks(step: float) -> list[float]:
        first = math.ceil(low / step)
        last = math.floor(high / step + 1e-6)
        return [round(k * step, 6) for k in range(first, last + 1)]

    every = [found for k in (1, 2, 2.5, 5, 10) if (found := marks(k * power))]
    return min(every, key=lambda found: abs(len(found) - count)) if every else []


def index_contour(level: Column, base: float, interval: float, every: int) -> Column:
    """Whether a level is every ``every``-th from ``base`` on."""
    step = interval * every
    return F.abs((level - base) - F.rint((level - base) / step) * step) < 1e-4 * interval


def code_colour(code: Column) -> Column:
    """A colour that a code always has: hue, saturation and value from the first three bytes of its md5, as ``#rrggbb``."""
    # The ranges of saturation and value.
    byte = lambda k: F.conv(F.substring(F.md5(code.cast("binary")), 2 * k + 1, 2), 16, 10).cast("double")
    h, s, v = byte(0) / 255 * 6, 0.45 + 0.35 * (byte(1) / 255), 0.65 + 0.25 * (byte(2) / 255)
    part = lambda shift: F.pmod(F.lit(float(shift)) + h, F.lit(6.0))
    channel = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0)))
    hexed = lambda c: F.lower(F.lpad(F.hex(F.rint(c * 255).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), *[hexed(channel(n)) for n in (5, 3, 1)])
