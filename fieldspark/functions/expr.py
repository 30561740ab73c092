"""Column expressions: unit changes, clips, masks, rules. No rows move here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of the scene mask that count as usable ground.
VALID_CLASSES = (4, 5, 6, 7)


def to_db(x: Column) -> Column:
    """Linear power to decibel; null where the power is not positive."""
    return F.when(x > 0, 10.0 * F.log10(x))


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10.0)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps null (``greatest`` and ``least`` skip nulls)."""
    y = x
    if lo is not None:
        y = F.when(y < lo, F.lit(float(lo))).otherwise(y)
    if hi is not None:
        y = F.when(y > hi, F.lit(float(hi))).otherwise(y)
    return y


def clip_pos(x: Column, sign: float = 1.0) -> Column:
    """Amount above the baseline: ``max(0, sign * x)``."""
    return clip(x * sign, lo=0.0)


def signed(x: Column, sign: float = 1.0) -> Column:
    return x * sign


def poly_eval(x: Column, coefficients: Column) -> Column:
    """Polynomial with coefficients in an array, low order first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def incidence_deg(column: Column, columns: Column, near_range_m: Column, spacing_m: Column,
                  height_m: Column, radius_m: Column, centre_deg: Column) -> Column:
    """Incidence along a range line by the law of cosines.

    The whole line is shifted so that its centre column equals the angle in the metadata.
    """
    def geometric(c: Column) -> Column:
        slant = near_range_m + c * spacing_m
        orbit = radius_m + height_m
        cosine = (orbit * orbit - slant * slant - radius_m * radius_m) / (2.0 * slant * radius_m)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    return geometric(column) + (centre_deg - geometric(columns / 2.0))


def calibrated_gamma(i: Column, q: Column, scale: Column, incidence: Column,
                     noise: Column) -> Column:
    """Sample to terrain-flattened power: noise removed, floored at 1 % of the noise."""
    power = i * i + q * q
    sigma = power * scale * scale * F.sin(F.radians(incidence)) - noise
    gamma = F.greatest(sigma, noise * 0.01) / F.cos(F.radians(incidence))
    return F.when(power > 0, gamma).otherwise(F.lit(0.0))


def valid_cell(cls: Column, red: Column, nir: Column, keep: Sequence[int] = VALID_CLASSES) -> Column:
    return cls.isin(*keep) & (red > 0) & (nir > 0)


def normalised_difference(b: Column, a: Column, valid: Column | None = None) -> Column:
    ok = (b + a) > 0
    if valid is not None:
        ok = valid & ok
    return F.when(ok, F.try_divide(b - a, b + a))


def folded_angle(azimuth: Column, look: float) -> Column:
    """Angle between an axis and a look direction, folded to 0..90 degrees."""
    return F.abs(F.pmod(azimuth - look + 90.0, F.lit(180.0)) - 90.0)


def cos_double_angle(azimuth: Column, look: float) -> Column:
    return F.cos(F.radians(2.0 * (azimuth - look)))


def rule_label(rules: Sequence[tuple[Column, str]]) -> Column:
    """First rule that holds gives the label; none gives null."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def quality_flag(n_valid: Column, n_all: int, n_min: int) -> Column:
    return (F.when(n_valid == n_all, "measured")
             .when(n_valid >= n_min, "interpolated").otherwise("imputed"))


def lookup(key: Column, table: Mapping[str, float], what: str) -> Column:
    """Category to constant; a category without an entry fails the job."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    value = F.element_at(F.create_map(*entries), key)
    return F.when(value.isNull(), F.raise_error(
        F.concat(F.lit(f"no {what} for "), F.coalesce(key, F.lit("null")))).cast("double")
    ).otherwise(value)


def spaced_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin number from 0; the last bin is closed; outside is null."""
    width = (hi - lo) / bins
    raw = F.floor((x - lo) / width).cast("int")
    return F.when((x >= lo) & (x <= hi), F.least(raw, F.lit(bins - 1)))


def gaussian_weight(distance: Column, bandwidth: float) -> Column:
    return F.exp(-F.pow(distance / bandwidth, 2.0))
