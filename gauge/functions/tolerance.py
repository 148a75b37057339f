"""Tolerance arithmetic as Column expressions. A missing measurement gives null, or false for flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a drawn tolerance fraction; half-width of a contour band that states none; fixed values.
CLIP, CONTOUR_BAND = 3.0, 0.025
#: Smallest change of a measurement that means rework, in mm; fixed value.
REWORK_MM = 0.10


def out_of_tolerance(excess: Column, bar: Column) -> Column:
    """Reported an excess, or drew the bar beyond its ends."""
    return excess.isNotNull() | F.coalesce(bar.rlike("<<|>>"), F.lit(False))


def sign_suspect(nominal: Column, measured: Column) -> Column:
    """The measurement has the nominal's size but the other sign."""
    found = (F.abs(nominal) > 1) & (nominal * measured < 0) & (F.abs(F.abs(measured) - F.abs(nominal)) < 0.5)
    return F.coalesce(found, F.lit(False))


def sign_fixed(nominal: Column, measured: Column, deviation: Column) -> tuple[Column, Column]:
    """Measured and deviation with a suspect sign turned; flags made from the report stay as they are."""
    suspect = sign_suspect(nominal, measured)
    return F.when(suspect, -measured).otherwise(measured), F.when(suspect, -measured - nominal).otherwise(deviation)


def fraction(deviation: Column, upper: Column, lower: Column) -> Column:
    """The share of its tolerance that a deviation uses up.

    Upwards the band is ``upper``, and a missing one gives null. Downwards it is the size of ``lower``. A
    band of 0, or a missing lower one, gives 0 for no deviation and else the clip limit by direction.
    """
    band = F.when(deviation >= 0, upper).otherwise(F.abs(lower))
    edge = F.when(deviation == 0, 0.0).when(deviation > 0, CLIP).otherwise(-CLIP)
    return F.when(deviation.isNull() | ((deviation >= 0) & upper.isNull()), None).when(F.coalesce(band, F.lit(0.0)) == 0, edge).otherwise(F.try_divide(deviation, band))


def clipped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(CLIP)), F.lit(-CLIP)))


def worst_infraction(lower: Column, upper: Column) -> Column:
    return F.greatest(F.abs(F.coalesce(lower, F.lit(0.0))), F.abs(F.coalesce(upper, F.lit(0.0))))


def has_infraction(lower: Column, upper: Column) -> Column:
    return worst_infraction(lower, upper) != 0


def in_band(value: Column, upper: Column) -> Column:
    """Within the band on both sides; a missing or zero band is the usual one."""
    return F.abs(value) <= F.coalesce(F.nullif(upper, F.lit(0.0)), F.lit(CONTOUR_BAND))


def scaled(value: Column, upper: Column, lower_deviation: Column, upper_deviation: Column) -> Column:
    """Place of a value on a bar from 0 to 100 with 0 in its middle, wide enough for both deviations and four bands."""
    band = F.coalesce(F.nullif(upper, F.lit(0.0)), F.lit(CONTOUR_BAND))
    size = lambda d: F.abs(F.coalesce(d, F.lit(0.0)))
    return 50 + 50 * value / (F.greatest(4 * band, size(lower_deviation), size(upper_deviation)) * 1.15)


def reworked(delta: Column) -> Column:
    """A change that noise does not make."""
    return F.abs(delta) >= REWORK_MM


def position(dx: Column, dz: Column) -> Column:
    """Position tolerance that a shift uses: the diameter around the nominal place."""
    return 2 * F.hypot(dx, dz)


def margin(deviation: Column, upper: Column, lower: Column) -> Column:
    """Distance to the nearer limit; negative beyond it."""
    return F.least(upper - deviation, deviation - lower)


def overcorrected(before: Column, after: Column, upper: Column, lower: Column) -> Column:
    """From beyond one limit to beyond the other."""
    return ((before > upper) & (after < lower)) | ((before < lower) & (after > upper))


def oval(least: Column, two_point: Column, upper: Column, lower: Column) -> Column:
    """The inscribed size is too small while the two-point size is too large."""
    return (least < lower) & (two_point > upper)
