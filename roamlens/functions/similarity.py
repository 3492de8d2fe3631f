"""String ratio, geography and vector expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from roamlens.functions import vocab
from roamlens.functions.tasks import indel, token_set


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio 0-100 of already paired names."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger of the token-set ratio and the indel ratio, 0-100."""
    return pd.Series([None if x is None or y is None else max(token_set(x, y), indel(x, y))
                      for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability; one value per finished test."""
    from math import erfc, sqrt

    return z.map(lambda v: None if v is None or v != v else erfc(abs(v) / sqrt(2.0))).astype("float64")


def half_even(x: Column, digits: int) -> Column:
    """Half-even rounding after the noise of binary arithmetic is removed."""
    return F.bround(F.round(x, 9), digits)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = lambda d: F.pow(F.sin(d / 2), 2)
    inside = half(p2 - p1) + F.cos(p1) * F.cos(p2) * half(F.radians(lng2 - lng1))
    return F.lit(2 * 6371000.0) * F.asin(F.sqrt(inside))


def in_box(lat: Column, lng: Column) -> Column:
    """A usable coordinate inside the country; a missing one is not."""
    ok = lat.between(*vocab.LAT_RANGE) & lng.between(*vocab.LNG_RANGE)
    return F.coalesce(ok & ~F.isnan(lat.cast("double")) & ~F.isnan(lng.cast("double")), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)
