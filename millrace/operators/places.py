"""Postings near many homes, by a grid.

Latitude is cut into bands as high as the radius, each band into cells at least as wide as the
radius is there.  A posting lies in one cell; a home is filed under the cells its radius reaches, in
three bands at most, few each (towards the poles a band has few cells, and one at the pole itself).
They meet by an equality join, a crowded cell's postings in parts, and the exact distance decides.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.parse import haversine_km

#: Distances are rounded to one decimal, so that much more may still be within a radius.
ROUNDING = 0.05
#: Postings of a cell that one task compares with the homes there, about.
MOST_IN_PART = 2_048


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height).cast("int")


def _cells(band: Column, height: float, reach: float) -> Column:
    """Cells of a band: as many as are wider than ``reach`` (an angle) where the band is narrowest."""
    low, high = band * height - 90, (band + 1) * height - 90
    narrow = F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.greatest(narrow, F.lit(0.0)) / reach)).cast("int")


def _column(lon: Column, cells: Column) -> Column:
    return F.floor((lon + 180) / 360 * cells).cast("int")


def within_km(postings: DataFrame, homes: DataFrame, km: float, post_id: str = "seq", home_id: str = "home") -> DataFrame:
    """(home, posting, km) of every posting that is ``km`` or less from a home; both have lat and lon (degrees).

    Rows without a place, or one out of range, are near nothing.  Longitudes may go round the date line.
    """
    reach = (km + ROUNDING) / fixed.EARTH_KM * 180 / 3.141592653589793 * (1 + 1e-9)  # the radius as an angle
    height = max(reach, 1e-6)
    bands = floor(180 / height)
    known = (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    p = postings.where(known).select(F.col(post_id).alias("_post"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    p = p.withColumn("band", F.least(_band(F.col("_lat"), height), F.lit(bands)))
    p = p.withColumn("cell", F.least(_column(F.col("_lon"), _cells(F.col("band"), height, reach)), _cells(F.col("band"), height, reach) - 1))

    h = homes.where(known).select(F.col(home_id).alias("_home"), "lat", "lon")
    own = F.least(_band(F.col("lat"), height), F.lit(bands))
    h = h.withColumn("band", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(bands)))))
    # how far the radius reaches in longitude: all around where it holds a pole
    sine = F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("lat"))
    around = (F.abs("lat") + reach >= 90) | (sine >= 1)
    wide = F.when(around, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + 1e-9)
    cells = _cells(F.col("band"), height, reach)
    first, last = _column(F.col("lon") - wide, cells), _column(F.col("lon") + wide, cells)
    h = h.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + cells - 1)), lambda c: F.pmod(c, cells)))))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    # a crowded cell is cut into parts of its postings, each of which meets all homes filed there
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowd = p.groupBy("band", "cell").agg(F.ceil(F.count("*") / MOST_IN_PART).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    p = p.join(crowd, ["band", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("_post"), parts).cast("int")).drop("parts").repartition(tasks, "band", "cell", "part")
    h = h.join(crowd, ["band", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = p.join(h, ["band", "cell", "part"]).withColumn("km", d).where(F.col("km") <= km)
    return met.select(F.col("_home").alias(home_id), F.col("_post").alias(post_id), "km")
