"""Bitmaps of hashed keys: which rows certainly have none of a set of keys.

A bitmap has a fixed number of bits (8 MB), so broadcasting it is bounded
whatever the number of keys. It only spares rows a shuffle: those it doesn't
hold have none of the keys; the others are joined. With very many keys it fills
up and spares less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.sources.scratch import materialise

BITS = 1 << 26


def bitmap_of(keys: DataFrame, key: str) -> tuple[DataFrame, str]:
    """(bucket, bits) of a column of longs, written out, and its path."""
    place = _place(F.col(key))
    return materialise(
        keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")), "bitmap"
    )


def with_hit(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: false where the key is certainly not among the bitmap's."""
    place = _place(F.col(key))
    at = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place) == F.col("_bucket"), "left").withColumn("_hit", hit).drop("_bucket", "_bits")


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
