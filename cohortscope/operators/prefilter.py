"""Approximate membership before an expensive step: a bitmap of hashed keys.

Every key sets one bit of ``bits``; rows whose bit is not set have no partner.
Rows whose bit is set by another key stay, so a join must still follow: the
filter only keeps what it need not parse and shuffle. With n distinct keys a
strange row stays with probability ``1 - exp(-n / bits)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: at most 2,048 bitmaps of 4 KB, 8 MB, whatever the number of keys.
BITS = 1 << 26


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def key_bitmaps(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(__part, __map): one 32,768-bit map for each part of the bits that a key falls into; built map-side."""
    place = _place(key, bits)
    return (keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("__part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__map")))


def probable(rows: DataFrame, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be among those of ``keys``; rows with a NULL key go.

    The maps are broadcast: their size is bounded by ``bits``, not by the keys.
    """
    place = _place(key, bits)
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.where(F.col(key).isNotNull()).withColumn("__part", F.bitmap_bucket_number(place))
            .join(F.broadcast(key_bitmaps(keys, key, bits)), "__part")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))
