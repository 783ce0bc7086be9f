"""A fixed-size bitmap that keeps rows without a partner out of a shuffle; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 4 MB, whatever the size of the data, so it can be broadcast.
BITS = 1 << 25
_BUCKET = 32768


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose 64-bit `key` may be among `keys` (one column of the same name), and rows that surely are not.

    No key is missed. With many more keys than bits nearly all rows land in the first part,
    which then is what it would have been without the bitmap.
    """
    place = F.pmod(F.col(key), F.lit(BITS))
    spot = keys.select(place.alias("_at"))
    maps = spot.groupBy((F.col("_at") / _BUCKET).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_at") % _BUCKET).alias("_map"))
    bit = (place % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright(bit, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    marked = rows.withColumn("_bucket", (place / _BUCKET).cast("int")).join(F.broadcast(maps), "_bucket", "left").withColumn("_hit", hit)
    return marked.where("_hit").select(*rows.columns), marked.where("not _hit").select(*rows.columns)
