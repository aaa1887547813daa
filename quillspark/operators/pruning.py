"""Prune a large table to the keys another one asks for, before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG2_BITS = 27                       # 16 MB of bits
_PAGE = 15                           # bits of a page: what one bitmap aggregate holds (4 KB)


def key_bitmap(keys: DataFrame, on: Sequence[str], log2_bits: int = LOG2_BITS) -> DataFrame:
    """(page, bits): one bit for the hash of each key.  At most ``2 ** log2_bits`` bits, however many keys there are."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << log2_bits))
    return keys.select(F.shiftright(place, _PAGE).alias("page"), place.bitwiseAND((1 << _PAGE) - 1).alias("at")) \
        .groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))


def prune_to_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str], log2_bits: int = LOG2_BITS,
                  others: bool = False) -> DataFrame:
    """Rows of ``rows`` whose key may be among ``keys``: all that are, and of the others one in ``2 ** log2_bits / keys``.
    With ``others``, the rest of the rows instead, none of which is among ``keys``.

    The bitmap is broadcast, which its size allows for any number of keys; ``rows`` is filtered where it is read, so wide
    columns of rows that no key asks for never reach a shuffle.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << log2_bits))
    at = place.bitwiseAND((1 << _PAGE) - 1)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bitmap = F.broadcast(key_bitmap(keys, on, log2_bits))
    return rows.join(bitmap, (F.shiftright(place, _PAGE) == F.col("page"))
                     & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1), "left_anti" if others else "left_semi")
