"""Which rows may repeat: a filter of keys seen twice, applied before wide rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.scratch import materialise

#: Slots for each key seen twice, so that one row in BITS_A_KEY that is alone passes for a repeated one.
BITS_A_KEY = 16
#: The filter has at most so many slots, 256 MB: enough for 134 million repeated keys at that rate; beyond, more rows that are alone pass.
MOST_BITS = 1 << 31
#: Bits of one bitmap, as bitmap_construct_agg makes them.
PAGE = 1 << 15
FLAG = "__may_repeat"


def flag_keys(df: DataFrame, key: Column, keys: DataFrame, flag: str = FLAG) -> DataFrame:
    """df with a flag: true where key (a long) is among keys (a table with one column k), and for one other row in BITS_A_KEY.

    The keys set a bit each in bitmaps, built range by range with partial aggregates. The bitmaps are sent to all tasks: 2 bytes for each
    key, MOST_BITS at most. No row of df moves. Names that begin with the flag's are reserved. A null key is never flagged.
    """
    n = keys.count()
    bits = max(1, min(MOST_BITS // PAGE, -(-n * BITS_A_KEY // PAGE))) * PAGE
    slot = lambda k: F.pmod(k, F.lit(bits).cast("long"))
    page, place = (lambda k: F.floor(slot(k) / PAGE).cast("int")), (lambda k: slot(k) % PAGE)
    pages = keys.groupBy(page(F.col("k")).alias(f"{flag}_page")).agg(F.bitmap_construct_agg(place(F.col("k"))).alias(f"{flag}_bits"))
    held = df.select("*", key.alias(f"{flag}_key")).withColumn(f"{flag}_page", page(F.col(f"{flag}_key")))
    byte = F.conv(F.hex(F.substring(f"{flag}_bits", (F.floor(place(F.col(f"{flag}_key")) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({flag}_byte, cast(pmod({flag}_key, {bits}L) % 8 as int)) & 1") == 1
    marked = held.join(F.broadcast(pages), f"{flag}_page", "left").withColumn(f"{flag}_byte", byte)
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(bit, F.lit(False)).alias(flag))


def may_repeat(df: DataFrame, columns: list[str], within: str | None = None) -> DataFrame:
    """df with a flag (FLAG, the one reserved beginning of a name): true for every row whose values of columns another row has, false for nearly all others.

    Values are equal as in grouping (null to null, NaN to NaN). Only 64-bit keys are shuffled: they are counted, and those
    seen twice become bitmaps that are sent to all tasks (flag_keys). Wide rows stay where they are. A flag that is wrongly true
    costs a row's way through a shuffle; what is decided by value afterwards stays right. With within (a boolean column), only
    keys of rows where it holds are counted, and a key seen once among them counts: the flag is then true for every row that equals one of these.
    """
    key = F.xxhash64(*columns)
    counted = (df.filter(within) if within else df).groupBy(key.alias("k")).count()
    often = materialise((counted if within else counted.filter("count > 1")).select("k"), "repeated-keys")
    return flag_keys(df, key, often)
