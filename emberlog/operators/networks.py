"""Looking addresses up in ranges that may lie in each other: the longest matching prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import MAPPED, ip_hex, ipv4_long
from ..functions.plan import computed_once


def masked(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of 32 hexadecimal digits as 16 bytes, the others nought."""
    whole = (bits / 4).cast("int")
    left = (bits % 4).cast("int")
    cut = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.element_at(F.array(*(F.lit(1 << (4 - i)) for i in range(4))), left + 1)
    part = F.when(left > 0, F.lower(F.hex(cut - cut % step))).otherwise("")
    return F.unhex(F.rpad(F.concat(F.substring(digits, F.lit(1), whole), part), 32, "0"))


def _aligned(ranges: DataFrame) -> DataFrame:
    """(first, last) IPv4 numbers as the few aligned blocks that they consist of: ``bits`` of 32 and ``start``. A block
    counts if it lies in the range and the block twice its size around it doesn't, so at most two of a size do."""
    a, b, size = F.col("first"), F.col("last"), F.expr("shiftleft(1L, 32 - __bits)")
    up = F.expr("(first + __size - 1) div __size * __size")
    down = F.expr("(last + 1) div __size * __size - __size")
    within = lambda x, size: (x >= a) & (x + size - 1 <= b)
    alone = lambda x: within(x, F.col("__size")) & ~within(x - x % (F.col("__size") * 2), F.col("__size") * 2)
    spread = ranges.withColumn("__bits", F.explode(F.sequence(F.lit(0), F.lit(32)))).withColumn("__size", size).withColumns({"__up": up, "__down": down})
    starts = F.array_distinct(F.array_compact(F.array(F.when(alone(F.col("__up")), F.col("__up")), F.when(alone(F.col("__down")), F.col("__down")))))
    return spread.withColumn("start", F.explode(starts))


def prefixes(ranges: DataFrame, values: list[str]) -> DataFrame:
    """(bits, net, *values): ``ranges`` as prefixes of 128-bit addresses. They are told by ``network`` (an address, with or
    without ``/n``) or else by ``first`` and ``last``, IPv4 addresses as numbers. What can't be read, null or the wrong way
    round is left out; of several rows for one prefix the least values stay."""
    if "network" in ranges.columns:
        address, length = F.trim(F.substring_index("network", "/", 1)), F.when(F.col("network").contains("/"), F.trim(F.substring_index("network", "/", -1)).try_cast("int"))
        four = ipv4_long(address).isNotNull()
        most = F.when(four, 32).otherwise(128)
        bits = F.when(F.col("network").contains("/"), length).otherwise(most)
        ok = bits.between(0, most)
        rows = ranges.select(F.when(ok, bits + F.when(four, 96).otherwise(0)).alias("bits"), ip_hex(address).alias("digits"), *values)
    else:
        blocks = _aligned(ranges.where("first <= last and first >= 0 and last < 4294967296"))
        rows = blocks.select((F.col("__bits") + 96).alias("bits"), F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex("start")), 8, "0")).alias("digits"), *values)
    rows = rows.where("bits is not null and digits is not null").select("bits", masked(F.col("digits"), F.col("bits")).alias("net"), *values)
    return rows.groupBy("bits", "net").agg(F.min(F.struct(*values)).alias("v")).select("bits", "net", *(F.col("v")[c].alias(c) for c in values))


def with_network(rows: DataFrame, nets: DataFrame, ip_col: str, values: list[str], digits_col: str | None = None) -> DataFrame:
    """``rows`` with ``values`` of the longest of ``nets`` (from ``prefixes``) that holds their address, null where none does.
    ``digits_col``: a column that has ``ip_hex`` of the address already.

    An address is tried at each length that occurs in ``nets``, of which there are at most 129, by an equi-join on length
    and masked bits; the longest that is found stays. Addresses are made distinct first, so a busy one costs no more.
    """
    if digits_col is None:
        return with_network(computed_once(rows, {"__digits": ip_hex(F.col(ip_col))}), nets, ip_col, values, "__digits").drop("__digits")
    lengths = nets.agg(F.sort_array(F.collect_set("bits")).alias("l")).scalar()
    keyed = rows.select(F.col(digits_col).alias("__d")).where("__d is not null").distinct()
    tried = keyed.withColumn("bits", F.explode(lengths)).select("__d", "bits", masked(F.col("__d"), F.col("bits")).alias("net"))
    found = tried.join(nets, ["bits", "net"]).groupBy("__d").agg(F.max_by(F.struct(*values), "bits").alias("__v"))
    return rows.join(found, F.col(digits_col) == F.col("__d"), "left").select(rows["*"], *(F.col("__v")[c].alias(c) for c in values))
