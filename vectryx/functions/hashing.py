"""FNV-1a routing and reproducible random levels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a_mod(text: Column, n: int) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as unsigned, modulo n.

    The state is two halves of 32 bits, as a product of 64 would overflow; the prime is 2**40 + 435.
    """
    digits = F.hex(F.encode(text, "utf-8"))
    count = F.length(digits) / 2
    octets = F.when(count >= 1, F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    mask = F.lit(0xFFFFFFFF)

    def step(state: Column, octet: Column) -> Column:
        low = state["l"].bitwiseXOR(octet)
        product = low * 435
        high = state["h"] * 435 + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(mask).alias("h"), product.bitwiseAND(mask).alias("l"))

    start = F.struct(F.lit(0xCBF29CE4).alias("h"), F.lit(0x84222325).alias("l"))
    return F.aggregate(octets, start, step, lambda s: ((s["h"] % n) * ((1 << 32) % n) + s["l"] % n) % n)


def level(id_: Column, m: int = 16) -> Column:
    """floor(-ln(u) / ln(m)) with u in (0, 1) from the id's hash, so that a rebuild gives each id its level again."""
    u = F.greatest(F.lit(1e-6), F.conv(F.substring(F.md5(id_.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)))
    return F.floor(-F.log(u) * F.lit(1 / math.log(m))).cast("int")
