"""Address blocks of both families as ranges of numbers.

An address is (high, low), its upper and lower 64 bits; `high` is 0 for IPv4. Ranges begin with their first address and
end before another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(20,0)"
HALF = 1 << 64


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(NUMBER)


def _power(exponent: Column) -> Column:
    """2 to the given power, 0 to 64, exactly: a product of two that fit into 64 bits."""
    half = F.floor(exponent / 2).cast("int")
    one = F.lit(1).cast("long")
    parts = [F.call_function("shiftleft", one, x).cast(NUMBER) for x in (half, (exponent - half).cast("int"))]
    return (parts[0] * parts[1]).cast(NUMBER)


def _address(high: Column, low: Column) -> Column:
    return F.struct(high.cast(NUMBER).alias("high"), low.cast(NUMBER).alias("low"))


def _block(version: int, first: Column, end: Column) -> Column:
    return F.struct(F.lit(version).alias("version"), first.alias("first"), end.alias("end"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def _ipv4(cidr: Column) -> Column:
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?$"
    numbers = F.array(*[F.regexp_extract(cidr, pattern, i).try_cast("long") for i in range(1, 6)])

    def block(found: Column) -> Column:
        octets, bits = [F.get(found, i) for i in range(4)], F.coalesce(F.get(found, 4), F.lit(32))
        value = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
        size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - F.least(bits, F.lit(32))).cast("int"))
        zero = _number(0)
        good = (F.greatest(*octets) <= 255) & (bits <= 32) & F.get(found, 3).isNotNull()
        first = _let(F.struct(value.alias("value"), size.alias("size")), lambda v: F.struct(
            (v["value"] - v["value"] % v["size"]).alias("low"), v["size"].alias("size")))
        return F.when(good, _let(first, lambda v: _block(4, _address(zero, v["low"]), _address(zero, v["low"] + v["size"]))))

    return _let(numbers, block)


def _groups(part: Column) -> Column:
    return F.when(F.coalesce(part, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _ipv6(cidr: Column) -> Column:
    text = F.lower(cidr)
    bits = F.when(text.contains("/"), F.regexp_extract(text, r"/(\d{1,3})$", 1).try_cast("int")).otherwise(F.lit(128))
    parts = F.split(F.split_part(text, F.lit("/"), F.lit(1)), "::")
    sides = _let(parts, lambda p: F.struct(
        _groups(F.get(p, 0)).alias("left"), _groups(F.get(p, 1)).alias("right"), F.size(p).alias("n")))

    def filled(side: Column) -> Column:
        gap = F.lit(8) - F.size(side["left"]) - F.size(side["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        whole = F.when(side["n"] == 2, gap >= 1).otherwise((side["n"] == 1) & (gap == 0))
        return F.struct(F.concat(side["left"], zeros, side["right"]).alias("groups"), whole.alias("whole"), bits.alias("bits"))

    def halves(found: Column) -> Column:
        digits = F.array_join(F.transform(found["groups"], lambda g: F.lpad(g, 4, "0")), "")
        return _let(digits, lambda d: F.struct(
            F.conv(F.substring(d, 1, 16), 16, 10).cast(NUMBER).alias("high"),
            F.conv(F.substring(d, 17, 16), 16, 10).cast(NUMBER).alias("low"),
            (found["bits"] >= 64).alias("in_low"),
            _power(F.when(found["bits"] >= 64, F.lit(128) - found["bits"]).otherwise(F.lit(64) - found["bits"])).alias("size"),
        ))

    def block(v: Column) -> Column:
        first_low = F.when(v["in_low"], v["low"] - v["low"] % v["size"]).otherwise(_number(0))
        first_high = F.when(v["in_low"], v["high"]).otherwise(v["high"] - v["high"] % v["size"])
        first = _address(first_high, first_low)

        def ended(at: Column) -> Column:
            full = v["in_low"] & (at["low"] + v["size"] >= _number(HALF))  # the block ends with the lower half
            end_low = F.when(v["in_low"] & ~full, at["low"] + v["size"]).otherwise(_number(0))
            end_high = F.when(full, at["high"] + 1).when(v["in_low"], at["high"]).otherwise(at["high"] + v["size"])
            return _block(6, at, _address(end_high, end_low))

        return _let(first, ended)

    def checked(found: Column) -> Column:
        good = found["whole"] & F.forall(found["groups"], lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (found["bits"] <= 128)
        return F.when(good, _let(halves(found), block))

    return _let(_let(sides, filled), checked)


def block_of(cidr: Column) -> Column:
    """(version, first, end) of an address or block; its host bits do not count. Null for anything else,
    also for IPv6 that ends in dotted IPv4."""
    return F.when(cidr.contains(":"), _ipv6(cidr)).otherwise(_ipv4(cidr))


def before(address: Column) -> Column:
    """The address before."""
    high, low = address["high"], address["low"]
    return F.when(low > 0, _address(high, low - 1)).otherwise(_address(high - 1, _number(HALF - 1)))


def address_text(version: Column, address: Column) -> Column:
    """Dotted numbers, or eight groups of four hex digits."""
    low = address["low"].cast("long")
    dotted = F.concat_ws(".", *[F.shiftright(low, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    halves = [F.lpad(F.lower(F.conv(address[half].cast("string"), 10, 16)), 16, "0") for half in ("high", "low")]
    grouped = F.concat_ws(":", *[F.substring(half, i, 4) for half in halves for i in (1, 5, 9, 13)])
    return F.when(version == 4, dotted).otherwise(grouped)
