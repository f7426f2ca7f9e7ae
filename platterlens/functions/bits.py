"""Numbers read digit by digit or bit by bit, and pictures as bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit_sum(n: Column) -> Column:
    """The sum of the decimal digits of a whole number of up to 18 digits."""
    whole = F.abs(n).cast("long")
    digit = lambda k: F.call_function("div", whole, F.lit(10**k).cast("long")) % 10
    return reduce(lambda a, b: a + b, (digit(k) for k in range(18)))


def from_bcd(byte: Column) -> Column:
    return (F.shiftright(byte, 4) * 10 + byte.bitwiseAND(F.lit(15))).cast("int")


def crc_hex(crc: Column) -> Column:
    return F.lpad(F.lower(F.hex(crc)), 8, "0")


def big_endian(data: Column) -> Column:
    """Up to seven bytes as a number, the first byte highest."""
    return F.conv(F.hex(data), 16, 10).cast("long")


def above_mean(values: Column) -> Column:
    """Bits of a picture: which samples are above the mean, first sample highest, as two signed halves of 64 bits."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    bits = F.transform(values, lambda x: F.when(x > mean, 1).otherwise(0).cast("long"))
    half = lambda at: F.aggregate(F.slice(bits, F.lit(at), F.lit(64)), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.struct(half(1).alias("hi"), half(65).alias("lo"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: The shapes that pixels of a disc can have, and the frame rates by what is measured.
RATIOS = ((32, 27), (8, 9), (64, 45), (16, 11), (1, 1))
RATES = ((23.976, "24000/1001"), (24.0, "24000/1001"), (29.97, "30000/1001"), (30.0, "30000/1001"), (25.0, "25"))


def snap_ratio(num: Column, den: Column) -> Column:
    """A pixel's shape as the first known ratio within a hundredth of it, else as it stands; 1/1 if it is no ratio."""
    out = F.when(num.isNull() | den.isNull() | (num == 0) | (den == 0), "1/1")
    for a, b in RATIOS:
        out = out.when(F.abs(num / F.nullif(den, F.lit(0)) - a / b) / (a / b) < 0.01, f"{a}/{b}")
    return out.otherwise(F.concat_ws("/", num.cast("long").cast("string"), den.cast("long").cast("string")))


def frame_rate(fps: Column) -> Column:
    """The exact rate that a measured one is near, or null."""
    return F.coalesce(*(F.when(F.abs(fps - near) < 0.05, name) for near, name in RATES))


def looks_telecined(plain: Column, decimated: Column) -> Column:
    return F.when(plain > 0, F.abs(decimated / plain - 0.8) < 0.03).otherwise(F.lit(False))


def square_size(width: Column, height: Column, num: Column, den: Column) -> Column:
    """The size with square pixels, its width made even; null where pixels are square."""
    wide = F.ceil(width * num / den).cast("long")
    return F.when(num != den, F.struct((wide + wide % 2).alias("width"), height.cast("long").alias("height")))
