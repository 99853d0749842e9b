"""Colours and whole numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "^#?[0-9a-fA-F]{6}$"
GRAY = 120  # of each channel, for what is no colour


def hsl_channels(hue: Column, saturation: Column, lightness: Column) -> list[Column]:
    """Red, green and blue from 0 to 255, of a hue in degrees (0 to 360) and two shares. Each channel is a ramp around the circle."""
    reach = saturation * F.least(lightness, 1 - lightness)

    def channel(offset: int) -> Column:
        k = (F.lit(offset) + hue / 30) % 12
        return 255 * (lightness - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))

    return [channel(n) for n in (0, 8, 4)]


def hex_channels(text: Column) -> list[Column]:
    """The three channels of #rrggbb, with or without the sign, white space around it left out."""
    digits = F.regexp_replace(F.trim(text), "^#", "")
    found = F.trim(text).rlike(HEX)
    return [F.when(found, F.conv(F.substring(digits, k, 2), 16, 10).cast("int")).otherwise(F.lit(GRAY)) for k in (1, 3, 5)]


def hex_text(channels: list[Column]) -> Column:
    """#rrggbb of channels, which are rounded and kept between 0 and 255."""
    two = [F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("long"))), 2, "0") for c in channels]
    return F.concat(F.lit("#"), *two)


def tinted(text: Column, amount: Column) -> Column:
    """A colour mixed with white, by an amount from 0 to 100; what isn't #rrggbb stays as it is."""
    mixed = [c + (255 - c) * (amount / 100) for c in hex_channels(text)]
    return F.when(text.rlike("^#[0-9a-fA-F]{6}$"), hex_text(mixed)).otherwise(text)


def greatest_divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of whole numbers of at least 0 (of a and 0: a). Euclid's steps, of which 64-bit numbers need fewer
    than 92."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.when(s.b == 0, F.lit(0).cast("long")).otherwise(s.a % s.b).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s.a)
