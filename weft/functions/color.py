"""Colour arithmetic on 0xAARRGGBB numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.once import let

# Metals.
GOLD, SILVER, BRONZE = 0xFFD4AF37, 0xFFB9BEC4, 0xFFCD7F32


def channels(argb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(argb, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0))


def to_hsl(argb: Column) -> Column:
    """struct<h (0 to 360), s, l>."""

    def parts(c: Column) -> Column:
        r, g, b = (x / F.lit(255.0) for x in channels(c))
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))

    def ends(p: Column) -> Column:
        return F.struct(p.alias("p"), F.greatest(p["r"], p["g"], p["b"]).alias("top"), F.least(p["r"], p["g"], p["b"]).alias("low"))

    def made(e: Column) -> Column:
        r, g, b, top, low = e["p"]["r"], e["p"]["g"], e["p"]["b"], e["top"], e["low"]
        light, d = (top + low) / 2, top - low
        sat = F.when(d == 0, 0.0).otherwise(d / F.greatest(1 - F.abs(2 * light - 1), F.lit(1e-4)))
        sector = F.when(top == r, F.when(g < b, (g - b) / d + 6).otherwise((g - b) / d)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
        return F.struct(F.when(d == 0, 0.0).otherwise(sector * 60).alias("h"), sat.alias("s"), light.alias("l"))

    return let(argb, lambda c: let(parts(c), lambda p: let(ends(p), made)))


def from_hsl(h: Column, s: Column, light: Column) -> Column:
    """The opaque colour; channels are rounded half up."""

    def parts(q: Column) -> Column:
        c, part = (1 - F.abs(2 * q["l"] - 1)) * q["s"], F.pmod(q["h"], F.lit(360.0)) / 60
        return F.struct(c.alias("c"), part.alias("part"), q["l"].alias("l"))

    def more(q: Column) -> Column:
        x = q["c"] * (1 - F.abs(F.pmod(q["part"], F.lit(2.0)) - 1))
        return F.struct(q["c"].alias("c"), x.alias("x"), (q["l"] - q["c"] / 2).alias("m"), F.floor(q["part"]).alias("k"))

    def made(q: Column) -> Column:
        c, x, m, k, zero = q["c"], q["x"], q["m"], q["k"], F.lit(0.0)
        r = F.when(k.isin(0, 5), c).when(k.isin(1, 4), x).otherwise(zero)
        g = F.when(k.isin(1, 2), c).when(k.isin(0, 3), x).otherwise(zero)
        b = F.when(k.isin(3, 4), c).when(k.isin(2, 5), x).otherwise(zero)
        byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + m) * 255 + 0.5))).cast("long")
        return F.lit(0xFF000000) + byte(r) * 65536 + byte(g) * 256 + byte(b)

    return let(F.struct(h.alias("h"), s.alias("s"), light.alias("l")), lambda q: let(parts(q), lambda p: let(more(p), made)))


def balanced(light: Column) -> Column:
    return F.when(light < 0.3, 0.45).when(light > 0.75, 0.6).otherwise(light)


def companions(argb: Column, limit: int = 8) -> Column:
    """Colours that go with one: opposite and neighbouring hues if it is saturated, a light and a dark neutral, metals. Each once."""

    def some(x: Column) -> Column:
        h, s, light = x["h"], x["s"], balanced(x["l"])
        vivid = s > 0.12
        return F.array(
            F.when(vivid, from_hsl(h + 180, F.least(s * 1.05, F.lit(1.0)), light)), F.when(vivid, from_hsl(h + 30, s * 0.85, light)), F.when(vivid, from_hsl(h + 330, s * 0.85, light)),
            from_hsl(h, F.lit(0.08), F.lit(0.82)), from_hsl(h, F.lit(0.10), F.lit(0.22)), F.when((h < 90) | (h > 300), F.lit(GOLD)).otherwise(F.lit(SILVER)), F.lit(BRONZE),
        )

    return F.slice(F.array_distinct(F.array_compact(let(to_hsl(argb), some))), 1, limit)


def undertone(skin: Column) -> Column:
    r, g, b = channels(skin)
    warmth = (r - b) - (r - g) * 0.5
    return F.when(warmth > 22, "WARM_GOLDEN").when(warmth < 8, "COOL_DEEP").otherwise("NEUTRAL_RICH")


def companions_for(argb: Column, skin: Column, limit: int = 8) -> Column:
    """companions, with the undertone's metal at the fourth place at the latest."""
    metal = F.when(undertone(skin) == "WARM_GOLDEN", F.lit(GOLD)).when(undertone(skin) == "COOL_DEEP", F.lit(SILVER)).otherwise(F.lit(BRONZE))
    some = lambda base: F.concat(F.slice(base, 1, 3), F.array(metal), F.slice(base, 4, limit + 2))
    return F.slice(F.array_distinct(let(F.array_remove(companions(argb, limit + 2), metal), some)), 1, limit)


def skin_harmony(colors: Column, skin: Column) -> Column:
    """How well colours (array<bigint>) suit a skin tone, 0 to 1; 0.5 without colours."""

    def one(x: Column, wearer: Column) -> Column:
        h, s, light, tone, skin_light = x["h"], x["s"], x["l"], wearer["tone"], wearer["l"]
        warm, jewel = (h <= 85) | (h >= 315), h.between(150, 295)
        match = F.when(tone == "NEUTRAL_RICH", 0.82).when(F.when(tone == "WARM_GOLDEN", warm | (h.between(110, 165) & (s > 0.35))).otherwise(jewel | ((s > 0.5) & ~warm)), 0.9).otherwise(0.6)
        return F.least(match + F.least(F.abs(light - skin_light) * 0.35, F.lit(0.15)), F.lit(1.0))

    total = lambda w: F.aggregate(colors, F.lit(0.0), lambda a, argb: a + let(to_hsl(argb), lambda x: one(x, w)))
    wearer = F.struct(undertone(skin).alias("tone"), to_hsl(skin)["l"].alias("l"))
    return F.when(F.size(colors) == 0, 0.5).otherwise(let(wearer, total) / F.size(colors))


def darken(argb: Column, by: float = 0.55) -> Column:
    r, g, b = (F.floor(x * by + 0.5).cast("long") for x in channels(argb))
    return F.lit(0xFF000000) + r * 65536 + g * 256 + b


def is_skin(argb: Column) -> Column:
    """A skin tone by its blue and red difference from luma."""
    r, g, b = channels(argb)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = (b - y) * 0.564 + 128, (r - y) * 0.713 + 128
    return (y > 40) & cb.between(77, 127) & cr.between(133, 173)


def filtered(argb: Column, brightness: float, contrast: float, saturation: float) -> Column:
    """The opaque colour after brightness, contrast and saturation (-100 to 100 each); channels are cut to whole numbers of 0 to 255 after each step.

    Sums are rounded to six places before they are cut, so engines agree.
    """
    cut = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x, 6).cast("int")))
    more, scale = (contrast + 100) / 100, (saturation + 100) / 100
    bright = [cut(x + brightness / 100 * 255) for x in channels(argb)]
    r, g, b = (cut(((x / F.lit(255.0) - 0.5) * more + 0.5) * 255) for x in bright)
    grey = F.round(0.299 * r + 0.587 * g + 0.114 * b, 6).cast("int")
    r, g, b = (cut(grey + scale * (x - grey)).cast("long") for x in (r, g, b))
    return F.lit(0xFF000000) + r * 65536 + g * 256 + b
