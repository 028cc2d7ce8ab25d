"""Statistics of pictures: native where a row's arrays suffice, numpy folds for whole rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.color import channels, to_hsl

LEVELS = 16


def hue_buckets(pixels: DataFrame, least: float = 0.07, most: int = 4) -> DataFrame:
    """img, bucket, share, argb: the colours with at least that share of a picture, the largest first, their mean colour.

    pixels: img, argb. Buckets are twelve hues of 30 degrees, black, white and grey.
    """
    from pyspark.sql import Window

    x = to_hsl(F.col("argb"))
    bucket = F.when(x["l"] < 0.12, "BLACK").when(x["l"] > 0.92, "WHITE").when(x["s"] < 0.12, "GREY").otherwise(F.concat(F.lit("H"), F.floor(x["h"] / 30).cast("string")))
    r, g, b = channels(F.col("argb"))
    counts = pixels.groupBy("img", bucket.alias("bucket")).agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for c, k in zip((r, g, b), "rgb", strict=True)])
    own = Window.partitionBy("img")
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(own)).where(F.col("share") >= least)
    out = out.withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "bucket"))).where(F.col("place") <= most)
    byte = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    return out.select("img", "bucket", "share", "place", (F.lit(0xFF000000) + byte("r") * 65536 + byte("g") * 256 + byte("b")).alias("argb"))


def uncertainty(scores: Column, temperature: float = 0.65, k: int = 10) -> Column:
    """struct<top, entropy, margin, calibrated> of a row's class scores: a softmax over the k largest, its entropy over
    ln k, the distance of the first two, and the first, lowered where the entropy is high."""
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    best = F.get(top, F.lit(0))
    raw = F.transform(top, lambda x: F.exp((x - best) / temperature))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    p = F.transform(raw, lambda x: x / total)
    entropy = F.aggregate(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b) / F.ln(F.greatest(F.size(top), F.lit(2)).cast("double"))
    first = F.get(p, F.lit(0))
    return F.struct(first.alias("top"), entropy.alias("entropy"), (first - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).alias("margin"), (first * (1 - 0.35 * entropy)).alias("calibrated"))


def profile(lum: np.ndarray) -> dict[str, float]:
    """Statistics of one grey picture (values 0 to 255)."""
    h, w = lum.shape
    q = np.minimum((lum / 256 * LEVELS).astype(int), LEVELS - 1)
    pairs = np.zeros((LEVELS, LEVELS))
    np.add.at(pairs, (q[:, :-1].ravel(), q[:, 1:].ravel()), 1)
    np.add.at(pairs, (q[:-1].ravel(), q[1:].ravel()), 1)
    pairs /= max(pairs.sum(), 1)
    i, j = np.indices(pairs.shape)
    mi, mj = (i * pairs).sum(), (j * pairs).sum()
    si, sj = np.sqrt(((i - mi) ** 2 * pairs).sum()), np.sqrt(((j - mj) ** 2 * pairs).sum())
    dx, dy = np.abs(np.diff(lum, axis=1)), np.abs(np.diff(lum, axis=0))
    d1, d2 = np.abs(lum[1:, 1:] - lum[:-1, :-1]), np.abs(lum[1:, :-1] - lum[:-1, 1:])
    energy = np.array([x.mean() if x.size else 0.0 for x in (dx, dy, d1, d2)])
    energy /= max(energy.sum(), 1e-9)
    rows, columns = lum.mean(axis=1), lum.mean(axis=0)
    within = lum.var() or 1.0
    return {
        "contrast": min(float(((i - j) ** 2 * pairs).sum()), 60.0), "homogeneity": float((pairs / (1 + np.abs(i - j))).sum()), "energy": float((pairs**2).sum()),
        "correlation": float(((i - mi) * (j - mj) * pairs).sum() / (si * sj)) if si * sj > 0 else 0.0,
        "gradient_x": float(energy[0]), "gradient_y": float(energy[1]), "anisotropy": float(energy.max() - energy.min()),
        "edges": float((np.concatenate([dx.ravel(), dy.ravel()]) > 32).mean()), "row_separation": float(rows.var() / within), "column_separation": float(columns.var() / within),
        "period": float(first_period(columns)),
    }


def first_period(line: np.ndarray) -> int:
    """The first lag from 3 to half the length with an autocorrelation over 0.55; 0 if there is none."""
    x = line - line.mean()
    if (power := float((x * x).sum())) == 0:
        return 0
    for lag in range(3, len(x) // 2 + 1):
        if float((x[:-lag] * x[lag:]).sum()) / power > 0.55:
            return lag
    return 0


_FIELDS = "contrast homogeneity energy correlation gradient_x gradient_y anisotropy edges row_separation column_separation period".split()


def profiles(rasters: DataFrame, id: str = "id") -> DataFrame:
    """id and the statistics of each raster (id, lum array<double>, w): one picture at a time, in batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [profile(np.asarray(v, dtype=float).reshape(-1, int(w))) for v, w in zip(b["lum"], b["w"], strict=True)]
            yield pd.concat([b[[id]].reset_index(drop=True), pd.DataFrame(rows, columns=_FIELDS)], axis=1)

    return rasters.select(id, "lum", "w").mapInPandas(run, f"{id} {rasters.schema[id].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in _FIELDS))


def grey_grids(embeddings: DataFrame) -> DataFrame:
    """id, lum, w: the 64 numbers of a vector as a grey picture of 8 by 8, from 0 to 255."""
    low, high = F.array_min("embedding"), F.array_max("embedding")
    lum = F.transform("embedding", lambda x: F.when(high == low, 0.0).otherwise((x.cast("double") - low) / (high - low) * 255.0))
    return embeddings.where(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), lum.alias("lum"), F.lit(8).alias("w"))


def tiles(w: Column, h: Column, side: int) -> Column:
    """array<struct<x, y>>: the corners of the tiles that fit, without overlap."""
    xs, ys = F.sequence(F.lit(0), w - side, F.lit(side)), F.sequence(F.lit(0), h - side, F.lit(side))
    both = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.when((w >= side) & (h >= side), both).otherwise(F.array().cast("array<struct<x:int,y:int>>"))


# The names of colour buckets (twelve hues, black, white, grey), and what a category is used for.
BUCKET_NAMES = ("RED", "ORANGE", "YELLOW", "GOLD", "GREEN", "TEAL", "TEAL", "BLUE", "INDIGO", "PURPLE", "PINK", "PINK", "BLACK", "CREAM", "GREY")
USES = (
    (("KENTE", "KENTE_PRINT"), ("CEREMONY", "FESTIVAL", "WEDDING")),
    (("ADINKRA",), ("MOURNING", "CEREMONY")),
    (("WAX", "ANKARA"), ("EVERYDAY", "CHURCH", "PARTY")),
    (("BATIK", "TIEDYE"), ("EVERYDAY", "PARTY")),
    (("LACE",), ("WEDDING", "CHURCH")),
    (("BROCADE",), ("WEDDING", "CEREMONY")),
    (("SILK", "CHIFFON"), ("WEDDING", "PARTY")),
    (("VELVET",), ("PARTY", "CEREMONY")),
    (("DENIM", "LINEN", "COTTON_PLAIN", "WOOL"), ("EVERYDAY", "OFFICE")),
    (("FUGU", "GONJA"), ("FESTIVAL", "CEREMONY", "EVERYDAY")),
)


def bucket_name(bucket: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, BUCKET_NAMES)), bucket), F.lit("GREY"))


def earth_tone(argb: Column) -> Column:
    """A warm brown: red leads, blue is least, and it is neither grey nor light."""
    r, g, b = channels(argb)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return (r == top) & (b == low) & (top - low >= 40) & (top <= 210)


def uses_of(category: Column) -> Column:
    out = F.array(F.lit("EVERYDAY"))
    for names, uses in USES:
        out = F.when(category.isin(list(names)), F.array(*map(F.lit, uses))).otherwise(out)
    return out


def print_traits(pattern: Column, contrast: Column, motif: Column, colors: Column, strips: Column) -> Column:
    """array<string>: contrast, scale, colours, direction and strips of a print."""
    return F.array_compact(F.array(
        F.when(contrast > 0.45, "HIGH_CONTRAST").otherwise("LOW_CONTRAST"), F.when(motif > 0.6, "LARGE_SCALE").when(motif < 0.35, "SMALL_REPEAT"), F.when(colors >= 4, "MULTICOLOUR").when(colors <= 2, "TWO_TONE"),
        F.when(pattern.isin("STRIPED", "CHECKED", "GRADIENT"), "DIRECTIONAL").otherwise("ALL_OVER"), F.when(strips > 0.5, "WOVEN_STRIPS"),
    ))


def pattern_rule(separation: Column | None = None, colors: Column | None = None, side: Column | None = None) -> Column:
    """struct<pattern, confidence, scale> from a row's lum_std, separation, edges, colors, contrast, brightness, dark, row_period, column_period,
    h_period, v_period, hue_spread and side: the first rule that holds. The thresholds are fixed values; columns that are given take the place of the row's."""
    given = {"separation": separation, "colors": colors, "side": side}
    c = lambda name: F.col(name) if given.get(name) is None else given[name]
    both = (c("h_period") > 0) & (c("v_period") > 0)
    length = F.when(both, F.least("h_period", "v_period") * 2.0).when(c("h_period") > 0, c("h_period") * 2.0).when(c("v_period") > 0, c("v_period") * 2.0).when(c("row_period") > 0, c("row_period") * 1.0).when(c("column_period") > 0, c("column_period") * 1.0)
    scale = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(length / c("side"), F.lit(0.5))))
    rules = [
        (c("lum_std") < 9, "SOLID", 0.85, F.lit(0.1)), (both & (F.abs(c("h_period") - c("v_period")) <= 0.35 * F.greatest("h_period", "v_period")), "CHECKED", 0.7, scale),
        ((c("h_period") > 0) | (c("v_period") > 0) | (c("separation") > 2.6), "STRIPED", 0.8, scale), ((c("edges") < 0.02) & (c("lum_std") > 14), "GRADIENT", 0.75, F.lit(0.9)),
        ((c("row_period") > 0) & (c("column_period") > 0) & (scale < 0.3), "DOTTED", 0.6, scale),
        ((c("contrast") > 0.45) & (c("colors") <= 3) & c("dark").between(0.08, 0.45) & (c("brightness") > 0.4), "SYMBOLIC", 0.55, scale),
        ((c("colors") >= 3) & (c("edges") > 0.08), "GEOMETRIC", 0.55, scale), ((c("colors") >= 4) & (c("hue_spread") > 0.4), "FLORAL", 0.5, scale), (c("edges") > 0.04, "ORGANIC", 0.45, scale),
    ]
    return _first(rules, ("ABSTRACT", 0.4, scale), ("pattern", "confidence", "scale"))


def _first(rules: list, otherwise: tuple, names: tuple) -> Column:
    """A struct of the values of the first rule (condition, values) that holds."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = lambda values: F.struct(*[value(v).alias(n) for v, n in zip(values, names, strict=True)])
    out = made(otherwise)
    for condition, *values in reversed(rules):
        out = F.when(condition, made(values)).otherwise(out)
    return out


def texture_rule(noise: Column, contrast: Column, edges: Column, brightness: Column, saturation: Column) -> Column:
    """The texture by noise, co-occurrence contrast, edges, brightness and saturation: the first rule that holds. The thresholds are fixed values."""
    return (
        F.when(noise > 7, "SLUB").when((contrast > 14) | (noise > 4), "WOVEN").when(edges > 0.12, "EMBROIDERED").when((brightness < 0.25) & (saturation > 0.35), "PILE")
        .when((brightness > 0.75) & (saturation < 0.2), "SHEER").otherwise("SMOOTH")
    )


def category_rule(pattern: Column, texture: Column, colors: Column, saturation: Column, contrast: Column, brightness: Column, earth: Column, indigo: Column, strips: Column, bands: Column) -> Column:
    """struct<category, confidence>: the first rule that holds. earth, indigo: whether a colour is an earth tone, or blue or indigo. The thresholds are fixed values."""
    striped = pattern == "STRIPED"
    muted = striped & colors.between(2, 3) & (saturation < 0.45)
    dyed = (pattern == "GRADIENT") | ((pattern == "ORGANIC") & (contrast < 0.35))
    vivid = pattern.isin("FLORAL", "ORGANIC", "GEOMETRIC") & (saturation > 0.5)
    solid = pattern == "SOLID"
    rules = [
        (muted & earth & (contrast > 0.45), "GONJA", 0.5), (muted, "FUGU", 0.48), (striped & (colors >= 4) & (saturation > 0.38), "KENTE", F.least(0.55 + 0.2 * strips, F.lit(0.78))),
        (striped & (colors >= 3) & (strips > 0.5) & (bands >= 3), "KENTE", 0.55), (striped & (colors >= 3), "KENTE_PRINT", 0.5), (pattern == "SYMBOLIC", "ADINKRA", 0.55),
        (dyed & (saturation > 0.4), "TIEDYE", 0.48), (dyed, "BATIK", 0.5), (vivid & (colors >= 5), "ANKARA", 0.55), (vivid, "WAX", 0.6), (indigo & texture.isin("SLUB", "WOVEN") & (saturation < 0.5), "DENIM", 0.5),
        (solid & (saturation < 0.18), "COTTON_PLAIN", 0.6), (solid & (texture == "SLUB"), "LINEN", 0.55), (solid & (brightness < 0.3) & (saturation > 0.35), "VELVET", 0.45), (solid & (saturation > 0.4), "SILK", 0.45),
        (solid, "COTTON_PLAIN", 0.42),
    ]
    return _first(rules, ("UNKNOWN", 0.3), ("category", "confidence"))


def placement_of(placement: Column, variation: Column) -> Column:
    """Where fabric goes in a variation: the first one as asked, the others differ where it is everywhere."""
    other = F.when(variation % 3 == 1, "PANELS").when(variation % 3 == 2, "ACCENTS").otherwise("TOP_ONLY")
    return F.when((variation > 0) & (placement == "FULL"), other).otherwise(placement)


def has_fabric(placement: Column, shape: Column, centre_y: Column) -> Column:
    """Whether a garment's shape (its number, and the height of its centre, 0 to 1) is made of the fabric."""
    return F.when(placement == "FULL", True).when(placement == "TOP_ONLY", centre_y < 0.5).when(placement == "SKIRT_ONLY", centre_y >= 0.5).when(placement == "PANELS", shape % 2 == 0).otherwise(False)
