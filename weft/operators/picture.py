"""What is seen in pictures: statistics of whole rasters in numpy, many at a time, and the rules that name pattern, texture and category from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.color import channels, undertone
from weft.operators import raster

# Thresholds and weights of the statistics.
LEVELS, EDGE, DARK, HUED, PEAK, STEP = 16, 32.0, 70.0, 10, 0.55, 7
LEAST_SHARE, MOST_COLORS, BAND_SHARE, BAND_EDGE, MOST_WAVES = 0.07, 4, 0.08, 36.0, 32
FLAT = {"energy_0": 0.25, "energy_45": 0.25, "energy_90": 0.25, "energy_135": 0.25, "angle": 0.0, "anisotropy": 0.0, "warp_weft": 0.5}
TOLERANCE = 44

_NUMBERS = (
    "saturation brightness lum_std contrast row_separation column_separation row_period column_period h_period v_period edges dark hue_spread noise "
    "glcm_contrast glcm_homogeneity glcm_energy glcm_correlation energy_0 energy_45 energy_90 energy_135 angle anisotropy warp_weft "
    "strip_score strip_period strip_bands strip_edges repeat_x repeat_y harmonic_purity luma_warp_weft luma_anisotropy repeat_strength"
).split()
_COLOR = pa.struct([("bucket", pa.int32()), ("share", pa.float64()), ("argb", pa.int64())])
SCHEMA = ", ".join(f"{n} double" for n in _NUMBERS) + ", strip_along_x boolean, colors array<struct<bucket: int, share: double, argb: bigint>>"


def autocorrelation(lines: np.ndarray, lag: int) -> np.ndarray:
    """Of each line (centred), the products with itself lag further on, over its power."""
    power = (lines * lines).sum(-1)
    return (lines[..., : lines.shape[-1] - lag] * lines[..., lag:]).sum(-1) / np.where(power < 1e-3, np.inf, power)


def first_period(profile: np.ndarray) -> np.ndarray:
    """The first lag from 3 to half the length whose autocorrelation is over PEAK; 0 without one, and for profiles of fewer than 8."""
    n, found = profile.shape[-1], np.zeros(profile.shape[:-1])
    if n < 8:
        return found
    centred = profile - profile.mean(-1, keepdims=True)
    for lag in range(n // 2, 2, -1):
        found = np.where(autocorrelation(centred, lag) > PEAK, lag, found)
    return found


def best_lag(profile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lag from 3 to half the length with the highest autocorrelation, and that, 0 to 1; zeros for profiles of fewer than 8 or without variation."""
    n = profile.shape[-1]
    lag_of, best = np.zeros(profile.shape[:-1]), np.zeros(profile.shape[:-1])
    if n // 2 < 4:
        return lag_of, best
    centred = profile - profile.mean(-1, keepdims=True)
    for lag in range(3, n // 2 + 1):
        c = autocorrelation(centred, lag)
        lag_of, best = np.where(c > best, lag, lag_of), np.maximum(best, c)
    return lag_of, np.minimum(best, 1.0)


def grid_period(lum: np.ndarray, axis: int) -> np.ndarray:
    """The repeat along axis (1: down, 2: right) from every STEP-th pixel: the first lag from 2 to half the side where the autocorrelation is a local peak over PEAK; 0 without one."""
    side = lum.shape[axis]
    most = side // 2
    found = np.zeros(len(lum))
    if most < 3:
        return found
    centred = np.moveaxis(lum - lum.mean((1, 2), keepdims=True), axis, 2)[:, ::STEP]  # the other axis in steps
    power = (centred[:, :, ::STEP] ** 2).sum((1, 2))
    corr = np.zeros((len(lum), most + 2))
    for lag in range(1, most + 1):
        at = np.arange(0, side - lag, STEP)
        corr[:, lag] = (centred[:, :, at] * centred[:, :, at + lag]).sum((1, 2)) / np.where(power < 1e-3, np.inf, power)
    for lag in range(most, 1, -1):
        peak = (corr[:, lag] > PEAK) & (corr[:, lag] >= corr[:, lag - 1]) & ((lag == most) | (corr[:, lag] >= corr[:, lag + 1]))
        found = np.where(peak, lag, found)
    return found


def separation(lum: np.ndarray, axis: int) -> np.ndarray:
    """Variance between lines' means over the mean variance within lines (1 at least); axis 2: rows, 1: columns."""
    means = lum.mean(axis)
    if means.shape[-1] < 4:
        return np.zeros(len(lum))
    return means.var(-1) / np.maximum(lum.var(axis).mean(-1), 1.0)


def cooccurrence(lum: np.ndarray) -> dict[str, np.ndarray]:
    """Contrast (up to 60), homogeneity, energy and correlation of LEVELS grey levels, over neighbours right and down, in both orders."""
    n, h, w = lum.shape
    if h < 2 or w < 2:
        return {"glcm_contrast": np.zeros(n), "glcm_homogeneity": np.ones(n), "glcm_energy": np.ones(n), "glcm_correlation": np.zeros(n)}
    q = np.clip((lum / 256 * LEVELS).astype(np.int64), 0, LEVELS - 1)
    a = np.concatenate([q[:, :-1, :-1].reshape(n, -1)] * 2, axis=1)
    b = np.concatenate([q[:, :-1, 1:].reshape(n, -1), q[:, 1:, :-1].reshape(n, -1)], axis=1)
    cells = (np.arange(n)[:, None] * LEVELS + a) * LEVELS + b
    p = np.bincount(cells.ravel(), minlength=n * LEVELS * LEVELS).reshape(n, LEVELS, LEVELS).astype(float)
    p = (p + p.transpose(0, 2, 1)) / (2.0 * a.shape[1])
    i, j = np.indices((LEVELS, LEVELS))
    total = lambda x: (x * p).sum((1, 2))
    mean = total(i)
    spread = total((i - mean[:, None, None]) ** 2)  # the same for both, p is symmetric
    together = total((i - mean[:, None, None]) * (j - mean[:, None, None]))
    return {
        "glcm_contrast": np.minimum(total((i - j) ** 2), 60.0), "glcm_homogeneity": np.clip(total(1 / (1 + (i - j) ** 2)), 0, 1), "glcm_energy": np.clip((p * p).sum((1, 2)), 0, 1),
        "glcm_correlation": np.clip(np.where(np.sqrt(spread) > 1e-6, together / np.where(spread > 0, spread, 1), 0), -1, 1),
    }


def directions(lum: np.ndarray) -> dict[str, np.ndarray]:
    """Shares of gradient energy across 0, 45, 90 and 135 degrees, the angle of the largest, its lead over the least, and the share of 0 and 90."""
    n, h, w = lum.shape
    if h < 4 or w < 4:
        return {k: np.full(n, v) for k, v in FLAT.items()}
    down, right = (lum[:, 2:, 1:-1] - lum[:, :-2, 1:-1]) * 0.5, (lum[:, 1:-1, 2:] - lum[:, 1:-1, :-2]) * 0.5
    main, anti = (lum[:, 2:, 2:] - lum[:, :-2, :-2]) * 0.3535, (lum[:, 2:, :-2] - lum[:, :-2, 2:]) * 0.3535
    energy = np.stack([(x * x).sum((1, 2)) for x in (down, main, right, anti)], axis=1)
    total = np.maximum(energy.sum(1), 1e-6)
    share = energy / total[:, None]
    top, low = share.max(1), share.min(1)
    return {
        "energy_0": share[:, 0], "energy_45": share[:, 1], "energy_90": share[:, 2], "energy_135": share[:, 3], "angle": share.argmax(1) * 45.0,
        "anisotropy": np.where(total < 1, 0.0, np.clip((top - low) / np.maximum(top + low, 1e-5), 0, 1)), "warp_weft": np.where(total < 1, 0.5, np.clip(share[:, 0] + share[:, 2], 0, 1)),
    }


def purity(profile: np.ndarray) -> np.ndarray:
    """The largest power of a wave over that of all, for 1 to 32 waves a profile; 0 for profiles of fewer than 8 or without power."""
    n = profile.shape[-1]
    if n < 8:
        return np.zeros(profile.shape[:-1])
    k = np.arange(1, min(n // 2, MOST_WAVES) + 1)
    angle = 2 * np.pi * np.outer(np.arange(n), k) / n
    centred = profile - profile.mean(-1, keepdims=True)
    power = (centred @ np.cos(angle)) ** 2 + (centred @ np.sin(angle)) ** 2
    total = power.sum(-1)
    return np.where(total < 1e-3, 0.0, np.clip(power.max(-1) / np.where(total > 0, total, 1), 0, 1))


def hsl(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees (-1 without one), saturation and lightness of channels from 0 to 255."""
    r, g, b = (rgb[..., c] / 255.0 for c in range(3))
    top, low = np.maximum(r, np.maximum(g, b)), np.minimum(r, np.minimum(g, b))
    light, d = (top + low) / 2, top - low
    safe = np.where(d == 0, 1, d)
    sixth = np.where(top == r, (g - b) / safe, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(d == 0, -1.0, np.where((top == r) & (sixth < 0), sixth + 6, sixth) * 60)
    return hue, np.where(d == 0, 0.0, d / np.maximum(1 - np.abs(2 * light - 1), 1e-4)), light


def hue_families(hue: np.ndarray, sat: np.ndarray, light: np.ndarray) -> np.ndarray:
    """0 gold, 1 green, 2 red, 3 blue, 4 black, 5 neutral. The bounds are fixed values."""
    hued = np.select([(hue < 20) | (hue >= 340), hue < 70, hue < 170, hue < 270], [2, 0, 1, 3], 2)
    return np.where(light < 0.18, 4, np.where(sat < 0.2, 5, hued))


def strips(lum: np.ndarray, families: np.ndarray) -> dict[str, np.ndarray]:
    """How much a picture looks like woven strips: periodic along one axis, of more than two hues, with sharp edges. The weights are fixed values."""
    n, h, w = lum.shape
    bands = sum(((families == f).reshape(n, -1).mean(1) >= BAND_SHARE).astype(float) for f in range(5))
    (lag_x, x), (lag_y, y) = best_lag(lum.mean(1)), best_lag(lum.mean(2))
    along_x = x >= y
    period, strength = np.where(along_x, lag_x, lag_y), np.maximum(x, y)
    inner = lum[:, 1 : max(h - 1, 1) : 2, 1 : max(w - 1, 1) : 2]
    if inner.size:
        right, below = lum[:, 1 : h - 1 : 2, 2:w:2], lum[:, 2:h:2, 1 : w - 1 : 2]
        share = lambda other: (np.abs(inner - other) > BAND_EDGE).reshape(n, -1).mean(1)
        edges = np.where(along_x, share(right), share(below))
    else:
        edges = np.zeros(n)
    periodic = np.where((strength > PEAK) & (period > 0), (strength - PEAK) / 0.45, 0.0)
    score = 0.35 * periodic + 0.45 * np.clip(bands - 2, 0, 2) / 2 + 0.2 * np.clip(edges / 0.3, 0, 1)
    return {"strip_score": np.clip(score, 0, 1), "strip_period": period, "strip_bands": bands, "strip_edges": edges, "strip_along_x": along_x}


def main_colors(rgb: np.ndarray, hue: np.ndarray, sat: np.ndarray, lum: np.ndarray) -> list[list[dict]]:
    """Of each picture the colours with LEAST_SHARE of it or more, at most MOST_COLORS, the largest first: bucket (twelve hues, black, white, grey), share, mean argb."""
    n = len(rgb)
    bucket = np.where(lum < 45, 12, np.where(sat < 0.16, np.where(lum > 205, 13, 14), np.clip((hue / 30).astype(np.int64), 0, 11))).reshape(n, -1)
    cells = (np.arange(n)[:, None] * 15 + bucket).ravel()
    count = np.bincount(cells, minlength=n * 15).reshape(n, 15).astype(np.int64)
    mean = [np.bincount(cells, rgb[..., c].ravel(), minlength=n * 15).reshape(n, 15).astype(np.int64) // np.maximum(count, 1) for c in range(3)]
    argb = (255 << 24) + (mean[0] << 16) + (mean[1] << 8) + mean[2]
    out = []
    for i in range(n):
        order = [b for b in np.argsort(-count[i], kind="stable")[:MOST_COLORS].tolist() if count[i, b] / bucket.shape[1] >= LEAST_SHARE]
        out.append([{"bucket": b, "share": count[i, b] / bucket.shape[1], "argb": int(argb[i, b])} for b in order])
    return out


def measured(rgb: np.ndarray) -> dict[str, np.ndarray | list]:
    """All statistics of a stack of pictures of one size (pictures, rows, columns, channels from 0 to 255)."""
    n, h, w, _ = rgb.shape
    hue, sat, light = hsl(rgb)
    lum = light * 255
    luma = rgb @ np.array([0.299, 0.587, 0.114])
    std = lum.std((1, 2))
    out: dict[str, np.ndarray | list] = {
        "saturation": np.clip(sat.mean((1, 2)), 0, 1), "brightness": np.clip(lum.mean((1, 2)) / 255, 0, 1), "lum_std": std, "contrast": np.clip(std / 90, 0, 1),
        "row_separation": separation(lum, 2), "column_separation": separation(lum, 1), "row_period": first_period(lum.mean(2)), "column_period": first_period(lum.mean(1)),
        "h_period": grid_period(lum, 2), "v_period": grid_period(lum, 1), "dark": (lum < DARK).mean((1, 2)),
    }
    corner = lum[:, :-1, :-1]
    jumps = [np.abs(corner - lum[:, :-1, 1:]) > EDGE, np.abs(corner - lum[:, 1:, :-1]) > EDGE]
    out["edges"] = np.mean([j.reshape(n, -1).mean(1) for j in jumps], axis=0) if corner.size else np.zeros(n)
    hued = hue >= 0
    spread = np.where(hued, hue, -np.inf).max((1, 2)) - np.where(hued, hue, np.inf).min((1, 2))
    out["hue_spread"] = np.where(hued.sum((1, 2)) < HUED, 0.0, spread / 360)
    if h > 2 and w > 2:
        y, x = slice(1, h - 1, 2), slice(1, w - 1, 2)
        here = lum[:, y, x]
        blur = (lum[:, y, 0 : w - 2 : 2] + lum[:, y, 2:w:2] + lum[:, 0 : h - 2 : 2, x] + lum[:, 2:h:2, x] + here) / 5
        out["noise"] = np.abs(here - blur).mean((1, 2))
    else:
        out["noise"] = np.zeros(n)
    out |= cooccurrence(lum) | directions(lum) | strips(lum, hue_families(hue, sat, light))
    of_luma = directions(luma)
    (repeat_x, x), (repeat_y, y) = best_lag(luma.mean(1)), best_lag(luma.mean(2))
    waves = np.where(x >= y, purity(luma.mean(1)), purity(luma.mean(2)))
    out |= {"repeat_x": repeat_x, "repeat_y": repeat_y, "repeat_strength": np.maximum(x, y), "harmonic_purity": waves, "luma_warp_weft": of_luma["warp_weft"], "luma_anisotropy": of_luma["anisotropy"]}
    out["colors"] = main_colors(rgb, hue, sat, lum)
    return out


def statistics(rasters: DataFrame, id: str = "id", most: int = 1 << 22) -> DataFrame:
    """id, w, h and all statistics of each raster.

    rasters: id, argb (array of numbers, row by row), w. Pictures of one size are measured together, `most` pixels at a time, so memory follows neither the number of rows nor of
    pictures; nothing is shuffled. The last row counts if it is whole. A raster without pixels, or with a null among them, has null statistics.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: dict[tuple[int, int], list[int]] = {}
            pixels = batch.column(1)
            for i, w in enumerate(batch.column(2).to_pylist()):
                given = pixels[i]
                n = len(given.values) if given.is_valid and not given.values.null_count else 0
                sizes.setdefault((n // w, w) if n and w and w > 0 and n >= w else (0, 0), []).append(i)
            for (h, w), rows in sizes.items():
                step = max(1, most // max(h * w, 1))
                for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                    yield told(batch, some, h, w, pixels)

    def told(batch: pa.RecordBatch, some: list[int], h: int, w: int, pixels: pa.Array) -> pa.RecordBatch:
        if h:
            argb = np.stack([pixels[i].values.to_numpy(zero_copy_only=False)[: h * w] for i in some]).astype(np.int64).reshape(-1, h, w)
            found = measured(np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(float))
        else:
            found = dict.fromkeys([*_NUMBERS, "strip_along_x", "colors"], [None] * len(some))
        arrays = [batch.column(0).take(pa.array(some)), pa.array([w or None] * len(some), pa.int32()), pa.array([h or None] * len(some), pa.int32())]
        arrays += [pa.array(found[k], pa.float64()) for k in _NUMBERS]
        arrays += [pa.array(found["strip_along_x"], pa.bool_()), pa.array(found["colors"], pa.list_(_COLOR))]
        return pa.RecordBatch.from_arrays(arrays, [id, "w", "h", *_NUMBERS, "strip_along_x", "colors"])

    kind = rasters.schema[id].dataType.simpleString()
    return rasters.select(id, F.col("argb").cast("array<bigint>"), F.col("w").cast("int")).mapInArrow(run, f"{id} {kind}, w int, h int, {SCHEMA}")


def alignment() -> Column:
    """How to lay a cut, from a row's statistics: the first rule that holds. Fixed values."""
    c = F.col
    return (
        F.when((c("strip_score") >= 0.48) | ((c("repeat_strength") > 0.65) & (c("luma_warp_weft") > 0.62)), "MATCH_WARP_STRIPS")
        .when(F.greatest("repeat_x", "repeat_y") >= F.least("w", "h") * 0.25, "CENTER_LARGE_MOTIF").when(c("luma_anisotropy") > 0.55, "DIRECTIONAL_NAP").otherwise("FREE_CUT")
    )


def signatures(rasters: DataFrame, id: str = "id") -> DataFrame:
    """Statistics with what they mean: pattern, pattern_confidence, motif_scale, texture, category, category_confidence, color_names, traits, uses,
    strip_width and advice. The rules are columns over statistics(), so only the numbers come from Python."""
    x = statistics(rasters, id).withColumn("n_colors", F.greatest(F.size("colors"), F.lit(1)))
    rule = raster.pattern_rule(separation=F.greatest("row_separation", "column_separation"), colors=F.col("n_colors"), side=F.least("w", "h"))
    x = x.withColumn("p", rule).withColumns({"pattern": F.col("p.pattern"), "pattern_confidence": F.col("p.confidence"), "motif_scale": F.col("p.scale")}).drop("p")
    x = x.withColumn("texture", raster.texture_rule(F.col("noise"), F.col("glcm_contrast"), F.col("edges"), F.col("brightness"), F.col("saturation")))
    x = x.withColumn("color_names", F.transform("colors", lambda c: raster.bucket_name(c["bucket"])))
    earth = F.exists("colors", lambda c: raster.earth_tone(c["argb"]))
    blue = F.arrays_overlap("color_names", F.array(F.lit("INDIGO"), F.lit("BLUE")))
    rule = raster.category_rule(F.col("pattern"), F.col("texture"), F.col("n_colors"), F.col("saturation"), F.col("contrast"), F.col("brightness"), earth, blue, F.col("strip_score"), F.col("strip_bands"))
    x = x.withColumn("c", rule).withColumns({"category": F.col("c.category"), "category_confidence": F.col("c.confidence")}).drop("c")
    traits = raster.print_traits(F.col("pattern"), F.col("contrast"), F.col("motif_scale"), F.col("n_colors"), F.col("strip_score"))
    x = x.withColumns({"traits": traits, "uses": raster.uses_of(F.col("category")), "strip_width": F.col("strip_period") / 2, "advice": alignment()})
    said = ["pattern", "pattern_confidence", "motif_scale", "texture", "category", "category_confidence", "color_names", "traits", "uses", "strip_width", "advice"]
    return x.withColumns({c: F.when(F.col("h").isNotNull(), F.col(c)) for c in said})


# ---- background removal


def border_median(rgb: np.ndarray) -> np.ndarray:
    """The upper median of each channel along a picture's border, corners twice."""
    edge = np.concatenate([rgb[0], rgb[-1], rgb[:, 0], rgb[:, -1]])
    return np.sort(edge, axis=0)[len(edge) // 2]


def largest_component(on: np.ndarray) -> np.ndarray:
    """The largest set of pixels that hang together by their sides; of equal ones that with the first pixel.

    Union-find over the runs of each row: a run joins those of the row above that it overlaps.
    """
    h, w = on.shape
    steps = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, start), end = np.nonzero(steps == 1), np.nonzero(steps == -1)[1]
    if not len(row):
        return np.zeros_like(on)
    parent = np.arange(len(row))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([top(i) for i in range(len(row))])
    best = np.bincount(roots, end - start).argmax()  # the first of equal ones, which has the first run
    out = np.zeros_like(on)
    for i in np.flatnonzero(roots == best).tolist():
        out[row[i], start[i] : end[i]] = True
    return out


def cut_out(argb: np.ndarray, tolerance: int = TOLERANCE) -> np.ndarray:
    """A picture with alpha 255 on its subject and 0 elsewhere: the largest connected part of what differs from the border's colour by more than three tolerances in all. Pictures under
    3 by 3 are as they were."""
    if min(argb.shape) < 3:
        return argb
    rgb = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1)
    kept = largest_component(np.abs(rgb - border_median(rgb)).sum(-1) > 3 * tolerance)
    return np.where(kept, argb | 0xFF000000, argb & 0xFFFFFF)


def without_background(rasters: DataFrame, id: str = "id", tolerance: int = TOLERANCE) -> DataFrame:
    """rasters (id, argb, w) with argb cut out. A raster that is no whole number of rows, has no pixels or a null among them, is as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pixels, w in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = pixels.is_valid and not pixels.values.null_count and w and w > 0 and len(pixels.values) and len(pixels.values) % w == 0
                out.append(cut_out(pixels.values.to_numpy(zero_copy_only=False).reshape(-1, w), tolerance).ravel() if whole else pixels.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), batch.column(2)], [id, "argb", "w"])

    kind = rasters.schema[id].dataType.simpleString()
    return rasters.select(id, F.col("argb").cast("array<bigint>"), F.col("w").cast("int")).mapInArrow(run, f"{id} {kind}, argb array<bigint>, w int")


# ---- masked regions


def behind(argb: Column, mask: Column) -> Column:
    """The pixels where the mask is at most 128, or ends before them; those of the subject without alpha. argb: array<bigint>."""
    return F.transform(argb, lambda p, i: F.when(F.coalesce(F.get(mask, i), F.lit(0)) <= 128, p).otherwise(p.bitwiseAND(F.lit(0xFFFFFF).cast("long"))))


def likely_skin(r: Column, g: Column, b: Column) -> Column:
    """Whether a colour may be skin, by its luma and chroma. Fixed values."""
    luma = r * 0.299 + g * 0.587 + b * 0.114
    cb, cr = 128 - r * 0.168736 - g * 0.331264 + b * 0.5, 128 + r * 0.5 - g * 0.418688 - b * 0.081312
    return (luma >= 28) & (luma <= 242) & cb.between(77, 135) & cr.between(130, 178) & (r >= g) & (g >= b - 12)


#: What a region's number means.
REGIONS = ("BACKGROUND", "HEAD_AND_FACE", "UPPER_GARMENT", "LOWER_GARMENT", "SKIN_EXPOSED")


def body_regions(rasters: DataFrame) -> DataFrame:
    """rasters (argb, mask: arrays of one length, w) with regions (array of REGIONS' numbers), skin_argb (mean colour of the skin of head and body, null without any) and undertone.

    The person is where the mask is over 128; of the rows from its first to its last, the head ends after 22 %, the trunk after 58 %. A picture whose person has fewer than two
    rows is all background, without skin.
    """
    c = F.col
    row = lambda i: F.floor(i / c("w"))
    rows = F.filter(F.transform("mask", lambda m, i: F.when(m > 128, row(i))), lambda y: y.isNotNull())
    x = rasters.withColumn("__weft_rows", rows).withColumns({"__weft_top": F.array_min("__weft_rows"), "__weft_end": F.array_max("__weft_rows")})
    tall = c("__weft_end") - c("__weft_top")
    cut = lambda part: c("__weft_top") + F.floor(tall * part + 0.5)
    x = x.withColumns({"__weft_head": cut(0.22), "__weft_trunk": cut(0.58)})

    def region(p: Column, i: Column) -> Column:
        skin = likely_skin(*channels(p))
        named = F.when(row(i) <= c("__weft_head"), 1).when(row(i) > c("__weft_trunk"), 3).when(skin, 4).otherwise(2)
        return F.when((F.get("mask", i) > 128) & (tall > 0), named).otherwise(0)

    x = x.withColumn("regions", F.transform("argb", region))
    seen = F.filter("argb", lambda p, i: F.get("regions", i).isin(1, 4) & likely_skin(*channels(p)))
    x = x.withColumn("__weft_skin", F.transform(seen, lambda p: F.struct(*[v.cast("long").alias(k) for k, v in zip("rgb", channels(p), strict=True)])))
    mean = lambda k: F.floor(F.aggregate("__weft_skin", F.lit(0).cast("long"), lambda n, p: n + p[k]) / F.size("__weft_skin"))
    x = x.withColumns({f"__weft_{k}": F.when(F.size("__weft_skin") > 0, mean(k)) for k in "rgb"})
    x = x.withColumn("skin_argb", (F.lit(0xFF000000) + c("__weft_r") * 65536 + c("__weft_g") * 256 + c("__weft_b")).cast("long"))
    x = x.withColumn("undertone", F.when(c("skin_argb").isNotNull(), undertone(c("skin_argb"))))
    return x.drop("__weft_rows", "__weft_top", "__weft_end", "__weft_head", "__weft_trunk", "__weft_skin", "__weft_r", "__weft_g", "__weft_b")


# ---- garment polygons

# Where a hem ends, and the polygons that sleeves and a high neck add.
HEMS = {"MINI": 0.72, "MIDI": 0.84, "MAXI": 0.95, "FLOOR": 0.995}
SLEEVES = {
    "THREE_QUARTER": ((0.26, 0.07, 0.34, 0.07, 0.28, 0.44, 0.19, 0.42), (0.66, 0.07, 0.74, 0.07, 0.81, 0.42, 0.72, 0.44)),
    "LONG": ((0.26, 0.07, 0.34, 0.07, 0.25, 0.58, 0.17, 0.56), (0.66, 0.07, 0.74, 0.07, 0.83, 0.56, 0.75, 0.58)),
}
COLLAR = (0.42, 0.0, 0.58, 0.0, 0.60, 0.055, 0.40, 0.055)
_POLYGONS = "array<array<struct<x: double, y: double>>>"


def _polygon(numbers: tuple[float, ...]) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(numbers[::2], numbers[1::2], strict=True)])


def customised(polygons: Column, neckline: Column, sleeve: Column, length: Column) -> Column:
    """A garment's polygons (arrays of points from 0 to 1, y downwards) with a neckline, sleeves and a hem; null or other names leave that as it is.

    Each point goes through the three rules in this order, each working on what the one before has made of it.
    """
    given = F.struct(polygons.cast(_POLYGONS).alias("polygons"), neckline.alias("neckline"), sleeve.alias("sleeve"), length.alias("length"))
    return F.get(F.transform(F.array(given), lambda g: _customised(g["polygons"], g["neckline"], g["sleeve"], g["length"])), F.lit(0))  # each is computed once


def _customised(polygons: Column, neckline: Column, sleeve: Column, length: Column) -> Column:
    # the bounds and shifts of the three rules are fixed values
    hem = F.create_map(*[F.lit(v) for pair in HEMS.items() for v in pair])[length]

    def necked(p: Column) -> Column:
        x, y = p["x"], p["y"]
        wide = (neckline == "OFF_SHOULDER") & (y < 0.09)
        new_x = F.when(wide & (x < 0.4), F.greatest(x - 0.04, F.lit(0.18))).when(wide & (x > 0.6), F.least(x + 0.04, F.lit(0.82))).otherwise(x)
        new_y = F.when(neckline.isin("V_NECK", "VNECK") & (y < 0.08) & x.between(0.44, 0.56), 0.14).when(wide, 0.11).when((neckline == "BOAT") & (y < 0.08), 0.035).when((neckline == "HIGH") & (y < 0.06) & x.between(0.4, 0.6), 0.0).otherwise(y)
        return F.struct(new_x.alias("x"), new_y.alias("y"))

    def sleeved(p: Column) -> Column:
        x, y = p["x"], p["y"]
        bare, puffed = (sleeve == "SLEEVELESS") & y.between(0.04, 0.38), (sleeve == "PUFF") & y.between(0.05, 0.32)
        puff = F.when(puffed & (x < 0.38), F.greatest(x - 0.07, F.lit(0.12))).when(puffed & (x > 0.62), F.least(x + 0.07, F.lit(0.88)))
        return F.struct(F.when(bare, F.greatest(F.lit(0.36), F.least(F.lit(0.64), x))).otherwise(F.coalesce(puff, x)).alias("x"), y.alias("y"))

    def hemmed(p: Column) -> Column:
        x, y = p["x"], p["y"]
        low = hem.isNotNull() & (y > 0.48)
        t = F.least(F.lit(1.0), (y - 0.48) / 0.5)
        flared = low & (length == "FLOOR") & (t > 0.7)
        new_x = F.when(flared & (x < 0.45), F.greatest(x - 0.03, F.lit(0.10))).when(flared & (x > 0.55), F.least(x + 0.03, F.lit(0.90))).otherwise(x)
        return F.struct(new_x.alias("x"), F.when(low, F.greatest(F.lit(0.48), F.least(F.lit(0.995), t * (hem - 0.48) + 0.48))).otherwise(y).alias("y"))

    out = polygons
    each = lambda rule: lambda polygon: F.transform(polygon, rule)
    for rule in (necked, sleeved, hemmed):
        out = F.transform(out, each(rule))
    none = F.array().cast(_POLYGONS)
    more = F.when(sleeve == "LONG", F.array(*map(_polygon, SLEEVES["LONG"]))).when(sleeve == "THREE_QUARTER", F.array(*map(_polygon, SLEEVES["THREE_QUARTER"]))).otherwise(none)
    return F.concat(out, more, F.when(neckline == "HIGH", F.array(_polygon(COLLAR))).otherwise(none))
