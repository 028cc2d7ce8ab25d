"""Statistics of pictures and what they name: planted pictures, and plain loops over pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import picture

RASTER = "id long, argb array<bigint>, w int"


def grid(w, h, f):
    return [f(x, y) for y in range(h) for x in range(w)]


def shown(spark, **pictures):
    names = list(pictures)
    rows = [(i, p[0], p[1]) for i, p in enumerate(pictures.values())]
    found = {r.id: r for r in picture.signatures(spark.createDataFrame(rows, RASTER)).collect()}
    return {n: found[i] for i, n in enumerate(names)}


def test_planted_pictures_are_named(spark):
    gold, green, red, black = 0xFFC8952B, 0xFF1F5450, 0xFF8C2F39, 0xFF14110F
    bands = [gold, green, red, black]
    found = shown(
        spark,
        solid=(grid(64, 64, lambda x, y: red), 64),
        small=(grid(48, 48, lambda x, y: 0xFF4A0E1C), 48),
        stripes=(grid(96, 64, lambda x, y: black if x // 12 % 2 == 0 else gold), 96),
        checks=(grid(80, 80, lambda x, y: red if (x // 10 % 2 == 0) == (y // 10 % 2 == 0) else 0xFFFDF8F2), 80),
        kente=(grid(96, 96, lambda x, y: bands[(x // 8 + y // 16) % 4]), 96),
        fugu=(grid(96, 64, lambda x, y: [0xFF3A4250, black, 0xFFF2EFE9][x // 12 % 3]), 96),
        gonja=(grid(96, 64, lambda x, y: [0xFFB8763A, 0xFFF2EFE9][x // 12 % 2]), 96),
        weave=(grid(32, 32, lambda x, y: 0xFF222222 if x // 4 % 2 == 0 else 0xFFDDDDDD), 32),
    )
    assert found["solid"].pattern == "SOLID" and len(found["solid"].colors) <= 4 and len(found["small"].colors) == 1
    assert found["stripes"].pattern == "STRIPED" and (found["stripes"].category != "KENTE" or found["stripes"].strip_bands >= 3)
    assert found["checks"].pattern == "CHECKED" and len(found["checks"].colors) >= 2 and found["checks"].glcm_contrast > 5
    kente = found["kente"]
    assert kente.category == "KENTE" and 0.6 <= kente.category_confidence <= 0.8 and kente.strip_score > 0.5 and "WOVEN_STRIPS" in kente.traits and kente.uses == ["CEREMONY", "FESTIVAL", "WEDDING"]
    assert found["fugu"].category == "FUGU" and found["gonja"].category == "GONJA"
    weave = found["weave"]
    assert weave.repeat_x == 8 and weave.strip_width == 4 and weave.strip_along_x and weave.harmonic_purity > 0.5 and weave.advice == "CENTER_LARGE_MOTIF" and kente.advice == "MATCH_WARP_STRIPS"
    assert weave.angle == 90 and weave.anisotropy > 0.25 and all(r.pattern_confidence <= 0.85 for r in found.values())


def plain(argb, w):
    """The statistics again, by loops over pixels."""
    h = len(argb) // w
    rgb = [((p >> 16) & 255, (p >> 8) & 255, p & 255) for p in argb[: w * h]]
    hue, sat, lum = [], [], []
    for r, g, b in rgb:
        r, g, b = r / 255, g / 255, b / 255
        mx, mn = max(r, g, b), min(r, g, b)
        light, d = (mx + mn) / 2, mx - mn
        lum.append(light * 255)
        sat.append(0 if d == 0 else d / max(1 - abs(2 * light - 1), 1e-4))
        k = -1 if d == 0 else ((g - b) / d if mx == r else (b - r) / d + 2 if mx == g else (r - g) / d + 4)
        hue.append(-1 if d == 0 else (k + 6 if mx == r and k < 0 else k) * 60)
    at = lambda x, y: lum[y * w + x]
    mean = lambda v: sum(v) / len(v)
    var = lambda v: mean([(a - mean(v)) ** 2 for a in v])
    rows, cols = [[at(x, y) for x in range(w)] for y in range(h)], [[at(x, y) for y in range(h)] for x in range(w)]
    sep = lambda lines: 0 if len(lines) < 4 else var([mean(v) for v in lines]) / max(mean([var(v) for v in lines]), 1)
    inner = [(x, y) for y in range(h - 1) for x in range(w - 1)]
    jumps = [abs(at(x, y) - at(x + 1, y)) > 32 for x, y in inner] + [abs(at(x, y) - at(x, y + 1)) > 32 for x, y in inner]
    odd = [(x, y) for y in range(1, h - 1, 2) for x in range(1, w - 1, 2)]
    noise = [abs(at(x, y) - (at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) + at(x, y)) / 5) for x, y in odd]

    def acf(profile, lag):
        m = mean(profile)
        power = sum((v - m) ** 2 for v in profile)
        return 0 if power < 1e-3 else sum((profile[i] - m) * (profile[i + lag] - m) for i in range(len(profile) - lag)) / power

    def first(profile):
        return next((k for k in range(3, len(profile) // 2 + 1) if len(profile) >= 8 and acf(profile, k) > 0.55), 0)

    def two_d(side, other, value):
        m, most = mean(lum), side // 2
        if most < 3:
            return 0
        power = sum((value(a, o) - m) ** 2 for o in range(0, other, 7) for a in range(0, side, 7))
        corr = [0] + [sum((value(a, o) - m) * (value(a + k, o) - m) for o in range(0, other, 7) for a in range(0, side - k, 7)) / power if power >= 1e-3 else 0 for k in range(1, most + 1)]
        return next((k for k in range(2, most + 1) if corr[k] > 0.55 and corr[k] >= corr[k - 1] and (k == most or corr[k] >= corr[k + 1])), 0)

    q = lambda x, y: min(int(at(x, y) / 256 * 16), 15)
    pairs = {}
    for x, y in inner:
        for other in (q(x + 1, y), q(x, y + 1)):
            for key in ((q(x, y), other), (other, q(x, y))):
                pairs[key] = pairs.get(key, 0) + 1 / (4 * len(inner))
    hued = [v for v in hue if v >= 0]
    luma = [r * 0.299 + g * 0.587 + b * 0.114 for r, g, b in rgb]
    profile = [mean([luma[y * w + x] for y in range(h)]) for x in range(w)], [mean([luma[y * w + x] for x in range(w)]) for y in range(h)]

    def best(p):
        return max([(acf(p, k), -k) for k in range(3, len(p) // 2 + 1)] + [(0, 0)]) if len(p) // 2 >= 4 else (0, 0)

    def pure(p):
        n, m = len(p), mean(p)
        if n < 8:
            return 0
        power = [sum((v - m) * math.cos(2 * math.pi * k * t / n) for t, v in enumerate(p)) ** 2 + sum((v - m) * math.sin(2 * math.pi * k * t / n) for t, v in enumerate(p)) ** 2 for k in range(1, min(n // 2, 32) + 1)]
        return 0 if sum(power) < 1e-3 else max(power) / sum(power)

    bx, by = best(profile[0]), best(profile[1])
    return {
        "saturation": min(mean(sat), 1), "brightness": mean(lum) / 255, "lum_std": math.sqrt(var(lum)), "row_separation": sep(rows), "column_separation": sep(cols), "edges": mean(jumps) if jumps else 0,
        "dark": mean([v < 70 for v in lum]), "hue_spread": (max(hued) - min(hued)) / 360 if len(hued) >= 10 else 0, "noise": mean(noise) if noise else 0,
        "row_period": first([mean(v) for v in rows]), "column_period": first([mean(v) for v in cols]), "h_period": two_d(w, h, lambda a, o: at(a, o)), "v_period": two_d(h, w, lambda a, o: at(o, a)),
        "glcm_contrast": min(sum((i - j) ** 2 * p for (i, j), p in pairs.items()), 60) if pairs else 0, "glcm_homogeneity": sum(p / (1 + (i - j) ** 2) for (i, j), p in pairs.items()) if pairs else 1,
        "glcm_energy": sum(p * p for p in pairs.values()) if pairs else 1, "repeat_x": -bx[1], "repeat_y": -by[1], "harmonic_purity": pure(profile[0] if max(bx[0], 0) >= max(by[0], 0) else profile[1]),
    }


@pytest.mark.parametrize("size", [(8, 8), (31, 17), (9, 40), (3, 3), (1, 1), (2, 9), (40, 4)])
def test_statistics_are_those_of_plain_loops(spark, size):
    w, h = size
    rng = random.Random(w * 100 + h)
    noisy = [rng.getrandbits(24) | 0xFF000000 for _ in range(w * h)]
    waves = grid(w, h, lambda x, y: (int(128 + 100 * math.sin(x * 1.3)) << 16) + (int(128 + 100 * math.cos(y)) << 8) + (x * 7 + y) % 256)
    rows = [(0, noisy, w), (1, waves, w), (2, [0xFF102030] * (w * h), w), (3, noisy + [5] * (w - 1), w)]
    found = {r.id: r for r in picture.statistics(spark.createDataFrame(rows, RASTER)).collect()}
    for i, argb, _ in rows:
        for k, v in plain(argb, w).items():
            assert abs(found[i][k] - v) < 1e-9 * max(1, abs(v)), (i, k, found[i][k], v)


def test_odd_rasters(spark):
    rows = [(0, None, 3), (1, [], 3), (2, [1, None, 3], 1), (3, [1, 2], 0), (4, [1, 2], None), (5, [1, 2], 5), (6, [1] * 6, 2), (6, [1] * 6, 2)]
    df = spark.createDataFrame(rows, RASTER).withColumn("colors", F.lit("clash"))
    found = picture.signatures(df).orderBy("id").collect()
    assert [r.pattern for r in found] == [None] * 6 + ["SOLID"] * 2 and found[-1].h == 3 and found[0].saturation is None
    assert picture.signatures(spark.createDataFrame([], RASTER)).collect() == []
    kept = {r.id: r.argb for r in picture.without_background(df).collect()}
    assert kept[2] == [1, None, 3] and kept[5] == [1, 2] and kept[0] is None


def cut(spark, argb, w):
    return picture.without_background(spark.createDataFrame([(1, argb, w)], RASTER)).first().argb


def test_plain_backgrounds_go(spark):
    inside = lambda x, y, a, b: a <= x <= b and a <= y <= b
    out = cut(spark, grid(24, 24, lambda x, y: 0xFFCC2222 if inside(x, y, 8, 15) else 0xFFFFFFFF), 24)
    assert out[0] == 0x00FFFFFF and out[11 * 24 + 11] == 0xFFCC2222
    out = cut(spark, grid(30, 30, lambda x, y: 0xFF224488 if inside(x, y, 4, 20) else 0xFF993311 if inside(x, y, 25, 27) else 0xFFEFEFEF), 30)
    assert out[10 * 30 + 10] >> 24 == 255 and out[26 * 30 + 26] >> 24 == 0  # the speck goes
    noisy = grid(20, 20, lambda x, y: 0xFF339944 if inside(x, y, 6, 13) else 0xFFF5F5F5)
    for i, c in ((0, 0xFF333333), (19, 0xFF444444), (19 * 20, 0xFF555555)):
        noisy[i] = c
    out = cut(spark, noisy, 20)
    assert out[9 * 20 + 9] >> 24 == 255 and out[0] >> 24 == 0


def test_the_largest_component_is_that_of_a_flood():
    rng = np.random.default_rng(5)
    for _ in range(200):
        on = rng.random(rng.integers(1, 12, 2)) < rng.choice([0.3, 0.5, 0.7])
        best, seen = set(), set()
        for start in map(tuple, np.argwhere(on).tolist()):
            if start in seen:
                continue
            part, work = {start}, [start]
            while work:
                y, x = work.pop()
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p] and p not in part:
                        part.add(p)
                        work.append(p)
            seen |= part
            best = part if len(part) > len(best) else best
        assert set(map(tuple, np.argwhere(picture.largest_component(on)).tolist())) == best


def test_body_regions(spark):
    skin, cloth = 0xFFC68642, 0xFF2244CC
    w, h = 6, 50
    argb = grid(w, h, lambda x, y: skin if y < 12 or x == 1 else cloth)
    mask = grid(w, h, lambda x, y: 255 if 1 <= x <= 4 else 128)
    rows = [(0, argb, mask, w), (1, argb, [0] * (w * h), w), (2, [], [], w), (3, [skin] * 4, [200, 200, 0, 0], 2), (4, None, None, 2)]
    found = {r.id: r for r in picture.body_regions(spark.createDataFrame(rows, "id long, argb array<bigint>, mask array<int>, w int")).collect()}
    r = found[0].regions
    assert r[0] == 0 and r[5 * w + 2] == 1 and r[11 * w + 2] == 1 and r[20 * w + 2] == 2 and r[20 * w + 1] == 4 and r[28 * w + 1] == 4 and r[29 * w + 1] == 3 and r[49 * w + 4] == 3
    assert found[0].skin_argb == skin and found[0].undertone == "WARM_GOLDEN"
    assert set(found[1].regions) == {0} and found[1].skin_argb is None and found[1].undertone is None
    assert found[3].regions == [0, 0, 0, 0] and found[2].regions == [] and found[4].skin_argb is None  # a person of one row is none


def test_behind_the_subject(spark):
    df = spark.createDataFrame([([0xFF112233, 0xFF445566, 0xFF778899], [128, 129])], "argb array<bigint>, mask array<int>")
    assert df.select(picture.behind(F.col("argb"), F.col("mask")).alias("x")).first().x == [0xFF112233, 0x445566, 0xFF778899]


def tailored(points, neckline, sleeve, length):
    out = []
    for x, y in points:
        if neckline in ("V_NECK", "VNECK") and y < 0.08 and 0.44 <= x <= 0.56:
            y = 0.14
        elif neckline == "OFF_SHOULDER" and y < 0.09:
            y = 0.11
            x = max(x - 0.04, 0.18) if x < 0.4 else min(x + 0.04, 0.82) if x > 0.6 else x
        elif neckline == "BOAT" and y < 0.08:
            y = 0.035
        elif neckline == "HIGH" and y < 0.06 and 0.4 <= x <= 0.6:
            y = 0.0
        if sleeve == "SLEEVELESS" and 0.04 <= y <= 0.38:
            x = min(max(x, 0.36), 0.64)
        if sleeve == "PUFF" and 0.05 <= y <= 0.32:
            x = max(x - 0.07, 0.12) if x < 0.38 else min(x + 0.07, 0.88) if x > 0.62 else x
        hem = picture.HEMS.get(length)
        if hem and y > 0.48:
            t = min(max((y - 0.48) / 0.5, 0), 1)
            y = min(max(0.48 + t * (hem - 0.48), 0.48), 0.995)
            if length == "FLOOR" and t > 0.7:
                x = max(x - 0.03, 0.1) if x < 0.45 else min(x + 0.03, 0.9) if x > 0.55 else x
        out.append((x, y))
    return out


def test_garments_are_tailored(spark):
    rng = random.Random(1)
    kaba = [(0.32, 0.06), (0.5, 0.02), (0.68, 0.06), (0.74, 0.3), (0.62, 0.34), (0.66, 0.98), (0.34, 0.98), (0.38, 0.34), (0.26, 0.3)]
    rows = []
    for neck in ("V_NECK", "OFF_SHOULDER", "BOAT", "HIGH", "ROUND", None):
        for sleeve in ("SLEEVELESS", "PUFF", "SHORT", "THREE_QUARTER", "LONG", None):
            for length in ("MINI", "MIDI", "MAXI", "FLOOR", "DEFAULT", None):
                rows.append((len(rows), [kaba, [(rng.random(), rng.random() ** 2) for _ in range(9)], []], neck, sleeve, length))
    df = spark.createDataFrame(rows, "id int, polygons array<array<struct<x: double, y: double>>>, neck string, sleeve string, length string")
    found = {r.id: r.p for r in df.select("id", picture.customised(F.col("polygons"), F.col("neck"), F.col("sleeve"), F.col("length")).alias("p")).collect()}
    for i, polygons, neck, sleeve, length in rows:
        extra = [list(zip(p[::2], p[1::2], strict=True)) for p in picture.SLEEVES.get(sleeve, ())] + ([list(zip(picture.COLLAR[::2], picture.COLLAR[1::2], strict=True))] if neck == "HIGH" else [])
        want = [tailored(p, neck, sleeve, length) for p in polygons] + extra
        assert len(found[i]) == len(want)
        for a, b in zip(found[i], want, strict=True):
            assert len(a) == len(b) and all(abs(p.x - x) < 1e-12 and abs(p.y - y) < 1e-12 for p, (x, y) in zip(a, b, strict=True))
