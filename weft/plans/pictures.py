"""Registered queries of pictures, which are made of the vectors: a vector's numbers, from 0 to 255, are the channels of a picture about as wide as high."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.once import let
from weft.operators import picture, raster
from weft.plans.catalogue import table_query

# SQL of the pictures and of each step over them, as common tables.
PIXELS = """
c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0e0 ELSE CAST(x AS DOUBLE) END) AS e, len(embedding) AS n, CAST(ceil(sqrt(len(embedding))) AS BIGINT) AS w FROM embeddings WHERE len(embedding) > 0),
g AS (SELECT id, n, w, CAST(ceil(n / w) AS BIGINT) AS h, list_transform(e, lambda x: CASE WHEN list_max(e) = list_min(e) THEN 0 ELSE CAST(floor((x - list_min(e)) / (list_max(e) - list_min(e)) * 255) AS BIGINT) END) AS v FROM c),
px AS (SELECT id, n, w, h, v, k, k % w AS x, k // w AS y, v[k % n + 1] AS r, v[(k + w) % n + 1] AS g, v[(k + 2) % n + 1] AS b FROM (SELECT *, unnest(range(w * h)) AS k FROM g))"""
LIGHT = """
mm AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) / 255e0 AS mx, least(r, g, b) / 255e0 AS mn FROM px),
ll AS (SELECT *, (mx + mn) / 2 AS l, (mx + mn) / 2 * 255 AS lum, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS luma, mx - mn AS d FROM mm),
hsl AS (SELECT *, CASE WHEN d = 0 THEN 0e0 ELSE d / greatest(1 - abs(2 * l - 1), 1e-4) END AS s,
  CASE WHEN d = 0 THEN -1e0 WHEN top = r THEN (CASE WHEN g < b THEN (g / 255e0 - b / 255e0) / d + 6 ELSE (g / 255e0 - b / 255e0) / d END) * 60 WHEN top = g THEN ((b / 255e0 - r / 255e0) / d + 2) * 60 ELSE ((r / 255e0 - g / 255e0) / d + 4) * 60 END AS hue FROM ll),
li AS (SELECT id, w, h, list(lum ORDER BY k) AS l, list(luma ORDER BY k) AS u FROM hsl GROUP BY id, w, h),
pk AS (SELECT *, k % w AS x, k // w AS y FROM (SELECT *, unnest(range(w * h)) AS k FROM li)),
cols AS (SELECT id, list(m ORDER BY x) AS m, list(u ORDER BY x) AS u, CASE WHEN count(*) < 4 THEN 0 ELSE var_pop(m) / greatest(avg(v), 1) END AS sep FROM (SELECT id, x, avg(lum) AS m, avg(luma) AS u, var_pop(lum) AS v FROM hsl GROUP BY id, x) GROUP BY id),
rows AS (SELECT id, list(m ORDER BY y) AS m, list(u ORDER BY y) AS u, CASE WHEN count(*) < 4 THEN 0 ELSE var_pop(m) / greatest(avg(v), 1) END AS sep FROM (SELECT id, y, avg(lum) AS m, avg(luma) AS u, var_pop(lum) AS v FROM hsl GROUP BY id, y) GROUP BY id)"""


def _acf(c: str, lag: str) -> str:
    """The autocorrelation of a centred list."""
    return f"(CASE WHEN list_sum(list_transform({c}, lambda q: q * q)) < 1e-3 THEN 0 ELSE list_sum(list_transform(range(1, len({c}) - {lag} + 1), lambda i: {c}[i] * {c}[i + {lag}])) / list_sum(list_transform({c}, lambda q: q * q)) END)"


def _centred(v: str) -> str:
    return f"list_transform({v}, lambda q: q - list_avg({v}))"


def _grid(side: str, other: str, at: str, on: str) -> str:
    """Autocorrelations of every seventh pixel for lags from 0 to one over half the side; at, on: places of a pixel and of the one lag further on."""
    product = f"list_sum(flatten(list_transform(range(0, {other}, 7), lambda o: list_transform(range(0, {side} - z, 7), lambda a: (l[{at}] - m) * (l[{on}] - m)))))"
    return f"list_transform(range(0, {side} // 2 + 2), lambda z: CASE WHEN z = 0 OR z > {side} // 2 OR power < 1e-3 THEN 0e0 ELSE {product} / power END)"


def _peak(corr: str, side: str) -> str:
    return f"CASE WHEN {side} // 2 < 3 THEN 0 ELSE coalesce(list_filter(range(2, {side} // 2 + 1), lambda z: {corr}[z + 1] > 0.55 AND {corr}[z + 1] >= {corr}[z] AND (z = {side} // 2 OR {corr}[z + 1] >= {corr}[z + 2]))[1], 0) END"


STATISTICS = f"""
whole AS (SELECT id, w, h, least(avg(s), 1) AS saturation, least(avg(lum) / 255, 1) AS brightness, stddev_pop(lum) AS lum_std, least(stddev_pop(lum) / 90, 1) AS contrast, avg(CASE WHEN lum < 70 THEN 1 ELSE 0 END) AS dark,
  CASE WHEN count(*) FILTER (WHERE hue >= 0) < 10 THEN 0 ELSE (max(hue) FILTER (WHERE hue >= 0) - min(hue) FILTER (WHERE hue >= 0)) / 360 END AS hue_spread FROM hsl GROUP BY id, w, h),
jumps AS (SELECT id, avg((CASE WHEN abs(l[k + 1] - l[k + 2]) > 32 THEN 1 ELSE 0 END + CASE WHEN abs(l[k + 1] - l[k + w + 1]) > 32 THEN 1 ELSE 0 END) / 2e0) AS edges FROM pk WHERE x < w - 1 AND y < h - 1 GROUP BY id),
rough AS (SELECT id, avg(abs(l[k + 1] - (l[k] + l[k + 2] + l[k - w + 1] + l[k + w + 1] + l[k + 1]) / 5)) AS noise FROM pk WHERE x % 2 = 1 AND y % 2 = 1 AND x < w - 1 AND y < h - 1 GROUP BY id),
lines AS (SELECT cols.id, {_centred('rows.m')} AS cr, {_centred('cols.m')} AS cc, rows.sep AS row_separation, cols.sep AS column_separation FROM rows JOIN cols USING (id)),
firsts AS (SELECT id, row_separation, column_separation, CASE WHEN len(cr) < 8 THEN 0 ELSE coalesce(list_filter(range(3, len(cr) // 2 + 1), lambda z: {_acf('cr', 'z')} > 0.55)[1], 0) END AS row_period,
  CASE WHEN len(cc) < 8 THEN 0 ELSE coalesce(list_filter(range(3, len(cc) // 2 + 1), lambda z: {_acf('cc', 'z')} > 0.55)[1], 0) END AS column_period FROM lines),
centre AS (SELECT id, w, h, l, list_avg(l) AS m FROM li),
power AS (SELECT *, list_sum(flatten(list_transform(range(0, h, 7), lambda o: list_transform(range(0, w, 7), lambda a: (l[o * w + a + 1] - m) * (l[o * w + a + 1] - m))))) AS power FROM centre),
grids AS (SELECT id, w, h, {_grid('w', 'h', 'o * w + a + 1', 'o * w + a + z + 1')} AS along, {_grid('h', 'w', 'a * w + o + 1', '(a + z) * w + o + 1')} AS down FROM power),
periods AS (SELECT id, {_peak('along', 'w')} AS h_period, {_peak('down', 'h')} AS v_period FROM grids),
stats AS (SELECT * FROM whole LEFT JOIN jumps USING (id) LEFT JOIN rough USING (id) JOIN firsts USING (id) JOIN periods USING (id))"""
_STATISTICS = ["saturation", "brightness", "lum_std", "contrast", "dark", "hue_spread", "edges", "noise", "row_separation", "column_separation", "row_period", "column_period", "h_period", "v_period"]

TEXTURE = """
q AS (SELECT id, w, h, x, y, k, list_transform(l, lambda v: least(CAST(floor(v / 256 * 16) AS BIGINT), 15)) AS q FROM pk WHERE x < w - 1 AND y < h - 1),
two AS (SELECT id, q[k + 1] AS a, q[k + 2] AS b FROM q UNION ALL SELECT id, q[k + 1], q[k + w + 1] FROM q),
pairs AS (SELECT id, a, b FROM two UNION ALL SELECT id, b, a FROM two),
p AS (SELECT id, a, b, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM pairs GROUP BY id, a, b),
mean AS (SELECT id, sum(a * p) AS m FROM p GROUP BY id),
glcm AS (SELECT id, least(sum((a - b) * (a - b) * p), 60) AS glcm_contrast, sum(p / (1 + (a - b) * (a - b))) AS glcm_homogeneity, sum(p * p) AS glcm_energy,
  CASE WHEN sqrt(sum((a - m) * (a - m) * p)) > 1e-6 THEN sum((a - m) * (b - m) * p) / sum((a - m) * (a - m) * p) ELSE 0 END AS glcm_correlation FROM p JOIN mean USING (id) GROUP BY id)"""


def _directions(name: str, v: str) -> str:
    """Energies across four directions, their anisotropy and the share of the upright ones, of a list of pixels."""
    return f"""
{name}_e AS (SELECT id, sum(pow(({v}[k + w + 1] - {v}[k - w + 1]) * 0.5e0, 2)) AS e0, sum(pow(({v}[k + w + 2] - {v}[k - w]) * 0.3535e0, 2)) AS e45, sum(pow(({v}[k + 2] - {v}[k]) * 0.5e0, 2)) AS e90, sum(pow(({v}[k + w] - {v}[k - w + 2]) * 0.3535e0, 2)) AS e135
  FROM pk WHERE x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 GROUP BY id),
{name} AS (SELECT id, e0 / t AS energy_0, e45 / t AS energy_45, e90 / t AS energy_90, e135 / t AS energy_135, 45e0 * (list_position([e0, e45, e90, e135], greatest(e0, e45, e90, e135)) - 1) AS angle,
  CASE WHEN t < 1 THEN 0 ELSE (greatest(e0, e45, e90, e135) - least(e0, e45, e90, e135)) / (greatest(e0, e45, e90, e135) + least(e0, e45, e90, e135)) END AS anisotropy, CASE WHEN t < 1 THEN 0.5e0 ELSE (e0 + e90) / t END AS warp_weft
  FROM (SELECT *, greatest(e0 + e45 + e90 + e135, 1e-6) AS t FROM {name}_e))"""


DIRECTIONS = _directions("dir", "l")
_TEXTURE = ["glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation", "energy_0", "energy_45", "energy_90", "energy_135", "angle", "anisotropy", "warp_weft"]


def _best(name: str, field: str) -> str:
    """The best lag of rows and columns of a field."""
    both = "UNION ALL ".join(f"SELECT id, '{axis}' AS axis, {_centred(f'{table}.{field}')} AS c FROM {table} " for axis, table in (("x", "cols"), ("y", "rows")))
    return f"""
{name}_c AS ({both}),
{name}_a AS (SELECT id, axis, c, CASE WHEN len(c) // 2 < 4 THEN [] ELSE list_transform(range(3, len(c) // 2 + 1), lambda z: {_acf('c', 'z')}) END AS acf FROM {name}_c),
{name}_b AS (SELECT id, axis, c, least(greatest(coalesce(list_max(acf), 0), 0), 1) AS strength, CASE WHEN coalesce(list_max(acf), 0) > 0 THEN list_position(acf, list_max(acf)) + 2 ELSE 0 END AS lag FROM {name}_a),
{name} AS (SELECT x.id, x.lag AS lag_x, y.lag AS lag_y, x.strength >= y.strength AS along_x, greatest(x.strength, y.strength) AS strength, CASE WHEN x.strength >= y.strength THEN x.lag ELSE y.lag END AS lag, CASE WHEN x.strength >= y.strength THEN x.c ELSE y.c END AS c
  FROM {name}_b x JOIN {name}_b y ON x.id = y.id AND x.axis = 'x' AND y.axis = 'y')"""


_WAVE = "list_sum(list_transform(range(0, len(c)), lambda t: c[t + 1] * {f}(2 * pi() * k * t / len(c))))"
SPECTRUM = (
    _best("rep", "u")
    + f""",
waves AS (SELECT id, CASE WHEN len(c) < 8 THEN [0e0] ELSE list_transform(range(1, least(len(c) // 2, 32) + 1), lambda k: pow({_WAVE.format(f='cos')}, 2) + pow({_WAVE.format(f='sin')}, 2)) END AS power FROM rep),
spec AS (SELECT rep.id, lag_x AS repeat_x, lag_y AS repeat_y, strength AS repeat_strength, CASE WHEN list_sum(power) < 1e-3 THEN 0 ELSE list_max(power) / list_sum(power) END AS harmonic_purity FROM rep JOIN waves USING (id))"""
)
STRIPS = (
    _best("band", "m")
    + """,
fam AS (SELECT id, CASE WHEN l < 0.18 THEN 4 WHEN s < 0.2 THEN 5 WHEN hue < 20 OR hue >= 340 THEN 2 WHEN hue < 70 THEN 0 WHEN hue < 170 THEN 1 WHEN hue < 270 THEN 3 ELSE 2 END AS f FROM hsl),
share AS (SELECT id, f, count(*) / sum(count(*)) OVER (PARTITION BY id) AS share FROM fam GROUP BY id, f),
hues AS (SELECT id, count(*) FILTER (WHERE f < 5 AND share >= 0.08) AS bands FROM share GROUP BY id),
sharp AS (SELECT id, avg(CASE WHEN abs(l[k + 1] - CASE WHEN along_x THEN l[k + 2] ELSE l[k + w + 1] END) > 36 THEN 1 ELSE 0 END) AS edged FROM pk JOIN band USING (id) WHERE x % 2 = 1 AND y % 2 = 1 AND x < w - 1 AND y < h - 1 GROUP BY id),
strip AS (SELECT id, along_x AS strip_along_x, lag AS strip_period, bands AS strip_bands, coalesce(edged, 0) AS strip_edges,
  least(0.35e0 * CASE WHEN strength > 0.55 AND lag > 0 THEN (strength - 0.55e0) / 0.45e0 ELSE 0 END + 0.45e0 * least(greatest(bands - 2, 0), 2) / 2 + 0.2e0 * least(coalesce(edged, 0) / 0.3e0, 1), 1) AS strip_score
  FROM band JOIN hues USING (id) LEFT JOIN sharp USING (id))"""
)
COLORS = """
buck AS (SELECT id, CASE WHEN lum < 45 THEN 12 WHEN s < 0.16 AND lum > 205 THEN 13 WHEN s < 0.16 THEN 14 ELSE least(CAST(floor(hue / 30) AS BIGINT), 11) END AS bucket, r, g, b FROM hsl),
counted AS (SELECT id, bucket, count(*) AS n, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b, sum(count(*)) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, bucket) AS place FROM buck GROUP BY id, bucket),
main AS (SELECT id, place, bucket, n / total AS share, r, g, b FROM counted WHERE n / total >= 0.07 AND place <= 4),
tones AS (SELECT g.id, greatest(count(bucket), 1) AS colors, coalesce(bool_or(main.r = greatest(main.r, main.g, main.b) AND main.b = least(main.r, main.g, main.b) AND main.r - main.b >= 40 AND main.r <= 210), false) AS earth, coalesce(bool_or(bucket IN (7, 8)), false) AS blue FROM g LEFT JOIN main ON g.id = main.id GROUP BY g.id)"""
SIGNATURE = """
al AS (SELECT * FROM stats LEFT JOIN glcm USING (id) JOIN strip USING (id) JOIN spec USING (id) JOIN tones USING (id) LEFT JOIN (SELECT id, anisotropy, warp_weft FROM lumadir) USING (id)),
sc AS (SELECT *, greatest(0.05e0, least(1, coalesce(CASE WHEN h_period > 0 AND v_period > 0 THEN least(h_period, v_period) * 2e0 WHEN h_period > 0 THEN h_period * 2e0 WHEN v_period > 0 THEN v_period * 2e0 WHEN row_period > 0 THEN row_period * 1e0 WHEN column_period > 0 THEN column_period * 1e0 END / least(w, h), 0.5e0))) AS scale FROM al),
pa AS (SELECT *, CASE WHEN lum_std < 9 THEN 'SOLID' WHEN h_period > 0 AND v_period > 0 AND abs(h_period - v_period) <= 0.35e0 * greatest(h_period, v_period) THEN 'CHECKED' WHEN h_period > 0 OR v_period > 0 OR greatest(row_separation, column_separation) > 2.6 THEN 'STRIPED'
  WHEN edges < 0.02 AND lum_std > 14 THEN 'GRADIENT' WHEN row_period > 0 AND column_period > 0 AND scale < 0.3 THEN 'DOTTED' WHEN contrast > 0.45 AND colors <= 3 AND dark BETWEEN 0.08 AND 0.45 AND brightness > 0.4 THEN 'SYMBOLIC'
  WHEN colors >= 3 AND edges > 0.08 THEN 'GEOMETRIC' WHEN colors >= 4 AND hue_spread > 0.4 THEN 'FLORAL' WHEN edges > 0.04 THEN 'ORGANIC' ELSE 'ABSTRACT' END AS pattern,
  CASE WHEN noise > 7 THEN 'SLUB' WHEN glcm_contrast > 14 OR noise > 4 THEN 'WOVEN' WHEN edges > 0.12 THEN 'EMBROIDERED' WHEN brightness < 0.25 AND saturation > 0.35 THEN 'PILE' WHEN brightness > 0.75 AND saturation < 0.2 THEN 'SHEER' ELSE 'SMOOTH' END AS texture FROM sc)"""
_CATEGORY = """CASE WHEN pattern = 'STRIPED' AND colors BETWEEN 2 AND 3 AND saturation < 0.45 THEN CASE WHEN earth AND contrast > 0.45 THEN 'GONJA' ELSE 'FUGU' END WHEN pattern = 'STRIPED' AND colors >= 4 AND saturation > 0.38 THEN 'KENTE'
  WHEN pattern = 'STRIPED' AND colors >= 3 THEN CASE WHEN strip_score > 0.5 AND strip_bands >= 3 THEN 'KENTE' ELSE 'KENTE_PRINT' END WHEN pattern = 'SYMBOLIC' THEN 'ADINKRA' WHEN pattern = 'GRADIENT' OR (pattern = 'ORGANIC' AND contrast < 0.35) THEN CASE WHEN saturation > 0.4 THEN 'TIEDYE' ELSE 'BATIK' END
  WHEN pattern IN ('FLORAL', 'ORGANIC', 'GEOMETRIC') AND saturation > 0.5 THEN CASE WHEN colors >= 5 THEN 'ANKARA' ELSE 'WAX' END WHEN blue AND texture IN ('SLUB', 'WOVEN') AND saturation < 0.5 THEN 'DENIM'
  WHEN pattern = 'SOLID' THEN CASE WHEN saturation < 0.18 THEN 'COTTON_PLAIN' WHEN texture = 'SLUB' THEN 'LINEN' WHEN brightness < 0.3 AND saturation > 0.35 THEN 'VELVET' WHEN saturation > 0.4 THEN 'SILK' ELSE 'COTTON_PLAIN' END ELSE 'UNKNOWN' END"""


def _with(*tables: str) -> str:
    return "WITH " + ",".join(tables)


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round(CAST(coalesce({n}, 0) AS DOUBLE) + 1e-9, 6) AS {n}" for n in names)  # sums that two engines add up in another order may lie on either side of a half


def pictures(embeddings: DataFrame) -> DataFrame:
    """id, argb, mask (arrays of one length), v (the vector's numbers from 0 to 255), w: a picture about as wide as high of each vector with numbers; the last row is filled from the beginning."""
    n = F.size("embedding")
    w = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    place = F.sequence(F.lit(0), w * F.ceil(n / w).cast("int") - 1)
    whole = F.transform("embedding", lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    span = lambda e: F.struct(e.alias("e"), F.array_min(e).alias("low"), F.array_max(e).alias("high"))
    value = lambda s: F.transform(s["e"], lambda x: F.when(s["high"] == s["low"], 0).otherwise(F.floor((x - s["low"]) / (s["high"] - s["low"]) * 255)).cast("bigint"))
    at = lambda v, k, step: F.get(v, ((k + step) % n).cast("int"))
    argb = lambda v: F.transform(place, lambda k: F.lit(0xFF000000) + at(v, k, F.lit(0)) * 65536 + at(v, k, w) * 256 + at(v, k, F.lit(2)))
    made = lambda v: F.struct(argb(v).alias("argb"), F.transform(place, lambda k: at(v, k, F.lit(1))).alias("mask"), v.alias("v"))
    p = let(whole, lambda e: let(span(e), lambda s: let(value(s), made)))
    return embeddings.where(n > 0).select(F.col("vec_id").alias("id"), p.alias("p"), w.alias("w")).select("id", "p.argb", "p.mask", "p.v", "w")


def _shown(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.select("id", *[F.round(F.col(n).cast("double") + 1e-9, 6).alias(n) for n in names])


@table_query("embeddings", sql=f"{_with(PIXELS, LIGHT, STATISTICS)} SELECT id, {_rounded(_STATISTICS)} FROM stats")
def picture_statistics(embeddings):
    return _shown(picture.statistics(pictures(embeddings)), _STATISTICS)


@table_query("embeddings", sql=f"{_with(PIXELS, LIGHT, TEXTURE, DIRECTIONS)} SELECT id, {_rounded(_TEXTURE)} FROM glcm JOIN dir USING (id)")
def picture_texture(embeddings):
    return _shown(picture.statistics(pictures(embeddings)), _TEXTURE)


@table_query("embeddings", sql=f"{_with(PIXELS, LIGHT, SPECTRUM)} SELECT id, {_rounded(['repeat_x', 'repeat_y', 'repeat_strength', 'harmonic_purity'])} FROM spec")
def picture_spectrum(embeddings):
    return _shown(picture.statistics(pictures(embeddings)), ["repeat_x", "repeat_y", "repeat_strength", "harmonic_purity"])


@table_query("embeddings", sql=f"{_with(PIXELS, LIGHT, STRIPS)} SELECT id, strip_along_x, {_rounded(['strip_period', 'strip_bands', 'strip_edges', 'strip_score'])} FROM strip")
def picture_strips(embeddings):
    found = picture.statistics(pictures(embeddings))
    return found.select("id", "strip_along_x", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in ("strip_period", "strip_bands", "strip_edges", "strip_score")])


@table_query("embeddings", sql=f"{_with(PIXELS, LIGHT, COLORS)} SELECT id, place, bucket, round(CAST(share AS DOUBLE), 6) AS share, 4278190080 + CAST(r * 65536 + g * 256 + b AS BIGINT) AS argb FROM main")
def picture_colors(embeddings):
    found = picture.statistics(pictures(embeddings)).select("id", F.posexplode("colors").alias("p", "c"))
    return found.select("id", (F.col("p") + 1).cast("long").alias("place"), F.col("c.bucket").cast("long").alias("bucket"), F.round("c.share", 6).alias("share"), "c.argb")


@table_query("embeddings", sql=f"""{_with(PIXELS, LIGHT, STATISTICS, TEXTURE, SPECTRUM, STRIPS, COLORS, _directions('lumadir', 'u'), SIGNATURE)}
SELECT id, pattern, texture, {_CATEGORY} AS category, CASE WHEN pattern = 'SOLID' THEN 0.1e0 WHEN pattern = 'GRADIENT' THEN 0.9e0 ELSE round(scale, 6) END AS motif_scale, strip_period / 2e0 AS strip_width,
  CASE WHEN strip_score >= 0.48 OR (repeat_strength > 0.65 AND coalesce(warp_weft, 0.5) > 0.62) THEN 'MATCH_WARP_STRIPS' WHEN greatest(repeat_x, repeat_y) >= least(w, h) * 0.25e0 THEN 'CENTER_LARGE_MOTIF' WHEN coalesce(anisotropy, 0) > 0.55 THEN 'DIRECTIONAL_NAP' ELSE 'FREE_CUT' END AS advice,
  (SELECT string_agg(name, ',' ORDER BY place) FROM (SELECT place, ([{', '.join(f"'{n}'" for n in raster.BUCKET_NAMES)}])[bucket + 1] AS name FROM main WHERE main.id = pa.id)) AS color_names FROM pa""")
def picture_signature(embeddings):
    x = picture.signatures(pictures(embeddings))
    return x.select("id", "pattern", "texture", "category", F.round("motif_scale", 6).alias("motif_scale"), "strip_width", "advice", F.when(F.size("color_names") > 0, F.array_join("color_names", ",")).alias("color_names"))


@table_query("embeddings", sql=f"""WITH RECURSIVE {PIXELS},
border AS (SELECT id, r, g, b FROM px WHERE y = 0 UNION ALL SELECT id, r, g, b FROM px WHERE y = h - 1 UNION ALL SELECT id, r, g, b FROM px WHERE x = 0 UNION ALL SELECT id, r, g, b FROM px WHERE x = w - 1),
med AS (SELECT id, list_sort(list(r))[count(*) // 2 + 1] AS mr, list_sort(list(g))[count(*) // 2 + 1] AS mg, list_sort(list(b))[count(*) // 2 + 1] AS mb FROM border GROUP BY id),
fg AS (SELECT id, k, x, y, w FROM px JOIN med USING (id) WHERE abs(r - mr) + abs(g - mg) + abs(b - mb) > 132),
near AS (SELECT a.id, a.k AS a, b.k AS b FROM fg a JOIN fg b ON a.id = b.id AND (b.k = a.k + a.w OR b.k = a.k - a.w OR (b.k = a.k + 1 AND b.y = a.y) OR (b.k = a.k - 1 AND b.y = a.y))),
reach AS (SELECT id, k AS root, k FROM fg UNION SELECT r.id, r.root, n.b FROM reach r JOIN near n ON r.id = n.id AND r.k = n.a),
part AS (SELECT id, k, min(root) AS root FROM reach GROUP BY id, k),
best AS (SELECT id, root FROM (SELECT id, root, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, root) AS place FROM part GROUP BY id, root) WHERE place = 1),
kept AS (SELECT part.id, part.k FROM part JOIN best ON part.id = best.id AND part.root = best.root)
SELECT px.id, count(kept.k) AS subject, md5(string_agg(CAST(r * 65536 + g * 256 + b + CASE WHEN kept.k IS NOT NULL OR least(w, h) < 3 THEN 4278190080 ELSE 0 END AS VARCHAR), ',' ORDER BY px.k)) AS argb_md5 FROM px LEFT JOIN kept ON px.id = kept.id AND px.k = kept.k GROUP BY px.id""")
def picture_cutout(embeddings):
    cut = picture.without_background(pictures(embeddings).select("id", "argb", "w"))
    opaque = F.size(F.filter("argb", lambda p: p >= 0xFF000000)).cast("long")
    return cut.select("id", opaque.alias("subject"), F.md5(F.array_join(F.transform("argb", lambda p: p.cast("string")), ",")).alias("argb_md5"))


_SKIN = "(luma BETWEEN 28 AND 242 AND 128 - r * 0.168736e0 - g * 0.331264e0 + b * 0.5e0 BETWEEN 77 AND 135 AND 128 + r * 0.5e0 - g * 0.418688e0 - b * 0.081312e0 BETWEEN 130 AND 178 AND r >= g AND g >= b - 12)"


@table_query("embeddings", sql=f"""{_with(PIXELS)},
mk AS (SELECT *, v[(k + 1) % n + 1] AS mask, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS luma FROM px),
sk AS (SELECT *, {_SKIN} AS skin, min(y) FILTER (WHERE mask > 128) OVER (PARTITION BY id) AS y0, max(y) FILTER (WHERE mask > 128) OVER (PARTITION BY id) AS y1 FROM mk),
rg AS (SELECT *, CASE WHEN mask <= 128 OR y1 IS NULL OR y0 >= y1 THEN 0 WHEN y <= y0 + floor((y1 - y0) * 0.22e0 + 0.5) THEN 1 WHEN y > y0 + floor((y1 - y0) * 0.58e0 + 0.5) THEN 3 WHEN skin THEN 4 ELSE 2 END AS region FROM sk),
mean AS (SELECT id, sum(r) FILTER (WHERE skin AND region IN (1, 4)) // count(*) FILTER (WHERE skin AND region IN (1, 4)) AS mr, sum(g) FILTER (WHERE skin AND region IN (1, 4)) // count(*) FILTER (WHERE skin AND region IN (1, 4)) AS mg,
  sum(b) FILTER (WHERE skin AND region IN (1, 4)) // count(*) FILTER (WHERE skin AND region IN (1, 4)) AS mb, string_agg(CAST(region AS VARCHAR), '' ORDER BY k) AS regions, md5(string_agg(CAST(r * 65536 + g * 256 + b + CASE WHEN mask <= 128 THEN 4278190080 ELSE 0 END AS VARCHAR), ',' ORDER BY k)) AS behind_md5 FROM rg GROUP BY id)
SELECT id, regions, CAST(4278190080 + mr * 65536 + mg * 256 + mb AS BIGINT) AS skin_argb, CASE WHEN mr IS NULL THEN NULL WHEN mr - mb - (mr - mg) * 0.5e0 > 22 THEN 'WARM_GOLDEN' WHEN mr - mb - (mr - mg) * 0.5e0 < 8 THEN 'COOL_DEEP' ELSE 'NEUTRAL_RICH' END AS undertone, behind_md5 FROM mean""")
def picture_regions(embeddings):
    x = picture.body_regions(pictures(embeddings).select("id", "argb", "mask", "w"))
    behind = F.array_join(F.transform(picture.behind(F.col("argb"), F.col("mask")), lambda p: p.cast("string")), ",")
    return x.select("id", F.array_join(F.transform("regions", lambda r: r.cast("string")), "").alias("regions"), "skin_argb", "undertone", F.md5(behind).alias("behind_md5"))


_NECKS, _SLEEVES, _LENGTHS = ["V_NECK", "VNECK", "OFF_SHOULDER", "BOAT", "HIGH", "ROUND"], ["SLEEVELESS", "PUFF", "SHORT", "THREE_QUARTER", "LONG", "DEFAULT"], ["MINI", "MIDI", "MAXI", "FLOOR", "DEFAULT"]


def _names(names: list[str], i: int) -> str:
    """The name that the i-th of a vector's numbers picks."""
    return f"([{', '.join(f"'{n}'" for n in names)}])[v[{i}] * {len(names)} // 256 + 1]"


def _more(sleeve_or_neck: str, polygons, first: int) -> str:
    points = [(k + first, i, x, y) for k, p in enumerate(polygons) for i, (x, y) in enumerate(zip(p[::2], p[1::2], strict=True))]
    return f"SELECT id, poly + c AS poly, i, x, y FROM ts, (VALUES {', '.join(f'({k}, {i}, {x}e0, {y}e0)' for k, i, x, y in points)}) q(poly, i, x, y) WHERE {sleeve_or_neck}"


@table_query("embeddings", sql=f"""{_with(PIXELS)},
ts AS (SELECT id, v, n, {_names(_NECKS, 1)} AS neck, {_names(_SLEEVES, 2)} AS sleeve, {_names(_LENGTHS, 3)} AS hem, CAST(ceil((n // 2) / 16e0) AS BIGINT) AS c FROM g WHERE n >= 3),
p0 AS (SELECT id, neck, sleeve, hem, j // 16 AS poly, j % 16 AS i, v[2 * j + 1] / 255e0 AS x, v[2 * j + 2] / 255e0 AS y FROM (SELECT *, unnest(range(n // 2)) AS j FROM ts)),
p1 AS (SELECT id, sleeve, hem, poly, i, CASE WHEN neck = 'OFF_SHOULDER' AND y < 0.09 AND x < 0.4 THEN greatest(x - 0.04e0, 0.18e0) WHEN neck = 'OFF_SHOULDER' AND y < 0.09 AND x > 0.6 THEN least(x + 0.04e0, 0.82e0) ELSE x END AS x,
  CASE WHEN neck IN ('V_NECK', 'VNECK') AND y < 0.08 AND x BETWEEN 0.44 AND 0.56 THEN 0.14e0 WHEN neck = 'OFF_SHOULDER' AND y < 0.09 THEN 0.11e0 WHEN neck = 'BOAT' AND y < 0.08 THEN 0.035e0 WHEN neck = 'HIGH' AND y < 0.06 AND x BETWEEN 0.4 AND 0.6 THEN 0e0 ELSE y END AS y FROM p0),
p2 AS (SELECT id, hem, poly, i, CASE WHEN sleeve = 'SLEEVELESS' AND y BETWEEN 0.04 AND 0.38 THEN greatest(0.36e0, least(0.64e0, x)) WHEN sleeve = 'PUFF' AND y BETWEEN 0.05 AND 0.32 AND x < 0.38 THEN greatest(x - 0.07e0, 0.12e0) WHEN sleeve = 'PUFF' AND y BETWEEN 0.05 AND 0.32 AND x > 0.62 THEN least(x + 0.07e0, 0.88e0) ELSE x END AS x, y FROM p1),
p3 AS (SELECT *, CASE hem WHEN 'MINI' THEN 0.72e0 WHEN 'MIDI' THEN 0.84e0 WHEN 'MAXI' THEN 0.95e0 WHEN 'FLOOR' THEN 0.995e0 END AS b, least(1e0, (y - 0.48e0) / 0.5e0) AS t FROM p2),
p4 AS (SELECT id, poly, i, CASE WHEN hem = 'FLOOR' AND y > 0.48 AND t > 0.7 AND x < 0.45 THEN greatest(x - 0.03e0, 0.1e0) WHEN hem = 'FLOOR' AND y > 0.48 AND t > 0.7 AND x > 0.55 THEN least(x + 0.03e0, 0.9e0) ELSE x END AS x,
  CASE WHEN b IS NOT NULL AND y > 0.48 THEN greatest(0.48e0, least(0.995e0, 0.48e0 + t * (b - 0.48e0))) ELSE y END AS y FROM p3
  UNION ALL {_more("sleeve = 'LONG'", picture.SLEEVES['LONG'], 0)} UNION ALL {_more("sleeve = 'THREE_QUARTER'", picture.SLEEVES['THREE_QUARTER'], 0)}
  UNION ALL SELECT id, poly + c + CASE WHEN sleeve IN ('LONG', 'THREE_QUARTER') THEN 2 ELSE 0 END, i, x, y FROM ts, (VALUES {', '.join(f'(0, {i}, {x}e0, {y}e0)' for i, (x, y) in enumerate(zip(picture.COLLAR[::2], picture.COLLAR[1::2], strict=True)))}) q(poly, i, x, y) WHERE neck = 'HIGH')
SELECT id, poly, i AS vertex, round(x, 9) AS x, round(y, 9) AS y FROM p4""")
def garment_polygons(embeddings):
    pick = lambda names, v, i: F.get(F.array(*map(F.lit, names)), F.floor(F.get(v, F.lit(i)) * len(names) / 256).cast("int"))
    value = lambda v, i: F.get(v, i.cast("int")) / F.lit(255.0)
    points = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda j: F.struct(value(v, 2 * j).alias("x"), value(v, 2 * j + 1).alias("y")))
    polygons = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / 16).cast("int") - 1), lambda k: F.slice(p, k * 16 + 1, F.lit(16)))
    made = lambda v: picture.customised(let(points(v), polygons), pick(_NECKS, v, 0), pick(_SLEEVES, v, 1), pick(_LENGTHS, v, 2))
    rows = pictures(embeddings).where(F.size("v") >= 3).select("id", let(F.col("v"), made).alias("p"))
    rows = rows.select("id", F.posexplode("p").alias("poly", "points")).select("id", "poly", F.posexplode("points").alias("vertex", "p"))
    return rows.select("id", F.col("poly").cast("long").alias("poly"), F.col("vertex").cast("long").alias("vertex"), F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))
