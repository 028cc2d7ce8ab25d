"""Registered queries of logs, scraped answers, predictions and combined live values."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import curate, neardup, trends, wardrobe
from weft.plans.catalogue import _ORDERED, SQL, _pictures, query, table_query
from weft.sources.views import BASE

# logs

_STARTS, _PATTERNS = ("Licensed under", "License:"), (r"(?i)copyright", r"^The .*\.$")


@table_query("documents", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS key FROM l),
h AS (SELECT *, key LIKE 'Licensed under%' OR key LIKE 'License:%' AS head FROM k),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM h),
i AS (SELECT *, section > 0 AND row_number() OVER w BETWEEN 2 AND 26 AND coalesce(sum(CASE WHEN key = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS inside FROM s WINDOW w AS (PARTITION BY doc_id, section ORDER BY place))
SELECT doc_id, min(place) AS place, key AS line FROM i WHERE key <> '' AND (head OR inside OR regexp_matches(line, '(?i)copyright') OR regexp_matches(line, '^The .*\.$')) GROUP BY doc_id, key""")
def log_errors(documents):
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return curate.log_errors(lines.withColumn("place", F.col("place").cast("long")), "doc_id", "place", "line", _STARTS, _PATTERNS)


# answers of picture searches: their JSON is made of the documents, a row each

_HOSTS = "CASE WHEN lang = 'es' THEN 'https://www.pinterest.com/pin/' ELSE 'https://media.example.org/' END || doc_id"
_RAW = r"regexp_extract(text, '(?m)^(Licensed under[^\n]*)', 1)"
#: The licences of all lines, by the SQL of license_norm.
_LICENCES = f"WITH named AS ({SQL['license_norm'].strip()})"


@table_query("documents", sql=f"""{_LICENCES},
d AS (SELECT doc_id, source, n_chars, length(string_split(text, chr(10))[1]) * 20 AS side, CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'de' THEN 'image/png' WHEN 'fr' THEN CASE WHEN n_chars > 1000 THEN 'image/webp' ELSE 'image/gif' END ELSE 'image/tiff' END AS mime, {_RAW} AS raw, {_HOSTS} AS url, lang FROM documents)
SELECT doc_id, source AS title, url, licence, CASE WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp', 'image/tiff') THEN 'mime ' || mime || ' unsupported' WHEN least(n_chars, side) < 300 THEN 'original below 300px'
  WHEN licence IS NULL THEN 'license rejected: ' || CASE WHEN raw = '' THEN 'unknown' ELSE raw END WHEN lang = 'es' THEN 'blocked host' END AS reason FROM d LEFT JOIN named ON named.line = d.raw""")
def commons_candidates(documents):
    raw = F.regexp_extract("text", r"(?m)^(Licensed under[^\n]*)", 1)
    mime = F.when(F.col("lang") == "en", "image/jpeg").when(F.col("lang") == "de", "image/PNG").when(F.col("lang") == "fr", F.when(F.col("n_chars") > 1000, "image/webp").otherwise("image/gif")).otherwise("image/tiff")
    url = F.concat(F.when(F.col("lang") == "es", "https://www.pinterest.com/pin/").otherwise("https://media.example.org/"), F.col("doc_id").cast("string"))
    value = lambda c: F.struct(c.alias("value"))
    info = F.struct(mime.alias("mime"), F.col("n_chars").alias("width"), (F.length(F.get(F.split("text", "\n"), F.lit(0))) * 20).alias("height"), url.alias("url"), F.lit("https://media.example.org/").alias("descriptionurl"), F.struct(value(F.lit("")).alias("LicenseShortName"), value(raw).alias("License")).alias("extmetadata"))
    page = F.struct(F.col("source").alias("title"), F.array(info).alias("imageinfo"))
    payload = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    return curate.commons_candidates(documents.select("doc_id", payload.alias("payload"))).select("doc_id", "title", "url", "licence", "reason")




@table_query("documents", sql=f"""
SELECT doc_id, source AS title, CASE WHEN n_chars < 100 THEN NULL ELSE 'https://media.example.org/' || doc_id END AS url, CASE lang WHEN 'en' THEN 'CC BY-SA 4.0' WHEN 'de' THEN 'Public domain' WHEN 'fr' THEN NULL ELSE 'CC0 1.0' END AS licence,
  CASE WHEN n_chars < 100 THEN 'no url' WHEN lang = 'fr' THEN 'license rejected: by-nc 4.0' WHEN n_chars < 300 THEN 'too small (' || n_chars || 'x' || n_chars || ')' END AS reason FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')""")
def openverse_candidates(documents):
    slug = F.when(F.col("lang") == "en", "by-sa").when(F.col("lang") == "de", "pdm").when(F.col("lang") == "fr", "by-nc").otherwise("cc0")
    url = F.when(F.col("n_chars") >= 100, F.concat(F.lit("https://media.example.org/"), F.col("doc_id").cast("string")))
    result = F.struct(F.col("source").alias("title"), url.alias("url"), slug.alias("license"), F.lit("4.0").alias("license_version"), F.col("n_chars").alias("width"), F.col("n_chars").alias("height"))
    payload = F.to_json(F.struct(F.array(result).alias("results")))
    return curate.openverse_candidates(documents.where(F.col("lang").isin("en", "de", "fr", "es")).select("doc_id", payload.alias("payload")))


@table_query("pages", sql=r"""
SELECT page_id, path, size FROM (SELECT page_id, unnest(['img' || regexp_replace(url, '^[a-z]+://[^/]*', '') || '.JPG', 'doc/' || page_id || '.png', 'img/' || page_id || '.txt', 'img/' || page_id || '.webp']) AS path, unnest([length(html), 10, 20, length(html) * 20]) AS size FROM pages) WHERE (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.png' OR lower(path) LIKE '%.webp') AND path LIKE 'img/%' AND size <= 50000""")
def tree_files(pages):
    entry = lambda path, kind, size: F.struct(path.alias("path"), F.lit(kind).alias("type"), size.cast("long").alias("size"))
    id, n = F.col("page_id").cast("string"), F.length("html")
    named = lambda folder, end: F.concat(F.lit(folder), id, F.lit(end))
    path = F.concat(F.lit("img"), F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), F.lit(".JPG"))
    tree = F.array(entry(path, "blob", n), entry(named("doc/", ".png"), "blob", F.lit(10)), entry(named("img/", ".txt"), "blob", F.lit(20)), entry(named("img/", ".webp"), "blob", n * 20), entry(named("img/", ".png"), "tree", F.lit(0)))
    return curate.tree_files(pages.select("page_id", F.to_json(F.struct(tree.alias("tree"))).alias("payload")), prefixes=("img/",), most=50_000)


# predictions and accuracy

_NOW = BASE + 8 * 7 * 86_400_000


@query("posts", sql=f"""
, one AS (SELECT CAST(floor(({_NOW} - createdAt) / 604800000e0) AS BIGINT) AS week, unnest(tags) AS tag FROM posts), counts AS (SELECT tag, week, count(*) AS n FROM one WHERE week BETWEEN 0 AND 7 GROUP BY tag, week),
dense AS (SELECT DISTINCT tag, w.week FROM counts, (SELECT unnest(range(8)) AS week) w), xy AS (SELECT tag, -CAST(dense.week AS DOUBLE) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM dense LEFT JOIN counts USING (tag, week)),
line AS (SELECT tag, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base, coalesce(regr_r2(y, x), 0) AS r2, avg(y) AS mean FROM xy GROUP BY tag)
SELECT tag, round((greatest(base + slope, 0) - mean) / mean * 100, 6) AS growth, round(0.5 + 0.5 * r2, 6) AS confidence, CAST({_NOW} + floor((7 + 23 * (1 - round(r2, 6))) * 86400000) AS BIGINT) // 1000 AS peak_s FROM line""")
def trend_predictions(posts):
    found = trends.predictions(posts, _NOW)
    return found.select("tag", F.round("growth", 6).alias("growth"), F.round("confidence", 6).alias("confidence"), F.expr("peak div 1000").alias("peak_s"))


@table_query("documents", "labels", sql="""
WITH x AS (SELECT lang AS truth, CASE WHEN toxic = 1 THEN 'xx' WHEN regexp_matches(text, '[ßöü]') THEN 'de' WHEN regexp_matches(text, '[ñó]') THEN 'es' WHEN regexp_matches(text, '[êçè]') THEN 'fr' ELSE 'en' END AS guess FROM documents JOIN labels USING (doc_id)),
c AS (SELECT truth, avg(CASE WHEN truth = guess THEN 1 ELSE 0 END) AS a FROM x WHERE truth IN ('en', 'de', 'es', 'fr', 'it') GROUP BY truth)
SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM x WHERE truth = guess) AS correct, round((SELECT avg(CASE WHEN truth = guess THEN 1 ELSE 0 END) FROM x WHERE truth IS NOT NULL), 6) AS overall, round((SELECT avg(a) FROM c), 6) AS macro, 5 - (SELECT count(*) FROM c) AS classes_without_rows""")
def language_accuracy(documents, labels):
    has = lambda letters: F.col("text").rlike(f"[{letters}]")
    guess = F.when(F.col("toxic") == 1, "xx").when(has("ßöü"), "de").when(has("ñó"), "es").when(has("êçè"), "fr").otherwise("en")
    rows = documents.join(labels, "doc_id").select(F.col("lang").alias("truth"), guess.alias("guess"))
    found = wardrobe.accuracy_summary(rows, "truth", "guess", ["en", "de", "es", "fr", "it"])
    return found.select("n", "correct", F.round("overall", 6).alias("overall"), F.round("macro", 6).alias("macro"), "classes_without_rows")


# combined live values

_KINDS = ["view", "click", "purchase"]


@table_query("events", sql="""
WITH x AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS p
  FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, v AS view, c AS click, p AS purchase FROM x WHERE v IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL""")
def combined_values(events):
    from weft.streaming import live

    return live.latest_of_all(events, _KINDS, "user_id", "event_type", "value", ["event_id"])


@table_query("events", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase')),
x AS (SELECT *, max(CASE WHEN event_type = 'view' THEN n END) OVER w AS v, max(CASE WHEN event_type = 'click' THEN n END) OVER w AS c, max(CASE WHEN event_type = 'purchase' THEN n END) OVER w AS p FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, v + c + p AS total FROM x WHERE v IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL""")
def combined_counts(events):
    """The sum of three counts, each time that one of them changes."""
    from pyspark.sql import Window

    from weft.streaming import live

    counted = events.where(F.col("event_type").isin(_KINDS)).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    found = live.latest_of_all(counted, _KINDS, "user_id", "event_type", "n", ["event_id"])
    return found.select("user_id", "event_id", sum(F.col(k) for k in _KINDS).cast("long").alias("total"))


# the staging gate

_CANDIDATES = "cand AS (SELECT h.id, h.class, h.u, CAST(180 + floor(abs(v.embedding[1]) * 100) AS INTEGER) AS w, CAST(180 + floor(abs(v.embedding[2]) * 100) AS INTEGER) AS ht FROM h0 h JOIN embeddings v ON v.vec_id = h.id % 1000000)"
_FIT = _ORDERED[: _ORDERED.index("SELECT h.id, CASE WHEN f.id IS NOT NULL")].replace(", p AS (", f", h0 AS (SELECT * FROM h), {_CANDIDATES}, fit AS (SELECT id, class, u FROM cand WHERE class IN (0, 1, 2, 3, 4, 5, 6) AND least(w, ht) >= 220), p AS (", 1)
_FIT = _FIT.replace("FROM h x JOIN h y", "FROM fit x JOIN fit y").replace("AS n FROM h)", "AS n FROM fit)")


def _candidates(embeddings):
    side = lambda i: (F.lit(180) + F.floor(F.abs(F.get("embedding", F.lit(i))) * 100)).cast("int")
    sides = embeddings.select(F.col("vec_id").alias("of"), side(0).alias("w"), side(1).alias("h"))
    return _pictures(embeddings).withColumn("of", F.col("id") % 1_000_000).join(sides, "of").select("id", "class", F.concat(F.lit("p"), (F.col("of") % 7).cast("string")).alias("stem"), "w", "h", "hash")


@table_query("embeddings", sql=f"""{_FIT}, named AS (SELECT fit.id, fit.class, 'p' || fit.id % 1000000 % 7 || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END || '.jpg' AS filename FROM fit JOIN f ON f.id = fit.id WINDOW w AS (PARTITION BY fit.class, fit.id % 1000000 % 7 ORDER BY fit.id))
SELECT c.id, CASE WHEN c.class NOT IN (0, 1, 2, 3, 4, 5, 6) THEN 'unknown class' WHEN least(w, ht) < 220 THEN 'too small (' || w || 'x' || ht || ')' WHEN f.id IS NOT NULL THEN 'ok' WHEN named.class = c.class THEN 'duplicate of ' || named.class || '/' || named.filename ELSE 'cross-class conflict with ' || named.class || '/' || named.filename END AS outcome
FROM (SELECT id, class, w, ht FROM cand) c LEFT JOIN f ON f.id = c.id LEFT JOIN first ON first.id = c.id LEFT JOIN (SELECT id, class, filename FROM named) named ON named.id = first.low""")
def staging_gate(embeddings):
    return neardup.staged(_candidates(embeddings), [0, 1, 2, 3, 4, 5, 6])[0]


@table_query("embeddings", sql=f"""{_FIT} SELECT fit.id, fit.class, w, ht AS h, 'p' || fit.id % 1000000 % 7 || CASE WHEN row_number() OVER o > 1 THEN '_' || row_number() OVER o ELSE '' END || '.jpg' AS filename FROM fit JOIN f ON f.id = fit.id JOIN cand ON cand.id = fit.id WINDOW o AS (PARTITION BY fit.class, fit.id % 1000000 % 7 ORDER BY fit.id)""")
def staging_credits(embeddings):
    return neardup.staged(_candidates(embeddings), [0, 1, 2, 3, 4, 5, 6])[1].select("id", "class", "w", "h", "filename")
