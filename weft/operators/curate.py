"""Which scraped rows are taken, with the reason of the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import host_blocked, license_name

#: How a build log's sections begin, how many lines they have at most, and what marks a line of the cause of a failure.
SECTION_STARTS, SECTION_LIMIT = ("* What went wrong:", "* Exception is:"), 25
ERROR_LINES = (r"^e: ", r"(?i)error: ", r"(?i)Could not (find|resolve|determine|download|get)", r"^> Task .*FAILED$", r"^FAILURE: ")
#: Kinds of pictures that are taken, their least side, and the licences that a slug names; so are the names of the answers' fields and the texts of the reasons.
PICTURE_KINDS, LEAST_SIDE, OPEN_SLUGS = ("image/jpeg", "image/png", "image/webp", "image/tiff"), 300, ("cc0", "by", "by-sa")
_COMMONS = (
    "query struct<pages: array<struct<title: string, imageinfo: array<struct<mime: string, width: bigint, height: bigint, url: string, descriptionurl: string, "
    "extmetadata: struct<LicenseShortName: struct<value: string>, License: struct<value: string>>>>>>>"
)
_OPENVERSE = "results array<struct<title: string, url: string, license: string, license_version: string, width: bigint, height: bigint>>"
_TREE = "tree array<struct<path: string, type: string, size: bigint>>"
_SPACE = " \t\n\r\x0b\x0c"


def outcome(url: Column, licence: Column, label: Column, labels: list[str], side: Column | None = None, least: int = 96) -> Column:
    """Null for a row that is kept, else why not: the first rule that fails."""
    rules = [
        (F.coalesce(F.trim(label), F.lit("")) == "", "blank"), (~F.coalesce(label.isin(labels), F.lit(False)), "unknown label"), (license_name(licence).isNull(), "licence"),
        (F.startswith(F.lower(F.coalesce(url, F.lit(""))), F.lit("file://")), "local file"), (host_blocked(url), "blocked host"),
    ]
    if side is not None:
        rules.append((F.coalesce(side, F.lit(0)) < least, "too small"))
    return F.coalesce(*[F.when(bad, why) for bad, why in rules])


def unique_names(files: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """name made unique within a class: _2, _3 ... before the extension."""
    n = F.row_number().over(Window.partitionBy(by, name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def capped(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first n of each class."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def with_credits(files: DataFrame, credits: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """files with their credit, or the defaults."""
    out = files.join(credits, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def class_table(rows: DataFrame) -> DataFrame:
    """label, found, kept, duplicates, groups, readiness. rows: label, status, grp."""
    out = rows.groupBy("label").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_distinct(F.when(F.col("status") == "kept", F.col("grp"))).alias("groups"))
    return out.withColumn("readiness", F.when(F.col("kept") >= 1000, "ready").when(F.col("kept") >= 300, "usable").otherwise("too few"))


def chunks(lines: DataFrame, by: str, order: str, text: str, most: int = 1400) -> DataFrame:
    """by, chunk, text: lines packed in order, a chunk is over when the next line would make it longer than most.

    A fold over one group's lines; a group is a log of bounded size.
    """
    rows = lines.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("l"))
    start = F.array().cast("array<string>")

    def step(out: Column, line: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        fits = (F.size(out) > 0) & (F.length(last) + 1 + F.length(line) <= most)
        return F.when(fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws("\n", last, line)))).otherwise(F.array_append(out, line))

    return rows.select(by, F.posexplode(F.aggregate("l", start, step)).alias("chunk", "text"))


def warnings(table: DataFrame, classes: list[str]) -> DataFrame:
    """label, warning of a class_table(): empty, few groups (one or two), little diversity (over ten kept for each of fewer than thirty groups)."""
    want = table.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    rows = want.join(table.select("label", "kept", "groups"), "label", "left").na.fill(0, ["kept", "groups"])
    found = F.array_compact(F.array(
        F.when(F.col("kept") == 0, "empty"), F.when(F.col("groups").between(1, 2), "few groups"),
        F.when((F.col("groups") > 0) & (F.col("kept") > 10 * F.col("groups")) & (F.col("groups") < 30), "little diversity"),
    ))
    return rows.select("label", F.explode(found).alias("warning"))


def file_label(path: Column, skip: list[str], prefixes: dict[str, str], default: str | None) -> Column:
    """The label of a file by the beginning of its name, case ignored: null for one to skip, else the first prefix's label, else the default."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    out = F.lit(default)
    for prefix, label in reversed(prefixes.items()):
        out = F.when(F.startswith(name, F.lit(prefix.lower())), F.lit(label)).otherwise(out)
    for prefix in skip:
        out = F.when(~F.startswith(name, F.lit(prefix.lower())), out)
    return out


def repo_key(repo: Column, path: Column, by: Column) -> Column:
    """What a file of a repository is grouped by: its folder (parent), the folder above (grandparent), or itself. A path without folders is its own."""
    up = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(p)
    return F.concat(F.lit("github:"), repo, F.lit("@"), F.when(by == "parent", up(path)).when(by == "grandparent", up(up(path))).otherwise(path))


# Phrases that a licence's file holds.
LICENCE_PHRASES = {"bsd": ("redistribution and use", "bsd"), "mit": ("permission is hereby granted", "mit license"), "apache": ("apache license",), "unlicense": ("unencumbered", "unlicense")}


def licence_file_ok(text: Column, expected: Column) -> Column:
    """Whether a licence's text looks like the licence expected; one that isn't known must name itself."""
    low, token = F.lower(text), F.lower(F.split(expected, "-")[0])
    out = F.contains(low, token) | F.contains(low, F.lower(expected))
    for name, phrases in LICENCE_PHRASES.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(token == name, hit).otherwise(out)
    return out


def renamed(rows: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """rows after ordered replacements in a text, and counts: how often each rule applied, in order."""
    text, counts = F.col(column), []
    for old, new in rules:
        counts.append(F.floor((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("long"))
        text = F.replace(text, F.lit(old), F.lit(new))
    return rows.withColumn("counts", F.array(*counts)).withColumn(column, text)


def provenance(source_key: Column) -> Column:
    """The part of a source key before #; null for a blank one."""
    return F.nullif(F.trim(F.split(source_key, "#")[0]), F.lit(""))


def new_file_name(name: Column, category: Column) -> Column:
    """A file's name with the prefix of another category: what stands before the first underscore goes."""
    return F.concat(F.lower(category), F.lit("_"), F.regexp_replace(name, "^[^_]*_", ""))


def ingest(rows: DataFrame, labels: list[str], near: DataFrame) -> DataFrame:
    """id, status of contributed files (id, category, present, decoded), by the first rule that fails; near: ids that are near another picture."""
    close = near.select(F.col("id").alias("_n")).distinct()
    both = rows.join(close, F.col("id") == F.col("_n"), "left")
    status = F.when(~F.coalesce(F.col("category").isin(labels), F.lit(False)), "unknown category").when(~F.col("present"), "missing").when(~F.col("decoded"), "undecodable").when(F.col("_n").isNotNull(), "duplicate").otherwise("accepted")
    return both.select("id", status.alias("status"))


def log_errors(lines: DataFrame, log: str, place: str, line: str, starts: tuple[str, ...] = SECTION_STARTS, patterns: tuple[str, ...] = ERROR_LINES, limit: int = SECTION_LIMIT) -> DataFrame:
    """log, place, line: the lines that tell why a log's run failed, stripped, each different one once, at its first place.

    Taken are lines that begin a section, the lines of a section (up to `limit`, or the first blank one), and outside of sections those that a pattern is found in. Sections are islands between
    their first lines: a running count of these numbers them. Null lines are blank; an empty table gives an empty one.
    """
    key = F.btrim(F.coalesce(F.col(line), F.lit("")), F.lit(_SPACE))
    rows = lines.select(F.col(log), F.col(place), F.col(line).alias("_line"), key.alias("_key"))
    head = F.lit(False)
    for start in starts:
        head = head | F.startswith("_key", F.lit(start))
    rows = rows.withColumn("_head", head).withColumn("_section", F.sum(F.col("_head").cast("int")).over(Window.partitionBy(log).orderBy(place)))
    own = Window.partitionBy(log, "_section").orderBy(place)
    blank = F.sum((F.col("_key") == "").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("_section") > 0) & F.row_number().over(own).between(2, limit + 1) & (F.coalesce(blank, F.lit(0)) == 0)
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.coalesce(F.col("_line").rlike(pattern), F.lit(False))
    taken = rows.withColumn("_in", inside).where((F.col("_head") | F.col("_in") | found) & (F.col("_key") != ""))
    return taken.groupBy(log, F.col("_key").alias("line")).agg(F.min(place).alias(place)).select(log, place, "line")


def _side_below(w: Column, h: Column) -> Column:
    return F.least(F.coalesce(w, F.lit(0)), F.coalesce(h, F.lit(0)))


def commons_candidates(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Each page of the answers of a media wiki (JSON text) as a row with the answer's other columns: title, url, landing, licence, and reason, the first rule that fails; null for a candidate.

    Answers that are null, no JSON or without pages give no rows; fields of other types count as missing.
    """
    others = [c for c in payloads.columns if c != payload]
    page = payloads.select(*others, F.explode(F.from_json(F.col(payload), _COMMONS)["query"]["pages"]).alias("p"))
    page = page.withColumn("i", F.get("p.imageinfo", F.lit(0)))
    text = lambda c: F.coalesce(c, F.lit(""))
    meta, mime = F.col("i.extmetadata"), F.lower(text(F.col("i.mime")))
    raw = F.coalesce(F.nullif(meta["LicenseShortName"]["value"], F.lit("")), F.nullif(meta["License"]["value"], F.lit("")), F.lit(""))
    nothing = F.coalesce(*[F.col(f"i.{c}").cast("string") for c in ("mime", "width", "height", "url", "descriptionurl")], meta.cast("string")).isNull()
    rules = [
        (nothing, F.lit("no imageinfo")), (~mime.isin(*PICTURE_KINDS), F.concat(F.lit("mime "), F.when(mime == "", "?").otherwise(mime), F.lit(" unsupported"))),
        (_side_below(F.col("i.width"), F.col("i.height")) < LEAST_SIDE, F.lit(f"original below {LEAST_SIDE}px")), (license_name(raw).isNull(), F.concat(F.lit("license rejected: "), F.when(raw == "", "unknown").otherwise(raw))),
        (host_blocked(text(F.col("i.descriptionurl"))) | host_blocked(text(F.col("i.url"))), F.lit("blocked host")),
    ]
    reason = F.coalesce(*[F.when(bad, why) for bad, why in rules])
    return page.select(*others, "p.title", "i.url", F.col("i.descriptionurl").alias("landing"), license_name(raw).alias("licence"), reason.alias("reason"))


def openverse_candidates(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Each result of the answers of a picture search (JSON text) as a row with the answer's other columns: title, url, licence, and reason, the first rule that fails; null for a candidate.

    A public domain mark needs no other licence; sides count only where both are known. Answers without results give no rows.
    """
    others = [c for c in payloads.columns if c != payload]
    r = payloads.select(*others, F.explode(F.from_json(F.col(payload), _OPENVERSE)["results"]).alias("r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    raw, slug = F.btrim(F.concat(text("license"), F.lit(" "), text("license_version"))), F.lower(text("license"))
    licence = F.when(slug == "pdm", "Public domain").when(slug.isin(*OPEN_SLUGS), license_name(F.concat(F.lit("CC "), raw))).otherwise(license_name(raw))
    w, h = (F.coalesce(F.col(f"r.{c}"), F.lit(0)) for c in ("width", "height"))
    small = (w != 0) & (h != 0) & (F.least(w, h) < LEAST_SIDE)
    rules = [
        (text("url") == "", F.lit("no url")), (host_blocked(text("url")), F.lit("blocked host")), (licence.isNull(), F.concat(F.lit("license rejected: "), F.when(raw == "", "unknown").otherwise(raw))),
        (small, F.concat(F.lit("too small ("), w.cast("string"), F.lit("x"), h.cast("string"), F.lit(")"))),
    ]
    return r.select(*others, "r.title", "r.url", licence.alias("licence"), F.coalesce(*[F.when(bad, why) for bad, why in rules]).alias("reason"))


def tree_files(listings: DataFrame, payload: str = "payload", extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp"), prefixes: tuple[str, ...] = ("",), most: int = 8 << 20) -> DataFrame:
    """path and size of the files of repository listings (JSON text) with one of the extensions and prefixes and at most `most` bytes, with the listing's other columns; an unknown size is 0."""
    others = [c for c in listings.columns if c != payload]
    rows = listings.select(*others, F.explode(F.from_json(F.col(payload), _TREE)["tree"]).alias("t"))
    any_of = lambda tests: F.exists(F.array(*tests), lambda x: x)
    path, size = F.coalesce(F.col("t.path"), F.lit("")), F.coalesce(F.col("t.size"), F.lit(0))
    kept = (F.col("t.type") == "blob") & any_of([F.endswith(F.lower(path), F.lit(e.lower())) for e in extensions]) & any_of([F.startswith(path, F.lit(p)) for p in prefixes]) & (size <= most)
    return rows.where(kept).select(*others, path.alias("path"), size.alias("size"))
