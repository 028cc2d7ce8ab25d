"""File sources and sinks: JSON catalogues, label files, manifests, language packs, image folders, zip manifests."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import codec
from weft.operators.store import upsert
from weft.schema import CATEGORIES

_STYLE = "id string, title_key string, description_key string, gender string, category string, occasions array<string>, silhouette string, affinity array<string>, structure float"
_LOOK = "id string, title_key string, gender string, fabrics array<string>, asset string"


def style_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The rows of dress_styles from a JSON file {version, styles: [...]}; lists become comma-separated."""
    rows = spark.read.schema(f"version int, styles array<struct<{_struct(_STYLE)}>>").json(path, multiLine=True).select(F.explode("styles").alias("s")).select("s.*")
    return rows.select("id", F.col("title_key").alias("titleKey"), F.col("description_key").alias("descriptionKey"), "gender", "category", codec.to_csv(F.col("occasions")).alias("occasions"), "silhouette", codec.to_csv(F.col("affinity")).alias("affinity"), "structure")


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in ddl.split(", "))


def catalogue_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version int").json(path, multiLine=True).select(F.coalesce("version", F.lit(1)).alias("version"))


def looks(spark: SparkSession, path: str) -> DataFrame:
    """Looks from JSON; a look with an unknown fabric is dropped whole."""
    rows = spark.read.schema(f"looks array<struct<{_struct(_LOOK)}>>").json(path, multiLine=True).select(F.explode("looks").alias("s")).select("s.*")
    return rows.where(codec.all_known(F.col("fabrics"), CATEGORIES))


def seeded(table: DataFrame, source: DataFrame) -> DataFrame:
    """The table, or the source's rows if the table is empty."""
    return upsert(table, source, table.columns[0]) if table.isEmpty() else table


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, label: one label a line, of files small enough for one task each."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("ordinal", "label"))
    return lines.where(F.trim("label") != "")


def csv_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header; an error if a required column is missing. All columns are text."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return rows


def zip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """category, file: the manifest.json in a zip file."""
    with zipfile.ZipFile(path) as z:
        files = json.loads(z.read("manifest.json")).get("files", [])
    return spark.createDataFrame([(f.get("category"), f.get("file")) for f in files], "category string, file string")


def write_zip_manifest(rows: DataFrame, path: str) -> None:
    """A contribution: its manifest of category and file."""
    files = [{"category": r["category"], "file": r["file"]} for r in rows.select("category", "file").toLocalIterator()]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"files": files}))


def image_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, label, length of files in root/<LABEL>/; folders whose name begins with an underscore are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rows = files.withColumn("label", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return rows.where(~F.startswith("label", F.lit("_")))


def language_pack(spark: SparkSession, path: str) -> DataFrame:
    """key, text of a tab-separated pack; blank lines and comments (#) are passed over, a key that occurs twice is an error."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    parts = F.split("value", "\t", 2)
    rows = lines.select(F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError(f"a key occurs twice in {path}")
    return rows


def xml_strings(spark: SparkSession, path: str) -> DataFrame:
    """key, text of the string elements of resource files."""
    pattern = r'(?s)<string name="([^"]+)"[^>]*>(.*?)</string>'
    whole = spark.read.text(path, wholetext=True)
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("text"))
    return whole.select(F.explode(pairs).alias("p")).select("p.key", "p.text")


def credits_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All credit files together; of rows with one key the last file's, then the last line's, stays."""
    rows = spark.read.csv(path, header=True).withColumns({"_f": F.input_file_name(), "_n": F.monotonically_increasing_id()})
    last = rows.groupBy(*keys).agg(F.max(F.struct("_f", "_n", F.struct(*[c for c in rows.columns if c not in keys and c not in ("_f", "_n")]).alias("r"))).alias("m"))
    return last.select(*keys, "m.r.*")


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)


def settings(rows: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """One row of typed settings from (key, value) rows; keys that are missing are null."""
    return rows.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(t).alias(k) for k, t in kinds.items()])


def service_verdicts(local: DataFrame, remote: DataFrame, id: str = "id", most: float = 0.8) -> DataFrame:
    """local verdicts (id, category, confidence) replaced by a service's where it has one; its confidence counts to most."""
    r = remote.select(F.col(id).alias("_i"), F.col("category").alias("_c"), F.least("confidence", F.lit(most)).alias("_k"))
    both = local.join(r, F.col(id) == F.col("_i"), "left")
    return both.withColumns({"category": F.coalesce("_c", "category"), "confidence": F.coalesce("_k", "confidence")}).drop("_i", "_c", "_k")
