"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import checked, row_hash

_HASH, _BUCKET, _SIZE = "__weft_hash", "__weft_bucket", "__weft_size"


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8)).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of range(n) by Fisher-Yates swaps from the end, drawn from a seeded generator."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), draws, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 17, text: str = "text", bucket_bytes: int = 64 << 20, min_buckets: int = 64) -> DataFrame:
    """Every row of docs with its shard (int) and slot (long): a uniform random order dealt over n_shards.

    Pass 1 scatters the rows uniformly into buckets of about bucket_bytes by a seeded hash of the whole row and
    counts each bucket. Pass 2 brings each bucket into memory, sorts it by that hash (so that the order in which
    rows arrive plays no part) and shuffles it by Fisher-Yates. A row's place in the whole order is its bucket's
    offset plus its place in the bucket; place modulo n_shards is the shard, the quotient the slot. So shards
    differ by one row at most, and slots run from 0 without gaps. Reruns over the same rows agree.

    Only equal whole rows share a hash. A bucket that they fill to more than 4 * bucket_bytes is scattered again
    by row number into pieces of bucket_bytes, so no bucket is larger than memory allows however often a row repeats;
    only in such a bucket, for the repeated rows and the others that share it, does the place depend on how the input is partitioned.

    The driver holds two numbers for each bucket: rows / bucket_bytes of them, about 1.6 million at 100 TB.

    Null text: size 8. Null ids, repeated rows and long texts are rows like others. An empty table gives an
    empty one. Columns named shard or slot are replaced.
    """
    checked(docs, text)
    docs = docs.drop("shard", "slot")
    sized = docs.withColumns({_HASH: row_hash(docs, seed), _SIZE: record_size(text)})
    total = sized.agg(F.sum(_SIZE)).first()[0] or 0
    n_buckets = max(min_buckets, -(-total // bucket_bytes))
    scattered = sized.withColumn(_BUCKET, F.pmod(F.col(_HASH), F.lit(n_buckets)))
    load = scattered.groupBy(_BUCKET).agg(F.count("*").alias("n"), F.sum(_SIZE).alias("bytes")).toArrow()
    bucket, rows, size = (load.column(c).to_numpy() for c in (_BUCKET, "n", "bytes"))
    if (hot := size > 4 * bucket_bytes).any():
        pieces = -(-size[hot] // bucket_bytes)
        first = n_buckets + np.cumsum(pieces) - pieces  # numbers of their own, after the others
        splits = docs.sparkSession.createDataFrame([(int(b), int(k), int(f)) for b, k, f in zip(bucket[hot], pieces, first, strict=True)], f"{_BUCKET} long, __weft_k long, __weft_first long")
        again = F.col("__weft_first") + F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.col("__weft_k"))
        # at most a quarter of the buckets are hot: three numbers each
        scattered = scattered.join(F.broadcast(splits), _BUCKET, "left").withColumn(_BUCKET, F.coalesce(again, F.col(_BUCKET))).drop("__weft_k", "__weft_first")
        load = scattered.groupBy(_BUCKET).agg(F.count("*").alias("n")).toArrow()
        bucket, rows = (load.column(c).to_numpy() for c in (_BUCKET, "n"))
    order = np.argsort(bucket)
    offsets = docs.sparkSession.sparkContext.broadcast((bucket[order], np.cumsum(rows[order]) - rows[order]))

    def deal(key, table):
        b = key[0].as_py()
        names, starts = offsets.value
        table = table.take(pa.array(np.argsort(table.column(_HASH).to_numpy(), kind="stable")))
        place = np.empty(table.num_rows, dtype=np.int64)
        place[fisher_yates(table.num_rows, [seed, b])] = np.arange(table.num_rows) + starts[np.searchsorted(names, b)]
        table = table.drop_columns([_HASH, _BUCKET, _SIZE])
        return table.append_column("shard", pa.array((place % n_shards).astype(np.int32))).append_column("slot", pa.array(place // n_shards))

    out = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return scattered.groupBy(_BUCKET).applyInArrow(deal, out)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard, its files in order of slot."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
