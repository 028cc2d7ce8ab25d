"""Every labelled row takes part in the classifier: none of them is only in a sample's place."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from weft.llm import common, toxicity


def _labelled(spark, n=2000):
    y = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, 1).otherwise(0)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), y.alias("toxic"))
    words = F.concat(F.lit("plain words stand here number"), (F.col("doc_id") % 97).cast("string"))
    docs = rows.select("doc_id", F.when(F.col("toxic") == 1, F.concat(words, F.lit(" vileword "), words)).otherwise(words).alias("text"), F.lit("en").alias("lang"))
    return docs, rows


def test_rows_beyond_the_sample_change_the_weights(spark):
    docs, labels = _labelled(spark)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(15)) >= 3)
    tiny = {r[0] for y in (0, 1) for r in chosen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(1))).limit(20).select("doc_id").collect()}
    other = docs.withColumn("text", F.when(F.col("doc_id").isin(list(tiny)), F.col("text")).otherwise(F.replace("text", F.lit("vileword"), F.lit("newword"))))
    a, b = (toxicity.train(d, labels, most_of_each=20) for d in (docs, other))
    said = spark.createDataFrame([("plain words newword here", "en")], "text string, lang string")
    assert toxicity.score(said, b).first()["score"] > toxicity.score(said, a).first()["score"] + 0.1


def test_thresholds_count_every_row(spark):
    docs, labels = _labelled(spark, 3000)
    net = toxicity.train(docs, labels, most_of_each=100)
    known = docs.join(labels.withColumnRenamed("toxic", "__weft_y"), "doc_id")
    got = toxicity.thresholds(known, net, "text", "doc_id", "lang")
    rows = toxicity.score(known.select("text", "__weft_y"), net).toPandas()
    assert got == {"en": toxicity.best_threshold(rows["score"].to_numpy(), rows["__weft_y"].to_numpy(), np.ones(len(rows)))}


def test_parts_are_averaged(spark):
    docs, labels = _labelled(spark)
    net = toxicity.ConvNet()
    sums = [np.full_like(p, 1.0) for p in (net.emb, net.conv, net.bias, net.top, net.base)]
    known = docs.join(labels.withColumnRenamed("toxic", "__weft_y"), "doc_id")
    start = net.emb.copy()
    toxicity.refine(known, net, sums, "text", "doc_id", 2000, part=300)
    again = toxicity.ConvNet()
    toxicity.refine(known.repartition(7), again, sums, "text", "doc_id", 2000, part=300)
    assert np.array_equal(net.emb, again.emb) and not np.array_equal(net.emb, start) and np.isfinite(net.emb).all()


def test_driver_gives_garbage_of_its_jvm_back(spark, monkeypatch):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    ref = jvm.java.lang.ref.WeakReference(gateway.new_array(jvm.byte, 1 << 20))
    common.rest(spark)
    assert ref.get() is None
    times = []
    monkeypatch.setattr(toxicity, "rest", times.append)
    toxicity.train(*_labelled(spark, 60))
    assert len(times) == 3  # before the texts come, after the first fit, after the thresholds


def test_buckets_of_many_words_take_little_memory():
    words = [b"word%d" % i for i in range(100_000)]
    tracemalloc.start()
    rows = toxicity.bucket_rows(words, len(words), 1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[:50].tolist() == [toxicity.buckets_of(w, 1 << 17) for w in words[:50]] and peak < 2 * rows.nbytes + 100_000
