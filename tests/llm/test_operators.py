"""Each operator on small rows: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, kdtree, line_dedup, minhash, mixing, sharding, syncmers, toxicity
from weft.llm.common import text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an operator might use for itself.
CLASH = ["size", "shard", "slot", "bucket", "score", "node", "keys", "target", "taken", "ids", "anchors", "n_lines", "word", "c", "h", "t", "i", "s"]


def rows(n=40, seed=1):
    rng = random.Random(seed)
    words = "the and of to in that erst shon anders welt".split()
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 4)))
        out.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None]), len(text)))
    return out


EDGE = [(100, None, "en", "a", None), (101, "", None, None, 0), (None, " \t\n ", "en", "b", 4), (102, "x" * 30_000, "en", "a", 30_000), (103, "word " * 5000, "en", "a", 25_000), (103, "word " * 5000, "en", "a", 25_000), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows() + EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


# 1


def test_shards_hold_every_row_once(docs):
    found = sharding.shard(docs, 5, min_buckets=8).toPandas()
    n = docs.count()
    assert len(found) == n and sorted(found.groupby("shard").size()) == sorted(n // 5 + (k < n % 5) for k in range(5))
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_shards_do_not_depend_on_the_input_partitions(docs):
    same = lambda df: sorted(map(repr, sharding.shard(df, 5).select("doc_id", "text", "shard", "slot").collect()))
    assert same(docs.repartition(7)) == same(docs.coalesce(1))


def test_a_hot_row_is_scattered_again(spark):
    df = spark.createDataFrame([(1, "copy" * 100)] * 3000 + [(i, "x") for i in range(2, 50)], "doc_id long, text string")
    found = sharding.shard(df, 4, bucket_bytes=20_000, min_buckets=4).toPandas()
    assert len(found) == 3048 and found.groupby("shard").slot.max().max() == 761


def test_shards_of_clashing_and_empty_tables(clashing, empty):
    assert sharding.shard(empty, 3).count() == 0
    found = sharding.shard(clashing, 3)
    assert found.schema["shard"].dataType.typeName() == "integer" and found.select("bucket").first()[0] == "own bucket"


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(100, [1])) == list(range(100)) and sharding.fisher_yates(0, [1]).size == 0


# 3


def brute_top(vectors, queries, k):
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors}
    out = set()
    for q in queries:
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard_rows,growth", [(10_000, 4), (40, 2)])
def test_top_k_against_brute_force(spark, shard_rows, growth):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 6).round(1)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 360)]
    bad = [(900, None), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [float("nan")] * 6), (600, [float("inf")] * 6), (None, [1.0] * 6), (500, [])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("shard", F.lit("own")).withColumn("score", F.lit("own"))
    found = {tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shard_rows, growth=growth).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute_top(vectors, [i for i, _ in vectors if i % 20 == 0], 5)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kdtree.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 5 * 1024 * 1024)]
    assert kdtree.top_k(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_top_k_of_several_lengths_and_repeated_ids(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)] + [(i, [1.0, float(i % 5), 2.0]) for i in range(30, 60)] + [(10, [50.0, 50.0]), (10, [0.0, 0.0]), (40, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [kdtree.top_k(x, F.col("vec_id") % 10 == 0, 4, shard_rows=8, growth=2).orderBy("query_id", "rank").collect() for x in (df.coalesce(1), df.repartition(5))]
    assert found[0] == found[1]
    query = {i: min(v for j, v in rows if j == i) for i in range(0, 60, 10)}
    for i, q in query.items():
        best = sorted((-1024 * 1024 * sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q))[:4]
        assert [(r.vec_id, r.score) for r in found[0] if r.query_id == i] == [(j, -s) for s, j in best]


def test_top_k_of_huge_rows(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1e12, 3.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = kdtree.top_k(df, F.col("vec_id").isin(3), 2, scale=16.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 256 * (10**12 + 3)), (1, 256 * (10**12 + 2))]


def test_top_k_of_huge_numbers():
    both = kdtree.exact_numbers([[1e15, 1.0], [1e15, 2.0]], 1024)
    tree = kdtree.KDTree(np.array([1, 2]), both)
    assert tree.search(both[0], 1, 1)[0] == ((1024 * 10**15) ** 2 + 2 * 1024**2, 2)


# 4


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    data = [(i, "w " * rng.randint(1, 60), "en", rng.choice("aaaaaabcde"), 0) for i in range(1500)] + EDGE
    found = mixing.mix(spark.createDataFrame(data, SCHEMA)).toPandas()
    assert len(found) == len(data) and (found.taken <= 3 * found["size"]).all()
    by = found.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-6).all() and (abs(by.taken - by.target) <= 0.02 * by.target + 30).all()


def test_mix_again_and_elsewhere_is_the_same(docs):
    same = lambda df: sorted(map(repr, mixing.mix(df).select("doc_id", "text", "taken").collect()))
    assert same(docs.repartition(5)) == same(docs.coalesce(1))


def test_mix_of_clashing_wordless_and_empty(clashing, empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.mix(clashing).select("word").first()[0] == "own word"
    assert mixing.mix(docs.where("text is null or trim(text) = ''")).agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


def test_mix_meets_targets_of_small_sources(spark):
    sizes = {"hot": 3000, "b": 7, "c": 120, "d": 131, "e": 61, "f": 1}
    data = [(f"{s} w{k}", s) for s, n in sizes.items() for k in range(n)]
    found = mixing.mix(spark.createDataFrame(data, "text string, source string"), min_slots=64).toPandas()
    by = found.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (by.taken == np.floor(by.target + 0.5)).all() and (by.taken > 0).all() and (found.taken <= 3 * found["size"]).all()


def test_targets_are_shared_anew():
    assert mixing.targets([("a", 10), ("b", 100), ("c", 0)]) == [30.0, 80.0, 0.0] and mixing.targets([]) == []


# 5


def test_training_adds_to_the_start():
    """What is toxic is the order of two words, which no word alone tells: the fitted net knows it, its start doesn't."""
    rng = random.Random(8)
    words = ["w0", "w1", "w2", "w3", "hate", "you"]
    docs, labels = [], []
    for i in range(600):
        d = [rng.randrange(4) for _ in range(12)]
        at = rng.randrange(11)
        d[at : at + 2] = [4, 5] if i % 2 else [5, 4]
        docs.append(np.array(d, np.int32))
        labels.append(float(i % 2))
    rows = np.array([toxicity.buckets_of(w.encode(), 1 << 12) for w in words], np.int32)
    y = np.array(labels, np.float32)
    share = {}
    for epochs in (0, 30):
        net = toxicity.ConvNet(size=1 << 12)
        net.fit(docs[:400], rows, y[:400], epochs=epochs)
        said = np.array([net.logit(net.table(rows[d])) > 0 for d in docs[400:]])
        share[epochs] = (said == (y[400:] == 1)).mean()
    assert share[0] < 0.6 and share[30] > 0.9, share


def test_the_sample_is_bounded_by_words(spark):
    data = [(i, ("bad " if i % 2 else "good ") * 500 + f"w{i}", "en") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    net = toxicity.train(docs, labels, most_words=5_100, epochs=2)  # ten texts
    found = toxicity.score(docs, net).groupBy(F.col("doc_id") % 2).agg(F.avg("score").alias("s")).orderBy("s").collect()
    assert found[0].s < found[1].s


def toxic_rows(n=400):
    rng = random.Random(2)
    calm, bad = [f"w{k}" for k in range(200)], ["scum", "idiot", "pathetic"]
    out = []
    for i in range(n):
        words, y = rng.choices(calm, k=rng.randint(5, 60)), int(rng.random() < 0.3)
        for _ in range(2 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), rng.choice(["en", "de"]), y))
    return out


def test_toxicity_learns(spark):
    df = spark.createDataFrame(toxic_rows(), "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(df.where("doc_id % 4 <> 2").drop("toxic"), df.select("doc_id", "toxic"))
    held = toxicity.score(df.where("doc_id % 4 = 2").withColumnRenamed("toxic", "y"), net).toPandas()
    assert ((held.score >= 0.3) == (held.y == 1)).mean() > 0.95 and (held.toxic == (held.y == 1)).mean() > 0.95 and set(net.thresholds) == {"en", "de"}


def test_toxicity_of_edges(docs, clashing, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, epochs=1)
    found = toxicity.score(clashing, net)
    scores = {repr(r.text): r.score for r in found.collect()}
    assert found.count() == docs.count() and all(0 <= s <= 1 for s in scores.values()) and scores["None"] == scores["''"]
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.score(docs, toxicity.train(empty, labels)).agg(F.max("score")).first()[0] < 1e-6


def lm_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# 7


def test_syncmers_are_context_free(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choices([f"w{k}" for k in range(50)], k=60))
    df = spark.createDataFrame([(1, passage), (2, "before it " + passage + " and after"), (3, passage)], "doc_id long, text string")
    found = {r.doc_id: r for r in syncmers.fingerprint(df).collect()}
    first = [(a.pos, a.hash) for a in found[1].anchors]
    inside = [(a.pos - 2, a.hash) for a in found[2].anchors if 0 <= a.pos - 2 <= 60 - syncmers.K]
    assert first == inside and found[1].fingerprint == found[3].fingerprint != found[2].fingerprint
    assert len(first) < 57
    shift = syncmers.matched_passages(syncmers.fingerprint(df.where("doc_id = 1")), syncmers.fingerprint(df.where("doc_id = 2"))).orderBy(F.desc("anchors")).first()
    assert shift["shift"] == 2


def test_syncmers_choose_by_the_least_inner_substring(spark):
    words = "a b c d e f g h a b c d".split()
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    pairs = [spark.range(1).select(F.xxhash64(F.lit(a), F.lit(b))).first()[0] for a, b in zip(words, words[1:], strict=False)]
    want = [i for i in range(len(words) - 3) if min(pairs[i : i + 3]) in (pairs[i], pairs[i + 2])]
    assert [a.pos for a in syncmers.fingerprint(df).first().anchors] == want


def test_next_text_in_descending_order(spark):
    data = [(i, f"text {i}") for i in range(300)] + [(7, "text 7")] * 40 + [(None, "none"), (5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for rows_each in (10_000, 20):
        found = syncmers.with_next(df, rows_each=rows_each).collect()
        by = {r.doc_id: r.next_text for r in found if r.doc_id not in (5, 7)}
        assert len(found) == len(data) and all(by[i] == f"text {i - 1}" for i in range(8, 300) if i - 1 not in (5, 7)) and by[None] == "text 299" and by[0] == "none"
        assert sum(r.next_text == "text 7" for r in found) == 41


def test_spans_are_ordered_by_blocks(spark, monkeypatch):
    data = [(i * 3, f"text {i * 3}") for i in range(400)]
    want = {i: f"text {i - 3 if i else 1197}" for i, _ in data}
    for spans in (1, 2, 7):
        monkeypatch.setattr(syncmers, "SPANS", spans)
        found = syncmers.with_next(spark.createDataFrame(data, "doc_id long, text string").repartition(3), rows_each=10).collect()
        assert {r.doc_id: r.next_text for r in found} == want


def test_likeness_counts_repeated_anchors(spark):
    """Beside brute force over multisets: a text of one word again and again keeps half of its anchors with half of it."""
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choices("ash bay elm fir oak".split(), k=n))
    pairs = [("dull " * 400, "dull " * 200 + word(200)), (word(300), word(300)), ("dull " * 30, ""), (word(40) * 5, word(40) * 2), ("", ""), ("one two three four", "one two three four")]
    kinds = [F.lit(False), F.lit(True)]
    for letters in kinds:
        a, b = (syncmers.anchors(F.col(x), letters) for x in "ab")
        rows = spark.createDataFrame(pairs, "a string, b string").select(a.alias("a"), b.alias("b"), syncmers.likeness(syncmers.hashes(a), syncmers.hashes(b)).alias("near")).collect()
        for r in rows:
            x, y = (Counter(p.hash for p in side) for side in (r.a, r.b))
            assert r.near == (2 * (x & y).total() / (x.total() + y.total()) if x or y else 1.0)
    half = spark.createDataFrame(pairs[:1], "a string, b string").select(syncmers.likeness(*[syncmers.hashes(syncmers.anchors(F.col(x), kinds[0])) for x in "ab"])).first()[0]
    assert 0.4 < half < 0.6


def test_fingerprints_of_edges(docs, clashing, empty):
    found = {repr(r.text)[:20]: r for r in syncmers.fingerprint(clashing).collect()}
    assert found["None"].anchors == [] and found["None"].fingerprint == found["''"].fingerprint
    assert syncmers.fingerprint(empty).count() == 0 and syncmers.with_next(empty).count() == 0 and syncmers.with_next(docs.limit(1)).count() == 1


def test_syncmers_of_few_and_long_words(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghij", k=400))
    prose = " ".join(rng.choices([f"w{k}" for k in range(50)], k=12))
    pairs = [("a striking likeness", "a striking likenesz"), (long, long[:200] + "".join(rng.choices("klmno", k=200))), ("日本語の文章は空白で区切られない", "日本語の文章は空白で区切らない"), (prose, prose.rsplit(" ", 1)[0])]
    df = spark.createDataFrame(pairs, "a string, b string")
    hashes, letters = ([f(F.col(c)) for c in "ab"] for f in (lambda c: syncmers.hashes(syncmers.anchors(c)), syncmers.by_letters))
    both = [syncmers.hashes_beside(F.col(c), hashes[k], letters[k], letters[1 - k]) for k, c in enumerate("ab")]
    found = [r[0] for r in df.select(syncmers.likeness(*both)).collect()]
    assert all(x > 0.4 for x in found) and 0.4 < found[1] < 0.6
    edges = [("Ab\n cd", "Ab cd"), ("abcde", "abcdf"), ("😀" * 3, "😀" * 3), (" ", "")]
    got = spark.createDataFrame(edges, "a string, b string").select(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).collect()
    assert [a == b for a, b in got] == [True, False, True, True] and [len(a) for a, _ in got] == [1, 1, 1, 0]


# 8


def brute_groups(data, k, percent):
    sets, parent = [], list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in data:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(data) if d is not None)


def family(n, seed):
    """A text and copies with more and more words changed: links form chains."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(80)]
    out, texts = [], [base]
    for _ in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts.append(t)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, words, percent):
    texts = family(90, 1) + family(60, 2) + ["alone", "Alone ", "a b c d e f", None, "", " "] + [family(1, 9)[0]] * 5
    data = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("node", F.lit("own")).withColumn("keys", F.lit("own"))
    found = minhash.near_duplicates(df, words=words, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_groups(data, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_edges(docs, empty):
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == docs.count() and minhash.near_duplicates(empty).count() == 0 and minhash.one_of_each(empty).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.where("doc_id = 103").count() == 1 and kept.columns == docs.columns


def test_estimates_are_near_the_similarity(spark):
    signer, known = minhash.Signer(25, 4), minhash.WordHash()
    a, b = (minhash.shingle_set(" ".join(f"w{i}" for i in r), 1, known) for r in (range(300), range(60, 360)))
    df = spark.createDataFrame([([int(x) for x in signer.sign(a)[1]], [int(x) for x in signer.sign(b)[1]])], "a array<long>, b array<long>")
    assert abs(df.select(minhash.similarity("a", "b", 100)).first()[0] - 240 / 360) < 0.2


# 9


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(lm_path()), random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in ("ab", "theandonrst", "äößé日本🙂 ", ".,!? \n\t'sre", "0123456789 ", "the<|endoftext|> ") for _ in range(25)]
    texts += [None, "", "x" * 20_000, "abcab" * 4000, " " * 3000 + "a", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("decoded", F.lit(1))
    for r in bpe.encode(df, lm_path(), leaf=16, batch_chars=500).collect():
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.where("doc_id < 0"), lm_path()).count() == 0


# 10


def brute_lines(texts, enough):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    lines = [(t or "").split("\n") for t in texts]
    held: dict = {}
    for own in lines:
        for k in {key(x) for x in own} - {""}:
            held[k] = held.get(k, 0) + 1
    out = []
    for own in lines:
        left = [x for x in own if held.get(key(x), 0) < enough]
        out.append((len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_common_lines_against_brute_force(spark, batches, fanout):
    rng = random.Random(6)
    pool = ["Hot line", " hot LINE\t", "second", "", "  ", "Ünder", "ünder"] + [f"own {k}" for k in range(60)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(120)] + [None, "", "hot line", "hot line", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("key", "n", "n_lines", "t", "keys")])
    found = line_dedup.drop_common_lines(df, batches=batches, fanout=fanout).select("n_lines", "n_dropped", F.sha2(text_of(), 256)).collect()
    assert sorted(map(tuple, found)) == brute_lines(texts, 10)


def test_common_lines_of_an_empty_table(empty):
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, enough=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (10 + k, 1, 1)], "key long, key2 int, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and {tuple(r) for r in runs.counts().collect()} >= {(1, 1, 3), (14, 1, 1)}
