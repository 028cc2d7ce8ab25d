"""LM scoring against a brute-force model, finite differences, and small rows of every odd kind."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import lm_scoring
from weft.llm.attention import END, Attention, Vocabulary, windows

SCHEMA = "doc_id long, text string"
EDGE = [(100, None), (101, ""), (None, " \t\n "), (102, "x" * 30_000), (103, "word " * 5000), (103, "word " * 5000), (None, None), (104, "naïve CAFÉ 中文 <|endoftext|> \u00a0 tail")]


def lm_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = "the and of to in that erst shon anders welt Unquestionably".split()
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(40)] + EDGE, SCHEMA)


@pytest.fixture(scope="module")
def model(docs):
    return lm_scoring.train(docs.where("doc_id % 5 <> 1"), lm_path(), steps=8, common=3)


def small(n=40, **more):
    return Vocabulary(np.arange(n, 0, -1) + 0.5, 3.5, heads=4, groups=3, own=5, bins=2, **more)


def brute(net: Attention, before: list[int], wanted: int) -> float:
    """The natural logarithm of the probability of a unit after others: one place at a time, whole softmaxes, in float64."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.array([p["emb"][u] + p["pos"][i] for i, u in enumerate(before)])
    d = net.dim
    q, k, v = (x @ p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
    weights = [math.exp(q[-1] @ k[j] / math.sqrt(d)) for j in range(len(x))]
    o = sum(w * v[j] for j, w in enumerate(weights)) / sum(weights)
    h = x[-1] + o @ p["o"]
    log_softmax = lambda z: z - np.log(np.exp(z).sum())
    if wanted < net.heads:
        return log_softmax(h @ p["out"] + p["bias"])[wanted]
    g, i = divmod(wanted - net.heads, net.wide)
    return log_softmax(h @ p["out"] + p["bias"])[net.heads + g] + log_softmax(h @ p["out2"][g] + p["bias2"][g])[i]


def test_first_subwords_are_the_librarys():
    odd = ["\u00a0", "a\u00a0", "\u00a0b", "a\u2003b", "\x1c", "\x1f.", "\x85", "<|endoftext|>", "x<|endoftext|>y", "\ufffd", "'s", "\u0120", "\u0120a", "don't,", "12ab", "...", "\u4e2d\u6587", "\U0001f600", "e\u0301", "\0"]
    rng = random.Random(9)
    words = odd + ["".join(rng.choices("ab\u00e9\u00a0\u3000\u4e2d.,'s12\u0120<|>", k=rng.randint(1, 9))) for _ in range(3000)]
    rng.shuffle(words)
    for together in (1, 7, 100):
        sub = lm_scoring.Subwords(lm_path(), together=together)
        got = sub.of([w.encode() for w in words])
        assert got == [sub.model.encode(" " + w, add_special_tokens=False).ids[0] for w in words]
    assert sub.of([b"\xff", b"\xed\xa0\x80"]) == [sub.model.encode(" " + w.decode("utf-8", "replace"), add_special_tokens=False).ids[0] for w in (b"\xff", b"\xed\xa0\x80")]


def test_words_split_together_are_those_of_each_text():
    rng = random.Random(11)
    texts = [None, "", " ", " \t\n\x0b\x0c\r ", "A b\x1cC\x1f\u00a0d \u00c9\u00e9\u0130 \u2003", "\0 \x85 a"]
    texts += ["".join(rng.choices("aBc\u00c4 \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u4e2d", k=rng.randint(0, 30))) for _ in range(500)] + ["", None]
    for some in (texts, texts[:3], []):
        words, places, sizes = lm_scoring.split_words(pa.array(["cut off", *some], pa.string())[1:])
        assert len(set(words)) == len(words) and sizes.tolist() == [len(lm_scoring.words_of(t)) for t in some]
        assert [words[i] for i in places] == [w for t in some for w in lm_scoring.words_of(t)]
        for n in (1, 7, 10**9):
            found = list(lm_scoring.runs(pa.array(some, pa.string()), n))
            assert [i for a, k in found for i in range(a, a + k)] == list(range(len(some))) and all(k > 0 for _, k in found)
    assert list(lm_scoring.runs(pa.array(["a" * 60, "b", "c", "d" * 60, None]), 3)) == [(0, 1), (1, 3), (4, 1)]


def test_each_different_word_of_texts_is_asked_for_once():
    asked = []

    class Asked(lm_scoring.Subwords):
        def numbers(self, words):
            asked.extend(words)
            return super().numbers(words)

    sub = Asked(lm_path())
    voc = Vocabulary(np.ones(sub.model.get_vocab_size()), 1.5)
    texts = ["The cat the CAT", None, "cat sat " * 50]
    units, sizes = lm_scoring.sequences(texts, sub, voc)
    assert sorted(asked) == [b"cat", b"sat", b"the"] and sizes.tolist() == [4, 0, 100]
    assert units.tolist() == voc.unit[sub.of([w for t in texts for w in lm_scoring.words_of(t)])].tolist()


def test_bytes_that_are_no_text(spark, docs):
    """A file may hold a string column with bytes that are not UTF-8."""
    odd = docs.unionByName(spark.sql("select 900L as doc_id, cast(unhex('74686520FF41C3207468C3') as string) as text"))
    rows, counts = lm_scoring.with_ids(odd, lm_path())
    found = {bytes(r.word): r.c for r in counts.collect()}
    assert found[b"\xffa\xc3"] == found[b"th\xc3"] == 1
    m, c = lm_scoring.train(rows, lm_path(), steps=8, common=3, counts=counts)
    r = lm_scoring.score(rows.where("doc_id = 900"), m, c, keep_text=False).first()
    assert r.n_tokens == 4 and r.n_known == 4


def test_vocabulary_places_every_id():
    voc = small()
    assert len(voc.unit) == 40 and (voc.unit > END).all() and voc.unit.max() < voc.start
    assert sorted(voc.unit[:3].tolist()) == [1, 2, 3]  # the heaviest are heads
    assert len(set(voc.unit[:18].tolist())) == 18  # then own ids, one a unit
    assert math.isclose(voc.weight.sum(), voc.masses.sum() + 3.5)
    first, second = voc.layers()
    assert math.isclose(np.exp(first).sum(), 1) and np.allclose(np.exp(second).sum(axis=1), 1)


def test_windows_count_each_unit_once():
    for step in (3, 6, 8):
        for sizes in ([0], [1], [7], [8], [9], [0, 23, 0, 40, 1]):
            seq = np.random.default_rng(1).integers(1, 9, sum(sizes))
            a, w, text = windows(seq, np.array(sizes), 99, 8, step)
            at = 0
            for k, n in enumerate(sizes):
                own = w[text == k]
                assert own[own >= 0].tolist() == [*seq[at : at + n], END] and a[text == k][0, 0] == 99
                at += n


def test_scores_are_brute_force_ones():
    voc = small()
    net = Attention(voc, dim=8, width=8)
    for v in net.p.values():
        v += np.random.default_rng(5).normal(0, 0.3, v.shape).astype(np.float32)
    units = voc.unit[np.random.default_rng(2).integers(0, 40, 45)]
    a, w, _ = windows(units, np.array([30, 0, 15]), voc.start, 8, 6)
    r, got = net.score(a, w, net.tables(), 6)
    rows, cols = np.nonzero(w >= 0)
    want = {}
    for i, j in zip(rows, cols, strict=True):
        want.setdefault(i, []).append(brute(net, a[i, : j + 1].tolist(), w[i, j]))
    assert len(got) == 48 and all(np.allclose(sorted(got[r == i]), sorted(want[i]), atol=1e-4) for i in want)
    total = sum(math.exp(brute(net, [voc.start, 3], u)) for u in range(voc.start))
    assert abs(total - 1) < 1e-9


def test_scores_out_of_the_range_of_float32():
    z = Attention._chosen(np.ones((2, 1), np.float32), np.array([[200.0, -200.0]], np.float32), np.zeros(2, np.float32), np.array([0, 1]))
    assert np.allclose(z, [0, -400])


def test_gradients_are_finite_differences():
    voc = small()
    net = Attention(voc, dim=4, width=6)
    net.p = {k: (v + np.random.default_rng(7).normal(0, 0.2, v.shape)).astype(np.float64) for k, v in net.p.items()}
    units = voc.unit[np.random.default_rng(3).integers(0, 40, 20)]
    a, w, _ = windows(units, np.array([11, 9]), voc.start, 6, 6)

    def loss() -> float:
        return -np.mean([brute(net, a[i, : j + 1].tolist(), w[i, j]) for i, j in zip(*np.nonzero(w >= 0), strict=True)])

    found, twice = net.gradients(a, w), net.gradients(np.concatenate([a, a[:1]]), np.concatenate([w, w[:1]]))
    weighted = net.gradients(a, w, np.array([2] + [1] * (len(a) - 1)))
    assert all(np.allclose(weighted[k], twice[k], atol=1e-6) for k in twice)
    rng = np.random.default_rng(4)
    for name, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "emb":
                at = (a[0, 1], at[1])
            was = v[at]
            v[at] = was + 1e-4
            up = loss()
            v[at] = was - 1e-4
            down = loss()
            v[at] = was
            assert abs((up - down) / 2e-4 - found[name][at]) < 1e-4, name


def test_base_scores_and_counts(docs, model):
    found = lm_scoring.score(docs, *model).collect()
    train: dict = {}
    for r in docs.where("doc_id % 5 <> 1").collect():
        for w in [*lm_scoring.words_of(r.text), None]:
            train[w] = train.get(w, 0) + 1
    total, kinds = sum(train.values()), len(train)
    assert len(found) == docs.count()
    for r in found:
        words = [*lm_scoring.words_of(r.text), None]
        base = sum(math.log10((train.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        assert r.n_tokens == len(words) and r.n_known == sum(w in train for w in words) and r.train_tokens == total and abs(r.base_score - base) < 1e-9 * max(1, abs(base))


def test_scores_of_texts(docs, model):
    """The whole score of short texts: the attention model's units and the words' shares in them."""
    m, _ = model
    sub = lm_scoring.Subwords(lm_path())
    counts: dict = {}
    for r in docs.where("doc_id % 5 <> 1").collect():
        for w in lm_scoring.words_of(r.text):
            counts[w] = counts.get(w, 0) + 1
    kinds = sub.of(list(counts))
    mass = np.full(sub.model.get_vocab_size(), 0.5)
    for (_, c), k in zip(counts.items(), kinds, strict=True):
        mass[k] += c + 0.5
    whole = np.bincount(m.units.unit, mass)
    n = 0
    for r in lm_scoring.score(docs, *model).collect():
        words = lm_scoring.words_of(r.text)
        if len(words) >= m.net.width:
            continue
        units = [int(m.units.unit[k]) for k in sub.of(words)]
        want = sum(brute(m.net, [m.units.start, *units[:i]], u) for i, u in enumerate([*units, END])) / math.log(10)
        want += sum(math.log10((counts.get(w, 0) + 0.5) / whole[u]) for w, u in zip(words, units, strict=True))
        assert abs(r.score - want) < 1e-3 * max(1, abs(want))
        n += 1
    assert n > 20


def test_fit_does_not_depend_on_the_split(spark, docs):
    one, other = (lm_scoring.train(x, lm_path(), steps=8)[0].net.p for x in (docs.coalesce(1), docs.repartition(6)))
    assert all(np.allclose(one[k], other[k], atol=1e-6) for k in one)


def test_learns_from_all_words_of_a_text(spark):
    words = random.Random(6).choices([f"w{k}" for k in range(30)], k=500)
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    sub = lm_scoring.Subwords(lm_path())
    ids = np.array(sub.of([w.encode() for w in words]))
    voc = Vocabulary(np.bincount(ids, minlength=sub.model.get_vocab_size()) + 0.5, 1.5)
    net, want = (Attention(voc, dim=8, width=16) for _ in "ab")
    a, w, _ = windows(voc.unit[ids], np.array([500]), voc.start, 16, 16)
    memory = {"step": 0, "m": {k: np.zeros_like(v) for k, v in want.p.items()}, "u": {k: np.zeros_like(v) for k, v in want.p.items()}}
    for i in range(0, len(a), 10):
        want.fit(a[i : i + 10], w[i : i + 10], 1, 0.002, 512, memory)
    lm_scoring.refine(df, "text", lm_path(), voc, net, 501, each=10)
    assert (w >= 0).sum() == 501 and memory["step"] == 4 and all(np.allclose(net.p[k], want.p[k], atol=1e-5) for k in want.p)


def test_learning_beats_the_base_on_unseen_text(spark):
    """Words in a fixed order: what comes next is known from what came before, not from counts."""
    cycle = "the cat sat on mat and dog ran to hill".split()
    rng = random.Random(2)

    def text() -> str:
        at = rng.randrange(10)
        return " ".join(cycle[(at + k) % 10] for k in range(30))

    df = spark.createDataFrame([(i, text()) for i in range(300)], SCHEMA)
    m, counts = lm_scoring.train(df.where("doc_id < 250"), lm_path())
    r = lm_scoring.score(df.where("doc_id >= 250"), m, counts).agg(F.avg("score").alias("s"), F.avg("base_score").alias("b")).first()
    assert r.s > 0.5 * r.b  # logarithms: far nearer to 0


def test_clashing_and_empty(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    model, counts = lm_scoring.train(empty, lm_path(), steps=8)
    assert lm_scoring.score(empty, model, counts).count() == 0
    names = ["score", "word", "c", "h", "k", "n", "w", "a", "n_tokens"]
    clashing = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    found = lm_scoring.score(clashing, model, counts)
    assert found.count() == docs.count() and found.agg(F.max("n_known")).first()[0] == 0 and found.select("word").first()[0] == "own word"
    m, c = lm_scoring.train(clashing, lm_path(), steps=8)
    assert lm_scoring.score(docs, m, c).count() == docs.count()


def test_each_text_once_is_as_all_copies(spark, docs):
    """Counts and scores of distinct texts with their copies, against those of all rows under the same model."""
    copied = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id = 3 or doc_id is null"))
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    texts = lm_scoring.distinct_texts(copied, learned=train)
    total = texts.agg(F.sum("copies"), F.sum("learned"), F.count("*"), F.countDistinct("text")).first()
    assert total[0] == copied.count() and total[1] == copied.where(train).count() and total[2] == total[3]
    m, counts = lm_scoring.train(texts.where("learned > 0"), lm_path(), steps=8, common=3, copies="learned")
    plain = lm_scoring.count_words(copied.where(train))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    new = ["n_tokens", "n_known", "train_tokens"]
    want = lm_scoring.score(copied, m, counts).select("doc_id", *new, F.round("base_score", 6), F.round("score", 3)).collect()
    once = lm_scoring.score(texts.drop("learned"), m, counts, keep_text=False)
    for share in (3, 20, 1000):  # no text, some texts and all are broadcast
        got = lm_scoring.for_copies(copied, once, share=share)
        assert got.columns == ["doc_id", *new, "base_score", "score"]
        got = got.select("doc_id", *new, F.round("base_score", 6), F.round("score", 3)).collect()
        odd = lambda r: tuple((x is None, x or 0) for x in r)
        assert all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 0.01 for a, b in zip(sorted(map(tuple, got), key=odd), sorted(map(tuple, want), key=odd), strict=True))
    none = lm_scoring.distinct_texts(copied.where("false"), learned=train)
    assert none.count() == 0 and lm_scoring.for_copies(copied.where("false"), lm_scoring.score(none.drop("learned"), m, counts, keep_text=False)).count() == 0


def test_ids_stored_with_texts_are_those_found_anew(spark, docs, monkeypatch):
    """One pass gives ids and counts; learning and scoring by them are as from the texts, and don't split words into subwords again."""
    rows, counts = lm_scoring.with_ids(docs, lm_path())
    sub = lm_scoring.Subwords(lm_path(), most=3, most_bytes=10)  # forgets again and again
    for r in rows.collect():
        assert np.frombuffer(r[lm_scoring.IDS], np.uint16).tolist() == sub.of(lm_scoring.words_of(r.text))
    assert rows.count() == docs.count() and sorted(counts.select("word", "c").collect()) == sorted(lm_scoring.count_words(docs).collect())
    assert all(r.sub == (sub.of([r.word])[0] if r.word else -1) for r in counts.collect())
    m, c = lm_scoring.train(rows, lm_path(), steps=8, common=3, counts=counts)
    again, _ = lm_scoring.train(docs, lm_path(), steps=8, common=3)
    assert all(np.allclose(m.net.p[k], again.net.p[k], atol=1e-6) for k in m.net.p)
    found, want = (sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm_scoring.score(x, m, c).collect()) for x in (rows, docs))
    assert found == want and lm_scoring.score(rows, m, c).columns[:2] == docs.columns
    m.path = "nowhere"
    assert lm_scoring.score(rows, m, c).count() == docs.count()  # with ids, no tokenizer is read
