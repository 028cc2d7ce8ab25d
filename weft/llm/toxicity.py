"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import WORD, checked, rest, stored, text_of, tidy

#: Bytes that are no part of a word become blanks: ASCII but for letters, digits and the underscore.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
TRIES = np.linspace(0.2, 0.8, 25)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def buckets_of(word: bytes, size: int) -> list[int]:
    """The rows of the embedding table whose sum is the word's embedding: the word's and those of its beginnings."""
    return [zlib.crc32(word) % size] + [zlib.crc32(word[:p], 7 + p) % size for p in PREFIXES]


def bucket_rows(words: Iterable[bytes], n: int, size: int) -> np.ndarray:
    """buckets_of() the n words, a row each, without a Python list for every word."""
    wide = 1 + len(PREFIXES)
    return np.fromiter((b for w in words for b in buckets_of(w, size)), np.int32, n * wide).reshape(-1, wide)


@dataclass
class ConvNet:
    """Filters of several widths over the words, their maxima over the whole text, and a logistic unit on these.

    A filter's answer at a place is a sum over its words of a product of the word's embedding with the filter's part for that
    place; so each distinct word needs these products once (table), and a text needs only sums and maxima.
    """

    size: int = 1 << 17
    dim: int = 16
    filters: int = 8
    seed: int = 11
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.parts = [(w, j) for w in range(len(WIDTHS)) for j in range(WIDTHS[w])]
        self.emb = rng.normal(0, 0.1, (self.size, self.dim)).astype(np.float32)
        self.conv = rng.normal(0, 0.3, (self.dim, len(self.parts) * self.filters)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * self.filters, np.float32)
        self.top = rng.normal(0, 0.3, len(WIDTHS) * self.filters).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def table(self, rows: np.ndarray) -> np.ndarray:
        """Words (as bucket rows) to their products with all filter parts."""
        return self.emb[rows].sum(axis=1) @ self.conv

    def answers(self, got: np.ndarray) -> list[np.ndarray]:
        """By width, the filters' answers at all places of one text (got: its words' table rows); short texts are padded with zeros."""
        if len(got) < max(WIDTHS):
            got = np.concatenate([got, np.zeros((max(WIDTHS) - len(got), got.shape[1]), np.float32)])
        out, k = [], 0
        for w in WIDTHS:
            n = len(got) - w + 1
            total = got[:n, k * self.filters : (k + 1) * self.filters].copy()
            for j in range(1, w):
                total += got[j : j + n, (k + j) * self.filters : (k + j + 1) * self.filters]
            out.append(total)
            k += w
        return out

    def logit(self, got: np.ndarray) -> float:
        pooled = np.concatenate([a.max(axis=0) for a in self.answers(got)]) + self.bias
        return float(np.maximum(pooled, 0) @ self.top + self.base[0])

    def _start(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, least: float = 3.0) -> None:
        """The first component of the embeddings starts from how far each bucket tells the labels apart.

        It is the root of the log-likelihood ratio of the bucket's documents by label, as far as that exceeds least, for
        buckets more frequent under label 1; the first filter of each width reads it. With few rows this points the
        maxima at telling words from the first epoch on, rather than at rare ones that are learnt by heart.
        """
        held = np.zeros((2, self.size))
        for d, y in zip(docs, labels, strict=True):
            held[int(y), np.unique(rows[d])] += 1
        total = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            both, gain = held.sum(axis=0) / total.sum(), np.zeros(self.size)
            for x, n in ((held, total), (total - held, total)):
                share = both if x is held else 1 - both
                gain += np.nan_to_num(2 * x * np.log(x / (n * share)), nan=0.0, posinf=0.0, neginf=0.0).sum(axis=0)
            more = held[1] / total[1] > held[0] / total[0]
        self.emb[:, 0] = np.where(more, np.clip((np.sqrt(np.maximum(gain, 0)) - least) / least, 0, 2), 0)
        for k, (w, _) in enumerate(self.parts):
            self.conv[0, k * self.filters : (k + 1) * self.filters] = 0
            self.conv[0, k * self.filters] = 1.0
            self.top[w * self.filters] = 1.0

    def fit(self, docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.03, l2: float = 1e-5, sums: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Adagrad over shuffled batches; the gradient of a maximum goes to the place where it is.

        docs: each text's words as row numbers of rows, which holds the buckets of each word. Returns Adagrad's sums; with those of an earlier call it goes on.
        """
        if sums is None:
            self._start(docs, rows, labels)
        sums = sums or [np.full_like(p, 1e-3) for p in (self.emb, self.conv, self.bias, self.top, self.base)]
        rng = np.random.default_rng(self.seed)
        nf = self.filters
        for epoch in range(epochs):
            lr = rate / (1 + 0.3 * epoch)
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                uniq, where = np.unique(np.concatenate([docs[i] for i in some] or [np.zeros(0, np.int64)]), return_inverse=True)
                emb = self.emb[rows[uniq]].sum(axis=1)
                table = emb @ self.conv
                d_table: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                d_bias, d_top, d_base = np.zeros_like(self.bias), np.zeros_like(self.top), 0.0
                start = 0
                for i in some:
                    own = where[start : start + len(docs[i])]
                    start += len(docs[i])
                    answers = self.answers(table[own])
                    places = [a.argmax(axis=0) for a in answers]
                    pooled = np.concatenate([a[p, np.arange(nf)] for a, p in zip(answers, places, strict=True)]) + self.bias
                    act = np.maximum(pooled, 0)
                    err = 1 / (1 + np.exp(-np.clip(act @ self.top + self.base[0], -30, 30))) - labels[i]
                    d_top += err * act
                    d_base += err
                    d_pool = np.where(pooled > 0, err * self.top, 0).astype(np.float32)
                    d_bias += d_pool
                    k = 0
                    for w, (width, p) in enumerate(zip(WIDTHS, places, strict=True)):
                        for j in range(width):
                            spot = p + j
                            real = spot < len(own)
                            if real.any():
                                d_table.append((own[spot[real]], (k + j) * nf + np.flatnonzero(real), d_pool[w * nf : (w + 1) * nf][real]))
                        k += width
                n = len(some)
                if d_table:
                    r, c, v = (np.concatenate(x) for x in zip(*d_table, strict=True))
                    touched, short = np.unique(r, return_inverse=True)
                    grad = np.zeros((len(touched), table.shape[1]), np.float32)
                    np.add.at(grad, (short, c), v / n)
                    d_conv = emb[touched].T @ grad + l2 * self.conv
                    back = grad @ self.conv.T
                    cells, inverse = np.unique(rows[uniq[touched]], return_inverse=True)
                    d_emb = np.zeros((len(cells), self.dim), np.float32)
                    np.add.at(d_emb, inverse.reshape(-1), np.repeat(back, rows.shape[1], axis=0))
                    sums[0][cells] += d_emb**2
                    self.emb[cells] -= lr * d_emb / np.sqrt(sums[0][cells])
                    sums[1] += d_conv**2
                    self.conv -= lr * d_conv / np.sqrt(sums[1])
                for p, s, g in ((self.bias, sums[2], d_bias / n), (self.top, sums[3], d_top / n), (self.base, sums[4], np.array([d_base / n], np.float32))):
                    s += g**2
                    p -= lr * g / np.sqrt(s)
        return sums


class Scorer:
    """A net's scores of texts; the table rows of words are remembered, up to most of them."""

    def __init__(self, net: ConvNet, most: int = 200_000):
        self.net, self.most = net, most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.net.conv.shape[1]), np.float32)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        get = self.number.get
        if new := [w for w in dict.fromkeys(words) if w not in self.number]:
            if len(self.number) > self.most:
                self._forget()
                new = list(dict.fromkeys(words))
                get = self.number.get
            at = len(self.number)
            while len(self.rows) < at + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(new)] = self.net.table(np.array([buckets_of(w, self.net.size) for w in new], dtype=np.int64))
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
        x = self.net.logit(self.rows[np.fromiter(map(get, words), np.int64, len(words))])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", id: str = "doc_id", most_of_each: int = 5000, epochs: int = 8, most_words: int = 4_000_000) -> ConvNet:
    """A net fitted on those rows of docs (id, text, lang) that labels (id, label 0 or 1) names.

    Ids that are labelled twice have the larger label. A fifth of the labelled ids, by a hash (of fewer than 1000 a third, for its languages), fits no weights (with fewer than 50 labelled, all do both): all their rows give the
    thresholds, by language the one of the best F1. Weights start on a bounded sample: of the rows of at most most_of_each other ids of either label, those with the smallest hash, in order of
    it and each once, at most 2 * most_of_each whole texts, and so many as have most_words words together, come to the driver. Then all rows of the other labelled ids take part in
    one more pass, by refine(). The base rate is that of all labelled rows. lang plays no part in a score. Without any row of one label, every score is the other's share.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).alias("__weft_y"))
    known = docs.select(id).distinct().join(marks, id)
    shares = {r[0]: r[1] for r in known.groupBy("__weft_y").count().collect()}
    net, spark = ConvNet(), docs.sparkSession
    if len(shares) < 2:
        net.top[:] = 0
        net.base[:] = 30.0 if shares.get(1) else -30.0
        return net
    total = sum(shares.values())
    few = total < 50
    fold = F.pmod(F.xxhash64(F.col(id), F.lit(2)), F.lit(15)) < (5 if total < 1000 else 3)
    learnt, kept = (known, known) if few else (known.where(~fold), known.where(fold))
    chosen = [learnt.where(F.col("__weft_y") == y).orderBy(F.xxhash64(F.col(id), F.lit(1)), id).limit(most_of_each) for y in (0, 1)]
    chosen = stored(chosen[0].unionByName(chosen[1]), "chosen")
    # at most 2 * most_of_each ids; the texts are read where they are
    key = F.struct(F.xxhash64(F.col(id), F.lit(1)).alias("h"), F.col(id).alias("i"), F.xxhash64("__weft_text").alias("t"))
    sample = docs.select(id, text_of(text).alias("__weft_text"), lang).join(F.broadcast(chosen), id).withColumn("__weft_key", key)
    count = F.regexp_count("__weft_text", F.lit(WORD))
    sizes = sample.select("__weft_key", count.alias("n")).distinct().orderBy("__weft_key").limit(2 * most_of_each).toPandas()  # figures only
    last = sizes["__weft_key"][max(0, int((sizes.n.cumsum() <= most_words).sum()) - 1)]
    id_kind = docs.schema[id].dataType
    end = F.struct(F.lit(last[0]).cast("long").alias("h"), F.lit(last[1]).cast(id_kind).alias("i"), F.lit(last[2]).cast("long").alias("t"))
    sample = sample.where(F.col("__weft_key") <= end).dropDuplicates(["__weft_key"]).sort("__weft_key")
    rest(spark)  # before the texts come and the weights start here
    vocab: dict[bytes, int] = {}
    own, said = [], []
    for batch in sample.select("__weft_text", "__weft_y").toArrow().to_batches(max_chunksize=200):
        for t, y in zip(batch.column(0), batch.column(1), strict=True):
            words = words_of(t.as_py())
            own.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
            said.append(y.as_py())
    rows = bucket_rows(vocab, len(vocab), net.size)
    vocab.clear()
    y = np.array(said, dtype=np.float32)
    ones, odds = float(y.sum()), shares[1] / shares[0]
    net.base[:] = np.log(max(ones, 1) / max(len(y) - ones, 1))
    sums = net.fit(own, rows, y, epochs)
    # the sample holds more toxic rows than there are among all
    net.base += np.float32(np.log(odds) - np.log(max(ones, 1) / max(len(y) - ones, 1)))
    del own, rows
    rest(spark)
    if not few:
        refine(docs.join(learnt, id), net, sums, text, id, total)
    net.thresholds = thresholds(docs.join(kept, id), net, text, id, lang)
    rest(spark)
    return net


def refine(docs: DataFrame, net: ConvNet, sums: list[np.ndarray], text: str, id: str, n: int, part: int = 20_000, each: int = 1000, rate: float = 0.009) -> None:
    """One more pass over all docs (id, text, __weft_y), each different row once; sums: Adagrad's of the net so far, n: about how many ids there are.

    Rows are dealt by hashes of their ids to parts of about so many, in order of a hash, so the result does not depend on how docs is split. Each part goes on from the net's
    weights; the parts' weights are averaged by their numbers of rows, in pieces, 64 at a time in three steps, so no task holds more than 64 pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net, sums))  # of fixed size
    parts, pieces = max(1, -(-n // part)), 16
    names = ["emb", "conv", "bias", "top", "base"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = copy.deepcopy(shared.value)
        waiting: list[tuple[list[bytes], int]] = []
        total, k, last, held = 0, None, None, 0

        def learn() -> int:
            vocab: dict[bytes, int] = {}
            docs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)) for words, _ in waiting]
            rows = bucket_rows(vocab, len(vocab), own.size)
            own.fit(docs, rows, np.array([y for _, y in waiting], dtype=np.float32), 1, rate=rate, sums=sums)
            done = len(waiting)
            waiting.clear()
            return done

        for batch in batches:
            for t, y, k, key in zip(*[batch.column(c) for c in range(4)], strict=True):  # noqa: B007
                if (key := key.as_py()) == last:
                    continue
                last = key
                waiting.append((words_of(t.as_py()), y.as_py()))
                held += len(waiting[-1][0])
                if len(waiting) >= each or held >= 500_000:
                    total, held = total + learn(), 0
        if waiting:
            total += learn()
        if total:
            flat = np.array_split(np.concatenate([getattr(own, x).ravel() for x in names]), pieces)
            for piece, w in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([k.as_py()], pa.int64()), pa.array([total], pa.int64()), pa.array([(w * np.float32(total)).tobytes()], pa.binary())], ["piece", "k", "n", "w"])

    def added(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("k")
        total = np.sum([np.frombuffer(w, np.float32) for w in table.w], axis=0, dtype=np.float64)
        return pd.DataFrame({"piece": [int(table.piece.iloc[0])], "k": [int(table.k.iloc[0]) // 64], "n": [int(table.n.sum())], "w": [total.astype(np.float32).tobytes()]})

    kind = "piece long, k long, n long, w binary"
    key = F.struct(F.xxhash64(F.col(id), F.lit(3)).alias("h"), F.col(id).alias("i"), F.xxhash64("__weft_text").alias("t"))
    dealt = docs.select(text_of(text).alias("__weft_text"), "__weft_y", F.pmod(F.xxhash64(F.col(id), F.lit(4)), F.lit(parts)).cast("int").alias("k"), id)
    dealt = dealt.select("__weft_text", "__weft_y", "k", key.alias("key"))
    found = dealt.repartitionById(parts, "k").sortWithinPartitions("key").mapInArrow(run, kind)
    for _ in range(3 if parts > 1 else 0):
        found = found.groupBy("piece", F.expr("k div 64").alias("g")).applyInPandas(added, kind)
    at = 0
    got = sorted((r["piece"], r["k"], r["n"], r["w"]) for r in found.collect())  # one set of weights (more only with more than 64 ** 3 parts)
    if not got:
        return
    means = []
    for piece in range(pieces):
        mine = [(m, np.frombuffer(w, np.float32).astype(np.float64)) for q, _, m, w in got if q == piece]
        means.append(sum(w for _, w in mine) / sum(m for m, _ in mine))
    mean = np.concatenate(means).astype(np.float32)
    for x in names:
        old = getattr(net, x)
        setattr(net, x, mean[at : at + old.size].reshape(old.shape))
        at += old.size


def thresholds(docs: DataFrame, net: ConvNet, text: str, id: str, lang: str) -> dict[str, float]:
    """By language, where five or more rows are toxic, best_threshold() over all rows of docs (id, text, lang, __weft_y), each different one once. Rows are counted by the highest threshold they reach."""
    tries = [float(t) for t in TRIES]
    rows = docs.select(id, text_of(text).alias("__weft_text"), F.col(lang).alias("__weft_g"), "__weft_y")
    scored = score(rows, net, "__weft_text").select("score", "__weft_g", "__weft_y", F.struct(id, F.xxhash64("__weft_text").alias("t"), "__weft_g").alias("key")).dropDuplicates(["key"])
    level = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in tries), F.lit(0))
    found = scored.where("__weft_g is not null").groupBy("__weft_g", "__weft_y", level.alias("level")).count().toPandas()
    out = {}
    for g, mine in sorted(found.groupby("__weft_g")):
        y, n = mine["__weft_y"].to_numpy(), mine["count"].to_numpy(dtype=float)
        if n[y == 1].sum() >= 5:
            out[g] = best_threshold(np.array([0.0, *tries])[mine["level"].to_numpy()], y, n)
    return out


def best_threshold(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Of the thresholds from 0.2 to 0.8 with the best weighted F1, one in the lower half."""
    tries, f1 = TRIES, []
    for t in tries:
        said = scores >= t
        hit = (weight * (said & (labels == 1))).sum()
        f1.append(2 * hit / max((weight * said).sum() + (weight * (labels == 1)).sum(), 1e-9))
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(tries[best[len(best) // 4]])


def score(docs: DataFrame, net: ConvNet, text: str = "text", lang: str = "lang", usual: float = 0.5) -> DataFrame:
    """docs with score (double, 0 to 1), threshold (of the row's language, or usual) and toxic (score >= threshold).

    Whole texts are scored, one after the other, so memory follows the longest text alone. Null and empty texts get
    the score of a text without words; repeated rows get the same score; an empty table gives an empty one; columns with the names of
    the new ones are replaced.
    """
    checked(docs, text)
    docs = docs.drop("score", "threshold", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    at = docs.columns.index(text)
    names = [*docs.columns, "score"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            found = pa.array([scorer.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    limit: Column = F.lit(usual)
    if lang in docs.columns:
        for g, t in sorted(net.thresholds.items()):
            limit = F.when(F.col(lang) == g, t).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))
