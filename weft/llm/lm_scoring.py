"""LM scoring by a causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import contextlib
import copy
import ctypes
import functools
import itertools
import json
import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.attention import END, Attention, Vocabulary, windows
from weft.llm.bpe import PIECES, byte_letters
from weft.llm.common import checked, row_hash, stored, text_of, tidy

#: Fixed value: how a file says that it splits by the pattern of byte-level BPE.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The pieces where the only white space is one blank before each word: no other is looked for.
WORD_PIECES = PIECES.removesuffix(r"|\s+(?!\S)|\s+")
#: The column of with_ids().
IDS = "__weft_ids"
#: The key of the end of a text among the words, none of which is empty.
END_WORD = b""


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """words_of() for many texts at once: the different words, each word's place among these, one text behind the other, and each text's number of words."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    some = pc.greater(pc.binary_length(texts), 0)  # the others would have one empty word
    lists = pc.ascii_split_whitespace(texts.filter(some))
    sizes = np.zeros(len(texts), np.int64)
    sizes[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes


def runs(texts: pa.Array, words: int) -> Iterator[tuple[int, int]]:
    """(from, number): texts that follow one another, with about so many words together; a longer text ends its run."""
    size = np.cumsum(1 + pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64) // 6)
    start = 0
    while start < len(size):
        stop = min(len(size), 1 + int(np.searchsorted(size, words + (size[start - 1] if start else 0))))
        yield start, stop - start
        start = stop


def keep_heap() -> None:
    """Lets the C library keep numpy's freed temporaries for the next ones, instead of mapping pages anew."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 25)  # M_TRIM_THRESHOLD


class Subwords:
    """The first subword id of a whole word behind a blank. Words are remembered; the memory is emptied when it is full.

    Words without white space of any kind inside are encoded many in one string, in which the tokens that begin with the blank begin
    the words, for byte-level pieces don't reach over a blank. The library's ids are found by tiktoken's faster merge loop where the file's ids
    stand in the order of its merges, so that the ids are the ranks. All other words are encoded by the library, each alone.
    """

    def __init__(self, path: str, most: int = 200_000, most_bytes: int = 20_000_000, together: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most, self.most_bytes, self.bytes, self.together = Tokenizer.from_file(path), most, most_bytes, 0, together
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.begins = [False] * self.model.get_vocab_size()
        for token, i in vocab.items():
            self.begins[i] = token.startswith(letters[ord(" ")])
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        plain = {t: i for t, i in vocab.items() if t not in self.added}
        back = {c: b for b, c in enumerate(letters)}
        self.fast = None
        if all(a < b for a, b in zip(made, made[1:])) and len(plain) == 256 + len(made) and spec["pre_tokenizer"] == PLAIN_SPLIT and not spec["normalizer"]:
            import tiktoken

            ranks = {bytes(back[c] for c in t): i for t, i in plain.items()}
            self.fast = tiktoken.Encoding("words", pat_str=WORD_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.number: dict[bytes, int] = {}  # of remembered words, in order
        self.first = np.zeros(1024, np.int32)  # by number

    def full(self) -> bool:
        return len(self.number) > self.most or self.bytes > self.most_bytes

    def forget(self) -> None:
        self.number.clear()
        self.bytes = 0

    def _together(self, texts: list[str]) -> list[int] | None:
        """The first ids of the words, if they can be found in one string."""
        whole = " " + " ".join(texts)
        if not self.fast or whole.split() != texts or any(a in whole for a in self.added):
            return None
        first = [i for i in self.fast(whole) if self.begins[i]]
        return first if len(first) == len(texts) else None

    def _alone(self, texts: list[str]) -> list[int]:
        return [e.ids[0] for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, which hold until forget()."""
        found = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            asked = [words[i] for i in unknown.tolist()]
            new = list(dict.fromkeys(asked))
            at = len(self.number)
            while len(self.first) < at + len(new):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            for i in range(0, len(new), self.together):
                some = new[i : i + self.together]
                texts = b" ".join(some).decode("utf-8", "replace").split(" ")
                first = self._together(texts)
                if first is None:
                    first = [(self._together([t]) or self._alone([t]))[0] for t in texts]
                self.first[at + i : at + i + len(some)] = first
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            found[unknown] = np.arange(at, at + len(new)) if len(new) == len(asked) else [self.number[w] for w in asked]
        return found

    def of(self, words: list[bytes]) -> list[int]:
        if self.full():
            self.forget()
        numbers = self.numbers(words)
        return self.first[numbers].tolist()


@functools.lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    """A worker's own, for all its tasks."""
    return Subwords(path)


class Model:
    """What scoring needs besides the counts of rare words: the units, the attention model, common words."""

    def __init__(self, path: str, units: Vocabulary, net: Attention, common: dict[bytes, int], tokens: int, types: int):
        self.path, self.units, self.net, self.common = path, units, net, common
        self.log_mass = np.log10(np.maximum(units.weight, 0.5))
        self.tokens, self.types = tokens, types
        self.log_all = math.log10(tokens + 0.5 * (types + 1))


def distinct_texts(docs: DataFrame, text: str = "text", written: bool = True, **folds: Column) -> DataFrame:
    """Each different text of docs (null as empty) once, with copies, its number of rows, and of those in each fold, in a written table (or not yet, for a next step that writes).

    The rows of a text are counted in each task first, so no group of copies comes together anywhere.
    """
    checked(docs, text)
    sums = [F.sum(F.when(fold, 1).otherwise(0)).cast("long").alias(name) for name, fold in folds.items()]
    found = docs.groupBy(text_of(text).alias(text)).agg(F.count("*").alias("copies"), *sums)
    return stored(found, "texts") if written else found


def _key(text: str) -> list[Column]:
    t = text_of(text)
    return [F.xxhash64(t).alias("__weft_t"), F.hash(t).alias("__weft_t2"), F.length(t).alias("__weft_len")]


def for_copies(docs: DataFrame, scored: DataFrame, text: str = "text", copies: str = "copies", share: int = 1000) -> DataFrame:
    """docs without their text, with the other columns of scored, which holds each different text of docs once, by its hashes.

    Texts with more than one in share of all rows are fewer than share, so they are broadcast; in the join by hashes that is left,
    no text has more rows than that.
    """
    keys = ["__weft_t", "__weft_t2", "__weft_len"]
    rows = docs.select("*", *_key(text)).drop(text)
    total = scored.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    many = F.col(copies) * share > total
    hot, rest = F.broadcast(scored.where(many)), scored.where(~many)
    plain = rows.join(F.broadcast(scored.where(many).select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(hot, keys).unionByName(plain).drop(*keys, copies)


def count_words(docs: DataFrame, text: str = "text", flush: int = 200_000, copies: str | None = None) -> DataFrame:
    """(word, c): how often each word, and the end of a text under the empty word, occurs in all docs, each row counted as its copies
    (else once). Summed in each task first."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return batch

        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if n == 1:
                    counts.update(words_of(t.as_py()))
                else:
                    for w, k in Counter(words_of(t.as_py())).items():
                        counts[w] += n * k
                counts[END_WORD] += n
                if len(counts) >= flush:
                    yield out()
        yield out()

    return docs.select(text, _times(copies)).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def with_ids(docs: DataFrame, path: str, text: str = "text", copies: str | None = None, batch_words: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """docs with the column IDS, the first subword ids of each text's words (id_kind(), one behind the other), and the counts (word, c, sub) of the words
    of all docs as count_words() gives them, with each word's first id; both in one written table, so each text is split once for both.

    A task's words are counted by the numbers they are remembered under; the counts go out when that memory is full, and at the end.
    """
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + T.StructType.fromDDL(f"{IDS} binary, __weft_word binary, __weft_c long, __weft_sub int").fields)
    at = docs.columns.index(text)
    times = None if copies is None else docs.columns.index(copies)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, counts, ends = subwords(path), np.zeros(0), 0
        as_ids = id_kind(sub.model.get_vocab_size())

        def out(kinds: pa.Schema, rest: bool) -> Iterator[pa.RecordBatch]:
            seen = np.flatnonzero(counts)
            words, c, first = list(sub.number) if len(seen) else [], counts[seen].astype(np.int64), sub.first[seen]
            words = [words[i] for i in seen.tolist()]
            if rest and ends:
                words, c, first = [*words, END_WORD], np.append(c, ends), np.append(first, -1)
            for i in range(0, len(words), 100_000):
                own = [pa.array(x[i : i + 100_000], k) for x, k in ((words, pa.binary()), (c, pa.int64()), (first, pa.int32()))]
                n = len(own[0])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in kinds), pa.nulls(n, pa.binary()), *own], kind.names)

        def some(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal counts, ends
            if sub.full():
                yield from out(rows.schema, False)
                sub.forget()
                counts = np.zeros(0)
            words, places, sizes = split_words(rows.column(at))
            found = sub.numbers(words)
            n = np.ones(len(sizes)) if times is None else rows.column(times).to_numpy(zero_copy_only=False).astype(np.float64)
            counts = np.concatenate([counts, np.zeros(len(sub.number) - len(counts))])
            counts[found] += np.bincount(places, np.repeat(n, sizes), len(words))  # exact below 2 ** 53
            ends += int(n.sum())
            offsets = np.concatenate([[0], np.cumsum(sizes * as_ids.itemsize)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(sub.first[found].astype(as_ids)[places])])
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, ids, pa.nulls(len(sizes), pa.binary()), none, none.cast(pa.int32())], kind.names)

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for start, n in runs(batch.column(at), batch_words):
                yield from some(batch.slice(start, n))
        if kinds is not None:
            yield from out(kinds, True)

    both = stored(docs.mapInArrow(run, kind), "ids")
    words = both.where("__weft_word is not null").groupBy(F.col("__weft_word").alias("word")).agg(F.sum("__weft_c").alias("c"), F.max("__weft_sub").alias("sub"))
    return both.where(f"{IDS} is not null").select(*[F.col(f"`{c}`") for c in docs.columns], IDS), stored(words.where("c > 0"), "counts")


def id_kind(ids: int) -> np.dtype:
    """How first subword ids lie in IDS, by how many there may be."""
    return np.dtype(np.uint16 if ids <= 1 << 16 else np.int32)


def _times(copies: str | None) -> Column:
    return (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("__weft_n")


def train(docs: DataFrame, path: str, text: str = "text", copies: str | None = None, common: int = 100_000, fit_windows: int = 4096, steps: int = 384, dim: int = 16, width: int = 32, counts: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model and the counts (word, c) of all words of docs.

    path: a byte-level BPE file of the tokenizers library. A word's place in the sequence is its first subword id; every id of the
    tokenizer has a place in the two-level output (Vocabulary). What follows that id in a word is given by the counts of whole words, which, like
    the masses of the ids, are over all docs. They stay a table; the driver gets one row for each id (a fixed number) and the common
    most frequent words.

    counts: those of with_ids(), if docs are rows that it gave for the same path, text and copies; else it is called here.
    copies: a column with the number of rows that a row of docs stands for (distinct_texts); counts and losses have it as weight.
    The attention weights start from a fit of about so many steps on fit_windows windows (of the documents with the smallest hash of their
    row), the bound of what comes to the driver; then every word of every document of docs takes part in refine().
    """
    if counts is None:
        docs, counts = with_ids(docs, path, text, copies)
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (counts.where(F.length("word") == 0).first() or (b"", 0))[1]
    by_sub = counts.where(F.length("word") > 0).groupBy("sub").agg((F.sum("c") + F.count("*") * 0.5).alias("mass"))
    mass = np.full(Subwords(path).model.get_vocab_size(), 0.5)  # one unknown word for each id
    for r in by_sub.collect():  # at most the tokenizer's vocabulary
        mass[r[0]] += r[1]
    units = Vocabulary(mass, ends + 0.5)
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(common).toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    net = Attention(units, dim, width)
    counts = counts.select("word", "c")
    a, w = sample(docs, units, width, fit_windows)
    if len(a):
        net.fit(a, w, -(-steps // -(-len(a) // 64)), 0.01, 64)
        about = docs.agg(F.sum(1 + F.expr(f"octet_length({IDS}) div {id_kind(len(units.unit)).itemsize}"))).first()[0]
        refine(docs, text, path, units, net, about, copies=copies)
    return Model(path, units, net, known, tokens, types), counts


def sequences(texts: list[str | None], sub: Subwords, units: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The units of the words of all texts, one text behind the other, and each text's number of words."""
    words, places, sizes = split_words(pa.array(texts, pa.string()))
    return units.unit[np.array(sub.of(words), np.int64)][places], sizes


def stored_sequences(ids: list[bytes], units: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same from IDS."""
    kind = id_kind(len(units.unit))
    return units.unit[np.frombuffer(b"".join(ids), kind)], np.array(list(map(len, ids)), np.int64) // kind.itemsize


def sample(docs: DataFrame, units: Vocabulary, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One window, named by the hash of its row without IDS, of each of the most documents (with IDS) with the smallest hashes."""
    h = row_hash(docs.drop(IDS), 9)
    last = docs.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return np.empty((0, width), np.int64), np.empty((0, width), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(units)  # of fixed size

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for batch in batches:
            inputs, wanted = [], []
            for t, x in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                a, w, _ = windows(*stored_sequences([t.as_py()], units), units.start, width, width)
                inputs.append(a[x % len(a)].tolist())
                wanted.append(w[x % len(a)].tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(inputs, kind), pa.array(wanted, kind)], ["h", "a", "w"])

    found = docs.select(IDS, h.alias("h")).where(F.col("h") <= last).mapInArrow(run, "h long, a array<int>, w array<int>").orderBy("h").limit(most).toArrow()
    return (np.array(found.column(k).to_pylist(), np.int64).reshape(-1, width) for k in ("a", "w"))


def refine(docs: DataFrame, text: str, path: str, units: Vocabulary, net: Attention, tokens: int, rate: float = 0.002, part: int = 1_000_000, each: int = 2048, batch: int = 512, copies: str | None = None) -> None:
    """One more pass over docs: every word and end of every document is wanted once, in windows that lie side by side. A row that stands
    for several copies has their number as the weight of its losses. tokens: about how many there are in the rows.

    The documents are dealt by hashes of their rows to parts of about so many words, in order of a second hash, so the result does not
    depend on how docs is split. Each part goes on from the net's weights; the parts' weights are averaged by
    their numbers of windows (copies too), 64 at a time in three steps, so no task holds more than 64 sets of weights and the driver gets few.
    """
    shared = docs.sparkSession.sparkContext.broadcast((path, units, net))  # of fixed size
    names, known = sorted(net.p), IDS in docs.columns  # else the ids are found here
    parts = max(1, -(-tokens // part))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        path, units, own = shared.value
        own, total, k = copy.deepcopy(own), 0, None
        wide = id_kind(len(units.unit)).itemsize
        memory = {"step": 0, "m": {x: np.zeros_like(v) for x, v in own.p.items()}, "u": {x: np.zeros_like(v) for x, v in own.p.items()}}
        waiting: list[bytes] | list[str | None] = []
        times: list[int] = []

        def learn() -> int:
            a, w, who = windows(*(stored_sequences(waiting, units) if known else sequences(waiting, subwords(path), units)), units.start, own.width, own.width)
            n = np.array(times, np.int64)[who]
            waiting.clear()
            times.clear()
            for i in range(0, len(a), each):  # a long text may have more
                own.fit(a[i : i + each], w[i : i + each], 1, rate, batch, memory, weight=n[i : i + each])
            return int(n.sum())

        size = 0
        for rows in batches:
            for t, k, n in zip(rows.column(0), rows.column(1), rows.column(2), strict=True):  # noqa: B007
                waiting.append(t.as_py())
                times.append(n.as_py())
                size += 1 + len(waiting[-1] or "") // (wide if known else 6)  # (about) its words
                if size >= each * own.width:
                    total, size = total + learn(), 0
        if waiting:
            total += learn()
        if total:
            flat = np.concatenate([own.p[x].ravel() * np.float32(total) for x in names])
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([total], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["k", "n", "w"])

    def added(table):
        table = table.sort_values("k")
        sums = np.sum([np.frombuffer(w, np.float32) for w in table.w], axis=0, dtype=np.float64)
        return pd.DataFrame({"k": [int(table.k.iloc[0]) // 64], "n": [int(table.n.sum())], "w": [sums.astype(np.float32).tobytes()]})

    row, source = docs.drop(IDS), IDS if known else text
    dealt = docs.select(F.col(f"`{source}`").alias("__weft_x"), F.pmod(row_hash(row, 5), F.lit(parts)).cast("int").alias("k"), row_hash(row, 6).alias("h"), _times(copies))
    found = dealt.repartitionById(parts, "k").sortWithinPartitions("h").select("__weft_x", "k", "__weft_n").mapInArrow(run, "k long, n long, w binary")
    for _ in range(3):
        found = found.groupBy(F.expr("k div 64").alias("g")).applyInPandas(added, "k long, n long, w binary")
    rows = sorted((r["k"], r["n"], np.frombuffer(r["w"], np.float32).astype(np.float64)) for r in found.collect())
    total = sum(n for _, n, _ in rows)
    if total:
        mean, at = sum(w for _, _, w in rows) / total, 0
        for x in names:
            size = net.p[x].size
            net.p[x] = mean[at : at + size].reshape(net.p[x].shape).astype(np.float32)
            at += size


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", batch_words: int = 200_000, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens (long), base_score and score (double), base-10 logarithms.

    A text is its words (lower-cased A-Z, between ASCII white space) and one end. base_score takes each for itself: (c + 0.5) / (N +
    0.5 * (V + 1)). score is the model's: the attention model gives the probability of the next word's first subword id (or its
    bin of rare ids) after those of the words before it, in overlapping windows that count each word once, three quarters of a
    window later each; within it a word has the share (c + 0.5) / (mass of all words there, with an unknown one for each id). Both are proper
    distributions over the known words and the unknown.

    Rows of with_ids() bring their first subword ids. Without keep_text, the rows have the hashes that for_copies() joins by in place of the text. Counts of the common words are with the tasks; those of all others are joined, once for each document and
    word. Null and empty texts are one end. Repeated rows are rows of their own; an empty table gives an empty one; columns with the names
    of the new ones are replaced.
    """
    checked(docs, text)
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    if not keep_text:
        docs = docs.select("*", *_key(text))
    at, gone = docs.columns.index(text), {IDS} if keep_text else {IDS, text}
    ids_at = docs.columns.index(IDS) if IDS in docs.columns else None  # else they are found here
    names = [x for x in docs.columns if x not in gone]
    all_names = [*names, "n_tokens", "__weft_known", "__weft_log", "__weft_gain", "__weft_rare"]
    own = [i for i, x in enumerate(docs.columns) if x not in gone]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: units, weights, and at most so many common words

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        m = shared.value
        log_c = {w: math.log10(c + 0.5) for w, c in m.common.items()}
        width, step, added = m.net.width, m.net.width * 3 // 4, m.net.tables()

        def some(texts: pa.Array, ids: list[bytes] | None) -> list[pa.Array]:
            words, places, sizes = split_words(texts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            logs = np.array(list(map(log_c.get, words)), np.float64)[places]  # None is NaN
            other = np.isnan(logs)
            rare, tf = np.unique(owner[other] * len(words) + places[other], return_counts=True)  # in order of texts
            pairs = pa.StructArray.from_arrays([pa.array([words[i] for i in (rare % max(1, len(words))).tolist()], pa.binary()), pa.array(tf, pa.int32())], ["w", "tf"])
            lists = pa.ListArray.from_arrays(np.searchsorted(rare, np.arange(len(sizes) + 1) * len(words)).astype(np.int32), pairs)
            logs[other] = 0
            known = sizes - np.bincount(owner, other, len(sizes)).astype(np.int64) + (1 if m.tokens else 0)
            units = m.units.unit[np.array(subwords(m.path).of(words), np.int64)][places] if ids is None else stored_sequences(ids, m.units)[0]
            a, w, who = windows(units, sizes, m.units.start, width, step)
            gain = -np.bincount(owner, m.log_mass[units], len(sizes)) - m.log_mass[END]
            for j in range(0, len(a), 2048):
                r, got = m.net.score(a[j : j + 2048], w[j : j + 2048], added, step)
                gain += np.bincount(who[j : j + 2048][r], got, len(sizes)) / math.log(10)
            sums = np.bincount(owner, logs, len(sizes)) + m.log_mass[END]
            return [pa.array(sizes + 1), pa.array(known), pa.array(sums), pa.array(gain), lists]

        for batch in batches:
            for start, n in runs(batch.column(at), batch_words):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.select(own).columns, *some(part.column(at), None if ids_at is None else part.column(ids_at).to_pylist())], all_names)

    kind = T.StructType([*(docs.schema.fields[i] for i in own), *T.StructType.fromDDL("n_tokens long, __weft_known long, __weft_log double, __weft_gain double, __weft_rare array<struct<w:binary,tf:int>>").fields])
    scored = stored(docs.mapInArrow(run, kind).withColumn("__weft_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("__weft_row", F.explode("__weft_rare").alias("r")).select("__weft_row", F.col("r.w").alias("word"), F.col("r.tf").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(counts, "word", "left").groupBy("__weft_row").agg(F.sum(F.col("tf") * F.log10(c + 0.5)).alias("__weft_more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("__weft_found"))
    out = scored.drop("__weft_rare").join(more, "__weft_row", "left")
    words = F.col("__weft_log") + F.coalesce("__weft_more", F.lit(0.0))
    return out.select(
        *[F.col(f"`{x}`") for x in names], "n_tokens", (F.col("__weft_known") + F.coalesce("__weft_found", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(model.log_all)).alias("base_score"), (words + F.col("__weft_gain")).alias("score"),
    )
