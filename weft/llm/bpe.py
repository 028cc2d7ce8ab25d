"""BPE encoding and decoding; long unsplit text is encoded as a tree of joined halves."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm.common import checked, tidy

#: Fixed value: the pattern by which byte-level BPE splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0250 alone, whose letters, numbers and white space are listed, for the faster re.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
NEAR_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def by_rank(spec: dict) -> dict[bytes, int] | None:
    """Id by bytes, if the file's ids stand in the order of its merges, so that they are the ranks; else None."""
    added = {a["content"] for a in spec["added_tokens"]}
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    back = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in added}
    return ranks if all(a < b for a, b in itertools.pairwise(made)) and len(ranks) == 256 + len(made) else None


def together(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """tiktoken's merge loop on each part of a text between two U+0000, and on each U+0000."""
    import tiktoken

    return tiktoken.Encoding("parts", pat_str="[^\0]+|\0", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str | int) -> int:
        n = self[key] = len(self)
        return n


class TreeBPE:
    """Encodes and decodes as the tokenizers library does with the same file.

    Pieces of up to leaf bytes are encoded many at once, by tiktoken's faster merge loop where the file's ids are ranks, else
    by the library's. A longer piece is cut into halves,
    again and again, down to leaves, which are encoded in one call; then neighbours are joined, level by level. A join
    encodes a window of tokens around the seam anew. It is done when the window's outer tokens agree with what is left
    and right of it: a token sequence is the encoding of its bytes if, and only if, every two neighbours are the
    encoding of their own bytes. Else the window is doubled, up to both sides whole.
    """

    def __init__(self, path: str, leaf: int = 256, cache: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.bytes_of = pa.array(self.token_bytes, pa.large_binary())
        self.path, self.leaf, self.limit = path, leaf, cache
        self.all_pieces, self.near_pieces, self.far = regex.compile(PIECES).findall, re.compile(NEAR_PIECES).findall, re.compile("[^\0-\u024f]").search
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        ranks = by_rank(spec)
        self.nul, self.fast = ranks and ranks[b"\0"], ranks and together(ranks)
        self._forget()
        self.agreed: dict[tuple[int, int], bool] = {}

    @functools.cached_property
    def model(self):
        """The library's merge loop, loaded when the first part needs it."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": [], "truncation": None, "padding": None}))

    def _forget(self) -> None:
        """Starts the cache of pieces anew: number by piece, and all ids, one piece's after the other's."""
        self.number = Numbers()
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def split(self, text: str) -> list[str]:
        return self.all_pieces(text) if self.far(text) else self.near_pieces(text)

    def _mapped(self, data: bytes) -> str:
        return "".join(map(self.letters.__getitem__, data))

    def _merge(self, parts: list[bytes]) -> list[list[int]]:
        """The merge loop on each part alone."""
        return [e.ids for e in self.model.encode_batch([self._mapped(p) for p in parts], add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def _agree(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their own bytes."""
        if (known := self.agreed.get((left, right))) is None:
            if len(self.agreed) > 1_000_000:
                self.agreed.clear()
            known = self.agreed[left, right] = self._merge([self._bytes([left, right])])[0] == [left, right]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a and b together."""
        width = 2
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            middle = self._merge([self._bytes(a[i:] + b[:j])])[0]
            if (i == 0 or self._agree(a[i - 1], middle[0])) and (j == len(b) or self._agree(middle[-1], b[j])):
                return a[:i] + middle + b[j:]
            width *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        """One unsplit piece of any length."""
        n = max(1, -(-len(data) // self.leaf))
        n = 1 << (n - 1).bit_length()
        cuts = [len(data) * k // n for k in range(n + 1)]
        level = self._merge([data[p:q] for p, q in zip(cuts, cuts[1:], strict=False)])
        while len(level) > 1:
            level = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=True)]
        return level[0]

    def _short(self, pieces: list[str]) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """The ids of pieces of up to leaf bytes, one piece's after the other's, and how many each has."""
        if not self.fast:
            found = self._merge([p.encode() for p in pieces])
            return np.array([i for x in found for i in x], np.int32), list(map(len, found))
        ids = np.array(self.fast("\0".join([*pieces, ""])), np.int32)
        ends = np.flatnonzero(ids == self.nul)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, pieces: list[str | int]) -> None:
        """Appends the ids of new pieces to the cache, those of the short ones found in one call. A number is a special token."""
        short = [isinstance(p, str) and len(p) <= self.leaf and "\0" not in p and (4 * len(p) <= self.leaf or len(p.encode()) <= self.leaf) for p in pieces]
        ids, sizes = self._short([p for p, s in zip(pieces, short, strict=True) if s])
        if not all(short):
            parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            every = [next(parts) if s else np.array([p] if isinstance(p, int) else self.encode_piece(p.encode()), np.int32) for p, s in zip(pieces, short, strict=True)]
            ids, sizes = np.concatenate(every), list(map(len, every))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and where each begins, with the end of the last."""
        if len(self.number) > self.limit or len(self.ids) > 16 * self.limit:
            self._forget()
        pieces: list[str | int] = []
        cuts = [0]
        for text in texts:
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                pieces += self.split(text[at : m.start()])
                pieces.append(self.added[m[0]])
                at = m.end()
            pieces += self.split(text[at:] if at else text)
            cuts.append(len(pieces))
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.number) >= len(self.starts):
            self._learn(list(itertools.islice(self.number, len(self.starts) - 1, None)))
        begin = self.starts[numbers]
        sizes = self.starts[numbers + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        begin -= ends[:-1]
        return self.ids[np.arange(ends[-1]) + np.repeat(begin, sizes)], ends[cuts]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, cuts = self.encode_all(texts)
        return [ids[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self._bytes(ids.tolist()).decode("utf-8", errors="replace")

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> pa.StringArray:
        """decode() of each part of ids between two cuts."""
        _, offsets, data = self.bytes_of.take(pa.array(ids)).buffers()
        at = np.frombuffer(offsets, np.int64, len(ids) + 1)[cuts].astype(np.int32)
        texts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(at), data)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([self.decode(ids[a:b]) for a, b in itertools.pairwise(cuts.tolist())], pa.string())
        return texts


def encode(docs: DataFrame, path: str, text: str = "text", leaf: int = 256, batch_chars: int = 1 << 20) -> DataFrame:
    """docs with ids (array<int>), the text's token ids, and decoded (string), the text of these ids.

    path: a byte-level BPE file of the tokenizers library, which every executor can read at that place.

    Texts go through in batches of about batch_chars code points, so memory doesn't follow the number of rows; a text
    is encoded whole. Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike,
    an empty table gives an empty one, and input columns named ids or decoded are replaced.
    """
    checked(docs, text)
    docs = docs.drop("ids", "decoded")
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = None
        for batch in batches:
            bpe = bpe or TreeBPE(path, leaf)
            texts: list[str] = []
            start, chars = 0, 0
            for i, t in enumerate(batch.column(at)):
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars or i == batch.num_rows - 1:
                    found, cuts = bpe.encode_all(texts)
                    ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, ids, bpe.decode_all(found, cuts)], names)
                    texts, start, chars = [], i + 1, 0

    names = [*docs.columns, "ids", "decoded"]
    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(run, out)
