"""Chat formatting: messages of typed parts become turns of a template, with a loss mask and references of what is attached."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checked, tidy

#: The template's control strings. No other text of the output holds "<|".
BEGIN, END, BESIDE = "<|im_start|>", "<|im_end|>", "<|part|>"
#: A part of a message. text is used by text parts, uri by the others; width and height of images, seconds of audio, pages of documents.
PART = "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
#: The kinds that are attached, and their placeholders.
KINDS = ("image", "audio", "document")
#: What a model's input has in a placeholder's place: tokens for each square of an image, each second, each page.
PATCH, PER_SECOND, PER_PAGE = 28, 25.0, 256


def escaped(text: Column) -> Column:
    """The text without control strings: every "<|" gets a backslash after the "<", as does every "<" with backslashes and a "|"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    """The text that escaped() was given."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """A role on one line and without control strings: backslashes doubled, line feeds as \\n, a "|" after "<" as \\p."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def text_part(text: Column) -> Column:
    """A message's content that is one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def visited(part: Column, visitors: dict[str, Callable[[Column], Column]], other: Callable[[Column], Column]) -> Column:
    """What the visitor of the part's kind gives for it."""
    out = other(part)
    for kind, visit in visitors.items():
        out = F.when(part["kind"] == kind, visit(part)).otherwise(out)
    return out


def placeholder(part: Column) -> Column:
    """What stands for the part in the turn: a text itself, escaped; an attachment's control string. A part of another kind is a text."""
    return visited(part, {kind: lambda p, kind=kind: F.lit(f"<|{kind}|>") for kind in KINDS}, lambda p: escaped(F.coalesce(p["text"], F.lit(""))))


def expanded_tokens(part: Column) -> Column:
    """How many tokens the placeholder becomes in the model's input; one at least, if an attachment's size is not known. Null for texts."""
    squares = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(0)), F.lit(1)) / PATCH)
    sizes = {
        "image": lambda p: squares(p["width"]) * squares(p["height"]),
        "audio": lambda p: F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND), F.lit(1)),
        "document": lambda p: F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * PER_PAGE,
    }
    return visited(part, {k: lambda p, f=f: f(p).cast("long") for k, f in sizes.items()}, lambda p: F.lit(None).cast("long"))


def attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*KINDS), F.lit(False))


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learned: str = "assistant") -> DataFrame:
    """messages with formatted (string), loss (array of from and to: the places in formatted, in code points, of learned text), attachments (array of kind, uri, at,
    tokens in the order of the placeholders) and n_expanded (long: their tokens together).

    content: an array of PART. A visitor by kind flattens it: texts are escaped, attachments become <|image|>, <|audio|> or <|document|>, and <|part|> stands between two
    texts that follow each other, so parts can be told apart again and no text can make a control string, alone or with the next. A turn is <|im_start|>role, a line feed,
    the flattened content, <|im_end|> and a line feed; a conversation is its turns in order, one after the other. Texts of turns whose role is `learned` are under the loss mask, without
    placeholders and control strings.

    A turn depends on no other, so a conversation with a third of all rows is formatted by many tasks, and there is no limit of its length. Null contents are without parts, null texts
    empty, null parts empty texts, a null role is the empty one. Repeated rows are formatted alike; an empty table gives an empty one; columns named as a result are replaced.
    """
    checked(messages, conv, turn, role, content)
    rows = messages.drop("formatted", "loss", "attachments", "n_expanded", "__weft_pieces", "__weft_spans")
    parts = F.coalesce(F.col(content).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    beside = lambda i: (i > 0) & ~attached(F.get(parts, i)) & ~attached(F.get(parts, i - 1))
    piece = lambda p, i: F.struct(F.when(beside(i), BESIDE).otherwise("").alias("gap"), F.coalesce(placeholder(p), F.lit("")).alias("text"), attached(p).alias("attached"))
    rows = rows.withColumn("__weft_pieces", F.transform(parts, piece))
    pieces, head = F.col("__weft_pieces"), F.concat(F.lit(BEGIN), escaped_role(F.coalesce(role, F.lit(""))), F.lit("\n"))
    body = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], p["text"])), "")
    # where each piece's text begins: the lengths of all before it
    start = F.struct(F.length(head).alias("end"), F.array().cast("array<struct<from: int, to: int, attached: boolean>>").alias("spans"))

    def step(at, p):
        begin = at["end"] + F.length(p["gap"])
        end = (begin + F.length(p["text"])).cast("int")
        return F.struct(end.alias("end"), F.concat(at["spans"], F.array(F.struct(begin.cast("int").alias("from"), end.alias("to"), p["attached"].alias("attached")))).alias("spans"))

    rows = rows.withColumn("__weft_spans", F.aggregate(pieces, start, step)["spans"])
    spans = F.col("__weft_spans")
    bare = lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))
    loss = F.when(F.coalesce(F.col(role), F.lit("")) == learned, F.transform(F.filter(spans, lambda s: ~s["attached"] & (s["to"] > s["from"])), bare))
    both = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.get(spans, i).alias("span"))), lambda x: x["span"]["attached"])
    refs = F.transform(both, lambda x: F.struct(x["part"]["kind"].alias("kind"), x["part"]["uri"].alias("uri"), x["span"]["from"].alias("at"), expanded_tokens(x["part"]).alias("tokens")))
    none = F.array().cast("array<struct<from: int, to: int>>")
    rows = rows.withColumns({"formatted": F.concat(head, body, F.lit(f"{END}\n")), "loss": F.coalesce(loss, none), "attachments": refs}).drop("__weft_pieces", "__weft_spans")
    return rows.withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """The role of a formatted turn, and its parts as (kind, text): the inverse of format_turns(), but for empty texts that no text stands beside."""
    head, body = formatted[len(BEGIN) : -len(END) - 1].split("\n", 1)
    pieces = [None, *re.split(r"<\|(\w+)\|>", body), None]  # a control string's name, a text, a name, ...
    parts: list[tuple[str, str]] = []
    for before, text, after in zip(pieces[::2], pieces[1::2], pieces[2::2], strict=False):
        if text or "part" in (before, after):
            parts.append(("text", unescaped(text)))
        if after not in (None, "part"):
            parts.append((after, ""))
    return unescaped_role(head), parts


class Reader:
    """What read_back() needs: take() a turn and its loss mask, done() for the values of the conversation."""

    def take(self, formatted: str, loss: list[dict]) -> None:
        raise NotImplementedError

    def done(self) -> tuple:
        raise NotImplementedError


class Digests(Reader):
    """n_turns, the digest of role, line feed, text and line feed of every turn, code points and digest of what is under the loss mask, and
    the code points of the whole conversation."""

    def __init__(self):
        self.n, self.chars, self.learned = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, loss: list[dict]) -> None:
        role, parts = read_turn(formatted)
        self.n += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{''.join(t for _, t in parts)}\n".encode())
        for span in loss:
            text = unescaped(formatted[span["from"] : span["to"]])
            self.learned += len(text)
            self.loss.update(text.encode())

    def done(self) -> tuple:
        return self.n, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, fold: Callable[[], Reader], schema: str, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "formatted")) -> DataFrame:
    """What a reader makes of each conversation's formatted turns in order; equal turns of one number follow each other by role and text.

    Rows of a conversation go to one task, sorted there by Spark, and stream through the reader, which sees one turn after the other: memory holds a batch of
    rows, however long the conversation is.
    """
    names = [n.split()[0] for n in schema.split(",")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, out = None, None, []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for key, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if reader is None or key != at:
                    if reader is not None:
                        out.append((at, *reader.done()))
                    at, reader = key, fold()
                reader.take(formatted, loss)
            if len(out) >= 10_000:
                yield rows()
        if reader is not None:
            out.append((at, *reader.done()))
        if out:
            yield rows()

    sorted_turns = turns.repartition(conv).sortWithinPartitions(conv, *order)
    return sorted_turns.select(conv, "formatted", "loss").mapInArrow(run, schema)
