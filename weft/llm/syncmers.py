"""Document fingerprints by closed syncmers over words, or over code points where words are few or long. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import SPACE, WORD, checked, stored, text_of

#: A k-mer has so many words, an inner substring so many of these.
K, S = 4, 2
#: The same in code points, for texts of fewer than FEW words or with more than LONG code points a word, white space included.
LETTERS_K, LETTERS_S = 6, 4
FEW, LONG = 12, 12
#: Spans of rows whose order is found together.
SPANS = 4096
_ANCHOR = "struct<pos:int,hash:bigint>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: lambdas would else compute it again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def by_letters(text: Column) -> Column:
    """Whether the text's k-mers are of code points: it has few words, or long ones."""
    words = F.regexp_count(text, F.lit(WORD))
    return _let(words, lambda n: (n < FEW) | (F.length(text) > LONG * n))


def anchors(text: Column, letters: Column | None = None) -> Column:
    """array<struct<pos, hash>>: the text's closed syncmers in order.

    Every K words in a row (between ASCII white space) are a k-mer, every S words in it an inner substring. With hashes
    of the inner substrings as their order, a k-mer is chosen if its least one is its first or its last, whatever
    stands around it. So equal passages have equal anchors, at positions that differ by one shift.

    Where letters (by_letters(), if it is not given) holds, k-mers are of LETTERS_K code points and inner substrings of LETTERS_S, with each
    run of white space as one blank and none at the ends; positions count code points. A text shorter than that is one k-mer; without words there is none.
    """

    def chosen(inner: Column) -> Column:
        # three inner substrings in both cases, so a k-mer is left out only if the middle one is less than both others
        def one(i: Column) -> Column:
            first, middle, last = F.get(inner, i), F.get(inner, i + 1), F.get(inner, i + 2)
            return F.when((middle >= first) | (middle >= last), F.struct(i.alias("pos"), F.xxhash64(first, last).alias("hash")))

        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(inner) - 3), one))

    none = F.array().cast(f"array<{_ANCHOR}>")

    def whole(parts: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(parts, F.lit(1)).alias("hash")))

    def of_words(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
        # the last pair has a null: cut off
        return F.when(F.size(words) == 0, none).when(F.size(words) < K, whole(words)).otherwise(_let(F.slice(pairs, 1, F.size(words) - 1), chosen))

    def of_letters(points: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(points) - LETTERS_S), lambda i: F.xxhash64(*[F.get(points, i + k) for k in range(LETTERS_S)]))
        return F.when(F.size(points) < LETTERS_K, whole(points)).otherwise(_let(inner, chosen))

    plain = F.btrim(F.regexp_replace(text, SPACE, " "))
    fine = F.when(plain == "", none).otherwise(_let(F.split(plain, ""), of_letters))
    return F.when(by_letters(text) if letters is None else letters, fine).otherwise(_let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words))


def hashes(found: Column) -> Column:
    """The anchors' hashes, each made one of its own with the number of those like it before: a passage that a text has a thousand times
    counts a thousand times. Equal hashes are brought together by sorting; a run of n of them gives n numbers."""

    def numbered(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda b: F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s)))
        one = lambda a, z: F.transform(F.sequence(F.lit(0), z - a - 1), lambda k: F.xxhash64(F.get(s, a), k))
        return F.flatten(_let(begins, lambda b: F.zip_with(b, ends(b), one)))

    return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.sort_array(F.transform(found, lambda a: a["hash"])), numbered))


def digest(found: Column) -> Column:
    """One short string for the anchors in order: equal texts have equal ones."""
    return F.md5(F.array_join(F.transform(found, lambda a: F.hex(a["hash"])), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of two fingerprints' hashes() that both have: 2 * common / all; 1 for two without any."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def hashes_beside(text: Column, found: Column, own: Column, other: Column) -> Column:
    """The hashes of a text for likeness() with another: found, its own, unless only the other has k-mers of code points; then
    those of its code points. own and other: by_letters() of both."""
    return F.when(other & ~own, hashes(anchors(text, F.lit(True)))).otherwise(found)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with anchors (array<struct<pos, hash>>) and fingerprint (a string) of each whole text.

    Null and empty texts have no anchors and one fingerprint in common. Repeated rows are marked alike, an empty table
    gives an empty one, columns with the new names are replaced. No shuffle.
    """
    checked(docs, text)
    docs = docs.drop("anchors", "fingerprint")
    return docs.withColumn("anchors", anchors(text_of(text))).withColumn("fingerprint", digest(F.col("anchors")))


def matched_passages(left: DataFrame, right: DataFrame, id: str = "doc_id") -> DataFrame:
    """(left_id, right_id, shift, anchors): by positional matching, how many anchors two documents share at one shift of words, or
    of code points for two documents with such k-mers.

    left and right hold id and anchors. Only hashes that occur once in a document are matched; a hash in many documents
    of both sides makes as many rows as there are such pairs, so one side should be a stated, small set.
    """

    def once(docs: DataFrame, name: str) -> DataFrame:
        each = docs.select(F.col(id).alias(name), F.explode("anchors").alias("a")).groupBy(name, "a.hash").agg(F.min("a.pos").alias("p"), F.count("*").alias("c"))
        return each.where("c = 1").select(name, "hash", F.col("p").alias(f"p_{name}"))

    both = once(left, "left_id").join(once(right, "right_id"), "hash")
    return both.groupBy("left_id", "right_id", (F.col("p_right_id") - F.col("p_left_id")).alias("shift")).agg(F.count("*").alias("anchors"))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", rows_each: int = 2048) -> DataFrame:
    """id, text and next_text of each row of docs: the text of the next row by descending id, of the first after the last.

    Rows that repeat an id are in order of their text's hash; null ids come last; ids are whole numbers. The order is cut into spans of about
    rows_each rows: at up to 255 quantiles of the ids, and evenly between these. An id that fills several quantiles is
    cut by the hash. Each text is moved once, to its span; besides, each span's first row goes to the span before it.
    Spans are numbered in order, so a window within each span finds the next text. Which span lies before a span is found within blocks of
    SPANS of them; only one number a block, so one for SPANS * rows_each (eight million) rows, is put in order by one task.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("i"), text_of(F.col(f"`{text}`")).alias("t")).withColumn("h", F.xxhash64("t"))
    n, low, high = rows.agg(F.count("*"), F.min("i"), F.max("i")).first()
    parts = min(255, n // rows_each)
    cuts = sorted(rows.agg(F.percentile_approx("i", [k / (parts + 1) for k in range(1, parts + 1)], 20_000)).first()[0] or []) if parts else []
    heavy = {c: cuts.count(c) + 1 for c in cuts if cuts.count(c) > 1}
    edges = sorted({*cuts, *(c + 1 for c in heavy)})
    each = max(1, -(-n // (rows_each * (parts + 1))))
    leaves = []  # from, to, spans in it
    for a, b in zip([low or 0, *edges], [*edges, (high or 0) + 1], strict=True):
        leaves.append((a, b, heavy[a] * each if a in heavy and b == a + 1 else min(each, max(1, b - a))))
    leaves.reverse()
    first, spans = 0, []
    for a, b, m in leaves:
        part = F.floor((F.lit(b - 1) - F.col("i")) / F.lit(float(max(1, b - a))) * m) if b - a > 1 else F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * m)
        spans.append((a, F.least(part, F.lit(m - 1)) + first))
        first += m

    def search(some: list[tuple[int, Column]]) -> Column:
        """The leaf whose interval holds the id, by halving; the leaves descend."""
        if len(some) == 1:
            return some[0][1]
        half = len(some) // 2
        return F.when(F.col("i") >= some[half - 1][0], search(some[:half])).otherwise(search(some[half:]))

    placed = rows.withColumn("s", F.when(F.col("i").isNull(), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * first) + first).otherwise(search(spans)).cast("long"))
    order = F.struct(F.bitwise_not("i").alias("o"), "h")
    heads = stored(placed.groupBy("s").agg(F.min(F.when(F.col("i").isNotNull(), order)).alias("a"), F.min("h").alias("b")).select("s", F.bitwise_not("a.o").alias("i"), F.coalesce("a.h", "b").alias("h")), "heads")
    # the span before each span that has rows; before the first, the last
    block = F.expr(f"s div {SPANS}")
    tops = heads.groupBy(block.alias("block")).agg(F.max("s").alias("top"))
    above = F.coalesce(F.lag("top").over(Window.orderBy("block")), F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("block", block).join(tops.select("block", above.alias("above")), "block")
    before = F.coalesce(F.lag("s").over(Window.partitionBy("block").orderBy("s")), "above")
    heads = heads.select(F.col("s").alias("s0"), F.col("i").alias("i0"), F.col("h").alias("h0"), before.alias("to"))
    same = (F.col("s") == F.col("s0")) & F.col("i").eqNullSafe(F.col("i0")) & (F.col("h") == F.col("h0"))
    ghosts = placed.join(heads, same).groupBy("to", "i", "h").agg(F.min("t").alias("t")).select("i", "t", "h", F.col("to").alias("s"), F.lit(1).alias("g"))
    window = Window.partitionBy("s").orderBy("g", F.col("i").desc_nulls_last(), "h", "t")
    linked = placed.withColumn("g", F.lit(0)).unionByName(ghosts).withColumn("next_text", F.lead("t").over(window)).where("g = 0")
    return linked.select(F.col("i").alias(id), F.col("t").alias(text), "next_text")
