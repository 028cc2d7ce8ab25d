"""How lists, enums and colours are stored as text, and read again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.schema import COLORS


def csv_parts(c: Column) -> Column:
    """Parts that aren't blank, as they stand."""
    return F.filter(F.split(c, ","), lambda x: F.trim(x) != "")


def csv_trimmed(c: Column) -> Column:
    """Trimmed parts, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_all(c: Column) -> Column:
    """All parts, blank ones too; a blank text is the empty list."""
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def csv_longs(c: Column) -> Column:
    """The parts that are whole numbers."""
    return F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def to_csv(c: Column) -> Column:
    return F.array_join(c, ",")


def enum_or(c: Column, names: list[str], default: str) -> Column:
    """The name, if it is known; the default otherwise, null included."""
    return F.when(c.isin(names), c).otherwise(F.lit(default))


def enums_known(c: Column, names: list[str]) -> Column:
    """Of an array of names the known ones."""
    return F.filter(c, lambda x: x.isin(names))


def enum_or_raise(c: Column, names: list[str]) -> Column:
    """The name; an error for an unknown one."""
    return F.when(c.isin(names) | c.isNull(), c).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), c)))


def all_known(c: Column, names: list[str]) -> Column:
    """Whether every name of the array is known: rows with others are dropped whole."""
    return F.forall(c, lambda x: x.isin(names))


def parse_colors(c: Column) -> Column:
    """'argb|ordinal|fraction;...' to structs. Parts without three fields or with a bad argb are dropped; a bad ordinal
    text is 0, an ordinal out of range GREY, a bad fraction 0."""
    names = F.array(*map(F.lit, COLORS))

    def one(part: Column) -> Column:
        f = F.split(part, r"\|")
        number = F.coalesce(F.get(f, F.lit(1)).try_cast("int"), F.lit(0))
        name = F.when(number.between(0, len(COLORS) - 1), F.get(names, number)).otherwise(F.lit("GREY"))
        return F.when(F.size(f) == 3, F.struct(F.get(f, F.lit(0)).try_cast("bigint").alias("argb"), name.alias("colorName"), F.coalesce(F.get(f, F.lit(2)).try_cast("float"), F.lit(0.0).cast("float")).alias("fraction")))

    return F.filter(F.transform(F.split(c, ";"), one), lambda x: x.isNotNull() & x["argb"].isNotNull())


def format_colors(c: Column) -> Column:
    """The reverse of parse_colors; fractions with three places."""
    names = F.array(*map(F.lit, COLORS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["argb"].cast("string"), (F.array_position(names, x["colorName"]) - 1).cast("string"), F.format_string("%.3f", x["fraction"]))), ";")
