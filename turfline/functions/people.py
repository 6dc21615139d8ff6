"""Name and address standardization as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import basic, join_present, text, words, zip_anywhere


def fold(word: str, table: dict[str, str]) -> str:
    """SQL text of a lookup in a small fixed table that keeps unknown words.

    Map lookups scan their keys, so the hashed ``IN`` test keeps words outside the table from paying for one.
    """
    keys = ", ".join(f"'{k}'" for k in table)
    pairs = " ".join(f"{k}:{v}" for k, v in table.items())
    return f"CASE WHEN {word} IN ({keys}) THEN element_at(str_to_map('{pairs}', ' ', ':'), {word}) ELSE {word} END"


def name_line(raw) -> Column:
    """A name in first..last order."""
    raw = text(raw)
    parts = F.split(raw, ",", -1)
    reordered = F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    return F.when(raw.contains(","), reordered).otherwise(raw)


def line_words(line) -> Column:
    """Words of a line of :func:`name_line` without generational suffixes."""
    return F.filter(words(basic(line)), lambda w: ~w.isin(*fixed.GENERATIONS))


def with_name_parts(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``first``, ``middle``, ``last`` and ``full``.

    Lines are columns of their own, because Spark evaluates below a lambda anew for every mention.
    """
    df = df.withColumn("_nl", name_line(name)).withColumn("_nw", line_words("_nl"))
    size = F.size("_nw")
    df = df.withColumn("_given", F.coalesce(F.get("_nw", F.lit(0)), F.lit("")))
    first = F.expr(fold("_given", fixed.NICKNAMES))
    last = F.when(size > 1, F.get("_nw", size - 1)).otherwise("")
    middle = F.when(size > 2, F.array_join(F.slice("_nw", F.lit(2), size - 2), " ")).otherwise("")
    return (
        df.withColumn("first", first).withColumn("middle", middle).withColumn("last", last)
        .withColumn("full", join_present(" ", "first", "middle", "last"))
        .drop("_nl", "_nw", "_given")
    )


_UNIT = "(?:#\\s*|\\b(?:" + "|".join(fixed.UNIT_WORDS) + ")\\b\\.?\\s*)([0-9]+[a-z]?|[a-z]\\d*)"


def with_address_parts(df: DataFrame, address: str = "address") -> DataFrame:
    """Add ``number``, ``street``, ``unit`` and ``zip5``."""
    df = df.withColumn("_line", F.split_part(text(address), F.lit(","), F.lit(1)))
    df = df.withColumn("unit", F.regexp_extract("_line", "(?i)" + _UNIT, 1)).withColumn("zip5", zip_anywhere(address))
    rest = F.when(F.col("unit") == "", F.col("_line")).otherwise(
        F.regexp_replace("_line", "(?is)^(.*?)" + _UNIT + "(.*)$", "$1 $3"))
    df = df.withColumn("_rest", rest).withColumn("_aw", words(basic("_rest")))
    head = F.coalesce(F.get("_aw", F.lit(0)), F.lit(""))
    numbered = head.rlike("^\\d+[a-z]?$")
    tail = F.when(numbered, F.slice("_aw", F.lit(2), F.greatest(F.size("_aw") - 1, F.lit(0)))).otherwise(F.col("_aw"))
    number = F.when(numbered, F.regexp_replace(head, "[a-z]$", "")).otherwise("")
    street = F.expr(f"array_join(transform(_tail, w -> {fold('w', fixed.STREET_WORDS)}), ' ')")
    return (
        df.withColumn("number", number).withColumn("_tail", tail).withColumn("street", street)
        .drop("_aw", "_line", "_rest", "_tail")
    )


def address_line() -> Column:
    """Upper-case postal line from the parts added by :func:`with_address_parts`."""
    unit = F.when(F.col("unit") != "", F.concat(F.lit("# "), F.col("unit"))).otherwise("")
    return F.upper(join_present(" ", "number", "street", unit, "zip5"))


def member_key() -> Column:
    """``first last|number street zip5``; the middle name stays out."""
    left = F.concat_ws(" ", "first", "last")
    return F.concat(left, F.lit("|"), F.concat_ws(" ", "number", "street", "zip5"))


def block_key() -> Column:
    return F.substring("last", 1, fixed.BLOCK_PREFIX)


def standardize(df: DataFrame, name: str = "name", address: str = "address") -> DataFrame:
    """Name parts, address parts and block key; only the two named columns are read."""
    return with_address_parts(with_name_parts(df, name), address).withColumn("block", block_key())


def search_tokens() -> Column:
    """First, middle, last, street words and ZIP, empty ones left out."""
    parts = F.array("first", "middle", "last")
    return F.filter(F.concat(parts, F.split("street", " "), F.array("zip5")), lambda w: w != "")
