"""Text folding as Column expressions (all evaluated in the JVM)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text(value) -> Column:
    """The column with null read as the empty string."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(""))


def _decompositions(form: str) -> dict[str, str]:
    """Characters beyond ASCII whose decomposition, without marks, holds an ASCII character, with that decomposition."""
    out = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        plain = "".join(c for c in unicodedata.normalize(form, chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if plain != chr(code) and any(c.isascii() for c in plain):
            out[chr(code)] = plain
    return out


def _spelled_out(column: Column, table: dict[str, str]) -> Column:
    """Replace characters by several; texts without any of them are not taken apart."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    letters = F.transform(F.split(column, ""), lambda c: F.when(c >= "\u0080", F.coalesce(F.element_at(pairs, c), c)).otherwise(c))
    present = F.translate(column, "".join(table), "") != column
    return F.when(present, F.array_join(letters, "")).otherwise(column)


_FOLDED = _decompositions("NFKD")
_ACCENTS = {k: v for k, v in _FOLDED.items() if len(v) == 1}
_LIGATURES = {k: v for k, v in _FOLDED.items() if len(v) > 1}
_MARKS = "".join(chr(c) for c in range(0x300, 0x370))


def _ascii(column: Column) -> Column:
    """No character takes more than one byte; most texts need no table then."""
    return F.octet_length(column) == F.char_length(column)


def strip_accents(value, delete: str = "") -> Column:
    """Fold accented letters to plain ones and drop the characters in ``delete``.

    The tables hold every character of the Basic Multilingual Plane whose compatibility decomposition has an ASCII
    character: one ``translate`` for those that become a single one, a lookup for ligatures and the like.
    """
    given = text(value)
    folded = F.translate(_spelled_out(given, _LIGATURES), "".join(_ACCENTS) + _MARKS, "".join(_ACCENTS.values()))
    plain = F.when(_ascii(given), given).otherwise(folded)
    return F.translate(plain, delete, "") if delete else plain


#: Spelled out, because a class of single characters is one table lookup and a class of ranges is tested range by range.
_WORD = "abcdefghijklmnopqrstuvwxyz0123456789-"


def basic(value) -> Column:
    """Lower-case ASCII words: accents and ``.,'"` `` dropped, other marks to spaces."""
    plain = F.lower(strip_accents(value, delete=".,'\"`"))
    return F.trim(F.regexp_replace(plain, f" [^{_WORD}]+|[^ {_WORD}][^{_WORD}]*", " "))  # a single space is one already


def words(value) -> Column:
    """Non-empty space-separated words."""
    column = F.col(value) if isinstance(value, str) else value
    return F.filter(F.split(column, " "), lambda w: w != "")


#: White space as a web page's reader sees it, the no-break spaces too.
_WIDE = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_BLANK = "\\t\\n\\x0b\\f\\r"
#: Runs of white space that are not a single space already.
_RUNS = f" [ {_BLANK}]+|[{_BLANK}][ {_BLANK}]*"


def squeeze(value) -> Column:
    given = text(value)
    plain = F.when(_ascii(given), given).otherwise(F.translate(given, _WIDE, " " * len(_WIDE)))
    return F.trim(F.regexp_replace(plain, _RUNS, " "))


def join_present(sep: str, *parts) -> Column:
    """``concat_ws`` over the parts that are not empty."""
    return F.concat_ws(sep, *[F.nullif(text(p), F.lit("")) for p in parts])


def slug(value) -> Column:
    folded = F.regexp_replace(basic(value), " ", "-")
    return F.coalesce(F.nullif(folded, F.lit("")), F.lit("na"))


_QUOTE_FROM = (
    "\u2018\u2019\u201b\u2032`"  # to '
    "\u201c\u201d\u201f"  # to "
    "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"  # to -
)
_QUOTE_TO = "'" * 5 + '"' * 3 + "-" * 7
_NFKC = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000))}
_COMPAT = {k: v for k, v in _NFKC.items() if v != k and len(v) == 1 and k not in _QUOTE_FROM}
#: Characters that become several; combining sequences of Korean and of presentation forms of other scripts stay.
_SEVERAL = {k: v.replace("\u2032", "'") for k, v in _NFKC.items() if len(v) > 1 and any(c.isascii() for c in v)}


def quote_fold(value) -> Column:
    """Fold what makes a correct quotation look different: quotes, dashes, spaces, case."""
    given = text(value)
    folded = _spelled_out(given, {**_SEVERAL, "\u2033": "''"})
    folded = F.translate(folded, _QUOTE_FROM + "".join(_COMPAT), _QUOTE_TO + "".join(_COMPAT.values()))
    return squeeze(F.lower(F.when(_ascii(given), F.replace(given, F.lit("`"), F.lit("'"))).otherwise(folded)))


def page_text(html) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, entities decoded."""
    out = text(html)
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "<[^>]+>"):
        out = F.regexp_replace(out, pattern, " ")
    for pattern, plain in (
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
        ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"),
    ):
        out = F.regexp_replace(out, pattern, plain)
    return squeeze(_numeric_entities(out))


def _numeric_entities(column: Column) -> Column:
    """Decode ``&#233;`` and ``&#xe9;`` by splitting at each entity; rows without one are untouched, and so are
    entities that name no character."""
    entity = "(?i)&#(?:x[0-9a-f]+|[0-9]+);"

    def decode(token: Column) -> Column:
        digits = F.regexp_extract(token, "(?i)^&#x?0*([0-9a-f]*);", 1)
        short = F.when((F.length(digits) > 0) & (F.length(digits) <= 7), digits)
        code = F.when(token.rlike("(?i)^&#x"), F.conv(short, 16, 10)).otherwise(short).try_cast("int")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        point = F.lpad(F.conv(F.when(real, code).cast("string"), 10, 16), 8, "0")
        return F.coalesce(F.decode(F.unhex(point), "UTF-32"), token)

    plain = F.split(column, entity, -1)
    found = F.regexp_extract_all(column, F.lit("(" + entity + ")"), 1)
    pairs = F.zip_with(plain, F.transform(found, decode), lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    return F.when(column.rlike(entity), F.array_join(pairs, "")).otherwise(column)


# --- the ZIP readings; they disagree on purpose, one per consumer ---------------
def zip_anywhere(value) -> Column:
    """First five-digit word, ZIP+4 allowed (address standardization)."""
    return F.regexp_extract(text(value), "\\b(\\d{5})(?:-\\d{4})?\\b", 1)


def zip_bare(value) -> Column:
    """First bare five-digit word (yield slices)."""
    return F.regexp_extract(text(value), "\\b(\\d{5})\\b", 1)


def zip_trailing(value) -> Column:
    """Five-digit word at the end (capture yields, campaign scope)."""
    return F.regexp_extract(text(value), "\\b(\\d{5})\\b\\s*$", 1)


def zip_trailing_plus4(value) -> Column:
    """Trailing ZIP with optional +4 (shard lookup)."""
    return F.regexp_extract(text(value), "(\\d{5})(?:-\\d{4})?\\s*$", 1)


def zip_trailing_loose(value) -> Column:
    """Trailing five digits without a word boundary (modal ZIP of a tile)."""
    return F.regexp_extract(text(value), "(\\d{5})\\s*$", 1)


def zip_digits(value) -> Column:
    """First five digits of a ZIP column."""
    return F.substring(F.regexp_replace(text(value), "[^0-9]", ""), 1, 5)
