"""Text expressions: terms, stop words, month labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]{2,}"
#: English function words and link leftovers that say nothing about a topic.
STOP_WORDS = tuple(
    "about above after again against all also am an and any are as at be because been before being below between both but by can could "
    "did do does doing down during each few for from further get had has have having he her here hers him his how if in into is it its "
    "just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their "
    "them then there these they this those through to too under until up us very was we were what when where which while who whom why "
    "will with would you your https com www ve http amp".split()
)
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms(text: Column) -> Column:
    """All terms of a text in small letters, as an array; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def month(epoch: Column) -> Column:
    """Month label ``yyyy-MM`` of epoch seconds, in UTC."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def letter(i: Column) -> Column:
    """Option letter of a zero-based number."""
    return F.chr(F.lit(65) + i)


def lettered(options: Column) -> Column:
    """Options as lines ``A: ...``."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(F.lit(65) + i), F.lit(": "), x)), "\n")


def decoded(raw: Column) -> Column:
    """Text of UTF-8 bytes; text stays as it is, broken bytes become replacement signs."""
    return F.decode(raw.cast("binary"), "UTF-8")


def subset_size(name: Column) -> Column:
    """The share that a file name such as ``keywords_0.01.json`` carries, null without one."""
    return F.regexp_extract(name, r"_(\d+(?:\.\d+)?(?:e-?\d+)?)(?:\.[A-Za-z]+)?$", 1).try_cast("double")
