"""Evaluation passages inside training text, found by canonical templates.

Words are runs of letters or digits, compared without case; marks and invisible format
characters neither end nor change a word. Each word is canonicalised on its own: numbers, names
and units become typed placeholders. Windows of consecutive canonical words are hashed on both
sides and joined. For a hit the words behind the placeholders (the slots) decide: equal slots
are a verbatim leak, slots that differ by a consistent renaming are a re-parameterised one.

Null, empty and short texts have no window and appear in no result. Repeated rows and items
with equal text each get their rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut, spread

#: Consecutive words that make a leak.
WINDOW = 12
#: Largest number of item words that travel to the tasks as one set (about 12 MB); more items go in further blocks.
BLOCK_WORDS = 2_000_000
#: Units that become one placeholder.
UNITS = frozenset("km m cm mm kg g mg t lb lbs oz l ml ft in mile miles metre metres meter meters gram grams kilogram kilograms litre litres liter liters hour hours minute minutes second seconds day days week weeks month months year years percent euro euros dollar dollars pound pounds cent cents".split())

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}­]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_DIGITS = regex.compile(r"\p{N}+\Z")


def words_of(text: str | None) -> list[str]:
    """The words of a text in compared form."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    return _WORD.findall(text.lower() if text.isascii() else text.casefold())


_CASED = regex.compile(r"(?<=[\p{Ll}\p{N},;] )\p{Lu}[\p{L}]+|\b\p{Ll}[\p{L}]*")


def name_words(items: DataFrame, text: str = "text") -> frozenset[str]:
    """Words that the items capitalise within a sentence, and never write small: their names.

    They are learned once, over all items, whatever the blocks; only the words reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {(m[0].casefold(), m[0][0].isupper()) for t in batch[text] for m in _CASED.finditer(t or "")}
            yield pd.DataFrame(sorted(seen), columns=["word", "big"])

    cased = items.select(text).filter(F.col(text).isNotNull()).mapInPandas(run, "word string, big boolean")
    return frozenset(r["word"] for r in cased.groupBy("word").agg(F.bool_and("big").alias("big")).filter("big").select("word").toLocalIterator())


def canonical(word: str, names: frozenset[str]) -> str:
    """The placeholder of a number, name or unit; other words stay."""
    if _DIGITS.match(word):
        return "<number>"
    if word in names:
        return "<name>"
    return "<unit>" if word in UNITS else word


def consistent(a: list[str], b: list[str]) -> bool:
    """Whether equal slots of one side are equal on the other side too, both ways."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(to.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a, b))


_HIT = "{key} {type}, template long, at int, slots array<string>"


def _windows(words: list[str], names: frozenset[str], size: int) -> Iterator[tuple[tuple[str, ...], int]]:
    shape = [canonical(w, names) for w in words]
    for i in range(len(words) - size + 1):
        yield tuple(shape[i : i + size]), i


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``BLOCK_WORDS`` words, read one partition at a time; one empty block if there are none."""
    block: list[tuple] = []
    size, first = 0, True
    for r in items.select(item_key, item_text).filter(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).orderBy(item_key, item_text).toLocalIterator():
        n = len(words_of(r[1]))
        if size and size + n > BLOCK_WORDS:
            yield block
            block, size, first = [], 0, False
        block.append((r[0], r[1]))
        size += n
    if block or first:
        yield block


def template_hits(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per (document, item) with a common template window: ``verbatim_windows``,
    ``renamed_windows`` (same template, other but consistent slots) and ``first_word``.

    Items are held-out test sets: they are broadcast in blocks of bounded size, whose windows are hashed in the tasks;
    documents are streamed once per block without a shuffle. Results do not depend on the blocks.
    """
    out: DataFrame | None = None
    context = docs.sparkSession.sparkContext
    parts = spread(docs.select(doc_key, text).filter(F.col(doc_key).isNotNull()))
    kd, ki = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    ddl = f"`{doc_key}` {kd}, `{item_key}` {ki}, verbatim_windows int, renamed_windows int, first_word int"
    known = context.broadcast(name_words(items, text))
    for block in _blocks(items, item_key, text):
        shared = context.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names = known.value
            index: dict[tuple[str, ...], list[tuple]] = {}
            vocabulary: set[str] = set()
            for key, t in shared.value:
                ws = words_of(t)
                for shape, i in _windows(ws, names, size):
                    index.setdefault(shape, []).append((key, ws[i : i + size]))
                    vocabulary.update(shape)
            for batch in batches:
                rows = []
                for doc, t in zip(batch[doc_key], batch[text]):
                    rows += [(doc, *x) for x in _match(words_of(t), names, index, vocabulary, size)]
                yield pd.DataFrame(rows, columns=[doc_key, item_key, "verbatim_windows", "renamed_windows", "first_word"])

        hits = parts.mapInPandas(run, ddl)
        out = hits if out is None else out.unionByName(hits)
    assert out is not None
    return out


def _match(words: list[str], names: frozenset[str], index: dict, vocabulary: set[str], size: int) -> list[tuple]:
    """Items that share template windows with a document's words."""
    if len(words) < size:
        return []
    found: dict[object, list[int]] = {}
    run = 0  # length of the run of words that can be part of a window
    shape: list[str] = []
    for i, w in enumerate(words):
        c = w if w in vocabulary else canonical(w, names)
        if c is w and (w in names or w in UNITS or _DIGITS.match(w)):
            c = canonical(w, names)
        if c not in vocabulary:
            run = 0
            shape.clear()
            continue
        run += 1
        shape.append(c)
        if run < size:
            continue
        if len(shape) > size:
            del shape[0]
        here = index.get(tuple(shape))
        if here:
            mine = words[i - size + 1 : i + 1]
            for key, theirs in here:
                same = mine == theirs
                if same or consistent(theirs, mine):
                    f = found.setdefault(key, [0, 0, i - size + 1])
                    f[0 if same else 1] += 1
    return [(k, *v) for k, v in found.items()]


def verbatim_leaks(hits: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Distinct (document, item) pairs that share at least one window word for word."""
    return hits.filter(F.col("verbatim_windows") > 0).select(doc_key, item_key).distinct()


def leaked_items(hits: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Per leaked item the number of documents with a verbatim and with only a re-parameterised copy."""
    verbatim = F.col("verbatim_windows") > 0
    return hits.groupBy(item_key).agg(F.count_if(verbatim).alias("verbatim_docs"), F.count_if(~verbatim).alias("renamed_docs"))


def hits_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``template_hits`` written once, for use by several reports."""
    return cut(template_hits(docs, items), "leak_hits")
