"""Encoding of a corpus with a public byte-level BPE tokenizer by prefix dynamic programming.

For each byte prefix of a piece exactly one token can end a valid encoding of that prefix. The
encoder stores that last token for every prefix: a candidate token that ends at a byte is the
one if it and the last token before it are a pair that BPE would leave apart. Following the
stored tokens back from the end gives the encoding; appended bytes only extend the table, and
after an edit only the pieces from the edit on are encoded again.

Null and empty texts have the empty list of ids. Strings that look like special tokens are
ordinary text. Text of any length is encoded whole, in time linear in its bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: how this family of vocabularies splits text into pieces before merging (public, GPT-2).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces kept per task, and the longest piece kept; only speed depends on them.
KEEP_PIECES, KEEP_BYTES = 500_000, 64


def load_ranks(name: str, directory: str = DEFAULT_DIR) -> dict[bytes, int]:
    """Token bytes to id of a ``.tiktoken`` file; the id is also the priority of the merge."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, coder: PrefixEncoder) -> None:
        self.coder, self.text, self.last = coder, bytearray(), []

    def append(self, more: bytes) -> None:
        """Extend the string; entries of earlier prefixes stay as they are."""
        start = len(self.text)
        self.text += more
        self._fill(start)

    def truncate(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        del self.text[length:], self.last[length:]

    def _fill(self, start: int) -> None:
        coder, last = self.coder, self.last
        reach = max(0, start - coder.longest)
        found: list[list[int]] = [[] for _ in range(len(self.text) - start)]
        for end, token in coder.automaton.iter(bytes(self.text[reach:]).decode("latin-1")):
            if end + reach >= start:
                found[end + reach - start].append(token)
        for i, tokens in enumerate(found, start):
            if len(tokens) > 1:
                tokens.sort(key=coder.length.__getitem__, reverse=True)
            for token in tokens:
                before = i - coder.length[token]
                if before < 0 or coder.apart(last[before], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def ids(self) -> list[int]:
        out, i = [], len(self.last) - 1
        while i >= 0:
            token = self.last[i]
            out.append(token)
            i -= self.coder.length[token]
        out.reverse()
        return out


class PrefixEncoder:
    """Encoder of one vocabulary; holds the automaton over tokens and the checked token pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.length.values())
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            if self._whole(b):
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, list[int]] = {}
        self.split = regex.compile(PIECES).findall

    def _merge(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short byte string; only used to check tokens and pairs of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: bytes) -> bool:
        """Whether merging the token's bytes gives the token back; others never occur in an encoding."""
        return len(token) == 1 or self._merge(token) == [token]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            known = self.pairs[a, b] = self._merge(x + y) == [x, y]
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
        return known

    def piece(self, text: str) -> list[int]:
        kept = self.kept.get(text)
        if kept is None:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw) if len(raw) == 1 else None
            if whole is not None:
                kept = [whole]
            else:
                table = PrefixTable(self)
                table.append(raw)
                kept = table.ids()
            if len(raw) <= KEEP_BYTES:
                if len(self.kept) >= KEEP_PIECES:
                    self.kept.clear()
                self.kept[text] = kept
        return kept

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept, out = self.kept, []
        for p in self.split(text):
            ids = kept.get(p)
            out += self.piece(p) if ids is None else ids
        return out

    def reencode(self, old: str, ids: list[int], new: str) -> list[int]:
        """Ids of ``new`` given those of ``old``: pieces before the first difference keep their ids."""
        same = 0
        for a, b in zip(old, new):
            if a != b:
                break
            same += 1
        keep_chars, keep_ids = 0, 0
        for p in self.split(old):
            # A piece is settled by its own characters, the one after it and the two after its first.
            if max(keep_chars + len(p) + 1, keep_chars + 3) > same:
                break
            keep_chars += len(p)
            keep_ids += len(self.piece(p))
        return ids[:keep_ids] + self.encode(new[keep_chars:])


_encoders: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(name: str, directory: str = DEFAULT_DIR) -> PrefixEncoder:
    """The encoder of a vocabulary, built once per process."""
    if (name, directory) not in _encoders:
        _encoders[name, directory] = PrefixEncoder(load_ranks(name, directory))
    return _encoders[name, directory]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, directory)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(ids: list[int], name: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> str:
    """The text of a list of ids."""
    of = encoder(name, directory).bytes_of
    return b"".join(of[i] for i in ids).decode("utf-8", "surrogatepass")


def token_totals(encoded: DataFrame) -> DataFrame:
    """Number of documents, tokens and distinct ids of an encoded corpus, which is encoded and written once."""
    encoded = cut(encoded, "encoded")
    sizes = encoded.groupBy().agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_tokens"))
    kinds = encoded.select(F.explode("ids").alias("i")).groupBy("i").count().groupBy().agg(F.count(F.lit(1)).alias("n_ids"))
    return sizes.join(F.broadcast(kinds))  # one row each
