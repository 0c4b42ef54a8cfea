"""Long exact spans shared between records, found with suffix automata over reference shards.

Comparing every document with every other is ruled out by anchors: positions that any two texts
with a common stretch of ``length`` characters must both choose (winnowing), each with four
surrounding windows of which the stretch covers at least one. Documents that share windows form
sets; the regions around their shared anchors are the references. Each set is cut into shards of
bounded text. A suffix automaton of a shard is built in a task, and the regions of the set are
streamed through it: at each character the matching statistic, capped at ``length``, tells which
reference documents hold the last ``length`` characters. Runs of such characters are the maximal
shared spans. Pairs need every shard of a set against every other; spans alone do not, so in sets
of several shards the hashes of all windows of ``length`` characters are counted, in time linear in the set.

The automata of shards are built where they are used instead of broadcast from the driver, so
neither their number nor their size is limited by the driver's memory.

Equal texts are one class and are compared once. Null texts and texts shorter than ``length``
share nothing. A span repeated within one document only is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.skew import split_join
from marlstone.session import cut, spread

LENGTH = 400
#: Characters hashed as one anchor.
ANCHOR = 64
#: Characters of reference text in one automaton, about; and the longest piece of a region.
SHARD_CHARS, PIECE_CHARS = 120_000, 20_000

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        out = np.full(max(n, 1 << 13), base, np.uint64)
        out[0] = 1
        _powers[str(base)] = known = np.multiply.accumulate(out)
    return known[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of a size, from prefix sums of character codes times powers."""
    return _mix((prefix[size:] - prefix[:-size]) * _power(_MUL, len(prefix) - size))


def _slide(x: np.ndarray, size: int, fn: np.ufunc, fill: int) -> np.ndarray:
    """Running minimum or maximum of every full window, in linear time (block-wise from both sides)."""
    n = len(x)
    pad = -n % size
    y = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, size)
    left = fn.accumulate(y, axis=1).ravel()
    right = fn.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return fn(right[: n - size + 1], left[size - 1 : n])


def anchors(text: str, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows around chosen anchors, with first and last position of their anchor in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, none = len(codes), np.empty(0, np.int64)
    if n < length:
        return none, none, none
    codes = _mix((codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _power(_INV, n), dtype=np.uint64)])
    grams = _window_hashes(prefix, anchor)
    size = length - anchor + 1
    least = _slide(grams, size, np.minimum, _MASK)
    edge = np.zeros(size - 1, np.uint64)
    chosen = np.flatnonzero(grams == _slide(np.concatenate([edge, least, edge]), size, np.maximum, 0))
    step = (length - anchor) // 4
    around = _window_hashes(prefix, anchor + 3 * step)
    keys, at = [], []
    for k in range(4):
        start = chosen - k * step
        fits = (start >= 0) & (start < len(around))
        keys.append(_mix(around[start[fits]] + np.uint64(k + 1)))
        at.append(chosen[fits])
    key, pos = np.concatenate(keys), np.concatenate(at)
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none
    last = np.append(first[1:], len(key)) - 1 if len(key) else none
    return key[first].view(np.int64), pos[first], pos[last]


class SuffixAutomaton:
    """All substrings of several texts (Blumer et al. 1985); each state knows the texts that hold it."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.owners = [-1], [0], [0]

    def add(self, text: str, owner: int) -> None:
        """Add a text of an owner (a bit)."""
        nxt, link, length, owners = self.next, self.link, self.len, self.owners
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                owners[last] |= owner
                continue
            new = q is None
            if new:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                owners.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    owners.append(0)
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = clone
                    if new:
                        link[cur] = clone
                    else:
                        cur = clone
            last = cur
            owners[last] |= owner

    def finish(self) -> None:
        """Hand the owners of each state on to the states of its suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.owners[self.link[v]] |= self.owners[v]

    def stream(self, text: str, cap: int) -> Iterator[tuple[int, int]]:
        """(end, owners) of every position whose last ``cap`` characters are in some text."""
        nxt, link, length, owners = self.next, self.link, self.len, self.owners
        v = l = 0
        for i, c in enumerate(text, 1):
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            t = nxt[v].get(c)
            if t is None:
                l = 0
                continue
            v = t
            l += 1
            if l >= cap:
                l = cap
                while length[link[v]] >= cap:
                    v = link[v]
                yield i, owners[v]


def shared_in_block(refs: list[tuple], streams: list[tuple], length: int) -> tuple[set[tuple], list[tuple]]:
    """Pairs (a < b) and spans (doc, start, end) of streams held by other documents; items are (doc, start, text)."""
    bits = {d: 1 << k for k, d in enumerate(sorted({r[0] for r in refs}))}
    docs = sorted(bits)
    automaton = SuffixAutomaton()
    for doc, _, text in refs:
        automaton.add(text, bits[doc])
    automaton.finish()
    pairs: set[tuple] = set()
    spans: list[tuple] = []
    for doc, start, text in streams:
        others = ~bits.get(doc, 0)
        met, begin, end = 0, -1, -1
        for i, own in automaton.stream(text, length):
            own &= others
            if not own:
                continue
            met |= own
            if begin >= 0 and i - length <= end:
                end = i
            else:
                if begin >= 0:
                    spans.append((doc, start + begin, start + end))
                begin, end = i - length, i
        if begin >= 0:
            spans.append((doc, start + begin, start + end))
        while met:
            low = met & -met
            other = docs[low.bit_length() - 1]
            pairs.add((min(doc, other), max(doc, other)))
            met ^= low
    return pairs, spans


def text_classes(docs: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts (``rep, text, copies``) and their members (``doc, rep``); short and null texts are in none."""
    long = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter((F.length("text") >= length) & F.col("doc").isNotNull())
    long = long.withColumn("digest", F.sha2("text", 256))
    classes = long.groupBy("digest").agg(F.min(F.struct("doc", "text")).alias("first"), F.count_distinct("doc").alias("copies"))
    classes = cut(classes.select("digest", F.col("first.doc").alias("rep"), F.col("first.text").alias("text"), "copies"), "text_classes")
    rows = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    members = split_join(long.select("doc", "digest"), classes.select("digest", "rep", "copies"), "digest", "copies", rows).select("doc", "rep").distinct()
    return classes.drop("digest"), members


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, first, last = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, a, b = anchors(text, length)
                keys.append(k)
                docs.append(np.full(len(k), doc, np.int64))
                first.append(a)
                last.append(b)
            if keys:
                columns = [pa.array(np.concatenate(x).astype(t)) for x, t in ((keys, np.int64), (docs, np.int64), (first, np.int32), (last, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "first", "last"])

    return run


def _pieces(length: int):
    """Regions around a document's shared anchors, merged and cut into overlapping pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sig, doc, at, text in zip(batch["sig"], batch["doc"], batch["at"], batch["text"]):
                regions: list[list[int]] = []
                for x in sorted((x["first"], x["last"]) for x in at):
                    a, b = max(0, x[0] - length + ANCHOR), min(len(text), x[1] + length)
                    if regions and a <= regions[-1][1]:
                        regions[-1][1] = max(regions[-1][1], b)
                    else:
                        regions.append([a, b])
                for a, b in regions:
                    while True:
                        end = min(b, a + PIECE_CHARS)
                        rows.append((sig, doc, a, text[a:end]))
                        if end == b:
                            break
                        a = end - length + 1
            yield pd.DataFrame(rows, columns=["sig", "doc", "start", "piece"])

    return run


def _block_batches(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for units in batch["units"]:
                refs = [(u["doc"], u["start"], u["piece"]) for u in units if u["role"] != 1]
                streams = [(u["doc"], u["start"], u["piece"]) for u in units if u["role"] != 0]
                pairs, spans = shared_in_block(refs, streams, length)
                rows += [(a, b, None, None) for a, b in sorted(pairs)] + [(d, None, s, e) for d, s, e in spans]
            out = pd.DataFrame(rows, columns=["doc", "other", "start", "end"])
            yield out.astype({"doc": "int64", "other": "Int64", "start": "Int64", "end": "Int64"})

    return run


def _window_batches(length: int):
    """Hashes of all windows of ``length`` characters of each piece, with their document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                n = len(codes) - length + 1
                if n < 1:
                    continue
                codes = _mix((codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _power(_INV, len(codes)), dtype=np.uint64)])
                # A piece starts anywhere in its document, so the hash must not depend on the place.
                key = _window_hashes(prefix, length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(n, doc, np.int64)), pa.array(np.arange(start, start + n, dtype=np.int32))], ["key", "doc", "at"])

    return run


def _spans_across(pieces: DataFrame, length: int) -> DataFrame:
    """``doc, start, end`` of runs of windows that more than one document of the pieces holds."""
    windows = cut(pieces.select("doc", "start", "piece").mapInArrow(_window_batches(length), "key long, doc long, at int"), "windows")
    held = windows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    total = windows.count()
    places = split_join(windows, held.select("key", "n"), "key", "n", total).select("doc", "at").distinct()
    order = Window.partitionBy("doc").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(order) > length, F.lit(True)).cast("int")
    runs = places.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc", "run").agg(F.min("at").alias("start"), (F.max("at") + length).alias("end")).select("doc", "start", "end")


def shared_between_classes(classes: DataFrame, length: int = LENGTH, pairs: bool = True) -> DataFrame:
    """Rows ``doc, other`` (pairs, if wanted) and ``doc, start, end`` (spans) between documents of different text."""
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread(classes.select("rep", "text")).mapInArrow(_anchor_batches(length), "key long, doc long, first int, last int")
    found = cut(rows, "anchors")
    sets = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("n > 1")
    shared = split_join(found, sets, "key", "n", found.count()).select(F.xxhash64("n", "x", "lo", "hi").alias("sig"), "doc", "first", "last")
    regions = shared.groupBy("sig", "doc").agg(F.collect_list(F.struct("first", "last")).alias("at"))
    units = regions.join(classes.select(F.col("rep").alias("doc"), "text"), "doc").mapInPandas(_pieces(length), "sig long, doc long, start int, piece string")
    units = cut(units, "regions")
    loads = cut(units.groupBy("sig").agg(F.ceil(F.sum(F.length("piece")) / SHARD_CHARS).cast("int").alias("shards"), F.count(F.lit(1)).alias("n")), "set_loads")
    placed = split_join(units, loads, "sig", "n", units.count()).withColumn("own", F.pmod(F.xxhash64("doc", "start"), F.col("shards")).cast("int"))
    one = placed.filter("shards = 1").select("sig", F.lit(0).alias("ref"), F.lit(0).alias("part"), F.lit(2).alias("role"), "doc", "start", "piece")
    many = placed.filter("shards > 1")
    blocks = one
    if pairs:
        every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("with")
        refs = many.select("sig", F.col("own").alias("ref"), every.alias("part"), F.lit(0).alias("role"), "doc", "start", "piece")
        streams = many.select("sig", every.alias("ref"), F.col("own").alias("part"), F.lit(1).alias("role"), "doc", "start", "piece")
        blocks = one.unionByName(refs).unionByName(streams)
    # One shuffle to as many tasks as are set: blocks cost far more time than their size in bytes tells.
    units_of = blocks.repartition(tasks, "sig", "ref", "part").groupBy("sig", "ref", "part").agg(F.collect_list(F.struct("role", "doc", "start", "piece")).alias("units"))
    out = cut(units_of.select("units").mapInPandas(_block_batches(length), "doc long, other long, start int, `end` int"), "shared")
    if pairs:
        return out
    across = _spans_across(many, length).select("doc", F.lit(None).cast("long").alias("other"), "start", "end")
    return out.filter(F.col("other").isNull()).unionByName(across)


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``{key}_a, {key}_b`` (a < b) of all documents with a common stretch of ``length`` characters, copies included."""
    classes, members = text_classes(docs, key, text, length)
    between = shared_between_classes(classes, length).filter(F.col("other").isNotNull()).select(F.col("doc").alias("ra"), F.col("other").alias("rb")).distinct()
    copied = classes.filter("copies > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    left, right = (members.select(F.col("doc").alias(f"d{x}"), F.col("rep").alias(f"r{x}")) for x in "ab")
    pairs = between.unionByName(copied).join(left, "ra").join(right, "rb").filter((F.col("ra") != F.col("rb")) | (F.col("da") < F.col("db")))
    return pairs.select(F.least("da", "db").alias(f"{key}_a"), F.greatest("da", "db").alias(f"{key}_b")).distinct()


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: ``n_chars, shared_chars, share, copies``; a text with copies is shared whole."""
    classes, members = text_classes(docs, key, text, length)
    spans = shared_between_classes(classes, length, pairs=False).select("doc", "start", "end")
    merged = spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    empty = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("chars"))
    total = F.aggregate(
        "s",
        empty,
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["chars"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("chars")),
    )["chars"]
    covered = merged.select(F.col("doc").alias("rep"), total.alias("covered"))
    own = classes.select("rep", "copies").join(covered, "rep", "left")
    per_doc = split_join(members, own, "rep", "copies", classes.agg(F.sum("copies").alias("n")).first()["n"] or 0).withColumnRenamed("doc", "_m")
    sizes = docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    out = sizes.join(per_doc, sizes[key].cast("long") == per_doc["_m"], "left")
    chars = F.when(F.coalesce("copies", F.lit(1)) > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select(key, "n_chars", chars.alias("shared_chars"), F.round(F.coalesce(F.try_divide(chars, F.col("n_chars")), F.lit(0.0)), 6).alias("share"), F.coalesce("copies", F.lit(1)).alias("copies"))


def shared_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Maximal shared spans of each text class: ``{key}`` (the class's least), ``start_pos, end_pos``."""
    classes, _ = text_classes(docs, key, text, length)
    spans = shared_between_classes(classes, length, pairs=False)
    return spans.select(F.col("doc").alias(key), F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos")).distinct()
