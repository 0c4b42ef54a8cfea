"""Groups of mutually similar vectors by grid density clustering.

Only directions count. Features are projections on fixed random axes, quantised to their sign, so
a cell is a code of as many bits as the data's size asks for; several independent grids make up
for groups that one grid cuts badly. In SQL, cells are counted, and those that hold more than cells
do on average and whose vectors point the same way (more than chance explains) are dense. All adjacent dense cells (one bit apart)
of like direction are joined, cells of different grids are joined where they share members, and minimum labels
are propagated along these links to convergence. Each component gives one direction, so what reaches the driver
grows with the number of groups, not of vectors. An exact pass then assigns every vector to its
nearest direction and recomputes directions, which drops what has too few members.

Unusable vectors (null, other length, null, NaN or infinite entries, all zero) are in no group. Of
repeated ids the usable row with the least row number counts. Empty input gives empty results.

Limit: some cell of some grid must hold two members of a group at least and few other vectors, so among very many
vectors without structure a group of a few rows may be missed; the README gives measured shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import dot
from marlstone.operators.components import components
from marlstone.session import cut, spread

DIM = 64
GRIDS = 8
#: Vectors per cell that the number of bits aims at.
PER_CELL = 4
#: Bits that the grids of each level have more than ``PER_CELL`` asks for.
FINER = (0, 3)
#: Least cosine of a member to its group's mean direction, least members of a group.
MEMBER, LEAST = 0.65, 8
#: Least mean cosine between the vectors of a dense cell, and how many standard errors of chance are added to it: for two vectors, for more.
COHERENT, ERRORS_TWO, ERRORS = 0.25, 3.5, 3.0
#: Dense cells are joined only if their mean directions are at least so close; directions closer than ``SAME`` are one group.
ALIKE, SAME = 0.9, 0.9
#: Least members that joined cells of different grids share.
SHARED = 2
#: Directions compared at once in a task (5 MB); more go in further blocks over the same rows.
BLOCK = 20_000
#: Cell sums that a task holds before it hands them on.
HELD = 50_000


def usable_vectors(df: DataFrame, key: str, vector: str, order: str, label: str, dim: int = DIM) -> DataFrame:
    """``id, vec`` (unit length) and ``label`` of each id with a usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(pa.compute.fill_null(lists.flatten().cast(pa.float64()), np.nan))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            ends = np.cumsum(sizes)
            rows = np.flatnonzero(sizes == dim)
            x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            x = (x[good] / norm[good, None]).astype(np.float32)
            keep = pa.array(rows[good])
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), vec, batch.column(2).take(keep), batch.column(3).take(keep)], ["id", "vec", "at", "label"])

    named = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("vec"), F.col(order).cast("long").alias("at"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull())
    rows = spread(named).mapInArrow(run, "id string, vec array<float>, at long, label int")
    return rows.groupBy("id").agg(F.min_by("vec", "at").alias("vec"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("at"))).alias("label"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def axes(bits: int, grid: int, dim: int = DIM) -> np.ndarray:
    """Random axes of a grid, orthonormal as far as the dimension allows."""
    rng = np.random.default_rng(1000 + grid)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(parts, axis=1)[:, :bits].astype(np.float32)


def cell_codes(vectors: DataFrame, bits: int, grids: int = GRIDS, dim: int = DIM, first: int = 0) -> DataFrame:
    """``id, grid, cell``: the quantised features of each vector in each grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [axes(bits, first + g, dim) for g in range(grids)]
        weight = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            cells = [((x @ a) > 0) @ weight for a in frames]
            ids = pa.concat_arrays([batch.column(0)] * grids)
            grid = np.repeat(np.arange(grids, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([ids, pa.array(grid), pa.array(np.concatenate(cells))], ["id", "grid", "cell"])

    return vectors.select("id", "vec").mapInArrow(run, "id string, grid int, cell long")


def _summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], dim: int) -> Iterator[pa.RecordBatch]:
    """Partial sums ``grp, n, total`` of (group numbers, vectors), handed on whenever many are held."""

    def rows(total: dict[int, np.ndarray], count: dict[int, int]) -> pa.RecordBatch:
        keys = list(total)
        flat = np.concatenate([total[k] for k in keys]) if keys else np.empty(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dim, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([count[k] for k in keys], pa.int64()), lists], ["grp", "n", "total"])

    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for g, x in batches:
        if not len(g):
            continue
        order = np.argsort(g, kind="stable")
        keys, first, n = np.unique(g[order], return_index=True, return_counts=True)
        for k, s, c in zip(keys.tolist(), np.add.reduceat(x[order].astype(np.float64), first, axis=0), n.tolist()):
            total[k] = total[k] + s if k in total else s
            count[k] = count.get(k, 0) + c
        if len(total) > HELD:
            yield rows(total, count)
            total, count = {}, {}
    yield rows(total, count)


_SUMS = "grp long, n long, total array<double>"


def _added(parts: DataFrame, dim: int) -> DataFrame:
    """``grp, n, total`` with partial sums added up, each position as an aggregate of its own."""
    sums = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)])
    return parts.groupBy("grp").agg(F.sum("n").alias("n"), sums.alias("total"))


def _cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_cells(codes: DataFrame, vectors: DataFrame, bits: int, dim: int = DIM) -> DataFrame:
    """``grp, grid, cell, n, total`` of cells with more than the average of occupied cells (2 at least) and like directions.

    Vectors that share a cell share signs, so their mean cosine is above 0 by chance; few vectors
    may exceed that by chance too. Both are asked for on top.
    """
    counts = cut(codes.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    mean = counts.agg(F.avg("n").alias("m")).first()["m"] or 0
    full = cut(counts.filter(F.col("n") >= max(2, math.ceil(mean))).withColumn("grp", F.xxhash64("grid", "cell")), "full_cells")
    members = codes.join(full.select("grid", "cell", "grp"), ["grid", "cell"]).select("id", "grp").join(vectors.select("id", "vec"), "id").select("grp", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(((np.asarray(b.column(0)), _matrix(b.column(1), dim)) for b in batches), dim)

    sums = _added(members.mapInArrow(run, _SUMS), dim).select("grp", "total")
    pairs = F.col("n") * (F.col("n") - 1)
    likeness = (dot(F.col("total"), F.col("total")) - F.col("n")) / pairs
    limit = max(COHERENT, 2 * bits / (math.pi * dim) + 0.1)
    chance = F.when(F.col("n") == 2, ERRORS_TWO).otherwise(ERRORS) / F.sqrt(F.lit(dim) * pairs / 2)
    return cut(full.join(sums, "grp").filter(likeness >= limit + chance), "dense_cells")


def cell_links(dense: DataFrame, codes: DataFrame, bits: int) -> DataFrame:
    """``a, b`` of dense cells that belong together: adjacent ones, and those of successive grids with common members."""
    flips = F.explode(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]))
    near = dense.select("grid", F.col("grp").alias("a"), F.col("cell").alias("from"), flips.alias("bit")).withColumn("cell", F.col("from").bitwiseXOR(F.col("bit")))
    beside = near.filter(F.col("cell") > F.col("from")).join(dense.select("grid", "cell", F.col("grp").alias("b")), ["grid", "cell"]).select("a", "b")
    held = codes.join(dense.select("grid", "cell", "grp"), ["grid", "cell"])
    of_id = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("grid", "grp"))).alias("c"))  # one per grid at most
    steps = F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1].grp as a, c[i].grp as b))")
    shared = of_id.filter(F.size("c") > 1).select(F.explode(steps).alias("s")).groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("n"))
    links = beside.unionByName(shared.filter(F.col("n") >= SHARED).select("a", "b"))
    of = dense.select("grp", "total")
    both = links.join(of.select(F.col("grp").alias("a"), F.col("total").alias("ta")), "a").join(of.select(F.col("grp").alias("b"), F.col("total").alias("tb")), "b")
    return both.filter(_cosine(F.col("ta"), F.col("tb")) >= ALIKE).select("a", "b")


def candidate_directions(vectors: DataFrame, n: int, dim: int = DIM, grids: int = GRIDS, finer: int = 0, first: int = 0) -> np.ndarray:
    """Directions of all components of dense cells, near repeats merged."""
    bits = max(3, min(58, round(math.log2(max(1, n / PER_CELL))) + finer))
    codes = cut(cell_codes(vectors, bits, grids, dim, first), "codes")
    dense = dense_cells(codes, vectors, bits, dim)
    roots = components(cell_links(dense, codes, bits)).select(F.col("node").alias("grp"), "root")
    whole = dense.join(roots, "grp", "left").select(F.coalesce("root", "grp").alias("grp"), "n", "total")
    found = _added(whole, dim).toArrow()
    return merge_directions(_matrix(found["total"].combine_chunks(), dim), np.asarray(found["n"]), SAME)


def merge_directions(centers: np.ndarray, sizes: np.ndarray, same: float) -> np.ndarray:
    """Unit directions without near repeats: larger groups first, those within ``same`` of a kept one left out."""
    norm = np.linalg.norm(centers, axis=1)
    order = [i for i in np.lexsort((np.arange(len(sizes)), -sizes)) if norm[i] > 0]
    kept, k = np.empty((len(order), centers.shape[1])), 0
    for i in order:
        c = centers[i] / norm[i]
        if not k or (kept[:k] @ c).max() < same:
            kept[k] = c
            k += 1
    return kept[:k].astype(np.float32)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and cosine of the nearest direction of each row; ties go to the first."""
    top, value = np.full(len(x), -1, np.int64), np.full(len(x), -2.0, np.float32)
    for start in range(0, len(centers), BLOCK):
        block = np.ascontiguousarray(centers[start : start + BLOCK].T)
        step = max(1, 4_000_000 // block.shape[1])
        for a in range(0, len(x), step):
            s = x[a : a + step] @ block
            best = s.argmax(1)
            v = s[np.arange(len(best)), best]
            better = v > value[a : a + step]
            top[a : a + step][better] = best[better] + start
            value[a : a + step][better] = v[better]
    return top, value


def assign(vectors: DataFrame, centers: np.ndarray, least: float, dim: int = DIM) -> DataFrame:
    """``id, vec, label, grp, cosine`` of vectors nearer than ``least`` to some direction; ties go to the first.

    Directions are one for each group found (256 bytes each) and travel once to each executor.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, cosine = _nearest(_matrix(batch.column(1), dim), shared.value)
            keep = pa.array(cosine > least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grp), pa.array(cosine)], [*batch.schema.names, "grp", "cosine"]).filter(keep)

    rows = vectors.select("id", "vec", "label")
    return rows.mapInArrow(run, "id string, vec array<float>, label int, grp long, cosine float")


def group_sums(vectors: DataFrame, centers: np.ndarray, least: float, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and vector sums of the groups that ``assign`` would make; one partial row per group and task is shuffled."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                grp, cosine = _nearest(x, shared.value)
                keep = cosine > least
                yield grp[keep], x[keep]

        return _summed(near(), dim)

    got = _added(vectors.select("vec").mapInArrow(run, _SUMS), dim).orderBy("grp").toArrow()
    return np.asarray(got["n"]), _matrix(got["total"].combine_chunks(), dim)


def refine(vectors: DataFrame, centers: np.ndarray, passes: int, dim: int = DIM) -> np.ndarray:
    """Directions recomputed from the vectors nearest to them; the first pass takes in a little more."""
    for k in range(passes):
        if not len(centers):
            break
        sizes, sums = group_sums(vectors, centers, MEMBER if k else MEMBER - 0.1, dim)
        big = sizes >= (LEAST if k else 3)
        centers = merge_directions(sums[big], sizes[big], SAME)
    return centers


def find_groups(vectors: DataFrame, dim: int = DIM, grids: int = GRIDS) -> np.ndarray:
    """Mean directions of all groups of ``id, vec, label`` rows.

    Vectors that no group takes are searched again on their own, where small groups stand out
    more, until that finds nothing new. Then further and finer grids are searched the same way.
    """
    centers, rest, level, first = np.empty((0, dim), np.float32), vectors, 0, 0
    while (n := rest.count()) >= LEAST:
        before = len(centers)
        found = candidate_directions(rest, n, dim, grids * (1 + level), FINER[level], first)
        # Candidates are tried on the rows they come from; only new groups send all rows through again.
        fresh = refine(rest, found, 2, dim) if len(found) else found
        first += grids * (1 + level)
        if len(fresh):
            centers = refine(vectors, np.concatenate([centers, fresh]), 2, dim)
        if len(centers) <= before:
            level += 1
            if level == len(FINER):
                break
            continue
        left = assign(vectors, centers, -3.0, dim).filter(F.col("cosine") <= F.lit(MEMBER))
        rest = cut(left.select("id", "vec", "label"), "ungrouped")
    return centers


def similarity_groups(df: DataFrame, key: str = "ids", vector: str = "embeddings", order: str = "row_no", label: str = "clusters", dim: int = DIM) -> DataFrame:
    """``id, grp, cosine, label`` of every member of a group."""
    vectors = spread(cut(usable_vectors(df, key, vector, order, label, dim), "vectors"))
    return assign(vectors, find_groups(vectors, dim), MEMBER, dim).select("id", "grp", "cosine", "label")


def named_groups(members: DataFrame) -> DataFrame:
    """``grp, cluster, size``: the number that most labelled members have (ties: the smallest), and the size."""
    votes = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    vote = F.when(F.col("label").isNotNull(), F.struct("n", -F.col("label")))
    return votes.groupBy("grp").agg(F.max_by("label", vote).alias("cluster"), F.sum("n").alias("size"))


def typical_members(members: DataFrame, top: int = 5) -> DataFrame:
    """``cluster, size, mean_cosine, typical``: the ``top`` members of each group nearest to its direction.

    Only members in the topmost cosine bins that together hold ``top`` members are ranked, not whole groups.
    """
    groups = named_groups(members)
    ranked = members.withColumn("bin", F.floor(F.col("cosine") * 200))
    edge = ranked.groupBy("grp", "bin").count()
    above = F.sum("count").over(Window.partitionBy("grp").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    near = edge.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < top).select("grp", "bin")
    order = Window.partitionBy("grp").orderBy(F.desc("cosine"), "id")
    few = ranked.join(near, ["grp", "bin"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top)
    picked = few.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical"))
    mean = members.groupBy("grp").agg(F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    return groups.join(mean, "grp").join(picked, "grp").select("cluster", "size", "mean_cosine", "typical")
