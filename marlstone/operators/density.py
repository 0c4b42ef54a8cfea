"""Density clustering of reduced vectors: fit on all rows or a share of them, predict for the others.

The fit follows Campello et al. (2013): core distances, mutual reachability, a minimum spanning
tree, a condensed tree by least cluster size, and selection by excess of mass. Distances and tree
are exact: points are kept in the boxes of a k-d tree, and boxes too far off to matter are skipped.
Tasks search the neighbours of all points side by side; one task for each core distance builds the tree. All other rows take the label of the nearest fitted point, or noise beyond the reach at which its
cluster was born.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.sampling import exact_sample

#: Points of a box, boxes of a crate and of a tray, a part of it, at most; boxes that search together; nearest points remembered of each point; boxes looked into at once; distances held at once; pieces of a component that search together.
BOX, CRATE, TRAY, GROUP, NEAR, STEP, HELD, PIECES = 32, 64, 8, 2, 16, 8, 4_000_000, 512


@dataclass
class Fit:
    points: np.ndarray
    labels: np.ndarray
    core: np.ndarray
    reach: np.ndarray
    edges: np.ndarray


def _gaps(lows: np.ndarray, highs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance from a box to each of these, a little less than it is so that rounding leaves none out."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0)
    return np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 - 1e-9)


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each ``first`` to before its ``last``."""
    size = last - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Boxes:
    """Points in the order of a k-d tree: box i holds ``points[starts[i]:starts[i + 1]]``, which are the rows ``order`` of x.

    Boxes that follow each other lie in one crate, so that most boxes need no look.
    """

    def __init__(self, x: np.ndarray) -> None:
        parts: list[np.ndarray] = []
        stack = [np.arange(len(x))] if len(x) else []
        while stack:
            rows = stack.pop()
            if len(rows) <= BOX:
                parts.append(np.sort(rows))
                continue
            part = x[rows]
            along, half = int((part.max(0) - part.min(0)).argmax()), len(rows) // 2
            order = np.argpartition(part[:, along], half)
            stack += [rows[order[half:]], rows[order[:half]]]
        self.order = np.concatenate([np.arange(0), *parts])
        self.starts = np.cumsum([0, *map(len, parts)])
        self.points = np.asarray(x, np.float64)[self.order]
        first, crates = self.starts[:-1], np.arange(0, len(parts), CRATE)
        self.low, self.high = np.minimum.reduceat(self.points, first), np.maximum.reduceat(self.points, first)
        self.crate_low, self.crate_high = np.minimum.reduceat(self.low, crates), np.maximum.reduceat(self.high, crates)

    def inside(self, crates: np.ndarray) -> np.ndarray:
        return _runs(crates * CRATE, np.minimum(crates * CRATE + CRATE, len(self.low)))

    def positions(self, boxes: np.ndarray) -> np.ndarray:
        return _runs(self.starts[boxes], self.starts[boxes + 1])

    def groups(self) -> int:
        return -(-len(self.low) // GROUP)

    def group(self, g: int) -> slice:
        return slice(self.starts[g * GROUP], self.starts[min(g * GROUP + GROUP, len(self.low))])

    def nearest(self, q: np.ndarray, k: int, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances, ascending, and positions of the ``k`` points nearest to each of the few ``q``; ties go to the lower position.

        Boxes nearby bound the distance of each query. Products in single precision then leave out what is
        certainly beyond that, by more than their rounding, and the rest is measured in full.
        """
        low, high = q.min(0), q.max(0)
        far_off = _gaps(self.crate_low, self.crate_high, low, high)
        m = 4 + 2 * k // (BOX * CRATE)
        some = self.inside(np.argpartition(far_off, m - 1)[:m] if m < len(far_off) else np.arange(len(far_off)))
        some = some[np.argsort(_gaps(self.low[some], self.high[some], low, high), kind="stable")[: 2 * STEP + 2 * k // (BOX // 2)]]
        at = self.positions(some)
        d = _distances(q, self.points[at])
        if core is not None:
            d = np.maximum(d, core[at])
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        some = self.inside(np.flatnonzero(far_off <= bound.max()))
        at = self.positions(some[_gaps(self.low[some], self.high[some], low, high) <= bound.max()])
        middle, found = (low + high) / 2, []
        step = max(1, HELD // len(q))
        for s in range(0, len(at), step):
            x, y = self.points[at[s : s + step]] - middle, q - middle
            scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
            x, y = (x / scale).astype(np.float32), (y / scale).astype(np.float32)
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            square = np.column_stack([y * -2, yy, np.ones_like(yy)]) @ np.column_stack([x, np.ones_like(xx), xx]).T
            most = (bound / scale) ** 2 * (1 + 1e-6) + (q.shape[1] + 8) * 2.0**-22 * (xx.max() + yy.max())
            i, j = np.divmod(np.flatnonzero(square <= most.astype(np.float32)[:, None]), len(x))
            j = at[s + j]
            d = _lengths(q[i], self.points[j])
            found.append((i, np.maximum(d, core[j]) if core is not None else d, j))
        i, d, j = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((j, d, i))
        count = np.bincount(i, minlength=len(q))
        take = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
        return d[take], j[take]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        d = a[:, i] - b[:, i]
        out += d * d
    return np.sqrt(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of ``a`` and of ``b``, or of each pair of their blocks."""
    out = np.zeros((*a.shape[:-1], b.shape[-2]))
    for i in range(a.shape[-1]):
        d = a[..., :, None, i] - b[..., None, :, i]
        out += d * d
    return np.sqrt(out)


def nearest_points(q: np.ndarray, boxes: Boxes, k: int, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances, ascending, and row numbers of the ``k`` points nearest to each of ``q``; no distance is under ``core``."""
    own = Boxes(q)
    far, near = np.empty((len(q), k)), np.empty((len(q), k), np.int64)
    core = core if core is None else core[boxes.order]
    for g in range(own.groups()):
        rows = own.order[own.group(g)]
        far[rows], at = boxes.nearest(q[rows], k, core)
        near[rows] = boxes.order[at]
    return far, near


def _lists(boxes: Boxes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of all points, by position."""
    n = len(boxes.points)
    far, near = np.empty((n, k)), np.empty((n, k), np.int32)
    for g in range(boxes.groups()):
        own = boxes.group(g)
        far[own], near[own] = boxes.nearest(boxes.points[own], k)
    return far, near


def _kept(samples: int, n: int) -> int:
    return min(n, max(NEAR, min(samples, n - 1) + 1))


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree under mutual reachability."""
    if len(x) < 2:
        return np.empty((0, 3))
    boxes = Boxes(x)
    return _tree(boxes, core[boxes.order], *_lists(boxes, min(len(x), NEAR)))


def _tree(boxes: Boxes, core: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) between rows, ascending; ``core``, ``far`` and ``near`` go by position.

    Boruvka's rounds: each component takes its shortest edge to another one. The lists hold the
    nearest points of each point; boxes are searched only where those leave a shorter edge possible.
    """
    n, width = len(boxes.points), near.shape[1]
    lowest = np.maximum(far[:, -1], core)
    known, to = np.empty((n, width)), np.empty((n, width), np.int32)
    for s in range(0, n, 1 << 16):
        own = slice(s, s + (1 << 16))
        d = np.maximum(np.maximum(far[own], core[own, None]), core[near[own]])
        order = np.argsort(d, axis=1, kind="stable")
        known[own], to[own] = np.take_along_axis(d, order, 1), np.take_along_axis(near[own], order, 1)
    del far, near
    first = boxes.starts[:-1]
    box_of = np.repeat(np.arange(len(first)), np.diff(boxes.starts))
    comp, next_, out = np.arange(n), np.zeros(n, np.int64), []
    live = np.arange(n)
    while True:
        k = int(comp.max()) + 1
        if k == 1:
            break
        bound, ends = np.full(k, np.inf), np.full((k, 2), -1)
        moved = live
        while len(moved):
            moved = moved[comp[to[moved, next_[moved]]] == comp[moved]]
            next_[moved] += 1
            moved = moved[next_[moved] < width]
        live = live[next_[live] < width]
        value = known[live, next_[live]]
        order = np.lexsort((live, value, comp[live]))
        have, at = np.unique(comp[live[order]], return_index=True)
        pick = order[at]
        bound[have], ends[have] = value[pick], np.stack([live[pick], to[live[pick], next_[live[pick]]]], 1)
        _search_outside(boxes, box_of, core, comp, lowest, bound, ends)
        lowest = np.maximum(lowest, bound[comp])  # no edge out of a component is shorter
        root = array("l", range(k))

        def find(i: int, root: array = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        order = np.argsort(bound, kind="stable")
        added = []
        for c, i, j in zip(order.tolist(), comp[ends[order, 0]].tolist(), comp[ends[order, 1]].tolist()):
            ra, rb = find(i), find(j)
            if ra != rb:
                root[rb] = ra
                added.append(c)
        out.append((ends[added], bound[added]))
        comp = np.unique(np.array([find(i) for i in range(k)]), return_inverse=True)[1][comp]
    ends, d = boxes.order[np.concatenate([e for e, _ in out])], np.concatenate([d for _, d in out])
    edges = np.column_stack([ends, d])
    return edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]


def _offer(value: np.ndarray, a: np.ndarray, b: np.ndarray, comp: np.ndarray, bound: np.ndarray, ends: np.ndarray) -> None:
    """Keep these edges where one is the shortest so far out of the component of either end."""
    for i, j in ((a, b), (b, a)):
        at = np.flatnonzero(value < bound[comp[i]])
        at = at[np.argsort(value[at], kind="stable")]
        c, shortest = np.unique(comp[i[at]], return_index=True)
        at = at[shortest]
        bound[c], ends[c] = value[at], np.stack([i[at], j[at]], 1)


class _Pieces:
    """Points of one box and one component each, in the order of the boxes: piece i holds ``rows[starts[i]:starts[i] + sizes[i]]``."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, box_of: np.ndarray, comp: np.ndarray, floor: np.ndarray) -> None:
        self.rows = rows = rows[np.lexsort((comp[rows], box_of[rows]))]
        box, own = box_of[rows], comp[rows]
        self.starts = np.concatenate([[0], np.flatnonzero((box[1:] != box[:-1]) | (own[1:] != own[:-1])) + 1])
        self.sizes = np.diff(self.starts, append=len(rows))
        self.comp, self.box = own[self.starts], box[self.starts]
        self.low, self.high = np.minimum.reduceat(x[rows], self.starts), np.maximum.reduceat(x[rows], self.starts)
        self.floor = np.minimum.reduceat(floor[rows], self.starts)

    def padded(self, pieces: np.ndarray) -> np.ndarray:
        """Points of each piece, the last one again and again where it has fewer than others."""
        size = self.sizes[pieces]
        return self.rows[self.starts[pieces][:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)]


def _search_outside(boxes: Boxes, box_of: np.ndarray, core: np.ndarray, comp: np.ndarray, lowest: np.ndarray, bound: np.ndarray, ends: np.ndarray) -> None:
    """Lower ``bound`` and set ``ends`` to the shortest edge out of each component; ``lowest`` is under all edges of a point.

    Points that follow each other give each component some edge. Pieces that may have a shorter one are then
    searched many at once, each in its own crate and then in all crates within reach: trays within reach
    in these, pieces in the trays, and of those the nearest ones first.
    """
    n, x = len(comp), boxes.points
    for apart in (1, 2, 4, 8, 16, 32, 64):
        for s in range(0, n - apart, HELD // 16):
            i = np.arange(s, min(s + HELD // 16, n - apart))
            j = i + apart
            i = i[(comp[i] != comp[j]) & ((lowest[i] < bound[comp[i]]) | (lowest[j] < bound[comp[j]]))]
            j = i + apart
            _offer(np.maximum(np.maximum(_lengths(x[i], x[j]), core[i]), core[j]), i, j, comp, bound, ends)
    rows = np.flatnonzero(lowest < bound[comp])
    if not len(rows):
        return
    own, other = _Pieces(rows, x, box_of, comp, lowest), _Pieces(np.arange(n), x, box_of, comp, core)
    trays = np.arange(0, len(boxes.low), TRAY)
    low, high = np.minimum.reduceat(boxes.low, trays), np.maximum.reduceat(boxes.high, trays)
    piece_at = np.searchsorted(other.box, np.append(trays, len(boxes.low)))
    # The component of a tray that holds only one, else -1.
    sole = np.minimum.reduceat(other.comp, piece_at[:-1])
    sole = np.where(sole == np.maximum.reduceat(other.comp, piece_at[:-1]), sole, -1)

    def search(i: np.ndarray, c: np.ndarray) -> None:
        """Pieces ``i`` against all in the crates ``c``."""
        tray = c * (CRATE // TRAY)
        last = np.minimum(tray + CRATE // TRAY, len(trays))
        i, tray = np.repeat(i, last - tray), _runs(tray, last)
        near = (sole[tray] != own.comp[i]) & (_gaps(low[tray], high[tray], own.low[i], own.high[i]) < bound[own.comp[i]])
        i, tray = i[near], tray[near]
        count = piece_at[tray + 1] - piece_at[tray]
        i, j = np.repeat(i, count), _runs(piece_at[tray], piece_at[tray + 1])
        differ = own.comp[i] != other.comp[j]
        _shorten(own, other, i[differ], j[differ], x, core, comp, bound, ends)

    crate, most = own.box // CRATE, max(1, HELD // 4 // BOX // CRATE)
    for own_crate in (True, False):
        for s in range(0, len(own.starts), PIECES):
            q = np.arange(s, min(s + PIECES, len(own.starts)))
            q = q[own.floor[q] < bound[own.comp[q]]]
            if not len(q):
                continue
            if own_crate:
                search(q, crate[q])
                continue
            crates = np.flatnonzero(_gaps(boxes.crate_low, boxes.crate_high, own.low[q].min(0), own.high[q].max(0)) < bound[own.comp[q]].max())
            some = max(1, HELD // 16 // max(1, len(crates)))
            for part in (q[t : t + some] for t in range(0, len(q), some)):
                i, c = (v.ravel() for v in np.meshgrid(part, crates, indexing="ij"))
                near = (c != crate[i]) & (_gaps(boxes.crate_low[c], boxes.crate_high[c], own.low[i], own.high[i]) < bound[own.comp[i]])
                i, c = i[near], c[near]
                for t in range(0, len(i), most):
                    search(i[t : t + most], c[t : t + most])


def _shorten(own: _Pieces, other: _Pieces, i: np.ndarray, j: np.ndarray, x: np.ndarray, core: np.ndarray, comp: np.ndarray, bound: np.ndarray, ends: np.ndarray) -> None:
    """Measure pairs of pieces, the nearest ones first, as long as they may hold an edge under ``bound``."""
    floor = np.maximum(np.maximum(_gaps(other.low[j], other.high[j], own.low[i], own.high[i]), own.floor[i]), other.floor[j])
    open_ = np.flatnonzero(floor < bound[own.comp[i]])
    open_ = open_[np.lexsort((floor[open_], i[open_]))]
    i, j, floor = i[open_], j[open_], floor[open_]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    rank, done, step = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))), 0, 1
    while len(i):
        now = rank < done + step
        a, b = i[now], j[now]
        small = (own.sizes[a] > BOX // 4) * 2 + (other.sizes[b] > BOX // 4)
        for kind in range(4):
            of_kind = np.flatnonzero(small == kind)
            for s in range(0, len(of_kind), HELD // 8 // BOX**2):
                at = of_kind[s : s + HELD // 8 // BOX**2]
                p, q = own.padded(a[at]), other.padded(b[at])
                d = np.maximum(_distances(x[p], x[q]), core[p][:, :, None])
                d = np.maximum(d, core[q][:, None, :], out=d).reshape(len(at), -1)
                best, r = d.argmin(1), np.arange(len(at))
                _offer(d[r, best], p[r, best // q.shape[1]], q[r, best % q.shape[1]], comp, bound, ends)
        left = ~now
        left[left] = floor[left] < bound[own.comp[i[left]]]
        i, j, floor, rank = i[left], j[left], floor[left], rank[left]
        done, step = done + step, step * 2


def fit(x: np.ndarray, least: int, samples: int) -> Fit:
    """Labels of all points: 0.. in the order of the cluster's first point, -1 for noise."""
    n = len(x)
    if n < 2:
        return Fit(x, np.full(n, -1), np.zeros(n), np.zeros(n), np.empty((0, 3)))
    boxes = Boxes(x)
    core, edges = _core_and_tree(boxes, *_lists(boxes, _kept(samples, n)), samples)
    labels, reach = _labels(_linkage(edges), least)
    return Fit(x, labels, core, reach, edges)


def _core_and_tree(boxes: Boxes, far: np.ndarray, near: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Core distances by row and the edges of the tree."""
    by_position = far[:, min(samples, len(far) - 1)].copy()
    core = np.empty(len(far))
    core[boxes.order] = by_position
    return core, _tree(boxes, by_position, far, near)


def _linkage(edges: np.ndarray) -> tuple[array, array, array, array]:
    """Single linkage of ascending edges: left and right part, size and height of each set; set n + i joins the sets of edge i."""
    n = len(edges) + 1
    root, top, size, height = array("l", range(n)), array("l", range(n)), array("l", [1]) * (2 * n - 1), array("d", [0.0]) * (2 * n - 1)
    left, right = array("l", [-1]) * (2 * n - 1), array("l", [-1]) * (2 * n - 1)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    node = n
    for s in range(0, n - 1, 1 << 16):
        for a, b, d in edges[s : s + (1 << 16)].tolist():
            ra, rb = find(int(a)), find(int(b))
            i, j = top[ra], top[rb]
            left[node], right[node], size[node], height[node] = i, j, size[i] + size[j], d
            if size[i] < size[j]:
                ra, rb = rb, ra
            root[rb] = ra
            top[ra] = node
            node += 1
    return left, right, size, height


def _labels(linkage: tuple[array, array, array, array], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and reach of each point. Sets joined at one height are joined at once, so that any minimum spanning tree gives the same."""
    left, right, size, height = linkage
    n, last = len(size) // 2 + 1, len(size) - 1

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += (left[v], right[v])
        return out

    density = lambda node: 1 / height[node] if height[node] > 0 else 1e12
    births, stable, children, members = [0.0], [0.0], [[]], [last]
    stack = [(last, 0)]
    while stack:
        node, c = stack.pop()
        while True:
            if node < n:
                break
            level, parts, ties = density(node), [], [node]
            while ties:
                v = ties.pop()
                if v >= n and height[v] == height[node]:
                    ties += (left[v], right[v])
                elif size[v] >= least:
                    parts.append(v)
            stable[c] += (size[node] - (size[parts[0]] if len(parts) == 1 else 0)) * (level - births[c])
            if len(parts) == 1:
                node = parts[0]
                continue
            for v in parts:
                births.append(level)
                stable.append(0.0)
                children.append([])
                members.append(v)
                children[c].append(len(births) - 1)
                stack.append((v, len(births) - 1))
            break
    chosen, worth = [False] * len(births), stable[:]
    for c in range(len(births) - 1, 0, -1):
        below = math.fsum(worth[x] for x in children[c])
        if children[c] and below > stable[c]:
            worth[c] = below
        else:
            chosen[c] = True
    labels, reach = np.full(n, -1), np.zeros(n)
    stack = [c for c in children[0]]
    picked = []
    while stack:
        c = stack.pop()
        if chosen[c]:
            picked.append(c)
        else:
            stack += children[c]
    groups = sorted((sorted(leaves(members[c])), births[c]) for c in picked)
    for k, (points, birth) in enumerate(groups):
        labels[points] = k
        reach[points] = 1 / birth if birth > 0 else np.inf
    return labels, reach


def predict(f: Fit, x: np.ndarray, boxes: Boxes | None = None) -> np.ndarray:
    """Labels of points that were not fitted; ``boxes`` are those of the fitted points."""
    if not len(f.points) or not len(x):
        return np.full(len(x), -1)
    d, near = nearest_points(x, boxes or Boxes(f.points), 1, f.core)
    j = near[:, 0]
    return np.where((f.labels[j] >= 0) & (d[:, 0] <= f.reach[j]), f.labels[j], -1)


def _gathered(rows: DataFrame) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Ids, ascending, and their vectors on the driver, as wide as they are in the table."""
    got = rows.toArrow()
    got = got.sort_by("id")
    vec = got["vec"].combine_chunks()
    return got["id"], vec.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else np.empty((0, 1))


def _fitted(shared: Broadcast, k: int, settings: int, df: DataFrame) -> DataFrame:
    """The ``k`` nearest points of all points, searched in tasks; then all of them in each of ``settings`` tasks, named by ``task``."""
    spark = df.sparkSession
    groups = shared.value.groups()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        for batch in batches:
            for g in batch.column(0).to_pylist():
                own = boxes.group(g)
                far, near = boxes.nearest(boxes.points[own], k)
                at = np.arange(own.start, own.stop, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in far]), pa.array([x.tobytes() for x in near.astype(np.int32)])], ["at", "far", "near"])

    # Neighbouring groups go to different tasks, as dense and thin regions take unequal time.
    tasks = max(1, min(groups // 8, 2 * spark.sparkContext.defaultParallelism))
    lists = spark.range(groups).repartitionById(tasks, (F.col("id") % tasks).cast("int")).mapInArrow(search, "at int, far binary, near binary")
    return lists.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(settings - 1)))).repartitionById(settings, F.col("task"))


def _collected(batches: Iterable[pa.RecordBatch], n: int, k: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The task and its lists from the rows of ``_fitted``; None where there are none."""
    task, far, near = -1, np.empty((0, k)), np.empty((0, k), np.int32)
    for batch in batches:
        if not batch.num_rows:
            continue
        if task < 0:
            task, far, near = batch.column("task")[0].as_py(), np.empty((n, k)), np.empty((n, k), np.int32)
        at = batch.column("at").to_numpy()
        far[at] = np.frombuffer(b"".join(batch.column("far").to_pylist())).reshape(-1, k)
        near[at] = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.int32).reshape(-1, k)
    return None if task < 0 else (task, far, near)


def cluster(df: DataFrame, key: str, vector: str, least: int = 10, samples: int = 5, fraction: float = 1.0, seed: str = "42") -> DataFrame:
    """``id, label`` of every row with a vector, fitted on ``fraction`` of the rows: all of them by default.

    The points of the fit pass through the driver, without a bound, and on to the tasks: 70 bytes each for five
    coordinates. One task holds their neighbours and the tree, about 0.5 kB a point.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull() & F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    ids, x = _gathered(rows if fraction >= 1 else exact_sample(rows, "id", fraction, seed).select("id", "vec"))
    n, k = len(x), _kept(samples, len(x))
    if n < 2:
        return rows.select("id", F.lit(-1).alias("label"))
    shared = spark.sparkContext.broadcast(Boxes(x))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _collected(batches, n, k):
            core, edges = _core_and_tree(shared.value, *got[1:], samples)
            del got
            labels, reach = _labels(_linkage(edges), least)
            yield from pa.table({"row": np.arange(n), "label": labels.astype(np.int32), "core": core, "reach": reach}).to_batches(1 << 16)

    fitted = _fitted(shared, k, 1, df).mapInArrow(build, "row long, label int, core double, reach double")
    if fraction >= 1:
        names = spark.sparkContext.broadcast(ids)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from pa.table({"id": names.value.take(batch.column("row")), "label": batch.column("label")}).to_batches()

        return fitted.select("row", "label").mapInArrow(named, f"id {kind}, label int")
    got = fitted.toArrow().sort_by("row")
    f = Fit(np.asarray(x, np.float64), got["label"].to_numpy(), got["core"].to_numpy(), got["reach"].to_numpy(), np.empty((0, 3)))
    sent = spark.sparkContext.broadcast((f, pd.Series(f.labels, ids.to_pandas())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, known = sent.value
        for pdf in batches:
            out = pdf["id"].map(known)
            rest = out.isna()
            if rest.any():
                out[rest] = predict(f, np.array(pdf["vec"][rest].tolist(), np.float64), shared.value)
            yield pd.DataFrame({"id": pdf["id"], "label": out.astype(int)})

    return rows.mapInPandas(run, f"id {kind}, label int")


def subclusters(df: DataFrame, key: str, cluster_col: str, vector: str, least: int = 5, samples: int = 3) -> DataFrame:
    """``cluster, id, sub`` within each cluster except noise, each fitted on all its rows in one task."""
    rows = df.select(F.col(cluster_col).cast("int").alias("cluster"), F.col(key).alias("id"), F.col(vector).alias("vec")).filter("cluster >= 0 and vec is not null")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        return pd.DataFrame({"cluster": pdf["cluster"], "id": pdf["id"], "sub": fit(np.array(pdf["vec"].tolist(), np.float64), least, samples).labels})

    return rows.groupBy("cluster").applyInPandas(run, f"cluster int, id {rows.schema['id'].dataType.simpleString()}, sub int")


def grid_scores(df: DataFrame, key: str, vector: str, sizes: list[int], samples: list[int]) -> DataFrame:
    """``least, samples, clusters, score`` of a fit on all rows for each feasible pair of parameters.

    Neighbours are searched once, in tasks; each number of samples has its tree in a task of its own, which
    serves all sizes. Points travel once to each executor, and a task holds about 0.5 kB a point.
    """
    spark = df.sparkSession
    _, x = _gathered(df.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter("vec is not null and id is not null"))
    n, schema = len(x), "least int, samples int, clusters int, score double"
    sizes, samples = [a for a in sizes if 2 <= a <= n], [b for b in samples if b <= n]
    if not sizes or not samples:
        return spark.createDataFrame([], schema)
    k, shared = _kept(max(samples), n), spark.sparkContext.broadcast(Boxes(x))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _collected(batches, n, k):
            b = samples[got[0]]
            _, edges = _core_and_tree(shared.value, *got[1:], b)
            del got
            tree, out = _linkage(edges), []
            for a in sizes:
                labels, _ = _labels(tree, a)
                out.append((a, b, int(labels.max(initial=-1)) + 1, dbcv_score(edges, labels)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["least", "samples", "clusters", "score"]).astype({"least": np.int32, "samples": np.int32, "clusters": np.int32}))

    return _fitted(shared, k, len(samples), df).mapInArrow(build, schema)


def best_parameters(x: np.ndarray, sizes: list[int], samples: list[int]) -> tuple[int, int, float]:
    """The feasible (least size, samples) whose clustering scores highest by density; the first wins ties."""
    best = (0, 0, -1.0)
    for least in sizes:
        for k in samples:
            if 2 <= least <= len(x) and k <= len(x):
                f = fit(x, least, k)
                value = dbcv_score(f.edges, f.labels)
                if value > best[2]:
                    best = (least, k, value)
    return best


def dbcv_score(edges: np.ndarray, labels: np.ndarray) -> float:
    """The density validity of labels on tree edges, as ``agreement.dbcv`` defines it."""
    if not len(edges):
        return 0.0
    la, lb = labels[edges[:, 0].astype(int)], labels[edges[:, 1].astype(int)]
    d, far = edges[:, 2], edges[:, 2].max()
    mixed = (la >= 0) != (lb >= 0)
    gap = d[mixed].min() if mixed.any() else far
    kinds, sizes = np.unique(labels[labels >= 0], return_counts=True)
    inner, cross = np.zeros(len(kinds)), np.full(len(kinds), np.inf)
    at = (la >= 0) & (la == lb)
    np.maximum.at(inner, np.searchsorted(kinds, la[at]), d[at])
    at = (la >= 0) & (lb >= 0) & (la != lb)
    for ends in (la, lb):
        np.minimum.at(cross, np.searchsorted(kinds, ends[at]), d[at])
    total, score = len(labels), 0.0
    for n, dsc, sep in zip(sizes.tolist(), inner.tolist(), cross.tolist()):
        sep = sep if sep < np.inf else (2 * gap if len(kinds) == 1 else 2 * far)
        if max(sep, dsc) > 0:
            score += n * (sep - dsc) / max(sep, dsc) / total
    return float(score * (labels >= 0).sum() / total)
