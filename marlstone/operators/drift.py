"""Schemas that drift between the files of a source: one consistent table and a report.

Every file gets a profile: the tree of its fields, whose nodes carry counts of JSON types and of
content features (magnitudes of numbers, shapes of strings). Profiles are built by map-side
partial counts, so a file or source of any size is never gathered in one task. Consecutive files
of a source are compared by tree edit distance: their trees are unordered, top-level fields of
one name are one field, and one minimum-cost assignment over everything that vanished and
everything that is new, at all levels, gives the adds, deletes, renames and moves of the script.
Scripts then compile into one projection per file: along a source's files every field keeps its
column through renames and moves, and columns of several sources are one where a shared name
holds like content.

Lines that are null, empty, cut off, not JSON, not an object or nested more deeply than the parser
goes count in no profile and yield no row of the table. A file without any object has no fields: its
predecessor is compared with it as with an empty schema. Empty input gives an empty report.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.components import components
from marlstone.operators.skew import balanced_join
from marlstone.session import cut, spread

TYPES = ("array", "boolean", "decimal", "integer", "object", "string")
#: Buckets into which string shapes and short words are hashed, so that a profile stays bounded whatever the number of values.
SHAPES = 512
#: A rename needs at least this likeness of content, or the lower one along with a like name.
CONTENT, CONTENT_NAMED, NAME = 0.55, 0.08, 0.5
#: What a move costs beyond a rename; least likeness of a move that also changes the name.
MOVE, MOVE_RENAMED = 0.1, 0.9
#: A nested field belongs to the tree if it occurs in at least this share of the values of its top-level field.
NESTED = 0.05
#: Least likeness of content of one name in two sources that makes it one column.
SAME_COLUMN = 0.25
#: Largest size of all projections together that travels to every task; more are joined by file.
BROADCAST_BYTES = 32 << 20


# ---------------------------------------------------------------- parsing and profiles


def _no_constant(text: str) -> float:
    raise ValueError(f"{text} is no JSON")


def _integer(text: str) -> int | float:
    return int(text) if len(text) < 4000 else float("inf")


def parse_object(line: object) -> dict | None:
    """The JSON object on a line, or None. Of a repeated key the last value holds."""
    if not isinstance(line, str):
        return None
    try:
        value = json.loads(line, parse_constant=_no_constant, parse_int=_integer)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value: object) -> str:
    """The JSON type of a non-null value; numbers split into integer and decimal by their spelling."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


_NUMBER = re.compile(r"\s*[+-]?\d{1,18}(\.\d+)?\s*\Z")


def _number_feature(x: float) -> str:
    """Sign and half-octave of a number; small whole numbers on their own."""
    a = abs(x)
    if a < 4:
        return f"n{int(x)}"
    octave, rest = 0, a
    while rest >= 2 and octave < 80:
        rest, octave = rest / 2, octave + 1
    return f"{'-' if x < 0 else 'n'}o{octave}{'b' if rest >= 1.414 else 'a'}"


def _bucket(text: str) -> int:
    code = 0
    for c in text:
        code = (code * 131 + ord(c)) % (SHAPES * 1021)
    return code % SHAPES


@lru_cache(1 << 14)
def _string_feature(text: str) -> str:
    if not text:
        return "s"
    if _NUMBER.match(text):
        return _number_feature(float(text))
    words = text.count(" ")
    if words > 1:
        size, n = 0, words
        while n > 1:
            n, size = n // 2, size + 1
        return f"s{size}{'?' if text.rstrip()[-1:] == '?' else ''}"
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "9", text))))
    return f"S{_bucket(shape)}" + (f"={_bucket(text)}" if len(text) <= 8 and text.isalpha() and text.islower() else "")


def _step(key: str) -> str:
    """A key as a step of a path, so that no key can be taken for two steps or for an array element."""
    return "/" + (key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key)


def _key(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~")


#: The step into the elements of an array; no key is written like this.
ELEMENT = "/~a"


def _visit(value: object, out: Counter) -> None:
    """Count types and content of a value and of everything in it, by path."""
    stack = [("", value)]
    while stack:
        path, x = stack.pop()
        if x is None:
            out[path, "null"] += 1
            continue
        kind = json_type(x)
        out[path, f"t:{kind}"] += 1
        if kind == "object":
            stack += [(path + _step(k), v) for k, v in x.items()]  # type: ignore[attr-defined]
        elif kind == "array":
            stack += [(path + ELEMENT, v) for v in x]  # type: ignore[attr-defined]
        elif kind == "string":
            out[path, f"c:{_string_feature(x)}"] += 1  # type: ignore[arg-type]
        else:
            out[path, f"c:{_number_feature(float(x))}"] += 1  # type: ignore[arg-type]


def _profile_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of each batch: (mirror, file, field, path, feature, n); field '' counts the objects."""
    for batch in batches:
        counts: dict[tuple[str, str, str], Counter] = defaultdict(Counter)
        for mirror, file_name, line in zip(batch["mirror"], batch["file_name"], batch["line"]):
            obj = parse_object(line)
            if obj is None:
                counts[mirror, file_name, ""]["", "lines"] += 0
                continue
            counts[mirror, file_name, ""]["", "lines"] += 1
            for k, v in obj.items():
                field = counts[mirror, file_name, "f" + k]
                field["", "present"] += 1
                _visit(v, field)
        rows = [(m, f, k, p, x, n) for (m, f, k), c in counts.items() for (p, x), n in c.items()]
        yield pd.DataFrame(rows, columns=["mirror", "file_name", "field", "path", "feature", "n"])


_FIELD = "array<struct<name:string,present:bigint,of:bigint,tree:string>>"
_TREE = "array<struct<path:string,feature:string,n:bigint>>"


def file_profiles(lines: DataFrame) -> DataFrame:
    """One row per file: ``mirror, file_name, names, profile``: the fields that belong to the file, and their trees as JSON.

    A field belongs to a file if at least half of its objects have the key. Batches count
    locally, then features are summed per file, so no file is gathered as rows.
    """
    lines = lines.select("mirror", "file_name", "line").filter(F.col("mirror").isNotNull() & F.col("file_name").isNotNull())
    parts = spread(lines).mapInPandas(_profile_batches, "mirror string, file_name string, field string, path string, feature string, n long")
    total = parts.groupBy("mirror", "file_name", "field", "path", "feature").agg(F.sum("n").alias("n"))
    fields = total.groupBy("mirror", "file_name", "field").agg(
        F.max(F.when(F.col("feature") == "present", F.col("n"))).alias("present"),
        F.max(F.when(F.col("feature") == "lines", F.col("n"))).alias("lines"),
        F.to_json(F.sort_array(F.collect_list(F.struct("path", "feature", "n")))).alias("tree"),
    )
    of_file = Window.partitionBy("mirror", "file_name")
    fields = fields.withColumn("of", F.max("lines").over(of_file)).filter((F.col("field") == "") | (2 * F.col("present") >= F.col("of")))
    named = F.when(F.col("field") != "", F.struct(F.substring("field", 2, (1 << 31) - 1).alias("name"), "present", "of", "tree"))
    found = fields.groupBy("mirror", "file_name").agg(F.sort_array(F.collect_list(named)).alias("f"))
    return found.select("mirror", "file_name", F.col("f.name").alias("names"), F.to_json("f").alias("profile"))


# ---------------------------------------------------------------- trees and edit distance


class Node:
    """A nested field: name, type counts, content features, children in name order."""

    __slots__ = ("children", "content", "name", "nulls", "types")

    def __init__(self, name: str) -> None:
        self.name, self.types, self.content, self.nulls, self.children = name, Counter(), Counter(), 0, []

    def kind(self) -> str:
        """The type of most non-null values; ties by name; '' if all values are null."""
        return min(self.types, key=lambda t: (-self.types[t], t)) if self.types else ""


def build_tree(name: str, rows: list[dict]) -> Node:
    """The tree of one field from its profile rows; nested fields below the share ``NESTED`` are strays."""
    nodes: dict[str, Node] = {"": Node(name)}
    for r in sorted(rows, key=lambda r: len(r.get("path", ""))):
        path, feature, n = r.get("path", ""), r["feature"], r["n"]
        if path not in nodes:
            nodes[path] = Node(path.rpartition("/")[2])
        node = nodes[path]
        if feature == "null":
            node.nulls += n
        elif feature.startswith("t:"):
            node.types[feature[2:]] += n
        elif feature.startswith("c:"):
            node.content[feature[2:]] += n
    total = sum(nodes[""].types.values()) or 1
    for path in sorted(nodes, key=len):
        if path:
            up = path.rpartition("/")[0]
            if up in nodes and sum(nodes[path].types.values()) >= NESTED * total:
                nodes[up].children.append(nodes[path])
    for node in nodes.values():
        node.children.sort(key=lambda x: x.name)
    return nodes[""]


def overlap(a: Counter, b: Counter) -> float:
    """Shared mass of two feature distributions, neighbouring half-octaves of numbers counting half."""
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return 1.0 if na == nb else 0.0
    pa, pb = {k: v / na for k, v in a.items()}, {k: v / nb for k, v in b.items()}
    same = sum(min(v, pb.get(k, 0.0)) for k, v in pa.items())
    ca, cb = Counter(), Counter()
    for p, c in ((pa, ca), (pb, cb)):
        for k, v in p.items():
            c[_coarse(k)] += v
    near = sum(min(v, cb.get(k, 0.0)) for k, v in ca.items())
    return (same + near) / 2


def _coarse(feature: str) -> str:
    if feature[:2] in ("no", "-o"):
        return feature[:-1]
    return feature.split("=")[0] if feature[:1] == "S" else feature.rstrip("?")


def relabel(a: Node, b: Node, root: bool) -> float:
    """Cost in 0..1 of turning node a into b: content where both hold values, types, and nested names."""
    scalar = bool(a.content) and bool(b.content)
    cost = 1 - overlap(a.content, b.content) if a.content or b.content else 0.0
    if not scalar and a.kind() != b.kind() and "" not in (a.kind(), b.kind()):
        cost = max(cost, 0.6)
    if not root and a.name != b.name:
        cost = min(1.0, cost + 0.4)
    return cost


def assign(cost: list[list[float]], drop: list[float] | None = None, add: list[float] | None = None) -> list[int]:
    """Minimum-cost assignment of rows to columns (shortest augmenting paths); -1 where leaving a row and a column out costs less.

    ``drop`` and ``add`` are the costs of leaving out each row and each column, 0.5 if not given.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    drop, add = drop or [0.5] * n, add or [0.5] * m
    size = n + m
    big = [[cost[i][j] if i < n and j < m else drop[i] if i < n else add[j] if j < m else 0.0 for j in range(size)] for i in range(size)]
    inf = float("inf")
    u, v, match, way = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = [inf] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    now = big[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if 0 < match[j] <= n:
            out[match[j] - 1] = j - 1
    return out


def _postorder(root: Node) -> list[Node]:
    """All nodes, children before their parents."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += x.children
    return out[::-1]


def _sizes(nodes: list[Node]) -> dict[int, int]:
    size: dict[int, int] = {}
    for x in nodes:
        size[id(x)] = 1 + sum(size[id(c)] for c in x.children)
    return size


def tree_distance(a: Node, b: Node) -> float:
    """Edit distance between unordered trees with unit cost of adding or deleting a node (constrained, Zhang 1996).

    Two nodes are matched with a minimum-cost assignment of their children's subtrees, or one of
    them is wrapped around the other: deleted or added between it and its parent.
    """
    na, nb = _postorder(a), _postorder(b)
    sa, sb = _sizes(na), _sizes(nb)
    d: dict[tuple[int, int], float] = {}
    for x in na:
        for y in nb:
            nx, ny = sa[id(x)], sb[id(y)]
            if not x.children or not y.children:
                below = float(nx + ny - 2)
            else:
                drop, add = [float(sa[id(c)]) for c in x.children], [float(sb[id(c)]) for c in y.children]
                cost = [[d[id(p), id(q)] for q in y.children] for p in x.children]
                to = assign(cost, drop, add)
                taken = {j for j in to if j >= 0}
                below = sum(cost[i][j] if j >= 0 else drop[i] for i, j in enumerate(to)) + sum(c for j, c in enumerate(add) if j not in taken)
            best = relabel(x, y, x is a or y is b) + below
            for c in y.children:
                best = min(best, d[id(x), id(c)] + ny - sb[id(c)])
            for c in x.children:
                best = min(best, d[id(c), id(y)] + nx - sa[id(c)])
            d[id(x), id(y)] = best
    return d[id(a), id(b)]


def content_likeness(a: Node, b: Node) -> float:
    """1 minus the tree edit distance as a share of rebuilding the tree, scaled by how alike null shares are."""
    na, nb = sum(a.types.values()), sum(b.types.values())
    if not na or not nb:
        return 0.0
    gap = abs(a.nulls / (na + a.nulls) - b.nulls / (nb + b.nulls))
    return max(0.0, 1 - tree_distance(a, b) / max(len(_postorder(a)), len(_postorder(b)))) * (1 - gap / 2)


def name_likeness(a: str, b: str) -> float:
    """Share of the shorter name found as a common run of letters in the other; case and separators ignored."""
    x, y = (re.sub(r"[\W_]", "", s).lower() for s in (a, b))
    if not x or not y:
        return 0.0
    best = 0
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, e in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == e else 0
            best = max(best, row[j])
    return best / min(len(x), len(y)) if best >= 3 else 0.0


def match_cost(a: Node, b: Node) -> tuple[float, float, float]:
    """Cost of a rename (deleting and adding costs 1), and the likeness of content and of name behind it."""
    content, name = content_likeness(a, b), name_likeness(a.name, b.name)
    if content >= CONTENT or (name >= NAME and content >= CONTENT_NAMED):
        return 1 - (0.8 * content + 0.2 * name), content, name
    if name >= 0.9 and sum(a.types.values()) and sum(b.types.values()):
        return 0.95, content, name
    return 2.0, content, name


# ---------------------------------------------------------------- scripts


def _fields(profile: str) -> dict[str, Node]:
    return {f["name"]: build_tree(f["name"], json.loads(f["tree"])) for f in json.loads(profile or "[]")}


def _below(a: Node, b: Node, at_a: str, at_b: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """What vanished and what is new below two matched nodes, as (path, parent's path, node) of whole subtrees, and type changes."""
    gone, fresh, types = [], [], []
    stack = [(a, b, at_a, at_b)]
    while stack:
        x, y, px, py = stack.pop()
        xs, ys = {c.name: c for c in x.children}, {c.name: c for c in y.children}
        gone += [(f"{px}/{k}", px, c) for k, c in xs.items() if k not in ys]
        fresh += [(f"{py}/{k}", py, c) for k, c in ys.items() if k not in xs]
        for k in sorted(xs.keys() & ys.keys()):
            if xs[k].kind() != ys[k].kind() and xs[k].kind() and ys[k].kind():
                types.append(("nested_type", f"{px}/{k}", f"{py}/{k}", xs[k].kind(), ys[k].kind(), 1.0))
            stack.append((xs[k], ys[k], f"{px}/{k}", f"{py}/{k}"))
    return gone, fresh, types


def _move_cost(x: tuple, y: tuple) -> tuple[float, float]:
    """Cost of nested subtree x becoming y: a rename in one place, or a move, which needs like content and a like name."""
    cost, content, _ = match_cost(x[2], y[2])
    if x[1] == y[1]:
        return cost, content
    kept = x[2].name == y[2].name
    if content < (CONTENT if kept else MOVE_RENAMED):
        return 2.0, content
    return cost + MOVE, content


def edit_script(old: dict[str, Node], new: dict[str, Node], apart: set[tuple[str, str]], linked: dict[str, str] | None = None) -> list[tuple]:
    """Minimum-cost script between two schemas: (kind, old field, new field, old type, new type, likeness).

    One assignment covers all vanished and all new subtrees, top-level fields and nested ones
    together. Kinds: ``added, removed, renamed, type`` of top-level fields; ``moved_in`` (a field
    becomes a nested one), ``moved_out`` (the reverse), ``nested_added, nested_removed,
    nested_renamed, nested_moved, nested_type``. Nested fields are paths of escaped keys.

    ``apart`` holds pairs of names that are different fields, as some file has both. Names with
    one value in ``linked`` are names of one field elsewhere, so they may be here as well.
    """
    linked = linked or {}

    def price(x: tuple, y: tuple) -> tuple[float, float]:
        if x[1] or y[1]:
            return _move_cost(x, y)
        a, b = x[2].name, y[2].name
        if tuple(sorted((a, b))) in apart:
            return 2.0, 0.0
        cost, content, _ = match_cost(x[2], y[2])
        return (0.95 if cost >= 1 and a in linked and linked[a] == linked.get(b) else cost), content

    def emit(gone: list[tuple], fresh: list[tuple]) -> None:
        """Put the cheapest steps from what vanished to what is new; parts of renamed fields follow."""
        gone, fresh = sorted(gone, key=lambda x: (x[1] != "", x[0])), sorted(fresh, key=lambda x: (x[1] != "", x[0]))
        priced = [[price(x, y) for y in fresh] for x in gone]
        to = assign([[c for c, _ in row] for row in priced]) if gone and fresh else [-1] * len(gone)
        taken = set()
        for i, (x, j) in enumerate(zip(gone, to)):
            top = not x[1]
            if j >= 0 and priced[i][j][0] < 1:
                taken.add(j)
                y = fresh[j]
                if top and not y[1]:
                    kind = "renamed"
                else:
                    kind = "moved_in" if top else "moved_out" if not y[1] else "nested_renamed" if x[1] == y[1] else "nested_moved"
                out.append((kind, x[0] if not top else x[2].name, y[0] if y[1] else y[2].name, x[2].kind(), y[2].kind(), round(priced[i][j][1], 4)))
                if kind == "renamed" and x[2].kind() != y[2].kind() and x[2].kind() and y[2].kind():
                    out.append(("type", x[2].name, y[2].name, x[2].kind(), y[2].kind(), 1.0))
                more = _below(x[2], y[2], x[0], y[0])
                out.extend(more[2])
                emit(more[0], more[1])
            elif top:
                out.append(("removed", x[2].name, "", x[2].kind(), "", 0.0))
            else:
                out.append(("nested_removed", x[0], "", x[2].kind(), "", 0.0))
        for j, y in enumerate(fresh):
            if j not in taken:
                out.append(("nested_added", "", y[0], "", y[2].kind(), 0.0) if y[1] else ("added", "", y[2].name, "", y[2].kind(), 0.0))

    out: list[tuple] = []
    gone = [(_step(a), "", old[a]) for a in old if a not in new]
    fresh = [(_step(b), "", new[b]) for b in new if b not in old]
    for k in sorted(old.keys() & new.keys()):
        a, b = old[k], new[k]
        if a.kind() != b.kind() and a.kind() and b.kind():
            out.append(("type", k, k, a.kind(), b.kind(), 1.0))
        more = _below(a, b, _step(k), _step(k))
        gone, fresh = gone + more[0], fresh + more[1]
        out.extend(more[2])
    emit(gone, fresh)
    return out


_STEP = "mirror string, file_name string, kind string, old_name string, new_name string, old_type string, new_type string, likeness double"


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for m, f, before, after, apart, linked in zip(batch["mirror"], batch["file_name"], batch["_before"], batch["profile"], batch["_apart"], batch["_linked"]):
            known = {(x["a"], x["b"]) for x in apart} if apart is not None else set()
            of = {x["name"]: x["column"] for x in linked} if linked is not None else {}
            rows += [(m, f, *step) for step in edit_script(_fields(before), _fields(after), known, of)]
        yield pd.DataFrame(rows, columns=["mirror", "file_name", "kind", "old_name", "new_name", "old_type", "new_type", "likeness"])


def schema_changes(profiles: DataFrame) -> DataFrame:
    """Every step of every file's script against the preceding file of its mirror.

    Names that some file of the collection holds side by side are different fields, so they
    are no renames of each other; each file is given only the pairs among its own changes. Names that content
    links firmly in some file may be linked in others where type and content change along with
    the name: scripts of files with such names are made again.
    """
    order = Window.partitionBy("mirror").orderBy("file_name")
    both = profiles.withColumn("_before", F.lag("profile").over(order)).withColumn("_names", F.lag("names").over(order))
    series = cut(both, "schema_steps")
    steps = series.filter(F.col("_before").isNotNull())
    file = ["mirror", "file_name"]
    changed = steps.select(*file, F.array_except("_names", "names").alias("gone"), F.array_except("names", "_names").alias("fresh")).filter((F.size("gone") > 0) & (F.size("fresh") > 0))
    asked = changed.select(*file, F.explode("gone").alias("x"), "fresh").select(*file, "x", F.explode("fresh").alias("y"))
    asked = asked.select(*file, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    beside = series.select("names", F.explode("names").alias("a")).join(asked.select("a", "b").distinct(), "a").filter(F.expr("array_contains(names, b)")).select("a", "b").distinct()
    apart = asked.join(beside, ["a", "b"]).groupBy(*file).agg(F.collect_list(F.struct("a", "b")).alias("_apart"))
    steps = steps.join(apart, file, "left")
    none = F.lit(None).cast("array<struct<name:string,column:string>>")
    first = cut(steps.withColumn("_linked", none).mapInPandas(_scripts, _STEP), "first_scripts")

    names = canonical_names(first.filter(F.col("likeness") >= CONTENT))
    ends = asked.join(names.select(F.col("name").alias("a"), F.col("column").alias("ca")), "a").join(names.select(F.col("name").alias("b"), F.col("column").alias("cb")), "b").filter("ca = cb")
    met = first.filter("kind = 'renamed'").select(*file, F.least("old_name", "new_name").alias("a"), F.greatest("old_name", "new_name").alias("b"))
    again = ends.join(met, [*file, "a", "b"], "left_anti")
    linked = again.select(*file, F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("ca").alias("column")), F.struct(F.col("b").alias("name"), F.col("cb").alias("column")))).alias("l"))
    linked = cut(linked.groupBy(*file).agg(F.collect_set("l").alias("_linked")), "linked_names")
    second = steps.join(linked, file).select("mirror", "file_name", "_before", "profile", "_apart", "_linked").mapInPandas(_scripts, _STEP)
    return first.join(linked.select(*file), file, "left_anti").unionByName(second)


def change_report(changes: DataFrame) -> DataFrame:
    """Top-level changes as ``mirror, file_name, change_kind, old_field, new_field``: the field's names in the two files.

    A field that moved into another one is removed at the top level, one that moved out is added.
    """
    kind = F.when(F.col("kind") == "moved_in", "removed").when(F.col("kind") == "moved_out", "added").otherwise(F.col("kind"))
    return (
        changes.filter(~F.col("kind").startswith("nested_"))
        .select(
            "mirror",
            "file_name",
            kind.alias("change_kind"),
            F.when(F.col("kind") == "moved_out", "").otherwise(F.col("old_name")).alias("old_field"),
            F.when(F.col("kind") == "moved_in", "").otherwise(F.col("new_name")).alias("new_field"),
        )
        .distinct()
    )


def canonical_names(changes: DataFrame) -> DataFrame:
    """``name, column`` of every renamed field: names linked by renames share the name that most renames touch."""
    links = changes.filter(F.col("kind") == "renamed").groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n"))
    weights = links.select(F.explode(F.array("old_name", "new_name")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(links, "old_name", "new_name").join(weights, "node")
    best = roots.groupBy("root").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("column"))
    return roots.join(best, "root").select(F.col("node").alias("name"), "column")


# ---------------------------------------------------------------- the consistent table


def _chains(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
    """Fields of one mirror's files followed along renames and moves: ``mirror, file_name, path, name, chain``.

    A field that comes back under its name is the same field. Files number in months, not in lines.
    """
    files = files.sort_values("file_name", ignore_index=True)
    now: dict[str, str] = {}
    parked: dict[str, str] = {}
    rows: list[tuple] = []
    for file_name, names, steps in zip(files["file_name"], files["names"], files["steps"]):
        there = {_step(n): n for n in names}
        moved: dict[str, str] = {}
        for s in steps if steps is not None else ():
            if s["kind"] in ("renamed", "moved_in", "moved_out", "nested_moved", "nested_renamed"):
                a = _step(s["old_name"]) if s["kind"] in ("renamed", "moved_in") else s["old_name"]
                b = _step(s["new_name"]) if s["kind"] in ("renamed", "moved_out") else s["new_name"]
                moved[a] = b
        lost = {s["old_name"] for s in steps if s["kind"] == "nested_removed"} if steps is not None else set()
        after: dict[str, str] = {}
        for path, chain in now.items():
            head = "/" + path[1:].partition("/")[0]
            to = moved.get(path)
            if to is None and head != path and head in moved:
                to = moved[head] + path[len(head) :]
            to = to or path
            top = "/" + to[1:].partition("/")[0]
            if top in there and path not in lost and ELEMENT not in to:
                after[to] = chain
            else:
                parked[path] = chain
        for path in there:
            if path not in after:
                after[path] = parked.pop(path, f"{file_name}{path}")
        rows += [(key[0], file_name, path, _key(path.rpartition("/")[2]), chain) for path, chain in after.items()]
        now = after
    return pd.DataFrame(rows, columns=["mirror", "file_name", "path", "name", "chain"])


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether a chain's content is like that of the other chains with one of its names."""
    for batch in batches:
        rows = []
        for m, chain, name, own, pool in zip(batch["mirror"], batch["chain"], batch["name"], batch["own"], batch["pool"]):
            mine = {(r.get("path", ""), r["feature"]): r["n"] for r in json.loads(own)}
            rest = [r | {"n": r["n"] - mine.get((r.get("path", ""), r["feature"]), 0)} for r in json.loads(pool)]
            a, b = build_tree(name, json.loads(own)), build_tree(name, [r for r in rest if r["n"] > 0])
            silent = not sum(a.types.values()) or not sum(b.types.values())
            rows.append((m, chain, name, silent or content_likeness(a, b) >= SAME_COLUMN))
        yield pd.DataFrame(rows, columns=["mirror", "chain", "name", "alike"])


def field_columns(profiles: DataFrame, changes: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``mirror, file_name, path, column``: the compiled projection of every file.

    Within a mirror a field keeps its column along the scripts. Chains of several mirrors are one
    column where they share a name and its content there is like that of the others; a chain with a
    meaning of its own gets a column of its own. A column is named like its field in most files, or
    as in ``wanted``; what would repeat a name is marked with the mirror.
    """
    file = ["mirror", "file_name"]
    steps = changes.groupBy(*file).agg(F.collect_list(F.struct("kind", "old_name", "new_name")).alias("steps"))
    series = profiles.select(*file, "names").join(steps, file, "left")
    paths = cut(series.groupBy("mirror").applyInPandas(_chains, "mirror string, file_name string, path string, name string, chain string"), "field_chains")
    top = paths.filter(F.expr("path not like '/%/%'"))
    fields = profiles.select(*file, F.explode(F.from_json("profile", _FIELD)).alias("f")).select(*file, F.col("f.name").alias("name"), F.explode(F.from_json("f.tree", _TREE)).alias("t"))
    cells = fields.join(top, [*file, "name"]).groupBy("mirror", "chain", "name", "t.path", "t.feature").agg(F.sum("t.n").alias("n"))
    cells = cut(cells, "chain_content")
    row = F.to_json(F.collect_list(F.struct("path", "feature", "n")))
    own = cells.groupBy("mirror", "chain", "name").agg(row.alias("own"))
    pool = cells.groupBy("name", "path", "feature").agg(F.sum("n").alias("n")).groupBy("name").agg(row.alias("pool"))
    alike = own.join(pool, "name").mapInPandas(_alike, "mirror string, chain string, name string, alike boolean").filter("alike")
    node = F.concat_ws("\u0001", F.lit("c"), "mirror", "chain")
    links = alike.select(node.alias("a"), F.concat_ws("\u0001", F.lit("n"), "name").alias("b"), "mirror", "chain", "name")
    roots = components(links)
    used = paths.groupBy("mirror", "chain", "name").agg(F.count(F.lit(1)).alias("n"))
    of = used.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.col("name").isin(*wanted) if wanted else F.lit(False)
    sizes = of.groupBy("root", "name").agg(F.sum("n").alias("n"), F.min("mirror").alias("mirror"))
    named = sizes.groupBy("root").agg(F.min_by("name", F.struct(F.when(first, 0).otherwise(1), -F.col("n"), F.col("name"))).alias("column"), F.sum("n").alias("n"), F.min("mirror").alias("m"))
    k = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "root"))
    k2 = F.row_number().over(Window.partitionBy("column", "m").orderBy(F.desc("n"), "root"))
    marked = F.when(k == 1, F.col("column")).otherwise(F.concat("column", F.lit("@"), "m", F.when(k2 > 1, F.concat(F.lit("#"), k2.cast("string"))).otherwise(F.lit(""))))
    names = named.select("root", marked.alias("column"))
    chains = of.select("mirror", "chain", "root").distinct().join(names, "root")
    return paths.join(chains, ["mirror", "chain"]).select(*file, "path", "column")


def _at(obj: object, keys: list[str]) -> object:
    for k in keys:
        if not isinstance(obj, dict):
            return None
        obj = obj.get(k)
    return obj


def unified_table(lines: DataFrame, changes: DataFrame, fields: dict[str, str], profiles: DataFrame | None = None) -> DataFrame:
    """All objects as one table: ``mirror, file_name, line_no``, ``fields`` (column to SQL type) and ``more``.

    Each line is read by the projection of its file (see ``field_columns``), so only fields that
    belong to the file are read and a stray key is never taken for one. ``more`` holds all other columns of
    the line as one JSON object, added fields included; null if there are none. Lines without mirror or file are read by their own names.
    A value that cannot be read as its column's type is null. Object or array values stay JSON
    text in string columns; an object that wraps one number gives that number to a numeric column.
    """
    profiles = cut(file_profiles(lines), "profiles") if profiles is None else profiles
    columns = field_columns(profiles, changes, list(fields))
    specs = columns.groupBy("mirror", "file_name").agg(F.to_json(F.sort_array(F.collect_list(F.struct("column", "path")))).alias("_spec"))
    specs = cut(specs.select(F.to_json(F.array("mirror", "file_name")).alias("_file"), "_spec"), "projections")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, list[tuple[str, list[str]]]] = {}
        for batch in batches:
            rows = []
            for m, f, n, line, spec in zip(batch["mirror"], batch["file_name"], batch["line_no"], batch["line"], batch["_spec"]):
                obj = parse_object(line)
                if obj is None:
                    continue
                if not isinstance(spec, str):
                    reads = [(k, [k]) for k in obj]
                else:
                    if spec not in ready:
                        ready[spec] = [(x["column"], [_key(s) for s in x["path"][1:].split("/")]) for x in json.loads(spec)]
                    reads = ready[spec]
                values = {c: v for c, keys in reads if (v := _at(obj, keys)) is not None}
                more = {c: v for c, v in values.items() if c not in fields}
                text = json.dumps(more, ensure_ascii=False, sort_keys=True) if more else None
                rows.append((m, f, n, *[_as_text(values.get(c), t) for c, t in fields.items()], text))
            yield pd.DataFrame(rows, columns=["mirror", "file_name", "line_no", *fields, "more"])

    keyed = lines.select("mirror", "file_name", "line_no", "line").withColumn("_file", F.to_json(F.array("mirror", "file_name")))
    size = specs.agg(F.sum(F.length("_spec") + F.length("_file")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        read = keyed.join(F.broadcast(specs), "_file", "left")
    else:
        read = balanced_join(keyed, specs, "_file", ["line_no", "line"], "left")
    ddl = "mirror string, file_name string, line_no long, " + ", ".join(f"`{f}` string" for f in fields) + ", more string"
    flat = read.select("mirror", "file_name", "line_no", "line", "_spec").mapInPandas(project, ddl)
    cast = [F.col(f"`{f}`").try_cast(t).alias(f) if t not in ("string", "bigint", "int") else F.col(f"`{f}`").try_cast("double").try_cast(t).alias(f) if t != "string" else F.col(f"`{f}`") for f, t in fields.items()]
    return flat.select("mirror", "file_name", "line_no", *cast, "more")


def _as_text(value: object, sql_type: str) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if sql_type == "boolean" and not isinstance(value, bool):
        return str(bool(value)).lower() if isinstance(value, (int, float)) else "true"
    if isinstance(value, bool):
        return str(value).lower() if sql_type in ("boolean", "string") else str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    if sql_type != "string" and isinstance(value, dict):
        numbers = [v for v in value.values() if isinstance(v, (int, float)) and not isinstance(v, bool)]
        return repr(numbers[0]) if len(numbers) == 1 else None
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
