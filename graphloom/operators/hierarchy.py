"""Parent-child rows to full hierarchies: path, depth, root, descendants, loops.

A fragment is what lies in one range of (tree, id), whole trees and parts of
trees alike; ranges have about ``fragment_rows`` rows, so a tree of any size is
cut into fragments of bounded size. A Python stage contracts the parent chains
of each fragment to its exits, the nodes whose parent lies elsewhere. Where an
exit leads is looked up in the contracted rows. The exits on which other exits
depend are the quotient forest; it is solved by the same steps, on its smaller
number of rows in fewer and so wider ranges, until one fragment holds it. If a
contraction leaves more than half of the rows (ids that say nothing about
closeness), the next ranges put each node beside its parent by coin: a node
that shows tails goes to a parent that shows heads, which contracts a share of
all chains, however the ids run. Then the paths above the exits are put before
the paths inside the fragments.

A loop is local (inside a fragment) or global: then it is a loop of the quotient
forest, whose entries into a fragment are followed up to the fragment's exit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions
from ..staging import Stage

ROOT, EXIT, LOOP, TAIL = 0, 1, -1, -2
_OUT = pa.schema([
    ("tree", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("state", pa.int32()), ("top", pa.string()), ("root", pa.string()),
    ("steps", pa.int64()), ("path", pa.list_(pa.string())),
])
_OUT_DDL = "tree bigint, node string, parent string, state int, top string, root string, steps bigint, path array<string>"


class Fragment:
    """The rows of one tree in one fragment.

    ``parts``: what each node adds to the path, from its parent (not included) to itself; None for the node alone.
    ``roots``: the root to which a node without parent belongs; None for the node itself.
    ``steps``: the length of the part; negative if the node is known to lead into a loop.
    """

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.parents: list[str | None] = []
        self.steps: list[int] = []
        self.parts: list[list[str] | None] = []
        self.roots: list[str | None] = []

    def loops(self, up: list[int]) -> dict[int, int]:
        """LOOP or TAIL of the nodes from which no top is reached; ``up`` has the parent's number or -1."""
        found: dict[int, int] = {}
        for start in range(len(up)):
            chain, place, at = [], {}, start
            while at not in found and at not in place:
                place[at] = len(chain)
                chain.append(at)
                at = up[at]
            cut = place.get(at, len(chain))
            found.update((x, TAIL) for x in chain[:cut])
            found.update((x, LOOP) for x in chain[cut:])
        return found

    def contract(self, paths: bool) -> Iterator[tuple]:
        """Rows of ``_OUT`` without the tree; ``path`` is the live path of the walk, to be copied by the reader.

        The walk goes down from the tops and keeps one path, that of the node it is at.
        """
        at = {n: i for i, n in enumerate(self.nodes)}
        below: dict[int, list[int]] = {}
        tops, left = [], len(self.nodes)
        for i, p in enumerate(self.parents):
            j = at.get(p, -1) if p is not None else -1
            if j < 0:
                tops.append(i)
            else:
                below.setdefault(j, []).append(i)
        for t in tops:
            outside = self.parents[t] is not None
            root = self.roots[t] if self.roots[t] is not None else self.nodes[t]
            state = EXIT if outside else ROOT if self.steps[t] >= 0 else TAIL
            top, path = self.nodes[t], []
            stack = [(t, 0, 0)]
            while stack:
                i, steps, long = stack.pop()
                steps += self.steps[i]
                if paths:
                    del path[long:]
                    part = self.parts[i]
                    if part is None:
                        path.append(self.nodes[i])
                    else:
                        path.extend(part)
                    long = len(path)
                left -= 1
                yield self.nodes[i], self.parents[i], state, top, root, steps, path
                stack.extend((j, steps, long) for j in below.get(i, ()))
        if left:
            seen, stack = set(), list(tops)
            while stack:
                i = stack.pop()
                seen.add(i)
                stack.extend(below.get(i, ()))
            rest = [i for i in range(len(self.nodes)) if i not in seen]
            number = {i: k for k, i in enumerate(rest)}
            state_of = self.loops([number[at[self.parents[i]]] for i in rest])
            for k, i in enumerate(rest):
                yield self.nodes[i], self.parents[i], state_of[k], self.nodes[i], "", 0, []


class _Writer:
    """Contracted rows as batches of a bounded number of values."""

    def __init__(self, flush: int):
        self.flush = flush
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in _OUT.names[:-1]]
        self.offsets, self.values = [0], []

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, _OUT)]
        arrays.append(pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.values, pa.string())))
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_OUT)

    def add(self, tree: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for *row, path in rows:
            for c, v in zip(self.columns, (tree, *row)):
                c.append(v)
            self.values.extend(path)
            self.offsets.append(len(self.values))
            if len(self.values) + len(self.offsets) > self.flush:
                yield self.batch()


def _local(paths: bool, flush: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tree, node, parent, steps, part, root), those of a tree together, to contracted rows."""
        out, tree, fragment = _Writer(flush), None, Fragment()
        for batch in batches:
            for t, node, parent, steps, part, root in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tree:
                    yield from out.add(tree, fragment.contract(paths))
                    tree, fragment = t, Fragment()
                fragment.nodes.append(node)
                fragment.parents.append(parent)
                fragment.steps.append(steps)
                fragment.parts.append(part)
                fragment.roots.append(root)
        yield from out.add(tree, fragment.contract(paths))
        yield out.batch()

    return run


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, top, node, parent, entry), those of a top together: the nodes between the entries and the top."""
    found: list[tuple[int, str]] = []

    def walk(tree: int | None, parents: dict[str, str | None], entries: list[str]) -> None:
        seen = set()
        for node in entries:
            while node in parents and node not in seen:
                seen.add(node)
                node = parents[node]
        found.extend((tree, n) for n in seen)

    key, parents, entries = (None, None), {}, []
    for batch in batches:
        for tree, top, node, parent, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if (tree, top) != key:
                walk(key[0], parents, entries)
                key, parents, entries = (tree, top), {}, []
            parents[node] = parent
            if entry:
                entries.append(node)
    walk(key[0], parents, entries)
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.string())], names=["tree", "node"])


_NO_PATH = "array()"


def _by_id() -> list[Column]:
    """Neighbours in the order of ids: numbers within ids run as numbers when shorter ids come first."""
    return [F.col("tree"), F.length("node"), F.col("node")]


def _by_coin(level: int) -> list[Column]:
    """Each node beside its parent if it shows tails and the parent heads. A parent with very many children is cut by the ids of the children."""
    heads = lambda c: F.pmod(F.xxhash64("tree", c, F.lit(level)), F.lit(2)) == 0
    beside = F.when(F.col("parent").isNotNull() & ~heads("node") & heads("parent"), F.col("parent")).otherwise(F.col("node"))
    return [F.col("tree"), beside, F.when(beside == F.col("node"), F.lit("")).otherwise(F.col("node"))]


def _solve(rows: DataFrame, stage: Stage, n: int, width: int, fragment_rows: int, paths: bool, trace: list, closeness: bool = True) -> DataFrame:
    """Staged rows (tree, node, parent, steps, part, root) to (tree, node, state, root, steps, path); state is ROOT, LOOP or TAIL."""
    level = len(trace)
    order = _by_id() if closeness else _by_coin(level)
    fragments = max(width, -(-n // fragment_rows))
    ranged = rows.repartitionByRange(fragments, *order).sortWithinPartitions("tree")
    local = stage.put(ranged.select("tree", "node", "parent", "steps", "part", "root").mapInArrow(_local(paths), _OUT_DDL))
    inside = local.where(F.col("state") != EXIT).select("tree", "node", "state", "root", "steps", "path")
    exits = local.where((F.col("state") == EXIT) & (F.col("top") == F.col("node"))).select("tree", F.col("node").alias("exit"), F.col("parent").alias("above"), F.col("root").alias("own"))
    at = local.select("tree", F.col("node").alias("above"), "state", "top", "root", "steps", "path")
    # Where each exit leads: to nothing (a root after all), into a solved chain, into a loop, or to another exit.
    led = stage.put(exits.join(at, ["tree", "above"], "left").select(
        "tree", "exit", "above",
        F.expr(f"CASE WHEN state IS NULL THEN {ROOT} WHEN state < 0 THEN {TAIL} ELSE state END").alias("state"),
        F.expr(f"if(state = {EXIT}, top, NULL)").alias("to"),
        F.coalesce(F.when(F.col("state").isNull(), F.col("own")), F.col("root"), F.lit("")).alias("root"),
        F.expr("CASE WHEN state IS NULL THEN 0 WHEN state < 0 THEN -1 ELSE steps END").alias("steps"), F.expr(f"coalesce(path, {_NO_PATH})").alias("part"),
    ))
    open_ = led.where(F.col("state") == EXIT)
    asked = open_.select("tree", F.col("to").alias("exit")).distinct()
    quotient = stage.put(led.join(asked, ["tree", "exit"], "left_semi").select(
        "tree", F.col("exit").alias("node"), F.col("to").alias("parent"), "steps", "part", F.when(F.col("to").isNull(), F.col("root")).alias("root"),
    ))
    counts = led.agg(F.count("*")).first()[0]
    size = quotient.count() if counts else 0
    trace.append({"rows": n, "fragments": fragments, "exits": counts, "quotient": size})
    told = led.where(F.col("state") != EXIT).select("tree", F.col("exit").alias("top"), F.col("state").alias("s"), F.col("root").alias("r"), F.col("steps").alias("n"), F.col("part").alias("p"))
    on_loop = None
    if size:
        solved = stage.put(_solve(quotient, stage, size, 1, fragment_rows, paths, trace, size * 2 <= n))
        of = solved.select("tree", F.col("node").alias("to"), F.expr(f"if(state = {ROOT}, {ROOT}, {TAIL})").alias("s"), F.col("root").alias("r"), F.col("steps").alias("n"), F.col("path").alias("p"))
        told = told.unionByName(open_.join(of, ["tree", "to"]).select(
            "tree", F.col("exit").alias("top"), "s", "r", (F.col("n") + F.col("steps")).alias("n"), F.concat("p", "part").alias("p"),
        ))
        loops = stage.put(open_.join(solved.where(F.col("state") == LOOP).select("tree", F.col("node").alias("exit")), ["tree", "exit"], "left_semi").select("tree", F.col("to").alias("top"), F.col("above").alias("node")))
        if not loops.isEmpty():
            # The rows of the fragments that a global loop runs through; those of a top lie in one fragment.
            parts = local.join(loops.select("tree", "top").distinct(), ["tree", "top"], "left_semi")
            marked = parts.join(loops.select("tree", "node", F.lit(True).alias("entry")).distinct(), ["tree", "node"], "left")
            marked = marked.select("tree", "top", "node", F.when(F.col("node") != F.col("top"), F.col("parent")).alias("parent"), F.coalesce("entry", F.lit(False)).alias("entry"))
            on_loop = stage.put(marked.repartition("tree", "top").sortWithinPartitions("tree", "top").mapInArrow(_climb, "tree bigint, node string"))
    outside = local.where(F.col("state") == EXIT).select("tree", "node", "top", "steps", "path").join(told, ["tree", "top"])
    outside = outside.select("tree", "node", F.col("s").alias("state"), F.col("r").alias("root"), (F.col("n") + F.col("steps")).alias("steps"), F.concat("p", "path").alias("path"))
    if on_loop is not None:
        outside = outside.join(on_loop.withColumn("on", F.lit(True)), ["tree", "node"], "left").withColumn("state", F.expr(f"if(on, {LOOP}, state)")).drop("on")
    return inside.unionByName(outside)


def hierarchy(df: DataFrame, tree: str, node: str, parent: str, fragment_rows: int = 50_000, paths: bool = True, trace: list | None = None) -> DataFrame:
    """(tree, node, root_id, depth, path) for every distinct (tree, node).

    * A node without parent, or whose parent (NULL, '' or unknown) is not in the tree, is a root of depth 0.
    * ``path`` is the array of ids from root to node. The paths of a chain are quadratic in its length; without ``paths`` there is no such column and the work is linear.
    * On a loop depth is -1, in a chain that runs into a loop -2; root_id is '' and path empty.
    * If a node comes with several parents the smallest non-NULL one counts; repeated rows count once.
    * Rows with a NULL tree or node are no nodes. An empty table gives an empty one. Other columns are not read.
    * ``trace`` gets one entry for each contraction: rows, fragments, exits and rows of the quotient.
    """
    spark = df.sparkSession
    stage = Stage(spark, "hierarchy")
    rows = df.select(df[tree].cast("bigint").alias("tree"), df[node].cast("string").alias("node"), df[parent].cast("string").alias("parent"))
    edges = stage.put(rows.where("tree IS NOT NULL AND node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    own = edges.select("tree", "node", "parent", F.lit(1).cast("bigint").alias("steps"), F.lit(None).cast("array<string>").alias("part"), F.lit(None).cast("string").alias("root"))
    out = _solve(own, stage, edges.count(), partitions(spark), fragment_rows, paths, [] if trace is None else trace)
    good = F.col("state") == ROOT
    out = out.select("tree", "node", F.when(good, F.col("root")).otherwise("").alias("root_id"), F.when(good, F.col("steps") - 1).otherwise(F.col("state")).cast("int").alias("depth"), F.when(good, F.col("path")).otherwise(F.expr(_NO_PATH)).alias("path"))
    return out if paths else out.drop("path")


def descendants(nodes: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for every node and each of its ancestors; nodes on or behind loops have none."""
    steps = nodes.where("depth > 0").select("tree", "node", "depth", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "ancestor"))
    return steps.select("tree", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
