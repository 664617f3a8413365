"""Data and control flow over statement tables: taint, reaching definitions, lineage, basic blocks, dominators, loops.

A unit is a function or a file. Units of up to UNIT_ROWS rows are gathered to a row each and worked through one by one
inside tasks; larger ones, and graphs without units, are frontiers of joins over (unit, node, state) rows that grow until
nothing new is found. Lineage of plans is cut with checkpoints at each level, so plans stay small and lost executors
cost one level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.graph import cut

#: The words at the start of a line that begin a block, and those of loops.
CONTROL = "if|else|for|while|do|switch|case|default|try|catch|finally|return|throw|break|continue"
LOOPS = "for|while|do"


#: Units with more rows than this go by frontiers of joins.
UNIT_ROWS = 5000
#: Levels after which a front is rid of what was met before: doing so reads all that was met.
SIFT = 4


def _packed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(unit, name_column...): a row a unit, with an array for each column, in one order."""
    lists = rows.groupBy("unit").agg(F.collect_list(F.struct(*columns)).alias("_r"))
    return lists.select("unit", *[F.col("_r")[c].alias(f"{name}_{c}") for c in columns])


def _by_unit(packed: DataFrame, work: Callable[..., Iterable[tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """(unit, fields...): the tuples that work makes of a unit's columns; fields: name, type."""
    names, kind = [f for f, _ in fields], packed.schema["unit"].dataType.simpleString()
    schema = ", ".join(f"`{f}` {t}" for f, t in [("unit", kind), *fields])
    types = pa.schema(packed.sparkSession.createDataFrame([], schema).toArrow().schema)

    def run(batches):
        for b in batches:
            units, found = [], []
            for unit, *columns in zip(*[c.to_pylist() for c in b.columns], strict=True):
                got = list(work(*columns))
                units += [unit] * len(got)
                found += got
            for i in range(0, len(found), 100_000):
                part = [units[i : i + 100_000], *(list(zip(*found[i : i + 100_000], strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, types.types, strict=True)], names=["unit", *names])

    return packed.mapInArrow(run, schema)


def _split(large: DataFrame, *frames: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The frames without the large units, and with them alone, or None if there are none."""
    large = cut(large.select("unit").distinct())
    if large.isEmpty():
        return list(frames), None
    return [f.join(large, "unit", "left_anti") for f in frames], [f.join(large, "unit", "left_semi") for f in frames]


def _large(*frames: DataFrame, most: int) -> DataFrame:
    out = None
    for f in frames:
        one = f.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("unit")
        out = one if out is None else out.union(one)
    return out


def _near(a: list | None, b: list | None) -> dict:
    to: dict = {}
    for x, y in zip(a or (), b or (), strict=True):
        to.setdefault(x, []).append(y)
    return to


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, cleaners: DataFrame | None = None, depth: int = 20) -> DataFrame:
    """(source, label, sink, depth, path): each source and each sink that its taint reaches, with one shortest path as witness.

    edges: src, dst. sources: id, label, what kind of taint a node brings in. sinks: id, label, what a node must not get.
    cleaners: id, label; a node takes that label off whatever passes it, so nothing goes on from there, and as a sink it
    is safe from it. Sources are dirty whatever they clean. A node is no sink of itself. Of equally short paths that with
    the least predecessor at each step, seen from the sink, is the witness. Null ends and labels reach nothing. No path
    meets a node twice, and what was met before by a shorter path is sifted out every few levels and at the end.
    """
    labels = lambda rows, name: rows.groupBy(F.col("id").alias("dst")).agg(F.collect_set("label").alias(name)).hint("merge")
    e = edges.select("src", "dst").where("src <> dst").distinct().join(labels(sinks, "_sink"), "dst", "left")
    e = e.withColumn("_clean", F.lit(None).cast(e.schema["_sink"].dataType)) if cleaners is None else e.join(labels(cleaners, "_clean"), "dst", "left")
    e, has = cut(e), lambda among: F.coalesce(F.array_contains(among, F.col("label")), F.lit(False))
    brought = sources.select(F.col("id").alias("source"), "label").where("source is not null and label is not null").distinct()
    # Nothing is broadcast: each side grows with the input. A path goes along with its front, so there is no way back to walk.
    front = cut(brought.select("source", "label", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(False).alias("hit")))
    levels = [front]
    for d in range(1, depth + 1):
        step = front.join(e.hint("merge"), F.col("node") == F.col("src")).where(~has("_clean") & ~F.array_contains("path", F.col("dst")))
        new = step.groupBy("source", "label", F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path"), F.first(has("_sink")).alias("hit"))
        if d % SIFT == 0:
            seen = reduce(DataFrame.unionByName, [level.select("source", "label", "node") for level in levels])
            new = new.join(seen.hint("merge"), ["source", "label", "node"], "left_anti")
        front = cut(new.withColumn("path", F.concat("path", F.array("node"))))
        if front.isEmpty():
            break
        levels.append(front)
    hits = reduce(DataFrame.unionByName, [level.where("hit").withColumn("depth", F.lit(d)) for d, level in enumerate(levels)])
    least = hits.groupBy("source", "label", F.col("node").alias("sink")).agg(F.min_by(F.struct("depth", "path"), "depth").alias("_p"))
    return least.select("source", "label", "sink", "_p.depth", "_p.path")


def steps_in_order(statements: DataFrame) -> DataFrame:
    """(unit, src, dst): control goes from each statement (unit, line) to the next line of its unit."""
    after = F.lead("line").over(Window.partitionBy("unit").orderBy("line"))
    return statements.select("unit", F.col("line").alias("src"), after.alias("dst")).where("dst is not null")


def _reach(defined: list, variable: list, src: list | None, dst: list | None) -> Iterable[tuple]:
    to, kill = _near(src, dst), set(zip(defined, variable, strict=True))
    for line, name in kill:
        seen = set(to.get(line, ()))
        stack = list(seen)
        while stack:
            at = stack.pop()
            if (at, name) not in kill:
                new = set(to.get(at, ())) - seen
                seen |= new
                stack += new
        for at in seen:
            yield name, line, at


def reaching_definitions(statements: DataFrame, steps: DataFrame, most: int = UNIT_ROWS) -> DataFrame:
    """(unit, variable, defined, line): the definitions that may still hold when control comes to a line.

    statements: unit, line, target (null where nothing is defined). steps: unit, src, dst, where control may go. A
    definition goes on through every line that doesn't define its variable anew (gen and kill); rows only ever get
    more, up to a fixpoint, so loops end. A line's own definition reaches the line where a loop comes back to it.
    """
    s = steps.select("unit", "src", "dst").dropna().distinct()
    gen = statements.select("unit", F.col("line").alias("defined"), F.col("target").alias("variable")).dropna().distinct()
    s, gen = cut(s), cut(gen)
    (few, small), rest = _split(_large(s, gen, most=most), s, gen)
    line, name = (gen.schema[c].dataType.simpleString() for c in ("defined", "variable"))
    packed = _packed(small, "d", ["defined", "variable"]).join(_packed(few, "s", ["src", "dst"]), "unit")
    out = _by_unit(packed, _reach, [("variable", name), ("defined", line), ("line", s.schema["dst"].dataType.simpleString())])
    return out if rest is None else out.unionByName(_reaching_frontier(*rest))


def _reaching_frontier(s: DataFrame, gen: DataFrame) -> DataFrame:
    kill = gen.select("unit", F.col("defined").alias("line"), "variable")
    seen = cut(gen.join(s.withColumnRenamed("src", "defined"), ["unit", "defined"]).select("unit", "variable", "defined", F.col("dst").alias("line")).distinct())
    front = seen
    while True:
        passed = front.join(kill, ["unit", "line", "variable"], "left_anti")
        moved = passed.join(s.withColumnRenamed("src", "line"), ["unit", "line"]).select("unit", "variable", "defined", F.col("dst").alias("line")).distinct()
        front = cut(moved.join(seen, ["unit", "variable", "defined", "line"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def data_flow(statements: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(unit, src, dst, variable): the value that src defines may be read at dst.

    statements: unit, line, target, uses (array of variables; null reads nothing). Without steps, control goes from line
    to line.
    """
    reaching = reaching_definitions(statements, steps_in_order(statements) if steps is None else steps)
    uses = statements.select("unit", "line", F.explode("uses").alias("variable")).distinct()
    return uses.join(reaching, ["unit", "line", "variable"]).select("unit", F.col("defined").alias("src"), F.col("line").alias("dst"), "variable")


def lineage(flow: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(unit, start, line, way, depth, end): every line that the value at start comes from ('back') or goes to ('forward'), at its least distance; end where it comes from, or goes, no farther.

    flow: unit, src, dst, as data_flow makes it. start: unit, line. The start itself is at depth 0 both ways. A depth is
    the greatest distance followed.
    """
    e = cut(flow.select("unit", "src", "dst").distinct())
    out = None
    for way, here, there in (("back", "dst", "src"), ("forward", "src", "dst")):
        seen = cut(start.select("unit", F.col("line").alias("start"), "line", F.lit(0).alias("depth")).distinct())
        front, at = seen, 0
        step = e.select("unit", F.col(here).alias("line"), F.col(there).alias("_next"))
        while depth is None or at < depth:
            at += 1
            moved = front.join(step, ["unit", "line"]).select("unit", "start", F.col("_next").alias("line")).distinct()
            front = cut(moved.join(seen, ["unit", "start", "line"], "left_anti").withColumn("depth", F.lit(at)))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        goes = step.select("unit", "line", F.lit(False).alias("_ends")).distinct()
        part = seen.join(goes, ["unit", "line"], "left").select("unit", "start", "line", F.lit(way).alias("way"), "depth", F.coalesce("_ends", F.lit(True)).alias("end"))
        out = part if out is None else out.unionByName(part)
    return out


def _follow(depth: int | None) -> Callable[..., Iterable[tuple]]:
    def work(line: list, target: list, uses: list, then: list, start: list) -> Iterable[tuple]:
        define = [(x, v) for x, v in zip(line, target, strict=True) if x is not None and v is not None]
        steps = [(x, y) for x, ys in zip(line, then, strict=True) if x is not None for y in ys or () if y is not None]
        reads: dict = {}
        for x, names in zip(line, uses, strict=True):
            reads.setdefault(x, set()).update(names or ())
        flow = set()
        if define and steps:
            flow = {(a, b) for name, a, b in _reach(*zip(*define, strict=True), *zip(*steps, strict=True)) if name in reads.get(b, ())}
        forward, back = {}, {}
        for a, b in flow:
            forward.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
        for first in {x for x, s in zip(line, start, strict=True) if s}:
            for way, to in (("back", back), ("forward", forward)):
                seen, front, at = {first}, [first], 0
                while front:
                    for x in front:
                        yield first, x, way, at, x not in to
                    if at == depth:
                        break
                    at += 1
                    front = list({y for x in front for y in to.get(x, ())} - seen)
                    seen.update(front)

    return work


def lineage_in_units(statements: DataFrame, depth: int | None = None, most: int = UNIT_ROWS) -> DataFrame:
    """(unit, start, line, way, depth, end): what lineage gives over the data_flow of these statements.

    statements: unit, line, target, uses, then (array of lines where control may go from there), start (whether to follow
    it). All of a unit is in these rows, so units of up to `most` of them are shuffled once, gathered to a row each and
    followed inside tasks, and no row of the flow is written anywhere; larger ones go by data_flow and lineage.
    """
    named, line = statements.where("unit is not null"), statements.schema["line"].dataType.simpleString()
    (few,), rest = _split(_large(named, most=most), named)
    packed = _packed(few, "r", ["line", "target", "uses", "then", "start"])
    out = _by_unit(packed, _follow(depth), [("start", line), ("line", line), ("way", "string"), ("depth", "int"), ("end", "boolean")])
    alone = statements.where("unit is null and start").select("unit", F.col("line").alias("start"), "line").distinct()
    ways = alone.withColumn("way", F.explode(F.array(F.lit("back"), F.lit("forward"))))
    out = out.unionByName(ways.withColumns({"depth": F.lit(0), "end": F.lit(True)}))
    if rest is not None:
        large = rest[0]
        flow = data_flow(large, large.select("unit", F.col("line").alias("src"), F.explode("then").alias("dst")))
        out = out.unionByName(lineage(flow, large.where("start").select("unit", "line"), depth))
    return out


def _starts_with(line: Column, words: str) -> Column:
    return line.rlike(rf"^\s*({words})\b")


def basic_blocks(functions: DataFrame) -> DataFrame:
    """(unit, block, start_line, end_line, statements, is_entry, is_exit): a block ends before each line that begins with a control word.

    functions: unit, content, start_line (of the content's first line). A null content has no blocks; an empty one has
    one block of one empty line. A text that starts with a control word starts its first block with it.
    """
    lines = functions.select("unit", "start_line", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    leads = F.when((F.col("at") > 0) & _starts_with(F.col("text"), rf"{CONTROL}|else\s+if"), 1).otherwise(0)
    numbered = lines.withColumn("block", F.sum(leads).over(Window.partitionBy("unit").orderBy("at")))
    block = numbered.groupBy("unit", "block").agg((F.min("start_line") + F.min("at")).alias("start_line"), (F.min("start_line") + F.max("at")).alias("end_line"), F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("statements"))
    last = F.max("block").over(Window.partitionBy("unit"))
    return block.select("unit", "block", "start_line", "end_line", "statements", (F.col("block") == 0).alias("is_entry"), (F.col("block") == last).alias("is_exit"))


def block_edges(blocks: DataFrame) -> DataFrame:
    """(unit, src, dst, kind, confidence): 'sequential' from block to block, 'branch_true' for each if that has a block after it, 'loop_back' for each loop."""
    prior = blocks.where("block > 0").select("unit", (F.col("block") - 1).alias("src"), F.col("block").alias("dst"), F.lit("sequential").alias("kind"), F.lit(1.0).alias("confidence"))
    said = blocks.select("unit", "block", "is_exit", F.explode("statements").alias("text"))
    branch = said.where(_starts_with(F.col("text"), "if") & ~F.col("is_exit")).select("unit", F.col("block").alias("src"), (F.col("block") + 1).alias("dst"), F.lit("branch_true").alias("kind"), F.lit(0.8).alias("confidence"))
    loop = said.where(_starts_with(F.col("text"), LOOPS)).select("unit", F.col("block").alias("src"), F.col("block").alias("dst"), F.lit("loop_back").alias("kind"), F.lit(1.0).alias("confidence"))
    return prior.unionByName(branch).unionByName(loop)


def _dominate(entry, src: list | None, dst: list | None) -> Iterable[tuple]:
    """Sets of dominators as bits, by the order in which nodes are finished last, until none gets smaller."""
    to, order, seen, stack = _near(src, dst), [], {entry}, [(entry, iter(()))]
    stack[0] = (entry, iter(to.get(entry, ())))
    while stack:
        at, rest = stack[-1]
        new = next((x for x in rest if x not in seen), None)
        if new is None:
            order.append(at)
            stack.pop()
        else:
            seen.add(new)
            stack.append((new, iter(to.get(new, ()))))
    order.reverse()
    number = {x: i for i, x in enumerate(order)}
    before: list[list[int]] = [[] for _ in order]
    for x in order:
        for y in to.get(x, ()):
            before[number[y]].append(number[x])
    of = [1] + [(1 << len(order)) - 1] * (len(order) - 1)
    moved = True
    while moved:
        moved = False
        for i in range(1, len(order)):
            bits = -1
            for j in before[i]:
                bits &= of[j]
            bits |= 1 << i
            moved |= bits != of[i]
            of[i] = bits
    count = [bits.bit_count() for bits in of]
    for i, bits in enumerate(of):
        while bits:
            j = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            yield order[i], order[j], count[j] == count[i] - 1


def dominators(edges: DataFrame, entries: DataFrame, most: int = UNIT_ROWS) -> DataFrame:
    """(unit, node, dominator, immediate): the nodes that every path from the unit's entry to a node passes, itself included.

    edges: unit, src, dst; entries: unit, node, one a unit. What can't be reached has no dominators. A node d dominates
    what is no longer reached without d: the frontier of large units carries (unit, the node left out, node), so a unit
    of n nodes has n * n rows at most.
    """
    e = cut(edges.select("unit", "src", "dst").where("src <> dst").distinct())
    first = entries.select("unit", "node").distinct()
    (few, small), rest = _split(_large(e, most=most), e, first)
    node = e.schema["src"].dataType.simpleString()
    packed = small.select("unit", F.col("node").cast(node).alias("node")).join(_packed(few, "e", ["src", "dst"]), "unit", "left")
    out = _by_unit(packed, _dominate, [("node", node), ("dominator", node), ("immediate", "boolean")])
    return out if rest is None else out.unionByName(_dominators_frontier(*rest))


def _dominators_frontier(e: DataFrame, entries: DataFrame) -> DataFrame:
    reached = _reached(e, entries.select("unit", F.lit(None).cast(e.schema["src"].dataType).alias("without"), "node"))
    reached = cut(reached.select("unit", "node"))
    left_out = reached.select("unit", F.col("node").alias("without")).join(entries.select("unit", F.col("node").alias("_entry")), "unit").where("without <> _entry")
    still = _reached(e, left_out.select("unit", "without", F.col("_entry").alias("node")))
    pairs = reached.join(reached.select("unit", F.col("node").alias("dominator")), "unit")
    found = cut(pairs.join(still.withColumnRenamed("without", "dominator"), ["unit", "dominator", "node"], "left_anti"))
    # Dominators of a node are a chain; the last before the node has the most dominators itself.
    rank = found.groupBy("unit", "node").agg(F.count(F.lit(1)).alias("_n"))
    ranked = found.join(rank.select("unit", F.col("node").alias("dominator"), F.col("_n").alias("_of")), ["unit", "dominator"]).join(rank, ["unit", "node"])
    return ranked.select("unit", "node", "dominator", (F.col("_of") == F.col("_n") - 1).alias("immediate"))


def _reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(unit, without, node): what is reached from start rows without passing `without` (null: without leaving anything out)."""
    seen = cut(start.select("unit", "without", "node").distinct())
    front = seen
    while True:
        moved = front.join(edges.withColumnRenamed("src", "node"), ["unit", "node"]).where("without is null or dst <> without").select("unit", "without", F.col("dst").alias("node")).distinct()
        same = [F.col("m.unit") == F.col("s.unit"), F.col("m.without").eqNullSafe(F.col("s.without")), F.col("m.node") == F.col("s.node")]
        front = cut(moved.alias("m").join(seen.alias("s"), same, "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def _bodies(head: list, tail: list, src: list | None, dst: list | None) -> Iterable[tuple]:
    back = _near(dst, src)
    for h, t in zip(head, tail, strict=True):
        seen, stack = {t}, [t]
        while stack:
            at = stack.pop()
            if at != h:
                new = set(back.get(at, ())) - seen
                seen |= new
                stack += new
        for x in seen:
            yield h, t, x


def natural_loops(edges: DataFrame, dominated: DataFrame, most: int = UNIT_ROWS) -> DataFrame:
    """(unit, head, tail, node): for each edge from tail back to a head that dominates it, the nodes of its loop.

    dominated: as dominators makes it. The loop has the head, and whatever comes to the tail without passing the head.
    """
    e = cut(edges.select("unit", "src", "dst").distinct())
    heads = e.join(dominated.select("unit", F.col("node").alias("src"), F.col("dominator").alias("dst")), ["unit", "src", "dst"]).select("unit", F.col("dst").alias("head"), F.col("src").alias("tail"))
    heads = cut(heads)
    (few, small), rest = _split(_large(e, most=most), e, heads)
    node = e.schema["src"].dataType.simpleString()
    packed = _packed(small, "h", ["head", "tail"]).join(_packed(few, "e", ["src", "dst"]), "unit")
    out = _by_unit(packed, _bodies, [("head", node), ("tail", node), ("node", node)])
    return out if rest is None else out.unionByName(_loops_frontier(*rest))


def _loops_frontier(e: DataFrame, heads: DataFrame) -> DataFrame:
    # A loop is named by (head, tail); its nodes are reached backwards from the tail, with the head left out.
    seen = cut(heads.select("unit", "head", "tail", F.col("tail").alias("node")))
    front = seen.where("node <> head")
    while True:
        moved = front.join(e.select("unit", F.col("dst").alias("node"), F.col("src").alias("_before")), ["unit", "node"]).select("unit", "head", "tail", F.col("_before").alias("node")).distinct()
        new = cut(moved.join(seen, ["unit", "head", "tail", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))
        front = new.where("node <> head")


def chains(nodes: DataFrame, edges: DataFrame, pattern: list[tuple[str, int, int]], kind: str | None = None, name_like: str | None = None) -> DataFrame:
    """(start, finish, path): the paths that match a chain of edge kinds, over a property graph of nodes (id, kind, name) and edges (src, dst, kind).

    pattern: (edge kind, fewest, most) in order; a path follows edges of each kind that many times. kind and name_like
    pick the nodes where paths may start: of that kind, with that text in their name whatever the case. No path passes a
    node twice. A pattern is a fixed number of joins, the sum of its greatest counts.
    """
    first = nodes
    if kind is not None:
        first = first.where(F.col("kind") == kind)
    if name_like is not None:
        first = first.where(F.contains(F.lower("name"), F.lit(name_like.lower())))
    paths = first.select(F.array("id").alias("path")).distinct()
    for edge_kind, fewest, most in pattern:
        e = edges.where(F.col("kind") == edge_kind).select("src", "dst").distinct()
        done = paths if fewest == 0 else None
        for k in range(1, most + 1):
            here = paths.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
            paths = cut(here.select(F.concat("path", F.array("dst")).alias("path")))
            if k >= fewest:
                done = paths if done is None else done.unionByName(paths)
        paths = done
    return paths.select(F.get("path", 0).alias("start"), F.element_at("path", -1).alias("finish"), "path").distinct()
