"""Flows, chains, calls, neighbours and differences against plain versions on random rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import calls, crossgraph, diffs, flows, memory, neighbour_graph
from loomstone.operators.graph import cut, scratch
from loomstone.plans import registry
from loomstone.tables import Tables

registry.queries()


def test_taint_with_cleaners_and_cycles(spark):
    r = random.Random(1)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(60)] + [(3, 3), (3, 4), (4, 3)]
    sources = [(r.randrange(25), r.choice("xy")) for _ in range(6)] + [(None, "x"), (1, None)]
    sinks = [(r.randrange(25), r.choice("xy")) for _ in range(12)]
    cleaners = [(r.randrange(25), r.choice("xy")) for _ in range(8)]
    got = flows.taint_paths(*(spark.createDataFrame(x, k) for x, k in ((edges, "src int, dst int"), (sources, "id int, label string"), (sinks, "id int, label string"), (cleaners, "id int, label string")))).collect()
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    want = {}
    for s, label in set(sources):
        if s is None or label is None:
            continue
        depth, edge, d = {s: 0}, {s}, 0
        while edge:
            d += 1
            edge = {b for a in edge for b in to[a] if (b, label) not in set(cleaners)} - set(depth)
            depth.update(dict.fromkeys(edge, d))
        want |= {(s, label, k): d for k, d in depth.items() if d and (k, label) in set(sinks)}
    assert {(g["source"], g["label"], g["sink"]): g["depth"] for g in got} == want and want
    for g in got:
        p = g["path"]
        assert len(p) == g["depth"] + 1 and p[0] == g["source"] and p[-1] == g["sink"] and all(b in to[a] for a, b in zip(p, p[1:])) and not any((x, g["label"]) in set(cleaners) for x in p[1:])


def random_units(r, n=12):
    statements, steps = [], []
    for u in range(n):
        size = r.randrange(1, 9)
        for line in range(1, size + 1):
            statements.append((u, line, r.choice([None, "a", "b", "c"]), r.sample("abcd", r.randrange(3)) if r.random() < 0.9 else None))
            if line < size:
                steps.append((u, line, line + 1))
            if r.random() < 0.3:
                steps.append((u, line, r.randrange(1, size + 1)))
    return statements, steps


def test_taint_broadcasts_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(flows, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.checkpoint())
    spark.sparkContext.setCheckpointDir(scratch(spark, "taint"))
    edges = [(i, i // k) for i in range(1, 200) for k in (2, 3)]
    frames = [spark.createDataFrame(x, k) for x, k in ((edges, "src int, dst int"), ([(i, "x") for i in range(100, 120)], "id int, label string"), ([(i, "x") for i in range(9)], "id int, label string"), ([(7, "x")], "id int, label string"))]
    got = {(r["source"], r["sink"]): (r["depth"], r["path"]) for r in flows.taint_paths(*frames).collect()}
    assert got[100, 0] == (5, [100, 33, 11, 3, 1, 0]) and (119, 7) not in got
    assert len(plans) < 12 and not any("BroadcastHashJoin" in p for p in plans)


def test_definitions_and_lineage(spark):
    statements, steps = random_units(random.Random(2))
    s = spark.createDataFrame(statements, "unit int, line int, target string, uses array<string>")
    e = spark.createDataFrame(steps, "unit int, src int, dst int")
    defines = {(u, n): t for u, n, t, _ in statements}
    after = defaultdict(set)
    for u, a, b in steps:
        after[u, a].add(b)
    reaching, changed = defaultdict(set), True
    while changed:  # the classic sets, line by line
        changed = False
        for u, n, t, _ in statements:
            out = {(v, d) for v, d in reaching[u, n] if v != t} | ({(t, n)} if t else set())
            for b in after[u, n]:
                changed |= not out <= reaching[u, b]
                reaching[u, b] |= out
    got = {(x["unit"], x["variable"], x["defined"], x["line"]) for x in flows.reaching_definitions(s, e).collect()}
    assert got == {(u, v, d, n) for (u, n), x in reaching.items() for v, d in x}
    flow = {(u, d, n, v) for u, n, _, uses in statements for v in uses or [] for w, d in reaching[u, n] if w == v}
    found = flows.data_flow(s, e)
    assert Counter(tuple(x) for x in found.collect()) == Counter(flow) and flow
    start = [(u, n) for u, n, *_ in statements if n == 1]
    lines = flows.lineage(found, spark.createDataFrame(start, "unit int, line int")).collect()
    back, forward = defaultdict(set), defaultdict(set)
    for u, a, b, _ in flow:
        back[u, b].add(a)
        forward[u, a].add(b)
    want = set()
    for u, n in start:
        for way, to in (("back", back), ("forward", forward)):
            depth, edge, d = {n: 0}, {n}, 0
            while edge:
                d += 1
                edge = {y for x in edge for y in to[u, x]} - set(depth)
                depth.update(dict.fromkeys(edge, d))
            want |= {(u, n, k, way, d, not to[u, k]) for k, d in depth.items()}
    assert {(x["unit"], x["start"], x["line"], x["way"], x["depth"], x["end"]) for x in lines} == want
    assert defines


def test_blocks_of_a_known_function(spark):
    text = "x = 1\ny = 2\nif (x) {\n  y = 3\n} \nelse {\n}\n  for (;;) {\niffy()\nreturn y"
    f = spark.createDataFrame([("f", text, 10), ("empty", "", 1), ("none", None, 1), ("head", "while (1)\nend", 1)], "unit string, content string, start_line int")
    blocks = flows.basic_blocks(f)
    got = {(b["unit"], b["block"]): (b["start_line"], b["end_line"], b["is_entry"], b["is_exit"]) for b in blocks.collect()}
    assert got == {("f", 0): (10, 11, True, False), ("f", 1): (12, 14, False, False), ("f", 2): (15, 16, False, False), ("f", 3): (17, 18, False, False), ("f", 4): (19, 19, False, True), ("empty", 0): (1, 1, True, True), ("head", 0): (1, 2, True, True)}
    edges = {(e["unit"], e["src"], e["dst"], e["kind"]) for e in flows.block_edges(blocks).collect()}
    assert edges == {("f", i, i + 1, "sequential") for i in range(4)} | {("f", 1, 2, "branch_true"), ("f", 3, 3, "loop_back"), ("head", 0, 0, "loop_back")}


def test_dominators_and_loops(spark):
    r = random.Random(3)
    edges = {(u, r.randrange(7), r.randrange(7)) for u in range(6) for _ in range(11)} | {(9, 0, 1), (9, 1, 2), (9, 2, 1), (9, 2, 3)}
    units = {u for u, *_ in edges}
    e = spark.createDataFrame(sorted(edges), "unit int, src int, dst int")
    dom = flows.dominators(e, spark.createDataFrame([(u, 0) for u in units], "unit int, node int"))

    def reach(u, without=None):
        seen, todo = set(), [0] if without != 0 else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for v, a, b in edges if v == u and a == x and b != without]
        return seen

    want = {(u, n, d) for u in units for d in reach(u) for n in reach(u) if n not in reach(u, d)}
    got = dom.collect()
    assert {(x["unit"], x["node"], x["dominator"]) for x in got} == want
    for x in got:
        above = {d for u, n, d in want if u == x["unit"] and n == x["node"] and d != n}
        assert x["immediate"] == (x["dominator"] in above and all((x["unit"], x["dominator"], d) in want for d in above))
    loops = defaultdict(set)
    for x in flows.natural_loops(e, dom).collect():
        loops[x["unit"], x["head"], x["tail"]].add(x["node"])
    for u, a, b in edges:
        if (u, a, b) in want:
            body, todo = {b, a}, [a] if a != b else []
            while todo:
                x = todo.pop()
                for v, p, q in edges:
                    if v == u and q == x and p not in body:
                        body.add(p)
                        todo.append(p)
            assert loops.pop((u, b, a)) == body | set()
    assert not loops


def test_chains_of_edge_kinds(spark):
    nodes = spark.createDataFrame([(1, "f", "Alpha"), (2, "f", "beta"), (3, "v", "alp"), (4, "v", None)], "id int, kind string, name string")
    edges = spark.createDataFrame([(1, 2, "call"), (2, 1, "call"), (2, 3, "flow"), (1, 3, "flow"), (3, 4, "flow"), (1, 2, "call")], "src int, dst int, kind string")
    got = {tuple(x["path"]) for x in flows.chains(nodes, edges, [("call", 0, 2), ("flow", 1, 2)], "f", "ALP").collect()}
    assert got == {(1, 3), (1, 3, 4), (1, 2, 3), (1, 2, 3, 4)}


def plain_calls(order, entry, depth, breadth):
    seen, out, cut = set(), [], False

    def visit(x, d):
        nonlocal cut
        if d > depth:
            cut = True
            return
        if x in seen:
            return
        seen.add(x)
        out.append((x, d))
        for y in order.get(x, [])[:breadth]:
            visit(y, d + 1)

    visit(entry, 0)
    return out, cut


@pytest.mark.parametrize("depth,breadth", [(5, 5), (2, 2), (0, 1)])
def test_call_flow_as_depth_first(spark, depth, breadth):
    r = random.Random(4)
    rows = [(r.randrange(20), r.randrange(20), i) for i in range(90)] + [(None, 1, 1), (1, None, 1)]
    first = {}
    for a, b, p in rows:
        if a is not None and b is not None:
            first[a, b] = min(first.get((a, b), p), p)
    order = defaultdict(list)
    for (a, b), _ in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
        order[a].append(b)
    got = defaultdict(list)
    for x in calls.call_flow(spark.createDataFrame(rows, "src int, dst int, place int"), spark.createDataFrame([(i,) for i in range(22)], "id int"), depth, breadth).collect():
        got[x["entry"]].append((x["place"], x["id"], x["depth"], x["truncated"]))
    for entry in range(22):
        out, cut = plain_calls(order, entry, depth, breadth)
        assert sorted(got[entry]) == [(i, n, d, cut) for i, (n, d) in enumerate(out)]


def test_call_flow_keeps_functions_and_no_paths(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(calls, "cut", lambda df: kept.append(df.cache()) or kept[-1])
    rows = [(i, j, j) for i in range(5) for j in range(5)]
    got = calls.call_flow(spark.createDataFrame(rows, "src int, dst int, place int"), spark.createDataFrame([(i,) for i in (0, 1, 9, None)], "id int"), 4)
    assert Counter((r["entry"], r["id"]) for r in got.collect()) == Counter([(e, i) for e in (0, 1) for i in range(5)] + [(9, 9), (None, None)])
    assert max(k.count() for k in kept) <= 10


def test_influence_chains_as_one_after_the_other(spark):
    r = random.Random(5)
    kinds = list(crossgraph.DAMPING)
    edges = sorted({(r.randrange(30), r.randrange(30), r.choice(kinds)) for _ in range(110)})
    edges = [(a, b, k, r.random(), r.random()) for a, b, k in edges]
    value = {i: r.random() for i in range(27)}
    links = crossgraph.influence_chains(spark.createDataFrame([(i,) for i in range(30)], "id int"), spark.createDataFrame(list(value.items()), "id int, value double"), spark.createDataFrame(edges, "src int, dst int, kind string, weight double, confidence double"))
    got = defaultdict(list)
    for x in links.collect():
        got[x["target"]].append((x["place"], x["src"], x["dst"], x["kind"], pytest.approx(x["factor"])))
    lengths = {x["target"]: (x["links"], x["factor"]) for x in crossgraph.chain_summary(links).collect()}
    for target in range(30):
        chain, opened, queue, factor = [], set(), [target], 1.0
        while queue and len(chain) < 10:
            node = queue.pop(0)
            if node in opened:
                continue
            opened.add(node)
            for a, b, k, w, c in sorted((e for e in edges if e[1] == node), key=lambda e: (-value.get(e[0], -1), e[0], e[2])):
                if a not in opened and a in value:
                    chain.append((len(chain) + 1, a, b, k, crossgraph.DAMPING[k] * w * c))
                    factor *= chain[-1][4]
                    queue.append(a)
        assert sorted(got[target], key=lambda x: x[0]) == chain
        assert lengths.get(target, (0, 1.0)) == (len(chain), pytest.approx(factor))


def clustered(n, dim=48, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20 + 1, dim))
    return centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("shard_rows", [10_000, 300])
def test_neighbour_graph_recall(spark, shard_rows):
    x = clustered(700)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 48), (None, x[0].tolist()), (3, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = scratch(spark, "index")
    neighbour_graph.build_index(vectors, path, shard_rows=shard_rows)
    queries = vectors.where("id % 25 = 0 or id = 5001")
    found = neighbour_graph.search_index(neighbour_graph.read_index(spark, path), queries)
    rows = found.collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {q: set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist()) for q in range(0, 700, 25)}
    mine = defaultdict(dict)
    for r in rows:
        mine[r["query"]][r["rank"]] = r
    assert set(mine) == set(exact)
    assert all(sorted(m) == list(range(1, 11)) and m[1]["id"] == q and all(m[i]["score"] >= m[i + 1]["score"] for i in range(1, 10)) for q, m in mine.items())
    assert all(r["score"] == pytest.approx(float(unit[r["query"]] @ unit[r["id"]])) for r in rows)
    assert sum(len(exact[q] & {r["id"] for r in m.values()}) for q, m in mine.items()) / (10 * len(exact)) >= 0.95
    again = scratch(spark, "again")
    neighbour_graph.build_index(vectors.repartition(7), again, shard_rows=shard_rows)
    assert Counter(map(tuple, neighbour_graph.search_index(neighbour_graph.read_index(spark, again), queries).collect())) == Counter(map(tuple, rows))


def test_chains_look_up_only_what_goes_on(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(crossgraph, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    ids = spark.range(50).select("id")
    edges = spark.createDataFrame([(i + 1, i, "documented_by_decision", 1.0, 1.0) for i in range(2)], "src long, dst long, kind string, weight double, confidence double")
    got = crossgraph.influence_chains(ids, ids.withColumn("value", F.lit(0.5)), edges)
    assert Counter(r["target"] for r in got.collect()) == {0: 2, 1: 1}
    assert all(k.count() <= 12 for k in kept[3:])


def test_neighbours_of_the_table_against_exact_ones(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    found = neighbour_graph.search_index(neighbour_graph.build_index(vectors, scratch(spark, "table")), vectors.where("id % 50 = 0"))
    x = {r["id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids = sorted(x)
    unit = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    exact = [(q, ids[j]) for q in ids if q % 50 == 0 for j in np.argsort(-(unit @ unit[ids.index(q)]), kind="stable")[:10]]
    assert neighbour_graph.recall(found, spark.createDataFrame([(int(a), int(b)) for a, b in exact], "query long, id long")) >= 0.95


def test_neighbour_graph_is_built_by_products_of_blocks(monkeypatch):
    monkeypatch.setattr(neighbour_graph, "BLOCK_ROWS", 32)
    x = clustered(260, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    layers = np.array([1 + (i % 4 == 1) + (i % 16 == 1) for i in range(len(x))])
    most, breadth = 5, 20
    away = lambda a, b: float(1 - x[a] @ x[b])

    def choose(node, among, limit):
        among, picked = sorted(among, key=lambda j: (away(node, j), j)), []
        for j in among:
            if len(picked) < limit and all(away(node, j) <= away(j, p) for p in picked):
                picked.append(j)
        return (picked + [j for j in among if j not in picked])[:limit]

    want = [[] for _ in x]
    for layer in range(3):
        on = [i for i in range(len(x)) if layers[i] > layer]
        theirs = {i: [] for i in on}
        for i in on:
            for j in choose(i, sorted([j for j in on if j < i], key=lambda j: away(i, j))[:breadth], most):
                theirs[i].append(j)
                theirs[j].append(i)
        limit = most * (2 if layer == 0 else 1)
        for i in on:
            want[i].append(sorted(theirs[i] if len(theirs[i]) <= limit else choose(i, theirs[i], limit)))
    got = neighbour_graph.layered_links(x, layers, most, breadth)
    assert [[sorted(layer) for layer in n] for n in got] == want


def test_each_shard_of_the_index_has_a_task(spark):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(700))], "id long, embedding array<double>")
    index = neighbour_graph.build_index(vectors, scratch(spark, "tasks"), shard_rows=50)
    of = index.groupBy(F.input_file_name()).agg(F.countDistinct("shard").alias("n")).collect()
    assert [r["n"] for r in of] == [1] * 14


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_differences_lead_from_one_text_to_the_other(spark):
    r = random.Random(8)
    text = lambda: None if r.random() < 0.05 else "\n".join(r.choice(["a", "b", "c", "", "dé"]) for _ in range(r.randrange(0, 30)))
    pairs = [(i, text(), text()) for i in range(150)] + [(200, "same\ntext", "same\ntext"), (201, "x\n" * 4000, "x\n" * 4000 + "y")]
    for context in (0, 3):
        got = diffs.unified_diffs(spark.createDataFrame(pairs, "id int, a string, b string"), ["id"], "a", "b", context).collect()
        assert len(got) == len(pairs)
        for g in got:
            _, a, b = next(p for p in pairs if p[0] == g["id"])
            a, b = a or "", b or ""
            assert diffs.patched(a, [h.asDict() for h in g["hunks"]]) == b and g["changes"] == g["additions"] + g["deletions"]
            if g["id"] < 200:
                common = longest_common(a.split("\n"), b.split("\n"))
                assert (g["deletions"], g["additions"]) == (len(a.split("\n")) - common, len(b.split("\n")) - common)
        assert next(g for g in got if g["id"] == 200)["hunks"] == []


def test_next_rows_of_a_group_over_many_ranges(spark):
    rows = [("en", i, f"t{i}") for i in range(300)] + [("de", 2 * i, None) for i in range(40)] + [(None, i, "n") for i in range(3)] + [("fr", 1, "x"), ("en", None, "y")]
    near = diffs.with_next(spark.createDataFrame(rows, "lang string, doc_id long, text string"), "lang", "doc_id")
    want = []
    for lang in ("en", "de", None):
        of = sorted((r for r in rows if r[0] == lang), key=lambda r: -1 if r[1] is None else r[1])
        want += [(*a, *b) for a, b in zip(of, of[1:])]
    assert Counter(map(tuple, near.collect())) == Counter(want)


def test_line_diffs_spread_a_language(spark, sf):
    plan = registry.PLANS["line_diffs"](Tables(spark, sf))._jdf.queryExecution().toString()
    by = [line for line in plan.splitlines() if "Window [" in line and "text" in line]
    assert by and all("_range" in line for line in by)


def test_facts_written_one_after_the_other(spark):
    r = random.Random(9)
    rows = [(r.choice(["p", "q", None]), i // 2, f"f{i:03}", r.choice([None, "", "  ", *[" ".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 7))) for _ in range(20)]])) for i in range(300)]
    df = spark.createDataFrame(rows, "scope string, at int, id string, text string")
    for newest in (300, 5):
        events = memory.write_facts(df, "scope", ["at"], "id", "text", newest=newest)
        want, held = [], defaultdict(list)  # newest first
        for scope, at, i, text in sorted(rows, key=lambda x: (x[1], x[2])):
            if not (text or "").strip():
                continue
            text = text.strip()
            words = lambda x: set(x.split())
            facts = held[scope]
            scores = [len(words(text) & words(t)) / len(words(text) | words(t)) for _, t in facts]
            best = max(scores, default=0)
            if best >= 0.5:
                fact, old = facts.pop(scores.index(best))
                want.append((scope, at, fact, "update", old, text))
            else:
                fact = i
                want.append((scope, at, i, "add", None, text))
            facts.insert(0, (fact, text))
            del facts[newest:]
        assert Counter(tuple(x) for x in events.collect()) == Counter(want)
    after = {(x["scope"], x["fact_id"]): x["writes"] for x in memory.facts_after(events, "scope", ["at"]).collect()}
    assert after == Counter((w[0], w[2]) for w in want)


def test_lineage_of_a_depth(spark):
    flow = spark.createDataFrame([(1, i, i + 1) for i in range(1, 12)], "unit int, src int, dst int")
    start = spark.createDataFrame([(1, 12)], "unit int, line int")
    back = {r["line"]: (r["depth"], r["end"]) for r in flows.lineage(flow, start, depth=8).where("way = 'back'").collect()}
    assert back == {12 - d: (d, False) for d in range(9)}
    assert flows.lineage(flow, start).where("way = 'back'").count() == 12


def test_large_units_go_by_frontiers_with_equal_results(spark):
    rng = random.Random(5)
    pairs = {(u, rng.randrange(8), rng.randrange(8)) for u in range(12) for _ in range(3 + u)}
    e = spark.createDataFrame(sorted(pairs), "unit int, src int, dst int")
    entry = spark.createDataFrame([(u, 0) for u in range(13)], "unit int, node int")
    said = spark.createDataFrame([(u, k, f"v{k % 3}" if k % 4 else None) for u in range(12) for k in range(8)], "unit int, line int, target string")
    for most in (0, 8):
        for f, a, b in ((flows.dominators, e, entry), (flows.natural_loops, e, flows.dominators(e, entry)), (flows.reaching_definitions, said, e)):
            few, some = f(a, b), f(a, b, most=most)
            assert few.columns == some.columns and few.count() > 12 and Counter(map(tuple, few.collect())) == Counter(map(tuple, some.collect()))


def test_units_take_no_level_of_joins_each(spark, monkeypatch):
    seen = []
    keep = flows.cut
    monkeypatch.setattr(flows, "cut", lambda df: seen.append(1) or keep(df))
    e = spark.createDataFrame([(1, i, i + 1) for i in range(20)], "unit int, src int, dst int")
    assert flows.dominators(e, spark.createDataFrame([(1, 0)], "unit int, node int")).count() == 21 * 22 // 2 and len(seen) < 10


@pytest.mark.parametrize("most", [5000, 6])
def test_lineage_in_units_is_that_of_the_flow(spark, most):
    rng = random.Random(5)
    name = lambda: rng.choice(["x", "y", None])
    rows = [(u, i, name(), [name(), "z"] if i % 4 else None, [i + 1 if i < n else None, rng.randrange(1, n + 1)], i in (1, n)) for u, n in [(1, 4), (2, 9), (3, 1), (None, 5), (4, 12)] for i in range(1, n + 1)]
    st = spark.createDataFrame(rows, "unit int, line long, target string, uses array<string>, then array<long>, start boolean")
    flow = flows.data_flow(st, st.select("unit", F.col("line").alias("src"), F.explode("then").alias("dst")))
    for depth in (None, 1):
        want = Counter(map(tuple, flows.lineage(flow, st.where("start").select("unit", "line"), depth).collect()))
        assert len(want) > 20 and Counter(map(tuple, flows.lineage_in_units(st, depth, most).collect())) == want


def test_lineage_query_shuffles_lines_but_writes_no_flow(spark, sf, monkeypatch):
    monkeypatch.setattr(flows, "data_flow", None)  # for units over UNIT_ROWS alone
    assert registry.PLANS["data_lineage"](Tables(spark, sf)).count() > 5000
