"""Queries over whole tables against brute force: no row is left out by its id."""

from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from loomstone.operators import aggregates
from loomstone.plans import registry
from loomstone.plans.graph_queries import tree
from loomstone.tables import Tables

registry.queries()


@pytest.fixture
def run(spark, sf):
    def rows(name, folder=sf):
        t = Tables(spark, folder)
        return t, registry.PLANS[name](t).collect()

    return rows


def test_fold_of_all_orders(run):
    t, got = run("bayes_ordered_fold")
    lines = defaultdict(list)
    for r in t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").collect():
        lines[r[0]].append(tuple(r[1:]))
    for k, of in lines.items():
        p = 0.5
        for *_, flag in sorted(of):
            a, b = (0.85, 0.35) if flag != "R" else (0.15, 0.65)
            p = min(0.95, max(0.05, p + 0.7 * (p * a / (p * a + (1 - p) * b) - p)))
        lines[k] = p
    assert {r["l_orderkey"]: r["p"] for r in got} == {k: pytest.approx(p, abs=2e-6) for k, p in lines.items()}


def test_closeness_of_all_nodes(run):
    t, got = run("closeness_bounded")
    to, ids = defaultdict(set), set()
    for a, b in tree(t).select("src", "dst").collect():
        ids |= {a, b}
        to[a].add(b)
    want = {}
    for root in ids:
        depth, edge = {root: 0}, {root}
        for d in range(1, 5):
            edge = {y for x in edge for y in to[x]} - set(depth)
            depth.update(dict.fromkeys(edge, d))
        want[root] = (len(depth) - 1) / sum(depth.values()) if len(depth) > 1 else 0
    assert len(want) > 60 and {r["id"]: r["closeness"] for r in got} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_pairs_are_made_and_counted_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PART_ROWS", 100)
    rows = [(i % 300, i * i % 37) for i in range(1900)] + [(None, 1), (None, 2), (7, None), (1000, None)] + [(1, k) for k in range(100, 180)]
    got = aggregates.cochange(spark.createDataFrame(rows, "c long, f long"), "c", "f", least_count=2)
    of = defaultdict(set)
    for c, f in rows:
        if None not in (c, f):
            of[c].add(f)
    want = Counter(p for files in of.values() for p in combinations(sorted(files)[:50], 2))
    assert {(r["a"], r["b"]): (r["together"], r["strength"]) for r in got.collect()} == {p: (n, n / len(of)) for p, n in want.items() if n > 1}
    assert got.rdd.getNumPartitions() == 20


def test_owners_and_partners_are_summed_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PART_ROWS", 100)
    rows = [(i % 300, i * i % 37, i % 11, float(i % 7)) for i in range(1900)] + [(1, k, k, 1.0) for k in range(100, 180)] + [(None, 1, None, 2.0), (5, None, 1, 2.0)]
    lines = spark.createDataFrame(rows, "c long, f long, a long, q double")
    of, sums, total = defaultdict(set), Counter(), Counter()
    for c, f, a, q in rows:
        if f is not None:
            sums[f, a] += q
            total[f] += q
            if c is not None:
                of[c].add(f)
    shares = aggregates.ownership(lines, "f", "a", "q")
    want = {k: (q, q / total[k[0]]) for k, q in sums.items() if total[k[0]] and q / total[k[0]] >= 0.05}
    assert {(r["f"], r["a"]): (r["lines"], r["share"]) for r in shares.collect()} == want
    pairs = Counter(p for files in of.values() for p in combinations(sorted(files), 2))
    together, partners = Counter(), Counter()
    for p, n in pairs.items():
        for f in p:
            together[f] += n
            partners[f] += 1
    near = aggregates.partners(lines, "c", "f")
    assert {r["f"]: (r["together"], r["partners"]) for r in near.collect()} == {f: (together[f], partners[f]) for f in together}
    assert near.rdd.getNumPartitions() == aggregates.parts(lines) == 20
    assert aggregates.by_author(lines, "f", "a", F.sum("q")).rdd.getNumPartitions() == 20


def test_flagship_counts_all_files_of_a_commit(spark, tmp_path):
    rows = [(1, k, k % 5, 3.0) for k in range(60)] + [(i, i * i % 61, i % 5, 2.0) for i in range(2, 400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in registry.queries()["flagship_hotspots"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = c.execute(registry.SQL["flagship_hotspots"]).fetchall()
    assert len(got) == 20 and max(r[3] for r in got) >= 59 and got == want


def test_pairs_of_all_files_of_a_commit(spark, tmp_path):
    rows = [(c, k) for c in (1, 2) for k in range(70)] + [(c, c % 9) for c in range(3, 40)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.queries()["cochange_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, 2, round(2 / 39, 9)) for a, b in combinations(range(70), 2)}
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == set(c.execute(registry.SQL["cochange_pairs"]).fetchall())


def test_dependents_at_any_depth(spark, tmp_path):
    spark.range(45_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: r["depth"] for r in registry.queries()["exhaustive_dependents"](spark, str(tmp_path)).collect()}
    want = {10: 0}
    for k in range(11, 45_000):  # each part depends on lesser ones
        known = [want[x] for x in (k // 2, k // 3) if x in want]
        if known:
            want[k] = min(known) + 1
    assert want.pop(10) == 0 and max(want.values()) == 12 and got == want
    c = duckdb.connect()
    c.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == dict(c.execute(registry.SQL["exhaustive_dependents"]).fetchall())


def test_timeline_of_all_entities(run):
    t, got = run("evolution_timeline")
    want = [(a, b, "order") for a, b in t.orders.select("o_custkey", "o_orderdate").collect()] + [tuple(r) for r in t.events.select("user_id", "ts", "event_type").collect()]
    assert Counter(map(tuple, got)) == Counter(want)


def test_loops_of_all_suppliers(run, sf):
    t, got = run("feedback_loops", sf.replace("sf0.001", "sf0.01"))
    ids = {r[0] for r in t.supplier.select("s_suppkey").collect()}
    assert len(ids) > 40 and {r["component"]: r["size"] for r in got} == {k: 4 for k in ids if k % 4 == 0 and {k + 1, k + 2, k + 3} <= ids}


def test_components_of_all_suppliers(run, sf):
    t, got = run("graph_scc", sf.replace("sf0.001", "sf0.01"))
    ids = {r[0] for r in t.supplier.select("s_suppkey").collect()}
    whole = {k for k in ids if {k - k % 5 + i for i in range(5)} <= ids}
    assert {r["id"]: (r["component"], r["size"]) for r in got if r["id"] in whole} == {k: (k - k % 5, 5) for k in whole} and ids <= {r["id"] for r in got}


def test_clone_tokens_of_all_items(run, sf):
    t, got = run("clone_tokens", sf.replace("sf0.001", "sf0.1"))
    ids = {r[0] for r in t.benchmark.select("item_id").collect()}
    assert len(ids) > 40 and {r["a"] for r in got} == {i for i in ids if i + 1 in ids}


def test_expertise_is_that_of_whole_numbers(run, sf):
    t, got = run("org_importance", sf.replace("sf0.001", "sf0.01"))
    lines = defaultdict(Counter)
    for file, author, q in t.lineitem.select("l_partkey", "l_suppkey", "l_quantity").collect():
        lines[file][author] += int(q)
    for r in got:
        by = lines[r["file"]]
        tenths = sum(q * (author % 10 if author % 3 else 5) for author, q in by.items())
        millionths = tenths * 10**5 * 2 // sum(by.values()) + 1 >> 1  # half up
        assert r["expertise"] == min(10**6, millionths) / 10**6
