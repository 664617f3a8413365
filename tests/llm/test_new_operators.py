"""Window panes, fingerprint groups and source divergence against plain versions, on odd rows and on the tables."""

import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomstone.llm import simhash_groups, source_divergence, window_panes

DOC = "doc_id long, text string, lang string, source string, f string, term string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HOUR, DAY = 3600, 86400
EPOCH = datetime(1970, 1, 1)


def plain_panes(rows, batches):
    """The rules, one batch after the other."""
    once = {}
    for click, ts, arrived, kind, value in sorted(rows, key=lambda r: (r[2] is not None, r[2] or EPOCH, r[1] or EPOCH, r[3] is not None, r[3] or "", r[4] is not None, r[4] or 0)):
        if ts is not None:
            once.setdefault(click, (ts, arrived or ts, kind, value))
    fed = defaultdict(list)
    for click, (ts, arrived, kind, value) in once.items():
        d = (arrived - EPOCH).days
        q = d % batches
        late = 0 if click is None else max(0, zlib.crc32(str(click).encode()) % 30 - 23)
        at = (ts - EPOCH - timedelta(days=d - q)) / timedelta(microseconds=1)
        cents = 0 if value is None or value != value else int(np.floor(100 * value + 0.5))
        fed[min(batches - 1, q + late)].append((at, kind or "none", int(at // (HOUR * 10**6)), click, cents))
    out, held, w = [], {}, float("-inf")
    for b in range(batches):
        due, closed = (lambda h: w >= ((h + 1) * HOUR + 2 * HOUR) * 10**6), (lambda h: w >= ((h + 1) * HOUR + 3 * DAY) * 10**6)
        touched = set()
        for _, kind, hour, click, cents in fed[b]:
            if closed(hour):
                out.append((b, hour, click, 1, cents, "late", kind))
            else:
                p = held.setdefault((kind, hour), [0, 0, None])
                p[0] += 1
                p[1] += cents
                touched.add((kind, hour))
        for (kind, hour), p in list(held.items()):
            if p[2] is None and due(hour):
                out.append((b, hour, -1, p[0], p[1], "emit", kind))
                p[2] = (p[0], p[1])
            elif p[2] is not None and (kind, hour) in touched:
                out += [(b, hour, -1, *p[2], "retract", kind), (b, hour, -1, p[0], p[1], "replace", kind)]
                p[2] = (p[0], p[1])
            if closed(hour):
                del held[kind, hour]
        w = max([w, *(r[0] for r in fed[b])])
    return out + [(batches - 1, hour, -1, p[0], p[1], "final", kind) for (kind, hour), p in held.items() if p[2] is None]


CLICK = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, hour string"


def clicks():
    t = lambda d, h, m=0, s=0: datetime(2024, 1, d, h, m, s)
    first = datetime(1970, 1, 1) + timedelta(days=19728)  # a day whose number is a multiple of 12, 4 and 3
    rows = [(1, t(3, 5), t(3, 5), "view", 1.005), (1, t(3, 5), t(3, 5), "view", 1.005), (1, t(3, 5), t(3, 6), "click", 9.0), (2, None, t(3, 5), "view", 1.0), (3, t(3, 5, 59, 59), None, None, None), (None, t(4, 1), t(4, 1), "view", float("nan")), (None, t(4, 2), t(4, 2), "view", 2.0)]
    rows += [(100 + i, first + timedelta(hours=5 * (i % 17), minutes=i), first + timedelta(hours=5 * (i % 17), minutes=i, days=i % 5 == 0), ["view", "click"][i % 2], i / 3 - 4) for i in range(90)]
    rows += [(1000 + i, first + timedelta(days=2, hours=2), first + timedelta(days=2, hours=2), "view", 1.0) for i in range(40)]  # one hot pane, its end exactly met
    rows += [(2000 + i, first - timedelta(hours=30), first + timedelta(days=3), "view", -0.005) for i in range(9)]  # before 1970 once moved
    return [(*r, "clash", "clash") for r in rows]


@pytest.mark.parametrize("batches", [3, 4])
def test_panes_as_plain_rules(spark, batches):
    rows = clicks()
    got = [tuple(r) for r in window_panes.panes(spark.createDataFrame(rows, CLICK), batches).collect()]
    want = plain_panes([r[:5] for r in rows], batches)
    assert Counter(got) == Counter(want)
    assert {"emit", "final"} <= {r[5] for r in got}


def test_panes_of_no_clicks(spark):
    out = window_panes.panes(spark.createDataFrame([], CLICK), 2)
    assert out.columns == ["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"]
    assert out.count() == 0


def test_hot_panes_are_added_up_before_the_shuffle():
    n = 5000
    b = pa.RecordBatch.from_pydict({"click_id": list(range(n)), "kind": ["view"] * n, "hour": [7] * (n - 100) + [-90] * 100, "cents": [3] * n, "mark": ["row"] * n})
    out = pa.Table.from_batches(list(window_panes._partials(0, window_panes.CLOSE_MS, 8)(iter([b, b])))).to_pylist()
    late, sums = [r for r in out if r["part"] >= 0], [r for r in out if r["part"] < 0]
    assert [(r["n"], r["cents"]) for r in sums] == [(2 * (n - 100), 6 * (n - 100))]
    assert len(late) == 200 and len({r["part"] for r in late}) == 8 and {r["late_hour"] for r in late} == {-90}


def test_panes_of_all_clicks(spark, sf):
    got = Counter(tuple(r) for r in window_panes.op11_window_panes(spark, sf).collect())
    c = duckdb.connect()
    c.execute(f"create view clicks as select * from '{sf}/clicks.parquet'")
    assert got == Counter(c.execute(window_panes.ORACLE_SQL).fetchall())
    assert {r[5] for r in got} == {"late", "emit", "retract", "replace", "final"}


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def odd_texts():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, "one two three four five"), (2, "one  two\tthree\nfour FIVE"), (2, "one two"), (2, "one two"), (3, None), (4, ""), (5, " \n "), (6, long), (7, long + " tail"), (None, "one two"), (None, "no other text is like this one"), (8, "Été à la mer, ÉTÉ à la mer"), (9, "x" * 5000)]
    return [*rows, *((20 + i, long + f" w{i}") for i in range(30))]


def test_fingerprints_of_odd_texts(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(d, t, "en", "a", "clash", "clash") for d, t in rows], DOC)
    for block in (simhash_groups.BLOCK_ROWS, 3):
        got = [tuple(r) for r in simhash_groups.simhash_groups(docs, block_rows=block).collect()]
        assert Counter(got) == Counter(plain_components(rows))
    assert simhash_groups.simhash_groups(docs.limit(0)).count() == 0


def test_fingerprints_of_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in simhash_groups.op12_simhash(spark, sf).collect()) == Counter(plain_components(rows))


@pytest.mark.parametrize("n", [10**3, 10**7, 10**11])
def test_segments_miss_no_pair(spark, n):
    """Random pairs that differ in 0 to 4 bits meet, in whatever segments n asks for."""
    rng = np.random.default_rng(5)
    parts = simhash_groups.choose_segments(n)
    assert any(radius for _, _, radius in parts)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    other = base.copy()
    for i in range(300):
        for b in rng.choice(64, i % 6, replace=False):  # those of 5 bits must not be linked
            other[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(np.concatenate([base, other]).view(np.int64))
    links = {frozenset((r.a, r.b)) for r in simhash_groups.link_fingerprints(spark.createDataFrame([(int(x),) for x in f], "f long"), segments=parts).collect()}
    want = {frozenset((int(a), int(b))) for i, (a, b) in enumerate(zip(base.view(np.int64), other.view(np.int64))) if 0 < i % 6 < 5}
    assert links == want


def test_great_buckets_give_forests():
    """A bucket of many links gives fewer edges than rows, and they connect what the links connect."""
    rng = np.random.default_rng(6)
    f = np.unique((rng.integers(0, 2, (400, 6)) << np.arange(0, 60, 10)).sum(axis=1).astype(np.uint64) | rng.integers(0, 8, 400).astype(np.uint64) << np.uint64(61))
    side = np.full(len(f), 2, np.int8)
    one, two = simhash_groups._forest(f, np.zeros(len(f), np.int8), side, 1)
    assert len(one) < len(f)
    assert all((int(a) ^ int(b)).bit_count() <= 1 for a, b in zip(one, two))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 1
    label = np.arange(len(f))
    for _ in range(len(f)):
        label = np.array([label[near[i]].min() for i in range(len(f))])
    assert len(f) - len(one) == len(np.unique(label))


def plain_divergence(rows, least=10, top=10):
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        total = sum((count[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, whole = {s: share(count[lang, s]) for s in sources}, share(total)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            marks = sorted((-gap(p[s][t], whole[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > whole[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, rows_ in (("pair", pairs), ("term", marks)) for r, (v, i) in enumerate(rows_)]
    return out


def test_divergence_as_plain_counts(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["tea", "Tea", "bread", "mill", "öl", "ÖL", "straße", "fox", "dog", "日本", "a1b"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 12), p=rng.dirichlet(np.ones(len(vocabulary))))), ["en", "de", None, ""][i % 4], ["a", "b", None, "ü", "c"][i % 5]) for i in range(400)]
    rows += [(None, "en", "a"), (None, None, None), ("", "fr", "only"), ("few words", "it", "x"), ("few words", "it", "y"), ("tea " * 50_000, "en", "b"), *[("tea bread", "en", "a")] * 300]
    docs = spark.createDataFrame([(i, t, lang, s, "clash", "clash") for i, (t, lang, s) in enumerate(rows)], DOC)
    assert Counter(tuple(r) for r in source_divergence.divergence(docs).collect()) == Counter(plain_divergence(rows))
    assert source_divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_of_all_documents(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert Counter(tuple(r) for r in source_divergence.op13_source_divergence(spark, sf).collect()) == Counter(c.execute(source_divergence.ORACLE_SQL).fetchall())
