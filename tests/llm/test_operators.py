"""The training-data operators against brute force, round trips and the cases that break kernels."""

import base64
import collections
import hashlib
import os
import random
import re
import tempfile
import textwrap
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import chat_format, collection_bwt, decontamination, license_scan, ngram_join, quality_classifier, quality_rules, repeat_removal, source_mix, token_counts, warc, windows
from loomstone.llm.textkernel import exact_ids, text_bytes
from loomstone.llm.textstats import count_texts

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix à potion of strong green tea and bread near an old mill"


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def odd_rows():
    """Null, empty, blank, very long, repeated and near-equal texts; null in every column."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4),
        (6, long, "en", None, 1), (7, long + " tail", "en", "a", 1), (8, "one two", "fr", "b", 1), (9, BASE + " and then some more words follow here", "en", "a", 1),
        (None, BASE, "en", "a", 1), (10, "É" * 200, "fr", "c", 200), (11, "x" * 49, "en", "a", 49), (12, "aaaa " * 300, "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOC).withColumn("spans", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("n_words", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def same_as_sql(df, sql, sf):
    found = duck(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


# 1


def test_chats_same_as_sql(spark, sf):
    same_as_sql(chat_format.op1_chat_format(spark, sf), chat_format.ORACLE_SQL, sf)


def test_chats_round_trip(spark):
    texts = ["", None, "\\", "###", "####", "# ## ### a</turn>b", "</turn>", "\\</turn>", "a: b", "é\n" * 50, "\\### Assistant: </turn> ok", "</turn", "##\\#", "x" * 200_000]
    roles = ["user", "assistant", "system", None, "", "a: b", "User", "@x", "#: \\", "ro</turn>le"]
    rows = [(c, t, random.Random((c or 0) * 31 + t).choice(roles), x) for c in (1, None, 5) for t, x in enumerate(texts)] + [(7, None, "user", "a"), (7, None, "user", "a"), (7, 0, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat_format.format_chats(turns)
    got = collections.defaultdict(list)
    for r in made.orderBy("conv_id", "piece").collect():
        back = list(chat_format.read_turns(r["formatted"]))
        got[r["conv_id"]] += back
        said = [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert said == [t for role, t in back if role == "assistant"] and r["n_turns"] == len(back)
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert got == want
    assert chat_format.digest_chats(made).count() == 4
    assert chat_format.digest_chats(chat_format.format_chats(turns.limit(0))).count() == 0


# 2


def covered(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for w in {b[i : i + width] for i in range(len(b) - width + 1)}:
                first[w] = min(d, first.get(w, d))
    for d, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1) if d is not None else ():
            if first[b[i : i + width]] < d:
                hit[i : i + width] = b"\1" * width
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        yield d, len(b), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(kept).hexdigest()


def digest(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return sorted(map(tuple, df.select("doc_id", "n_bytes", removed.alias("r"), F.size("spans").cast("long"), F.sha2("kept", 256)).collect()), key=repr)


def test_transform_of_small_collections():
    rng = random.Random(3)
    for _ in range(60):
        sigma = rng.choice([2, 3, 26, 200])
        seqs = [bytes(rng.randint(1, sigma) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        seqs += seqs[:2]
        c = collection_bwt.CollectionBWT(np.frombuffer(b"".join(seqs), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
        suffixes = sorted(((s[j:] + b"\0", i, j) for i, s in enumerate(seqs) for j in range(len(s) + 1)), key=lambda x: x[:2])
        assert c.read("bwt").tolist() == [seqs[i][j - 1] if j else 0 for _, i, j in suffixes]
        shared = [0] + [len(os.path.commonprefix([a[0][:-1], b[0][:-1]])) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert c.read("lcp").tolist() == shared
        where = {(i, len(seqs[i]) - j): k for k, (_, i, j) in enumerate(suffixes)}
        assert all(where[w, n] == p for n, who, place in c.places(20) for w, p in zip(who.tolist(), place.tolist(), strict=True))
        c.close()


def test_segments_hold_every_window_once():
    texts = pa.array(["abc" * 60, "", None, "x" * 49, "y" * 50, BASE * 3])
    data, at = text_bytes(texts)
    of, start, count, _, _ = windows.segments(data, at, 50)
    found = sorted((int(d), int(s) + k) for d, s, c in zip(of, start, count, strict=True) for k in range(c))
    assert found == sorted((i, at[i] + k) for i in range(6) for k in range(at[i + 1] - at[i] - 49))


def test_minimisers_are_the_leftmost_least():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) for _ in range(20)] + ["a" * 300, "ab" * 100]
    data, at = text_bytes(pa.array(texts))
    *found, gram = windows.segments(data, at, 50)
    size = 50 - windows.GRAM + 1
    for of, start, count, value, place in zip(*found, windows.minimiser_places(gram, *found[1:]), strict=True):
        for w in range(start, start + count):
            assert at[of] <= w and w + 50 <= at[of + 1] and (gram[w : w + size].min(), w + gram[w : w + size].argmin()) == (value, place)


def test_repeats_as_brute_force(real, docs):
    got = digest(repeat_removal.remove_repeats(real))
    assert got == sorted(covered([tuple(r) for r in real.select("doc_id", "text").collect()]), key=repr)
    assert digest(repeat_removal.remove_repeats(docs, keep=("lang",))) == sorted(covered([r[:2] for r in odd_rows()]), key=repr)


def test_repeats_of_hot_strings(spark, real):
    """Every shared minimiser is hot: the result is the same."""
    line = "this very line of more than fifty bytes is in each of all the documents here"
    rng = random.Random(8)
    rows = [(d, f"{rng.random()} {rng.random()} {line} {rng.random()}\n{line[:55]}{rng.random()}", "", "", 0) for d in range(60)]
    df = spark.createDataFrame(rows, DOC)
    made = repeat_removal.repeated_spans(df, hot_segments=1)
    want = {d: n for d, _, n, _, _ in covered([r[:2] for r in rows])}
    found = {r["doc_id"]: int(np.diff(np.frombuffer(r["spans"], np.int64).reshape(-1, 2)).sum()) for r in made.collect()}
    assert found == {d: n for d, n in want.items() if n}
    shared = {r["doc_id"]: int(np.diff(np.frombuffer(r["spans"], np.int64).reshape(-1, 2)).sum()) for r in repeat_removal.repeated_spans(real, hot_segments=1).collect()}
    assert shared == {d: n for d, _, n, _, _ in covered([tuple(r) for r in real.select("doc_id", "text").collect()]) if n}


@pytest.mark.parametrize(("sigma", "part"), [(2, 4 << 20), (4, 3000), (4, 200), (256, 5000)])
def test_windows_of_segments_as_brute_force(sigma, part):
    rng = random.Random(sigma)
    texts = [bytes(rng.randrange(256 - sigma, 256) for _ in range(rng.randint(50, 300))) for _ in range(20)]
    texts += [t[: len(t) // 2] + b"-" + t[len(t) // 2 :] for t in texts] + texts[:3]
    doc = np.array(rng.sample(range(100), len(texts)))
    data, at = text_bytes(pa.array(texts, pa.binary()))
    of, start, count, value, gram = windows.segments(data, at, 50)
    place = windows.minimiser_places(gram, start, count, value)
    least = {}
    for t, d in zip(texts, doc, strict=True):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], 1000))
    got = repeat_removal.window_docs(repeat_removal.gather(data, start, count + 49), count + 49, place - start, doc[of], 50, part)
    assert got.tolist() == [least[data[s + k : s + k + 50].tobytes()] for s, c in zip(start, count, strict=True) for k in range(c)]


def test_kept_columns_with_names_of_made_ones(docs, spark):
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    clash = docs.withColumn("score", F.lit(1))
    for call in (lambda: repeat_removal.remove_repeats(docs, keep=("spans",)), lambda: decontamination.find_leaks(docs, items, keep=("N_words",)), lambda: quality_classifier.score_quality(clash, labels, keep=("score",)), lambda: source_mix.mix_sources(docs, carry=("size",))):
        with pytest.raises(ValueError, match="rename"):
            call()


def mirrored(n):
    """A Thue-Morse text and its complement: equal under any hash that sums byte values times powers of an odd base modulo 2**64."""
    a = "A"
    while len(a) < n:
        a += a.translate(str.maketrans("AB", "BA"))
    return a, a.translate(str.maketrans("AB", "BA"))


def test_hashes_of_mirrored_texts(spark):
    a, b = mirrored(1024)
    (dup,) = count_texts(pa.array([f"{a}\n{b}"]))["n_dup_lines"]
    (rep,) = count_texts(pa.array([f"{a} p q z {b} p q"]))["n_repeat_words"]
    assert (dup, rep) == (0, 0)
    rows = [(i, t, "", "", 0) for i, t in enumerate([f"{a} x y z q", f"{b} x y z q", f"{BASE} {a} {BASE}"])]
    df = spark.createDataFrame(rows, DOC)
    assert {r["n_links"] for r in ngram_join.ngram_join(df).collect()} == {0} and ngram_join.one_of_each(df).count() == 3
    items = [(5, f"{BASE} {b} {BASE}")]
    got = decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()) == sorted(leaks([r[:2] for r in rows], items))
    assert digest(repeat_removal.remove_repeats(df)) == sorted(covered([r[:2] for r in rows]), key=repr)


def test_equal_spans_under_one_hash():
    data = np.frombuffer(b"abcabcxyzabcxyzab" + b"q" * 600, np.uint8)
    start, end = np.array([0, 3, 6, 9, 12, 15, 20, 300]), np.array([3, 6, 9, 12, 15, 17, 280, 560])
    for key in (None, np.zeros(8, np.uint64)):
        ids, first = exact_ids(data, start, end, key)
        assert [data[start[f] : end[f]].tobytes() for f in first[ids]] == [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]
        assert len(first) == 4 and first.tolist() == [min(np.flatnonzero(ids == k)) for k in range(4)]


def test_repeats_whole_characters(spark, none):
    rows = spark.createDataFrame([(1, "é" * 60, "", "", 0), (2, "x" + "é" * 60 + "y", "", "", 0)], DOC)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in repeat_removal.remove_repeats(rows, whole_characters=True).collect()}
    assert kept == {1: "é" * 60, 2: "xy"}
    assert repeat_removal.remove_repeats(none).count() == 0


# 3


def test_licenses_same_as_sql(spark, sf):
    same_as_sql(license_scan.op3_license_scan(spark, sf), license_scan.ORACLE_SQL, sf)


def test_licenses(spark, none):
    mit = license_scan.TEMPLATES["mit-text"]
    rows = [(1, mit, "", "", 0), (2, f"intro words\n\n{mit}\n\nend of it", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (5, "Released under the MIT License.\n" * 3, "", "", 0), (6, "licensed", "", "", 0), (7, (mit + " ") * 5, "", "", 0), (None, mit, "", "", 0)]
    df = license_scan.document_licenses(spark.createDataFrame(rows, DOC).withColumn("license", F.lit("clash")))
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in df.collect()}
    assert got[1][0] == got[2][0] == got[7][0] == "mit-text" and got[5] == ("mit-notice", 4)
    assert got[3] == got[4] == got[6] == got[None] == (None, 0)
    assert license_scan.document_licenses(none).count() == 0


def wrapped(text, width=70, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licenses_within_long_documents(spark):
    prose = " ".join(f"w{i}x of the v{i % 7}" for i in range(400))
    t = license_scan.TEMPLATES
    cut = t["mit-text"].index("The above copyright"), t["mit-text"].index("THE SOFTWARE IS")
    mit = "\n\n".join(wrapped(p) for p in (t["mit-text"][: cut[0]], t["mit-text"][cut[0] : cut[1]], t["mit-text"][cut[1] :]))
    bsd = t["bsd-3-text"].replace("met: 1.", "met:\n\n1.").replace(" 2. Redis", "\n\n2. Redis").replace(" 3. Neither", "\n\n3. Neither").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    bsd = "\n\n".join(wrapped(p) for p in bsd.split("\n\n"))
    apache, gpl = wrapped(t["apache-2-header"], mark=" * "), wrapped(t["gpl-3-header"], mark="# ")
    texts = [f"{prose}\n\n{mit}\n\n{prose}", f"{prose}\n{bsd}\n{prose}", f"{apache}\nimport os\n{prose}", f"{gpl}\n{prose}", f"{prose} {t['gpl-2-notice']} {prose}", prose, f"{prose}\n\n{mit}\n\n{prose}\n\n{mit}"]
    df = spark.createDataFrame([(i, x, "", "", 0) for i, x in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in license_scan.document_licenses(df).collect()}
    for i, name in enumerate(["mit-text", "bsd-3-text", "apache-2-header", "gpl-3-header", "gpl-2-notice", None, "mit-text"]):
        assert name in got[i]["licenses"].split(",") if name else got[i]["license"] is None, (i, got[i])
    assert got[0]["dice"] == 1 and got[0]["n_units"] == 1 and got[6]["n_units"] == 2


def test_license_notices_among_other_words(spark):
    known = {
        "(c) 2021 All rights reserved": "all-rights-reserved", "Copyright 2020 Acme. All rights reserved.": "all-rights-reserved", "This page is licensed under CC BY 4.0.": "cc-by-4-notice",
        "This project is released under the MIT License.": "mit-notice", "Licensed under the MIT License.": "mit-notice", "// SPDX-License-Identifier: GPL-3.0-only\nint x;": "gpl-3-spdx",
        "# SPDX-License-Identifier: Apache-2.0": "apache-2-spdx", "/* SPDX-License-Identifier: MIT */ some code follows": "mit-spdx", "nothing of that kind here": None,
    }
    df = spark.createDataFrame([(i, x, "", "", 0) for i, x in enumerate(known)], DOC)
    got = {r["doc_id"]: r for r in license_scan.document_licenses(df).collect()}
    assert all(name in got[i]["licenses"].split(",") if name else got[i]["license"] is None for i, name in enumerate(known.values())), got


def plain_windows(words, template, threshold):
    """The rule of windows, with every window's bigrams counted anew."""
    pairs, theirs = [f"{a} {b}" for a, b in zip(words, words[1:])], set(license_scan.template_bigrams(template))
    n, m = len(pairs), len(theirs)
    need, span = license_scan.bounds(m, threshold).start, int((len(license_scan.template_words(template)) - 1) * (2 - threshold) / threshold + 1e-9)
    at = [i for i in range(n) if pairs[i] in theirs]

    def best(s, end):
        found = [(-2 * len(set(pairs[s : e + 1]) & theirs) / (len(set(pairs[s : e + 1])) + m), e - s, s, e) for e in at if s <= e < min(end, s + span)]
        return min(found, default=(0, 0, s, s))

    starts = [s for k, s in enumerate(at) if k + need <= len(at) and at[k + need - 1] - s < span]
    starts = [s for s in starts if s == 0 or pairs[s - 1] not in theirs or pairs[s - 1] in pairs[s : s + span] or pairs[s] in pairs[max(0, s - span + 1) : s]]
    bests = [w for w in (best(s, n) for s in starts) if -w[0] >= threshold]
    out, last = [], -2
    while True:
        left = [w for w in bests if w[2] > last + 1]
        if not left:
            return sorted((s, round(-less, 9)) for less, _, s, _ in out)
        now, (_, _, first, block) = left[0], left[0]
        for w in left[1:]:
            if w[2] > min(block, now[3] + 1):
                break
            now = min(now, w, key=lambda x: (x[0], x[1]))
        gap = min((best(w[2], now[2] - 1) for w in bests if first <= w[2] and w[2] + need < now[2]), default=(0,)) if now[2] - first > need else (0,)
        out += [now] + [gap] * (-gap[0] >= threshold)
        last = now[3]


def test_license_windows_as_brute_force(spark):
    rng, rows, texts = random.Random(11), [], {f"t{k}": "" for k in range(4)}
    for k, n in enumerate((3, 9, 14, 30)):
        texts[f"t{k}"] = " ".join(rng.choice("abcdefgh" if k < 3 else "abcdefghijklmnopqrstuvwxyz") + str(k) for _ in range(n))
    for _ in range(160):
        words = []
        for _ in range(rng.randrange(1, 6)):
            t = texts[f"t{rng.randrange(4)}"].split()
            i, j = sorted((rng.randrange(len(t)), rng.randrange(len(t) + 1))) if rng.random() < 0.5 else (0, len(t))
            words += [w if rng.random() > 0.06 else "x" for w in t[i:j]] + ["y"] * rng.choice([0, 0, 1, 3]) + [f"z{rng.randrange(90)}" for _ in range(rng.choice([0, 0, 2, 9]))]
        words = ["q0", "q1", "q2", *words, "q3", "q4", "q5", "q6"]
        rows.append(words)
    df = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in enumerate(rows)], DOC)
    found = collections.defaultdict(list)
    whole = set()
    for r in license_scan.scan_licenses(df, texts, 0.85).collect():
        found[r["doc_id"], r["license"]].append((r["place"], round(r["dice"], 9)))
        whole |= {(r["doc_id"], r["license"])} if r["kind"] != "window" else set()
    want = {(i, k): got for i, w in enumerate(rows) for k, t in texts.items() if (i, k) not in whole and (got := plain_windows(w, t, 0.85))}
    assert {k: sorted(v) for k, v in found.items() if k not in whole} == want and len(want) > 60


def test_many_licenses_in_one_document(spark):
    """A hundred texts one after the other, each found, in time that grows with the text."""
    mit = license_scan.TEMPLATES["mit-text"]
    df = spark.createDataFrame([(1, f"begin {mit} " + " ".join(f"x{i} y{i} z{i} {mit}" for i in range(99)), "", "", 0)], DOC)
    assert [r["place"] for r in license_scan.scan_licenses(df.withColumn("text", F.lit("warm up " + mit))).collect()] != []
    begin = time.time()
    found = [r for r in license_scan.scan_licenses(df).collect() if r["license"] == "mit-text"]
    assert len(found) == 100 and all(r["dice"] == 1 for r in found)
    assert time.time() - begin < 30


def test_full_licenses(spark):
    t = license_scan.TEMPLATES
    full = [k for k in t if k.endswith("-full")]
    assert len(full) == 7
    rows = [(i, t[k], "", "", 0) for i, k in enumerate(full)] + [(10, "our own words first\n" + t["apache-2.0-full"] + "\nand at last some more of them " + " ".join(f"w{i}" for i in range(900)), "", "", 0)]
    got = {r["doc_id"]: r for r in license_scan.document_licenses(spark.createDataFrame(rows, DOC)).collect()}
    assert [got[i]["license"] for i in range(7)] == full and all(got[i]["dice"] == 1 for i in range(7))
    assert got[10]["license"] == "apache-2.0-full"


@pytest.mark.parametrize("m", [1, 5, 40, 200])
def test_license_bounds_are_exact(m):
    inside = license_scan.bounds(m, 0.85)
    assert [n for n in range(1, 2 * m + 2) if 2 * min(m, n) / (m + n) >= 0.85 - 1e-12] == list(inside)


# 4


def leaks(rows, items, width=10):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for j in range(len(w) - k + 1) if w else ():
            wins[tuple(w[j : j + k])].add(i)
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if found := wins.get(tuple(w[j : j + k])):
                    got |= found
                    hit.update(range(j, j + k))
        yield d, len(w), len(hit), sorted(got)


@pytest.mark.parametrize("block", [32 << 20, 500])
def test_leaks_as_brute_force(spark, sf, real, docs, block):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "ONE two"), (901, None), (902, ""), (903, BASE), (903, BASE), (None, BASE), (904, "É" * 200)], "item_id long, text string")
    every = items.unionByName(extra)
    known = [tuple(r) for r in every.where("item_id is not null").collect()]
    for df, keep in ((real, ()), (docs, ("source", "n_words"))):
        got = decontamination.find_leaks(df, every, keep=() if "n_words" in keep else keep, block_bytes=block)
        rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()), key=repr)
        assert rows == sorted(leaks([tuple(r) for r in df.select("doc_id", "text").collect()], known), key=repr)


def test_leaks_without_items(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, items).where("n_hit > 0").count() == 0
    assert decontamination.find_leaks(none, items).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(50):
        parts = [rng.integers(0, 3, rng.integers(1, 12)) for _ in range(4)]
        ids = np.concatenate(parts)
        end = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        assert decontamination.suffix_array(ids, end).tolist() == sorted(range(len(ids)), key=lambda i: (ids[i : end[i]].tolist(), i))


def test_longest_match_is_one(spark):
    docs = spark.createDataFrame([(1, "x y " + BASE + " z", "", "", 0)], DOC)
    (m,) = decontamination.find_leaks(docs, spark.createDataFrame([(5, "q " + BASE)], "item_id long, text string")).first()["matches"]
    assert tuple(m) == (5, 1, 2, len(words(BASE)))


# 5


def test_classifier_on_held_out_rows(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    got = quality_classifier.op5_quality_classifier(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 80 and right > 0.97


def test_classifier_never_reads_held_out_labels(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_classifier.score_quality(docs, x).collect()), key=repr) for x in (labels, turned))
    assert a == b and len(a) == len(odd_rows()) and all(0 <= r[2] <= 1 for r in a)
    assert {r[2] for r in quality_classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(none, labels).count() == 0
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


# 6


def base_counts(text):
    text = text or ""
    found = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = collections.Counter(zip(found, found[1:], found[2:], strict=False))
    hit = {i + k for i, t in enumerate(zip(found, found[1:], found[2:], strict=False)) if triples[t] > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts_as_brute_force(real):
    texts = [r[1] for r in odd_rows()] + [r[0] for r in real.select("text").collect()] + ["a\nb\na\n \n \n\u2028a", "\x0bq q q q\x0c", "#*$%&|<>", "é é é é é\r\né"]
    got = count_texts(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [base_counts(t) for t in texts]


def test_rules(spark, sf, docs, none):
    got = quality_rules.op6_quality_rules(spark, sf.replace("sf0.001", "sf0.1"))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/labels.parquet")
    rows = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.05
    odd = quality_rules.apply_rules(docs)
    assert odd.count() == len(odd_rows()) and odd.where("base_failed and kept").count() == 0
    assert quality_rules.apply_rules(none).count() == 0


def test_every_statistic_rejects_alone(spark):
    """Of plain texts some are far off in one statistic only: in a large group and in a small one they go, and the others stay."""
    rng = np.random.default_rng(3)
    words = lambda n, low=3, high=8: ["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(low, high))) for _ in range(n)]
    broken = lambda w, width=9: "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))
    rows = []
    for source, n in (("large", 300), ("small", 20)):
        rows += [(source, "plain", broken(words(rng.integers(110, 190)))) for _ in range(n)]
        short, passage = words(30), words(60)
        rows += [
            (source, "x_words", broken(words(9000))),
            (source, "x_length", broken(words(150, 18, 24))),
            (source, "x_symbols", broken([w if i % 4 else "####$$$$" for i, w in enumerate(words(150))])),
            (source, "x_dup_lines", "\n".join(w for _ in range(6) for w in rng.permutation(short))),
            (source, "x_repeats", broken(passage + words(130) + passage, 7)),
        ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, _, t) in enumerate(rows)], DOC)
    got = collections.defaultdict(list)
    for r in quality_rules.apply_rules(docs).collect():
        source, kind, _ = rows[r["doc_id"]]
        assert not r["base_failed"]
        got[source, kind].append(r["kept"])
    for (_, kind), kept in got.items():
        assert np.mean(kept) > 0.9 if kind == "plain" else kept == [False], (kind, kept)


def plain_mcd(x, h, starts=60):
    """Fast MCD with random starts: the least log determinant of the covariance of h rows, and those rows."""
    rng, best = np.random.default_rng(1), (np.inf, None)
    for _ in range(starts):
        rows = rng.choice(len(x), x.shape[1] + 1, replace=False)
        last = np.inf
        while True:
            cov = np.cov(x[rows].T, bias=True) + 1e-12 * np.eye(x.shape[1])
            d = np.einsum("ni,ij,nj->n", x - x[rows].mean(0), np.linalg.inv(cov), x - x[rows].mean(0))
            rows = np.argsort(d, kind="stable")[:h]
            det = np.linalg.slogdet(np.cov(x[rows].T, bias=True))[1]
            if det >= last - 1e-12:
                break
            last = det
        if last < best[0]:
            best = last, rows
    return best


@pytest.mark.parametrize("edge", [2000, 3])
def test_robust_groups_as_plain_mcd(spark, monkeypatch, edge):
    """Groups with a fifth of the rows far off: the determinant of a plain search, exactly the support share, the rows that lie apart at a distance."""
    monkeypatch.setattr(quality_rules, "EDGE", edge)
    rng, rows, data = np.random.default_rng(7), [], {}
    for g, n in (("a", 240), (None, 150)):
        x = rng.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 0.5]])
        x[: n // 5] += [9, -7, 5]
        data[g] = x
        rows += [(g, *map(float, r)) for r in x]
    rows += [("same", 1.0, 2.0, 3.0)] * 40 + [("one", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    run = lambda: {r["g"]: r for r in quality_rules.robust_groups(df, ["g"], ["x", "y", "z"], least_spread=[1e-3] * 3, few=0).collect()}
    got = run()
    scale = quality_rules._consistency(quality_rules.SUPPORT, 3)
    for g, x in data.items():
        h = quality_rules._support(len(x), quality_rules.SUPPORT)
        det, _ = plain_mcd(x, h)
        model = np.array(got[g]["model"])
        d = (((x - model[:3]) @ model[3:].reshape(3, 3).T) ** 2).sum(1)
        near = np.argsort(d)[:h]
        assert got[g]["log_det"] <= det + 3 * np.log(scale) + 0.02  # of sixty random starts the best may end a little lower
        assert np.allclose(x[near].mean(0), model[:3]) and np.allclose(np.linalg.inv(model[3:].reshape(3, 3)) @ np.linalg.inv(model[3:].reshape(3, 3)).T, scale * np.cov(x[near].T, bias=True))
        assert (d[: len(x) // 5] > 30).all() and (d[len(x) // 5 :] > 16).mean() < 0.05
    assert np.allclose(got["same"]["model"][:3], [1, 2, 3]) and got["one"]["n"] == 1
    assert all(np.allclose(r["model"], got[g]["model"], rtol=1e-9, atol=1e-12) for g, r in run().items())


def test_classifier_as_plain_discriminant(spark, sf):
    """Scores against the discriminant written out with determinants and inverses."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    known = {r[0]: r[1] for r in labels.where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id", "quality").collect() if r[0] in texts}
    x = dict(zip(texts, quality_classifier.features(count_texts(pa.array(list(texts.values()), pa.string()))), strict=True))
    learn = np.stack([x[d] for d in known])
    centre, spread = learn.mean(0), np.sqrt(np.maximum(learn.var(0), 1e-6))
    z = {k: (np.stack([x[d] for d in known if known[d] == k]) - centre) / spread for k in (0, 1)}
    p, n = learn.shape[1], len(learn)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in z.values()) / n
    density = {}
    for k, v in z.items():
        lean = 0.2 + 0.8 * p / (p + len(v))
        cov = (1 - lean) * np.cov(v.T, bias=True) + lean * pooled
        cov = 0.98 * cov + 0.02 * np.eye(p) * np.trace(cov) / p
        diff = (np.stack(list(x.values())) - centre) / spread - v.mean(0)
        density[k] = np.log((len(v) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff)
    odds = density[1] - density[0]
    want = dict(zip(x, 0.5 + 0.5 * odds / (10 + np.abs(odds)), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.op5_quality_classifier(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_classifier_with_odd_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, None), (3, 7), (None, 1), (8, 0), (12, 1)], "doc_id long, quality int")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and quality_rules.chi2_quantile(0.99, 5) == pytest.approx(15.086, abs=1e-3)


# 7


def test_mix_same_as_sql(spark, sf):
    same_as_sql(source_mix.op7_source_mix(spark, sf), source_mix.ORACLE_SQL, sf)


def test_mix(spark, docs, none):
    a = source_mix.mix_sources(docs, carry=("lang",)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, source_mix.mix_sources(docs, carry=("lang",)).collect()))
    assert len(a) == len(odd_rows()) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in a)
    sizes = {r["source"]: r["source_size"] for r in a}
    targets = {r["source"]: r["target"] for r in a}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert source_mix.mix_sources(none).count() == 0


def test_mix_is_native(spark, sf):
    plan = source_mix.op7_source_mix(spark, sf)._jdf.queryExecution().toString() + license_scan.op3_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"Python|InPandas|InArrow", plan)


# 8


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return tokenizers.Tokenizer.from_file(path), open(path, encoding="utf-8").read()


def test_tokens_as_the_library(tokenizer, spark, sf, docs, none):
    lib, definition = tokenizer
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = collections.Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        assert collections.Counter(tuple(r) for r in token_counts.count_tokens(df, definition).select("doc_id", "n_bytes", "n_tokens").collect()) == texts
    assert token_counts.count_tokens(none, definition).count() == 0


def test_tokens_of_strange_texts(tokenizer):
    lib, definition = tokenizer
    counts, rng = token_counts.PieceCounts.load(definition), random.Random(1)
    pool = list(" \n\t\x1c\x85\u3000'streaab1é½") + ["<|endoftext|>", "  ", "'ll", "\u2028", "中", "🙂"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert counts.count(text) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


# 9


def test_archives(spark):
    rows = [(1, "http://a/é\r\nX: y", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 50_000), (6, "http://f", "a\r\n\r\nWARC/1.1"), (7, "http://g", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("records", F.lit("clash"))
    folder = "file://" + tempfile.mkdtemp()
    manifest = warc.write_archives(pages, folder)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    for i, _, h in rows:
        body, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r["payload"] is None if r["refers_to"] else bytes(r["payload"]) == body
    raw = open(manifest.first()["path"].removeprefix("file://"), "rb").read()
    assert int.from_bytes(raw[:4], "little") == 0x184D2A5D and int.from_bytes(raw[8:12], "little") == 0xFD2FB528
    empty = warc.write_archives(pages.limit(0), folder)
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_archives_of_all_pages(spark, sf):
    got = warc.op9_warc(spark, sf)
    sql = """SELECT page_id, strlen(html) AS payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
             FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM pages)"""
    same_as_sql(got.drop("payload_digest"), sql, sf)


# 10


def links(rows):
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for d, t in rows if d is not None}
    out, ids = collections.defaultdict(set), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                out[a].add(b)
                out[b].add(a)
    return {d: len(out[d]) for d in ids}


def test_links_as_brute_force(real):
    got = ngram_join.ngram_join(real)
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == links([tuple(r) for r in real.select("doc_id", "text").collect()])


def test_links_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    rng, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = [(d, " ".join(w if rng.random() > 0.01 else f"v{rng.random()}" for w in base), "", "", 0) for d in range(40)]
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == links([r[:2] for r in rows])


def test_links_of_odd_rows(spark, docs, none):
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    assert set(got) == {r[0] for r in odd_rows()} and got[1]["class_id"] == got[2]["class_id"] == 1 and got[1]["class_size"] == 3
    assert got[6]["group_id"] == got[7]["group_id"] == 6 and got[3]["n_links"] == got[4]["n_links"] == 0 and got[None]["class_id"] is None
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r[0] for r in left.where("doc_id is not null").select("doc_id").collect()) == [1, 3, 4, 5, 6, 8, 9, 10, 11, 12]
    assert ngram_join.ngram_join(none).count() == 0


def test_links_of_rows_that_share_a_doc_id(spark):
    t, q = BASE, " ".join(f"other{i}" for i in range(30))
    rows = [(1, t, "", "", 0), (1, q, "", "", 0), (2, t, "", "", 0), (3, q, "", "", 0), (3, q, "", "", 0), (4, t + " and more", "", "", 0), (5, None, "", "", 0), (5, "", "", "", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r["doc_id"], r["class_id"], r["class_size"], r["n_links"], r["group_id"]) for r in ngram_join.ngram_join(df).collect())
    assert got == [(1, 1, 2, 2, 1), (1, 1, 3, 2, 1), (2, 1, 2, 2, 1), (3, 1, 3, 2, 1), (3, 1, 3, 2, 1), (4, 4, 1, 2, 1), (5, 5, 1, 0, 5), (5, 5, 1, 0, 5)]
    assert sorted((r["doc_id"], r["text"] or "") for r in ngram_join.one_of_each(df).collect()) == [(1, q), (1, t), (5, ""), (5, "")]


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
