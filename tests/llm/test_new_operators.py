"""Operators 11 to 13 against brute force, and on nulls, empty texts, ties, repeats, long texts and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskloom.llm import fim, simhash, spelling
from maskloom.llm.common import bounded_groups, table
from maskloom.llm.queries import FIM_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, word string, key string, fp long, form string, root string"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 12))) for _ in range(300)]
    prose = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(6)]
    long = [rng.choice(vocab) for _ in range(1500)]
    near = [" ".join(["changed" if rng.random() < 0.001 else w for w in long]) for _ in range(40)]
    texts = [None, "", " \n\t", "\n", "\n\n a", "one", "One two", "one  TWO", "a\nb\nc", "a\nb\nc\n", "é\r\n中文\n😀 x", "x <P> y\nz\n",
             "Straßenbahn ÀÉÎõüß×÷ÿ Āa", "q" * 3000 + " " + "q" * 2999, "ab\n" * 5000 + "end", *prose, *prose[:2], *near]
    given = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(120).collect()]
    rows = [(i, t, 1, "w", "k", 2, "f", "r") for i, t in enumerate(texts + given)]
    rows += [(5, "one", 1, "w", "k", 2, "f", "r"), (None, "a null id\nhas lines\n", 1, "w", "k", 2, "f", "r")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 11

def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_variants(rows, min_chars=7, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_chars and c >= 2}
    form, n_near = {}, {}
    for w in n:
        around = [v for v in n if near(w, v)]
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], n_near[w], n.get(form[w])))
    return out


def test_variants_equal_brute_force(spark, docs, empty):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 11))) for _ in range(25)]
    lines = []
    for k in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(stems[:rng.randint(1, 25)])
            if rng.random() < 0.08:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "é" + w[i + 1:], w.upper()])
            words.append(w)
        lines.append((1000 + k, " ".join(words), 1, "w", "k", 2, "f", "r"))
    chain = " ".join(["kkklmnopq"] * 400 + ["kkklmnopp"] * 30 + ["kkklmnoop"] * 2)  # the last is near the second only
    lines += [(2000 + k, chain, 1, "w", "k", 2, "f", "r") for k in range(2)]
    both = docs.unionByName(spark.createDataFrame(lines, SCHEMA))
    got = [tuple(r) for r in spelling.variants(both).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(listed(both))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)
    assert spelling.variants(empty).collect() == []


def test_large_groups_are_parted(spark):
    rng = random.Random(5)
    same = {"abcdef" + "".join(rng.choice("abcdefghijklé") for _ in range(rng.randint(5, 6))) for _ in range(16_000)}
    words = sorted(same | {"z" * 900 + "".join(p) for p in itertools.product("abcd", repeat=3)})
    counts = {w: 2 + zlib.crc32(w.encode()) % 5 for w in words}
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(
        spark.createDataFrame(list(counts.items()), "word string, n long"), cells=20_000).collect()}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    around = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            around[w] |= group
    known = set(words)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in known:
                around[w].add(short)
                around[short].add(w)
    want = {}
    for w in words:
        near_w = around[w] - {w}
        if near_w:
            best = min(near_w, key=lambda v: (-counts[v], v))
            want[w] = (len(near_w), best, counts[best])
    assert len(want) > 1000 and got == want


def test_long_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w19"}


def test_bounded_groups():
    import pyarrow as pa
    rng = random.Random(1)
    keys = sorted(rng.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 8, 8, 8, 8, 9]) for _ in range(300))
    for limit, size in itertools.product((1, 5, 20, 40, 1000), (1, 3, 7, 100, 1000)):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i:i + size], "at": list(range(i, min(i + size, 300)))})
                   for i in range(0, 300, size)]
        seen, whole, over = [], [], set()
        for far, t in bounded_groups(iter(batches), "key", limit):
            seen += t.column("at").to_pylist()
            if far:
                over |= set(t.column("key").to_pylist())
            else:
                whole += [set(t.column("key").to_pylist())]
        n = Counter(keys)
        assert sorted(seen) == list(range(300)) and over == {k for k in n if n[k] > limit}
        assert sum(map(len, whole)) == len(set(keys) - over)  # no group is cut


# ---------------------------------------------------------------- 12

def brute_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in fim.SENTINELS):
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def order(rows):
    return sorted(rows, key=repr)


def test_fill_in_middle(spark, docs, empty):
    out = fim.transform(docs, ["doc_id"]).withColumn("restored", fim.restored())
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert order(got) == order([brute_fim(*r) for r in listed(docs)])
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.transform(empty, ["doc_id"]).collect() == []
    assert {r["form"] for r in fim.transform(docs, ["doc_id"], rate=0).collect()} == {"plain"}


def test_fill_in_middle_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*r[:5], sha(r[5]), sha(r[6])) for r in (brute_fim(*r) for r in listed(docs))]
    assert order(con.sql(FIM_SQL).fetchall()) == order(want)


def test_cuts_in_fenwick_trees():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé😀\n b") for _ in range(rng.choice([0, 1, 5, 900, 5000, 40_000]))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for unit, units in (("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)), ("char", list)):
        trees = fim.BlockTrees(data, offsets, unit)
        assert trees.total_units.tolist() == [len(units(t)) for t in texts]
        assert trees.total_points.tolist() == [len(t) for t in texts]
        for _ in range(40):
            doc = np.arange(30)
            k = np.array([rng.randint(0, n) for n in trees.total_units.tolist()])
            place, before = trees.cut(doc, k)
            for i, t in enumerate(texts):
                head = "".join(units(t)[:k[i]])
                assert (place[i] - offsets[i], before[i]) == (len(head.encode()), len(head))


# ---------------------------------------------------------------- 13

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(prints))]
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(spark, docs, empty):
    rows = listed(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (d, _), c in zip(rows, label):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = [(d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, label)]
    for group in (simhash.GROUP, 1):
        got = [tuple(r) for r in simhash.near_duplicates(docs, group=group).collect()]
        assert order(got) == order(want)
    assert len(set(w[2] for w in want)) < len({p for p in prints})  # some links are between different fingerprints
    assert simhash.near_duplicates(empty).collect() == []


def test_golay_decodes_every_word_within_three():
    golay = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 20_000)
    index = golay.index(words)
    code = words ^ golay.error[golay.low[words & 0xFFF] ^ golay.high[words >> 12]]
    assert (np.bitwise_count(code ^ words) <= 3).all() and (golay.index(code) == index).all()
    assert {simhash._rest(int(c)) for c in code[:2000]} == {0}
    far = code ^ ((1 << rng.integers(0, 23, len(code))) | (1 << rng.integers(0, 23, len(code))))
    assert (golay.index(far) == index).all()


def test_every_pair_within_two_bits_shares_a_key():
    golay = simhash.Golay()
    rng = np.random.default_rng(2)
    for a, b in itertools.product(range(64), repeat=2):
        x = rng.integers(0, 1 << 64, 1, dtype=np.uint64)
        y = x ^ np.uint64((1 << a) | (1 << b))
        assert set(simhash.golay_keys(x, golay)[0].tolist()) & set(simhash.golay_keys(y, golay)[0].tolist())


def test_links_of_dense_fingerprints(spark):
    """Many fingerprints under one key: pairs in a task and shared words in Spark give the same components."""
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
                    | {rng.getrandbits(64) for _ in range(50)})
    label = brute_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    from maskloom.llm.components import components
    for group in (simhash.GROUP, 3):
        found = {r["u"]: r["v"] for r in components(simhash.links(df, group)).collect()}
        ours = [found.get(p, p) for p in signed]
        pairs = {(a, b) for a, b in zip(ours, label)}
        assert len(pairs) == len(set(ours)) == len(set(label)) < len(prints)
