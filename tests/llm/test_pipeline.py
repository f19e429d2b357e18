"""Every stage of the pipeline against brute force, on given documents with nulls, repeats, copies, passages and secrets."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.llm.common import save, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
RULE = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A folder of tables: given rows, edge rows, near copies, benchmark passages with changed words, secrets; clashing columns."""
    rng = random.Random(8)
    root = str(tmp_path_factory.mktemp("pipeline"))
    given = table(spark, SF, "documents")
    rows = [tuple(r) for r in given.collect()]
    items = [r["text"] for r in table(spark, SF, "benchmark").orderBy("item_id").collect()]
    vocab = sorted({w for r in rows for w in words(r[1]) if len(w) > 3})
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    extra, planted = [], set()
    base = prose(400)
    for k in range(6):
        copy = list(base)
        copy[20 * k] = f"changed{k}"
        extra.append((5000 + k, " ".join(copy)))
    for k, item in enumerate(items[:8]):
        passage = words(item)[:13 + k]
        if len(passage) >= 13:
            passage[6] = "swapped"
            extra.append((6000 + k, " ".join(prose(90) + passage + prose(90))))
            planted.add(6000 + k)
    extra += [(7000, " ".join(prose(120)) + " password='abc+/def.GHI=123'"), (7001, " ".join(prose(7000))), (7002, None), (7003, ""), (7004, " \n "),
              (None, " ".join(prose(150))), (7005, " ".join(["again"] * 300)), (5000, " ".join(base))]
    extra += [extra[-1], (7006, "short one")]
    rows += [(i, t, "xx", "hot", None if t is None else len(t)) for i, t in extra]
    kinds = ", ".join(f"{n} {t}" for n, t in given.dtypes)
    docs = spark.createDataFrame(rows, kinds)
    clash = {"node": F.lit("n"), "root": F.col("doc_id"), "kept": F.lit(True), "item_id": F.lit(1), "_row": F.lit("r"), "n_words": F.lit(2)}
    docs.withColumns(clash).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = table(spark, SF, "labels")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").select(
        *[F.col(c).cast(t) for c, t in labels.dtypes])).write.parquet(f"{root}/labels.parquet")
    bench = table(spark, SF, "benchmark")
    bench.unionByName(spark.createDataFrame([(None, "a null id has words too"), (900, None), (901, " ")], "item_id long, text string").select(
        *[F.col(c).cast(t) for c, t in bench.dtypes])).write.parquet(f"{root}/benchmark.parquet")
    return root, planted


@pytest.fixture(scope="module")
def stages(spark, data):
    import corpus_pipeline as pipeline
    docs = table(spark, data[0], "documents")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, data[0]), f"test-{name}")
        out.append(docs)
    for before, after in zip(out, out[1:4]):
        assert after.dtypes == before.dtypes
    return out


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def gone(before, after):
    left = collections.Counter(listed(before))
    left.subtract(collections.Counter(listed(after)))
    assert min(left.values()) >= 0
    return [k for k, n in left.items() for _ in range(n)]


def base_failed(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            inside.update((i, i + 1, i + 2))
    return len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_rules_reject_bad_documents_alone(spark, data, stages):
    out = gone(stages[0], stages[1])
    kept = listed(stages[1])
    assert not [i for i, t in kept if base_failed(t)] and any(base_failed(t) for _, t in out)
    good = {r["doc_id"] for r in table(spark, data[0], "labels").where("quality = 1").collect()}
    assert len([i for i, t in out if i in good and not base_failed(t)]) <= 0.06 * len(good)


def test_one_document_of_each_group_stays(stages):
    rows = listed(stages[1])
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][1] == rows[j][1]
            or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    while True:
        old = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            break
    groups = collections.defaultdict(list)
    for k, row in zip(label, rows):
        groups[k].append(row)
    kept = listed(stages[2])
    assert len(kept) == len(groups) < len(rows)
    for members in groups.values():
        least = min((i for i, _ in members if i is not None), default=None)
        assert len([k for k in kept if k in members]) == 1 and any(k in members and k[0] == least for k in kept)


def test_documents_with_benchmark_passages_go(spark, data, stages):
    items = [words(r["text"]) for r in table(spark, data[0], "benchmark").where("item_id is not null").collect()]
    grams = {tuple(w[i:i + 3]) for w in items for i in range(len(w) - 2)}
    out = {i for i, _ in gone(stages[2], stages[3])}
    clean = {i for i, t in listed(stages[2]) if not any(tuple(w) in grams for w in zip(words(t), words(t)[1:], words(t)[2:]))}
    assert not out & clean  # who shares no three words with an item stays
    assert data[1] & {i for i, _ in listed(stages[2])} <= out
    whole = [" ".join(w) for w in items if len(w) >= 13]
    assert not [i for i, t in listed(stages[3]) if any(f" {w} " in f" {' '.join(words(t))} " for w in whole)]


def test_secrets_are_replaced_and_documents_stay(stages):
    before, after = dict(listed(stages[3])), dict(listed(stages[4]))
    assert sorted(before, key=repr) == sorted(after, key=repr)
    for i, t in before.items():
        secret = [m for m in RULE.finditer(t) if len(m[2]) >= 12]
        if secret:
            assert "[SECRET]" in after[i] and not any(m[2] in after[i] for m in secret)
        elif "[SECRET]" not in after[i]:
            assert after[i] == t
    assert any("[SECRET]" in t for t in after.values())
    assert sum(a != before[i] and not RULE.search(before[i]) and not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", before[i])
               for i, a in after.items()) <= 0.02 * len(before)


def test_sequences_hold_every_token_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in listed(stages[4]):
        want[i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in stages[5].collect():
        ids = [int.from_bytes(r["ids"][k:k + 4], "little") for k in range(0, len(r["ids"]), 4)]
        assert len(ids) == r["length"] <= 1024
        pieces[r["doc_id"]].append((r["start"], r["piece"], ids))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    got = collections.Counter((i, tuple(x for _, _, ids in sorted(p) for x in ids)) for i, p in pieces.items())
    assert got == want
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_an_empty_table_passes_every_stage(spark, data):
    import corpus_pipeline as pipeline
    docs = table(spark, data[0], "documents").where("1 = 0")
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, data[0]), f"test-empty-{name}")
        assert docs.count() == 0
