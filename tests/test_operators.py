"""Invariants and brute-force checks for splits, memory, windows, metrics and parsing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as TX
from maskloom.operators import memory as MEM
from maskloom.operators import metrics as H
from maskloom.operators import splits as SP
from maskloom.operators import windows as W
from maskloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_splits_partition_rows_and_groups(spark):
    t = FX.turns(spark, SF)
    n = t.count()
    g = SP.group_split(t, 0.3, 1).collect()
    assert len(g) == n
    by_group = {}
    for r in g:
        by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    n_groups = len(by_group)
    assert sum(1 for s in by_group.values() if s == {"val"}) == int(0.3 * n_groups)
    e = SP.random_split(t, 0.25, 3, exact=True)
    assert e.filter("split = 'val'").count() == math.ceil(n * 0.25)


def test_group_kfold_blocks(spark):
    t = FX.turns(spark, SF)
    kf = SP.group_kfold(t, 3).collect()
    n = t.count()
    assert len(kf) == 3 * n
    for fold in range(3):
        rows = [r for r in kf if r["fold"] == fold]
        assert len(rows) == n
    # every row is in the test part of exactly one fold
    tests = {}
    for r in kf:
        if r["split"] == "test":
            tests[r["idx"]] = tests.get(r["idx"], 0) + 1
    assert set(tests.values()) == {1} and len(tests) == n


def test_cycle_chunks_are_disjoint(spark):
    t = FX.turns(spark, SF)
    a = {r["idx"] for r in SP.cycle_chunk(t, 0.25, 0).collect()}
    b = {r["idx"] for r in SP.cycle_chunk(t, 0.25, 1).collect()}
    assert a and b and not (a & b)
    assert len(a) == len(b) == int(t.count() * 0.25)


def test_swap_unselected_fallback_branch(spark):
    split = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (4, "val")], "idx long, split string")
    mem = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 1)],
                                "idx long, selected int, correct int")
    out = {r["idx"]: r["split"] for r in SP.swap_unselected(split, mem).collect()}
    # no unselected training rows: failed val row 3 goes to train, one known-correct train row to val
    assert out[3] == "train" and out[1] == "val" and out[2] == "train" and out[4] == "val"


def test_memory_correct_is_sticky(spark):
    base = spark.createDataFrame([(1, 0, "l", "a b c d e", 5, ["a"], "[M] b c d e")],
                                 "idx long, group_id long, label string, text string, token_num long, "
                                 "mask_words array<string>, masked_sent string")
    mem = MEM.memory_init(base)
    ok = spark.createDataFrame([(1, ["a"], 1)], "idx long, pred_words array<string>, correct int")
    bad = spark.createDataFrame([(1, ["b"], 0)], "idx long, pred_words array<string>, correct int")
    m1 = MEM.memory_update(mem, ok).collect()[0]
    assert m1["correct"] == 1 and m1["selected"] == 1 and list(m1["mask_words"]) == ["a"]
    assert m1["valid_correct"] == 1
    m2 = MEM.memory_update(MEM.memory_update(mem, ok), bad, any_success=False).collect()[0]
    assert m2["correct"] == 1 and list(m2["mask_words"]) == []   # failure resets the mask, keeps the flag


def test_early_stop_spark_matches_driver_rule(spark):
    hist = [(0, 0.1), (1, 0.5), (2, 0.4), (3, 0.6), (4, 0.6), (5, 0.55), (6, 0.2)]
    df = spark.createDataFrame([(1, e, 0.0, 0.0, m) for e, m in hist],
                               "run_id long, epoch long, acc double, f1 double, mcc double")
    for warmup in (0, 1, 3):
        for patience in (1, 2, 3):
            r = W.early_stop(df, "mcc", warmup, patience).first()
            assert (bool(r["early_stopped"]), r["es_epoch"]) == W.early_stop_rows(hist, warmup, patience)


def test_running_quality_matches_window(spark):
    s = FX.scored(spark, SF)
    got = {r["idx"]: r["running_acc"] for r in W.running_quality(s).collect()}
    rows = sorted(s.collect(), key=lambda r: r["idx"])
    acc = {}
    for r in rows:
        h, n = acc.get(r["group_id"], (0, 0))
        h, n = h + (r["label"] == r["pred"]), n + 1
        acc[r["group_id"]] = (h, n)
        assert got[r["idx"]] == pytest.approx(h / n)


def test_mcc_and_f1_brute_force(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("b", "None"), ("a", "a")]
    df = spark.createDataFrame(pairs, "label string, pred string")
    classes = sorted({x for p in pairs for x in p})
    tp = {c: sum(1 for y, p in pairs if y == p == c) for c in classes}
    fp = {c: sum(1 for y, p in pairs if p == c and y != c) for c in classes}
    fn = {c: sum(1 for y, p in pairs if y == c and p != c) for c in classes}
    f1 = sum(0.0 if 2 * tp[c] + fp[c] + fn[c] == 0 else 2 * tp[c] / (2 * tp[c] + fp[c] + fn[c])
             for c in classes) / len(classes)
    assert H.macro_f1_multiclass(df).first()["macro_f1"] == pytest.approx(f1)
    s, c = len(pairs), sum(tp.values())
    t = {k: sum(1 for y, _ in pairs if y == k) for k in classes}
    p = {k: sum(1 for _, q in pairs if q == k) for k in classes}
    num = c * s - sum(t[k] * p[k] for k in classes)
    den = math.sqrt((s * s - sum(v * v for v in p.values())) * (s * s - sum(v * v for v in t.values())))
    assert H.mcc(df).first()["mcc"] == pytest.approx(num / den)


def test_parse_label_and_prompt(spark):
    df = spark.createDataFrame([("x ### Label: 2. Negotiating",), ("### Label: 5",), ("no tag Sharing",),
                                ("### Label: nothing",)], "o string")
    got = [r[0] for r in df.select(TX.parse_label("o")).collect()]
    assert got == ["Negotiating", "Other", "None", "None"]
    m, p = TX.split_message(F.lit("Classify: a:b:c"))
    r = spark.range(1).select(m.alias("m"), p.alias("p")).first()
    assert (r["m"], r["p"]) == ("c", "a : b : ")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_pair_plan_has_no_dialogue_window(spark):
    import re
    nt = TX.normalize_text(FX.turns(spark, SF))
    plan = _plan(W.context_pair(nt))
    windows = re.findall(r"\n[^\n]*Window \[[^\n]*", plan)
    texts = [w for w in windows if "lag(_row" in w]
    assert windows and len(texts) == 2
    # turns are windowed by (dialogue, slice); by dialogue alone only one row for each slice
    assert sum("_s#" in w.split("specifiedwindowframe")[0] or "_s#" in w for w in texts) == 2
    assert "Join" not in plan


def test_scan_prunes_columns(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["scan_columns"](spark, SF))
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in plan


def test_dense_positions_exact(spark):
    from maskloom.operators.filters import dense_positions
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS k")
    got = sorted((r["k"], r["pos"]) for r in dense_positions(df, "k").collect())
    assert got == [(k, i) for i, k in enumerate(sorted(r["k"] for r in df.collect()))]


def test_dual_process_loop_beats_majority(spark):
    from maskloom.plans.catalog_learn import docs_split
    from maskloom.plans.loops import DualProcessConfig, dual_process_loop
    tr, te = docs_split(spark, SF)
    res = dual_process_loop(spark, tr, te, DualProcessConfig(end_epoch=2, repeat_r=1, patience=1, warmup=0))
    rows = res.ledger.collect()
    test_rows = [r for r in rows if r["kind"] == "test"]
    assert test_rows
    counts = te.groupBy("label").count().collect()
    majority = max(r["count"] for r in counts) / sum(r["count"] for r in counts)
    assert test_rows[0]["acc"] > majority
    mem = spark.read.parquet(res.memory_root)
    assert mem.count() > 0


def test_mask_rate_search_rows(spark):
    from maskloom.plans.catalog_learn import docs_split
    from maskloom.plans.loops import mask_rate_search
    tr, te = docs_split(spark, SF)
    rows = mask_rate_search(tr, te, rates=[0.05, 0.2], epochs=2, patience=1, warmup=0).collect()
    search = [r for r in rows if r["phase"] == "search"]
    final = [r for r in rows if r["phase"] == "final"]
    assert {r["rate"] for r in search} == {0.05, 0.2}
    assert len(final) == 1 and final[0]["rate"] in (0.05, 0.2)
    best = max(search, key=lambda r: r["mcc"])
    assert final[0]["rate"] == best["rate"] or any(r["mcc"] == best["mcc"] and r["rate"] == final[0]["rate"]
                                                   for r in search)
    assert all(0.0 <= r["acc"] <= 1.0 for r in rows)


def test_load_utterances_csv_roundtrip(spark):
    from pyspark.sql import types as T
    from maskloom.sources import io as IO
    t = FX.turns(spark, SF)
    path = IO.scratch_path(spark, "csv")
    t.select(F.col("group_id").alias("classID"), "turn", F.col("label").alias("labels"),
             F.col("speaker").alias("Speaker"), F.col("text").alias("context")) \
        .write.option("header", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("classID", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("labels", T.StringType()), T.StructField("Speaker", T.StringType()),
                           T.StructField("context", T.StringType())])
    cols = {"group": "classID", "turn": "turn", "text": "context", "label": "labels", "speaker": "Speaker"}
    got = IO.load_utterances(spark, path, "csv", cols, schema=schema)
    assert sorted(got.select("idx", "text").collect()) == sorted(t.select("idx", "text").collect())
    no_key = IO.load_utterances(spark, path, "csv", {k: v for k, v in cols.items() if k != "turn"}, schema=schema)
    ids = [r["idx"] for r in no_key.collect()]
    assert sorted(ids) == list(range(t.count()))      # zipWithIndex fallback: dense, unique


def test_rank_within_hot_key(spark):
    from pyspark.sql import Window
    from maskloom.operators.filters import rank_within
    # key 0 holds a third of all rows
    df = spark.range(0, 3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 97 + 1 END AS k",
                                         "(id * 7919) % 3001 AS t", "id")
    got = {r["id"]: r["rank"] for r in rank_within(df, "k", ["t", "id"]).collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r["id"]: r["rn"] - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_scores_with_null_labels_and_predictions(spark):
    from maskloom.operators import metrics as H
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", None), (None, "a"), (None, None), ("b", "c"), ("c", "c")]
    df = spark.createDataFrame(rows, "label string, pred string")
    pairs = [(("none", "label") if y is None else y, ("none", "pred") if p is None else p) for y, p in rows]
    classes = {v for pair in pairs for v in pair}
    t = {k: sum(y == k for y, _ in pairs) for k in classes}
    p = {k: sum(q == k for _, q in pairs) for k in classes}
    tp = {k: sum(y == q == k for y, q in pairs) for k in classes}
    f1 = sum(2 * tp[k] / (t[k] + p[k]) for k in classes) / len(classes)
    assert abs(H.macro_f1_multiclass(df).first()["macro_f1"] - f1) < 1e-12
    s, c = len(rows), sum(tp.values())
    top = c * s - sum(t[k] * p[k] for k in classes)
    low = ((s * s - sum(v * v for v in p.values())) * (s * s - sum(v * v for v in t.values()))) ** 0.5
    assert abs(H.mcc(df).first()["mcc"] - top / low) < 1e-12


def test_context_pair_null_speaker_is_a_change(spark):
    df = spark.createDataFrame([(1, 0, "u", "hi"), (1, 1, None, "yo"), (1, 2, None, "so"), (1, 3, "u", "ok")],
                               "group_id long, turn long, speaker string, text string")
    got = [r["context"] for r in W.context_pair(df).orderBy("turn").collect()]
    assert got == ["@ hi", "# hi @ yo", "# yo @ so", "# so @ ok"]


# --- slices: windows over hot dialogues and runs -----------------------------------------------------

def _history(spark, rows):
    return spark.createDataFrame(rows, "run_id long, epoch long, acc double, f1 double, mcc double")


def test_previous_turn_skips_dropped_turns_at_any_slice_width(spark):
    rng = random.Random(3)
    rows = [(g, t, rng.choice("ab"), f"t{g}.{t}") for g in (1, 2, None) for t in range(40) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "group_id long, turn long, speaker string, text string")
    want, before = {}, {}
    for g, t, sp, x in rows:
        p = before.get(g)
        change = p is None or p[0] != sp
        want[g, t] = (("# " if change else "@ ") + (p[1] if p else "") + " @ " + x).replace("#  @", "@")
        before[g] = (sp, x)
    for span in (1, 3, 7, 4096):
        got = {(r["group_id"], r["turn"]): r["context"] for r in W.context_pair(df, span=span).collect()}
        assert got == want


def test_early_stop_slices_match_driver_rule(spark):
    rng = random.Random(5)
    runs = {r: [(e, rng.choice([0.1, 0.2, 0.3, 0.4])) for e in range(30) if rng.random() < 0.7] for r in range(12)}
    runs[99] = [(0, 0.5)]
    df = _history(spark, [(r, e, 0.0, 0.0, m) for r, h in runs.items() for e, m in h])
    for span in (1, 2, 5, 4096):
        for patience in (1, 2, 3):
            got = {r["run_id"]: (bool(r["early_stopped"]), r["es_epoch"]) for r in W.early_stop(df, "mcc", 1, patience, span=span).collect()}
            assert got == {r: W.early_stop_rows(h, 1, patience) for r, h in runs.items() if h}


def _cycles(history, budget):
    out = []
    for outer in sorted(history):
        mccs = history[outer]
        ran, stop, used = [], None, budget
        for r in range(min(budget, len(mccs))):
            ran.append(mccs[r])
            if budget > 1 and r > 0 and ran[-2] > ran[-1]:
                stop, budget = r, budget - 1
                break
        best = max(range(len(ran)), key=lambda i: (ran[i], -i))
        out.append((outer, len(ran), stop, best, ran[best], budget))
    return out


def test_cycle_stop_slices_match_a_sequential_walk(spark):
    rng = random.Random(8)
    runs = {r: {o: [rng.choice([0.1, 0.2, 0.3]) for _ in range(rng.randint(1, 6))] for o in range(40) if rng.random() < 0.8}
            for r in range(6)}
    rows = [(r, o, c, m) for r, h in runs.items() for o, ms in h.items() for c, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run_id long, outer long, cycle long, mcc double")
    for span in (1, 3, 1024):
        for budget in (1, 3, 5):
            got = sorted(tuple(r) for r in W.cycle_stop(df, budget, span=span).collect())
            want = sorted((r, *x) for r, h in runs.items() for x in _cycles(h, budget))
            assert got == want


def test_a_million_rows_of_one_run_are_spread(spark):
    rows = spark.range(1_000_000).selectExpr("1L AS run_id", "id div 3 AS outer", "id % 3 AS cycle",
                                             "cast(xxhash64(id) % 1000 as double) AS mcc")
    out = W.cycle_stop(rows, 3)
    assert "Pandas" not in _plan(out) and "Python" not in _plan(out)
    assert out.count() == 333_334
    hist = rows.selectExpr("run_id", "outer * 3 + cycle AS epoch", "mcc AS acc", "mcc AS f1", "mcc")
    es = W.early_stop(hist, "mcc", 0, 3).first()
    best = [r["mcc"] for r in hist.orderBy("epoch").limit(200).collect()]
    assert (bool(es["early_stopped"]), es["es_epoch"]) == W.early_stop_rows(list(enumerate(best)), 0, 3)


# --- exact cuts without moving rows --------------------------------------------------------------------

def test_cut_key_finds_the_rank(spark):
    from maskloom.operators.filters import below, cut_key
    rng = random.Random(2)
    numbers = rng.sample(range(-10**15, 10**15), 500) + list(range(100))
    words = [f"{rng.getrandbits(64):016x}" for _ in range(500)] + ["ab", "abc", "abcd", "zz" * 40]
    for values, kind in ((sorted(set(numbers)), "long"), (sorted(set(words)), "string")):
        df = spark.createDataFrame([(v, "x" * 50) for v in values], f"k {kind}, text string").repartition(5)
        for bins in (4, 70, 1 << 16):
            for k in (0, 1, 77, len(values) - 1):
                cut = cut_key(df, "k", k, step=1, bins=bins)
                assert cut == values[k] and df.filter(below("k", cut)).count() == k
            assert cut_key(df, "k", len(values)) is None
    ties = spark.createDataFrame([(None,), (1,), (2,), (2,), (2,), (3,)], "k long")
    assert [cut_key(ties, "k", k) for k in range(7)] == [1, 1, 2, 2, 2, 3, None]


def test_exact_cuts_move_no_rows(spark):
    from maskloom.operators import filters as FL
    t = FX.turns(spark, SF)
    for df in (FL.data_percent(t, 0.3), SP.cycle_chunk(t, 0.25, 1), SP.random_split(t, 0.2, 7, exact=True), SP.group_split(t, 0.2, 7)):
        assert "Exchange" not in _plan(df) and "Scan ExistingRDD" not in _plan(df)


def test_replace_words_equals_lookup(spark):
    from maskloom.functions.masks import replace_words
    rng = random.Random(4)
    rows = [("a b a c", ["a", "zz", "a"]), ("", ["a"]), (None, ["a"]), ("a  b", []), ("a b", None), ("[M] a", ["[M]"])]
    rows += [(" ".join(rng.choice("abcdefgh") for _ in range(60)), rng.sample("abcdefghij", 3)) for _ in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, text string, words array<string>")
    got = {r["idx"]: (r["m"], r["d"]) for r in replace_words(replace_words(df, "text", "words", "m"), "text", "words", "d", remove=True).collect()}
    for i, (text, words) in enumerate(rows):
        if text is None:
            assert got[i] == (None, None)
        else:
            words = words or []
            toks = [t for t in text.split(" ") if t]
            assert got[i] == (" ".join("[M]" if t in words else t for t in toks), " ".join(t for t in toks if t not in words))


def test_replace_words_is_not_quadratic(spark):
    import time
    from maskloom.functions.masks import replace_words
    rng = random.Random(6)
    toks = [f"w{rng.randrange(15_000)}" for _ in range(20_000)]
    df = spark.createDataFrame([(" ".join(toks), sorted({t for t in toks if rng.random() < 0.15}))], "text string, words array<string>")
    start = time.time()
    text = replace_words(df, "text", "words", "m").first()["m"]
    assert time.time() - start < 10 and text.count("[M]") > 3000


def test_missing_predictions_are_misses(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None)], "label string, pred string")
    assert H.macro_f1_onehot(df, ["a"]).first()["macro_f1"] == pytest.approx(2 / 3)
    s = spark.createDataFrame([(1, 0, "a", None), (1, 1, "a", "a")], "group_id long, idx long, label string, pred string")
    assert {r["idx"]: r["running_acc"] for r in W.running_quality(s).collect()} == {0: 0.0, 1: 0.5}


def test_leaderboard_kinds_of_files(spark):
    rows = [("m", 1e-4, 4, "u_val_test", 0.5, 0.5, 1), ("m", 2e-4, 8, "val", 0.9, 0.1, 0), ("m", 3e-4, 4, "val_test", 0.8, 0.7, 2),
            ("m", 4e-4, 4, "test", 0.7, 0.9, 3), ("n", 1e-4, 4, "val_test", 0.4, 0.2, 5), ("n", 1e-4, 8, "val", 0.4, 0.3, 4)]
    df = spark.createDataFrame(rows, "model string, lr double, batch long, testFile string, acc double, macro_f1 double, epoch long")
    got = {(r["model"], r["eval_set"]): r.asDict() for r in H.leaderboard(df).collect()}
    assert set(got) == {("m", "val"), ("m", "test"), ("n", "val")}
    assert got["m", "val"]["max_acc"] == 0.5 and got["m", "test"]["max_acc"] == 0.8 and got["m", "test"]["best_f1_epoch"] == 3
    assert got["m", "val"]["base_acc"] == 0.9 and got["n", "val"]["best_acc_epoch"] == 4 and got["n", "val"]["best_f1_batch"] == 8


def test_prompt_of_unknown_and_null_labels(spark):
    df = spark.createDataFrame([("c", "m", "Sharing"), ("c", "m", None)], "context string, message string, label string")
    got = [r[0] for r in df.select(TX.render_prompt("context", "message", "label")).collect()]
    assert got[0].endswith("### Label: 4. Sharing") and got[1] is None
    with pytest.raises(Exception, match="no such label"):
        df.select(TX.render_prompt("context", "message", F.lit("Sharin"))).collect()


def test_logistic_regression_option(spark):
    from maskloom.operators import learners as L
    rows = [(i, "ab"[i % 2], f"{'red' if i % 2 else 'blue'} word{i % 7} word{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, label string, text string")
    model = L.train_classifier_lr(df, num_features=1 << 10)
    labels = model.stages[3].labels
    out = model.transform(df).select("label", "prediction").collect()
    assert all(labels[int(r["prediction"])] == r["label"] for r in out)


def test_classifier_lr_cuts_texts_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer

    from maskloom.operators import learners as L
    written = []
    real = L._session.written
    monkeypatch.setattr(L._session, "written", lambda df, name: (written.append((name, df.columns)), real(df, name))[1])
    rows = [(i, f"w{i % 3} v{i % 5} u{i % 2} x{i % 7}", "abc"[i % 3]) for i in range(90)] + [(90, "", "a"), (91, "w0", "c")]
    df = spark.createDataFrame(rows, "idx long, text string, label string")
    model = L.train_classifier_lr(df, num_features=1 << 10)
    assert written == [("hashed-tokens", ["_tf", "label"])]
    plain = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="t"), HashingTF(inputCol="t", outputCol="f", numFeatures=1 << 10),
                             IDF(inputCol="f", outputCol="g"), StringIndexer(inputCol="label", outputCol="y"),
                             LogisticRegression(featuresCol="g", labelCol="y", maxIter=20, family="multinomial")]).fit(df)
    got, want = ({r["idx"]: r["prediction"] for r in m.transform(df).collect()} for m in (model, plain))
    assert got == want and list(model.stages[3].labels) == list(plain.stages[3].labels)


def test_normalize_text_goes_through_the_characters_once(spark):
    from maskloom.functions.text import normalize_text
    df = spark.createDataFrame([(1, " a,\tb! @ #  Mask: c 'd' "), (2, " "), (3, None), (4, "?!"), (5, "@ #")], "idx long, text string")
    out = normalize_text(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [tuple(r) for r in out.orderBy("idx").collect()] == [(1, "a b c d", 4)]
    kept = normalize_text(df, keep="@#").orderBy("idx").collect()
    assert [tuple(r) for r in kept] == [(1, "a b @ # c d", 4)]
