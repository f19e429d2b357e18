"""The driver loops: control flow as a function, resume after every step, logs, additive models."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions.hashing import hunit, seed_salt
from maskloom.operators import learners as L
from maskloom.operators import masking as M
from maskloom.plans.loops import DualProcessConfig, Step, _final_epoch, dual_process_loop, next_step, read_memory
from maskloom.sources import io as IO


def _walk(cfg, mcc_of_cycle, mcc_of_epoch):
    done, trace = [], []
    while (s := next_step(done, cfg)) is not None:
        epoch, name, r = s
        trace.append(s)
        budget = done[-1].budget if done else cfg.repeat_r
        mcc, stopped = None, False
        if name == "cycle":
            mcc = mcc_of_cycle(epoch, r)
            before = [x.mcc for x in done if x.epoch == epoch and x.name == "cycle"]
            stopped = budget > 1 and r > 0 and before[-1] > mcc
            budget -= stopped
        elif name in ("final", "test"):
            mcc = mcc_of_epoch(epoch)
        done.append(Step(epoch, name, r, budget, stopped, mcc=mcc))
        assert len(trace) < 500
    return done, trace


def test_control_flow_equals_a_nested_loop():
    rng = random.Random(4)
    for _ in range(200):
        cfg = DualProcessConfig(end_epoch=rng.randint(1, 7), repeat_r=rng.randint(1, 4), patience=rng.randint(1, 3), warmup=rng.randint(0, 3))
        cyc, ep = {}, {}
        of_cycle = lambda e, r: cyc.setdefault((e, r), rng.choice([0.1, 0.2, 0.3]))
        of_epoch = lambda e: ep.setdefault(e, rng.choice([0.1, 0.2, 0.3, 0.4]))
        done, trace = _walk(cfg, of_cycle, of_epoch)
        want, budget, hist = [], cfg.repeat_r, []
        from maskloom.operators.windows import early_stop_rows
        for e in range(cfg.end_epoch):
            if e <= 1:
                want.append((e, "init", 0))
            if e >= 1:
                seen = []
                for r in range(budget):
                    want.append((e, "cycle", r))
                    seen.append(of_cycle(e, r))
                    if budget > 1 and r > 0 and seen[-2] > seen[-1]:
                        budget -= 1
                        break
            want.append((e, "final", 0))
            hist.append((e, of_epoch(e)))
            if e >= cfg.warmup:
                stopped, es = early_stop_rows(hist, cfg.warmup, cfg.patience)
                if stopped or e == cfg.end_epoch - 1:
                    best = es if stopped else max(hist, key=lambda x: (x[1], -x[0]))[0]
                    want.append((best, "test", 0))
                    break
        assert trace == want


@pytest.fixture(scope="module")
def rows(spark):
    """Two labels that share words; masks matter."""
    rng = random.Random(1)
    own = {"a": [f"a{i}" for i in range(12)], "b": [f"b{i}" for i in range(12)]}
    both = [f"c{i}" for i in range(20)]
    data = []
    for i in range(160):
        y = "ab"[i % 2]
        words = [rng.choice(own[y] if rng.random() < 0.25 else both) for _ in range(rng.randint(6, 14))]
        if rng.random() < 0.2:
            words = [rng.choice(own["ab"[(i + 1) % 2]] + both) for _ in words]
        data.append((i, i % 9, y, " ".join(words), len(words)))
    df = spark.createDataFrame(data, "idx long, group_id long, label string, text string, token_num long").cache()
    return df.where("idx < 120"), df.where("idx >= 120")


class _Ended(Exception):
    pass


def test_loop_resumes_after_every_step(spark, rows):
    train, test = rows
    cfg = dict(end_epoch=3, repeat_r=2, patience=1, warmup=0, mask_test=True, r_rate=0.5, pct=0.3)
    plain = dual_process_loop(spark, train, test, DualProcessConfig(**cfg))
    want = sorted(map(tuple, plain.ledger.collect()))
    assert len({w[4] for w in want}) > 1  # the epochs differ, so the arg-max means something
    root = IO.scratch_path(spark, "resumed")
    seen = []

    def end(step):
        seen.append((step.epoch, step.name, step.cycle))
        raise _Ended

    while True:
        try:
            res = dual_process_loop(spark, train, test, DualProcessConfig(**cfg, root=root), end)
            break
        except _Ended:
            # what a step that was ended midway left behind
            spark.range(3).write.mode("overwrite").parquet(f"{root}/smem/epoch={seen[-1][0]}/step=cycle-{seen[-1][2] + 1}")
            assert len(seen) < 40
    assert seen[0] == (0, "init", 0) and seen[-1][1] == "test" and len(set(seen)) == len(seen)
    assert sorted(map(tuple, res.ledger.collect())) == want and res.best_epoch == plain.best_epoch
    val = {w[1]: w[4] for w in want if w[0] == "val"}
    tested = [w[1] for w in want if w[0] == "test"]
    assert tested == [plain.best_epoch]
    cycles = [s for s in seen if s[1] == "cycle"]
    log = res.memory_log.select("epoch", "step", "smem_size", "selected_rate").collect()
    assert {(r["epoch"], r["step"]) for r in log} == {(e, f"cycle-{r}") for e, _, r in cycles}
    assert all(r["smem_size"] == train.where("1=1").count() - plain_val(train) for r in log)
    names = {(r["epoch"], r["step"], r["dataName"]) for r in res.mask_log.collect()}
    assert {(e, "final", n) for e in val if e for n in ("i_masker_smem", "i_masker_val")} <= names
    with pytest.raises(ValueError):
        dual_process_loop(spark, train, test, DualProcessConfig(**{**cfg, "pct": 0.1}, root=root))


def test_loop_keeps_each_text_once(spark, rows):
    train, test = rows
    # rows that come twice, and rows without a text
    none = spark.createDataFrame([(5001 + i, 2, "b", None, 1) for i in range(4)], train.schema)
    train = train.unionByName(train.where("idx < 9")).unionByName(none).checkpoint()
    cfg = dict(end_epoch=2, repeat_r=2, patience=1, warmup=0, mask_test=True, pct=0.3)
    plain = dual_process_loop(spark, train, test, DualProcessConfig(**cfg))
    root, told = IO.scratch_path(spark, "texts-once"), []

    def look(step):
        told.append(step)
        states = spark.read.parquet(f"{root}/state").select("epoch", "step").distinct().collect()
        assert len(states) == 1 and "masked_sent" not in spark.read.parquet(f"{root}/state").columns
        assert not any(IO.path_exists(spark, f"{root}/{kind}") for kind in ("remasked", "val"))
        if step.name == "cycle":
            IO.drop_path(spark, f"{root}/state")  # as a cycle leaves it that is ended midway
            raise _Ended

    while True:
        try:
            res = dual_process_loop(spark, train, test, DualProcessConfig(**cfg, root=root), look)
            break
        except _Ended:
            assert len(told) < 20
    assert sorted(map(tuple, res.ledger.collect())) == sorted(map(tuple, plain.ledger.collect()))
    assert not {"text", "masked_sent"} & set(spark.read.parquet(res.memory_root).columns)
    fit = train.where(hunit(F.lit("ival"), F.col("idx")) >= 0.2)
    last = read_memory(spark, res.memory_root, train, 1, "final")
    assert sorted(r["idx"] for r in last.collect()) == sorted({r["idx"] for r in fit.collect()})
    assert sorted(map(str, last.collect())) == sorted(map(str, read_memory(spark, plain.memory_root, train, 1, "final").collect()))


def test_snapshots_give_each_row_its_own_text(spark, rows):
    train, test = rows
    more = [(5000 + i, 1, y, t, 5) for i in range(6) for y, t in (("a", "c1 c2 c3 a1 a2"), ("b", "c4 c5 b3 b2 b1"), ("b", None))]
    train = train.unionByName(train.where("idx < 9")).unionByName(spark.createDataFrame(more, train.schema)).checkpoint()
    res = dual_process_loop(spark, train, test, DualProcessConfig(end_epoch=1, warmup=0, pct=0.3))
    fit = train.where(hunit(F.lit("ival"), F.col("idx")) >= 0.2)
    assert fit.where("idx >= 5000 and text is null").count() and fit.where("idx < 9").count() > fit.where("idx < 9").distinct().count()
    masked = M.mask_percent(fit, 0.3, seed_salt(0, 0)).select("idx", "label", "text", "mask_words", "masked_sent")
    memory = read_memory(spark, res.memory_root, train, 0, "init").select(masked.columns)
    assert sorted(map(str, memory.collect())) == sorted(map(str, masked.collect()))


def plain_val(train):
    from maskloom.functions.hashing import hunit
    return train.filter(hunit(F.lit("ival"), F.col("idx")) < 0.2).count()


def test_final_epoch_prefers_early_stop_then_largest():
    cfg = DualProcessConfig(warmup=0, patience=1)
    steps = [Step(e, "final", 0, 1, False, mcc=m) for e, m in enumerate([0.9, 0.3, 0.2])]
    assert _final_epoch(steps, cfg) == (True, 1)
    steps = [Step(e, "final", 0, 1, False, mcc=m) for e, m in enumerate([0.4, 0.3, 0.4])]
    assert _final_epoch(steps, cfg) == (False, 0)


def test_counts_of_copies_add_up(spark, rows):
    train, test = rows
    again = train.withColumn("text", F.concat("text", F.lit(" extra words")))
    merged = L.merge_counts(L.count_tokens(train), L.count_tokens(again))
    whole = L.count_tokens(train.unionByName(again))
    key = lambda c: sorted((r["t"], tuple(r["c"])) for r in c.tokens.collect())
    assert key(merged) == key(whole) and merged.rows == whole.rows
    grid = [(1.0, 1), (0.5, 3)]
    a, b = (L.classifier_from_counts(c, grid).predict(test) for c in (merged, whole))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        L.merge_counts(merged, L.count_tokens(train.where("label = 'a'")))


def test_classifier_edges(spark, rows):
    train, _ = rows
    model = L.train_classifier(train.withColumn("label", F.when(F.col("idx") > 2, F.col("label"))))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "nowhere seen"), (4, "a0 a0 a1")], "idx long, text string")
    got = {r["idx"]: r["pred"] for r in model.predict(odd).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] == got[3] and got[4] == "a"
    none = L.train_classifier(train.where("1 = 0")).predict(odd).collect()
    assert {r["pred"] for r in none} == {None}
