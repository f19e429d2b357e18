"""The paths that large tables take give what the plain ones give, and rows are not worked on more often than needed."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions.masks import draw_masks, draw_masks_each
from maskloom.operators import learners as L
from maskloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    data = [(i if i % 13 else None, "ab"[i % 2], " ".join(rng.choice(words[: 5 + i % 50]) for _ in range(i % 17))) for i in range(150)]
    return spark.createDataFrame(data + data[:9], "idx long, label string, text string").withColumn("token_num", F.lit(9).cast("long")).cache()


def test_rare_tokens_are_shuffled_and_count_alike(spark, rows, monkeypatch):
    grid = [(1.0, 1), (0.5, 3)]
    plain = L.train_classifier(rows, grid)
    monkeypatch.setattr(L, "COMMON", 12)
    split = L.train_classifier(rows, grid)
    assert plain.others is None and split.others is not None and 0 < split.tokens.count() <= 12
    # rows of rare tokens alone, and of unknown ones alone, keep their place and label
    odd = rows.where("idx is not null").unionByName(rows.sparkSession.createDataFrame(
        [(900, "a", "w54", 1), (901, "b", "none such", 2), (902, None, None, 0)], "idx long, label string, text string, token_num long"))
    key = lambda m: sorted(map(str, m.predict(odd, carry=["label"]).collect()))
    assert key(plain) == key(split) and len({x for x in key(plain)}) == 2 * odd.select("idx").distinct().count()
    monkeypatch.setattr(L, "COMMON", 0)
    assert key(L.train_classifier(rows, grid)) == key(plain)


def test_tokens_are_hashed_not_sorted_by_row(rows):
    model = L.train_classifier(rows)
    plan = _plan(model.predict(rows, carry=["label"]))
    # only the one row a document that leaves its task is aggregated with a string
    assert plan.count("SortAggregate") <= 2 and "HashAggregate" in plan and "SortMergeJoin" not in plan


def test_budgets_together_equal_budgets_alone(spark, rows):
    budgets = [0, 1, 3, 50]
    each = draw_masks_each(rows, "text", "idx", [F.lit(b) for b in budgets], 4)
    for i, b in enumerate(budgets):
        alone = draw_masks(rows, "text", "idx", b, 4)
        assert sorted(map(str, each.select("idx", F.col("masked_sents")[i].alias("x")).collect())) == \
            sorted(map(str, alone.select("idx", F.col("masked_sent").alias("x")).collect()))


def test_copies_are_counted_side_by_side(rows):
    both = rows.withColumn("texts", F.array("text", F.reverse(F.col("text"))))
    labels = L.count_labels(rows)
    together = L.classifier_from_counts(L.count_copies(both, "texts", 2, labels))
    got = sorted(map(str, together.predict(rows).collect()))
    want = []
    for i, text in enumerate(("text", F.reverse(F.col("text")))):
        alone = L.train_classifier(rows.withColumn("text", F.col("text") if i == 0 else text))
        want += alone.predict(rows).withColumn("cfg", F.lit(i)).collect()
    assert got == sorted(map(str, want))


def test_masker_takes_wide_columns_along_once(rows):
    masked = draw_masks(rows, "text", "idx", 2, 1)
    model = L.train_masker(masked)
    alone = model.predict(masked.where("idx is not null").dropDuplicates(["idx"]), 0.3)
    along = model.predict(masked.where("idx is not null").dropDuplicates(["idx"]), 0.3, carry=["label", "masked_sent"])
    assert sorted(map(str, alone.collect())) == sorted(map(str, along.select("idx", "pred_words").collect()))
    want = {r["idx"]: (r["label"], r["masked_sent"]) for r in masked.where("idx is not null").collect()}
    assert {r["idx"]: (r["label"], r["masked_sent"]) for r in along.collect()} == want


def test_variants_draw_a_mask_once_for_all_folds(spark):
    table = FX.variants(spark, SF)
    masks = table.where("variant = 'dp'").groupBy("seed", "epoch", "idx").agg(F.countDistinct("clsInFeat").alias("n"), F.count("*").alias("m"))
    assert masks.where("n <> 1 or m <> 3").count() == 0
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("fold#") < plan.index("ArrowEvalPython")  # folds are attached above the draws


def test_masker_ranks_rare_words_as_it_ranks_common_ones(rows, monkeypatch):
    masked = draw_masks(rows, "text", "idx", 2, 1)
    model, scores = L.train_masker(masked), {}
    for r in model.scores.collect():
        scores[r["t"]] = r["score"]
    df = rows.where("idx is not null").dropDuplicates(["idx"])
    cands = df.select("idx", L.candidate_tokens(F.col("text")).alias("c"), L.mask_budget("token_num", 0.3).alias("k")).collect()
    for threshold in (0.0, 0.3):
        want = {}
        for r in cands:
            c = [(-scores.get(t, 0.5), p, t) for p, t in enumerate(r["c"] or []) if scores.get(t, 0.5) >= threshold]
            want[r["idx"]] = [t for _, _, t in sorted(c)[:r["k"] or 0]]
        assert any(want.values())
        for most in (1 << 17, 8, 0):
            monkeypatch.setattr(L, "KNOWN", most)
            got = {r["idx"]: r["pred_words"] for r in model.predict(df, 0.3, threshold).collect()}
            assert got == want
    monkeypatch.setattr(L, "KNOWN", 8)
    plan = _plan(model.predict(rows, 0.3, carry=["label", "text"]))
    assert plan.count("Exchange hashpartitioning(idx#") == 1 and plan.count("Generate inline") == 1  # no word of a text but the rare ones
