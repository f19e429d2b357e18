"""Catalog: success memory (G) and evaluation (H) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.hashing import hunit
from maskloom.functions.text import normalize_text
from maskloom.operators import masking as M
from maskloom.operators import memory as MEM
from maskloom.operators import metrics as H
from maskloom.plans import sqltext as S
from maskloom.plans.catalog_splits import HIST, LEDGER, MEM0, SCORED
from maskloom.plans.registry import register
from maskloom.session import materialize
from maskloom.sources import fixtures as FX

T = S.turns_cte()
ROLES = ["user", "assistant", "system"]


# --- fixtures: previous memory and judged validation rows -----------------------------------------
def memory_prev(spark, sf):
    nt = normalize_text(FX.turns(spark, sf))
    mem = MEM.memory_init(M.mask_percent(nt, 0.15, 42))
    flags = FX.memory0(spark, sf)
    mem = mem.drop("selected", "correct").join(flags, "idx", "left")
    mem = mem.withColumn("pred_words", F.when(F.col("correct") == 1, F.col("mask_words"))
                         .otherwise(F.array().cast("array<string>")))
    mem = mem.withColumn("valid_correct", F.when((F.col("correct") == 1) & (F.size("mask_words") > 0), F.lit(1)))
    return mem


def judged(spark, sf, mem):
    val = mem.filter(hunit(F.lit("split"), F.lit(7), F.col("idx")) < 0.2)
    return MEM.judge_masks(FX.scored(spark, sf), val)


def _valid_sql(text, words):
    tk = S.toks(S.strip_punct(text))
    return f"(CASE WHEN len({tk}) > 2 THEN list_filter({words}, lambda x: list_contains({tk}, x)) ELSE []::VARCHAR[] END)"


def _replace_sql(text, words):
    return (f"array_to_string(list_transform({S.toks(text)}, lambda x: CASE WHEN list_contains({words}, x) "
            f"THEN '[M]' ELSE x END), ' ')")


_MEM_SQL = f"""WITH {T}, {S.normalized_cte('nt', 'turns')},
{S.draw_ctes('dm', 'nt', S.budget('token_num', 0.15), 42, salt='pct')}, {MEM0}, {SCORED},
mp AS (SELECT nt.idx, nt.group_id, nt.label, nt.text, nt.token_num, dm.mask_words, f.selected, f.correct,
         CASE WHEN f.correct = 1 THEN dm.mask_words ELSE []::VARCHAR[] END AS pred_words,
         CASE WHEN f.correct = 1 AND len(dm.mask_words) > 0 THEN 1 END AS valid_correct,
         []::VARCHAR[] AS valid_words, CAST(NULL AS INTEGER) AS cur_valid_correct
       FROM nt JOIN dm ON nt.idx = dm.idx LEFT JOIN mem0 f ON nt.idx = f.idx),
jd AS (SELECT mp.idx, mp.mask_words AS jw, CASE WHEN trim(sc.label) = sc.pred THEN 1 ELSE 0 END AS jc
       FROM mp JOIN scored sc ON mp.idx = sc.idx WHERE {S.hunit(S.lit('split'), '7', 'mp.idx')} < 0.2),
u1 AS (SELECT mp.*, jd.jw, jd.jc, jd.idx IS NOT NULL AS judged,
              (SELECT coalesce(max(jc), 0) FROM jd) = 1 AS anyok FROM mp LEFT JOIN jd ON mp.idx = jd.idx),
u2 AS (SELECT * REPLACE (
         CASE WHEN judged THEN 1 ELSE selected END AS selected,
         CASE WHEN anyok AND judged THEN jw ELSE pred_words END AS pred_words,
         CASE WHEN anyok AND jc = 1 THEN 1 ELSE correct END AS correct,
         CASE WHEN anyok THEN {_valid_sql('text', 'mask_words')} ELSE valid_words END AS valid_words) FROM u1),
u3 AS (SELECT * REPLACE (CASE WHEN anyok THEN CAST(coalesce(correct = 1 AND len(pred_words) > 0, false) AS INTEGER)
         ELSE cur_valid_correct END AS cur_valid_correct) FROM u2),
u4 AS (SELECT * REPLACE (CASE WHEN cur_valid_correct = 1 THEN valid_words ELSE mask_words END AS mask_words) FROM u3),
u5 AS (SELECT * REPLACE (CASE WHEN anyok AND correct = 1 AND len(mask_words) > 0 THEN 1 ELSE valid_correct END
         AS valid_correct) FROM u4),
u6 AS (SELECT * REPLACE (CASE WHEN jc = 0 THEN []::VARCHAR[] ELSE mask_words END AS mask_words) FROM u5)"""


@register("memory_init", f"""WITH {T}, {S.normalized_cte('nt', 'turns')},
{S.draw_ctes('dm', 'nt', S.budget('token_num', 0.15), 42, salt='pct')}
SELECT nt.idx, nt.group_id, nt.label, nt.token_num, {S.render_mask('dm.mask_words')} AS masked_word,
       dm.masked_sent, '[M]' AS pred_mask, '[M]' AS valid_mask, CAST(NULL AS INTEGER) AS correct,
       CAST(NULL AS INTEGER) AS valid_correct, CAST(NULL AS INTEGER) AS cur_valid_correct,
       CAST(NULL AS INTEGER) AS selected, CAST(len(dm.mask_words) AS BIGINT) AS mask_size
FROM nt JOIN dm ON nt.idx = dm.idx""")
def q_memory_init(spark, sf):
    nt = normalize_text(FX.turns(spark, sf))
    return MEM.render_memory(MEM.memory_init(M.mask_percent(nt, 0.15, 42)))


@register("judge_masks", f"""{_MEM_SQL}
SELECT jd.idx, sc.label, sc.pred, {S.render_mask('jd.jw')} AS pred_mask, jd.jc AS correct
FROM jd JOIN scored sc ON jd.idx = sc.idx""")
def q_judge_masks(spark, sf):
    j = judged(spark, sf, memory_prev(spark, sf))
    return j.select("idx", "label", "pred", MEM.render_mask("pred_words").alias("pred_mask"), "correct")


@register("memory_update", f"""{_MEM_SQL}
SELECT idx, group_id, label, token_num, {S.render_mask('mask_words')} AS masked_word,
       {_replace_sql('text', 'mask_words')} AS masked_sent, {S.render_mask('pred_words')} AS pred_mask,
       {S.render_mask('valid_words')} AS valid_mask, correct, valid_correct, cur_valid_correct, selected,
       CAST(len(mask_words) AS BIGINT) AS mask_size FROM u6""")
def q_memory_update(spark, sf):
    mem = materialize(memory_prev(spark, sf))  # read for the judged rows and for the update
    return MEM.render_memory(MEM.memory_update(mem, judged(spark, sf, mem)))


@register("memory_stats", f"""{_MEM_SQL},
a AS (SELECT count(*) AS n, sum(CASE WHEN selected = 1 THEN 1 ELSE 0 END) AS sel,
             sum(CASE WHEN correct = 1 THEN 1 ELSE 0 END) AS cor, sum(CASE WHEN valid_correct = 1 THEN 1 ELSE 0 END) AS vc,
             sum(CASE WHEN jc = 1 THEN 1 ELSE 0 END) AS js, count(jc) AS jn FROM u6)
SELECT CAST(n AS BIGINT) AS smem_size, sel / n AS selected_rate, round_even(vc / n, 4) AS valid_success_mask_rate,
       round_even(cor / n, 4) AS success_mask_rate, round_even((sel - cor) / n, 4) AS fail_mask_rate,
       round_even(js / jn, 4) AS cur_val_success_rate FROM a""")
def q_memory_stats(spark, sf):
    mem = materialize(memory_prev(spark, sf))
    jd = judged(spark, sf, mem)
    return MEM.memory_stats(MEM.memory_update(mem, jd), jd)


# --- H ----------------------------------------------------------------------------------------------
_SC = f"WITH {T}, {SCORED}"


@register("one_hot_labels", f"""{_SC}
SELECT idx, {', '.join(f"CAST(contains(label, '{r}') AS INTEGER) AS y_{r}" for r in ROLES)},
       {', '.join(f"CAST(contains(pred, '{r}') AS INTEGER) AS ypred_{r}" for r in ROLES)} FROM scored""")
def q_one_hot_labels(spark, sf):
    s = FX.scored(spark, sf)
    s = H.one_hot_labels(s, ROLES, "label", "y_")
    s = H.one_hot_labels(s, ROLES, "pred", "ypred_")
    return s.drop("group_id", "label", "pred")


@register("confusion", f"{_SC} SELECT trim(label) AS label, pred, count(*) AS n FROM scored GROUP BY ALL")
def q_confusion(spark, sf):
    return H.confusion(FX.scored(spark, sf))


@register("accuracy", f"""{_SC}
SELECT group_id % 2 AS half, round_even(avg(CASE WHEN trim(label) = pred THEN 1.0 ELSE 0.0 END), 4) AS acc,
       count(*) AS n FROM scored GROUP BY ALL""")
def q_accuracy(spark, sf):
    s = FX.scored(spark, sf).withColumn("half", F.col("group_id") % 2)
    return H.accuracy(s, ["half"])


def _f1_sql(tp, fp, fn):
    return f"(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END)"


def _onehot_f1_sql():
    parts = []
    for r in ROLES:
        y, yp = f"coalesce(contains(trim(label), '{r}'), false)", f"coalesce(contains(pred, '{r}'), false)"
        parts.append(_f1_sql(f"sum(CAST({y} AND {yp} AS BIGINT))", f"sum(CAST(NOT {y} AND {yp} AS BIGINT))",
                             f"sum(CAST({y} AND NOT {yp} AS BIGINT))"))
    return "(" + " + ".join(parts) + f") / {len(ROLES)}"


@register("macro_f1_onehot", f"{_SC} SELECT round_even({_onehot_f1_sql()}, 9) AS macro_f1 FROM scored")
def q_macro_f1_onehot(spark, sf):
    return H.macro_f1_onehot(FX.scored(spark, sf), ROLES).select(F.bround("macro_f1", 9).alias("macro_f1"))


_CONF = f"""{_SC}, conf AS (SELECT trim(label) AS label, pred, count(*) AS n FROM scored GROUP BY ALL),
t AS (SELECT label AS cls, sum(n) AS t FROM conf GROUP BY 1), p AS (SELECT pred AS cls, sum(n) AS p FROM conf GROUP BY 1),
tp AS (SELECT label AS cls, sum(n) AS tp FROM conf WHERE label = pred GROUP BY 1),
pc AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(t.t, 0) AS t, coalesce(p.p, 0) AS p, coalesce(tp.tp, 0) AS tp
       FROM t FULL JOIN p ON t.cls = p.cls LEFT JOIN tp ON coalesce(t.cls, p.cls) = tp.cls)"""


@register("macro_f1_multiclass", f"""{_CONF}
SELECT round_even(avg({_f1_sql('tp', 'p - tp', 't - tp')}), 9) AS macro_f1 FROM pc""")
def q_macro_f1_multiclass(spark, sf):
    return H.macro_f1_multiclass(FX.scored(spark, sf)).select(F.bround("macro_f1", 9).alias("macro_f1"))


_MCC_SQL = """m AS (SELECT sum(CAST(t AS DOUBLE) * p) AS tp_sum, sum(CAST(p AS DOUBLE) * p) AS pp,
                 sum(CAST(t AS DOUBLE) * t) AS tt, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS s FROM pc),
mc AS (SELECT CASE WHEN sqrt((s * s - pp) * (s * s - tt)) = 0 THEN 0.0
              ELSE (c * s - tp_sum) / sqrt((s * s - pp) * (s * s - tt)) END AS mcc FROM m)"""


@register("mcc", f"{_CONF}, {_MCC_SQL} SELECT round_even(mcc, 9) AS mcc FROM mc")
def q_mcc(spark, sf):
    return H.mcc(FX.scored(spark, sf)).select(F.bround("mcc", 9).alias("mcc"))


_META = {"model": "rule", "lr": 1e-4, "batch": 8, "trainFile": "train", "testFile": "val", "epoch": 0}


@register("evaluate_run", f"""{_CONF}, {_MCC_SQL}
SELECT 'rule' AS model, CAST(0.0001 AS DOUBLE) AS lr, CAST(8 AS BIGINT) AS batch, 'train' AS trainFile,
       'val' AS testFile, (SELECT round_even({_onehot_f1_sql()}, 4) FROM scored) AS macro_f1,
       round_even(mcc, 4) AS macro_mcc,
       (SELECT round_even(avg(CASE WHEN trim(label) = pred THEN 1.0 ELSE 0.0 END), 4) FROM scored) AS acc,
       CAST(0 AS BIGINT) AS epoch FROM mc""")
def q_evaluate_run(spark, sf):
    return H.evaluate_run(FX.scored(spark, sf), ROLES, _META)


@register("leaderboard", f"""WITH {HIST}, {LEDGER},
lg AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch) = 1 AS first,
              max(CAST(contains(testFile, 'u_val') AS INTEGER)) OVER (PARTITION BY model) = 1 AS has_uval FROM ledger),
base AS (SELECT model, acc AS base_acc, macro_f1 AS base_f1 FROM lg WHERE first),
tg AS (SELECT *, CASE WHEN (CASE WHEN has_uval THEN contains(testFile, 'u_val') ELSE contains(testFile, 'val') END)
         THEN 'val' WHEN contains(testFile, 'test') THEN 'test' END AS eval_set FROM lg),
ba AS (SELECT model, eval_set, epoch, batch, lr,
         row_number() OVER (PARTITION BY model, eval_set ORDER BY acc DESC, epoch) AS r1,
         row_number() OVER (PARTITION BY model, eval_set ORDER BY macro_f1 DESC, epoch) AS r2,
         max(acc) OVER (PARTITION BY model, eval_set) AS max_acc,
         max(macro_f1) OVER (PARTITION BY model, eval_set) AS max_f1 FROM tg WHERE eval_set IS NOT NULL)
SELECT a.model, a.eval_set, b.base_acc, a.max_acc, a.max_acc - b.base_acc AS acc_gain, a.epoch AS best_acc_epoch,
       a.batch AS best_acc_batch, a.lr AS best_acc_lr, b.base_f1, a.max_f1, a.max_f1 - b.base_f1 AS f1_gain,
       f.epoch AS best_f1_epoch, f.batch AS best_f1_batch, f.lr AS best_f1_lr
FROM ba a JOIN ba f ON a.model = f.model AND a.eval_set = f.eval_set AND f.r2 = 1
JOIN base b ON a.model = b.model WHERE a.r1 = 1""")
def q_leaderboard(spark, sf):
    return H.leaderboard(FX.ledger(spark, sf))


@register("seed_summary", f"""WITH {HIST}, {LEDGER}
SELECT model, testFile, count(*) AS n_seeds,
       round_even(avg(acc), 9) AS acc_mean, round_even(stddev_pop(acc), 9) AS acc_std,
       round_even(avg(macro_f1), 9) AS f1_mean, round_even(stddev_pop(macro_f1), 9) AS f1_std,
       round_even(avg(macro_mcc), 9) AS mcc_mean, round_even(stddev_pop(macro_mcc), 9) AS mcc_std
FROM ledger GROUP BY ALL""")
def q_seed_summary(spark, sf):
    return H.seed_summary(FX.ledger(spark, sf), ["model", "testFile"])


@register("token_stats", f"""WITH {S.docs_cte()}, {S.normalized_cte('nd', 'docs')}
SELECT label, avg(token_num) AS mean_tokens, CAST(max(token_num) AS BIGINT) AS max_tokens FROM nd GROUP BY ALL""")
def q_token_stats(spark, sf):
    return H.token_stats(normalize_text(FX.docs(spark, sf)), ["label"])
