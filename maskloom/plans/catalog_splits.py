"""Catalog: windows (D) and splits (E) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.text import normalize_text, task_prefix
from maskloom.operators import masking as M
from maskloom.operators import splits as SP
from maskloom.operators import windows as W
from maskloom.plans import sqltext as S
from maskloom.plans.registry import register
from maskloom.sources import fixtures as FX

T = S.turns_cte()
HIST = ("history AS (SELECT CAST(user_id AS BIGINT) AS run_id, CAST(row_number() OVER (PARTITION BY user_id "
        "ORDER BY ts, event_id) - 1 AS BIGINT) AS epoch, value / 100.0 AS acc, "
        f"{S.hunit(S.lit('f1'), 'event_id')} AS f1, {S.hunit(S.lit('mcc'), 'event_id')} * 2.0 - 1.0 AS mcc, "
        "event_type FROM events)")
LEDGER = ("ledger AS (SELECT run_id, 'run' || CAST(run_id AS VARCHAR) AS model, "
          "[CAST(0.0001 AS DOUBLE), CAST(0.0002 AS DOUBLE), CAST(0.0003 AS DOUBLE), CAST(0.0004 AS DOUBLE), "
          "CAST(0.0005 AS DOUBLE)][CAST(epoch % 5 + 1 AS BIGINT)] AS lr, "
          "CAST([4, 8, 16][CAST(epoch % 3 + 1 AS BIGINT)] AS BIGINT) AS batch, 'train' AS trainFile, "
          "CASE WHEN event_type IN ('click', 'view') THEN 'val' ELSE 'test' END AS testFile, "
          "f1 AS macro_f1, mcc AS macro_mcc, acc, epoch FROM history)")
SCORED = ("scored AS (SELECT idx, group_id, label, CASE WHEN " + S.hunit(S.lit("nopred"), "idx") + " < 0.05 THEN NULL WHEN len(" +
          S.toks(S.squeeze("text")) + ") > 60 THEN 'assistant' ELSE 'user' END AS pred FROM turns)")
RULED = ("scored AS (SELECT idx, group_id, label, CASE WHEN len(" + S.toks(S.squeeze("text")) +
         ") > 60 THEN 'assistant' ELSE 'user' END AS pred FROM turns)")  # every turn, as a model scores them
BLANK = ("bt AS (SELECT * REPLACE (CASE WHEN " + S.hunit(S.lit("blank"), "idx") + " < 0.1 THEN ' ' ELSE text END AS text) FROM turns)")
MEM0 = ("mem0 AS (SELECT idx, CASE WHEN " + S.hunit(S.lit("sel"), "idx") + " < 0.5 THEN 1 END AS selected, "
        "CASE WHEN " + S.hunit(S.lit("sel"), "idx") + " < 0.5 THEN CASE WHEN " + S.hunit(S.lit("cor"), "idx") +
        " < 0.6 THEN 1 ELSE 0 END END AS correct FROM turns)")


# --- D ------------------------------------------------------------------------------------------
@register("context_pair", f"""WITH {T}, {BLANK}, {S.normalized_cte('nt', 'bt', cols='idx, group_id, turn, speaker, label')},
p AS (SELECT *, lag(text) OVER w AS prev_text, lag(speaker) OVER w AS prev_speaker FROM nt
      WINDOW w AS (PARTITION BY group_id ORDER BY turn))
SELECT idx, replace(CASE WHEN prev_text IS NULL OR speaker <> prev_speaker
    THEN '# ' || coalesce(prev_text, '') || ' @ ' || text
    ELSE '@ ' || prev_text || ' @ ' || text END, '#  @', '@') AS context FROM p""")
def q_context_pair(spark, sf):
    nt = normalize_text(FX.blank_turns(spark, sf))
    return W.context_pair(nt, "text", by_speaker=True).select("idx", "context")


@register("early_stop", f"""WITH {HIST},
v AS (SELECT run_id, epoch, mcc AS m FROM history WHERE epoch > 2),
f AS (SELECT run_id, epoch,
        coalesce(lead(m, 1) OVER w - m <= 0, false) AND coalesce(lead(m, 2) OVER w - m <= 0, false)
        AND coalesce(lead(m, 3) OVER w - m <= 0, false) AS stop
      FROM v WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
a AS (SELECT run_id, min(CASE WHEN stop THEN epoch END) AS es, max(epoch) AS last FROM f GROUP BY run_id),
r AS (SELECT DISTINCT run_id FROM history)
SELECT r.run_id, CAST(coalesce(a.es, a.last, 0) AS BIGINT) AS es_epoch,
       CAST(a.es IS NOT NULL AS INTEGER) AS early_stopped FROM r LEFT JOIN a ON r.run_id = a.run_id""")
def q_early_stop(spark, sf):
    return W.early_stop(FX.history(spark, sf), "mcc", warmup=2, patience=3)


@register("best_epoch", f"""WITH {HIST}
SELECT run_id, epoch AS best_epoch, (acc + f1) / 2 AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (acc + f1) / 2 DESC, epoch) AS rn FROM history)
WHERE rn = 1""")
def q_best_epoch(spark, sf):
    return W.best_epoch(FX.history(spark, sf), "f1_acc")


_STOP = "(b > 1 AND least(b, nc) >= 2 AND m0 > m1)"
_STOP2 = "(b > 1 AND least(b, nc) >= 3 AND m1 > m2)"


@register("cycle_stop", f"""WITH RECURSIVE {HIST},
h AS (SELECT run_id, CAST(floor(epoch / 3) AS BIGINT) AS o, epoch % 3 AS cycle, mcc FROM history),
p AS (SELECT run_id, o, max(CASE WHEN cycle = 0 THEN mcc END) AS m0, max(CASE WHEN cycle = 1 THEN mcc END) AS m1,
             max(CASE WHEN cycle = 2 THEN mcc END) AS m2, count(*) AS nc FROM h GROUP BY run_id, o),
r AS (SELECT run_id, CAST(0 AS BIGINT) AS o, CAST(3 AS BIGINT) AS b FROM p WHERE o = 0
      UNION ALL
      SELECT r.run_id, r.o + 1, CASE WHEN ({_STOP.replace('b ', 'r.b ').replace('(b,', '(r.b,')}
                                         OR {_STOP2.replace('b ', 'r.b ').replace('(b,', '(r.b,')}) THEN r.b - 1 ELSE r.b END
      FROM r JOIN p ON p.run_id = r.run_id AND p.o = r.o),
x AS (SELECT p.*, r.b, {_STOP} AS s1, NOT {_STOP} AND {_STOP2} AS s2 FROM p JOIN r ON p.run_id = r.run_id AND p.o = r.o),
y AS (SELECT *, CASE WHEN s1 THEN 2 WHEN s2 THEN 3 ELSE least(b, nc) END AS ran FROM x)
SELECT run_id, o AS "outer", CAST(ran AS BIGINT) AS cycles_run,
       CAST(CASE WHEN s1 THEN 1 WHEN s2 THEN 2 END AS BIGINT) AS stopped_at,
       CAST(CASE WHEN ran = 1 THEN 0 WHEN ran = 2 THEN (CASE WHEN m1 > m0 THEN 1 ELSE 0 END)
            WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS BIGINT) AS best_cycle,
       CASE WHEN ran = 1 THEN m0 WHEN ran = 2 THEN greatest(m0, m1) ELSE greatest(m0, m1, m2) END AS best_mcc,
       CAST(CASE WHEN s1 OR s2 THEN b - 1 ELSE b END AS BIGINT) AS next_budget FROM y""")
def q_cycle_stop(spark, sf):
    h = FX.history(spark, sf)
    h = h.select("run_id", F.floor(F.col("epoch") / 3).cast("long").alias("outer"),
                 (F.col("epoch") % 3).cast("long").alias("cycle"), "mcc")
    return W.cycle_stop(h, start_budget=3)


@register("recent_runs", f"""WITH {HIST}, {LEDGER}
SELECT * FROM ledger ORDER BY epoch DESC, run_id DESC LIMIT 20""")
def q_recent_runs(spark, sf):
    return W.recent_runs(FX.ledger(spark, sf), 20)


@register("running_quality", f"""WITH {T}, {SCORED}
SELECT idx, group_id, label, pred, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY group_id
       ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_acc FROM scored""")
def q_running_quality(spark, sf):
    return W.running_quality(FX.scored(spark, sf))


# --- E ------------------------------------------------------------------------------------------
@register("random_split", f"""WITH {T}
SELECT idx, CASE WHEN {S.hunit(S.lit('split'), '7', 'idx')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM turns""")
def q_random_split(spark, sf):
    return SP.random_split(FX.turns(spark, sf), 0.2, 7).select("idx", "split")


@register("random_split_exact", f"""WITH {T},
r AS (SELECT idx, row_number() OVER (ORDER BY {S.hkey(S.lit('split'), '7', 'idx')}) - 1 AS p, count(*) OVER () AS n
      FROM turns)
SELECT idx, CASE WHEN p < CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM r""")
def q_random_split_exact(spark, sf):
    return SP.random_split(FX.turns(spark, sf), 0.2, 7, exact=True).select("idx", "split")


@register("group_split", f"""WITH {T},
g AS (SELECT group_id, row_number() OVER (ORDER BY {S.hkey(S.lit('group'), '7', 'group_id')}) - 1 AS p,
             count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM turns)),
v AS (SELECT group_id FROM g WHERE p < CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT))
SELECT t.idx, t.group_id, CASE WHEN v.group_id IS NOT NULL THEN 'val' ELSE 'train' END AS split
FROM turns t LEFT JOIN v ON t.group_id = v.group_id""")
def q_group_split(spark, sf):
    return SP.group_split(FX.turns(spark, sf), 0.2, 7).select("idx", "group_id", "split")


_KF = f"""WITH {T},
f AS (SELECT group_id, min(idx) AS first FROM turns GROUP BY group_id),
r AS (SELECT group_id, row_number() OVER (ORDER BY first) - 1 AS p, count(*) OVER () AS n FROM f),
b AS (SELECT group_id, CAST(least(floor(p / greatest(1, round_even(n / 3.0, 0))), 2) AS INTEGER) AS blk FROM r),
x AS (SELECT t.idx, t.group_id, b.blk, unnest(range(0, 3)) AS fold FROM turns t JOIN b ON t.group_id = b.group_id)
SELECT idx, group_id, CAST(fold AS INTEGER) AS fold, CASE WHEN blk = fold THEN 'test' ELSE 'train' END AS split FROM x"""


@register("group_kfold", _KF)
def q_group_kfold(spark, sf):
    return SP.group_kfold(FX.turns(spark, sf), 3).select("idx", "group_id", "fold", "split")


@register("seeded_shuffle", f"WITH {T} SELECT idx, {S.hkey(S.lit('shuffle'), '5', 'idx')} AS shuffle_key FROM turns")
def q_seeded_shuffle(spark, sf):
    return SP.seeded_shuffle(FX.turns(spark, sf), 5).select("idx", "shuffle_key")


@register("cycle_chunk", f"""WITH {T},
r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM turns),
c AS (SELECT idx, p, CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) AS sz FROM r)
SELECT idx FROM c WHERE p >= sz AND p < 2 * sz""")
def q_cycle_chunk(spark, sf):
    return SP.cycle_chunk(FX.turns(spark, sf), 0.25, 1).select("idx")


@register("swap_unselected", f"""WITH {T}, {MEM0},
s AS (SELECT idx, CASE WHEN {S.hunit(S.lit('split'), '7', 'idx')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM turns),
j AS (SELECT s.idx, s.split, coalesce(m.selected, 0) = 1 AS sel FROM s LEFT JOIN mem0 m ON s.idx = m.idx),
c AS (SELECT sum(CASE WHEN split = 'val' AND sel THEN 1 ELSE 0 END) AS val_sel FROM j),
mv AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY {S.hkey(S.lit('swap'), '0', 'idx')}) - 1 AS p
       FROM j WHERE split = 'train' AND NOT sel) WHERE p < (SELECT val_sel FROM c))
SELECT idx, CASE WHEN split = 'val' AND sel THEN 'train' WHEN idx IN (SELECT idx FROM mv) THEN 'val'
       ELSE split END AS split FROM j""")
def q_swap_unselected(spark, sf):
    t = FX.turns(spark, sf)
    s = SP.random_split(t, 0.2, 7)
    return SP.swap_unselected(s, FX.memory0(spark, sf), seed=0)


def _e7_sql():
    parts, names = [], []
    for e in range(3):
        parts.append(S.draw_ctes(f"dm{e}", "nt", S.budget("token_num", 0.15), e + 100, salt="pct"))
        names.append(f"SELECT idx, {e} AS epoch, {S.render_mask(f'mask_words')} AS masked_word FROM dm{e}")
    return (f"WITH {T}, {S.normalized_cte('nt', 'turns')}, " + ", ".join(parts) + " " +
            " UNION ALL ".join(names))


@register("seed_salt", _e7_sql())
def q_seed_salt(spark, sf):
    from maskloom.functions.masks import draw_masks, mask_budget
    from maskloom.functions.text import render_mask
    nt = normalize_text(FX.turns(spark, sf)).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(3)])))
    seed = F.col("epoch") + 100 * 1  # E7: epoch + 100 * rand_seed
    m = draw_masks(nt, "text", "idx", mask_budget("token_num", 0.15), seed, salt="pct")
    return m.select("idx", "epoch", render_mask("mask_words").alias("masked_word"))


@register("train_val_union", f"""WITH {T}, {S.normalized_cte('nt', 'turns')}
SELECT idx, CASE WHEN {S.hunit(S.lit('split'), '7', 'idx')} < 0.2 THEN 'val' ELSE 'train' END AS split,
       'Classify: ' || {S.strip_prefixes('text')} AS clsInFeat FROM nt""")
def q_train_val_union(spark, sf):
    nt = SP.random_split(normalize_text(FX.turns(spark, sf)), 0.2, 7)
    view = lambda d: d.select("idx", "split", task_prefix("text").alias("clsInFeat"))
    return SP.train_val_union(view(nt.filter(F.col("split") == "train")), view(nt.filter(F.col("split") == "val")))
