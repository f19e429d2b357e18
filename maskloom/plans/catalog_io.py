"""Catalog: variants, snapshots, ledgers, resume (A3-A7), scoring (I) and the scoring stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.hashing import hunit
from maskloom.functions.text import normalize_text, render_mask
from maskloom.operators import masking as M
from maskloom.operators import metrics as H
from maskloom.operators import scoring as SC
from maskloom.plans import sqltext as S
from maskloom.plans.catalog_eval import ROLES, _CONF, _MCC_SQL, _onehot_f1_sql
from maskloom.plans.catalog_splits import RULED, SCORED
from maskloom.plans.registry import register
from maskloom.sources import fixtures as FX
from maskloom.sources import io as IO

T = S.turns_cte()
_NT = f"WITH {T}, {S.normalized_cte('nt', 'turns')}"


# --- A3 ---------------------------------------------------------------------------------------------
def _variant_sql(fold, parts):
    """Rows of one variant: ``parts`` lists (variant, seed, epoch, mask_pct, splits)."""
    blocks = ("f AS (SELECT group_id, min(idx) AS first FROM nt GROUP BY group_id), "
              "r AS (SELECT group_id, row_number() OVER (ORDER BY first) - 1 AS p, count(*) OVER () AS n FROM f), "
              "b AS (SELECT group_id, CAST(least(floor(p / greatest(1, round_even(n / 3.0, 0))), 2) AS INTEGER) AS blk "
              "FROM r)")
    vb = f"CAST(('0x' || substr({S.hkey(S.lit('vb'), 'sp0.group_id')}, 1, 6)) AS BIGINT) % 2"
    sp = (f"sp AS (SELECT sp0.*, CASE WHEN b.blk = {fold} THEN 'test' WHEN {vb} = 0 THEN 'val' ELSE 'train' END AS split "
          f"FROM nt sp0 JOIN b ON sp0.group_id = b.group_id)")
    ctes, sel = [_NT, blocks, sp], []
    for i, (variant, seed, epoch, pct, splits) in enumerate(parts):
        k = S.budget("token_num", pct / 100) if variant != "base" else "0"
        ctes.append(S.draw_ctes(f"d{i}", "sp", k, seed * 100 + epoch, salt="pct"))
        sel.append(f"SELECT '{variant}' AS variant, {fold} AS fold, {seed} AS seed, {epoch} AS epoch, {pct} AS mask_pct, sp.split, sp.idx, "
                   f"sp.group_id, 'Classify: ' || {S.strip_prefixes(f'd{i}.masked_sent')} AS clsInFeat, sp.label AS labels "
                   f"FROM sp JOIN d{i} ON sp.idx = d{i}.idx WHERE sp.split IN ({splits})")
    return ", ".join(ctes) + " " + " UNION ALL ".join(sel)


def stored_variant(spark, sf, kinds, *args, **options):
    """Write the variant table by folder, and read one variant of it back."""
    rows = FX.variants(spark, sf, kinds)
    root = IO.write_variants(rows, IO.scratch_path(spark, "variants"))
    return IO.select_variant(IO.read_variants(spark, root, rows.schema), *args, **options)


_ALL, _TV, _TE = "'train', 'val', 'test'", "'train', 'val'", "'test'"


@register("select_variant", _variant_sql(1, [("dp", 1, 0, 15, "'train', 'test'"), ("dp", 1, 1, 15, _TV)]))
def q_select_variant(spark, sf):
    return stored_variant(spark, sf, ("dp",), "cum", fold=1, seed=1, epoch=1, val_type="masked")


@register("select_variant_base", _variant_sql(2, [("base", 0, 0, 0, _ALL)]))
def q_select_variant_base(spark, sf):
    return stored_variant(spark, sf, ("base", "rm"), "base", fold=2)


@register("select_variant_dp", _variant_sql(0, [("dp", 1, 2, 15, _TV), ("dp", 1, 0, 15, _TE)]))
def q_select_variant_dp(spark, sf):
    return stored_variant(spark, sf, ("dp",), "dp", fold=0, seed=1, epoch=2)


@register("select_variant_rm", _variant_sql(1, [("rm", 1, 0, 15, _ALL)]))
def q_select_variant_rm(spark, sf):
    return stored_variant(spark, sf, ("base", "rm"), "rm", fold=1, seed=1, mask_pct=15)


@register("select_variant_cum_unmasked", _variant_sql(1, [("dp", 0, 0, 15, "'train', 'test'"), ("dp", 0, 1, 15, "'train'"),
                                                          ("base", 0, 0, 0, "'val'")]))
def q_select_variant_cum_unmasked(spark, sf):
    return stored_variant(spark, sf, ("base", "dp"), "cum", fold=1, seed=0, epoch=1, val_type="unmasked")


# --- A4 / A7 snapshots -------------------------------------------------------------------------------
def _masks_for_epoch(nt, epoch):
    return M.mask_percent(nt, 0.15, epoch).select("idx", render_mask("mask_words").alias("masked_word"))


def _epoch_sql(epochs):
    parts = [S.draw_ctes(f"e{e}", "nt", S.budget("token_num", 0.15), e, salt="pct") for e in epochs]
    sel = " UNION ALL ".join(f"SELECT idx, {e} AS epoch, {S.render_mask('mask_words')} AS masked_word FROM e{e}"
                             for e in epochs)
    return f"{_NT}, " + ", ".join(parts) + " " + sel


@register("write_snapshot", _epoch_sql([1, 2]))
def q_write_snapshot(spark, sf):
    nt = normalize_text(FX.turns(spark, sf)).cache()
    root = IO.scratch_path(spark, "snapshots")
    IO.write_snapshot(_masks_for_epoch(nt, 0), root, "smem", 1)   # replaced below
    IO.write_snapshot(_masks_for_epoch(nt, 1), root, "smem", 1)
    IO.write_snapshot(_masks_for_epoch(nt, 2), root, "smem", 2)
    nt.unpersist()
    return IO.read_snapshot(spark, root, "smem").select("idx", "epoch", "masked_word")


@register("resume_epoch", _epoch_sql([1]))
def q_resume_epoch(spark, sf):
    nt = normalize_text(FX.turns(spark, sf)).cache()
    root = IO.scratch_path(spark, "resume")
    for e in range(3):
        IO.write_snapshot(_masks_for_epoch(nt, e), root, "smem", e)
    nt.unpersist()
    epoch, rows = IO.resume_epoch(spark, root, start_epoch=2, name="smem")
    return rows.select("idx", "epoch", "masked_word")


# --- A5 / A6 -----------------------------------------------------------------------------------------
def _ledger_row_sql(model):
    return (f"SELECT '{model}' AS model, CAST(0.0001 AS DOUBLE) AS lr, CAST(8 AS BIGINT) AS batch, "
            f"'train' AS trainFile, 'val' AS testFile, (SELECT round_even({_onehot_f1_sql()}, 4) FROM scored) "
            f"AS macro_f1, round_even(mcc, 4) AS macro_mcc, (SELECT round_even(avg(CASE WHEN trim(label) = pred "
            f"THEN 1.0 ELSE 0.0 END), 4) FROM scored) AS acc, CAST(0 AS BIGINT) AS epoch FROM mc")


@register("append_ledger", f"{_CONF}, {_MCC_SQL} {_ledger_row_sql('rule-a')} UNION ALL {_ledger_row_sql('rule-b')}")
def q_append_ledger(spark, sf):
    path = IO.scratch_path(spark, "ledger")
    s = FX.scored(spark, sf)
    meta = {"lr": 1e-4, "batch": 8, "trainFile": "train", "testFile": "val", "epoch": 0}
    IO.append_ledger(spark, path, H.evaluate_run(s, ROLES, dict(meta, model="rule-a")))
    return IO.append_ledger(spark, path, H.evaluate_run(s, ROLES, dict(meta, model="rule-b")))


@register("resume_unscored", f"WITH {T} SELECT idx FROM turns WHERE NOT ({S.hunit(S.lit('done'), 'idx')} < 0.6)")
def q_resume_unscored(spark, sf):
    path = IO.scratch_path(spark, "predlog")
    t = FX.turns(spark, sf)
    FX.scored(spark, sf).filter(hunit(F.lit("done"), F.col("idx")) < 0.6).write.mode("append").parquet(path)
    return IO.resume_unscored(t, spark.read.parquet(path)).select("idx")


# --- I ------------------------------------------------------------------------------------------------
@register("score_batches", f"WITH {T}, {RULED} SELECT idx, group_id, label, pred FROM scored")
def q_score_batches(spark, sf):
    return SC.score_batches(FX.turns(spark, sf), lambda: SC.LengthRuleModel(60), batch_size=64)


_LABS = ["assistant", "system", "user"]


@register("generate_and_parse", f"""WITH {T}, {RULED}
SELECT idx, label, ' ' || CASE WHEN pred = 'assistant' THEN '1' ELSE '3' END || '. ' || pred AS output,
       pred FROM scored""")
def q_generate_and_parse(spark, sf):
    from maskloom.functions.text import label_index
    labels = [r["label"] for r in label_index(FX.turns(spark, sf)).orderBy("label_id").collect()]
    c = FX.colon_text(spark, sf)
    return SC.generate_and_parse(c, lambda: SC.RuleGenerator(labels), labels)


# --- streaming ------------------------------------------------------------------------------------------
@register("stream_score", f"WITH {T}, {RULED} SELECT idx, group_id, label, pred FROM scored")
def q_stream_score(spark, sf):
    from maskloom.streaming.scoring_stream import stream_score
    src_schema = FX.table(spark, sf, "conversations").schema
    sink = IO.scratch_path(spark, "stream-sink")
    ckpt = IO.scratch_path(spark, "stream-ckpt")

    def prepare(b):
        return b.select(IO.natural_key("conv_id", "turn", FX.TURN_SPAN).alias("idx"),
                        F.col("conv_id").cast("long").alias("group_id"), F.col("role").alias("label"), "text")

    # the table is a file or a folder of files; a pattern takes either as the source
    q = stream_score(spark, f"{sf.rstrip('/')}/conversations.parque[t]", src_schema, sink, ckpt, lambda: SC.LengthRuleModel(60),
                     prepare=prepare)
    q.awaitTermination()
    schema = "idx long, group_id long, label string, pred string"
    if not IO.path_exists(spark, sink):  # no file, no batch
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink).select("idx", "group_id", "label", "pred")
