"""Catalog: masking queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.masks import valid_mask
from maskloom.functions.text import render_mask
from maskloom.operators import masking as M
from maskloom.plans import sqltext as S
from maskloom.plans.registry import register
from maskloom.sources import fixtures as FX
from maskloom.functions.text import normalize_text

PCT, SEED = 0.15, 42


def norm_turns(spark, sf):
    return normalize_text(FX.turns(spark, sf), remove_punct=True)


# --- F2 -------------------------------------------------------------------
_F2_SQL = f"""
WITH {S.turns_cte()}, {S.normalized_cte('nt', 'turns')},
{S.draw_ctes('dm', 'nt', S.budget('token_num', PCT), SEED, salt='pct')}
SELECT nt.idx, nt.token_num, {S.render_mask('dm.mask_words')} AS masked_word, dm.masked_sent,
       CAST(len(dm.mask_words) AS BIGINT) AS mask_size
FROM nt JOIN dm ON nt.idx = dm.idx
"""


@register("mask_percent", _F2_SQL)
def q_mask_percent(spark, sf):
    m = M.mask_percent(norm_turns(spark, sf), PCT, SEED)
    return m.select("idx", "token_num", "masked_word", "masked_sent", "mask_size")


# --- F9 (also the flagship) ---------------------------------------------------
_F9_SQL = f"""
WITH {S.turns_cte()}, {S.normalized_cte('nt', 'turns', cols='idx, group_id, label, speaker')},
{S.draw_ctes('dm', 'nt', S.budget('token_num', PCT), SEED, salt='pct')},
v AS (
  SELECT nt.speaker, nt.token_num, len(dm.mask_words) AS ps,
         len(CASE WHEN len({S.toks(S.strip_punct('nt.text'))}) > 2
                  THEN list_filter(dm.mask_words, lambda x: list_contains({S.toks(S.strip_punct('nt.text'))}, x))
                  ELSE []::VARCHAR[] END) AS vs
  FROM nt JOIN dm ON nt.idx = dm.idx),
a AS (
  SELECT speaker AS dataName, avg(ps) AS p, avg(vs) AS v, avg(vs / token_num) AS r,
         CAST(sum(CASE WHEN ps <> vs THEN 1 ELSE 0 END) AS BIGINT) AS invalidNum, count(*) AS totNum
  FROM v GROUP BY speaker)
SELECT 0 AS epoch, dataName, round_even(p, 3) AS pred_mask_size, round_even(v, 3) AS valid_mask_size,
       round_even(round_even(v, 3) / round_even(p, 3), 3) AS pred_valid_maskSizeRatio,
       round_even(r * 100, 2) AS avgMaskRatePerInput, invalidNum, totNum,
       round_even(invalidNum / totNum, 4) AS invalidRate
FROM a
"""


def flagship(spark, sf):
    """turns -> C5 -> F2 (p=0.15) -> F7 -> C8 -> F9 per speaker."""
    m = M.mask_percent(norm_turns(spark, sf), PCT, SEED)
    m = m.withColumn("valid_words", valid_mask(F.col("text"), F.col("mask_words")))
    m = m.withColumn("epoch", F.lit(0)).withColumnRenamed("speaker", "dataName")
    return M.mask_stats(m, ["epoch", "dataName"], pred="mask_words", valid="valid_words")


register("mask_stats", _F9_SQL)(flagship)


# --- F1 / F3 / F4 -------------------------------------------------------------------------------
_NT = f"WITH {S.turns_cte()}, {S.normalized_cte('nt', 'turns')}"


@register("mask_one", f"""{_NT}, {S.draw_ctes('dm', 'nt', '1', SEED, salt='one')}
SELECT idx, coalesce(mask_words[1], '[M]') AS single_masked_word, masked_sent FROM dm""")
def q_mask_one(spark, sf):
    return M.mask_one(norm_turns(spark, sf), SEED).select("idx", "single_masked_word", "masked_sent")


@register("mask_count", f"""{_NT}, {S.draw_ctes('dm', 'nt', '2', SEED, salt='cnt')}
SELECT idx, {S.render_mask('mask_words')} AS masked_word, masked_sent, CAST(len(mask_words) AS BIGINT) AS mask_size
FROM dm""")
def q_mask_count(spark, sf):
    return M.mask_count(norm_turns(spark, sf), 2, SEED).select("idx", "masked_word", "masked_sent", "mask_size")


_SPLIT3_SQL = (f"CASE WHEN {S.hunit(S.lit('split3'), '7', 'idx')} < 0.2 THEN 'val' "
               f"WHEN {S.hunit(S.lit('split3'), '7', 'idx')} < 0.4 THEN 'test' ELSE 'train' END")


def split3(df):
    from maskloom.functions.hashing import hunit
    u = hunit(F.lit("split3"), F.lit(7), F.col("idx"))
    return df.withColumn("split", F.when(u < 0.2, F.lit("val")).when(u < 0.4, F.lit("test")).otherwise(F.lit("train")))


_NT3 = f"{_NT}, nts AS (SELECT *, {_SPLIT3_SQL} AS split FROM nt)"


@register("mask_all_splits", f"""{_NT3}, {S.draw_ctes('dm', 'nts', S.budget('token_num', 0.15), 1, salt='pct')}
SELECT nts.split, count(*) AS rows, avg(len(dm.mask_words)) AS avg_mask_size
FROM nts JOIN dm ON nts.idx = dm.idx GROUP BY ALL""")
def q_mask_all_splits(spark, sf):
    _, stats = M.mask_all_splits(split3(norm_turns(spark, sf)), "percent", epoch=1, pct=0.15, rand_seed=0)
    return stats


@register("random_mask_dataset", f"""{_NT3}, {S.draw_ctes('dm', 'nts', S.budget('token_num', 0.15), SEED, salt='pct')}
SELECT nts.idx, nts.group_id, nts.split, 'Classify: ' || {S.strip_prefixes(
    "CASE WHEN nts.split IN ('train', 'val') THEN dm.masked_sent ELSE nts.text END")} AS clsInFeat, nts.label AS labels
FROM nts JOIN dm ON nts.idx = dm.idx""")
def q_random_mask_dataset(spark, sf):
    return M.random_mask_dataset(split3(norm_turns(spark, sf)), 0.15, SEED)


@register("unmasked_dataset", f"""{_NT3}
SELECT idx, group_id, split, 'Classify: ' || {S.strip_prefixes('text')} AS clsInFeat, label AS labels FROM nts""")
def q_unmasked_dataset(spark, sf):
    return M.unmasked_dataset(split3(norm_turns(spark, sf)))


# --- F7 / F8 / F10 on external mask predictions ---------------------------------------------------
from maskloom.plans.catalog_text import _ext_sql  # noqa: E402

_EXTV = f"""{_NT}, {_ext_sql()},
pv AS (SELECT nt.idx, nt.text, nt.token_num, ext.pred_mask, {S.parse_mask('ext.pred_mask')} AS pw FROM nt JOIN ext ON nt.idx = ext.idx),
pvv AS (SELECT *, (CASE WHEN len({S.toks(S.strip_punct('text'))}) > 2 THEN list_filter(pw, lambda x:
        list_contains({S.toks(S.strip_punct('text'))}, x)) ELSE []::VARCHAR[] END) AS vw FROM pv)"""


def _pred_valid(spark, sf):
    return M.apply_pred_masks(norm_turns(spark, sf), FX.ext_masks(spark, sf))


@register("valid_mask", f"""{_EXTV}
SELECT idx, {S.render_mask('pw')} AS pred_mask, {S.render_mask('vw')} AS valid_mask,
       CAST(len(pw) AS BIGINT) AS pred_size, CAST(len(vw) AS BIGINT) AS valid_size FROM pvv""")
def q_valid_mask(spark, sf):
    p = _pred_valid(spark, sf)
    return p.select("idx", render_mask("pred_words").alias("pred_mask"), render_mask("valid_words").alias("valid_mask"),
                    F.size("pred_words").cast("long").alias("pred_size"),
                    F.size("valid_words").cast("long").alias("valid_size"))


@register("invalid_masks", f"""{_EXTV}
SELECT idx, {S.render_mask('pw')} AS pred_mask, {S.render_mask('vw')} AS valid_mask FROM pvv WHERE len(pw) <> len(vw)""")
def q_invalid_masks(spark, sf):
    p = M.invalid_masks(_pred_valid(spark, sf))
    return p.select("idx", render_mask("pred_words").alias("pred_mask"), render_mask("valid_words").alias("valid_mask"))


@register("apply_pred_masks", f"""{_EXTV}
SELECT idx, {S.render_mask('vw')} AS masked_word, array_to_string(list_transform({S.toks('text')},
       lambda x: CASE WHEN list_contains(vw, x) THEN '[M]' ELSE x END), ' ') AS masked_sent,
       CAST(len(vw) AS BIGINT) AS mask_size FROM pvv""")
def q_apply_pred_masks(spark, sf):
    return _pred_valid(spark, sf).select("idx", "masked_word", "masked_sent", "mask_size")


# --- F11 / F12 ------------------------------------------------------------------------------------
def _masker_train_sql():
    from maskloom.plans.catalog_eval import _MEM_SQL
    mt = (f"mt AS (SELECT mp.idx, mp.group_id, mp.label, mp.text, mp.token_num, "
          f"CASE WHEN mp.correct = 1 THEN mp.mask_words ELSE []::VARCHAR[] END AS words, "
          f"{_replace_sql_words('mp.text', 'mp.mask_words')} AS ms FROM mp "
          f"WHERE {S.hunit(S.lit('split'), '7', 'mp.idx')} >= 0.2), "
          f"mtx AS (SELECT idx, ms AS text FROM mt)")
    return (f"{_MEM_SQL}, {mt}, {S.draw_ctes('nw', 'mtx', '1', 3, salt='one')}, "
            f"mw AS (SELECT mt.*, nw.mask_words[1] AS x FROM mt JOIN nw ON mt.idx = nw.idx)")


def _replace_sql_words(text, words):
    return (f"array_to_string(list_transform({S.toks(text)}, lambda x: CASE WHEN list_contains({words}, x) "
            f"THEN '[M]' ELSE x END), ' ')")


@register("masker_train_set", f"""{_masker_train_sql()}
SELECT group_id, 'Mask: ' || {S.strip_prefixes('text')} AS text, label AS labels, token_num AS tokenNum,
       {S.render_mask("CASE WHEN x IS NULL OR x = '[M]' OR list_contains(words, x) THEN words ELSE list_append(words, x) END")}
       AS masked_word, idx FROM mw""")
def q_masker_train_set(spark, sf):
    from maskloom.functions.hashing import hunit
    from maskloom.plans.catalog_eval import memory_prev
    mem = memory_prev(spark, sf)
    train_ids = mem.filter(hunit(F.lit("split"), F.lit(7), F.col("idx")) >= 0.2).select("idx")
    return M.masker_train_set(mem, train_ids, seed=3)


def _set_sql(name, src, feat, where, words="mask_words"):
    return (f"SELECT idx, group_id, '{name}' AS set_name, 'Classify: ' || {S.strip_prefixes(feat)} AS clsInFeat, label AS labels, "
            f"token_num AS tokenNum, {S.render_mask(words)} AS masked_word FROM {src} WHERE {where}")


@register("masker_sets", f"""{_masker_train_sql()},
words AS (SELECT idx, CASE WHEN x IS NULL OR x = '[M]' OR list_contains(words, x) THEN words ELSE list_append(words, x) END AS w FROM mw)
SELECT 'masker_train' AS set_name, m.group_id, 'Mask: ' || {S.strip_prefixes('m.text')} AS text, m.label AS labels,
       m.token_num AS tokenNum, {S.render_mask('w.w')} AS masked_word, m.idx FROM mw m JOIN words w ON m.idx = w.idx
UNION ALL SELECT 'r_masker_smem', group_id, 'Mask: ' || {S.strip_prefixes('text')}, label, token_num, {S.render_mask('mask_words')}, idx FROM mp
UNION ALL SELECT 'i_masker_val', group_id, 'Mask: ' || {S.strip_prefixes('text')}, label, token_num, {S.render_mask('mask_words')}, idx FROM mp
  WHERE group_id % 5 = 0
UNION ALL SELECT 'i_masker_test', group_id, 'Mask: ' || {S.strip_prefixes('text')}, label, token_num, {S.render_mask('mask_words')}, idx FROM mp
  WHERE group_id % 5 = 1""")
def q_masker_sets(spark, sf):
    from maskloom.functions.hashing import hunit
    from maskloom.plans.catalog_eval import memory_prev
    from maskloom.session import materialize
    mem = materialize(memory_prev(spark, sf))  # read for each set
    train_ids = mem.filter(hunit(F.lit("split"), F.lit(7), F.col("idx")) >= 0.2).select("idx")
    return M.masker_sets(mem, train_ids, mem.filter("group_id % 5 = 0"), mem.filter("group_id % 5 = 1"), seed=3)


@register("classifier_sets_r", f"""{_masker_train_sql()}, ms AS (SELECT *, {_replace_sql_words('text', 'mask_words')} AS masked_sent FROM mp)
{_set_sql('masked_r_train', 'ms', 'masked_sent', S.hunit(S.lit('split'), '7', 'idx') + ' >= 0.2')}
UNION ALL {_set_sql('masked_r_val', 'ms', 'masked_sent', S.hunit(S.lit('split'), '7', 'idx') + ' < 0.2')}""")
def q_classifier_sets_r(spark, sf):
    from maskloom.functions.hashing import hunit
    from maskloom.plans.catalog_eval import memory_prev
    from maskloom.session import materialize
    mem = materialize(memory_prev(spark, sf))
    u = hunit(F.lit("split"), F.lit(7), F.col("idx"))
    return M.classifier_sets(mem, None, None, "r_train", mem.filter(u >= 0.2), mem.filter(u < 0.2))


@register("classifier_sets", f"""{_NT3}, {S.draw_ctes('dm', 'nts', S.budget('token_num', 0.15), SEED, salt='pct')},
m AS (SELECT nts.*, dm.masked_sent, dm.mask_words FROM nts JOIN dm ON nts.idx = dm.idx)
{_set_sql('masked_i_train', 'm', 'masked_sent', "split = 'train'")} UNION ALL {_set_sql('masked_i_val', 'm', 'masked_sent', "split = 'val'")}
UNION ALL {_set_sql('masked_i_trainVal', 'm', 'masked_sent', "split IN ('train', 'val')")}
UNION ALL {_set_sql('i_test', 'm', 'text', "split = 'test'")}""")
def q_classifier_sets(spark, sf):
    from maskloom.session import materialize
    m = materialize(M.mask_percent(split3(norm_turns(spark, sf)), PCT, SEED))
    mem, val, test = (m.filter(F.col("split") == s) for s in ("train", "val", "test"))
    return M.classifier_sets(mem, val, test, "i_train").unionByName(M.classifier_sets(mem, val, test, "test"))
