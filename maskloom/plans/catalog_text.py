"""Catalog: sources (A1, A2), filters (B) and text functions (C) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import text as TX
from maskloom.functions.hashing import hkey, hunit
from maskloom.operators import filters as FL
from maskloom.plans import sqltext as S
from maskloom.plans.catalog_splits import BLANK
from maskloom.plans.registry import register
from maskloom.sources import fixtures as FX
from maskloom.sources import io as IO

T = S.turns_cte()
D = S.docs_cte()


def _norm(spark, sf, keep=""):
    return TX.normalize_text(FX.turns(spark, sf), remove_punct=True, keep=keep)


# --- A1 / A2 --------------------------------------------------------------------------------
@register("load_utterances", f"""
SELECT CAST(conv_id * 4294967296 + turn AS BIGINT) AS idx, CAST(conv_id AS BIGINT) AS group_id,
       CAST(turn AS BIGINT) AS turn, role AS speaker, role AS label, text FROM conversations""")
def q_load_utterances(spark, sf):
    return IO.load_utterances(spark, f"{sf}/conversations.parquet", "parquet",
                              {"group": "conv_id", "turn": "turn", "text": "text", "label": "role",
                               "speaker": "role"})


@register("scan_columns", "SELECT conv_id, role FROM conversations")
def q_scan_columns(spark, sf):
    return IO.scan_columns(FX.table(spark, sf, "conversations"), ["conv_id", "role"])


# --- B ----------------------------------------------------------------------------------------
@register("drop_blank", f"""
WITH {D} SELECT idx, CAST({S.token_count(S.squeeze('text'))} AS BIGINT) AS token_num FROM docs
WHERE text IS NOT NULL AND text <> ' ' AND text <> '' AND {S.token_count('text')} > 0""")
def q_drop_blank(spark, sf):
    d = FL.drop_blank(FX.docs(spark, sf))
    return d.select("idx", TX.token_count(TX.squeeze_space("text")).cast("long").alias("token_num"))


@register("data_percent", f"""
WITH {T}, r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS n FROM turns)
SELECT idx FROM r WHERE pos < CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT)""")
def q_data_percent(spark, sf):
    return FL.data_percent(FX.turns(spark, sf), 0.3, "train").select("idx")


def _load_sql(name, cut, punct):
    """One split, loaded: ``cut`` chooses rows by place (p of n) among those that are not blank."""
    return (f"{name}_b AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM bt WHERE text IS NOT NULL AND text <> ' '), "
            f"{name}_c AS (SELECT * FROM {name}_b WHERE {cut}), {S.normalized_cte(f'{name}_n', f'{name}_c', remove_punct=punct)}")


@register("load_split", f"""WITH {T}, {BLANK}, {_load_sql('tr', 'p < CAST(floor(n * CAST(0.4 AS DOUBLE)) AS BIGINT)', True)},
{_load_sql('te', 'p < 5 OR p >= n - 5', False)}
SELECT 'train' AS split, idx, CASE WHEN len({S.toks('text')}) > 24 THEN array_to_string({S.toks('text')}[-24:], ' ') ELSE text END AS text,
  CAST({S.token_count(f"CASE WHEN len({S.toks('text')}) > 24 THEN array_to_string({S.toks('text')}[-24:], ' ') ELSE text END")} AS BIGINT) AS token_num FROM tr_n
UNION ALL SELECT 'test', idx, text, token_num FROM te_n""")
def q_load_split(spark, sf):
    t = FX.blank_turns(spark, sf)
    cols = ["split", "idx", "text", "token_num"]
    train = FL.load_split(t, "train", pct=0.4, max_tokens=24).withColumn("split", F.lit("train")).select(cols)
    test = FL.load_split(t, "test", pct=0.4, debug=5, remove_punct=False).withColumn("split", F.lit("test")).select(cols)
    return train.unionByName(test)


@register("head_tail", f"""
WITH {T}, h AS (SELECT idx FROM turns ORDER BY idx LIMIT 50), t AS (SELECT idx FROM turns ORDER BY idx DESC LIMIT 50)
SELECT DISTINCT idx FROM (SELECT * FROM h UNION ALL SELECT * FROM t)""")
def q_head_tail(spark, sf):
    return FL.head_tail(FX.turns(spark, sf), 50).select("idx")


_MW = f"""WITH {T}, {S.normalized_cte('nt', 'turns')}"""


@register("masker_view", f"""{_MW}
SELECT group_id, 'Mask: ' || {S.strip_prefixes('text')} AS text, label AS labels, token_num AS tokenNum,
       '[M]' AS masked_word, idx FROM nt""")
def q_masker_view(spark, sf):
    return FL.masker_view(_norm(spark, sf).withColumn("masked_word", F.lit("[M]")))


@register("classifier_view", f"""{_MW}
SELECT group_id, 'Classify: ' || {S.strip_prefixes('text')} AS clsInFeat, label AS labels, token_num AS tokenNum,
       '[M]' AS masked_word, idx FROM nt""")
def q_classifier_view(spark, sf):
    return FL.classifier_view(_norm(spark, sf).withColumn("masked_word", F.lit("[M]")), feat="text")


# --- C1..C7 -----------------------------------------------------------------------------------
@register("space_punct", f"WITH {T} SELECT idx, {S.space_punct('text')} AS spaced FROM turns")
def q_space_punct(spark, sf):
    return FX.turns(spark, sf).select("idx", TX.space_punct("text").alias("spaced"))


@register("strip_punct", f"""WITH {T} SELECT idx, {S.strip_punct('text')} AS plain,
       {S.strip_punct('text', '@#')} AS plain_keep FROM turns""")
def q_strip_punct(spark, sf):
    return FX.turns(spark, sf).select("idx", TX.strip_punct("text").alias("plain"),
                                      TX.strip_punct("text", "@#").alias("plain_keep"))


@register("squeeze_space", f"WITH {D} SELECT idx, {S.squeeze('text')} AS squeezed FROM docs")
def q_squeeze_space(spark, sf):
    return FX.docs(spark, sf).select("idx", TX.squeeze_space("text").alias("squeezed"))


def _prefixed_input_sql():
    pick = f"substr({S.hkey(S.lit('pfx'), 'idx')}, 1, 1)"
    return (f"CASE WHEN {pick} IN ('0','1','2','3') THEN 'Classify: ' || text "
            f"WHEN {pick} IN ('4','5','6','7') THEN 'Mask: Classify: ' || text ELSE text END")


def _prefixed_input():
    pick = F.substring(hkey(F.lit("pfx"), F.col("idx")), 1, 1)
    return (F.when(pick.isin("0", "1", "2", "3"), F.concat(F.lit("Classify: "), "text"))
             .when(pick.isin("4", "5", "6", "7"), F.concat(F.lit("Mask: Classify: "), "text"))
             .otherwise(F.col("text")))


@register("task_prefix", f"""WITH {T}, p AS (SELECT idx, {_prefixed_input_sql()} AS inp FROM turns)
SELECT idx, 'Classify: ' || {S.strip_prefixes('inp')} AS cls_text, 'Mask: ' || {S.strip_prefixes('inp')} AS mask_text
FROM p""")
def q_task_prefix(spark, sf):
    p = FX.turns(spark, sf).select("idx", _prefixed_input().alias("inp"))
    return p.select("idx", TX.task_prefix("inp").alias("cls_text"), TX.task_prefix("inp", "mask").alias("mask_text"))


@register("normalize_text", f"""WITH {D}, {S.normalized_cte('nd', 'docs')}
SELECT idx, text, token_num FROM nd""")
def q_normalize_text(spark, sf):
    return TX.normalize_text(FX.docs(spark, sf), remove_punct=True).select("idx", "text", "token_num")


@register("normalize_text_spaced", f"""WITH {T}, {S.normalized_cte('nt', 'turns', remove_punct=False)}
SELECT idx, text, token_num FROM nt""")
def q_normalize_text_spaced(spark, sf):
    return TX.normalize_text(FX.turns(spark, sf), remove_punct=False).select("idx", "text", "token_num")


@register("token_count", f"""WITH {D} SELECT idx, CAST({S.token_count(S.squeeze('text'))} AS BIGINT) AS token_num
FROM docs""")
def q_token_count(spark, sf):
    return FX.docs(spark, sf).select("idx", TX.token_count(TX.squeeze_space("text")).cast("long").alias("token_num"))


@register("truncate_tokens", f"""{_MW}
SELECT idx,
  CASE WHEN len({S.toks('text')}) > 32 THEN array_to_string({S.toks('text')}[-32:], ' ') ELSE text END AS text_right,
  CASE WHEN len({S.toks('text')}) > 32 THEN array_to_string({S.toks('text')}[1:32], ' ') ELSE text END AS text_left,
  CAST(least(token_num, 32) AS BIGINT) AS token_num FROM nt""")
def q_truncate_tokens(spark, sf):
    base = _norm(spark, sf).withColumn("text_left", F.col("text")).withColumnRenamed("text", "text_right")
    both = TX.truncate_tokens(TX.truncate_tokens(base, 32, text="text_left", right=False), 32, text="text_right")
    return both.select("idx", "text_right", "text_left", F.col("token_num").cast("long"))


# --- C8..C14 on external mask predictions ------------------------------------------------------
def _ext_sql():
    words = ("list_concat(list_transform(list_sort(list_transform(" + S.toks(S.squeeze(S.strip_punct('text'))) +
             ", lambda w, i: {'k': " + S.hkey(S.lit('ext'), 'idx', 'i - 1') + ", 'w': w}))[1:3], lambda r: r.w), "
             "['qqzz'])")
    flag = f"substr({S.hkey(S.lit('extn'), 'idx')}, 1, 1)"
    return (f"ext AS (SELECT idx, CASE WHEN {flag} = '0' THEN NULL WHEN {flag} = '1' THEN '[M]' "
            f"ELSE array_to_string({words}, ' ') END AS pred_mask FROM turns)")


_EXT = f"WITH {T}, {S.normalized_cte('nt', 'turns')}, {_ext_sql()}"


def _ext(spark, sf):
    return _norm(spark, sf).join(FX.ext_masks(spark, sf), "idx")


@register("replace_tokens", f"""{_EXT}
SELECT nt.idx, array_to_string(list_transform({S.toks('nt.text')},
       lambda x: CASE WHEN list_contains({S.parse_mask('ext.pred_mask')}, x) THEN '[M]' ELSE x END), ' ') AS masked_sent
FROM nt JOIN ext ON nt.idx = ext.idx""")
def q_replace_tokens(spark, sf):
    from maskloom.functions.masks import pin_columns, replace_words
    e = pin_columns(_ext(spark, sf), _w=TX.parse_mask("pred_mask"))
    return replace_words(e, "text", "_w", "masked_sent").select("idx", "masked_sent")


@register("remove_tokens", f"""{_EXT}
SELECT nt.idx, array_to_string(list_filter({S.toks('nt.text')},
       lambda x: NOT list_contains({S.parse_mask('ext.pred_mask')}, x)), ' ') AS reduced
FROM nt JOIN ext ON nt.idx = ext.idx""")
def q_remove_tokens(spark, sf):
    from maskloom.functions.masks import pin_columns, replace_words
    e = pin_columns(_ext(spark, sf), _w=TX.parse_mask("pred_mask"))
    return replace_words(e, "text", "_w", "reduced", remove=True).select("idx", "reduced")


_RAW = S.toks("coalesce(ext.pred_mask, '[M]')")


@register("drop_sentinel", f"""{_EXT}
SELECT idx, array_to_string(CASE WHEN len({_RAW}) > 1 THEN list_filter({_RAW}, lambda x: x <> '[M]') ELSE {_RAW} END,
       ' ') AS words FROM ext""")
def q_drop_sentinel(spark, sf):
    e = FX.ext_masks(spark, sf)
    raw = TX.tokens(F.coalesce(F.col("pred_mask"), F.lit("[M]")))
    return e.select("idx", F.array_join(TX.drop_sentinel(raw), " ").alias("words"))


@register("dedupe_tokens", f"""WITH {D}, {S.normalized_cte('nd', 'docs')}
SELECT idx, array_to_string({S.distinct_ordered(S.toks('text'))}, ' ') AS distinct_words,
       CAST(len({S.distinct_ordered(S.toks('text'))}) AS BIGINT) AS n_distinct FROM nd""")
def q_dedupe_tokens(spark, sf):
    d = TX.normalize_text(FX.docs(spark, sf), remove_punct=True)
    dist = TX.dedupe_tokens(TX.tokens("text"))
    return d.select("idx", F.array_join(dist, " ").alias("distinct_words"), F.size(dist).cast("long").alias("n_distinct"))


@register("fill_null_masks", f"""{_EXT}
SELECT idx, {S.render_mask(S.parse_mask('pred_mask'))} AS masked_word FROM ext""")
def q_fill_null_masks(spark, sf):
    return FX.ext_masks(spark, sf).select("idx", TX.fill_null_masks("pred_mask").alias("masked_word"))


@register("mask_size", f"""{_EXT}
SELECT idx, CAST(len({S.parse_mask('pred_mask')}) AS BIGINT) AS mask_size FROM ext""")
def q_mask_size(spark, sf):
    return FX.ext_masks(spark, sf).select("idx", TX.mask_size("pred_mask").cast("long").alias("mask_size"))


@register("append_mask", f"""{_EXT}, a AS (SELECT nt.idx, {S.parse_mask('ext.pred_mask')} AS w,
       {S.toks('nt.text')}[len({S.toks('nt.text')})] AS x FROM nt JOIN ext ON nt.idx = ext.idx)
SELECT idx, {S.render_mask("CASE WHEN x IS NULL OR x = '[M]' OR list_contains(w, x) THEN w ELSE list_append(w, x) END")}
       AS masked_word FROM a""")
def q_append_mask(spark, sf):
    e = _ext(spark, sf)
    last = F.element_at(TX.tokens("text"), -1)
    return e.select("idx", TX.render_mask(TX.append_mask(TX.parse_mask("pred_mask"), last)).alias("masked_word"))


# --- C15..C19 -----------------------------------------------------------------------------------
_COLON = (f"WITH {T}, p1 AS (SELECT group_id, turn + 1 AS turn, text AS t1 FROM turns), "
          f"p2 AS (SELECT group_id, turn + 2 AS turn, text AS t2 FROM turns), "
          f"colon AS (SELECT t.idx, t.label, concat_ws(':', p2.t2, p1.t1, t.text) AS text FROM turns t "
          f"LEFT JOIN p1 ON t.group_id = p1.group_id AND t.turn = p1.turn "
          f"LEFT JOIN p2 ON t.group_id = p2.group_id AND t.turn = p2.turn)")
_PIECES = "string_split(replace(text, 'Classify: ', ''), ':')"
_MSG = "string_split(text, ':')[-1]"
_PRIOR = f"array_to_string({_PIECES}[1:len({_PIECES}) - 1], ' : ') || ' : '"


@register("split_message", f"""{_COLON}
SELECT idx, {_MSG} AS message, {_PRIOR} AS prior_context FROM colon""")
def q_split_message(spark, sf):
    c = FX.colon_text(spark, sf)
    msg, prior = TX.split_message("text")
    return c.select("idx", msg.alias("message"), prior.alias("prior_context"))


def _py_strip_sql(e):
    ws = S.WS_RE[1:-2]  # the class without the trailing '+' and quotes
    return f"regexp_replace({e}, '^{ws}+|{ws}+$', '', 'g')"


def _prompt_sql(ctx, msg):
    return ("(" + S.lit(TX.PROMPT_HEAD + TX.SYSTEM_PROMPT + TX.PROMPT_USER) + " || " + _py_strip_sql(ctx) + " || " +
            S.lit(TX.PROMPT_MSG) + " || " + _py_strip_sql(msg) + " || " + S.lit(TX.PROMPT_TAIL) + ")")


@register("render_prompt", f"""{_COLON},
li AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS label_id
       FROM (SELECT DISTINCT trim(label) AS label FROM turns WHERE label IS NOT NULL)),
pm AS (SELECT idx, CASE WHEN {S.hunit(S.lit('nolabel'), 'idx')} < 0.05 THEN NULL ELSE label END AS label,
              {_MSG} AS message, {_PRIOR} AS prior_context FROM colon)
SELECT pm.idx, {_prompt_sql('prior_context', 'message')} || CAST(li.label_id AS VARCHAR) || '. ' || pm.label
       AS train_prompt, {_prompt_sql('prior_context', 'message')} AS test_prompt
FROM pm LEFT JOIN li ON trim(pm.label) = li.label""")
def q_render_prompt(spark, sf):
    c = FX.colon_text(spark, sf)
    li = TX.label_index(FX.turns(spark, sf))
    msg, prior = TX.split_message("text")
    label = F.when(hunit(F.lit("nolabel"), F.col("idx")) >= 0.05, F.trim("label"))  # a twentieth has no label, but a test prompt
    c = c.select("idx", label.alias("label"), msg.alias("message"), prior.alias("prior_context"))
    from maskloom.operators.splits import join_keys
    c = join_keys(c, li, "label", "left")
    test = TX.render_prompt("prior_context", "message")
    train = F.concat(test, F.col("label_id").cast("string"), F.lit(". "), F.col("label"))
    return c.select("idx", train.alias("train_prompt"), test.alias("test_prompt"))


def _gen_sql():
    pick = f"CAST(('0x' || substr({S.hkey(S.lit('gen'), 'idx')}, 1, 4)) AS BIGINT)"
    labels = "[" + ", ".join(S.lit(x) for x in TX.DIALOGUE_LABELS) + "]"
    head = "text"
    tag = S.lit(" " + TX.LABEL_TAG + " ")
    return (f"g0 AS (SELECT idx, label, text, {pick} AS pick FROM turns), "
            f"gen AS (SELECT idx, label, CASE floor(pick / 36) % 4 "
            f"WHEN 0 THEN {head} || {tag} || {labels}[CAST(pick % 6 + 1 AS BIGINT)] || ' it is' "
            f"WHEN 1 THEN {head} || {tag} || CAST(CAST(floor(pick / 6) % 6 + 1 AS BIGINT) AS VARCHAR) || '.' "
            f"WHEN 2 THEN {head} || {S.lit(' ' + TX.LABEL_TAG + ' unsure')} "
            f"ELSE {head} || ' answer ' || {labels}[CAST(pick % 6 + 1 AS BIGINT)] END AS output FROM g0)")


def _parse_label_sql(e):
    tag = TX.LABEL_TAG
    win = f"substr({e}, strpos({e}, {S.lit(tag)}) + {len(tag)}, 100)"
    names = "[" + ", ".join(S.lit(x) for x in TX.DIALOGUE_LABELS) + "]"
    ids = "[" + ", ".join(S.lit(str(i + 1)) for i in range(len(TX.DIALOGUE_LABELS))) + "]"
    by_name = f"list_filter({names}, lambda l: contains({win}, l))[1]"
    by_id = f"list_filter(generate_series(1, {len(TX.DIALOGUE_LABELS)}), lambda i: contains({win}, {ids}[i]))[1]"
    return f"coalesce({by_name}, {names}[{by_id}], 'None')"


_GEN = f"WITH {T}, {_gen_sql()}"


@register("parse_label", f"{_GEN} SELECT idx, label, output, {_parse_label_sql('output')} AS pred FROM gen")
def q_parse_label(spark, sf):
    g = FX.gen_out(spark, sf)
    return g.select("idx", "label", "output", TX.parse_label("output").alias("pred"))


_PATHS = ("WITH h AS (SELECT user_id AS run_id, event_id, event_type FROM events), "
          "paths AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'model/run' || CAST(run_id AS VARCHAR) || '/final' "
          "ELSE 'model/run' || CAST(run_id AS VARCHAR) || '/epoch' || CAST(event_id % 50 AS VARCHAR) || '/ckpt' END "
          "AS path FROM h)")


@register("parse_epoch", f"""{_PATHS}
SELECT event_id, path, CASE WHEN strpos(path, 'epoch') > 0 THEN TRY_CAST(split_part(substr(path, strpos(path, 'epoch') + 5),
       '/', 1) AS INTEGER) END AS epoch FROM paths""")
def q_parse_epoch(spark, sf):
    e = FX.table(spark, sf, "events")
    path = F.when(F.col("event_type") == "error",
                  F.concat(F.lit("model/run"), F.col("user_id").cast("string"), F.lit("/final"))) \
            .otherwise(F.concat(F.lit("model/run"), F.col("user_id").cast("string"), F.lit("/epoch"),
                                (F.col("event_id") % 50).cast("string"), F.lit("/ckpt")))
    p = e.select("event_id", path.alias("path"))
    return p.select("event_id", "path", TX.parse_epoch("path").alias("epoch"))


@register("label_index", f"""WITH {T}
SELECT label, CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS label_id
FROM (SELECT DISTINCT trim(label) AS label FROM turns WHERE label IS NOT NULL)""")
def q_label_index(spark, sf):
    return TX.label_index(FX.turns(spark, sf))
