"""Masking operators.

Inputs are normalized utterance frames (``normalize_text``: idx, text, token_num,
...). Masks travel as ``ARRAY<STRING>`` (empty = no mask) and are rendered to
the reference's space-joined / ``[M]`` string form only at the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.masks import draw_masks, draw_masks_each, mask_budget, valid_mask
from maskloom.functions.text import (SENTINEL, append_mask, parse_mask, render_mask,
                                     strip_prefixes, task_prefix)


def mask_one(df: DataFrame, seed: int, text: str = "text", idx: str = "idx") -> DataFrame:
    """one random word (all its occurrences) when > 3 unmasked tokens remain."""
    out = draw_masks(df, text, idx, 1, seed, salt="one", words_out="_w", text_out="masked_sent")
    return (out.withColumn("single_masked_word", F.coalesce(F.get(F.col("_w"), 0), F.lit(SENTINEL)))
               .drop("_w"))


def mask_percent(df: DataFrame, pct: float, seed: int, text: str = "text", idx: str = "idx") -> DataFrame:
    """``floor(token_num * pct)`` draws (min 1 when token_num > 1), stopping at <= 3 left."""
    out = draw_masks(df, text, idx, mask_budget("token_num", pct), seed, salt="pct",
                     words_out="mask_words", text_out="masked_sent")
    return out.withColumn("masked_word", render_mask("mask_words")) \
              .withColumn("mask_size", F.size("mask_words").cast("long"))


def mask_percent_each(df: DataFrame, pcts: list[float], seed: int, text: str = "text", idx: str = "idx") -> DataFrame:
    """F2 for several rates at once: ``masked_sents`` holds, rate by rate, the text that ``mask_percent`` masks."""
    return draw_masks_each(df, text, idx, [mask_budget("token_num", p) for p in pcts], seed, salt="pct")


def mask_count(df: DataFrame, k: int, seed: int, text: str = "text", idx: str = "idx") -> DataFrame:
    """a fixed number of draws per row."""
    out = draw_masks(df, text, idx, k, seed, salt="cnt", words_out="mask_words", text_out="masked_sent")
    return out.withColumn("masked_word", render_mask("mask_words")) \
              .withColumn("mask_size", F.size("mask_words").cast("long"))


def mask_all_splits(df: DataFrame, mode: str, epoch: int, pct: float = 0.15, rand_seed: int = 0,
                    split: str = "split") -> tuple[DataFrame, DataFrame]:
    """re-mask every split for an epoch; return (masked rows, mean mask size per split)."""
    from maskloom.functions.hashing import seed_salt
    seed = seed_salt(epoch, rand_seed)
    masked = mask_percent(df, pct, seed) if mode == "percent" else mask_count(df, 1, seed)
    stats = masked.groupBy(split).agg(F.count(F.lit(1)).alias("rows"),
                                      F.avg("mask_size").alias("avg_mask_size"))
    return masked, stats


def random_mask_dataset(df: DataFrame, pct: float, seed: int, split: str = "split",
                        mask_val: bool = True) -> DataFrame:
    """random-masking baseline: masked train (and val), raw test; [group, clsInFeat, labels]."""
    masked = mask_percent(df, pct, seed)
    masked_split = F.col(split).isin("train", "val") if mask_val else (F.col(split) == "train")
    feat = F.when(masked_split, F.col("masked_sent")).otherwise(F.col("text"))
    return masked.select("idx", "group_id", split, task_prefix(feat).alias("clsInFeat"),
                         F.col("label").alias("labels"))


def unmasked_dataset(df: DataFrame, split: str = "split") -> DataFrame:
    """no-masking baseline sets."""
    return df.select("idx", "group_id", split, task_prefix(F.col("text")).alias("clsInFeat"),
                     F.col("label").alias("labels"))


def invalid_masks(df: DataFrame, pred: str = "pred_words", valid: str = "valid_words") -> DataFrame:
    """F8: rows whose predicted and valid mask sizes differ (the reject table)."""
    return df.filter(F.size(pred) != F.size(valid))


def mask_stats(df: DataFrame, by: list[str], pred: str = "pred_words", valid: str = "valid_words",
               token_num: str = "token_num") -> DataFrame:
    """one aggregate per (epoch, dataset); rounding half-even 3/3/3/2/-/-/4."""
    ps, vs = F.size(pred), F.size(valid)
    agg = df.groupBy(*by).agg(
        F.avg(ps).alias("_p"), F.avg(vs).alias("_v"),
        F.avg(vs / F.col(token_num)).alias("_r"),
        F.sum(F.when(ps != vs, 1).otherwise(0)).cast("long").alias("invalidNum"),
        F.count(F.lit(1)).alias("totNum"))
    p3, v3 = F.bround("_p", 3), F.bround("_v", 3)
    return agg.select(*by, p3.alias("pred_mask_size"), v3.alias("valid_mask_size"),
                      F.bround(F.try_divide(v3, p3), 3).alias("pred_valid_maskSizeRatio"),
                      F.bround(F.col("_r") * 100, 2).alias("avgMaskRatePerInput"),
                      "invalidNum", "totNum",
                      F.bround(F.col("invalidNum") / F.col("totNum"), 4).alias("invalidRate"))


def apply_pred_masks(df: DataFrame, preds: DataFrame, pred_col: str = "pred_mask",
                     text: str = "text") -> DataFrame:
    """attach predicted masks by idx, clean (C11, C12), validate (F7), substitute.

    The reference aligns predictions by row position; here it is an equi-join on
    ``idx``. Rows with no prediction get no mask.
    """
    from maskloom.functions.masks import pin_columns, replace_words
    j = df.join(preds.select("idx", pred_col), "idx", "left")
    body = strip_prefixes(F.col(text))
    j = pin_columns(j, pred_words=parse_mask(F.col(pred_col)), _body=body)
    j = pin_columns(j, valid_words=valid_mask(F.col("_body"), F.col("pred_words")))
    return (replace_words(j, "_body", "valid_words", "masked_sent")
             .withColumn("masked_word", render_mask("valid_words"))
             .withColumn("mask_size", F.size("valid_words").cast("long"))
             .drop("_body"))


def add_random_word(df: DataFrame, seed: int, words: str = "mask_words", text: str = "masked_sent") -> DataFrame:
    """One exploratory draw on the already-masked text, appended to ``words`` (C14)."""
    out = draw_masks(df, text, "idx", 1, seed, salt="one", words_out="_new", text_out="_new_sent")
    return (out.withColumn(words, append_mask(F.col(words), F.get(F.col("_new"), 0)))
               .drop("_new", "_new_sent"))


def masker_train_set(memory: DataFrame, train_ids: DataFrame, seed: int, rate: float = 1.0,
                     chunk: int = 0) -> DataFrame:
    """masker training rows for the reflective train split.

    Memory rows of the split keep their mask only when known correct
    (``correct <=> 1``, NaN counts as not correct); every row gets one new
    exploratory draw on its current masked text, appended to its words; the
    rows of cycle chunk ``chunk`` (size ``floor(n * rate)``) are returned in the
    masker projection.
    """
    from maskloom.operators.filters import masker_view
    from maskloom.operators.splits import cycle_chunk
    m = memory.join(train_ids.select("idx"), "idx", "left_semi")
    keep = F.col("correct").eqNullSafe(1)
    m = m.withColumn("mask_words", F.when(keep, F.col("mask_words")).otherwise(F.array().cast("array<string>")))
    m = add_random_word(m, seed, words="mask_words", text="masked_sent")
    m = m.withColumn("masked_word", render_mask("mask_words"))
    m = cycle_chunk(m, rate, chunk) if rate < 1 else m
    return masker_view(m)


def masker_sets(memory: DataFrame, train_ids: DataFrame, val: DataFrame, test: DataFrame, seed, rate: float = 1.0,
                chunk: int = 0) -> DataFrame:
    """F11, whole: the masker's training rows and the sets it predicts on, in the masker projection with ``set_name``.

    masker_train: as ``masker_train_set``. r_masker_smem: the whole memory.
    i_masker_val and i_masker_test: the held-out splits. Null masks are shown as the sentinel.
    """
    from maskloom.operators.filters import masker_view
    parts = {"masker_train": masker_train_set(memory, train_ids, seed, rate, chunk)}
    for name, df in (("r_masker_smem", memory), ("i_masker_val", val), ("i_masker_test", test)):
        parts[name] = masker_view(df.withColumn("masked_word", F.coalesce(render_mask("mask_words"), F.lit(SENTINEL))))
    out = None
    for name, df in parts.items():
        named = df.withColumn("set_name", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def classifier_sets(memory: DataFrame, val: DataFrame, test: DataFrame, mode: str,
                    r_train_ids: DataFrame | None = None, r_val_ids: DataFrame | None = None,
                    mask_test: bool = False) -> DataFrame:
    """classifier sets with a ``set_name`` column.

    r_train: reflective train / val rows of the memory, both masked. i_train:
    the whole memory (masked) and the masked validation split. test: train+val
    (masked) and the test split, masked only when ``mask_test``. Inputs carry
    idx, group_id, label, text, token_num, mask_words, masked_sent.
    """
    def view(df, name, feat="masked_sent"):
        return df.select("idx", "group_id", F.lit(name).alias("set_name"), task_prefix(F.col(feat)).alias("clsInFeat"),
                         F.col("label").alias("labels"), F.col("token_num").alias("tokenNum"),
                         render_mask("mask_words").alias("masked_word"))
    if mode == "r_train":
        return view(memory.join(r_train_ids.select("idx"), "idx", "left_semi"), "masked_r_train") \
            .unionByName(view(memory.join(r_val_ids.select("idx"), "idx", "left_semi"), "masked_r_val"))
    if mode == "i_train":
        return view(memory, "masked_i_train").unionByName(view(val, "masked_i_val"))
    train_val = view(memory, "masked_i_trainVal").unionByName(view(val, "masked_i_trainVal"))
    return train_val.unionByName(view(test, "i_test", "masked_sent" if mask_test else "text"))
