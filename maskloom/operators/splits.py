"""Splits and sampling.

All randomness is ``md5(salt|seed|key)``: reproducible, independent of
partitioning and retries, and repeatable in SQL. Exact-size cuts find
the cut key by refining a histogram (``cut_key``) and filter by it; ranks use
``dense_positions``, never a global single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import hkey, hunit
from maskloom.operators.filters import below, cut_key, dense_positions


def join_keys(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Null-safe join with a key table (one row per key); a null key is a key like any other.

    Spark picks the join: it broadcasts below its own size limit, and beyond it
    shuffles, where AQE's skew-join handling splits a hot key's partition.
    """
    side = keys.withColumnRenamed(on, "_on")
    return df.join(side, F.col(on).eqNullSafe(F.col("_on")), how).drop("_on")


def random_split(df: DataFrame, val_size: float, seed: int, exact: bool = False, key: str = "idx") -> DataFrame:
    """Seeded row split; adds ``split`` in {'train', 'val'}.

    Default: hash threshold (one pass, size approximately ``val_size``).
    ``exact=True``: the ``ceil(n * val_size)`` rows with the smallest hash key.
    """
    if not exact:
        return df.withColumn("split", F.when(hunit(F.lit("split"), F.lit(seed), F.col(key)) < val_size,
                                             F.lit("val")).otherwise(F.lit("train")))
    n_val = math.ceil(df.count() * val_size)
    keyed = df.withColumn("_sk", hkey(F.lit("split"), F.lit(seed), F.col(key)))
    val = below("_sk", cut_key(keyed, "_sk", n_val)) if n_val else F.lit(False)
    return keyed.withColumn("split", F.when(val, F.lit("val")).otherwise(F.lit("train"))).drop("_sk")


def group_split(df: DataFrame, val_size: float, seed: int, group: str = "group_id") -> DataFrame:
    """``floor(val_size * #groups)`` groups (smallest hash) go to 'val'; no group straddles.

    The groups' cut hash is found once; a row then tells its side by its own group's hash, without a join.
    """
    hashed = hkey(F.lit("group"), F.lit(seed), F.col(group))
    groups = df.select(group).distinct().select(hashed.alias("_gk"))
    k = int(val_size * groups.count())
    val = below("_gk", cut_key(groups, "_gk", k)) if k else F.lit(False)
    return df.withColumn("_gk", hashed).withColumn("split", F.when(val, F.lit("val")).otherwise(F.lit("train"))).drop("_gk")


def group_kfold(df: DataFrame, n_splits: int, group: str = "group_id", order: str = "idx") -> DataFrame:
    """Groups in first-appearance order cut into blocks of ``round_half_even(#groups / n)``.

    The last block takes the remainder; block size is clamped to >= 1 (Q19).
    Emits one row per (row, fold) with ``split`` test/train.
    """
    j = group_blocks(df, n_splits, group, order)
    j = j.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return j.withColumn("split", F.when(F.col("_blk") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_blk")


def group_blocks(df: DataFrame, n_splits: int, group: str = "group_id", order: str = "idx") -> DataFrame:
    """``df`` with ``_blk``, the block of its group (E3): the fold that tests on it."""
    from maskloom.session import written
    first = written(df.groupBy(group).agg(F.min(order).alias("_first")), "groups")  # read to count and to rank
    n_groups = first.count()
    size = max(1, int(round(n_groups / n_splits)))  # Python round is half-even
    ranked = dense_positions(first, "_first", out="_gp")
    blocks = ranked.select(group, F.least(F.floor(F.col("_gp") / size), F.lit(n_splits - 1)).cast("int").alias("_blk"))
    return join_keys(df, blocks, group, "inner")


def seeded_shuffle(df: DataFrame, seed: int, key: str = "idx", partitions: int | None = None) -> DataFrame:
    """Seeded shuffle before writing: range-partition and sort by a hash key (kept as ``shuffle_key``)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("shuffle_key", hkey(F.lit("shuffle"), F.lit(seed), F.col(key)))
    return keyed.repartitionByRange(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def cycle_chunk(df: DataFrame, rate: float, i: int, order: str = "idx") -> DataFrame:
    """E5: chunk ``i`` of size ``floor(n * rate)`` in ``order``; disjoint chunks (Q1). Two cuts and a filter; no row moves."""
    if rate >= 1:
        return df
    size = int(df.count() * rate)
    if not size:
        return df.filter(F.lit(False))
    start = below(order, cut_key(df, order, i * size)) if i else F.lit(False)
    return df.filter(below(order, cut_key(df, order, (i + 1) * size)) & ~start)


def swap_unselected(split_df: DataFrame, memory: DataFrame, seed: int = 0, literal_q8: bool = False) -> DataFrame:
    """Rebalance a train/val split with the memory flags.

    Validation rows already ``selected`` go to train and the same number of
    never-selected training rows (hash order) go to val. When no training row is
    unselected: validation rows not known correct go to train and as many
    training rows known correct (``literal_q8``: not known correct, as the
    reference literally filters) go to val. Returns (idx, split).
    """
    j = split_df.select("idx", "split").join(memory.select("idx", "selected", "correct"), "idx", "left")
    sel = F.coalesce(F.col("selected"), F.lit(0)) == 1
    cor = F.coalesce(F.col("correct"), F.lit(0)) == 1
    counts = j.agg(
        F.sum(F.when((F.col("split") == "val") & sel, 1).otherwise(0)).alias("val_sel"),
        F.sum(F.when((F.col("split") == "train") & ~sel, 1).otherwise(0)).alias("train_unsel"),
        F.sum(F.when((F.col("split") == "val") & ~cor, 1).otherwise(0)).alias("val_fail"),
        F.sum(F.when((F.col("split") == "train") & (~cor if literal_q8 else cor), 1).otherwise(0)).alias("train_succ"),
    ).first()
    hk = hkey(F.lit("swap"), F.lit(seed), F.col("idx"))
    if (counts["train_unsel"] or 0) > 0:
        out_val, cand, take = (F.col("split") == "val") & sel, (F.col("split") == "train") & ~sel, counts["val_sel"] or 0
    elif (counts["train_succ"] or 0) > 0:
        cand_cond = ~cor if literal_q8 else cor
        out_val, cand, take = (F.col("split") == "val") & ~cor, (F.col("split") == "train") & cand_cond, \
            counts["val_fail"] or 0
    else:
        return j.select("idx", "split")
    movers = dense_positions(j.filter(cand).select("idx").withColumn("_k", hk), "_k", out="_p") \
        .filter(F.col("_p") < take).select("idx", F.lit(True).alias("_to_val"))
    res = j.join(movers, "idx", "left")
    new = F.when(out_val, F.lit("train")).when(F.col("_to_val"), F.lit("val")).otherwise(F.col("split"))
    return res.select("idx", new.alias("split"))


def train_val_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate train and val sets (by column name)."""
    return a.unionByName(b)
