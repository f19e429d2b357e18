"""Filters and projections and the dense-position helper.

``cut_key`` finds the key that has a given number of rows below it by refining
a histogram, so an exact cut is a filter and moves no row.

``dense_positions`` gives every row its 0-based rank in ``order`` without a
global single-partition window: range-partition + sort, count rows per
partition (tiny), turn the counts into offsets, add the in-partition index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import task_prefix, token_count


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    """B1: non-null text that is not ' ' / '' and has at least one token."""
    c = F.col(col)
    return df.filter(c.isNotNull() & (c != " ") & (c != "") & (token_count(c) > 0))


def rank_within(df: DataFrame, key: str, order: list[str], out: str = "rank") -> DataFrame:
    """0-based rank of each row inside its ``key`` group, ordered by ``order`` (unique per key).

    A global dense position over (key, order) minus the key's first position:
    skew-safe (a key holding a third of all rows is spread over the range
    partitions), unlike ``row_number`` over a window partitioned by the key.
    The per-key first positions (one row per key) are joined back null-safe.
    """
    from maskloom.operators.splits import join_keys
    sort_key = F.struct(F.col(key), *[F.col(c) for c in order])
    pos = dense_positions(df.withColumn("_rk", sort_key), "_rk", out="_gp").drop("_rk")
    first = pos.groupBy(key).agg(F.min("_gp").alias("_first"))  # null keys form a group of their own
    res = join_keys(pos, first, key, "inner")
    return res.withColumn(out, (F.col("_gp") - F.col("_first")).cast("long")).drop("_gp", "_first")


def dense_positions(df: DataFrame, order: str, out: str = "pos", partitions: int | None = None) -> DataFrame:
    """Attach ``out`` = 0-based rank of ``order`` (unique key) across the whole frame.

    The range-partitioned, sorted frame is checkpointed (reliable checkpoint in
    the cluster's checkpoint dir) so the partition layout used for counting is
    the one used for numbering, also after an executor loss.
    """
    from maskloom.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n_parts, F.col(order)).sortWithinPartitions(order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    local = F.col("_mid") - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_loc", local)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    # One row per partition: the running sum over them is bounded by the partition count.
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
                  .drop("_pid", "_loc", "_off", "_mid"))


BINS = 1 << 16  # rows of one histogram, and keys that the last step collects: the bound of what reaches the driver


def cut_key(df: DataFrame, key: str, k: int, step: int = 4, bins: int = BINS):
    """The value of ``key`` at rank ``k`` (from 0), so with unique keys ``k`` rows are below it; None: no row has that rank.

    Only the key column is read, once for its range and once for each
    refinement: the rows between two bounds are counted by ``bins`` equal ranges
    (whole numbers) or by the next ``step`` characters (strings), and the range
    that holds the cut is refined until its keys can be collected. Rows that tie
    with the cut stay together; null keys count as the least.
    """
    keys = df.select(F.col(key).alias("k"))
    total = keys.agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"),
                     F.count_if(F.col("k").isNull()).alias("nulls")).first()
    below, n, lo, hi = total["nulls"], total["n"], total["lo"], total["hi"]
    if k >= below + n:
        return None
    if isinstance(lo, str):
        inside, size, prefix = F.col("k").isNotNull(), n, ""
        while size > bins:
            part = F.substring("k", len(prefix) + 1, step)
            hist = sorted(keys.where(inside).groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"])
            for r in hist:
                if below + r["count"] > k:
                    break
                below += r["count"]
            prefix, size = prefix + r["p"], r["count"]
            inside = F.col("k").startswith(prefix)
            if len(r["p"]) < step:  # the key ends here: all of these are equal
                return prefix
    else:
        while True:
            inside, size = F.col("k").between(lo, hi), None
            width = (hi - lo) // bins + 1
            if width == 1 or n <= bins:
                break
            part = F.expr(f"cast((cast(k as decimal(38, 0)) - {lo}) div {width} as long)")
            hist = sorted(keys.where(inside).groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"])
            for r in hist:
                if below + r["count"] > k:
                    break
                below += r["count"]
            lo, hi, n = lo + r["p"] * width, min(hi, lo + (r["p"] + 1) * width - 1), r["count"]
    # few keys, or few different ones
    for r in sorted(keys.where(inside).groupBy("k").count().collect(), key=lambda r: r["k"]):
        if below + r["count"] > k:
            return r["k"]
        below += r["count"]
    return None


def below(key: str, cut) -> Column:
    """Rows before the cut that :func:`cut_key` found: null keys are the least, and no cut leaves all rows below."""
    return F.lit(True) if cut is None else F.col(key).isNull() | (F.col(key) < cut)


def data_percent(df: DataFrame, pct: float, split: str = "train", order: str = "idx") -> DataFrame:
    """B2: keep the leading ``floor(n * pct)`` rows (``.loc[:n]`` made exclusive, Q1); test is never cut.

    ``order`` is unique. The cut is a filter on it; no row moves.
    """
    if pct >= 1 or "test" in split:
        return df
    keep = int(df.count() * pct)
    return df.filter(below(order, cut_key(df, order, keep))) if keep else df.filter(F.lit(False))


def head_tail(df: DataFrame, k: int, order: str = "idx") -> DataFrame:
    """First k and last k rows by ``order`` (TakeOrdered on each end), no duplicates."""
    head = df.orderBy(F.col(order).asc()).limit(k)
    tail = df.orderBy(F.col(order).desc()).limit(k)
    return head.unionByName(tail).dropDuplicates([order])


def load_split(df: DataFrame, split: str, pct: float = 1.0, debug: int = 0, remove_punct: bool = True, max_tokens: int = 0,
               text: str = "text", order: str = "idx", right: bool = True) -> DataFrame:
    """The loading of one split, its parts in the reference's order: blank filter (B1), leading share (B2; never of a test
    split), first and last ``debug`` rows (B3), prefix and punctuation (C1, C2, C4), spaces (C3), truncation (C7)."""
    from maskloom.functions.text import normalize_text, truncate_tokens
    raw = F.col(text)
    rows = data_percent(df.filter(raw.isNotNull() & (raw != " ")), pct, split, order)
    if debug:
        rows = head_tail(rows, debug, order)
    return truncate_tokens(normalize_text(rows, text, remove_punct=remove_punct), max_tokens, text, right)


MASKER_COLS = ["group_id", "text", "labels", "tokenNum", "masked_word", "idx"]
CLASSIFIER_COLS = ["group_id", "clsInFeat", "labels", "tokenNum", "masked_word", "idx"]


def masker_view(df: DataFrame) -> DataFrame:
    """Masker projection: [group, 'Mask: ' + text, labels, tokenNum, masked_word, idx]."""
    return df.select("group_id", task_prefix(F.col("text"), "mask").alias("text"), F.col("label").alias("labels"),
                     F.col("token_num").alias("tokenNum"), "masked_word", "idx")


def classifier_view(df: DataFrame, feat: str = "masked_sent") -> DataFrame:
    """Classifier projection: [group, 'Classify: ' + masked text, labels, tokenNum, masked_word, idx]."""
    return df.select("group_id", task_prefix(F.col(feat)).alias("clsInFeat"), F.col("label").alias("labels"),
                     F.col("token_num").alias("tokenNum"), "masked_word", "idx")
