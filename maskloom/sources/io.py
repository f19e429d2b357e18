"""Sources and sinks: utterance loading, snapshots, ledgers, resume."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def load_utterances(spark: SparkSession, path: str, fmt: str = "parquet", cols: dict | None = None,
                    schema: T.StructType | None = None, turn_span: int = 1 << 32) -> DataFrame:
    """A1: read one split and bind group / turn / text / label / speaker columns.

    ``cols`` maps logical names to source columns (``group``, ``turn``, ``text``,
    ``label``, ``speaker``). ``idx`` comes from the natural key
    (``natural_key``) when both exist; otherwise rows are numbered by file and
    place in it (``number_rows``). CSV needs a declared ``schema`` (no inference at scale).
    """
    cols = cols or {}
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV input needs a declared schema")
        df = reader.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = reader.format(fmt).load(path)

    keyed = bool(cols.get("group") and cols.get("turn"))

    def pick(key, default=None):
        src = cols.get(key, default)
        return F.col(src) if src and src in df.columns else F.lit(None)

    bound = df.select(pick("group").cast("long").alias("group_id"), pick("turn").cast("long").alias("turn"),
                      pick("speaker").cast("string").alias("speaker"), pick("label").cast("string").alias("label"),
                      pick("text").cast("string").alias("text"), *([] if keyed else [F.col("_metadata").alias("_at")]))
    if keyed:
        return bound.select(natural_key("group_id", "turn", turn_span).alias("idx"), *bound.columns)
    return number_rows(bound, "_at", exact=fmt == "parquet")


def natural_key(group: str, turn: str, turn_span: int = 1 << 32) -> Column:
    """``group * turn_span + turn``: one long, unique while turns lie in [0, turn_span) and groups within 2**63 / turn_span
    of zero. A row outside these bounds, or without group or turn, raises: it would take another row's key."""
    limit = (1 << 63) // turn_span
    fits = F.col(group).between(-limit, limit - 1) & F.col(turn).between(0, turn_span - 1)
    told = F.concat(F.lit("no key for group and turn: "), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.lit(", "),
                    F.coalesce(F.col(turn).cast("string"), F.lit("null")))
    return F.when(fits, F.col(group).cast("long") * F.lit(turn_span).cast("long") + F.col(turn).cast("long")).otherwise(F.raise_error(told)).cast("long")


def number_rows(df: DataFrame, at: str, exact: bool) -> DataFrame:
    """Rows numbered from 0 by (file path, place in the file) as ``idx``, on the JVM; ``at`` holds the source's ``_metadata``.

    Parquet tells a row's place in its file (``exact``). Other formats tell the
    block of the file that the row was read from; a block is read by one task in
    order, so the place in it is the running row id less the block's first one.
    Counts by file or block give the offsets: one row each reaches the window over them.
    """
    if exact:
        rows = df.withColumn("_f", F.col(at)["file_path"]).withColumn("_b", F.lit(0).cast("long")).withColumn("_p", F.col(at)["row_index"])
        first = F.lit(0).cast("long")
    else:
        rows = df.withColumn("_f", F.col(at)["file_path"]).withColumn("_b", F.col(at)["file_block_start"]) \
            .withColumn("_p", F.monotonically_increasing_id())
        first = F.min("_p")
    parts = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")  # one row for each file or block
    parts = parts.select("_f", "_b", (before - F.col("_first")).alias("_off"))
    return rows.join(parts, ["_f", "_b"]).select((F.col("_p") + F.col("_off")).cast("long").alias("idx"),
                                                 *[c for c in df.columns if c != at])


def scan_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: column subset; on parquet Catalyst prunes the scan to ``cols`` (ReadSchema)."""
    return df.select(*cols)


def select_variant(df: DataFrame, variant: str, fold: int, seed: int = 0, epoch: int = 0,
                   mask_pct: int = 0, val_type: str = "masked") -> DataFrame:
    """A3: train / val / test rows of one dataset variant via partition-column filters.

    base: fold. dp: fold, seed, epoch (train, val); test of the same fold/seed at
    epoch 0 (the test file has no epoch). cum: dp train of every epoch <= epoch,
    val masked (dp val at ``epoch``) or unmasked (base val). rm: mask_pct, fold, seed.
    """
    c = F.col
    if variant == "base":
        return df.filter((c("variant") == "base") & (c("fold") == fold))
    if variant == "dp":
        tv = (c("split").isin("train", "val")) & (c("epoch") == epoch)
        te = (c("split") == "test") & (c("epoch") == 0)
        return df.filter((c("variant") == "dp") & (c("fold") == fold) & (c("seed") == seed) & (tv | te))
    if variant == "cum":
        dp = (c("variant") == "dp") & (c("fold") == fold) & (c("seed") == seed)
        train = dp & (c("split") == "train") & (c("epoch") <= epoch)
        test = dp & (c("split") == "test") & (c("epoch") == 0)
        if val_type == "masked":
            val = dp & (c("split") == "val") & (c("epoch") == epoch)
        else:
            val = (c("variant") == "base") & (c("fold") == fold) & (c("split") == "val")
        return df.filter(train | val | test)
    if variant == "rm":
        return df.filter((c("variant") == "rm") & (c("fold") == fold) & (c("seed") == seed)
                         & (c("mask_pct") == mask_pct))
    raise ValueError(f"unknown variant {variant}")


#: Columns of a stored variant table, in the order of its folders.
VARIANT_PARTS = ["variant", "fold", "seed", "epoch", "mask_pct", "split"]


def write_variants(df: DataFrame, root: str, files: int | None = None, key: str = "idx") -> str:
    """A3 sink: variant rows by folder (``VARIANT_PARTS``).

    Every task writes its own rows to all their folders, so the size of a task follows the input's splits and no row moves.
    With ``files`` the rows are first gathered into so many files a folder, which one task each writes.
    """
    if files:
        df = df.repartition(*VARIANT_PARTS, F.pmod(F.xxhash64(key), F.lit(files)))
    df.write.mode("overwrite").partitionBy(*VARIANT_PARTS).parquet(root)
    return root


def read_variants(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """A3 source: the stored table; ``select_variant`` on it reads the chosen folders only."""
    return spark.read.schema(schema).parquet(root)


def write_snapshot(df: DataFrame, root: str, name: str, epoch: int) -> str:
    """A4: write dataset ``name`` for ``epoch``, replacing only that partition."""
    (df.withColumn("name", F.lit(name)).withColumn("epoch", F.lit(int(epoch)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("name", "epoch").parquet(root))
    return root


def read_snapshot(spark: SparkSession, root: str, name: str, epoch: int | None = None) -> DataFrame:
    df = spark.read.parquet(root).filter(F.col("name") == name)
    if epoch is not None:
        df = df.filter(F.col("epoch") == epoch)
    return df


def append_ledger(spark: SparkSession, path: str, rows_df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """A5: append rows to a metric ledger (created on first write) and return the ledger."""
    if schema is not None:
        rows_df = rows_df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    rows_df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def resume_unscored(input_df: DataFrame, log_df: DataFrame, key: str = "idx") -> DataFrame:
    """Rows not yet scored by an interrupted run (anti-join on the key, not row count)."""
    return input_df.join(log_df.select(key), key, "left_anti")


def snapshot_epochs(spark: SparkSession, root: str, name: str | None = None) -> list[int]:
    """Epochs of the snapshots below ``root``, by the names of their folders: no file is read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/name={name if name is not None else '*'}/epoch=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted({int(f.getPath().getName().split("=", 1)[1]) for f in found or []})


def resume_epoch(spark: SparkSession, root: str, start_epoch: int, name: str | None = None) -> tuple[int, DataFrame]:
    """The last finished snapshot below ``start_epoch``: (epoch, rows); -1 and no rows where there is none."""
    epochs = [e for e in snapshot_epochs(spark, root, name) if e < start_epoch]
    snaps = spark.read.parquet(root)
    if name is not None:
        snaps = snaps.filter(F.col("name") == name)
    return (epochs[-1], snaps.filter(F.col("epoch") == epochs[-1])) if epochs else (-1, snaps.limit(0))


def prune_snapshots(spark: SparkSession, root: str, name: str, keep: int = 2) -> list[int]:
    """A4: delete all but the last ``keep`` epochs of a snapshot; returns the epochs deleted."""
    old = snapshot_epochs(spark, root, name)[:-keep] if keep else snapshot_epochs(spark, root, name)
    for e in old:
        drop_path(spark, f"{root}/name={name}/epoch={e}")
    return old


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    from maskloom.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
