"""Sources and sinks: numbering without keys, key bounds, stored variants, snapshots by folder."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.sources import fixtures as FX
from maskloom.sources import io as IO

SF = "/root/testdata/sf0.001"
COLS = {"text": "context", "label": "labels"}
CSV = T.StructType([T.StructField("labels", T.StringType()), T.StructField("context", T.StringType())])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark, fmt):
    """Several files of different sizes; some texts hold line ends."""
    path = IO.scratch_path(spark, f"numbered-{fmt}")
    rows = spark.range(1000).selectExpr("concat('l', id % 3) AS labels", "concat('text ', id, if(id % 7 = 0, '\\nmore', '')) AS context", "id")
    parts = rows.repartitionByRange(7, "id").sortWithinPartitions("id")
    for k, where in enumerate(("id < 10", "id between 10 and 700", "id > 700")):
        w = parts.where(where).drop("id").write.mode("append")
        w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.parquet(path)
    return path


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_rows_without_keys_are_numbered_by_file_and_place(spark, fmt):
    path = _files(spark, fmt)
    got = IO.load_utterances(spark, path, fmt, COLS, schema=CSV)
    assert "Python" not in _plan(got) and "ExistingRDD" not in _plan(got)
    rows = got.select("idx", "text").collect()
    assert sorted(r["idx"] for r in rows) == list(range(1000))
    reader = spark.read.schema(CSV).option("header", True).option("multiLine", True).option("escape", '"')
    files = sorted({r["f"] for r in spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").load(path).select(F.col("path").alias("f")).collect()})
    want = [r["context"] for f in files for r in (reader.csv(f) if fmt == "csv" else spark.read.parquet(f)).coalesce(1).collect()]
    assert [r["text"] for r in sorted(rows, key=lambda r: r["idx"])] == want
    # the same numbers whatever the tasks
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        again = IO.load_utterances(spark, path, fmt, COLS, schema=CSV).select("idx", "text")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_keys_outside_their_bounds_raise(spark):
    make = lambda g, t: spark.createDataFrame([(g, t)], "g long, t long").select(IO.natural_key("g", "t").alias("idx"))
    assert make(5, 7).first()["idx"] == 5 * 2**32 + 7 and make(-2**31, 0).first()["idx"] == -2**63
    assert make(2**31 - 1, 2**32 - 1).first()["idx"] == 2**63 - 1
    for g, t in ((2**31, 0), (1, 2**32), (1, -1), (None, 1), (1, None)):
        with pytest.raises(Exception, match="no key for group and turn"):
            make(g, t).collect()


def test_variants_are_read_by_folder(spark):
    rows = FX.variants(spark, SF)
    root = IO.write_variants(rows, IO.scratch_path(spark, "variants"), files=2)
    table = IO.read_variants(spark, root, rows.schema)
    assert sorted(map(str, table.select(sorted(rows.columns)).collect())) == sorted(map(str, rows.select(sorted(rows.columns)).collect()))
    for variant, options in (("base", dict(fold=1)), ("dp", dict(fold=1, seed=1, epoch=2)), ("rm", dict(fold=2, seed=0, mask_pct=15)),
                             ("cum", dict(fold=0, seed=1, epoch=1)), ("cum", dict(fold=0, seed=1, epoch=1, val_type="unmasked"))):
        one = IO.select_variant(table, variant, **options)
        filters = [x for x in _plan(one).split("PartitionFilters: ")[1].split("PushedFilters")[0:1]]
        assert "variant" in filters[0] and "fold" in filters[0]
        read = {r["f"].rsplit("/", 1)[0] for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
        assert 0 < len(read) < 12 and all("variant=" in f for f in read)


def test_snapshots_are_found_by_folder_and_pruned(spark):
    root = IO.scratch_path(spark, "snaps")
    for e in (0, 1, 2, 10):
        IO.write_snapshot(spark.range(e + 1), root, "smem", e)
    IO.write_snapshot(spark.range(4), root, "other", 7)
    assert IO.snapshot_epochs(spark, root, "smem") == [0, 1, 2, 10] and IO.snapshot_epochs(spark, root) == [0, 1, 2, 7, 10]
    epoch, rows = IO.resume_epoch(spark, root, 10, "smem")
    assert epoch == 2 and rows.count() == 3
    assert IO.resume_epoch(spark, root, 0, "smem")[0] == -1
    assert IO.prune_snapshots(spark, root, "smem", keep=2) == [0, 1] and IO.snapshot_epochs(spark, root, "smem") == [2, 10]
    assert IO.read_snapshot(spark, root, "smem", 10).count() == 11
