"""The scoring stream resumes from its checkpoint: a second start adds nothing and keeps the output."""

from pyspark.sql import functions as F

from maskloom.operators.scoring import LengthRuleModel
from maskloom.sources import fixtures as FX
from maskloom.sources import io as IO
from maskloom.streaming.scoring_stream import stream_score

SF = "/root/testdata/sf0.001"


def test_stream_resume_is_idempotent(spark):
    schema = FX.table(spark, SF, "conversations").schema
    sink, ckpt = IO.scratch_path(spark, "sink"), IO.scratch_path(spark, "ckpt")

    def prepare(b):
        return b.select((F.col("conv_id") * (1 << 32) + F.col("turn")).cast("long").alias("idx"),
                        F.col("conv_id").cast("long").alias("group_id"), F.col("role").alias("label"), "text")

    for _ in range(2):
        q = stream_score(spark, SF, schema, sink, ckpt, lambda: LengthRuleModel(60), prepare=prepare,
                         glob="conversations.parquet")
        q.awaitTermination()
    out = spark.read.parquet(sink)
    n = FX.turns(spark, SF).count()
    assert out.count() == n
    assert out.select("idx").distinct().count() == n


def test_stream_scores_a_table_of_several_files(spark, tmp_path):
    from maskloom.plans.registry import QUERIES
    import maskloom.plans.catalog  # noqa: F401
    rows = spark.createDataFrame([(c, t, "user", "a b c") for c in range(5) for t in range(3)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["stream_score"](spark, str(tmp_path)).count() == 15
    rows.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["stream_score"](spark, f"{tmp_path}/none").count() == 0
