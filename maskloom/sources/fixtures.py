"""Views over the supplied parquet tables (FIXTURES.md §2).

Each view is a plain projection / join of the given tables, so the work grows
with the data, and each has a SQL twin in ``maskloom.plans.sqltext`` or a catalog module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.hashing import hkey, hunit
from maskloom.functions.text import DIALOGUE_LABELS, LABEL_TAG, squeeze_space, tokens
from maskloom.sources.io import natural_key

TURN_SPAN = 1 << 32  # idx = conv_id * TURN_SPAN + turn, checked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns: idx, group_id, turn, speaker, label, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        natural_key("conv_id", "turn", TURN_SPAN).alias("idx"),
        F.col("conv_id").cast("long").alias("group_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").alias("speaker"),
        F.col("role").alias("label"),
        F.col("text"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a learnable label (language)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("long").alias("idx"), F.col("source").alias("group_id"),
                    "text", F.col("lang").alias("label"))


def rule_pred(text) -> F.Column:
    """Fixture rule model: 'assistant' for long turns (> 60 tokens), else 'user'."""
    return F.when(F.size(tokens(squeeze_space(text))) > 60, F.lit("assistant")).otherwise(F.lit("user"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a rule prediction: idx, group_id, label, pred; a twentieth has none (null)."""
    t = turns(spark, sf_dir)
    pred = F.when(hunit(F.lit("nopred"), F.col("idx")) >= 0.05, rule_pred(F.col("text")))
    return t.select("idx", "group_id", "label", pred.alias("pred"))


def blank_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which a tenth is blank."""
    return turns(spark, sf_dir).withColumn("text", F.when(hunit(F.lit("blank"), F.col("idx")) < 0.1, F.lit(" ")).otherwise(F.col("text")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run epoch metrics derived from ``events`` (one run per user).

    epoch = rank of the event inside its user by (ts, event_id), computed with
    ``rank_within`` so one very active user does not land in a single task.
    """
    from maskloom.operators.filters import rank_within
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    e = rank_within(e, "user_id", ["ts", "event_id"], out="_epoch")
    return e.select(
        F.col("user_id").cast("long").alias("run_id"),
        F.col("_epoch").alias("epoch"),
        (F.col("value") / 100.0).alias("acc"),
        hunit(F.lit("f1"), F.col("event_id")).alias("f1"),
        (hunit(F.lit("mcc"), F.col("event_id")) * 2.0 - 1.0).alias("mcc"),
        F.col("event_type"),
    )


LR_GRID = [1e-4, 2e-4, 3e-4, 4e-4, 5e-4]
BATCH_GRID = [4, 8, 16]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ledger rows: model, lr, batch, trainFile, testFile, macro_f1, macro_mcc, acc, epoch."""
    h = history(spark, sf_dir)
    lr = F.element_at(F.array(*[F.lit(x) for x in LR_GRID]), (F.col("epoch") % 5 + 1).cast("int"))
    batch = F.element_at(F.array(*[F.lit(x) for x in BATCH_GRID]), (F.col("epoch") % 3 + 1).cast("int"))
    return h.select(
        "run_id",
        F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("model"),
        lr.alias("lr"), batch.cast("long").alias("batch"),
        F.lit("train").alias("trainFile"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("val")).otherwise(F.lit("test")).alias("testFile"),
        F.col("f1").alias("macro_f1"), F.col("mcc").alias("macro_mcc"), "acc", "epoch")


def gen_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model completions for parse tests: tag + label name, digit, neither, or no tag."""
    t = turns(spark, sf_dir)
    pick = F.conv(F.substring(hkey(F.lit("gen"), F.col("idx")), 1, 4), 16, 10).cast("long")
    lab = F.element_at(F.array(*[F.lit(x) for x in DIALOGUE_LABELS]), (pick % 6 + 1).cast("int"))
    digit = (F.floor(pick / 6) % 6 + 1).cast("string")
    head = F.col("text")
    kind = F.floor(pick / 36) % 4
    out = (F.when(kind == 0, F.concat(head, F.lit(" " + LABEL_TAG + " "), lab, F.lit(" it is")))
            .when(kind == 1, F.concat(head, F.lit(" " + LABEL_TAG + " "), digit, F.lit(".")))
            .when(kind == 2, F.concat(head, F.lit(" " + LABEL_TAG + " unsure")))
            .otherwise(F.concat(head, F.lit(" answer "), lab)))
    return t.select("idx", "label", out.alias("output"))


def ext_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External mask predictions: 3 words of the row plus 1 absent word; some null / sentinel."""
    from maskloom.functions.text import strip_punct
    t = turns(spark, sf_dir)
    toks = tokens(squeeze_space(strip_punct(F.col("text"))))
    keyed = F.transform(toks, lambda w, i: F.struct(hkey(F.lit("ext"), F.col("idx"), i).alias("k"), w.alias("w")))
    picked = F.transform(F.slice(F.array_sort(keyed), 1, 3), lambda r: r["w"])
    words = F.array_join(F.concat(picked, F.array(F.lit("qqzz"))), " ")
    flag = F.substring(hkey(F.lit("extn"), F.col("idx")), 1, 1)
    pm = F.when(flag == "0", F.lit(None).cast("string")).when(flag == "1", F.lit("[M]")).otherwise(words)
    return t.select("idx", pm.alias("pred_mask"))


def colon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current turn prefixed by the two previous turns of the dialogue, joined by ':'.

    Turns are dense per dialogue, so the previous turns come from an equi-join on
    (group_id, turn - k): skew-proof, unlike a window over one huge dialogue.
    """
    t = turns(spark, sf_dir).select("idx", "group_id", "turn", "label", "text")
    p1 = t.select("group_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("t1"))
    p2 = t.select("group_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("t2"))
    j = t.join(p1, ["group_id", "turn"], "left").join(p2, ["group_id", "turn"], "left")
    return j.select("idx", "label", F.concat_ws(":", "t2", "t1", "text").alias("text"))


def memory0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory flags for turns: about half selected, part of those correct; null when unknown."""
    t = turns(spark, sf_dir)
    sel = hunit(F.lit("sel"), F.col("idx")) < 0.5
    cor = hunit(F.lit("cor"), F.col("idx")) < 0.6
    return t.select("idx", F.when(sel, F.lit(1)).alias("selected"),
                    F.when(sel, F.when(cor, F.lit(1)).otherwise(F.lit(0))).alias("correct"))


def variants(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("base", "dp", "rm")) -> DataFrame:
    """Dataset variant rows: base / dp / rm x fold 0-2 x seed 0-1 x epoch 0-2, split by E3 blocks.

    dp and rm rows carry 15% random masks seeded ``seed * 100 + epoch``; base
    rows are unmasked. Columns: variant, fold, seed, epoch, mask_pct, split, idx,
    group_id, clsInFeat, labels.
    """
    from maskloom.functions.masks import draw_masks
    from maskloom.functions.text import normalize_text, task_prefix
    from maskloom.operators.splits import group_blocks
    from maskloom.session import spread

    grid = ([("base", f, 0, 0, 0) for f in range(3)]
            + [("dp", f, s, e, 15) for f in range(3) for s in range(2) for e in range(3)]
            + [("rm", f, s, 0, 15) for f in range(3) for s in range(2)])
    grid = [g for g in grid if g[0] in kinds]
    # A mask depends on seed, epoch and rate only: drawn once, it serves every variant and fold that has it.
    uses: dict = {}
    for v, f, s, e, p in grid:
        uses.setdefault((s, e, p), []).append((v, f))
    masks = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(e).alias("epoch"), F.lit(p).alias("mask_pct"),
                               F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(f).alias("fold")) for v, f in vf]).alias("uses"))
                      for (s, e, p), vf in uses.items()])
    x = group_blocks(normalize_text(spread(turns(spark, sf_dir))), 3)
    # validation = the block after the test block (cyclic) inside the training part
    x = x.withColumn("_val", F.conv(F.substring(hkey(F.lit("vb"), F.col("group_id")), 1, 6), 16, 10).cast("long") % 2 == 0)
    x = x.select("idx", "group_id", "label", "text", "token_num", "_blk", "_val", F.inline(masks))
    k = F.floor(F.col("token_num") * (F.col("mask_pct") / 100.0)).cast("int")
    k = F.when(F.col("mask_pct") == 0, F.lit(0)).when((F.col("token_num") > 1) & (k == 0), F.lit(1)).otherwise(k)
    m = draw_masks(x.withColumn("_k", k), "text", "idx", F.col("_k"), F.col("seed") * 100 + F.col("epoch"), salt="pct")
    m = m.select("seed", "epoch", "mask_pct", "idx", "group_id", task_prefix(F.col("masked_sent")).alias("clsInFeat"),
                 F.col("label").alias("labels"), "_blk", "_val", F.inline("uses"))
    split = F.when(F.col("_blk") == F.col("fold"), F.lit("test")).when(F.col("_val"), F.lit("val")).otherwise(F.lit("train"))
    return m.select("variant", "fold", "seed", "epoch", "mask_pct", split.alias("split"), "idx", "group_id", "clsInFeat", "labels")
