"""Driver loops.

Each step is a distributed job over the whole tables; only a handful of metric
rows per step come back to the driver (early stop, arg-max, cycle budget).
The state of the dual-process loop lies in the shared checkpoint folder: a
snapshot for each step, and a manifest with one row for each step that is
complete, written last. So every step starts from a short lineage, and a loop
that was ended goes on after its last complete step. No text lies there more
than once: snapshots name theirs by a hash, and only the newest memory has it beside its masks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions.hashing import hunit, seed_salt
from maskloom.functions.masks import pin_columns, replace_words, valid_mask
from maskloom.functions.text import parse_mask
from maskloom.operators import learners as L
from maskloom.operators import masking as M
from maskloom.operators import memory as MEM
from maskloom.operators import metrics as H
from maskloom.operators import splits as SP
from maskloom.operators import windows as W
from maskloom.sources import io as IO


def _eval_rows(scored: DataFrame, by: list[str]) -> DataFrame:
    """acc / macro-F1 (multiclass) / MCC per ``by`` group, one small frame."""
    acc = H.accuracy(scored, by).drop("n")
    f1 = H.macro_f1_multiclass(scored, by)
    mc = H.mcc(scored, by=by)
    return acc.join(f1, by).join(mc, by)


def grid_search(train: DataFrame, val: DataFrame, grid: list[tuple[float, int]]) -> DataFrame:
    """Every config of the grid trained in one job; best MCC wins (first config on ties)."""
    model = L.train_classifier(train, grid)
    # scored rows feed two aggregates (accuracy, MCC): materialize the predictions once
    scored = _pin(model.predict(val, carry=["label"]))
    acc = H.accuracy(scored, ["cfg"]).drop("n")
    mc = H.mcc(scored, by=["cfg"])
    g = L.grid_frame_col(grid)
    cfgs = val.sparkSession.range(1).select(F.explode(g).alias("g")).select("g.*")
    res = cfgs.join(acc, "cfg").join(mc, "cfg")
    # |grid| rows: a global window here is bounded by the grid size.
    rank = F.row_number().over(Window.orderBy(F.col("mcc").desc(), F.col("cfg")))
    return res.select("cfg", "alpha", "min_count", "acc", F.bround("mcc", 4).alias("mcc"),
                      (rank == 1).cast("int").alias("is_best"))


def _metrics_row(model: L.NaiveBayes, rows: DataFrame, feat: str, cfg: int = 0) -> dict:
    scored = _pin(model.predict(rows, text=feat, carry=["label"]).where(F.col("cfg") == cfg).withColumn("_g", F.lit(0)))
    r = _eval_rows(scored, ["_g"]).first()
    return {"acc": float(r["acc"]), "f1": float(r["macro_f1"]), "mcc": float(r["mcc"])}


def _log(*msg) -> None:
    import os
    import sys
    import time
    if os.environ.get("MASKLOOM_VERBOSE"):
        print(time.strftime("%H:%M:%S"), *msg, file=sys.stderr, flush=True)


def _stopped(spark: SparkSession, hist: list[dict], warmup: int, patience: int) -> tuple[bool, int]:
    return W.early_stop_rows([(d["epoch"], d["mcc"]) for d in hist], warmup, patience)


def _pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the cluster's checkpoint folder."""
    from maskloom.session import materialize
    return materialize(df)


def _release(spark: SparkSession) -> None:
    """Give back the shuffle files of finished plans."""
    from maskloom.session import release
    release(spark)


def grid_search_final(train: DataFrame, val: DataFrame, test: DataFrame, grid: list[tuple[float, int]],
                      seeds: tuple[int, ...] = (0, 1, 2), val_size: float = 0.2) -> DataFrame:
    """J4, second part: the best configuration of the grid, tested over seeds.

    For each seed the training and validation rows are split anew by that seed
    (E1), the best configuration is trained on its training part and tested on ``test``. One row:
    the configuration, and mean and population deviation of the metrics (H9).
    """
    best = grid_search(train, val, grid).where("is_best = 1").first()
    both, test = _pin(SP.train_val_union(train, val)), _pin(test)
    rows = []
    for seed in seeds:
        part = SP.random_split(both, val_size, seed).where("split = 'train'")
        model = L.train_classifier(part, [grid[best["cfg"]]])
        r = _metrics_row(model, test, "text")
        rows.append((best["cfg"], best["alpha"], best["min_count"], r["acc"], r["f1"], r["mcc"]))
    ledger = train.sparkSession.createDataFrame(rows, "cfg int, alpha double, min_count int, acc double, macro_f1 double, macro_mcc double")
    return H.seed_summary(ledger, ["cfg", "alpha", "min_count"])


def mask_rate_search(train: DataFrame, test: DataFrame, rates: list[float], epochs: int = 3,
                     patience: int = 1, warmup: int = 0, rand_seed: int = 0, seeds: tuple[int, ...] = (0,),
                     mask_val: bool = False) -> DataFrame:
    """Random-mask rate search with early stop per rate (Q10), then per-seed final test.

    The classifier at epoch j is trained on the masked copies of epochs 0..j
    (each epoch re-masks with the E7 seed schedule), which is the closed-form
    counterpart of continuing to train on freshly masked data. Token counts add
    up, so an epoch counts its own copies only and merges them into the counts so far.
    The rates go epoch by epoch together: their masks are prefixes of the same draws, their models configs of one.
    """
    spark = train.sparkSession
    val = _pin(train.filter(hunit(F.lit("val"), F.col("idx")) < 0.2))
    fit = _pin(train.filter(hunit(F.lit("val"), F.col("idx")) >= 0.2))
    test = _pin(test)
    labels = L.count_labels(fit)
    rows = []

    def run(rates, seed_base):
        """All rates epoch by epoch: (history, (model, its config), early-stop epoch) for each."""
        counts, models, found = None, [], {}
        hists = {i: [] for i in range(len(rates))}
        for j in range(epochs):
            copies = M.mask_percent_each(fit, rates, seed_salt(j, seed_base))
            new = L.count_copies(copies, "masked_sents", len(rates), labels)
            counts = new if counts is None else L.merge_counts(counts, new)
            models.append(L.classifier_from_counts(counts))
            if mask_val:
                parts = [models[-1].predict(M.mask_percent(val, rates[i], seed_salt(j, seed_base) + 7), text="masked_sent", carry=["label"])
                         .where(F.col("cfg") == i) for i in hists if i not in found]
                scored = parts[0]
                for p in parts[1:]:
                    scored = scored.unionByName(p)
            else:
                scored = models[-1].predict(val, carry=["label"])
            metrics = {r["cfg"]: r for r in _eval_rows(_pin(scored), ["cfg"]).collect()}  # a row a rate
            for i, hist in hists.items():
                if i in found:
                    continue
                r = metrics[i]
                hist.append(dict(epoch=j, acc=float(r["acc"]), f1=float(r["macro_f1"]), mcc=float(r["mcc"])))
                _log("rate", rates[i], "epoch", j, hist[-1])
                if j >= warmup:
                    stopped, es = _stopped(spark, hist, warmup, patience)
                    if stopped:
                        found[i] = hist, (models[es], i), es
            if len(found) == len(rates):
                break
        return [found.get(i, (hist, (models[-1], i), hist[-1]["epoch"])) for i, hist in hists.items()]

    found = dict(zip(rates, run(rates, rand_seed)))
    for rate in rates:
        rows += [("search", float(rate), d["epoch"], rand_seed, d["acc"], d["f1"], d["mcc"]) for d in found[rate][0]]
    best = max(range(len(rows)), key=lambda k: (rows[k][6], -k))
    best_rate = rows[best][1]
    for seed in seeds:
        # the model of the early-stop epoch, evaluated on the (unmasked) test split; the search's own seed is trained already
        _, (model, cfg), es = found[best_rate] if seed == rand_seed else run([best_rate], seed)[0]
        r = _metrics_row(model, test, "text", cfg)
        rows.append(("final", float(best_rate), es, seed, r["acc"], r["f1"], r["mcc"]))
    return spark.createDataFrame(rows, "phase string, rate double, epoch long, seed long, acc double, "
                                       "f1 double, mcc double")


# ---------------------------------------------------------------- J6

@dataclass
class DualProcessConfig:
    end_epoch: int = 5
    repeat_r: int = 2
    patience: int = 1
    warmup: int = 1
    pct: float = 0.15
    val_size: float = 0.2
    rand_seed: int = 0
    mask_test: bool = False
    split_mode: str = "random"       # or "byGroup"
    literal_q8: bool = False
    r_rate: float = 1.0              # share of the reflective training rows that one cycle's masker learns from
    root: str | None = None          # a folder with a manifest is resumed


@dataclass
class DualProcessResult:
    ledger: DataFrame            # kind (val, test), epoch, acc, f1, mcc
    memory_root: str             # snapshots by epoch and step; ``read_memory`` gives one with its texts
    best_epoch: int
    memory_log: DataFrame | None  # G4 by epoch and cycle
    mask_log: DataFrame | None    # F9 by epoch and step


@dataclass
class Step:
    """One row of the manifest: a step that is complete."""

    epoch: int
    name: str                    # init, cycle, final, test
    cycle: int
    budget: int                  # cycles that an epoch may run after this step
    stopped: bool                # the cycle stop ended the epoch here
    acc: float | None = None
    f1: float | None = None
    mcc: float | None = None


_MANIFEST = ("seq long, epoch long, name string, cycle long, budget long, stopped boolean, acc double, f1 double, mcc double, "
             "config string")


def next_step(done: list[Step], cfg: DualProcessConfig) -> tuple[int, str, int] | None:
    """(epoch, name, cycle) of the step after those that are done; None at the end. The whole control flow of the loop.

    Epochs 0 and 1 start with a new memory, epoch 0 has no cycles. An epoch runs
    the cycles that its budget allowed when it began, unless the cycle stop ends it. From the
    warm-up on, an early stop or the last epoch leads to the test.
    """
    if not done:
        return 0, "init", 0
    last = done[-1]
    if last.name == "test":
        return None
    if last.name == "init":
        return (0, "final", 0) if last.epoch == 0 else (last.epoch, "cycle", 0)
    if last.name == "cycle":
        before = [s for s in done if not (s.epoch == last.epoch and s.name == "cycle")]
        allowed = before[-1].budget
        more = not last.stopped and last.cycle + 1 < allowed
        return (last.epoch, "cycle", last.cycle + 1) if more else (last.epoch, "final", 0)
    if last.epoch >= cfg.warmup and (_final_epoch(done, cfg)[0] or last.epoch == cfg.end_epoch - 1):
        return _final_epoch(done, cfg)[1], "test", 0
    if last.epoch == cfg.end_epoch - 1:
        return None
    return (1, "init", 0) if last.epoch == 0 else (last.epoch + 1, "cycle", 0)


def _final_epoch(done: list[Step], cfg: DualProcessConfig) -> tuple[bool, int]:
    """(early stop, epoch of the final model): the early-stop epoch, or else the one of largest mcc (the first of equal ones)."""
    hist = [(s.epoch, s.mcc) for s in done if s.name == "final"]
    stopped, es = W.early_stop_rows(hist, cfg.warmup, cfg.patience)
    return stopped, es if stopped else max(hist, key=lambda x: (x[1], -x[0]))[0]


#: How the folder is laid out: a loop of another layout is not gone on with.
_LAYOUT = 2


def _without_masked(df: DataFrame) -> DataFrame:
    """The rows without ``masked_sent``, which is ``text`` with ``mask_words`` masked; of rows without a text it stays as ``_sent``."""
    return df.withColumn("_sent", F.when(F.col("text").isNull(), F.col("masked_sent"))).drop("masked_sent")


def _with_masked(df: DataFrame) -> DataFrame:
    j = replace_words(df, "text", "mask_words", "masked_sent")
    return j.withColumn("masked_sent", F.coalesce("masked_sent", "_sent")).drop("_sent")


def read_memory(spark: SparkSession, memory_root: str, train: DataFrame, epoch: int, step: str) -> DataFrame:
    """The memory after a step of a loop over ``train``, with its texts and masked texts.

    A snapshot has a row's ``idx`` and the hash of its text, so that rows of one ``idx`` get the text that is theirs.
    """
    snapshot = spark.read.parquet(f"{memory_root}/epoch={epoch}/step={step}")
    texts = train.select(F.col("idx").alias("_idx"), F.xxhash64("text").alias("_key"), "text").dropDuplicates(["_idx", "_key"])
    whole = snapshot.join(texts, F.col("idx").eqNullSafe(F.col("_idx")) & (F.col("text_key") == F.col("_key")))
    return _with_masked(whole.drop("_idx", "_key", "text_key"))


class _Store:
    """The loop's folder: snapshots and logs by epoch and step, and the manifest that says which of them are complete.

    ``smem`` has the memory after every step, without texts; ``state`` the newest one with them, which the next step reads. What
    only the step itself reads again (``remasked``, ``val``) goes when it is complete.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: DualProcessConfig, train: DataFrame):
        self.spark, self.root, self.train = spark, root, train
        self.config = json.dumps({k: v for k, v in asdict(cfg).items() if k != "root"} | {"layout": _LAYOUT}, sort_keys=True)
        self.done: list[Step] = []
        if IO.path_exists(spark, f"{root}/manifest"):
            rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").orderBy("seq").collect()  # a row a step
            if any(r["config"] != self.config for r in rows):
                raise ValueError(f"{root} holds a loop with another configuration")
            self.done = [Step(*[r[f] for f in Step.__dataclass_fields__]) for r in rows]

    def put(self, df: DataFrame, kind: str, epoch: int, step: str) -> DataFrame:
        """Write (again, if a step was ended midway) and read back."""
        schema, path = df.schema, f"{self.root}/{kind}/epoch={epoch}/step={step}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def get(self, kind: str, epoch: int, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/epoch={epoch}/step={step}")

    def put_masked(self, df: DataFrame, kind: str, epoch: int, step: str) -> DataFrame:
        """``put`` for rows with a mask: their masked texts are made anew from text and mask as they are read."""
        return _with_masked(self.put(_without_masked(df), kind, epoch, step)).select(df.columns)

    def put_memory(self, df: DataFrame, epoch: int, step: str) -> DataFrame:
        memory = self.put_masked(df, "state", epoch, step)
        self.put(self.get("state", epoch, step).withColumn("text_key", F.xxhash64("text")).drop("text"), "smem", epoch, step)
        return memory

    def get_memory(self, epoch: int, step: str) -> DataFrame:
        if IO.path_exists(self.spark, f"{self.root}/state/epoch={epoch}/step={step}/_SUCCESS"):
            return _with_masked(self.get("state", epoch, step))
        return read_memory(self.spark, f"{self.root}/smem", self.train, epoch, step)

    def _last(self) -> tuple[int, str]:
        """The last complete step that wrote a memory (epoch 0's final step leaves it as it is)."""
        last = [s for s in self.done if s.name != "test" and not (s.name == "final" and s.epoch == 0)][-1]
        return last.epoch, f"cycle-{last.cycle}" if last.name == "cycle" else last.name

    def memory(self) -> DataFrame:
        return self.get_memory(*self._last())

    def drop_states(self, but: tuple[int, str] | None = None) -> None:
        """Delete the memories with texts: any of them can be made again from its snapshot."""
        if but is None:
            return IO.drop_path(self.spark, f"{self.root}/state")
        for e in {s.epoch for s in self.done}:
            for name in ("init", "final", *(f"cycle-{s.cycle}" for s in self.done if s.epoch == e and s.name == "cycle")):
                if (e, name) != but:
                    IO.drop_path(self.spark, f"{self.root}/state/epoch={e}/step={name}")

    def commit(self, step: Step) -> None:
        row = [(len(self.done), *[getattr(step, f) for f in Step.__dataclass_fields__], self.config)]
        IO.append_ledger(self.spark, f"{self.root}/manifest", self.spark.createDataFrame(row, _MANIFEST).coalesce(1))
        self.done.append(step)
        for kind in ("remasked", "val"):
            IO.drop_path(self.spark, f"{self.root}/{kind}")
        self.drop_states(self._last())
        _release(self.spark)


def _remask(df: DataFrame, masker: L.TokenMasker, pct: float) -> DataFrame:
    """Replace each row's mask by the masker's valid prediction (F10 semantics); ``masker_words`` keeps the prediction."""
    keep = [c for c in df.columns if c not in ("idx", "mask_words", "masked_sent", "mask_size", "pred_words")]
    source = df.withColumnRenamed("pred_words", "_pred_words") if "pred_words" in df.columns else df
    extra = ["_pred_words"] if "pred_words" in df.columns else []
    j = masker.predict(source, pct, carry=keep + extra).withColumnRenamed("pred_words", "masker_words")
    j = pin_columns(j, mask_words=valid_mask(F.col("text"), F.col("masker_words")))
    j = replace_words(j, "text", "mask_words", "masked_sent").withColumn("mask_size", F.size("mask_words").cast("long"))
    if extra:
        j = j.withColumnRenamed("_pred_words", "pred_words")
    return j.select(*df.columns, *[c for c in ("mask_words", "masked_sent", "mask_size", "masker_words") if c not in df.columns])


def dual_process_loop(spark: SparkSession, train: DataFrame, test: DataFrame, cfg: DualProcessConfig,
                      on_step: Callable[[Step], None] | None = None, stored: bool = False) -> DualProcessResult:
    """The dual-process masking loop as a sequence of Spark jobs, resumable after every step.

    ``train`` / ``test``: normalized utterances (idx, group_id, label, text, token_num); with ``stored`` they are read from written
    tables, of which the loop needs no copy of its own. Returns the per-epoch ledger (acc, f1, mcc of the I-classifier on masked
    validation rows, plus the final test row), the memory snapshots and the logs.

    A step writes its snapshot and logs, then its row of the manifest; only then
    it counts. Called again with the same ``cfg.root`` the loop goes on after the last
    such row; what an ended step left is written again. ``on_step`` is called after each row.
    The final model is that of the early-stop epoch, or of the epoch of largest mcc. With
    ``mask_test`` the test rows are masked by that epoch's masker (epoch 0 has none: they stay as they are).
    """
    root = cfg.root or IO.scratch_path(spark, "dual-process")
    pin = (lambda df: df) if stored else _pin
    i_val = pin(train.filter(hunit(F.lit("ival"), F.col("idx")) < cfg.val_size))
    i_train = pin(train.filter(hunit(F.lit("ival"), F.col("idx")) >= cfg.val_size))
    test = pin(test)
    store = _Store(spark, root, cfg, i_train)

    def init(epoch, _):
        masked = M.mask_percent(i_train, cfg.pct, seed_salt(epoch, cfg.rand_seed))
        store.put_memory(MEM.memory_init(masked), epoch, "init")
        return Step(epoch, "init", 0, store.done[-1].budget if store.done else max(1, cfg.repeat_r), False)

    def cycle(epoch, r):
        seed, memory = f"{seed_salt(epoch, cfg.rand_seed)}-{r}", store.memory()
        ids = memory.select("idx", "group_id")
        cut = SP.group_split if cfg.split_mode == "byGroup" else SP.random_split
        split = cut(ids, cfg.val_size, seed)
        if epoch > 1:
            split = SP.swap_unselected(split, memory, seed=seed, literal_q8=cfg.literal_q8)
        split = _pin(split.select("idx", "split"))
        r_train, r_val = (split.filter(F.col("split") == x).select("idx") for x in ("train", "val"))
        known = M.masker_train_set(memory, r_train, seed, rate=cfg.r_rate, chunk=r)
        known = known.select("idx", F.regexp_replace("text", "^Mask: ", "").alias("text"), parse_mask("masked_word").alias("mask_words"))
        masker = L.train_masker(known)
        _release(spark)
        masked = store.put_masked(_remask(memory, masker, cfg.pct), "remasked", epoch, f"cycle-{r}")
        store.drop_states()
        _release(spark)
        store.put(M.mask_stats(masked.withColumn("dataName", F.lit("r_masker_smem")), ["dataName"], "masker_words", "mask_words"),
                  "mask_log", epoch, f"cycle-{r}")
        memory = masked.drop("masker_words")
        cls = L.train_classifier(memory.join(r_train, "idx", "left_semi"), text="masked_sent")
        rv = memory.join(r_val, "idx", "left_semi")
        scored = _pin(cls.predict(rv, text="masked_sent", carry=["label"]).drop("cfg"))
        judged = _pin(MEM.judge_masks(scored, rv))
        mcc = float(H.mcc(scored).first()["mcc"] or 0.0)
        _release(spark)
        updated = store.put_memory(MEM.memory_update(memory, judged), epoch, f"cycle-{r}")
        store.put(MEM.memory_stats(updated, judged), "memory_log", epoch, f"cycle-{r}")
        before = [s.mcc for s in store.done if s.epoch == epoch and s.name == "cycle"]
        budget = store.done[-1].budget
        stopped = budget > 1 and r > 0 and before[-1] > mcc
        return Step(epoch, "cycle", r, budget - stopped, stopped, mcc=mcc)

    def final(epoch, _):
        memory, val = store.memory(), M.mask_percent(i_val, cfg.pct, seed_salt(epoch, cfg.rand_seed) + 50)
        if epoch >= 1:
            masker = L.train_masker(memory)
            store.put(masker.scores, "masker", epoch, "final")
            masked = store.put_masked(_remask(memory, masker, cfg.pct), "remasked", epoch, "final")
            store.drop_states()
            _release(spark)
            masked_val = store.put_masked(_remask(val, masker, cfg.pct), "val", epoch, "final")
            both = masked.select(F.lit("i_masker_smem").alias("dataName"), "masker_words", "mask_words", "token_num").unionByName(
                masked_val.select(F.lit("i_masker_val").alias("dataName"), "masker_words", "mask_words", "token_num"))
            store.put(M.mask_stats(both, ["dataName"], "masker_words", "mask_words"), "mask_log", epoch, "final")
            memory, val = store.put_memory(masked.drop("masker_words"), epoch, "final"), masked_val
        cls = L.train_classifier(memory, text="masked_sent")
        return Step(epoch, "final", 0, store.done[-1].budget, False, **_metrics_row(cls, val, "masked_sent"))

    def final_test(epoch, _):
        model = L.train_classifier(store.get_memory(epoch, "final" if epoch else "init"), text="masked_sent")
        rows, feat = test, "text"
        if cfg.mask_test and epoch:
            rows, feat = _remask(test, L.TokenMasker(store.get("masker", epoch, "final"), 0.5, 1.0), cfg.pct), "masked_sent"
        return Step(epoch, "test", 0, store.done[-1].budget, False, **_metrics_row(model, rows, feat))

    run = {"init": init, "cycle": cycle, "final": final, "test": final_test}
    while (step := next_step(store.done, cfg)) is not None:
        epoch, name, r = step
        store.commit(run[name](epoch, r))
        _log(store.done[-1])
        if on_step:
            on_step(store.done[-1])
    kind = {"final": "val", "test": "test"}
    ledger = spark.createDataFrame([(kind[s.name], s.epoch, s.acc, s.f1, s.mcc) for s in store.done if s.name in kind],
                                   "kind string, epoch long, acc double, f1 double, mcc double")
    logs = [spark.read.parquet(f"{root}/{x}") if IO.path_exists(spark, f"{root}/{x}") else None for x in ("memory_log", "mask_log")]
    return DualProcessResult(ledger, f"{root}/smem", _final_epoch(store.done, cfg)[1], *logs)
