"""Batch scoring with a user-supplied model.

``mapInPandas`` loads the model once per task, feeds Arrow batches through it
in ``batch_size`` slices and emits (idx, group_id, label, pred). This is the
only place Python touches rows; everything around it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import LABEL_TAG, SENTINEL, parse_label, render_prompt, split_message


class LengthRuleModel:
    """Stand-in classifier for tests: long utterances are 'assistant', short ones 'user'."""

    def __init__(self, threshold: int = 60, long_label: str = "assistant", short_label: str = "user"):
        self.threshold, self.long_label, self.short_label = threshold, long_label, short_label

    def predict(self, texts: list[str]) -> list[str | None]:
        return [None if t is None else (self.long_label if len(t.split()) > self.threshold else self.short_label)
                for t in texts]


class RuleGenerator:
    """Stand-in generator: appends ``k. name`` after the prompt, chosen by message length."""

    def __init__(self, labels: list[str], threshold: int = 60, long_label: str = "assistant",
                 short_label: str = "user"):
        self.labels, self.threshold = labels, threshold
        self.long_label, self.short_label = long_label, short_label

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            msg = p.split("### Message: ", 1)[-1].split(" <|eot_id|>", 1)[0]
            lab = self.long_label if len(msg.split()) > self.threshold else self.short_label
            out.append(f"{p}{self.labels.index(lab) + 1}. {lab}")
        return out


def _batches(pdf: pd.DataFrame, size: int):
    for start in range(0, len(pdf), size):
        yield pdf.iloc[start:start + size]


def score_batches(df: DataFrame, load_model: Callable[[], object], batch_size: int = 64,
                  text: str = "text", keep: tuple[str, ...] = ("idx", "group_id", "label")) -> DataFrame:
    """``pred`` for every row; null predictions become the sentinel.

    ``load_model`` runs once per task on the executor (not on the driver), so
    large models are never pickled per row.
    """
    cols = list(keep) + [text]
    fields = [f for f in df.select(*cols).schema.fields if f.name != text]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", pred string"

    def run(it):
        model = load_model()
        for pdf in it:
            for chunk in _batches(pdf, batch_size):
                preds = model.predict(chunk[text].tolist())
                out = chunk[list(keep)].copy()
                out["pred"] = [SENTINEL if p is None else p for p in preds]
                yield out

    return df.select(*cols).mapInPandas(run, schema)


def generate_and_parse(df: DataFrame, load_model: Callable[[], object], labels: list[str],
                       batch_size: int = 16, text: str = "text") -> DataFrame:
    """Prompt (C16, test form) -> completion (user model) -> label (C17).

    ``df`` carries idx, label and the ``:``-joined context text. Returns
    idx, label, output (the 100-char answer window) and pred.
    """
    msg, prior = split_message(F.col(text))
    prompts = df.select("idx", "label", render_prompt(prior, msg).alias("prompt"))

    def run(it):
        model = load_model()
        for pdf in it:
            for chunk in _batches(pdf, batch_size):
                out = chunk[["idx", "label"]].copy()
                out["completion"] = model.generate(chunk["prompt"].tolist())
                yield out

    gen = prompts.mapInPandas(run, "idx long, label string, completion string")
    c = F.col("completion")
    window = F.substring(c, F.locate(LABEL_TAG, c) + len(LABEL_TAG), 100)
    return gen.select("idx", "label", window.alias("output"), parse_label(c, LABEL_TAG, labels).alias("pred"))
