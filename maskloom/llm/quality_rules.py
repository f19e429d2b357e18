"""Operator 4: quality rules as a learned decision list, on DataFrame functions alone.

``text_stats`` computes the statistics of one text inside its own row.
``learn_rules`` runs sequential covering over labelled statistics: a rule grows
by the threshold condition of highest information gain on two thirds of the
rows, is pruned on the other third, and its rows are then removed. Only
histograms (features x cuts x labels) and rule counts reach the driver.
``rule_expression`` turns the ordered rules into one ``CASE WHEN``.

Nulls and edges: a null text has no words, and fails the base rule. A null
label, a label of an unknown document or a null id takes no part in learning.
Repeated rows count as often as they stand. With no labels, or one class only,
the list is empty and the base rule decides alone. Columns of the input other
than the id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.masks import pin_columns
from maskloom.llm.common import drop_saved, save

WORD = r"[^\x20\x09-\x0D]+"
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
CUTS = 32


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus the statistics of each whole text, computed inside the row (no shuffle, no Python)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*keep, body.alias("_body"))
    out = out.withColumn("_words", F.regexp_extract_all("_body", F.lit(WORD), F.lit(0)))
    out = out.withColumn("_lines", F.filter(F.split("_body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    out = out.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_body", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_body", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct_words"),
        F.zip_with(F.zip_with("_hashes", F.slice("_hashes", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)),
                   F.slice("_hashes", 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias("_padded"))
    # zip_with pads the shorter side, so the last two entries are no windows
    out = out.withColumn("_windows", F.slice("_padded", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")))
    out = out.withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    out = out.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
                       lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(0).cast("long"))
    # pinned, or a filter on one statistic would be pushed below all of them and compute them again
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_marks", "n_distinct_words",
             "n_repeat_words"]
    return pin_columns(out.select(*keep, *stats), **{c: F.col(c) for c in stats})


def base_failed() -> Column:
    """The fixed rule: fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in FEATURES.items()})


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    at = [k / CUTS for k in range(1, CUTS)]
    got = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Rows of each label in each interval between cuts, for every feature, in one aggregation."""
    def interval(f: str) -> Column:
        edges = F.array(*[F.lit(c) for c in cuts[f]]) if cuts[f] else F.array().cast("array<double>")
        return F.size(F.filter(edges, lambda e: F.col(f) > e))

    bins = [F.struct(F.lit(k).alias("f"), interval(f).alias("b")) for k, f in enumerate(FEATURES)]
    got = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    names = list(FEATURES)
    for r in got:
        out[names[r["f"]]][r["b"]] = [int(r["p"]), int(r["n"])]
    return out


def _best(hist: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    total_p = sum(p for p, _ in next(iter(hist.values())))
    total_n = sum(n for _, n in next(iter(hist.values())))
    best: tuple[float, Condition | None, int, int] = (0.0, None, total_p, total_n)
    if not total_p or not total_n:
        return best
    before = math.log2(total_p / (total_p + total_n))
    for f, rows in hist.items():
        p = n = 0
        for cut, (bp, bn) in zip(cuts[f], rows):
            p, n = p + bp, n + bn
            for above, cp, cn in ((False, p, n), (True, total_p - p, total_n - n)):
                if cp:
                    gain = cp * (math.log2(cp / (cp + cn)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, cut), cp, cn)
    return best


def learn_rules(stats: DataFrame, labels: DataFrame, *, max_rules: int = 8, max_conditions: int = 4,
                min_precision: float = 0.95, min_covered: int = 10) -> list[list[Condition]]:
    """Ordered rules that reject (label quality 0), from statistics with ``doc_id`` and labels (doc_id, quality).

    A rule is taken while it covers ``min_covered`` bad rows and keeps ``min_precision`` on the pruning rows.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").alias("_id"), (1 - F.col("quality")).cast("int").alias("bad"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    # the base rule decides first, so the list learns on what it leaves
    table = save(with_features(stats.where(~base_failed())).join(marks, F.col("doc_id") == F.col("_id")).select(
        "bad", (fold == 0).alias("prune"), *FEATURES), "rule-rows")
    grow_rows, prune_rows = table.where("not prune"), table.where("prune")
    cuts, rules, covered = _cuts(grow_rows), [], F.lit(False)
    while len(rules) < max_rules:
        rule: list[Condition] = []
        left = grow_rows.where(~covered)
        while len(rule) < max_conditions:
            gain, cond, p, n = _best(_histogram(left.where(_holds(rule)), cuts), cuts)
            if cond is None:
                break
            rule.append(cond)
            if n == 0:
                break
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        got = prune_rows.where(~covered).agg(*[
            F.coalesce(F.sum(F.when(_holds(h), x)), F.lit(0)).alias(f"{k}{i}")
            for i, h in enumerate(heads) for k, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"]), -i) for i in range(len(heads))]
        at = -max(worth)[1]
        p, n = got[f"p{at}"], got[f"n{at}"]
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(heads[at])
        covered = covered | _holds(heads[at])
    drop_saved(table)
    return rules


def rule_expression(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, from 1, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(_holds(rule), k) if out is None else out.when(_holds(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], **options) -> DataFrame:
    """``keep`` columns, statistics, ``base_failed``, ``rule`` (0: none) and ``kept`` for every row of ``docs``.

    ``keep`` names ``doc_id`` among others. The statistics are computed once and
    written to the shared folder; learning and judging both read them there.
    """
    stats = save(text_stats(docs, keep), "rule-stats")
    rules = learn_rules(stats.where("doc_id is not null"), labels, **options)
    out = with_features(stats).withColumn("base_failed", base_failed()).withColumn("rule", rule_expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judge(packed, labels, ["doc_id", "_row"], **options).where("kept").select("_row.*")
