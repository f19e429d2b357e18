"""Learned operators against direct computations: the quadratic discriminant (8) and the decision list (4)."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import qda, quality_rules
from maskloom.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def vector(text):
    """The statistics of one text, one after the other."""
    raw = (text or "").encode()
    words = [w.lower() for w in WORD.findall(raw)]
    n, solid = len(words), max(sum(map(len, words)), 1)
    share = lambda chars: math.sqrt(sum(c in chars for c in raw) / solid)
    marks = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>!?"]
    pairs = Counter(zip(words, words[1:]))
    per_word = lambda x: math.sqrt(x / max(n, 1))
    return [math.log1p(n), math.log1p(len(raw)), math.log1p(sum(map(len, words)) / max(n, 1)), share(range(65, 91)), share(range(48, 58)),
            share(b"#*$%&|<>"), share(b"!?"), share(marks), share(range(128, 256)), per_word(raw.count(b"\n")), per_word(len(set(words))),
            per_word(sum(a == b for a, b in zip(words, words[1:]))), per_word(sum(k - 1 for k in pairs.values()))]


def test_discriminant_equals_direct_computation(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r["score"] for r in qda.score(docs, labels).collect()}
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5).alias("held")).collect()
    x = {r["doc_id"]: np.array(vector(r["text"])) for r in rows}
    held = {r["doc_id"] for r in rows if r["held"]}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    parts = {c: np.array([x[i] for i in y if y[i] == c and i in x and i not in held]) for c in (0, 1)}
    total, d = sum(map(len, parts.values())), len(qda.NAMES)
    cov = {c: np.cov(p.T, bias=True) for c, p in parts.items()}
    pooled = sum(len(parts[c]) / total * cov[c] for c in cov)
    logs = {}
    for c, p in parts.items():
        s = 0.98 * (0.9 * cov[c] + 0.1 * pooled) + 0.02 * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        inverse, (_, log_det) = np.linalg.inv(s), np.linalg.slogdet(s)
        gap = {i: v - p.mean(0) for i, v in x.items()}
        logs[c] = {i: math.log(len(p) / total) - 0.5 * g @ inverse @ g - 0.5 * log_det for i, g in gap.items()}
    for i in x:
        want = 1 / (1 + math.exp(-np.clip(logs[1][i] - logs[0][i], -500, 500)))
        assert got[i] == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def stats(spark):
    docs = table(spark, SF, "documents")
    return quality_rules.text_stats(docs, ["doc_id"]).cache()


def gain(rows, holds):
    p, n = sum(r["bad"] for r in rows), sum(1 - r["bad"] for r in rows)
    cp = sum(r["bad"] for r in rows if holds(r))
    cn = sum(1 - r["bad"] for r in rows if holds(r))
    return (cp * (math.log2(cp / (cp + cn)) - math.log2(p / (p + n))) if cp and p and n else 0.0), cn


def test_decision_list_equals_plain_search(spark, stats):
    labels = table(spark, SF, "labels")
    # a label that the statistics do not tell alone, with some noise
    made = quality_rules.with_features(stats).select("doc_id", F.when(
        (F.col("n_words") > 200) & (F.xxhash64("doc_id") % 10 != 0), 0).otherwise(1).alias("quality"))
    for marks in (labels, made):
        rules = quality_rules.learn_rules(stats, marks, max_rules=3)
        left = [r.asDict() for r in quality_rules.with_features(stats.where(~quality_rules.base_failed())).join(
            marks.where("quality in (0, 1)").select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").withColumn(
                "prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()]
        grow, prune = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        at = [k / quality_rules.CUTS for k in range(1, quality_rules.CUTS)]
        frame = spark.createDataFrame([[float(r[f]) for f in quality_rules.FEATURES] for r in grow], list(quality_rules.FEATURES))
        got = frame.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in quality_rules.FEATURES]).first()
        cuts = {f: sorted(set(got[f])) for f in quality_rules.FEATURES}
        holds = lambda r, rule: all((r[f] > c) == above for f, above, c in rule)
        want = []
        while len(want) < 3:
            rule, rows = [], [r for r in grow if not any(holds(r, w) for w in want)]
            rows_left = rows
            while len(rule) < 4:
                best, cond, cn = 0.0, None, 0
                for f in quality_rules.FEATURES:
                    for c in cuts[f]:
                        for above in (False, True):
                            g, n = gain(rows_left, lambda r: (r[f] > c) == above)
                            if g > best + 1e-9:
                                best, cond, cn = g, (f, above, c), n
                if cond is None:
                    break
                rule.append(cond)
                rows_left = [r for r in rows_left if holds(r, [cond])]
                if cn == 0:
                    break
            if not rule:
                break
            free = [r for r in prune if not any(holds(r, w) for w in want)]
            worth = []
            for k in range(1, len(rule) + 1):
                hit = [r["bad"] for r in free if holds(r, rule[:k])]
                p, n = sum(hit), len(hit) - sum(hit)
                worth.append(((p - n) / max(1, p + n), -k, p, n))
            _, k, p, n = max(worth)
            if p < 10 or p < 0.95 * (p + n):
                break
            want.append(rule[:-k])
        assert [[(c.feature, c.above, pytest.approx(c.cut)) for c in r] for r in rules] == want
