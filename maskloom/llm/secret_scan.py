"""Operator 7: secret scans with character Markov models, on DataFrame functions alone.

Fixed patterns give the base spans. Candidate strings, all runs of 12 or more key
characters, are scored by two first-order character Markov models,
one of random strings and one of ordinary identifiers; a log-likelihood ratio
per character over the threshold adds a span of kind ``markov``.

Labelled samples: the values inside base spans are the random strings; words
of letters, names put together from words with marks between them, and lines of marks are the ordinary ones.
Both models are transition counts over all documents (96 x 96 states at most),
summed in Spark; only those counts reach the driver.

Nulls and edges: a null or empty text has no spans. Ties cannot arise, spans of
one kind never overlap. With no base span in the corpus no string is labelled
random, the ratio is undefined and no markov span is added. Repeated rows are
scanned each. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.masks import pin_columns

# Fixed patterns.
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the models judge: 12 or more key characters, the least length of an assigned value.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Ordinary samples for the second model: whole runs of 8 or more ASCII letters or marks, and words with marks between them.
ORDINARY = r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z]{8,}|[+/_=-]{8,}|[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)+)(?![A-Za-z0-9+/_=-])"
SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def spans_of(text: Column, pattern: str, kind: str, wanted: Column | None = None) -> Column:
    """Array of (kind, start, end, value) of the leftmost non-overlapping matches, from match and gap lengths; with
    ``wanted`` only of the matches in that array."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    empty = F.array().cast(SPANS)

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["h"])
        more = F.concat(acc["spans"], F.array(F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["h"].alias("value"))))
        spans = more if wanted is None else F.when(F.array_contains(wanted, x["h"]), more).otherwise(acc["spans"])
        return F.when(x["h"].isNull(), acc).otherwise(F.struct(end.alias("at"), spans.alias("spans")))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    some = text.rlike(pattern) if wanted is None else F.size(wanted) > 0
    return F.when(some, F.aggregate(steps, start, step, lambda a: a["spans"])).otherwise(empty)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with array columns ``assign``, ``access`` and ``hex`` of base spans (failing matches dropped)."""
    body = F.coalesce(F.col(text), F.lit(""))
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 12
    return pin_columns(docs, assign=F.filter(spans_of(body, ASSIGN, "assign"), long_value),
                       access=spans_of(body, ACCESS, "access"), hex=spans_of(body, HEX, "hex"))


def _pairs(rows: DataFrame, label: str) -> DataFrame:
    """Transition counts of a table of (value, n)."""
    at = F.sequence(F.lit(1), F.length("value") - 1)
    two = rows.where(F.length("value") >= 2).select("n", F.explode(F.transform(
        at, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    return two.groupBy("pair").agg(F.sum("n").alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def train(docs: DataFrame, text: str = "text") -> dict[str, float] | None:
    """Log ratio (random against ordinary) of each transition, from labelled strings of all documents."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = base_spans(docs.select(text), text)
    values = found.select(F.explode(F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 1)),
        F.transform(F.concat("access", "hex"), lambda s: s["value"]))).alias("value"), F.lit(1).alias("n"))
    words = docs.select(F.explode(F.regexp_extract_all(body, F.lit(ORDINARY), F.lit(0))).alias("value"))
    # each distinct word is one sample, so that one very common word cannot make the model
    words = words.groupBy("value").agg(F.lit(1).alias("n"))
    got = _pairs(values, "random").unionByName(_pairs(words, "ordinary")).collect()
    counts: dict[str, dict[str, int]] = {"random": {}, "ordinary": {}}
    for r in got:
        if set(r["pair"]) <= set(ALPHABET):
            counts[r["label"]][r["pair"]] = int(r["n"])
    if not counts["random"]:
        return None
    firsts = {k: {a: sum(c.get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for k, c in counts.items()}
    prob = lambda k, a, b: (counts[k].get(a + b, 0) + 0.5) / (firsts[k][a] + 0.5 * len(ALPHABET))
    return {a + b: math.log(prob("random", a, b) / prob("ordinary", a, b)) for a in ALPHABET for b in ALPHABET}


def _ratios(model: dict[str, float]) -> Column:
    """The model as one constant array, indexed by the two characters' places in the alphabet."""
    text = ",".join(f"{model[a + b]:.6g}" for a in ALPHABET for b in ALPHABET)
    return F.split(F.lit(text), ",").cast("array<double>")


def _pair_ratio(ratios: Column, pair: Column) -> Column:
    place = lambda c: F.position(c, F.lit(ALPHABET))
    return F.get(ratios, (place(F.substring(pair, 1, 1)) - 1) * len(ALPHABET) + place(F.substring(pair, 2, 1)) - 1)


def scan(docs: DataFrame, keep: list[str], *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, ``assign``, ``access``, ``hex`` and ``markov`` span arrays for every row of ``docs``."""
    model = train(docs, text)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    out = base_spans(source, "_body")
    empty = F.array().cast(SPANS)
    if model is None:
        return out.withColumn("markov", empty).drop("_body")
    # every different candidate of a text is judged once; only those found guilty are located
    out = pin_columns(out, **{c: F.col(c) for c in ("assign", "access", "hex")}, _ratios=_ratios(model), _strings=F.array_distinct(
        F.regexp_extract_all(F.col("_body"), F.lit(CANDIDATE), F.lit(0))))

    def guilty(value):
        pairs = F.sequence(F.lit(1), F.length(value) - 1)
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + _pair_ratio(F.col("_ratios"), F.substring(value, i, F.lit(2))))
        return total > F.lit(threshold) * (F.length(value) - 1)

    out = pin_columns(out, _guilty=F.filter("_strings", guilty))
    # a span that lies in a base span adds nothing
    base = F.concat("assign", "access", "hex")
    new = F.filter(spans_of(F.col("_body"), CANDIDATE, "markov", F.col("_guilty")), lambda s: ~F.exists(
        base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return out.withColumn("markov", new).drop("_body", "_strings", "_guilty", "_ratios")


def joined(*arrays: str) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""
    ranked = F.transform(F.concat(*arrays), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"),
        F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("line")))
    return F.array_join(F.transform(F.sort_array(ranked), lambda x: x["line"]), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mark``; overlapping spans become one. A null text stays null."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    out = scan(packed, ["_row"], **options)
    spans = F.sort_array(F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(acc["text"], (acc["at"] + 1).cast("int"),
                                               F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                       F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"), cut.alias("out"))

    clean = F.aggregate(F.col("_spans"), F.struct(F.col("_row.text").alias("text"), F.lit(0).cast("long").alias("at"),
                                                  F.lit("").alias("out")), step,
                        lambda a: F.concat(a["out"], F.substring(a["text"], (a["at"] + 1).cast("int"), F.length(a["text"]))))
    out = out.withColumn("_spans", spans).withColumn("_text", F.when(F.size("_spans") > 0, clean).otherwise(F.col("_row.text")))
    fields = []
    for c in docs.columns:
        if c == "text":
            fields.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            fields.append(F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(
                F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            fields.append(F.col("_row")[c].alias(c))
    return out.select(*fields)
