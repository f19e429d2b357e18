"""Operator 6: best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``. Minimum bin slack fills
one bin at a time: the largest length left opens it, and a subset-sum over the
lengths still available, kept as the bits of one integer, finds the fullest
feasible completion, which is then removed. Lengths are whole numbers up to
``capacity``, so the state is the histogram of lengths. A completion stays
the fullest for as long as its lengths last (removing lengths adds no sums), so it is
repeated at once as often as the counts allow. Each pattern uses up a length:
there are at most ``capacity`` patterns whatever the number of documents.

The pieces themselves never leave the executors: a piece is given its rank among
the pieces of its length from counts by (block of rows, length), and the rank
and length name the bin and the offset.

Nulls and edges: a null text is empty and packs as its end token alone; a
document of exactly ``capacity`` tokens is one full piece; equal lengths are
told apart by block and place in it, repeated rows are packed each. Ids are
longs (null ids stay null; one that is no number fails the cast). An empty
table gives no rows. Columns of the input other than the id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import column, save
from maskloom.llm.tokens import BYTE_BPE, encoded_batches

PIECES = "doc_id long, piece int, start long, length long, ids binary, block long, place long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), the task that made them (``block``) and their number
    among that task's pieces of the same length (``place``)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"),
                         F.spark_partition_id().cast("long").alias("_block"))

    def make(batches):
        seen = np.zeros(capacity + 1, np.int64)
        for batch, at, ids in encoded_batches(batches, tokenizer, end_id, "_text"):
            raw, row, pieces, starts, sizes, places = [], [], [], [], [], []
            for r, one in zip(at, ids):
                total = len(one) // 4
                head = (total - 1) % capacity + 1
                cuts = [0, *range(head, total + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    pieces.append(p)
                    starts.append(a)
                    sizes.append(b - a)
                    places.append(seen[b - a])
                    seen[b - a] += 1
                    raw.append(one[4 * a:4 * b])
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(pick), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()), column(batch, "_block").take(pick),
                pa.array(places, pa.int64())], names=["doc_id", "piece", "start", "length", "ids", "block", "place"])

    return source.mapInArrow(make, PIECES)


def _fullest(counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the largest sum up to ``room``; larger lengths first among equals."""
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        left, unit = min(counts[size], room // size), 1
        while left:
            k = min(unit, left)
            new = (sums | (sums << (k * size))) & mask
            if new != sums:
                steps.append((size, k, sums))
                sums = new
            left, unit = left - k, unit * 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    target = sums.bit_length() - 1
    taken: list[int] = []
    for size, k, before in reversed(steps):
        if not before >> target & 1:
            taken += [size] * k
            target -= k * size
    return taken


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin, in order) and how many bins take each; together they use every length up."""
    left = {s: n for s, n in histogram.items() if n > 0}
    patterns = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        pattern = (largest, *sorted(_fullest(rest, capacity - largest), reverse=True))
        use = Counter(pattern)
        times = min(left[s] // k for s, k in use.items())
        patterns.append((pattern, times))
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return patterns


def pack(docs: DataFrame, *, tokenizer: str = BYTE_BPE, capacity: int = 1024, end_id: int = 2, text: str = "text",
         payload: dict[str, Column] | None = None) -> DataFrame:
    """Every piece of every document with ``sequence_id`` and ``offset``.

    ``payload`` names what each piece carries besides: by default its ``ids``. A
    caller that needs only a digest of the ids names that, and ids are not shuffled.
    """
    spark = docs.sparkSession
    payload = {"ids": F.col("ids")} if payload is None else payload
    made = tokenize_pieces(docs, tokenizer, capacity, end_id, text)
    pieces = save(made.select("doc_id", "piece", "start", "length", "block", "place",
                              *[c.alias(k) for k, c in payload.items()]), "pieces")
    counts = save(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most capacity patterns of at most sqrt(2 * capacity) different lengths each: a table of bounded size
    used, bins, rows = Counter(), 0, []
    for pattern, times in minimum_bin_slack(histogram, capacity):
        offset = 0
        for size, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], used[size] + k * times, k, bins, offset))
            used[size] += k * times
            offset += size * k
        bins += times
    slots = spark.createDataFrame(rows, "length long, low long, high long, k long, first_bin long, base long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    first_rank = counts.withColumn("before", before).select("length", "block", "before")
    ranked = pieces.join(first_rank, ["length", "block"]).withColumn("_rank", F.col("before") + F.col("place"))
    inside = F.col("_rank") - F.col("low")
    return ranked.join(F.broadcast(slots), ["length"]).where("_rank >= low and _rank < high").select(
        "doc_id", "piece", "start", "length", *payload,
        (F.col("first_bin") + F.floor(inside / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("base") + inside % F.col("k") * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its ids in order and, for each piece, document, offset and length (the attention blocks)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"),
                                            x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))
