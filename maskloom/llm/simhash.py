"""Operator 13: SimHash near duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that
differ in at most two bits, some segment is equal and the one after it (in a
circle) differs in at most one bit: either one segment alone is equal, and the
others differ in one bit each, or two are, and one of them is followed by the
other. So each fingerprint gives, for each segment, that segment itself joined
with the indices of all codewords of the binary Golay code (23, 12) to which
the next segment decodes after at most one change. The code is perfect, so
every word decodes, and most give one to six indices. Fingerprints under one
key are verified by their distance, and what is linked becomes one component.

Groups under one key larger than ``GROUP`` are not paired in a task: their
fingerprints are given every word within one bit as a key, in Spark; those that
share such a word are at most two bits apart, and each word has at most 65.

Fingerprints: texts are lower-cased (A-Z); shingles of three words, joined by
one space, are hashed by XXH64 (seed 42); a bit is 1 if over half of the hashes
have it. Texts of one or two words are one shingle; those of none (null and
empty texts too) have fingerprint zero and are linked like any other. Long
texts are handled whole. Rows of one text, and repeated rows, share their
component. A null id is no component's name unless all its ids are null. Empty
tables give no rows. Columns other than the id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import U64, bounded_groups, column, drop_saved, join_counted, save
from maskloom.llm.components import components

WORDS = 3
SEED = 42
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints under one key that one task pairs.
GROUP = 512
DISTANCE = 2
#: Bytes of text whose shingles are hashed and counted at once (a longer text alone, whole).
PIECE = 1 << 18


# ---------------------------------------------------------------- fingerprints

def shingle_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each document from the hashes of its shingles: ``first`` has n + 1 places."""
    out = np.zeros(len(first) - 1, U64)
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
    over = 2 * ones > sizes[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()  # bytes: A-Z only, and white space of ASCII only
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in zip(words, words[1:], words[2:])]


def _fingerprints(batches):
    for batch in batches:
        texts = column(batch, "_text").cast(pa.binary())
        out, hashes, first, size = [], [], [0], 0
        for t in texts:
            raw = t.as_py() or b""
            hashes += _hashes(raw)
            first.append(len(hashes))
            size += len(raw)
            if size > PIECE:
                out.append(shingle_bits(np.array(hashes, U64), np.array(first)))
                hashes, first, size = [], [0], 0
        out.append(shingle_bits(np.array(hashes, U64), np.array(first)))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.concatenate(out).view(np.int64))],
                                         names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (its 64 bits as a long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- Golay keys

def _rest(word: int) -> int:
    """Remainder of a 23-bit word by the generator: its syndrome."""
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


class Golay:
    """Nearest codeword of every 23-bit word, by a table of the 2048 syndromes and their errors of at most three bits."""

    def __init__(self):
        one = np.array([_rest(1 << k) for k in range(23)], np.int64)
        words = np.arange(1 << 12)
        self.low = np.zeros(1 << 12, np.int64)
        self.high = np.zeros(1 << 11, np.int64)
        for k in range(12):
            self.low ^= (words >> k & 1) * one[k]
        for k in range(11):
            self.high ^= (words[:1 << 11] >> k & 1) * one[12 + k]
        self.error = np.zeros(1 << 11, np.int64)
        bits = [0, *(1 << k for k in range(23))]
        for a in range(24):
            for b in range(a, 24):
                for c in range(b, 24):
                    e = (bits[a] | bits[b] | bits[c])
                    self.error[self.low[e & 0xFFF] ^ self.high[e >> 12]] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        """Number (12 bits) of the codeword nearest to each word."""
        return (words ^ self.error[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11


def golay_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (unsigned), and the place of each key's fingerprint."""
    parts, shift = [], 0
    for width in SEGMENTS:
        parts.append(((fp >> U64(shift)) & U64((1 << width) - 1)).astype(np.int64))
        shift += width
    keys, rows = [], []
    for k, part in enumerate(parts):
        near, width = parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3]
        flips = np.array([0, *(1 << b for b in range(width))], np.int64)
        found = np.sort(golay.index(near[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        row, col = np.nonzero(new)
        keys.append((np.int64(k) << 34) | (part[row] << 12) | found[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches):
    golay = Golay()
    for batch in batches:
        fp = column(batch, "fp").to_numpy()
        keys, rows = golay_keys(fp.view(U64), golay)
        for a in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + (1 << 17)]), pa.array(fp[rows[a:a + (1 << 17)]])],
                                             names=["key", "fp"])


# ---------------------------------------------------------------- verified links

def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links: every value but the least with the least."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    move = np.flatnonzero(label != np.arange(len(names)))
    return names[move], names[label[move]]


def close_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the pairs within ``DISTANCE`` bits under one key; ``key`` is sorted."""
    n = len(key)
    end = np.searchsorted(key, key, "right")
    live, step = np.arange(n), 0
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    some_u, some_v, size = [u], [v], 0
    while True:
        step += 1
        live = live[live + step < end[live]]
        if not len(live):
            break
        near = np.bitwise_count((fp[live] ^ fp[live + step]).view(U64)) <= DISTANCE
        some_u.append(fp[live[near]])
        some_v.append(fp[live[near] + step])
        size += len(some_u[-1])
        if size > 1 << 20:  # few links say the same
            u, v = _forest(np.concatenate(some_u), np.concatenate(some_v))
            some_u, some_v, size = [u], [v], 0
    return _forest(np.concatenate(some_u), np.concatenate(some_v))


def _verify(group: int):
    def run(batches):
        for over, table in bounded_groups(batches, "key", group):
            if over:
                fp = np.unique(table.column("fp").to_numpy())
                u, v = fp, fp
            else:
                u, v = close_pairs(table.column("key").to_numpy(), table.column("fp").to_numpy())
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), over))],
                                                 names=["u", "v", "over"])
    return run


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of the distinct fingerprints ``fp`` within two bits."""
    keys = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = save(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(group), "u long, v long, over boolean"),
                 "fingerprint-links")
    # fingerprints of large groups: all words within one bit; who shares one is within two
    words = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("u").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    wide = found.where("over").select("u").distinct().select("u", F.explode(F.concat(F.array("u"), words)).alias("word"))
    shared = wide.groupBy("word").agg(F.sort_array(F.collect_set("u")).alias("all")).where("size(all) > 1")
    more = shared.select(F.explode("all").alias("u"), F.col("all")[0].alias("v")).where("u != v")
    return found.where("not over").select("u", "v").unionByName(more.distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (its least id)."""
    rows = save(fingerprints(docs, text=text), "fingerprints")
    fps = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    labels = components(links(fps, group)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    grouped = fps.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = save(grouped.join(named, "root").select("fp", "n", "component_id"), "fingerprint-components")
    drop_saved(fps)
    return join_counted(rows, of_fp, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
