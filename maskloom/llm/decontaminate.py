"""Operator 5: benchmark decontamination by spaced-seed hashing.

A mask over consecutive words reads some positions and ignores the others, so a
seed survives substitutions at ignored positions. The masks are complete: every
pattern of substitutions that the rule below allows leaves a seed. Seeds of
benchmark items are joined to the seeds of every position of every document;
the hits are verified by diagonal (document position minus item position), each
once: the overlap of item and document there is compared word by word, and a leak is
a stretch that covers ``min_words`` item words (or the whole item, if shorter)
of which at least ``similarity`` agree, starting and ending with agreement. A hit
that goes on from one at the words before it is not listed, so texts that repeat
themselves give as many hits as words, not their product. A diagonal whose words of the document all lie in
leaks of the same item already gives no further row.

Items are taken in blocks of bounded total length, each scanned against all
documents; so a benchmark of any size needs no larger broadcast than one block.

Nulls and edges: a null or empty text has no words; an item of fewer words than
``min_words`` is a leak as a whole only, and has masks over its whole length.
Items without words, and rows with a null item id, match nothing; item ids are
longs (one that is no number fails the cast). Repeated
documents and repeated items yield a row each. Words are lower-cased (A-Z).
Very long documents are scanned whole. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.common import U64, column, mix, text_slices, word_hashes

#: Fixed spaced seeds: offsets read by each mask. Every stretch of ``COMPLETE`` (words, similarity) or more holds one:
#: enumerated for up to 25 words; of a longer stretch cut into parts of 13 to 25, one part is as similar as the whole.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 3, 7, 9, 10, 11), (0, 1, 2, 4, 5, 8, 9), (0, 1, 3, 5, 8, 10, 11), (0, 2, 4, 5, 6, 7, 8),
         (0, 1, 2, 3, 7, 8, 9), (0, 1, 2, 3, 4, 5, 6))
COMPLETE = (13, 0.8)
#: Words of benchmark text in one broadcast block (a seed is 16 bytes: at most about 70 MB a block).
BLOCK_WORDS = 1 << 20
FILTER_BITS = 24

SCHEMA = "item_id long, start_word int, end_word int, item_start int, item_words int, n_match int"


def changes(n: int, similarity: float) -> int:
    """Words of a stretch of ``n`` that may differ."""
    return min(n, int(n * (1 - similarity) + 1e-6))


def masks_for(min_words: int, similarity: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which every stretch of at least ``min_words`` words and ``similarity`` holds one."""
    if min_words >= COMPLETE[0] and similarity >= COMPLETE[1]:
        return MASKS
    # the longest run of equal words that no arrangement of the changes avoids, in the lengths that parts of a stretch have
    runs = [-(-(n - changes(n, similarity)) // (changes(n, similarity) + 1)) for n in range(max(1, min_words), 2 * max(1, min_words))]
    return (tuple(range(max(1, min(runs)))),)


def whole_masks(n: int, similarity: float) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` words: its ends, which agree, and one of more parts than may hold a change."""
    inner = np.arange(1, n - 1)
    parts = min(changes(n, similarity) + 1, max(1, len(inner) + 1))
    return [tuple(sorted({0, n - 1, *inner[k::parts].tolist()})) for k in range(parts)]


def _seeds(words: np.ndarray, first: np.ndarray, mask: tuple[int, ...], span: int, salt: int):
    """Seed hash at each word whose whole span lies in its document; returns hashes and word positions."""
    if len(words) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + span <= last)
    h = np.full(len(at), U64(salt + 1))
    for o in mask:
        h = (h ^ words[at + o]) * U64(0x9FB21C651E98DF25)
    return mix(h), at


def _previous(h: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Seed of the same mask one word before each, in the same document (an inverted seed of its own where there is none)."""
    out = ~h
    if len(h) > 1:
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (np.searchsorted(first, at[1:], "right") == np.searchsorted(first, at[:-1], "right"))) + 1
        out[follows] = h[follows - 1]
    return out


class _Block:
    """Seeds of one block of items, sorted, behind a bit table that most document positions fail."""

    def __init__(self, ids: list[int], words: np.ndarray, first: np.ndarray, min_words: int, similarity: float):
        self.ids, self.words, self.first = np.asarray(ids, np.int64), words, first
        sizes = np.diff(first)
        # (mask, span, salt, length of the items it is for: only at their start, or None)
        self.shapes = [(mask, max(mask) + 1, m, None) for m, mask in enumerate(masks_for(min_words, similarity))]
        for n in sorted({int(n) for n in sizes[(sizes > 0) & (sizes < min_words)]}):
            self.shapes += [(mask, n, (n << 16) + m, n) for m, mask in enumerate(whole_masks(n, similarity))]
        seeds, where, before = [], [], []
        for mask, span, salt, n in self.shapes:
            h, at = _seeds(words, first, mask, span, salt)
            item = np.searchsorted(first, at, "right") - 1
            fits = sizes[item] >= min_words if n is None else (sizes[item] == n) & (at == first[item])
            before.append(_previous(h, at, first)[fits])
            seeds.append(h[fits])
            where.append(at[fits])
        h, at, before = np.concatenate(seeds), np.concatenate(where), np.concatenate(before)
        self.known = np.unique(h)
        place, last = self._known(h), self._known(before)
        # by seed, then by the seed one word before it in the item (0: none)
        key = place * (len(self.known) + 1) + last + 1
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.seeds = key[order], at[order], h[order]
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.seeds >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _known(self, h: np.ndarray) -> np.ndarray:
        """Number of each seed among the items' seeds; -1: none of them."""
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == h, at, -1) if len(self.known) else np.full(len(h), -1)

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(document word, item word) pairs that share a seed, without those whose words before share one as well."""
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, span, salt, _ in self.shapes:
            h, at = _seeds(words, first, mask, span, salt)
            some = self.bits[(h >> U64(64 - FILTER_BITS)).astype(np.int64)]
            if not some.any():
                continue
            before = _previous(h, at, first)[some]
            h, at = h[some], at[some]
            place = self._known(h)
            some = place >= 0
            place, at, last = place[some], at[some], self._known(before[some])
            base = place * (len(self.known) + 1)
            ends = [np.searchsorted(self.key, x) for x in (base, base + last + 1, base + last + 2, base + len(self.known) + 1)]
            ends[1], ends[2] = (np.where(last >= 0, ends[k], ends[0]) for k in (1, 2))  # no seed before: nothing goes on from it
            for low, high in ((ends[0], ends[1]), (ends[2], ends[3])):
                n = high - low
                rep = np.repeat(np.arange(len(at)), n)
                docs.append(at[rep])
                items.append(self.at[low[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(docs), np.concatenate(items)


def _leaks(block: _Block, words, first, min_words: int, similarity: float, any_leak: bool = False):
    """Verified leaks of a slice: (document, item, start word, end word, item start, item words, matches).

    With ``any_leak`` one leak a document is enough.
    """
    at, it = block.hits(words, first)
    if not len(at):
        return []
    doc = np.searchsorted(first, at, "right") - 1
    item = np.searchsorted(block.first, it, "right") - 1
    diagonal = (at - first[doc]) - (it - block.first[item])
    rows = np.unique(np.stack([doc, item, diagonal], 1), axis=0)
    out, leaking = [], -1
    bounds = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
    for x, y in zip(bounds.tolist(), np.append(bounds[1:], len(rows)).tolist()):
        d, i = rows[x, :2].tolist()
        if any_leak and d == leaking:
            continue
        dw, iw = words[first[d]:first[d + 1]], block.words[block.first[i]:block.first[i + 1]]
        need = min(min_words, len(iw))
        covered: list[tuple[int, int]] = []  # document words in leaks of this item
        for g in _tiled(rows[x:y, 2].tolist(), len(iw)):
            low, high = max(0, -g), min(len(iw), len(dw) - g)
            if any(p <= low + g and high + g <= q for p, q in covered):
                continue
            best = _stretch(dw[low + g:high + g] == iw[low:high], need, similarity)
            if best is not None:
                a, b, n = best
                out.append((d, i, low + g + a, low + g + b, low + a, len(iw), n))
                covered = _with(covered, low + g + a, low + g + b)
                if any_leak:
                    leaking = d
                    break
    return out


def _tiled(diagonals: list[int], n: int):
    """All diagonals in order, but first those whose parts of the document (``n`` words) do not overlap: where every
    diagonal leaks, these cover what the others would find."""
    if len(diagonals) < 3:
        return diagonals
    tiles, rest, end = [], [], None
    for g in diagonals:
        if end is None or g >= end:
            tiles.append(g)
            end = max(g, 0) + n if g >= 0 else g + n
        else:
            rest.append(g)
    return tiles + rest


def _with(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Disjoint spans with one more; touching ones are joined."""
    out = []
    for p, q in spans:
        if q < a or p > b:
            out.append((p, q))
        else:
            a, b = min(a, p), max(b, q)
    return [*out, (a, b)]


def _stretch(same: np.ndarray, need: int, similarity: float):
    """Longest stretch of at least ``need`` words with a share ``similarity`` of agreement, ends agreeing; the last of equal ones."""
    starts = np.flatnonzero(same)
    if len(same) < need or not len(starts):
        return None
    # stretch [a, b) qualifies when its excess sum(same) - similarity * length is not negative
    excess = np.concatenate([[0.0], np.cumsum(same - similarity)]) + 1e-9 * np.arange(len(same) + 1)
    lowest = np.minimum.accumulate(excess[starts])
    ends = starts + 1
    k = np.searchsorted(-lowest, -excess[ends] - 1e-12)  # the first start that is low enough for each end
    size = np.where(k < len(starts), ends - starts[np.minimum(k, len(starts) - 1)], 0)
    best = len(size) - 1 - int(np.argmax(size[::-1]))
    if size[best] < need:
        return None
    a, b = int(starts[k[best]]), int(ends[best])
    return a, b, int(same[a:b].sum())


def _blocks(items: DataFrame, item_id: str, text: str):
    """Benchmark items in blocks of bounded total length, streamed to the driver one partition at a time."""
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"),
                                                          F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        n = r["t"].count(" ") + 1
        if ids and size + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += n
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """One row for each (document row, item, diagonal) that leaks: ``keep`` columns, item and word positions."""
    spark = docs.sparkSession
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, *T._parse_datatype_string(SCHEMA).fields])
    arrow = [(f.name, f.dataType) for f in schema.fields[len(keep):]]
    out = None
    for ids, texts in _blocks(benchmark, item_id, item_text):
        raw = [t.encode() for t in texts]
        words, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        shared = spark.sparkContext.broadcast((ids, words, first))

        def scan(batches, shared=shared):
            block = _Block(*shared.value, min_words, similarity)
            for batch in batches:
                found = []
                for row, _, data, offsets in text_slices(batch, "_text"):
                    words, first = word_hashes(data, offsets)
                    found += [(row + d, *rest) for d, *rest in _leaks(block, words, first, min_words, similarity)]
                if not found:
                    continue
                cols = list(zip(*found))
                pick = pa.array(cols[0], pa.int64())
                kept = [column(batch, k).take(pick) for k in keep]
                new = [pa.array(block.ids[list(cols[1])], pa.int64())] + [pa.array(c, pa.int32()) for c in cols[2:]]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*keep, *(n for n, _ in arrow)])

        part = source.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no leak, with their own columns (a row with a null id is judged like any other)."""
    flagged = mark_leaking(docs, benchmark, **options)
    return flagged.where("not _leaks").drop("_leaks")


def mark_leaking(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """``docs`` with a boolean ``_leaks``, row by row without a join; one pass for each benchmark block."""
    spark = docs.sparkSession
    out = docs.withColumn("_leaks", F.lit(False))
    for ids, texts in _blocks(benchmark, item_id, item_text):
        raw = [t.encode() for t in texts]
        words, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        shared = spark.sparkContext.broadcast((ids, words, first))

        def scan(batches, shared=shared):
            block = _Block(*shared.value, min_words, similarity)
            for batch in batches:
                leaks = np.array(column(batch, "_leaks").to_numpy(zero_copy_only=False), bool)
                for row, _, data, offsets in text_slices(batch, text):
                    words, first = word_hashes(data, offsets)
                    for d, *_ in _leaks(block, words, first, min_words, similarity, any_leak=True):
                        leaks[row + d] = True
                at = batch.schema.get_field_index("_leaks")
                yield batch.set_column(at, "_leaks", pa.array(leaks))

        out = out.mapInArrow(scan, out.schema)
    return out
