"""Operator 11: grouping of spelling variants by dynamic programming over sorted lists.

Words that are one edit apart share all but a stretch of their code points: of
two words of which the shorter has ``l``, the first half or the last half is the
same. So each word goes to a group for either half of its own length and of one
less, and a group holds what its words do not share, the middles, as a sorted
list. Every middle of a list is compared with all the others by one walk along
the list: a range of words with a common prefix has one row of the edit matrix,
a band of three cells, which is worked out once and handed on through the
common prefixes (LCPs) of neighbours. Where the least cell of a row exceeds one
edit, the whole range is skipped. All words of many groups walk together.

A group with more than ``GROUP`` words or ``CELLS`` code points is not walked: each of its words goes on
to the two groups that share one half of the middle as well, and so on; when all
but a stretch of one code point is shared, a group has at most ``NARROW`` words. Nothing is capped.

A pair is counted once: in a group of words whose *later* part is shared, pairs
that also share the earlier half are left to the other group.

Nulls and edges: a null text has no words; a null id counts as the empty string.
Repeated rows count again. Words of any length are compared whole. Words
without a near word, and words that none is frequent enough to be a form of,
have a null form and are their own root. Empty tables give no rows. Columns
other than the id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import bounded_groups, column, drop_saved, save

#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
#: Letters that a word can have, and the most words that share all but a stretch of one code point.
LETTERS = 26 + 64
NARROW = LETTERS + LETTERS ** 2
#: Words of one list, ``NARROW`` at least; larger groups are parted further.
GROUP = 10_000
#: Code points of one list, and about those that are walked at once; larger groups are parted further.
CELLS = 4_000_000
#: Words that walk their lists together.
ASKS = 1024
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- words and counts

def _count(min_chars: int, every: int):
    run_of = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % min_chars)

    def table(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(column(batch, "_name"), column(batch, "_text")):
                found = Counter(run_of.findall(text.as_py() or ""))
                if not found:
                    continue
                seed = zlib.crc32(f"{name.as_py()}:".encode())
                for word, n in found.items():
                    word = word.translate(ASCII_LOWER)
                    h = zlib.crc32(word.encode(), seed)
                    if every and h % every == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1:]
                        if len(word) < min_chars:
                            continue
                    counts[word] += n
                if len(counts) > FLUSH:
                    yield table(counts)
                    counts = Counter()
        if counts:
            yield table(counts)
    return run


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2,
               every: int = 31) -> DataFrame:
    """``word`` and ``n``: runs of letters, lower-cased (A-Z), one in ``every`` of them by hash without one code point."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_name"), F.col(text).alias("_text"))
    counted = source.mapInArrow(_count(min_chars, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- groups by shared parts

def part_groups(rows: DataFrame) -> DataFrame:
    """Each row ``(word, n, l, a, b)`` twice: with the later half ``[h, b)`` of the stretch unshared, and with the earlier.

    ``l`` is the length of the shorter word of a pair, ``[a, b)`` the stretch of it that holds the edit.
    """
    half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = rows.select("word", "n", "l", F.explode(F.array(
        F.struct(half.alias("a"), F.col("b").alias("b")), F.struct(F.col("a"), half.alias("b")))).alias("s")).select("word", "n", "l", "s.*")
    tail = F.col("l") - F.col("b")
    shared = [F.col("word").substr(F.lit(1), F.col("a")), F.when(tail > 0, F.expr("right(word, l - b)")).otherwise(F.lit(""))]
    return both.withColumn("key", F.concat_ws(":", "l", "a", "b", *shared))


def near_rows(group: np.ndarray, middles: np.ndarray, sizes: np.ndarray):
    """Pairs (both orders) of rows of a group whose middles are exactly one edit apart.

    ``middles`` has the code points of each row, padded with -1, and rows are sorted by (group, middle).
    """
    n, width = middles.shape
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    same = np.cumprod(middles[1:] == middles[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1])), -1)
    start = np.flatnonzero(lcp < 0)
    end = np.append(start[1:], n)
    of = np.searchsorted(start, np.arange(n), "right") - 1
    padded = np.full((n, width + 3), -2, middles.dtype)  # column d + 1 is code point d; -2 equals nothing
    padded[:, 1:width + 1] = np.where(middles < 0, -2, middles)
    # per depth: the rows where a longer prefix begins, and where the shorter one ends
    steps = [(np.flatnonzero((lcp <= d) & (sizes > d)), np.append(np.flatnonzero(lcp <= d), n)) for d in range(width)]
    found_a, found_b = [none], [none]
    many = np.flatnonzero(end[of] - start[of] > 1)
    for k in range(0, len(many), ASKS):
        # each row asks its whole group: a range [low, high) of rows with a common prefix, and its cells j = d - 1, d, d + 1
        asks = many[k:k + ASKS]
        low, high = start[of[asks]], end[of[asks]]
        row = np.tile(np.array([2, 0, 1], np.int8), (len(asks), 1))
        for depth in range(width + 1):
            # a range begins with the word that ends here, if there is one
            ends = np.flatnonzero(sizes[low] == depth)
            offset = sizes[asks[ends]] - depth + 1
            inside = (offset >= 0) & (offset <= 2)
            ends, offset = ends[inside], offset[inside]
            ends = ends[row[ends, offset] == 1]
            found_a.append(asks[ends])
            found_b.append(low[ends])
            if depth == width or not len(asks):
                break
            begins, bounds = steps[depth]
            x, y = np.searchsorted(begins, low), np.searchsorted(begins, high)
            times = y - x
            by = np.repeat(np.arange(len(asks)), times)
            child = begins[x[by] + np.arange(len(by)) - np.repeat(np.cumsum(times) - times, times)]
            c, q, r = middles[child, depth], asks[by], row[by]
            new = np.empty_like(r)
            new[:, 0] = np.minimum(r[:, 0] + (padded[q, depth] != c), r[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(r[:, 1] + (padded[q, depth + 1] != c), r[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(r[:, 2] + (padded[q, depth + 2] != c), new[:, 1] + 1)
            np.minimum(new, 2, out=new)
            alive = new.min(1) <= 1  # else the whole range is skipped
            low = child[alive]
            high = bounds[np.searchsorted(bounds, low, "right")]
            asks, row = q[alive], new[alive]
    return np.concatenate(found_a), np.concatenate(found_b)


def _walk(rows: list[tuple]) -> list[tuple]:
    """``(word, n_near, best n, best word)`` of rows ``(key, middle, word, n, l, b)`` sorted by key and middle."""
    keys, middles, words, counts, l, b = zip(*rows)
    names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    group = np.array([names[k] for k in keys])
    sizes = np.array([len(m) for m in middles])
    grid = np.full((len(rows), max(1, int(sizes.max()))), -1, np.int32)
    for i, m in enumerate(middles):
        grid[i, :sizes[i]] = np.frombuffer(m.encode("utf-32-le"), np.uint32)
    best: dict[str, tuple] = {}
    for i, j in zip(*(x.tolist() for x in near_rows(group, grid, sizes))):
        u, v = words[i], words[j]
        # both of the longer length: another group's pair; the earlier part shared as well: so too
        if min(len(u), len(v)) != l[i] or (b[i] < l[i] and u[:b[i]] == v[:b[i]]):
            continue
        m, key = best.get(u, (0, None))
        mine = (-counts[j], v)
        best[u] = (m + 1, mine if key is None or mine < key else key)
    return [(u, m, -k[0], k[1]) for u, (m, k) in best.items()]


_OUT = ("word", "n", "l", "a", "b", "n_near", "best_n", "best")


def _near(group: int, cells: int):
    """From rows sorted by key: near words of each word in its group, or the rows themselves where a group is too large."""
    def results(found):
        k = len(found)
        cols = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.int32())] * 3,
             pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=list(_OUT))

    def again(table):
        k = table.num_rows
        return pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks() for c in _OUT[:5]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.string())], names=list(_OUT))

    def run(batches):
        for over, table in bounded_groups(batches, "key", group):
            if over:
                yield again(table)
                continue
            cols = [table.column(c).to_pylist() for c in ("key", "word", "n", "l", "a", "b")]
            size = Counter(cols[0])
            wide = [size[k] > 1 and size[k] * (b - a + 1) > cells and b - a > 1 for k, a, b in zip(cols[0], *cols[4:])]
            if any(wide):
                yield again(table.filter(pa.array(wide)))
            rows = sorted((key, w[a:len(w) - (l - b)], w, n, l, b) for key, w, n, l, a, b, far in zip(*cols, wide)
                          if size[key] > 1 and not far)
            start, widest = 0, 0
            for i, r in enumerate(rows):
                fresh = i > start and r[0] != rows[i - 1][0]
                if fresh and (i - start) * max(widest, len(r[1])) > cells:
                    yield results(_walk(rows[start:i]))
                    start, widest = i, 0
                widest = max(widest, len(r[1]))
            if rows:
                yield results(_walk(rows[start:]))
    return run


def near_words(words: DataFrame, *, group: int = GROUP, cells: int = CELLS) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest ``n`` (``best``, ``best_n``) of the distinct ``words`` that have one.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.
    """
    if group < NARROW:
        raise ValueError(f"a list must have room for {NARROW} words")
    size = F.length("word")
    shortest = words.agg(F.min(size)).first()[0] or 1
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where(F.col("l") >= max(1, shortest)).select(
        "word", "n", "l", F.lit(0).alias("a"), F.col("l").alias("b"))
    kinds = "word string, n long, l int, a int, b int, n_near long, best_n long, best string"
    found = None
    while True:  # a round for each halving of the largest groups' middles
        keyed = part_groups(rows)
        out = save(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_near(group, cells), kinds), "near-words")
        part = out.where("best is not null").select("word", "n_near", "best_n", "best")
        found = part if found is None else found.unionByName(part)
        rows = out.where("best is null").select(*_OUT[:5])
        if rows.isEmpty():
            break
    key = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(key).alias("k")).select(
        "word", "n_near", F.col("k.w").alias("best"), (-F.col("k.m")).alias("best_n"))


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain ``word`` -> ``form``; chains have no circle, as forms are more frequent.

    Pointers are doubled, so the rounds grow with the logarithm of the longest chain.
    """
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = save(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                       F.col("_next").isNotNull().alias("moved")), "roots")
        drop_saved(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, every: int = 31,
             factor: int = 10, group: int = GROUP) -> DataFrame:
    """One row for each word: ``word``, ``form`` (its near word of largest n, if ``factor`` times as frequent), ``root``,
    ``n``, ``n_near``, ``form_n``."""
    words = save(vocabulary(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_count=min_count, every=every), "vocabulary")
    near = near_words(words, group=group)
    some = F.col("best_n") >= factor * F.col("n")
    out = save(words.join(near, "word", "left").select(
        "word", F.when(some, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(some, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
