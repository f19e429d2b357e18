"""Operator 10: removal of repeated byte strings by a sparse suffix sort (deep-shallow).

Every string of ``length`` bytes holds an anchor, the least hash among its
``GRAM``-byte grams, and equal strings hold equal anchors at equal offsets. So
anchors are grouped by their gram, and within a group the suffixes that start at
each offset before the anchor are sorted to depth ``length``: first by multikey
sorting of 8-byte characters down to the shallow depth; then, for the groups
that still agree, by blind tries that look at branching characters only, all groups
at once. Suffixes that agree to full depth are repeats.

Equal surroundings of an anchor are sorted once (a passage in a third of all
documents is one row of that table). Groups of very many different surroundings
are split by the bytes that all strings of eight neighbouring offsets share. A
subgroup that is still too large (a passage barely over ``length`` bytes in very many
different surroundings) is not sorted in a task: its strings are compared by
64-bit hash in Spark, as whole surroundings are, and those of two surroundings are repeats.

Nulls and edges: a null text is empty; texts under ``length`` bytes keep all their
bytes. Rows of equal text (repeated rows, whatever their ids) make all of their
strings repeats. Matches never cross rows. Long texts are handled whole. Empty
tables give no rows. Columns other than the id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import (U64, binary_rows, bounded_groups, column, drop_saved, join_counted, mix, partitions, prefix_hash,
                                 range_hash, release, rest, save, text_slices)
from maskloom.llm.jaccard_join import text_node

GRAM = 104
SHALLOW = 2
#: Different surroundings of one gram that are sorted together; larger groups are split by content.
GROUP = 8192
#: Surroundings that a task takes up at once, besides the rest of a group.
STEP = 2048
#: Base of a packed position: position, bytes before, bytes after.
PACK = 4096


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[:len(values) - width + 1], out[width - done:]) if width > done else out


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor positions, their gram hashes, and hashes and extents of their surroundings."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(U64), none.astype(U64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = range_hash(prefix, at, at + GRAM)
    span = length - GRAM + 1
    least = _sliding(grams, span, np.minimum)
    # windows that cross documents decide nothing
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:], sizes)[:len(least)] - length
    least = np.where(np.arange(len(least)) <= last, least, U64(0))
    padded = np.concatenate([np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)])
    found = np.flatnonzero(grams == _sliding(padded, span, np.maximum))
    doc = np.searchsorted(offsets, found, "right") - 1
    left = np.minimum(found - offsets[doc], length - GRAM)
    right = np.minimum(offsets[doc + 1] - found, length)
    around = range_hash(prefix, found - left, found + right)
    around = mix(around ^ (left.astype(U64) * U64(1_000_003) + right.astype(U64)))
    return found, grams[found], around, doc, left, right


def _find(length: int):
    """Rows (key, around, id, place): the anchors of every text; ``place`` packs position and extents."""
    def run(batches):
        for batch in batches:
            for row, n, data, offsets in text_slices(batch, "_text"):
                at, key, around, doc, left, right = _anchors(data, offsets, length)
                if len(at):
                    place = ((at - offsets[doc]) * PACK + left) * PACK + right
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.view(np.int64)), pa.array(around.view(np.int64)),
                        column(batch, "_id").take(pa.array(row + doc)), pa.array(place)], names=["key", "around", "id", "place"])
        rest()
    return run


def _combine(limit: int = 1 << 20):
    """Anchors of equal surroundings within a task, counted before they are shuffled."""
    def flush(held):
        table = pa.Table.from_batches(held)
        key, around = (table.column(c).to_numpy() for c in ("key", "around"))
        order = np.lexsort((around, key))
        new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(around[order]) != 0))
        first = np.flatnonzero(new)
        pick = order[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[pick]), pa.array(around[pick]), pa.array(np.diff(np.append(first, len(order)))),
             *(pa.array(table.column(c).to_numpy()[pick]) for c in ("id", "place"))],
            names=["key", "around", "n", "id", "place"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _surroundings(length: int):
    """The bytes around the wanted anchors of each text, padded so that the anchor stands at the same place."""
    room = length - GRAM

    def run(batches):
        for batch in batches:
            wanted = column(batch, "wanted")
            for row, n, data, offsets in text_slices(batch, "_text"):
                part = wanted.slice(row, n)
                doc = np.repeat(np.arange(n), _lengths(part))
                flat = part.flatten()
                if not len(flat):
                    continue
                place = flat.field(2).to_numpy()
                at, before, after = place // PACK // PACK + offsets[doc], place // PACK % PACK, place % PACK
                where = np.arange(-room, length)
                index = np.clip(at[:, None] + where[None, :], 0, len(data) - 1)
                inside = (where[None, :] >= -before[:, None]) & (where[None, :] < after[:, None])
                body = np.where(inside, data[index], 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0), flat.field(1), flat.field(3), pa.array(before.astype(np.int16)),
                     pa.array(after.astype(np.int16)), binary_rows(body.reshape(-1), np.arange(len(at) + 1) * (room + length))],
                    names=["key", "around", "split", "before", "after", "bytes"])
    return run


def _split_large(length: int):
    """Surroundings of large groups go to one subgroup for each eight offsets, named by the bytes those strings share."""
    room = length - GRAM

    def run(batches):
        for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
            raw = np.frombuffer(b"".join(column(batch, "bytes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            split = np.array(column(batch, "split").to_numpy(zero_copy_only=False), bool)
            key = column(batch, "key").to_numpy().view(U64)
            whole = np.flatnonzero(~split)
            picks, groups, low = [whole], [key[whole]], [np.full(len(whole), -1, np.int16)]
            many = np.flatnonzero(split)
            if len(many):
                flat = raw[many].reshape(-1)
                prefix = prefix_hash(flat)
                line = np.arange(len(many)) * raw.shape[1]
                for o in range(0, room + 1, 8):
                    top = min(o + 7, room)
                    shared = range_hash(prefix, line + room - o, line + room - top + length)
                    picks.append(many)
                    groups.append(mix(shared ^ key[many] ^ U64(o + 1)))
                    low.append(np.full(len(many), o, np.int16))
            pick = pa.array(np.concatenate(picks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(groups).view(np.int64)), pa.array(np.concatenate(low))]
                + [column(batch, c).take(pick) for c in ("key", "around", "before", "after", "bytes")],
                names=["group", "low", "key", "around", "before", "after", "bytes"])
        rest()
    return run


def _characters(body: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte character that starts at each place of each row."""
    out = np.zeros((body.shape[0], body.shape[1] - 7), U64)
    for k in range(8):
        out = (out << U64(8)) | body[:, k:body.shape[1] - 7 + k].astype(U64)
    return out


def _refine(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by group and keys, and the new group numbers along it."""
    order = np.lexsort((*keys[::-1], group))
    change = np.zeros(len(order), bool)
    for k in (group, *keys):
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(change)


def _shared(order: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of two or more."""
    many = np.bincount(number)[number] > 1
    return order[many], number[many]


def repeated_suffixes(chars: np.ndarray, row: np.ndarray, start: np.ndarray, group: np.ndarray, n_chars: int) -> np.ndarray:
    """Which suffixes (``row``, ``start``) equal another of their group over ``n_chars`` 8-byte characters.

    Shallow: multikey sorting, character by character, of what still agrees.
    Deep: one blind trie for each remaining group. A round compares each suffix with
    its group's first one only up to where they part, and branches on that place and the
    character there; characters between branchings are not sorted on.
    """
    out = np.zeros(len(row), bool)
    live, number = _shared(*_refine(group))
    for d in range(min(SHALLOW, n_chars)):
        if not len(live):
            return out
        order, new = _refine(number, chars[row[live], start[live] + 8 * d])
        kept, number = _shared(order, new)
        live = live[kept]
    depth = np.full(len(live), min(SHALLOW, n_chars))
    while len(live):
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        leader = live[np.repeat(first, np.diff(np.append(first, len(live))))]
        parted = np.full(len(live), n_chars)
        char = np.zeros(len(live), U64)
        open_ = np.flatnonzero(leader != live)
        for d in range(int(depth.min()), n_chars):
            if not len(open_):
                break
            mine = chars[row[live[open_]], start[live[open_]] + 8 * d]
            differs = (mine != chars[row[leader[open_]], start[leader[open_]] + 8 * d]) & (d >= depth[open_])
            parted[open_[differs]] = d
            char[open_[differs]] = mine[differs]
            open_ = open_[~differs]
        equal = (parted == n_chars) & (leader != live)
        out[live[equal]] = True
        out[leader[equal]] = True
        rest = np.flatnonzero(parted < n_chars)
        order, new = _refine(number[rest], parted[rest], char[rest])
        kept, new = _shared(order, new)
        depth = parted[rest[kept]] + 1
        live, number = live[rest[kept]], new
    return out


_REPEATS = ("key", "around", "high", "least", "string")


def _sort(length: int, limit: int):
    """Repeats of each surrounding, as the highest and least offset; of groups over ``limit`` rows each string, with its hash."""
    room = length - GRAM

    def extents(table):
        before = table.column("before").to_numpy().astype(np.int64)
        after = table.column("after").to_numpy().astype(np.int64)
        low = table.column("low").to_numpy().astype(np.int64)
        # suffixes start ``offset`` bytes before the anchor
        first = np.maximum(np.maximum(0, length - after), low)
        last = np.where(low >= 0, np.minimum(before, low + 7), before)
        count = np.maximum(0, last - first + 1)
        row = np.repeat(np.arange(len(count)), count)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]

    def strings(table):
        row, offset = extents(table)
        prefix = prefix_hash(np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8))
        start = row * (room + length) + room - offset
        name = mix(range_hash(prefix, start, start + length) ^ offset.astype(U64))
        pick, at = pa.array(row), pa.array(offset.astype(np.int32))
        key, around = (table.column(c).combine_chunks().take(pick) for c in ("key", "around"))
        return pa.RecordBatch.from_arrays([key, around, at, at, pa.array(name.view(np.int64))], names=list(_REPEATS))

    def flush(held):
        table = pa.concat_tables(held).combine_chunks()
        m = table.num_rows
        body = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(m, room + length)
        row, offset = extents(table)
        name = np.unique(table.column("group").to_numpy(), return_inverse=True)[1]
        found = repeated_suffixes(_characters(body), row, room - offset, name[row] * (room + 1) + offset, length // 8)
        row, offset = row[found], offset[found]
        if not len(row):
            return None
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        pick = pa.array(row[starts])
        return pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks().take(pick) for c in ("key", "around")]
            + [pa.array(np.maximum.reduceat(offset, starts).astype(np.int32)),
               pa.array(np.minimum.reduceat(offset, starts).astype(np.int32)), pa.nulls(len(starts), pa.int64())], names=list(_REPEATS))

    def run(batches):
        held, size = [], 0
        small = (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP))
        for over, table in bounded_groups(small, "group", limit):
            if over:
                yield from (strings(table.slice(a, STEP)) for a in range(0, table.num_rows, STEP))
                continue
            # rows of equal text give equal surroundings once each; one surrounding alone has nothing to agree with
            name, around = table.column("group").to_numpy(), table.column("around").to_numpy()
            order = np.lexsort((around, name))
            new = np.append(True, (name[order][1:] != name[order][:-1]) | (around[order][1:] != around[order][:-1]))[:len(order)]
            kept = order[new]
            many = np.unique(name[kept], return_inverse=True, return_counts=True)
            kept = np.sort(kept[many[2][many[1]] > 1])
            if not len(kept):
                continue
            held.append(table.take(pa.array(kept)))
            size += len(kept)
            if size >= STEP:
                out = flush(held)
                held, size = [], 0
                if out is not None:
                    yield out
        if held:
            out = flush(held)
            if out is not None:
                yield out
        held = None
        rest()

    return run


def text_ids(docs: DataFrame, text: str) -> Column:
    """A 64-bit id for each different text: a salted hash, salted anew if two texts of this table ever share one."""
    body = F.coalesce(F.col(text), F.lit(""))
    salt = 0
    while True:
        name = F.xxhash64(F.lit(salt), body)
        seen = docs.select(name.alias("id"), text_node(text).alias("node")).groupBy("id").agg(
            F.min("node").alias("a"), F.max("node").alias("b"))
        if seen.where("a != b").isEmpty():
            return name
        salt += 1


def repeated_spans(docs: DataFrame, name: Column, *, text: str = "text", length: int = 200, group: int | None = None) -> DataFrame:
    """``(id, spans)``: for each text with repeats, the byte intervals around anchors that repeats cover.

    ``name`` is the id of a row's text; rows of equal text have equal spans.
    """
    if length % 8 or not GRAM + 8 <= length < PACK:
        raise ValueError(f"length must be a multiple of 8 from {GRAM + 8} to {PACK - 1}")
    spark = docs.sparkSession
    source = docs.select(F.col(text).alias("_text"), name.alias("_id"))
    group = GROUP if group is None else group
    anchors = save(source.mapInArrow(_find(length), "key long, around long, id long, place long"), "anchors")
    # one exchange by gram serves the counts of surroundings and the number of them a gram has
    around = anchors.mapInArrow(_combine(), "key long, around long, n long, id long, place long").repartition("key")
    around = around.groupBy("key", "around").agg(F.sum("n").alias("n"), F.first("id").alias("id"), F.first("place").alias("place"))
    around = around.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
    around = save(around.where("n > 1 or m > 1"), "surroundings")
    release(spark)
    # grams with several different surroundings are sorted
    wanted = around.where("m > 1").groupBy("id").agg(F.collect_list(F.struct(
        "key", "around", "place", (F.col("m") > group).alias("split"))).alias("wanted"))
    cut, split = _surroundings(length), _split_large(length)  # in one worker: two would hold twice the memory
    bodies = source.withColumnRenamed("_id", "id").join(wanted, "id").select("_text", "wanted").mapInArrow(
        lambda batches: split(cut(batches)), "group long, low short, key long, around long, before short, after short, bytes binary")
    sorted_ = save(bodies.repartition(partitions(spark), "group").sortWithinPartitions("group").mapInArrow(
        _sort(length, group), "key long, around long, high int, least int, string long"), "repeats")
    release(spark)
    single = sorted_.where("string is not null")
    shared = single.groupBy("string").agg(F.min("around").alias("a"), F.max("around").alias("b"), F.count(F.lit(1)).alias("n"))
    many = join_counted(single, shared.where("a != b").select("string", "n"), "string", "n")
    repeats = sorted_.where("string is null").drop("string").unionByName(many.select("key", "around", "high", "least"))
    # surroundings that stand in several places repeat as a whole
    before, after = F.expr(f"cast(place div {PACK} % {PACK} as int)"), F.expr(f"cast(place % {PACK} as int)")
    whole = around.where("n > 1").where(before + after >= length).select(
        "key", "around", before.alias("high"), F.greatest(F.lit(0), length - after).alias("least"))
    covered = whole.unionByName(repeats).groupBy("key", "around").agg(F.max("high").alias("high"), F.min("least").alias("least"))
    covered = save(covered.join(around.select("key", "around", "n"), ["key", "around"]), "covered")
    at = F.expr(f"place div {PACK * PACK}")
    # surroundings that stand in very many places meet their extents by a broadcast
    spans = join_counted(anchors, covered, ["key", "around"], "n").select(
        "id", F.struct((at - F.col("high")).alias("a"), (at - F.col("least") + length).alias("b")).alias("s"))
    spans = save(spans.groupBy("id").agg(F.collect_set("s").alias("spans")), "spans")
    for done in (anchors, around, sorted_, covered):
        drop_saved(done)
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, keep: list[str], *, text: str = "text", length: int = 200, group: int | None = None) -> DataFrame:
    """``keep`` columns, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed`` and ``removed`` (maximal runs) for each row."""
    name = text_ids(docs, text)
    spans = repeated_spans(docs, name, text=text, length=length, group=group).withColumnRenamed("id", "_sid")
    source = docs.select(*keep, F.col(text).alias("_text"), name.alias("_id"))
    source = source.join(spans, F.col("_id") == F.col("_sid"), "left").select(*keep, "_text", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches):
        for batch in batches:
            spans = column(batch, "spans")
            counts = _lengths(spans)
            flat, ends = spans.flatten(), np.cumsum(counts)
            low = flat.field(0).to_numpy() if len(flat) else np.zeros(0, np.int64)
            high = flat.field(1).to_numpy() if len(flat) else np.zeros(0, np.int64)
            starts = ends - counts
            kept, sizes, gone, runs = [], [], [], []
            for row, n, data, offsets in text_slices(batch, "_text"):
                raw = data.tobytes()
                for i in range(n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    cut = slice(int(starts[row + i]), int(ends[row + i]))
                    merged = _merge(low[cut], high[cut])
                    out, at = [], a
                    for x, y in merged:
                        out.append(raw[at:a + x])
                        at = a + y
                    out.append(raw[at:b])
                    kept.append(b"".join(out))
                    sizes.append(b - a)
                    gone.append(b - a - len(kept[-1]))
                    runs.append([{"a": x, "b": y} for x, y in merged])
            yield pa.RecordBatch.from_arrays(
                [column(batch, k) for k in keep] + [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                                                    pa.array(gone, pa.int64()),
                                                    pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=[*keep, "kept", "n_bytes", "n_removed", "removed"])

    return source.mapInArrow(run, f"{schema}, kept binary, n_bytes long, n_removed long, removed array<struct<a:long,b:long>>")


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _merge(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals; touching ones become one."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(low, kind="stable"):
        a, b = int(low[k]), int(high[k])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
