"""Operator 9: n-gram Jaccard join with a MinHash LSH forest.

A text is the set of its word shingles (five words, A-Z lower-cased). Its
signature is cut into ``trees`` keys of ``max_depth`` minima; sorted, the keys of
a tree are a prefix trie. Matched prefixes are shortened from ``max_depth`` until
a pair of the wanted similarity shares one in some tree with probability
``recall``; texts below one such trie node are candidates, and are verified on
their exact shingle sets.

A trie node of any size is worked on in blocks of texts by hash, a task for each two
blocks, so that hot nodes are split; tasks return link counts and a star for
each connected part, never the pairs. A pair that meets in several trees counts
in the first one only. Texts are nodes, equal texts (copies) one node with its
number of rows; copies are never paired with each other.

Nulls and edges: a null text is empty. A text of 1 to 4 words has the one
shingle of all its words; a text without words has none and links to nothing but
its copies. Repeated rows are copies. A null id is kept, and ranks after all
others when a class is named. Long texts are handled whole. Empty tables give no rows.
Columns other than the id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import (U64, binary_rows, column, drop_saved, mix, release, save, shingle_hashes,
                                 sorted_groups, text_slices, word_hashes)
from maskloom.llm.components import components

#: Texts of one block of a trie node.
BLOCK = 256
#: Cells of one dense incidence matrix in a verification.
CELLS = 8 << 20


def forest_depth(similarity: float, recall: float, trees: int, max_depth: int) -> int:
    """Prefix length: shortened from ``max_depth`` until the chance of a shared prefix reaches ``recall``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def text_node(text: str = "text") -> Column:
    """Identity of a text: 16 bytes, equal for equal texts (null as empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sketch(n_hashes: int, words: int):
    rng = np.random.default_rng(9)
    factor = (rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32) | np.uint32(1))
    salt = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, n_hashes), np.uint32)
            some = np.zeros(batch.num_rows, bool)
            for row, n, data, offsets in text_slices(batch, "_text"):
                h, first = shingle_hashes(*word_hashes(data, offsets), words)
                h = (h >> U64(32)).astype(np.uint32)
                have = np.flatnonzero(np.diff(first))
                if not len(have):
                    continue
                starts = first[:-1][have]
                for k in range(n_hashes):
                    out[row + have, k] = np.minimum.reduceat((h ^ salt[k]) * factor[k], starts)
                some[row + have] = True
            keep = np.flatnonzero(some)
            pick = pa.array(keep)
            sig = out[keep].astype(">u4")
            yield pa.RecordBatch.from_arrays([
                column(batch, "_node").take(pick), column(batch, "doc_id").take(pick),
                binary_rows(sig.reshape(-1), np.arange(len(keep) + 1) * n_hashes)], names=["node", "doc_id", "sig"])

    return run


def _forest(trees: int, max_depth: int):
    """Rows (tree, key, node): the keys of every text."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint8).reshape(n, trees, max_depth * 4)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, t, np.int32)),
                    binary_rows(np.ascontiguousarray(sig[:, t]).reshape(-1), np.arange(n + 1) * (max_depth * 4)),
                    column(batch, "node")], names=["tree", "key", "node"])
    return run


def _prefix_ids(sig: np.ndarray, depth: int) -> np.ndarray:
    """(texts, trees, max_depth) minima to one 64-bit id of each text's trie node in each tree."""
    h = np.broadcast_to(np.arange(1, sig.shape[1] + 1, dtype=U64), sig.shape[:2]).copy()
    for k in range(depth):
        h = mix((h ^ sig[:, :, k].astype(U64)) * U64(0x9FB21C651E98DF25))
    return h


def _prefixes(trees: int, max_depth: int, depth: int):
    """Rows (node, prefix): the ids of a text's trie nodes, one for each tree."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), ">u4").reshape(n, trees, max_depth)
            yield pa.RecordBatch.from_arrays([column(batch, "node"), binary_rows(
                _prefix_ids(sig, depth).reshape(-1), np.arange(n + 1) * trees)], names=["node", "prefix"])
    return run


def _trie_nodes(depth: int):
    """From keys sorted by (tree, key): texts below trie nodes of that depth with two texts or more."""
    def run(batches):
        carry = None
        for batch in _with_next(batches):
            tree = column(batch, "tree").to_numpy()
            raw = np.frombuffer(b"".join(column(batch, "key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            head = raw[:, :depth * 4]
            same = np.zeros(batch.num_rows, bool)  # common prefix with the row before reaches the depth
            same[1:] = (tree[1:] == tree[:-1]) & (head[1:] == head[:-1]).all(1)
            if carry is not None:
                same[0] = carry == (tree[0], head[0].tobytes())
            after = np.append(same[1:], batch.schema.metadata == {b"next": b"1"})
            carry = (tree[-1], head[-1].tobytes())
            pick = np.flatnonzero(same | after)
            if not len(pick):
                continue
            h = U64(0) + tree[pick].astype(U64) + U64(1)
            for k in range(depth):
                value = np.ascontiguousarray(head[pick, 4 * k:4 * k + 4]).view(">u4").reshape(-1)
                h = mix((h ^ value.astype(U64)) * U64(0x9FB21C651E98DF25))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tree[pick]),
                                              column(batch, "node").take(pa.array(pick))], names=["gid", "tree", "node"])

    def _with_next(batches):
        """Each batch, marked when the next one begins below its last trie node."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held.replace_schema_metadata({"next": str(int(_same_head(held, batch)))})
            held = batch
        if held is not None:
            yield held.replace_schema_metadata({"next": "0"})

    def _same_head(a, b):
        return column(a, "tree")[-1].as_py() == column(b, "tree")[0].as_py() and \
            column(a, "key")[-1].as_py()[:depth * 4] == column(b, "key")[0].as_py()[:depth * 4]

    return run


def _first_shared(prefixes: np.ndarray) -> np.ndarray:
    """For each two texts the first tree in which they share a trie node (the number of trees, if none)."""
    m, trees = prefixes.shape
    first = np.full((m, m), trees, np.int16)
    for t in range(trees - 1, -1, -1):
        first[prefixes[:, None, t] == prefixes[None, :, t]] = t
    return first


def _wanted(group: pa.Table) -> np.ndarray:
    """Which pairs of the texts of a block pair this task decides."""
    first = _first_shared(np.frombuffer(b"".join(group.column("prefix").to_pylist()), U64).reshape(group.num_rows, -1))
    mine = first == group.column("tree")[0].as_py()
    np.fill_diagonal(mine, False)
    left, right, own = (group.column(c).to_numpy() for c in ("left", "right", "own"))
    if left[0] != right[0]:
        mine &= own[:, None] != own[None, :]
    return mine


def _members(batches):
    """Texts that take part in at least one pair of their block pair."""
    for group in sorted_groups(batches, ["gid", "left", "right"]):
        if group.num_rows < 2:
            continue
        pick = np.flatnonzero(_wanted(group).any(1))
        if len(pick):
            out = group.take(pa.array(pick)).select(["node", "gid", "left", "right", "own", "tree"]).combine_chunks()
            yield from out.to_batches()


def _attach_sets(words: int):
    """A row for each task of a text, with its sorted distinct shingles."""
    def run(batches):
        for batch in batches:
            tasks = column(batch, "tasks")
            for row, n, data, offsets in text_slices(batch, "_text"):
                h, first = shingle_hashes(*word_hashes(data, offsets), words)
                sets = [np.unique(h[a:b]) for a, b in zip(first, first[1:])]
                part = tasks.slice(row, n)
                counts = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                where = np.repeat(np.arange(n), counts)
                flat = part.flatten()
                step = max(1, (4 << 20) // max(1, max(map(len, sets), default=1) * 8))
                for a in range(0, len(where), step):
                    at = where[a:a + step]
                    pick = pa.array(row + at)
                    body = [sets[i] for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, c).take(pick) for c in ("node", "copies", "prefix")]
                        + [flat.slice(a, len(at)).field(k) for k in range(5)]
                        + [binary_rows(np.concatenate(body), np.cumsum([0, *map(len, body)]))],
                        names=["node", "copies", "prefix", "gid", "left", "right", "own", "tree", "set"])
    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from dense incidence matrices of bounded size."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(1, CELLS // m)
    total = np.zeros((m, m), np.float64)
    start = 0
    while start < len(place):
        low = place[start]
        stop = int(np.searchsorted(place, low + width))
        table = np.zeros((m, min(width, int(place[stop - 1] - low) + 1)), np.float32)
        table[owner[start:stop], place[start:stop] - low] = 1
        total += table @ table.T
        start = stop
    return total


def _verify(similarity: float):
    """Per text of a block pair: rows linked to it, and the least text of its connected part."""
    def run(batches):
        nodes, counts, roots = [], [], []
        for group in sorted_groups(batches, ["gid", "left", "right"]):
            m = group.num_rows
            if m < 2:
                continue
            mine = _wanted(group)
            sets = [np.frombuffer(b, U64) for b in group.column("set").to_pylist()]
            size = np.array([len(s) for s in sets], np.float64)
            both = _overlaps(sets)
            linked = mine & (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9)
            weight = linked @ group.column("copies").to_numpy().astype(np.int64)
            names = group.column("node").to_pylist()
            label = np.argsort(np.argsort(np.array([n.hex() for n in names])))
            by_rank = np.argsort(label)
            while True:
                least = np.where(linked, label[None, :], m).min(1)
                new = np.minimum(label, least)
                if (new == label).all():
                    break
                label = new
            for i in np.flatnonzero(weight):
                nodes.append(names[i])
                counts.append(int(weight[i]))
                roots.append(names[by_rank[label[i]]])
            if len(nodes) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()),
                                                  pa.array(roots, pa.binary())], names=["node", "links", "root"])
                nodes, counts, roots = [], [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()),
                                              pa.array(roots, pa.binary())], names=["node", "links", "root"])
    return run


def classes(docs: DataFrame, *, text: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999,
            trees: int = 16, max_depth: int = 6) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``node`` (its text), ``root`` (its class's least text), ``class_id``
    and ``n_links``.

    ``class_id`` is the least id of the connected component; ``n_links`` counts
    the other rows whose similarity reaches the threshold, copies included.
    """
    spark = docs.sparkSession
    depth = forest_depth(similarity, recall, trees, max_depth)
    source = docs.select("doc_id", F.col(text).alias("_text"), text_node(text).alias("_node"))
    rows = docs.select("doc_id", text_node(text).alias("node"))
    sketches = save(source.mapInArrow(_sketch(trees * max_depth, words),
                                      f"node binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, sig binary"), "sketches")
    # the least id of a text stands for its copies
    texts = save(sketches.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                              F.max("sig").alias("sig")), "texts")
    drop_saved(sketches)
    release(spark)
    keys = texts.select("node", "sig").mapInArrow(_forest(trees, max_depth), "tree int, key binary, node binary")
    head = F.substring("key", 1, depth * 4)
    below = keys.withColumn("_head", F.xxhash64("tree", head)).repartition("_head").drop("_head") \
        .sortWithinPartitions("tree", "key").mapInArrow(_trie_nodes(depth), "gid long, tree int, node binary")
    below = save(below, "trie-nodes")
    sizes = below.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("tree").alias("tree"),
                                     F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("least"))
    release(spark)
    # trie nodes of several trees over the same texts: one is enough
    kept = sizes.groupBy("m", "x", "least").agg(F.min(F.struct("tree", "gid")).alias("g")).select("g.gid", "m")
    prefixes = texts.select("node", "sig").mapInArrow(_prefixes(trees, max_depth, depth), "node binary, prefix binary")
    member = below.join(kept, "gid").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("node", "gid", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                           "own", "tree").join(prefixes, "node")
    order = ["gid", "left", "right"]
    tasks = member.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _members, "node binary, gid long, left int, right int, own int, tree int")
    # written, so that what led to the tasks is off the disks before texts and sets move
    tasks = save(tasks.groupBy("node").agg(F.collect_list(F.struct(*order, "own", "tree")).alias("tasks")), "block-tasks")
    drop_saved(below)
    release(spark)
    tasks = tasks.join(texts.select("node", "rep", "copies"), "node").join(prefixes, "node")
    body = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"), text_node(text).alias("_node"))
    # rows that repeat id and text would give their text twice
    busy = body.join(tasks, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("rep"))) \
        .dropDuplicates(["node"]).select("node", "copies", "prefix", "tasks", "_text")
    sets = busy.mapInArrow(_attach_sets(words), "node binary, copies long, prefix binary, gid long, left int, right int, "
                                                "own int, tree int, set binary")
    found = save(sets.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _verify(similarity), "node binary, links long, root binary"), "links")
    release(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    grouped = texts.select("node", "rep", "copies").join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")),
                                                         "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = grouped.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_text = grouped.join(names, "root").join(links, "node", "left").select(
        "node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = rows.join(of_text.select("node"), "node", "left_anti").groupBy("node").agg(
        F.first("node").alias("root"), F.min("doc_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return rows.join(of_text.unionByName(empty), "node").select(
        "doc_id", "node", "root", "class_id", "n_links")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one of least id (null ids last), with the columns of ``docs``."""
    text = options.get("text", "text")
    found = save(classes(docs, **options), "classes")
    release(docs.sparkSession)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))
    first = found.groupBy("root").agg(F.min(rank).alias("r"))
    keep = first.select(F.col("r.doc_id").alias("_keep_id"), F.col("r.node").alias("_keep_node"))
    marked = docs.withColumn("_node", text_node(text))
    hit = marked.join(keep, (F.col("_node") == F.col("_keep_node")) & F.col("doc_id").eqNullSafe(F.col("_keep_id")))
    return hit.dropDuplicates(["_keep_id", "_keep_node"]).select(*docs.columns)
