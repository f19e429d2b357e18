"""Shared helpers: scratch tables in the shared folder, and vectorised word and byte hashing for Arrow batches.

Texts are handled as the concatenated UTF-8 bytes of a slice of an Arrow batch
plus document offsets, so that one numpy call works on many documents at once.
A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.session import checkpoint_dir, release  # noqa: F401  (release: of the operators)

U64 = np.uint64
#: Bytes of text handled at once in a Python worker (longer documents are handled alone, whole).
SLICE_BYTES = 2 << 20
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- tables

def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a table written by :func:`save` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, mod: int):
    """True for rows whose crc32(doc_id as text) is divisible by ``mod``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == 0, F.lit(False))


# ---------------------------------------------------------------- slices of Arrow batches

def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Yield ``(first_row, n_rows, data, offsets)``: whole texts of consecutive rows, about ``limit`` bytes at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(col))
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array whose row i holds the bytes of ``values[offsets[i]:offsets[i + 1]]``."""
    values = np.ascontiguousarray(values)
    bounds = (np.asarray(offsets, np.int64) * values.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


# ---------------------------------------------------------------- hashing

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers of the hash base modulo 2**64, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        for k in [k for k in _powers if k > SLICE_BYTES * 2]:
            del _powers[k]
        pair = np.empty((2, size), U64)
        for row, base in zip(pair, (_BASE, _INVERSE)):
            row[0] = 1
            done = 1
            while done < size:
                row[done:2 * done] = row[:done] * U64(pow(base, done, 1 << 64))
                done *= 2
        _powers[size] = pair
    return _powers[size][0], _powers[size][1]


def rest() -> None:
    """At the end of a task: give back what a reused worker would hold while the JVM works."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**i; ``range_hash`` turns them into hashes of byte ranges."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (n + 1 values)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~WHITESPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= cut[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= cut[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of a slice, and each document's first word (n + 1 values)."""
    starts, ends, first = word_spans(data, offsets)
    return range_hash(prefix_hash(LOWER[data]), starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within documents; a document of 1 to size-1 words has one, of all its words.

    Returns the hashes and each document's first one (n + 1 values).
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(out_first[-1]) - out_first[doc] + first[doc]
    stop = np.minimum(first[doc + 1], at + size)
    h = np.zeros(len(at), U64)
    for k in range(size):
        here = at + k
        inside = here < stop
        if inside.all():
            h = (h ^ words[here]) * U64(0x9FB21C651E98DF25) + U64(k + 1)
        else:
            nxt = (h ^ words[np.minimum(here, len(words) - 1)]) * U64(0x9FB21C651E98DF25) + U64(k + 1)
            h = np.where(inside, nxt, h)
    return mix(h), out_first


# ---------------------------------------------------------------- sorted streams

def sorted_groups(batches, keys: list[str]):
    """Yield one Arrow table per run of equal ``keys`` in a sorted stream of batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = column(batch, k)
            if batch.num_rows > 1:
                change[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)), True).to_numpy(
                    zero_copy_only=False)
        bounds = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(column(held[-1], k)[len(held[-1]) - 1] != column(batch, k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for b in bounds[:-1]:
            yield pa.Table.from_batches([*held, batch.slice(start, b - start)])
            held, start = [], b
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def bounded_groups(batches, key: str, limit: int):
    """Cut a stream sorted by ``key`` into ``(over, table)``: whole groups of at most ``limit`` rows, many to a table, or
    (``over``) rows of larger groups as they come. Never holds more than ``limit`` rows and a batch."""
    held, open_key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if open_key is not None:  # the rest of a group that was too large
            same = np.append(pc.equal(table.column(key), open_key).to_numpy(zero_copy_only=False), False)
            n = int(np.argmin(same))
            if n:
                yield True, table.slice(0, n)
                table = table.slice(n)
            if not table.num_rows:
                continue
            open_key = None
        if held is not None:
            table = pa.concat_tables([held, table])
        col = table.column(key).combine_chunks()
        n = len(col)
        change = np.ones(n, bool)
        if n > 1:
            change[1:] = pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(change)
        sizes = np.diff(np.append(first, n))
        last = int(first[-1])
        large = np.repeat(sizes > limit, sizes)[:last]
        if large.any():
            yield True, table.slice(0, last).filter(pa.array(large))
            yield False, table.slice(0, last).filter(pa.array(~large))
        elif last:
            yield False, table.slice(0, last)
        if n - last > limit:
            yield True, table.slice(last)
            held, open_key = None, col[last]
        else:
            held = table.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield False, held


def join_counted(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` to ``keyed`` (one row a key, with the number of rows it meets in ``count``) without a hot task.

    Keys that hold over a thousandth of the rows are at most a thousand, so they
    are broadcast; the rest is joined by shuffling.
    """
    names = [key] if isinstance(key, str) else key
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(count) * 1000 > total))
    cold = rows.join(hot.select(*names), key, "left_anti").join(keyed.where(F.col(count) * 1000 <= total), key)
    return rows.join(hot, key).unionByName(cold)
