"""Operator 1: token ids as Arrow files of equal-length sequences.

Documents in ascending id order are encoded and written as one stream, cut into
sequences of ``length`` ids. A shard is an Arrow IPC file whose record batches
hold ``input_ids`` (fixed-size list of unsigned ids) and ``mask`` (fixed-size
list of booleans, false on the padding of the shard's last sequence), stored
uncompressed, so that a memory-mapped reader gets any sequence as a view
without copying. Beside it a second Arrow file names its documents: id, first
token in the shard, number of tokens.

Shards are ranges of document ids, written by one task each under a temporary
name and then renamed: a retried or repeated task leaves the same bytes.

Nulls and edges: a null or empty text is its end token alone. Null ids sort
first; ids are longs, and one that is no number fails the cast. Equal ids stand
together, ordered by text. Long texts are encoded whole; the strings of special
tokens in a text are these tokens, as the tokenizer has it when loaded. Ids over
65,535 need ``wide``. An empty table writes no shard. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import column, partitions, save, scratch

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: How a tokenizer treats the space before a word: dropped, or kept as the word's first byte.
BOUNDARY = {WORD_BPE: "dropped", BYTE_BPE: "leading"}
CACHE_WORDS = 900_000
CACHE_LENGTH = 48
#: Stands alone between new words that are encoded as one text; words that hold it are encoded alone.
_MARK = "\x01"
_MARKED_WORDS = 2_000
#: ASCII marks that end a word: after a letter they are tokens of their own.
_TAIL = ".,;:!?%$&*#|)"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """A public tokenizer with a bounded cache of words, for texts cut where no token can reach across.

    A text is cut at its spaces. Where the tokenizer drops white space that is
    always safe. Where the space is the next word's first byte it is safe
    unless other white space stands beside it; such texts are encoded whole.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        # their strings in a text are their ids; such texts are encoded whole (matched without case, to be safe)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.boundary = BOUNDARY.get(name)
        # a word of letters is one piece to the tokenizer: its last token, or its first after a space, tells it
        mark = {"dropped": lambda t: t.endswith("</w>"), "leading": lambda t: t.startswith("Ġ")}.get(self.boundary)
        vocab = self.tokenizer.get_vocab() if mark else {}
        self.edge = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.edge[[i for t, i in vocab.items() if mark(t)]] = True
        self.line_end = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [-1])[-1]
        self.known: dict[str, bytes | None] = {}
        self.plain: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, words: list[str], before: str, mark: str) -> list[bytes]:
        """Ids of each word as it stands after ``before``, many words to a text with ``mark`` between them."""
        ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
        middle = self.tokenizer.encode(_MARK, add_special_tokens=False).ids[-1]
        left, right = ids.index(middle), len(ids) - ids.index(middle)
        groups = [words[a:a + _MARKED_WORDS] for a in range(0, len(words), _MARKED_WORDS)]
        texts = [before + (mark + before).join(g) for g in groups]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            at = np.array(e.ids, "<u4")
            raw = at.tobytes()
            marks = np.flatnonzero(at == middle)
            if len(marks) != len(group) - 1:
                raise ValueError("the mark between words is not a token of its own")
            starts, ends = [0, *(4 * (marks + right)).tolist()], [*(4 * (marks - left)).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(starts, ends)]
        return out

    def _lettered(self, words: list[str], before: str, mark: str) -> list[bytes]:
        """Ids of words of letters (ASCII where case is folded), each after a space, a word's end or a line end, many to a
        text and no mark between them."""
        out: list[bytes] = []
        groups = [words[a:a + _MARKED_WORDS] for a in range(0, len(words), _MARKED_WORDS)]
        lines = self.boundary == "leading" and not before
        texts = [before + ("\n" if lines else " ").join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            at = np.array(e.ids, "<u4")
            if lines:  # a line end between letters is a token of its own
                ends = 4 * np.flatnonzero(at == self.line_end)
                if len(ends) != len(group) - 1:
                    out += self._marked(group, before, mark)
                    continue
                raw = at.tobytes()
                out += [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]
                continue
            edges = 4 * np.flatnonzero(self.edge[at])
            if len(edges) != len(group):
                out += self._marked(group, before, mark)
                continue
            cuts = [*edges.tolist(), 4 * len(at)] if self.boundary == "leading" else [0, *(edges + 4).tolist()]
            raw = at.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, words: set[str], known: dict[str, bytes | None], before: str, mark: str) -> None:
        """Add words to ``known``; None marks a word whose text must be encoded whole.

        A word's stem is looked up without the marks that end it, and without
        case where the tokenizer folds it (ASCII only: beyond, folding and
        composition may not commute).
        """
        fold = self.boundary == "dropped"
        letters = [w for w in words if w.isalpha()]  # most words: they are their own stems
        split, odd = [], []
        for w in words.difference(letters):
            if _MARK in w or not w or w.strip() != w:
                odd.append(w)
                continue
            stem = w.rstrip(_TAIL)
            if not stem or not stem[-1].lower().isalpha():
                stem = w
            split.append((w, stem.lower() if fold and stem.isascii() else stem, w[len(stem):]))
        # set.difference looks each word up in the cache; difference_update would go through the whole cache
        if fold:
            folded = [w.lower() if w.isascii() else w for w in letters]
            fresh = {*folded, *(stem for _, stem, _ in split)}.difference(known)
            simple = [w for w in fresh if w.isascii() and w.isalpha()]
            fresh.difference_update(simple)
        else:  # words of letters are new as they come
            fresh = {stem for _, stem, _ in split}.difference(known)
            simple = letters + [w for w in fresh if w.isalpha() and w not in words]
            fresh = {w for w in fresh if not w.isalpha()}
        known.update(zip(simple, self._lettered(simple, before, mark)))
        fresh = list(fresh)
        known.update(zip(fresh, self._marked(fresh, before, mark)))
        tails = list({t for _, _, t in split if t not in self.tails})
        self.tails.update(zip(tails, self._encode(tails)))
        for w, stem, tail in split:
            known[w] = known[stem] + self.tails[tail]
        if fold:
            known.update(zip(letters, map(known.__getitem__, folded)))
        known.update(dict.fromkeys(odd) if not fold else zip(odd, self._encode(odd)))

    def _resolve(self, new: set[str]) -> None:
        if self.boundary == "dropped":
            self._learn(new, self.known, "", f" {_MARK} ")
            return
        # a line end between two words is a token of its own, and the next word has no space before it
        lines = {w: w.split("\n") for w in new if "\n" in w}
        single = {w for w in new if w not in lines}
        single.update(x[0] for x in lines.values() if x[0] not in self.known)
        self._learn(single, self.known, " ", f" {_MARK}")
        rest = {y for x in lines.values() for y in x[1:]}
        rest = rest.difference(self.plain)
        self._learn(rest, self.plain, "", f"\n{_MARK}\n")
        end = self._encode(["\n"])[0]
        for w, x in lines.items():
            parts = [self.known[x[0]], *(self.plain[y] for y in x[1:])]
            self.known[w] = None if None in parts else end.join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.boundary is None:
            return self._encode(texts)
        whole = [k for k, t in enumerate(texts) if "<|" in t and any(x in t.lower() for x in self.special)]
        if whole:
            some = set(whole)
            rest = self.encode([t for k, t in enumerate(texts) if k not in some])
            alone = dict(zip(whole, self._encode([texts[k] for k in whole])))
            left = iter(rest)
            return [alone[k] if k in some else next(left) for k in range(len(texts))]
        if len(self.known) + len(self.plain) > CACHE_WORDS:
            self.known, self.plain, self.tails = {}, {}, {"": b""}
        known, leading = self.known, self.boundary == "leading"
        words = [t.split(" ") if leading else t.replace("\n", " ").split(" ") for t in texts]
        heads = [x.pop(0) for x in words] if leading else []
        new = set().union(*words).difference(known)
        self._resolve(new)
        first = self._encode(heads) if leading else None
        out = []
        for k, (t, parts) in enumerate(zip(texts, words)):
            try:
                if not leading:
                    out.append(b"".join(map(known.__getitem__, parts)))
                elif parts and heads[k].strip() != heads[k]:
                    out.append(self._encode([t])[0])
                else:
                    out.append(first[k] + b"".join(map(known.__getitem__, parts)))
            except TypeError:  # an odd word
                out.append(self._encode([t])[0])
        for w in [w for w in new if len(w) > CACHE_LENGTH]:
            known.pop(w, None)
        return out


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encoded_batches(batches, tokenizer: str, end_id: int, text: str, step_bytes: int = 4 << 20):
    """Yield ``(batch, rows, ids)``: some rows of a batch and the ids of their texts, end token included."""
    enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = pc.fill_null(column(batch, text), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < batch.num_rows:
            done = sizes[row - 1] if row else 0
            stop = min(batch.num_rows, max(row + 1, int(np.searchsorted(sizes, done + step_bytes, "right"))))
            yield batch, range(row, stop), [x + end for x in enc.encode(texts.slice(row, stop - row).to_pylist())]
            row = stop


# ---------------------------------------------------------------- files

def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri) else (pafs.LocalFileSystem(), uri)


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([("input_ids", pa.list_(pa.field("item", ids, False), length)),
                      ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard long, sequences string, documents string, n_documents long, n_sequences long, n_tokens long"


class _ShardWriter:
    """Streams ids into an Arrow IPC file of fixed-size-list batches."""

    def __init__(self, uri: str, length: int, rows: int, wide: bool):
        self.fs, self.path = _place(uri)
        self.schema, self.length, self.rows = sequence_schema(length, wide), length, rows
        self.type = np.uint32 if wide else np.uint16
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        if self.type is np.uint16 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError(f"token id {int(ids.max())} needs wide=True")
        self.held.append(ids.astype(self.type))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.type)
        whole = len(ids) // self.length
        if last and len(ids) % self.length:
            pad = self.length - len(ids) % self.length
            mask = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)])
            ids = np.concatenate([ids, np.zeros(pad, self.type)])
            whole += 1
        else:
            if not last:  # only full batches before the last, so that a sequence's batch is known
                whole -= whole % self.rows
            mask = np.ones(whole * self.length, bool)
        for a in range(0, whole, self.rows):
            cut = slice(a * self.length, min(whole, a + self.rows) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v[cut]), type=f.type) for v, f in zip((ids, mask), self.schema)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += whole
        rest = ids[whole * self.length:]
        self.held, self.n_held = ([rest] if len(rest) else []), len(rest)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        _publish(self.fs, self.temporary, self.path)


def _publish(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(temporary, path)


def write_sequences(docs: DataFrame, out: str | None = None, *, tokenizer: str = WORD_BPE, length: int = 1024, end_id: int = 1,
                    rows: int = 256, wide: bool = False, text: str = "text") -> DataFrame:
    """Encode ``docs`` into shards below ``out`` (default: the shared folder); returns the manifest, a row for each shard."""
    out = out or scratch(docs.sparkSession, "tokens")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    source = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text") \
        .withColumn("_shard", F.spark_partition_id().cast("long"))

    def write(batches):
        writer = None
        ids_of, starts, sizes, shard = [], [], [], None
        for batch, at, ids in encoded_batches(batches, tokenizer, end_id, "_text"):
            if writer is None:
                shard = column(batch, "_shard")[0].as_py()
                fs, base = _place(out)
                fs.create_dir(base, recursive=True)
                writer = _ShardWriter(f"{out}/shard-{shard:07d}.arrow", length, rows, wide)
            start = writer.n_tokens
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ids_of += column(batch, "doc_id").slice(at.start, len(at)).to_pylist()
            starts.append(start + np.cumsum(n) - n)
            sizes.append(n)
            writer.add(np.frombuffer(b"".join(ids), "<u4"))
        if writer is None:
            return
        writer.close()
        name = f"{out}/shard-{shard:07d}.docs.arrow"
        fs, path = _place(name)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        table = pa.table([pa.array(ids_of, pa.int64()), np.concatenate(starts), np.concatenate(sizes)], schema=DOCS)
        with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, DOCS) as index:
            index.write_table(table, max_chunksize=65536)
        _publish(fs, temporary, path)
        yield pa.RecordBatch.from_pylist([{
            "shard": shard, "sequences": f"{out}/shard-{shard:07d}.arrow", "documents": name, "n_documents": len(ids_of),
            "n_sequences": writer.n_sequences, "n_tokens": writer.n_tokens}])

    return save(source.mapInArrow(write, MANIFEST), "manifest")


class SequenceFile:
    """A shard opened for random access; on a local or mounted path sequences are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        b = self.file.get_batch(k)
        return b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).values

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // self.rows)
        cut = slice(i % self.rows * self.length, (i % self.rows + 1) * self.length)
        return ids[cut], mask[cut].to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents of the shards, read from the files: id, first token in the whole stream, tokens and the crc32 of the ids.

    Mask bits must agree with the number of tokens, or the read fails.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    shards = manifest.withColumn("base", before)
    # a given number of tasks: the manifest is small, what its rows name is not
    shards = shards.repartition(max(8, partitions(manifest.sparkSession)), "shard")

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _read_shard(shard)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_shard(shard: dict):
    fs, path = _place(shard["documents"])
    with fs.open_input_file(path) as f:
        index = pa.ipc.open_file(f).read_all()
    starts = index.column("start").to_numpy()
    sizes = index.column("n_tokens").to_numpy()
    seq = SequenceFile(shard["sequences"])
    crc = np.zeros(len(starts), np.uint32)
    done, doc, real = 0, 0, 0
    for k in range(seq.file.num_record_batches):
        ids, mask = seq.batch(k)
        real += mask.true_count
        raw = memoryview(ids.astype("<u4").tobytes())
        stop = done + len(ids)
        while doc < len(starts) and starts[doc] < stop:
            a, b = max(starts[doc], done), min(starts[doc] + sizes[doc], stop)
            crc[doc] = zlib.crc32(raw[4 * (a - done):4 * (b - done)], int(crc[doc]))
            if starts[doc] + sizes[doc] > stop:
                break
            doc += 1
        done = stop
    if real != shard["n_tokens"] or doc != len(starts):
        raise ValueError(f"{shard['sequences']}: {real} tokens read, {shard['n_tokens']} written")
    for a in range(0, len(starts), 65536):
        cut = slice(a, a + 65536)
        yield pa.RecordBatch.from_arrays([
            index.column("doc_id")[cut].combine_chunks(), pa.array(starts[cut] + shard["base"]), pa.array(sizes[cut]),
            pa.array(crc[cut].astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])
