"""Operator 3: language-model scores by logistic context mixing.

A text is its words, A-Z lower-cased, joined by single spaces and ended by one
end symbol, predicted bit by bit. Bit predictors of orders 1 to 4 and of the word so
far read hashed contexts (the bytes before, or those since the last space, and the
bits of the byte so far) in tables of 2**TABLE_BITS slots of zeros and ones counted
over all training texts, kept in two bytes a slot. Their stretched probabilities are mixed by weights gated on
bit place and on the evidence behind the word so far, learnt online by logistic
Newton steps, with each window's own occurrence left out of the counts; an
adaptive probability map then refines the mix. A bit's context lies in a window of
five bytes and a 24-bit hash of the word so far, so the corpus is gathered as counts
of its different windows (a table that grows with the input), and a worker keeps
the answers for the windows it met, in a table of fixed size.

The unigram base needs the training count of every word of a text: documents are
dealt into blocks, words counted by block and summed over all, and the counts
sent back to the blocks that hold the word. Words are compared by 64-bit hashes.

Nulls and edges: a null text is empty and holds the end alone. A null id is
training. Repeated rows are scored each and counted each. Long texts are scored
whole, in bounded slices of whole texts. Without training texts every
probability is one half per bit and the base counts are zero. Columns other
than the id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import (LOWER, U64, column, drop_saved, held_out, mix, partitions, prefix_hash, range_hash, release,
                                 rest, save, text_slices, word_spans)

ORDERS = (1, 2, 3, 4)
PREDICTORS = len(ORDERS) + 1  # the orders, then the word so far
TABLE_BITS = 21
EVIDENCE = np.array([0.5, 1.5, 3.5, 15.5, 255.5], np.float32)
GATES = 8 * (len(EVIDENCE) + 1)
INPUTS = PREDICTORS + 1
APM_STEPS = 33
#: Curvature that a gate starts with: evidence for its first weights.
RIDGE = 50.0
#: Windows of one training task; more windows make more tasks.
TASK_WINDOWS = 2_000_000
SPACE, END = 32, 10
END_WORD = np.array([0x7E57ED], U64)
#: Bytes of text handled at once, and different words and windows that a task counts before it hands them on.
STEP = 1 << 19
HELD = 2_000_000


def _streams(data: np.ndarray, offsets: np.ndarray):
    """Normalised bytes of the texts of a slice, each text's first byte (n + 1 values), word hashes and first words."""
    starts, ends, first = word_spans(data, offsets)
    low = LOWER[data]
    words = range_hash(prefix_hash(low), starts, ends)
    counts = np.diff(first)
    empty = np.flatnonzero(counts == 0)
    where = first[empty]
    s, e = np.insert(starts, where, 0), np.insert(ends, where, 0)  # a text without words: an empty word and the end
    n = np.maximum(counts, 1)
    bounds = np.concatenate([[0], np.cumsum(n)])
    size = e - s + 1
    out_end = np.cumsum(size)
    index = np.arange(out_end[-1] if len(out_end) else 0) - np.repeat(out_end - size, size) + np.repeat(s, size)
    body = low[np.minimum(index, len(low) - 1)] if len(low) else np.zeros(len(index), np.uint8)
    body[out_end - 1] = SPACE
    body[out_end[bounds[1:] - 1] - 1] = END
    return body, np.concatenate([[0], out_end[bounds[1:] - 1]]), words, first


def _windows(body: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte, the four before it in its text (the end symbol before the text) and a hash of its word so far, packed."""
    index = np.arange(len(body), dtype=np.int32 if len(body) < 1 << 31 else np.int64)
    local = index - np.repeat(first[:-1].astype(index.dtype), np.diff(first))
    fresh = np.ones(len(body), bool)  # every text's last byte is the end symbol
    fresh[1:] = (body[:-1] == SPACE) | (body[:-1] == END)
    word = np.maximum.accumulate(np.where(fresh, index, 0))
    out = body.astype(U64) | ((range_hash(prefix_hash(body), word, index) >> U64(40)) << U64(40))
    for lag in range(1, ORDERS[-1] + 1):
        before = np.empty(len(body), U64)
        before[lag:] = body[:-lag] if lag < len(body) else 0
        before[:lag] = END
        before[local < lag] = END
        out |= before << U64(8 * lag)
    return out


def _counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in the order they came, in which the weights are learnt, and the sum of each one's counts (none given: one each)."""
    code, names = pd.factorize(keys)
    return names, np.bincount(code, counts, len(names)).astype(np.int64)


class _Tally:
    """Counts of keys, merged whenever they have doubled."""

    def __init__(self):
        self.pairs, self.size, self.merged = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pairs.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD // 4 + 2 * self.merged:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) > 1:
            self.pairs = [_counts(*(np.concatenate(x) for x in zip(*self.pairs)))]
        self.size = self.merged = len(self.pairs[0][0])
        return self.pairs[0]


def _gather(batches):
    """(block, word, n) with n the training count, and (null, window, n), for the texts of a task."""
    tallies: dict[int | None, _Tally] = {}

    def flush():
        for block, tally in tallies.items():
            names, n = tally.merge()
            blocks = pa.nulls(len(names), pa.int32()) if block is None else pa.array(np.full(len(names), block, np.int32))
            for a in range(0, len(names), 1 << 17):
                cut = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([blocks[cut], pa.array(names[cut].view(np.int64)), pa.array(n[cut])],
                                                 names=["block", "key", "n"])
        tallies.clear()

    for batch in batches:
        held = np.asarray(column(batch, "held_out").to_numpy(zero_copy_only=False), bool)
        block = column(batch, "block").to_numpy()
        for row, n, data, offsets in text_slices(batch, "_text", STEP):
            body, first, hashes, first_word = _streams(data, offsets)
            train = ~held[row:row + n]
            mine = block[row:row + n]
            blocks = np.repeat(mine, np.diff(first_word))
            weight = np.repeat(train, np.diff(first_word))
            for b in np.unique(mine):
                tally = tallies.setdefault(int(b), _Tally())
                here = blocks == b
                tally.add(*_counts(np.append(hashes[here], END_WORD), np.append(weight[here], train[mine == b].sum())))
            used = _windows(body, first)[np.repeat(train, np.diff(first))]
            if len(used):
                tallies.setdefault(None, _Tally()).add(*_counts(used))
            if sum(t.size for t in tallies.values()) > HELD:
                for t in tallies.values():
                    t.merge()
                if sum(t.size for t in tallies.values()) > HELD // 2:
                    yield from flush()
    yield from flush()
    rest()


def _levels() -> np.ndarray:
    """The 256 counts that a slot can tell apart: 0 to 32, then steps of 14 % up to 10**14."""
    return np.concatenate([np.arange(33), np.geomspace(32, 1e14, 224)[1:]])


def _answers() -> tuple[np.ndarray, np.ndarray]:
    """Stretched prediction and evidence of every slot code, as it is, and with one zero or one one left out."""
    zeros, ones = np.repeat(_levels(), 256), np.tile(_levels(), 256)
    cases = [(zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))]
    stretch = np.concatenate([np.clip(np.log((b + 0.05) / (a + 0.05)), -12, 12) for a, b in cases])
    return stretch.astype(np.float32), np.concatenate([np.searchsorted(EVIDENCE, a + b) for a, b in cases])


STRETCH, BACKING = _answers()


def slot_codes(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts of slots as codes: the level of the zeros in the high byte, of the ones in the low byte."""
    levels = _levels()
    middle = (levels[1:] + levels[:-1]) / 2
    return (np.searchsorted(middle, zeros) << 8 | np.searchsorted(middle, ones)).astype(np.uint16)


class Model:
    """Slot codes of all predictors, mixing weights and the probability map."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, apm: np.ndarray | None):
        self.codes, self.weights, self.apm = codes, weights, apm

    @staticmethod
    def context(windows: np.ndarray, i: int) -> np.ndarray:
        if i == len(ORDERS):
            return mix((windows >> U64(40)) * U64(8))
        k = ORDERS[i]
        return mix(((windows >> U64(8)) & U64((1 << 8 * k) - 1)) * U64(8) + U64(k))

    @staticmethod
    def contexts(windows: np.ndarray) -> list[np.ndarray]:
        return [Model.context(windows, i) for i in range(PREDICTORS)]

    @staticmethod
    def slot(context: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Places in a predictor's table, of contexts and the salts of nodes."""
        out = context ^ salt
        out *= U64(0xD6E8FEB86659FD93)
        out >>= U64(64 - TABLE_BITS)
        return out.view(np.int64)

    @staticmethod
    def salt(node: np.ndarray) -> np.ndarray:
        return node.astype(U64) * U64(0x9E3779B97F4A7C15)

    @staticmethod
    def slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        """For each predictor, places in its own table."""
        salt = Model.salt(node)
        return [Model.slot(c, salt) for c in contexts]

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray, leave: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (and a bias), and the amount of evidence behind the word so far (a place in EVIDENCE).

        ``leave`` leaves one occurrence of the bit itself out of the counts.
        """
        x = np.empty((INPUTS, len(bit)), np.float32)
        x[-1] = 0.3
        case = (1 + bit) << 16 if leave else np.int64(0)
        for i, s in enumerate(slots):
            at = self.codes[i << TABLE_BITS:(i + 1) << TABLE_BITS][s] + case
            np.take(STRETCH, at, out=x[i], mode="clip")
        return x, BACKING[at]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = self.weights[:, 0].take(gate) * x[0]
        for k in range(1, INPUTS):
            out += self.weights[:, k].take(gate) * x[k]
        return np.clip(out, -12, 12)

    def refined(self, stretch: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mix averaged, in the logistic domain, with the map's answer."""
        if self.apm is not None:
            at, part = apm_place(stretch)
            row = node.astype(np.int64) * APM_STEPS + at
            stretch = (stretch + self.apm[row] * (1 - part) + self.apm[row + 1] * part) / 2
        return 1 / (1 + np.exp(-stretch.astype(np.float64)))

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte given those before."""
        contexts, byte = self.contexts(windows), (windows & U64(255)).astype(np.int64)
        out = np.zeros(len(windows))
        for b in range(8):
            node, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1
            x, evidence = self.inputs(self.slots(contexts, node), bit, False)
            p = self.refined(self.mixed(x, b * (len(EVIDENCE) + 1) + evidence), node)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def apm_place(stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(stretch, -11.99, 11.99) + 12) * ((APM_STEPS - 1) / 24)
    low = at.astype(np.int64)
    return low, at - low


def _count_slots(batches):
    """Zeros and ones of the slots that a task's windows touch, one predictor after the other."""
    held = [(column(batch, "key").to_numpy().view(U64), column(batch, "n").to_numpy()) for batch in batches]
    for i in range(PREDICTORS):
        seen = np.zeros(2 << TABLE_BITS)  # of each slot the zeros, then the ones
        for windows, n in held:
            context, byte, n = Model.context(windows, i), (windows & U64(255)).astype(np.int64), n.astype(np.float64)
            for b in range(8):
                s = Model.slot(context, Model.salt((1 << b) | (byte >> (8 - b))))
                np.add.at(seen, (s << 1) | ((byte >> (7 - b)) & 1), n)  # fast as long as both sides are doubles
        seen = seen.reshape(-1, 2)
        some = np.flatnonzero(seen.any(1))
        for a in range(0, len(some), 1 << 18):
            s = some[a:a + (1 << 18)]
            zeros, ones = seen[s].astype(np.float32).T
            yield pa.RecordBatch.from_arrays(
                [pa.array((s + (i << TABLE_BITS)).astype(np.int32)), pa.array(zeros.copy()), pa.array(ones.copy())],
                names=["slot", "zeros", "ones"])
    del held, seen
    rest()


def _coded(batches):
    for batch in batches:
        codes = slot_codes(column(batch, "zeros").to_numpy(), column(batch, "ones").to_numpy())
        yield pa.RecordBatch.from_arrays([column(batch, "slot"), pa.array(codes.view(np.int16))], names=["slot", "code"])


def _learn(shared):
    """One online pass over a task's windows: Newton steps per gate, each on the curvature met so far.

    Yields the curvature (input, other) and its product with the weights (other null) of every gate, so that
    the tasks' weights can be averaged by the evidence behind them.
    """
    def run(batches):
        model = Model(*shared.value)
        weights = model.weights.astype(np.float64)
        curve = np.tile(np.eye(INPUTS) * RIDGE, (GATES, 1, 1))
        for batch in batches:
            windows, n = column(batch, "key").to_numpy().view(U64), column(batch, "n").to_numpy().astype(np.float64)
            for a in range(0, len(windows), 8192):
                w, c = windows[a:a + 8192], n[a:a + 8192]
                contexts, byte = model.contexts(w), (w & U64(255)).astype(np.int64)
                for b in range(8):
                    node, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1
                    x, evidence = model.inputs(model.slots(contexts, node), bit, True)
                    order = np.argsort(evidence.astype(np.uint8), kind="stable")
                    by_gate, counts, bits = x[:, order].astype(np.float64), c[order], bit[order]
                    cut = np.searchsorted(evidence[order], np.arange(len(EVIDENCE) + 2))
                    for e in np.flatnonzero(np.diff(cut)):
                        mine = slice(cut[e], cut[e + 1])
                        gate, xs, cs = b * (len(EVIDENCE) + 1) + e, by_gate[:, mine], counts[mine]
                        p = 1 / (1 + np.exp(-np.clip(weights[gate] @ xs, -12, 12)))
                        curve[gate] += (xs * (cs * np.maximum(p * (1 - p), 0.01))) @ xs.T
                        step = np.linalg.solve(curve[gate], xs @ (cs * (bits[mine] - p)))
                        weights[gate] += step / max(1.0, 4 * np.abs(step).max())
        product = np.einsum("gij,gj->gi", curve, weights)
        gate, i, j = np.indices(curve.shape, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([gate.ravel(), gate[:, :, 0].ravel()])),
             pa.array(np.concatenate([i.ravel(), i[:, :, 0].ravel()])),
             pa.array(np.concatenate([j.ravel(), np.full(product.size, INPUTS, np.int32)])),
             pa.array(np.concatenate([curve.ravel(), product.ravel()]))], names=["gate", "input", "other", "value"])
        rest()
    return run


def _map_counts(shared):
    """Zeros and ones seen at each place of the probability map."""
    def run(batches):
        model = Model(*shared.value)
        seen = np.zeros((2, 256 * APM_STEPS + 1))
        for batch in batches:
            windows, n = column(batch, "key").to_numpy().view(U64), column(batch, "n").to_numpy().astype(np.float64)
            contexts, byte = model.contexts(windows), (windows & U64(255)).astype(np.int64)
            for b in range(8):
                node, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1
                x, evidence = model.inputs(model.slots(contexts, node), bit, True)
                at, part = apm_place(model.mixed(x, b * (len(EVIDENCE) + 1) + evidence))
                row = node * APM_STEPS + at
                for value in (0, 1):
                    mine = bit == value
                    seen[value] += np.bincount(row[mine], (n * (1 - part))[mine], seen.shape[1])
                    seen[value] += np.bincount(row[mine] + 1, (n * part)[mine], seen.shape[1])
        some = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0][some]), pa.array(seen[1][some])],
                                         names=["place", "zeros", "ones"])
        rest()
    return run


def train(windows: DataFrame, *, rounds: int = 2) -> Model:
    """The model of a table of windows (key, n). Only tables of fixed size reach the driver."""
    spark = windows.sparkSession
    tasks = 1 + windows.count() // TASK_WINDOWS
    word = F.shiftrightunsigned("key", 40)  # a word so far counts its slots in one task; the empty one, 0, in all
    windows = save(windows.repartition(tasks, F.when(word == 0, F.col("key")).otherwise(word)), "windows")
    got = windows.mapInArrow(_count_slots, "slot int, zeros float, ones float").groupBy("slot").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).mapInArrow(_coded, "slot int, code short").toArrow()
    codes = np.zeros(PREDICTORS << TABLE_BITS, np.uint16)
    codes[got.column("slot").to_numpy()] = got.column("code").to_numpy().view(np.uint16)
    del got
    model = Model(codes, np.full((GATES, INPUTS), 0.3, np.float32), None)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.codes, model.weights, None))
        both = np.zeros((GATES, INPUTS, INPUTS + 1))
        for r in windows.mapInArrow(_learn(shared), "gate int, input int, other int, value double").groupBy(
                "gate", "input", "other").agg(F.sum("value").alias("value")).collect():
            both[r["gate"], r["input"], r["other"]] = r["value"]
        if both.any():
            model.weights = np.linalg.solve(both[:, :, :-1], both[:, :, -1:])[:, :, 0].astype(np.float32)
        shared.destroy()
    shared = spark.sparkContext.broadcast((model.codes, model.weights, None))
    apm = np.tile(np.linspace(-12, 12, APM_STEPS), 256)
    apm = np.append(apm, apm[-1])
    for r in windows.mapInArrow(_map_counts(shared), "place int, zeros double, ones double").groupBy("place").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect():
        prior = 1 / (1 + math.exp(-apm[r["place"]]))
        p = (r["ones"] + 8 * prior) / (r["zeros"] + r["ones"] + 8)
        apm[r["place"]] = min(12.0, max(-12.0, math.log(p / (1 - p)) if 0 < p < 1 else apm[r["place"]]))
    model.apm = apm.astype(np.float32)
    shared.destroy()
    drop_saved(windows)
    return model


class _Scorer:
    """Evaluates windows, and keeps the last one of each place of a table of fixed size."""

    BITS = 21

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.full(1 << self.BITS, ~U64(0)), np.zeros(1 << self.BITS)  # no text has a byte 255

    def place(self, windows: np.ndarray) -> np.ndarray:
        return ((windows * U64(0xD6E8FEB86659FD93)) >> U64(64 - self.BITS)).view(np.int64)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        place = self.place(windows)
        value = self.values[place]
        new = np.flatnonzero(self.keys[place] != windows)
        if len(new):
            code, names = pd.factorize(windows[new])
            got = np.concatenate([self.model.log10(names[a:a + 16384]) for a in range(0, len(names), 16384)])
            value[new] = got[code]
            place = self.place(names)
            self.keys[place] = names
            kept = self.keys[place] == names  # of several for a place, one
            self.values[place[kept]] = got[kept]
        return value


def _score(shared, keep: list[str], n_train: int, n_words: int):
    def run(batches):
        scorer = _Scorer(Model(*shared.value))
        block, keys, counts, table = None, [], [], None
        for batch in batches:
            kind = column(batch, "kind").to_numpy()
            blocks = column(batch, "block").to_numpy()
            cut = np.flatnonzero(np.append(True, (np.diff(kind) != 0) | (np.diff(blocks) != 0)))
            for a, b in zip(cut, np.append(cut[1:], len(kind))):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, keys, counts, table = blocks[a], [], [], None
                if kind[a] == 0:
                    keys.append(column(part, "key").to_numpy().view(U64))
                    counts.append(column(part, "c").to_numpy())
                    continue
                if table is None:
                    k = np.concatenate(keys)
                    order = np.argsort(k)
                    table = k[order], np.concatenate(counts)[order]
                    keys, counts = [], []
                out = []
                for row, n, data, offsets in text_slices(part, "_text", STEP):
                    body, first, words, first_word = _streams(data, offsets)
                    logs = scorer(_windows(body, first))
                    score = np.add.reduceat(logs, first[:-1])
                    c = table[1][np.searchsorted(table[0], words)] if len(words) else np.zeros(0, np.int64)
                    end = table[1][np.searchsorted(table[0], END_WORD)][0]
                    scale = n_train + 0.1 * (n_words + 1)
                    base = np.append(np.log10((c + 0.1) / scale), 0.0)
                    has = np.diff(first_word) > 0
                    sums = np.where(has, np.add.reduceat(base, np.minimum(first_word[:-1], len(base) - 1)), 0.0)
                    known = np.add.reduceat(np.append(c > 0, False).astype(np.int64), np.minimum(first_word[:-1], len(c)))
                    out.append((score, sums + math.log10((end + 0.1) / scale), np.diff(first_word) + 1,
                                np.where(has, known, 0) + int(end > 0), np.diff(first)))
                score, base, n, known, size = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [column(part, k) for k in keep] + [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                                                       pa.array(np.full(len(n), n_train, np.int64)), pa.array(base),
                                                       pa.array(score), pa.array(-score / math.log10(2) / size)],
                    names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
        rest()
    return run


def score(docs: DataFrame, *, text: str = "text", mod: int = 10) -> DataFrame:
    """``doc_id``, ``held_out``, token counts, ``base_score``, ``score`` and ``bits_per_byte`` for every row of ``docs``."""
    spark = docs.sparkSession
    width = partitions(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), body.alias("_text"),
                         F.pmod(F.xxhash64("doc_id", body), F.lit(width)).cast("int").alias("block"))
    gathered = save(source.repartition(width, "block").mapInArrow(_gather, "block int, key long, n long"), "gathered")
    release(spark)
    windows = gathered.where("block is null").groupBy("key").agg(F.sum("n").alias("n"))
    model = train(save(windows, "all-windows"))
    by_word = Window.partitionBy("key")
    counts = gathered.where("block is not null").repartition("key").groupBy("key", "block").agg(F.sum("n").alias("n"))
    counts = save(counts.select("block", "key", "n", F.sum("n").over(by_word).alias("c"),
                                F.min("block").over(by_word).alias("least")), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(
        (F.col("c") > 0) & (F.col("block") == F.col("least")), 1)).alias("v")).first()
    drop_saved(gathered)
    release(spark)
    shared = spark.sparkContext.broadcast((model.codes, model.weights, model.apm))
    fields = {f.name: f.dataType.simpleString() for f in source.schema}
    words = counts.select(
        F.lit(0).alias("kind"), "block", "key", "c", F.lit(None).cast(fields["doc_id"]).alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("_text"))
    texts = source.select(F.lit(1).alias("kind"), "block", F.lit(None).cast("long").alias("key"),
                          F.lit(None).cast("long").alias("c"), "doc_id", "held_out", "_text")
    both = words.unionByName(texts).repartition(width, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(_score(shared, ["doc_id", "held_out"], int(total["n"] or 0), int(total["v"] or 0)), (
        f"doc_id {fields['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, bits_per_byte double"))
