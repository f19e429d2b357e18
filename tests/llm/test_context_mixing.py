"""Context mixing (3): counts and scores of a task, exact and within bounded memory."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa

from maskloom.llm import context_mixing


def _batches(texts, rows=200):
    for a in range(0, len(texts), rows):
        part = texts[a:a + rows]
        yield pa.RecordBatch.from_arrays([pa.array([i % 5 == 0 for i in range(a, a + len(part))]), pa.array([1 + i % 2 for i in range(
            a, a + len(part))], pa.int32()), pa.array(part)], names=["held_out", "block", "_text"])


def test_context_mixing_gathers_within_bounds():
    # op3: a task counts words and windows in bounded memory, merging what repeats before it hands it on
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x:x}" for x in rng.integers(0, 60_000, 1200)) for _ in range(1200)]
    words, windows, total, size = collections.Counter(), collections.Counter(), 0, 0
    tracemalloc.start()
    for batch in context_mixing._gather(_batches(texts)):
        total += batch.num_rows
        size = max(size, batch.num_rows)
        for k, n in zip(*(batch.column(c).to_pylist() for c in ("block", "n"))):
            (windows if k is None else words)[k] += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    train = [t for i, t in enumerate(texts) if i % 5]
    assert sum(words.values()) == sum(len(t.split()) + 1 for t in train) and windows[None] == sum(len(t) + 1 for t in train)
    assert size <= 1 << 17 and peak < 100 << 20


def test_context_mixing_slots_and_scores_are_exact():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 100, 4000).astype(np.uint8)
    body[rng.integers(0, 4000, 900)] = context_mixing.SPACE
    windows = context_mixing._windows(body, np.array([0, 1500, 4000]))
    names, n = np.unique(windows, return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["key", "n"])
    zeros, ones = collections.Counter(), collections.Counter()
    for w, c in zip(names, n):
        for i in range(context_mixing.PREDICTORS):
            context = context_mixing.Model.context(np.array([w]), i)
            for b in range(8):
                node = (1 << b) | (int(w) & 255) >> (8 - b)
                salted = (int(context[0]) ^ node * 0x9E3779B97F4A7C15 % 2 ** 64) * 0xD6E8FEB86659FD93 % 2 ** 64
                slot = (salted >> (64 - context_mixing.TABLE_BITS)) + (i << context_mixing.TABLE_BITS)
                (ones if int(w) >> (7 - b) & 1 else zeros)[slot] += int(c)
    codes, got = np.zeros(context_mixing.PREDICTORS << context_mixing.TABLE_BITS, np.uint16), {}
    for r in context_mixing._count_slots([batch]):
        slot, z, o = (r.column(c).to_numpy() for c in ("slot", "zeros", "ones"))
        got |= dict(zip(slot.tolist(), zip(z.tolist(), o.tolist())))
        codes[slot] = context_mixing.slot_codes(z, o)
    assert got == {s: (zeros[s], ones[s]) for s in zeros | ones}
    model = context_mixing.Model(codes, rng.normal(size=(context_mixing.GATES, context_mixing.INPUTS)).astype(np.float32), None)
    scorer = context_mixing._Scorer(model)
    scorer.BITS, scorer.keys, scorer.values = 8, np.full(256, ~np.uint64(0)), np.zeros(256)  # many windows for a place
    for part in (windows[:900], windows[500:], windows):
        assert np.array_equal(scorer(part), model.log10(part))
