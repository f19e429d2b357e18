"""Operator 12: fill-in-middle transformation with cuts found in Fenwick trees.

A text is cut after two random numbers of units (lines, or code points). Its
UTF-8 bytes are taken in blocks of fixed size; a Fenwick tree over the blocks
stores the unit starts and the code points of each. Binary-lifting descent
finds the block in which a cut lies and what stands before it; the place itself
is found inside that block. The trees of all texts of a slice are built and
descended together.

The draws are the first 8-digit groups of the sha256 of ``<seed>:<doc_id>``, so
every run and every task attempt cuts alike, and SQL can repeat them.

Nulls and edges: a null text is the empty one; a null id is drawn for as the
empty string, and rows of one id and text are treated alike. Texts that are
empty or hold a sentinel stay plain, with null prefix and middle. Texts of any
length are handled whole. An empty table gives none. Only the columns named in
``keep``, the id and the text are read; a ``keep`` column must not bear a name
of a result column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.common import U64, column, text_slices

#: Bytes of text in one leaf of a Fenwick tree.
BLOCK = 1024
SENTINELS = ("<P>", "<S>", "<M>")
#: Cuts whose blocks are looked into at once.
LOOK = 2048


class BlockTrees:
    """A Fenwick tree for each text of a slice, over blocks of its bytes, in one pair of arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.data, self.offsets = data, offsets
        point = (data & 0xC0) != 0x80
        if unit == "char":
            start = point
        elif unit == "line":
            start = np.zeros(len(data), bool)
            start[1:] = data[:-1] == 10
            start[offsets[:-1][np.diff(offsets) > 0]] = True
        else:
            raise ValueError(f"unknown unit {unit!r}")
        self.start, self.point = start, point
        n = -(-np.diff(offsets) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(n)])  # first block of each text
        self.n = n
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(self.first[-1]) - self.first[doc]
        self.low = offsets[doc] + at * BLOCK
        self.high = np.minimum(self.low + BLOCK, offsets[doc + 1])
        self.units, self.points = self._tree(start, at), self._tree(point, at)
        self.total_units, self.total_points = self._sum(self.units), self._sum(self.points)

    def _tree(self, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        tree = running[self.high] - running[self.low]
        step, node = 1, at + 1  # nodes count from 1; a node takes in its children, smallest steps first
        while len(at) and step < int(self.n.max(initial=0)):
            up = np.flatnonzero(node % (2 * step) == 0)
            tree[up] += tree[up - step]
            step *= 2
        return tree

    def _sum(self, tree: np.ndarray) -> np.ndarray:
        """Sum over all blocks of each text: the nodes on the way down from its last one."""
        total, node = np.zeros(len(self.n), np.int64), self.n.copy()
        while True:
            live = np.flatnonzero(node)
            if not len(live):
                return total
            total[live] += tree[self.first[live] + node[live] - 1]
            node[live] &= node[live] - 1

    def cut(self, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place (in the slice) after the first ``k`` units of each text ``doc``, and the code points before it."""
        place, before = self.offsets[doc + 1].copy(), self.total_points[doc].copy()
        inner = np.flatnonzero(k < self.total_units[doc])
        d, want = doc[inner], k[inner].copy()  # the unit start that follows exactly ``want`` others
        node, points = np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
        step = 1 << (int(self.n.max(initial=1)).bit_length() - 1) if len(self.n) else 0
        while step:
            nxt = node + step
            live = np.flatnonzero(nxt <= self.n[d])
            at = self.first[d[live]] + nxt[live] - 1
            some = self.units[at] <= want[live]
            live, at = live[some], at[some]
            node[live] = nxt[live]
            want[live] -= self.units[at]
            points[live] += self.points[at]
            step >>= 1
        for a in range(0, len(inner), LOOK):
            some = slice(a, a + LOOK)
            low = self.low[self.first[d[some]] + node[some]]
            high = self.high[self.first[d[some]] + node[some]]
            here = low[:, None] + np.arange(BLOCK)[None, :]
            inside = here < high[:, None]
            here = np.minimum(here, len(self.data) - 1)
            number = np.cumsum(self.start[here] & inside, 1)
            local = (number > want[some, None]).argmax(1)
            place[inner[some]] = low + local
            before[inner[some]] = points[some] + (self.point[here] & (np.arange(BLOCK)[None, :] < local[:, None])).sum(1)
        return place, before


def draw(doc_id, k: int, seed: int = 7) -> Column:
    """The ``k``-th (from 1) 32-bit draw for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, keep: list[str], *, doc_id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7,
              rate: int = 100, spm: int = 50) -> DataFrame:
    """``keep`` columns, ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix first.
    """
    source = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"),
                         *[draw(F.col(doc_id), k, seed).alias(f"_h{k}") for k in (1, 2, 3, 4)])
    own = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = T.StructType([*source.select(*keep).schema.fields, *T._parse_datatype_string(own).fields])
    names = [f.name for f in schema.fields]
    mark_p, mark_s, mark_m = (s.encode() for s in SENTINELS)

    def run(batches):
        for batch in batches:
            draws = [column(batch, f"_h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for row, n, data, offsets in text_slices(batch, "_text"):
                trees = BlockTrees(data, offsets, unit)
                h1, h2, h3, h4 = (h[row:row + n] for h in draws)
                units = trees.total_units
                doc = np.arange(n)
                one, two = h1 % (units + 1), h2 % (units + 1)
                cut1, before1 = trees.cut(doc, np.minimum(one, two))
                cut2, before2 = trees.cut(doc, np.maximum(one, two))
                out, form, raw = [], [], data.tobytes()
                for i in range(n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    t = raw[a:b]
                    if not t or h3[i] % 100 >= rate or mark_p in t or mark_s in t or mark_m in t:
                        form.append("plain")
                        out.append(t)
                        continue
                    x, y = int(cut1[i]) - a, int(cut2[i]) - a
                    if h4[i] % 100 < spm:
                        form.append("spm")
                        out.append(b"".join((mark_s, t[y:], mark_p, t[:x], mark_m, t[x:y])))
                    else:
                        form.append("psm")
                        out.append(b"".join((mark_p, t[:x], mark_s, t[y:], mark_m, t[x:y])))
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c).slice(row, n) for c in keep), pa.array(units), pa.array(form),
                     pa.array(before1, mask=plain), pa.array(before2 - before1, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=names)
    return source.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from ``output`` and ``form`` alone; exact, as no text that holds a sentinel is transformed."""
    part = F.split(output, "|".join(SENTINELS), -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])) \
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
