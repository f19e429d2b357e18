"""Row-local mask kernels.

The reference draws mask words one at a time: each draw picks a uniformly
random position among the still-unmasked, punctuation-free tokens, provided
more than three remain, and masks every occurrence of that word. A random
permutation of positions, read left to right keeping first occurrences, has
the same distribution, so one sort per row replaces k passes over the table.

The permutation is an md5 key per position (``hashing.hkey``). Drawing and
replacing are small functions of one row's bytes, run over Arrow batches: no
shuffle. As chains of higher-order functions, which Spark interprets, they took four times as long.
"""

from __future__ import annotations

import re
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import PUNCTUATION, SENTINEL, char_class, tokens

MIN_REMAINING = 3  # a draw needs more than this many unmasked tokens (fixed value)
_PUNCT = char_class(PUNCTUATION)
_HAS_PUNCT = re.compile(b"[" + re.escape(PUNCTUATION.encode()) + b"]").search
_SENTINEL = SENTINEL.encode()


def pin_columns(df: DataFrame, **exprs: Column) -> DataFrame:
    """Evaluate ``exprs`` once per row and expose them as plain columns.

    Arrays that later lambdas index into must not be re-derived per element:
    Catalyst's CollapseProject counts a reference inside a lambda once, so it
    would inline e.g. a sorted array into ``transform`` and redo the sort for
    every element. ``inline`` of a one-element array is a Generate, which no
    projection is collapsed into.
    """
    keep = [c for c in df.columns if c not in exprs]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))))


def mask_budget(token_num, pct: float) -> Column:
    """F2 draw count: ``floor(token_num * pct)``, at least 1 when token_num > 1."""
    k = F.floor(F.col(token_num) * F.lit(float(pct))).cast("int")
    return F.when((F.col(token_num) > 1) & (k == 0), F.lit(1)).otherwise(k)


def _split(text: bytes) -> list[bytes]:
    return [w for w in text.split(b" ") if w]


def maskable_words(text: bytes) -> list[bytes]:
    """Distinct tokens that can be masked (no punctuation, not the sentinel), first-occurrence order."""
    return [w for w in dict.fromkeys(_split(text)) if w != _SENTINEL and not _HAS_PUNCT(w)]


def _draw(head: bytes, text: bytes, budgets: list) -> list[tuple[list[bytes], bytes]]:
    """For each budget the drawn words in draw order, and the masked text, of one row."""
    toks, key, count = _split(text), {}, {}
    head += b"|"
    for p, w in enumerate(toks):
        if w in count:
            count[w] += 1
        elif w == _SENTINEL or _HAS_PUNCT(w):
            continue
        else:
            count[w] = 1
        h = md5(head + b"%d|" % p + w).digest()  # bytes sort as their hex digits do
        if w not in key or h < key[w]:
            key[w] = h
    left, order = sum(count.values()), []
    for w in sorted(key, key=key.get):
        if left <= MIN_REMAINING:
            break
        order.append(w)
        left -= count[w]
    out = []
    for k in budgets:
        drawn = order[:max(k or 0, 0)]
        hidden = set(drawn)
        out.append((drawn, b" ".join([_SENTINEL if w in hidden else w for w in toks])))
    return out


def _draw_batch(head: pa.Array, text: pa.Array, k: pa.Array) -> pa.Array:
    rows = [_draw(h, t, [n])[0] if t is not None else ([], b"") for h, t, n in zip(head.to_pylist(), text.to_pylist(), k.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.binary())), pa.array([r[1] for r in rows], pa.binary())],
                                      names=["words", "text"])


def _draw_each_batch(head: pa.Array, text: pa.Array, k: pa.Array) -> pa.Array:
    rows = [[x for _, x in _draw(h, t, n)] if t is not None else [b""] * len(n) for h, t, n in zip(head.to_pylist(), text.to_pylist(), k.to_pylist())]
    return pa.array(rows, pa.list_(pa.binary()))


def _head(salt: str, seed, idx: str) -> Column:
    return F.concat_ws("|", F.lit(salt), (seed if isinstance(seed, Column) else F.lit(str(seed))).cast("string"),
                       F.col(idx).cast("string")).cast("binary")


def draw_masks_each(df: DataFrame, text: str, idx: str, budgets: list[Column], seed, salt: str = "mask",
                    texts_out: str = "masked_sents") -> DataFrame:
    """Attach ``texts_out``: for each of ``budgets`` the text that ``draw_masks`` masks with it. The draws of a smaller budget
    are the first ones of a larger, so keys and order are worked out once for all."""
    draw = F.arrow_udf(_draw_each_batch, "array<binary>")
    each = draw(_head(salt, seed, idx), F.col(text).cast("binary"), F.array(*[b.cast("int") for b in budgets]))
    return pin_columns(df, **{texts_out: each.cast("array<string>")})


def draw_masks(df: DataFrame, text: str, idx: str, k, seed, salt: str = "mask",
               words_out: str = "mask_words", text_out: str = "masked_sent") -> DataFrame:
    """Attach ``words_out`` (drawn words, draw order) and ``text_out`` (masked text).

    ``k`` is an int or a Column: the maximum number of draws per row. Tokens that
    already are the sentinel, or hold punctuation, are never drawn.
    """
    kcol = k if isinstance(k, Column) else F.lit(int(k))
    draw = F.arrow_udf(_draw_batch, "words array<binary>, text binary")
    df = df.withColumn("_mk", draw(_head(salt, seed, idx), F.col(text).cast("binary"), kcol.cast("int")))
    return pin_columns(df, **{words_out: F.col("_mk.words").cast("array<string>"), text_out: F.col("_mk.text").cast("string")}).drop("_mk")


def _replace_batch(remove: bool):
    def run(text: pa.Array, words: pa.Array) -> pa.Array:
        out = []
        for t, ws in zip(text.to_pylist(), words.to_pylist()):
            if t is None:
                out.append(None)
                continue
            ws = set(ws or ())
            out.append(b" ".join([w for w in _split(t) if w not in ws] if remove else [_SENTINEL if w in ws else w for w in _split(t)]))
        return pa.array(out, pa.binary())
    return run


def replace_words(df: DataFrame, text: str, words: str, out: str, remove: bool = False) -> DataFrame:
    """C8 / C9 on long rows: attach ``out``, ``text`` with every token found in the array ``words`` masked (or removed).

    One set of the words and one pass over the tokens of a row. A null list has no words; a null text gives null.
    """
    replaced = F.arrow_udf(_replace_batch(remove), "binary")(F.col(text).cast("binary"), F.col(words).cast("array<binary>"))
    return pin_columns(df, **{out: replaced.cast("string")})


def valid_mask(text, words) -> Column:
    """mask words that are tokens of the punctuation-free text (> 2 tokens), else none."""
    t = text if isinstance(text, Column) else F.col(text)
    w = words if isinstance(words, Column) else F.col(words)
    toks = tokens(F.regexp_replace(t, _PUNCT, ""))
    # array_intersect is hash based (O(n + m)) and keeps the order of ``w``.
    return F.when(F.size(toks) > 2, F.array_intersect(w, toks)) \
            .otherwise(F.array().cast("array<string>"))
