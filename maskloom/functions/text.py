"""Text and token scalar functions.

All functions return ``Column`` expressions built from ``pyspark.sql.functions``
and higher-order array functions, so they run row-locally inside the JVM with
no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
SENTINEL = "[M]"  # "no mask" marker and the replacement token
CLASSIFY_PREFIX = "Classify: "
MASK_PREFIX = "Mask: "
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # Python string.punctuation
TURN_MARKERS = "@#"  # kept by strip_punct in dialogue (speaker) mode
# Python str.split() whitespace as a regex class (Java \s is narrower).
WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set as literal characters (Python's str.split() separators), for translate().
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
DIALOGUE_LABELS = ["Regulating", "Negotiating", "Maintaining", "Sharing", "Other", "Off-task"]
LABEL_TAG = "### Label:"
SYSTEM_PROMPT = (
    "You are a dialog act classifier. Answer with a single label among Regulating, "
    "Negotiating, Maintaining, Sharing, Other, and Off-task."
)
# ---------------------------------------------------------------------------


def char_class(chars: str) -> str:
    """Regex character class matching exactly ``chars`` (every char escaped)."""
    return "[" + "".join("\\" + c for c in chars) + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def space_punct(col) -> Column:
    """One space before every punctuation char except the apostrophe."""
    cls = char_class(PUNCTUATION.replace("'", ""))
    return F.regexp_replace(_c(col), "(" + cls + ")", " $1")


def strip_punct(col, keep: str = "") -> Column:
    """Delete punctuation chars, except those in ``keep`` (translate: a char map, no regex)."""
    chars = "".join(c for c in PUNCTUATION if c not in keep)
    return F.translate(_c(col), chars, "")


def squeeze_tokens(col) -> Column:
    """Whitespace-separated tokens, Python ``str.split()`` semantics, without a regex."""
    spaced = F.translate(_c(col), WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.array_remove(F.split(spaced, " "), "")


def squeeze_space(col) -> Column:
    """Collapse whitespace runs to one space and trim (Python split/join)."""
    return F.array_join(squeeze_tokens(col), " ")


def strip_prefixes(col) -> Column:
    """Remove every ``Classify: `` / ``Mask: `` occurrence (regex only on rows that hold one)."""
    c = _c(col)
    has = c.contains(CLASSIFY_PREFIX) | c.contains(MASK_PREFIX)
    return F.when(has, F.regexp_replace(c, "Classify: |Mask: ", "")).otherwise(c)


def task_prefix(col, task: str = "classify") -> Column:
    """C4: strip any task prefix, then add exactly one."""
    prefix = CLASSIFY_PREFIX if task == "classify" else MASK_PREFIX
    return F.concat(F.lit(prefix), strip_prefixes(col))


def tokens(col) -> Column:
    """Space-separated tokens, empty pieces dropped (array_remove is codegen'd, no lambda)."""
    return F.array_remove(F.split(_c(col), " "), "")


def token_count(col) -> Column:
    """Number of tokens, not counting ``@`` / ``#`` turn markers."""
    return F.size(F.array_remove(F.array_remove(tokens(col), "@"), "#"))


def normalize_text(df: DataFrame, text: str = "text", remove_punct: bool = True,
                   keep: str = "", out: str | None = None) -> DataFrame:
    """Prefix strip -> C2 or C1 -> C3 -> token count -> B1 filter.

    Writes the cleaned text to ``out`` (default: in place) and ``token_num``.
    Rows whose raw text is null or a single space, or that end with no token,
    are dropped.
    """
    out = out or text
    raw = F.col(text)
    body = strip_prefixes(raw)
    if remove_punct:  # C2 and C3 in one pass over the characters: white space becomes a space, punctuation goes
        gone = "".join(c for c in PUNCTUATION if c not in keep)
        body = F.translate(body, WHITESPACE_CHARS + gone, " " * len(WHITESPACE_CHARS))
        toks = F.array_remove(F.split(body, " "), "")
    else:
        toks = squeeze_tokens(space_punct(body))
    others = [c for c in df.columns if c not in (out, "token_num")]
    # inline() of a one-element array evaluates the regex chain once per row; a plain
    # withColumn + filter would be inlined by Catalyst into the pushed-down filter and
    # run the whole chain twice.
    pinned = df.filter(raw.isNotNull() & (raw != " ")).select(
        *others, F.inline(F.array(F.struct(toks.alias("_tokens")))))
    # the tokens that make the text are counted, the text is not cut again
    counted = F.size(F.array_remove(F.array_remove("_tokens", "@"), "#")).cast("long")
    res = pinned.withColumn("token_num", counted).filter(F.col("token_num") > 0).withColumn(out, F.array_join("_tokens", " "))
    order = [c for c in df.columns if c != "token_num"] + ([out] if out not in df.columns else []) + ["token_num"]
    return res.select(*order)


def truncate_tokens(df: DataFrame, n: int, text: str = "text", right: bool = True) -> DataFrame:
    """Keep the last (right=True) or first n tokens of longer texts; recount."""
    toks = tokens(F.col(text))
    if n <= 0:
        cut = F.col(text)
    else:
        kept = F.slice(toks, -n, n) if right else F.slice(toks, 1, n)
        cut = F.when(F.size(toks) > n, F.array_join(kept, " ")).otherwise(F.col(text))
    return (df.filter(F.col(text) != "")
              .withColumn(text, cut)
              .withColumn("token_num", token_count(F.col(text)).cast("long"))
              .filter(F.col("token_num") > 0))


def replace_tokens(text, words) -> Column:
    """Every whole token found in ``words`` becomes the sentinel.

    ``words`` is evaluated inside the per-token lambda: pass a plain column
    (see ``masks.pin_columns``), not an expression, on long texts.
    """
    w = _c(words)
    return F.array_join(
        F.transform(tokens(text), lambda x: F.when(F.array_contains(w, x), F.lit(SENTINEL)).otherwise(x)),
        " ")


def remove_tokens(text, words) -> Column:
    """Drop tokens listed in ``words`` (other duplicates kept)."""
    w = _c(words)
    return F.array_join(F.filter(tokens(text), lambda x: ~F.array_contains(w, x)), " ")


def drop_sentinel(words) -> Column:
    """Remove the sentinel from a list only when it has more than one entry."""
    w = _c(words)
    return F.when(F.size(w) > 1, F.array_remove(w, SENTINEL)).otherwise(w)


def dedupe_tokens(words) -> Column:
    """C11: distinct words, first-occurrence order."""
    return F.array_distinct(_c(words))


def parse_mask(col) -> Column:
    """C12 core: mask string -> array; null / 'nan' / '' / sentinel -> empty array."""
    c = _c(col)
    raw = F.when(c.isNull() | (c == "nan"), F.lit(SENTINEL)).otherwise(c)
    return F.array_remove(F.array_distinct(tokens(raw)), SENTINEL)


def render_mask(words) -> Column:
    """Mask array -> the reference's string form (sentinel when empty)."""
    w = _c(words)
    return F.when(F.size(w) == 0, F.lit(SENTINEL)).otherwise(F.array_join(w, " "))


def fill_null_masks(col) -> Column:
    """Null / 'nan' / empty -> sentinel, dedupe, drop sentinel, squeeze."""
    return render_mask(parse_mask(col))


def mask_size(col) -> Column:
    """Words in a mask string; 0 for the sentinel."""
    return F.size(parse_mask(col))


def append_mask(words, word) -> Column:
    """C14: append a drawn word unless it is null / the sentinel / already present."""
    w, x = _c(words), _c(word)
    return F.when(x.isNull() | (x == SENTINEL) | F.array_contains(w, x), w) \
            .otherwise(F.concat(w, F.array(x)))


def split_message(col) -> tuple[Column, Column]:
    """(message, prior_context) of ``a:b:c``.

    message = last ``:`` piece of the full string; prior context = the other
    pieces of the prefix-free string joined by `` : `` plus a trailing `` : ``.
    """
    c = _c(col)
    message = F.element_at(F.split(c, ":"), -1)
    pieces = F.split(F.regexp_replace(c, "Classify: ", ""), ":")
    prior = F.concat(F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), " : "), F.lit(" : "))
    return message, prior


# Prompt layout, fixed value: the reference builds the prompt from an indented
# triple-quoted template, so the indentation (32 spaces) is part of the text.
_INDENT = " " * 32
PROMPT_HEAD = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n" + _INDENT
PROMPT_USER = "<|eot_id|> \n" + _INDENT + "\n" + _INDENT + "<|start_header_id|>user<|end_header_id|>\n" + _INDENT
PROMPT_MSG = " \n" + _INDENT + "### Message: "
PROMPT_TAIL = " <|eot_id|> \n" + _INDENT + "\n" + _INDENT + \
    "<|start_header_id|>assistant<|end_header_id|>\n" + _INDENT + "### Label: "


def py_strip(col) -> Column:
    """Python ``str.strip()``: trim every whitespace char, not only spaces."""
    return F.regexp_replace(_c(col), "^" + WHITESPACE_CLASS + "+|" + WHITESPACE_CLASS + "+$", "")


def render_prompt(context, message, label=None, labels: list[str] | None = None) -> Column:
    """Chat prompt; with a label column the answer ``k. name`` is appended (null for a null label, an error for one
    that is not in the list)."""
    labels = labels or DIALOGUE_LABELS
    body = F.concat(F.lit(PROMPT_HEAD + SYSTEM_PROMPT + PROMPT_USER), py_strip(context),
                    F.lit(PROMPT_MSG), py_strip(message), F.lit(PROMPT_TAIL))
    if label is None:
        return body
    lab = _c(label)
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), lab)
    known = F.when(pos > 0, pos.cast("string")).when(lab.isNotNull(), F.raise_error(F.concat(F.lit("no such label: "), lab)))
    return F.concat(body, known, F.lit(". "), lab)


def parse_label(col, tag: str = LABEL_TAG, labels: list[str] | None = None) -> Column:
    """C17: label named in the 100 chars after the first tag.

    First label (list order) contained; else first id digit (list order)
    contained; else 'None'. A missing tag starts the window at len(tag)-1,
    as the reference's ``find`` of -1 does.
    """
    labels = labels or DIALOGUE_LABELS
    c = _c(col)
    window = F.substring(c, F.locate(tag, c) + len(tag), 100)
    names = F.array(*[F.lit(x) for x in labels])
    ids = F.array(*[F.lit(str(i + 1)) for i in range(len(labels))])
    by_name = F.get(F.filter(names, lambda l: F.contains(window, l)), 0)
    by_id = F.get(F.filter(F.sequence(F.lit(1), F.lit(len(labels))),
                           lambda i: F.contains(window, F.element_at(ids, i))), 0)
    by_id_name = F.when(by_id.isNotNull(), F.get(names, by_id - 1))
    return F.coalesce(by_name, by_id_name, F.lit("None"))


def parse_epoch(col) -> Column:
    """N of the first ``epochN`` path segment; null when absent or not a number."""
    c = _c(col)
    seg = F.substring_index(F.substring(c, F.locate("epoch", c) + 5, 1 << 30), "/", 1)
    return F.when(F.locate("epoch", c) > 0, seg.try_cast("int"))


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct trimmed labels with a 1-based id.

    The distinct runs as a partial aggregate first, so only the (small) label
    set reaches the single-partition ranking window.
    """
    labs = df.select(F.trim(F.col(label)).alias("label")).where(F.col("label").isNotNull()).distinct()
    return labs.withColumn("label_id", F.row_number().over(Window.orderBy("label")).cast("long"))
