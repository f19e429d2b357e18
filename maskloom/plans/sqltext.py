"""SQL building blocks for the DuckDB oracle.

These mirror the Spark column functions as plain SQL text (DuckDB dialect), so
every registered query has an independent SQL statement over the same tables.
"""

from __future__ import annotations

from maskloom.functions.text import (CLASSIFY_PREFIX, PUNCTUATION, SENTINEL, WHITESPACE_CLASS,
                                     char_class)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT_RE = lit(char_class(PUNCTUATION))
WS_RE = lit(WHITESPACE_CLASS + "+")


def toks(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {WS_RE}, ' ', 'g'))"


def strip_punct(e: str, keep: str = "") -> str:
    chars = "".join(c for c in PUNCTUATION if c not in keep)
    return f"regexp_replace({e}, {lit(char_class(chars))}, '', 'g')"


def space_punct(e: str) -> str:
    cls = char_class(PUNCTUATION.replace("'", ""))
    return f"regexp_replace({e}, {lit('(' + cls + ')')}, ' \\1', 'g')"


def strip_prefixes(e: str) -> str:
    return f"regexp_replace({e}, 'Classify: |Mask: ', '', 'g')"


def token_count(e: str) -> str:
    return f"len(list_filter({toks(e)}, lambda x: x NOT IN ('@', '#')))"


def hkey(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def hunit(*parts: str) -> str:
    return f"(CAST(('0x' || substr({hkey(*parts)}, 1, 8)) AS BIGINT) / 4294967296.0)"


def render_mask(list_expr: str) -> str:
    return f"CASE WHEN len({list_expr}) = 0 THEN '{SENTINEL}' ELSE array_to_string({list_expr}, ' ') END"


def distinct_ordered(list_expr: str) -> str:
    return f"list_filter({list_expr}, lambda x, i: list_position({list_expr}, x) = i)"


def parse_mask(e: str) -> str:
    raw = f"CASE WHEN {e} IS NULL OR {e} = 'nan' THEN '{SENTINEL}' ELSE {e} END"
    return f"list_filter({distinct_ordered(toks(raw))}, lambda x: x <> '{SENTINEL}')"


def turns_cte() -> str:
    return ("turns AS (SELECT CAST(conv_id * 4294967296 + turn AS BIGINT) AS idx, CAST(conv_id AS BIGINT) AS group_id, "
            "CAST(turn AS BIGINT) AS turn, role AS speaker, role AS label, text FROM conversations)")


def docs_cte() -> str:
    return ("docs AS (SELECT CAST(doc_id AS BIGINT) AS idx, source AS group_id, text, lang AS label FROM documents)")


def normalized_cte(name: str, src: str, remove_punct: bool = True, keep: str = "",
                   cols: str = "idx, group_id, label") -> str:
    """C5 as a CTE: cleaned ``text`` + ``token_num``, blank rows dropped."""
    body = strip_prefixes("text")
    body = strip_punct(body, keep) if remove_punct else space_punct(body)
    return (f"{name}_0 AS (SELECT {cols}, {squeeze(body)} AS text FROM {src} "
            f"WHERE text IS NOT NULL AND text <> ' '), "
            f"{name} AS (SELECT *, CAST({token_count('text')} AS BIGINT) AS token_num FROM {name}_0 "
            f"WHERE {token_count('text')} > 0)")


def budget(token_num: str, pct: float) -> str:
    k = f"CAST(floor({token_num} * CAST({pct!r} AS DOUBLE)) AS BIGINT)"
    return f"(CASE WHEN {token_num} > 1 AND {k} = 0 THEN 1 ELSE {k} END)"


def draw_ctes(name: str, src: str, k_expr: str, seed: str, salt: str = "mask") -> str:
    """The random-draw kernel as unnest + windows.

    ``src`` has idx, text and the columns used by ``k_expr``. Produces
    ``{name}_w`` (idx, w, mk: drawn words) and ``{name}`` (idx, mask_words list,
    masked_sent).
    """
    return f"""
{name}_t AS (SELECT idx, {k_expr} AS k, unnest({toks('text')}) AS w,
                    unnest(generate_series(0, len({toks('text')}) - 1)) AS p FROM {src}),
{name}_c AS (SELECT idx, k, w, p, {hkey(lit(salt), lit(str(seed)), 'idx', 'p', 'w')} AS key
             FROM {name}_t WHERE w <> '{SENTINEL}' AND NOT regexp_matches(w, {PUNCT_RE})),
{name}_g AS (SELECT idx, any_value(k) AS k, w, min(key) AS mk, count(*) AS c FROM {name}_c GROUP BY idx, w),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY mk) AS j,
                    sum(c) OVER (PARTITION BY idx) - coalesce(sum(c) OVER (PARTITION BY idx ORDER BY mk
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
             FROM {name}_g),
{name}_w AS (SELECT idx, w, mk FROM {name}_r WHERE j <= k AND remaining > 3),
{name}_m AS (SELECT t.idx, string_agg(CASE WHEN d.w IS NOT NULL THEN '{SENTINEL}' ELSE t.w END, ' ' ORDER BY t.p)
                    AS masked_sent
             FROM {name}_t t LEFT JOIN {name}_w d ON t.idx = d.idx AND t.w = d.w GROUP BY t.idx),
{name}_l AS (SELECT idx, list(w ORDER BY mk) AS mask_words FROM {name}_w GROUP BY idx),
{name} AS (SELECT s.idx, coalesce(l.mask_words, []::VARCHAR[]) AS mask_words,
                  coalesce(m.masked_sent, '') AS masked_sent
           FROM {src} s LEFT JOIN {name}_m m ON s.idx = m.idx LEFT JOIN {name}_l l ON s.idx = l.idx)"""


CLASSIFY = lit(CLASSIFY_PREFIX)
