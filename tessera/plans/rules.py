"""SQL of the rules on single texts that several queries share."""

from __future__ import annotations

from tessera.functions.text import BENCHMARK_NAMES


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\n\f\v]+', ' ', 'g'))"


def useful(x: str) -> str:
    """Whether a trimmed text is a useful sentence."""
    count = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    named = " + ".join(f"CAST(contains(lower({x}), '{n}') AS INTEGER)" for n in BENCHMARK_NAMES)
    return f"""(regexp_matches({x}, '^[A-Z"(]') AND {count('[A-Za-z0-9]+')} >= 10 AND {count('[A-Za-z]')} >= 40 AND {count('[0-9]')} <= 0.08 * length({x}) AND {count('[A-Z]')} <= 0.45 * {count('[A-Za-z]')} AND {named} < 2)"""


def first_sentence(x: str, most: int) -> str:
    """Of a squeezed text."""
    head = rf"coalesce(nullif(regexp_extract({x}, '^(.+?[.!?])( |$)', 1), ''), {x})"
    return f"CASE WHEN length({head}) > {most} THEN rtrim(substring({head}, 1, {most})) || '...' ELSE {head} END"


def snippets(rows: str, most: int = 420) -> str:
    """Tables that end with ``snippet``: ``rows`` (with text) and their evidence snippet."""
    joined = squeezed(r"regexp_replace(text, '([A-Za-z])-[ \t\r\n]+([A-Za-z])', '\1\2', 'g')")
    return rf"""o AS (SELECT *, {joined} AS one FROM {rows}),
    g AS (SELECT *, list_filter(string_split(regexp_replace(one, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: {useful('s')}) AS g, {first_sentence('one', most)} AS f FROM o),
    s AS (SELECT * EXCLUDE (one, g, f), CASE WHEN len(g) > 0 THEN CASE WHEN length(g[1]) >= {most} THEN g[1] ELSE array_to_string(g[1:2], ' ') END WHEN {useful('f')} THEN f ELSE '' END AS s FROM g),
    snippet AS (SELECT * EXCLUDE (s), CASE WHEN length(s) > {most} THEN rtrim(substring(s, 1, {most})) || '...' ELSE s END AS snippet FROM s)"""
