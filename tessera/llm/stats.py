"""Whole-text statistics of documents, vectorised over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.textlib import LANE, LOWER, Slice, code_points, room, slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = ALPHA[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:'\"()-")] = True

#: Counts of a text. The first five are long integers by contract.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_letters", "n_upper", "n_digits", "n_marks", "n_punct", "n_lines", "n_distinct_words", "n_top_word", "n_same_next", "n_symbol_words")
REPEAT_WINDOW = 8


def _per_row(flags: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by (row, key), where a new group starts in it, and the size of each group."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(order)))


def count(s: Slice) -> dict[str, np.ndarray]:
    """``COUNTS`` of each row of a slice."""
    buf, offs, n = s.buf, s.offs, len(s)
    starts, ends, ptr = s.words()
    rows = np.repeat(np.arange(n), np.diff(ptr))
    out = {"n_words": np.diff(ptr)}
    chars = code_points(buf)
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    out["word_chars"] = np.zeros(n, np.int64)
    np.add.at(out["word_chars"], rows, total[ends] - total[starts])
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARK), ("n_punct", PUNCT)):
        out[name] = _per_row(table[buf], offs)
    out["n_letters"] = _per_row(ALPHA[buf] & chars, offs)
    out["n_chars"] = _per_row(chars, offs)
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[buf], dtype=np.int64)])
    out["n_symbol_words"] = _per_row(symbol[ends] > symbol[starts], ptr)

    # Lines with a word, and those of them equal to an earlier line of the text.
    cut = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offs[:-1], cut + 1]))
    end = np.sort(np.concatenate([offs[1:], cut]))
    line_row = np.searchsorted(offs, np.minimum(begin, max(len(buf) - 1, 0)), "right") - 1 if len(buf) else np.zeros(0, np.int64)
    some = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[some], end[some]
    line_row = line_row[some] if len(buf) else line_row
    hashed = LANE.words(buf, begin, end) if len(begin) else np.zeros(0, np.uint64)
    _, at, size = _groups(line_row, hashed)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    first = np.bincount(line_row[np.lexsort((hashed, line_row))[at]], minlength=n) if len(at) else np.zeros(n, np.int64)
    out["n_dup_lines"] = out["n_lines"] - first

    words = LANE.words(buf, starts, ends)
    low = LANE.words(LOWER[buf], starts, ends)
    order, at, size = _groups(rows, low)
    own = rows[order[at]] if len(at) else np.zeros(0, np.int64)
    out["n_distinct_words"] = np.bincount(own, minlength=n)
    out["n_top_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["n_top_word"], own, size)
    out["n_same_next"] = np.bincount(rows[1:][(low[1:] == low[:-1]) & (rows[1:] == rows[:-1])], minlength=n)

    # Words under windows that are found twice or more in the text.
    k = REPEAT_WINDOW
    grams = LANE.grams(words, k)
    valid = np.flatnonzero(room(ptr)[: len(grams)] >= k)
    order, at, size = _groups(rows[valid], grams[valid])
    again = valid[order[np.repeat(size > 1, size)]] if len(at) else np.zeros(0, np.int64)
    edge = np.zeros(len(words) + k + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(edge)[: len(words)] > 0, ptr)
    return out


def stream(column: pa.Array) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """First row and counts of each slice of a text column; null counts as empty."""
    for s in slices(column):
        yield s.first, count(s)
