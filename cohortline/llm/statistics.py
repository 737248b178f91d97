"""Counts of whole texts that quality rules and classifiers work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .words import Words, chunks, encoded, mix, run_hashes, slices, span_hashes

#: Whole numbers for each text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_pipes", "n_digits", "n_distinct")
COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
#: Words in the windows whose repeats are counted.
REPEAT_WINDOW = 8
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _with_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))


def _per_text(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def counts(texts: list[bytes]) -> np.ndarray:
    """The COUNTS of each text, a row each.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A line is what stands between line feeds; it is a duplicate if it has a word and
    equals an earlier line. A word repeats if it lies in an 8-word window that the text has at least twice.
    """
    out = []
    for _, part in chunks(texts):
        words = Words(part)
        data, n = words.data, len(part)
        n_words = np.diff(words.first)
        in_word = np.zeros(len(data) + 1, dtype=np.int8)
        in_word[words.starts] += 1
        in_word[words.ends] -= 1
        in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        text_of = np.repeat(np.arange(n), n_words)
        hashes = words.hashes()
        # Lines: cut at line feeds and at the ends of texts.
        feed = np.flatnonzero(data == 10)
        begins = np.sort(np.concatenate((words.text_start, feed + 1)))
        begins = begins[begins < len(data)]
        line_text = np.searchsorted(words.text_start, begins, side="right") - 1
        stops = np.minimum(np.concatenate((begins[1:], [len(data)])) - 1, words.text_end[line_text])
        filled = np.searchsorted(words.starts, begins) < np.searchsorted(words.starts, stops)
        begins, stops, line_text = begins[filled], stops[filled], line_text[filled]
        line = _with_text(span_hashes(data, begins, stops), line_text)
        again = np.ones(len(line), dtype=bool)
        again[np.unique(line, return_index=True)[1]] = False
        # Windows of words.
        runs = run_hashes(hashes, REPEAT_WINDOW)
        start = np.arange(len(runs))
        inside = start + REPEAT_WINDOW <= words.first[1:][text_of[: len(runs)]] if len(runs) else np.empty(0, bool)
        start = start[inside]
        value, back, times = np.unique(_with_text(runs[start], text_of[start]), return_inverse=True, return_counts=True)
        start = start[times[back] > 1]
        step = np.zeros(len(hashes) + 1, dtype=np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + REPEAT_WINDOW, -1)
        repeated = np.cumsum(step[:-1]) > 0
        distinct = np.unique(_with_text(hashes, text_of), return_index=True)[1]
        pipes = (words.ends - words.starts == 1) & (data[words.starts] == 124)
        out.append(
            np.stack(
                [
                    n_words,
                    words.sums(in_word & ((data & 0xC0) != 0x80)),
                    words.sums(_SYMBOLS[data]),
                    np.bincount(line_text[again], minlength=n),
                    _per_text(repeated, words.first),
                    np.bincount(line_text, minlength=n),
                    words.sums((data >= 65) & (data <= 90)),
                    words.sums(data == 33),
                    _per_text(pipes, words.first),
                    words.sums((data >= 48) & (data <= 57)),
                    np.bincount(text_of[distinct], minlength=n),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.empty((0, len(COUNTS)), np.int64)


def append_counts(text_col: str):
    """For mapInArrow: each row with its text's counts behind its own columns."""

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            table = counts(encoded(batch.column(text_col).to_pylist()))
            fields = [*batch.schema, *[pa.field(c, pa.int64()) for c in COUNTS]]
            columns = [*batch.columns, *[pa.array(table[:, i].astype(np.int64)) for i in range(len(COUNTS))]]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return append


#: Features as (name, numerator, denominator) of counts; shares of 0 in texts without words.
FEATURES = (
    ("symbol_share", "n_symbols", "word_chars"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("bang_share", "n_bangs", "n_words"),
    ("pipe_share", "n_pipes", "n_words"),
    ("mean_word", "word_chars", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("words_per_line", "n_words", "n_lines"),
    ("n_words", "n_words", None),
)


def feature_columns() -> list[Column]:
    return [
        (F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) if b else F.col(a).cast("double")).alias(f"f_{name}") for name, a, b in FEATURES
    ]


def feature_matrix(table: np.ndarray) -> np.ndarray:
    """The same features from rows of counts."""
    place = {c: i for i, c in enumerate(COUNTS)}
    return np.stack([table[:, place[a]] / (np.maximum(table[:, place[b]], 1) if b else 1.0) for _, a, b in FEATURES], axis=1).astype(float)
