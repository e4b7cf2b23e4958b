"""Quality rules from repetition coverage.

Word n-grams of several lengths are hashed by a rolling polynomial over word
identities; characters inside n-grams that occur more than once, and characters
inside repeated lines, are measured against all characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

#: n-gram length -> largest tolerated share (percent) of word characters inside n-grams found twice or more.
COVERAGE_LIMITS = {5: 50, 6: 45, 8: 40, 10: 30}
DUP_LINE_LIMIT = 30
SYMBOL_LIMIT = 30
BASE_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_BASE = np.uint64(0x9E3779B97F4A7C55)


def _measure(text: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, offsets = at.flat(text)
    docs = len(offsets) - 1
    found = at.words(data, offsets)
    lead = (data & 0xC0) != 0x80
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    chars = leads[found.end] - leads[found.start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    per = lambda mask: np.bincount(found.doc[mask], chars[mask], docs).astype(np.int64)
    out = {
        "n_words": found.counts,
        "word_chars": np.bincount(found.doc, chars, docs).astype(np.int64),
        "n_symbols": at.per_doc(symbol[data], offsets),
    }

    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    line_end = np.sort(np.concatenate([newline, offsets[1:]]))
    line_doc = np.repeat(np.arange(docs), at.per_doc(data == 10, offsets) + 1)
    worded = np.searchsorted(found.start, line_end) - np.searchsorted(found.start, line_start)
    some = worded > 0
    line_start, line_end, line_doc = line_start[some], line_end[some], line_doc[some]
    line = at.identities(data, line_start, line_end)
    again = ~at.first_of(line_doc * (len(line) + 1) + line)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    word_line = np.searchsorted(line_start, found.start, "right") - 1
    out["dup_line_chars"] = per(again[word_line] if len(line) else np.zeros(0, bool))

    value = at.mix(at.identities(data, found.start, found.end).astype(np.uint64))
    salt = at.mix(found.doc.astype(np.uint64) ^ np.uint64(0xD0C5))
    gram = np.zeros(len(value), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, max(lengths) + 1):
            k = len(value) - n + 1
            if k <= 0:
                gram = gram[:0]
            else:
                gram = gram[:k] + value[n - 1 :] * power
                power = power * _BASE
            if n not in lengths:
                continue
            whole = np.flatnonzero(found.doc[:k] == found.doc[n - 1 :]) if k > 0 else np.zeros(0, np.int64)
            twice = whole[at.repeated(at.mix(gram[whole] + salt[whole]))]
            inside = at.covered(twice, n, len(value))
            out[f"dup_chars_{n}"] = per(inside)
            if n == BASE_WINDOW:
                out["n_repeat_words"] = np.bincount(found.doc[inside], minlength=docs)
    return out


def repetition_coverage(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", lengths: tuple[int, ...] = tuple(COVERAGE_LIMITS)) -> DataFrame:
    """Repetition measures of every row, beside the ``carry`` columns (all but clashing ones by default).

    Null and empty texts measure 0 everywhere.  Rows are independent: repeated
    rows and equal ids each get their own result, and an empty table gives an
    empty result.  An input column with the name of a measure is replaced.
    Counts are exact up to the chance of a 64-bit hash collision between two
    n-grams of one text slice.
    """
    lengths = tuple(sorted({*lengths, BASE_WINDOW}))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    # a second copy of the text travels under a private name only where the caller does not carry it
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    kept = source.select(*[F.col(f"`{c}`") for c in carry]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "__text"):
            got = _measure(at.column(part, "__text"), lengths)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(pa.array(got[n], pa.int64()) for n in names)], [*carry, *names])

    schema = type(kept)(kept.fields)
    for n in names:
        schema = schema.add(n, "long")
    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    """Too short, or too many words inside repeated 8-word windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(limits: dict[int, int] | None = None) -> Column:
    """Kept: symbols, repeated lines and every n-gram coverage within their limits."""
    keep = (100 * F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words")) & (100 * F.col("dup_line_chars") <= DUP_LINE_LIMIT * F.col("word_chars"))
    for n, most in (limits or COVERAGE_LIMITS).items():
        keep = keep & (100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars"))
    return keep


def judge(docs: DataFrame, carry: list[str] | None = None, limits: dict[int, int] | None = None) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row; see ``repetition_coverage``."""
    limits = limits or COVERAGE_LIMITS
    measured = repetition_coverage(docs, carry, lengths=tuple(limits))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(limits))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns of ``docs``, whatever these are called.

    Null and empty texts fail as too short; repeated rows pass or fail alike; an
    empty table stays empty.
    """
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), ["row"])
    return judged.filter("kept").select("row.*")
