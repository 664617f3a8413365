"""Document statistics over whole texts, by numpy on Arrow batches: the inputs of the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomstone.llm.common import ready, tidy
from loomstone.llm.textkernel import SPACE, chars, doc_of, exact_ids, per_doc, runs, text_bytes

#: Fixed characters: the symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_same_next", "n_distinct_words", "n_chars_all"]

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_LOWER = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_MARK = np.array([0x21 <= b < 0x7F and not (_UPPER[b] or _LOWER[b] or _DIGIT[b]) and chr(b) not in ".," for b in range(256)])


def _equal_to_earlier(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order, with equal ids if equal: is it equal to an earlier one of its text; does it occur at least twice there."""
    if not len(item):
        return np.zeros(0, bool), np.zeros(0, bool)
    both = doc.astype(np.int64) * (int(item.max()) + 1) + item
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(item), bool)
    same[1:] = both[order[1:]] == both[order[:-1]]
    twice = same.copy()
    twice[:-1] |= same[1:]
    earlier, often = np.zeros(len(item), bool), np.zeros(len(item), bool)
    earlier[order], often[order] = same, twice
    return earlier, often


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An id of each pair of ids: equal if and only if both are equal."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """Every count of COUNTS for every text of an Arrow column, exact: equal words and lines are compared byte for byte. Null is an empty text; every count of it is 0."""
    data, at = text_bytes(column)
    n = len(at) - 1
    space = SPACE[data]
    start, end = runs(~space, at)
    doc = doc_of(start, at)
    word, _ = exact_ids(data, start, end)
    code = chars(data)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(code & ~space, at), "n_symbols": per_doc(_SYMBOL[data], at)}

    newline = data == 0x0A
    line_start, line_end = runs(~newline, at)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=seen[1:])
    worded = seen[line_end] > seen[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = doc_of(line_start, at)
    earlier, _ = _equal_to_earlier(line_doc, exact_ids(data, line_start, line_end)[0])
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)

    covered = np.zeros(len(word) + 3, bool)
    if len(word) > 2:
        triple = _pairs(_pairs(word[:-2], word[1:-1]), word[2:])
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        _, often = _equal_to_earlier(doc[whole], triple[whole])
        for i in range(3):
            covered[whole[often] + i] = True
    covered = covered[: len(word)]
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    again, _ = _equal_to_earlier(doc, word)
    out["n_distinct_words"] = np.bincount(doc[~again], minlength=n)
    same = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    out["n_same_next"] = np.bincount(doc[same], minlength=n)
    for name, table in (("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = per_doc(table[data], at)
    out["n_chars_all"] = per_doc(code, at)
    return out


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and the COUNTS of its `text`, read in one pass without a shuffle.

    Null texts count as empty; extra columns of any name are not read. An empty table gives an empty table.
    """
    ready(docs.sparkSession)
    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{c} long" for c in COUNTS])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_texts(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=[*keep, *COUNTS])

    return docs.select(*keep, "text").mapInArrow(tidy(kernel), schema)
