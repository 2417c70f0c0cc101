"""Word tokens of many texts at once: the Arrow form of ``text.tokens``, for counts of words from a given vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from deskweave.functions.text import STOP_WORDS

# Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def _kinds() -> np.ndarray:
    """Of each byte: 2 may begin a token, 1 only go on one, 0 neither."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"_.-")] = 1
    kinds[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 2
    return kinds


def token_spans(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the tokens of lower-case texts, which begin and end at ``at``."""
    kinds = _kinds()[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    inside = np.concatenate([[False], kinds > 0, [False]])
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    # A token goes from the first letter or digit of a run to the run's end.
    begin = np.append(np.flatnonzero(kinds == 2), len(raw))
    starts = begin[np.searchsorted(begin, starts)]
    whole = ends - starts >= 2
    starts, ends = starts[whole], ends[whole]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]))


def _steps(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, byte offsets from 0, bytes)."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, starts, body = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + STEP_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, at[first : last + 1] - at[first], raw[at[first] : at[last]]
        first = last


def vocabulary_counts(batches: Iterator[pa.RecordBatch], text: str, keep: Sequence[str], vocabulary: Sequence[str], mark: str) -> Iterator[pa.RecordBatch]:
    """(columns to keep, length, term, frequency) of the words of the vocabulary in each lower-case text, no text null.

    ``length`` counts all tokens but stop words. Each text also has one row with the mark.
    """
    terms = pa.array([*vocabulary, mark], pa.string())
    known = pa.array([*vocabulary, *STOP_WORDS], pa.large_string())
    n_terms = len(vocabulary)
    for batch in batches:
        for first, at, raw in _steps(batch.column(text)):
            texts = len(at) - 1
            starts, ends, owner = token_spans(at, raw)
            place = pc.index_in(_words(raw, starts, ends), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            length = np.bincount(owner[place < n_terms], minlength=texts).astype(np.int32)
            asked = (place >= 0) & (place < n_terms)
            code = np.concatenate([owner[asked] * (n_terms + 1) + place[asked], np.arange(texts) * (n_terms + 1) + n_terms])
            code, frequency = np.unique(code, return_counts=True)
            owner, place = np.divmod(code, n_terms + 1)
            kept = [batch.column(c).take(pa.array(owner + first)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length[owner]), terms.take(pa.array(place)), pa.array(frequency.astype(np.int64))], names=[*keep, "length", "term", "frequency"])
