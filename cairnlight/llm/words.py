"""Arrow and numpy helpers for text that is worked on word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def chunks(text: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of ``text`` of about ``most`` bytes, each with its first row.

    A longer text is a slice of its own; none is cut.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(text):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, text.slice(start, stop - start)
        start = stop


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets into the words, a code for each word, and the distinct words.

    Words are runs without white space; a null text has none.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; 0 where there are none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
