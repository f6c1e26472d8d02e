"""Texts of an Arrow batch as flat word arrays: each distinct word is worked on once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text: Spark bounds batches by rows alone in some operators."""
    ends = np.cumsum(pc.binary_length(pc.fill_null(batch.column(column), "")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def sliced(texts: pa.Array, size: int, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on a text array in such parts."""
    parts = [work(b.column(0)) for b in slices(pa.record_batch([texts], ["text"]), "text", size)]
    return pa.concat_arrays(parts) if parts else work(texts)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace-separated words of each text: codes, distinct words, row offsets.

    ``codes[offsets[i]:offsets[i + 1]]`` index the distinct words of row i. Null is empty.
    """
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.utf8_split_whitespace(texts)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = np.array(coded.dictionary.to_pylist(), dtype=object)
    empty = np.flatnonzero(distinct == "")
    if len(empty):
        keep = codes != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, distinct, offsets


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between blanks and control white space (9 to 13): codes, distinct words, row offsets. Null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = lists.flatten().dictionary_encode()
    codes, empty = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
    return codes, coded.dictionary, offsets


def word_hashes(distinct: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
