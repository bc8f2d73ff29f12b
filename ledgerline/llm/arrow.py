"""Arrow batches of texts: ids and all other columns pass through as Arrow arrays, so no value changes on the way.

(Through pandas a nullable column of whole numbers becomes one of floats, and ids above 2**53 change.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text of at most so many bytes is worked on at a time, unless a single document has more.
CHUNK = 1 << 20


def runs(texts: list, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that hold at most so many characters or bytes, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a column as bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of batches with their texts, each of bounded size."""
    for batch in batches:
        texts = utf8(batch, name)
        for start, stop in runs(texts, most):
            yield batch.slice(start, stop - start), texts[start:stop]


def extended(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The columns of batch named in keep, as they are, and more."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *more.values()], names=[*keep, *more])


def lists(parts: list[np.ndarray], kind) -> pa.Array:
    """An array of lists from numpy arrays."""
    ends = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    values = np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
