"""Groups of rows that follow each other in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def runs_of(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[list[list[tuple]]]:
    """Lists of whole groups: rows, as tuples, that share their first ``n_key`` columns.

    Only the group that a batch ends in is carried over, so a task holds a batch and a group.
    """
    open_: list[tuple] = []
    for batch in batches:
        done: list[list[tuple]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ and row[:n_key] != open_[0][:n_key]:
                done.append(open_)
                open_ = []
            open_.append(row)
        if done:
            yield done
    if open_:
        yield [open_]
