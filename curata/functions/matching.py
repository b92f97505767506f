"""Sequential one-to-one choices over rows sorted by group: streamed, with the sets of one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def one_to_one(group: int, left: int, right: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps each row whose left and right are still free in its group; the arguments are column numbers. The order of rows is the order of choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_l, used_r = None, set(), set()
        for batch in batches:
            keep = []
            for g, a, b in zip(*(batch.column(i).to_pylist() for i in (group, left, right)), strict=True):
                if g != now:
                    now, used_l, used_r = g, set(), set()
                free = a not in used_l and b not in used_r
                if free:
                    used_l.add(a)
                    used_r.add(b)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
