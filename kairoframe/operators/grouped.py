"""Small groups in Python without a call for each.

`applyInPandas` builds a frame for every group, which costs a millisecond however small the group is. Here a partition
is sorted by key and read in batches; groups are slices of its columns. A group that goes on in the next batch is carried
over, so a task holds one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def grouped_rows(df: DataFrame, key: str, order: str, run: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """run(columns of one group as lists, in order) -> rows, for every value of key (not null)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            at = frame[key].to_numpy()
            cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1).tolist(), len(at)]
            columns = {c: frame[c].tolist() for c in frame.columns}
            out = [row for a, z in zip(cuts, cuts[1:], strict=False) for row in run({c: v[a:z] for c, v in columns.items()})]
            return pd.DataFrame(out, columns=names)

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            at = frame[key].to_numpy()
            last = int(np.nonzero(at != at[-1])[0][-1]) + 1 if (at != at[-1]).any() else 0
            held = frame.iloc[last:]
            if last:
                yield done(frame.iloc[:last])
        if held is not None and len(held):
            yield done(held)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(part, schema)


def scanned(df: DataFrame, key: str, order: str, values: Sequence[str], start: Callable[[], Callable[..., tuple]], made: dict[str, str]) -> DataFrame:
    """df with columns made (name -> type), from a pass along each key (not null) in order.

    start() gives a key's step function: step(*values of a row) -> the made values of that row. Missing numbers are NaN.
    A task holds one batch and one key's state.
    """
    names = df.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out, nan = [], float("nan")
            columns = [batch.column(c).to_pylist() for c in values]
            for k, *xs in zip(batch.column(key).to_pylist(), *columns, strict=True):
                if step is None or k != now:
                    now, step = k, start()
                out.append(step(*[nan if x is None else x for x in xs]))
            arrays = [pa.array([None if r[i] is None or r[i] != r[i] else r[i] for r in out], KINDS[kind]) for i, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], [*names, *made])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{n}` {k}" for n, k in made.items()])
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(part, schema)
