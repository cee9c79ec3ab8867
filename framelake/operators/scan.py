"""Groups of rows in order, one after another in Python: for what a fold along an order does in one pass and SQL would do by copying."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch of results, from which on it is handed over.
OUT_ROWS = 8192


def each_group(df: DataFrame, keys: list[str], order: list, columns: list[str], of: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """of(columns of a group, as numpy arrays or lists, rows in order) -> columns of its result; schema: keys, then the result's columns.

    Rows are dealt by keys and sorted there; a task holds one group at a time, whatever the number of groups. Results of several small
    groups share a batch.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    rest = [c for c in names if c not in keys]

    def run(batches):
        now, parts, made, rows = None, [], {c: [] for c in names}, 0

        def done():
            nonlocal rows
            out = of({c: _joined([p[c] for p in parts]) for c in columns})
            if out:
                n = len(next(iter(out.values())))
                rows += n
                for c in rest:
                    made[c].append(out[c])
                for k, v in zip(keys, now):
                    if k in made:
                        made[k].append([v] * n)

        def flushed():
            nonlocal rows
            batch = pa.RecordBatch.from_arrays([pa.array(_joined(made[c])) for c in names], names)
            for c in names:
                made[c].clear()
            rows = 0
            return batch

        for batch in batches:
            if not len(batch):
                continue
            values, start = {c: _values(batch.column(c)) for c in columns}, 0
            for end in _ends(batch, keys):
                key = tuple(batch.column(k)[start].as_py() for k in keys)
                if parts and key != now:
                    done()
                    parts = []
                    if rows >= OUT_ROWS:
                        yield flushed()
                now = key
                parts.append({c: v[start:end] for c, v in values.items()})
                start = end
        if parts:
            done()
        if rows:
            yield flushed()

    dealt = df.select(*dict.fromkeys([*keys, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(_cast(run, schema, df), schema)


def _values(column: pa.Array):
    return column.to_numpy(zero_copy_only=False) if pa.types.is_primitive(column.type) and not column.null_count else column.to_pylist()


def _joined(parts: list):
    """Arrays or lists, one after another."""
    if len(parts) == 1:
        return parts[0] if isinstance(parts[0], np.ndarray) else list(parts[0])
    if all(isinstance(p, np.ndarray) for p in parts):
        return np.concatenate(parts)
    return [x for p in parts for x in (p.tolist() if isinstance(p, np.ndarray) else p)]


def _cast(run, schema: str, df: DataFrame):
    """Casts what run() makes to the schema's types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema)

    def cast(batches):
        for made in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made.columns, kinds)], [f.name for f in kinds])

    return cast


def _ends(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where groups end in a batch whose groups are runs of equal keys."""
    new = np.zeros(max(len(batch) - 1, 0), bool)
    for k in keys:
        c = batch.column(k)
        if c.null_count or not pa.types.is_primitive(c.type):
            c = c.to_pylist()
            new |= np.fromiter((a != b for a, b in zip(c, c[1:])), bool, len(new))
        else:
            c = c.to_numpy(zero_copy_only=False)
            new |= c[1:] != c[:-1]
    return [*(np.nonzero(new)[0] + 1).tolist(), len(batch)]
