"""Many values in one row: how tasks pass arrays of numbers through shuffles and take them apart again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LISTS = {
    **dict.fromkeys(("keys", "ids", "rows", "high", "low"), pa.int64()),
    **dict.fromkeys(("at", "size", "doc", "count", "level"), pa.int32()),
}


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def list_batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    columns = []
    for name in names_of(schema):
        if name in ("part", "kind"):
            columns.append(pa.array([r[name] for r in rows], pa.int32()))
        elif name == "data":
            columns.append(pa.array([r.get(name, b"") for r in rows], pa.binary()))
        else:
            kind = _LISTS[name]
            parts = [np.asarray(r.get(name, ())).astype(kind.to_pandas_dtype()) for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind)))
    return pa.RecordBatch.from_arrays(columns, names_of(schema))


def flat(table: pa.Table, name: str) -> np.ndarray:
    """All values of a list column, one row after the other."""
    return np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks)])


def sizes_of(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in table.column(name).chunks)])


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def by_value(order_by: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, positions) for each value of a small integer."""
    order = np.argsort(order_by, kind="stable")
    begins = run_starts(order_by[order])
    return [(int(order_by[order[a]]), order[a:b]) for a, b in zip(begins, [*begins[1:], len(order)])]
