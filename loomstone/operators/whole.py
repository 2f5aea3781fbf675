"""Work on whole units in column batches: a Python worker sees many units at once, and each of them whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20


def _whole(batches: Iterator[pa.RecordBatch], least: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Tables of whole units, of rows that come with equal units together."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        size += b.nbytes
        if size < least:
            continue
        t = pa.concat_tables(held)
        code = unit_codes(t)
        cut = int(np.searchsorted(code, code[-1]))
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
            t = t.take(pa.array(np.arange(t.num_rows)))  # a slice would keep all of its table in memory
        held, size = [t], t.nbytes if cut else 0  # of a unit larger than this, as much again is read before it is looked at
    if held:
        yield pa.concat_tables(held)


def unit_codes(t: pa.Table) -> np.ndarray:
    """0, 1, ... for each row's unit; equal units stand together."""
    code = t["unit"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])]) if len(code) else code


def map_units(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema, *columns) -> DataFrame:
    """run over tables of whole units of rows(unit, ...), in any order within a unit. columns: what goes to Python besides unit and unit_rows, computed after the rows are together.

    The window that counts a unit's rows brings them together, with a shuffle only where they are not yet."""
    x = rows.withColumn("unit_rows", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    x = x.select("unit", "unit_rows", *columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            yield from run(t.combine_chunks()).combine_chunks().to_batches()

    return x.mapInArrow(each, schema)


def bags(t: pa.Table, column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, term, count, number of terms) of lists of terms, each distinct term of a row once, by row; rows: the number that stands for each row."""
    lists = t[column].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().dictionary_encode()
    term, n = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    key, count = np.unique(np.repeat(rows, lengths).astype(np.int64) * n + term, return_counts=True)
    return key // n, key % n, count.astype(np.float64), n


def pages_of(t: pa.Table, *by: str) -> Iterator[list[dict]]:
    """The rows of each unit as records, in the order of `by`."""
    order = [(c, "ascending") for c in by]
    bounds = np.flatnonzero(np.diff(unit_codes(t), prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield t.slice(a, b - a).sort_by(order).to_pylist() if by else t.slice(a, b - a).to_pylist()
