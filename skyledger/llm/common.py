"""Shared helpers: document folds, and Arrow batches of texts and of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scratch import discard, stored

__all__ = ["complete", "concat_structs", "discard", "fold", "lower_ascii", "slices", "stored", "struct_of"]


def fold(doc_id: Column, of: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `of`."""
    return F.crc32(doc_id.cast("string")) % of


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Cut an Arrow text array into runs of about `limit` bytes, one text at least."""
    size = np.fromiter((len(x) for x in texts.cast(pa.binary()).to_pylist()), np.int64, len(texts)) if len(texts) else np.zeros(0, np.int64)
    lo, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield texts.slice(lo, i - lo)
            lo, total = i, 0
        total += int(n)
    if lo < len(texts):
        yield texts.slice(lo)


def concat_structs(parts: list[pa.Array], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """One struct array from the runs of a batch; an empty one where there were none."""
    if parts:
        return pa.concat_arrays(parts)
    return pa.StructArray.from_arrays([pa.array([], t) for _, t in fields], fields=[pa.field(n, t) for n, t in fields])


def struct_of(fields: list[tuple[str, pa.DataType]], columns: list) -> pa.Array:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in fields])


def complete(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of sorted rows cut so that no group of equal keys is split; and where each group begins, and the end."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        fresh = np.zeros(batch.num_rows, bool)
        fresh[0] = True
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            fresh[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(fresh).tolist()
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        tail = batch.slice(starts[-1])
    if tail is not None:
        yield tail, [0, tail.num_rows]
