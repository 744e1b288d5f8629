"""Arrow-batched passes of plain Python functions over rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship, spread

#: Bytes of text that one pass holds at once, besides a single text beyond it.
SLICE = 16 << 20


def map_rows(df: DataFrame, fn: Callable, schema: str, scan: bool = False) -> DataFrame:
    """``fn(*values of a row) -> iterable of output tuples``, row by row inside Arrow batches.

    Rows are handed to Python in Arrow batches and written back in slices, so memory stays bounded
    by the largest texts. ``scan`` says that ``df`` only reads files: small ones are then spread over all cores.
    """
    ship(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        out: list[list] = [[] for _ in arrow]
        n = 0
        for batch in batches:
            for row in zip(*(_values(c) for c in batch.columns), strict=True):
                for got in fn(*row):
                    for o, v in zip(out, got, strict=True):
                        o.append(v)
                    n += 1
                if n >= 20_000:
                    yield _batch(out, arrow)
                    out, n = [[] for _ in arrow], 0
        yield _batch(out, arrow)

    return (spread(df) if scan else df).mapInArrow(run, struct)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, scan: bool = False) -> DataFrame:
    """``make()`` is called once a task and gives ``fn(*columns as lists) -> columns as lists``, batch by batch."""
    ship(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in _slices(batch):
                yield _batch(fn(*(c.to_pylist() for c in part.columns)), arrow)

    return (spread(df) if scan else df).mapInArrow(run, struct)


def _values(column):
    """Values of a column, in pieces, so that one batch of long texts is not held twice; lists of numbers as lists, by their offsets."""
    for at in range(0, len(column), 500):
        part = column.slice(at, 500)
        if pa.types.is_list(part.type) and pa.types.is_integer(part.type.value_type) and not part.values.null_count:
            flat, ends = part.flatten().to_numpy(zero_copy_only=False).tolist(), part.value_lengths().to_pylist()
            to = 0
            for n in ends:
                if n is None:
                    yield None
                else:
                    to += n
                    yield flat[to - n : to]
        else:
            yield from part.to_pylist()


def _slices(batch: pa.RecordBatch):
    """A batch in pieces of about ``SLICE`` bytes."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * SLICE / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
