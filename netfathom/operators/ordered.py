"""Rules along the rows of a key, in order: rows stream through a task, and only the rule's own state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK = 10000  # rows of a batch


def in_order(rows: DataFrame, keys: list[str], order: list[str], schema: StructType, rule: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """What ``rule`` gives for the rows of each key. It takes an iterator over them and is to read it to the end; a key of
    any size is never gathered."""
    at, kinds = [rows.columns.index(k) for k in keys], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = (r for _, own in groupby(flat, lambda r: tuple(r[i] for i in at)) for r in rule(own))
        while chunk := list(islice(out, CHUNK)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*chunk), kinds)], schema=kinds)

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
