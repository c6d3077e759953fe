"""Arrow plumbing for the operators that run Python inside tasks.

Spark partitions and moves the rows; a task sees one Arrow batch at a time and
works through it in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowloom.session import ship_package

#: Bytes of text that are tokenised or scored together.
SLICE_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def add_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    fn: Callable[[Iterator[list[pa.Array]]], Iterator[list[pa.Array]]],
) -> DataFrame:
    """All columns of ``df`` and the ``outputs`` (a DDL string) that ``fn`` computes.

    ``fn`` maps an iterator of the input arrays of each batch to an iterator of the
    output arrays of each batch, row for row. A column of ``df`` that has the name
    of an output is replaced by it; all others pass through as they are.
    """
    ship_package(df.sparkSession)
    new = StructType.fromDDL(outputs)
    names = {f.name.lower() for f in new}
    old = [c for c in df.columns if c.lower() not in names]
    sent = df.select(*[F.col(quoted(c)) for c in old], *[F.col(quoted(c)).alias(f"__in{i}__") for i, c in enumerate(inputs) if c not in old])
    at = [old.index(c) if c in old else len(old) + sum(x not in old for x in inputs[:i]) for i, c in enumerate(inputs)]
    schema = StructType([f for f in sent.schema if f.name in old][: len(old)] + list(new))
    kinds = [_arrow_type(f.dataType) for f in new]
    labels = [*old, *[f.name for f in new]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[list[pa.Array]]:
            for batch in batches:
                held.append(batch)
                yield [batch.column(i) for i in at]

        for arrays in fn(feed()):
            batch = held.pop()
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(arrays, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(old)], *made], labels)

    return _plain(sent).mapInArrow(run, schema)


def _plain(df: DataFrame) -> DataFrame:
    """``df`` under names that mapInArrow, which reads them as expressions, takes as they are."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_batches(df: DataFrame, inputs: list[str], outputs: str, fn: Callable[[Iterator[list[pa.Array]]], Iterator[list]]) -> DataFrame:
    """``fn`` makes any number of rows out of the input columns of each partition."""
    ship_package(df.sparkSession)
    new = StructType.fromDDL(outputs)
    kinds = [_arrow_type(f.dataType) for f in new]
    labels = [f.name for f in new]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in fn(list(b.columns) for b in batches):
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(arrays, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, labels)

    return _plain(df.select(*[F.col(quoted(c)) for c in inputs])).mapInArrow(run, new)


#: What Spark bounds the bytes of an Arrow batch by, besides its rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send rows to Python by their number alone. With a bound of bytes Spark measures
    the batch after each row, which takes four times as long as to write a row of some numbers.
    For rows of a fixed width only; the setting of before comes back."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str((1 << 31) - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, without decoding; null counts as empty."""
    binary = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(binary).to_pylist()]


def slices(items: list, size: Callable[[object], int] = len, most: int = SLICE_BYTES) -> Iterator[list]:
    """Runs of consecutive items of about ``most`` bytes; a larger item is alone."""
    run: list = []
    total = 0
    for item in items:
        n = size(item)
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(item)
        total += n
    if run:
        yield run
