"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpusloom.sources.shared import shared_path

#: Maps A-Z to a-z and every other ASCII byte that is no digit or lower-case letter to a blank.
#: In UTF-8 all bytes of other characters are above 0x7F, so words can be cut on bytes.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(text: str | None) -> bytes:
    """Bytes of a text; null is empty, lone surrogates (which Arrow cannot carry anyway) become ``?``."""
    return (text or "").encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = shared_path(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function from one batch to column dicts; ``schema`` is a Spark type or DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def keep_rows(df: DataFrame, text: str, decide: Callable[[list[str | None]], list[bool]], most: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose text ``decide`` wants, with all their columns; one map, no join.

    The columns go by number meanwhile, so their names may hold anything.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = f"c{df.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, most):
                yield part.filter(pa.array(decide(part.column(place).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``most`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
