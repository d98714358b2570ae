"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.joins import joined_by_weight
from ..session import discard, ship_code, stored

#: Characters of text handled at once inside a Python worker; bounds its lists of words.
SLICE_CHARS = 2_000_000

__all__ = ["as_bytes", "beside_texts", "conversations", "discard", "documents", "embeddings", "hold", "id_bucket", "joined_by_weight", "labels", "map_texts", "memory", "quoted", "release", "slices", "stored"]

#: Word memories by operator; a worker keeps those of one operator at a time.
_memories: dict[str, list[dict]] = {}
_holder: list[str] = [""]


def memory(name: str, kind: type[dict] = dict) -> dict:
    """A dict that outlives tasks in a reused worker, until another operator holds the worker."""
    made = kind()
    _memories.setdefault(name, []).append(made)
    return made


def hold(name: str) -> None:
    """Empty the memories of all operators but name."""
    if _holder[0] != name:
        for other, held in _memories.items():
            if other != name:
                for m in held:
                    m.clear()
        _holder[0] = name


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, mod n; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Cut a list of texts into runs of about limit characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str]], list[list]],
    outputs: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Apply fn to runs of texts without a shuffle.

    fn gets texts (null read as empty) and returns one list per output column.
    The result has the columns of keep, untouched, then those of outputs (a DDL
    string).
    """
    done = beside_texts(df, fn, outputs, keep, text)
    return done.select(*[F.col("kept").getField(c).alias(c) for c in keep], *done.columns[1:])


def beside_texts(df: DataFrame, fn: Callable[[list[str]], list[list]], outputs: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """map_texts with the columns of keep in one struct, kept, so that columns of any name travel beside the outputs."""
    ship_code(df.sparkSession)
    kept = F.struct(*[F.col(quoted(c)) for c in keep] or [F.lit(0).alias("nothing")]).alias("kept")
    source = df.select(kept, F.col(quoted(text)).alias("text"))
    schema = StructType([source.schema["kept"], *StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is not None else "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                own = batch.column(0).slice(part.start, part.stop - part.start)
                made = fn(texts[part])
                columns = [own.cast(arrow.field(0).type), *(pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(made))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            release()

    return source.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as col() takes it whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def as_bytes(text: str) -> bytes:
    """UTF-8; a lone surrogate, which Spark never yields, becomes '?'."""
    return text.encode("utf-8", "replace")
