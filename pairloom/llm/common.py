"""What the training-data operators share: tables, scratch storage and words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pairloom.functions.storage import shared, ship

__all__ = ["column", "drop", "held", "let_go", "long_id", "map_texts", "plain_words", "saved", "saved_at", "scratch", "shared_dir", "ship", "spaced_words", "steps", "table"]

#: Bytes of text that one step of a Python operator handles at a time.
STEP_BYTES = 4 << 20

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xff] into a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a UTF-8 text with A-Z lower-cased."""
    return text.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    """The id column as a long. Ids of another kind raise, since a cast would turn them into nulls."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{name} is {kind.simpleString()}; ids must be whole numbers")
    return F.col(name).cast("long").alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df as a written table: a lost executor costs no more than reading it again."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """As `saved`, with the path to `drop` when nothing reads the table any more; else it goes when the session's JVM ends."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(f"{at}/t")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/t"), at


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in slices of about `limit` bytes of text, with the texts as UTF-8 (null: empty). A longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > begin and size + n > limit:
                yield batch.slice(begin, i - begin), [x or b"" for x in texts[begin:i]]
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield batch.slice(begin), [x or b"" for x in texts[begin:]]


_held: dict[object, object] = {}


def held(key, make: Callable):
    """make(), kept in this worker process until another key is asked for: a worker that serves one operator after the other holds the cache of one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


_serves: list[str] = [""]


def let_go(module: str) -> None:
    """Drop what this worker process holds if an operator of another module put it there, and return the memory: not all operators ask for a cache of their own."""
    if _serves[0] != module:
        _serves[0] = module
        _held.clear()
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Spark's setting for the bytes of a batch that it hands to Python, its default (64 MB), and the bytes for texts.
_BATCH, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches are bounded by fewer bytes, since 10,000 rows may be long texts. A setting of the session's own stays."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_texts(df: DataFrame, cols: list, schema: str, work: Callable, text: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """Run work(batch, texts) -> dict of columns (or RecordBatch, or None) over slices of whole texts, without a shuffle."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    module = work.__module__

    def run(batches):
        let_go(module)
        for batch, texts in steps(batches, text, limit):
            out = work(batch, texts)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.select(*cols).mapInArrow(run, schema)
