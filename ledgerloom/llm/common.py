"""Helpers of the subpackage: tables, staged results, document maps and word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder serves a local session; a cluster session raises, since a machine-local
    folder would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: it cuts lineage and survives lost executors.

    With ``by``, a folder for each of its (few) values, so that a filter on it reads only these.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one job, each removed as soon as the job says that no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of ``tables``; the rest of what was staged stays."""
        gone = [(t, p) for t, p in self.paths if any(t is x for x in tables)]
        self.paths = [(t, p) for t, p in self.paths if not any(t is x for x in tables)]
        for _, path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def named(self, *names: str) -> list[DataFrame]:
        return [t for t, p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t, _ in self.paths if not any(t is x for x in tables)])


def map_batches(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    return df.mapInArrow(task, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of (values, type) pairs or ready arrays."""
    arrays = [pa.array(c[0], c[1]) if isinstance(c, tuple) else c for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal id modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def bounded_sample(df: DataFrame, columns: list[str], by: str, rows: int) -> list:
    """At most ``rows`` rows, in the order of the hash of column ``by``: one, the smallest, of each of ``rows`` hash
    buckets. Aggregated before it is collected, so neither a task nor the driver gets more, whatever the input."""
    h = F.xxhash64(by)
    picked = df.groupBy(F.pmod(h, F.lit(rows)).alias("bucket__")).agg(
        F.min_by(F.struct(*columns), h).alias("row__"), F.min(h).alias("hash__")
    )
    return [r.row__ for r in sorted(picked.collect(), key=lambda r: r.hash__)]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores as needed so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; ``bytes.split`` cuts at exactly these six characters."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z only, which is what ``bytes.lower`` does."""
    return text.encode().lower().split() if text else []


class Recent(dict):
    """A bounded memo: two generations of at most ``limit`` entries, so that frequent keys stay."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file: in ``folder``, or else where the package of the files has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
