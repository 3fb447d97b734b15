"""Helpers the operators share: scratch tables, byte tables and slicing of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder
    of this process serves a local session; executors of a cluster don't share one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="vertexloom-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. It cuts the lineage, and what was
    computed survives the loss of the executors that computed it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, which has a row for each key and in ``weight`` how
    many of the ``total`` rows have it. Keys of more than a thousandth of the rows, of which there
    can't be more than a thousand, are broadcast, so no task takes all rows of a key."""
    most = total / 1000
    heavy = F.broadcast(keyed.where(F.col(weight) > most).withColumn("is_heavy", F.lit(True)))
    out = [*rows.columns, *[c for c in keyed.columns if c not in rows.columns]]
    marked = rows.join(heavy, on, "left")
    light = marked.where("is_heavy IS NULL").select(*rows.columns).join(keyed.where(F.col(weight) <= most), on)
    return marked.where("is_heavy").select(*out).union(light.select(*out))


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def carried_row(docs: DataFrame, text_col: str, whole: bool) -> tuple[Column, int | None]:
    """What a pass over texts reads: the text as ``body``, or the whole row as the struct ``row`` and
    the place of its text. A row travels once."""
    if not whole:
        return F.col(text_col).alias("body"), None
    return whole_row(docs), docs.columns.index(text_col)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as the struct ``row``, so that their names clash with nothing."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def row_texts(batch: pa.RecordBatch, at: int | None) -> pa.Array:
    """The texts of a batch: the column ``body``, or field ``at`` of the struct ``row``."""
    return batch.column("body") if at is None else pc.struct_field(batch.column("row"), [at])


def byte_slices(batch: pa.RecordBatch, column: str | pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` whose texts (a column of it, or others by row) hold about
    ``most`` bytes at the utmost; a longer text makes a piece of its own."""
    lengths = pc.binary_length(batch.column(column) if isinstance(column, str) else column).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def binary_texts(batch: pa.RecordBatch, column: str | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return (batch.column(column) if isinstance(column, str) else column).cast(pa.binary()).to_pylist()


def words_table(separators: bytes) -> bytes:
    """A table for bytes.translate: A-Z to lower case and every separator to a space. Splitting
    the result with bytes.split() gives the words."""
    lower = bytes(range(256)).lower()
    return bytes(0x20 if i in separators else lower[i] for i in range(256))


#: Words are runs of bytes other than ASCII white space.
SPACED = words_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and all bytes above 0x7F.
ALPHANUMERIC = words_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
