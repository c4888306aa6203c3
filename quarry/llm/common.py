"""What the operators share: inputs, the shared folder, Arrow batch mapping."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an operator's Python code holds at once.
ROWS = 1000

_local_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` of the session names it.  Where that is unset, a
    local master gets a temporary folder; a cluster has to name one, as a machine-local
    folder is of no use there.
    """
    global _local_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="quarry-")
        return f"file://{_local_dir}"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, kind: str = "step") -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/quarry/{kind}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the file system that has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def materialize(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: an executor that is lost later costs no recomputation.
    Unlike ``checkpoint()`` the copy is columnar, so later reads are pruned.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, file)


#: A key that more than one in so many rows have is hot; there are fewer such keys than that.
HOT = 1000


def join_hot(rows: DataFrame, key: str, facts: DataFrame, of: str, times: str, total: int) -> DataFrame:
    """``rows`` with the ``facts`` of their key, which is ``of`` there, once for each key; rows without any go.

    ``times``: how many of the ``total`` rows have the key, at most.  Facts of hot keys are
    broadcast, fewer than ``HOT`` rows; the others go by an ordinary
    join, in which no key has more than ``total / HOT`` rows.  ``rows`` are read twice.
    """
    hot = facts.where(F.col(times) * HOT > total)
    others = rows.join(F.broadcast(hot.select(F.col(of).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    here = rows.join(F.broadcast(hot), F.col(key) == F.col(of)).drop(of, times)
    return here.unionAll(others.join(facts.where(F.col(times) * HOT <= total), F.col(key) == F.col(of)).drop(of, times))


def quoted(names: list[str]) -> list[str]:
    """Column names as they are, whatever signs they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def without(names: list[str], *taken: str) -> list[str]:
    """The names but for those that Spark would take for one of ``taken``."""
    low = {t.lower() for t in taken}
    return [n for n in names if n.lower() not in low]


def unused(*names: str) -> list[str]:
    """Column names that no input has."""
    mark = uuid.uuid4().hex
    return [f"_{mark}_{n}" for n in names]


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


_PLACE = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """A number for each shingle, in text order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    size = min(size, len(h))
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        mixed += (h[k : len(h) - size + 1 + k] ^ np.uint64(k + 1)) * _PLACE[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def set_hash(grams: np.ndarray) -> int:
    """A signed 64-bit number for a sorted set."""
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]]) -> DataFrame:
    """``mapInArrow`` over ``df``.

    ``make`` is called once in each task and returns the function for a batch
    of at most ``ROWS`` rows, whose columns go by their places; that gives columns
    by name (lists or arrays), all of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])
        own = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                out = own(batch.slice(start, ROWS))
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[k.name], pa.Array) else pa.array(x, k.type) for k in kinds], names=kinds.names)

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    # By place: PySpark looks columns up by name here, which fails for odd names.
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def id_type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
