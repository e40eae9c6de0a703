"""Shared pieces of the training-data operators: reading, folds, bounded
samples, and Arrow-batched row annotation."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import scratch_path

_FIELD = "n:{}"
_SHIPPED: set[str] = set()
#: Rows of a few numbers that a join may broadcast: about 10 MB, Spark's own bound on a table's size.
FEW_ROWS = 200_000
#: What this worker process holds for the next tasks: at most one thing, by its kind and key.
_STORED: dict[tuple, object] = {}
_BATCH_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package: its sources go
    out once per application as a zip that the driver serves.  Bounds the rows
    and bytes of an Arrow batch as well."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    # Batches of whole texts: Spark's default number of rows (left alone if it was changed) can fill a worker's memory.
    if spark.conf.get(_BATCH_ROWS, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_ROWS, "2000")
    # And by size, as texts may be long: the buffers of larger batches add up in executors and workers.
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "1m")
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-py-"), "fleetlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package, followlinks=True):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, fn, schema, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors.  Workers live
    on for other operators' tasks, so each task lets go of what is ``stored`` of
    another kind than ``keeps``, and freed memory is handed back around it."""
    ship(df.sparkSession)

    def run(batches):
        let_go(keeps)
        hand_back()
        try:
            yield from fn(batches)
        finally:
            hand_back()

    return df.mapInArrow(run, schema)


def stored(kind: str, key, make: Callable[[], object]):
    """What ``make`` returns, made once and kept in this process until something
    else is stored or a task that keeps no such kind begins."""
    found = _STORED.get((kind, key))
    if found is None:
        _STORED.clear()
        found = _STORED[kind, key] = make()
    return found


def let_go(but: str | None = None) -> None:
    """Drop what this process keeps, unless it is of the kind ``but``."""
    for k in [k for k in _STORED if k[0] != but]:
        del _STORED[k]


def hand_back() -> None:
    """Return this process's freed memory to the system, where it can be."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, typed, so that any extra column
    (whatever its name) cannot clash with the operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"),
                       *[F.col(c) for c in more])


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (NULL for a NULL id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


def held_out(doc_id: str, k: int, remainder: int) -> Column:
    """True when the fold of the id is ``remainder``; a NULL id is never held out."""
    return F.coalesce(fold(doc_id, k) == remainder, F.lit(False))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint directory and read it back: cuts
    the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, for the side of a join that is
    broadcast while these are few.  More are shuffled."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialised frames that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df._folder)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def bounded_per_class(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, chosen by the hash of the key.

    The rows of a label are first thinned by their hash to about twice the
    bound, from a count of each label, so however many rows a label has, few
    of them meet in the task that ranks them."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_of_label"))  # a row for each label
    part = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.lit(2 * per_class + 100) / F.col("_of_label")
    thin = rows.join(F.broadcast(sizes), label).where(part)
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(1)), F.col(key))
    return thin.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_class).select(*rows.columns)


def quoted(columns: list[str]) -> list[str]:
    """Column names as identifiers, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def free_name(taken: list[str], base: str) -> str:
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def annotate(df: DataFrame, column: str, fields: list[T.StructField],
             factory: Callable[[], Callable[[list], list[pa.Array]]],
             keep: list[str] | None = None, keeps: str | None = None) -> tuple[DataFrame, str]:
    """Append one struct column computed from the text column, batch by batch.

    ``factory`` builds, once per task, a function from a list of texts (None
    for NULL) to one Arrow array per field.  The columns named in ``keep`` (all
    by default) pass through unchanged; leaving out the text saves its way
    back.  ``keeps`` is the kind of what the factory has ``stored``.  Returns the
    frame and the name of the new column.
    """
    kept = df.columns if keep is None else keep
    name = free_name(kept, "found")
    struct = T.StructType(fields)
    arrow_fields = [pa.field(f.name, _arrow_type(f.dataType)) for f in fields]
    where = df.columns.index(column)
    places = [df.columns.index(c) for c in kept]
    in_names = [_FIELD.format(i) for i in range(len(df.columns))]
    out_names = [in_names[i] for i in places] + [_FIELD.format(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for b in batches:
            if score is None:
                score = factory()
            arrays = [a.cast(f.type) for a, f in zip(score(b.column(where).to_pylist()), arrow_fields, strict=True)]
            found = pa.StructArray.from_arrays(arrays, fields=arrow_fields)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), found], names=out_names)

    # Positional names inside the exchange with Python: column names of the caller may be anything.
    renamed = df.toDF(*in_names)
    schema = T.StructType([*(renamed.schema.fields[i] for i in places), T.StructField(out_names[-1], struct)])
    return map_arrow(renamed, run, schema, keeps).toDF(*kept, name), name


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow_type(f.dataType)) for f in t.fields])
    return {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[t.typeName()]
