"""Tables that change in one step: all of a load is visible, or none of it.

A root holds any number of tables.  Data folders below ``data/`` are written by
Spark once, under a name nobody else uses, and never changed.  What belongs to
the tables is said by the newest file of ``versions/``: for each table its
schema and its folders, and for each load its id and content digest.  A load
writes its folders first and then puts the next version file, which must not
exist yet: the file appears whole or not at all, and of two writers one wins.
The loser reads the winner's version and builds its load on that.

So a reader resolves one version and keeps it; a writer that stops anywhere
before the last step has changed nothing (its folders belong to no version and
``vacuum`` removes them).  The put needs a file system whose rename does not
replace an existing file (HDFS, local); on an object store use one with
conditional puts behind the same Hadoop interface.

The version file holds one entry for each folder of a table and for each load; a
partitioned table has at most one folder entry for each partition value and
commit that still holds current rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_VERSION = 0


class LostRace(Exception):
    """Another writer put the version first."""


class LoadRejected(ValueError):
    """A load broke more rules than allowed; nothing was committed."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        super().__init__(f"load rejected: {counts}")


@dataclass
class Version:
    number: int = NO_VERSION
    tables: dict[str, dict] = field(default_factory=dict)   # name -> {schema, partition, folders}
    loads: dict[str, dict] = field(default_factory=dict)    # load id -> {rows, digest}
    info: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "tables": self.tables, "loads": self.loads, "info": self.info}, sort_keys=True)


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p, sc._jvm.org.apache.hadoop


class Manifest:
    """The versions of the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading ---------------------------------------------------------

    def numbers(self) -> list[int]:
        fs, top, _ = _hadoop(self.spark, f"{self.root}/versions")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or a given one; an empty one before the first load."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return Version()
            number = numbers[-1]
        fs, path, hadoop = _hadoop(self.spark, self._file(number))
        stream = fs.open(path)
        try:
            return Version(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of one version."""
        return self.frame(self.version(number), name)

    def frame(self, version: Version, name: str, values: list | None = None) -> DataFrame:
        """The rows of a table in ``version``; only the partitions in ``values`` (as ``_text`` writes them) if given."""
        if name not in version.tables:
            raise KeyError(f"no table {name} in version {version.number} of {self.root}")
        table = version.tables[name]
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{f['path']}" for f in table["folders"] if values is None or f["value"] in values]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _file(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    # -- writing ---------------------------------------------------------

    def put(self, version: Version) -> None:
        """Make ``version`` the newest.  Raises LostRace if its number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, top, hadoop = _hadoop(self.spark, f"{self.root}/versions")
        fs.mkdirs(top)
        fresh = f"{self.root}/versions/.{version.number:012d}-{uuid.uuid4().hex}"
        out = fs.create(hadoop.fs.Path(fresh), False)
        out.write(bytearray(version.to_json().encode()))
        out.close()
        context = hadoop.fs.FileContext.getFileContext(top.toUri() if top.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hadoop.fs.Path(fresh), hadoop.fs.Path(self._file(version.number)), none)  # never replaces
        except Exception as e:
            fs.delete(hadoop.fs.Path(fresh), False)
            if "FileAlreadyExists" in str(e):
                raise LostRace(self._file(version.number)) from e
            raise

    def update(self, change: Callable[[Transaction], None], tries: int = 8) -> Version:
        """Run ``change`` on a transaction and commit it; after a lost race the
        change is made again on the winner's version."""
        for left in range(tries - 1, -1, -1):
            t = Transaction(self, self.version())
            change(t)
            if not t.touched:
                return t.base
            try:
                return t.commit()
            except LostRace:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the versions before the newest ``keep`` and all data folders
        that none of those names.  Not while a writer is at work: its folders
        belong to no version yet."""
        numbers = self.numbers()
        kept = {f["path"].split("/")[1] for n in numbers[-keep:] for t in self.version(n).tables.values() for f in t["folders"]}
        fs, data, hadoop = _hadoop(self.spark, f"{self.root}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in kept] if fs.exists(data) else []
        for n in numbers[:-keep]:
            fs.delete(hadoop.fs.Path(self._file(n)), False)
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)


class Transaction:
    """Changes to tables on top of one version, visible after ``commit``."""

    def __init__(self, manifest: Manifest, base: Version):
        self.manifest, self.base = manifest, base
        self.next = Version(base.number + 1, json.loads(json.dumps(base.tables)), dict(base.loads), dict(base.info))
        self.touched = False

    def read(self, name: str) -> DataFrame:
        """A table as this transaction leaves it."""
        return self.manifest.frame(self.next, name)

    def has(self, name: str) -> bool:
        return name in self.next.tables

    def overwrite(self, name: str, df: DataFrame, partition: str | None = None, rules: dict[str, Column] | None = None, limit: int = 0) -> dict[str, int]:
        """Full refresh of a table."""
        folder, counts = self._write(df, partition, rules or {}, limit)
        self.next.tables[name] = {"schema": _nullable(df.schema).jsonValue(), "partition": partition, "folders": self._folders(folder, partition)}
        self.touched = True
        return counts  # violations of each rule

    def append(self, name: str, df: DataFrame, load_id: str | None = None, rules: dict[str, Column] | None = None, limit: int = 0) -> bool:
        """Add rows by column name.  With a ``load_id`` the load is remembered
        with its content (row count and an order-free digest), in the same
        commit: repeating it adds nothing and returns False, and other content
        under the same id is an error.

        ``rules`` (name -> violating condition) are counted while the rows are
        written; more than ``limit`` violations of one raise LoadRejected."""
        if self.has(name):
            known = T.StructType.fromJson(self.next.tables[name]["schema"])
            df = df.select(*[F.col(f"`{c}`").cast(known[c].dataType) for c in known.names])
        partition = self.next.tables[name]["partition"] if self.has(name) else None
        content = {} if load_id is None else {"rows": 0, "digest": "0"}
        folder, _ = self._write(df, partition, rules or {}, limit, content)
        if load_id is not None:
            known_load = self.next.loads.get(load_id)
            if known_load is not None and known_load != content:
                raise ValueError(f"load {load_id!r} was made before with other content: {known_load}, now {content}")
            if known_load is not None:
                return False  # the folder just written belongs to no version
            self.next.loads[load_id] = content
        if self.has(name):
            self.next.tables[name]["folders"] += self._folders(folder, partition)
        else:
            self.next.tables[name] = {"schema": _nullable(df.schema).jsonValue(), "partition": None, "folders": self._folders(folder, None)}
        self.touched = True
        return True

    def upsert(self, name: str, incoming: DataFrame, keys: list[str], partition: str, derived: Column | None = None) -> None:
        """Insert new keys, replace the rows of existing ones, in a table
        partitioned by ``partition``.

        Only the partitions that change are read whole and written anew.  They
        are those of the incoming rows and those in which an incoming key is
        now; the second need a look at the stored keys (key and partition
        columns only), unless the partition is a function of the key:
        ``derived`` states it, and rows that break it are an error.  NULL is a
        partition like any other.  Incoming rows that repeat a key are an
        error; rows without a key (a NULL in it) match nothing and are added."""
        from fleetlens.operators.tables import check_unique, split_null_keys, stored, upsert
        incoming = stored(incoming)
        check_unique(split_null_keys(incoming, keys)[0], keys)
        if derived is not None and not incoming.where(~F.col(partition).eqNullSafe(derived)).isEmpty():
            raise ValueError(f"{partition} is not what the key {keys} says")
        touched = incoming.select(_text(partition).alias("v")).distinct()
        new, schema = incoming, _nullable(incoming.schema)
        if self.has(name):
            schema = T.StructType.fromJson(self.next.tables[name]["schema"])
            if derived is None:
                now = split_null_keys(self.read(name).select(*keys, partition), keys)[0]
                moved = now.join(incoming.select(*keys).distinct(), keys, "left_semi").select(_text(partition).alias("v"))
                touched = touched.unionByName(moved).distinct()
        values = [r["v"] for r in touched.collect()]  # one for each partition that changes
        if self.has(name):
            old = self.manifest.frame(self.next, name, values)
            new = upsert(old, incoming.select(*schema.names), keys, check=False)
        folder, _ = self._write(new.select(*schema.names), partition, {}, 0)
        kept = [f for f in self.next.tables.get(name, {"folders": []})["folders"] if f["value"] not in values]
        self.next.tables[name] = {"schema": schema.jsonValue(), "partition": partition, "folders": kept + self._folders(folder, partition)}
        self.touched = True

    def commit(self) -> Version:
        self.manifest.put(self.next)
        return self.next

    def _write(self, df: DataFrame, partition: str | None, rules: dict[str, Column], limit: int, content: dict | None = None) -> tuple[str, dict[str, int]]:
        """Write a folder; the rules' violations and, into ``content``, the row
        count and the digest are observed on the way."""
        seen, watched = Observation(), df
        columns = [F.col(f"`{c}`") for c in df.columns]
        digest = F.sum(F.xxhash64(*columns, *[c.isNull() for c in columns]).cast("decimal(38,0)"))  # the hash skips NULLs
        wanted = [F.count(F.lit(1)).alias("rows"), digest.cast("string").alias("digest")] if content else []
        wanted += [F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(f"rule_{i}") for i, c in enumerate(rules.values())]
        if wanted:
            watched = df.observe(seen, *wanted)
        folder = f"data/{uuid.uuid4().hex}"
        w = watched if partition is None else watched.withColumn("_p", _text(partition))
        w = w.write.mode("errorifexists")
        (w if partition is None else w.partitionBy("_p")).parquet(f"{self.manifest.root}/{folder}")
        got = seen.get if wanted else {}
        if content:
            content.update(rows=got["rows"], digest=got["digest"] or "0")
        counts = {name: got[f"rule_{i}"] for i, name in enumerate(rules)}
        if any(v > limit for v in counts.values()):
            raise LoadRejected(counts)
        return folder, counts

    def _folders(self, folder: str, partition: str | None) -> list[dict]:
        if partition is None:
            return [{"path": folder, "value": None}]
        fs, top, hadoop = _hadoop(self.manifest.spark, f"{self.manifest.root}/{folder}")
        unescape = self.manifest.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory())
        return [{"path": f"{folder}/{n}", "value": None if n.endswith("=__HIVE_DEFAULT_PARTITION__") else unescape(n.split("=", 1)[1])} for n in names]


def _text(partition: str) -> Column:
    """A partition value as text; the letter before it keeps an empty text apart from NULL."""
    return F.concat(F.lit("v"), F.col(f"`{partition}`").cast("string"))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
