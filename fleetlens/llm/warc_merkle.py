"""Merkle fixity audit of WARC files.

A page is a WARC resource record at an offset of its file.  Every record is
hashed; the records that start in one range of ``span`` bytes are hashed, in
order, to a range node, ``FANOUT`` neighbouring ranges to a wider one and so on
up to the file, and files in the same way to one root.  An audit compares the
roots of two replicas, descends level by level only below nodes that differ,
and so finds the records that are damaged, missing or extra.

Nodes are numbered by offset and file number, not by rank, so a lost record
changes only the nodes above it.  A file holds the pages of a range of
``ids_per_file`` ids; pages with a NULL id are spread over NULL_FILES files by
the hash of their content.  A record is hashed where it is read, and only its id,
url, hash and length are sorted to find offsets: the bytes never cross the network.
Equal records are counted before they are sorted, and ranges of the sorted rows
carry on from each other's sums, so neither a file nor the copies of a record meet
in one task.

Defined cases: records of equal id are ordered by url and hash; equal rows give
equal records one after the other; a NULL url or html is empty; an empty table has
no records; only page_id, url and html are read, so extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise

FANOUT = 16
SPAN = 1 << 16
NULL_FILES = 64

RECORD = r"""concat('WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:', coalesce(string(page_id), 'none'),
    '>\r\nWARC-Target-URI: ', url, '\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ',
    octet_length(html), '\r\n\r\n', html, '\r\n\r\n')"""


#: Copies of one record that one task places.
COPIES = 50_000


def records(pages: DataFrame, ids_per_file: int = 1024) -> DataFrame:
    """WARC records: page_id, url, file, length, hash, record."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.select("page_id", "url", F.expr(RECORD).alias("record"))
    file = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("record"), F.lit(NULL_FILES))).otherwise(
        F.floor(F.col("page_id") / ids_per_file))
    return p.select("page_id", "url", file.cast("long").alias("file"), F.octet_length("record").cast("long").alias("length"),
                    F.sha2("record", 256).alias("hash"), "record")


def leaves(recs: DataFrame, *more: str) -> DataFrame:
    """Level 0: page_id, file, start (offset), length and hash of every record,
    and the columns ``more`` that depend on a record alone."""
    keys = ["file", "page_id", "url", "hash", "length", *more]
    order = [F.col("file"), F.col("page_id").asc_nulls_first(), F.col("url"), F.col("hash"), *map(F.col, more)]
    groups = recs.groupBy(*keys).agg(F.count("*").alias("_copies"))
    ranged = groups.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_bytes", F.col("_copies") * F.col("length"))
    ranged = materialise(ranged, "ranged")
    ahead = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    parts = ranged.groupBy("file", "_part").agg(F.sum("_bytes").alias("b")).select("file", "_part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("file", "_part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_at", F.coalesce(F.sum("_bytes").over(within), F.lit(0))).join(parts, ["file", "_part"])
    some = F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPIES}L)"))
    one = F.explode(F.expr(f"sequence(_chunk * {COPIES}L, least(_copies, (_chunk + 1) * {COPIES}L) - 1)"))
    dealt = placed.withColumn("_chunk", some).repartition("file", "page_id", "hash", "_chunk").withColumn("_copy", one)
    return materialise(dealt.select("page_id", "file", (F.col("_base") + F.col("_at") + F.col("_copy") * F.col("length")).alias("start"), "length", "hash", *more), "leaves")


class Tree:
    """Node tables of one replica, level 0 (records) first.

    A node is (file, node, hash): below the file level ``node`` numbers ranges
    of offsets; above it files are grouped and ``node`` is 0.
    """

    def __init__(self, level0: DataFrame, file_levels: int, group_levels: int, span: int = SPAN):
        self.levels = [level0.select("page_id", "file", F.col("start").alias("node"), "length", "hash")]
        self.parents: list[tuple[str, str]] = []  # how a level's nodes name their parents
        for k in range(file_levels + group_levels):
            parent = ("file", f"node div {span if k == 0 else FANOUT}L") if k < file_levels else (f"floor(file / {FANOUT})", "0L")
            below = self.levels[-1]
            self.parents.append(parent)
            # A range holds at most span / (smallest record) records, any other node FANOUT children.
            children = F.array_sort(F.collect_list(F.struct(F.col("file"), F.col("node"), F.col("hash"))))
            self.levels.append(
                below.groupBy(F.expr(parent[0]).cast("long").alias("pf"), F.expr(parent[1]).alias("pn"))
                .agg(children.alias("c"))
                .select(F.col("pf").alias("file"), F.col("pn").alias("node"),
                        F.sha2(F.expr("concat_ws(',', transform(c, x -> concat(x.file, ':', x.node, ':', x.hash)))"), 256).alias("hash")))


def _heights(a: DataFrame, b: DataFrame, span: int) -> tuple[int, int]:
    """Levels up to one node a file, and from there to one root."""
    ends = a.select("file", "start").unionByName(b.select("file", "start"))
    r = ends.agg(F.max("start").alias("s"), F.min("file").alias("lo"), F.max("file").alias("hi")).first()
    nodes, in_file = (r["s"] or 0) // span, 1
    while nodes:
        nodes, in_file = nodes // FANOUT, in_file + 1
    lo, hi, groups = r["lo"] or 0, r["hi"] or 0, 0
    while lo != hi and (lo, hi) != (-1, 0):
        lo, hi, groups = lo // FANOUT, hi // FANOUT, groups + 1
    return in_file, groups


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN) -> DataFrame:
    """The records in which two leaf tables differ: file, start, page_id and
    the hashes on both sides (NULL where a side has no record)."""
    in_file, groups = _heights(primary, replica, span)
    a, b = Tree(primary, in_file, groups, span), Tree(replica, in_file, groups, span)
    suspect = None
    for level in range(len(a.levels) - 1, -1, -1):
        x, y = a.levels[level], b.levels[level]
        if suspect is not None:
            keys = suspect.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
            pf, pn = (F.expr(e) for e in a.parents[level])
            x, y = (t.withColumn("pf", pf.cast("long")).withColumn("pn", pn).join(keys, ["pf", "pn"], "left_semi").drop("pf", "pn")
                    for t in (x, y))
        # Equal hashes at one place pair off; what is left differs.
        if level == 0:
            return _pair(x, y)
        suspect = (x.select("file", "node", F.col("hash").alias("h")).join(y.select("file", "node", F.col("hash").alias("g")), ["file", "node"], "full_outer")
                   .where("not (h <=> g)").select("file", "node"))
        suspect = materialise(suspect, "suspects")
    raise AssertionError("level 0 is always reached")


def _pair(x: DataFrame, y: DataFrame) -> DataFrame:
    x = x.select("file", F.col("node").alias("start"), F.col("page_id").alias("pa"), F.col("hash").alias("primary_sha256"))
    y = y.select("file", F.col("node").alias("start"), F.col("page_id").alias("pb"), F.col("hash").alias("replica_sha256"))
    return (x.join(y, ["file", "start"], "full_outer").where("not (primary_sha256 <=> replica_sha256)")
            .select("file", "start", F.coalesce("pa", "pb").alias("page_id"), "primary_sha256", "replica_sha256"))


def fixity_report(primary: DataFrame, replica: DataFrame, span: int = SPAN) -> DataFrame:
    """Every record of either replica with its state: intact, damaged, missing
    (not in the replica) or extra (only there)."""
    found = audit(primary, replica, span).select("file", "start", F.col("page_id").alias("other_id"), "primary_sha256", "replica_sha256")
    state = (F.expr("case when primary_sha256 is null and replica_sha256 is null then 'intact' when replica_sha256 is null then 'missing' "
                    "when primary_sha256 is null then 'extra' else 'damaged' end"))
    both = primary.select("page_id", "file", "start", "length", "hash").join(found, ["file", "start"], "full_outer")
    return both.select(F.coalesce("page_id", "other_id").alias("page_id"), "file", "start", "length",
                       F.col("hash").alias("record_sha256"),
                       F.when(state == "intact", F.col("hash")).otherwise(F.col("replica_sha256")).alias("replica_sha256"),
                       state.alias("state"))
