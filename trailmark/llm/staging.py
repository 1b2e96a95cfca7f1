"""Intermediate tables in the shared folder, and connected components over them.

Lineage is cut by writing a table under the folder that the cluster names in
``spark.checkpoint.dir``. Only where that setting is absent and Spark runs inside one machine
(``local``) is a scratch folder made; on a cluster its absence is an error.

Operators return frames that read such tables lazily, so only a caller knows when they may go.
``owned`` collects what is stored while it is open; ``Owned.release`` deletes it once what was made
of it is written. Within an operator ``discard`` deletes tables whose readers are all stored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2048  # some MB of documents; a batch is held several times over, outside the heap and by the Python worker
FILE_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder for local runs without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trailmark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Owned:
    """Tables stored within one ``owned`` block, by path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, None] = {}

    def release(self, unless_read_by: DataFrame | None = None) -> bool:
        """Deletes the tables; not, and False, where the frame given still reads one of them."""
        if unless_read_by is not None and any(
                path.split(":", 1)[-1].lstrip("/") in f for f in unless_read_by.inputFiles() for path in self.tables):
            return False
        for path in self.tables:
            _delete(self.spark, path)
        self.tables.clear()
        return True


_owners: ContextVar[tuple[Owned, ...]] = ContextVar("owners", default=())


@contextmanager
def owned(spark: SparkSession) -> Iterator[Owned]:
    """Whatever is stored while the block is open belongs to the ``Owned`` it yields."""
    owner = Owned(spark)
    token = _owners.set((*_owners.get(), owner))
    try:
        yield owner
    finally:
        _owners.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames that ``stored`` returned and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            for owner in _owners.get():
                owner.tables.pop(path, None)
            _delete(df.sparkSession, path)


@contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the write ends; Arrow batches have at most ``BATCH_ROWS`` rows. The session's settings come back."""
    rows = int(spark.conf.get(BATCH))
    settings = {CLEANUP: "true", BATCH: str(rows if 0 < rows < BATCH_ROWS else BATCH_ROWS)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for a table of ids with ``rows`` rows: as many as there are cores, more where it is large."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def stored(df: DataFrame, name: str, bucketed: tuple[str, int] | None = None, files: int | None = None) -> DataFrame:
    """``df`` written as parquet to a new folder of the shared folder, and read again.

    With ``bucketed`` (column, buckets) the files are bucketed, so a join on the column does not
    shuffle them; the catalog entry that this takes is dropped again, the files stay. With ``files`` there are at most
    as many. Shuffle files of the write are released when it ends, so they do not add up over
    stages.
    """
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/trailmark-{name}-{tag}"
    entry = f"trailmark_{name}_{tag}" if bucketed else None
    for owner in _owners.get():
        owner.tables[path] = None
    with _while_writing(spark):
        if bucketed:
            column, buckets = bucketed
            df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(entry)
        else:
            df.write.parquet(path)
    if bucketed:
        out = spark.table(entry)
        spark.sql(f"DROP TABLE {entry}")  # an external table: only its entry goes
    else:
        out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(texts: DataFrame, least: int = 512, bytes_each: int = 1 << 26) -> int:
    """Hash buckets for digits or seeds of all texts: by the size of the texts, so that a bucket
    fits in a task at any scale, and the same however many partitions they come in."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(least, -(-total // bytes_each))


AMONG_BITS = 27


def among(rows: DataFrame, ids: DataFrame, max_bits: int = AMONG_BITS) -> DataFrame:
    """``rows`` (doc_id and others) whose id may be among those of ``ids`` (one long column, stored).

    The ids reach the tasks as a bitmap of hashes, at most ``2**max_bits`` bits whatever their number, so rows
    that a join would drop are not shuffled for it. A few others pass; the join follows.
    """
    import numpy as np
    import pyarrow as pa

    from trailmark.llm.textbytes import mix

    spark = rows.sparkSession
    bits = min(max((16 * ids.count()).bit_length(), 10), max_bits)
    mask = np.uint64((1 << bits) - 1)

    def places(column) -> np.ndarray:
        return mix(column.to_numpy().view(np.uint64)) & mask

    def set_bits(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).drop_null()))
            if len(at):
                word, begin = np.unique(at >> np.uint64(6), return_index=True)
                held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(held.view(np.int64))], names=["word", "held"])

    table = ids.mapInArrow(set_bits, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[table.column("word").to_numpy()] = table.column("held").to_numpy().view(np.uint64)
    shipped = spark.sparkContext.broadcast(words)
    at = rows.columns.index("doc_id")

    def keep(batches):
        for batch in batches:
            column = batch.column(at)
            place = places(column.fill_null(0))
            found = (shipped.value[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(found & column.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(keep, rows.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50, files: int | None = None) -> DataFrame:
    """Connected components by repeated contraction: ``(node, root)`` for every node of an edge;
    ``root`` is the least node of its component.

    Every round points each node to the least of its neighbours and itself, then follows the
    pointers once; edges are rewritten to the pointed-to nodes and those within one node dropped.
    All of it is aggregation and joins on node ids, which partial aggregation and skew joins
    spread even when one node has a third of all edges. Rounds grow with the logarithm of the
    longest path. Raises if ``max_rounds`` do not suffice (no partial result is returned). Tables of few rows are written
    to few files, not to one for each shuffle partition, the first of links to at most ``files``.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    jumps: list[DataFrame] = []
    before: list[DataFrame] = []
    links = stored(links.where("a <> b").distinct(), "links", files=files)
    for _ in range(max_rounds):
        left_over = links.count()
        files = files_for(spark, 2 * left_over)
        if not before:
            most_files = files
        if not left_over:
            pointer = nodes.select("node", F.col("node").alias("root"))
            for jump in jumps:
                pointer = pointer.join(jump, pointer["root"] == jump["x"], "left").select(
                    "node", F.coalesce("to", "root").alias("root"))
            out = stored(pointer, "components", files=most_files)
            discard(*jumps, *before, links)
            return out
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("x"), F.least("a", "m").alias("to"))
        # follow the pointer of the pointed-to node once: x -> to -> to'
        hop = least.select(F.col("x").alias("y"), F.col("to").alias("to2"))
        jumps.append(stored(least.join(hop, least["to"] == hop["y"], "left").select(
            "x", F.coalesce("to2", "to").alias("to")), "jump", files=files))
        before.append(links)
        left, right = (jumps[-1].select(F.col("x").alias(f"{s}x"), F.col("to").alias(f"{s}to")) for s in "ab")
        links = stored(links.join(left, links["a"] == left["ax"]).join(right, links["b"] == right["bx"])
                       .select(F.col("ato").alias("a"), F.col("bto").alias("b")).where("a <> b").distinct(), "links", files=files)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
