"""Session plumbing shared by the training-data operators: shared scratch tables and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches go by bytes as well as by rows, so that long texts do not make a batch as large as they are many.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Most files (a path and a number each) whose numbers are broadcast; beyond it a table with keys is written.
BROADCAST_FILES = 50_000
_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, wherever the driver found it. Once per context."""
    sc = spark.sparkContext
    if not spark.conf.get(BATCH).rstrip("b").isdigit() or int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))  # what a task holds of its input on either side
    if getattr(sc, "_loomstone_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="loomstone-"), "loomstone_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(out)
    sc._loomstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's. Only where driver and executors are one
    process may both be unset: then a folder of this machine is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loomstone-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomstone/{sc.applicationId}"


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


#: What marks a column that keyed() made, as against one of the input that only has its name.
KEYED = {"loomstone_row_key": True}


def is_keyed(df: DataFrame, key: str = "row_key") -> bool:
    return key in df.columns and bool(df.schema[key].metadata.get("loomstone_row_key"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, key: str = "row_key") -> DataFrame:
    """df with a column `key` (long, unique), the same at every reading and on every executor; a column of that name is replaced
    (free_name() gives one that is none).

    Rows of a Parquet table have a key already: their file and their place in it. Anything else is written as a table first."""
    spark = df.sparkSession
    if key not in df.columns and type_of(df) == "LogicalRelation":
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        names = sorted(r[0] for r in placed.select("_file").distinct().limit(BROADCAST_FILES + 1).collect())
        if 0 < len(names) <= BROADCAST_FILES and not {"_file", "_row", "_nth"} & set(df.columns):
            numbers = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_file string, _nth long"))
            return placed.join(numbers, "_file").select(*df.columns, F.shiftleft("_nth", 36).bitwiseOR(F.col("_row")).alias(key, metadata=KEYED))
    return write_table(df.withColumn(key, F.monotonically_increasing_id().alias(key, metadata=KEYED)))[0]


def type_of(df: DataFrame) -> str:
    """What df's analysed plan is at its top: LogicalRelation for a Parquet table as it was read."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() if plan.toString().strip().endswith("parquet") else ""


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that write_table() made and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key with more than 1 / HOT_SHARE of all rows (and HOT_ROWS) is hot: there are HOT_SHARE of them at most, so they can be broadcast.
HOT_SHARE, HOT_ROWS = 20_000, 1000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """The keys of counts (key, n; one row a key, sums of n at most total) that spread_join() deals over several tasks, with the
    number of these, as a broadcast table of HOT_SHARE rows at most; None where no key is hot."""
    most = max(HOT_ROWS, total // HOT_SHARE)
    if total <= most:
        return None
    hot, _ = write_table(counts.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("long").alias("_tasks")))
    return None if hot.isEmpty() else F.broadcast(hot)


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """many joined with one, which has one row a key at most. Rows of a hot key are dealt over several tasks by the column `by`,
    and its row of one goes to each of them."""
    if hot is None:
        return many.join(one, key)
    left = many.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_tasks")), F.lit(0).cast("long"))).drop("_tasks")
    last = F.coalesce("_tasks", F.lit(1).cast("long")) - 1
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_tasks")
    return left.join(right, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (id, component) with component = the smallest id reachable.

    Alternates large-star and small-star steps (each a grouped minimum and one equi-join), which converge in few rounds
    on any shape of graph. Every round is written to the shared folder, so no lineage grows and no labels reach the
    driver. Ids without an edge to another id are absent from the result; null ids are ignored.
    """
    spark = edges.sparkSession
    cur = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    cur, path = write_table(cur)
    seen, n_edges = None, cur.count()
    while True:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The centre of a large star has as many rows as the star.
        hot = hot_keys(both.groupBy("u").agg(F.count("*").alias("n")), "u", "n", 2 * n_edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, "u", hot, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low2.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        nxt, npath = write_table(small)
        # A fixed point is a set of stars: each id has one parent and no parent has a parent.
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, path)
        cur, path = nxt, npath
        if tuple(state) == seen:
            break
        seen, n_edges = tuple(state), state[0]
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
