"""Shared pieces: written tables that cut lineage, row ids, connected components."""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    On one machine, where the session names none, it is a folder of our own; a
    cluster must name one, because its executors don't share the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="taskloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts the lineage as ``checkpoint()`` does, survives lost executors, keeps
    only the columns a reader needs and is compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing will read again."""
    spark = table.sparkSession
    own = f"{shared_dir(spark)}/taskloom-"
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if own.removeprefix("file:").lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dense_runs(values: DataFrame, size: int) -> DataFrame:
    """(run, cells): the longs ``value`` of ``values`` at their places ``at`` (0 to size - 1), 0 elsewhere, in runs of 1024; those at one place by their bits."""
    run = F.shiftright("at", 10).alias("run")
    none = values.sparkSession.range(size).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("value"))
    # Dealt by runs, the values of a place and the places of a run are gathered where they are.
    cells = values.select(F.col("at").cast("int").alias("at"), F.col("value").cast("long").alias("value")).union(none).select(run, "at", "value").repartition("run")
    cells = cells.groupBy("run", "at").agg(F.bit_or("value").alias("value"))
    runs = cells.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    return runs.select("run", F.transform("cells", lambda c: c["value"]).alias("cells"))


def dense_array(values: DataFrame, size: int) -> Column:
    """The cells of ``dense_runs`` as one array.

    The array is a scalar subquery, so a task gets it once; ``size`` is its bound.
    """
    runs = dense_runs(values, size)
    return runs.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "cells"))), lambda r: r["cells"])).alias("values")).scalar()


#: Longs of a key filter: 8 MB at most, whatever the number of keys.
FILTER_WORDS = 1 << 20


def key_filter(keys: DataFrame, *columns: str) -> Column:
    """Whether a row's columns may be among ``keys``: never false for one that is, seldom true for one that isn't.

    One bit a key, in a bitmap that has 32 bits or more for each key until it is
    ``FILTER_WORDS`` longs large; beyond that it lets more rows pass.
    """
    wanted, size = keys.count(), 1 << 10
    while size * 2 < wanted and size < FILTER_WORDS:
        size *= 2
    h = F.xxhash64(*columns)
    at, bit = h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 40).bitwiseAND(63).cast("int")
    set_ = keys.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("value"))
    word = F.get(dense_array(set_, size), at.cast("int"))
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(1) == 1


def _file_salt(paths: list[str]) -> str:
    """What to append to the paths so that 31 bits of their hashes tell them apart."""
    plain = {p.replace("file:///", "file:/") for p in paths}
    for k in range(1000):
        if len({xxhash.xxh64_intdigest((p + f"#{k}").encode(), 42) & 0x7FFFFFFF for p in plain}) == len(plain):
            return f"#{k}"
    raise RuntimeError(f"{len(plain)} files cannot be told apart by 31 bits")


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Adds a row number that is the same each time the same Parquet files are read.

    It is made of a hash of the file's path and the row's place in the file, so
    it does not depend on how many cores there are or how files are split. Two
    rows with equal values, or with a null key, stay two rows. Columns and rows
    may have been left out since the read. Any other frame has no such places
    and is refused: write it first.
    """
    paths = df.inputFiles()
    try:
        place = df.metadataColumn("_metadata")
        file = F.xxhash64(F.concat(place["file_path"], F.lit(_file_salt(paths)))).bitwiseAND(0x7FFFFFFF)
        return df.withColumn(name, F.shiftleft(file, 32) + place["row_index"])
    except AnalysisException as e:
        raise ValueError("the rows of this frame have no places in Parquet files: write it and read it back first") from e


def kept_rows(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose row number is among ``ids`` (``left_semi``), or is not (``left_anti``), with all their columns."""
    return with_row_id(docs.select(F.struct("*").alias("row"))).join(ids.select("_rid"), "_rid", how).select("row.*")


def _least_neighbour(e: DataFrame, both_ways: bool) -> DataFrame:
    """(n, o, least): each edge seen from ``n``, with the least of n and its neighbours."""
    if both_ways:
        seen = e.select(F.col("hi").alias("n"), F.col("lo").alias("o")).union(e.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
    else:
        seen = e.select(F.col("hi").alias("n"), F.col("lo").alias("o"))
    least = seen.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("least"))
    return seen.join(least, "n")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges``; component is the least id reachable.

    Alternating large-star and small-star rounds: only minima per node are
    gathered, never the neighbours of one node. Edges with a null end and loops
    carry no link; without links the result has no rows.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .distinct()
    )
    e = stored(e)
    seen = None
    for _ in range(most_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        large = _least_neighbour(e, True).where("o > n").select(F.col("least").alias("lo"), F.col("o").alias("hi")).where("lo != hi").distinct()
        small = _least_neighbour(large, False)
        small = small.select(F.col("least").alias("lo"), F.col("o").alias("hi")).union(small.select(F.col("least").alias("lo"), F.col("n").alias("hi")))
        e = stored(small.where("lo != hi").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
