"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: White space that may surround an id; fixed values.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2003\u3000\ufeff"

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local master gets a temporary folder of its own where none is
    named: on a cluster such a folder would not be visible to every executor.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores, for heavy work per row on a small input; large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them back.

    Unlike an executor-local copy the table outlives any executor. Parquet is
    smaller than a serialised checkpoint and keeps column pruning.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing will read again."""
    path = getattr(df, "_codeloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the tables of materialise(), deleted with them at the end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/codeloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Bits of a key filter, 2 MB: the filter of millions of keys still drops most rows, that of more passes them all.
FILTER_BITS = 1 << 24


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """rows with `_maybe`: false for keys that are certainly not among the wanted keys, found before any row moves.

    The filter is one bit per hash, built where the keys are and merged in
    blocks of 4 KB: what is broadcast is at most bits / 8 bytes, whatever the
    number of keys. A null key is never wanted.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = wanted.where(wanted_key.isNotNull()).select(h(wanted_key).alias("h"))
    blocks = bit.groupBy(F.bitmap_bucket_number("h").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    at = rows.withColumn("_h", F.when(key.isNotNull(), h(key))).withColumn("_block", F.bitmap_bucket_number("_h")).withColumn("_at", F.bitmap_bit_position("_h"))
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, F.pmod(F.col("_at"), F.lit(8)).cast("int")) == 1
    return at.join(F.broadcast(blocks), "_block", "left").withColumn("_maybe", F.coalesce(on, F.lit(False))).drop("_h", "_block", "_at", "_bits")


def likely_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key may be among the wanted keys; an exact join has to follow."""
    return marked(rows, key, wanted, wanted_key).where("_maybe").drop("_maybe")


def without_keys(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows whose key is not in `gone` (a table with that column): only rows that the filter cannot clear are moved to be compared."""
    m = marked(rows, F.col(key), gone, gone[key])
    return m.where("not _maybe").unionByName(m.where("_maybe").join(gone.select(key), key, "left_anti")).drop("_maybe")


def skewed_join(rows: DataFrame, side: DataFrame, key: str, weight: str, by: list[str], pieces: int = 1000) -> DataFrame:
    """Inner join with a side of unique keys whose `weight` is the number of rows with that key, spread by those counts.

    A key that holds more than 1 / pieces of all rows is cut into as many
    parts as it has such shares; there are at most `pieces` keys like that, so
    they are broadcast to salt the rows, by a hash of the columns `by` so that
    a task that runs again puts each row where it was.
    """
    share = side.agg(F.greatest(F.ceil(F.sum(weight) / F.lit(pieces)), F.lit(1)).alias("_share"))  # one row
    cut = side.crossJoin(F.broadcast(share)).withColumn("_parts", F.greatest(F.floor(F.col(weight) / F.col("_share")), F.lit(1)).cast("int")).drop("_share")
    heavy = cut.where("_parts > 1").select(key, F.col("_parts").alias("_of"))
    salted = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of")
    return salted.join(cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"), [key, "_salt"]).drop("_salt")


def id_key(c: Column | str) -> Column:
    """An id as it is compared: letter case and surrounding blanks do not count."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def packed_key(c: Column | str) -> Column:
    """id_key as bytes: 64 hex digits shrink to 32 bytes; a leading tag keeps the two forms apart."""
    k = id_key(c)
    return F.when(k.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(k))).when(
        k.isNotNull(), F.concat(F.lit(b"\x00"), F.encode(k, "utf-8"))
    )


def unpacked_key(c: Column | str) -> Column:
    """The inverse of packed_key."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.substring(c, 2, 2147483646)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(F.decode(body, "utf-8"))
