"""Shared folders, table access and small column helpers of the operators."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of all word rules here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark, what: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, set here only where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="logweir-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch: documents are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; its session sends at most BATCH_ROWS rows or about BATCH_BYTES to Python at a time, unless it is set to fewer."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, most)
    return df


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and survives lost executors."""
    folder = shared_folder(df.sparkSession, what)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() that no later read needs."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null, in compiled expressions."""
    flat = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    return F.coalesce(F.length(F.regexp_replace(flat, " *[^ ]+", "x")), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, y): a bounded sample, the same on reruns, of labels that may be learnt from.

    Null or other labels than 0 and 1 are left out; a doc_id labelled twice counts by its larger label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
