"""What the operators share on the driver's side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded by bytes, for very long texts; each is held by the JVM, outside its heap, and by Python, which works
#: on parts of about so many bytes.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, whatever the rows' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Where a shared folder is local, Hadoop starts a `chmod` for each file and each task's folder; while it does, the executor's memory
#: is counted twice.  Raw files come without checksum files, which are files more; other file systems don't read this.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Files of a table that is written to few: for each core, and at least.
FILES_A_CORE, LEAST_FILES = 4, 32

#: Spark then removes what an execution has shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).  Only on one machine, as in tests, is one
    made up where that setting is missing."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def in_few_tasks(df: DataFrame) -> DataFrame:
    """df's partitions worked off one after the other by some tasks a core, so that whoever writes it makes few files."""
    return df.coalesce(max(LEAST_FILES, FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism))


def kept(df: DataFrame, few: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage.

    few: the last step's partitions are worked off one after the other by some tasks a core, each of which writes one file
    without checksums, so that the number of files doesn't grow with the input.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = in_few_tasks(df).write.options(**RAW_FILES) if few else df.write
        out.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote and that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Stands for a null doc_id; it sorts first.
LEAST = -(1 << 63)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """Rows (doc, th, text), with the columns `keep`, that (doc, th) identifies, and whether doc alone does.

    th is 0 if all ids differ, else a hash of the text.  Rows that agree in id and text
    thus are one document.  Nothing hangs on the order or partitions of a scan, which may
    change when executors are lost.
    """
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST))
    unique = docs.select(ids.alias("doc")).groupBy("doc").count().where("count > 1").isEmpty()
    th = F.lit(0).cast("long") if unique else F.coalesce(F.xxhash64(F.col(text)), F.lit(0))
    return docs.select(ids.alias("doc"), th.alias("th"), F.col(text).alias("text"), *keep), unique


def doc_ids(column="doc"):
    """The ids as they were: LEAST is null again."""
    return F.when(F.col(column) != LEAST, F.col(column))
