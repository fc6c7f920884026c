"""Reading the given tables and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caudal.session import checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; no two calls give the same."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/llm/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again. The plan before it runs once, a lost executor costs a
    re-read, and values that depend on the run (row numbers) are fixed from here on."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Spark drops the shuffle files of finished jobs when the driver's JVM collects what refers to them, which is asked for here."""
    df.sparkSession._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Gives the disk of settled tables back, and that of shuffles. Only for tables that nothing reads any more: what was made from
    them is settled too."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(conf).delete(folder, True)
    release(tables[0])


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """A distinct number for each row, so that repeated rows can be told apart. Settle the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def held_out(column: str, modulus: int) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 1, F.lit(False))


def doc_and(inside: DataFrame, fields: str) -> StructType:
    """Schema of the column `doc` of `inside`, followed by `fields`."""
    return StructType([inside.schema["doc"], *StructType.fromDDL(fields).fields])
