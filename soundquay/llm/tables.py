"""Input tables and working tables shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soundquay.sources.stage import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Staged:
    """Intermediate tables of one operator call, as Parquet below the shared checkpoint folder.

    A staged table cuts the lineage: a task that is repeated after the loss of an executor reads
    the files again. ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_folder(spark, name)
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made}-{name}"

    def put(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.put(df, name)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def settle(self) -> None:
        """Let Spark delete the shuffle files of steps that are done and written.

        It does so when the driver's garbage is collected, which may take long on a quiet driver.
        """
        self.spark._jvm.System.gc()
