"""Session defaults."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """Adaptive execution on, UTC, null-free settings that results do not depend on."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"} | more
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def materialise(frame: DataFrame) -> DataFrame:
    """Store a frame that several branches read in the shared checkpoint folder, so that none computes it again. The folder is that of
    spark.checkpoint.dir; one is set here only where there is none, as in tests."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder; a cluster without one is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessel-"))
    return context.getCheckpointDir()


class Rounds:
    """Tables of a loop: each frame kept replaces that of the round before. Unlike a checkpoint, a table read again carries no constraints of
    the plan that made it, which would pile up on the driver from round to round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def keep(self, frame: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{shared_folder(self.spark)}/round-{uuid.uuid4().hex}"
        frame.write.parquet(self.path)
        if before:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return self.spark.read.schema(frame.schema).parquet(self.path)
