"""Session settings and the shared folder for written intermediates."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dirs: dict[str, str] = {}  # by application, for local masters only
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(cpus: int = 8, app: str = "shelfwise", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, as the cluster names it.

    A machine-local folder stands in only on a local master, where one machine
    is all there is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="shelfwise-")
        named = _local_dirs[context.applicationId]
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or the scratch folder in use, that nothing has used before."""
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """What is written to new paths inside is removed at the end; nothing may be read from it afterwards."""
    folder = new_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that nothing computes it again.

    A written table and not ``checkpoint()``, which computes its input twice.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, schema: T.StructType | str, rows) -> DataFrame:
    """A table of constants, planned as a LocalTableScan."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {name: [row[i] for row in rows] for i, name in enumerate(schema.names)}
    df = spark.createDataFrame(pa.table(columns))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def spread(df: DataFrame) -> DataFrame:
    """A plain scan over all cores, if it has fewer partitions than there are cores.

    For heavy work per row on a small file. A large input keeps its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
