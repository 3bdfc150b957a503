"""Session, table and staging helpers shared by every operator."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vektrail")
    for key, value in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint directory exists and the master is
    local a temporary folder is made; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vektrail-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path objects of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Create a small file; with ``overwrite`` off an existing one is an error."""
    fs, target = filesystem(spark, path)
    out = fs.create(target, overwrite)
    out.write(bytearray(data))
    out.close()


def publish_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make a small file whole or not at all; False if it exists. The rename refuses to replace a file, so of two writers one wins."""
    folder, name = path.rsplit("/", 1)
    temp = f"{folder}/.{name}-{uuid.uuid4().hex}"
    write_bytes(spark, temp, data, overwrite=False)
    fs, source = filesystem(spark, temp)
    _, target = filesystem(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(source, target, options)
        return True
    except Exception:
        fs.delete(source, False)
        if fs.exists(target):
            return False
        raise


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published files of a folder, ascending."""
    fs, path = filesystem(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit())


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the gateway may be gone already
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it.

    The archive is made in memory and lies in the shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_vektrail_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    path = f"{shared_dir(spark)}/vektrail/code-{uuid.uuid4().hex}/vektrail.zip"
    write_bytes(spark, path, packed.getvalue())
    context.addPyFile(path)
    atexit.register(_drop_at_exit, spark, path)
    context._vektrail_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    The files are replicated by the shared file system, so a lost executor loses
    nothing. They are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vektrail/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)
