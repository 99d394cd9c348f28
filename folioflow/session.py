"""Making the package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Add the package to the context once, unless the workers' path holds it already (an installation or PYTHONPATH)."""
    context = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_folioflow_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="folioflow-zip-"))
    with zipfile.ZipFile(folder / "folioflow.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(str(folder / "folioflow.zip"))
    context._folioflow_shipped = True
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Unset is only accepted on a local master (tests), where a folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="folioflow-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Input below this size for each core is spread over the cores before work that is heavy for its size.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its input is small, by the optimizer's size of it. Large input has tasks enough and is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SMALL_BYTES else df
