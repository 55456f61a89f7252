"""Written tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster the
    setting must be there, as a machine's own folder can't be seen by other machines.
    """
    root = spark.conf.get(_KEY, None)
    if not root:
        root = getattr(spark, "_foliomill_scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="foliomill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark._foliomill_scratch = root
    return f"{root.rstrip('/')}/foliomill/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliomill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_foliomill_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is one file scan, with nothing but projections and filters over it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def numbered(df: DataFrame) -> DataFrame:
    """``_row`` (a struct of all columns of ``df``), ``_file`` and ``_at``, which tell any two rows apart.

    Rows of a Parquet scan are named by a hash of their file and by their place in it, so they
    have the same names in each plan that reads them; any other DataFrame is written first.
    """
    table = df if _is_scan(df) else materialize(df)
    place = table.metadataColumn("_metadata")
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    return table.select(row.alias("_row"), F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_at"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of the rows of :func:`numbered` whose names aren't in ``gone`` (_file, _at)."""
    return rows.join(gone, ["_file", "_at"], "left_anti").select("_row.*")
