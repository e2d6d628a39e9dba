"""Session construction and cluster-wide settings.

The engine never sets cluster paths on a session that already has them: the
checkpoint directory is read from ``spark.checkpoint.dir`` and only filled in
(under the system temp folder) for local test sessions where it is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on.  UTC makes epoch <-> timestamp conversion
# engine-independent; AQE re-plans joins from runtime sizes, splits skewed
# partitions and coalesces small ones.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "bandcast", extra: dict | None = None) -> SparkSession:
    """Return a session configured for the engine.

    On a cluster ``master`` stays None and the launcher's settings win; for
    tests pass ``master="local[8]"``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("BANDCAST_DRIVER_MEM", "16g"))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``bandcast`` importable in the Python workers (pandas UDFs and
    ``applyInPandas`` functions are pickled by reference to this package).
    The package is zipped once per application on the driver and handed to
    ``SparkContext.addPyFile``, which serves it to every executor — the same
    as ``--py-files`` on spark-submit."""
    sc = _context(spark)
    app = sc.applicationId if sc is not None else f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="bandcast-pyfiles-"), "bandcast.zip")   # driver-side source only
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)                  # Spark Connect equivalent
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local tests)
    do we create one, so lineage-cutting never lands on a machine-local path
    on a real cluster.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = _context(spark)
        if sc is None or not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="bandcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = _context(spark)
    if sc is not None:                 # Spark Connect: the server reads spark.checkpoint.dir
        sc.setCheckpointDir(d)
    return d


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
