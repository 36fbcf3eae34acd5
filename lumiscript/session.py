"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(app: str = "lumiscript", **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow; whatever the caller or the cluster sets wins."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once for each context; they need not share the driver's path.

    Spark serves the archive to the executors as it does any Python file.
    """
    import atexit
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_lumiscript_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lumiscript-")) / "lumiscript.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    sc._lumiscript_shipped = True
