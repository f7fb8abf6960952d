"""CSV output of the dashboard views, with a manifest."""

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.model import Model, Rules
from tidemark.operators.views import VIEWS, build_view


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write ``df`` as CSV with a header, replacing ``path``, and return the path.

    ``single_file`` is for results as small as the dashboard views, with one row per month
    and segment: the rows are computed in parallel, and only the result is gathered.
    """
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_export(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read an exported CSV back with the columns and types of ``like``."""
    return spark.read.schema(like.schema).option("header", True).option("mode", "FAILFAST").csv(path)


def _size_kb(spark: SparkSession, path: str) -> float:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return round(files.getContentSummary(location).getLength() / 1024, 1)


def export_counted(df: DataFrame, path: str) -> int:
    """:func:`export_csv` to a single file; the rows are counted while they are written."""
    seen = Observation()
    export_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, single_file=True)
    return seen.get["rows"]


def export_views(
    model: Model, folder: str, rules: Rules = Rules(), names: Iterable[str] = VIEWS, at_once: int = 4
) -> DataFrame:
    """Export the named views below ``folder`` and return (and write) the manifest.

    Manifest columns: view_name, dashboard, rows, size_kb, primary_use, in the order of the names. ``at_once`` views are
    written at a time, as jobs of one fair pool (where the session's scheduler is fair), so that small ones fill the gaps of
    large ones. No view is computed twice and no file is read back. If one fails, its error is raised when the others are done.
    """
    spark, names = model.spark, list(names)

    def write(name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "export")
        view, path = VIEWS[name], f"{folder}/{name}.csv"
        rows = export_counted(build_view(name, model, rules), path)
        return name, view.dashboard, rows, _size_kb(spark, path), view.primary_use

    with ThreadPoolExecutor(at_once) as pool:
        entries = list(pool.map(inheritable_thread_target(spark)(write), names))
    manifest = spark.createDataFrame(
        entries,
        "view_name string, dashboard string, rows bigint, size_kb double, primary_use string",
    )
    export_csv(manifest, f"{folder}/manifest.csv", single_file=True)
    return manifest
