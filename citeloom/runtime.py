"""Session-level plumbing: table access, lineage cutting, and skew-aware lookups.

Nothing here decides semantics.  Intermediate tables are parquet files below the folder named by
``spark.checkpoint.dir`` (shared by all executors on a cluster); only where that setting is absent,
as in tests, a private folder is made and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than ``1 / HOT_SHARE`` of the rows (and at least HOT_ROWS), so
#: at most HOT_SHARE keys can be hot: the proven bound of every broadcast made for hot keys.
HOT_SHARE = 1000
HOT_ROWS = 10_000

_tables: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="citeloom-code-")) / "citeloom.zip"  # read by the driver only, which serves it
    atexit.register(shutil.rmtree, target.parent, True)
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Shuffle files go when the query that wrote them ends, instead of when the driver collects its garbage; generated
#: methods that are too long for the JVM's compiler (8000 bytes) are split.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def sparing(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """Queries run inside have the settings SPARING; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in SPARING} if on else {}
    for k in before:
        spark.conf.set(k, SPARING[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "step", spare: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files survive the loss of any executor, are compressed, and give the planner true sizes.  ``spare`` is
    for large steps, see SPARING.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/citeloom-{label}-{uuid.uuid4().hex}"
    with sparing(spark, spare):
        df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """``df`` as it is; the files below ``path``, which it reads, are deleted at exit."""
    _tables.append((spark, path))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores before costly work on small rows; a fixed number of partitions is not merged
    by the adaptive planner, which looks at bytes only."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def drop(*frames: DataFrame | None) -> None:
    """Delete the files of tables made by :func:`cut` that no later plan reads."""
    for df in frames:
        if df is not None:
            _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if "/citeloom-" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                _delete(spark, {path})
        except Exception:  # the JVM may be gone already
            return


def lookup(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join of ``left`` with ``right``, which holds one row per ``key`` and a column ``n_rows``
    giving the number of ``left`` rows of that key.

    Hot keys (see HOT_SHARE) are joined by broadcast, so a key with a third of all rows never lands
    in one task; the others shuffle.  Nothing is dropped.
    """
    total = right.agg(F.sum("n_rows")).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = right.filter(F.col("n_rows") > bound)
    if right.limit(1).count() == 0 or hot.limit(1).count() == 0:
        return left.join(right, key)
    keys = F.broadcast(hot.select(*([key] if isinstance(key, str) else key)))
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(keys, key, "left_anti").join(right.filter(F.col("n_rows") <= bound), key)
    )
