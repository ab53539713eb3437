"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


#: Rows of a small batch.
BATCH_ROWS = 1 << 10


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of Spark (with _ for each dot) for what is run inside."""
    names = {name.replace("_", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Characters of a query's plan that the driver keeps as text, for each of the last thousand queries and each change of a running one.
PLAN_TEXT = 1 << 12


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """What is run inside removes its shuffle files when it ends, not when the driver happens to collect its garbage, and the texts of its plans are short."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_ui_explainMode="simple",
                    spark_sql_maxPlanStringLength=str(PLAN_TEXT))


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Texts go to Python in batches of few rows inside, as the JVM and Python each hold a batch whole."""
    return settings(spark, spark_sql_execution_arrow_maxRecordsPerBatch=str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared checkpoint folder, with its lineage cut and its shuffle files removed."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint()


def counted(df: DataFrame) -> int:
    """``df.count()``, with its shuffle files removed."""
    with shuffles_freed(df.sparkSession):
        return df.count()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared checkpoint folder in columns, as most of its numbers are small; its shuffle files are removed."""
    ensure_checkpoint_dir(df.sparkSession)
    name = f"table-{unique_name()}"
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(folder)
    _STORED.add(name)
    return df.sparkSession.read.parquet(folder)


#: Names of the folders that ``stored`` has written and that are still there.
_STORED: set[str] = set()


def removed(*used: DataFrame) -> None:
    """Remove the tables of ``stored`` that ``used`` read; what is made of them has been written by now. Other inputs stay."""
    folders = {m[0] for df in used for x in df.inputFiles() if (m := re.match(r".*/(table-[0-9a-f]{32})(?=/)", x)) and m[1] in _STORED}
    for folder in folders:
        context = used[0].sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.discard(folder.rsplit("/", 1)[1])


#: Rows that ``small`` tables have at most.
MAX_BROADCAST = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, worked out, to be broadcast in joins if it has ``MAX_BROADCAST`` rows at most; else joined as Spark sees fit."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df``, which joins never broadcast: Spark takes rows that an explode or Python makes for as few as they are made of."""
    return df.hint("merge")


def like_string(column: str | Column) -> Column:
    """A column as string with null as the empty string."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def fields(**kinds: str) -> T.StructType:
    """A schema from name=ddl pairs, in order."""
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in kinds.items()))


#: What this Python process has made for its tasks, by name; a few of the last.
_MADE: dict[str, object] = {}


def made_once(name: str, make: Callable[[], object], kind: str = "") -> object:
    """``make()``, kept for later tasks of the same Python worker; names are unique for each use (see ``unique_name``).

    Of large objects, whose names begin with a ``kind``, a worker keeps only the last.
    """
    if name not in _MADE:
        forget(kind)
        while len(_MADE) >= 3:
            _MADE.pop(next(iter(_MADE)))
        _MADE[name] = make()
    return _MADE[name]


def forget(kind: str) -> None:
    """Let go of what this Python worker has made of a ``kind``."""
    for name in [x for x in _MADE if kind and x.startswith(kind)]:
        _MADE.pop(name)


def unique_name() -> str:
    return uuid.uuid4().hex
