"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of every word count and shingle: space and \x09-\x0D.  ``bytes.split()`` cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset: the warehouse, or, if driver and executors are one process as in tests, a folder that goes with
    it.  A warehouse on the driver's own disk is refused, for executors elsewhere would write to theirs.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        found = spark.conf.get("spark.sql.warehouse.dir")
        if found.startswith("file:") or "://" not in found:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return found
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkclade-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


_scope: ContextVar = ContextVar("sparkclade_scope", default=None)


class Scope:
    """A folder of intermediate tables, deleted whole by ``close``."""

    def __init__(self, spark: SparkSession):
        self.folder = f"{shared_dir(spark).rstrip('/')}/sparkclade-{uuid.uuid4().hex}"
        self.path, self.conf, self.before = spark._jvm.org.apache.hadoop.fs.Path(self.folder), spark._jsc.hadoopConfiguration(), _scope.get()

    @contextmanager
    def outer(self) -> Iterator[None]:
        """Within the block, tables go to where they went before this scope, and so outlast it."""
        token = _scope.set(self.before)
        try:
            yield
        finally:
            _scope.reset(token)

    def close(self) -> None:
        self.path.getFileSystem(self.conf).delete(self.path, True)


#: By application: the scope of whatever is called outside a block, which goes when the process ends.
_application: dict[str, Scope] = {}


def current_scope(spark: SparkSession) -> Scope:
    if found := _scope.get():
        return found
    key = spark.sparkContext.applicationId
    if key not in _application:
        found = _application[key] = Scope(spark)
        atexit.register(close_quietly, found)
    return _application[key]


def close_quietly(scope: Scope) -> None:
    """At exit the JVM may be gone already."""
    try:
        scope.close()
    except Exception:
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Within the block, intermediate tables go to a folder of its own, deleted when the block ends.

    So a result of the operators is to be written, or read out, inside of it.  Tables of other blocks, and those of
    operators called outside of any, which last as long as the process, are never touched.
    """
    own = Scope(spark)
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        own.close()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the scope's folder and read back: the lineage ends there, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{current_scope(spark).folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._sparkclade_folder = path
    return found


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables of frames that ``stored`` returned and nothing will read again."""
    for df in frames:
        delete(spark, df._sparkclade_folder)


#: By application: the scope of the stage called last on its own.
_staged: dict[str, Scope] = {}


def stage(f: Callable) -> Callable:
    """A stage of a pipeline.

    Inside a ``scope`` its tables belong to that.  Called outside of any, it has a scope of its own, which goes when the
    next stage is called so: its result is to be written by then, for that is what the next stage reads.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _scope.get():
            return f(spark, docs, sf_dir)
        key = spark.sparkContext.applicationId
        if earlier := _staged.pop(key, None):
            earlier.close()
        _staged[key] = Scope(spark)
        atexit.register(close_quietly, _staged[key])
        token = _scope.set(_staged[key])
        try:
            return f(spark, docs, sf_dir)
        finally:
            _scope.reset(token)

    return run


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened as far as columns of a table have them already, in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, columns: list[str], f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that clashing extra columns never reach Python."""
    return df.select(*columns).mapInArrow(f, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of ``rows``, so that few texts at a time are Python objects; Arrow's free memory goes back at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
