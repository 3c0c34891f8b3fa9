"""What the training-data operators share: tables, saved intermediate results, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word pattern of the contracts has it: blank, tab, line feed to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, an own one if all run on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="vectide-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder: later reads neither repeat the work nor need lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vectide-{uuid.uuid4().hex}"
    if _recorded is not None:
        _recorded.append(path)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table behind a DataFrame that came from saved; others stay."""
    if path := getattr(df, "_saved_at", None):
        _remove(df.sparkSession, path)


_recorded: list[str] | None = None
_left: list[str] = []


@contextlib.contextmanager
def step(docs: DataFrame) -> Iterator[None]:
    """One stage of a pipeline whose result is written before the next stage begins: what its body saves for itself
    is removed when the next stage begins, unless that stage's docs still read it."""
    global _recorded
    if _left:
        read = {part for f in docs.inputFiles() for part in f.split("/")}
        for path in [p for p in _left if p.rsplit("/", 1)[1] not in read]:
            _remove(docs.sparkSession, path)
            _left.remove(path)
    _recorded = []
    try:
        yield
    finally:
        _left.extend(_recorded)
        _recorded = None


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is a scratch one
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that a saved table has replaced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give a Python worker's free memory back: idle workers stay alive beside the executor."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: list[dict] = []


def kept_between_tasks() -> dict:
    """A dict for what an operator's tasks leave in a Python worker for the next ones."""
    _kept.append({})
    return _kept[-1]


def only(own: dict | None = None) -> None:
    """As a task begins: let go of what tasks of other operators have left, as one worker serves all stages in turn."""
    others = [x for x in _kept if x is not own and x]
    for x in others:
        x.clear()
    if others:
        tidy()


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def words_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
