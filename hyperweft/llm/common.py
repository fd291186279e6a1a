"""What the operators of this subpackage share: cutting lineage, word patterns, let-bindings, fixed-size counters."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

#: On a local file system, Hadoop starts a chmod for each folder, file and checksum file that it makes, each for a moment
#: a second process of the executor's whole size. Tables between steps have no checksum files (Parquet's pages have sums).
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Rows of a file of a table between steps whose number of rows is known, at least.
EACH = 25_000

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir. Where that is unset, a local run (a test) gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        top = sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="hyperweft-")
        sc.setCheckpointDir(top)
    folder = f"{top.rstrip('/')}/hyperweft-{sc.applicationId}"
    if folder not in _made:
        _made[folder] = spark
        atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    """The session's tables go when Python ends; a killed driver leaves them to the folder's retention."""
    spark = _made.pop(folder, None)
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone by now
        pass


def written(df: DataFrame, rows: int | None = None, each: int = EACH) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, outlives executors.

    rows: about how many there are or are worked on, if known; they then go into no more files than one for each `each`,
    so that a small table isn't one of many tiny files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(parts_for(rows, each))
    df.write.options(**PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, or name with a number, so that it is none of those taken, in any case."""
    held = {x.lower() for x in taken}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(held) + 1))) if x not in held)


def shielded(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with its columns named c0, c1, ..., so that added ones clash with none, and these columns under their old names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), evaluating value once: a one-element transform binds it."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null: word characters that follow a space or the start."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")


def parts_for(rows: int, each: int) -> int:
    """Number of partitions (or cells, shards) of about `each` rows."""
    return max(1, -(-rows // each))
