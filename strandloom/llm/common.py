"""What the document operators share: inputs, shared storage and streaming over Arrow batches."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, /tmp/checkpoints for a local master, and an error for a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not f"{spark.conf.get('spark.master', '')}[".startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "file:///tmp/checkpoints"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"__{w}{i}" for i in range(len(taken) + 1)) if n not in taken) for w in wanted]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing.

    An empty df keeps its schema, as that is given to the reader.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/strandloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table that stored() made and that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run and that nothing refers to; it notices at a collection of garbage only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow without a barrier; step must be a function of an importable module or a partial of one, so that workers keep its caches."""
    return df.mapInArrow(step, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text", size: int = 256) -> Iterator[tuple[int, list]]:
    """The texts of a batch in slices of a few hundred, so that Python strings of a whole batch never stand in memory at once."""
    column = batch.column(name)
    for at in range(0, batch.num_rows, size):
        yield at, column.slice(at, size).to_pylist()


def words_column(text) -> F.Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as an array; null: an empty array."""
    spaces = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaces, " "), "")


def cached(load: Callable) -> Callable:
    """One value per argument and process: workers that serve many tasks load a model once."""
    return functools.lru_cache(maxsize=4)(load)
