"""Sources and sinks: JSON lines, JSON documents, the embedding cache, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Splits whose sizes are broadcast, some 20 MB; more of them are joined by a shuffle.
MOST_SPLITS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that the cluster names in spark.checkpoint.dir; a temporary one where it names none (tests)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prefloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/prefloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str | None = None, lenient: bool = False) -> DataFrame:
    """JSON lines, or one JSON document with a list of rows, by the path's ending; blank lines are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST")
    reader = reader.schema(schema) if schema else reader
    return reader.option("multiLine", path.endswith(".json") and "*" not in path).json(path)


def _lines(spark: SparkSession, path: str, blank: bool) -> DataFrame:
    """(file, part, at, value) of text files: a row's split, and a number that grows by one from row to row within it."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    return (text if blank else text.where(F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())


def _numbered(rows: DataFrame, within: list[str]) -> DataFrame:
    """rows with `line`, from 1, in the order of files and of their bytes; `within` file or over all files.

    A split's rows keep their order in its partition, so a row's number follows from the rows of the splits before it, a
    table of one row a split, and its distance to the split's first row.  No row is seen by Python.
    """
    sizes = written(rows.groupBy("file", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "splits")
    before = sizes.select("file", "part", "first", (F.sum("n").over(Window.partitionBy(*within).orderBy("file", "part")) - F.col("n")).alias("before"))  # a row for each split
    if sizes.count() <= MOST_SPLITS:  # then no row of text is shuffled
        before = F.broadcast(before)
    return rows.join(before, ["file", "part"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: lines with their number in their file from 1, blank lines counted but left out."""
    return _numbered(_lines(spark, path, True), ["file"]).where(F.trim("value") != "").select("file", "line", "value")


def read_ingested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with `row_id`, their position from 0 over all files by name, blank lines left out; a line that is no JSON object is an error that names its position."""
    rows = _numbered(_lines(spark, path, False), []).select((F.col("line") - 1).alias("row_id"), "value")
    row = F.from_json("value", F.lit(schema))
    bad = F.try_parse_json("value").isNull()
    return rows.select("row_id", F.when(bad, F.raise_error(F.concat(F.lit(f"{path}: row "), F.col("row_id").cast("string"), F.lit(" is no JSON")))).otherwise(row).alias("row")).select("row_id", "row.*")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(line, row) with each line as a VARIANT; a line that is no JSON is an error that names the line."""
    lines = read_numbered(spark, path)
    v = F.try_parse_json("value")
    return lines.select("file", "line", F.when(v.isNull(), F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": no JSON")))).otherwise(v).alias("row"))


def write_rows(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless the output is there already."""
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(fs_path):
        return False
    df.write.parquet(path)
    return True


def as_document(df: DataFrame) -> DataFrame:
    """A one-row table as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_embeddings(df: DataFrame, path: str) -> None:
    """(model, text_id, embedding), a folder for each model."""
    df.write.mode("append").partitionBy("model").parquet(path)


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The model's embeddings; those of other models are not read, and no folder gives no rows."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], "text_id string, embedding array<float>, model string")
    return spark.read.parquet(path).where(F.col("model") == model)


def fingerprint(df: DataFrame, text: str) -> DataFrame:
    """One row: a hash of all texts that does not depend on their order, and their number; a cached bundle is valid if both agree."""
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.concat_ws(":", total(F.xxhash64(text)), total(F.xxhash64(F.lit("second"), text))).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def import_bundle(cache: DataFrame, bundle: DataFrame, texts: DataFrame, model: str) -> DataFrame:
    """cache with the rows of an old bundle (text, embedding, model, fingerprint, n) that it lacks; a bundle of another model or other texts adds none."""
    from ..functions.text import text_id

    valid = bundle.where(F.col("model") == model).join(F.broadcast(fingerprint(texts, "text")), ["fingerprint", "n"], "left_semi")  # one row
    rows = valid.select(text_id(F.col("text")).alias("text_id"), F.col("embedding").cast("array<float>").alias("embedding"), "model").dropDuplicates(["text_id"])
    return cache.unionByName(rows.join(cache.select("text_id", "model"), ["text_id", "model"], "left_anti"))


def ingest_slice(df: DataFrame, n: int | None, row_id: str = "row_id") -> DataFrame:
    """The first n rows by their position at ingest, or all."""
    return df if n is None else df.where(F.col(row_id) < n)


def read_arrays(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(name, row, vector) of the arrays in .npz or .npy files (an .npy's array is `array`); an array that lacks is an error that names it."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                arrays = {k: got[k] for k in got.files} if hasattr(got, "files") else {"array": got}
                if lacking := sorted(set(required) - set(arrays)):
                    raise ValueError(f"{where} lacks {', '.join(lacking)}")
                for name in sorted(arrays):
                    rows = np.atleast_2d(np.asarray(arrays[name], float))
                    for at in range(0, len(rows), 1024):
                        part = rows[at : at + 1024]
                        yield pd.DataFrame({"name": name, "row": range(at, at + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "name string, row long, vector array<double>")


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace a Parquet table by change(table): the new one is written beside it, then the old one becomes path.bak.

    Where a crash between the two renames has left only path.bak, that is the table: it is put back first.
    """
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    new, old, kept = jvm(path + ".new"), jvm(path), jvm(path + ".bak")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old) and fs.exists(kept):
        fs.rename(kept, old)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(path + ".new")
    fs.delete(kept, True)
    if not (fs.rename(old, kept) and fs.rename(new, old)):
        raise OSError(f"{path} can't be replaced")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there; of a pattern's matches the newest."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
        if len(found):
            return str(max(found, key=lambda s: (s.getModificationTime(), str(s.getPath()))).getPath())
    raise FileNotFoundError(", ".join(paths))
