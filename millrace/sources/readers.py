"""Example files of several formats as tables: row_id, label, features (an array of idx, val), file."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.lines import FORMATS, examples, parse_lines, rejects


def text_lines(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    """Lines of text files in the shape that parse_lines takes. line_id is the number of the file part and of the line in it: unique, and the same as long as the files are cut into the same parts. The solvers write their rows once for that reason."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.monotonically_increasing_id().alias("line_id"), F.input_file_name().alias("file_name"), F.lit(fmt).alias("fmt"), F.col("value").alias("raw"))


def read_text(spark: SparkSession, path: str | list[str], fmt: str = "libsvm", keep_rejects: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Rows of the lines that parse: row_id, label, features. Ids stand as in the file. keep_rejects is given the others, with reasons and their text."""
    parsed = parse_lines(text_lines(spark, path, fmt))
    if keep_rejects:
        keep_rejects(rejects(parsed))
    return examples(parsed).select(F.col("line_id").alias("row_id"), "label", "features")


def read_rec(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows kept as compressed columns (Parquet): row_id, label, features, and weight where it was written."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


READERS: dict[str, Callable[..., DataFrame]] = {f: (lambda spark, path, f=f: read_text(spark, path, f)) for f in FORMATS} | {"rec": read_rec}


def read(spark: SparkSession, path: str | list[str], fmt: str, part: int = 0, parts: int = 1) -> DataFrame:
    """The rows of files of a format; of so many parts of them, one, which the row's hash decides."""
    if fmt not in READERS:
        raise ValueError(f"no such format: {fmt}")
    if not 0 <= part < parts:
        raise ValueError("no such part")
    rows = READERS[fmt](spark, path)
    return rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == part)


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files in the pattern's folder whose whole path matches it as a regular expression with anything before it. Names only are listed; no file is read."""
    folder, _, name = pattern.rpartition("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder or ".")
    found = [str(s.getPath().toUri().getPath()) for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if s.isFile()]
    return sorted(f for f in found if re.fullmatch(f".*{re.escape(folder)}/{name}" if folder else f".*{name}", f))
