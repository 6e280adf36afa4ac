"""Rows (row_id, label, features) as text or compressed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    """As short as it can be: whole numbers without a point."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def libsvm_lines(rows: DataFrame) -> DataFrame:
    """value: label idx[:val] ... per row; a null val is left out, a null label is 0. Ids are written as unsigned numbers; entries without idx are left out."""
    items = F.transform(F.filter("features", lambda x: x["idx"].isNotNull()), lambda x: F.concat(F.conv(F.hex(x["idx"]), 16, 10), F.when(x["val"].isNull(), "").otherwise(F.concat(F.lit(":"), _number(x["val"])))))
    return rows.select(F.concat_ws(" ", _number(F.coalesce("label", F.lit(0.0))), F.coalesce(items, F.array().cast("array<string>"))).alias("value"))


def _writer(df: DataFrame, part_size: float, size: Column, merged: bool):
    """Files of at most about part_size MB, by the mean size in bytes of a row; for a negative part_size each task writes one file. merged: all in one task."""
    if part_size == 0:
        raise ValueError("part_size must not be 0")
    writer = (df.coalesce(1) if merged else df).write.mode("overwrite")
    if part_size < 0:
        return writer
    mean = df.agg(F.avg(size)).first()[0] or 1
    return writer.option("maxRecordsPerFile", max(1, int(part_size * 1e6 / mean)))


def write_libsvm(rows: DataFrame, path: str, part_size: float = -1, merged: bool = False) -> None:
    lines = libsvm_lines(rows)
    _writer(lines, part_size, F.octet_length("value") + 1, merged).text(path)


def write_rec(rows: DataFrame, path: str, part_size: float = -1, compression: str = "zstd", merged: bool = False) -> None:
    """Values that are all 1 cost nothing: they are written as null."""
    one = F.transform("features", lambda x: F.struct(x["idx"].alias("idx"), F.when(x["val"] != 1, x["val"]).alias("val")))
    slim = rows.withColumn("features", one)
    _writer(slim, part_size, F.size("features") * 9 + 1, merged).option("compression", compression).parquet(path)


WRITERS = {"libsvm": write_libsvm, "rec": write_rec}


def convert(spark, p) -> None:
    """p: params.Convert. Reads files of one format and writes them in another, in files of about part_size MB."""
    from millrace.sources.readers import read

    if p.data_out_format not in WRITERS:
        raise ValueError(f"can't write {p.data_out_format}")
    WRITERS[p.data_out_format](read(spark, p.data_in, p.data_format), p.data_out, p.part_size)

