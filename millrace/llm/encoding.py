"""Token ids of whole tables of texts, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokenizers import FILES, FOLDER, Ranks, counter, decode, encode


def _known(names: list[str], library: str | None = None) -> None:
    for n in names:
        if n not in FILES or library and FILES[n][0] != library:
            raise ValueError(f"no such {library or ''} tokenizer: {n}")


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """One row per row: the key (a bigint, null stays null) and ids, without special tokens; an empty and a null text both give an empty list.

    Texts are read whole; long ones are cut where no token can change, and no text is too long or too blank to be encoded. Rows may repeat and are then encoded as often. Only the two columns are read and nothing is shuffled.
    folder holds the rank file, on every machine.
    """
    _known([tokenizer], "tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Ranks(tokenizer, folder)
        for b in batches:
            lists = [encode(e, t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def texts(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The key and text of each list of ids, by joining the tokens' raw bytes; null and empty lists give an empty text."""
    _known([tokenizer], "tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Ranks(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(e, x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` bigint, text string")


def token_counts(df: DataFrame, key: str, text: str, tokenizers: list[str], folder: str = FOLDER) -> DataFrame:
    """The key and, named after each tokenizer, the number of tokens of the text (0 for null and empty texts)."""
    _known(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [counter(n, folder) for n in tokenizers]
        for b in batches:
            rows = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c(rows), pa.int32()) for c in counts)], [key, *tokenizers])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join([f"`{key}` bigint", *(f"`{n}` int" for n in tokenizers)]))
