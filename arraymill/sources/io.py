"""Sources and sinks: typed vectors as files that Spark reads and writes anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMPY = {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "float32": "f4", "float64": "f8"}


def read_binary(spark: SparkSession, path: str, kind: str, big_endian: bool = False) -> DataFrame:
    """path, idx, v: files of packed numbers."""
    from arraymill.types import spark_type

    code = (">" if big_endian else "<") + _NUMPY[kind]
    out = "double" if kind in ("float32", "float64") else "bigint"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v = np.frombuffer(raw, code)
                for k in range(0, len(v), 1 << 16):
                    part = v[k : k + (1 << 16)]
                    yield pd.DataFrame({"path": name, "idx": np.arange(k, k + len(part)), "v": part.astype("f8" if out == "double" else "i8")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, f"path string, idx bigint, v {out}").withColumn("v", F.col("v").cast(spark_type(kind)))


def read_text(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Lines of text files in a charset."""
    return spark.read.option("encoding", charset).csv(path, sep="\x01", quote="", schema="value string")


def write_vector(df: DataFrame, path: str, mode: str = "append") -> None:
    """A vector as Parquet; appends by default."""
    df.write.mode(mode).parquet(path)


def freeze(df: DataFrame, path: str, shape: tuple[int, ...]) -> None:
    """A tensor's rows with its shape."""
    df.withMetadata("v", {"shape": list(shape)}).write.mode("overwrite").parquet(path)


def thaw(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    df = spark.read.parquet(path)
    return df, tuple(df.schema["v"].metadata["shape"])


def peek(raw: Column, offset: int, kind: str) -> Column:
    """An integer at a byte offset of a little-endian binary."""
    from arraymill.types import unchecked, width

    n = width(kind)
    parts = [F.conv(F.hex(F.substring(raw, offset + k + 1, 1)), 16, 10).cast("bigint") * F.lit(1 << (8 * k)) for k in range(min(n, 7))]
    value = sum(parts[1:], parts[0])
    if n == 8:
        top = F.conv(F.hex(F.substring(raw, offset + 8, 1)), 16, 10).cast("bigint")
        value = value.bitwiseOR(F.call_function("shiftleft", top, F.lit(56)))
    return unchecked(value, kind)


def encoded(text: Column, charset: str = "UTF-8") -> Column:
    """Text as bytes that end with a zero."""
    return F.concat(F.encode(text, charset), F.unhex(F.lit("00")))


def decoded(raw: Column, charset: str = "UTF-8") -> Column:
    return F.decode(F.substring(raw, F.lit(1), F.octet_length(raw) - 1), charset)
