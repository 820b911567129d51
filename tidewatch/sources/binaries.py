"""Texts of files whose encoding nobody has stated; binaries are refused."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

DECODED = StructType().add("text", StringType()).add("encoding", StringType())


def looks_like_text(text: str, most: int = 4096) -> bool:
    """Hardly any control characters at the beginning, and mostly printable ones."""
    head = text[:most]
    odd = sum((c < " " and c not in "\t\r\n") or c == "\x7f" for c in head)
    shown = sum(c.isprintable() or c in "\t\r\n" for c in head)
    return odd <= max(1, len(head) // 100) and shown * 20 >= len(head) * 17


def _read(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except (UnicodeDecodeError, ValueError):
        return None


def decoded(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding): utf-16 by its byte order mark or many zero bytes, else utf-8, else cp1252; (None, None) for a binary or null, ('', 'empty') for no bytes."""
    if data is None:
        return None, None
    if not data:
        return "", "empty"
    if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) or data.count(0) > len(data) // 8:
        for encoding in ("utf-16", "utf-16-le", "utf-16-be"):
            text = _read(data, encoding)
            if text is not None and looks_like_text(text):
                return text, encoding
    if (text := _read(data, "utf-8")) is not None:
        return text, "utf-8"
    text = None if 0 in data else _read(data, "cp1252")
    return (text, "cp1252") if text is not None and looks_like_text(text) else (None, None)


@F.pandas_udf(DECODED)
def _decode(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(d) for d in data], columns=["text", "encoding"])


def decode(data: Column) -> Column:
    """Struct (text, encoding) of bytes; what is UTF-8 is decoded without Python."""
    # no zero byte; a 00 across two bytes goes to Python too
    plain = F.is_valid_utf8(data.cast("string")) & (F.instr(F.hex(data), "00") == 0)
    easy = plain & ~F.hex(F.substring(data, 1, 2)).isin("FFFE", "FEFF") & (F.length(data) > 0)
    slow = _decode(F.when(~F.coalesce(easy, F.lit(False)), data))
    return F.when(easy, F.struct(data.cast("string").alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(slow)


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, text, encoding) of the files below a folder; binaries have nulls, so that they can be reported as unread. Spark's reader gives no row for a file of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.withColumn("d", decode(F.col("content"))).select("path", "length", "d.text", "d.encoding")
