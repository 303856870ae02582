"""Delimited files: separator and encoding by trial over the whole file, stated schema."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.stats import nan_to_null

# Separators and encodings in the order they are tried.
SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "latin-1", "cp1252")

#: Spark reads no cp1252: it is read as latin-1, and the characters that differ are put right.
_SPARK_NAMES = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1"}
#: Bytes that have no character in cp1252.
_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, one character per byte."""
    return spark.read.option("encoding", "ISO-8859-1").csv(
        path, sep="\x01", schema="line string", quote="", escape="", mode="PERMISSIVE")


def _open_quote(sep: str) -> Column:
    """Whether a quoted field starts in a line and does not end in it."""
    closed = F.regexp_replace(F.col("line"), f'(^|{re.escape(sep)})"(?:[^"]|"")*+"(?={re.escape(sep)}|$)', "$1")
    return F.coalesce(closed.rlike(f'(^|{re.escape(sep)})"'), F.lit(False))


def _options(enc: str, sep: str, multi_line: bool) -> dict:
    return {"sep": sep, "encoding": _SPARK_NAMES.get(enc, enc), "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}


def _ragged(spark: SparkSession, path: str, enc: str, sep: str, width: int, multi_line: bool) -> bool:
    """Whether any record of the whole file has more fields than the header."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    rows = spark.read.options(**_options(enc, sep, multi_line)).schema(schema).csv(path)
    return rows.filter(F.col(f"c{width}").isNotNull()).limit(1).count() > 0


@dataclass(frozen=True)
class Format:
    """How a delimited file is to be read."""

    encoding: str
    sep: str
    multi_line: bool


def detect(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS, multi_line: bool | None = None) -> Format:
    """The first encoding that decodes all lines, and the first separator that gives more than one column and
    no record longer than the header.

    One pass over all lines checks the encodings and looks for line breaks inside quotes; one more per
    separator tried looks for records that are too long.  If no separator gives several columns, the last
    one that parses is kept.  An empty file is an error, and so is one that nothing reads.
    """
    lines = _lines(spark, path)
    bytes_ = F.encode("line", "ISO-8859-1")
    bad = {"utf-8": ~F.is_valid_utf8(bytes_.cast("string")), "latin-1": F.lit(False), "cp1252": F.col("line").rlike(_UNDEFINED)}
    known = [e for e in encodings if e in bad]
    if len(known) < len(encodings):
        raise ValueError(f"encodings are {', '.join(bad)}")
    first = next((r[0] for r in lines.filter(F.length(F.trim("line")) > 0).head(1)), None)
    if first is None:
        raise ValueError(f"no data in {path}")
    checks = lines.agg(*[F.coalesce(F.bool_or(bad[e]), F.lit(False)).alias(e) for e in known],
                       *[F.coalesce(F.bool_or(_open_quote(s)), F.lit(False)).alias(f"quote{i}") for i, s in enumerate(SEPARATORS)]).first()
    last = None
    for enc in (e for e in known if not checks[e]):
        head = first.encode("latin-1").decode(enc).removeprefix("\ufeff")
        for i, sep in enumerate(SEPARATORS):
            broken = checks[f"quote{i}"] if multi_line is None else multi_line
            width = len(next(csv.reader([head], delimiter=sep)))
            if _ragged(spark, path, enc, sep, width, broken):
                continue
            last = Format(enc, sep, broken)
            if width > 1:
                return last
    if last is None:
        raise ValueError(f"could not read {path} with any encoding and separator")
    return last


def sniff(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """(encoding, separator)."""
    found = detect(spark, path, encodings)
    return found.encoding, found.sep


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | None = None,
                   try_encodings: bool = False, sample_ratio: float = 1.0, multi_line: bool | None = None) -> DataFrame:
    """S1 (S2 with `try_encodings`): a header file of unknown separator as a table.

    `multi_line` says whether quoted fields hold line breaks; by default the whole file is looked through.
    Such a file cannot be split and is read by one task per file.  The schema is inferred once (from a share
    of the rows if asked) and then stated, so reading does not scan the files twice again.
    """
    tried = tuple(dict.fromkeys((encoding, *ENCODINGS) if encoding else ENCODINGS)) if try_encodings else (encoding or "utf-8",)
    found = detect(spark, path, tried, multi_line)
    options = {**_options(found.encoding, found.sep, found.multi_line), "header": True, "nanValue": "NaN"}
    if schema is None:
        schema = spark.read.options(**options, inferSchema=True, samplingRatio=sample_ratio).csv(path).schema
    df = spark.read.options(**options).schema(schema).csv(path)
    if found.encoding == "cp1252":
        differ = {bytes([b]): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
        wrong, right = ("".join(x) for x in zip(*[(k.decode("latin-1"), v) for k, v in differ.items() if v]))
        df = df.withColumns({f.name: F.translate(F.col(f"`{f.name}`"), wrong, right)
                             for f in schema.fields if isinstance(f.dataType, T.StringType)})
    return nan_to_null(df)


def read_sorted_by_time(spark: SparkSession, path: str, time: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: the date column parsed.  Rows are not sorted globally: every use orders inside its windows."""
    df = read_delimited(spark, path, schema=schema)
    if isinstance(df.schema[time].dataType, T.DateType):
        return df
    return df.withColumn(time, F.col(time).try_cast("date"))
