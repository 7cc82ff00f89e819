"""Readers. Every row carries ``line_no``, its place in the input, because the order of lines decides what comes first or last."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequilt.functions.json_text import any_value, strict_object
from framequilt.functions.text import blank_to_null, file_stem, strip_ws
from framequilt.operators.selection import surgery_type
from framequilt.session import exists, names_in, read_file
from framequilt.sources.excel import first_sheet

# Suffixes of videos and sheets.
VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm", "m4v")
MORE_VIDEO_SUFFIXES = (*VIDEO_SUFFIXES, "mpg", "mpeg", "wmv")
SHEET_SUFFIXES = ("csv", "xlsx", "xls")
# Spellings of a type that state none.
NO_TYPE = ("n/a", "na", "unknown")


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, line_no: the place of the line from 0 without gaps, files in the order of their paths.

    Spark packs pieces of files into partitions by size. The number of a line is therefore counted within its piece, and
    the pieces are put in order by file and offset: one row for each 128 MB of input is sorted and broadcast.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__id"))
    pieces = raw.groupBy("__file", "__from").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("__file", "__from", "__first", F.coalesce(earlier, F.lit(0)).alias("__before"))
    return raw.join(F.broadcast(starts), ["__file", "__from"]).select("value", (F.col("__before") + F.col("__id") - F.col("__first")).alias("line_no"))


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSONL file, blank and malformed lines and other values left out: the fields of ``schema``, raw, line_no.

    Python's reader decides what is well formed (NaN and repeated keys are, trailing text isn't); the fields are then read by Spark.
    """
    lines = numbered_lines(spark, path).filter(strip_ws(F.col("value")) != "")
    objects = lines.select(strict_object("value").alias("raw"), "line_no").filter("raw IS NOT NULL")
    return objects.select(F.from_json("raw", schema, {"allowNonNumericNumbers": "true"}).alias("r"), "raw", "line_no").select("r.*", "raw", "line_no")


def resume_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier output: every line that is JSON, objects or not (what is no object has null fields, but counts); a file that doesn't exist has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, raw string, line_no bigint")
    lines = numbered_lines(spark, path).filter(strip_ws(F.col("value")) != "")
    values = lines.select(any_value("value").alias("raw"), "line_no").filter("raw IS NOT NULL")
    fields = F.from_json(F.when(F.col("raw").startswith("{"), F.col("raw")), schema, {"allowNonNumericNumbers": "true"})
    return values.select(fields.alias("r"), "raw", "line_no").select("r.*", "raw", "line_no")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSONL file; any malformed or blank line is an error when it is read."""
    lines = numbered_lines(spark, path)
    checked = F.coalesce(strict_object("value"), F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80))).cast("string"))
    return lines.select(F.from_json(checked, schema).alias("r"), "line_no").select("r.*", "line_no")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of a file that holds one JSON array; anything else is an error when it is read."""
    text = any_value("value")
    checked = F.when(text.startswith("["), text).otherwise(F.raise_error(F.lit("the file must hold one JSON array")).cast("string"))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(checked, f"array<struct<{schema}>>")).alias("line_no", "r"))
    return rows.select("r.*", F.col("line_no").cast("bigint").alias("line_no"))


def training_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return strict_jsonl(spark, path, schema) if path.endswith("jsonl") else json_array(spark, path, schema)


def object_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """Entries of a file that holds one JSON object: key and the fields of the value (null where it is no object). Another top level is an error."""
    whole = spark.read.text(path, wholetext=True)
    checked = F.coalesce(strict_object("value"), F.raise_error(F.lit("the top level must be an object")).cast("string"))
    entries = whole.select(F.explode(F.from_json(checked, "map<string,string>")).alias(key, "v"))
    value = F.from_json(F.when(F.trim("v").startswith("{"), F.col("v")), value_schema)
    return entries.select(key, value.alias("r")).select(key, "r.*")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header, all columns text, names without blanks at the ends, empty cells null. Old workbooks (.xls) need pandas with xlrd."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif suffix in ("xlsx", "xls"):
        if suffix == "xlsx":
            head, *rows = first_sheet(read_file(spark, path)) or [[]]
        else:
            import io

            import pandas as pd

            pdf = pd.read_excel(io.BytesIO(read_file(spark, path)), dtype=str)
            head, rows = list(pdf.columns), pdf.astype(object).where(pdf.notna(), None).values.tolist()
        names = [h if h is not None else f"column {i}" for i, h in enumerate(head)]
        full = [tuple((r + [None] * len(names))[: len(names)]) for r in rows]
        df = spark.createDataFrame(full, ", ".join(f"`{n}` string" for n in names)).coalesce(1)
    else:
        raise ValueError(f"unsupported sheet: {path}")
    return df.toDF(*[c.strip() for c in df.columns]).withColumn("line_no", F.monotonically_increasing_id())


def sheets(spark: SparkSession, folder: str, suffixes: Sequence[str] = SHEET_SUFFIXES) -> DataFrame:
    """All sheets of a folder in the order of their names, columns united by name, with file_no and line_no. A folder without sheets is an error."""
    out: DataFrame | None = None
    for i, df in enumerate(_each_sheet(spark, folder, suffixes)):
        df = df.withColumn("file_no", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _each_sheet(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> list[DataFrame]:
    names = [n for n in names_in(spark, folder) if n.rsplit(".", 1)[-1].lower() in suffixes]
    if not names:
        raise ValueError(f"no sheets in {folder}")
    return [sheet(spark, os.path.join(folder, n)) for n in names]


def type_map(spark: SparkSession, folder: str) -> DataFrame:
    """id and surgery type of the workbooks of a folder: of each id the first type that is stated, files in the order of their names. Sheets without the columns id and Type are left out."""
    rows = spark.createDataFrame([], "id string, kind string, place struct<file_no:int,line_no:bigint>")
    for i, df in enumerate(_each_sheet(spark, folder, SHEET_SUFFIXES[1:])):
        if {"id", "Type"} <= set(df.columns):
            rows = rows.unionByName(df.select(F.col("id"), F.col("Type").alias("kind"), F.struct(F.lit(i).alias("file_no"), "line_no").alias("place")))
    return first_types(rows, "id", "kind", "place")


def first_types(rows: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """id and type: the first stated type of each id, in its display form. Ids that are missing, blank or 'nan' are dropped."""
    k = strip_ws(F.col(key).cast("string"))
    stated = F.coalesce(strip_ws(F.col(kind).cast("string")), F.lit(""))
    named = rows.select(k.alias("id"), F.when(F.lower(stated).isin(*NO_TYPE), "").otherwise(surgery_type(stated)).alias("type"), F.col(order).alias("__order"))
    return named.filter((F.lower("id") != "nan") & (F.col("id") != "") & (F.col("type") != "")).groupBy("id").agg(F.min_by("type", "__order").alias("type"))


def id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """Distinct ids, one per line, blanks dropped. A missing file is an error."""
    return spark.read.text(path).select(blank_to_null(F.col("value")).alias(name)).filter(F.col(name).isNotNull()).distinct()


def video_catalogue(spark: SparkSession, folder: str, suffixes: Sequence[str] = VIDEO_SUFFIXES, recursive: bool = True) -> DataFrame:
    """stem, path of the videos below a folder, suffixes in any case; where a stem occurs more than once, the least path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    videos = files.filter(F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1)).isin(*suffixes))
    return videos.groupBy(strip_ws(file_stem(F.col("path"))).alias("stem")).agg(F.min("path").alias("path"))


def absolute_media(base: str, path: Column) -> Column:
    """Path below a base folder; absolute ones stay."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
