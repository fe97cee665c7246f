"""C1 / C20: the yearly CSV extract as an all-text staging frame.

CSV dialect of the source load (``FORMAT CSV, HEADER TRUE, UTF8``): columns
bound by position with the header line skipped, ``"`` quotes doubled to
escape, newlines allowed inside quotes, an unquoted empty field is NULL while
a quoted empty field is the empty string, and a line with the wrong number
of fields aborts the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.schema import STAGING_SCHEMA
from claimlens.sources import records

# A marker that never occurs in the data: with it as ``nullValue`` Spark
# keeps quoted "" as '' and turns only unquoted empty fields into NULL.
_NULL_MARKER = "\u0001"


# Holds the text of a line whose fields are not 28.
CORRUPT = "_corrupt_line"
CSV_SCHEMA = T.StructType([*STAGING_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


class ExtractError(ValueError):
    """An extract that can't be read as the dialect says."""


def csv_options(multi_line: bool = True) -> dict[str, str]:
    return {
        "header": "true",
        "enforceSchema": "true",   # bind by position; the header line is skipped
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "columnPruning": "false",  # every field of every line is parsed, whatever is selected
        "encoding": "UTF-8",
        "nullValue": _NULL_MARKER,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def checked(raw: DataFrame) -> DataFrame:
    """The 28 columns of lines read with :data:`CSV_SCHEMA`; a short or long line
    raises, whatever rows and columns are used later.

    The check sits inside every column, so a filter on one (the state) can't be
    pushed into the parser ahead of it.
    """
    bad = F.raise_error(F.concat(F.lit("malformed extract line: "), F.left(F.col(CORRUPT), F.lit(200)))).cast("string")
    return raw.select(*[F.when(F.col(CORRUPT).isNull(), F.col(c)).otherwise(bad).alias(c) for c in STAGING_SCHEMA.names])


def inspect_extract(spark: SparkSession, path: str | list[str]) -> tuple[int, int]:
    """(lines with an odd number of quotes, lines that are not UTF-8), in one
    distributed pass over the lines of a file of any size."""
    profile = records.block_profile(spark, path).collect()  # a row for each split
    return sum(r["odd"] for r in profile), sum(r["bad"] for r in profile)


def parse_records(text: DataFrame) -> DataFrame:
    """Records (one text column) -> the 28 columns and the corrupt marker."""
    options = {k: v for k, v in csv_options().items() if k not in ("header", "enforceSchema", "encoding", "columnPruning")}
    ddl = ", ".join(f"`{f.name}` string" for f in CSV_SCHEMA.fields)
    c = F.col(records.RECORD)
    line = F.when(F.endswith(c, F.lit("\r")), F.left(c, F.length(c) - 1)).otherwise(c)
    return text.select(F.from_csv(line, ddl, options).alias("r")).select("r.*")


def read_raw(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """The extract's lines with :data:`CSV_SCHEMA`: malformed ones are marked, bytes that are not UTF-8 raise.

    Without ``multi_line`` the extract decides, in one pass: if no line holds an
    odd number of quotes, no field spans lines and Spark's reader splits the
    files; otherwise records are cut by :mod:`claimlens.sources.records`, in as
    many splits. True reads each file unsplit, False takes each line as a record.
    """
    if multi_line is None:
        profile = records.block_profile(spark, path).collect()  # a row for each split, as the driver plans them
        if bad := sum(r["bad"] for r in profile):
            raise ExtractError(f"{bad} line(s) of {path} are not valid UTF-8")
        if any(r["odd"] for r in profile):
            if open_files := records.unfinished([(r["file"], r["block"], r["odd"]) for r in profile]):
                raise ExtractError(f"a quoted field is never closed in {open_files[:3]}")
            return parse_records(records.records(spark, path, profile))
        multi_line = False
    return spark.read.schema(CSV_SCHEMA).options(**csv_options(multi_line)).csv(path)


def read_staging(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """C1: read extract file(s) as 28 text columns; a malformed line raises."""
    return checked(read_raw(spark, path, multi_line))


def write_staging(df: DataFrame, path: str, mode: str = "overwrite", lines_per_file: int = 0, compression: str = "none") -> None:
    """Write a staging frame as the extract CSV (quoted "" stays apart from NULL).

    ``lines_per_file`` bounds a file's lines whatever the partitions; a compressed
    file is read unsplit, so a compressed extract needs that bound.
    """
    from claimlens.sources.sinks import CSV_WRITE

    df.write.mode(mode).options(**CSV_WRITE, maxRecordsPerFile=str(lines_per_file), compression=compression).csv(path)


def staging_row_count(stg: DataFrame) -> DataFrame:
    """C20: load sanity count as a one-row frame (every line is checked)."""
    # always true, but not for the optimizer: a bare count would read no column
    every = F.length(F.coalesce(F.col(stg.columns[0]), F.lit(""))) >= 0
    return stg.where(every).agg(F.count(F.lit(1)).alias("staging_rows"))
