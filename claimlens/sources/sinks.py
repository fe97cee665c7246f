"""C15 export and the star-schema table layout.

A load writes all its tables under one new version folder and publishes it
under the next number of the log (:mod:`claimlens.sources.versions`); readers
resolve the newest published version. A failed load therefore changes nothing
that a reader sees, and no table of an older load is ever mixed in.

* ``utilization`` is range-partitioned and sorted by ``(npi, hcpcs_cd)``, so
  parquet row-group statistics prune ``npi`` ranges and a hot provider is
  spread over several files; Spark sizes the partitions. With roll-ups a column
  more, ``_first``, marks one row of each distinct (npi, hcpcs_cd): the roll-ups
  count pairs by it. Readers name their columns and do not see it;
* the roll-ups (per npi, per code, specialty x code) are written beside it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.plans.base import SUM_COLS, Star, fact_pairs, roll_up, roll_up_marked, specialty_codes, specialty_profile
from claimlens.plans.materialize import reliable, small_partitions
from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA
from claimlens.sources import versions

# quoted "" stays apart from NULL, and blanks at the ends of a text stay
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``INSERT INTO t SELECT``: columns in the table's order, cast to its
    declared types (ANSI: a value that does not fit raises)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


MANIFEST = "_manifest.json"
#: Column of written facts: true on one row of each distinct (npi, hcpcs_cd).
FIRST = "_first"


def export_summary(df: DataFrame, path: str, fmt: str = "csv", order_by: list[Column] | None = None,
                   single_file: bool = False, mode: str = "overwrite") -> None:
    """Write a view for spreadsheet use.

    ``order_by`` applies the view's ORDER BY as a distributed range sort; the
    part files follow the order, and ``_manifest.json`` lists them in it, so the
    parts read in manifest order are the ordered file. ``single_file`` gathers
    the rows in one task and is meant for views with a row per specialty only.
    """
    if single_file:
        out = df.coalesce(1).sortWithinPartitions(*order_by) if order_by else df.coalesce(1)
    else:
        out = df.orderBy(*order_by) if order_by else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_WRITE).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")
    if mode == "overwrite":  # appended parts have no common order
        write_manifest(df, path, fmt, bool(order_by))


def write_manifest(df: DataFrame, path: str, fmt: str, ordered: bool) -> None:
    """List the part files of an export. Spark numbers parts by partition, and a range sort's partitions are in order."""
    folder = versions.Folder(df.sparkSession, path)
    parts = [n for n in folder.names() if n.startswith("part-")]
    folder.create(MANIFEST, json.dumps({"format": fmt, "ordered": ordered, "columns": df.columns, "parts": parts}))


def exported_parts(spark: SparkSession, path: str) -> list[str]:
    """The part files of an export, in order."""
    folder = versions.Folder(spark, path)
    return [f"{folder.path}/{n}" for n in json.loads(folder.read(MANIFEST))["parts"]]


def join_parts(spark: SparkSession, path: str, target: str, chunk: int = 1 << 20) -> None:
    """One ordered CSV file from an export's parts, streamed: the header once, then the parts' bytes in
    manifest order. No task and no driver holds the rows."""
    folder = versions.Folder(spark, path)
    manifest = json.loads(folder.read(MANIFEST))
    if manifest["format"] != "csv":
        raise ValueError("only CSV parts can be joined")
    with folder.writer(target) as write:
        for k, name in enumerate(manifest["parts"]):
            with folder.reader(name) as read:
                if k:
                    skip_header(read)
                while piece := read(chunk):
                    write(piece)


def skip_header(read) -> None:
    """Read up to the end of the first record: a newline outside quotes."""
    inside = False
    while byte := read(1):
        if byte == b'"':
            inside = not inside
        elif byte == b"\n" and not inside:
            return


def _sum_fields() -> list[T.StructField]:
    return [T.StructField(c, T.LongType() if c == "benes" else T.DecimalType(38, 4) if c in SUM_COLS[2:] else T.DecimalType(22, 2)) for c in SUM_COLS]


ROLLUP_SCHEMAS = {
    "by_npi": T.StructType([T.StructField("npi", T.LongType()), *_sum_fields(), T.StructField("n_other", T.LongType())]),
    "by_code": T.StructType([T.StructField("hcpcs_cd", T.StringType()), *_sum_fields(), T.StructField("n_other", T.LongType())]),
    "by_specialty_code": T.StructType([T.StructField("specialty", T.StringType()), T.StructField("hcpcs_cd", T.StringType())]),
}


PROFILE_SCHEMA = T.StructType([T.StructField("specialties", T.LongType()), T.StructField("largest", T.LongType())])


def write_version(star: Star, root: str, with_rollups: bool = True) -> str:
    """Write every table of a load under a new version folder; nothing is published."""
    spark, version = star.providers.sparkSession, uuid.uuid4().hex
    at = f"{root.rstrip('/')}/versions/{version}"
    conform(star.providers, PROVIDERS_SCHEMA).write.parquet(f"{at}/providers")
    conform(star.codes, CODES_SCHEMA).write.parquet(f"{at}/hcpcs_codes")
    # range partitions on (npi, code): files hold disjoint npi ranges (tight
    # row-group statistics) and a provider on a third of all rows is split
    # across files by code; no count is named, so AQE sizes the files
    facts = conform(star.utilization, UTILIZATION_SCHEMA).repartitionByRange("npi", "hcpcs_cd").sortWithinPartitions("npi", "hcpcs_cd")
    if with_rollups:
        # a pair's rows are side by side in one range partition, so the window adds neither a shuffle nor a sort
        pair = Window.partitionBy("npi", "hcpcs_cd").orderBy("npi", "hcpcs_cd")
        facts = facts.withColumn(FIRST, F.row_number().over(pair) == 1)
    facts.write.parquet(f"{at}/utilization")
    if with_rollups:
        star = read_star(spark, root, version=version)
        marked = spark.read.schema(T.StructType([*UTILIZATION_SCHEMA.fields, T.StructField(FIRST, T.BooleanType())])).parquet(f"{at}/utilization")
        pairs = marked.where(FIRST).select("npi", "hcpcs_cd")
        _write_rollups(roll_up_marked(marked, "npi", FIRST), roll_up_marked(marked, "hcpcs_cd", FIRST),
                       specialty_codes(marked, star.providers, pairs), star.providers, root, version)
    return version


def write_rollups(star: Star, root: str, version: str) -> str:
    """Write the roll-ups of a version's tables beside them; the distinct pairs are found once for all three."""
    pairs = reliable(fact_pairs(star.utilization))
    _write_rollups(roll_up(star.utilization, "npi", pairs), roll_up(star.utilization, "hcpcs_cd", pairs),
                   specialty_codes(star.utilization, star.providers, pairs), star.providers, root, version)
    return version


def _write_rollups(by_npi: DataFrame, by_code: DataFrame, by_specialty_code: DataFrame, providers: DataFrame, root: str, version: str) -> None:
    at = f"{root.rstrip('/')}/versions/{version}"
    for name, df in (("by_npi", by_npi), ("by_code", by_code)):
        conform(df, ROLLUP_SCHEMAS[name]).write.parquet(f"{at}/{name}")
    with small_partitions(providers.sparkSession):  # most pairs are a (specialty, code) of their own
        conform(by_specialty_code, ROLLUP_SCHEMAS["by_specialty_code"]).write.parquet(f"{at}/by_specialty_code")
    conform(specialty_profile(providers), PROFILE_SCHEMA).write.parquet(f"{at}/_profile")


def write_codes(codes: DataFrame, root: str, version: str) -> None:
    """Write the code table of an unpublished version anew."""
    conform(codes, CODES_SCHEMA).write.mode("overwrite").parquet(f"{root.rstrip('/')}/versions/{version}/hcpcs_codes")


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a complete version the one that readers see, whatever was published meanwhile."""
    while True:
        try:
            versions.publish(spark, root, version, versions.published(spark, root))
            return
        except versions.PublishConflict:
            continue


def write_star(star: Star, root: str, with_rollups: bool = True) -> None:
    """Write all tables of a load and publish them together."""
    publish(star.providers.sparkSession, root, write_version(star, root, with_rollups))


def published(spark: SparkSession, root: str) -> str | None:
    """The newest published version, or None before the first."""
    at = versions.published(spark, root)
    return at.version if at else None


def read_star(spark: SparkSession, root: str, with_rollups: bool = True, version: str | None = None) -> Star:
    """The newest published star, or the version named; its roll-ups too if it has them."""
    root = root.rstrip("/")
    version = version or published(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published star under {root}")
    at = f"{root}/versions/{version}"

    def table(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{at}/{name}")

    star = Star(table("providers", PROVIDERS_SCHEMA), table("hcpcs_codes", CODES_SCHEMA), table("utilization", UTILIZATION_SCHEMA))
    if with_rollups:
        try:
            star.by_npi, star.by_code, star.by_specialty_code = (table(n, s) for n, s in ROLLUP_SCHEMAS.items())
            star.profile = table("_profile", PROFILE_SCHEMA)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # a version written without roll-ups computes them
            star.by_npi = star.by_code = star.by_specialty_code = star.profile = None
    return star
