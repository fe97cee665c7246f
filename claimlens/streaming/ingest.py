"""Incremental star-schema loading from extract files as they arrive.

The source script loads one yearly extract per run. When extracts arrive as
files over time (a new year, a corrected state file), the same load runs per
micro-batch of new files with Structured Streaming:

* the file source tracks which files were loaded (checkpoint location), so
  each file is loaded once; a batch reads its files as the one-shot load does
  (strict lines, UTF-8, quoted newlines in splits);
* every batch applies the loads of :mod:`claimlens.sources.loaders` (state
  filter, typed facts) and appends, per provider and per code, the batch's
  smallest raw row as a *candidate*. The provider and code tables are the
  smallest candidate per key over all batches: exactly the one-shot load of all
  files, however they were split into batches or ordered;
* every batch adds its share of the roll-ups: sums per provider and per code,
  and the (npi, code) pairs that no earlier batch has. Sums and numbers of new
  pairs are additive, so roll-ups, distinct counts included, are exact sums over
  batches; old facts are never read again;
* a batch is checked against the constraints before it is written: malformed
  lines, bytes that are not UTF-8, missing keys, texts over their length, and
  NPI texts that meet another text's number in the batch or in what earlier
  batches loaded. A batch that violates one is not loaded: its files and the
  reasons go to the quarantine table, and the stream goes on;
* every table has a ``load_batch`` partition column and a batch rewrites only
  its own partition (dynamic partition overwrite), so a batch retried after a
  failure leaves the same files as one that ran once;
* a batch counts only once its commit row is written, after its tables: reads
  and compaction leave out a batch that was cut short or quarantined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimlens.functions.exprs import blank_to_null
from claimlens.plans.base import SUM_COLS, Star, fact_pairs, roll_up, specialty_codes
from claimlens.plans.materialize import reliable
from claimlens.schema import (
    CODES_LENGTHS,
    CODES_SCHEMA,
    PROVIDERS_LENGTHS,
    PROVIDERS_SCHEMA,
    STAGING_COLUMNS,
    UTILIZATION_LENGTHS,
    UTILIZATION_SCHEMA,
)
from claimlens.sources.loaders import (
    CODE_SRC,
    DEFAULT_STATE,
    PROVIDER_SRC,
    code_candidates,
    codes_from_candidates,
    in_state,
    load_utilization,
    provider_candidates,
    providers_from_candidates,
)
from claimlens.sources.sinks import ROLLUP_SCHEMAS, conform
from claimlens.sources.staging import CORRUPT, ExtractError, read_raw
from claimlens.sources.versions import Folder

BATCH_COL = "load_batch"
PROVIDER_CANDIDATES, CODE_CANDIDATES, FACTS = "provider_candidates", "code_candidates", "utilization"
NPI_SUMS, CODE_SUMS, PAIRS = "by_npi", "by_code", "pairs"
COMMITS, SNAPSHOTS, QUARANTINE = "_commits", "_snapshots", "quarantine"
LOADED, QUARANTINED = "loaded", "quarantined"


def _candidate_schema(key: str, columns: list[str]) -> list[T.StructField]:
    text = T.StringType()
    return [T.StructField(key, text), T.StructField("r", T.StructType([T.StructField(c, text) for c in columns]))]


_KEYS = {PROVIDER_CANDIDATES: "Rndrng_NPI", CODE_CANDIDATES: "HCPCS_Cd"}
_SUM_KEYS = {NPI_SUMS: "npi", CODE_SUMS: "hcpcs_cd"}
_PAIR = [T.StructField("npi", T.LongType()), T.StructField("hcpcs_cd", T.StringType())]
_SCHEMAS = {PROVIDER_CANDIDATES: _candidate_schema("Rndrng_NPI", PROVIDER_SRC),
            CODE_CANDIDATES: _candidate_schema("HCPCS_Cd", CODE_SRC), FACTS: UTILIZATION_SCHEMA.fields,
            NPI_SUMS: ROLLUP_SCHEMAS["by_npi"].fields, CODE_SUMS: ROLLUP_SCHEMAS["by_code"].fields, PAIRS: _PAIR}
_BATCH = T.StructField(BATCH_COL, T.LongType())
_QUARANTINE = "load_batch bigint, file string, reason string, violations bigint"
# what arrives: only names are read here
_ARRIVED = "path string, modificationTime timestamp, length bigint, content binary"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn(BATCH_COL, F.lit(batch_id).cast("bigint"))
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(BATCH_COL)
       .parquet(path))


# -- constraints of a batch ----------------------------------------------------

def _unfit(c, kind: str, blank_is_null: bool = True):
    """Rows whose text the load's cast would refuse."""
    c = blank_to_null(c) if blank_is_null else c
    return F.count_if(c.isNotNull() & c.try_cast(kind).isNull())


def batch_violations(facts: DataFrame, providers: DataFrame, codes: DataFrame, root: str, batch_id: int) -> dict[str, int]:
    """Violations of the schema's constraints by a batch, by name; empty if clean.

    ``facts`` are its staged rows of the state, ``providers`` and ``codes`` its
    candidates (one row a key). The batch's NPI texts meet those of earlier
    batches by number; no earlier fact is read.
    """
    spark = facts.sparkSession
    r = lambda c: F.col("r." + c)
    checks = [
        (facts, {"not_null.npi": F.count_if(F.col("Rndrng_NPI").isNull()), "not_null.hcpcs_cd": F.count_if(F.col("HCPCS_Cd").isNull()),
                 "type.npi": _unfit(F.col("Rndrng_NPI"), "bigint", False), "type.Tot_Benes": _unfit(F.col("Tot_Benes"), "int"),
                 **{f"type.{c}": _unfit(F.col(c), "decimal(12,2)") for c in STAGING_COLUMNS[-6:]},
                 "length.place_of_service": F.count_if(F.char_length("Place_Of_Srvc") > UTILIZATION_LENGTHS["place_of_service"])}),
        (providers, {"type.state_fips": _unfit(r("Rndrng_Prvdr_State_FIPS"), "smallint", False), "type.ruca_code": _unfit(r("Rndrng_Prvdr_RUCA"), "decimal(4,1)"),
                     **{f"length.{out}": F.count_if(F.char_length(r(c)) > PROVIDERS_LENGTHS[out])
                        for c, out in zip(PROVIDER_SRC, PROVIDERS_SCHEMA.names[1:]) if out in PROVIDERS_LENGTHS}}),
        (codes, {"length.hcpcs_cd": F.count_if(F.char_length("HCPCS_Cd") > CODES_LENGTHS["hcpcs_cd"]),
                 **{f"length.{out}": F.count_if(F.char_length(r(c)) > CODES_LENGTHS[out]) for c, out in zip(CODE_SRC, CODES_SCHEMA.names[1:])}}),
    ]
    mine = providers.select(F.col("Rndrng_NPI").alias("text"), F.col("Rndrng_NPI").try_cast("bigint").alias("npi")).where("npi is not null")
    known = _current(spark, root, PROVIDER_CANDIDATES, before=batch_id).select(F.col("Rndrng_NPI").alias("text"), F.col("Rndrng_NPI").cast("bigint").alias("npi"))
    known = known.join(mine.select("npi"), "npi", "left_semi")  # the batch's side is the smaller one
    texts = mine.unionByName(known).distinct().groupBy("npi").agg(F.count(F.lit(1)).alias("n"))
    checks.append((texts, {"unique.npi": F.count_if(F.col("n") > 1)}))
    named = [df.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts.values())])
             .select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("n")) for i, name in enumerate(counts)])))
             for df, counts in checks]
    found = reduce(DataFrame.unionByName, named).where("n > 0").collect()  # one row a check
    return {r["name"]: int(r["n"]) for r in found}


def _quarantine(spark: SparkSession, root: str, batch_id: int, files: list[str], found: dict[str, int]) -> None:
    rows = [(batch_id, f, reason, n) for f in files or [None] for reason, n in sorted(found.items())]
    folder = Folder(spark, root)
    for table in _SCHEMAS:  # what an earlier try of the batch may have left
        folder.remove(f"{table}/{BATCH_COL}={batch_id}")
    _write_batch(spark.createDataFrame(rows, _QUARANTINE).drop(BATCH_COL).coalesce(1), f"{root}/{QUARANTINE}", batch_id)
    _commit(spark, f"{root}/{COMMITS}", batch_id, QUARANTINED)


def quarantined(spark: SparkSession, target_root: str) -> DataFrame:
    """(load_batch, file, reason, violations) of the batches that were not loaded. A corrected file is
    loaded when it arrives under a new name."""
    return _read(spark, f"{target_root.rstrip('/')}/{QUARANTINE}", T._parse_datatype_string(_QUARANTINE))


# -- a batch ---------------------------------------------------------------------

def batch_rollups(util: DataFrame, known_pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch adds: sums per npi and per code, each with its number of new pairs, and the new pairs."""
    pairs = fact_pairs(util)
    new = reliable(pairs.join(known_pairs, pairs["npi"].eqNullSafe(known_pairs["npi"]) & pairs["hcpcs_cd"].eqNullSafe(known_pairs["hcpcs_cd"]), "left_anti"))
    by_npi, by_code = (conform(roll_up(util, key, new), ROLLUP_SCHEMAS[name]) for name, key in _SUM_KEYS.items())
    return by_npi, by_code, new


def load_batch(stg: DataFrame, batch_id: int, target_root: str, state: str = DEFAULT_STATE, files: list[str] | None = None) -> bool:
    """Load one batch of staging rows into the tables under ``target_root``, or quarantine it.

    ``stg`` may carry the corrupt marker of :func:`staging.read_raw`; a marked
    line of any state is a violation. True if the batch was loaded.
    """
    spark, root = stg.sparkSession, target_root.rstrip("/")
    if CORRUPT in stg.columns:
        stg = reliable(stg.where(F.col(CORRUPT).isNotNull() | (F.col("Rndrng_Prvdr_State_Abrvtn") == F.lit(state))))
        malformed = stg.where(F.col(CORRUPT).isNotNull()).count()
        if malformed:
            _quarantine(spark, root, batch_id, files or [], {"malformed": malformed})
            return False
        stg = stg.select(*STAGING_COLUMNS)
    else:
        stg = reliable(in_state(stg, state))  # read by the checks and the loads
    providers, codes = reliable(provider_candidates(stg, state)), reliable(code_candidates(stg, state))
    if found := batch_violations(stg, providers, codes, root, batch_id):
        _quarantine(spark, root, batch_id, files or [], found)
        return False
    _write_batch(providers, f"{root}/{PROVIDER_CANDIDATES}", batch_id)
    _write_batch(codes, f"{root}/{CODE_CANDIDATES}", batch_id)
    _write_batch(load_utilization(stg, state), f"{root}/{FACTS}", batch_id)
    mine = spark.read.schema(T.StructType([*_SCHEMAS[FACTS], _BATCH])).parquet(f"{root}/{FACTS}").where(F.col(BATCH_COL) == batch_id).drop(BATCH_COL)
    for table, df in zip((NPI_SUMS, CODE_SUMS, PAIRS), batch_rollups(mine, _current(spark, root, PAIRS, before=batch_id))):
        _write_batch(df, f"{root}/{table}", batch_id)
    _commit(spark, f"{root}/{COMMITS}", batch_id, LOADED)
    return True


def load_files(spark: SparkSession, files: list[str], batch_id: int, target_root: str, state: str = DEFAULT_STATE, multi_line: bool | None = None) -> bool:
    """Load one batch of extract files, or quarantine it; True if it was loaded."""
    try:
        raw = read_raw(spark, files, multi_line)
    except ExtractError as e:
        _quarantine(spark, target_root.rstrip("/"), batch_id, files, {f"unreadable: {e}"[:300]: 1})
        return False
    return load_batch(raw, batch_id, target_root, state, files)


def start_ingest(spark: SparkSession, source_dir: str, target_root: str, *,
                 checkpoint_location: str | None = None, state: str = DEFAULT_STATE,
                 available_now: bool = True, processing_time: str | None = None,
                 max_files_per_trigger: int | None = None, multi_line: bool | None = None) -> StreamingQuery:
    """Start loading every extract file that appears under ``source_dir``.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps polling every ``processing_time``.
    """
    reader = spark.readStream.schema(_ARRIVED).format("binaryFile")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source_dir).select("path")  # names only: contents are read by the batch, in splits

    def run(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r["path"] for r in batch.collect())  # the file source keeps the same list in the driver
        if files:
            load_files(batch.sparkSession, files, batch_id, target_root, state, multi_line)

    # part of the target, so that an ingest restarted in any session resumes
    ckpt = checkpoint_location or f"{target_root.rstrip('/')}/_checkpoint"
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


# -- commits ---------------------------------------------------------------------

def _commit(spark: SparkSession, path: str, number: int, state: str = LOADED) -> None:
    """One small file for each number, created once."""
    Folder(spark, path).create(f"{number:012d}", state)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last(spark: SparkSession, path: str) -> int:
    """The last number committed, or -1. Batches come one after the other, so
    every batch up to it is complete."""
    return max((int(n) for n in Folder(spark, path).names() if n.isdigit()), default=-1)


SNAPSHOT_COL = "upto"


def _batches(spark: SparkSession, root: str, table: str, after: int, before: int | None = None) -> DataFrame:
    """Rows of the loaded batches behind ``after`` (partition-pruned), read with the declared schema."""
    schema = T.StructType([*_SCHEMAS[table], _BATCH])
    last = _last(spark, f"{root}/{COMMITS}") if before is None else before - 1
    if last <= after:
        return spark.createDataFrame([], schema)
    return _read(spark, f"{root}/{table}", schema).where(F.col(BATCH_COL).between(after + 1, last))  # a quarantined batch has none


def _current(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """The latest complete snapshot plus only the batches after it."""
    upto = _last(spark, f"{root}/{SNAPSHOTS}")
    if before is not None and upto >= before:
        raise ValueError(f"batch {before} of {root} is part of a snapshot already")
    newer = _batches(spark, root, table, upto, before).drop(BATCH_COL)
    if upto < 0:
        return newer
    return spark.read.schema(T.StructType(_SCHEMAS[table])).parquet(f"{root}/{table}_snapshot/{SNAPSHOT_COL}={upto}").unionByName(newer)


def _summed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A roll-up: the sum of its batches, one row per key."""
    key = _SUM_KEYS[table]
    return conform(_current(spark, root, table).groupBy(key).agg(*[F.sum(c).alias(c) for c in [*SUM_COLS, "n_other"]]), T.StructType(_SCHEMAS[table]))


def compact(spark: SparkSession, target_root: str) -> int:
    """Reduce every candidate and roll-up batch loaded so far to one row per key, and gather the pairs.

    The result goes to ``<table>_snapshot/upto=<last batch>`` (a new path, so
    nothing being read is overwritten); later reads start from the newest
    snapshot and skip the partitions it covers. Minima and sums are
    associative, so results do not change. Returns the last batch covered.
    """
    root = target_root.rstrip("/")
    done, upto = _last(spark, f"{root}/{SNAPSHOTS}"), _last(spark, f"{root}/{COMMITS}")
    if upto <= done:  # nothing new: never rewrite the snapshot being read
        return done
    reduced = {t: _current(spark, root, t).groupBy(key).agg(F.min("r").alias("r")) for t, key in _KEYS.items()}
    reduced |= {t: _summed(spark, root, t) for t in _SUM_KEYS}
    reduced[PAIRS] = _current(spark, root, PAIRS)
    for table, df in reduced.items():
        df.write.mode("overwrite").parquet(f"{root}/{table}_snapshot/{SNAPSHOT_COL}={upto}")
    _commit(spark, f"{root}/{SNAPSHOTS}", upto)  # all tables are there
    return upto


def read_loaded(spark: SparkSession, target_root: str) -> Star:
    """The incrementally loaded star: providers and codes reduced from their
    latest snapshot and newer candidates, facts of all loaded batches
    (``load_batch`` kept as a column), and the roll-ups as sums over batches."""
    root = target_root.rstrip("/")
    providers = providers_from_candidates(_current(spark, root, PROVIDER_CANDIDATES))
    pairs = _current(spark, root, PAIRS)
    specialties = specialty_codes(pairs, providers, pairs)
    return Star(providers, codes_from_candidates(_current(spark, root, CODE_CANDIDATES)), _batches(spark, root, FACTS, -1),
                _summed(spark, root, NPI_SUMS), _summed(spark, root, CODE_SUMS), specialties)


def rollup_tables(star: Star) -> dict[str, DataFrame]:
    """The roll-ups of a star by name."""
    return {"by_npi": star.rollup("npi"), "by_code": star.rollup("hcpcs_cd"), "by_specialty_code": star.specialty_codes()}
