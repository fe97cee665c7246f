"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Byte triplets taken at the spacings ``TRIPLETS`` are hashed into ``BUCKETS``
counters; each counter is written as its quartile (two bits), preceded by the
length on a logarithmic scale. Two digests differ by the summed quartile steps
(a full step counts double) plus the length steps; the difference is divided
by its bound, so likeness runs from 0 to 1.

``with_next`` pairs every document with the one that follows it in descending
id order, without a global window: ids alone give range bounds and each range's
first id, documents go to their range (the first of a range also to the range
before it), and each range is streamed in sorted order, one document held at a
time.

Defined results: null text counts as empty; an empty text has the digest of no
triplets and is like another such text; equal texts have equal digests; rows
with the same id follow each other by text; a null id comes last; one document
follows itself; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
TRIPLETS = ((0, 3, 7), (0, 5, 9))
_rng = np.random.default_rng(411)
_TABLES = [[_rng.integers(0, BUCKETS, 256).astype(np.uint16) for _ in range(3)] for _ in TRIPLETS]
_STEP = np.array([0, 1, 2, 6], np.int64)
LENGTH_BASE, LENGTH_STEP = 1.3, BUCKETS / 64
BOUND = 3.0 * BUCKETS
#: Text bytes that one range of ids should hold; ranges that smaller tables get,
#: if each holds SMALL_RANGE_BYTES, to keep the cluster busy.
RANGE_BYTES, SMALL_RANGES, SMALL_RANGE_BYTES = 256 << 20, 200, 8 << 20
PORTION_BYTES = 2 << 20


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of quartile codes for each text, its length code last."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.zeros(n * BUCKETS, np.int64)
    for (_, second, third), (a, b, c) in zip(TRIPLETS, _TABLES):
        m = len(data) - third
        if m <= 0:
            continue
        h = a[data[:m]] * np.uint16(3) + b[data[second:second + m]] * np.uint16(5) + c[data[third:third + m]]
        inside = row[:m] == row[third:third + m]
        counts += np.bincount(row[:m][inside] * BUCKETS + (h[inside] % BUCKETS), minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    codes = np.zeros((n, BUCKETS + 1), np.uint8)
    for k in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
        codes[:, :-1] += counts > q[:, k:k + 1]
    codes[:, -1] = np.minimum(255, np.log1p(np.diff(off)) / np.log(LENGTH_BASE)).astype(np.uint8)
    return codes


def to_hex(codes: np.ndarray) -> list[str]:
    """Length code, then four buckets a byte."""
    body = codes[:, :-1].reshape(len(codes), BUCKETS // 4, 4)
    packed = body[..., 0] | body[..., 1] << 2 | body[..., 2] << 4 | body[..., 3] << 6
    return [f"{int(c[-1]):02x}{p.tobytes().hex()}" for c, p in zip(codes, packed.astype(np.uint8))]


def from_hex(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    body = np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()
    return np.append(body, raw[0]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the bound on; rows of codes against rows of codes."""
    d = np.abs(a.astype(np.int64) - b.astype(np.int64))
    score = _STEP[d[..., :-1]].sum(axis=-1) + d[..., -1] * LENGTH_STEP
    return 1.0 - np.minimum(1.0, score / BOUND)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and digest of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi in _portions([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]):
                texts = [(x.as_py() or "").encode() for x in batch.column(1)[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(to_hex(digests(texts)))],
                                                 ["key", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", id_col)


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        total += s
        if total >= PORTION_BYTES or i - lo >= 2000:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


_LAST = -(2**63)  # where a null id sorts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows in ranges of descending ids, ready to be streamed: (part, after, key, text).

    ``after`` marks the copy of the next range's first document at a range's end.
    """
    key = F.coalesce(docs[id_col].cast("bigint"), F.lit(_LAST))
    rows = docs.select(key.alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = max(1, -(-size // range_bytes), min(SMALL_RANGES, size // SMALL_RANGE_BYTES))
    cuts = sorted(set(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:  # ranges numbered from the highest ids down
        return pd.Series((len(cuts) - np.searchsorted(cuts, k.to_numpy(), "left")).astype(np.int32))

    # a few numbers for each range: its first key
    first = {r["part"]: r["key"] for r in rows.select("key").groupBy(part_of("key").alias("part")).agg(F.max("key").alias("key")).collect()}
    parts = sorted(first)
    before = {first[p]: parts[i - 1] for i, p in enumerate(parts)}  # the first range follows the last

    @F.pandas_udf("int")
    def also_to(k: pd.Series) -> pd.Series:
        return k.map(before).astype("Int32")

    dest = F.array(F.struct(part_of("key").alias("part"), F.lit(False).alias("after")),
                   F.struct(F.col("also").alias("part"), F.lit(True).alias("after")))
    return rows.withColumn("also", also_to("key")).withColumn("dest", F.explode(dest)) \
        .where("dest.part is not null").select("dest.part", "dest.after", "key", "text") \
        .repartition(max(1, len(parts)), "part") \
        .sortWithinPartitions("part", "after", F.desc("key"), "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document against its edited text and the next document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, key, text, digest) of the row before, if it still waits for its next document
        for batch in it:
            col = batch.column(3)
            for lo, hi in _portions([len(x.as_buffer()) for x in col]):
                texts = [x.as_py() for x in col[lo:hi]]
                codes = digests([t.encode() for t in texts])
                meta = zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), batch.column(2)[lo:hi].to_pylist())
                ids, own, edited, mine, nexts = [], [], [], [], []
                for (part, after, key), text, code in zip(meta, texts, codes):
                    if held is not None and held[0] == part:
                        k = len(held[2]) // 3
                        ids.append(None if held[1] == _LAST else held[1])
                        own.append(held[2])
                        edited.append((held[2][:len(held[2]) - k] + text[:k]).encode())
                        mine.append(held[3])
                        nexts.append(code)
                    held = None if after else (part, key, text, code)
                if not ids:
                    continue
                a, b, e = np.array(mine), np.array(nexts), digests(edited)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(to_hex(a)), pa.array(to_hex(e)),
                     pa.array(likeness(a, e)), pa.array(likeness(a, b))],
                    ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, id_col, text_col, range_bytes).mapInArrow(
        run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double").withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
