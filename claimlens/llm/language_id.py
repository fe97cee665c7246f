"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased (ASCII), everything but letters becomes a blank, and its
2- to 4-byte subwords (blanks mark word ends) are hashed into ``BUCKETS``
rows of an embedding table; the mean embedding goes through a linear softmax.
Table and softmax are trained by stochastic gradient descent in numpy on a
bounded, content-hashed sample of at most about ``PER_LANGUAGE`` documents of
each language and ``MAX_SAMPLE`` in all, at least about one of each (whole texts and short spans of them, so that short texts are
calibrated too). A fifth of the sample fits the temperature and the rejection
threshold. Scoring is one pass over all whole texts: mean and softmax are
linear, so each bucket's contribution to the logits is one small row.

Defined results: null text, or text without any letter, is ``und`` with score
0 and rejected; with no labelled rows everything is ``und``; ties go to the
first language in sorted order; every label is learned, however many; repeated rows are answered row by row; a null id counts as
held out. Extra columns are ignored (``predict``) or kept (``keep_known``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm import textblocks as tb
from claimlens.llm.scratch import drop_worker_caches

BITS, DIM, SIZES = 18, 16, (2, 3, 4)
#: Many more buckets than subwords of the learned languages, so that unknown subwords seldom fall on known ones.
BUCKETS = 1 << BITS
#: Bounds of the training sample: documents of a language, and of all of them.
PER_LANGUAGE, MAX_SAMPLE = 300, 60_000
SPANS = (1, 2, 4, 8, 20, 60)  # words of the short training spans
EPOCHS, RATE = 6, 0.5
#: A row of the table moves only when its subword occurs, so its step is this much longer.
SPARSE_GAIN = 8
#: Share of held-out training documents that the rejection threshold may cost.
REJECTED_SHARE, MAX_THRESHOLD = 0.001, 0.4
#: Text bytes scored at once; each takes about 50 bytes of work space.
SCORED_BYTES = 1 << 19
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def held_out(id_col: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(True))


def subwords(low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size n, the bucket at every position (BUCKETS where no letter is covered)."""
    letter = low != 32
    x = low.astype(np.uint32) + np.uint32(1)
    for n in SIZES:
        m = len(low) - n + 1
        if m <= 0:
            yield n, np.zeros(0, np.int64)
            continue
        h = np.full(m, n, np.uint32)
        some = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ x[i:i + m]) * _MUL[i]
            some |= letter[i:i + m]
        h ^= h >> np.uint32(15)
        out = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64)
        out[~some] = BUCKETS
        yield n, out


def bag(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their share of its subwords."""
    got = np.concatenate([h for _, h in subwords(low)])
    got, count = np.unique(got[got < BUCKETS], return_counts=True)
    return got, count / max(1, count.sum())


def _sample_bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, lang, text) -> bags of the whole text and of short spans, each deflated: steps from bucket to bucket, then shares."""
    for batch in it:
        rows = {"seed": [], "lang": [], "words": [], "size": [], "bag": []}
        for b in tb.blocks(batch.column(2)):
            for i in range(b.hi - b.lo):
                low = _LETTER[b.data[b.off[i]:b.off[i + 1]]]
                begin = np.flatnonzero((low != 32) & (np.concatenate([[32], low[:-1]]) == 32))
                if not len(begin):
                    continue
                seed = batch.column(0)[b.lo + i].as_py()
                parts = [(len(begin), low)]
                for n in SPANS:
                    if n < len(begin):
                        at = (seed * 31 + n * 7919) % (len(begin) - n)
                        parts.append((n, low[begin[at]:begin[at + n]]))
                for n, part in parts:
                    bucket, share = bag(part)
                    packed = zlib.compress(np.diff(bucket, prepend=0).astype(np.int32).tobytes() + share.astype(np.float32).tobytes(), 1)
                    for k, v in zip(rows, (seed, batch.column(1)[b.lo + i].as_py(), n, len(bucket), packed)):
                        rows[k].append(v)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS+1 rows: each bucket's part of the calibrated logits, and 1 if it was trained; the last row is zero
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(langs: list[str], bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, calibrate: np.ndarray,
          whole: np.ndarray) -> Model:
    """Embedding and softmax by SGD on the rows that are not for calibration.

    There is no bias, and the share of subwords that were never trained counts as
    equal shares of the languages: a text of unknown subwords is rejected.
    """
    rng = np.random.default_rng(7)
    k = len(langs)
    emb = np.zeros((BUCKETS + 1, DIM), np.float32)
    out = rng.normal(0, 1, (DIM, k)).astype(np.float32)
    fit = np.flatnonzero(~calibrate) if (~calibrate).any() else np.arange(len(y))
    weight = 1.0 / np.maximum(1, np.bincount(y[fit], minlength=k))
    weight = weight / weight[y[fit]].mean()
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            b, s = bags[i]
            x = s @ emb[b]
            g = _softmax(x @ out)
            g[y[i]] -= 1
            g *= rate * weight[y[i]]
            back = out @ g
            out -= np.outer(x, g)
            emb[b] -= np.outer(s, back) * SPARSE_GAIN
    table = emb @ out
    known = (table != 0).any(axis=1)
    logits, seen = np.stack([s @ table[b] for b, s in bags]), np.array([s @ known[b] for b, s in bags])
    cal = np.flatnonzero(calibrate) if calibrate.any() else np.arange(len(y))
    loss = {t: -np.log(np.maximum(_softmax(logits[cal] / t)[np.arange(len(cal)), y[cal]], 1e-9)).mean()
            for t in (0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    t = min(loss, key=loss.get)
    top = (seen[cal] * _softmax(logits[cal] / t).max(axis=1) + (1 - seen[cal]) / k)[whole[cal]]
    threshold = min(MAX_THRESHOLD, float(np.quantile(top, REJECTED_SHARE))) if len(top) else 0.0
    return Model(langs, np.column_stack([table / t, known]).astype(np.float32), threshold * 0.999)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the rows given (the caller leaves held-out rows out)."""
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counts = rows.groupBy(rows[lang_col].alias("lang")).count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), 0.0)
    # a row is in the sample if its hash falls under its language's share
    per_language = max(1.0, min(PER_LANGUAGE, MAX_SAMPLE / len(counts)))
    key = F.xxhash64(rows[id_col].cast("string"), F.lit(17))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    picked = rows.where(F.pmod(key, F.lit(1_000_003)) < share[rows[lang_col]] * 1_000_003)
    got = picked.select(F.shiftrightunsigned(key, 1).alias("seed"), rows[lang_col].alias("lang"), rows[text_col].alias("text")) \
        .mapInArrow(_sample_bags, "seed bigint, lang string, words bigint, size bigint, bag binary") \
        .toArrow()
    if not got.num_rows:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), 0.0)
    # only the small columns are sorted; the bags stay in the order they came
    keys = got.select(["seed", "lang", "words"])
    order = pc.sort_indices(keys, sort_keys=[("seed", "ascending"), ("lang", "ascending"), ("words", "ascending")])
    keys = keys.take(order)
    names, seed = keys["lang"].to_pylist(), keys["seed"].to_numpy()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    y = np.array([place[x] for x in names])
    bags = _slices(_inflated(got))
    bags = [bags[i] for i in order.to_numpy()]
    last = np.append(seed[1:] != seed[:-1], True)  # the whole text is the longest part of its row
    model = train(langs, bags, y, (seed // 8) % 5 == 0, last)
    del got, keys, bags
    pa.default_memory_pool().release_unused()  # the driver lives on: the sample's memory goes back
    return model


def _inflated(got: pa.Table) -> pa.Table:
    """Lists bucket and share of the deflated bags."""
    size = got["size"].to_numpy()
    end = np.cumsum(size)
    bucket, share = np.empty(size.sum(), np.int32), np.empty(size.sum(), np.float32)
    for packed, a, z in zip(got["bag"], end - size, end):
        raw = zlib.decompress(packed.as_py())
        bucket[a:z] = np.cumsum(np.frombuffer(raw, np.int32, z - a))
        share[a:z] = np.frombuffer(raw, np.float32, z - a, 4 * (z - a))
    off = pa.array(np.append(0, end))
    return pa.table({"bucket": pa.LargeListArray.from_arrays(off, pa.array(bucket)), "share": pa.LargeListArray.from_arrays(off, pa.array(share))})


def _slices(got: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each row, without a copy."""
    out = []
    for b in got.to_batches():
        bucket, share = b.column("bucket"), b.column("share")
        off, at = bucket.offsets.to_numpy(), share.offsets.to_numpy()
        bucket, share = bucket.values.to_numpy(), share.values.to_numpy()
        out += [(bucket[a:z], share[c:e]) for a, z, c, e in zip(off[:-1], off[1:], at[:-1], at[1:])]
    return out


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a letter: ASCII ones by byte class, the rest by Unicode category."""
    n = len(off) - 1
    out = np.zeros(n, bool)
    if not len(data):
        return out
    ascii_letter = np.concatenate([[0], np.cumsum((_LETTER[data] != 32) & (data < 128))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    out = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~out & (high[off[1:]] > high[off[:-1]])):
        out[i] = any(c.isalpha() for c in data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def score_block(m: Model, b: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: none) and calibrated probability for each row of a block."""
    n, k = len(b.off) - 1, len(m.languages)
    known = _has_letter(b.data, b.off) & b.valid
    if not k or not len(b.data):
        return np.full(n, -1), np.zeros(n)
    total, count = np.zeros((n, k + 1)), np.zeros(n)
    for size, h in subwords(_LETTER[b.data]):
        a, z = b.off[:-1], b.off[1:] - size + 1
        rows = np.flatnonzero(z > a)
        if not len(rows):
            continue
        # reduceat over [a, z) of each row; what lies between rows is dropped
        cut = np.stack([a[rows], z[rows]], axis=1).ravel()
        cut = cut[:-1] if cut[-1] >= len(h) else cut
        total[rows] += np.add.reduceat(m.table[h], cut, axis=0, dtype=np.float64)[::2]
        count[rows] += np.add.reduceat((h < BUCKETS).astype(np.int64), cut)[::2]
    mean = total / np.maximum(1, count)[:, None]
    p = mean[:, k:] * _softmax(mean[:, :k]) + (1 - mean[:, k:]) / k
    best = p.argmax(axis=1)
    return np.where(known, best, -1), np.where(known, p[np.arange(n), best], 0.0)


def predict(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in it:
            lang, score = [], []
            for b in tb.blocks(batch.column(1), SCORED_BYTES):
                i, p = score_block(model, b)
                lang.extend(names[i])
                score.extend(p.tolist())
            rejected = [x == UNKNOWN or s < model.threshold for x, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", id_col)


def keep_known(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is not rejected, all columns kept, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        model = shared.value
        for batch in it:
            keep = [np.zeros(0, bool)]
            for b in tb.blocks(batch.column(at), SCORED_BYTES):
                i, p = score_block(model, b)
                keep.append((i >= 0) & (p >= model.threshold))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    m = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, m).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
