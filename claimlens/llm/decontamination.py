"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item. Each window is
represented by the smallest hash of its ``GRAM``-word grams (the winnowing
fingerprint): a document that shares a whole window shares its fingerprint, so
every shared span of ``WINDOW`` words or more is found. Documents are winnowed
the same way; where a document fingerprint meets a benchmark fingerprint, the
hit is extended: the windows around that gram are compared whole, and every
word of an equal window is hit.

Documents are read once and never shuffled. The benchmark side is cut into
blocks of at most ``max_windows`` rows (counted, not assumed); each block is
broadcast and one pass per block merges its hits, so a benchmark of any size
is handled with bounded memory.

Defined results: null or wordless text has no words and no hits; an item with
no words, or with a null id, is no item; an item shorter than a window is one
window; equal item ids count once; windows occurring in several items count
for each; repeated rows are answered row by row; an empty benchmark hits
nothing. Extra columns are ignored (``hits``) or kept (``remove_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import textblocks as tb

WINDOW, GRAM = 10, 5
#: Benchmark windows held by one task at a time (about 40 bytes each).
MAX_WINDOWS = 1_000_000

SPANS = "array<struct<start:bigint,end:bigint>>"


def _fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """For each window of n words, the smallest hash of its grams."""
    k = min(GRAM, n)
    g = tb.grams(h, k)
    m = len(h) - n + 1
    out = g[:m].copy()
    for i in range(1, n - k + 1):
        np.minimum(out, g[i:i + m], out=out)
    return out


def _window_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Item rows -> one row per distinct window of each item."""
    for batch in it:
        ids = batch.column(0)
        for b in tb.blocks(batch.column(1)):
            w = tb.words(b, tb.ALNUM)
            for i in range(b.hi - b.lo):
                h = w.hash[w.first[i]:w.first[i + 1]]
                if not len(h):
                    continue
                n = min(WINDOW, len(h))
                win, at = np.unique(tb.grams(h, n), return_index=True)
                fp = _fingerprints(h, n)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(win), n)), pa.array(win.view(np.int64)), pa.array(fp.view(np.int64)),
                     pa.array([ids[b.lo + i].as_py()] * len(win), pa.string())], ["n", "win", "fp", "item"])


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n words, window hash, fingerprint, item id) of every item window."""
    items = bench.select(bench[item_col].cast("string").alias("item"), bench[text_col].alias("text")).where("item is not null")
    return items.mapInArrow(_window_rows, "n bigint, win bigint, fp bigint, item string").distinct()


class _Table:
    """Windows of one block, by window length: sorted fingerprints, sorted
    window hashes and the items of each (several rows where items share one)."""

    def __init__(self, rows: pa.Table):
        n, win, fp = (rows.column(c).to_numpy() for c in ("n", "win", "fp"))
        self.items = np.array(rows.column("item").to_pylist(), dtype=object)
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            order = at[np.argsort(win[at].view(np.uint64), kind="stable")]
            self.by[int(k)] = (np.unique(fp[at].view(np.uint64)), win[order].view(np.uint64), order)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, set]:
        """Mask of hit words and the items found."""
        hit, found = np.zeros(len(h) + 1, np.int64), set()
        for n, (fps, wins, order) in self.by.items():
            if len(h) < n:
                continue
            f = _fingerprints(h, n)
            new = np.ones(len(f), bool)
            new[1:] = f[1:] != f[:-1]
            runs = np.flatnonzero(new)
            pos = np.searchsorted(fps, f[runs])
            met = fps[np.minimum(pos, len(fps) - 1)] == f[runs]
            if not met.any():
                continue
            # extend: compare whole windows wherever the fingerprint is the benchmark's
            ends = np.append(runs[1:], len(f))[met]
            lens = ends - runs[met]
            at = np.repeat(runs[met], lens) + tb.spread(lens)
            wh = tb.grams(h, n)[at]
            lo, hi = np.searchsorted(wins, wh, "left"), np.searchsorted(wins, wh, "right")
            ok = hi > lo
            np.add.at(hit, at[ok], 1)
            np.add.at(hit, at[ok] + n, -1)
            for a, z in {*zip(lo[ok].tolist(), hi[ok].tolist())}:
                found.update(self.items[order[a:z]].tolist())
        return np.cumsum(hit[:-1]) > 0, found


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2])]


def _scan(table_bc, earlier: bool):
    """Pass over documents: (id, text[, n_words, spans, items]) -> the same with this block's hits merged."""
    kept: list = []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Table(table_bc.value))
        table = kept[0]
        for batch in it:
            counts, spans, items = [], [], []
            for b in tb.blocks(batch.column(1)):
                w = tb.words(b, tb.ALNUM)
                for i in range(b.hi - b.lo):
                    h = w.hash[w.first[i]:w.first[i + 1]]
                    mask, found = table.hits(h)
                    if earlier:
                        for s in batch.column(3)[b.lo + i].as_py():
                            mask[s["start"]:s["end"]] = True
                        found.update(batch.column(4)[b.lo + i].as_py())
                    counts.append(len(h))
                    spans.append(_spans(mask) if mask.any() else [])
                    items.append(sorted(found))
            span_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(spans, span_t), pa.array(items, pa.list_(pa.string()))],
                ["key", "text", "n_words", "spans", "items"])

    return run


def _tables(bench: DataFrame, max_windows: int) -> list:
    """The benchmark windows in broadcast blocks; equal windows are in one block (cut by hash)."""
    windows = benchmark_windows(bench)
    n = max(1, -(-windows.count() // max_windows))
    rows = windows.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(n)))
    sc = bench.sparkSession.sparkContext
    return [sc.broadcast(rows.where(F.col("block") == i).drop("block").toArrow()) for i in range(n)]


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document row: id, n_words, hit word spans, item ids (sorted)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    schema = f"key {kind}, text string, n_words bigint, spans {SPANS}, items array<string>"
    for i, table in enumerate(_tables(bench, max_windows)):
        out = out.mapInArrow(_scan(table, i > 0), schema)
    return out.drop("text").withColumnRenamed("key", id_col)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The document rows without any hit word, all columns kept, one pass for each block."""
    at = docs.columns.index(text_col)

    def keep(table_bc):
        made: list = []

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(_Table(table_bc.value))
            for batch in it:
                clean = []
                for b in tb.blocks(batch.column(at)):
                    w = tb.words(b, tb.ALNUM)
                    clean += [not made[0].hits(w.hash[w.first[i]:w.first[i + 1]])[0].any() for i in range(b.hi - b.lo)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for table in _tables(bench, max_windows):
        out = out.mapInArrow(keep(table), docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
lens as (select distinct n from bw),
dw as (
  select doc_id, i, lens.n as n, array_to_string(w[i:i + lens.n - 1], ' ') as win
  from d, lens, unnest(range(1, len(w) - lens.n + 2)) as u(i) where len(w) >= lens.n),
m as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.win = bw.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
