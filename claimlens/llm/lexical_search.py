"""Ranked lexical search with per-term geometric blocking.

Every document becomes a sparse vector of integer impacts over the terms of the
queries. A task indexes its vectors in chunks: documents are clustered by the
most similar of ``PIVOTS`` pivot vectors, each term's posting list is cut into
blocks of similar documents, and a block keeps the coordinatewise maximum of its
vectors. A query walks its lists from the highest peak impact down; the sum of a
block's summary over the query's terms bounds every score in it, so a block is
skipped only where that bound is below the query's current k-th score, and the
walk ends where the peaks of the remaining lists together are. Impacts and
bounds are integers: nothing is approximate. A list's blocks are built when a
query first reaches the list.

Each task carries the k best of each query through all its chunks and returns
at most k rows a query; a window over those rows is the answer. Documents are
never shuffled. The queries are cut into blocks of about ``MAX_TERMS`` (query,
term) pairs, counted in Spark; one block is broadcast at a time.

The score is integer arithmetic after one floor of a logarithm (see
:func:`weight` and :class:`Chunk`).

Defined results: a null, empty or termless text is no document of the
statistics and matches nothing; a query without terms, or without a matching
document, has no rows; repeated document rows are ranked each, a null doc_id
last among equal scores; repeated query rows are answered once each under
their item_id; equal scores rank by doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

#: (query, term) pairs broadcast at a time, about 60 bytes each.
MAX_TERMS = 500_000
#: Postings of a chunk, documents of a block, pivots of a chunk.
CHUNK_POSTINGS, BLOCK_DOCS, PIVOTS = 1_000_000, 64, 32
TOP = 10

# Separators of terms and the constants of the score.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
SCALE, SLOPE, TF_UNIT, LENGTH_UNIT = 1_000_000_000, 90, 1000, 8


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


# -- queries ------------------------------------------------------------------

def _query_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found = [sorted(set(terms_of(t))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])


class Queries:
    """One block of queries: item ids, and their terms as positions in a vocabulary."""

    def __init__(self, rows: list):
        self.items = [r[0] for r in rows]
        vocab: dict[bytes, int] = {}
        self.terms = [np.array([vocab.setdefault(bytes(t), len(vocab)) for t in r[1]], np.int64) for r in rows]
        self.vocab = vocab
        self.weights = np.zeros(len(vocab), np.int64)


# -- document vectors ---------------------------------------------------------

VECTORS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def _vectors(queries):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = queries.value.vocab.get
        for batch in it:
            n, sizes, idx, tf = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                found = Counter([i for i in map(get, words) if i is not None])
                n.append(len(words))
                sizes.append(len(found))
                idx.extend(found.keys())
                tf.extend(found.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists(np.array(idx, np.int32), sizes, pa.int32()),
                 _lists(np.array(tf, np.int32), sizes, pa.int32())], ["doc_id", "n", "terms", "tfs"])

    return run


# -- index of a chunk ---------------------------------------------------------

class Blocks:
    """Blocks of one posting list: documents of block i are ``docs[cut[i]:cut[i+1]]``,
    its summary ``term/peak[start[i]:start[i+1]]``."""

    def __init__(self, docs, cut, term, peak, start):
        self.docs, self.cut, self.term, self.peak, self.start = docs, cut, term, peak, start


class Chunk:
    """Vectors of a chunk of documents, their clusters and their blocked posting lists.

    An impact is ``w * ((SCALE * tf) // (TF_UNIT * tf + LENGTH_UNIT * m))`` with
    ``m = 100 - SLOPE + (SLOPE * n * N) // L``.
    """

    def __init__(self, ids, null, n, sizes, terms, tfs, weights, n_docs: int, length: int):
        self.ids, self.null = ids, null
        m = (100 - SLOPE) + (SLOPE * n * n_docs) // length
        rows = np.repeat(np.arange(len(n)), sizes)
        tf = tfs.astype(np.int64)
        impact = weights[terms] * ((SCALE * tf) // (TF_UNIT * tf + LENGTH_UNIT * m[rows]))
        self.local = np.full(len(weights), -1, np.int64)
        present = np.unique(terms)
        self.local[present] = np.arange(len(present))
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.impact = self.local[terms], impact
        order = np.argsort(self.term, kind="stable")
        self.list_docs = rows[order]
        self.list_off = np.searchsorted(self.term[order], np.arange(len(present) + 1))
        self.peak = np.maximum.reduceat(impact[order], self.list_off[:-1]) if len(present) else np.zeros(0, np.int64)
        self.cluster, self.likeness = self._clusters(len(present))
        self.blocks: dict[int, Blocks] = {}
        self.scored = self.skipped = 0

    def _rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of some documents, and the count of each."""
        counts = self.off[docs + 1] - self.off[docs]
        ends = np.cumsum(counts)
        return np.repeat(self.off[docs] - ends + counts, counts) + np.arange(int(counts.sum())), counts

    def _clusters(self, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each document by inner product of unit vectors, and that product."""
        n = len(self.ids)
        norm = np.zeros(n)
        filled = np.flatnonzero(np.diff(self.off))
        value = self.impact.astype(np.float64)
        if len(filled):
            norm[filled] = np.sqrt(np.add.reduceat(value * value, self.off[filled]))
        unit = (value / np.maximum(np.repeat(norm, np.diff(self.off)), 1e-9)).astype(np.float32)
        pivots = filled[np.linspace(0, len(filled) - 1, min(PIVOTS, len(filled))).astype(int)] if len(filled) else filled
        cluster, likeness = np.zeros(n, np.int64), np.zeros(n, np.float32)
        if not len(pivots):
            return cluster, likeness
        table = np.zeros((n_terms, len(pivots)), np.float32)
        for j, d in enumerate(pivots):
            table[self.term[self.off[d]:self.off[d + 1]], j] = unit[self.off[d]:self.off[d + 1]]
        step = 100_000  # entries at a time
        lo = 0
        while lo < len(filled):
            hi = max(lo + 1, int(np.searchsorted(self.off[filled], self.off[filled[lo]] + step)))
            a, z = self.off[filled[lo]], self.off[filled[min(hi, len(filled)) - 1] + 1]
            dots = np.add.reduceat(table[self.term[a:z]] * unit[a:z, None], self.off[filled[lo:hi]] - a)
            cluster[filled[lo:hi]] = dots.argmax(1)
            likeness[filled[lo:hi]] = dots.max(1)
            lo = hi
        return cluster, likeness

    def blocked(self, t: int) -> Blocks:
        """The blocks of list ``t``: runs of at most ``BLOCK_DOCS`` documents of one cluster, most alike first."""
        if t not in self.blocks:
            docs = self.list_docs[self.list_off[t]:self.list_off[t + 1]]
            docs = docs[np.lexsort((-self.likeness[docs], self.cluster[docs]))]
            new = np.ones(len(docs), bool)
            new[1:] = self.cluster[docs][1:] != self.cluster[docs][:-1]
            run = np.flatnonzero(new)
            inside = np.arange(len(docs)) - np.repeat(run, np.diff(np.append(run, len(docs))))
            cut = np.flatnonzero(inside % BLOCK_DOCS == 0)
            block = np.cumsum(inside % BLOCK_DOCS == 0) - 1
            at, counts = self._rows(docs)
            key = np.repeat(block, counts) * len(self.peak) + self.term[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            peak = np.maximum.reduceat(self.impact[at][order], first)
            key = key[first]
            start = np.searchsorted(key, np.arange(len(cut)) * len(self.peak))
            self.blocks[t] = Blocks(docs, np.append(cut, len(docs)), key % len(self.peak), peak, start)
        return self.blocks[t]

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Merge the documents of this chunk that can be among a query's best."""
        mine = self.local[terms]
        mine = mine[mine >= 0]
        mine = mine[np.argsort(-self.peak[mine], kind="stable")]
        rest = np.cumsum(self.peak[mine][::-1])[::-1]
        if not len(mine) or rest[0] < best.needed():
            return
        wanted = np.zeros(len(self.peak), np.int64)
        wanted[mine] = 1
        seen = np.zeros(len(self.ids), bool)
        for t, left in zip(mine, rest):
            if left < best.needed():
                break  # documents met only from here on stay below
            b = self.blocked(int(t))
            bound = np.add.reduceat(b.peak * wanted[b.term], b.start)
            order = np.argsort(-bound, kind="stable")
            at, width = 0, 1
            while at < len(order) and bound[order[at]] >= best.needed():
                group = order[at:at + width]
                group = group[bound[group] >= best.needed()]
                docs = np.concatenate([b.docs[b.cut[g]:b.cut[g + 1]] for g in group])
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    e, counts = self._rows(docs)
                    score = np.add.reduceat(self.impact[e] * wanted[self.term[e]], np.cumsum(counts) - counts)
                    best.add(score, self.ids[docs], self.null[docs])
                self.scored += len(group)
                at, width = at + len(group), min(2 * width, 32)
            self.skipped += len(order) - at


class Best:
    """The k best (score, doc_id) of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def needed(self) -> int:
        """A score below this changes nothing."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score, ids, null) -> None:
        ok = score >= self.needed()
        if not ok.any():
            return
        score, ids, null = (np.concatenate([a, b[ok]]) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def _search(queries, n_docs: int, length: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = [Best(k) for _ in q.items]
        held, size = [], 0

        def answer():
            parts = [np.concatenate(c) for c in zip(*held)]
            chunk = Chunk(*parts, q.weights, n_docs, length)
            for terms, b in zip(q.terms, best):
                chunk.search(terms, b)

        for batch in it:
            ids, terms, tfs = batch.column(0), batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), batch.column(1).to_numpy(),
                         sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            size += int(sizes.sum())
            if size >= CHUNK_POSTINGS:
                answer()
                held, size = [], 0
        if held:
            answer()
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), i)), pa.array(b.ids, mask=b.null), pa.array(b.score)], ["q", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", k: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of every query row."""
    spark = docs.sparkSession
    item_type = queries.schema[item_col].dataType.simpleString()
    asked = queries.select(queries[item_col].alias("item"), queries[query_col].cast("string").alias("text"))
    asked = asked.mapInArrow(_query_terms, f"item {item_type}, terms array<binary>").where(F.size("terms") > 0)
    asked = written(asked.select(F.uuid().alias("row"), "item", "terms"), "search-queries")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-pairs // max_terms))
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for i in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == i).select("item", "terms").collect()  # about max_terms pairs
        block = Queries(rows)
        sent = spark.sparkContext.broadcast(block)
        vectors = written(texts.mapInArrow(_vectors(sent), VECTORS), "search-vectors")
        n_docs, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        for t, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            block.weights[t] = weight(n_docs, df)
        ready = spark.sparkContext.broadcast(block)
        kind = "q bigint, doc_id bigint, score bigint"
        found = vectors.where(F.size("terms") > 0).mapInArrow(_search(ready, int(n_docs or 0), int(length or 0), k), kind)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"q bigint, item {item_type}")  # the block's items
        part = written(ranked.join(names, "q").select(F.col("item").alias(item_col), "rank", "doc_id", "score"), "search-results")
        sent.unpersist()
        ready.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
q as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
tf as (select r, doc_id, t, count(*) as tf from d group by all),
n as (select r, cast(sum(tf) as bigint) as n from tf group by r),
tot as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from n),
w as (select t, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from tf, tot group by t, big_n),
s as (
  select item_id, tf.r, tf.doc_id, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * big_n) // big_l)))) as bigint) as score
  from q join tf on q.t = tf.t join w on w.t = q.t join n on n.r = tf.r, tot group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
