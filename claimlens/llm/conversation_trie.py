"""Prefix trie of conversations from sorted paths, LCPs and range minima.

A conversation's path is the chain of its turn digests: entry d is a 128-bit
digest of the first d turns, so two conversations share their first d turns
exactly if entry d of their paths is equal, and the common prefix of neighbours
in path order is their LCP. Equal paths are one class (with its member count).

Classes are range-sorted by path and cut into blocks of bounded size. In a
block, a sparse table of minima over the LCPs answers range minima; every
candidate prefix (a class and a depth that starts there) binary-searches its
left and its right extent on that table, independently of all others, and the
interval between them is the node's members. Counts, leaves and saved tokens
are differences of prefix sums over that interval, the smallest member is a
range minimum, children are counted at the left extent of each class's LCP.

A node whose interval meets neither edge of its block is complete. The prefixes
of a block's first and last class ("edge nodes", at most two paths a block) are
sums over blocks, corrected where one block counted what another counts too: a
node that continues from an earlier block (its text, and itself as a child) and
a last class that a later block extends (no leaf). A first turn, or a whole
conversation, shared by a third of all rows is thus spread over blocks; only
the digest of a class's ids, which is sequential, is one stream of joined ids.

Defined results: null role and null text are empty; turns are ordered by turn
(null first), equal turns by the digest of role and text (repeated rows are
turns of their own); rows with a null conv_id belong to no conversation; an
empty table has no nodes, not even a root. Extra columns are ignored. A
conversation is held as 20 bytes for each of its turns, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

KEY = 16  # bytes of a digest
#: Ids joined in one piece of a class; turns and classes of a block.
PIECE_IDS, BLOCK_TURNS, BLOCK_CLASSES = 4096, 400_000, 100_000
#: Conversations of one hundred share the first turns of the first of them.
FAMILY, HEADS = 100, 6

ROOT_ENDS = hashlib.sha256(b"").hexdigest()


# -- rebuilt conversations ----------------------------------------------------

def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest of role and text, code points of the text)."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    packed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"),
                        F.unhex(F.left(F.sha2(packed, 256), F.lit(2 * KEY))).alias("digest"),
                        F.length(text).alias("chars")).where("conv_id is not null")


def _rows(it: Iterator[pa.RecordBatch]):
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows, schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += weight(r)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


_PATHS = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("chars", pa.binary())])


def _path(turns: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    at, path = b"", []
    for digest, _ in turns:
        at = hashlib.sha256(at + digest).digest()[:KEY]
        path.append(at)
    return b"".join(path), np.array([c for _, c in turns], np.int32).tobytes()


def _rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by (family, its first conversation first, conversation, turn) -> rebuilt paths."""
    def conversations():
        family, heads, now, turns, take = None, [], None, [], 0
        for base, conv, h, digest, chars in _rows(it):
            if conv != now:
                if now is not None:
                    yield now, heads[:take] + turns[take:]
                now, turns, take = conv, [], h
                if base != family:
                    family, heads = base, []
            turns.append((digest, chars))
            if conv == base and len(heads) < HEADS:
                heads.append((digest, chars))
        if now is not None:
            yield now, heads[:take] + turns[take:]

    def rows():
        for conv, turns in conversations():
            path, chars = _path(turns)
            yield path, conv, chars

    yield from _batches(rows(), _PATHS, lambda r: len(r[0]) + len(r[2]) + 40)


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(path, conv_id, chars) of every conversation c: the first h turns of conversation
    c - c % 100, then c's own turns behind its first h; h = crc32 of c's decimal mod 6."""
    c = F.col("conv_id")
    rows = turn_rows(turns).select((c - c % FAMILY).alias("base"), "conv_id", F.pmod(F.crc32(c.cast("string")), F.lit(HEADS)).cast("int").alias("h"),
                                   "turn", "digest", "chars")
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return rows.select("base", "conv_id", "h", "digest", "chars").mapInArrow(_rebuild, "path binary, conv_id bigint, chars binary")


def plain_paths(turns: DataFrame) -> DataFrame:
    """(path, conv_id, chars) of every conversation as it is."""
    c = F.col("conv_id")
    rows = turn_rows(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return rows.select(c.alias("base"), "conv_id", F.lit(0).alias("h"), "digest", "chars").mapInArrow(_rebuild, "path binary, conv_id bigint, chars binary")


# -- classes of equal paths ---------------------------------------------------

_PIECES = pa.schema([("path", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("ids", pa.string())])
_CLASSES = pa.schema([("path", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        now, chars, ids = None, None, []
        for path, conv, c in _rows(it):
            if path != now or len(ids) >= PIECE_IDS:
                if ids:
                    yield now, chars, len(ids), ids[0], ",".join(map(str, ids))
                now, chars, ids = path, c, []
            ids.append(conv)
        if ids:
            yield now, chars, len(ids), ids[0], ",".join(map(str, ids))

    yield from _batches(rows(), _PIECES, lambda r: len(r[0]) + len(r[1]) + len(r[4]) + 40)


def _classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        now, digest = None, None
        for path, chars, n, low, ids in _rows(it):
            if now is not None and now[0] == path:
                now[2] += n
                digest.update(b",")
            else:
                if now is not None:
                    yield (*now, digest.hexdigest())
                now, digest = [path, chars, n, low], hashlib.sha256()
            digest.update(ids.encode())
        if now is not None:
            yield (*now, digest.hexdigest())

    yield from _batches(rows(), _CLASSES, lambda r: len(r[0]) + len(r[1]) + 120)


def classes(paths: DataFrame) -> DataFrame:
    """Distinct paths: members, smallest member, and the digest of the members' ids in order."""
    pieces = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id") \
        .mapInArrow(_pieces, "path binary, chars binary, n bigint, low bigint, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "low") \
        .mapInArrow(_classes, "path binary, chars binary, n bigint, low bigint, ends string")


# -- nodes of a block ---------------------------------------------------------

class RangeMin:
    """Sparse table: level k holds the minima of 2**k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (1 << len(self.levels)) <= len(values):
            v, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], both included."""
        k = np.floor(np.log2(np.maximum(hi - lo + 1, 1))).astype(np.int64)
        k -= (1 << k) > hi - lo + 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            v = self.levels[level]
            out[at] = np.minimum(v[lo[at]], v[hi[at] - (1 << int(level)) + 1])
        return out

    def right(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Largest r with values[i+1..r] all >= d, by binary search on range minima."""
        pos, n = i.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            ok = pos + (1 << k) < n
            ok[ok] = self.levels[k][pos[ok] + 1] >= d[ok]
            pos[ok] += 1 << k
        return pos

    def left(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Smallest l with values[l+1..i] all >= d."""
        pos = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = pos - (1 << k) >= 0
            ok[ok] = self.levels[k][pos[ok] - (1 << k) + 1] >= d[ok]
            pos[ok] -= 1 << k
        return pos


def common(a: bytes, b: bytes) -> int:
    """Equal leading digests of two paths. Digests are chained: equal at d means equal up to d."""
    lo, hi = 0, min(len(a), len(b)) // KEY
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[(mid - 1) * KEY:mid * KEY] == b[(mid - 1) * KEY:mid * KEY]:
            lo = mid
        else:
            hi = mid - 1
    return lo


NODES = ("key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends string, chars bigint, block bigint, edge boolean, first boolean, last boolean, whole_last boolean")
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), *[pa.int64()] * 2, *[pa.bool_()] * 4]
_NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]


def block_nodes(paths: list[bytes], chars: list[bytes], n: np.ndarray, low: np.ndarray, ends: list[str], block: int) -> pa.RecordBatch:
    """Node rows of one block of distinct sorted paths; edge nodes hold this block's share only."""
    m = len(paths)
    depth = np.array([len(p) // KEY for p in paths], np.int64)
    lcp = np.array([0, *(common(a, b) for a, b in zip(paths, paths[1:]))], np.int64)
    tree, lows = RangeMin(lcp), RangeMin(low)
    # prefix sums of code points, flat: class i from depth 0 at flat[i]
    flat = np.concatenate([[0], np.cumsum(depth + 1)])
    sums = np.concatenate([np.concatenate([[0], np.cumsum(np.frombuffer(c, np.int32), dtype=np.int64)]) for c in chars])
    total = sums[flat[:-1] + depth]

    first = np.where(np.arange(m) == 0, 0, lcp + 1)  # first depth that starts at a class
    counts = depth - first + 1
    cand = np.concatenate([[0], np.cumsum(counts)])
    i = np.repeat(np.arange(m), counts)
    d = np.arange(cand[-1]) - np.repeat(cand[:-1] - first, counts)
    left, right = tree.left(i, d), tree.right(i, d)
    assert (left == i).all()

    up = np.maximum(d - 1, 0)
    before = sums[flat[i] + up] * (d > 0)  # code points ahead of the node's own text
    members = np.concatenate([[0], np.cumsum(n)])
    weighted = np.concatenate([[0], np.cumsum(n * total)])
    fresh = np.concatenate([[0], np.cumsum(total - sums[flat[:-1] + lcp])])
    leaf = np.ones(m, np.int64)
    leaf[:-1] = lcp[1:] < depth[:-1]
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    n_convs = members[right + 1] - members[left]
    once = total[left] - before + fresh[right + 1] - fresh[left + 1]
    saved = weighted[right + 1] - weighted[left] - before * n_convs - once

    # the node in which a class's own new chain begins: left extent of (class, lcp)
    others = np.arange(1, m)
    join = tree.left(others, lcp[1:])
    join = cand[join] + lcp[1:] - first[join]
    children = (depth[i] > d).astype(np.int64)
    np.add.at(children, join, 1)
    parent = np.arange(len(i)) - 1
    parent[cand[1:-1]] = join
    conv = lows.between(left, right)
    first_chain, last_chain = left == 0, right == m - 1
    edge = first_chain | last_chain
    whole = d == depth[i]

    keys = [paths[a][(b - 1) * KEY:b * KEY] if b else b"" for a, b in zip(i.tolist(), d.tolist())]
    parents = [None if b == 0 else paths[a][(b - 2) * KEY:(b - 1) * KEY] if b > 1 else b"" for a, b in zip(i.tolist(), d.tolist())]
    hidden = (parent < 0) | edge[np.maximum(parent, 0)]
    own = sums[flat[i] + d] - before
    ended = pa.array(ends, pa.string()).take(pa.array(i, mask=~whole))
    cols = [keys, parents, d, conv, pa.array(conv[np.maximum(parent, 0)], mask=hidden), n_convs, children, leaves[right + 1] - leaves[left], saved,
            ended, own, np.full(len(i), block), edge, first_chain, last_chain, last_chain & whole & (i == m - 1)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _NODE_TYPES)], _NODE_NAMES)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, size = TaskContext.get().partitionId() << 32, [], 0
    for row in _rows(it):
        held.append(row)
        size += len(row[0]) // KEY + 1
        if size >= BLOCK_TURNS or len(held) >= BLOCK_CLASSES:
            yield _block(held, at)
            at, held, size = at + 1, [], 0
    if held:
        yield _block(held, at)


def _block(rows: list, at: int) -> pa.RecordBatch:
    paths, chars, n, low, ends = zip(*rows)
    return block_nodes(list(paths), list(chars), np.array(n, np.int64), np.array(low, np.int64), list(ends), at)


# -- the trie -----------------------------------------------------------------

_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def trie(paths: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends (digest of the ids of the members that end there, or null)."""
    classed = written(classes(written(paths, "trie-paths")), "trie-classes")
    nodes = written(classed.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_blocks, NODES), "trie-nodes")
    edges = nodes.where("edge")
    spans = written(edges.groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi")), "trie-spans")

    # a first chain's nodes that an earlier block has too: their text was counted there, and they are its children
    up = Window.partitionBy("block").orderBy(F.col("depth").desc())  # one path
    chain = edges.where("first").join(spans, "key").withColumn("again", F.col("lo") < F.col("block"))
    chain = chain.select(
        "key", F.sum(F.when(F.col("again"), F.col("chars")).otherwise(0)).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("saved_tokens"),
        F.when(F.lag("again").over(up), F.lit(-1)).otherwise(0).cast("bigint").alias("n_children"), F.lit(0).cast("bigint").alias("n_leaves"))
    # a last class that a later block extends is no leaf
    grown = edges.where("whole_last").join(spans, "key").where("hi > block").select("block")
    tail = edges.where("last").join(grown, "block").select(
        "key", F.lit(0).cast("bigint").alias("saved_tokens"), F.lit(0).cast("bigint").alias("n_children"), F.lit(-1).cast("bigint").alias("n_leaves"))
    nothing = {c: F.lit(None) for c in ("parent", "depth", "conv_id", "n_convs", "ends")}
    parts = edges.select("key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends") \
        .unionByName(chain.unionByName(tail).withColumns(nothing), allowMissingColumns=True)
    merged = written(parts.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends").alias("ends")), "trie-edges")

    name = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    at_edge = merged.join(name, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    # complete nodes under an edge node: its name is joined by block, a node has one row in each
    here = edges.select("block", F.col("key").alias("parent")).join(name, "parent")
    inner = nodes.where(~F.col("edge"))
    under = inner.where("parent_conv_id is null").drop("parent_conv_id").join(here, ["block", "parent"]).withColumn("parent_conv_id", F.col("above"))
    return inner.where("parent_conv_id is not null").select(*_OUT).unionByName(under.select(*_OUT)).unionByName(at_edge.select(*_OUT))


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt_paths(turns)).select(*_OUT[:-1], F.coalesce("ends", F.lit(ROOT_ENDS)).alias("ends_sha256"))


ORACLE = r"""
with o as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
own as (
  select c, list(struct_pack(r := role, t := text) order by turn nulls first, substr(sha256(length(role) || ':' || role || text), 1, 32)) as l from o group by c),
h as (
  select c, l, xor(list_reduce(flatten([[4294967295::bigint],
      flatten(list_transform(range(1, length(c::varchar) + 1), lambda i: [ascii(substr(c::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295::bigint) % 6 as h
  from own),
p as (
  select h.c, list_concat(coalesce(list_slice(b.l, 1, h.h), []), list_slice(h.l, h.h + 1, len(h.l))) as p
  from h left join own b on b.c = h.c - h.c % 100),
m as (select c, p, d, list_slice(p, 1, d) as k from p, unnest(range(0, len(p) + 1)) as u(d)),
node as (
  select k, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len(p) = d), '')) as ends_sha256
  from m group by k, d),
child as (select list_slice(k, 1, d - 1) as k, count(*) as n_children from node where d > 0 group by 1),
full_node as (
  select node.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * length(k[d].t) end as saved
  from node left join child using (k)),
sub as (
  select list_slice(k, 1, e) as k, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from full_node, unnest(range(0, d + 1)) as u(e) group by 1)
select f.conv_id, cast(f.d as bigint) as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, sub.n_leaves,
  cast(sub.saved_tokens as bigint) as saved_tokens, f.ends_sha256
from full_node f join sub using (k) left join node up on f.d > 0 and up.d = f.d - 1 and up.k = list_slice(f.k, 1, f.d - 1)
"""
