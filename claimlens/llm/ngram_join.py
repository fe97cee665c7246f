"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

A document is its set of distinct word shingles; documents with equal sets are
one class and are joined once. Two sets of sizes a and b link when they share
T = ceil(s/(1+s) * (a+b)) shingles, which is at least ceil(s*a). Any T shingles
of T-1 set aside must leave one: so each class sets its T-1 last shingles aside
(its long lists) and is posted on the lists of the others only. Shingles that
repeat among the classes of a block of input ("heavy") come last in every set,
so the posted lists are short.

Classes meeting in a short list are candidates, after filters on size, on the
shared place, and on parity sketches: a bit table of n to 2n bits in which each
shingle flips one bit; the bits that differ are a lower bound of the shingles
that differ, so no link is lost. What is left, and the classes of lists longer
than ``LONG`` (which are not paired out), form groups. Groups are cut into
blocks by size and hash, and each pair of blocks is searched with an inverted
index (DivideSkip): a set's short lists are merged, candidates with enough
occurrences are probed by binary search in its long lists, and only the links
that join two parts leave the task. The work on a group grows with the square
of its classes (equal sets count once), its output does not.

Any choice of heavy shingles gives the same links; the bit table that holds
them, and the one that picks the classes to be compared, have a fixed size.
Classes are identified by 64-bit sums of mixed shingle hashes.

Defined results: null, empty or blank text has no shingles and is linked with
nothing; a text shorter than a shingle is one shingle; repeated rows are rows
of one class; ids may repeat; a null id is never a component's name, and a
component of null ids only has a null name; an empty table gives no rows.
Extra columns are ignored (``join``) or kept (``keep_one``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import textblocks as tb
from claimlens.llm.graph import components
from claimlens.llm.scratch import IdTable, written

SHINGLE, NUM, DEN = 5, 4, 5  # words; similarity NUM / DEN
#: Bits of the fixed tables (8 MB); shingles counted together; classes remembered by a task.
TABLE_BITS, COUNTED, REMEMBERED = 26, 2_000_000, 500_000
#: Longest list whose classes are paired out; classes of a block of a group.
LONG, BLOCK = 64, 256
#: Size classes: two sets that can link differ by one at most.
SIZE_STEP = 1.26
PROBE_COST = 0.0085  # weight of a probe against a merge step in DivideSkip's choice of long lists


def needed(a, b):
    """Shared shingles that sets of these sizes need to link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def shingle_sets(b: tb.Block, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the rows of a block."""
    w = tb.words(b, tb.SPACE)
    g = tb.grams(w.hash, size)
    for i in range(b.hi - b.lo):
        a, z = int(w.first[i]), int(w.first[i + 1])
        if z - a >= size:
            yield i, np.unique(g[a:z - size + 1])
        else:
            yield i, tb.grams(w.hash[a:z], z - a) if z > a else g[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set, at least one for each shingle and 64 in all."""
    bits = max(6, int(len(s) - 1).bit_length())
    at = (tb.mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8))


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the shingles in one of two sketched sets only."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # neighbours fold into one: places are the top bits of a hash
        bits = np.unpackbits(x)
        x = np.packbits(bits[::2] ^ bits[1::2])
    return int(np.bitwise_count(x ^ y).sum())


def class_id(s: np.ndarray) -> int:
    return int(tb.mix(tb.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


class _Seen:
    """Classes a task has dealt with, a bounded number of them."""

    def __init__(self):
        self.ids: set[int] = set()

    def new(self, c: int) -> bool:
        if c in self.ids:
            return False
        if len(self.ids) >= REMEMBERED:
            self.ids.clear()
        self.ids.add(c)
        return True


def _classify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (0, key, set size, class, sketch) by row, the sketch once
    in a task, and (1, shingle, rows) of repeated shingles."""
    seen, held, count = _Seen(), [], 0
    names = ["kind", "a", "n", "c", "bits"]

    def repeated():
        u, k = np.unique(np.concatenate(held), return_counts=True)
        u, k = u[k > 1], k[k > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), pa.array(u.view(np.int64)), pa.array(k.astype(np.int64)),
                                           pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary())], names)

    for batch in it:
        n, c, bits = [], [], []
        for b in tb.blocks(batch.column(1)):
            for _, s in shingle_sets(b):
                n.append(len(s))
                c.append(class_id(s) if len(s) else None)
                bits.append(None)
                if len(s) and seen.new(c[-1]):
                    bits[-1] = sketch(s).tobytes()
                    held.append(s)
                    count += len(s)
            if count >= COUNTED:
                yield repeated()
                held, count = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()),
                                           pa.array(bits, pa.binary())], names)
    if held:
        yield repeated()


def _slot(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _class_mark(c: np.ndarray, rep: np.ndarray) -> np.ndarray:
    return tb.mix(c.view(np.uint64) ^ tb.mix(rep.view(np.uint64)))


def bit_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, bits) of the bit table: 4 kB of it each, deflated, as most are nearly empty."""
    two = len(rows.columns) == 2

    def slots(it):
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False)
            s = np.unique(_slot(_class_mark(x, b.column(1).to_numpy(zero_copy_only=False)) if two else x))
            yield pa.RecordBatch.from_arrays([pa.array(s >> 15), pa.array(s & 32767)], ["chunk", "bit"])

    def pack(it):
        for b in it:
            out = []
            for bits in b.column(1):
                byte = np.zeros(32768, np.uint8)
                byte[bits.values.to_numpy()] = 1
                out.append(zlib.compress(np.packbits(byte).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["chunk", "bits"])

    return rows.mapInArrow(slots, "chunk bigint, bit bigint").groupBy("chunk").agg(F.collect_set("bit").alias("bits")) \
        .mapInArrow(pack, "chunk bigint, bits binary")


def bit_table(rows: DataFrame) -> np.ndarray:
    """Bits set at the hashes of the rows (one column: the hash; two: class and its id). 8 MB, whatever the rows.

    Its chunks come as deflated Arrow batches: as plain rows they would pass the
    driver's JVM several times over, 8 MB each, also where few bits are set.
    """
    chunks = bit_chunks(rows).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for chunk, bits in zip(chunks["chunk"].to_pylist(), chunks["bits"]):
        table[chunk * 4096:(chunk + 1) * 4096] = np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
    del chunks
    pa.default_memory_pool().release_unused()
    return table


def _bits(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _divided(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = _bits(heavy, _slot(s))
    return s[~m], s[m]


def _postings(heavy_bc):
    """(key, text) -> (shingle, class, size, place) of the lists that are not set aside."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, seen = heavy_bc.value, _Seen()
        for batch in it:
            for b in tb.blocks(batch.column(1)):
                cols = [[], [], [], []]
                for _, s in shingle_sets(b):
                    n = len(s)
                    if n * (DEN - NUM) < NUM or not seen.new(c := class_id(s)):
                        continue  # too small to link with any other set, or dealt with
                    p = n - -(-NUM * n // DEN) + 1
                    order = np.concatenate(_divided(s, heavy))[:p]
                    for col, v in zip(cols, (order.view(np.int64), np.full(p, c), np.full(p, n, np.int32), np.arange(p, dtype=np.int32))):
                        col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["h", "c", "n", "pos"])

    return run


_CANDIDATES = "kind tinyint, a bigint, b bigint, n bigint"


def _batch(kind: int, a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(np.asarray(n, np.int64))],
                                      ["kind", "a", "b", "n"])


def _short_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by shingle -> (0, class, class, 0) candidates of short lists; (1, shingle, class, size) of long ones."""
    tail = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]
    long_list = None  # a long list that goes on in the next batch

    def finish(h, c, n, pos):
        nonlocal long_list
        if not len(h):
            return
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        out = np.repeat(size > LONG, size)
        if long_list is not None:
            out |= h == long_list
            size[h[start] == long_list] = 0
        if out.any():
            yield _batch(1, h[out], c[out], n[out])
        found = []
        for k in np.unique(size[(size > 1) & (size <= LONG)]):
            at = start[size == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            t = needed(n[x], n[y])
            ok = (np.minimum(n[x], n[y]) * DEN >= np.maximum(n[x], n[y]) * NUM) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= t)
            found.append(np.stack([np.minimum(c[x], c[y])[ok], np.maximum(c[x], c[y])[ok]], axis=1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _batch(0, pairs[:, 0].copy(), pairs[:, 1].copy(), np.zeros(len(pairs)))

    for batch in it:
        cols = [np.concatenate([t, x.to_numpy(zero_copy_only=False).astype(np.int64)]) for t, x in zip(tail, batch.columns)]
        h, c = cols[0], cols[1]
        once = np.ones(len(h), bool)  # a class that several tasks posted
        once[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        cols = [x[once] for x in cols]
        h = cols[0]
        if not len(h):
            continue
        cut = int(np.searchsorted(h, h[-1], "left")) if h[0] != h[-1] else 0
        yield from finish(*(x[:cut] for x in cols))
        tail = [x[cut:] for x in cols]
        if long_list != h[-1]:
            long_list = None
        if len(tail[0]) > LONG or long_list is not None:
            yield _batch(1, tail[0], tail[1], tail[2])
            long_list, tail = h[-1], [x[:0] for x in tail]
    yield from finish(*tail)


def _sets(wanted_bc):
    """(key, text) -> the sets of the wanted classes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = wanted_bc.value, _Seen()
        for batch in it:
            keys = np.asarray(batch.column(0).fill_null(0))
            for b in tb.blocks(batch.column(1)):
                out = []
                for i, s in shingle_sets(b):
                    if not len(s):
                        continue
                    c = class_id(s)
                    if _bits(wanted, _slot(_class_mark(np.array([c]), keys[b.lo + i:b.lo + i + 1])))[0] and seen.new(c):
                        out.append((c, s.tobytes()))
                if out:
                    c, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.binary())], ["c", "shingles"])

    return run


def _near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with sizes and sketches -> those whose sketches differ in no more bits than linked sets can."""
    for batch in it:
        keep = [differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= na + nb - 2 * needed(na, nb)
                for na, nb, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Index:
    """Inverted lists of some sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        ids = np.repeat(np.arange(len(sets)), self.size)
        values = np.concatenate(sets)
        order = np.lexsort((ids, values))
        self.values, first = np.unique(values[order], return_index=True)
        self.ids, self.off = ids[order], np.append(first, len(values))

    def search(self, s: np.ndarray) -> np.ndarray:
        """Ids of the sets that link with s (DivideSkip)."""
        t = -(-NUM * len(s) // DEN)  # no set can link with less
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        if len(at) < t:
            return at[:0]
        length = self.off[at + 1] - self.off[at]
        at = at[np.argsort(-length, kind="stable")]
        aside = min(t - 1, int(t / (PROBE_COST * np.log2(max(2, int(length.max()))) + 1)))
        # merge the short lists, counting; a result occurs in at least t - aside of them
        merged = np.sort(np.concatenate([self.ids[self.off[i]:self.off[i + 1]] for i in at[aside:]]))
        cut = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.append(cut, len(merged)))
        found, count = merged[cut][count >= t - aside], count[count >= t - aside]
        t_of = needed(len(s), self.size[found])
        for k, i in enumerate(at[:aside]):  # probe the long lists; drop what can't reach its T any more
            if not len(found):
                break
            row = self.ids[self.off[i]:self.off[i + 1]]
            p = np.minimum(np.searchsorted(row, found), len(row) - 1)
            count = count + (row[p] == found)
            if k % 16 == 15:
                keep = count + (aside - k - 1) >= t_of
                found, count, t_of = found[keep], count[keep], t_of[keep]
        return found[count >= t_of]


def _block_pair(table: pa.Table) -> pa.Table:
    """The rows of one pair of blocks -> links (a, b, null) that join two parts and,
    where classes have their numbers of rows w, the rows (a, null, n) that link with each."""
    table = table.take(np.unique(table.column("c").to_numpy(), return_index=True)[1])  # a set may come from several tasks
    w = table.column("w").to_numpy() if "w" in table.column_names else None
    first, second = table.column("first").to_pylist(), table.column("own").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    c = table.column("c").to_pylist()
    left = [i for i in range(len(c)) if second[i] == first[i]]
    same = table.column("second")[0].as_py() == first[0]
    right = left if same else [i for i in range(len(c)) if second[i] != first[i]]
    a, b, parent = [], [], list(range(len(c)))
    linked = np.zeros(len(c), np.int64)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if left and right:
        index = Index([sets[i] for i in right])
        for q in left:
            hits = index.search(sets[q])
            if w is not None:
                at = np.asarray(right)[hits]
                at = at[at != q]
                linked[q] += w[at].sum()
                if not same:
                    linked[at] += w[q]
            for f in hits:
                x, y = root(q), root(right[f])
                if x != y:
                    parent[x] = y
                    a.append(c[q])
                    b.append(c[right[f]])
    k = np.flatnonzero(linked)
    return pa.table({"a": pa.array(a + [c[i] for i in k], pa.int64()), "b": pa.array(b + [None] * len(k), pa.int64()),
                     "n": pa.array([None] * len(a) + linked[k].tolist(), pa.int64())})


def _group_links(edges: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the groups that the edges (a, b) make of the classes: sizes (c, n) and sets (c, shingles);
    with a column w of sizes, the rows of a class, also the rows (a, null, n) of _block_pair."""
    weight = [x for x in ("w",) if x in sizes.columns]
    group = components(edges).select(F.col("node").alias("c"), F.col("root").alias("g"))
    rows = group.join(sizes, "c").select("c", "g", *weight, F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).alias("s"))
    rows = written(rows, "members")
    parts = rows.groupBy("g", "s").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    up = parts.select("g", (F.col("s") - 1).alias("s"), F.col("k").alias("k_up"))
    down = parts.select("g", (F.col("s") + 1).alias("s"), F.col("k").alias("k_down"))
    parts = parts.join(up, ["g", "s"], "left").join(down, ["g", "s"], "left")
    rows = rows.join(parts, ["g", "s"]).withColumn("j", F.pmod(F.xxhash64("c"), F.col("k")))
    block = lambda s, j: F.concat_ws(":", s.cast("string"), j.cast("string"))
    own = block(F.col("s"), F.col("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    pair = lambda x, y: F.struct(x.alias("first"), y.alias("second"))
    s = F.col("s")
    pairs = F.concat(
        F.transform(upto(F.col("k")), lambda i: pair(block(s, F.least(i, F.col("j"))), block(s, F.greatest(i, F.col("j"))))),
        F.transform(upto(F.coalesce("k_up", F.lit(0).cast("bigint"))), lambda i: pair(own, block(s + 1, i))),
        F.transform(upto(F.coalesce("k_down", F.lit(0).cast("bigint"))), lambda i: pair(block(s - 1, i), own)))
    dealt = rows.withColumn("p", F.explode(pairs)).select("g", "p.first", "p.second", own.alias("own"), "c", *weight)
    return dealt.join(sets, "c").groupBy("g", "first", "second").applyInArrow(_block_pair, "a bigint, b bigint, n bigint")


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      n_links: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(key, n, c) of every row, links (a, b) between classes that join them into their components,
    and with ``n_links`` (c, n): the rows of other classes that link with a class, where there are any."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("key"), docs[text_col].cast("string").alias("text"))
    first = written(rows.mapInArrow(_classify, "kind tinyint, a bigint, n bigint, c bigint, bits binary"), "classes")
    of_row = first.where("kind = 0").select(F.col("a").alias("key"), "n", "c")
    heavy = spark.sparkContext.broadcast(bit_table(first.where("kind = 1").select("a")))
    posted = rows.mapInArrow(_postings(heavy), "h bigint, c bigint, n int, pos int")
    found = written(posted.repartition("h").sortWithinPartitions("h", "n", "c").mapInArrow(_short_lists, _CANDIDATES), "candidates")
    # candidates of short lists, past their sketches; a class may have one of each task, all equal
    bits = first.where("kind = 0 and bits is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    x = bits.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = bits.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = found.where("kind = 0").select("a", "b").distinct().join(x, "a").join(y, "b") \
        .select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_near, "a bigint, b bigint")
    # classes of long lists, each tied to the least of its list
    members = found.where("kind = 1").select(F.col("a").alias("h"), "b").distinct()
    centre = members.groupBy("h").agg(F.min("b").alias("a"))
    edges = written(near.union(members.join(centre, "h").select("a", "b")), "near")
    wanted = edges.select(F.col("a").alias("c")).union(edges.select(F.col("b").alias("c"))).distinct()
    reps = of_row.where("c is not null").groupBy("c").agg(F.coalesce(F.min("key"), F.lit(0).cast("bigint")).alias("rep"), F.first("n").alias("n"),
                                                             F.count("*").alias("w"))
    sizes = written(wanted.join(reps, "c"), "wanted")
    marked = spark.sparkContext.broadcast(bit_table(sizes.select("c", "rep")))
    sets = rows.mapInArrow(_sets(marked), "c bigint, shingles binary")
    if not n_links:
        return of_row, _group_links(edges, sizes.select("c", "n"), sets).select("a", "b"), None
    out = written(_group_links(edges, sizes.select("c", "n", "w"), sets), "links")
    counts = out.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    return of_row, out.where("b is not null").select("a", "b"), counts


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_links: bool = False) -> DataFrame:
    """id, n_shingles, component_id of every row; with ``n_links`` also the number of other rows it links with."""
    of_row, links, counts = classes_and_links(docs, id_col, text_col, n_links)
    root = components(links)
    by_class = of_row.where("c is not null").groupBy("c").agg(F.min("key").alias("least"), F.count("*").alias("w")) \
        .join(root.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_class.join(least, "root").select("c", "component_id", "w")
    more = []
    if n_links:
        named = named.join(counts.withColumnRenamed("n", "others"), "c", "left")
        more = [F.coalesce(F.col("w") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links")]
    kind = docs.schema[id_col].dataType
    return of_row.join(named, "c", "left").select(
        F.col("key").cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"), *more)


def _with_class(at: int):
    """Document rows with the class of their text (null without shingles) as one more column."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            c = []
            for b in tb.blocks(batch.column(at)):
                c += [class_id(s) if len(s) else None for _, s in shingle_sets(b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c, pa.int64())], [*batch.schema.names, "c"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, its smallest id's; rows with a null id, and rows without shingles, stay.

    Which rows go is decided by (id, class), so unlike texts of one id are
    judged each. Only the texts of ids that lose a row are shuffled (and the few
    others whose bit in a table of those ids is set); all others pass by.
    """
    of_row, links, _ = classes_and_links(docs, id_col, text_col)
    rows = of_row.where("c is not null and key is not null").groupBy("key", "c").agg(F.count("*").alias("w"))
    rows = rows.join(components(links).withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rows = written(rows, "rows")
    best = rows.groupBy("root").agg(F.min(F.struct("key", "c")).alias("best"))
    judged = written(rows.join(best, "root").select("key", "c", "w", (F.struct("key", "c") == F.col("best")).alias("stays")), "judged")
    touched = judged.where("not stays or w > 1").select("key").distinct()
    table = IdTable(touched, "key")
    key = docs[id_col].cast("bigint")
    aside = docs.where(key.isNotNull() & table.may_hold(key))
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, c is the class
    at, key_at = docs.columns.index(text_col), names[docs.columns.index(id_col)]
    marked = aside.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    marked = marked.mapInArrow(_with_class(at), schema + ", c bigint")
    stays = judged.where("stays").select(F.col("key").alias("k"), F.col("c").alias("kc"))
    one = marked.join(stays, (marked[key_at].cast("bigint") == stays["k"]) & (marked["c"] == stays["kc"]), "left_semi").dropDuplicates([key_at, "c"])
    back = marked.where("c is null").unionByName(one).drop("c").toDF(*docs.columns)
    return docs.where(key.isNull() | ~table.may_hold(key)).union(back)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g
  from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)
"""
