"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards; a node weighs what its shards weigh. Each
row descends level by level: every child draws -ln(u)/weight, u in (0,1) from a
hash of the key and the child, and the smallest draw wins. A draw changes only
with its own child's weight, so where a weight grows, rows move only into the
subtrees whose weight grew (from anywhere), and where it shrinks, only out of
them. ``grow`` adds a shard as a subtree of its own: rows move into the new
shard and nowhere else (law ``key``).

``slots`` numbers the rows of each shard without gaps: rows are cut into many
small buckets of a shard, numbered there, and each bucket starts where the
buckets before it end. No task ever holds a shard.

Defined results: a null text has size 8 and the checksum of no bytes; a null
key is hashed as its own value; rows with equal keys share a shard and get
slots of their own; an empty table gives no rows; shards that drew nothing have
no slots. Extra columns are kept by ``assign``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

RACKS, SHARDS_A_RACK = 3, 4
#: Rows of a shard that one numbering group should hold.
GROUP_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """``shards``: (region, rack, shard, weight); a weight above zero."""

    shards: tuple[tuple[int, int, int, float], ...]

    def children(self, path: tuple[int, ...] = ()) -> list[tuple[int, float]]:
        """(child, weight) below a region, a rack or the root."""
        out: dict[int, float] = {}
        for s in self.shards:
            if s[:len(path)] == path:
                out[s[len(path)]] = out.get(s[len(path)], 0.0) + s[3]
        return sorted(out.items())


def layout(n: int) -> Tree:
    """n equal shards, four to a rack and three racks to a region."""
    per_region = RACKS * SHARDS_A_RACK
    return Tree(tuple((s // per_region, s % per_region // SHARDS_A_RACK, s, 1.0) for s in range(n)))


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own."""
    region = max((r for r, *_ in tree.shards), default=-1) + 1
    return replace(tree, shards=(*tree.shards, (region, 0, shard, weight)))


def _draw(key: Column, path: tuple[int, ...], child: int, weight: float) -> Column:
    h = F.xxhash64(key, F.lit("/".join(map(str, (*path, child)))))
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def place(key: Column, tree: Tree, path: tuple[int, ...] = ()) -> Column:
    """The shard of a key: the smallest draw at each level."""
    if len(path) == 3:
        return F.lit(path[2])
    children = tree.children(path)
    if len(children) == 1:
        return place(key, tree, (*path, children[0][0]))
    best = F.array_min(F.array(*[F.struct(_draw(key, path, c, w).alias("d"), F.lit(c).alias("c")) for c, w in children]))["c"]
    if len(path) == 2:
        return best
    down = F.when(best == children[0][0], place(key, tree, (*path, children[0][0])))
    for c, _ in children[1:]:
        down = down.when(best == c, place(key, tree, (*path, c)))
    return down


def assign(rows: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """The rows with their shard."""
    return rows.withColumn(out, place(F.col(key), tree).cast("int"))


def slots(rows: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Rows of a written table numbered from 0 in each shard."""
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    names, mark = ("group", "n", "shard", "g", "first", "k"), "_"
    while any(mark + n in rows.columns for n in names):
        mark += "_"  # no column of the caller is taken
    group, n, its_shard, g, ahead, k = (mark + x for x in names)
    dealt = rows.withColumn(group, F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = dealt.groupBy(shard, group).agg(F.count("*").alias(n))
    before = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(shard).alias(its_shard), F.col(group).alias(g), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    within = F.row_number().over(Window.partitionBy(shard, group).orderBy(*order))
    numbered = dealt.withColumn(k, within)
    return numbered.join(first, (numbered[shard] == first[its_shard]) & (numbered[group] == first[g])) \
        .withColumn(out, (F.col(ahead) + F.col(k) - 1).cast("bigint")).drop(group, k, its_shard, g, ahead)


def write_shards(rows: DataFrame, tree: Tree, path: str, key: str = "doc_id") -> None:
    """Files by shard; each task writes what it reads, so no shard passes through one task."""
    assign(rows, tree, key, "shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tree = layout(24)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text") + 8, F.lit(8)).cast("bigint").alias("size"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    rows = assign(assign(rows, tree), grow(tree, 24), out="grown_shard")
    # the row number only parts rows that are equal in everything else
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shards")
    return slots(rows, "shard", ["doc_id", "text_crc32", "size", "_row"]) \
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
