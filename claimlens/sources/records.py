"""Records of a CSV extract whose quoted fields span lines, read in splits.

Whether a newline ends a record depends on the quotes before it: an even
number means outside a quoted field (a doubled quote counts twice). The scan is
a prefix scan over blocks, a block being the part of a file that one split
reads:

1. one aggregate gives each block's number of lines with an odd number of
   quotes. That is its end state for either start state: an even number keeps
   the state, an odd one flips it;
2. the states are composed in block order, which gives every block its true
   start state and, where a block starts inside a quoted field, the block in
   which that record began. This is one row a split, which the driver plans
   anyway;
3. each split is read again and finds its first record start from its start
   state. Records that begin and end in one block never leave their task; the
   parts of a record that crosses a block border (at most two parts a block)
   are joined by a shuffle of those parts alone.

A file of any size is thus read by as many tasks as a file without quoted
newlines. Lines end in ``\\n`` or ``\\r\\n``; a newline inside quotes is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record"
_OUT = "record string, file string, owner bigint, block bigint, header boolean"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): the lines of each split in order, as Spark plans the splits."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _odd(value):
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1


def block_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, odd, bad): lines with an odd number of quotes, and lines that are not UTF-8."""
    return lines(spark, path).groupBy("file", "block").agg(
        F.count_if(_odd(F.col("value"))).alias("odd"), F.count_if(~F.is_valid_utf8("value")).alias("bad"))


def compose(blocks: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, block) -> (starts inside a quoted field, block in which that record began).

    ``blocks``: (file, block, odd lines). A block with an odd line that ends
    inside a field opened it at its last odd line; a block without one hands on
    what it was given.
    """
    states: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, owner = None, False, -1
    for name, block, odd in sorted(blocks):
        if name != file:
            file, inside, owner = name, False, -1
        states[name, block] = (inside, owner)
        inside ^= bool(odd % 2)
        if odd:
            owner = block
    return states


def unfinished(blocks: list) -> list[str]:
    """Files whose last quoted field is never closed."""
    total: dict[str, int] = {}
    for name, _, odd in blocks:
        total[name] = total.get(name, 0) + odd
    return sorted(f for f, n in total.items() if n % 2)


def _cut(states_bc, keep: str):
    """Lines of whole splits -> records (``keep`` = "whole") or parts of records that cross a border ("parts")."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = states_bc.value
        at, inside, owner, first, held = None, False, -1, False, []
        out: list[tuple] = []

        def flush():
            nonlocal out
            got, out = out, []
            names = ["record", "file", "owner", "block", "header"]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names)

        def emit(text: str, whole: bool):
            nonlocal first
            if whole and text in ("", "\r"):
                return  # empty lines are no records
            header, first = first, False  # the first record of a file, which begins in its first block
            if whole == (keep == "whole") and not (whole and header):
                out.append((text, at[0], owner, at[1], header))

        def close_block():
            if held:  # the block ends inside a record: its opening part, or a middle part
                emit("\n".join(held), False)
                held.clear()

        for batch in it:
            values = batch.column(2)
            odd = (pc.count_substring(values, pattern='"').to_numpy(zero_copy_only=False) % 2).astype(bool)
            files, blocks, texts = batch.column(0), batch.column(1).to_numpy(), values.to_pylist()
            new = np.ones(len(texts), bool)
            names = files.dictionary_encode().indices.to_numpy()
            new[1:] = (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])
            for lo, hi in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(texts))):
                here = (files[int(lo)].as_py(), int(blocks[lo]))
                if here != at:
                    close_block()
                    if here not in states:
                        raise RuntimeError(f"the splits of {here[0]} changed since they were inspected; read the extract again")
                    at, (inside, owner), first = here, states[here], here[1] == 0
                for text, flips in zip(texts[lo:hi], odd[lo:hi]):
                    if not inside and not flips:
                        emit(text, True)
                    elif inside and not flips:
                        held.append(text)
                    elif flips and not inside:
                        inside, owner = True, at[1]
                        held.append(text)
                    else:
                        inside = False
                        # a record opened in an earlier block: its last part
                        began_here = owner == at[1]
                        held.append(text)
                        joined = "\n".join(held)
                        held.clear()
                        emit(joined, began_here)
                if len(out) >= 10_000:
                    yield flush()
        close_block()
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str | list[str], profile: list) -> DataFrame:
    """Every record of the extract but the headers, as one text column."""
    states = compose([(r["file"], r["block"], r["odd"]) for r in profile])
    sent = spark.sparkContext.broadcast(states)
    text = lines(spark, path)
    whole = text.mapInArrow(_cut(sent, "whole"), _OUT).select(RECORD)
    crossing = sorted({f for (f, _), (inside, _) in states.items() if inside})
    if not crossing:
        return whole
    parts = text.where(F.col("file").isin(crossing)).mapInArrow(_cut(sent, "parts"), _OUT)
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"), F.max("header").alias("header"))
    return whole.unionByName(joined.where(~F.col("header")).select(F.concat_ws("\n", F.col("p.record")).alias(RECORD)))
