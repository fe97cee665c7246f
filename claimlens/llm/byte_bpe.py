"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table stores the one token that can end a
valid encoding of that prefix. A token fits after another when the two, merged
by rank from bytes, come out as exactly these two; an encoding is valid when
all its neighbours fit, so the last token of each prefix is unique and follows
from the table of the shorter prefixes. Appending bytes only adds entries, and
after an edit only the entries from the edit to the point where the table
agrees again (one longest-token length of equal entries) are recomputed.

The ranks file is read by the driver from a path parameter and broadcast; its
size is checked against ``MAX_RANKS_BYTES``. Documents are encoded where they
are read, without a shuffle; a bounded cache holds encoded pieces.

Defined results: null or empty text has no tokens and decodes to no bytes;
special-token strings in a text are ordinary text; repeated rows are encoded
row by row; a rank file without all 256 bytes is refused. Extra columns are
ignored unless ``keep`` names them.
"""

from __future__ import annotations

import base64
import os
import uuid
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.scratch import worker_cache

MAX_RANKS_BYTES = 64 << 20
#: Entries that a worker's caches hold; text characters encoded together.
CACHE_PIECES, CACHE_PAIRS, PORTION_CHARS = 200_000, 400_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    size = os.path.getsize(path)
    if size > MAX_RANKS_BYTES:
        raise ValueError(f"ranks file of {size} bytes is over the bound of {MAX_RANKS_BYTES}")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE of a short byte string: join the lowest-ranked neighbours, leftmost first."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def last_merge(data: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge ends the plain BPE of a token's bytes; None if it does not end in this token."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]])


#: Letters, digits and white space below U+0100, fixed by Unicode.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"


def _splitters(pattern: str):
    """The pattern for any text, and an equal one in explicit character classes
    for texts below U+0100 (None if the pattern is not the public one)."""
    import re

    import public_tokenizers as P
    import regex

    narrow = None
    if pattern == P.PATTERN:
        narrow = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
    return regex.compile(pattern), narrow


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks do not hold every single byte")
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}  # by its last three bytes: length of the longest such token
        for token in ranks:
            if len(token) > self.reach.get(token[-3:], 2):
                self.reach[token[-3:]] = len(token)
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pattern, self.narrow = _splitters(pattern)
        self.pairs: dict[int, bool] = {}  # by left * 2**24 + right: smaller than a tuple
        self.pieces: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (or, with left -1, can begin a piece)."""
        got = self.pairs.get((left << 24) + right)
        if got is None:
            got = self._fits(left, right)
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[(left << 24) + right] = got
        return got

    def _split(self, token: int) -> tuple[int, int] | None:
        """The tokens that ``token`` is merged from last: itself twice for a byte, None if merges in rising order do not make it."""
        if token not in self.splits:
            data = self.bytes_of[token]
            got = last_merge(data, self.ranks) if len(data) > 1 else (token, token)
            for part in got or ():
                if len(self.bytes_of[part]) > 1 and (part > token or self._split(part) is None):
                    got = None
            self.splits[token] = got
        return self.splits[token]

    def _fits(self, left: int, right: int) -> bool:
        """Both are taken apart, the latest merge first: no merge across their border may come before one inside.

        Of equal ranks the leftmost merges first, so right's merges lose against an equal one at the border.
        Tokens that are not made by merges in rising order are merged from bytes."""
        if self._split(right) is None or left >= 0 and self._split(left) is None:
            before = self.bytes_of[left] if left >= 0 else b""
            return merge_by_rank(before + self.bytes_of[right], self.ranks) == ([left] if left >= 0 else []) + [right]
        if left < 0:
            return True
        limit, bytes_of, rank = 1 << 32, self.bytes_of, self.ranks.get
        while True:
            across = rank(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                return False
            a, b = (-1 if len(bytes_of[t]) == 1 else t for t in (left, right))
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = left, self._split(left)[1]
            else:
                limit, right = right + 1, self._split(right)[0]

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add the entries of data's prefixes that ``last`` does not hold yet."""
        rank, known, reach = self.ranks.get, self.pairs.get, self.reach.get
        for i in range(len(last), len(data) + 1):
            n = reach(data[i - 3:i], 2) if i > 2 else i
            for j in range(i - n if i > n else 0, i):
                t = rank(data[j:i])
                if t is not None:
                    left = last[j]
                    ok = known((left << 24) + t)
                    if ok or ok is None and self.fits(left, t):
                        last.append(t)
                        break
            else:
                raise ValueError("no valid encoding")

    def backtrack(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in sorted order: each keeps the table entries of the
        prefix it shares with the piece before it."""
        before, last = b"", [-1]
        for piece in sorted(pieces):
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
                continue
            n = len(commonprefix((before, data)))
            del last[n + 1:]
            self.extend(data, last)
            before = data
            self.pieces[piece] = array("I", self.backtrack(last)).tobytes()

    def split(self, text: str) -> list[str]:
        rule = self.narrow if self.narrow is not None and (text.isascii() or ord(max(text)) < 256) else self.pattern
        return rule.findall(text)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.pieces)
        if new and len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces.clear()
            new = set().union(*split)
        self.learn(new)
        get = self.pieces.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


class PrefixTable:
    """``last[i]``: last token of the encoding of the first i bytes (-1 for none)."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many entries were recomputed."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        same, done = 0, 0
        for i in range(start + 1, len(self.data) + 1):
            if same >= self.encoder.longest:  # from here on every entry depends on equal ones only
                self.last.extend(old[i - shift:])
                break
            self.encoder.extend(self.data[:i], self.last)
            done += 1
            same = same + 1 if i > start + len(new) and old[i - shift] == self.last[i] else 0
        return done

    def tokens(self) -> list[int]:
        return self.encoder.backtrack(self.last)


_ENCODERS: dict[int, Encoder] = {}
worker_cache(_ENCODERS)


def _encoder(model) -> Encoder:
    """One encoder for each worker and broadcast model."""
    if model.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.id] = Encoder(*model.value)
    return _ENCODERS[model.id]


class _Model:
    """A broadcast (ranks, pattern) with a key for the worker's encoder cache."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        self.id = uuid.uuid4().hex
        self.shared = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    @property
    def value(self):
        return self.shared.value


def model(spark, ranks_path: str, pattern: str) -> _Model:
    return _Model(spark, ranks_path, pattern)


def encode(docs: DataFrame, m: _Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The kept columns, ids (binary, little-endian uint32 each) and n_tokens;
    with ``decoded`` also the ids decoded again, by the same worker."""
    from pyspark.sql import types as T

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(m)
        for batch in it:
            lo = 0
            while lo < batch.num_rows:
                texts, size, hi = [], 0, lo
                while hi < batch.num_rows and size < PORTION_CHARS:
                    texts.append(batch.column(0)[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                ids = enc.packed(texts)
                cols = [*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    cols.append(pa.array([enc.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi
        enc.pieces.clear()  # idle workers of later stages should not hold them

    rows = docs.select(docs[text_col].cast("string").alias("_text"), *[docs[c] for c in keep])
    fields = [docs.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    names = [f.name for f in fields]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, m: _Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The same rows with the decoded bytes added."""
    from pyspark.sql import types as T

    names = encoded.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(m)
        for batch in it:
            col = batch.column(names.index(ids_col))
            out = pa.array([enc.decode(x.as_py() or b"") for x in col], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())]))


def default_model(spark) -> _Model:
    import public_tokenizers as P

    return model(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    m = default_model(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, m, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
