"""Language-model scoring with Brown class-based bigrams.

Every word of the training texts has one class. The text's probability is the
product over its tokens of P(class | class before) * P(word | class), from the
end token to the end token:

* core words (count >= N / ``CORE``, so at most ``CORE`` of them) are clustered by
  exchange: a word moves to the class that raises the class-bigram likelihood
  most, by the exact difference. The most frequent words are a class each, the
  others join in tiers; then a round moves a hashed part of the words, each
  against the classes as they were, and Spark recounts the class bigrams between
  rounds. The words' bigram lists are a Spark table, one row a word;
* every other word makes one exchange step: the class with the largest gain for
  its own left and right neighbours in the core (only those have a class then),
  counted over all training texts, rare words included;
* once every word has its class, each text is written as its classes, and the class
  bigrams are counted over all neighbours of all training texts;
* P(c | c') is the Witten-Bell mixture of class bigrams with class frequencies,
  P(w | c) is count(w) / count(c). Words never seen in training are one symbol
  whose probability is the share of tokens seen once (Good-Turing), taken from
  all others; a class after it follows class frequencies. The probabilities of
  all known words and that symbol sum to 1 after every class.

Words with count >= N / ``SHARED`` (at most ``SHARED``) are sent to every task;
the others are joined by a shuffle, and as their counts are below that share no
key is hot. Counts, classes and vocabulary cover all training texts; nothing
but the two bounded tables and class matrices passes through the driver.

Defined results: null and empty texts are the end token alone; a null id is
hashed as the empty text; repeated rows are scored each (and counted each);
an empty table, or one without training rows, gives rows scored with no
knowledge (N = 0: base 0 only for the unknown symbol, log10(1/1)); extra
columns are ignored. A document's tokens are held at once.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

CLASSES, ROUNDS = 128, 12
#: Words that take part in the exchange rounds, and words sent to every task, as shares of the tokens.
CORE, SHARED = 1 << 14, 1 << 19
#: Distinct words, or context codes, that a task gathers before it hands them on.
HELD = 400_000

END = b""                      # the end token: no word is empty
LONG_WORD, DIGEST = 40, 24     # a longer word is keyed by a blank and its digest: no word holds a blank
END_CLASS, UNKNOWN = 0, -1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, then the end token."""
    words = text.lower().split() if text else []
    words.append(END)
    if max(map(len, words)) <= LONG_WORD:
        return words
    return [w if len(w) <= LONG_WORD else b" " + hashlib.blake2b(w, digest_size=DIGEST).digest() for w in words]


def _texts(batch: pa.RecordBatch, column: int) -> list:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _looked_up(table: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The words' numbers; UNKNOWN for those the table lacks."""
    return np.fromiter(map(table.get, words, repeat(UNKNOWN)), np.int64, len(words))


# -- counts -------------------------------------------------------------------

def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    for batch in it:
        for text in _texts(batch, 0):
            c.update(tokens(text))
            if len(c) >= HELD:
                yield rows()
                c.clear()
    if c:
        yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, end token included."""
    return texts.select("text").mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# -- exchange clustering of the core words ------------------------------------

def _core_pairs(core_bc):
    """Texts -> counts of adjacent core words (a, b); the end token is also ahead of each text."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = core_bc.value
        held, size = [], 0

        def rows():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair // CORE), pa.array(pair % CORE), pa.array(n)], ["a", "b", "n"])

        for batch in it:
            for text in _texts(batch, 0):
                ids = np.append(0, _looked_up(core, tokens(text)))
                both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                held.append(ids[:-1][both] * CORE + ids[1:][both])
                size += len(ids)
                if size >= 4 << 20:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return run


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_gain(m: np.ndarray, right: np.ndarray, left: np.ndarray, itself: float) -> np.ndarray:
    """What each class's word bigrams add to the class-bigram likelihood, if a word joins it.

    ``m``: class bigram counts without the word; ``right``/``left``: its followers and
    predecessors by class, ``itself``: its bigrams with itself.
    """
    r, k = np.flatnonzero(right), np.flatnonzero(left)
    gain = (_phi(m[:, r] + right[r]) - _phi(m[:, r])).sum(1) + (_phi(m[k, :] + left[k, None]) - _phi(m[k, :])).sum(0)
    diag, rows, cols = np.diag(m), m.sum(1) + left, m.sum(0) + right  # margins: whatever the class, the neighbours' grow
    # the diagonal cell was counted once with followers and once with predecessors
    gain += _phi(diag + right + left + itself) - _phi(diag + right) - _phi(diag + left) + _phi(diag)
    return gain - _phi(rows + right.sum() + itself) + _phi(rows) - _phi(cols + left.sum() + itself) + _phi(cols)


def likelihood(m: np.ndarray) -> float:
    return float(_phi(m).sum() - _phi(m.sum(1)).sum() - _phi(m.sum(0)).sum())


def _bigrams(classes_bc):
    """Word rows (word, followers, counts) -> class bigram counts of this task, over words that have a class."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n_classes = classes_bc.value
        m = np.zeros((n_classes, n_classes), np.int64)
        for batch in it:
            for word, others, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if cls[word] >= 0:
                    of = cls[others.values.to_numpy()]
                    m[cls[word]] += np.bincount(of[of >= 0], counts.values.to_numpy()[of >= 0], n_classes).astype(np.int64)
        a, b = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m[a, b])], ["a", "b", "n"])

    return run


def _matrix(rows: list, n_classes: int) -> np.ndarray:
    m = np.zeros((n_classes, n_classes))
    for a, b, n in rows:
        m[a, b] += n
    return m


def _best(state_bc):
    """Word rows (word, followers, counts, predecessors, counts) of chosen words -> (word, best class) where it is a new one."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, m0, chosen = state_bc.value
        out = []
        for batch in it:
            for w, ro, rn, lo, ln in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 5))):
                if not chosen[w]:
                    continue
                ro, rn, lo, ln = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in (ro, rn, lo, ln))
                itself, c = float(rn[ro == w].sum()), cls[w]
                right, left = (np.bincount(cls[o][(cls[o] >= 0) & (o != w)], n[(cls[o] >= 0) & (o != w)], len(m0)) for o, n in ((ro, rn), (lo, ln)))
                m = m0
                if c >= 0:
                    m = m0.copy()
                    m[c, :] -= right
                    m[:, c] -= left
                    m[c, c] -= itself
                gain = class_gain(m, right, left, itself)
                gain[END_CLASS] = -np.inf
                best = int(gain.argmax())
                if c < 0 or gain[best] > gain[c] + 1e-9 * abs(gain[c]):
                    out.append((w, best))
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["word", "cls"])

    return run


def exchange(pairs: DataFrame, n_words: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of core words 0..n_words-1, most frequent first (0 is the end token, alone in class 0), from
    their bigram counts (a, b, n); the class bigram counts; and the likelihoods from the first full assignment on.

    The first words are a class each; words join in tiers four times as large, each word the class
    of the largest gain. Then a round moves a hashed part of the words; a round that lowers the
    likelihood (its moves met) is taken back, and the next ones move half as many.
    """
    sc = pairs.sparkSession.sparkContext
    right = pairs.groupBy(F.col("a").alias("word")).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("r"))  # at most CORE entries a word
    left = pairs.groupBy(F.col("b").alias("word")).agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("l"))
    words = written(right.join(left, "word", "full").select("word", F.col("r.b").alias("ro"), F.col("r.n").alias("rn"),
                                                            F.col("l.a").alias("lo"), F.col("l.n").alias("ln")), "lm-core")
    followers = words.where("ro is not null").select("word", "ro", "rn")
    order = np.arange(n_words)
    hashed = (order * 0x9E3779B1 >> 12) & 0xFFFF

    def counted(cls: np.ndarray) -> np.ndarray:
        sent = sc.broadcast((cls, n_classes))
        rows = followers.mapInArrow(_bigrams(sent), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n")).collect()  # n_classes^2 at most
        sent.unpersist()
        return _matrix(rows, n_classes)

    def moved(cls: np.ndarray, m: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        state, new = sc.broadcast((cls, m, chosen)), cls.copy()
        for w, c in words.mapInArrow(_best(state), "word bigint, cls bigint").collect():  # at most CORE rows
            new[w] = c
        state.unpersist()
        return new

    cls = np.where(order < n_classes, order, UNKNOWN)
    m, done = counted(cls), min(n_classes, n_words)
    while done < n_words:
        tier = (order >= done) & (order < 4 * done)
        cls = moved(cls, m, tier)
        cls[tier & (cls < 0)] = 1  # no core neighbour at all
        m, done = counted(cls), min(4 * done, n_words)
    seen, parts = [likelihood(m)], 4
    for turn in range(rounds if n_words > n_classes else 0):
        new = moved(cls, m, (order > 0) & (hashed % parts == turn % parts))
        n = counted(new)
        if likelihood(n) >= seen[-1]:
            cls, m = new, n
            seen.append(likelihood(m))
        else:
            parts *= 2
    return cls, m, seen


# -- all other words ----------------------------------------------------------

def _contexts(core_bc, n_classes: int):
    """Texts -> per task and word outside the core: its count, and the classes before (code) and after (n_classes + code) it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = core_bc.value
        local: dict[bytes, int] = {}
        held, counts, size = [], [], 0

        def rows():
            every = np.concatenate(held) if held else np.zeros(0, np.int64)
            key, n = np.unique(every, return_counts=True)
            word, code = key // (2 * n_classes), (key % (2 * n_classes)).astype(np.uint8 if n_classes <= 128 else np.uint16)
            off = np.searchsorted(word, np.arange(len(local) + 1)).astype(np.int32)
            total = np.bincount(np.concatenate(counts), minlength=len(local))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(local), pa.binary()), pa.array(total, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(code.astype(np.int16))),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(n.astype(np.int32)))], ["word", "n", "code", "times"])

        for batch in it:
            for text in _texts(batch, 0):
                words = tokens(text)
                cls = np.concatenate(([END_CLASS], _looked_up(classes, words), [UNKNOWN]))
                at = np.flatnonzero(cls[1:-1] == UNKNOWN)
                ids = np.array([local.setdefault(words[i], len(local)) for i in at.tolist()], np.int64)
                before, after = cls[at], cls[at + 2]
                known = before >= 0
                held.append(ids[known] * (2 * n_classes) + before[known])
                known = after >= 0
                held.append(ids[known] * (2 * n_classes) + n_classes + after[known])
                counts.append(ids)
                size += 2 * len(ids)
                if len(local) >= HELD or size >= 16 << 20:
                    yield rows()
                    local.clear()
                    held, counts, size = [], [], 0
        if local:
            yield rows()

    return run


def _join_class(model_bc):
    """Sorted context rows -> (word, n, class)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, totals = model_bc.value
        k = len(m)
        log_m, log_t = np.log(m + 0.5), np.log(totals + 0.5 * k)
        open_: list = []  # the last word: it may go on in the next batch

        def close(words, n, h):
            gain = h[:, :k] @ log_m + h[:, k:] @ log_m.T - 2 * n[:, None] * log_t
            gain[:, END_CLASS] = -np.inf
            cls = gain.argmax(1)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(cls)], ["word", "n", "cls"])

        for batch in it:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            off = batch.column(2).offsets.to_numpy()
            code = batch.column(2).flatten().to_numpy().astype(np.int64)
            times = batch.column(3).flatten().to_numpy()
            off = off - off[0]
            for lo in range(0, len(words), 4096):
                hi = min(lo + 4096, len(words))
                part = words[lo:hi]
                new = np.array([True, *(a != b for a, b in zip(part, part[1:]))])
                if open_ and open_[0] == part[0]:
                    names, new[0] = [open_[0]], False
                else:
                    if open_:
                        yield close([open_[0]], np.array([open_[1]]), open_[2][None])
                    names, open_ = [], []
                slot = np.cumsum(new) - (0 if names else 1)
                names += [w for w, f in zip(part, new) if f]
                h, total = np.zeros((len(names), 2 * k)), np.zeros(len(names), np.int64)
                np.add.at(total, slot, n[lo:hi])
                rows = np.repeat(slot, np.diff(off[lo:hi + 1]))
                np.add.at(h, (rows, code[off[lo]:off[hi]]), times[off[lo]:off[hi]])
                if open_:
                    total[0] += open_[1]
                    h[0] += open_[2]
                if len(names) > 1:
                    yield close(names[:-1], total[:-1], h[:-1])
                open_ = [names[-1], total[-1], h[-1].copy()]
        if open_:
            yield close([open_[0]], np.array([open_[1]]), open_[2][None])

    return run


# -- the model ----------------------------------------------------------------

class Model:
    """``words``: Spark table (word, n, cls) of all training words; ``total`` N; ``size`` V;
    ``steps``: log10 P(class | class before), one more row and column for the unknown symbol; ``sums``: log10 of class counts."""

    def __init__(self, words: DataFrame, total: int, size: int, steps: np.ndarray, sums: np.ndarray, likelihood: list[float]):
        self.words, self.total, self.size, self.steps, self.sums, self.likelihood = words, total, size, steps, sums, likelihood


def transitions(m: np.ndarray, totals: np.ndarray, once: int, total: int, size: int) -> np.ndarray:
    """log10 of P(next | before) over the classes and, last, the unknown symbol: rows sum to 1 over classes in use."""
    k = len(totals)
    unknown = min(0.5, max(once, 1) / (total + 1)) if total else 1.0
    share = totals / max(total, 1)
    kinds, seen = (m > 0).sum(1), m.sum(1)
    p = np.empty((k + 1, k + 1))
    mixed = (m + kinds[:, None] * share) / np.maximum(seen + kinds, 1)[:, None]
    mixed[seen == 0] = share
    p[:k, :k], p[k, :k] = mixed * (1 - unknown), share * (1 - unknown)
    p[:, k] = unknown
    return np.log10(np.maximum(p, 1e-300))


# -- texts as classes ---------------------------------------------------------

_PARTS = ["row", "n_tokens", "n_known", "base", "score", "codes", "rare", "places"]
#: Codes of texts that are handled at once, but for one text.
AT_ONCE = 1 << 20


def _code_type(k: int):
    """Of a class, or k: a word that is not (yet) known."""
    return np.uint8 if k < 256 else np.uint16


def _encode(table_bc):
    """(id, train, text) -> what the shared words decide, and the text as class codes: the end token's, then each token's.

    ``rare`` are the text's other words, ``places`` the place in it of each such token;
    their codes stay open (k).
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, cls, sums, total, size = table_bc.value
        k = len(sums)
        emit = np.log10(n) - sums[cls] if len(n) else np.zeros(0)
        base = np.log10((n + 1) / (total + size + 1))
        row = TaskContext.get().partitionId() << 36
        for batch in it:
            cols: list[list] = [[] for _ in _PARTS]
            for text in _texts(batch, 2):
                words = tokens(text)
                ids = _looked_up(index, words)
                at = np.flatnonzero(ids < 0)
                local: dict[bytes, int] = {}
                places = np.array([local.setdefault(words[i], len(local)) for i in at.tolist()], np.int32)
                ok = ids[ids >= 0]
                codes = np.full(len(ids) + 1, k, _code_type(k))
                codes[0] = END_CLASS
                codes[1:][ids >= 0] = cls[ok]
                for c, v in zip(cols, (row, len(ids), len(ok), float(base[ok].sum()), float(emit[ok].sum()), codes.tobytes(), list(local), places)):
                    c.append(v)
                row += 1
            types = [*[pa.int64()] * 3, *[pa.float64()] * 2, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(cols, types)]], ["id", "train", *_PARTS])

    return run


def _resolve(model_bc):
    """Encoded rows with their rare words' (place, n, class) -> all but the steps of the score, and whole codes."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total, size = model_bc.value
        k = len(sums)
        for batch in it:
            known, base, score = (batch.column(i).to_numpy().copy() for i in (3, 4, 5))
            codes = batch.column(6).to_pylist()
            for i, (places, found) in enumerate(zip(batch.column(7), batch.column(8))):
                if not found.is_valid or not len(found.values):
                    continue
                place = found.values.field("place").to_numpy()
                n = np.zeros(len(place), np.int64)
                c = np.full(len(place), k)
                n[place] = found.values.field("n").to_numpy()
                c[place] = found.values.field("cls").to_numpy()
                at = places.values.to_numpy()
                t = np.bincount(at, minlength=len(n))
                seen = n > 0
                known[i] += t[seen].sum()
                base[i] += (t * np.log10((n + 1) / (total + size + 1))).sum()
                score[i] += (t[seen] * (np.log10(n[seen]) - sums[c[seen]])).sum()
                own = np.frombuffer(codes[i], _code_type(k)).copy()
                own[own == k] = c[at]
                codes[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(known), pa.array(base), pa.array(score), pa.array(codes, pa.binary())],
                                             ["id", "train", "n_tokens", "n_known", "base", "score", "codes"])

    return run


def _joined(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in turn -> (first text, their codes one after the other, where each ends)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(column.to_pylist(), 1):
        held.append(text)
        size += len(text)
        if size >= AT_ONCE or i == len(column):
            kind = np.dtype(_code_type(k))
            yield first, np.frombuffer(b"".join(held), kind).astype(np.int64), np.cumsum([len(x) for x in held]) // kind.itemsize
            held, size, first = [], 0, i


def _class_pairs(k: int):
    """Codes of training texts -> class bigrams."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k + 1, k + 1), np.int64)
        for batch in it:
            for _, every, ends in _joined(batch.column(0), k):
                m += np.bincount(every[:-1] * (k + 1) + every[1:], minlength=m.size).reshape(m.shape)
                m[END_CLASS, END_CLASS] -= len(ends) - 1  # a text's end and the next one's beginning are no bigram
        a, b = np.nonzero(m[:k, :k])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m[a, b])], ["a", "b", "n"])

    return run


def _steps(model_bc):
    """Rows with whole codes -> scores."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = model_bc.value
        for batch in it:
            score = batch.column(4).to_numpy().copy()
            for first, every, ends in _joined(batch.column(5), len(steps) - 1):
                each = np.append(steps[every[:-1], every[1:]], 0.0)
                each[ends - 1] = 0  # from a text's end to the next one's beginning
                score[first:first + len(ends)] += np.add.reduceat(each, np.append(0, ends[:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _coded(docs: DataFrame, words: DataFrame, sums: np.ndarray, total: int, size: int, shared: int) -> DataFrame:
    """(id, train, text) -> (id, train, n_tokens, n_known, base, score without its steps, codes), written."""
    sc = docs.sparkSession.sparkContext
    table = words.where(F.col("n") * shared >= total).toArrow()  # at most ``shared`` words
    index = {w: i for i, w in enumerate(table.column("word").to_pylist())}
    n, cls = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "cls"))
    sent, small = sc.broadcast((index, n, cls, sums, total, size)), sc.broadcast((sums, total, size))
    kind = docs.schema["id"].dataType.simpleString()
    head = f"id {kind}, train boolean"
    parts = written(docs.select("id", "train", "text").mapInArrow(
        _encode(sent), f"{head}, row bigint, n_tokens bigint, n_known bigint, base double, score double, codes binary, "
                       "rare array<binary>, places array<int>"), "lm-parts")
    sent.unpersist()
    rest = words.where(F.col("n") * shared < total)
    rare = parts.select("row", F.posexplode("rare").alias("place", "word")).join(rest, "word", "left")
    found = rare.select("row", "place", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("cls", F.lit(len(sums))).cast("bigint").alias("cls"))
    found = found.groupBy("row").agg(F.collect_list(F.struct("place", "n", "cls")).alias("found"))  # the words of one text
    whole = parts.drop("rare").join(found, "row", "left").select("id", "train", "n_tokens", "n_known", "base", "score", "codes", "places", "found")
    coded = written(whole.mapInArrow(_resolve(small), f"{head}, n_tokens bigint, n_known bigint, base double, score double, codes binary"), "lm-coded")
    small.unpersist()
    return coded


def _scored(coded: DataFrame, model: Model, id_col: str) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast(model.steps)
    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "n_tokens", "n_known", "base", "score", "codes").mapInArrow(
        _steps(sent), f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("id", id_col)


# -- fitting ------------------------------------------------------------------

def _fit(docs: DataFrame, n_classes: int, rounds: int, core: int) -> tuple[Model, DataFrame]:
    """Model of the training rows of ``docs`` (id, train, text), and all rows as classes."""
    if core > CORE:
        raise ValueError(f"core is at most {CORE}")
    spark, texts = docs.sparkSession, docs.where("train").select("text")
    counts = written(word_counts(texts), "lm-counts")
    total, size, once = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("n"), F.count_if(F.col("n") == 1)).first())
    if not total:
        empty = counts.select("word", "n", F.lit(0).cast("bigint").alias("cls"))
        return Model(empty, 0, 0, transitions(np.zeros((1, 1)), np.zeros(1), 0, 0, 0), np.zeros(1), []), _coded(docs, empty, np.zeros(1), 0, 0, SHARED)
    # the end token among them, at most ``core`` words have that share
    rows = counts.where((F.col("n") * core >= total) & (F.col("word") != F.lit(END))).orderBy(F.col("n").desc(), "word").collect()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    names = [END, *[bytes(r["word"]) for r in rows]]
    n = np.array([ends["n"], *[r["n"] for r in rows]], np.int64)
    sc = spark.sparkContext
    index = sc.broadcast({w: i for i, w in enumerate(names)})
    pairs = written(texts.select("text").mapInArrow(_core_pairs(index), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs")
    cls, m, gains = exchange(pairs, len(n), n_classes, rounds)
    index.unpersist()

    classes = sc.broadcast(dict(zip(names, cls.tolist())))
    model = sc.broadcast((m, np.bincount(cls, n, n_classes)))
    seen = texts.select("text").mapInArrow(_contexts(classes, n_classes), "word binary, n bigint, code array<smallint>, times array<int>")
    joined = written(seen.repartition("word").sortWithinPartitions("word").mapInArrow(
        _join_class(model), "word binary, n bigint, cls bigint"), "lm-classes")
    classes.unpersist()
    model.unpersist()
    of_core = spark.createDataFrame([(bytearray(w), int(c), int(x)) for w, c, x in zip(names, n, cls)], "word binary, n bigint, cls bigint")
    words = of_core.unionByName(joined)
    totals = np.zeros(n_classes)
    for c, s in words.groupBy("cls").agg(F.sum("n")).collect():  # n_classes rows
        totals[c] = s
    sums = np.log10(np.maximum(totals, 1))
    coded = _coded(docs, words, sums, total, size, SHARED)
    steps = coded.where("train").select("codes").mapInArrow(_class_pairs(n_classes), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n"))
    m = _matrix(steps.collect(), n_classes)  # n_classes^2 at most
    return Model(words, total, size, transitions(m, totals, once, total, size), sums, gains), coded


def fit(texts: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS, core: int = CORE) -> Model:
    """Model of all rows of ``texts`` (column text)."""
    docs = texts.select(F.lit(0).alias("id"), F.lit(True).alias("train"), texts["text"].cast("string").alias("text"))
    return _fit(docs, n_classes, rounds, core)[0]


# -- scoring ------------------------------------------------------------------

def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", shared: int = SHARED) -> DataFrame:
    """One row per document row: id, n_tokens, n_known, base_score, score (log10)."""
    rows = docs.select(docs[id_col].alias("id"), F.lit(False).alias("train"), docs[text_col].cast("string").alias("text"))
    return _scored(_coded(rows, model.words, model.sums, model.total, model.size, shared), model, id_col)


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """:func:`fit` on the rows that ``train`` picks and :func:`score` of all rows, which are written as classes once for both."""
    rows = docs.select(docs[id_col].alias("id"), train.alias("train"), docs[text_col].cast("string").alias("text"))
    model, coded = _fit(rows, CLASSES, ROUNDS, CORE)
    return model, _scored(coded, model, id_col)


def remainder(id_col):
    """Of the id's decimal text, as the contract's split takes it."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(7))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, out = fit_and_score(docs, remainder(F.col("doc_id")) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(log10_score: float, n_tokens: int) -> float:
    return math.pow(10, -log10_score / n_tokens)
