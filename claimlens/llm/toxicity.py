"""Toxicity: a learned lexicon trie met by Levenshtein automata, read in context.

A lexicon is learned from labelled rows: words, and word beginnings that
several words share, whose log-odds between toxic and clean rows are high. The
lexicon is a trie; each word of a text runs through it as a Levenshtein
automaton (bit-parallel states, distance 1 for entries of five letters or
more), so misspelled terms meet their entry. Every occurrence is then read in
its context window: inside quotation marks, or after a word of reporting, it
counts ``QUOTED`` of a plain one. A logistic model on the sums by kind of match
and their density gives the score.

The lexicon and the model are fitted on at most about ``MAX_TRAIN`` labelled
rows, picked by a hash of the id; the lexicon counts each distinct text of its
rows once, so copies neither make nor unmake a term. Scoring is one pass over
all whole texts.

Defined results: null or empty text has the score of a text without matches;
rows without a label are not learned from; contradictory labels of one id
or of one text in the lexicon's rows count as toxic from one half on; with labels of one kind only, every score is
that share; repeated rows are answered row by row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

#: Bound of the labelled sample; its first part makes the lexicon, the rest fits the model.
MAX_TRAIN, LEXICON_SHARE = 20_000, 0.6
MIN_ROWS, MIN_SHARE, MIN_ODDS = 4, 0.004, 2.5
#: Distinct words behind which a term stands in toxic texts: near copies of one
#: toxic text repeat its harmless words behind the same ones. A fixed number, as
#: contexts saturate while the texts of a frequent term grow.
MIN_CONTEXTS = 4
STEM_LENGTHS = range(3, 8)
MIN_CONTINUATIONS = 4
FUZZY_LENGTH, WINDOW_CHARS, QUOTED = 5, 60, 0.25
THRESHOLD = 0.7
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
# Verbs that report another's words.
_REPORT = frozenset("said says wrote writes called calls quoted quotes quote reported reads cites cited "
                    "dijo escribió llamó cita sagte schrieb nannte zitierte dit écrit appelé cite".split())


class Trie:
    """Entries by letters; a word entry ends with the word, a stem entry anywhere in it."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.entries = entries
        self.root: dict = {}
        # one edit leaves an entry's first letters in place, or the three after them within one letter
        self.begin2, self.begin3, self.after2, self.after3 = set(), set(), set(), set()
        for i, (text, stem, _) in enumerate(entries):
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            fuzzy = len(text) >= FUZZY_LENGTH
            node.setdefault("", []).append((i, stem, fuzzy))
            if not fuzzy or len(text) > FUZZY_LENGTH:
                self.begin3.add(text[:3])
            if fuzzy and len(text) == FUZZY_LENGTH:
                self.begin2.add(text[:2])
                self.after2.add(text[2:5])
            elif fuzzy:
                self.after3.add(text[3:6])

    def may_match(self, w: str) -> bool:
        """A cheap necessary condition of :meth:`match`."""
        a2, a3 = self.after2, self.after3
        return (w[:3] in self.begin3 or w[:2] in self.begin2 or w[1:4] in a2 or w[2:5] in a2 or w[3:6] in a2
                or w[2:5] in a3 or w[3:6] in a3 or w[4:7] in a3)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry within its distance, longest first; None without one."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end = 1 << len(word)
        best: tuple[int, int, int] | None = None
        # bit i of a state: the first i letters of the word are consumed, with 0 or at most 1 edit
        todo = [(self.root, 1, 3, 0)]
        while todo:
            node, s0, s1, depth = todo.pop()
            for i, stem, fuzzy in node.get("", ()):
                if s0 & end or stem and s0:
                    got = (0, -depth, i)
                elif fuzzy and (s1 & end or stem and s1):
                    got = (1, -depth, i)
                else:
                    continue
                if best is None or got < best:
                    best = got
            for c, child in node.items():
                if c:
                    m = masks.get(c, 0)
                    n0 = (s0 & m) << 1
                    n1 = (s1 & m) << 1 | s0 | s0 << 1 | n0 | n0 << 1
                    n1 &= (end << 1) - 1
                    if n0 | n1:
                        todo.append((child, n0, n1, depth + 1))
        return best and (best[0], best[2])


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the occurrence stands in quotation marks, or follows a reporting word, within its window."""
    before, after = text[max(0, start - WINDOW_CHARS):start], text[end:end + WINDOW_CHARS]
    before, after = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    for o, c in zip(_OPEN, _CLOSE):
        if o == c:
            if before.count(o) % 2 and o in after:
                return True
        elif before.rfind(o) > before.rfind(c) and c in after:
            return True
    words = _WORD.findall(before.lower())[-4:]
    return any(w in _REPORT for w in words)


def _places(low: str, word: str) -> Iterator[int]:
    """Where the word stands as a whole word."""
    at = low.find(word)
    while at >= 0:
        end = at + len(word)
        if (not at or not _WORD.match(low[at - 1])) and not _WORD.match(low, end):
            yield at
        at = low.find(word, end)


class Scorer:
    """Features of a text; words already met are remembered, a bounded number of them."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.trie, self.seen, self.met = Trie(entries), set(), {}
        self.met_words = set()

    def features(self, text: str) -> list[float]:
        low = text.lower()
        if len(low) != len(text):  # keep places in step with the text
            text = low
        words = _WORD.findall(low)
        distinct = set(words)
        new = distinct - self.seen
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen, self.met, self.met_words, new = set(), {}, set(), distinct
        self.seen |= new
        may, match = self.trie.may_match, self.trie.match
        for w in new:
            if may(w) and (got := match(w)) is not None:
                self.met[w] = got
                self.met_words.add(w)
        hits = {w: self.met[w] for w in sorted(distinct & self.met_words)}
        sums, kinds = [0.0] * 4, set()
        for w, (edits, entry) in hits.items():
            _, stem, odds = self.trie.entries[entry]
            kinds.add(entry)
            for start in _places(low, w):
                sums[2 * stem + edits] += odds * (QUOTED if quoted(text, start, start + len(w)) else 1.0)
        scale = 100 / (len(words) + 20)
        return [*(math.log1p(x) for x in sums), *(math.log1p(x * scale) for x in sums), math.log1p(len(kinds))]


N_FEATURES = 9


@dataclass
class Model:
    entries: list[tuple[str, bool, float]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def _term_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) of distinct texts -> in how many toxic and clean ones each word
    and word beginning occurs, and behind which words in the toxic ones (hashes)."""
    counts: dict[tuple[str, bool], list] = {}
    for batch in it:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _WORD.findall((text or "").lower())
            found: dict[tuple[str, bool], str] = {}
            for before, w in zip(["", *words], words):
                if len(w) >= 3:
                    found.setdefault((w, False), before)
                    for n in STEM_LENGTHS:
                        if len(w) > n:
                            found.setdefault((w[:n], True), before)
            for t, before in found.items():
                c = counts.setdefault(t, [0, 0, set()])
                c[0 if toxic else 1] += 1
                if toxic:
                    c[2].add(zlib.crc32(before.encode()))
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([t[0] for t, _ in rows], pa.string()), pa.array([t[1] for t, _ in rows], pa.bool_()),
         pa.array([c[0] for _, c in rows], pa.int64()), pa.array([c[1] for _, c in rows], pa.int64()),
         pa.array([sorted(c[2]) for _, c in rows], pa.list_(pa.int64()))], ["term", "stem", "toxic", "clean", "behind"])


def choose_entries(terms: list, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Entries from (term, stem, toxic texts, clean texts): stems shortest first, then words no stem covers."""
    def odds(t):
        return math.log((t["toxic"] + 0.5) / (n_toxic + 1)) - math.log((t["clean"] + 0.5) / (n_clean + 1))

    good = {(t["term"], t["stem"]): odds(t) for t in terms if odds(t) >= MIN_ODDS}
    spread = Counter(w[:n] for w, stem in good if not stem for n in STEM_LENGTHS if len(w) > n)
    kept: dict[str, float] = {}
    for (term, stem), v in sorted(good.items(), key=lambda x: (len(x[0][0]), x[0])):
        if stem and spread[term] >= MIN_CONTINUATIONS and not any(term[:n] in kept for n in range(3, len(term))):
            kept[term] = v
    out = [(t, True, v) for t, v in kept.items()]
    out += [(w, False, v) for (w, stem), v in good.items() if not stem and not any(w[:n] in kept for n in range(3, len(w)))]
    return sorted(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2 * len(x))
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows given (the caller leaves held-out rows out)."""
    y = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")) \
        .agg((F.avg(label_col) >= 0.5).alias("toxic"))
    n = y.count()
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(29)), F.lit(1_000_003)) / 1_000_003
    picked = y.where(u < min(1.0, MAX_TRAIN / max(1, n))).withColumn(
        "first", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(31)), F.lit(1000)) < int(1000 * LEXICON_SHARE))
    # about MAX_TRAIN rows of an id and two flags at most
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(picked), "id")
    # copies of a text are one text; the sample is bounded, so is what is written
    texts = written(rows.where("first").groupBy("text").agg((F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic")), "texts")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    terms = texts.select("toxic", "text").mapInArrow(
        _term_counts, "term string, stem boolean, toxic bigint, clean bigint, behind array<bigint>") \
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                     F.size(F.array_distinct(F.flatten(F.collect_list("behind")))).alias("contexts")) \
        .where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("toxic") >= max(MIN_ROWS, math.ceil(MIN_SHARE * n_toxic))) &
               ((F.col("toxic") + 0.5) * (n_clean + 1) >= math.exp(MIN_ODDS) * (F.col("clean") + 0.5) * (n_toxic + 1))).collect()
    entries = choose_entries(terms, n_toxic, n_clean)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(entries)
        for batch in it:
            f = [s.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    got = rows.where("not first").select("toxic", "text").mapInArrow(run, "toxic boolean, f array<double>").toPandas()
    if got["toxic"].nunique() < 2:
        share = float(got["toxic"].mean()) if len(got) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(entries, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), math.log(share / (1 - share)))
    return Model(entries, *fit_logistic(np.array(got["f"].tolist()), got["toxic"].to_numpy(float)))


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        s = Scorer(model.entries)
        for batch in it:
            f = np.array([s.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip((f - model.mean) / model.scale @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    m = fit(docs, labels.where(~part))
    return score(docs, m).select("doc_id", part.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
