"""Personal data: base patterns, and bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seed entities. Every seed, and
every other identifier-like string (five digits or more, digit groups joined by
single blanks, dots, dashes or brackets included, or an ``@``), stands in
lexical patterns: the word before, the word after, both, the two words before,
the second word before with the first one skipped, and its own shape (lengths of
its digit runs and its signs). Patterns and instances form a graph, which Spark
scores: a pattern's score for a kind is the mean score of its distinct
instances, shrunk by one; an entity of the kind scores 1, of another kind 0, an
unknown instance the mean of its patterns (``ROUNDS`` times back and forth).
Patterns with ``MIN_SEEDS`` distinct entities and a score of ``MIN_SCORE`` are
trusted. Unknown identifiers of fitting form in a trusted pattern become
entities of its kind; they seed the next round, until a round finds none. All
places of a found entity become spans. Base spans stay as they are.

Texts are read once. What is found is written to the shared folder (it is small
beside the text); edges are made distinct before any join, so a pattern or an
instance that fills a third of all rows is pre-aggregated.

Defined results: null or empty text has no spans; a base match that fails its
check is dropped and not retried; repeated rows are searched row by row, and
equal instances count once in a pattern; ties between kinds go to the first in
``KINDS``; without seeds nothing is added. A run of joined digit groups with
more digits than any kind has stands for all its parts that fit; of overlapping
found spans the longest stays. Instances are compared by a 128-bit digest of
the whole string. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.scratch import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 5, 0.8
MIN_DIGITS, CONTEXT_CHARS = 5, 80
MAX_JOINED_DIGITS = 19  # more than any kind has

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_OTHER = re.compile(r"(?<![^\s\"'<>,;|()\[\]{}])[^\s\"'<>,;|()\[\]{}]*+")
# digit groups, some in brackets, joined by single blanks, dots or dashes
_GROUP = r"(?:\([0-9]++\)|[0-9]++)"
_JOINED = re.compile(rf"(?<![\w@])\+?{_GROUP}(?:[ \u00a0.-]?{_GROUP})+(?![\w@]|[:,.-]\w)")
_DIGIT_RUN = re.compile(r"[0-9@]")
_WORD = re.compile(r"\w+")
_ONE_GROUP, _DOTTED, _RUN = re.compile(_GROUP), re.compile(r"[0-9]+\.[0-9]+\.[0-9]+"), re.compile(r"[0-9]+|[^\W\d_]+")


def emails(t: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = t.find("@", m.end() if m else at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, z) for a, z in emails(t)]
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def other_identifiers(t: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that touch no base span: words, and joined digit
    groups beside the words they hold."""
    taken = sorted(taken)
    out, at, k = _joined_numbers(t, taken), 0, 0
    for m in _DIGIT_RUN.finditer(t):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and not (t[start - 1].isspace() or t[start - 1] in "\"'<>,;|()[]{}"):
            start -= 1
        end = _OTHER.match(t, start).end() if start == 0 or t[start - 1].isspace() or t[start - 1] in "\"'<>,;|()[]{}" else m.end()
        at = max(end, m.end())
        while end > start and t[end - 1] in ".:!?":
            end -= 1
        s = t[start:end]
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        if sum(c.isdigit() for c in s) >= MIN_DIGITS or "@" in s[1:-1]:
            out.append((start, end))
    return sorted(set(out))


def _joined_numbers(t: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, k = [], 0
    for m in _JOINED.finditer(t):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        digits = sum(c.isdigit() for c in m.group())
        if MIN_DIGITS <= digits <= MAX_JOINED_DIGITS:
            out.append((start, end))
        elif digits > MAX_JOINED_DIGITS:  # several numbers in a row: every run of its groups that fits
            groups = [(g.start(), g.end(), sum(c.isdigit() for c in g.group())) for g in _ONE_GROUP.finditer(t, start, end)]
            for i, (a, _, _) in enumerate(groups):
                n = 0
                for _, z, d in groups[i:]:
                    n += d
                    if n > MAX_JOINED_DIGITS:
                        break
                    if n >= MIN_DIGITS:
                        out.append((a, z))
    return out


def shape(s: str) -> str:
    """Lengths of digit runs, runs of letters as one, and all signs."""
    return _RUN.sub(lambda m: str(len(m.group())) if m.group()[0].isdigit() else "a", s)


def patterns(t: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place."""
    before = _WORD.findall(t[max(0, start - CONTEXT_CHARS):start].lower())[-2:]
    after = _WORD.findall(t[end:end + CONTEXT_CHARS].lower())[:1]
    out = ["#" + shape(t[start:end])]
    if len(out[0]) > CONTEXT_CHARS:
        out = []
    if len(before) == 2:
        out += [f"{before[0]} {before[1]} _", f"{before[0]} * _"]
    if before:
        out.append(f"{before[-1]} _")
    if after:
        out.append(f"_ {after[0]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def fitting(s: str) -> list[str]:
    """Kinds whose form a string can have."""
    digits = sum(c.isdigit() for c in s)
    return [k for k, ok in (("email", "@" in s), ("ip", bool(_DOTTED.search(s))), ("card", 12 <= digits <= 19), ("phone", 6 <= digits <= 15)) if ok]


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spot = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.binary()),
                      ("fits", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))])
    for batch in it:
        found = []
        for x in batch.column(2):
            t = x.as_py() or ""
            base = base_spans(t)
            other = [(None, a, z) for a, z in other_identifiers(t, [(a, z) for _, a, z in base])]
            found.append([{"kind": k, "start": a, "end": z, "instance": hashlib.blake2b(t[a:z].encode(), digest_size=16).digest(),
                           "fits": fitting(t[a:z]), "patterns": patterns(t, a, z)} for k, a, z in base + other])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(spot))], ["row", "key", "found"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, key, found): base spans and other identifiers of every row, with their patterns."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_find, f"row bigint, key {kind}, found array<struct<kind:string,start:bigint,end:bigint,"
                                  "instance:binary,fits:array<string>,patterns:array<string>>>")


def score_patterns(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(pattern, kind, score, seeds) of the patterns that hold entities.

    ``edges``: distinct (instance, pattern); ``entities``: (instance, kind).
    """
    seeds = edges.join(entities, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    everything = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    base = written(seeds.join(everything, "pattern"), "base")
    # only patterns that hold an entity can score; an instance's other patterns count as 0
    unknown = written(edges.join(entities, "instance", "left_anti"), "unknown")
    degree = unknown.groupBy("instance").agg(F.count("*").alias("degree"))
    beside = written(unknown.join(base.select("pattern").distinct(), "pattern", "left_semi").join(degree, "instance"), "beside")
    scores = base.withColumn("score", F.col("seeds") / (F.col("n") + 1))
    for _ in range(ROUNDS):
        guess = beside.join(scores.select("pattern", "kind", "score"), "pattern").groupBy("instance", "kind") \
            .agg((F.sum("score") / F.first("degree")).alias("s"))
        added = beside.select("instance", "pattern").join(guess, "instance").groupBy("pattern", "kind").agg(F.sum("s").alias("added"))
        scores = written(base.join(added, ["pattern", "kind"], "left")
                         .withColumn("score", (F.col("seeds") + F.coalesce("added", F.lit(0.0))) / (F.col("n") + 1)), "scores")
    return scores.select("pattern", "kind", "score", "seeds")


def bootstrap(found: DataFrame) -> DataFrame:
    """(instance, kind, support) of the entities found beyond the seeds: one kind each, and the trusted patterns they were found in."""
    spots = found.select(F.explode("found").alias("f")).select("f.kind", "f.instance", "f.fits", "f.patterns")
    edges = written(spots.select("instance", F.explode("patterns").alias("pattern")).distinct(), "edges")
    forms = written(spots.where("kind is null").select("instance", F.explode("fits").alias("kind")).distinct(), "forms")
    seeds = written(spots.where("kind is not null").select("instance", "kind").distinct(), "seeds")
    added, entities = None, seeds
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    while True:
        trusted = score_patterns(edges, entities).where((F.col("seeds") >= MIN_SEEDS) & (F.col("score") >= MIN_SCORE))
        held = edges.join(trusted, "pattern").groupBy("instance", "kind").agg(F.count("*").alias("support"), F.max("score").alias("score"))
        new = held.join(forms, ["instance", "kind"]).join(entities, "instance", "left_anti") \
            .groupBy("instance").agg(F.max(F.struct("support", "score", (-order).alias("o"), "kind")).alias("best")).select("instance", F.col("best.kind").alias("kind"))
        new = written(new, "entities")
        if new.isEmpty():  # support by the patterns trusted at last, also those that came after the entity
            return new.withColumn("support", F.lit(0)) if added is None else written(
                added.join(held, ["instance", "kind"], "left").select("instance", "kind", F.coalesce("support", F.lit(0)).alias("support")), "entities")
        added = new if added is None else written(added.union(new), "entities")
        entities = written(entities.union(new), "entities")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, base and added spans (kind, start, end)."""
    found = written(find(docs, id_col, text_col), "pii")
    spots = found.select("row", F.explode("found").alias("f")).where("f.kind is null") \
        .select("row", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.instance").alias("instance"))
    added = spots.join(bootstrap(found), "instance").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "support")).alias("added"))
    # of spans that overlap (a joined number, a word of it) the one in more trusted patterns stays, then the longest
    ranked = F.reverse(F.array_sort(F.transform("added", lambda x: F.struct(
        x["support"].cast("bigint").alias("support"), (x["end"] - x["start"]).alias("length"), (-x["start"]).alias("before"), x["kind"].alias("kind"),
        x["start"].alias("start"), x["end"].alias("end")))))
    none = F.array().cast("array<struct<support:bigint,length:bigint,before:bigint,kind:string,start:bigint,end:bigint>>")
    kept = F.aggregate(ranked, none, lambda got, x: F.when(
        F.exists(got, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])), got).otherwise(F.concat(got, F.array(x))))
    added = added.select("row", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added"))
    spans = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    return found.join(added, "row", "left").select(
        F.col("key").alias(id_col), spans.alias("base"),
        F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("added"))


def rediscovery(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How well the method finds base entities that it is not told: a hashed third of them is no seed.

    One row per kind: hidden entities, those found again with their kind, and
    all entities found under that kind.
    """
    found = written(find(docs, id_col, text_col), "pii")
    hidden = lambda f: f["kind"].isNotNull() & (F.pmod(F.xxhash64(f["instance"]), F.lit(3)) == 0)
    told = found.select("row", "key", F.transform("found", lambda f: F.struct(
        F.when(~hidden(f), f["kind"]).alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["instance"].alias("instance"),
        f["fits"].alias("fits"), f["patterns"].alias("patterns"))).alias("found"))
    truth = found.select(F.explode(F.filter("found", hidden)).alias("f")).select(F.col("f.instance").alias("instance"), F.col("f.kind").alias("kind")).distinct()
    got = bootstrap(told).select("instance", F.col("kind").alias("as"))
    both = truth.join(got, "instance", "full")
    kinds = both.select(F.explode(F.array_distinct(F.array("kind", "as"))).alias("name"), "kind", "as").where("name is not null")
    return kinds.groupBy(F.col("name").alias("kind")).agg(F.count_if(F.col("kind") == F.col("name")).alias("hidden"),
                                                          F.count_if((F.col("kind") == F.col("as")) & (F.col("as") == F.col("name"))).alias("found_again"),
                                                          F.count_if(F.col("as") == F.col("name")).alias("found"))


def joined(spans):
    """kind:start:end by kind as listed, then start, comma-joined."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark, sf_dir: str) -> DataFrame:
    got = extract(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return got.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.concat("base", "added")).alias("spans"))
