"""Secret scan: candidate strings judged by a random forest, in DataFrame functions only.

Candidates are runs of 16 or more key characters that hold a digit and, as the
value of a key word, whole quoted strings and runs of six or more. Each is
described by its length, shares of character classes, transitions between
them, distinct characters, dictionary coverage, path words and the words and
signs beside it. A random forest, trained on labelled findings, removes the
false positives. Without a table of labelled findings, those whose context
decides them are the labels: a key word, an assignment sign and quotes around
a string that is not a number label a secret; plain numbers, parts of
addresses, and strings of dictionary or plain words without any key word or
assignment label a false one; every other finding has no label. Labelled strings
are also taught without their context, so a key pasted in prose is judged by its
own characters; the forest decides all. At most about ``MAX_TRAIN`` labelled findings, picked
by content hash, train it; every candidate of every whole text is scored.

Findings are written once to the shared folder (they are few beside the text);
the text itself is not shuffled by the scan.

Defined results: null or empty text has no findings; equal strings at several
places are several findings; repeated rows are scanned row by row; a null path
has no path words; when the labels hold one kind only, that kind is every
verdict, and without labels nothing is a secret. ``redact`` keeps all columns.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.scratch import IdTable, written

CONTEXT = 60
#: Bound of the labelled findings that train the forest, and its size.
MAX_TRAIN, TREES, DEPTH = 20_000, 20, 6
THRESHOLD = 0.5
REDACTED = "<SECRET>"

# Words beside keys, common words, and words of paths without real keys.
KEY_WORDS = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|signature"
# What may stand between a key word and its value; the short test of its end comes first, as it is cheap.
_VALUE_OF = (r"(?<=[=:][ \t]{0,2}[\"'`]?)(?<=(?i:" + KEY_WORDS + r")[\"'`]?[ \t]{0,2}(?:=|:)[ \t]{0,2}[\"'`]?)")
#: Beside a key word: a whole quoted string, or key characters; elsewhere 16 key characters or more with a digit.
CANDIDATE = (r"(?<=[\"'`])" + _VALUE_OF + r"[^\s\"'`<>]{6,}+(?=[\"'`])|(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+|"
             + _VALUE_OF + r"[A-Za-z0-9+/_\-]{6,}+)={0,2}")
DICTIONARY = ("the|and|for|with|that|this|from|have|not|are|you|all|can|more|new|user|name|data|file|path|test|example|sample|"
              "dummy|http|https|www|com|org|html|index|page|image|content|version|number|value|string|der|die|und|les|des|que|los|las")
PATH_WORDS = "test|example|sample|doc|mock|fixture|demo"
# Dictionary words cover a string by this share, or plain words and numbers joined by signs make it up.
COVERED, WORDS_ONLY = 0.5, "^([A-Z]?[a-z]+|[0-9]+)([-_/+]+([A-Z]?[a-z]+|[0-9]+))+$"

FEATURES = ["length", "digits", "upper", "lower", "signs", "transitions", "distinct", "hex", "number", "coverage",
            "key_word", "key_beside", "assigned", "quoted", "address", "path"]
CONTEXT_FEATURES = FEATURES[10:14]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: key, row, start, end, candidate and its context."""
    path = docs[path_col].cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"), path.alias("path"),
                       F.monotonically_increasing_id().alias("row")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))) \
        .withColumn("gaps", F.split("text", CANDIDATE, -1))
    one = F.transform("found", lambda c, i: F.struct(
        c.alias("candidate"), F.length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after")))
    rows = rows.select("key", "row", "path", F.posexplode(one).alias("pos", "f")).select("key", "row", "path", "pos", "f.*")
    # places: the gaps and candidates before it in its row
    here = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("candidate")).over(here)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("candidate")).drop("gap", "pos")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def describe(found: DataFrame) -> DataFrame:
    """The findings with their features (doubles)."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    beside = F.regexp_replace("before", r"[^A-Za-z0-9_\-]*$", "")
    values = {
        "length": F.least(F.length("candidate"), F.lit(200)).cast("double"),
        "digits": _share("[^0-9]"), "upper": _share("[^A-Z]"), "lower": _share("[^a-z]"), "signs": _share("[A-Za-z0-9]"),
        "transitions": F.regexp_count("candidate", F.lit(r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
        / F.length("candidate"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))).cast("double"),
        "hex": flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")), "number": flag(F.col("candidate").rlike("^[0-9]+$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower("candidate"), DICTIONARY, "")) / F.length("candidate"),
        "key_word": flag(F.concat("before", "after").rlike(f"(?i)({KEY_WORDS})")),
        "key_beside": flag(beside.rlike(f"(?i)({KEY_WORDS})$")),
        "assigned": flag(F.col("before").rlike(r"(=|:)[^A-Za-z0-9]*$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "address": flag(F.col("before").rlike(r"(@|://|[A-Za-z0-9]\.)$") | F.col("after").rlike(r"^(@|\.[A-Za-z])")),
        "path": flag(F.col("path").rlike(f"(?i)({PATH_WORDS})")),
    }
    return found.withColumns(values)


def context_label() -> Column:
    """1 or 0 where the context decides a finding, else null."""
    yes = (F.col("key_beside") + F.col("assigned") + F.col("quoted") == 3) & (F.col("number") == 0)
    words = (F.col("coverage") >= COVERED) | F.col("candidate").rlike(WORDS_ONLY)
    no = (F.col("number") == 1) | (F.col("address") == 1) | (F.col("key_word") + F.col("assigned") == 0) & words
    return F.when(yes, 1.0).when(no, 0.0)


class Forest:
    """A trained forest, or one verdict where the labels hold one kind only."""

    def __init__(self, described: DataFrame, label: Column | None = None):
        from_context = label is None
        label = context_label() if from_context else label
        rows = described.withColumn("label", label.cast("double")).where("label is not null")
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        self.verdict, self.model = max(sizes, default=0.0), None
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        if len(sizes) == 2:
            total = sum(sizes.values())
            u = F.pmod(F.xxhash64("candidate", "start"), F.lit(1_000_003)) / 1_000_003
            # both kinds weigh the same
            weight = F.when(F.col("label") == 1, total / sizes[1.0]).otherwise(total / sizes[0.0])
            train = rows.where(u < min(1.0, MAX_TRAIN / total)).withColumn("weight", weight).select(*FEATURES, "label", "weight")
            if from_context:  # each string is taught without its context too: a secret is one in prose as well
                train = train.union(train.withColumns({c: F.lit(0.0) for c in CONTEXT_FEATURES}))
            if train.groupBy("label").count().count() == 2:
                self.model = RandomForestClassifier(
                    featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH,
                    featureSubsetStrategy="sqrt", seed=11).fit(self.assembler.transform(train))

    def judge(self, described: DataFrame) -> DataFrame:
        """The findings with ``probability`` and ``secret``."""
        if self.model is None:
            out = described.withColumn("probability", F.lit(float(self.verdict)))
        else:
            out = self.model.transform(self.assembler.transform(described)) \
                .withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features") \
                .withColumnRenamed("p", "probability")
        return out.withColumn("secret", F.col("probability") >= THRESHOLD)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All judged findings of all documents."""
    described = written(describe(findings(docs, id_col, text_col, path_col)), "findings")
    return Forest(described).judge(described).withColumnRenamed("key", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The documents with their secrets replaced; a document without one is unchanged."""
    judged = scan(docs, id_col, text_col, path_col)
    secrets = written(judged.where("secret").select(F.col(id_col).alias("k"), "candidate").distinct().groupBy("k").agg(
        F.array_sort(F.collect_list("candidate"), lambda a, b: F.length(b) - F.length(a)).alias("secrets")), "secrets")
    # only documents with a secret are joined; the others pass by, unshuffled
    table = IdTable(secrets, "k")
    hit = table.may_hold(docs[id_col])
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    at, text = names[docs.columns.index(id_col)], F.col(names[docs.columns.index(text_col)])
    few = docs.where(hit).toDF(*names)
    joined = few.join(secrets, few[at].eqNullSafe(secrets["k"]), "left")
    # whole strings only: a short secret may be a part of other words
    whole = lambda s: F.concat(
        F.when(s.rlike(r"^[A-Za-z0-9+/_\-]"), r"(?<![A-Za-z0-9+/_\-])").otherwise(""), F.lit(r"\Q"),
        F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"),
        F.when(s.rlike(r"[A-Za-z0-9+/_\-]$"), r"(?![A-Za-z0-9+/_\-])").otherwise(""))
    clean = F.when(F.col("secrets").isNull(), text).otherwise(
        F.aggregate("secrets", text, lambda t, s: F.regexp_replace(t, whole(s), F.lit(REDACTED))))
    redacted = joined.select(*[clean.alias(n) if docs.columns[i] == text_col else F.col(n) for i, n in enumerate(names)])
    return docs.where(~hit).union(redacted.toDF(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                             F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")
