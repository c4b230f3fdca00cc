"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` characters of tokens and keys that holds a digit, or a lower-case letter
before an upper-case one; ``=`` ends it, but for padding, so ``KEY=value`` and ``?token=value`` give the value. The forest
sees its length, the shares of digits and capitals, how often neighbouring characters change their class, how many
different characters it has, how much of it the corpus's own common words cover, whether its path looks like tests or
configuration, and the words around it.

The forest is trained on labelled findings (doc_id, start, label), if they are given. Else ``provenance_labels`` takes
labels from the assignment: a value that is assigned to a name like key or token is a finding, a value that is not
assigned at all is none, and a value under another name stays unlabelled. The forest sees neither the assignment nor its
name, only the words before them and the value itself, so it judges unassigned values by what they look like. Training
uses at most ``TRAINING_ROWS`` labelled rows (smallest hash first); the dictionary and the scan use all texts.

Defined results: null and empty texts have no candidates; without both kinds of labels there is no forest, and each
candidate scores its share of the labels (one half if there are none); rows that repeat an id are scanned each;
equal values in a text are separate findings; other columns are left out.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.llm.common import whole
from firmatlas.llm.privacy import matches
from firmatlas.session import write_stage

LEAST, CONTEXT, DICTIONARY, TRAINING_ROWS, TREES, DEPTH, KEEP = 16, 40, 256, 20_000, 20, 6, 0.5
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}(?![\p{{L}}\p{{N}}]|\s*=+\s*[\"']?[\p{{L}}\p{{N}}])"
# what gives a value its name: the name, perhaps quoted, a sign, perhaps a quotation mark
ASSIGNMENT = r"([\p{L}\p{N}_.-]+)[\"']?\s*[:=]\s*[\"']?$"
# fixed values: words that speak for a credential, for something else, and parts of paths
CUES = "api key apikey token secret password passwd pwd credential auth bearer private access"
OTHERS = "example sample dummy placeholder test commit sha sha1 sha256 md5 hash checksum digest uuid version card order invoice"
TEST_PATHS = r"(?i)(?:^|[/_.-])(?:tests?|spec|mock|fixtures?|examples?|docs?)(?:[/_.-]|$)"
CONFIG_PATHS = r"(?i)(?:^|[/_.-])(?:conf|config|settings|env|secrets?|credentials?|ya?ml|ini|properties)(?:[/_.-]|$)"
FEATURES = ("length", "digits", "capitals", "symbols", "changes", "variety", "hexadecimal", "covered", "near_cue", "near_other", "near_common", "test_path", "config_path")


def _any_word(words: str) -> str:
    return rf"(?i)(?<![\p{{L}}])(?:{'|'.join(words.split())})(?![\p{{L}}])"


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of four to twelve letters."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(whole(text)), F.lit(r"(?<![\p{L}\p{N}])[a-z]{4,12}+(?![\p{L}\p{N}])"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def candidates(docs: DataFrame, words: list[str], doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, start, end, value and the features of every candidate."""
    read = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    spans = F.when(F.col("text").rlike(CANDIDATE), matches(F.col("text"), CANDIDATE, "term"))
    spans = F.filter(spans, lambda m: m["raw"].rlike("[0-9]|[a-z][A-Z]"))
    each = read.select("doc_id", "path", "text", F.explode(spans).alias("m"))
    before = F.substring("text", F.greatest(F.col("m.start") - CONTEXT, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(CONTEXT)))
    rows = each.select("doc_id", "path", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.raw").alias("value"), before.alias("before"))
    value, size = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(value, pattern, ""))) / size

    borders = F.size(F.split(value, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[^+/_=-])", -1)) - 1
    covered = F.length(F.regexp_replace(F.lower(value), "|".join(words), "")) if words else F.length(value)
    name = F.regexp_extract("before", ASSIGNMENT, 1)
    # words around the value without the name that it is assigned to
    around = F.regexp_replace("before", ASSIGNMENT, "")
    letters = F.greatest(F.length(F.regexp_replace(around, r"\P{L}", "")), F.lit(1))
    strange = F.length(F.regexp_replace(F.regexp_replace(F.lower(around), rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})", ""), r"\P{L}", "")) if words else letters
    made = {
        "length": size,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "symbols": share("[+/_=-]"),
        "changes": borders / size,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hexadecimal": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "covered": (size - covered) / size,
        "near_cue": around.rlike(_any_word(CUES)),
        "near_other": around.rlike(_any_word(OTHERS)),
        "near_common": 1 - strange / letters,
        "test_path": F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATHS),
        "config_path": F.coalesce(F.col("path"), F.lit("")).rlike(CONFIG_PATHS),
    }
    return rows.select("doc_id", "start", "end", "value", F.nullif(name, F.lit("")).alias("name"), *[c.cast("double").alias(f) for f, c in made.items()])


def provenance_labels(found: DataFrame) -> DataFrame:
    """The findings that the text itself labels, by the name they are assigned to."""
    secret = F.regexp_replace("name", r"(?<=[a-z])(?=[A-Z])|[_.-]", " ").rlike(_any_word(CUES))
    label = F.when(F.col("name").isNull(), 0.0).when(secret, 1.0)
    return found.withColumn("label", label).where("label is not null")


def given_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The findings that ``labels`` (doc_id, start, label) names."""
    return found.join(labels.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, seed: int = 11) -> tuple[Transformer | None, float]:
    """A forest from labelled findings (features and label 0 or 1), and the share of label 1."""
    bounded = labelled.groupBy("value", "label").agg(*[F.first(c).alias(c) for c in FEATURES])
    bounded = write_stage(bounded.orderBy(F.xxhash64("value"), "value", "label").limit(rows), "secret-labels")
    told = bounded.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if not 0 < told["ones"] < told["n"]:
        return None, told["ones"] / told["n"] if told["n"] else 0.5
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(assembled(bounded)), told["ones"] / told["n"]


def assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)


def judged(found: DataFrame, forest: Transformer | None, share: float, keep: float = KEEP) -> DataFrame:
    """Findings with the forest's score and whether they are kept."""
    if forest is None:
        scored = found.withColumn("score", F.lit(float(share)))
    else:
        scored = forest.transform(assembled(found)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("kept", F.col("score") >= keep)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", labels: DataFrame | None = None) -> DataFrame:
    """Every candidate with its score; the forest learns from ``labels``, or from what the texts label themselves."""
    found = write_stage(candidates(docs, dictionary(docs, text), doc_id, text, path), "secret-candidates")
    return judged(found, *train(provenance_labels(found) if labels is None else given_labels(found, labels)))
