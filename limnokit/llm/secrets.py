"""Secret scan with a random forest that removes false positives.

Candidates are long strings of key-like characters, issued formats and
whatever follows a credential's name. Each is described by its length, the transitions between kinds
of its characters, how much of it dictionary words cover, the path or source
it was found in, and the words beside it. A random forest trained on labelled
findings gives each a probability. Where there are none, they are made: in the
places of findings of the corpus, keys drawn from hashes are planted as secrets,
with and without a credential's name before them, and as harmless identifiers
beside the words for those; found digits, words and paths are harmless too. So
the forest has to tell keys by their characters, and their neighbours only add.

All of it is DataFrame functions and the JVM's own forest; no Python runs on
the executors. Texts never leave the scan: only candidates and 80 characters
before and 40 behind them do.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnokit.session import settle

BEFORE, BEHIND = 80, 40

CREDENTIAL_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_ -]?key)"
ASSIGNED = CREDENTIAL_WORDS + r"[\"']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}[\"']?$"
HARMLESS_WORDS = r"(?i)\b(?:sha(?:1|256|512)?|md5|commit|checksum|digest|hash|uuid|guid|isbn|order|invoice|serial|version|example|sample|dummy|placeholder|test)\b"
HARMLESS_PATHS = r"(?i)(?:test|example|sample|fixture|mock|doc|readme)"
#: Documented formats of issued credentials.
ISSUED = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{16,})"
_NAMED = r"(?<=[=:>\s\"'`])(?<=" + CREDENTIAL_WORDS.replace("(?i)(?:", "(?i:") + r"[A-Za-z0-9_-]{0,16}[\"']?(?:\s{0,3}(?:[:=]|=>|:=)\s{0,3}|\s{1,3}(?:is\s{1,3})?)"
#: A candidate: what follows a credential's name (all in quotes, or 4 or more characters), an issued format, or 16 or more key-like characters.
UNNAMED = r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{16,}+={0,2}|" + ISSUED
CANDIDATE = (
    _NAMED + r"[\"'`])[^\"'`\r\n]{4,256}(?=[\"'`])|"
    + _NAMED + r"[\"'`]?)(?![=:])[^\s\"'`,;<>(){}\[\]]{4,}+|"
    + UNNAMED
)

FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "distinct_share", "letter_digit", "digit_letter", "case_change", "symbol_change",
    "dictionary_share", "issued", "credential_word", "assigned", "quoted", "harmless_word", "harmless_path", "words_before", "digits_around",
)


def dictionary_from_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case words of three letters or more in a public vocabulary of base64 ranks, as ``word``.

    The size is that of the vocabulary, whatever the corpus.
    """
    token = F.lower(F.trim(F.unbase64(F.split("value", " ")[0]).cast("string")))
    return spark.read.text(path).select(token.alias("word")).filter(F.col("word").rlike("^[a-z]{3,}$")).distinct()


def find_candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ordinal, value, before, behind, path`` of every candidate of ``docs`` (``doc_id``, ``text``)."""
    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), "text")
    named = F.col("text").rlike(CREDENTIAL_WORDS)  # without one, the slower pattern finds the same
    values = F.when(named, F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).otherwise(F.regexp_extract_all("text", F.lit(UNNAMED), 0))
    found = found.withColumn("values", values).filter(F.size("values") > 0)
    found = found.withColumn("between", F.when(named, F.split("text", CANDIDATE, -1)).otherwise(F.split("text", UNNAMED, -1)))
    each = F.transform(
        F.sequence(F.lit(1), F.size("values")),
        lambda i: F.struct(
            i.alias("ordinal"),
            F.element_at("values", i).alias("value"),
            F.right(F.element_at("between", i), F.lit(BEFORE)).alias("before"),
            F.left(F.element_at("between", i + 1), F.lit(BEHIND)).alias("behind"),
        ),
    )
    return found.select("doc_id", "path", F.explode(each).alias("x")).select("doc_id", "x.*", "path")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _flag(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(pattern).cast("double"), F.lit(0.0))


def describe(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``candidates`` with the columns of ``FEATURES``; ``dictionary`` has distinct lower-case ``word``."""
    values = candidates.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    covered = runs.join(dictionary, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    steps = F.greatest(F.length("value") - 1, F.lit(1))
    return candidates.join(covered, "value", "left").withColumns(
        {
            "length": F.length("value").cast("double"),
            "digit_share": _share("[0-9]"),
            "upper_share": _share("[A-Z]"),
            "hex_share": _share("[0-9a-fA-F]"),
            "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
            "letter_digit": F.regexp_count("value", F.lit("(?<=[A-Za-z])(?=[0-9])")) / steps,
            "digit_letter": F.regexp_count("value", F.lit("(?<=[0-9])(?=[A-Za-z])")) / steps,
            "case_change": F.regexp_count("value", F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / steps,
            "symbol_change": F.regexp_count("value", F.lit("(?<=[A-Za-z0-9])(?=[+/_=-])")) / steps,
            "dictionary_share": F.coalesce(F.col("covered"), F.lit(0)) / F.length("value"),
            "issued": _flag("value", ISSUED),
            "credential_word": _flag("before", CREDENTIAL_WORDS),
            "assigned": _flag("before", ASSIGNED),
            "quoted": (F.col("before").rlike("[\"']$") & F.col("behind").rlike("^[\"']")).cast("double"),
            "harmless_word": _flag("before", HARMLESS_WORDS),
            "harmless_path": _flag("path", HARMLESS_PATHS),
            "words_before": F.regexp_count("before", F.lit(r"\S+")).cast("double"),
            "digits_around": F.regexp_count(F.concat("before", "behind"), F.lit("[0-9]")).cast("double"),
        }
    ).drop("covered")


#: What stands before planted findings: a credential's name, or a word for harmless identifiers.
PLANTED_NAMES = ('api_key = "', "token: ", "password=", "bearer ", "secret => '", "-----BEGIN RSA PRIVATE KEY-----\n")
PLANTED_HARMLESS = ("commit ", "sha256 ", "checksum: ", "uuid ", "md5 hash ", "serial ")


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def planted_findings(candidates: DataFrame, rows: int, seed: int) -> DataFrame:
    """Labelled findings in the places of ``rows`` candidates chosen by a hash.

    A third each: a key in the place as it is (1), after a credential's name
    (1), beside a word for harmless identifiers (0). Keys are 16 to 64 letters
    and digits, hexadecimal digits (20 or more), base64, or letters alone, by
    the bits of a hash, none with the prefix of an issued format; harmless
    identifiers are hexadecimal or digits.
    """
    order = F.xxhash64("value", "before", "behind", "doc_id", "ordinal", F.lit(seed))
    places = candidates.withColumn("__by", order).orderBy("__by").limit(rows)
    bits = F.concat_ws("/", "value", "doc_id", "ordinal", F.col("__by").cast("string"))
    code, hexes = F.base64(F.unhex(F.sha2(bits, 512))), F.sha2(bits, 256)
    size = F.pmod(F.shiftright("__by", 8), F.lit(49)) + 16
    kind = F.pmod(F.shiftright("__by", 16), F.lit(4))
    key = (
        F.when(kind == 0, F.left(F.translate(code, "+/=", "xY"), size))
        .when(kind == 1, F.left(hexes, F.greatest(size, F.lit(20))))
        .when(kind == 2, F.left(code, size))
        .otherwise(F.left(F.translate(code, "0123456789+/=", "qRsTuVwXyZ"), size))
    )
    harmless = F.when(kind < 3, F.left(hexes, F.greatest(size, F.lit(32)))).otherwise(F.left(F.translate(hexes, "abcdef", "135792"), size))
    part = F.pmod(F.shiftright("__by", 24), F.lit(3))
    spot = F.shiftright("__by", 32)
    lead = F.when(part == 1, _pick(PLANTED_NAMES, spot)).when(part == 2, _pick(PLANTED_HARMLESS, spot))
    quote = F.when(F.right(lead, F.lit(1)).isin('"', "'"), F.right(lead, F.lit(1))).otherwise(F.lit(" "))
    before = F.when(part == 0, F.col("before")).otherwise(F.right(F.concat("before", F.lit(" "), lead), F.lit(BEFORE)))
    behind = F.when(part == 0, F.col("behind")).otherwise(F.left(F.concat(quote, "behind"), F.lit(BEHIND)))
    return places.select(
        "doc_id", "ordinal", F.when(part == 2, harmless).otherwise(key).alias("value"), before.alias("before"), behind.alias("behind"), "path",
        F.when(part == 2, 0.0).otherwise(1.0).alias("label"),
    )


def surely_harmless(found: DataFrame) -> DataFrame:
    """Described findings that no one would take for secrets, with ``label`` 0: digits, words and paths without a credential's name."""
    plain = (F.col("digit_share") == 1) | (F.col("dictionary_share") > 0.6)
    return found.filter(plain & (F.col("credential_word") == 0) & (F.col("issued") == 0)).withColumn("label", F.lit(0.0))


def train_forest(labelled: DataFrame, rows: int = 30_000, trees: int = 30, depth: int = 8, seed: int = 17):
    """A forest fitted on at most ``rows`` labelled findings of each label, chosen by a hash; None with one label only."""
    order = F.xxhash64("value", "before", "behind", "doc_id", "ordinal", F.lit(seed))
    parts = [labelled.filter(F.col("label") == x).orderBy(order).limit(rows) for x in (0.0, 1.0)]
    train = settle(parts[0].unionByName(parts[1]).select("label", *FEATURES), "secret-labels")
    if train.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(_vectors(train))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(found)


def score(found: DataFrame, forest, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``; an issued format is a secret whatever the forest says, and all there is without one."""
    issued = F.col("issued") == 1
    if forest is None:
        out = found.withColumn("probability", F.when(issued, 1.0).otherwise(0.0))
    else:
        out = forest.transform(_vectors(found)).withColumn("probability", vector_to_array("probability")[1])
        out = out.drop("features", "rawPrediction", "prediction")
    return out.withColumn("is_secret", issued | (F.col("probability") >= threshold))


def scan_secrets(
    docs: DataFrame, dictionary: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", train_rows: int = 30_000, threshold: float = 0.5, seed: int = 17
) -> DataFrame:
    """Every candidate of ``docs`` (``doc_id``, ``text``, and ``path`` if there is one), scored.

    Gives ``doc_id, ordinal`` (from 1 in order of place), ``value, before,
    behind``, the features, ``probability`` and ``is_secret``. ``labelled``:
    findings with ``label`` and the features (as of ``describe``); without it
    those of ``planted_findings`` and ``surely_harmless``. Null and empty texts
    have no candidates, nor has an empty table. Repeated rows give their
    candidates again. Null ids and paths are allowed; other columns are ignored.
    """
    candidates = settle(find_candidates(docs, path), "candidates")
    found = settle(describe(candidates, dictionary), "findings")
    if labelled is None:
        planted = describe(settle(planted_findings(candidates, train_rows, seed), "planted"), dictionary)
        labelled = planted.unionByName(surely_harmless(found), allowMissingColumns=True)
    return score(found, train_forest(labelled, train_rows, seed=seed), threshold)
