"""Secret scans: candidate strings by patterns, false positives removed by a random forest. DataFrame functions only.

Each candidate is described by its length, how its characters change class, how far words of a dictionary cover it, whether
it stands in a path, and the words beside it. The forest learns from labelled findings and scores candidates in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A candidate is kept from this score on.
THRESHOLD = 0.5
#: Characters of the text on either side that are looked at.
AROUND = 48
#: At most so many labelled findings are learned from, chosen by a hash.
TRAIN_ROWS = 50_000

# Names that announce a secret, and words that speak against one.
KEY_NAMES = "password|passwd|pwd|passphrase|secret|secret_key|client_secret|token|access_token|auth_token|refresh_token|api_key|apikey|api-key|access_key|private_key|credential|credentials|bearer|authorization"
PLAIN_NAMES = "commit|revision|checksum|sha1|sha256|md5|hash|digest|etag|uuid|guid|build|version|order|invoice|serial|isbn|phone|example|sample|dummy|placeholder|test|image|file|page"
#: Words that code, prose and paths are made of.
DICTIONARY = (
    "about access account admin after again alert also always archive article assets author backup before begin between blog body book bootstrap border build button cache change check class client code color "
    "comment common company component config content control count create data date default demo description design detail device document download dummy edit element email error event example export file filter "
    "first font form format foo frame from function gallery google group guide header height hello help home html http https icon image images index info input item java javascript label language large last layout "
    "library light line link list load local login main manager master media menu message method mobile model module name network node number object office option order page password path photo picture placeholder "
    "plugin point post print product profile project public query random record report request response result review sample screen script search section server service session setting shop simple site small source "
    "start state static status store story style submit summary support system table target template test text theme thumb time title token tool type update upload user value version video view welcome white width "
    "window world your xxx abc qwerty letmein secret changeme the and for with that this have not you are was"
).split()

# A name of a secret, a sign, and what follows; or a run of 16 characters or more with a digit; or a key file's first line.
_NAMED = rf"(?i:(?<![A-Za-z0-9])(?:{KEY_NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}[\"']?)"
_CANDIDATE = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----|{_NAMED}[^\s\"'<>]{{6,}}+|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{16,}}+"

_CLASSES = "[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points, end exclusive), value, left, right (the text beside it).

    A name before a value counts as text on its left.
    """

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(_CANDIDATE))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)).alias("found"), F.split("text", _CANDIDATE, -1).alias("parts"))
    beside = f"transform(found, (x, i) -> struct(i as ordinal, x as unit, right(parts[i], {AROUND}) as left, left(parts[i + 1], {AROUND}) as right, length(parts[i]) as gap))"
    rows = rows.select("doc_id", "row", F.inline(F.expr(beside)))
    head = F.regexp_extract("unit", f"^{_NAMED}", 0)
    end = F.sum(F.col("gap") + F.length("unit")).over(Window.partitionBy("row").orderBy("ordinal"))
    rows = rows.select("doc_id", end.alias("end"), head.alias("head"), F.expr("unit"), "left", "right")
    value = F.expr("substring(unit, length(head) + 1)")
    return rows.select("doc_id", (F.col("end") - F.length(value)).alias("start"), "end", value.alias("value"), F.right(F.concat("left", "head"), F.lit(AROUND)).alias("left"), "right")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _features() -> dict[str, Column]:
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    distinct = F.size(F.array_distinct(F.split(value, ""))).cast("double")
    covered = F.length(F.regexp_replace(value, rf"(?i){'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}", ""))
    last_word = F.lower(F.regexp_extract(left, r"([A-Za-z_-]+)[^A-Za-z]*$", 1))
    return {
        "length": F.log2(size), "digits": _count(value, "[0-9]") / size, "upper": _count(value, "[A-Z]") / size, "lower": _count(value, "[a-z]") / size,
        "changes": _count(value, _CLASSES) / size, "longest_run": F.expr(f"array_max(transform(regexp_extract_all(value, '{_CLASSES}', 0), x -> length(x)))").cast("double") / size,
        "distinct": distinct / size, "distinct_log": F.log2(distinct + 1), "hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"), "number": value.rlike("^[0-9 -]+$").cast("double"),
        "sections": _count(value, "[/_-]+"), "words": _count(value, "[A-Za-z]{4,}"), "vowels": _count(value, "(?i)[aeiou]") / size,
        "dictionary": 1 - covered / size,
        "path": (left.rlike(r"(?i)(?:https?:|www\.|\./|[/\\])\S*$") | value.rlike("^/|/.*/") | right.rlike(r"^\.(?:[a-z]{2,4})\b")).cast("double"),
        "named": left.rlike(rf"(?i)(?:{KEY_NAMES})[\"']?\s*[:=>]*\s*[\"']?$").cast("double"), "near_name": left.rlike(rf"(?i)\b(?:{KEY_NAMES})\b").cast("double"),
        "plain_name": last_word.rlike(rf"^(?:{PLAIN_NAMES})$").cast("double"), "assigned": left.rlike(r"[:=]\s*[\"']?$").cast("double"), "quoted": left.rlike("[\"']$").cast("double"),
        "key_file": value.rlike("^-----BEGIN").cast("double"),
    }


def describe(found: DataFrame) -> DataFrame:
    """The candidates with a column `features` (vector) of their properties and of the words and signs beside them."""

    made = _features()
    return VectorAssembler(inputCols=[f"_f_{k}" for k in made], outputCol="features").transform(found.select("*", *(F.coalesce(v, F.lit(0.0)).alias(f"_f_{k}") for k, v in made.items()))).drop(*(f"_f_{k}" for k in made))


def train(labelled: DataFrame, *, trees: int = 40, depth: int = 8, max_rows: int = TRAIN_ROWS, seed: int = 7):
    """Fit the forest on labelled findings: value, left, right (strings), label (1: a secret). Rows with nulls are not used."""

    rows = labelled.select(*(F.col(c).cast("string").alias(c) for c in ("value", "left", "right")), F.col("label").cast("double").alias("label")).dropna()
    rows = rows.orderBy(F.xxhash64("value", "left", "right"), "value", "left", "right", "label").limit(max_rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(describe(rows))


def scan(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, start, end, value, score (0 to 1), kept (score >= threshold).

    Null and empty texts, and those without candidates, give no rows; nor does an empty table. Texts are searched whole.
    Repeated rows give repeated findings. Columns other than doc_id and text aren't read.
    """

    scored = model.transform(describe(candidates(docs)))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.select("doc_id", "start", "end", "value", score.alias("score"), (score >= threshold).alias("kept"))


# --- labelled findings ------------------------------------------------------------------------------------------------


def _pick(key: str, choices: list[str]) -> Column:
    return F.element_at(F.array(*(F.expr(c) for c in choices)), (F.pmod(F.xxhash64("id", "seed", F.lit(key)), F.lit(len(choices))) + 1).cast("int"))


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 1) -> DataFrame:
    """A small labelled table made by rule: secrets in several alphabets, and numbers, words, paths and digests that are none."""

    rows = spark.range(n).withColumn("seed", F.lit(seed)).withColumn("hex", F.sha2(F.concat_ws("-", "seed", "id").cast("binary"), 256))
    rows = rows.withColumn("b64", F.translate(F.base64(F.unhex("hex")), "=", "")).withColumn("num", F.translate("hex", "abcdef", "012345"))
    dictionary = "array(" + ",".join(f"'{w}'" for w in DICTIONARY) + ")"
    word = [f"{dictionary}[pmod(xxhash64(id, seed, {k}), {len(DICTIONARY)})]" for k in range(4)]
    made = [f"translate(substring(hex, {8 * k + 1}, {k + 5}), '0123456789abcdef', 'aeiounrtslmdcpgh')" for k in range(4)]
    secret = ["substring(hex, 1, 40)", "substring(hex, 1, 32)", "upper(substring(hex, 1, 40))", "hex", "substring(b64, 1, 24)", "substring(b64, 1, 40)", "concat('AKIA', upper(translate(substring(b64, 1, 16), '+/', 'XY')))", "concat('sk_live_', translate(substring(b64, 3, 24), '+/', 'ab'))", "concat('ghp_', translate(substring(b64, 1, 36), '+/', 'cd'))", "substring(b64, 5, 12)", "concat(substring(b64, 1, 10), '!', substring(num, 1, 2))", "'-----BEGIN RSA PRIVATE KEY-----'"]
    named = [f"concat('{k}', '{sign}')" for k in ("token", "TOKEN", "api_key", "password", "secret", "auth_token", "Authorization", "access_key") for sign in (" = \"", "=", ": ", ": \"")]
    some = [f"concat({m}, ' ')" for m in made] + ["''"]
    plain = ["substring(num, 1, 16)", "substring(num, 1, 19)", "substring(num, 1, 24)", f"concat_ws('-', {made[0]}, {made[1]}, {made[2]}, substring(num, 1, 2))", f"concat_ws('_', {word[0]}, {word[1]}, {word[2]}, substring(num, 1, 3))", f"concat_ws('/', '', {word[0]}, {word[1]}, substring(num, 1, 4), {word[2]})", f"concat({word[0]}, {word[1]}, {word[2]}, substring(num, 1, 3))", f"concat('2024-', substring(num, 1, 2), '-', {made[0]}, '-', {made[1]}, '-', {made[2]})", f"concat({made[0]}, {made[1]}, {made[2]}, substring(num, 1, 1))", "concat_ws('-', substring(num, 1, 4), substring(num, 5, 4), substring(num, 9, 4), substring(num, 13, 4))"]
    ordinary = ["substring(hex, 1, 40)", "hex", "substring(hex, 1, 32)", "concat_ws('-', substring(hex, 1, 8), substring(hex, 9, 4), substring(hex, 13, 4), substring(hex, 17, 4), substring(hex, 21, 12))"]
    beside = [f"concat('{k}', '{sign}')" for k in ("commit", "sha256", "md5", "checksum", "uuid", "version", "etag", "hash") for sign in (" ", ": ", "=")]
    folder = [f"concat('{k}', {word[3]}, '/')" for k in ("https://cdn.example.com/", "/static/", "src/", "./img/", "http://www.site.org/")]
    empty = ["'password'", "'changeme'", "'xxxxxxxxxxxx'", "'********'", "concat(" + word[0] + ", '123')", "'your_token_here'", "'example'", "concat('<', 'redacted')", "'none,null'", "'placeholder1'", f"concat({word[0]}, {word[1]})", f"concat({made[0]}, {made[1]})"]
    kind = F.pmod(F.xxhash64("id", "seed", F.lit("kind")), F.lit(20))
    is_secret, none_named, in_path, digest = kind < 10, kind.between(10, 11), kind.between(12, 13), kind.between(14, 15)
    value = F.when(is_secret, _pick("secret", secret)).when(none_named, _pick("empty", empty)).when(in_path, F.when(kind == 12, _pick("ordinary", ordinary)).otherwise(_pick("plain", plain))).when(digest, _pick("ordinary", ordinary)).otherwise(_pick("plain", plain))
    left = F.when(is_secret | none_named, F.concat(_pick("some", some), _pick("named", named))).when(in_path, F.concat(_pick("some", some), _pick("folder", folder))).when(digest, F.concat(_pick("some", some), _pick("beside", beside))).otherwise(_pick("some", some))
    right = F.when(in_path, _pick("end", ["'.js'", "'.png'", "'/'", "' '"])).otherwise(_pick("after", ["'\"'", "' '", "'!! '", "'### '", "'.'", "''"]))
    return rows.select(value.alias("value"), left.alias("left"), right.alias("right"), is_secret.cast("int").alias("label"))
