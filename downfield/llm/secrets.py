"""Secret scans: candidate strings, then a random forest that removes false positives."""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.llm.common import words
from downfield.session import materialise

# A candidate is a run of at least so many key characters anywhere within a word, with the padding that ends it.
LEAST = 12
KEY_CHARS = r"[A-Za-z0-9_+/\-]"
CANDIDATE = rf"({KEY_CHARS}{{{LEAST},}}+(?:={{1,2}}(?![A-Za-z0-9_+/=\-]))?)"
# A word of ordinary writing: letters only, or digits only. Its runs count if issued as keys are or if a hint stands before.
PLAIN = r"^[^0-9]*$|^[0-9.,:+()/\-]*$"
ISSUED = r"^(A(KIA|SIA|ROA|IDA|GPA)[A-Z0-9]|AIza|gh[pousr]_|github_pat_|glpat-|npm_|pypi-|hf_|[rs]k_(live|test)_|sk-|xox[abeoprs]-|ya29|eyJ)"
# Where a word is cut into settings, so that a hint counts for the runs of its own setting. No run goes beyond.
SETTING_ENDS = r"(?<=[,;&?{}])"
TREES, DEPTH, SEED = 30, 6, 7
THRESHOLD = 0.5
# A forest is fitted on at most so many labelled findings, by a hash of the finding.
MAX_LABELLED = 20_000

HINTS = r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|api.?key|access.?key|credential|auth|bearer|private|signature)"
HARMLESS = r"(?i)(commit|sha1?|md5|digest|checksum|hash|uuid|guid|version|isbn|order|invoice|phone|card|build|revision|etag|example|sample|placeholder|dummy)"
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|fixtures?|examples?|samples?|docs?|mock)([/_.\-]|$)"
# Frequent letter groups of ordinary words; the share of a candidate that they cover tells words from keys.
DICTIONARY = ("the|and|ing|ion|tion|ent|for|tha|ter|est|ers|all|ate|ver|con|com|per|pro|sta|men|are|his|ess|our|was|ith|her|"
              "not|but|one|out|use|man|day|get|has|him|how|new|now|old|see|two|way|who|did|its|let|put|say|she|too|page|name|"
              "user|data|file|line|time|list|type|value|class|table|index|image|example|test|sample|http|www|html|change|key")
FEATURES = ("length", "n_digits", "n_upper", "n_lower", "n_other", "transitions", "same_pairs", "kinds", "dictionary", "hex",
            "distinct", "hint", "harmless", "assigned", "quoted", "test_path")


def with_features(findings: DataFrame) -> DataFrame:
    """Add ``FEATURES`` to (candidate, word, before, after, path): the candidate, the word it stands in, the two words
    before and the one after, and the path of the file or null. ``head`` and ``tail`` are what stands around the candidate
    in its word; without them they are cut from the word."""
    c = F.col("candidate")
    if "head" not in findings.columns:
        start = F.expr("instr(word, candidate)")
        findings = findings.withColumns({"head": F.substring("word", F.lit(1), start - 1),
                                         "tail": F.substring("word", start + F.length(c), F.length("word"))})
    size = F.length(c).cast("double")

    def count(pattern: str) -> Column:
        return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))

    # One letter for each kind of character: a border between two kinds is a transition.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "_")
    borders = F.length(kinds) - F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    around = F.concat_ws(" ", "before", "head")
    distinct = F.size(F.array_distinct(F.split(c, "")))
    values = {
        "length": size, "n_digits": count("[0-9]") / size, "n_upper": count("[A-Z]") / size, "n_lower": count("[a-z]") / size,
        "n_other": count("[^A-Za-z0-9]") / size, "transitions": (F.length(kinds) - borders - 1) / size,
        "same_pairs": (F.length(c) - F.length(F.regexp_replace(c, r"(.)\1+", "$1"))) / size,
        "kinds": F.length(F.concat_ws("", F.sort_array(F.array_distinct(F.split(kinds, ""))))),
        "dictionary": (F.length(c) - F.length(F.regexp_replace(F.lower(c), DICTIONARY, ""))) / size,
        "hex": F.rlike(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "distinct": distinct / F.least(size, F.lit(32.0)),
        "hint": F.rlike(around, F.lit(HINTS)), "harmless": F.rlike(F.concat_ws(" ", around, "after", c), F.lit(HARMLESS)),
        "assigned": F.rlike(around, F.lit(r"[=:]\s*[\"']?$")), "quoted": F.rlike("head", F.lit(r"[\"']$")) & F.rlike("tail", F.lit(r"^[\"']")),
        "test_path": F.rlike(F.coalesce("path", F.lit("")), F.lit(TEST_PATH)),
    }
    return findings.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(candidate, word, before, after, path, secret): findings of known kinds, made by rule from hashes of a counter.

    Half are keys in the forms that keys are issued in, after a word that names them or bare. The others are what a
    scan brings up besides: checksums named as such, identifiers, card and order numbers, long compound words, paths,
    placeholders."""
    i = F.col("id")
    hexes = F.concat(F.sha2(i.cast("string").cast("binary"), 256), F.sha2(F.concat(F.lit("more"), i.cast("string")).cast("binary"), 256))
    upper = F.substring(F.regexp_replace(F.upper(F.base64(F.unhex(hexes))), "[^A-Z0-9]", ""), 1, 16)
    mixed = F.regexp_replace(F.base64(F.unhex(F.substring(hexes, 1, 60))), "[+/=]", "x")
    syllables = [F.element_at(F.array(*[F.lit(s) for s in (
        "the", "ing", "er", "tion", "ver", "an", "men", "re", "st", "en", "keit", "ous", "ation", "que", "ble", "ment")]),
        (F.conv(F.substring(hexes, 2 * k + 1, 1), 16, 10).cast("int") + 1)) for k in range(7)]
    digits = F.substring(F.regexp_replace(hexes, "[a-f]", ""), 1, 16)
    kind = (i % 18).cast("int")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4),
                       F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    # (candidate, what stands before it in its word, what stands after it in its word, words before, label)
    kinds = [
        (F.concat(F.lit("AKIA"), upper), "", "", "word and", 1), (F.concat(F.lit("AKIA"), upper), "access_key=", "", "with the", 1),
        (F.substring(hexes, 1, 18), "password=", "", "then a", 1), (F.substring(hexes, 1, 40), '"', '"', "token =", 1),
        (F.substring(hexes, 1, 32), "api_key:", "", "set the", 1), (mixed, '"', '"', "secret =", 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), "", "", "as in", 1), (mixed, "Bearer:", "", "send auth", 1),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), "", ",", "of the", 1),
        (F.substring(hexes, 1, 40), "", "", "see commit", 0), (F.substring(hexes, 1, 32), "md5=", "", "file checksum", 0),
        (uuid, "", "", "order uuid", 0), (digits, "", "", "the card", 0), (F.concat(*syllables), "", ".", "this is", 0),
        (F.concat_ws("_", syllables[0], F.lit("value"), syllables[1], F.lit("2024")), "", "", "column name", 0),
        (F.concat_ws("/", F.lit("home"), syllables[1], syllables[2], F.lit("page01")), "", "", "path is", 0),
        (F.concat(F.lit("EXAMPLE"), F.lit("KEY000"), F.substring(digits, 1, 3)), "token=", "", "sample", 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(digits, 1, 2)), "password=", "", "placeholder", 0),
    ]

    def pick(values: list[Column]) -> Column:
        out = F.when(kind == 0, values[0])
        for k, v in enumerate(values[1:], 1):
            out = out.when(kind == k, v)
        return out

    made = spark.range(n).select(
        "id", pick([k[0] for k in kinds]).alias("candidate"), pick([F.lit(k[1]) for k in kinds]).alias("open"),
        pick([F.lit(k[2]) for k in kinds]).alias("close"), pick([F.lit(k[3]) for k in kinds]).alias("before"),
        pick([F.lit(k[4]) for k in kinds]).alias("secret"))
    path = F.when(F.floor(i / 18) % 5 == 0, F.concat(F.lit("src/part"), i.cast("string"), F.lit(".py")))
    return made.select("candidate", F.concat("open", "candidate", "close").alias("word"), "before", F.lit("and").alias("after"),
                       path.alias("path"), "secret")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest over ``FEATURES``; reruns on the same findings agree."""
    rows = (with_features(labelled.where("secret is not null")).withColumn("label", F.col("secret").cast("double"))
            .orderBy(F.md5(F.concat_ws("\u0001", "candidate", "word", "before")), "label").limit(MAX_LABELLED))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors.repartition(1))


def running_sums(sizes: Column) -> Column:
    """For each item of an array the sum of those before it. Sums of blocks of about the root of its length keep the work at the
    length times that root, with no array longer than the given one."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, b: a + b)

    # Arrays are bound as lambda variables, so that they are computed once and not for each item.
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / width).cast("int")),
                         lambda b: total(F.slice(sizes, b * width + 1, width)))
    return F.get(F.transform(F.array(F.struct(sizes.alias("s"), width.alias("w"), blocks.alias("b"))), lambda x: F.get(F.transform(
        F.array(F.transform(x["b"], lambda _, k: total(F.slice(x["b"], F.lit(1), k)))), lambda starts: F.transform(
            x["s"], lambda _, k: F.get(starts, F.floor(k / x["w"]).cast("int")) + total(F.slice(
                x["s"], F.floor(k / x["w"]).cast("int") * x["w"] + 1, k % x["w"])))), F.lit(0))), F.lit(0))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, offset, candidate, head, tail, before, after, path): every long run of key characters in the words of
    the whole texts. Those of words of letters only or digits only count where they begin as issued keys do or a hint
    stands before them. place counts the words from 0, offset the characters of the word before the run; head is what stands before it
    in its setting, a part of the word, from the previous run on, after the first hint and the first harmless word of the
    setting; tail is what follows up to the next run."""
    w = F.col("w")
    path = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    split = docs.select("doc_id", path.alias("path"), words(F.col("text")).alias("w")).where(F.size(w) > 0)
    long = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(F.get(w, i)) >= LEAST) & F.rlike(
        F.get(w, i), F.lit(CANDIDATE)))
    found = F.transform(long, lambda i: F.struct(
        i.alias("place"), F.get(w, i).alias("word"),
        F.concat_ws(" ", F.when(i > 1, F.get(w, i - 2)), F.when(i > 0, F.get(w, i - 1))).alias("before"),
        F.coalesce(F.get(w, i + 1), F.lit("")).alias("after")))
    in_words = split.select("doc_id", "path", F.explode(found).alias("x")).select(
        "doc_id", "path", "x.place", "x.before", "x.after", F.explode(F.array(F.struct(
            F.rlike("x.word", F.lit(PLAIN)).alias("plain"), F.split("x.word", SETTING_ENDS, -1).alias("parts")))).alias("cut")).select(
        "doc_id", "path", "place", "before", "after", "cut.plain", "cut.parts")
    settings = F.filter(F.arrays_zip("parts", running_sums(F.transform("parts", F.length)).alias("start")),
                        lambda x: F.rlike(x["parts"], F.lit(CANDIDATE)))

    # What a setting hints at first, with the place where that ends, counts for the runs behind it.
    def first(pattern: str) -> Column:
        return F.struct(F.regexp_extract("x.parts", pattern, 0).alias("text"),
                        F.length(F.regexp_extract("x.parts", rf"(?s)^.*?(?:{pattern})", 0)).alias("end"))

    # A setting's gaps are one more than its runs; gap k stands before run k.
    in_settings = in_words.select("doc_id", "path", "place", "before", "after", "plain",
                                  F.explode(settings).alias("x")).select(
        "doc_id", "path", "place", "before", "after", "plain", "x.start", F.explode(F.array(F.struct(
            F.regexp_extract_all("x.parts", F.lit(CANDIDATE), F.lit(1)).alias("runs"), F.split("x.parts", CANDIDATE, -1).alias("gaps"),
            first(HINTS).alias("hint"), first(HARMLESS).alias("harmless")))).alias("cut")).select("*", "cut.*").drop("cut")
    sizes = F.zip_with("gaps", "runs", lambda gap, run: F.length(gap) + F.coalesce(F.length(run), F.lit(0)))
    each = F.arrays_zip("runs", "gaps", F.slice("gaps", F.lit(2), F.size("gaps")).alias("next"),
                        F.concat(F.array(F.lit("")), "runs").alias("last"), running_sums(sizes).alias("at"))
    runs = in_settings.select("doc_id", "path", "place", "before", "after", "plain", "start", "hint", "harmless", F.explode(each).alias("y")).where(
        "y.runs is not null").withColumn("at", F.col("y.at") + F.length("y.gaps"))
    told = [F.when((F.col(f"{c}.end") > 0) & (F.col(f"{c}.end") <= F.col("at")), F.concat(f"{c}.text", F.lit(" "))).otherwise("")
            for c in ("hint", "harmless")]
    hinted = F.rlike(F.concat_ws(" ", "before", "head"), F.lit(HINTS))
    return (runs.select("doc_id", "path", "place", "before", "after", "plain", (F.col("start") + F.col("at")).alias("offset"),
                        F.col("y.runs").alias("candidate"), F.concat(*told, "y.last", "y.gaps").alias("head"), F.col("y.next").alias("tail"))
            .where(~F.col("plain") | F.rlike("candidate", F.lit(ISSUED)) | hinted).drop("plain"))


def scan(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per finding: doc_id, place, offset, n_chars, sha256 of the candidate, score and secret (score of at least one half).

    Null, empty and blank texts have no findings, an empty table gives none; long texts and words of very many runs are scanned
    whole; repeated rows and repeated keys repeat their findings; a null doc_id is kept; other columns but ``path`` are ignored."""
    model = train(materialise(labelled))
    found = materialise(with_features(candidates(docs)).select("doc_id", "place", "offset", "candidate", *FEATURES))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", F.col("place").cast("long").alias("place"), F.col("offset").cast("long").alias("offset"),
                         F.length("candidate").cast("long").alias("n_chars"),
                         F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"), "score",
                         (F.col("score") >= THRESHOLD).alias("secret"))
