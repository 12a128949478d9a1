"""Secret scan: candidates from one regular expression, false positives removed by a random forest.

Only DataFrame functions and Spark ML run: candidates are cut out of the text by a split at
their starts, features are expressions over the candidate and the text around it, and the
forest (TREES trees of depth DEPTH) is Spark ML's.  A candidate is a run of MIN_CHARS or more
of `[A-Za-z0-9_+/-]`, with the dots of a token in three parts, or, after an assignment to a
word like password, any value of MIN_VALUE or more characters up to a blank or quote.

Features: length, shares of character classes, transitions (between classes, and how likely
its pairs of characters are in ordinary words), distinct characters, dictionary coverage,
known prefixes and shapes, words and signs before and after it, and the path.  Pairs and
dictionary come from Language.learn: the words of all documents, counted by Spark; two small
tables, the pairs' scores and the DICTIONARY most frequent words, are put into the expressions.

The forest learns from labelled findings.  labelled_findings() makes a fixed set of them,
TRAIN_ROWS rows, from the formats of issued keys and of what is commonly mistaken for one;
a table of one's own with the same columns can be given instead.

A null or empty text has no candidates.  Rows that repeat a doc_id are scanned row by row.
`doc_id`, `text` and, if there, `source` (as the path) are read; other columns may have any
name.  Secrets are never written out, only their digest and place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import cut, dropped, stored, table

MIN_CHARS, MIN_VALUE, CONTEXT = 12, 8, 40
TREES, DEPTH, TRAIN_ROWS, SEED = 40, 8, 6000, 17
DICTIONARY = 1_000
CLASS = "[A-Za-z0-9_+/-]"
#: Prefixes of issued keys, words near secrets, words near look-alikes.
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|sk-|rk_live_|xox[abpr]-|AIza|eyJ|glpat-|npm_|SG[._])"
NEAR = "(?i)(key|token|secret|passw|pwd|auth|credential|private|bearer|access|login)"
FALSE_NEAR = "(?i)(example|sample|dummy|placeholder|sha1|sha256|md5|commit|uuid|guid|checksum|digest|etag|revision|isbn|order|invoice|version|build|branch|file|path|url|http)"
FALSE_WITHIN = "(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000)"
#: What assigns a value: a word of a secret, quotes, a sign of assignment.  Java looks back over a bounded length only.
ASSIGNED = "(?:passw(?:or)?d|passwd|pwd|secret|token|api_?key|apikey|credential)[\"']?[ \\t]{0,2}[:=][ \\t]{0,2}[\"'`]?"
VALUE = "[^\\s\"'`<>]"
DOTTED = "(?:eyJ[\\w-]{8,}(?:\\.[\\w-]+){1,2}|SG\\.[\\w-]{16,}\\.[\\w-]{16,})"
# One character decides first, then the few after a sign of assignment; only there is the long look back tried.
STARTS = f"(?<!{CLASS})(?={CLASS}{{{MIN_CHARS},}}|{DOTTED})|(?<=[:=\\s\"'`])(?<=[:=][ \\t\"'`]{{0,3}})(?={VALUE}{{{MIN_VALUE},}})(?<=(?i:{ASSIGNED}))"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_transitions", "f_pairs", "f_distinct", "f_dictionary", "f_hex", "f_digits_only", "f_uuid", "f_prefix",
    "f_near", "f_assigned", "f_false_near", "f_false_within", "f_near_after", "f_false_after", "f_path", "f_repeat",
)


@dataclass
class Language:
    """Log likelihoods of character pairs against chance, by 37 * first + second (0 is any other character), and common words."""

    pairs: list[float] = field(default_factory=lambda: [0.0] * (37 * 37))
    words: list[str] = field(default_factory=list)

    @staticmethod
    def learn(docs: DataFrame) -> Language:
        """From all documents; none give a language that tells nothing."""
        words = stored(docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,24}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
        common = words.where(F.col("w").rlike("^[a-z]{4,}$")).orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()
        # A pair counts once for each different word, so that frequent words don't outweigh the rest.
        at = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k")
        pairs = {r["p"]: r["n"] for r in words.where(F.col("w").rlike("[a-z]")).select("w", at).groupBy(F.expr("substring(w, k, 2)").alias("p")).agg(F.count("*").alias("n")).collect()}
        dropped(words)
        total = sum(pairs.values())
        chance = 1 / len(ALPHABET) ** 2
        score = [0.0] * (37 * 37)
        for i, x in enumerate(ALPHABET, 1):
            for j, y in enumerate(ALPHABET, 1):
                score[37 * i + j] = round(math.log((pairs.get(x + y, 0) + 0.5) / (total + 0.5 / chance) / chance), 4) if total else 0.0
        return Language(score, [r["w"] for r in common])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, start (code points), before, after, candidate, path.

    A run needs a digit, or letters of both cases inside, to be one; an assigned value doesn't.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    parts = docs.select("doc_id", path.alias("path"), F.split("text", STARTS, -1).alias("parts")).where(F.col("parts").isNotNull() & (F.size("parts") > 1) | F.col("parts")[0].rlike(f"^{CLASS}{{{MIN_CHARS},}}"))
    # Lengths are summed by groups of about the root of their number, so no start adds up all that is before it.
    parts = parts.withColumn("sizes", F.transform("parts", F.length)).withColumn("step", F.greatest(F.lit(1), F.floor(F.sqrt(F.size("parts")))).cast("int"))
    add = lambda some: F.aggregate(some, F.lit(0), lambda a, b: a + b)
    parts = parts.withColumn("sums", F.transform(F.sequence(F.lit(0), F.expr("(size(parts) - 1) div step")), lambda g: add(F.slice("sizes", g * F.col("step") + 1, F.col("step")))))

    def one(k: Column) -> Column:
        last, here = F.when(k > 0, F.get("parts", k - 1)).otherwise(""), F.array_join(F.slice("parts", k + 1, F.lit(3)), "")
        assigned = last.rlike(f"(?i){ASSIGNED}$")
        run = F.regexp_extract(here, f"^(?:{DOTTED}|{CLASS}{{{MIN_CHARS},}}={{0,2}})", 0)
        value = F.regexp_extract(here, f"^{VALUE}{{{MIN_VALUE},}}", 0)
        sound = F.when(run.rlike("[0-9]|[a-z][A-Z].*[a-z]"), run).otherwise("")
        found = F.when(assigned & (F.length(value) > F.length(sound)), value).otherwise(sound)
        # What goes on from a token in parts, or from an assigned value, is no candidate of its own.
        inner = last.rlike(f"^(eyJ[\\w-]{{8,}}|SG|[\\w-]{{16,}})\\.$") & F.when(k > 1, F.get("parts", k - 2).rlike("(?<![\\w.-])$|^eyJ[\\w-]+\\.$")).otherwise(True) & last.rlike("^(eyJ|SG|[\\w-]{16,}\\.$)")
        inner = inner | (k > 1) & F.coalesce(F.get("parts", k - 2).rlike(f"(?i){ASSIGNED}$") & last.rlike(f"^{VALUE}+$"), F.lit(False))
        return F.struct(k.alias("k"), F.when(F.coalesce(inner, F.lit(False)), "").otherwise(found).alias("candidate"), F.right(last, F.lit(CONTEXT)).alias("before"), here.alias("here"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), one), lambda x: x["candidate"] != "")
    start = lambda k: add(F.slice("sums", F.lit(1), F.floor(k / F.col("step")).cast("int"))) + add(F.slice("sizes", F.floor(k / F.col("step")).cast("int") * F.col("step") + 1, k % F.col("step")))
    placed = F.transform(found, lambda x: F.struct(x["candidate"].alias("candidate"), x["before"].alias("before"), F.substring(x["here"], F.length(x["candidate"]) + 1, F.lit(CONTEXT)).alias("after"), start(x["k"]).alias("start")))
    return parts.select("doc_id", "path", F.posexplode(placed).alias("ordinal", "x")).select("doc_id", "ordinal", F.col("x.start").cast("long").alias("start"), "x.before", "x.after", "x.candidate", "path")


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def with_features(found: DataFrame, language: Language) -> DataFrame:
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    size = F.length(c)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "_")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1"))
    known = F.split(F.lit(" ".join(language.words)), " ")
    words = F.split(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])|[^A-Za-z]+", " ")), " ")
    covered = F.aggregate(F.filter(words, lambda w: (w != "") & F.array_contains(known, w)), F.lit(0), lambda n, w: n + F.length(w))
    low, likely = F.lower(c), F.split(F.lit(" ".join(map(str, language.pairs))), " ").cast("array<double>")
    code = lambda k: F.call_function("locate", F.substring(low, k, F.lit(1)), F.lit(ALPHABET))
    pairs = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.lit(0.0), lambda t, k: t + F.get(likely, code(k) * 37 + code(k + 1)))
    values = {
        "f_length": size.cast("double"),
        "f_digits": _share(c, "[0-9]"),
        "f_upper": _share(c, "[A-Z]"),
        "f_lower": _share(c, "[a-z]"),
        "f_signs": _share(c, "[^A-Za-z0-9]"),
        "f_transitions": (runs - 1) / size,
        "f_pairs": pairs / size,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(32)),
        "f_dictionary": covered / size,
        "f_hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "f_digits_only": flag(c.rlike("^[0-9_+/=-]+$")),
        "f_uuid": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "f_prefix": flag(c.rlike(PREFIXES)),
        "f_near": flag(before.rlike(NEAR)),
        "f_assigned": flag(before.rlike("[:=][ \\t]*[\"'`]?$") | before.rlike("(?i)bearer $")),
        "f_false_near": flag(before.rlike(FALSE_NEAR)),
        "f_false_within": flag(c.rlike(FALSE_WITHIN)),
        "f_near_after": flag(after.rlike(NEAR)),
        "f_false_after": flag(after.rlike(FALSE_NEAR)),
        "f_path": flag(F.col("path").rlike("(?i)(test|example|sample|docs?/|fixture|mock)")),
        "f_repeat": F.length(c) / F.greatest(F.length(F.regexp_replace(c, r"(.)\1+", "$1")), F.lit(1)),
    }
    return found.withColumns({k: v.cast("double") for k, v in values.items()})


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """before, after, candidate, path, label: a fixed training set; every value comes from a hash of its number."""
    base = spark.range(0, rows, 1, 2).select("id", F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512).alias("h"), F.pmod(F.xxhash64("id"), F.lit(65536)).alias("r"))
    b64 = F.translate(F.base64(F.unhex("h")), "\n", "")
    letters = F.translate(F.col("h"), "0123456789", "ghijklmnop")
    size = (F.col("r") % 24 + 16).cast("int")
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in ("index", "release", "config", "version", "thention", "ouering", "menting", "build", "station", "result", "einzelung", "ciones")]), (F.conv(F.substring("h", k, 3), 16, 10).cast("int") % 12 + 1).cast("int"))
    secret_near = F.element_at(F.array(*[F.lit(x) for x in ('token = "', "password=", "api_key: ", "secret = '", "Authorization: Bearer ", "access_key=", "private_key: ", "pwd=", 'auth_token: "', "login ")]), (F.col("r") % 10 + 1).cast("int"))
    plain_near = F.element_at(F.array(*[F.lit(x) for x in ("commit ", "sha256: ", "checksum=", "order ", "the file ", "see http://host/", "version ", "uuid ", " of the and ", "etag: ", "example ", "isbn ")]), (F.col("r") % 12 + 1).cast("int"))
    upper = F.upper(F.translate(F.col("h"), "0123456789", "ghijk01234"))
    kinds = [
        (secret_near, F.substring("h", 1, 40), 1), (secret_near, F.expr("substring(h, 1, 16 + r % 48)"), 1), (secret_near, F.expr("substring(h, 1, 12 + r % 10)"), 1),
        (secret_near, F.substring(b64, 1, 40), 1), (F.lit(" x "), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), 1), (F.lit("in "), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 36)), 1),
        (F.lit(""), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64, "[+/=]", "Q"), 1, 24)), 1), (F.lit("and the "), F.expr("substring(h, 1, 10 + r % 16)"), 1), (F.lit("of api_key="), F.substring(b64, 1, 32), 1),
        (F.lit('password: "'), F.concat(F.initcap(F.substring(letters, 1, 4)), F.substring("h", 20, 3), F.lit("&"), F.substring(letters, 9, 3), F.lit("!")), 1), (F.lit("pwd = '"), F.concat(F.substring(b64, 1, 6), F.lit("#"), F.substring(b64, 8, 4)), 1), (F.lit("and "), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 36)), 1),
        (F.lit("Bearer "), F.concat(F.lit("eyJ"), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 17), F.lit(".eyJ"), F.substring(F.regexp_replace(b64, "[+/=]", "y"), 10, 30), F.lit("."), F.substring(F.regexp_replace(b64, "[+/=]", "z"), 30, 40)), 1), (F.lit("see "), F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")), 0), (F.lit("password: "), F.concat(word(1), F.lit("s")), 0), (F.lit('token = "'), F.concat_ws("_", word(1), word(4), word(7)), 0), (F.lit("secret: <"), F.concat(F.lit("your-"), word(2), F.lit("-here")), 0),
        (plain_near, F.substring("h", 1, 40), 0), (plain_near, F.substring("h", 1, 64), 0), (plain_near, F.expr("concat_ws('-', substring(h,1,8), substring(h,9,4), substring(h,13,4), substring(h,17,4), substring(h,21,12))"), 0),
        (F.lit("with "), F.expr("translate(substring(h, 1, 16), 'abcdef', '123456')"), 0), (plain_near, F.concat_ws("_", word(1), word(4), F.expr("conv(substring(h, 9, 2), 16, 10)")), 0), (plain_near, F.concat_ws("-", word(1), F.lit("2024-01"), F.expr("conv(substring(h, 9, 2), 16, 10)")), 0),
        (secret_near, F.concat(F.lit("your_"), word(2), F.lit("_key_here_1")), 0), (secret_near, F.rpad(F.lit("x1"), 20, "x"), 0), (secret_near, F.rpad(F.lit("0"), 16, "0"), 0),
        (plain_near, F.concat_ws("/", word(1), word(4), word(7), F.expr("conv(substring(h, 9, 2), 16, 10)")), 0), (plain_near, F.concat(word(1), F.initcap(word(4)), F.initcap(word(7))), 0), (F.lit(" ont "), F.concat(F.initcap(letters.substr(F.lit(1), size)), F.lit("1")), 0),
    ]
    option = F.element_at(F.array(*[F.struct(b.alias("before"), c.alias("candidate"), F.lit(y).alias("label")) for b, c, y in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    return base.select(option.alias("x"), F.when(F.col("r") % 50 == 0, "tests/fixture").otherwise("src").alias("path"), F.when(F.col("r") % 7 == 0, " in the file").otherwise('"').alias("after")).select("x.before", "after", "x.candidate", "path", F.col("x.label").cast("double").alias("label"))


def train(findings: DataFrame, language: Language) -> PipelineModel:
    gathered = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    rows = cut(gathered.transform(with_features(findings, language)).select("features", "label"))
    return PipelineModel([gathered, forest.fit(rows)])


def scored(found: DataFrame, model: PipelineModel, language: Language, threshold: float = 0.5) -> DataFrame:
    """Candidates with probability and is_secret."""
    p = F.round(vector_to_array("probability").getItem(1), 9)
    return model.transform(with_features(found, language)).withColumn("p", p).withColumn("is_secret", F.col("p") >= threshold)


def scan(docs: DataFrame, model: PipelineModel, language: Language, threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal, start, n_chars, probability, is_secret, candidate_sha256; a row for each candidate."""
    out = scored(candidates(docs), model, language, threshold)
    return out.select("doc_id", "ordinal", "start", F.length("candidate").cast("long").alias("n_chars"), F.col("p").alias("probability"), "is_secret", F.sha2("candidate", 256).alias("candidate_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    language = Language.learn(docs)
    return scan(docs, train(labelled_findings(spark), language), language)
