"""Secret scan with a random forest against false positives; DataFrame functions only.

Candidates are long runs of key characters, shorter ones behind a key word.
Each is described by its length, the transitions between its character classes,
the share that a dictionary covers, and its surroundings: paths and links that
it stands in and the words in front of it.  The dictionary holds the corpus's
own most frequent words.  A random forest that was trained on labelled findings
decides which candidates are secrets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import Scratch, frequent_rows

#: Characters kept in front of and behind a candidate.
CONTEXT = 48

#: Words that announce a credential.  Fixed values.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "key")

_KEY_CHAR = r"[A-Za-z0-9_\-+/=.~]"

#: A run of key characters with at least one digit or change of case is looked at; it is shorter behind a key word.
#: A leading ``name=`` is not part of it.
RUN = (
    rf"(?=[A-Za-z0-9_\-+/.~]{_KEY_CHAR}{{7}})(?![A-Za-z0-9_.\-]{{1,40}}=[A-Za-z0-9_\-+/.~])"
    rf"(?:{_KEY_CHAR}{{16,}}|(?<=[\s\"'`=:])(?<=(?i:{'|'.join(KEY_WORDS)})[\"'`]?\s{{0,2}}[=:]{{0,2}}\s{{0,2}}[\"'`]?){_KEY_CHAR}{{8,}})"
)

#: Words that announce something else of the same look.  Fixed values.
PLAIN_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "etag", "hash", "integrity", "revision", "version", "file", "path")

#: A whole word of a text, and a word inside a candidate, both in lower case later.
WORD, PIECE = r"(?<![A-Za-z0-9])[A-Za-z]{4,20}(?![A-Za-z0-9])", r"[A-Z]?[a-z]{3,20}|[A-Z]{4,20}"

#: Common letter groups and the words of the example findings.  Fixed values.
DICTIONARY = (
    "the and ing ion tion ent her for tha nth int ere ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont test data name user file path config "
    "service server client module package index main example default value public static class function image document content style script page home account "
    "about search query result report index version update node list item type view model base core util common lib src build dist node_modules org com net www http https"
).split()

FEATURES = ("length", "digit_share", "upper_share", "symbol_share", "transitions", "hex_only", "distinct_share", "dictionary_share", "group_share", "longest_letters", "path_like", "in_path", "quoted", "assigned", "key_word", "plain_word", "known_prefix", "separators")

#: Prefixes of well-known credential formats.  Fixed values.
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|pk_live_|rk_live_|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: ``doc_id, start`` (code points, from 1)``, candidate, before, after``.

    Only texts and, in them, only pieces between white space that hold a run
    are split up, so ordinary words never become rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(RUN))
    # Split at the runs themselves: the pieces between them give positions and context.
    cut = docs.select("doc_id", F.split("text", RUN, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"))
    widths = F.transform("runs", lambda x, i: F.char_length(F.get("gaps", i)) + F.char_length(x))
    cut = cut.select("doc_id", "gaps", "runs", _running_sums(widths).alias("ends"))
    # Each row takes its own neighbourhood only.
    rows = F.transform(
        "runs",
        lambda x, i: F.struct(
            (F.get("ends", i) - F.char_length(x) + 1).cast("long").alias("start"),
            x.alias("candidate"),
            F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    rows = F.filter(rows, lambda x: x["candidate"].rlike(r"[0-9]|[a-z][A-Z]"))
    return cut.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def _running_sums(sizes: Column) -> Column:
    """Sums up to each element, its own included, by doubling: after step k each holds the sum of up to 2**k elements."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(2)))).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.aggregate(steps, sizes, step)


def corpus_words(docs: DataFrame, most: int, text_col: str = "text") -> DataFrame:
    """The most frequent words of all texts and those of DICTIONARY: ``word``, at most ``most`` and some 80 rows."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).where("n > 1")
    counts = Scratch(docs.sparkSession, "words").save(counts, "counts")
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in DICTIONARY if len(w) > 3])).alias("word"))
    return frequent_rows(counts, "n", most).select("word").unionByName(fixed).distinct()


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``covered``: how many characters of each candidate are words of the dictionary, which is small enough for every task."""
    pieces = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit(PIECE), F.lit(0))).alias("piece"))
    hits = pieces.join(F.broadcast(words), F.lower("piece") == F.col("word"))
    covered = hits.groupBy("candidate").agg(F.sum(F.char_length("piece")).alias("covered"))
    return found.join(covered, "candidate", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def _count(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the vector ``features`` to rows of ``candidate, before, after, covered``."""
    c, size = F.col("candidate"), F.char_length("candidate").cast("double")
    before = F.lower(F.coalesce("before", F.lit("")))
    near = F.regexp_extract(before, r"([^\n]{0,32})$", 1)
    rest = F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "-")
    said = lambda words: F.when(near.rlike("(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)"), 1.0).otherwise(0.0)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    rows = found.withColumns(
        {
            "length": F.log1p(size),
            "digit_share": _count("[0-9]", c) / size,
            "upper_share": _count("[A-Z]", c) / size,
            "symbol_share": _count("[^A-Za-z0-9]", c) / size,
            "transitions": (F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double") - 1) / size,
            "hex_only": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "distinct_share": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(size, F.lit(64.0)),
            "dictionary_share": F.col("covered") / size,
            "group_share": 1 - F.char_length(rest) / size,
            "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda w: F.char_length(w))).cast("double") / size,
            "path_like": flag(c.rlike(r"/.*/|\.[a-z]{2,4}($|/)|^www\.|//")),
            "in_path": flag(F.coalesce("before", F.lit("")).rlike(r"://\S*$|[/\\]\S*$|[A-Za-z]:$|[?&%@]\S*$") | F.coalesce("after", F.lit("")).rlike(r"^[/\\?%&@]")),
            "quoted": flag(F.coalesce("before", F.lit("")).rlike("[\"'`]$")),
            "assigned": flag(before.rlike("[=:][ \"'`]*$")),
            "key_word": said(KEY_WORDS),
            "plain_word": said(PLAIN_WORDS),
            "known_prefix": flag(c.rlike(KNOWN_PREFIX)),
            "separators": _count("[-_.]", c),
        }
    )
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows).drop(*FEATURES)


@dataclass(frozen=True)
class Settings:
    """The forest, its decision threshold, and the bounds on the labelled findings it is trained on and on the dictionary's words."""

    trees: int = 24
    depth: int = 6
    threshold: float = 0.5
    findings: int = 20_000
    words: int = 50_000
    seed: int = 5


def example_texts(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Texts of one finding each, made from seeded hashes: ``doc_id, text, secret``.

    Secrets are random keys in usual formats; the others are digests,
    identifiers, paths, links and joined words of the same lengths.  Both stand
    in every mix of key word, assignment and quotes, and bare.  Only plain hex
    needs its surroundings: it is a secret behind a key word alone.
    """
    rows = spark.range(n).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)).alias(f"h{k}") for k in range(9)])
    hexes = F.sha2(F.concat(F.lit("s"), "id"), 256)
    mixed = F.translate(F.base64(F.unhex(hexes)), "+/=", "xY0")
    pick = lambda words, h: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.col(h), F.lit(len(words))) + 1).cast("int"))
    word = lambda h: pick(DICTIONARY[:60], h)
    kind = F.pmod(F.col("id"), F.lit(12))
    key, plain, sign, quote = pick(KEY_WORDS, "h0"), pick(PLAIN_WORDS, "h1"), pick((" = ", "=", ": ", ":"), "h2"), pick(('"', "'", '"'), "h3")
    candidate = (
        F.when(kind == 0, F.substring(hexes, 1, 40))
        .when(kind == 1, F.substring(hexes, 1, 32))
        .when(kind == 2, F.substring(mixed, 1, 40))
        .when(kind == 3, F.concat(pick(("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"), "h1"), F.substring(mixed, 1, 30)))
        .when(kind == 4, F.substring(mixed, 1, 24))
        .when(kind == 5, F.substring(hexes, 1, 64))
        .when(kind == 6, F.substring(hexes, 1, 40))
        .when(kind == 7, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)))
        .when(kind == 8, F.concat_ws("/", word("h0"), word("h1"), word("h2"), F.concat(word("h3"), F.lit(".html"))))
        .when(kind == 9, F.concat_ws(".", F.lit("www"), F.concat(word("h0"), word("h1"), F.pmod("h2", F.lit(90))), F.lit("example"), F.lit("com")))
        .when(kind == 10, F.concat(word("h0"), F.initcap(word("h1")), F.initcap(word("h2")), F.initcap(word("h3")), F.pmod("h1", F.lit(100))))
        .otherwise(F.concat(F.pmod("h0", F.lit(9000)) + 1000, F.lpad(F.col("h1").cast("string"), 7, "0"), F.lpad(F.col("h2").cast("string"), 7, "1")))
    )
    odd = lambda h: F.pmod(F.col(h), F.lit(2)) == 1
    none = F.lit("")
    keyed, marked = F.when((kind < 2) | odd("h4"), F.concat(F.lit(" "), key)).otherwise(none), odd("h5")
    named = F.when(kind.isin(5, 6) & ((keyed != "") | odd("h6")) | (kind.between(7, 11) & odd("h6")), F.concat(F.lit(" "), plain)).otherwise(none)
    quote = F.when(odd("h7"), quote).otherwise(none)
    before = F.concat(word("h8"), keyed, named, F.when(marked, sign).otherwise(F.lit(" ")), quote)
    # one in eight stands in a link, of either kind: behind a parameter's name, or as a part of the path
    link = F.pmod(F.col("h8"), F.lit(8)) == 0
    where = F.when(kind < 5, F.concat(F.lit("?"), key, F.lit("="))).otherwise(F.concat(F.lit("/"), word("h1"), F.lit("?"), pick(("id", "page", "ref", "rev", "q"), "h0"), F.lit("=")))
    before = F.when(link, F.concat(F.lit("https://"), word("h3"), F.lit(".example.org"), where)).otherwise(before)
    quote = F.when(link, none).otherwise(quote)
    return rows.select(F.col("id").alias("doc_id"), F.concat(before, candidate, quote, F.lit(" "), word("h2")).alias("text"), (kind < 5).cast("double").alias("secret"))


def example_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Labelled findings, as ``candidates`` cuts them from ``example_texts``: ``candidate, before, after, secret``."""
    # The texts are written first: the search names its text many times, and each time the planner would put in all that makes it.
    texts = Scratch(spark, "examples").save(example_texts(spark, n), "texts")
    return candidates(texts).join(texts.select("doc_id", "secret"), "doc_id").select("candidate", "before", "after", "secret")


def train_filter(findings: DataFrame, words: DataFrame, settings: Settings = Settings()) -> RandomForestClassificationModel:
    """A forest from at most ``settings.findings`` labelled findings, those with the smallest seeded hash."""
    rows = findings.where("candidate is not null and secret is not null")
    rows = rows.orderBy(F.xxhash64(F.lit(settings.seed), "candidate", "before"), "candidate").limit(settings.findings)
    # Features are written once: the forest reads its rows many times, and each reading would plan and compile all of this anew.
    rows = with_features(with_coverage(rows, words)).select("features", F.col("secret").cast("double").alias("secret"))
    rows = Scratch(findings.sparkSession, "findings").save(rows.coalesce(4), "features")
    return RandomForestClassifier(labelCol="secret", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed).fit(rows)


def scan_secrets(docs: DataFrame, findings: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of all texts with the forest's judgement.

    One row per candidate: ``doc_id, start, length, candidate_sha256, score,
    secret``.  The candidate itself is not repeated in the result; its digest
    tells equal ones apart.

    Null and empty texts have no candidates.  Repeated rows repeat their
    candidates.  A null id is reported as null.  Other columns are not read; an
    empty table gives an empty result.  Findings that hold only one class
    give a forest that always says that class.
    """
    words = Scratch(docs.sparkSession, "secrets").save(corpus_words(docs, settings.words, text_col), "dictionary")
    model = train_filter(findings, words, settings)
    found = Scratch(docs.sparkSession, "secrets").save(candidates(docs, id_col, text_col), "found")
    judged = model.transform(with_features(with_coverage(found, words)))
    score = vector_to_array("probability")[1] if model.numClasses > 1 else F.lit(0.0)
    return judged.select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), score.alias("score"), (score >= settings.threshold).alias("secret"))
