"""Secret scans: candidates from text, false positives removed by a random forest.

Candidates are runs of at least 16 letters, digits and ``+ / _ = -`` with a
digit among them; a word without blanks can hold many, and each is one. Features: length, character transitions (runs of letters and
digits for each character), kinds and variety of characters, the share that
dictionary words cover, path and address marks, and the neighbouring words, or
what stands beside the run inside its own word: an assignment, words that name secrets, words that name other codes.

The forest is trained from labelled findings (a table of ``word, prev1, prev2,
next1, label``). ``labelled_findings`` writes ``FINDINGS`` of them from a seed, of
many kinds; the model is thus bounded and always the same. Its trees become
nested CASE expressions, so scanning is DataFrame expressions only.

Defined results: null or empty texts have no finding; null ids are carried;
repeated rows are scanned each; a word that stands twice is two findings;
further columns are ignored; an empty table gives no rows. Texts are whole.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FINDINGS = 6000
TREES, DEPTH, SEED = 20, 6, 91
_RUN = "[A-Za-z0-9+/_=-]"
#: Any text with a candidate matches this: a digit has eight of the run's characters on one side.
_MAY = rf"[0-9]{_RUN}{{8}}|{_RUN}{{8}}[0-9]"
#: Tried only where a run starts, and without going back: a run is looked at once.
_CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z+/_=-]*+[0-9]){_RUN}{{16,}}+"
_INLINE = r"^([A-Za-z_-]{2,24})=([^=].*)$"
# Words beside secrets, beside other codes, and inside names.
SECRET_WORDS = "password passwd pwd pass secret token apikey key auth credential credentials bearer private access signing"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid build version rev revision order invoice tracking isbn card phone account session trace etag blob"
DICTIONARY = (
    "the and for with from this that have not you are was all any can her one our out day get has him his how man new now old see two way who boy did its let put say she too "
    "use about after again could every first found great house large learn never other place plant point right small sound spell still study their there these thing think "
    "three water where which world would write user name test example sample demo admin config default value data file image page index main build release version number "
    "order item code your here key api secret token password change placeholder dummy service server client local host public static"
)

FEATURES = ("length", "transitions", "digits", "upper", "hex", "variety", "covered", "slashes", "address", "secret_word", "other_word", "assigned", "quoted", "prefixed", "signs")


def _any(words: str) -> str:
    return "(^|[^a-z0-9])(" + "|".join(words.split()) + ")([^a-z0-9]|$)"


def described(rows: DataFrame) -> DataFrame:
    """Adds ``value`` and the features to rows of ``word, prev1, prev2, next1``."""
    blank = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = rows.withColumn("run", F.regexp_extract("word", _CANDIDATE, 0))
    inline = F.regexp_extract("run", _INLINE, 1)
    rows = rows.withColumns({"inline": inline, "value": F.when(inline != "", F.regexp_extract("run", _INLINE, 2)).otherwise(F.col("run"))})
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern: 1 - F.length(F.regexp_replace(v, pattern, "")) / size
    flag = lambda c: c.cast("double")
    assigned = (F.col("inline") != "") | blank("prev1").rlike("[=:]>?[\"']?$")
    # only an assignment's own name, or the word just before, names what follows
    names = F.lower(F.concat_ws(" ", "inline", "prev1", F.when(assigned, F.col("prev2"))))
    columns = {
        "length": size, "transitions": F.length(F.regexp_replace(F.lower(v), "[a-z]+|[0-9]+|[^a-z0-9]+", "x")) / size, "digits": share("[0-9]"), "upper": share("[A-Z]"),
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "variety": F.size(F.array_distinct(F.split(F.lower(v), ""))).cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))), "")) / size,
        "slashes": share("/"), "address": flag(F.col("word").rlike(r"://|@|^[./~]|\.(com|net|org|html?|png|jpg|js|css|py|json|txt)\b")),
        "secret_word": flag(names.rlike(_any(SECRET_WORDS) + "|_(key|token|secret|password)")), "other_word": flag(F.concat_ws(" ", names, blank("prev2"), blank("next1")).rlike(_any(OTHER_WORDS))),
        "assigned": flag(assigned), "quoted": flag(F.col("word").rlike("^[\"'`]|=[\"'`]")),
        "prefixed": flag(v.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^(gh[pousr]_|glpat-|xox[abpr]-|sk_live_|sk-|AIza|npm_|hf_)")), "signs": share("[^A-Za-z0-9]"),
    }
    return rows.withColumns(columns)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Generated findings with their label: 1 for secrets, 0 for what only looks like one."""
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), "id"), 512)
    number = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("int")
    pick = lambda salt, words: F.get(F.split(F.lit("\t".join(words)), "\t"), number(salt, len(words)))
    alphabet = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "+/=\n\r", "xY")
    cut = lambda text, least, most, salt: F.substring(text, F.lit(1), F.lit(least) + number(salt, most - least + 1))
    secrets, others = SECRET_WORDS.split() + ["api_key", "access_token", "client_secret", "TOKEN", "PASSWORD", "Secret"], OTHER_WORDS.split()
    plain = ["with", "under", "of", "in", "see", "and", "the", "on", "de", "la", "und", "que", "ist", "en", ":", "Then", "nota"]
    decimal = F.translate(h("d"), "abcdef", "739105")
    w1, w2 = pick("w1", DICTIONARY.split()), pick("w2", DICTIONARY.split())
    hexes = cut(h("x"), 16, 64, "xl")
    sure = F.translate(F.concat(hexes, F.lit("a7")), "", "")
    mixed = F.concat(cut(alphabet("m"), 16, 44, "ml"), F.lit("4z"))
    upper = F.concat(F.upper(cut(alphabet("u"), 14, 14, "u")), F.lit("7Q"))
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    ends = pick("end", ["", "", "", ",", ";", "!!", ".", "***"])
    # kind: word, prev1, prev2, label
    kinds = [
        (F.concat(quoted(sure), ends), pick("=", ["=", ":", "=>"]), pick("s", secrets), 1), (F.concat(quoted(mixed), ends), pick("=", ["=", ":"]), pick("s", secrets), 1),
        (F.concat(pick("s", secrets), F.lit("="), cut(h("y"), 14, 40, "yl"), F.lit("c1"), ends), pick("p", plain), pick("q", plain), 1),
        (F.concat(pick("s", secrets), F.lit("="), mixed, ends), pick("p", plain), pick("q", plain), 1), (F.concat(mixed, ends), F.concat(pick("s", secrets), F.lit(":")), pick("q", plain), 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16), ends), pick("p", plain), pick("q", plain), 1), (F.upper(F.concat(quoted(sure), ends)), F.lit("="), F.upper(pick("s", secrets)), 1),
        (F.concat(pick("pre", ["ghp_", "sk_live_", "glpat-", "hf_", "npm_"]), mixed), pick("p", plain), pick("q", plain), 1), (F.concat(sure, ends), F.lit("="), pick("s", secrets), 1),
        (F.concat(F.substring(decimal, 1, 16), ends), pick("p", plain), pick("q", plain), 0), (F.concat(cut(decimal, 16, 24, "dl"), ends), pick("o", others), pick("q", plain), 0),
        (F.concat(sure, ends), pick("o", others), pick("q", plain), 0), (F.concat(sure, ends), pick("=", ["=", ":"]), pick("o", others), 0),
        (F.concat_ws("-", F.substring(h("a"), 1, 8), F.substring(h("b"), 1, 4), F.substring(h("c"), 1, 4), F.substring(h("e"), 1, 12)), pick("p", plain + others), pick("q", plain), 0),
        (F.concat(F.lit("/"), w1, F.lit("/"), w2, F.lit("/"), F.substring(decimal, 1, 6), F.lit("/"), w1), pick("p", plain), pick("q", plain), 0),
        (F.concat_ws("_", w1, w2, w1, F.substring(decimal, 1, 3)), pick("p", plain + ["="]), pick("q", plain + secrets), 0), (F.concat(w1, F.lit("-"), w2, F.lit("-2024-"), w2, F.lit("-01")), pick("p", plain), pick("q", plain), 0),
        (quoted(F.concat(pick("ph", ["xxxxxxxxxxxxxxx", "your-api-key-here-", "changeme-changeme", "example-token-"]), F.lit("1"))), F.lit("="), pick("s", secrets), 0),
        (F.concat(F.substring(sure, 1, 40), ends), pick("p", plain), pick("q", plain), 0), (F.concat(F.lit("https://"), w1, F.lit(".com/"), w2, F.lit("/"), F.substring(decimal, 1, 12)), pick("p", plain), pick("q", plain), 0),
        (F.concat(w1, w2, w1, w2, F.substring(decimal, 1, 2), ends), pick("p", plain), pick("q", plain), 0), (F.concat(pick("o", others), F.lit("="), sure), pick("p", plain), pick("q", plain), 0),
    ]
    rows = spark.range(0, n // len(kinds), 1, 1)
    found = [
        rows.select(own.alias("word"), prev1.alias("prev1"), prev2.alias("prev2"), pick("n", plain).alias("next1"), F.lit(label).alias("label"))
        for own, prev1, prev2, label in kinds
    ]
    return reduce(DataFrame.unionByName, found).coalesce(1)


def train(findings: DataFrame) -> list[str]:
    """A random forest from labelled findings; each tree as text."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = described(findings).where("value != ''").select(F.col("label").cast("double").alias("label"), *FEATURES)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    return [t.toDebugString for t in forest.trees]


_TRAINED: list[str] = []


def default_trees(spark: SparkSession) -> list[str]:
    """The forest from the generated findings; the same always, so trained once a process."""
    if not _TRAINED:
        _TRAINED.extend(train(labelled_findings(spark)))
    return _TRAINED


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.0-9eE]+)\)|Predict: ([-+.0-9eE]+)")


def tree_column(text: str) -> Column:
    """A tree's prediction as nested CASE expressions."""
    steps = [m.groups() for m in _SPLIT.finditer(text)]
    at = 0

    def node() -> Column:
        nonlocal at
        step = steps[at]
        at += 1
        if step[4] is not None:
            return F.lit(float(step[4]))
        low = node()
        at += 1  # the Else line
        return F.when(F.col(FEATURES[int(step[1])]) <= float(step[3]), low).otherwise(node())

    return node()


#: What parts a word into pieces, of which a run and what touches it is one.
_PART = r"\"'`,;{}()\[\]<>|&?"
#: A name, perhaps quoted, and the sign that assigns to it, just before a run.
_NAMED = r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]*+)[\"'`]?[=:]>?[\"'`\[{(]*$"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run, with its piece of the word and its neighbours: ``id_col, at, word, prev1, prev2, next1``."""
    rows = docs.select(id_col, text_col).where(F.col(text_col).rlike(_MAY)).select(id_col, F.split(text_col, r"\s+").alias("_words"))
    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", i).rlike(_CANDIDATE))
    found = F.transform(places, lambda i: F.struct(
        i.alias("at"), F.get("_words", i).alias("_whole"), F.get("_words", i - 1).alias("_prev1"), F.get("_words", i - 2).alias("_prev2"), F.get("_words", i + 1).alias("_next1")))
    rows = rows.select(id_col, F.inline(found))
    rows = rows.withColumns({"_runs": F.regexp_extract_all("_whole", F.lit(_CANDIDATE), 0), "_gaps": F.split("_whole", _CANDIDATE, -1)})
    # one row more than there are runs: the last gap has none behind it
    zipped = F.arrays_zip(
        F.col("_gaps").alias("before"), F.col("_runs").alias("run"), F.slice("_gaps", F.lit(2), F.size("_gaps")).alias("after"), F.concat(F.array(F.lit(None).cast("string")), "_runs").alias("last"))
    rows = rows.withColumn("_alone", F.size("_runs") == 1).select(id_col, "at", "_prev1", "_prev2", "_next1", "_alone", F.inline(zipped)).where("run IS NOT NULL")
    before, after, first = F.col("before"), F.col("after"), F.col("last").isNull()
    own_left = F.regexp_extract("before", rf"([{_PART}]?)([^{_PART}]*)$", 0)
    own_right = F.regexp_extract("after", rf"^[^{_PART}]*[{_PART}]?", 0)
    # a scheme's colon assigns nothing
    name = F.regexp_extract("before", _NAMED, 1)
    assigned = before.rlike(_NAMED) & ~(before.endswith(":") & F.col("run").startswith("//"))
    words_before = F.regexp_extract("before", r"([A-Za-z0-9_.-]+)[^A-Za-z0-9_.-]*$", 1)
    words_after = F.regexp_extract("after", r"([A-Za-z0-9_.-]+)", 1)
    none = F.lit("")
    bare = first & (words_before == "")
    return rows.select(
        id_col, "at", F.concat(own_left, "run", own_right).alias("word"),
        F.when(assigned, F.concat(name, F.lit("="))).when(bare | (first & before.rlike("://")), F.col("_prev1")).otherwise(words_before).alias("prev1"),
        F.when(assigned, F.when(name != "", none).when(first, F.col("_prev1")).otherwise(F.col("last"))).when(bare | (first & before.rlike("://")), F.col("_prev2")).otherwise(none).alias("prev2"),
        F.when(words_after != "", words_after).when(F.col("_alone") | after.isNull(), F.col("_next1")).otherwise(none).alias("next1"),
    )


def scan(docs: DataFrame, trees: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates with the forest's ``score`` (share of trees) and ``is_secret``.

    Returns ``id_col, at`` (number of the word), ``secret, score, is_secret``.
    """
    rows = described(candidates(docs, id_col, text_col))
    score = sum((tree_column(t) for t in trees), F.lit(0.0)) / len(trees)
    return rows.select(id_col, "at", F.col("value").alias("secret"), score.alias("score"), (score >= 0.5).alias("is_secret"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents."""
    found = scan(table(spark, sf_dir, "documents"), default_trees(spark))
    return found.where("is_secret").select("doc_id", "at", "secret", "score")


QUERIES = {"op7_secret_scan": op7_secret_scan}
