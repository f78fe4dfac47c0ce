"""URL filter with DataFrame functions and Spark ML only.

Rules decide first: a rule ``host/path`` fits its host and all subdomains if the
URL's path starts with the rule's path; the longest rule wins. Every other URL
is judged by a logistic regression on hashed character n-grams of host and
path, fitted to a small labelled URL table (``spark.ml`` on the cluster; the
table's bound is ``MAX_LABELLED``).

Defined cases: a null URL or one without ``://`` has an empty host and path and
no n-grams (the method then judges by its intercept alone); repeated rows are
judged one by one; an empty table gives no rows; an empty labelled table raises;
other columns do not matter.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.decontaminate import LOWER, UPPER
from upkeep.llm.storage import check_columns

FEATURES = 1 << 13
MAX_LABELLED = 100_000
GRAMS = (3, 4)

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# The labelled URL table used when the caller has none: host labels that say
# what a site sells, and ordinary ones, crossed with common URL shapes.
BLOCKED_LABELS = (
    "casino-win", "online-casino", "casino-bonus", "free-bets", "bets-live", "sports-bets", "poker-win", "free-spins",
    "cheap-pills", "pills-online", "buy-pills", "pharma-cheap", "spam-farm", "link-farm", "seo-spam", "spam-links",
    "adult-x", "adult-cams", "xxx-adult", "hot-adult", "ads-track", "track-ads", "click-track", "ads-serve",
    "payday-cash", "free-cash", "win-cash", "cheap-watches", "replica-cheap", "lotto-win",
)
ALLOWED_LABELS = (
    "news", "weather", "library", "university", "history", "science", "museum", "gardening", "cooking", "travel",
    "mathematics", "physics", "village", "mountain", "recipes", "archive", "journal", "theatre", "northern", "thinking",
    "station", "nation", "reading", "writing", "another", "together", "weekend", "thunder", "thread", "thorn",
    "whether", "enable", "table", "ratio", "erosion", "onset", "ocean", "rented", "handed", "heather",
    "sandstone", "lyrics", "shore", "fisher", "bleach", "stream", "timber", "honest", "anthem", "threshold",
)
SHAPES = ("", "www.", "m.", "blog.")
PATHS = ("/en/{n}", "/es/{n}.html", "/fr/{n}/", "/de/{n}", "/")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, start = rule.partition("/")
        same = (host == own) | host.endswith("." + own)
        fits.append(F.when(same & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams_of(host: Column, path: Column) -> Column:
    """Character n-grams of the host and of the path, marked by where they come from."""
    def cut(mark: str, text: Column, n: int) -> Column:
        def pieces(t: Column) -> Column:
            last = F.length(t) - n + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(t, i, F.lit(n))))

        # bound as a lambda variable, the text is computed once and not for every position
        return F.element_at(F.transform(F.array(text), pieces), 1)

    bounded = F.concat(F.lit("^"), host, F.lit("$"))
    return F.array_distinct(F.concat(*(cut(mark, text, n) for mark, text in (("h", bounded), ("p", path)) for n in GRAMS)))


def default_labels(spark: SparkSession) -> DataFrame:
    """The labelled table of this module as (url, blocked)."""
    def literals(values: tuple[str, ...]) -> Column:
        return F.array(*(F.lit(v) for v in values))

    both = F.concat(F.transform(literals(BLOCKED_LABELS), lambda w: F.struct(w.alias("word"), F.lit(1).alias("blocked"))),
                    F.transform(literals(ALLOWED_LABELS), lambda w: F.struct(w.alias("word"), F.lit(0).alias("blocked"))))
    words = spark.range(1).select(F.explode(both).alias("w")).select("w.word", "w.blocked")
    crossed = words.select("*", F.explode(literals(SHAPES)).alias("shape")).select("*", F.explode(literals(PATHS)).alias("path"))
    number = F.pmod(F.xxhash64("word", "shape", "path"), F.lit(1000)).cast("string")
    top = F.element_at(literals(("com", "net", "org")), (F.pmod(F.xxhash64("path", "word"), F.lit(3)) + 1).cast("int"))
    url = F.concat(F.lit("https://"), "shape", "word", F.lit(".example."), top, F.replace("path", F.lit("{n}"), number))
    return crossed.select(url.alias("url"), "blocked")


def _featured(urls: DataFrame) -> DataFrame:
    grams = urls.withColumn("grams", grams_of(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams)


def train(labelled: DataFrame, reg: float = 0.01) -> LogisticRegressionModel:
    """Fit the regression to (url, blocked 0 or 1)."""
    check_columns(labelled, "url", "blocked")
    if not 0 < (n := labelled.limit(MAX_LABELLED + 1).count()) <= MAX_LABELLED:
        raise ValueError(f"the labelled table has {n} rows; 1 to {MAX_LABELLED} are needed")
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label"))
    return LogisticRegression(maxIter=25, regParam=reg, standardization=False).fit(_featured(rows.na.drop()))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_p (the method's probability)."""
    check_columns(pages, id_col, url_col)
    model = train(default_labels(pages.sparkSession) if labelled is None else labelled)
    url = F.col("url")
    cut = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    cut = cut.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    scored = model.transform(_featured(cut)).select("page_id", "host", "path", vector_to_array("probability")[1].alias("blocked_p"),
                                                    rule_for(F.col("host"), F.col("path"), rules).alias("fit"))
    method = F.when(F.col("blocked_p") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "blocked_p")
