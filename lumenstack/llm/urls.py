"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

All is DataFrame functions and spark.ml's DataFrame API. The host is what stands after the first "://" up to
"/", "?", "#" or the end, A-Z lower-cased; the path runs on to "?", "#" or the end. A null URL and one without
"://" have both empty. A rule `host/path` fits its host and all subdomains if the path starts with the rule's;
the longest that fits decides, else the model does. The model is fitted on a small labelled table that holds no
host of any table judged; URLs with nothing to see are allowed by the intercept alone. Repeated rows are judged alike,
an empty table gives no rows, and columns of any name are kept as they are.
"""

from __future__ import annotations

from importlib import resources

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm.common import free_name

#: A part of the labelled table is made of these words: pairs of them are host names, the next is the path.
UNWANTED = "casino poker slots bets betting jackpot bingo lottery win bonus viagra pills pharma cheap discount loans payday adult porn xxx cams escort dating spam seo links farm track clicks ads adserver popup free download crack keygen warez phish".split()
ORDINARY = "library museum university school college news weather recipes garden history science travel music theatre sport health hospital city council river forest mountain market bakery bridge station radio journal archive atlas maths physics biology poetry novel painting kitchen village harbour".split()
PATHS = "en de/12 fr/page-3.html about articles/7?ref=a index.html 2021/05 es/77#top contact item/340/".split()
#: Rules as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of host and path, each kind by itself and marked at its ends."""

    def of(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    ends = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    return F.concat(*(of(mark, text, n) for mark, text in zip("hp", ends) for n in sizes))


def features(df: DataFrame, url: Column, dimensions: int, grams: str = "grams", out: str = "features") -> DataFrame:
    """df with the columns grams and out."""
    return HashingTF(inputCol=grams, outputCol=out, numFeatures=dimensions, binary=True).transform(df.withColumn(grams, ngrams(host_of(url), path_of(url))))


def written_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the labelled URLs that labelled_urls.txt lists, whole ones with their paths; 1: unwanted."""
    lines = resources.files(__package__).joinpath("labelled_urls.txt").read_text("utf-8").split("\n")
    line = F.explode(F.split(F.lit("\n".join(x for x in lines if x)), "\n")).alias("line")
    return spark.range(0, 1, 1, 1).select(line).select(F.concat(F.lit("https://"), F.substr("line", F.lit(3))).alias("url"), F.substr("line", F.lit(1), F.lit(1)).cast("double").alias("label"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of written_urls() and paired_urls()."""
    return written_urls(spark).unionAll(paired_urls(spark))


def paired_urls(spark: SparkSession) -> DataFrame:
    """(url, label): a host of each word with each of the next three words of its kind (the next nine of ordinary ones,
    which are the rule), in turn joined in three ways and under four suffixes; 1: unwanted."""
    kinds = []
    for words, label, others in ((UNWANTED, 1.0, 3), (ORDINARY, 0.0, 9)):
        made = []
        for i, word in enumerate(words):
            for k in range(1, others + 1):
                other, n = words[(i + k) % len(words)], others * i + k
                host = (f"{word}-{other}", f"www.{word}{other}", f"{other}.{word}{n}")[n % 3] + (".test", ".example.com", ".example.net", ".example.org")[n % 4]
                made.append(f"http{'s' * (n % 2)}://{host}/{PATHS[n % len(PATHS)]}")
        kinds.append(spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit(" ".join(made)), " ")).alias("url"), F.lit(label).alias("label")))
    return kinds[0].unionAll(kinds[1])


def train_url_model(labelled: DataFrame, dimensions: int = 1 << 13, strength: float = 0.02, ordinary: float = 5.0) -> LogisticRegressionModel:
    """labelled: url, label (1: unwanted); a small table, for every pass of the fit goes over it. Rows weigh as if `ordinary`
    URLs met each unwanted one, whatever the table's own shares."""
    shares = labelled.agg(F.sum("label").alias("unwanted"), F.count("*").alias("rows"))
    weight = F.when(F.col("label") == 1, 1.0).otherwise(ordinary * F.col("unwanted") / (F.col("rows") - F.col("unwanted")))
    rows = features(labelled.select("url", "label"), F.col("url"), dimensions).join(F.broadcast(shares)).withColumn("weight", weight)  # one row
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=strength, maxIter=50).fit(rows)


def judge_urls(df: DataFrame, model: LogisticRegressionModel, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """df with a struct column url_verdict (host, path, rule, verdict, probability; underscores before a taken name)."""
    grams, found, chance, guess, out = (free_name(df, x) for x in ("_grams", "_features", "_chance", "_guess", "url_verdict"))
    seen = features(df, F.col(url_col), model.numFeatures, grams, found)
    scored = model.copy().setFeaturesCol(found).setProbabilityCol(chance).setPredictionCol(guess).setRawPredictionCol("").transform(seen)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, unwanted = rule_for(host, path, rules), vector_to_array(chance)[1]
    verdict = F.coalesce(rule["verdict"], F.when(unwanted > 0.5, "block").otherwise("allow"))
    return scored.select(*(F.col(f"`{c}`") for c in df.columns), F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict"), unwanted.alias("probability")).alias(out))
