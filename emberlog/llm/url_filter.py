"""URL filtering: host and path rules first, gradient-boosted trees over lexical features for the rest.

DataFrame functions and Spark's own trees only; nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

_FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "value_length", "hyphens", "fragment", "secure"]
#: What suffix statistics are kept of: the host's last label, its last two, and either with the path's first segment.
SUFFIXES = ("suffix", "domain", "section", "place")
FEATURES += [f"{s}_{x}" for s in SUFFIXES for x in ("rate", "log_count", "log_labels")]
_PRIOR_ROWS = 20  # rows that the prior counts for in a rate


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or one of its parents and the path's start; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):  # longer ones are wrapped around shorter ones
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def lexical_features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` (with host and path) and the lexical features but the suffix statistics; null urls count as empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    length = F.length(url)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / F.greatest(length, F.lit(1))
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    last, two = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    segment = F.regexp_extract("path", r"^/([^/]*)", 1)
    return urls.withColumns(
        {
            "suffix": last,
            "domain": two,
            "section": F.concat(last, F.lit("/"), segment),
            "place": F.concat(two, F.lit("/"), segment),
            "url_length": length.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.filter(F.split("host", r"\."), lambda x: x != "")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(length, F.lit(1)),
            "entropy": entropy,
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "value_length": F.length(query).cast("double"),
            "hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": url.startswith("https:").cast("double"),
        }
    )


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", most_training_rows: int = 20_000, rounds: int = 10, depth: int = 4, seed: int = 17, learn: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) for every row.

    The trees learn from urls that a rule decides, at most ``most_training_rows`` of them, chosen by a hash of the url, and
    judge the others, which are blocked at a score of 0.5 or more. Suffix statistics (``SUFFIXES``) count all rows, and their
    labels all rows that a rule decides; for a url to learn from, they leave out the fifth of the urls that it belongs to, so
    that no row meets its own label. ``learn`` narrows the rows whose labels are used, to hold some out. Where rules label no url,
    or all alike, the score is that label's smoothed share. Null urls and urls without ``://`` have an empty host and path
    and no rule; repeated rows each get their row; an empty table gives an empty one; other columns are ignored.
    """
    base = pages.select(F.col(id_col), F.col(url_col).alias("__url"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("__learn"))
    base = base.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    base = lexical_features(base.withColumns({"rule": rule, "ruled": ruled}), "__url")
    base = base.withColumns({"label": F.when(F.col("__learn"), (F.col("ruled") == "block").cast("double")), "fold": F.pmod(F.xxhash64("__url", F.lit(seed + 1)), F.lit(_FOLDS))})
    sample = materialize(base.where("label is not null").orderBy(F.xxhash64("__url", F.lit(seed))).limit(most_training_rows).drop(id_col, "host", "path", "rule", "ruled"), "urls")
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in SUFFIXES))
    folds = materialize(base.select("fold", "label", F.explode(each).alias("s")).groupBy("s.kind", "s.key", "fold").agg(F.count("*").alias("rows"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("block")), "suffixes")
    counted = folds.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "block")))
    counts = counted.where(F.col("kind") == SUFFIXES[0]).agg(F.sum("n").alias("n"), F.sum("block").alias("block")).first()
    prior = ((counts["block"] or 0.0) + 1) / ((counts["n"] or 0) + 2)

    def told(k: str, n: Column, block: Column) -> list[Column]:
        return [F.col("key").alias(k), ((block + _PRIOR_ROWS * prior) / (n + _PRIOR_ROWS)).alias(f"{k}_rate"), F.log1p("rows").alias(f"{k}_log_count"), F.log1p(n).alias(f"{k}_log_labels")]

    apart = counted.withColumnsRenamed({"n": "all_n", "block": "all_block"}).join(folds.drop("rows"), ["kind", "key"])
    known, learned = base, sample
    for k in SUFFIXES:
        known = known.join(counted.where(F.col("kind") == k).select(*told(k, F.col("n"), F.col("block"))), k, "left")
        learned = learned.join(apart.where(F.col("kind") == k).select("fold", *told(k, F.col("all_n") - F.col("n"), F.col("all_block") - F.col("block"))), [k, "fold"])
    learnt = sample.agg(F.count("*").alias("n"), F.sum("label").alias("block")).first()
    if not 0 < (learnt["block"] or 0.0) < learnt["n"]:
        scored = known.withColumn("block_score", F.lit(prior))
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        # both verdicts weigh alike, so a score of a half is where they are as likely
        share = learnt["block"] / learnt["n"]
        learned = learned.withColumn("weight", F.when(F.col("label") > 0, 0.5 / share).otherwise(0.5 / (1 - share)))
        trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=seed, checkpointInterval=-1)
        model = trees.fit(assembler.transform(learned).select("features", "label", "weight"))
        scored = model.transform(assembler.transform(known)).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_score")
