"""Mixing sources to target weights by temperature, as DataFrame operations only.

The token shares of the sources are raised to an exponent and normalised. The exponent is bisected until the entropy of
the weights, or the most often that a source must be repeated, meets its target. A token budget is then dealt out in
blocks: each source's blocks are permuted anew in every epoch, and epochs are taken until its part of the budget is met.
All epochs but a source's last are whole. In that one, running sums go over ranges of drawn block numbers, then over the
blocks of the one range where the budget ends, then over the documents of the one block: each about the square root of a
source's blocks, or one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

_STEPS = 16  # exponents tried at once
_ROUNDS = 9


def word_count(text: Column) -> Column:
    """Words of a text: runs of other than ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, budget: float, entropy: float | None = None, most_epochs: float | None = None) -> DataFrame:
    """``sources`` (source, tokens) with ``weight`` and ``epochs`` (weight times budget over tokens).

    Exponents lie between 0 (uniform) and 1 (proportional). With ``entropy``, in shares of the greatest possible, the
    weights have at least that entropy with the largest exponent that gives it; with ``most_epochs``, the smallest
    exponent under which no source is repeated more often. With both, the limit of epochs has precedence: the exponent is
    the greater of the two. If no exponent meets the target, 0 or 1 comes closest.
    """
    if entropy is None and most_epochs is None:
        raise ValueError("give an entropy or a limit of epochs")
    full = sources.where("tokens > 0")
    total = full.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return sources.withColumns({"weight": F.lit(0.0), "epochs": F.lit(0.0)})
    share = F.col("tokens") / F.lit(float(total["t"]))

    def measure(exponents: list[float], by_entropy: bool) -> list[float]:
        """Entropy share or most epochs at each exponent, in one pass over the sources."""
        powers = full.select("tokens", *(F.pow(share, F.lit(a)).alias(f"p{i}") for i, a in enumerate(exponents)))
        sums = powers.agg(*(F.sum(f"p{i}").alias(f"s{i}") for i in range(len(exponents))), *(F.sum(F.when(F.col(f"p{i}") > 0, F.col(f"p{i}") * F.log(f"p{i}"))).alias(f"l{i}") for i in range(len(exponents))), *(F.max(F.col(f"p{i}") / F.col("tokens")).alias(f"m{i}") for i in range(len(exponents)))).first()
        if not by_entropy:
            return [sums[f"m{i}"] / sums[f"s{i}"] * budget for i in range(len(exponents))]
        top = math.log(total["n"]) or 1.0
        return [(math.log(sums[f"s{i}"]) - sums[f"l{i}"] / sums[f"s{i}"]) / top for i in range(len(exponents))]

    def bisect(by_entropy: bool) -> float:
        meets = (lambda x: x >= entropy) if by_entropy else (lambda x: x > most_epochs)  # true on the lower side
        ends = measure([0.0, 1.0], by_entropy)
        if not meets(ends[0]) or meets(ends[1]):
            return 1.0 if meets(ends[0]) else 0.0
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            tried = [low + (high - low) * k / _STEPS for k in range(1, _STEPS)]
            lower = sum(1 for x in measure(tried, by_entropy) if meets(x))  # both measures fall as the exponent grows
            low, high = ([low, *tried][lower], [*tried, high][lower])
        return low if by_entropy else high

    exponent = max(bisect(kind) for kind, goal in ((True, entropy), (False, most_epochs)) if goal is not None)
    scale = full.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(scale)).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("epochs", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(budget)) / F.col("tokens")).otherwise(0.0))


def mix(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, most_epochs: float | None = 4.0, block_tokens: int = 100_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, n_tokens, epoch, block, weight): a row for each time that a document is taken.

    Budget: ``budget_share`` of all tokens. A source's documents lie in blocks of about ``block_tokens`` tokens by a hash
    of id and text. An epoch takes its blocks in an order drawn for it, and the documents of a block in a drawn order,
    until the source's tokens are used up: a document is taken while the tokens before it are below the target, so a
    source exceeds its part by less than one document. Null sources are a source of their own, null ids are kept.
    Documents without words (null, empty and blank texts) carry no tokens and are never taken; repeated rows are all taken;
    an empty table gives an empty one; other columns are ignored. ``most_epochs`` bounds how often one row is taken; without
    it a tiny source may be repeated as often as its weight asks for.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(text_col).alias("sig")).where("n_tokens > 0")
    rows = materialize(rows, "tokens")
    sources = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    budget = (sources.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    weighted = source_weights(sources, budget, entropy, most_epochs).withColumn("target", F.floor(F.col("weight") * budget))
    whole = F.floor(F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(0))
    planned = weighted.select(F.col("source").alias("s"), "weight", F.ceil(F.col("tokens") / block_tokens).alias("blocks"), "tokens", "target", whole.alias("whole"))
    planned = materialize(planned.withColumns({"rest": F.col("target") - F.col("whole") * F.col("tokens"), "bits": F.ceil(F.log2("blocks") / 2).cast("int")}).drop("tokens", "target"), "weights")
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod(F.xxhash64("id", "sig", F.lit(seed)), "blocks"))
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", "block", "weight"]
    full = joined.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).select(columns)

    # the last epoch: a permutation of the source's blocks, of which it takes as many as are left to take
    drawn = joined.where("rest > 0").withColumnRenamed("whole", "epoch").withColumn("draw", F.xxhash64("source", "epoch", "block", F.lit(seed)))
    drawn = drawn.withColumn("range", F.expr("pmod(shiftright(draw, 63 - bits), shiftleft(2L, bits))"))
    sizes = materialize(drawn.groupBy("source", "range", "draw", "block", "rest").agg(F.sum("n_tokens").alias("tokens")), "blocks")

    def opened(parts: DataFrame, before: Column, *order: str) -> DataFrame:
        """What is begun before the rest is used up; ``inside``: also ended."""
        upto = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        got = parts.withColumn("before", before + F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where("before < rest")
        return got.withColumn("inside", F.col("before") + F.col("tokens") <= F.col("rest"))

    of_source = lambda a, b, key: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.{key}") == F.col(f"{b}.{key}"))
    ranges = materialize(opened(sizes.groupBy("source", "range", "rest").agg(F.sum("tokens").alias("tokens")), F.lit(0), "range"), "ranges")
    last = ranges.where("not inside").select("source", "range", F.col("before").alias("at"))
    cut = sizes.alias("x").join(last.alias("y"), of_source("x", "y", "range")).select("x.*", "y.at")
    cut = materialize(opened(cut, F.col("at"), "draw", "block"), "cut")
    one = drawn.alias("x").join(ranges.where("inside").alias("y"), of_source("x", "y", "range")).select("x.*")
    two = drawn.alias("x").join(cut.alias("y"), of_source("x", "y", "block")).select("x.*", "y.before", "y.inside")
    # only the last block of a source is cut, within its own documents
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64("id", "sig", "epoch", F.lit(seed)), "id", "sig").rowsBetween(Window.unboundedPreceding, -1)
    three = two.where("not inside").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("at < rest")
    return full.union(one.select(columns)).union(two.where("inside").select(columns)).union(three.select(columns))
