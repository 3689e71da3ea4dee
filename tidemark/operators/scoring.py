"""Scores of trials: confusion counts, binomial tails, ablation gains, budgets, families of statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(trials: DataFrame, keys: list[str], truth: str, predicted: str, least: int) -> DataFrame:
    """Counts, rates (null without trials) and PASS, FAIL or INSUFFICIENT of each group."""
    t, p = F.col(truth), F.col(predicted)
    out = trials.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    out = out.withColumns({"fp_rate": F.try_divide("fp", F.col("fp") + F.col("tn")), "fn_rate": F.try_divide("fn", F.col("fn") + F.col("tp"))})
    state = F.when((F.col("tp") + F.col("fn") < least) | (F.col("fp") + F.col("tn") < least), "INSUFFICIENT").when((F.col("fp") == 0) & (F.col("fn") == 0), "PASS")
    return out.withColumn("state", state.otherwise("FAIL"))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(at least k of n at one half), summed in logs; each term follows from the one before it."""
    n, k = n.cast("double"), k.cast("double")
    upto = lambda m: F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int"))
    first = F.aggregate(upto(k), F.lit(0.0), lambda a, j: a + F.when(j <= k, F.ln((n - j + 1) / j)).otherwise(0.0)) - n * F.ln(F.lit(2.0))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["term"] + F.ln((n - i) / (i + 1))).alias("term"), (a["total"] + F.exp(a["term"])).alias("total"))

    return F.aggregate(F.sequence(k.cast("int"), n.cast("int")), start, step)["total"]


def probe(trials: DataFrame, keys: list[str], correct: str) -> DataFrame:
    """Accuracy and one-sided binomial p of each group."""
    out = trials.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col(correct)).cast("int").alias("k"))
    return out.withColumns({"accuracy": F.col("k") / F.col("n"), "p_value": binomial_tail(F.col("n"), F.col("k"))})


def reversed_pairs(trials: DataFrame, pair: str, correct: str) -> DataFrame:
    """Pairs of which both orders are right."""
    g = trials.groupBy(pair).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k"))
    return g.withColumn("both", (F.col("n") == 2) & (F.col("k") == 2))


def ablation(supported: DataFrame, keys: list[str], step: str, claim: str, true: str) -> DataFrame:
    """For each pass in order: claims newly supported against the pass before, and how many of all are false."""
    sets = supported.groupBy(*keys, step).agg(F.sort_array(F.collect_set(claim)).alias("_s"), F.count_distinct(F.when(~F.col(true), F.col(claim))).alias("n_false"))
    w = Window.partitionBy(*keys).orderBy(step)
    before = F.coalesce(F.lag("_s").over(w), F.expr("cast(array() as array<bigint>)"))
    gained = sets.withColumn("_before", before)
    return gained.select(*keys, step, F.size("_s").alias("n_supported"), F.size(F.array_except("_s", "_before")).alias("n_new"), F.size(F.array_except("_before", "_s")).alias("n_lost"), "n_false")


def budget(events: DataFrame, keys: list[str], limit: str) -> DataFrame:
    """Reserved against settled money by operation, then by key: spent, open, unknown, remaining."""
    by_op = events.groupBy(*keys, "operation_id").agg(
        F.max(F.when(F.col("event") == "RESERVED", F.col("amount"))).alias("estimate"),
        F.max(F.when(F.col("event") == "COMPLETED", F.col("amount"))).alias("actual"),
        F.max(limit).alias("_limit"),
    )
    total = F.sum(F.coalesce("actual", "estimate"))
    return by_op.groupBy(*keys).agg(
        F.sum("estimate").alias("reserved"),
        F.sum("actual").alias("settled"),
        F.count_if(F.col("actual").isNull()).alias("n_open"),
        (F.max("_limit") - total).alias("remaining"),
    )


def status_counts(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums at every level of the keys, with the level's grouping id."""
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def independent_votes(votes: DataFrame, example: str, label: str, least: int) -> DataFrame:
    """Majority label of independent votes; AMBIGUOUS under the minimum or without a strict majority."""
    by = votes.groupBy(example, label).agg(F.count("*").alias("n")).groupBy(example)
    out = by.agg(F.sum("n").alias("n_votes"), F.max(F.struct("n", label)).alias("_top"))
    keep = (F.col("n_votes") >= least) & (2 * F.col("_top.n") > F.col("n_votes"))
    return out.select(example, "n_votes", F.when(keep, F.col("_top")[label].cast("string")).otherwise("AMBIGUOUS").alias("label"))


#: What a benchmark must hold and may fail.
CRITERIA = {"examples": 20, "positive": 6, "negative": 6, "ambiguous": 2, "overall": 0.2, "false_positive": 0.1, "false_negative": 0.2, "control": 0.2}


def qualification(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out metrics and state of each benchmark from trials(split, control, prediction, correct, natural).

    PRESENT on a negative is a false positive even where the answer failed otherwise; every failed positive is
    a false negative. NOT_TESTED, PROVISIONAL, VALIDATED_ON_BENCHMARK or FAILED.
    """
    held = F.col("split") == "held_out"
    is_ = lambda c: held & (F.col("control") == c)
    wrong = ~F.col("correct")
    out = trials.groupBy(*keys).agg(
        F.count_if(held).alias("n"), F.count_if(held & wrong).alias("failed"),
        *[F.count_if(is_(c)).alias(c.lower()) for c in ("POSITIVE", "NEGATIVE", "AMBIGUOUS")],
        *[F.count_if(is_(c) & wrong).alias("failed_" + c.lower()) for c in ("POSITIVE", "NEGATIVE", "AMBIGUOUS")],
        F.count_if(is_("NEGATIVE") & (F.col("prediction") == "PRESENT")).alias("false_positives"),
        F.coalesce(F.bool_and(F.when(held, F.col("natural"))), F.lit(False)).alias("natural"),
    )
    share = lambda a, b: F.try_divide(a, b)
    out = out.withColumns({"failure_rate": share("failed", "n"), "fp_rate": share("false_positives", "negative"), "fn_rate": share("failed_positive", "positive"), "ambiguous_rate": share("failed_ambiguous", "ambiguous"), "negative_rate": share("failed_negative", "negative")})
    enough = (F.col("n") >= CRITERIA["examples"]) & (F.col("positive") >= CRITERIA["positive"]) & (F.col("negative") >= CRITERIA["negative"]) & (F.col("ambiguous") >= CRITERIA["ambiguous"])
    good = (F.col("failure_rate") <= CRITERIA["overall"]) & (F.col("fp_rate") <= CRITERIA["false_positive"]) & (F.col("fn_rate") <= CRITERIA["false_negative"])
    good = good & (F.greatest("fn_rate", "negative_rate", "ambiguous_rate") <= CRITERIA["control"])
    state = F.when(F.col("n") == 0, "NOT_TESTED").when(~enough | ~F.col("natural"), "PROVISIONAL").when(good, "VALIDATED_ON_BENCHMARK").otherwise("FAILED")
    return out.withColumn("status", state)


def probe_passed(scored: DataFrame) -> DataFrame:
    """A probe passes at 80 % right and p of at most 0.01, with at least 12 trials."""
    ok = (F.col("n") >= 12) & (F.col("accuracy") >= 0.8) & (F.col("p_value") <= 0.01)
    return scored.withColumn("passed", ok)


def ablation_evaluation(claims: DataFrame, gold: DataFrame) -> DataFrame:
    """Passes in order, of claims(pass_no, claim, status, n_evidence), against gold(claim, status).

    New supported claims are verified ones that the pass before didn't have; supported ones that gold calls OPEN
    or CONTRADICTED are false; those without gold are unadjudicated.
    """
    said = claims.join(gold.select("claim", F.col("status").alias("gold")), "claim", "left")
    backed = (F.col("status") == "SUPPORTED") & (F.col("n_evidence") > 0)
    pick = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("claim"))))
    rows = said.groupBy("pass_no").agg(
        pick(backed & (F.col("gold") == "SUPPORTED")).alias("verified"),
        pick(backed & F.col("gold").isin("OPEN", "CONTRADICTED")).alias("false_claims"),
        pick(backed & F.col("gold").isNull()).alias("unadjudicated"),
        pick(F.col("status") == "OPEN").alias("abstentions"),
    )
    before = F.coalesce(F.lag("verified").over(Window.orderBy("pass_no")), F.array().cast("array<string>"))
    # Passes are a handful of runs; the window is over them.
    return rows.withColumn("new_supported", F.array_except("verified", before))
