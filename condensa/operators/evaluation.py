"""How well projections keep facts, and how evaluation results are summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basis_points

# ---- Fixed values ----------------------------------------------------------------------------------------------
#: name -> pattern of material that must not be published.
SECRETS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "github-token": r"\bgh[opsu]_[A-Za-z0-9]{36,}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "secret-assignment": r"(?i)\b(?:api[_-]?key|secret|password|passwd|token)\s*[:=]\s*[\"']?[A-Za-z0-9+/=_-]{24,}",
}
#: Further rules for captured output: who it was captured by.
IDENTITIES = {
    "home-path": r"/(?:home|Users)/(?!dev(?:[^A-Za-z0-9._-]|$))[A-Za-z0-9._-]+",
    "email": r"(?<![A-Za-z0-9._%+-])(?!dev@example\.invalid\b)[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
}
Z = 1.959963984540054
# ----------------------------------------------------------------------------------------------------------------


def fact_recall(visible: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, facts, kept, recall): exact containment; recall of no facts is 1."""
    met = visible.select(key, "visible").join(facts, key, "left")
    kept = F.count_if(F.coalesce(F.col("visible").contains(F.col("fact")), F.lit(False)))
    return met.groupBy(key).agg(F.count("fact").alias("facts"), kept.alias("kept")).withColumn("recall", F.when(F.col("facts") == 0, 1.0).otherwise(F.col("kept") / F.col("facts")))


def utilization(projected: DataFrame, limit: int) -> DataFrame:
    """Per fidelity: rows, and the least, nearest-rank median and P95, and greatest share of the budget, in basis points."""
    used = projected.withColumn("used", basis_points(F.col("visible_count"), F.lit(limit)))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by used)").cast("long")
    return used.groupBy("fidelity").agg(F.count("*").alias("n"), F.min("used").alias("low"), rank(0.5).alias("median"), rank(0.95).alias("p95"), F.max("used").alias("high"))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """(key, rule) for every rule that finds something in a document."""
    hits = F.array(*(F.when(F.col(text).rlike(p), n) for n, p in (rules or SECRETS).items()))
    return docs.select(key, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))


def covered(spans: DataFrame, key: str) -> DataFrame:
    """(key, covered): bytes under disjoint spans."""
    return spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"))


def share(part: Column, whole: Column) -> Column:
    """A percentage with four places; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 1_000_000) / 10_000)


def nearest_rank(c: str, p: float) -> Column:
    """The value at rank ceil(n p); null of nothing."""
    return F.expr(f"percentile_disc({p}) within group (order by {c})")


def by_budget(results: DataFrame) -> DataFrame:
    """Per budget: fixtures, how many are exact and extractive, failures by code, and over-budget ones' utilisation and retention.

    `results`: budget, fidelity, failure_code, over_budget, utilization and retention (percent; of the over-budget ones).
    """
    over = F.col("over_budget")
    rows = results.withColumn("u", F.when(over, F.col("utilization"))).withColumn("r", F.when(over, F.col("retention")))
    codes = rows.where("failure_code is not null").groupBy("budget", "failure_code").agg(F.count("*").alias("n"))
    codes = codes.groupBy("budget").agg(F.array_sort(F.collect_list(F.struct("failure_code", "n"))).alias("failures"))
    told = rows.groupBy("budget").agg(
        F.count("*").alias("fixtures"), F.count_if(F.col("fidelity") == "exact").alias("exact"), F.count_if(F.col("fidelity") == "extractive").alias("extractive"), F.count_if(over).alias("over_budget"),
        F.min("u").alias("min_utilization"), nearest_rank("u", 0.5).alias("median_utilization"), F.max("u").alias("max_utilization"), nearest_rank("r", 0.5).alias("median_retention"),
    )
    listed = F.coalesce(F.array_join(F.transform("failures", lambda x: F.concat(x["failure_code"], F.lit("="), x["n"].cast("string"))), ","), F.lit(""))
    return told.join(codes, "budget", "left").withColumn("failures", listed)


def by_shape(tasks: DataFrame) -> DataFrame:
    """Per shape: tasks, and how many kept their answer's line raw and projected. `tasks`: shape, raw, production."""
    return tasks.groupBy("shape").agg(F.count("*").alias("total"), F.count_if("raw").alias("raw"), F.count_if("production").alias("production"))


def count_by(values: DataFrame, *keys: str) -> DataFrame:
    """Rows by one key or a pair of them."""
    return values.groupBy(*keys).agg(F.count("*").alias("n"))


def balance(invocations: DataFrame) -> DataFrame:
    """(model, raw, production, asymmetry) of invocations (case, arm, model): a model counts once a case and arm."""
    once = invocations.distinct()
    out = once.groupBy("model").agg(F.count_if(F.col("arm") == "raw").alias("raw"), F.count_if(F.col("arm") == "production").alias("production"))
    return out.withColumn("asymmetry", F.abs(F.col("raw") - F.col("production")))


def cases(rows: DataFrame) -> DataFrame:
    """One row over all cases (status, deterministic, input_tokens, visible_tokens, p0_declared, p0_recalled, p1_declared,
    p1_recalled): counts by status, recall of either class (1 of nothing), and the median reduction; only deterministic
    measured cases are scored."""
    valid = (F.col("status") == "measured") & F.col("deterministic")
    scored = rows.withColumn("reduction", F.when(valid & (F.col("input_tokens") > 0), (F.col("input_tokens") - F.col("visible_tokens")) / F.col("input_tokens")))
    total = lambda c: F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).cast("long")
    recall = lambda c: F.when(F.col(f"{c}_declared") == 0, 1.0).otherwise(F.col(f"{c}_recalled") / F.col(f"{c}_declared"))
    out = scored.agg(
        F.count("*").alias("total_cases"), *(F.count_if(F.col("status") == x).alias(f"{x}_cases") for x in ("measured", "unsupported", "invalid")), F.count_if(valid).alias("deterministic_cases"),
        *(total(f"{c}_{x}").alias(f"{c}_{x}") for c in ("p0", "p1") for x in ("declared", "recalled")), nearest_rank("reduction", 0.5).alias("median_reduction"),
    )
    return out.withColumn("p0_recall", recall("p0")).withColumn("p1_recall", recall("p1"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion at 95 %; the whole range when nothing was tried."""
    p, zz = successes / n, F.lit(Z * Z)
    middle, half = p + zz / (n * 2), F.lit(Z) * F.sqrt((p * (F.lit(1.0) - p) + zz / (n * 4)) / n)
    scale = F.lit(1.0) + zz / n
    return F.when(n == 0, 0.0).otherwise(F.greatest((middle - half) / scale, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least((middle + half) / scale, F.lit(1.0)))
