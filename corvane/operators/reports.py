"""Operational reports over the logs of interactions, turns, runs and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trailing windows and the width of their buckets, in seconds.
WINDOWS = {"1h": (3600, 60), "24h": (86_400, 900), "7d": (604_800, 7200), "30d": (2_592_000, 21_600)}


def parse_window(name: str) -> tuple[int, int]:
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; one of {sorted(WINDOWS)}")
    return WINDOWS[name]


def filtered(df: DataFrame, since=None, until=None, **equal) -> DataFrame:
    """Conditions that are None are left out; the time range is half-open."""
    for k, v in equal.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    if since is not None:
        df = df.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    return df


#: What usage is told by: columns of interactions and of turns joined to their sessions.
USAGE_KEYS = {"uid": "uid", "session": "session_id", "runbook": "runbook_ref", "collection": None}


def usage(interactions: DataFrame, turns: DataFrame, sessions: DataFrame, group_by: str = "uid", since=None, until=None, most: int = 500) -> DataFrame:
    """``key, interactions, turns, input_tokens, output_tokens, avg_latency`` per user, session, runbook or collection.

    Either side may be missing. A row that names several collections counts for each. The busiest come first;
    the limit is the feature of the report.
    """
    if group_by not in USAGE_KEYS:
        raise ValueError(f"group_by must be uid|session|runbook|collection, got '{group_by}'")
    seen, said = filtered(interactions, since, until), filtered(turns, since, until)
    if group_by == "collection":
        seen = seen.select(F.explode("collection_ids").alias("key"), "latency_ms")
        said = said.select(F.explode("collections_searched").alias("key"), "input_tokens", "output_tokens")
    else:
        name = USAGE_KEYS[group_by]
        seen = seen.where(F.col(name).isNotNull()).select(F.col(name).alias("key"), "latency_ms")
        if group_by == "runbook":
            said = said.join(sessions.select(F.col("id").alias("session_id"), "runbook_ref"), "session_id")
        said = said.select(F.col(name).alias("key"), "input_tokens", "output_tokens")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    a = seen.groupBy("key").agg(F.count(F.lit(1)).alias("interactions"), F.avg("latency_ms").alias("avg_latency"))
    b = said.groupBy("key").agg(
        F.count(F.lit(1)).alias("turns"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens"))
    )
    return (
        a.join(b, "key", "full_outer")
        .select("key", zero("interactions"), zero("turns"), zero("input_tokens"), zero("output_tokens"), F.round("avg_latency", 3).alias("avg_latency"))
        .orderBy(F.col("interactions").desc(), "key")
        .limit(most)
    )


def cost_by_model(turns: DataFrame) -> DataFrame:
    """``provider, model, turns, overridden, input_tokens, output_tokens`` of turns that have a completion (a model), the dearest first.

    ``overridden``: turns whose model the caller chose. Counts that a provider didn't give are 0.
    """
    tokens = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    by = turns.where("model IS NOT NULL").groupBy("provider", "model")
    cost = by.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.coalesce("was_override", F.lit(False))).alias("overridden"), tokens("input_tokens"), tokens("output_tokens"))
    return cost.orderBy((F.col("input_tokens") + F.col("output_tokens")).desc(), "provider", "model")


def timeseries(interactions: DataFrame, bucket_seconds: int) -> DataFrame:
    """Counts, client and server errors, median and 95th percentile per bucket, aligned to the epoch."""
    bucket = F.window("created_at", f"{bucket_seconds} seconds")
    return (
        interactions.groupBy(bucket.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if((F.col("status") >= 400) & (F.col("status") < 500)).alias("client_errors"),
            F.count_if(F.col("status") >= 500).alias("server_errors"),
            F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50"),
            F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"),
        )
        .select(F.col("w.start").cast("string").alias("bucket"), "requests", "client_errors", "server_errors", "p50", "p95")
    )


def endpoints(interactions: DataFrame, most: int = 20) -> DataFrame:
    """Requests, share of errors, mean and 95th percentile per method, busiest first."""
    return (
        interactions.groupBy("method")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.round(F.count_if(F.col("status") >= 400) / F.count(F.lit(1)), 6).alias("error_rate"),
            F.round(F.avg("latency_ms"), 4).alias("avg_ms"),
            F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"),
        )
        .orderBy(F.col("requests").desc(), "method")
        .limit(most)
    )


def sessions_report(sessions: DataFrame, turns: DataFrame, bucket: str = "6 hours") -> DataFrame:
    """``bucket, opened, users, turns, active, active_uids``: sessions opened and their different users; turns, and their different sessions and users. Empty sides are 0."""
    start = lambda c: F.window(c, bucket)["start"].alias("bucket")
    opened = sessions.groupBy(start("opened_at")).agg(F.count(F.lit(1)).alias("opened"), F.countDistinct("uid").alias("users"))
    said = turns.groupBy(start("created_at")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("active"), F.countDistinct("uid").alias("active_uids"))
    zero = (F.coalesce(c, F.lit(0)).alias(c) for c in ("opened", "users", "turns", "active", "active_uids"))
    return opened.join(said, "bucket", "full_outer").select(F.col("bucket").cast("string").alias("bucket"), *zero)


def evidence_report(metrics: DataFrame) -> DataFrame:
    """Per profile and layer: turns, refusals, complete answers, refusal codes, nearest-rank percentiles.

    Codes are listed by frequency and then by name.
    """
    per = metrics.groupBy("profile", "layer").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if("refused").alias("refusals"),
        F.count_if("complete").alias("complete"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95"),
    )
    codes = (
        metrics.where("refused")
        .groupBy("profile", "layer", F.concat(F.lit("code-"), F.col("refusals_code")).alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("profile", "layer")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))).alias("c"))
        .select("profile", "layer", F.array_join(F.transform("c", lambda x: F.concat(x["code"], F.lit(":"), (-x["n"]).cast("string"))), ",").alias("codes"))
    )
    return per.join(codes, ["profile", "layer"], "left").withColumn("codes", F.coalesce("codes", F.lit("")))


def runbook_report(runs: DataFrame, steps: DataFrame, since: str | None = None) -> DataFrame:
    """``state, runs, avg_wall_ms``: runs begun since then by their own state; a run lasts from its start to the last update of a step, if it has one.

    ``runs``: ``run_id, state, created_at``; ``steps``: ``run_id, updated_at``.
    """
    begun = runs if since is None else runs.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    last = steps.groupBy("run_id").agg(F.max("updated_at").alias("last"))
    wall = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return begun.join(last, "run_id", "left").groupBy("state").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(wall / 1000), 1).alias("avg_wall_ms"))


def budget_ledger(reservations: DataFrame) -> DataFrame:
    """Units held and settled and rows counted per configuration, tier and day; released ones don't count."""
    return (
        reservations.where("state <> 'released'")
        .groupBy("config_name", "tier", "day")
        .agg(
            F.coalesce(F.sum(F.when(F.col("state") == "held", F.col("units"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(F.col("state") == "settled", F.col("units"))), F.lit(0)).alias("settled"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def budgets_vs_limits(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """Spending against limits; configured limits without rows, and rows without limits, stay."""
    spent = ledger.groupBy("config_name", "tier").agg(F.max(F.col("held") + F.col("settled")).alias("peak"), F.sum("n").alias("n"))
    return spent.join(limits, ["config_name", "tier"], "full_outer").select(
        "config_name", "tier", F.coalesce("peak", F.lit(0)).alias("peak"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("daily_limit", F.lit(0)).alias("daily_limit"), F.coalesce(F.col("peak") > F.col("daily_limit"), F.lit(False)).alias("over"),
    )


def active_sum(reservations: DataFrame, day: str, limit: int) -> DataFrame:
    """Units not released on a day, and whether a further one fits the limit."""
    return (
        reservations.where((F.col("day") == F.lit(day).cast("date")) & (F.col("state") != "released"))
        .agg(F.coalesce(F.sum("units"), F.lit(0)).alias("active"))
        .withColumn("fits", F.col("active") + 1 <= limit)
    )


def control_plane_counts(**tables: DataFrame) -> DataFrame:
    """``part, n`` for each table named."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_counts(df: DataFrame, state: str, size: str) -> DataFrame:
    """Rows and bytes per state."""
    return df.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


OUTCOMES = ("passed", "failed", "harness_error", "unavailable")  # fixed values


def latency_report(samples: DataFrame, elapsed_ms: float, by: str = "method") -> DataFrame:
    """Per group of requests (``outcome, duration_ms``): nearest-rank percentiles, least and most over those that passed, goodput a second of the time elapsed, and all outcomes.

    Whatever didn't pass is offered work too, but has no part in the times.
    """
    good = F.when(F.col("outcome") == "passed", F.col("duration_ms"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN outcome = 'passed' THEN duration_ms END)").cast("long")
    return samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("offered"),
        F.count(good).alias("correct"),
        F.round(F.count(good) * 1000.0 / F.lit(float(elapsed_ms)), 9).alias("goodput_per_second"),
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        F.min(good).cast("long").alias("min_ms"),
        F.max(good).cast("long").alias("max_ms"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES),
    )


def audit_page(interactions: DataFrame, before: str, most: int) -> DataFrame:
    """The newest rows before a cursor."""
    return interactions.where(F.col("created_at") < F.lit(before).cast("timestamp")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def next_ordinal(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg((F.coalesce(F.max("ordinal"), F.lit(0)) + 1).alias("next_ordinal"))


def job_claim(jobs: DataFrame, now: str, max_attempts: int = 4, most: int = 1) -> DataFrame:
    """The oldest jobs that are pending, or whose lease has lapsed with attempts left."""
    at = F.lit(now).cast("timestamp")
    free = (F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("lease_until") < at) & (F.col("attempt") < max_attempts))
    return jobs.where(free & (F.col("created_at") < at)).orderBy("created_at", "id").limit(most)


def lapsed_leases(jobs: DataFrame, now: str, max_attempts: int = 4) -> DataFrame:
    """Leases run out by ``now``: tried again while attempts are left."""
    at = F.lit(now).cast("timestamp")
    return jobs.where((F.col("state") == "leased") & (F.col("lease_until") < at)).select(
        "id", F.when(F.col("attempt") < max_attempts, "retry").otherwise("failed").alias("next"), (F.col("attempt") + 1).alias("attempt")
    )
