"""Money in whole micro-units: what attempts cost, and how much of it was observed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_observations(observations: DataFrame) -> DataFrame:
    """The observation of highest revision per attempt."""
    names = [c for c in observations.columns if c != "attempt_id"]
    return observations.groupBy("attempt_id").agg(F.max_by(F.struct(*names), "revision").alias("x")).select("attempt_id", "x.*")


def money_report(observations: DataFrame) -> DataFrame:
    """Subtotals and coverage per currency, from the latest observation of each attempt."""
    per = latest_observations(observations).groupBy("currency").agg(
        F.sum(F.col("micros").cast("decimal(38,0)")).alias("micros"),
        *(F.count_if(F.col("coverage") == c).alias(c) for c in ("complete", "partial", "unknown")),
    )
    return per.withColumn("micros", F.col("micros").cast("long"))


_KEY = ("provider", "route", "model")


def price_spans(prices: DataFrame) -> DataFrame:
    """``provider, route, model, start, valid_from, valid_until``: from when on which price of a key applies, until the key's next start.

    ``prices`` has a row for each key and validity, with ``order`` for those that begin together, and no null but in ``valid_until``. Where none applies, the validity is null. Prices are swept in the
    order they begin: a later one goes before those that are valid by then, of which only those that outlive it matter.
    """
    names = [*_KEY, "valid_from", "valid_until"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, valid, out, kinds = None, [], [], []

        def put(start, span: tuple) -> None:
            """Of spans that start together the last one applies."""
            if out and out[-1][:4] == (*now, start):
                out.pop()
            out.append((*now, start, *span))

        def ended(by=None) -> None:
            """Prices that end by then, or ever, leave; the one below applies from there on."""
            while valid and valid[-1][1] is not None and (by is None or valid[-1][1] <= by):
                end = valid.pop()[1]
                put(end, valid[-1] if valid else (None, None))

        def told(keep: int) -> pa.RecordBatch:
            columns = list(zip(*out[: len(out) - keep], strict=True)) or [()] * 6
            del out[: len(out) - keep]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_KEY, "start", *names[3:]])

        for b in batches:
            kinds = [*(b.column(i).type for i in range(4)), b.column(3).type, b.column(4).type]
            for *key, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    ended()
                    valid.clear()
                    now = key
                ended(start)
                while valid and (end is None or valid[-1][1] is not None and valid[-1][1] <= end):
                    valid.pop()
                valid.append((start, end))
                put(start, valid[-1])
            if len(out) > 1:
                yield told(1)
        ended()
        if out:
            yield told(0)

    kinds = dict(prices.dtypes)
    lined = prices.select(*names, "order").repartition(*_KEY).sortWithinPartitions(*_KEY, "valid_from", "order").select(*names)
    schema = [*((k, kinds[k]) for k in _KEY), ("start", kinds["valid_from"]), *((k, kinds[k]) for k in names[3:])]
    return lined.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema))


def applicable_prices(attempts: DataFrame, prices: DataFrame, splits: int = 8) -> DataFrame:
    """Each attempt with ``price``, the one valid when it was submitted, or null; of several the newest, then the largest id.

    Provider, route and model are equal. Of prices of one key and validity only the largest id can apply. Their spans, which don't
    overlap, are put among the attempts of the key in the order of time, and an attempt takes the last one before it: no attempt meets more than one price.
    A key's attempts are dealt to ``splits`` groups, each with all its spans.
    """
    names = [F.col(c) for c in prices.columns if c not in _KEY]
    sound = F.col("valid_until").isNull() | (F.col("valid_from") < F.col("valid_until"))
    p = prices.where(F.col("valid_from").isNotNull() & sound).dropna(subset=list(_KEY)).select(*_KEY, "valid_from", "valid_until", F.struct(*names, *_KEY).alias("price"))
    best = p.groupBy(*_KEY, "valid_from", "valid_until").agg(F.max_by("price", F.struct("price.id")).alias("price"))
    validity = [F.col(c) for c in (*_KEY, "valid_from", "valid_until")]
    of = best.select(F.struct(*validity).alias("of"), "price")
    spans = price_spans(best.select(*validity, F.col("price.id").alias("order"))).withColumn("of", F.when(F.col("valid_from").isNotNull(), F.struct(*validity)))
    told = spans.join(of, spans["of"].eqNullSafe(of["of"]), "left").select(*_KEY, "start", "price")
    at = "__at"
    marks = told.select(
        *_KEY, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("__split"), F.col("start").alias(at), F.struct("price").alias("__span"),
        F.lit(None).cast(attempts.schema).alias("__attempt"),
    )
    asked = attempts.select(
        *_KEY, F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int").alias("__split"), F.col("submitted_at").alias(at), F.lit(None).cast(marks.schema["__span"].dataType).alias("__span"),
        F.struct(*attempts.columns).alias("__attempt"),
    )
    # a price applies from its first moment on, so it goes before what is submitted then
    by = Window.partitionBy(*_KEY, "__split").orderBy(at, F.col("__attempt").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asked).withColumn("__span", F.last("__span", ignorenulls=True).over(by)).where("__attempt IS NOT NULL")
    return found.select(*(F.col(f"__attempt.`{c}`").alias(c) for c in attempts.columns), F.col("__span.price").alias("price"))


# What is charged for, and which of it under each basis.
CATEGORIES = ("input", "output", "cache_read", "cache_write", "reasoning", "context")
INCLUSIVE = ("input", "output")


def calculate(priced: DataFrame) -> DataFrame:
    """``id, price_id, currency, micro_units, missing_price, missing_usage, unknown_categories, error`` per attempt.

    ``priced`` has a count, or null if it is unknown, for each category, ``unknown_categories``, and ``price`` with its
    ``basis`` and a map of ``rates`` (``micro_units, per_tokens``). Inclusive rates charge the totals of input and
    output; partitioned ones charge what is left of them after cache and reasoning, and those apart. Each
    category is rounded up to a whole unit. The sum, a decimal number as text, is only told if every rate and count is known; a
    rate of zero is one, a missing rate isn't. Usage or prices that contradict themselves give an ``error``.
    """
    price, rates = F.col("price"), F.col("price.rates")
    count = {c: F.col(c).cast("decimal(20,0)") for c in CATEGORIES}
    zero = lambda c: F.coalesce(count[c], F.lit(0).cast("decimal(20,0)"))
    bad_usage = (zero("cache_read") + zero("cache_write") > count["input"]) | (count["reasoning"] > count["output"])
    named = F.map_keys(rates)
    bad_price = (
        (F.col("price.id").cast("string") == "") | (F.col("price.provider") == "") | (F.col("price.model") == "")
        | ~F.regexp_like(F.col("price.route"), F.lit("^[0-9a-f]{64}$")) | ~F.regexp_like(F.col("price.currency"), F.lit("^[A-Z]{3}$"))
        | (F.col("price.valid_from") >= F.col("price.valid_until"))
        | F.exists(F.map_values(rates), lambda r: r["per_tokens"] == 0)
        | (F.size(F.array_except(named, F.array(*map(F.lit, CATEGORIES)))) > 0)
        | ((F.col("price.basis") == "inclusive") & (F.size(F.array_except(named, F.array(*map(F.lit, INCLUSIVE)))) > 0))
    )
    whole = F.col("price.basis") == "inclusive"
    counts = {
        "input": F.when(whole, count["input"]).otherwise(count["input"] - count["cache_read"] - count["cache_write"]),
        "output": F.when(whole, count["output"]).otherwise(count["output"] - count["reasoning"]),
    } | {c: F.when(~whole, count[c]) for c in CATEGORIES if c not in INCLUSIVE}

    def charge(c: str) -> Column:
        rate = F.try_element_at(rates, F.lit(c))
        product, per = counts[c].cast("decimal(20,0)") * rate["micro_units"].cast("decimal(18,0)"), F.nullif(rate["per_tokens"], F.lit(0)).cast("decimal(18,0)")
        rest = product % per
        return ((product - rest) / per).cast("decimal(38,0)") + F.when(rest > 0, 1).otherwise(0)

    needed = lambda names, of: reduce(lambda a, b: a | b, (of(c) for c in names))
    no_rate = lambda c: F.try_element_at(rates, F.lit(c)).isNull()
    no_count = lambda c: count[c].isNull()
    unpriced = price.isNull() | F.when(whole, needed(INCLUSIVE, no_rate)).otherwise(needed(CATEGORIES, no_rate))
    uncounted = needed(INCLUSIVE, no_count) | (price.isNotNull() & ~F.coalesce(whole, F.lit(True)) & needed(CATEGORIES, no_count))
    strange = F.col("unknown_categories") | F.coalesce(whole & ~needed(INCLUSIVE, no_count) & (count["context"] > 0), F.lit(False))
    total = F.when(whole, charge("input") + charge("output")).otherwise(reduce(lambda a, b: a + b, map(charge, CATEGORIES)))
    error = (
        F.when(bad_usage, "usage subset exceeds parent total")
        .when(price.isNotNull() & bad_price, "invalid price snapshot")
        .when(~unpriced & ~uncounted & ~strange & (total > F.lit(str(2**64 - 1)).cast("decimal(20,0)")), "monetary total exceeds u64 micro-units")
    )
    found = priced.select(
        "id", price.getField("id").alias("price_id"), F.col("price.currency").alias("currency"),
        F.when(~unpriced & ~uncounted & ~strange, total.cast("string")).alias("micro_units"),
        unpriced.alias("missing_price"), uncounted.alias("missing_usage"), strange.alias("unknown_categories"), error.alias("error"),
    )
    sound = F.col("error").isNull()
    return found.select("id", *(F.when(sound, F.col(c)).alias(c) for c in found.columns if c not in ("id", "error")), "error")


def usage_coverage(evidence: DataFrame, day: str) -> DataFrame:
    """``day, complete, partial, unknown``: what is known of the usage of a day's reservations.

    ``evidence``: ``day, usage_source, input_tokens, output_tokens``. Only what a provider reported counts: both numbers are a complete
    observation, one a partial one; everything else is unknown.
    """
    told = F.coalesce(F.col("usage_source") == "provider_reported", F.lit(False))
    known = F.col("input_tokens").isNotNull().cast("int") + F.col("output_tokens").isNotNull().cast("int")
    rows = evidence.where(F.col("day") == F.lit(day).cast("date"))
    return rows.agg(
        F.count_if(told & (known == 2)).alias("complete"), F.count_if(told & (known == 1)).alias("partial"), F.count_if(~told | (known == 0)).alias("unknown")
    ).select(F.lit(day).alias("day"), "complete", "partial", "unknown")
