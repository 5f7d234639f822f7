"""Contexts for a model: what holds at a pin, under a budget of tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import normalized_claim, scope_group
from corvane.operators.ledger import Snapshot, directives

# The sections, in order.
TITLES = ("Point-in-time pin", "Canon digest", "Accepted facts", "Locked details", "Open promises", "Frequency budgets")
PIN, DIGEST, FACTS, LOCKED, PROMISES, BUDGETS = range(1, 7)
#: How coarse digests are, finest first: every scope; scopes of the active group and groups besides; groups; all in one.
LEVELS = ("scopes", "active", "groups", "rollup")


def _lines(rows: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.lit(TITLES[section - 1]).alias("title"), place.alias("place"), line.alias("line"))


def _digest_lines(digests: DataFrame, scope: str | None, level: str) -> DataFrame:
    tier, group = F.col("tier"), None if scope is None else scope.split(".")[0]
    if level == "scopes":
        chosen = tier == 0
    elif level == "active":
        mine = F.lit(False) if group is None else scope_group(F.col("scope")) == group
        others = F.lit(True) if group is None else F.col("scope") != group
        chosen = ((tier == 0) & mine) | ((tier == 1) & others)
    else:
        chosen = tier == (1 if level == "groups" else 2)
    return _lines(digests.where(chosen), DIGEST, F.concat(tier.cast("string"), F.col("scope")), F.col("text"))


def _bytes(lines: DataFrame) -> tuple[int, int]:
    """Lines, and bytes of them joined by line ends."""
    r = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("b")).first()
    return r.n, r.b + max(0, r.n - 1)


def _size(parts: dict[int, tuple[int, int]]) -> int:
    """Bytes of the rendered sections, those without lines left out."""
    shown = [len(TITLES[s - 1]) + 4 + b for s, (n, b) in parts.items() if n]
    return sum(shown) + 2 * max(0, len(shown) - 1)


def _newest(facts: DataFrame, room: int) -> DataFrame:
    """The newest facts whose lines, joined, take at most ``room`` bytes.

    Sizes are summed per run of positions first, so that no window holds all facts at once.
    """
    run = F.floor(F.col("seq") / 1024)
    sized = facts.withColumn("line", _fact_line()).withColumn("size", F.octet_length("line") + 1).withColumn("run", run)
    per = sized.groupBy("run").agg(F.sum("size").alias("n"))
    later = Window.orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("run", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"))
    within = Window.partitionBy("run").orderBy(F.col("seq").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = sized.join(offsets, "run").where(F.col("after") <= room + 1)
    return kept.withColumn("used", F.col("after") + F.sum("size").over(within)).where(F.col("used") <= room + 1)


def _fact_line() -> Column:
    return normalized_claim(F.col("subject"), F.col("key"), F.col("value"))


def _fact_lines(facts: DataFrame) -> DataFrame:
    return _lines(facts, FACTS, F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.col("id")), _fact_line())


def compose_context(snapshot: Snapshot, scope: str | None = None, budget: int | None = None, as_of_date: str | None = None) -> DataFrame:
    """``section, title, place, line``: what is told, by section and place; see :func:`render`.

    A token is four bytes of the rendered text, rounded down in all. Under a budget digests get coarser level by level, and only at
    the coarsest facts go, the oldest first. Locked details, open promises and budgets always stay. Sections
    without lines are left out. Only sums reach the driver.
    """
    spark = snapshot.facts.sparkSession
    due = F.when(F.col("due_scope").isNotNull(), F.concat(F.lit(" (due: "), F.col("due_scope"), F.lit(")"))).otherwise(F.lit(""))
    parts = {
        LOCKED: _lines(snapshot.anchors, LOCKED, F.col("detail_key"), F.concat("detail_key", F.lit("="), "locked_value", F.lit(" [locked]"))),
        PROMISES: _lines(
            snapshot.promises.where("status = 'open'"), PROMISES, F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.col("id")),
            F.concat(F.lit("["), F.col("key"), F.lit("] "), F.coalesce("description", F.lit("")), due),
        ),
        BUDGETS: _lines(directives(snapshot.counters), BUDGETS, F.col("key"), F.col("directive")),
        FACTS: _fact_lines(snapshot.facts),
    }
    if snapshot.as_of_seq is not None:
        date = f" (as of {as_of_date})" if as_of_date else ""
        said = f"This brief reflects the ledger as of seq {snapshot.as_of_seq}{date}. Later facts are not visible."
        parts[PIN] = _lines(spark.range(1), PIN, F.lit(""), F.lit(said))
    digest = _digest_lines(snapshot.digests, scope, LEVELS[0])
    if budget is not None:
        limit = 4 * budget + 3
        sizes = {s: _bytes(p) for s, p in parts.items()}
        for level in LEVELS:
            digest = _digest_lines(snapshot.digests, scope, level)
            total = _size(sizes | {DIGEST: _bytes(digest)})
            if total <= limit:
                break
        else:
            without = _size({s: n for s, n in sizes.items() if s != FACTS} | {DIGEST: _bytes(digest)})
            # the title of the section and what parts it from the others
            room = limit - without - len(TITLES[FACTS - 1]) - 4 - (2 if without else 0)
            parts[FACTS] = _fact_lines(_newest(snapshot.facts, room))
    return reduce(DataFrame.unionByName, [digest, *parts.values()])


def render(lines: DataFrame) -> DataFrame:
    """``text, tokens, sha256`` of a composed context. For contexts under a budget: the text is one value."""
    per = lines.groupBy("section", "title").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    body = F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    all_ = per.select("section", body.alias("body")).agg(F.array_sort(F.collect_list(F.struct("section", "body"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["body"]), "\n\n")
    return all_.select(text.alias("text")).select("text", F.floor(F.octet_length("text") / 4).cast("long").alias("tokens"), F.sha2("text", 256).alias("sha256"))
