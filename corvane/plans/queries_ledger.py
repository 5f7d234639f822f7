"""Registered queries of the fact ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corvane.operators import digests, ledger
from corvane.plans.inputs import HEAD, PIN, ctes, derived, head_at, pin_at, table
from corvane.plans.registry import query

FACT_COLUMNS = ["id", "seq", "claim_type", "subject", "key", "value", "scope_path", "status"]
_COLS = ", ".join(FACT_COLUMNS)


def _slice_sql(pin: str | None, where: str = "status = 'accepted'", tail: str = "") -> str:
    see = "SELECT * FROM claims" + (f" WHERE seq <= {pin}" if pin is not None else "")
    return f"""{ctes("claims")}, seen AS ({see})
        SELECT {_COLS} FROM seen c WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.supersedes_id = c.id) AND {where} {tail}"""


@query("slice_facts_head", _slice_sql(None))
def slice_facts_head(spark, d):
    return ledger.slice_facts(derived(spark, d, "claims")).select(FACT_COLUMNS)


@query("slice_facts_pin", _slice_sql(PIN))
def slice_facts_pin(spark, d):
    return ledger.slice_facts(derived(spark, d, "claims"), pin_at(spark, d)).select(FACT_COLUMNS)


@query("slice_facts_scope", _slice_sql(PIN, "status IN ('accepted', 'disputed') AND (scope_path = 'seg' OR scope_path LIKE 'seg.%')"))
def slice_facts_scope(spark, d):
    return ledger.slice_facts(derived(spark, d, "claims"), pin_at(spark, d), "seg", ["accepted", "disputed"]).select(FACT_COLUMNS)


@query("slice_newest_n", _slice_sql(PIN, tail="ORDER BY seq DESC, id LIMIT 25"))
def slice_newest_n(spark, d):
    return ledger.slice_facts(derived(spark, d, "claims"), pin_at(spark, d), limit=25).select(FACT_COLUMNS)


@query("chain_claims", f"{ctes('claims')} SELECT id, version_id, seq FROM claims WHERE version_id IN ('v1', 'v3')")
def chain_claims(spark, d):
    return ledger.chain_claims(derived(spark, d, "claims"), ["v1", "v3"]).select("id", "version_id", "seq")


@query("get_claim", f"{ctes('claims')} SELECT {_COLS} FROM claims WHERE id = 'c42'")
def get_claim(spark, d):
    return ledger.get_claim(derived(spark, d, "claims"), "c42").select(FACT_COLUMNS)


@query(
    "superseded_by",
    f"""{ctes("claims")} SELECT supersedes_id AS id, arg_min(id, seq) AS by, min(seq) AS by_seq FROM claims
        WHERE supersedes_id IS NOT NULL GROUP BY 1""",
)
def superseded_by(spark, d):
    return ledger.superseded_by(derived(spark, d, "claims"))


@query(
    "lineage_walk",
    f"""{ctes("versions").replace("WITH ", "WITH RECURSIVE ", 1)}, up(id, parent_id, step) AS (
        SELECT id, parent_id, 0 FROM versions WHERE id = 'v4'
        UNION ALL SELECT v.id, v.parent_id, step + 1 FROM versions v JOIN up ON v.id = up.parent_id)
        SELECT id, max(step) OVER () - step AS position FROM up""",
)
def lineage_walk(spark, d):
    return ledger.lineage(spark, derived(spark, d, "versions"), "v4")


@query(
    "anchors_pin",
    f"""{ctes("anchors")} SELECT detail_key, id, version_id, locked_value, seq FROM (
        SELECT *, row_number() OVER (PARTITION BY detail_key ORDER BY version_id DESC, seq DESC) AS n
        FROM anchors WHERE locked AND seq <= {PIN} AND version_id IN ('v1', 'v2', 'v3')) WHERE n = 1""",
)
def anchors_pin(spark, d):
    chain = ledger.lineage(spark, derived(spark, d, "versions"), "v3")
    return ledger.anchors_at(derived(spark, d, "anchors"), chain, pin_at(spark, d))


@query(
    "promises_pin",
    f"""{ctes("promises")} SELECT id, subject, seq, due_scope, key, description, CASE WHEN fulfilled_seq <= {PIN} THEN fulfilled_seq END AS fulfilled_seq,
        CASE WHEN fulfilled_seq <= {PIN} THEN 'fulfilled' ELSE 'open' END AS status FROM promises WHERE seq <= {PIN}""",
)
def promises_pin(spark, d):
    return ledger.promises_at(derived(spark, d, "promises"), pin_at(spark, d))


def _overdue_sql(message: str, where: str) -> str:
    return f"""{ctes("promises")} SELECT id AS promise_id, 'gate.promise-unfulfilled' AS rule_id, 'warn' AS severity, {message} AS message, 'ch3' AS scope_path,
        '{{"promise_id":"' || id || '","promise_key":"' || key || '"}}' AS detail FROM promises WHERE fulfilled_seq IS NULL AND {where}"""


@query("promise_overdue", _overdue_sql("'promise ''' || key || ''' was due at scope ''' || due_scope || ''' and is still open'", "due_scope = 'ch3'"))
def promise_overdue(spark, d):
    return ledger.overdue(ledger.promises_at(derived(spark, d, "promises")), "ch3")


@query("promise_overdue_final", _overdue_sql("'promise ''' || key || ''' is still open at the final unit: ' || description", "true"))
def promise_overdue_final(spark, d):
    return ledger.overdue(ledger.promises_at(derived(spark, d, "promises")), "ch3", final=True)


@query(
    "counter_totals_pin",
    f"{ctes('counters')} SELECT key, CAST(sum(count) AS BIGINT) AS count, max(budget) AS budget FROM counters WHERE seq <= {PIN} GROUP BY key",
)
def counter_totals_pin(spark, d):
    return ledger.counter_totals(derived(spark, d, "counters"), pin_at(spark, d))


@query(
    "counter_totals_latest",
    f"""{ctes("counters")} SELECT key, CAST(sum(count) AS BIGINT) AS count, max(budget) AS budget FROM (
        SELECT *, row_number() OVER (PARTITION BY version_id, key, scope_path ORDER BY seq DESC) AS n FROM counters)
        WHERE n = 1 AND seq <= {HEAD} - 5 GROUP BY key""",
)
def counter_totals_latest(spark, d):
    return ledger.counter_totals(derived(spark, d, "counters"), head_at(spark, d) - 5, latest_only=True)


_TOTALS = f"""{ctes("counters")}, t AS (SELECT key, CAST(sum(count) AS BIGINT) AS count, max(budget) AS budget FROM counters GROUP BY key),
    u AS (SELECT key, CASE key WHEN '1-URGENT' THEN budget WHEN '2-HIGH' THEN budget - 1 WHEN '5-LOW' THEN budget - 2 ELSE count END AS count, budget FROM t)"""


def _totals(spark, d):
    """Totals over their budget, at it, one below and two below."""
    t = ledger.counter_totals(derived(spark, d, "counters"))
    left = F.when(F.col("key") == "1-URGENT", 0).when(F.col("key") == "2-HIGH", 1).when(F.col("key") == "5-LOW", 2)
    return t.withColumn("count", F.coalesce(F.col("budget") - left, F.col("count")))


@query(
    "counter_budget",
    f"""{_TOTALS} SELECT key, 'gate.counter-budget' AS rule_id, 'warn' AS severity, CAST(NULL AS VARCHAR) AS scope_path,
        'counter ''' || key || ''' at ' || CAST(count AS VARCHAR) || ' exceeds whole-document budget ' || CAST(budget AS VARCHAR) AS message,
        '{{"budget":' || CAST(budget AS VARCHAR) || ',"counter_key":"' || key || '","total":' || CAST(count AS VARCHAR) || '}}' AS detail
        FROM u WHERE count > budget""",
)
def counter_budget(spark, d):
    return ledger.check_budgets(_totals(spark, d))


@query(
    "counter_directives",
    f"""{_TOTALS} SELECT key, key || ': used ' || CAST(count AS VARCHAR) || '/' || CAST(budget AS VARCHAR) ||
        CASE WHEN count >= budget THEN chr(10) || 'AVOID: ''' || key || ''' — budget exhausted'
             WHEN count + 1 = budget THEN chr(10) || 'CAUTION: ''' || key || ''' — one use remaining' ELSE '' END AS directive
        FROM u WHERE budget IS NOT NULL""",
)
def counter_directives(spark, d):
    return ledger.directives(_totals(spark, d))


@query(
    "chain_head",
    f"""{ctes("claims", "anchors", "promises", "counters")}
        SELECT greatest((SELECT max(seq) FROM claims), (SELECT max(seq) FROM anchors), (SELECT max(greatest(seq, fulfilled_seq)) FROM promises),
                        (SELECT max(seq) FROM counters)) AS head""",
)
def chain_head(spark, d):
    return ledger.chain_head(*(derived(spark, d, n) for n in ("claims", "anchors", "promises", "counters")))


@query(
    "append_claims",
    f"""{ctes("candidates")} SELECT cid, CAST({HEAD} + row_number() OVER (ORDER BY cid) AS BIGINT) AS seq FROM candidates""",
)
def append_claims(spark, d):
    head = head_at(spark, d)
    return ledger.append_claims(head, derived(spark, d, "candidates"), "cid", expected_head=head).select("cid", "seq")


_EVENTS = """SELECT CONCAT('src', CAST(user_id % 50 AS STRING)) AS source, epoch, 'e' || CAST(CASE WHEN event_id % 41 = 0 THEN before ELSE event_id END AS STRING) AS event_id, event_id AS arrival,
    CASE WHEN event_id % 41 = 0 THEN n - 1 WHEN event_id % 97 = 0 THEN n + 1 ELSE n END AS sequence,
    MD5(CAST(CASE WHEN event_id % 41 = 0 AND event_id % 2 = 0 THEN before ELSE event_id END AS STRING)) AS digest,
    CASE WHEN event_id % 89 = 0 THEN 'broken' ELSE MD5(CAST(before AS STRING)) END AS prior_digest
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id % 50, epoch ORDER BY event_id) AS n, LAG(event_id) OVER (PARTITION BY user_id % 50, epoch ORDER BY event_id) AS before
          FROM (SELECT *, CAST(FLOOR(event_id / 400) AS BIGINT) AS epoch FROM {events}) e) x"""


@query(
    "event_chain_check",
    f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY arrival, event_id) AS place FROM ({_EVENTS.format(events="events")})),
        go AS (SELECT source, epoch, event_id, sequence, place, arrival, CASE WHEN sequence = 1 THEN 'accepted' ELSE 'refused' END AS ack, CASE WHEN sequence = 1 THEN 1 ELSE 0 END AS last,
                CASE WHEN sequence = 1 THEN digest END AS had, CASE WHEN sequence = 1 THEN MAP {{event_id: digest}} ELSE MAP {{}} END AS taken FROM ev WHERE place = 1
            UNION ALL SELECT * FROM (SELECT e.source, e.epoch, e.event_id, e.sequence, e.place, e.arrival, a.ack, CASE WHEN a.ack = 'accepted' THEN e.sequence ELSE g.last END,
                CASE WHEN a.ack = 'accepted' THEN e.digest ELSE g.had END, CASE WHEN a.ack = 'accepted' THEN map_concat(g.taken, MAP {{e.event_id: e.digest}}) ELSE g.taken END
                FROM go g JOIN ev e ON e.source = g.source AND e.epoch = g.epoch AND e.place = g.place + 1,
                LATERAL (SELECT CASE WHEN g.taken[e.event_id] IS NOT NULL THEN CASE WHEN g.taken[e.event_id] = e.digest THEN 'replayed' ELSE 'mismatch' END
                    WHEN e.sequence = g.last + 1 AND (g.last = 0 OR e.prior_digest = g.had) THEN 'accepted' ELSE 'refused' END AS ack) a))
        SELECT source, epoch, event_id, sequence, ack FROM go WHERE ack NOT IN ('accepted', 'replayed')""",
)
def event_chain_check(spark, d):
    """Events by source and epoch, some broken, some sent again."""
    return ledger.event_chain_check(spark.sql(_EVENTS, events=table(spark, d, "events")))


_CHAINS = """SELECT CONCAT('v', CAST(o_orderkey AS STRING)) AS id, 'v' || CAST(LAG(o_orderkey) OVER (PARTITION BY CAST(FLOOR(o_orderkey / 256) AS BIGINT), o_orderstatus ORDER BY o_orderkey) AS STRING) AS parent_id
    FROM {orders}"""


@query(
    "version_lineages",
    f"""WITH RECURSIVE v AS MATERIALIZED ({_CHAINS.format(orders="orders")}), w AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM v WHERE parent_id IS NULL
            UNION ALL SELECT v.id, w.root, w.depth + 1 FROM w JOIN v ON v.parent_id = w.id)
        SELECT id, root, depth FROM w""",
)
def version_lineages(spark, d):
    """Root and depth of a version for each order, whose parent is the order before of the same status and range of keys."""
    return ledger.lineages(spark.sql(_CHAINS, orders=table(spark, d, "orders")))


_FACTS = f"""{ctes("claims")},
    facts AS (SELECT * FROM claims c WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM claims s WHERE s.supersedes_id = c.id))"""

_TIER0 = """SELECT scope, n_facts, built_from_seq, text, sha256(text) AS sha256 FROM (
    SELECT coalesce(scope_path, '') AS scope, count(*) AS n_facts, max(seq) AS built_from_seq,
           '[' || coalesce(scope_path, '') || '] ' || CAST(count(*) AS VARCHAR) || ' facts' || chr(10) ||
           string_agg(trim(subject) || '.' || trim(key) || '=' || trim(value), chr(10) ORDER BY seq) AS text
    FROM facts GROUP BY coalesce(scope_path, ''))"""
_TIER1 = """SELECT scope, n_facts, built_from_seq, text, sha256(text) AS sha256 FROM (
    SELECT scope, n_facts, built_from_seq, '[group ' || scope || '] ' || CAST(n_facts AS VARCHAR) || ' facts across ' || CAST(n_scopes AS VARCHAR) ||
           ' scopes; keys: ' || keys AS text
    FROM (SELECT split_part(coalesce(scope_path, ''), '.', 1) AS scope, count(*) AS n_facts, max(seq) AS built_from_seq,
                 count(DISTINCT scope_path) AS n_scopes, string_agg(DISTINCT subject || '.' || key, ', ' ORDER BY subject || '.' || key) AS keys FROM facts GROUP BY 1))"""
_TIER2 = """SELECT scope, n_facts, built_from_seq, text, sha256(text) AS sha256 FROM (
    SELECT '' AS scope, count(*) AS n_facts, coalesce(max(seq), 0) AS built_from_seq,
           '[rollup] ' || CAST(count(*) AS VARCHAR) || ' facts, ' || CAST(count(DISTINCT scope_path) AS VARCHAR) || ' scopes, ' ||
           CAST(count(DISTINCT subject) AS VARCHAR) || ' subjects: ' || string_agg(DISTINCT subject, ', ' ORDER BY subject) AS text FROM facts)"""


def _facts(spark, d):
    return ledger.slice_facts(derived(spark, d, "claims"))


@query("digest_tier0", f"{_FACTS} {_TIER0}")
def digest_tier0(spark, d):
    return digests.tier0(_facts(spark, d))


@query("digest_tier1", f"{_FACTS} {_TIER1}")
def digest_tier1(spark, d):
    return digests.tier1(_facts(spark, d))


@query("digest_tier2", f"{_FACTS} {_TIER2}")
def digest_tier2(spark, d):
    return digests.tier2(_facts(spark, d))


@query(
    "digest_ladder",
    f"""{_FACTS} SELECT *, 0 AS tier FROM ({_TIER0}) UNION ALL SELECT *, 1 AS tier FROM ({_TIER1}) UNION ALL SELECT *, 2 AS tier FROM ({_TIER2})""",
)
def digest_ladder(spark, d):
    return digests.ladder(_facts(spark, d))


@query(
    "snapshot_counts",
    f"""{ctes("claims", "anchors", "promises", "counters")}, seen AS (SELECT * FROM claims WHERE seq <= {PIN}),
        facts AS (SELECT * FROM seen c WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.supersedes_id = c.id)),
        d AS (SELECT '0' || scope || sha256 AS x FROM ({_TIER0}) UNION ALL SELECT '1' || scope || sha256 FROM ({_TIER1}) UNION ALL SELECT '2' || scope || sha256 FROM ({_TIER2}))
        SELECT 'facts' AS part, count(*) AS n, md5(string_agg(id || value, ',' ORDER BY id)) AS digest FROM facts
        UNION ALL SELECT 'anchors', count(*), md5(string_agg(detail_key || id, ',' ORDER BY detail_key)) FROM (
            SELECT *, row_number() OVER (PARTITION BY detail_key ORDER BY version_id DESC, seq DESC) AS k
            FROM anchors WHERE locked AND seq <= {PIN} AND version_id IN ('v1', 'v2', 'v3', 'v4')) WHERE k = 1
        UNION ALL SELECT 'promises', count(*), md5(string_agg(id || CASE WHEN fulfilled_seq <= {PIN} THEN 'fulfilled' ELSE 'open' END, ',' ORDER BY id)) FROM promises WHERE seq <= {PIN}
        UNION ALL SELECT 'counters', count(*), md5(string_agg(key || CAST(n AS VARCHAR), ',' ORDER BY key)) FROM (SELECT key, sum(count)::BIGINT AS n FROM counters WHERE seq <= {PIN} GROUP BY key)
        UNION ALL SELECT 'digests', count(*), md5(string_agg(x, ',' ORDER BY x)) FROM d""",
)
def snapshot_counts(spark, d):
    """Size and a digest of the contents of each part of a snapshot at the pin."""
    chain = ledger.lineage(spark, derived(spark, d, "versions"), "v4")
    s = ledger.load_snapshot(*(derived(spark, d, n) for n in ("claims", "anchors", "promises", "counters")), chain, pin_at(spark, d))
    said = {
        "facts": F.concat("id", "value"),
        "anchors": F.concat("detail_key", "id"),
        "promises": F.concat("id", "status"),
        "counters": F.concat("key", F.col("count").cast("string")),
        "digests": F.concat(F.col("tier").cast("string"), "scope", "sha256"),
    }
    order = {"facts": "id", "anchors": "detail_key", "promises": "id", "counters": "key"}

    def part(name):
        rows = F.array_sort(F.collect_list(F.struct(F.col(order[name]) if name in order else said[name], said[name].alias("x"))))
        joined = F.array_join(F.transform(rows, lambda r: r["x"]), ",")
        return getattr(s, name).agg(F.count(F.lit(1)).alias("n"), F.md5(joined).alias("digest")).select(F.lit(name).alias("part"), "n", "digest")

    return reduce(lambda a, b: a.unionByName(b), map(part, said))
