"""Registered queries of the operational reports, money, access and document governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import access, governance, money, reports
from corvane.operators.access import Binding, Principal
from corvane.plans.inputs import ctes, derived, table
from corvane.plans.registry import query


def _usage_sql(seen: str, said: str) -> str:
    return f"""{ctes("interactions", "turns", "sessions")},
        a AS (SELECT key, count(*) AS interactions, round(avg(latency_ms), 3) AS avg_latency FROM ({seen}) GROUP BY key),
        b AS (SELECT key, count(*) AS turns, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens FROM ({said}) GROUP BY key)
        SELECT key, coalesce(interactions, 0) AS interactions, coalesce(turns, 0) AS turns, coalesce(input_tokens, 0) AS input_tokens,
               coalesce(output_tokens, 0) AS output_tokens, avg_latency FROM a FULL OUTER JOIN b USING (key) ORDER BY interactions DESC, key LIMIT 500"""


def _usage(spark, d, group_by):
    return reports.usage(*(derived(spark, d, n) for n in ("interactions", "turns", "sessions")), group_by)


@query("usage_by_user", _usage_sql("SELECT uid AS key, latency_ms FROM interactions", "SELECT uid AS key, input_tokens, output_tokens FROM turns"))
def usage_by_user(spark, d):
    return _usage(spark, d, "uid")


@query(
    "usage_by_session",
    _usage_sql("SELECT session_id AS key, latency_ms FROM interactions WHERE session_id IS NOT NULL", "SELECT session_id AS key, input_tokens, output_tokens FROM turns"),
)
def usage_by_session(spark, d):
    return _usage(spark, d, "session")


@query(
    "usage_by_runbook",
    _usage_sql(
        "SELECT runbook_ref AS key, latency_ms FROM interactions WHERE runbook_ref IS NOT NULL",
        "SELECT runbook_ref AS key, input_tokens, output_tokens FROM turns JOIN sessions ON sessions.id = turns.session_id",
    ),
)
def usage_by_runbook(spark, d):
    return _usage(spark, d, "runbook")


@query(
    "usage_by_collection",
    _usage_sql(
        "SELECT unnest(collection_ids) AS key, latency_ms FROM interactions",
        "SELECT unnest(collections_searched) AS key, input_tokens, output_tokens FROM turns",
    ),
)
def usage_by_collection(spark, d):
    return _usage(spark, d, "collection")


@query(
    "cost_by_model",
    f"""{ctes("turns")} SELECT provider, model, count(*) AS turns, count(*) FILTER (ordinal % 5 = 1) AS overridden, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
        CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens FROM turns GROUP BY 1, 2""",
)
def cost_by_model(spark, d):
    return reports.cost_by_model(derived(spark, d, "turns").withColumn("was_override", F.expr("CASE WHEN ordinal % 5 = 1 THEN true WHEN ordinal % 5 = 2 THEN false END")))


@query(
    "timeseries_bucket",
    f"""{ctes("interactions")} SELECT CAST(time_bucket(INTERVAL '21600 seconds', created_at, TIMESTAMP '1970-01-01') AS VARCHAR) AS bucket,
        count(*) AS requests, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status >= 500) AS server_errors,
        quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM interactions GROUP BY 1""",
)
def timeseries_bucket(spark, d):
    return reports.timeseries(derived(spark, d, "interactions"), reports.parse_window("30d")[1])


@query(
    "endpoints_p95",
    f"""{ctes("interactions")} SELECT method, count(*) AS requests, round(count(*) FILTER (status >= 400) / count(*), 6) AS error_rate,
        round(avg(latency_ms), 4) AS avg_ms, quantile_cont(latency_ms, 0.95) AS p95 FROM interactions GROUP BY method ORDER BY requests DESC, method LIMIT 20""",
)
def endpoints_p95(spark, d):
    return reports.endpoints(derived(spark, d, "interactions"))


@query(
    "sessions_full_outer",
    f"""{ctes("sessions", "turns")},
        a AS (SELECT time_bucket(INTERVAL '6 hours', opened_at, TIMESTAMP '1970-01-01') AS bucket, count(*) AS opened, count(DISTINCT uid) AS users FROM sessions GROUP BY 1),
        b AS (SELECT time_bucket(INTERVAL '6 hours', created_at, TIMESTAMP '1970-01-01') AS bucket, count(*) AS turns, count(DISTINCT session_id) AS active, count(DISTINCT uid) AS active_uids FROM turns GROUP BY 1)
        SELECT CAST(bucket AS VARCHAR) AS bucket, coalesce(opened, 0) AS opened, coalesce(users, 0) AS users, coalesce(turns, 0) AS turns,
               coalesce(active, 0) AS active, coalesce(active_uids, 0) AS active_uids
        FROM a FULL OUTER JOIN b USING (bucket)""",
)
def sessions_full_outer(spark, d):
    return reports.sessions_report(derived(spark, d, "sessions"), derived(spark, d, "turns"))


@query(
    "evidence_layer_nearest_rank",
    f"""{ctes("metrics")}, per AS (SELECT profile, layer, count(*) AS turns, count(*) FILTER (refused) AS refusals, count(*) FILTER (complete) AS complete,
            quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM metrics GROUP BY 1, 2),
        c AS (SELECT profile, layer, string_agg(code || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, code) AS codes FROM (
            SELECT profile, layer, 'code-' || CAST(refusals_code AS VARCHAR) AS code, count(*) AS n FROM metrics WHERE refused GROUP BY ALL) GROUP BY 1, 2)
        SELECT profile, layer, turns, refusals, complete, p50, p95, coalesce(codes, '') AS codes FROM per LEFT JOIN c USING (profile, layer)""",
)
def evidence_layer_nearest_rank(spark, d):
    return reports.evidence_report(derived(spark, d, "metrics"))


@query(
    "runbook_report",
    """WITH s AS (SELECT l_orderkey, max(CAST(l_shipdate AS TIMESTAMP)) AS last FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
        SELECT o_orderstatus AS state, count(*) AS runs, round(avg((epoch_us(last) - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 1000), 1) AS avg_wall_ms
        FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1993-06-01 00:00:00' GROUP BY 1""",
)
def runbook_report(spark, d):
    """Orders are the runs, their items but the first the steps, so some runs have none."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    steps = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("updated_at"))
    return reports.runbook_report(runs, steps, "1993-06-01 00:00:00")


_LEDGER = """l AS (SELECT config_name, tier, day, CAST(coalesce(sum(units) FILTER (state = 'held'), 0) AS BIGINT) AS held,
    CAST(coalesce(sum(units) FILTER (state = 'settled'), 0) AS BIGINT) AS settled, count(*) AS n FROM reservations WHERE state <> 'released' GROUP BY 1, 2, 3)"""


@query("budget_ledger", f"{ctes('reservations')}, {_LEDGER} SELECT config_name, tier, CAST(day AS VARCHAR) AS day, held, settled, n FROM l")
def budget_ledger(spark, d):
    return reports.budget_ledger(derived(spark, d, "reservations")).withColumn("day", F.col("day").cast("string"))


@query(
    "budgets_vs_limits",
    f"""{ctes("reservations", "limits")}, {_LEDGER}, s AS (SELECT config_name, tier, max(held + settled) AS peak, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1, 2)
        SELECT config_name, tier, coalesce(peak, 0) AS peak, coalesce(n, 0) AS n, coalesce(daily_limit, 0) AS daily_limit, coalesce(peak > daily_limit, false) AS over
        FROM s FULL OUTER JOIN limits USING (config_name, tier)""",
)
def budgets_vs_limits(spark, d):
    return reports.budgets_vs_limits(reports.budget_ledger(derived(spark, d, "reservations")), derived(spark, d, "limits"))


@query(
    "budget_active_sum",
    f"""{ctes("reservations")} SELECT CAST(coalesce(sum(units), 0) AS BIGINT) AS active, coalesce(sum(units), 0) + 1 <= 1000000 AS fits
        FROM reservations WHERE day = DATE '1997-03-03' AND state <> 'released'""",
)
def budget_active_sum(spark, d):
    return reports.active_sum(derived(spark, d, "reservations"), "1997-03-03", 1_000_000)


@query(
    "control_plane_counts",
    f"""{ctes("sources", "sessions", "turns")} SELECT 'sources' AS part, count(*) AS n FROM sources UNION ALL SELECT 'sessions', count(*) FROM sessions
        UNION ALL SELECT 'turns', count(*) FROM turns UNION ALL SELECT 'events', count(*) FROM events""",
)
def control_plane_counts(spark, d):
    return reports.control_plane_counts(
        events=table(spark, d, "events"), **{n: derived(spark, d, n) for n in ("sources", "sessions", "turns")}
    )


@query(
    "storage_by_state",
    f"{ctes('reservations')} SELECT state, count(*) AS n, CAST(sum(units) AS BIGINT) AS bytes FROM reservations GROUP BY state",
)
def storage_by_state(spark, d):
    return reports.state_counts(derived(spark, d, "reservations"), "state", "units")


@query(
    "latency_report",
    f"""{ctes("interactions")}, s AS (SELECT method, latency_ms AS ms, CASE status WHEN 200 THEN 'passed' WHEN 404 THEN 'failed' WHEN 500 THEN 'harness_error' ELSE 'unavailable' END AS outcome FROM interactions)
        SELECT method, count(*) AS offered, count(*) FILTER (outcome = 'passed') AS correct, round(count(*) FILTER (outcome = 'passed') * 1000.0 / 2592000000.0, 9) AS goodput_per_second,
        quantile_disc(ms, 0.5) FILTER (outcome = 'passed') AS p50_ms, quantile_disc(ms, 0.95) FILTER (outcome = 'passed') AS p95_ms, min(ms) FILTER (outcome = 'passed') AS min_ms,
        max(ms) FILTER (outcome = 'passed') AS max_ms, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed,
        count(*) FILTER (outcome = 'harness_error') AS harness_error, count(*) FILTER (outcome = 'unavailable') AS unavailable FROM s GROUP BY method""",
)
def latency_report(spark, d):
    outcome = F.when(F.col("status") == 200, "passed").when(F.col("status") == 404, "failed").when(F.col("status") == 500, "harness_error").otherwise("unavailable")
    return reports.latency_report(derived(spark, d, "interactions").select("method", outcome.alias("outcome"), F.col("latency_ms").alias("duration_ms")), 30 * 86_400_000)


@query(
    "audit_page",
    f"""{ctes("interactions")} SELECT id, uid, method, status FROM interactions WHERE created_at < TIMESTAMP '2024-01-15 00:00:00'
        ORDER BY created_at DESC, id DESC LIMIT 50""",
)
def audit_page(spark, d):
    return reports.audit_page(derived(spark, d, "interactions"), "2024-01-15 00:00:00", 50).select("id", "uid", "method", "status")


@query(
    "filtered_interactions",
    f"""{ctes("interactions")} SELECT id, uid, method, status, CAST(json_extract(props, '$.k') AS INT) AS k FROM interactions
        WHERE method = 'purchase' AND status = 200 AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-09 00:00:00'""",
)
def filtered_interactions(spark, d):
    rows = reports.filtered(derived(spark, d, "interactions"), "2024-01-05", "2024-01-09", method="purchase", status=200, uid=None)
    return rows.select("id", "uid", "method", "status", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("next_ordinal", f"{ctes('turns')} SELECT session_id, CAST(coalesce(max(ordinal), 0) + 1 AS BIGINT) AS next_ordinal FROM turns GROUP BY session_id")
def next_ordinal(spark, d):
    return reports.next_ordinal(derived(spark, d, "turns"))


@query(
    "job_claim",
    f"""{ctes("jobs")} SELECT id, queue, state FROM jobs WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' AND (state = 'pending'
        OR (state = 'leased' AND lease_until < TIMESTAMP '2024-01-20 00:00:00' AND attempt < 4)) ORDER BY created_at, id LIMIT 10""",
)
def job_claim(spark, d):
    return reports.job_claim(derived(spark, d, "jobs"), "2024-01-20 00:00:00", most=10).select("id", "queue", "state")


@query(
    "lapsed_leases",
    f"""{ctes("jobs")} SELECT id, CASE WHEN attempt < 4 THEN 'retry' ELSE 'failed' END AS next, attempt + 1 AS attempt FROM jobs
        WHERE state = 'leased' AND lease_until < TIMESTAMP '2024-01-10 00:00:00'""",
)
def lapsed_leases(spark, d):
    return reports.lapsed_leases(derived(spark, d, "jobs"), "2024-01-10 00:00:00")


@query(
    "money_latest_obs",
    f"""{ctes("observations")} SELECT o.attempt_id, x.revision, x.coverage, x.micros, x.currency FROM (SELECT DISTINCT attempt_id FROM observations) o
        LEFT JOIN LATERAL (SELECT * FROM observations i WHERE i.attempt_id = o.attempt_id ORDER BY revision DESC LIMIT 1) x ON true""",
)
def money_latest_obs(spark, d):
    return money.latest_observations(derived(spark, d, "observations"))


@query(
    "money_report",
    f"""{ctes("observations")}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY revision DESC) AS n FROM observations) WHERE n = 1)
        SELECT currency, CAST(sum(micros) AS BIGINT) AS micros, count(*) FILTER (coverage = 'complete') AS complete,
               count(*) FILTER (coverage = 'partial') AS partial, count(*) FILTER (coverage = 'unknown') AS unknown FROM x GROUP BY currency""",
)
def money_report(spark, d):
    return money.money_report(derived(spark, d, "observations"))


_PRICED = """best AS (SELECT * FROM (SELECT a.id AS attempt, p.*, row_number() OVER (PARTITION BY a.id ORDER BY valid_from DESC, p.id DESC) AS n
    FROM attempts a JOIN prices p ON a.provider = p.provider AND a.route = p.route AND a.model = p.model AND submitted_at >= valid_from AND submitted_at < valid_until) WHERE n = 1),
    priced AS (SELECT a.*, b.id AS price_id, b.currency, b.basis, b.per_tokens AS per, b.input_micro AS r_in, b.output_micro AS r_out, b.cache_micro AS r_cache,
                      b.context_micro AS r_context, b.valid_from FROM attempts a LEFT JOIN best b ON b.attempt = a.id)"""


def _priced(spark, d):
    """Attempts with their price, whose rates are a map as an operator supplies them."""
    prices = derived(spark, d, "prices")
    micro = {"input": "input_micro", "output": "output_micro", "cache_read": "cache_micro", "cache_write": "cache_micro", "reasoning": "cache_micro", "context": "context_micro"}
    pairs = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.struct(F.col(c).alias("micro_units"), F.col("per_tokens").alias("per_tokens")).alias("v")))
        for k, c in micro.items()
    ])
    prices = prices.withColumn("rates", F.map_from_entries(F.array_compact(pairs))).drop("per_tokens", "input_micro", "output_micro", "cache_micro", "context_micro")
    return money.applicable_prices(derived(spark, d, "attempts"), prices)


@query("price_applicability", f"{ctes('attempts', 'prices')}, {_PRICED} SELECT id, price_id, CAST(valid_from AS VARCHAR) AS valid_from FROM priced")
def price_applicability(spark, d):
    return _priced(spark, d).select("id", F.col("price.id").alias("price_id"), F.col("price.valid_from").cast("string").alias("valid_from"))


def _charge(count: str, rate: str) -> str:
    return f"CAST(({count} * CAST({rate} AS HUGEINT) + per - 1) // per AS HUGEINT)"


@query(
    "money_calculate",
    f"""{ctes("attempts", "prices")}, {_PRICED},
        x AS (SELECT *, coalesce(basis = 'inclusive', false) AS inc, coalesce(cache_read, 0) + cache_write > input OR coalesce(reasoning > output, false) AS bad,
              basis = 'inclusive' AND r_cache IS NOT NULL AS wrong FROM priced),
        y AS (SELECT *, price_id IS NULL OR r_in IS NULL OR r_out IS NULL OR (NOT inc AND (r_cache IS NULL OR r_context IS NULL)) AS missing_price,
              output IS NULL OR (price_id IS NOT NULL AND NOT inc AND cache_read IS NULL) AS missing_usage,
              unknown_categories OR (inc AND output IS NOT NULL AND context > 0) AS strange FROM x),
        z AS (SELECT *, CASE WHEN inc THEN {_charge("input", "r_in")} + {_charge("output", "r_out")}
              ELSE {_charge("(input - cache_read - cache_write)", "r_in")} + {_charge("(output - reasoning)", "r_out")} + {_charge("cache_read", "r_cache")}
                   + {_charge("cache_write", "r_cache")} + {_charge("reasoning", "r_cache")} + {_charge("context", "r_context")} END AS total FROM y)
        SELECT id, CASE WHEN ok THEN price_id END AS price_id, CASE WHEN ok THEN currency END AS currency,
               CASE WHEN ok AND NOT missing_price AND NOT missing_usage AND NOT strange THEN CAST(total AS VARCHAR) END AS micro_units,
               CASE WHEN ok THEN missing_price END AS missing_price, CASE WHEN ok THEN missing_usage END AS missing_usage, CASE WHEN ok THEN strange END AS unknown_categories,
               CASE WHEN bad THEN 'usage subset exceeds parent total' WHEN wrong THEN 'invalid price snapshot' END AS error
        FROM (SELECT *, NOT bad AND NOT coalesce(wrong, false) AS ok FROM z)""",
)
def money_calculate(spark, d):
    return money.calculate(_priced(spark, d))


_EVIDENCE = """SELECT o_orderkey AS id, CAST(DATE '1997-01-01' + INTERVAL '1' DAY * CAST(o_orderkey % 3 AS INT) AS DATE) AS day,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'estimated' ELSE 'provider_reported' END AS usage_source,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS input_tokens, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS output_tokens FROM {orders}"""


@query(
    "budget_usage_coverage",
    f"""WITH e AS ({_EVIDENCE.format(orders="orders")}), x AS (SELECT *, coalesce(usage_source = 'provider_reported', false) AS told, (input_tokens IS NOT NULL)::INT + (output_tokens IS NOT NULL)::INT AS k FROM e WHERE day = DATE '1997-01-02')
        SELECT '1997-01-02' AS day, count(*) FILTER (told AND k = 2) AS complete, count(*) FILTER (told AND k = 1) AS partial, count(*) FILTER (NOT told OR k = 0) AS unknown FROM x""",
)
def budget_usage_coverage(spark, d):
    return money.usage_coverage(spark.sql(_EVIDENCE, orders=table(spark, d, "orders")), "1997-01-02")


@query(
    "access_permits",
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, o_orderkey % 4 AS level,
           CASE WHEN o_orderkey % 2 = 0 THEN ['eu'] WHEN o_orderkey % 3 = 0 THEN ['eu', 'hr'] ELSE [] END AS comp FROM orders)
       WHERE level <= 2 AND len(list_filter(comp, lambda x: x NOT IN ('eu', 'legal'))) = 0""",
)
def access_permits(spark, d):
    comp = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array('eu') WHEN o_orderkey % 3 = 0 THEN array('eu', 'hr') ELSE cast(array() AS array<string>) END")
    rows = table(spark, d, "orders")
    return rows.where(access.permits(Principal(2, ["eu", "legal"]), F.col("o_orderkey") % 4, comp)).select("o_orderkey", "o_orderpriority")


_BINDINGS = [
    Binding("alpha", prefix="src1/"),
    Binding("beta", prefix="src2", media_types=["application/pdf", "text/html"]),
    Binding("gamma", media_types=["text/markdown"]),
    Binding("delta", content_hashes=["d41d8cd98f00b204e9800998ecf8427e", "no such hash"]),
    Binding("every", prefix=""),
    Binding("empty"),
]


@query(
    "binding_match",
    f"""{ctes("sources")} SELECT source_id, 'alpha' AS collection FROM sources WHERE starts_with(path, 'src1/')
        UNION SELECT source_id, 'beta' FROM sources WHERE starts_with(path, 'src2') AND media_type = 'application/pdf'
        UNION SELECT source_id, 'gamma' FROM sources WHERE media_type = 'text/markdown'
        UNION SELECT source_id, 'delta' FROM sources WHERE content_hash IN ('d41d8cd98f00b204e9800998ecf8427e', 'no such hash')
        UNION SELECT source_id, 'every' FROM sources""",
)
def binding_match(spark, d):
    return access.matched_collections(derived(spark, d, "sources"), _BINDINGS)


@query(
    "route_collections",
    """WITH q AS (SELECT conv_id * 100 + turn AS query_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM conversations),
        r AS (SELECT query_id, list_contains(w, 'the') AND list_contains(w, 'of') AS a, list_contains(w, 'on') AS b FROM q)
        SELECT query_id, CASE WHEN a AND b THEN ['docs', 'faq', 'ops'] WHEN a THEN ['docs', 'faq'] WHEN b THEN ['ops'] ELSE ['docs', 'faq', 'ops', 'rest'] END AS collections FROM r""",
)
def route_collections(spark, d):
    q = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return access.route_collections(q, [([" The", "of"], ["docs", "faq"]), (["ON "], ["ops"])], ["docs", "faq", "ops", "rest"])


@query(
    "permitted_collections",
    f"""{ctes("sources")}, c AS (SELECT collection, min(access_level) AS level, count(*) > 150 AS active FROM sources GROUP BY 1)
        SELECT collection, level, active FROM c WHERE active AND level <= 0""",
)
def permitted_collections(spark, d):
    c = derived(spark, d, "sources").groupBy("collection").agg(F.min("access_level").alias("level"), (F.count(F.lit(1)) > 150).alias("active"))
    c = c.withColumn("compartments", F.expr("cast(array() as array<string>)"))
    return access.permitted_collections(c, Principal(0)).drop("compartments")


_PREFIXES = """SELECT prefix AS collection, prefix, CAST(MAX(p_size) % 4 AS INT) AS level,
    CASE WHEN LENGTH(prefix) % 3 = 0 THEN SPLIT('eu', ',') WHEN LENGTH(prefix) % 3 = 1 THEN SPLIT('eu,hr', ',') ELSE SPLIT('hr,hr', ',') END AS compartments
    FROM (SELECT p_size, SUBSTRING(CONCAT(p_brand, '/', p_type), 1, 6 + CAST(p_partkey % 12 AS INT)) AS prefix FROM {part}) x GROUP BY prefix"""


def _held(x: str) -> str:
    return f"""'["' || array_to_string({x}.compartments, '", "') || '"]'"""


@query(
    "prefix_shadowing",
    f"""WITH p AS ({_PREFIXES.format(part="part")}) SELECT a.collection AS outer, b.collection AS inner, a.prefix AS outer_prefix, b.prefix AS inner_prefix,
            'collection ''' || a.collection || ''' (level ' || CAST(a.level AS VARCHAR) || ', compartments ' || {_held("a")} || ') binds ''' || a.prefix || ''', a prefix of the more-restricted ''' ||
            b.collection || ''' (level ' || CAST(b.level AS VARCHAR) || ', ' || {_held("b")} || ') binding ''' || b.prefix || ''' — the restricted documents are also served to the wider audience; make the overlap a decision, not an accident' AS message
        FROM p a JOIN p b ON starts_with(b.prefix, a.prefix) AND a.collection <> b.collection AND a.level <= b.level AND list_has_all(b.compartments, a.compartments)
            AND (a.level < b.level OR len(list_distinct(a.compartments)) < len(list_distinct(b.compartments)))""",
)
def prefix_shadowing(spark, d):
    return access.shadowed_prefixes(spark.sql(_PREFIXES, part=table(spark, d, "part")))


@query(
    "unreadable_sources",
    f"{ctes('sources')} SELECT source_id, path FROM sources WHERE source_id IN (SELECT 'src-' || CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)",
)
def unreadable_sources(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select(F.concat(F.lit("src-"), F.col("doc_id")).alias("source_id"))
    return access.unreadable(derived(spark, d, "sources"), gone).select("source_id", "path")


_DAY = "1998-06-01"


_RULING = f"""{ctes("publications", "relations")},
        begun AS (SELECT * FROM publications WHERE effective_from <= DATE '{_DAY}'),
        ranked AS (SELECT *, rank() OVER (PARTITION BY document_id ORDER BY effective_from DESC, published_at DESC) AS r FROM begun),
        ties AS (SELECT document_id, count(DISTINCT id) AS ties FROM ranked WHERE r = 1 GROUP BY 1),
        top AS (SELECT t.*, CASE WHEN ties = 1 THEN p.id END AS id, p.state, p.effective_until AS until, p.collection FROM ties t
                JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS k FROM ranked WHERE r = 1) p ON p.document_id = t.document_id AND p.k = 1),
        rel AS (SELECT * FROM relations WHERE effective_from <= DATE '{_DAY}' AND (effective_until IS NULL OR effective_until > DATE '{_DAY}')),
        standing AS (SELECT document_id FROM top WHERE state <> 'withdrawn' AND (until IS NULL OR until > DATE '{_DAY}')),
        gone AS (SELECT DISTINCT to_document AS d FROM rel WHERE kind = 'supersedes' AND from_document IN (SELECT document_id FROM standing)),
        remain AS (SELECT document_id FROM standing WHERE document_id NOT IN (SELECT d FROM gone)),
        ruling AS (SELECT document_id, collection, id, CASE WHEN ties > 1 THEN 'ambiguous'
            WHEN document_id IN (SELECT from_document FROM rel WHERE kind = 'supersedes' AND from_document IN (SELECT d FROM gone)) THEN 'review'
            WHEN state = 'withdrawn' THEN 'withdrawn' WHEN until <= DATE '{_DAY}' THEN 'expired' WHEN document_id IN (SELECT d FROM gone) THEN 'superseded'
            WHEN document_id IN (SELECT from_document FROM rel WHERE kind = 'conflicts' OR (kind IN ('requires', 'amends', 'applies-to', 'exception-to')
                                                                                           AND to_document NOT IN (SELECT document_id FROM remain))) THEN 'review'
            ELSE 'governs' END AS verdict FROM top WHERE ties = 1 OR true)"""


def _verdicts(spark, d):
    return governance.governing_publications(derived(spark, d, "publications"), derived(spark, d, "relations"), _DAY)


@query("governing_publications", f"{_RULING} SELECT document_id, collection, id, verdict FROM ruling")
def governing_publications(spark, d):
    # which of two equally late ones is named is anyone's choice
    return _verdicts(spark, d).withColumn("id", F.when(F.col("verdict") != "ambiguous", F.col("id")))


@query(
    "governing_collections",
    f"""{_RULING} SELECT collection, document_id, id FROM ruling r WHERE verdict = 'governs'
        AND NOT EXISTS (SELECT 1 FROM ruling x WHERE x.collection = r.collection AND x.verdict IN ('ambiguous', 'review'))""",
)
def governing_collections(spark, d):
    return governance.governing(_verdicts(spark, d))


@query(
    "amendment_review",
    f"""{ctes("relations")}, t AS (SELECT * FROM relations WHERE kind IN ('amends', 'applies-to', 'exception-to')
            AND effective_from <= DATE '{_DAY}' AND (effective_until IS NULL OR effective_until > DATE '{_DAY}'))
        SELECT DISTINCT 'doc' || CAST(o_custkey AS VARCHAR) AS document_id FROM orders WHERE o_orderstatus = 'F'
        AND ('doc' || CAST(o_custkey AS VARCHAR) IN (SELECT to_document FROM t) OR 'doc' || CAST(o_custkey AS VARCHAR) IN (SELECT from_document FROM t))""",
)
def amendment_review(spark, d):
    picked = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("doc"), F.col("o_custkey")).alias("document_id")).distinct()
    return governance.amendment_review(picked, derived(spark, d, "relations"), _DAY)
