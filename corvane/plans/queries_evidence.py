"""Registered queries of the evidence plane, verification, and streams."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from corvane.operators import context, evidence, ledger, verification
from corvane.operators.access import Principal
from corvane.operators.evidence import EvidenceColumn, Layer, Manifest, View
from corvane.plans.inputs import PIN, ctes, derived, pin_at, table
from corvane.plans.queries_ledger import _TIER0, _TIER1, _TIER2
from corvane.plans.registry import query
from corvane.session import shared_dir
from corvane.streaming import streams

ORDERS = [
    EvidenceColumn("o_orderkey", "int64", False, key=True),
    EvidenceColumn("o_orderstatus", "string"),
    EvidenceColumn("o_custkey", "int64", name="customer", unit="id"),
    EvidenceColumn("late", "bool"),
    EvidenceColumn("at", "timestamp_tz"),
    EvidenceColumn("both", "array", element="string"),
]

_MANIFEST = Manifest("orders", ORDERS, authorization="level-0")
_ROWS = """SELECT o_orderpriority AS grp, o_orderdate, o_orderkey, CAST(o_orderkey AS VARCHAR) || chr(31) || coalesce(nullif(o_orderstatus, 'P'), chr(0)) || chr(31) ||
    CAST(o_custkey AS VARCHAR) || chr(31) || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END || chr(31) ||
    CASE WHEN o_orderkey % 5 = 0 THEN chr(0) ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') END || chr(31) || '[' || o_orderstatus || chr(31) || o_orderpriority || ']' AS r FROM orders"""


def _head_sql(key: bool, identity: str) -> str:
    """The head written out: each column's id, name, type, scale, unit, nullable and key flag."""
    columns = (
        f"o_orderkey,o_orderkey,int64,@,@,false,{'true' if key else 'false'}", "o_orderstatus,o_orderstatus,string,@,@,true,false", "o_custkey,customer,int64,@,id,true,false",
        "late,late,bool,@,@,true,false", "at,at,timestamp_tz,@,@,true,false", "both,both,array,@,@,true,false",
    )
    one = lambda c: " || chr(31) || ".join("chr(0)" if x == "@" else f"'{x}'" for x in c.split(","))
    return "'canon@1' || chr(29) || " + " || chr(30) || ".join(map(one, columns)) + f" || chr(29) || {identity} || chr(29)"


def _hashable(spark, d):
    return table(spark, d, "orders").select(
        "o_orderpriority", "o_orderdate", "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"), "o_custkey", (F.col("o_totalprice") > 100000).alias("late"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("at"), F.array("o_orderstatus", "o_orderpriority").alias("both"),
    )


@query(
    "logical_hash",
    f"""SELECT grp AS o_orderpriority, count(*) AS n_rows, sha256({_head_sql(True, "'keys' || chr(31) || 'false' || chr(31) || 'level-0'")} || string_agg(r, chr(30) ORDER BY r)) AS logical_hash
        FROM ({_ROWS}) GROUP BY 1""",
)
def logical_hash(spark, d):
    return evidence.logical_hashes(_hashable(spark, d), _MANIFEST, "o_orderpriority")


@query(
    "logical_hash_sequence",
    f"""SELECT count(*) AS n_rows, sha256({_head_sql(False, "'position' || chr(31) || 'o_orderdate' || chr(31) || 'o_orderkey' || chr(31) || 'true' || chr(31) || 'secret' || chr(31) || ''")} ||
        string_agg(r, chr(30) ORDER BY o_orderdate, o_orderkey)) AS logical_hash FROM ({_ROWS})""",
)
def logical_hash_sequence(spark, d):
    """Rows in a declared order, of a result that is cut and lacks a column."""
    columns = [replace(c, key=False) for c in ORDERS]
    m = Manifest("orders", columns, order_by=["o_orderdate", "o_orderkey"], truncated=True, denied=["secret"])
    return evidence.logical_hashes(_hashable(spark, d), m)


@query(
    "evidence_rows",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, true AS has_more FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20)""",
)
def evidence_rows(spark, d):
    m = Manifest("m", ORDERS[:4], level=1)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return evidence.rows_page(o, m, Principal(2), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40)


@query(
    "purge_due",
    """SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL '365' DAY <= TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey % 7 <> 0 AND o_orderstatus = 'F'""",
)
def purge_due(spark, d):
    a = table(spark, d, "orders").select(
        "o_orderkey", F.expr("o_orderdate + INTERVAL '365' DAY").cast("timestamp").alias("expires_at"), (F.col("o_orderkey") % 7 == 0).alias("held"),
        F.when(F.col("o_orderstatus") == "F", "committed").otherwise("open").alias("state"),
    )
    return evidence.purge_due(a, "1997-01-01 00:00:00").select("o_orderkey")


@query(
    "semantic_selection",
    """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 0) AS worth FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
)
def semantic_selection(spark, d):
    view = View({"orders": F.count(F.lit(1)), "worth": F.round(F.sum("o_totalprice"), 0)}, ["o_orderstatus", "o_orderpriority"], ["o_orderpriority"])
    return evidence.select_from(table(spark, d, "orders"), view, ["orders", "worth"], ["o_orderstatus"], {"o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("execute_plan", "SELECT 'ledger' AS layer, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'search', count(*) FROM documents WHERE lang = 'de'")
def execute_plan(spark, d):
    got = evidence.execute_plan(
        [
            Layer("ledger", lambda: table(spark, d, "orders").where("o_orderstatus = 'F'"), required=True),
            Layer("refusing", lambda: None),
            Layer("fallback", lambda: table(spark, d, "documents"), fallback=True),
            Layer("search", lambda: table(spark, d, "documents").where("lang = 'de'")),
        ]
    )
    parts = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n") for k, v in got.items() if not isinstance(v, str)]
    return parts[0].unionByName(parts[1])


@query(
    "count_conflicts",
    """WITH c AS (SELECT l_suppkey AS subject, l_returnflag AS layer, count(*) AS value FROM lineitem GROUP BY 1, 2)
        SELECT a.subject, a.layer AS a, a.value AS va, b.layer AS b, b.value AS vb FROM c a JOIN c b USING (subject) WHERE a.layer < b.layer AND a.value <> b.value""",
)
def count_conflicts(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("layer")).agg(F.count(F.lit(1)).alias("value"))
    return evidence.count_conflicts(c)


@query(
    "context_fit",
    """SELECT layer, ordinal, length, CAST(used AS BIGINT) AS used FROM (SELECT conv_id AS layer, turn AS ordinal, length(text) AS length,
        sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 900""",
)
def context_fit(spark, d):
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("layer"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("length"))
    return evidence.fit_budget(p, 900)


_PLAN = """SELECT conv_id AS turn, role AS layer, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS place, CASE WHEN conv_id % 2 = 0 AND role <> 'user' THEN 150 END AS budget,
    conv_id % 3 = 0 AND role = 'user' AS preserve FROM {conversations} GROUP BY conv_id, role"""


@query(
    "compose_layers",
    f"""WITH RECURSIVE l AS ({_PLAN.format(conversations="conversations")}), i AS (SELECT conv_id AS turn, role AS layer, sum(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS s FROM conversations),
        p AS MATERIALIZED (SELECT l.*, row_number() OVER (PARTITION BY turn ORDER BY place) AS k, (SELECT list(s ORDER BY s) FROM i WHERE i.turn = l.turn AND i.layer = l.layer) AS sums FROM l),
        go AS (SELECT turn, CAST(0 AS BIGINT) AS k, CAST(400 AS BIGINT) AS lft, NULL::INT AS place, NULL::VARCHAR AS layer, NULL::VARCHAR AS state, NULL::INT AS kept, NULL::BIGINT AS used FROM (SELECT DISTINCT turn FROM p)
            UNION ALL SELECT turn, k, CAST(lft - used AS BIGINT), place, layer, CASE WHEN kept = 0 THEN 'dropped' WHEN kept = n THEN 'whole' ELSE 'partial' END, kept, used FROM (
                SELECT *, CAST(CASE WHEN kept = 0 THEN 0 ELSE sums[kept] END AS BIGINT) AS used FROM (
                    SELECT p.turn, p.k, g.lft, p.place, p.layer, p.sums, len(sums) AS n, CAST(CASE WHEN sums[len(sums)] <= least(g.lft, coalesce(budget, g.lft)) THEN len(sums) WHEN preserve THEN 0
                        ELSE len(list_filter(sums, lambda c: c <= least(g.lft, coalesce(budget, g.lft)))) END AS INT) AS kept
                    FROM go g JOIN p ON p.turn = g.turn AND p.k = g.k + 1)))
        SELECT turn, place, layer, state, kept, used FROM go WHERE k > 0""",
)
def compose_layers(spark, d):
    """Conversations as turns, their roles as layers, some of which are to be preserved and don't fit."""
    c = table(spark, d, "conversations")
    items = c.select(F.col("conv_id").alias("turn"), F.col("role").alias("layer"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("length"))
    return evidence.compose_layers(items, spark.sql(_PLAN, conversations=c), 400)


_STEPS = """SELECT o_custkey AS turn, o_orderkey AS place, CONCAT('layer', CAST(o_orderkey % 5 AS STRING)) AS layer, CASE o_orderkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'fallback' ELSE 'supporting' END AS requirement,
    o_orderkey % 7 <> 0 AS produced, CASE WHEN o_orderkey % 2 = 0 THEN 'policy_denied' END AS refusal_code, o_orderkey % 11 = 0 AS complete, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 END AS counted FROM {orders}"""


@query(
    "plan_decisions",
    f"""WITH s AS ({_STEPS.format(orders="orders")}), h AS (SELECT *, coalesce(bool_or(produced) OVER (PARTITION BY turn ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had FROM s),
        r AS (SELECT * FROM h WHERE requirement <> 'fallback' OR NOT had),
        c AS (SELECT a.turn, count(*) AS n FROM r a JOIN r b ON a.turn = b.turn AND a.place < b.place WHERE a.produced AND b.produced AND a.counted <> b.counted GROUP BY 1),
        f AS (SELECT turn, layer, coalesce(refusal_code, 'unavailable') AS code FROM r WHERE requirement = 'required' AND NOT produced QUALIFY row_number() OVER (PARTITION BY turn ORDER BY place) = 1)
        SELECT g.*, coalesce(n, 0) AS disclosed_conflicts, f.layer AS failed_layer, f.code AS failed_code
        FROM (SELECT turn, count(*) AS layers, bool_or(produced AND complete) AS completeness_available FROM r GROUP BY turn) g LEFT JOIN c ON c.turn = g.turn LEFT JOIN f ON f.turn = g.turn""",
)
def plan_decisions(spark, d):
    """Customers as turns, their orders as the layers of their plans."""
    return evidence.plan_decisions(spark.sql(_STEPS, orders=table(spark, d, "orders")))


def _context_sql(pin: str | None, scope: str | None, budget: int | None) -> str:
    """All six sections, the four levels of digests, and facts trimmed at the last of them."""
    seen = f" WHERE seq <= {pin}" if pin else ""
    done = f"fulfilled_seq <= {pin}" if pin else "fulfilled_seq IS NOT NULL"
    group = "''" if scope is None else f"'{scope.split('.')[0]}'"
    mine = "false" if scope is None else f"split_part(scope, '.', 1) = {group}"
    others = "true" if scope is None else f"scope <> {group}"
    limit = "NULL" if budget is None else str(4 * budget + 3)
    header = (
        f"""SELECT 1 AS section, 'Point-in-time pin' AS title, '' AS place, 'This brief reflects the ledger as of seq ' || CAST({pin} AS VARCHAR) || '. Later facts are not visible.' AS line UNION ALL"""
        if pin
        else ""
    )
    return f"""{ctes("claims", "anchors", "promises", "counters")}, seen AS (SELECT * FROM claims{seen}),
        facts AS (SELECT * FROM seen c WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.supersedes_id = c.id)),
        t0 AS ({_TIER0}), t1 AS ({_TIER1}), t2 AS ({_TIER2}),
        d AS (SELECT 1 AS lv, '0' || scope AS place, text FROM t0 UNION ALL SELECT 2, '0' || scope, text FROM t0 WHERE {mine} UNION ALL SELECT 2, '1' || scope, text FROM t1 WHERE {others}
              UNION ALL SELECT 3, '1' || scope, text FROM t1 UNION ALL SELECT 4, '2' || scope, text FROM t2),
        f AS (SELECT seq, id, trim(subject) || '.' || trim(key) || '=' || trim(value) AS line FROM facts),
        fixed AS ({header}
            SELECT 4 AS section, 'Locked details' AS title, detail_key AS place, detail_key || '=' || locked_value || ' [locked]' AS line FROM (
                SELECT *, row_number() OVER (PARTITION BY detail_key ORDER BY version_id DESC, seq DESC) AS k FROM anchors
                WHERE locked AND version_id IN ('v1', 'v2', 'v3', 'v4'){seen.replace(" WHERE", " AND")}) WHERE k = 1
            UNION ALL SELECT 5, 'Open promises', lpad(CAST(seq AS VARCHAR), 20, '0') || id, '[' || key || '] ' || description || ' (due: ' || due_scope || ')' FROM (SELECT * FROM promises{seen})
                WHERE NOT coalesce({done}, false)
            UNION ALL SELECT 6, 'Frequency budgets', key, key || ': used ' || CAST(n AS VARCHAR) || '/' || CAST(b AS VARCHAR) ||
                CASE WHEN n >= b THEN chr(10) || 'AVOID: ''' || key || ''' — budget exhausted' WHEN n + 1 = b THEN chr(10) || 'CAUTION: ''' || key || ''' — one use remaining' ELSE '' END
                FROM (SELECT key, CAST(sum(count) AS BIGINT) AS n, max(budget) AS b FROM counters{seen} GROUP BY key) WHERE b IS NOT NULL),
        parts AS (SELECT 0 AS lv, strlen(any_value(title)) + 4 + sum(strlen(line)) + count(*) - 1 AS b FROM fixed GROUP BY section),
        fb AS (SELECT CASE WHEN count(*) > 0 THEN 18 + sum(strlen(line)) + count(*) - 1 END AS b FROM f),
        db AS (SELECT l.lv, CASE WHEN count(text) > 0 THEN 16 + sum(strlen(text)) + count(*) - 1 END AS b FROM (SELECT unnest([1, 2, 3, 4]) AS lv) l LEFT JOIN d ON d.lv = l.lv GROUP BY 1),
        base AS (SELECT db.lv, coalesce((SELECT sum(b) FROM parts), 0) + coalesce(db.b, 0) + 2 * greatest(0, (SELECT count(*) FROM parts) + (db.b IS NOT NULL)::INT - 1) AS b FROM db),
        full_size AS (SELECT lv, base.b + coalesce(fb.b + 2, 0) AS b FROM base, fb),
        chosen AS (SELECT CASE WHEN {limit} IS NULL THEN 1 ELSE coalesce((SELECT min(lv) FROM full_size WHERE b <= {limit}), 4) END AS lv,
                          {limit} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM full_size WHERE b <= {limit}) AS cut),
        kept AS (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY seq DESC, id DESC) AS used FROM f)
        SELECT section, title, place, line FROM fixed
        UNION ALL SELECT 2, 'Canon digest', place, text FROM d, chosen WHERE d.lv = chosen.lv
        UNION ALL SELECT 3, 'Accepted facts', lpad(CAST(seq AS VARCHAR), 20, '0') || id, line FROM kept, chosen
            WHERE NOT cut OR used - 1 <= {limit} - (SELECT b FROM base WHERE lv = 4) - 20"""


def _snapshot(spark, d, pin=None):
    chain = ledger.lineage(spark, derived(spark, d, "versions"), "v4")
    return ledger.load_snapshot(*(derived(spark, d, n) for n in ("claims", "anchors", "promises", "counters")), chain, pin)


@query("context_compose", _context_sql(None, None, None))
def context_compose(spark, d):
    """Without a budget all is told."""
    return context.compose_context(_snapshot(spark, d))


@query("context_compose_pin", _context_sql(PIN, "seg.BUILDING", 40_000))
def context_compose_pin(spark, d):
    """At a pin and under a budget; which level it comes to depends on the size of the ledger."""
    return context.compose_context(_snapshot(spark, d, pin_at(spark, d)), "seg.BUILDING", 40_000)


@query("context_compose_tight", _context_sql(None, None, 32_000))
def context_compose_tight(spark, d):
    return context.compose_context(_snapshot(spark, d), None, 32_000)


@query(
    "context_text",
    f"""WITH l AS ({_context_sql(PIN, None, 3000)}), s AS (SELECT section, '## ' || any_value(title) || chr(10) || string_agg(line, chr(10) ORDER BY place) AS body FROM l GROUP BY section),
        t AS (SELECT string_agg(body, chr(10) || chr(10) ORDER BY section) AS text FROM s) SELECT text, CAST(strlen(text) // 4 AS BIGINT) AS tokens, sha256(text) AS sha256 FROM t""",
)
def context_text(spark, d):
    """The text itself."""
    return context.render(context.compose_context(_snapshot(spark, d, pin_at(spark, d)), None, 3000))


@query(
    "observations_to_claims",
    """SELECT 'obs-' || CAST(o_orderkey AS VARCHAR) AS id, 'cust-' || CAST(o_custkey AS VARCHAR) AS subject, 'price' AS key, CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) AS value,
        CASE WHEN o_orderkey % 2 = 0 THEN 'fact' ELSE 'correction' END AS claim_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid_from FROM orders WHERE o_orderkey % 6 <> 0""",
)
def observations_to_claims(spark, d):
    cust = F.concat(F.lit("cust-"), F.col("o_custkey"))
    batch = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("observation_id"),
        F.when(F.col("o_orderkey") % 6 == 0, F.array(cust, F.lit("other"))).otherwise(F.array(cust)).alias("entity_candidates"),
        F.lit("price").alias("property"),
        F.round("o_totalprice", 0).cast("long").alias("value"),
        F.when(F.col("o_orderkey") % 2 == 0, "snapshot").otherwise("update").alias("change_kind"),
        F.to_date("o_orderdate").alias("valid_from"),
    )
    return evidence.observations_to_claims(batch)


_ANSWERS = """SELECT doc_id AS answer_id, CONCAT('He said "', SUBSTRING(text, 5, 30), '" and "', SUBSTRING(text, 1, 4), '" in [', source, '/', CAST(doc_id % 50 AS STRING),
    '] and [of the ', lang, '/', CAST(doc_id % 4 AS STRING), '] and [see] evidence/ev', CAST(doc_id % 3 AS STRING), '#', CAST(doc_id % 40 AS STRING), ' of ', CAST(doc_id % 20 AS STRING)) AS answer FROM {documents}"""
_SERVED = """SELECT doc_id AS answer_id, CONCAT(source, '/', CAST(doc_id % 60 AS STRING)) AS path,
    CASE WHEN doc_id % 3 = 0 THEN UPPER(SUBSTRING(text, 6, 400)) ELSE text END AS text FROM {documents}"""
_CELLS = "SELECT CONCAT('ev', CAST(doc_id % 2 AS STRING)) AS evidence_id, doc_id % 40 AS row, doc_id % 13 AS value FROM {documents}"


def _verif(spark, d):
    docs = table(spark, d, "documents")
    return spark.sql(_ANSWERS, documents=docs), spark.sql(_SERVED, documents=docs), spark.sql(_CELLS, documents=docs)


_V = f"WITH a AS ({_ANSWERS.format(documents='documents')}), s AS ({_SERVED.format(documents='documents')}), c AS ({_CELLS.format(documents='documents')})"


_WS = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query(
    "quote_check",
    f"""{_V}, p AS (SELECT answer_id, regexp_split_to_array(answer, '["“”]') AS p FROM a),
        q AS (SELECT answer_id, unnest(list_filter(p, lambda x, i: i % 2 = 0 AND i < len(p))) AS quote FROM p),
        k AS (SELECT *, {_WS.format(t="quote")} AS n FROM q WHERE strlen(trim(quote, chr(10) || ' ')) >= 15)
        SELECT answer_id, quote FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.answer_id = k.answer_id AND contains({_WS.format(t="s.text")}, k.n))""",
)
def quote_check(spark, d):
    a, s, _ = _verif(spark, d)
    return verification.check_quotes(a, s)


@query(
    "citation_check",
    f"""{_V}, x AS (SELECT DISTINCT answer_id, trim(t) AS path FROM (SELECT answer_id, unnest(regexp_extract_all(answer, '\\[([^\\]]*)\\]', 1)) AS t FROM a)
            WHERE contains(t, '/') AND NOT contains(t, chr(10)))
        SELECT answer_id, path FROM x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.answer_id = x.answer_id AND s.path = x.path)""",
)
def citation_check(spark, d):
    a, s, _ = _verif(spark, d)
    return verification.check_citations(a, s)


_ASSERTED = """SELECT doc_id AS answer_id, CASE WHEN doc_id % 23 = 0 THEN 'no block at all' ELSE CONCAT('As [evidence/ev', CAST(doc_id % 3 AS STRING), '#r', CAST(doc_id % 44 AS STRING), '] and [evidence/ev1] say ```assertions ',
    CASE WHEN doc_id % 17 = 0 THEN '[{"value": ' ELSE CONCAT('[{"value": " ', CAST(doc_id % 13 + doc_id % 2 AS STRING), '", "evidence_refs": [',
        CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '"contracts/chunk-9"' WHEN doc_id % 7 = 0 THEN CONCAT('"evidence/ev0#r2", "evidence/ev0#r', CAST(doc_id % 50 AS STRING), '"')
             ELSE CONCAT('"evidence/ev', CAST(doc_id % 3 AS STRING), '#r', CAST(doc_id % 40 AS STRING), '"') END, ']}]') END,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE '``` and so on' END) END AS answer FROM {documents}"""
_ROWS = "SELECT CONCAT('ev', CAST(doc_id % 2 AS STRING)) AS evidence_id, CONCAT('r', CAST(doc_id % 40 AS STRING)) AS row_id, CONCAT(CAST(doc_id % 13 AS STRING), ' ') AS value FROM {documents}"


def _asserted(spark, d):
    docs = table(spark, d, "documents")
    docs.createOrReplaceTempView("asserted_documents")
    return spark.sql(_ASSERTED.replace("{documents}", "asserted_documents")), spark.sql(_ROWS, documents=docs)


_A = f"WITH a AS ({_ASSERTED.replace('{documents}', 'documents')}), c AS ({_ROWS.format(documents='documents')})"


@query(
    "cell_check",
    f"""{_A}, b AS (SELECT answer_id, substr(answer, strpos(answer, '```assertions') + 13) AS rest FROM a WHERE contains(answer, '```assertions')),
        k AS (SELECT answer_id, contains(rest, '```') AS closed, trim(split_part(rest, '```', 1)) AS body FROM b),
        p AS (SELECT answer_id, unnest(json_transform(body, '[{{"value": "VARCHAR", "evidence_refs": ["VARCHAR"]}}]')) AS x FROM k WHERE closed AND json_valid(body)),
        r AS (SELECT answer_id, x.value AS value, len(x.evidence_refs) AS m, unnest(x.evidence_refs) AS ref FROM p),
        v AS (SELECT *, regexp_matches(ref, '^evidence/[^#]+#.') AS ok, regexp_extract(ref, '^evidence/([^#]+)#(.+)$', 1) AS e, regexp_extract(ref, '^evidence/([^#]+)#(.+)$', 2) AS w FROM r)
        SELECT answer_id, NULL::VARCHAR AS value, NULL::VARCHAR AS ref, CASE WHEN closed THEN 'unparsed' ELSE 'unclosed' END AS fault FROM k WHERE NOT closed OR NOT json_valid(body)
        UNION ALL SELECT answer_id, x.value, NULL, 'no_evidence' FROM p WHERE len(x.evidence_refs) = 0
        UNION ALL SELECT * FROM (SELECT answer_id, value, ref, CASE WHEN NOT ok THEN 'not_a_reference'
            WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.evidence_id = e AND c.row_id = w) THEN 'not_served'
            WHEN m = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.evidence_id = e AND c.row_id = w AND trim(c.value) = trim(v.value)) THEN 'not_in_row' END AS fault FROM v) WHERE fault IS NOT NULL""",
)
def cell_check(spark, d):
    """Typed assertions against the rows that were served."""
    return verification.check_assertions(*_asserted(spark, d))


@query(
    "evidence_citation_check",
    rf"""{_A}, x AS (SELECT DISTINCT answer_id, trim(t) AS ref FROM (SELECT answer_id, unnest(regexp_extract_all(answer, '\[([^\]]*)\]', 1)) AS t FROM a))
        SELECT answer_id, ref FROM x WHERE regexp_matches(ref, '^evidence/[^#]+#.') AND NOT EXISTS (SELECT 1 FROM c WHERE 'evidence/' || c.evidence_id || '#' || c.row_id = ref)""",
)
def evidence_citation_check(spark, d):
    return verification.check_evidence_citations(*_asserted(spark, d))


@query(
    "frozen_grade",
    """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lower(text) || CASE WHEN doc_id % 4 = 0 THEN ' there is not enough evidence' ELSE '' END END AS t, [source || '/x', lang] AS cited FROM documents),
        g AS (SELECT doc_id, t, cited, t <> '' AS ran, starts_with(cited[1], 'src1') AS leak, list_contains(cited, 'en') OR list_contains(cited, 'de') AS any_ok, list_contains(cited, 'src2/x') AS all_ok,
              contains(t, 'the') AS has, (contains(t, 'of') OR contains(t, 'de')) AND contains(t, 'a') AS sides, contains(t, 'not enough evidence') AS short FROM a),
        v AS (SELECT *, CASE WHEN (doc_id % 2 = 0 AND leak) OR NOT any_ok OR (doc_id % 5 = 0 AND NOT all_ok) THEN 'FAIL' ELSE 'PASS' END AS evidence,
              CASE WHEN NOT ran THEN 'FAIL' WHEN NOT has OR (doc_id % 3 = 0 AND NOT sides) OR (doc_id % 8 = 0 AND NOT short) THEN 'FAIL' ELSE 'PASS' END AS answer FROM g)
        SELECT doc_id AS case_id, evidence, answer, doc_id % 2 = 0 AND leak AS hard_fail, CASE WHEN doc_id % 2 = 0 AND leak THEN cited[1] ELSE '' END AS leaked FROM v""",
)
def frozen_grade(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " there is not enough evidence").otherwise(""))
    docs = table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 9 != 0, text).alias("answer"), F.array(F.concat("source", F.lit("/x")), "lang").alias("cited"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    case = F.col("case_id")
    e = a.select(
        "case_id", words("en", "de").alias("cite_any"), F.when(case % 2 == 0, words("src1")).alias("must_not_cite"), words("The").alias("contains_all"), F.lit(None).cast("array<string>").alias("cite_all"),
        F.when(case % 5 == 0, words("src2/x")).alias("conflict_cite_all"), F.lit(None).cast("array<string>").alias("conflict_cite_any"),
        F.when(case % 3 == 0, F.array(words("of", "DE"), words("a"))).alias("sides"), (case % 8 == 0).alias("insufficient"),
    )
    return verification.grade(a, e).withColumn("leaked", F.array_join("leaked", ","))


_RESPONSES = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'openai' WHEN 3 THEN 'ollama' WHEN 4 THEN 'anthropic' ELSE 'openai' END AS provider,
    CASE event_id % 6
        WHEN 0 THEN CONCAT('{"usage": {"prompt_tokens": ', CAST(user_id + 9 AS STRING), ', "completion_tokens": ', CAST(user_id + 8 AS STRING),
            ', "total_tokens": 7, "prompt_tokens_details": {"cached_tokens": 4, "audio_tokens": ', CAST(user_id % 2 AS STRING), '}, "completion_tokens_details": {"reasoning_tokens": 8}}}')
        WHEN 1 THEN CONCAT('{"usage": {"input_tokens": ', CAST(user_id AS STRING), ', "output_tokens": 2, "cache_read_input_tokens": 5}}')
        WHEN 2 THEN CONCAT('{"usage": {"prompt_tokens": ', CAST(user_id AS STRING), ', "completion_tokens": "many", "context_tokens": 3}}')
        WHEN 3 THEN CONCAT('{"prompt_eval_count": ', CAST(user_id AS STRING), ', "eval_count": 1.5}')
        WHEN 4 THEN CONCAT('{"usage": {"input_tokens": ', CAST(user_id AS STRING), ', "output_tokens": 2, "cache_creation_input_tokens": null}}')
        ELSE CASE WHEN user_id % 2 = 0 THEN 'not json' ELSE '{"error": "x"}' END END AS response FROM {events}"""


@query(
    "provider_usage",
    """SELECT event_id AS id, CAST(CASE event_id % 6 WHEN 0 THEN user_id + 9 WHEN 1 THEN user_id + 5 WHEN 2 THEN user_id WHEN 3 THEN user_id END AS BIGINT) AS input,
        CAST(CASE event_id % 6 WHEN 0 THEN user_id + 8 WHEN 1 THEN 2 WHEN 4 THEN 2 END AS BIGINT) AS output, CAST(CASE event_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 4 THEN 0 END AS BIGINT) AS cache_read,
        CAST(CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS BIGINT) AS cache_write, CAST(CASE event_id % 6 WHEN 0 THEN 8 END AS BIGINT) AS reasoning, CAST(NULL AS BIGINT) AS context,
        event_id % 6 = 2 OR (event_id % 6 = 0 AND user_id % 2 = 1) AS unknown_categories FROM events""",
)
def provider_usage(spark, d):
    return verification.provider_usage(spark.sql(_RESPONSES.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"), events=table(spark, d, "events")))


@query(
    "intents",
    """SELECT conv_id, turn, CASE WHEN text LIKE '%lookup%' THEN 'lookup' WHEN role = 'user' THEN 'comparison' WHEN role = 'system' THEN 'timeline' END AS intent FROM conversations""",
)
def intents(spark, d):
    label = F.when(F.col("role") == "user", "A Comparison, other").when(F.col("role") == "system", "timeline").otherwise("none of these")
    return table(spark, d, "conversations").select("conv_id", "turn", verification.intent(label).alias("intent"))


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, frame, parts: int = 3):
    """A log of a few files, read as a stream, all at once."""
    at = _scratch(spark)
    frame.repartition(parts, "created_at").write.parquet(f"{at}/log")
    return streams.read_log(spark, f"{at}/log", spark.read.parquet(f"{at}/log").schema, parts), at


@query(
    "stream_tumbling",
    f"""{ctes("interactions")} SELECT CAST(time_bucket(INTERVAL '6 hours', created_at, TIMESTAMP '1970-01-01') AS VARCHAR) AS bucket, count(*) AS requests,
        count(*) FILTER (status >= 500) AS server_errors FROM interactions GROUP BY 1""",
)
def stream_tumbling(spark, d):
    log = derived(spark, d, "interactions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream, at = _stream(spark, d, log)
    out = streams.run_available(streams.tumbling(stream, late="60 days"), f"{at}/out", f"{at}/state", "complete")
    return out.select(F.col("bucket").cast("string").alias("bucket"), "requests", "server_errors")


@query(
    "stream_idempotent",
    f"""{ctes("interactions")} SELECT idempotency_key, count(DISTINCT body_hash) AS bodies FROM (SELECT uid || '-' || CAST(id % 5 AS VARCHAR) AS idempotency_key, md5(method) AS body_hash FROM interactions) GROUP BY 1""",
)
def stream_idempotent(spark, d):
    log = derived(spark, d, "interactions").select(
        F.concat("uid", F.lit("-"), (F.col("id") % 5).cast("string")).alias("idempotency_key"), F.md5("method").alias("body_hash"), F.col("created_at").cast("timestamp").alias("created_at")
    )
    stream, at = _stream(spark, d, log)
    out = streams.run_available(streams.idempotent(stream, "60 days"), f"{at}/out", f"{at}/state")
    return out.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("bodies"))


@query(
    "stream_acknowledged",
    f"""{ctes("interactions")}, r AS (SELECT uid || '-' || CAST(id % 5 AS VARCHAR) AS k, CAST(id AS VARCHAR) AS request_id, md5(method) AS h, created_at FROM interactions),
        f AS (SELECT *, row_number() OVER w AS n, first_value(h) OVER w AS first FROM r WINDOW w AS (PARTITION BY k ORDER BY created_at, request_id))
        SELECT k AS idempotency_key, CASE WHEN n = 1 THEN 'accepted' WHEN h = first THEN 'replayed' ELSE 'refused' END AS ack, count(*) AS n FROM f GROUP BY 1, 2""",
)
def stream_acknowledged(spark, d):
    """Answers of a keyed state to requests, some with the key of another."""
    log = derived(spark, d, "interactions").select(
        F.concat("uid", F.lit("-"), (F.col("id") % 5).cast("string")).alias("idempotency_key"), F.col("id").cast("string").alias("request_id"), F.md5("method").alias("body_hash"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
    stream, at = _stream(spark, d, log, spark.sparkContext.defaultParallelism)
    out = streams.run_available(streams.acknowledged(stream, 400 * 86_400_000), f"{at}/out", f"{at}/state", rocksdb=True)
    return out.groupBy("idempotency_key", "ack").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_gated_append",
    f"""{ctes("interactions")} SELECT uid, count(*) AS n FROM interactions WHERE status < 400 GROUP BY uid""",
)
def stream_gated_append(spark, d):
    log = derived(spark, d, "interactions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream, at = _stream(spark, d, log)
    streams.gated_append(stream, lambda b: b.where("status < 400"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "idempotency_conflicts",
    f"""{ctes("interactions")} SELECT uid AS idempotency_key, count(DISTINCT method) AS bodies FROM interactions GROUP BY 1 HAVING count(DISTINCT method) > 1""",
)
def idempotency_conflicts(spark, d):
    return streams.conflicts(derived(spark, d, "interactions").select(F.col("uid").alias("idempotency_key"), F.md5("method").alias("body_hash")))


@query(
    "redacted_bodies",
    f"""SELECT event_id, CASE WHEN event_id % 10 = 4 THEN '{{"redacted":"response contains secret material; not stored"}}' WHEN c = '' THEN NULL WHEN strlen(c) <= 40 AND json_valid(c) THEN c
            ELSE '{{"bytes_len":' || CAST(strlen(c) AS VARCHAR) || ',"sha256":"' || sha256(c) || '"}}' END AS body
        FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"Token": "x", "props": ' || props || ', "more": "' || event_type || '"}}' WHEN 1 THEN '' WHEN 2 THEN 'not json ' || event_type ELSE '{{"q": "' || event_type || '"}}' END AS c FROM events)""",
)
def redacted_bodies(spark, d):
    n = F.col("event_id") % 5
    long = F.concat(F.lit('{"Token": "x", "props": '), "props", F.lit(', "more": "'), "event_type", F.lit('"}'))
    body = F.when(n == 0, long).when(n == 1, "").when(n == 2, F.concat(F.lit("not json "), "event_type")).otherwise(F.concat(F.lit('{"q": "'), "event_type", F.lit('"}')))
    return table(spark, d, "events").select("event_id", verification.logged_body(body, 40, F.col("event_id") % 10 == 4).alias("body"))


@query("stream_reservations")
def stream_reservations(spark, d):
    """Balances after each event of a keyed, stateful stream; compared with a plain loop in the tests."""
    log = derived(spark, d, "interactions").select(
        F.col("uid").alias("budget"), F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("id"),
        F.when(F.col("method") == "purchase", "settle").when(F.col("method") == "error", "release").otherwise("reserve").alias("event"),
        F.col("latency_ms").alias("units"), F.col("created_at").cast("timestamp").alias("created_at"),
    )
    stream, at = _stream(spark, d, log, spark.sparkContext.defaultParallelism)
    return streams.run_available(streams.reservations(stream, 10**12), f"{at}/out", f"{at}/state")
