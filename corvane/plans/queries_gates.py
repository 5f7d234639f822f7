"""Registered queries of the governance gates and the calendar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import chronology, gates, ledger
from corvane.plans.inputs import ctes, derived, table
from corvane.plans.registry import query

# Literals here are the fixed values themselves, not those of the library.
_ALL = f"""{ctes("claims", "candidates", "anchors")},
    facts AS (SELECT * FROM claims c WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM claims s WHERE s.supersedes_id = c.id)),
    locked AS (SELECT detail_key, locked_value, id AS anchor_id FROM (
        SELECT *, row_number() OVER (PARTITION BY detail_key ORDER BY version_id DESC, seq DESC) AS n
        FROM anchors WHERE locked AND version_id IN ('v1', 'v2', 'v3', 'v4')) WHERE n = 1),
    cand AS (SELECT *, subject || '.' || key AS claim_key, lower(trim(value)) AS folded FROM candidates),
    g_anchor AS (SELECT cid, 'gate.anchor-consistency' AS rule_id, 'block' AS severity,
                        'claim ''' || claim_key || '=' || value || ''' contradicts locked anchor value ''' || locked_value || '''' AS message, claim_key,
                        '{{"anchor_id":"' || anchor_id || '","claim_key":"' || claim_key || '","locked_value":"' || locked_value || '","proposed_value":"' || value || '"}}' AS detail
                 FROM cand JOIN locked ON detail_key = claim_key WHERE folded <> lower(trim(locked_value))),
    latest AS (SELECT subject || '.' || key AS claim_key, arg_max(value, seq) AS accepted, arg_max(id, seq) AS by_id, max(seq) AS at_seq FROM facts GROUP BY 1),
    g_ledger AS (SELECT cid, 'gate.ledger-conflict' AS rule_id, 'block' AS severity,
                        'claim ''' || claim_key || '=' || value || ''' conflicts with accepted canon ''' || claim_key || '=' || accepted || ''' (use a correction to supersede)' AS message, claim_key,
                        '{{"canon_claim_id":"' || by_id || '","canon_seq":' || CAST(at_seq AS VARCHAR) || ',"canon_value":"' || accepted || '","claim_key":"' || claim_key || '","proposed_value":"' || value || '"}}' AS detail
                 FROM cand JOIN latest USING (claim_key) WHERE claim_type <> 'correction' AND supersedes_id IS NULL AND folded <> lower(trim(accepted))),
    g_orphan AS (SELECT cid, 'gate.orphaned-reference' AS rule_id, 'warn' AS severity, 'correction targets ''' || claim_key || ''' but no such canon was established' AS message, claim_key,
                        '{{"claim_key":"' || claim_key || '"}}' AS detail
                 FROM cand k WHERE claim_type = 'correction' AND (NOT EXISTS (SELECT 1 FROM facts f WHERE f.subject = k.subject)
                                                                  OR NOT EXISTS (SELECT 1 FROM facts f WHERE f.subject || '.' || f.key = k.claim_key))),
    g_meta AS (SELECT cid, 'gate.meta-leakage' AS rule_id, 'warn' AS severity, 'output contains meta-leakage marker ''' || marker || '''' AS message, CAST(NULL AS VARCHAR) AS claim_key,
                      '{{"marker":"' || marker || '"}}' AS detail
               FROM cand, (SELECT unnest(['as an ai', 'as a language model', 'i cannot assist', 'i''m sorry, but', '[insert', 'lorem ipsum']) AS marker) WHERE contains(lower(text), marker)),
    found AS (SELECT * FROM g_anchor UNION ALL
              SELECT * FROM g_ledger l WHERE NOT EXISTS (SELECT 1 FROM g_anchor a WHERE a.cid = l.cid AND a.claim_key = l.claim_key)
              UNION ALL SELECT * FROM g_orphan UNION ALL SELECT * FROM g_meta)"""


def _inputs(spark, d):
    chain = ledger.lineage(spark, derived(spark, d, "versions"), "v4")
    return (
        derived(spark, d, "candidates"),
        ledger.slice_facts(derived(spark, d, "claims")),
        ledger.anchors_at(derived(spark, d, "anchors"), chain),
    )


def _passages(spark, d):
    """The benchmark's passages as the texts before every candidate."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("previous_index"), F.col("text").alias("previous"))


@query("gate_anchor", f"{_ALL} SELECT * FROM g_anchor")
def gate_anchor(spark, d):
    c, _, a = _inputs(spark, d)
    return gates.anchor_gate(c, a)


@query("gate_ledger", f"{_ALL} SELECT * FROM g_ledger")
def gate_ledger(spark, d):
    c, f, _ = _inputs(spark, d)
    return gates.ledger_gate(c, f)


@query("gate_orphan", f"{_ALL} SELECT * FROM g_orphan")
def gate_orphan(spark, d):
    c, f, _ = _inputs(spark, d)
    return gates.orphan_gate(c, f)


_EXACT = [f"cust-{i}.priority" for i in range(0, 400, 2)]


@query(
    "governance_transition",
    f"""{_ALL}, exact AS (SELECT unnest([{", ".join(f"'{k}'" for k in _EXACT)}]) AS k),
        f AS (SELECT *, subject || '.' || key AS ck, lower(value) AS said FROM facts),
        n AS (SELECT *, row_number() OVER w AS r, lead(said) OVER w AS next_value, lead(id) OVER w AS next_id, first(said) OVER w AS top_value, first(id) OVER w AS top_id FROM f
              WINDOW w AS (PARTITION BY ck ORDER BY seq DESC, id DESC)),
        p AS (SELECT id AS claim_id, ck, said, CASE WHEN r = 1 THEN next_value ELSE top_value END AS other, CASE WHEN r = 1 THEN next_id ELSE top_id END AS other_id, ck IN (SELECT k FROM exact) AS ex FROM n)
        SELECT claim_id, 'gate.anchor-consistency' AS rule_id, ck AS claim_key, anchor_id AS against FROM p JOIN locked ON detail_key = ck WHERE CASE WHEN ex THEN said <> locked_value ELSE said <> lower(locked_value) END
        UNION ALL SELECT claim_id, 'gate.ledger-conflict', ck, other_id FROM p WHERE other IS NOT NULL AND said <> other""",
)
def governance_transition(spark, d):
    """What conflicts when some facts are compared exactly; their values are lower-cased here, those of the anchors aren't."""
    _, f, a = _inputs(spark, d)
    found = gates.assess_transition(f.withColumn("value", F.lower("value")), a, dict.fromkeys(_EXACT, "exact-string-v1"))
    against = F.coalesce(F.get_json_object("detail", "$.anchor_id"), F.get_json_object("detail", "$.canon_claim_id"))
    return found.select("claim_id", "rule_id", "claim_key", against.alias("against"))


@query("gate_meta", f"{_ALL} SELECT * FROM g_meta")
def gate_meta(spark, d):
    return gates.meta_gate(derived(spark, d, "candidates"))


@query("gates_dedup_union", f"{_ALL} SELECT * FROM found")
def gates_dedup_union(spark, d):
    return gates.run_gates(*_inputs(spark, d), previous=_passages(spark, d))


@query("gates_downgraded", f"{_ALL} SELECT rule_id, CASE severity WHEN 'block' THEN 'warn' ELSE severity END AS severity, count(*) AS n FROM found GROUP BY 1, 2")
def gates_downgraded(spark, d):
    return gates.run_gates(*_inputs(spark, d), extended=False, previous=_passages(spark, d)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("gates_previous_text")
def gates_previous_text(spark, d):
    """All gates where the text before a candidate is that of its subject's last one. No SQL says the ratio."""
    c, f, a = _inputs(spark, d)
    by = Window.partitionBy("subject").orderBy(F.substring("cid", 2, 20).cast("long"))
    before = c.select("cid", F.lit(0).alias("previous_index"), F.lag("text").over(by).alias("previous")).where("previous IS NOT NULL")
    return gates.run_gates(c, f, a, previous=before)


@query(
    "blocked_status",
    f"""{_ALL} SELECT cid, CASE WHEN cid IN (SELECT cid FROM found WHERE severity = 'block') THEN 'disputed' ELSE 'accepted' END AS status FROM cand""",
)
def blocked_status(spark, d):
    c, f, a = _inputs(spark, d)
    return gates.disputed(c, gates.run_gates(c, f, a, previous=_passages(spark, d))).select("cid", "status")


@query(
    "gate_counter",
    f"""{ctes("candidates")} SELECT cid, pattern, found, budget FROM (
        SELECT cid, pattern, budget, CAST((length(lower(text)) - length(replace(lower(text), pattern, ''))) / length(pattern) AS INT) AS found
        FROM candidates, (VALUES ('o', 1), ('er', 1), ('model', 0)) p(pattern, budget)) WHERE found > budget""",
)
def gate_counter(spark, d):
    return gates.counter_gate(derived(spark, d, "candidates"), [("o", 1), ("er", 1), ("model", 0)])


@query("gate_similarity")
def gate_similarity(spark, d):
    """Turns that nearly repeat an earlier one of their conversation. No SQL says this ratio."""
    turns = table(spark, d, "conversations")
    a = turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("cid"), "conv_id", "turn", "text")
    b = turns.select("conv_id", F.col("turn").alias("other"), F.col("text").alias("previous"))
    pairs = a.join(b, "conv_id").where("other < turn")
    return gates.similarity_gate(pairs, 0.3).select("cid", F.md5("previous").alias("previous_md5"), "ratio")


@query(
    "findings_prefix",
    f"{ctes('findings')} SELECT * FROM findings WHERE starts_with(rule_id, 'rule_R.x_') AND severity = 'warn' AND seq <= (SELECT max(seq) // 2 FROM findings)",
)
def findings_prefix(spark, d):
    """At half of the head, so that it grows with the table."""
    findings = derived(spark, d, "findings")
    half = (findings.agg(F.max("seq")).first()[0] or 0) // 2
    return gates.findings_view(findings, rule_prefix="rule_R.x_", severity="warn", as_of_seq=half)


@query("findings_recent", f"{ctes('findings')} SELECT * FROM findings WHERE severity = 'warn' ORDER BY seq DESC, rule_id DESC, message DESC, scope_path DESC, claim_no DESC LIMIT 1000")
def findings_recent(spark, d):
    found = gates.findings_view(derived(spark, d, "findings"), severity="warn")
    return gates.recent(found, 1000, "seq", "rule_id", "message", "scope_path", "claim_no")


_DETAILED = """SELECT *, CASE WHEN claim_no % 3 = 0 THEN CONCAT('evidence/', scope_path) END AS evidence_ref,
    CASE WHEN claim_no % 4 = 0 THEN CONCAT('c', CAST(claim_no % 50 AS STRING)) END AS claim_id FROM {findings}"""


@query(
    "findings_dedup",
    f"""{ctes("findings")}, x AS ({_DETAILED.format(findings="findings").replace("STRING", "VARCHAR")}),
        i AS (SELECT *, CASE WHEN evidence_ref IS NULL AND claim_id IS NULL THEN coalesce(scope_path, '') ELSE coalesce(evidence_ref, '') END AS a,
                     CASE WHEN evidence_ref IS NULL AND claim_id IS NULL THEN message ELSE coalesce(claim_id, '') END AS b FROM x),
        n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, a, b ORDER BY seq, message, scope_path) AS k FROM i WHERE severity = 'warn')
        SELECT rule_id, scope_path, message, seq FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM i o WHERE o.severity = 'info' AND o.rule_id = n.rule_id AND o.a = n.a AND o.b = n.b)""",
)
def findings_dedup(spark, d):
    """Warnings that no note has said before."""
    f = spark.sql(_DETAILED, findings=derived(spark, d, "findings"))
    new = gates.dedup_findings(f.where("severity = 'warn'"), f.where("severity = 'info'"), "seq", "message", "scope_path")
    return new.select("rule_id", "scope_path", "message", "seq")


@query(
    "shape_validation",
    f"""{ctes("candidates")}, v AS (
        SELECT cid, 'value' AS field, 'pattern' AS rule FROM candidates WHERE NOT regexp_matches(value, '^ [1-3]-')
        UNION ALL SELECT cid, 'subject', 'maxLength' FROM candidates WHERE length(subject) > 9
        UNION ALL SELECT cid, 'claim_type', 'enum' FROM candidates WHERE claim_type NOT IN ('fact')
        UNION ALL SELECT cid, 'supersedes_id', 'required' FROM candidates WHERE supersedes_id IS NULL)
        SELECT cid, 'shape.schema-violation' AS rule_id, 'block' AS severity, field, rule FROM v""",
)
def shape_validation(spark, d):
    shape = {
        "required": ["supersedes_id"],
        "properties": {"value": {"pattern": "^ [1-3]-"}, "subject": {"maxLength": 9}, "claim_type": {"enum": ["fact"]}},
    }
    return gates.shape_validation(derived(spark, d, "candidates"), shape)


# Dates are written in fifteen ways; the SQL knows each row's day and way, and so never reads the text.
_TIME = f"""{ctes("when_facts")},
    latest AS (SELECT subject, key, arg_max(struct_pack(v := value, w := way, d := day, i := claim_id, c := candidate), CASE WHEN candidate THEN 1000000000 ELSE 0 END + seq) AS x
               FROM when_facts GROUP BY subject, key),
    ev AS (SELECT subject, key, subject || '.' || key AS ck, x.v AS value, CASE WHEN x.c THEN NULL ELSE x.i END AS claim_id, x.c AS candidate, x.w IN (4, 5, 6, 11, 12) AS uncertain,
                  CASE WHEN x.w IN (0, 7, 8) THEN 'day' WHEN x.w IN (2, 4, 5, 9) THEN 'year' ELSE 'month' END AS precision,
                  CASE WHEN x.w IN (0, 7, 8) THEN x.d WHEN x.w IN (2, 4, 5, 9) THEN CAST(date_trunc('year', x.d) AS DATE)
                       WHEN x.w = 11 THEN CAST(strftime(x.d, '%Y-03-01') AS DATE) WHEN x.w = 12 THEN CAST(strftime(x.d, '%Y-12-01') AS DATE)
                       WHEN x.w = 10 THEN CAST(strftime(x.d, '%Y-01-01') AS DATE) ELSE CAST(date_trunc('month', x.d) AS DATE) END AS s,
                  CASE WHEN x.w IN (0, 7, 8) THEN x.d WHEN x.w IN (2, 4, 5) THEN CAST(strftime(x.d, '%Y-12-31') AS DATE)
                       WHEN x.w = 9 THEN CAST(strftime(x.d + INTERVAL 3 YEAR, '%Y-12-31') AS DATE) WHEN x.w = 11 THEN CAST(strftime(x.d, '%Y-05-31') AS DATE)
                       WHEN x.w = 12 THEN last_day(CAST(strftime(x.d + INTERVAL 1 YEAR, '%Y-02-01') AS DATE)) WHEN x.w = 10 THEN last_day(CAST(strftime(x.d, '%Y-04-01') AS DATE))
                       ELSE last_day(x.d) END AS e
           FROM latest WHERE x.w < 13)"""


def _pair_sql(a: str, b: str) -> str:
    return f"""FROM ev a JOIN ev b USING (subject) WHERE a.key LIKE '{a}' AND b.key LIKE '{b}' AND (a.candidate OR b.candidate)
        AND a.key <> b.key AND NOT a.uncertain AND NOT b.uncertain"""


def _chain(side: str, role: str) -> str:
    value = lambda x: f"CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END"
    return f"""'{{"claim":"' || {side}.ck || '","claim_id":' || {value(side + ".claim_id")} || ',"origin":"' || CASE WHEN {side}.candidate THEN 'candidate' ELSE 'ledger' END
        || '","role":"{role}","value":"' || {side}.value || '","when":{{"end":"' || CAST({side}.e AS VARCHAR) || '","precision":"' || {side}.precision
        || '","start":"' || CAST({side}.s AS VARCHAR) || '","uncertain":' || CAST({side}.uncertain AS VARCHAR) || '}}}}'"""


def _found_sql(rule_id: str, kind: str, rule: str, severity: str, message: str, roles: tuple[tuple[str, str], ...], extras: str = "", after: str = "") -> str:
    """One finding as SQL columns; ``rule`` is its JSON, ``extras`` and ``after`` what stands before and after the kind."""
    claim = "NULL"
    for side, _ in roles:
        claim = f"CASE WHEN {side}.candidate THEN {side}.ck ELSE {claim} END"
    chain = " || ',' || ".join(_chain(*r) for r in roles)
    return f"""'{rule_id}' AS rule_id, '{severity}' AS severity, {message} AS message, CAST({claim} AS VARCHAR) AS claim_key,
        '{{"chain":[' || {chain} || ']' || CASE WHEN {claim} IS NULL THEN '' ELSE ',"claim_key":"' || {claim} || '"' END || {extras or "''"} ||
        ',"kind":"{kind}"' || {after or "''"} || ',"rule":{rule}}}' AS detail"""


_ORDER = chronology.Rule("order", "start_date", "end_date", "block")
_CONTAINS = chronology.Rule("contains", "start_date", "filed_on")
_OVERLAP = chronology.Rule("overlap", "*", "*")
_DEADLINE = chronology.Rule("deadline", "start_date", "review_due", days=90)
_DURATION = chronology.Rule("duration", "start_date", "end_date", least=30, most=400)
_ABSOLUTE = chronology.Rule("order", "Cust-7.start_date", "*_on")
_SAID_A, _SAID_B = "a.ck || '=' || a.value", "b.ck || '=' || b.value"

_ORDER_SQL = f"""SELECT {_found_sql("gate.chronology-order", "order", '{"order":{"after":"end_date","before":"start_date"}}', "block",
    f"'chronology: ''' || {_SAID_B} || ''' must come after ''' || {_SAID_A} || ''' but is definitely before it'", (("a", "before"), ("b", "after")))}
    {_pair_sql('start_date', 'end_date')} AND b.e < a.s"""
_CONTAINS_SQL = f"""SELECT {_found_sql("gate.chronology-order", "contains", '{"contains":{"inner":"filed_on","outer":"start_date"}}', "warn",
    f"'chronology: ''' || {_SAID_B} || ''' must fall within ''' || {_SAID_A} || ''' but is definitely outside it'", (("a", "outer"), ("b", "inner")))}
    {_pair_sql('start_date', 'filed_on')} AND NOT (a.s <= b.e AND b.s <= a.e)"""
_OVERLAP_SQL = f"""SELECT {_found_sql("gate.chronology-order", "overlap", '{"forbid_overlap":{"a":"*","b":"*"}}', "warn",
    f"'chronology: ''' || {_SAID_A} || ''' and ''' || {_SAID_B} || ''' must not overlap but definitely do'", (("a", "a"), ("b", "b")))}
    {_pair_sql('%', '%')} AND a.precision = 'day' AND b.precision = 'day' AND a.s <= b.e AND b.s <= a.e AND a.key < b.key"""
_DEADLINE_RULE = '{"deadline":{"due_from":"start_date","key":"review_due","within_days":90}}'
_DUE = """',"deadline":"' || CAST(CAST(a.e + 90 AS DATE) AS VARCHAR) || '"'"""
_DEADLINE_SQL = f"""SELECT {_found_sql("gate.chronology-deadline", "deadline", _DEADLINE_RULE, "warn",
    f"'chronology: ''' || {_SAID_B} || ''' is definitely later than the deadline ' || CAST(CAST(a.e + 90 AS DATE) AS VARCHAR) || ' (90 days after ''' || {_SAID_A} || ''')'",
    (("a", "due_from"), ("b", "event")), extras=_DUE)}
    {_pair_sql('start_date', 'review_due')} AND b.s > a.e + 90
    UNION ALL SELECT {_found_sql("gate.chronology-deadline", "deadline", _DEADLINE_RULE, "warn",
    f"'chronology: no ''review_due'' event within 90 days of ''' || {_SAID_A} || ''' — deadline ' || CAST(CAST(a.e + 90 AS DATE) AS VARCHAR) || ' passed as of 2000-01-01'",
    (("a", "due_from"),), extras=_DUE, after="',\"now\":\"2000-01-01\"'")}
    FROM ev a WHERE key = 'start_date' AND NOT uncertain AND e + 90 < DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM ev y WHERE y.subject = a.subject AND y.key = 'review_due')"""
_GAPS = "date_diff('day', a.e, b.s) AS lo, date_diff('day', a.s, b.e) AS hi"
_DURATION_SQL = f"""SELECT {_found_sql("gate.chronology-duration", "duration", '{"duration":{"from":"start_date","max_days":400,"min_days":30,"to":"end_date"}}', "warn",
    f"'chronology: elapsed days from ''' || {_SAID_A} || ''' to ''' || {_SAID_B} || ''' (between ' || CAST(date_diff('day', a.e, b.s) AS VARCHAR) || ' and ' || CAST(date_diff('day', a.s, b.e) AS VARCHAR) || ') '"
    " || CASE WHEN date_diff('day', a.e, b.s) > 400 THEN 'definitely exceeds max_days=400' ELSE 'definitely under min_days=30' END",
    (("a", "from"), ("b", "to")), extras="',\"gap_days_max\":' || CAST(date_diff('day', a.s, b.e) AS VARCHAR) || ',\"gap_days_min\":' || CAST(date_diff('day', a.e, b.s) AS VARCHAR)")}
    {_pair_sql('start_date', 'end_date')} AND (date_diff('day', a.s, b.e) < 30 OR date_diff('day', a.e, b.s) > 400)"""
_ABSOLUTE_SQL = f"""SELECT {_found_sql("gate.chronology-order", "order", '{"order":{"after":"*_on","before":"Cust-7.start_date"}}', "warn",
    f"'chronology: ''' || {_SAID_B} || ''' must come after ''' || {_SAID_A} || ''' but is definitely before it'", (("a", "before"), ("b", "after")))}
    FROM ev a JOIN ev b ON b.key = 'filed_on' WHERE a.ck = 'cust-7.start_date' AND (a.candidate OR b.candidate) AND NOT a.uncertain AND NOT b.uncertain AND b.e < a.s"""


def _timeline(spark, d):
    return chronology.timeline(derived(spark, d, "when_facts"))


@query(
    "chrono_timeline",
    f"{_TIME} SELECT subject, key, value, claim_id, candidate, uncertain, precision, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS until FROM ev",
)
def chrono_timeline(spark, d):
    when = [F.col("when.uncertain"), F.col("when.precision"), F.col("when.start").cast("string").alias("start"), F.col("when.end").cast("string").alias("until")]
    return _timeline(spark, d).select("subject", "key", "value", "claim_id", "candidate", *when)


@query("chrono_order", f"{_TIME} {_ORDER_SQL}")
def chrono_order(spark, d):
    return chronology.order_rule(_timeline(spark, d), _ORDER)


@query("chrono_contains", f"{_TIME} {_CONTAINS_SQL}")
def chrono_contains(spark, d):
    return chronology.contains_rule(_timeline(spark, d), _CONTAINS)


@query("chrono_overlap", f"{_TIME} {_OVERLAP_SQL}")
def chrono_overlap(spark, d):
    return chronology.forbid_overlap(_timeline(spark, d), _OVERLAP)


@query("chrono_deadline", f"{_TIME} {_DEADLINE_SQL}")
def chrono_deadline(spark, d):
    return chronology.deadline_rule(_timeline(spark, d), _DEADLINE, "2000-01-01")


@query("chrono_duration", f"{_TIME} {_DURATION_SQL}")
def chrono_duration(spark, d):
    return chronology.duration_rule(_timeline(spark, d), _DURATION)


@query("chrono_absolute", f"{_TIME} {_ABSOLUTE_SQL}")
def chrono_absolute(spark, d):
    """A target that names one fact meets those of every subject."""
    return chronology.order_rule(_timeline(spark, d), _ABSOLUTE)


@query("check_chronology", f"{_TIME} {' UNION ALL '.join((_ORDER_SQL, _CONTAINS_SQL, _OVERLAP_SQL, _DEADLINE_SQL, _DURATION_SQL, _ABSOLUTE_SQL))}")
def check_chronology(spark, d):
    """All rules at once."""
    rules = (_ORDER, _CONTAINS, _OVERLAP, _DEADLINE, _DURATION, _ABSOLUTE)
    return chronology.check_chronology(derived(spark, d, "when_facts"), rules, "2000-01-01")


@query(
    "temporal_keys",
    f"""{ctes("when_facts")} SELECT key, (key LIKE '%\\_date' ESCAPE '\\' OR key LIKE '%\\_on' ESCAPE '\\' OR key LIKE 'date\\_%' ESCAPE '\\'
        OR key LIKE '%\\_deadline' ESCAPE '\\' OR key LIKE '%\\_due' ESCAPE '\\' OR key LIKE '%\\_when' ESCAPE '\\') AS temporal, count(*) AS n
        FROM when_facts GROUP BY key""",
)
def temporal_keys(spark, d):
    return derived(spark, d, "when_facts").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("temporal", chronology.temporal(F.col("key")))
