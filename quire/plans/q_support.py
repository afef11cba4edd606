"""Registered support analytics queries (S11, A1-A10) over tickets at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import support as U
from quire.plans import oracle as O
from quire.plans.registry import register
from quire.plans.fixtures import tickets
from quire.sources.tables import read_table

_T = f"WITH t AS ({O.tickets()})"
_URG = """CASE WHEN status = 'Closed' THEN 'Low'
     WHEN category IN ('Login Issue', 'Account Access') OR priority = 'High' THEN 'High'
     WHEN category IN ('Billing', 'Subscription') THEN 'Medium' ELSE 'Low' END"""
_RANK = "CASE urgency WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
_COLS = "id, customer_name, email, category, priority, status"


@register(
    "tickets_by_status",
    f"{_T} SELECT {_COLS} FROM t WHERE status ILIKE 'open' ORDER BY id LIMIT 50",
)
def tickets_by_status(spark, sf_dir):
    return U.tickets_by_status(tickets(spark, sf_dir), "open")


@register(
    "ticket_counts",
    f"""{_T} SELECT status, priority, category, count(*) AS n, grouping(status, priority, category) AS level
FROM t GROUP BY GROUPING SETS ((status), (priority), (category), ())""",
)
def ticket_counts(spark, sf_dir):
    return U.ticket_counts(tickets(spark, sf_dir))


# Each ticket comes with a message that its event's properties and number spell out.
_DESC = """t.id || ' ' || e.props || CASE t.id % 6 WHEN 0 THEN ' we had DATA LOSS' WHEN 1 THEN ' my account is Suspended'
     WHEN 2 THEN ' we lost all data' WHEN 3 THEN ' the service is slow' ELSE '' END"""


@register(
    "derive_urgency",
    f"""{_T}, d AS (SELECT t.*, lower({_DESC}) AS m FROM t JOIN events e ON e.event_id = t.id),
u AS (SELECT id, category, priority, status, CASE
     WHEN regexp_matches(m, 'data loss|lost data|lost all data|breach|hacked|outage|down for everyone|service down') THEN 'Critical'
     WHEN status = 'Closed' THEN 'Low'
     WHEN category IN ('Login Issue', 'Account Access') OR priority = 'High' OR contains(m, 'suspend') THEN 'High'
     WHEN category IN ('Billing', 'Subscription') THEN 'Medium' ELSE 'Low' END AS urgency FROM d)
SELECT id, category, priority, status, urgency, {_RANK} AS urgency_rank FROM u""",
)
def derive_urgency(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, (" we had DATA LOSS", " my account is Suspended", " we lost all data", " the service is slow", "", ""))), (F.col("id") % 6 + 1).cast("int"))
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props")
    t = tickets(spark, sf_dir).join(events, "id").withColumn("description", F.concat(F.col("id").cast("string"), F.lit(" "), F.col("props"), said))
    return U.derive_urgency(t, "description").select("id", "category", "priority", "status", "urgency", "urgency_rank")


@register(
    "triage_order",
    f"""{_T}, u AS (SELECT id, status, {_URG} AS urgency FROM t)
SELECT id, status, urgency, {_RANK} AS urgency_rank FROM u ORDER BY urgency_rank, id""",
)
def triage_order(spark, sf_dir):
    return U.triage_order(tickets(spark, sf_dir)).select("id", "status", "urgency", "urgency_rank")


_REQ_SQL = """SELECT conv_id || ':' || turn AS request_id,
  CASE (conv_id + turn) % 4
    WHEN 0 THEN 'USER' || (conv_id % 200) || '@EXAMPLE.COM'
    WHEN 1 THEN 'customer ' || (conv_id % 200)
    WHEN 2 THEN 'Customer ' || (conv_id % 200) || ' Jr'
    ELSE 'alice' || conv_id || '@example.com' END AS term
FROM conversations"""


def lookup_requests(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") % 200).cast("string")
    v = (F.col("conv_id") + F.col("turn")) % 4
    term = (
        F.when(v == 0, F.concat(F.lit("USER"), k, F.lit("@EXAMPLE.COM")))
        .when(v == 1, F.concat(F.lit("customer "), k))
        .when(v == 2, F.concat(F.lit("Customer "), k, F.lit(" Jr")))
        .otherwise(F.concat(F.lit("alice"), F.col("conv_id").cast("string"), F.lit("@example.com")))
    )
    return conv.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), term.alias("term"))


_LOOKUP_SQL = f"""{_T},
u AS (SELECT *, {_URG} AS urgency FROM t),
r AS (SELECT *, {_RANK} AS rnk FROM u),
prof AS (SELECT lower(email) AS email_lc, lower(customer_name) AS name_lc, count(*) AS n_records, min(rnk) AS best_rank,
                first(category ORDER BY rnk, id) AS classification, first(email ORDER BY rnk, id) AS email,
                first(id ORDER BY rnk, id) AS top_id
         FROM r GROUP BY 1, 2),
req AS ({_REQ_SQL}),
ex AS (SELECT req.request_id, req.term, p.* FROM req JOIN prof p
       ON lower({O.strip('req.term')}) = p.email_lc OR lower({O.strip('req.term')}) = p.name_lc),
exa AS (SELECT request_id, term, 'exact' AS match_kind, count(DISTINCT email) AS n_customers, CAST(sum(n_records) AS BIGINT) AS n_records,
               first(classification ORDER BY best_rank, top_id) AS classification, min(best_rank) AS best_rank,
               CASE WHEN count(DISTINCT email) = 1 THEN min(email) END AS email
        FROM ex GROUP BY request_id, term),
missed AS (SELECT * FROM req WHERE request_id NOT IN (SELECT request_id FROM exa)),
firsts AS (SELECT split_part(name_lc, ' ', 1) AS first_lc, count(DISTINCT email) AS n_customers, CAST(sum(n_records) AS BIGINT) AS n_records,
                  first(classification ORDER BY best_rank, top_id) AS classification, min(best_rank) AS best_rank
           FROM prof GROUP BY 1),
br AS (SELECT m.request_id, m.term, CASE WHEN f.first_lc IS NOT NULL THEN 'first_name' ELSE 'none' END AS match_kind,
              coalesce(f.n_customers, 0) AS n_customers, coalesce(f.n_records, 0) AS n_records, f.classification, f.best_rank,
              NULL::VARCHAR AS email
       FROM missed m LEFT JOIN firsts f ON split_part(lower({O.strip('m.term')}), ' ', 1) = f.first_lc),
res AS (SELECT *, n_records > 0 AS found,
               CASE best_rank WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' END AS urgency
        FROM (SELECT * FROM exa UNION ALL SELECT * FROM br))"""


@register(
    "ticket_lookup",
    f"{_LOOKUP_SQL}\nSELECT request_id, term, match_kind, n_customers, n_records, classification, found, urgency FROM res",
)
def ticket_lookup(spark, sf_dir):
    return U.ticket_lookup(lookup_requests(spark, sf_dir), tickets(spark, sf_dir)).select(
        "request_id", "term", "match_kind", "n_customers", "n_records", "classification", "found", "urgency"
    )


@register(
    "lookup_verdict",
    f"""{_LOOKUP_SQL}
SELECT request_id, found, n_records, classification, urgency,
  CASE WHEN NOT found THEN 'no matching record; ask for an order number or ticket id'
       WHEN n_customers > 1 THEN 'several customers match; ask for an e-mail address or ticket id' END AS missing_information,
  CASE WHEN NOT found THEN 'tell the customer no record was found and ask for an identifier'
       WHEN n_customers > 1 THEN 'ask which customer is meant before acting'
       WHEN urgency IN ('Critical', 'High') THEN 'prioritise: contact the customer today'
       ELSE 'reply with the current status and next step' END AS recommended_action
FROM res""",
)
def lookup_verdict(spark, sf_dir):
    lk = U.ticket_lookup(lookup_requests(spark, sf_dir), tickets(spark, sf_dir))
    return U.lookup_verdict(lk).select(
        "request_id", "found", "n_records", "classification", "urgency", "missing_information", "recommended_action"
    )


_GUARD_Q_SQL = """SELECT conv_id, turn, CASE (conv_id + turn) % 6
    WHEN 0 THEN 'SELECT id FROM support_requests WHERE note = ' || '''' || replace(text, '''', '''''') || ''''
    WHEN 1 THEN '  with x AS (SELECT 1) SELECT * FROM x WHERE y = ' || '''' || replace(text, '''', '''''') || ''';'
    WHEN 2 THEN 'SELECT 1; SELECT ' || '''' || replace(text, '''', '''''') || ''''
    WHEN 3 THEN 'DELETE FROM support_requests WHERE note = ' || '''' || replace(text, '''', '''''') || ''''
    WHEN 4 THEN text ELSE 'with ' || text END AS query
FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, CASE conv_id % 2 WHEN 0 THEN '   ' ELSE ' ;; ' END FROM conversations"""


def guard_queries(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    quoted = F.concat(F.lit("'"), F.replace(F.col("text"), F.lit("'"), F.lit("''")), F.lit("'"))
    v = (F.col("conv_id") + F.col("turn")) % 6
    q = (
        F.when(v == 0, F.concat(F.lit("SELECT id FROM support_requests WHERE note = "), quoted))
        .when(v == 1, F.concat(F.lit("  with x AS (SELECT 1) SELECT * FROM x WHERE y = "), quoted, F.lit(";")))
        .when(v == 2, F.concat(F.lit("SELECT 1; SELECT "), quoted))
        .when(v == 3, F.concat(F.lit("DELETE FROM support_requests WHERE note = "), quoted))
        .when(v == 4, F.col("text"))
        .otherwise(F.concat(F.lit("with "), F.col("text")))
    )
    blank = F.when(F.col("conv_id") % 2 == 0, "   ").otherwise(" ;; ")
    blanks = conv.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), blank.alias("query"))
    return conv.select("conv_id", "turn", q.alias("query")).unionByName(blanks)


def _guard_sql_expr(x: str) -> str:
    q3 = O.strip(f"regexp_replace({O.strip(x)}, ';+\\z', '')")
    forb = O.q(U.FORBIDDEN_RE2)
    return f"""CASE WHEN {q3} = '' THEN {O.q(U.MSG_EMPTY)}
     WHEN NOT regexp_matches({q3}, {O.q(U.SELECT_ONLY_RE2)}) THEN {O.q(U.MSG_NOT_SELECT)}
     WHEN contains({q3}, ';') THEN {O.q(U.MSG_MULTI)}
     WHEN regexp_matches({q3}, {forb}) THEN 'The keyword ''' || upper(regexp_extract({q3}, {forb}, 2)) || ''' is not permitted. This tool is read-only.'
END"""


@register(
    "guard_select",
    f"""WITH g AS ({_GUARD_Q_SQL}), e AS (SELECT conv_id, turn, {_guard_sql_expr('query')} AS error FROM g)
SELECT conv_id, turn, error IS NULL AS ok, error FROM e""",
)
def guard_select(spark, sf_dir):
    g = guard_queries(spark, sf_dir).withColumn("error", U.guard_column("query"))
    return g.select("conv_id", "turn", F.col("error").isNull().alias("ok"), "error")


_OPEN_Q = (
    "SELECT id, customer_name, email, category, priority, status, created_at FROM support_requests "
    "WHERE status ILIKE 'open' ORDER BY id LIMIT 50;"
)


def _ts_text(c: str) -> str:
    return f"CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%d %H:%M:%S') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END"


@register(
    "run_select",
    f"""{_T}, r AS (SELECT id, customer_name, email, category, priority, status, created_at FROM t
                   WHERE status ILIKE 'open' ORDER BY id LIMIT 50)
SELECT NULL::VARCHAR AS error, CAST(count(*) AS INTEGER) AS row_count,
  '["id","customer_name","email","category","priority","status","created_at"]' AS columns,
  '[' || coalesce(string_agg(to_json({{'id': id, 'customer_name': customer_name, 'email': email, 'category': category,
        'priority': priority, 'status': status, 'created_at': {_ts_text('created_at')}}}), ',' ORDER BY id), '') || ']' AS rows,
  (SELECT count(*) FROM t WHERE status ILIKE 'open') < 0 AS truncated
FROM r""",
)
def run_select(spark, sf_dir):
    """Guarded statement over the ``support_requests`` view -> JSON envelope."""
    tickets(spark, sf_dir).createOrReplaceTempView("support_requests")
    return U.run_select(spark, _OPEN_Q)


# One statement for each kind of outcome, about the ticket counts of each category.
TOOL_CASES = {
    "success": "SELECT category, count(*) AS n FROM support_requests GROUP BY category ORDER BY category",
    "capped": "SELECT id FROM support_requests ORDER BY id",
    "with": "WITH x AS (SELECT status, count(*) AS n FROM support_requests GROUP BY status) SELECT * FROM x ORDER BY status",
    "path": "SELECT * FROM text.`/etc/hostname`",
    "quoted": "SELECT `reflect`('java.lang.System', 'currentTimeMillis') AS t FROM support_requests",
    "commented": "SELECT java_method/**/('java.lang.Math', 'abs', -1) AS t",
    "nested": "SELECT id FROM support_requests WHERE id IN (SELECT count(*) FROM parquet.`/etc`)",
    "zero": "SELECT id / (id - id) AS x FROM support_requests",
    "cast": "SELECT CAST(email AS INT) AS x FROM support_requests",
    "delete": "DELETE FROM support_requests",
    "two": "SELECT 1; SELECT 2",
}


@register(
    "run_select_cases",
    f"""{_T}, c AS (SELECT category, count(*) AS n FROM t GROUP BY 1), st AS (SELECT status, count(*) AS n FROM t GROUP BY 1)
SELECT 'success' AS name, 'rows' AS outcome, count(*)::INTEGER AS row_count,
       '[' || string_agg(to_json({{'category': category, 'n': n}}), ',' ORDER BY category) || ']' AS rows, FALSE AS truncated FROM c
UNION ALL SELECT 'with', 'rows', count(*)::INTEGER, '[' || string_agg(to_json({{'status': status, 'n': n}}), ',' ORDER BY status) || ']', FALSE FROM st
UNION ALL SELECT 'capped', 'rows', 50, '[' || string_agg(to_json({{'id': id}}), ',' ORDER BY id) || ']', TRUE FROM (SELECT id FROM t ORDER BY id LIMIT 50)
UNION ALL SELECT unnest(['path', 'quoted', 'commented', 'nested', 'delete', 'two']), 'refused', 0, '[]', FALSE
UNION ALL SELECT unnest(['zero', 'cast']), 'failed', 0, '[]', FALSE""",
)
def run_select_cases(spark, sf_dir):
    """The SQL tool's contract: rows, refusals and failures, all as data."""
    tickets(spark, sf_dir).createOrReplaceTempView("support_requests")
    out = None
    for name, statement in TOOL_CASES.items():
        e = U.run_select(spark, statement, views=["support_requests"])
        outcome = F.when(F.col("error").isNull(), "rows").when(F.col("error").startswith("SQL execution failed:"), "failed").otherwise("refused")
        one = e.select(F.lit(name).alias("name"), outcome.alias("outcome"), "row_count", "rows", "truncated")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "rows_to_json",
    f"""{_T}, r AS (SELECT id, email, status, created_at FROM t ORDER BY created_at DESC, id LIMIT 50)
SELECT NULL::VARCHAR AS error, CAST(count(*) AS INTEGER) AS row_count, '["id","email","status","created_at"]' AS columns,
  '[' || coalesce(string_agg(to_json({{'id': id, 'email': email, 'status': status, 'created_at': {_ts_text('created_at')}}}), ','
        ORDER BY created_at DESC, id), '') || ']' AS rows, (SELECT count(*) FROM t) > 50 AS truncated
FROM r""",
)
def rows_to_json(spark, sf_dir):
    t = tickets(spark, sf_dir).orderBy(F.desc("created_at"), "id")
    return U.rows_to_json(t.select("id", "email", "status", "created_at"), 50)


@register(
    "redact_error",
    f"""WITH m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'could not connect to server at ' || url || html
                                   WHEN 1 THEN replace(html, '://', ' ') ELSE html END AS message FROM pages),
s AS (SELECT page_id, {O.strip("coalesce(message, '')")} AS m FROM m),
c AS (SELECT page_id, CASE WHEN m = '' THEN 'OperationalError' ELSE m END AS m FROM s)
SELECT page_id, CASE WHEN contains(m, '://') THEN 'OperationalError (details withheld: may contain credentials)'
                     ELSE left(m, 300) END AS redacted FROM c""",
)
def redact_error(spark, sf_dir):
    """Every page's whole html in one of three forms (``redact_error_pages`` has all of them)."""
    pages = read_table(spark, sf_dir, "pages")
    v = F.col("page_id") % 3
    plain = F.replace(F.col("html"), F.lit("://"), F.lit(" "))
    msg = F.when(v == 0, F.concat(F.lit("could not connect to server at "), F.col("url"), F.col("html"))).when(v == 1, plain).otherwise(F.col("html"))
    return pages.select("page_id", U.redact_column(msg, F.lit("OperationalError")).alias("redacted"))


@register(
    "redact_error_pages",
    f"""WITH m AS (SELECT page_id, 'address' AS form, 'could not connect to server at ' || url || html AS message FROM pages
UNION ALL SELECT page_id, 'whole', html FROM pages
UNION ALL SELECT page_id, 'plain', replace(html, '://', ' ') FROM pages
UNION ALL SELECT page_id, 'blank', '   ' FROM pages),
s AS (SELECT page_id, form, {O.strip("coalesce(message, '')")} AS m FROM m)
SELECT page_id, form, CASE WHEN contains(m, '://') THEN 'OperationalError (details withheld: may contain credentials)'
                           WHEN m = '' THEN 'OperationalError' ELSE left(m, 300) END AS redacted FROM s""",
)
def redact_error_pages(spark, sf_dir):
    """Every page's whole html in each form, and a blank message beside them."""
    pages = read_table(spark, sf_dir, "pages")
    forms = {
        "address": F.concat(F.lit("could not connect to server at "), F.col("url"), F.col("html")),
        "whole": F.col("html"),
        "plain": F.replace(F.col("html"), F.lit("://"), F.lit(" ")),
        "blank": F.lit("   "),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), m.alias("message")) for name, m in forms.items()]))
    cases = pages.select("page_id", rows.alias("c")).select("page_id", "c.form", "c.message")
    return cases.select("page_id", "form", U.redact_column("message", F.lit("OperationalError")).alias("redacted"))


_REC_COLS = ["customer_name", "email", "category", "priority", "status"]


_RECONCILE_SQL = f"""WITH t0 AS ({O.tickets()}),
t AS (SELECT id, {', '.join(f"CASE WHEN id % 26 <> 0 THEN {c} END AS {c}" for c in _REC_COLS)} FROM t0),
a AS (SELECT id, customer_name, CASE WHEN id % 7 = 0 THEN NULL ELSE email END AS email,
             CASE WHEN id % 11 = 0 THEN 'Technical Support' ELSE category END AS category, priority, status
      FROM t WHERE id % 13 <> 0),
j AS (SELECT coalesce(t.id, a.id) AS id,
             CASE WHEN a.id IS NULL THEN 'missing_row' WHEN t.id IS NULL THEN 'extra_row' ELSE 'differs' END AS kind,
             {', '.join(f't.{c} AS e_{c}, a.{c} AS a_{c}' for c in _REC_COLS)}
      FROM t FULL OUTER JOIN a ON t.id = a.id)
{' UNION ALL '.join(f"SELECT id, kind, '{c}' AS column, e_{c} AS expected, a_{c} AS actual FROM j WHERE e_{c} IS DISTINCT FROM a_{c}" for c in _REC_COLS)}
UNION ALL SELECT id, kind, NULL, NULL, NULL FROM j
WHERE kind <> 'differs' AND coalesce({', '.join(f'e_{c}, a_{c}' for c in _REC_COLS)}) IS NULL"""


def _reconciled(spark, sf_dir):
    """Expected rows whose number 26 divides hold nulls only, and are missing below."""
    t = tickets(spark, sf_dir)
    t = t.select("id", *[F.when(F.col("id") % 26 != 0, F.col(c)).alias(c) for c in _REC_COLS])
    actual = t.where(F.col("id") % 13 != 0).select(
        "id", "customer_name",
        F.when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("email")).alias("email"),
        F.when(F.col("id") % 11 == 0, F.lit("Technical Support")).otherwise(F.col("category")).alias("category"),
        "priority", "status",
    )
    return t, actual


@register("reconcile", _RECONCILE_SQL)
def reconcile(spark, sf_dir):
    return U.reconcile(*_reconciled(spark, sf_dir), "id", _REC_COLS)


@register("reconcile_by_digests", _RECONCILE_SQL)
def reconcile_by_digests(spark, sf_dir):
    return U.reconcile_by_digests(*_reconciled(spark, sf_dir), "id", _REC_COLS)


_ELIDED_Q = "SELECT id, customer_name, status, created_at FROM support_requests WHERE status ILIKE 'open'"
_EXPECTED = ["id", "customer_name", "email", "category", "priority", "status", "created_at"]


@register(
    "required_columns",
    f"""{_T}, r AS (SELECT id, customer_name, status, created_at FROM t WHERE status ILIKE 'open'),
c AS (SELECT count(*) AS n, count(id) AS c_id, count(customer_name) AS c_name, count(status) AS c_status,
             count(created_at) AS c_created FROM r)
SELECT * FROM (VALUES ('id', TRUE), ('customer_name', TRUE), ('email', FALSE), ('category', FALSE),
                      ('priority', FALSE), ('status', TRUE), ('created_at', TRUE)) v(column_name, present),
  LATERAL (SELECT CASE v.column_name WHEN 'id' THEN c_id WHEN 'customer_name' THEN c_name WHEN 'status' THEN c_status
                               WHEN 'created_at' THEN c_created ELSE 0 END AS non_null_rows, n AS result_rows FROM c)""",
)
def required_columns(spark, sf_dir):
    """A result that elides columns (as the built-in tool did) is caught: every
    source column must be present and carry its values."""
    tickets(spark, sf_dir).createOrReplaceTempView("support_requests")
    return U.required_columns(U.guarded_sql(spark, _ELIDED_Q), _EXPECTED)


def _flow_sql() -> str:
    from quire.plans.q_routing import _MSG, _ROUTES, _EMAIL_FIND_RE2, _classify_sql

    routed = f"""SELECT p.*, rt.runs_analysis, rt.runs_sql, rt.runs_response, rt.runs_gmail FROM (
  SELECT c.*, {_classify_sql('c.message', 'c.session_subject')} AS predicted, c.intent AS route_intent FROM (
    SELECT m.*, last_value(subject IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_subject
    FROM ({_MSG}) m) c) p0
  CROSS JOIN LATERAL (SELECT CASE WHEN p0.route_intent = 'DATA_LOOKUP' THEN TRUE
        WHEN p0.route_intent = 'ACTION_REQUEST' THEN NOT coalesce(regexp_matches(p0.message, {O.q(_EMAIL_FIND_RE2)}), FALSE)
        ELSE FALSE END AS needs_lookup) nl
  JOIN LATERAL (SELECT p0.*, nl.needs_lookup) p ON TRUE
  LEFT JOIN ({_ROUTES}) rt ON p.route_intent = rt.intent AND p.needs_lookup = rt.needs_lookup"""
    req = f"SELECT session_id || ':' || turn AS request_id, coalesce(session_subject, '') AS term FROM ({routed}) WHERE runs_sql"
    body = _LOOKUP_SQL.replace(f"req AS ({_REQ_SQL})", f"req AS ({req})")
    from quire.plans.q_routing import _validate_sql

    return f"""{body},
flow AS ({routed}),
j AS (SELECT f.*, res.found AS lookup_found, res.match_kind AS lookup_match, res.urgency AS lookup_urgency,
             coalesce(nullif(regexp_extract(f.message, {O.q(_EMAIL_FIND_RE2)}, 0), ''), res.email) AS to_email,
             CASE WHEN res.classification IS NOT NULL THEN 'Update on your ' || res.classification || ' request' END AS mail_subject,
             f.message AS body, 'support@example.com' AS sender, 'app-password' AS password
      FROM flow f LEFT JOIN res ON res.request_id = f.session_id || ':' || f.turn),
v AS (SELECT session_id, turn, session_subject, route_intent, predicted, needs_lookup, runs_analysis, runs_sql,
             runs_response, runs_gmail, lookup_found, lookup_match, lookup_urgency, {_validate_sql('mail_subject')} FROM j)
SELECT session_id, turn, session_subject, route_intent, predicted, needs_lookup, runs_analysis, runs_sql,
       runs_response, runs_gmail, lookup_found, lookup_match, lookup_urgency,
       CASE WHEN runs_gmail THEN success END AS email_sent, CASE WHEN runs_gmail THEN message END AS email_result
FROM v"""


@register("support_flow", _flow_sql())
def support_flow(spark, sf_dir):
    """Section 3.3 end to end for every user message."""
    from quire.plans.fixtures import messages
    from quire.plans.support_flow import support_flow as flow

    return flow(messages(spark, sf_dir), tickets(spark, sf_dir))


_SEEDS = ", ".join("(" + ", ".join("NULL" if v is None else O.q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in U.SEED_ROWS)


@register(
    "load_support_requests",
    f"""{_T}, s AS (SELECT * FROM (VALUES {_SEEDS}) v(id, customer_name, email, category, priority, status))
SELECT CAST(s.id AS INTEGER) AS id, s.customer_name, s.email, s.category, s.priority, s.status, count(t.id) AS n_like
FROM s LEFT JOIN t ON t.category = s.category AND t.status = s.status
GROUP BY ALL""",
)
def load_support_requests(spark, sf_dir):
    """The seed tickets, each with the number of given tickets of its category and status."""
    like = tickets(spark, sf_dir).groupBy("category", "status").agg(F.count(F.lit(1)).alias("n_like"))
    seeds = U.load_support_requests(spark).drop("created_at").join(like, ["category", "status"], "left")
    return seeds.select("id", "customer_name", "email", "category", "priority", "status", F.coalesce("n_like", F.lit(0).cast("long")).alias("n_like"))
