"""Support analytics golden rows (seed tickets, published lookups, guard and
envelope behaviour)."""

import json


from quire.operators import support as U


def test_seed_and_open_tickets(spark):
    t = U.load_support_requests(spark)
    assert t.count() == 5
    names = [r["customer_name"] for r in U.tickets_by_status(t, "OPEN").collect()]
    assert names == ["John Smith", "Emma Johnson", "Michael Brown"]


def test_lookup_golden(spark):
    t = U.load_support_requests(spark)
    req = spark.createDataFrame([(1, "sarah cohen"), (2, "alice@example.com"), (3, "Sarah")], "request_id int, term string")
    got = {r["request_id"]: r for r in U.ticket_lookup(req, t).collect()}
    assert got[1]["found"] and got[1]["classification"] == "Billing" and got[1]["match_kind"] == "exact"
    assert got[1]["urgency"] == "Medium"
    assert not got[2]["found"] and got[2]["match_kind"] == "none"
    assert got[3]["found"] and got[3]["match_kind"] == "first_name"
    v = {r["request_id"]: r for r in U.lookup_verdict(U.ticket_lookup(req, t)).collect()}
    assert v[2]["missing_information"].startswith("no matching record")


def test_urgency_rules(spark):
    t = U.derive_urgency(U.load_support_requests(spark))
    got = {r["id"]: r["urgency"] for r in t.collect()}
    assert got == {1: "High", 2: "Medium", 3: "Low", 4: "High", 5: "Medium"}
    d = spark.createDataFrame([("Billing", "Low", "Open", "we had data loss")], "category string, priority string, status string, d string")
    assert d.select(U.urgency(description="d").alias("u")).first()["u"] == "Critical"


GUARD = [
    ("SELECT 1", None),
    ("WITH x AS (SELECT 1) SELECT * FROM x", None),
    ("SELECT 1;", None),
    ("SELECT 1; SELECT 2", U.MSG_MULTI),
    ("DELETE FROM t", U.MSG_NOT_SELECT),
    ("SELECT * FROM t WHERE s = 'Call'", "The keyword 'CALL' is not permitted. This tool is read-only."),
    ("   ", U.MSG_EMPTY),
]


def test_guard_python_and_column_agree(spark):
    for q, verdict in GUARD:
        assert U.guard_select(q)[1] == verdict, q
    df = spark.createDataFrame([(q,) for q, _ in GUARD], "q string")
    col = [r["e"] for r in df.select(U.guard_column("q").alias("e")).collect()]
    assert col == [v for _, v in GUARD]


def test_run_select_envelope(spark):
    U.load_support_requests(spark).createOrReplaceTempView("support_requests")
    env = U.run_select(spark, "SELECT id, email, NULL AS note FROM support_requests WHERE status ILIKE 'open' ORDER BY id", 2).first()
    assert env["error"] is None and env["row_count"] == 2
    rows = json.loads(env["rows"])
    assert rows[0] == {"id": 1, "email": "john@example.com", "note": None}
    assert json.loads(env["columns"]) == ["id", "email", "note"]
    bad = U.run_select(spark, "DROP TABLE support_requests").first()
    assert bad["error"] == U.MSG_NOT_SELECT and bad["row_count"] == 0 and bad["rows"] == "[]"
    err = U.run_select(spark, "SELECT nope FROM support_requests").first()
    assert err["error"].startswith("SQL execution failed:")


def test_redact():
    assert U.redact_message("failed for postgres://u:p@h/db", "OperationalError") == (
        "OperationalError (details withheld: may contain credentials)"
    )
    assert U.redact_message("  ", "Boom") == "Boom"
    assert len(U.redact_message("x" * 500, "E")) == 300


def test_reconcile(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    a = spark.createDataFrame([(1, "a"), (3, "c")], "id int, v string")
    got = sorted((r["id"], r["kind"]) for r in U.reconcile(e, a, "id", ["v"]).collect())
    assert got == [(2, "missing_row"), (3, "extra_row")]


def test_envelope_duplicate_names_last_wins(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a, CAST(NULL AS STRING) AS b")
    env = U.rows_to_json(df).first()
    assert json.loads(env["columns"]) == ["a", "a", "b"]
    assert json.loads(env["rows"]) == [{"a": 2, "b": None}]


def test_guard_column_equals_python_guard_on_derived_statements(spark):
    from conftest import SF_SMALL
    from quire.plans.q_support import guard_queries

    rows = guard_queries(spark, SF_SMALL).select("query", U.guard_column("query").alias("e")).collect()
    assert rows
    for r in rows:
        assert r["e"] == U.guard_select(r["query"])[1], r["query"][:80]


REFUSED = [
    "SELECT reflect('java.lang.System', 'currentTimeMillis') AS t",
    "SELECT `reflect`('java.lang.System', 'currentTimeMillis') AS t",
    "SELECT java_method/**/('java.lang.Math', 'abs', -1)",
    "SELECT try_reflect('java.lang.System', 'currentTimeMillis')",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x",
    "SELECT * FROM support_requests WHERE EXISTS (SELECT 1 FROM hidden)",
    "WITH x AS (SELECT * FROM hidden) SELECT * FROM x",
    "SELECT * FROM range(10)",
]


def test_run_select_reaches_listed_views_only(spark):
    U.load_support_requests(spark).createOrReplaceTempView("support_requests")
    spark.range(3).createOrReplaceTempView("hidden")
    for q in REFUSED:
        env = U.run_select(spark, q, views=["support_requests"]).first()
        assert env["error"] and not env["error"].startswith("SQL execution failed") and env["rows"] == "[]", q
    ok = "WITH x AS (SELECT id FROM Support_Requests UNION SELECT 9) SELECT count(*) AS n FROM x JOIN (VALUES (1), (9)) v(id) USING (id)"
    assert json.loads(U.run_select(spark, ok, views=["support_requests"]).first()["rows"]) == [{"n": 2}]


def test_run_select_never_raises(spark):
    U.load_support_requests(spark).createOrReplaceTempView("support_requests")
    for q in ("SELECT 1/0", "SELECT CAST('x' AS INT)", "SELECT nope FROM support_requests", "SELECT id FROM", "SELECT raise_error('https://u:p@h')"):
        env = U.run_select(spark, q).first()
        assert env["error"].startswith("SQL execution failed:") and env["row_count"] == 0, q
    assert "://" not in U.run_select(spark, "SELECT raise_error('https://u:p@h')").first()["error"]
    assert U.run_select(spark, "SELECT 1", 10**9).first()["error"]


def test_envelope_names_are_valid_json_and_truncation_is_told(spark):
    names = ["a\\b", 'q"t', "tab\there", "né"]
    df = spark.createDataFrame([(1, 2, 3, 4), (5, 6, 7, 8)], "a int, b int, c int, d int").toDF(*names)
    env = U.rows_to_json(df, 1).first()
    assert json.loads(env["columns"]) == names and env["truncated"] and env["row_count"] == 1
    assert not U.rows_to_json(df, 2).first()["truncated"]


def test_lookup_counts_a_customer_once(spark):
    t = U.load_support_requests(spark).limit(1)
    both = t.selectExpr("id", "email AS customer_name", "email", "category", "priority", "status")
    req = spark.createDataFrame([(1, "JOHN@example.com"), (1, "john@example.com")], "request_id int, term string")
    assert [(r["n_records"], r["n_customers"]) for r in U.ticket_lookup(req, both).collect()] == [(1, 1), (1, 1)]


def test_reconcile_reports_missing_rows_of_nulls(spark):
    e = spark.createDataFrame([(1, None), (2, "b")], "id int, v string")
    a = spark.createDataFrame([(2, "b"), (3, None)], "id int, v string")
    got = sorted((r["id"], r["kind"], r["column"]) for r in U.reconcile(e, a, "id", ["v"]).collect())
    assert got == [(1, "missing_row", None), (3, "extra_row", None)]


def test_flow_keeps_messages_of_long_sessions_apart(spark):
    from quire.plans.support_flow import support_flow

    rows = [(1, 100, "find Sarah Cohen", "DATA_LOOKUP", "Sarah Cohen"), (2, 0, "find David Levi", "DATA_LOOKUP", "David Levi")]
    m = spark.createDataFrame(rows, "session_id long, turn long, message string, intent string, subject string")
    out = support_flow(m, U.load_support_requests(spark))
    assert sorted((r["session_id"], r["lookup_urgency"]) for r in out.collect()) == [(1, "Medium"), (2, "Low")]
    assert "app-password" not in out._jdf.queryExecution().toString()


def test_every_page_is_an_error_message(spark):
    """No page is blanked: its whole html is a message of its own, beside a blank one."""
    import __spark_entry__ as E
    from conftest import SF_SMALL

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = {(r["page_id"], r["form"]): r["redacted"] for r in E.queries()["redact_error_pages"](spark, SF_SMALL).collect()}
    assert set(rows) == {(p, f) for p in pages for f in ("address", "whole", "plain", "blank")}
    for p, html in pages.items():
        assert rows[p, "whole"] == U.redact_message(html, "OperationalError")
        assert rows[p, "plain"] == U.redact_message((html or "").replace("://", " "), "OperationalError")
        assert rows[p, "blank"] == "OperationalError"


def _two_tables(spark, n=20_000):
    e = spark.range(n).selectExpr("id", "concat('name ', id) AS name", "IF(id % 10 = 0, NULL, cast(id % 7 AS string)) AS kind")
    a = e.where("id <> 77").selectExpr("id", "IF(id = 500, 'other', name) AS name", "IF(id = 9000, '', kind) AS kind").unionByName(spark.createDataFrame([(n + 5, "more", None)], e.schema))
    return e, a


def test_digests_find_what_the_join_finds(spark):
    e, a = _two_tables(spark)
    cols = ["name", "kind"]
    want = sorted(map(tuple, U.reconcile(e, a, "id", cols).collect()), key=str)
    assert {r[0] for r in want} == {77, 500, 9000, 20_005}
    assert sorted(map(tuple, U.reconcile_by_digests(e, a, "id", cols).collect()), key=str) == want


def test_rows_joined_follow_the_differences(spark):
    e, a = _two_tables(spark)
    left, right = U.differing_rows(e, a, "id", ["name", "kind"])
    assert 4 <= left.count() <= 4 * 4 * U.LEAF_ROWS and right.count() <= 4 * 4 * U.LEAF_ROWS
    left, right = U.differing_rows(e, e, "id", ["name", "kind"])
    assert left.count() == right.count() == 0


def test_digests_of_small_and_odd_tables(spark):
    schema = "id long, name string"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, None), (2, ""), (3, "a")], schema)
    two = spark.createDataFrame([(1, ""), (2, ""), (3, "a")], schema)
    assert U.reconcile_by_digests(none, none, "id", ["name"]).collect() == []
    assert {r["id"] for r in U.reconcile_by_digests(none, one, "id", ["name"]).collect()} == {1, 2, 3}
    assert [tuple(r) for r in U.reconcile_by_digests(one, two, "id", ["name"]).collect()] == [(1, "differs", "name", None, "")]
