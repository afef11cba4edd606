"""Support analytics (S10, S11, A1-A11): guarded read-only SQL, the JSON
envelope, ticket lookup with one broader retry, urgency rules, reconciliation.

All of it is column expressions, aggregations and equi-joins; the only
driver-side work is parsing a single guarded statement.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import strip_text
from quire.session import shared_dir

# Fixed values ---------------------------------------------------------------
DEFAULT_MAX_ROWS = 50
MOST_ROWS = 1000
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "copy", "call", "do",
)
WORDCH = r"[\p{L}\p{N}_]"
SELECT_ONLY = r"(?iu)^(select|with)(?!" + WORDCH + ")"
# RE2 spellings (no lookaround) used by the SQL oracle
SELECT_ONLY_RE2 = r"(?i)^(select|with)([^\pL\pN_]|$)"
FORBIDDEN_RE2 = r"(?i)(^|[^\pL\pN_])(" + "|".join(FORBIDDEN_WORDS) + r")([^\pL\pN_]|$)"
FORBIDDEN = r"(?iu)(?<!" + WORDCH + r")(" + "|".join(FORBIDDEN_WORDS) + r")(?!" + WORDCH + ")"
# Spark expressions that call arbitrary JVM methods (whatever name they go by), and the
# leaves a plan may have beside the listed views.
SQL_ON_FILES = "spark.sql.runSQLOnFiles"
UNSAFE_EXPRESSIONS = ("CallMethodViaReflection", "TryReflect")
PLAN_LEAVES = ("OneRowRelation", "OneRowRelation$", "LocalRelation", "CTERelationRef", "UnionLoopRef")
MSG_EMPTY = "No SQL query was provided."
MSG_NOT_SELECT = "Only SELECT queries are permitted. This tool is read-only."
MSG_MULTI = "Multiple statements are not permitted. Send a single SELECT."
WITHHELD = " (details withheld: may contain credentials)"
ERROR_CUT = 300

CATEGORIES = ("Login Issue", "Billing", "Technical Support", "Account Access", "Subscription")
PRIORITIES = ("High", "Medium", "Low")
STATUSES = ("Open", "In Progress", "Closed")
SEED_ROWS = [
    (1, "John Smith", "john@example.com", "Login Issue", "High", "Open"),
    (2, "Sarah Cohen", "sarah@example.com", "Billing", "Medium", "In Progress"),
    (3, "David Levi", "david@example.com", "Technical Support", "Low", "Closed"),
    (4, "Emma Johnson", "emma@example.com", "Account Access", "High", "Open"),
    (5, "Michael Brown", "michael@example.com", "Subscription", "Medium", "Open"),
]
# Urgency (our order for overlapping rules: Critical, Closed -> Low, High, Medium, Low)
CRITICAL_TERMS = r"(?i)(data loss|lost (all )?data|breach|hacked|outage|down for everyone|service down)"
SUSPENDED_TERMS = r"(?i)suspend"
BLOCKING_CATEGORIES = ("Login Issue", "Account Access")
MEDIUM_CATEGORIES = ("Billing", "Subscription")
URGENCY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}


# S10
def support_requests_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.IntegerType(), False),
            T.StructField("customer_name", T.StringType(), True),
            T.StructField("email", T.StringType(), True),
            T.StructField("category", T.StringType(), True),
            T.StructField("priority", T.StringType(), True),
            T.StructField("status", T.StringType(), True),
        ]
    )


def load_support_requests(spark: SparkSession) -> DataFrame:
    """The five seed tickets; ``created_at`` defaults to the load time."""
    df = spark.createDataFrame(SEED_ROWS, support_requests_schema())
    return df.withColumn("created_at", F.localtimestamp())


# A7
def guard_select(query: str | None) -> tuple[str, str | None]:
    """Normalise one statement and return ``(query, refusal or None)``."""
    import regex  # Unicode-aware, supports the same lookarounds as Java

    q = (query or "").strip().rstrip(";").strip()
    if not q:
        return q, MSG_EMPTY
    if not regex.match(SELECT_ONLY.replace("(?iu)", "(?i)"), q):
        return q, MSG_NOT_SELECT
    if ";" in q:
        return q, MSG_MULTI
    m = regex.search(FORBIDDEN.replace("(?iu)", "(?i)"), q)
    if m:
        return q, f"The keyword '{m.group(1).upper()}' is not permitted. This tool is read-only."
    return q, None


def guard_column(query) -> Column:
    """A7 over a column of statements: the refusal message or null."""
    q = strip_text(F.regexp_replace(strip_text(F.col(query) if isinstance(query, str) else query), r";+\z", ""))
    word = F.upper(F.regexp_extract(q, FORBIDDEN, 1))
    return (
        F.when(q == "", F.lit(MSG_EMPTY))
        .when(~q.rlike(SELECT_ONLY), F.lit(MSG_NOT_SELECT))
        .when(F.instr(q, ";") > 0, F.lit(MSG_MULTI))
        .when(word != "", F.concat(F.lit("The keyword '"), word, F.lit("' is not permitted. This tool is read-only.")))
    )


# A9
def redact_message(message: str, class_name: str, cut: int | None = ERROR_CUT) -> str:
    m = (message or "").strip() or class_name
    if "://" in m:
        return class_name + WITHHELD
    return m[:cut] if cut else m


def redact_column(message, class_name, cut: int | None = ERROR_CUT) -> Column:
    m = strip_text(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    cls = F.col(class_name) if isinstance(class_name, str) else class_name
    m = F.when(m == "", cls).otherwise(m)
    body = F.left(m, F.lit(cut)) if cut else m
    return F.when(F.instr(m, "://") > 0, F.concat(cls, F.lit(WITHHELD))).otherwise(body)


# S11
def json_value(col: str, dtype: T.DataType) -> Column:
    """How the envelope encodes one value: timestamps like ``str(datetime)``,
    decimals as floats, everything else as JSON does."""
    c = F.col(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(
            F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        ).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    return c


def rows_to_json(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """One-row envelope ``(error, row_count, columns, rows, truncated)``; ``columns``
    and ``rows`` are JSON arrays, a row keeping every column and nulls. The row cap is
    the tool's contract (50, MOST_ROWS at most, as all rows become one string);
    ``truncated`` tells whether there were more."""
    n = int(max_rows or DEFAULT_MAX_ROWS)
    if n <= 0:
        n = DEFAULT_MAX_ROWS
    if n > MOST_ROWS:
        raise ValueError(f"max_rows must not be greater than {MOST_ROWS}.")
    fields = df.schema.fields
    names = [f.name for f in fields]
    # duplicate names: every name stays in ``columns``, the last value wins in ``rows``
    pos = [f"__c{i}" for i in range(len(fields))]
    df = df.toDF(*pos)
    last = {name: i for i, name in enumerate(names)}
    kept = [i for i, name in enumerate(names) if last[name] == i]
    obj = F.to_json(
        F.struct(*[json_value(pos[i], fields[i].dataType).alias(names[i]) for i in kept]), {"ignoreNullFields": "false"}
    )
    capped = df.limit(n + 1).select(F.monotonically_increasing_id().alias("__ord"), obj.alias("__json"))
    cols_json = json.dumps(names, ensure_ascii=False, separators=(",", ":"))
    held = capped.agg(F.array_sort(F.collect_list(F.struct("__ord", "__json"))).alias("__rows"))
    shown = F.slice(F.transform("__rows", lambda s: s["__json"]), 1, n)
    return held.select(
        F.lit(None).cast("string").alias("error"),
        F.least(F.size("__rows"), F.lit(n)).alias("row_count"),
        F.lit(cols_json).alias("columns"),
        F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")).alias("rows"),
        (F.size("__rows") > n).alias("truncated"),
    )


ENVELOPE = "error string, row_count int, columns string, rows string, truncated boolean"


def error_envelope(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame(
        [(message, 0, None, "[]", False)], ENVELOPE
    )


# A11
def required_columns(result: DataFrame, expected: list[str]) -> DataFrame:
    """Per expected column: present in the result, and how many rows carry a
    value for it (one aggregation pass over the result)."""
    have = set(result.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count(F.col(c)).alias(c) if c in have else F.lit(0).cast("long").alias(c) for c in expected
    ]
    counted = result.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"), F.col(c).alias("non_null_rows"))
        for c in expected
    ]))
    return counted.select("__rows", stack.alias("s")).select(
        "s.column_name", "s.present", "s.non_null_rows", F.col("__rows").alias("result_rows")
    )


# A8
class Refused(PermissionError):
    """A statement that reaches for more than the listed views."""


def _seq(jvm_seq) -> list:
    return [jvm_seq.apply(i) for i in range(jvm_seq.size())]


def _class(node) -> str:
    return node.getClass().getSimpleName()


def _check_expression(e) -> None:
    if _class(e) in UNSAFE_EXPRESSIONS:
        raise Refused(f"The function '{e.prettyName().upper()}' is not permitted. This tool is read-only.")
    for child in _seq(e.children()):
        _check_expression(child)


def _check_plan(plan, views: set[str]) -> None:
    """Walk an analysed plan: its leaves are the listed views, constants and references
    to its own common tables; no expression calls into the JVM."""
    kind = _class(plan)
    if kind == "View":
        name = plan.desc().identifier().table()
        if not plan.isTempView() or name.lower() not in views:
            raise Refused(f"The table '{name}' is not available.")
        return  # what a listed view reads is its owner's matter
    if kind not in PLAN_LEAVES and plan.children().isEmpty():
        raise Refused("Only the listed views are available.")
    for e in _seq(plan.expressions()):
        _check_expression(e)
    for inner in (*_seq(plan.children()), *_seq(plan.subqueries())):
        _check_plan(inner, views)


def guarded_sql(spark: SparkSession, query: str, views: Iterable[str] | None = None) -> DataFrame:
    """The result of one guarded statement over ``views`` (default: all temporary views
    of the session). Raises ``Refused``; nothing is run, and no file is opened, before
    the plan is checked: file paths are no tables here."""
    q, refusal = guard_select(query)
    if refusal:
        raise Refused(refusal)
    if views is None:
        views = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    before = spark.conf.get(SQL_ON_FILES, "true")
    spark.conf.set(SQL_ON_FILES, "false")
    try:
        df = spark.sql(q)
    except AnalysisException as exc:
        if exc.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
            raise Refused("Only the listed views are available.") from exc
        raise
    finally:
        spark.conf.set(SQL_ON_FILES, before)
    _check_plan(df._jdf.queryExecution().analyzed(), {v.lower() for v in views})
    return df


def run_select(spark: SparkSession, query: str, max_rows: int = DEFAULT_MAX_ROWS, views: Iterable[str] | None = None) -> DataFrame:
    """Guard, analyse, check the plan, run and encode at most ``max_rows`` rows. Never
    raises: a refusal or a failure, at run time too, becomes an error envelope."""
    try:
        rows = rows_to_json(guarded_sql(spark, query, views), max_rows).collect()
        return spark.createDataFrame(rows, ENVELOPE)
    except Refused as exc:
        return error_envelope(spark, str(exc))
    except Exception as exc:  # noqa: BLE001 - any engine error becomes data
        return error_envelope(spark, f"SQL execution failed: {redact_message(str(exc), type(exc).__name__)}")


# A1
def tickets_by_status(tickets: DataFrame, status: str, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return (
        tickets.where(F.col("status").ilike(status))
        .select("id", "customer_name", "email", "category", "priority", "status")
        .orderBy("id")
        .limit(max_rows)
    )


# A2
def ticket_counts(tickets: DataFrame) -> DataFrame:
    """Counts by status, by priority, by category and overall in one pass
    (grouping sets; partial aggregation map-side)."""
    return tickets.groupingSets(
        [["status"], ["priority"], ["category"], []], "status", "priority", "category"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


# A4
def urgency(category="category", priority="priority", status="status", description: str | None = None) -> Column:
    cat, pri, st = F.col(category), F.col(priority), F.col(status)
    desc = F.col(description) if description else F.lit(None).cast("string")
    critical = F.coalesce(desc.rlike(CRITICAL_TERMS), F.lit(False))
    suspended = F.coalesce(desc.rlike(SUSPENDED_TERMS), F.lit(False))
    return (
        F.when(critical, "Critical")
        .when(st == "Closed", "Low")
        .when(cat.isin(*BLOCKING_CATEGORIES) | suspended | (pri == "High"), "High")
        .when(cat.isin(*MEDIUM_CATEGORIES), "Medium")
        .otherwise("Low")
    )


def urgency_rank(col="urgency") -> Column:
    return F.create_map(*[F.lit(x) for kv in URGENCY_RANK.items() for x in kv])[F.col(col)]


def derive_urgency(tickets: DataFrame, description: str | None = None) -> DataFrame:
    return tickets.withColumn("urgency", urgency(description=description)).withColumn("urgency_rank", urgency_rank())


# A6
def triage_order(tickets: DataFrame) -> DataFrame:
    """Blocking tickets first: by urgency rank, then id (a global range sort)."""
    return derive_urgency(tickets).orderBy("urgency_rank", "id")


# A3
def _customer_profiles(tickets: DataFrame) -> DataFrame:
    """Pre-aggregate tickets per customer (map-side partial aggregation), so
    the lookup joins requests to one row per customer, not to every ticket."""
    t = derive_urgency(tickets)
    first = F.struct("urgency_rank", "id")
    return t.groupBy(F.lower("email").alias("email_lc"), F.lower("customer_name").alias("name_lc")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(first).alias("best"),
        F.min_by("category", first).alias("classification"),
        F.min_by("email", first).alias("email"),
    )


def _per_key(prof: DataFrame, key: str) -> DataFrame:
    """One row for each lookup key, however many customers share it."""
    return prof.groupBy(F.col(key).alias("__key")).agg(
        F.count_distinct("email").alias("n_customers"),
        F.sum("n_records").alias("n_records"),
        F.min_by("classification", "best").alias("classification"),
        F.min("best")["urgency_rank"].alias("__rank"),
        F.min("email").alias("email"),
    )


def ticket_lookup(requests: DataFrame, tickets: DataFrame, term: str = "term") -> DataFrame:
    """Case-insensitive exact match on name or e-mail; unmatched requests get
    one broader try on the first name only; the rest are not found.

    Both sides of each join have one row a key: exact keys (e-mail or name; a customer
    whose name is its e-mail counts once) and first names. The first-name join sees only
    unmatched requests; matched ones carry keys that meet nothing, spread by hash."""
    prof = _customer_profiles(tickets)
    exact = _per_key(prof.withColumn("__k", F.explode(F.array_distinct(F.array("email_lc", "name_lc")))), "__k")
    firsts = _per_key(prof.withColumn("__k", F.split("name_lc", " ").getItem(0)), "__k")
    keys = [F.col(f"r.{c}") for c in requests.columns]
    t = F.lower(strip_text(F.col(f"r.{term}")))
    one = requests.alias("r").join(exact.alias("x"), t == F.col("x.__key"), "left")
    missed = F.col("x.__key").isNull()
    word = F.when(missed, F.split(t, " ").getItem(0)).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(t).cast("string")))
    both = one.join(firsts.alias("f"), word == F.col("f.__key"), "left")
    got = lambda c: F.when(~missed, F.col(f"x.{c}")).otherwise(F.col(f"f.{c}"))
    rank_names = F.array(*[F.lit(x) for x in URGENCY_RANK])
    return both.select(
        *keys,
        F.when(~missed, "exact").when(F.col("f.__key").isNotNull(), "first_name").otherwise("none").alias("match_kind"),
        F.coalesce(got("n_customers"), F.lit(0)).cast("long").alias("n_customers"),
        F.coalesce(got("n_records"), F.lit(0)).cast("long").alias("n_records"),
        got("classification").alias("classification"),
        F.when(~missed & (F.col("x.n_customers") == 1), F.col("x.email")).alias("email"),
        (F.coalesce(got("n_records"), F.lit(0)) > 0).alias("found"),
        F.when(~missed | F.col("f.__key").isNotNull(), F.element_at(rank_names, got("__rank") + 1)).alias("urgency"),
    )


# A5
def lookup_verdict(lookups: DataFrame) -> DataFrame:
    """found / records / classification / urgency / missing_information /
    recommended_action; zero rows is not an error, several customers means a
    missing identifier."""
    missing = (
        F.when(~F.col("found"), F.lit("no matching record; ask for an order number or ticket id"))
        .when(F.col("n_customers") > 1, F.lit("several customers match; ask for an e-mail address or ticket id"))
    )
    action = (
        F.when(~F.col("found"), F.lit("tell the customer no record was found and ask for an identifier"))
        .when(F.col("n_customers") > 1, F.lit("ask which customer is meant before acting"))
        .when(F.col("urgency").isin("Critical", "High"), F.lit("prioritise: contact the customer today"))
        .otherwise(F.lit("reply with the current status and next step"))
    )
    return lookups.withColumn("missing_information", missing).withColumn("recommended_action", action)


# A10
def reconcile(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Row-by-row comparison: one output row per differing (key, column). A missing or
    extra row whose compared values are all null gives one row with a null column."""
    e = expected.select(key, *[F.col(c).cast("string").alias(f"e__{c}") for c in columns], F.lit(True).alias("e__"))
    a = actual.select(key, *[F.col(c).cast("string").alias(f"a__{c}") for c in columns], F.lit(True).alias("a__"))
    j = e.join(a, key, "full_outer")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"e__{c}").alias("expected"), F.col(f"a__{c}").alias("actual"),
                F.col(f"e__{c}").eqNullSafe(F.col(f"a__{c}")).alias("same"),
            )
            for c in columns
        ]
    )
    rowstate = (
        F.when(F.col("a__").isNull(), "missing_row").when(F.col("e__").isNull(), "extra_row").otherwise("differs")
    )
    found = F.filter(cells, lambda c: ~c["same"])
    none = F.lit(None).cast("string")
    nothing = F.array(F.struct(none.alias("column"), none.alias("expected"), none.alias("actual"), F.lit(False).alias("same")))
    found = F.when((F.size(found) == 0) & (rowstate != "differs"), nothing).otherwise(found)
    out = j.select(key, rowstate.alias("kind"), F.explode(found).alias("c"))
    return out.select(key, "kind", "c.column", "c.expected", "c.actual")


# A10 by digests: two tables are compared bucket by bucket before any row is joined
LEAF_ROWS, FAN_BITS, MAX_BITS = 64, 4, 40


def _bucket(key: str, bits: int) -> Column:
    """The first ``bits`` bits of the key's hash, as a number."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - bits) if bits else F.lit(0).cast("long")


def tree_bits(rows: int) -> int:
    """Depth in bits of a tree whose leaves hold about LEAF_ROWS rows: a multiple of FAN_BITS."""
    need = max(0, (rows // LEAF_ROWS).bit_length())
    return min(MAX_BITS, -(-need // FAN_BITS) * FAN_BITS)


def digest_leaves(df: DataFrame, key: str, columns: list[str], bits: int) -> DataFrame:
    """(bucket, n, h1, h2): count and order-free digests of the rows of each bucket that has any. Small enough to
    keep beside a table, so that a later comparison reads only digests of an unchanged side."""
    # nulls and empty strings differ; a cell's length parts it from the next
    cells = F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in [key, *columns]))
    h = [F.xxhash64(F.lit(i), cells) for i in (1, 2)]
    # summed in decimals: equal rows do not cancel out, whatever their number
    rows = df.select(_bucket(key, bits).alias("bucket"), *(x.cast("decimal(38,0)").alias(f"h{i}") for i, x in enumerate(h, 1)))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))


def differing_buckets(expected: DataFrame, actual: DataFrame, bits: int) -> DataFrame:
    """Leaf buckets whose digests differ, by descent from the root: on each level only the children of
    differing nodes are compared."""
    spark = expected.sparkSession

    def level(leaves: DataFrame, depth: int) -> DataFrame:
        up = leaves.withColumn("bucket", F.shiftrightunsigned("bucket", bits - depth) if depth < bits else F.col("bucket"))
        return up.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "h1", "h2")))

    nodes = None
    for depth in range(0, bits + 1, FAN_BITS):
        e, a = level(expected, depth), level(actual, depth)
        if nodes is not None:
            under = lambda t: t.join(nodes, F.shiftrightunsigned(t["bucket"], FAN_BITS) == nodes["node"], "left_semi")  # noqa: B023, E731
            e, a = under(e), under(a)
        pair = e.alias("e").join(a.alias("a"), "bucket", "full_outer")
        same = F.lit(True)
        for c in ("n", "h1", "h2"):
            same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
        path = shared_dir(spark, "differing")
        pair.where(~same).select(F.col("bucket").alias("node")).write.parquet(path)
        nodes = spark.read.schema("node long").parquet(path)
    return nodes.withColumnRenamed("node", "bucket")


def differing_rows(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in differing buckets: all that differ, and their bucket's others."""
    spark = expected.sparkSession
    bits = tree_bits(max(expected.count(), actual.count()))
    kept = []
    for side, name in ((expected, "expected"), (actual, "actual")):
        path = shared_dir(spark, f"digests-{name}")
        digest_leaves(side, key, columns, bits).write.parquet(path)
        kept.append(spark.read.parquet(path))
    nodes = differing_buckets(*kept, bits)
    near = lambda df: df.join(nodes, _bucket(key, bits) == nodes["bucket"], "left_semi")
    return near(expected), near(actual)


def reconcile_by_digests(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``reconcile``'s rows, with a join of the rows of differing buckets only."""
    return reconcile(*differing_rows(expected, actual, key, columns), key, columns)
