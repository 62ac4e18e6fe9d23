"""The engine's queries on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.functions import scalars
from plumbline.functions import similarity as sim
from plumbline.operators import changelog, relational, veracity
from plumbline.operators import predicates as p
from plumbline.plans import dialect
from plumbline.plans.rewrites import with_distinct_value
from plumbline.session import ship
from plumbline.sources.logs import Log
from plumbline.sources.tables import Tables

PATTERN = "blue rign"
AS_OF, HORIZON, MIN_SEQ = 5000, 6000, 4000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL for the same rows."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[build.__name__] = run
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder name where driver and executors both write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="plumbline-")
    return posixpath.join(base, f"plumbline-{uuid.uuid4().hex}")


def lineitem(t) -> DataFrame:
    """lineitem with its derived confidence."""
    return veracity.attach(t("lineitem"), F.lit(1.0) - F.col("l_discount"))


def log(t) -> DataFrame:
    """The change log that events stand for."""
    op = F.when(F.col("event_type") == "error", changelog.DELETE).otherwise(changelog.PUT)
    return t("events").select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.when(op == changelog.PUT, F.col("props")).alias("value"))


_LOG = "(SELECT CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"
_NEWEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}) WHERE rn = 1)"
_V = "CAST(CAST(1.0 - l_discount AS FLOAT) AS DOUBLE)"

# ---- scans, lookups, comparisons


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def seq_scan(t):
    return t("nation")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return relational.point_lookup(t("customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_name, s_suppkey FROM supplier")
def projection(t):
    s = t("supplier")
    return s.select(p.column(s, 1), p.column(s, "s_suppkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def filter_basic(t):
    return p.where(t("lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber")


def _comparison(name: str, op: str) -> None:
    def build(t):
        return t("part").where(p.compare(F.col("p_size"), op, F.lit(25))).select("p_partkey", "p_size")

    build.__name__ = name
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25")(build)


for _name, _op in {"cmp_eq": "=", "cmp_ne": "<>", "cmp_lt": "<", "cmp_le": "<=", "cmp_gt": ">", "cmp_ge": ">="}.items():
    _comparison(_name, _op)


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size > 10 AND p_retailprice < 1200")
def pred_and(t):
    return t("part").where(p.all_of(F.col("p_size") > 10, F.col("p_retailprice") < 1200)).select("p_partkey", "p_size", "p_brand")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size > 45 OR p_retailprice < 1000")
def pred_or(t):
    return t("part").where(p.any_of(F.col("p_size") > 45, F.col("p_retailprice") < 1000)).select("p_partkey", "p_size", "p_brand")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, (nullif(o_orderstatus, 'O') IS NULL) AS same_as_null, (nullif(o_orderstatus, 'O') IS NULL OR nullif(o_orderstatus, 'O') < 'P') AS below_p FROM orders")
def cmp_two_valued(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return t("orders").select(
        "o_orderkey",
        status.alias("status"),
        p.compare(status, p.EQUAL, F.lit(None).cast("string"), two_valued=True).alias("same_as_null"),
        p.compare(status, p.LESS, F.lit("P"), two_valued=True).alias("below_p"),
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def index_point(t):
    return relational.point_lookup(t("orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def index_range(t):
    return relational.index_range(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 400)


@query("SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem GROUP BY l_suppkey")
def unique_keys(t):
    rows = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_line"))
    return relational.unique_by(rows, "l_suppkey", F.col("first_line"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_scan(t):
    return relational.prefix_scan(t("customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_suppkey + 10 < 40 OR s_suppkey > 60)")
def range_overlap(t):
    key = F.col("s_suppkey")
    return t("supplier").where(relational.overlaps(key, key + 10, F.lit(40), F.lit(60))).select("s_suppkey")


# ---- similarity

#: Jaro and Jaro-Winkler for {pairs}, a table (a, b) of ASCII text, by folding over matched places.
_JARO = """WITH src AS (SELECT DISTINCT a, b FROM ({pairs})),
s AS (SELECT a, b, length(a) l1, length(b) l2, greatest(length(a), length(b)) // 2 - 1 md FROM src),
q AS (SELECT *, CASE WHEN l1 = 0 OR l2 = 0 OR (l1 = 1 AND l2 = 1) THEN []::STRUCT(i BIGINT, j BIGINT)[] ELSE
  list_reduce(range(1, l1 + 1), lambda s, i: list_concat(s, list_transform(list_filter(
    range(greatest(1, i - md), least(i + md, l2) + 1),
    lambda j: b[j] = a[i] AND NOT list_contains(list_transform(s, lambda q: q.j), j))[1:1],
    lambda j: {{'i': i, 'j': j}})), []::STRUCT(i BIGINT, j BIGINT)[]) END prs FROM s),
m AS (SELECT *, len(prs) m, list_sum([CASE WHEN a[x[1].i] <> b[x[2]] THEN 1 ELSE 0 END
  FOR x IN list_zip(prs, list_sort(list_transform(prs, lambda q: q.j)))]) mis FROM q),
j AS (SELECT a, b, CASE WHEN l1 = 0 AND l2 = 0 THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE
  ELSE (m::DOUBLE / l1 + m::DOUBLE / l2 + (m - mis / 2.0::DOUBLE) / m) / 3 END jaro FROM m),
sc AS (SELECT a, b, jaro, jaro + (CASE
  WHEN least(length(a), length(b)) < 1 OR a[1:1] <> b[1:1] THEN 0
  WHEN least(length(a), length(b)) < 2 OR a[2:2] <> b[2:2] THEN 1
  WHEN least(length(a), length(b)) < 3 OR a[3:3] <> b[3:3] THEN 2
  WHEN least(length(a), length(b)) < 4 OR a[4:4] <> b[4:4] THEN 3 ELSE 4 END) * 0.1::DOUBLE * (1 - jaro) AS jw FROM j)
SELECT {select} FROM {outer} JOIN sc ON {on}"""


def _names_sql(select: str, where: str = "", pattern: str = PATTERN, a: str = "p_name", b: str = "") -> str:
    b = b or f"'{pattern}'"
    return _JARO.format(pairs=f"SELECT {a} AS a, {b} AS b FROM part", select=select, outer="part", on=f"sc.a = {a} AND sc.b = {b}") + (f" WHERE {where}" if where else "")


def _scored(t, build, name="score"):
    return with_distinct_value(t("part").select("p_partkey", "p_name"), "p_name", name, build)


@query(f"SELECT p_partkey, levenshtein(p_name, '{PATTERN}') AS distance FROM part")
def levenshtein(t):
    return _scored(t, lambda c: sim.levenshtein(c, F.lit(PATTERN)), "distance").select("p_partkey", F.col("distance").cast("long").alias("distance"))


@query(f"SELECT p_partkey, round(1 - levenshtein(p_name, '{PATTERN}')::DOUBLE / greatest(length(p_name), length('{PATTERN}')), 9) AS score FROM part")
def norm_levenshtein(t):
    return _scored(t, lambda c: sim.normalized_levenshtein(c, F.lit(PATTERN))).select("p_partkey", F.round("score", 9).alias("score"))


@query(_names_sql("p_partkey, round(jaro, 9) AS score"))
def jaro(t):
    return _scored(t, lambda c: sim.jaro(c, F.lit(PATTERN))).select("p_partkey", F.round("score", 9).alias("score"))


@query(_names_sql("p_partkey, round(jw, 9) AS score"))
def jaro_winkler(t):
    return _scored(t, lambda c: sim.jaro_winkler(c, F.lit(PATTERN))).select("p_partkey", F.round("score", 9).alias("score"))


@query(f"SELECT p_partkey, levenshtein(lower(p_name), lower('{PATTERN.upper()}')) AS distance FROM part")
def levenshtein_ci(t):
    return _scored(t, lambda c: sim.levenshtein_ci(c, F.lit(PATTERN.upper())), "distance").select("p_partkey", F.col("distance").cast("long").alias("distance"))


@query(_names_sql("p_partkey, round(jw, 9) AS score", a="lower(p_name)"))
def jaro_winkler_ci(t):
    return _scored(t, lambda c: sim.jaro_winkler_ci(F.upper(c), F.lit(PATTERN.upper()))).select("p_partkey", F.round("score", 9).alias("score"))


@query(_names_sql("p_partkey, jw >= 0.8 AS by_winkler, 1 - levenshtein(p_name, 'blue rign')::DOUBLE / greatest(length(p_name), 9) >= 0.5 AS by_edits"))
def is_similar(t):
    both = lambda c: F.struct(sim.is_similar(c, F.lit(PATTERN)).alias("w"), sim.is_similar(c, F.lit(PATTERN), 0.5, "levenshtein").alias("e"))
    return _scored(t, both).select("p_partkey", F.col("score.w").alias("by_winkler"), F.col("score.e").alias("by_edits"))


@query(_names_sql("p_partkey, p_name, round(jw, 9) AS score", a="coalesce(p_name, '')"))
def fuzzy_score(t):
    return _scored(t, lambda c: sim.score(c, F.lit(PATTERN))).select("p_partkey", "p_name", F.round("score", 9).alias("score"))


@query(_names_sql("p_partkey, p_name, round(jw, 9) AS score", "jw >= 0.85"))
def fuzzy_like_jw(t):
    # names that a bound from lengths rules out never get a score
    name, pattern = F.col("p_name"), F.lit(PATTERN)
    possible = t("part").select("p_name").distinct().where(sim.upper_bound(name, pattern) + 1e-9 >= 0.85)
    found = possible.select("p_name", F.explode(F.filter(F.array(sim.jaro_winkler(name, pattern)), lambda s: s >= 0.85)).alias("score"))
    return t("part").select("p_partkey", "p_name").join(found, "p_name").select("p_partkey", "p_name", F.round("score", 9).alias("score"))


@query(f"SELECT p_partkey, p_name FROM part WHERE 1 - levenshtein(p_name, '{PATTERN}')::DOUBLE / greatest(length(p_name), length('{PATTERN}')) >= 0.6")
def fuzzy_like_lev(t):
    return t("part").where(p.fuzzy_like(F.col("p_name"), PATTERN, 0.6, "levenshtein")).select("p_partkey", "p_name")


@query(_names_sql("DISTINCT p_name, round(jw, 9) AS score") + " ORDER BY score DESC, p_name LIMIT 10")
def fuzzy_topk(t):
    names = t("part").select("p_name").distinct()
    return names.select("p_name", F.round(sim.jaro_winkler(F.col("p_name"), F.lit(PATTERN)), 9).alias("score")).orderBy(F.desc("score"), "p_name").limit(10)


@query(_names_sql("p_partkey, p_name", "jw >= 0.85 AND p_size > 10"))
def sql_fuzzy(t):
    part = t("part")
    sim.register(part.sparkSession)
    text = f"SELECT p_partkey, p_name FROM {{part}} WHERE p_size > 10 AND p_name FUZZY LIKE '{PATTERN}' WITH THRESHOLD 0.85"
    return part.sparkSession.sql(dialect.parse(text), part=part)


# ---- confidence


def _veracity(name: str, op: str, threshold: float) -> None:
    def build(t):
        return lineitem(t).where(p.veracity(op, threshold)).select("l_orderkey", "l_linenumber", F.round(F.col(p.VERACITY).cast("double"), 6).alias("veracity"))

    near = f"abs({_V} - CAST({threshold} AS DOUBLE)) < 0.0001"
    test = {"=": near, "<>": f"NOT ({near})"}.get(op, f"{_V} {op} CAST({threshold} AS DOUBLE)")
    build.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, round({_V}, 6) AS veracity FROM lineitem WHERE {test}")(build)


for _name, _op, _t in (("veracity_gt", ">", 0.95), ("veracity_ge", ">=", 0.9), ("veracity_lt", "<", 0.93), ("veracity_le", "<=", 0.92), ("veracity_eq", "=", 0.95), ("veracity_ne", "<>", 0.95)):
    _veracity(_name, _op, _t)


@query("SELECT l_orderkey, l_linenumber, round(CAST(CAST(greatest(0, least(1, 1.5 - l_discount * 20)) AS FLOAT) AS DOUBLE), 5) AS veracity FROM lineitem")
def veracity_clamp(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(veracity.clamp(1.5 - F.col("l_discount") * 20).cast("double"), 5).alias("veracity"))


@query(f"SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_quantity, round(min({_V}), 6) AS min_veracity FROM lineitem GROUP BY l_returnflag")
def veracity_group_by(t):
    out = veracity.summary(lineitem(t), "l_returnflag", "l_quantity")
    return out.select("l_returnflag", F.round("avg_l_quantity", 6).alias("avg_quantity"), F.round(F.col("min_veracity").cast("double"), 6).alias("min_veracity"))


# ---- tables


def _tables(t) -> tuple[Tables, SparkSession]:
    spark = t("region").sparkSession
    return Tables(spark, scratch(spark)), spark


@query("SELECT * FROM (VALUES (3, 'Heron', 31, 1.0::DOUBLE), (5, 'Otter', 18, 0.9::DOUBLE)) AS v(id, name, length, veracity)")
def insert_values(t):
    tables, spark = _tables(t)
    tables.create("boats", "id int, name string, length int")
    tables.insert("boats", spark.sql("VALUES (3, 'Heron', 31)"))
    tables.insert("boats", spark.sql("VALUES (5, 'Otter', 18)"), v=0.9)
    return tables.read("boats").select("id", "name", "length", F.round(F.col(p.VERACITY).cast("double"), 6).alias("veracity"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, 0.75::DOUBLE AS veracity FROM lineitem WHERE l_quantity > 40")
def insert_select(t):
    tables, _ = _tables(t)
    tables.create("large", "l_orderkey long, l_linenumber int, l_quantity double")
    tables.insert("large", lineitem(t).where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity", p.VERACITY), v=0.75)
    return tables.read("large").select("l_orderkey", "l_linenumber", "l_quantity", F.col(p.VERACITY).cast("double").alias("veracity"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_where(t):
    tables, _ = _tables(t)
    rows = t("customer").select("c_custkey", "c_name", "c_acctbal")
    tables.create("customers", rows.schema)
    tables.insert("customers", rows)
    tables.delete("customers", F.col("c_acctbal") < 0)
    return tables.read("customers").drop(p.VERACITY)


@query("SELECT * FROM (VALUES ('a', 'id,name,__veracity__', 'by_id'), ('b', 'x,__veracity__', NULL)) AS v(name, columns, index_name)")
def ddl_catalog(t):
    tables, spark = _tables(t)
    for name, schema in (("a", "id int, name varchar(50)"), ("b", "x double"), ("c", "y int")):
        tables.create(name, schema)
    tables.create_index("by_id", "a", "id")
    tables.create_index("by_y", "c", "y")
    tables.drop("c")
    by_table = {table: index for index, (table, _) in tables.indexes.items()}
    return spark.createDataFrame([(n, ",".join(tables.schema(n).names), by_table.get(n)) for n in tables.names()], "name string, columns string, index_name string")


# ---- statements of the dialect


def _engine(t) -> Engine:
    spark = t("region").sparkSession
    return Engine(spark, scratch(spark))


@query("SELECT * FROM (VALUES (7, 'Lyon', 0.5::DOUBLE, 1.0::DOUBLE), (8, 'Graz', NULL, 1.0::DOUBLE), (9, 'Faro', 2.5::DOUBLE, 0.4::DOUBLE)) AS v(code, town, height, veracity)")
def sql_create_insert(t):
    db = _engine(t)
    db.sql("CREATE TABLE towns (code INT, town VARCHAR(20), height DOUBLE)")
    db.sql("INSERT INTO towns VALUES (7, 'Lyon', 0.5)")
    db.sql("INSERT INTO towns (town, code) VALUES ('Graz', 8)")
    db.sql("INSERT INTO towns VALUES (9, 'Faro', 2.5) VERACITY 0.4")
    return db.sql("SELECT code, town, height, round(CAST(__veracity__ AS DOUBLE), 6) AS veracity FROM towns")


def _orders(t) -> Engine:
    """An engine with some of the orders, those of the second half less certain."""
    db = _engine(t)
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    db.tables.create("purchases", rows.schema)
    db.tables.insert("purchases", rows, v=F.when(F.col("o_orderkey") % 4 < 2, 1.0).otherwise(0.25))
    return db


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sql_select_star(t):
    return _orders(t).sql("SELECT * FROM purchases WHERE o_orderstatus = 'F'")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 < 2 AND o_totalprice > 1000")
def sql_veracity(t):
    return _orders(t).sql("SELECT o_orderkey FROM purchases WHERE __veracity__ > 0.5 AND o_totalprice > 1000")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS price, min(CASE WHEN o_orderkey % 4 < 2 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS veracity FROM orders GROUP BY o_orderstatus")
def sql_group_by(t):
    return _orders(t).sql("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS price, CAST(min(__veracity__) AS DOUBLE) AS veracity FROM purchases GROUP BY o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderkey % 4 >= 2)")
def sql_delete(t):
    db = _orders(t)
    db.sql("DELETE FROM purchases WHERE o_orderstatus = 'F'")
    db.execute("DELETE FROM purchases WHERE __veracity__ < 0.5")
    return db.sql("SELECT o_orderkey, o_custkey FROM purchases")


@query("SELECT * FROM (VALUES ('now', 'colour', 'dark blue', 3), ('then', 'colour', 'red', 1), ('field', 'size', '4', 2)) AS v(asked, key, value, seq)")
def sql_commands(t):
    db = _engine(t)
    for line in ("PUT colour red", "PUT size '{\"w\": 4}'", "PUT colour 'dark blue'", "PUT gone 1", "DEL gone"):
        db.execute(line)
    asked = {"now": "GET colour", "then": "GET colour AS OF 1", "field": "GET size w", "gone": "GET gone"}
    answers = [db.execute(line).select(F.lit(name).alias("asked"), "key", "value", F.col("seq").cast("int").alias("seq")) for name, line in asked.items()]
    return functools.reduce(DataFrame.unionByName, answers)


# ---- joins and set operations, which Spark has


@query("SELECT n_name, r_name, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def join_inner(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "s_suppkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 2000) ON o_custkey = c_custkey")
def join_left(t):
    return t("customer").join(t("orders").where("o_totalprice > 2000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def join_semi_anti(t):
    customer, on = t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")
    return customer.join(t("orders"), on, "left_semi").withColumn("buys", F.lit(True)).unionByName(customer.join(t("orders"), on, "left_anti").withColumn("buys", F.lit(False)))


@query("SELECT 'union' AS part, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'less', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier)")
def set_operations(t):
    key = lambda table, c: t(table).select(F.col(c).alias("k"))
    a, b = key("customer", "c_nationkey"), key("supplier", "s_nationkey")
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "less": key("customer", "c_custkey").subtract(key("supplier", "s_suppkey"))}
    return functools.reduce(DataFrame.union, [df.select(F.lit(name).alias("part"), "k") for name, df in parts.items()])


# ---- the key-value log


@query(f"SELECT key, value, seq FROM {_NEWEST} WHERE op = 'PUT'")
def kv_get_latest(t):
    return changelog.state(log(t))


@query(f"SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG} WHERE seq <= {AS_OF}) WHERE rn = 1 AND op = 'PUT'")
def kv_as_of(t):
    return changelog.state(log(t), AS_OF)


@query(f"SELECT key, value, seq FROM {_NEWEST} WHERE op = 'PUT' UNION ALL SELECT 'new', 'v', max(seq) + 1 FROM {_LOG}")
def kv_put(t):
    entries = log(t)
    operations = entries.sparkSession.createDataFrame([(1, "new", changelog.PUT, "v")], "n int, key string, op string, value string")
    return changelog.state(entries.unionByName(changelog.batch(entries, operations)))


@query(f"SELECT key, op = 'PUT' AS live FROM {_NEWEST}")
def kv_delete_visibility(t):
    return changelog.visibility(log(t))


@query(f"SELECT k.key, coalesce(n.op = 'PUT', false) AS found FROM (SELECT CAST(range AS VARCHAR) AS key FROM range(0, 200)) k LEFT JOIN {_NEWEST} n ON k.key = n.key")
def kv_exists(t):
    entries = log(t)
    return changelog.exists(entries, entries.sparkSession.range(200).select(F.col("id").cast("string").alias("key")))


@query(f"SELECT v.key, l.last + v.n AS seq, v.op, v.value FROM (VALUES (1, 'x', 'PUT', '1'), (2, 'y', 'PUT', '2'), (3, 'x', 'DELETE', NULL)) AS v(n, key, op, value), (SELECT max(seq) AS last FROM {_LOG}) l")
def kv_batch(t):
    entries = log(t)
    rows = [(1, "x", "PUT", "1"), (2, "y", "PUT", "2"), (3, "x", "DELETE", None)]
    return changelog.batch(entries, entries.sparkSession.createDataFrame(rows, "n int, key string, op string, value string"))


def _scan(name: str, reverse: bool) -> None:
    def build(t):
        order = F.desc("key") if reverse else F.asc("key")
        return relational.positions(changelog.range_scan(log(t), "1", "3", reverse), order).select(F.col("pos").cast("long").alias("pos"), "key", "value")

    build.__name__ = name
    query(f"SELECT row_number() OVER (ORDER BY key {'DESC' if reverse else 'ASC'}) AS pos, key, value FROM {_NEWEST} WHERE op = 'PUT' AND key >= '1' AND key < '3'")(build)


_scan("kv_range_scan", False)
_scan("kv_reverse_scan", True)


@query(f"SELECT key, seq, op, value FROM {_LOG}")
def kv_versions(t):
    return changelog.versions(log(t))


@query(f"SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}")
def kv_version_rank(t):
    return changelog.version_rank(log(t)).select("key", "seq", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT max(seq) AS snapshot_seq FROM {_LOG}")
def kv_snapshot_seq(t):
    return changelog.snapshot_seq(log(t))


@query(f"SELECT count(*) AS num_versions, count(DISTINCT key) AS num_keys, (SELECT count(*) FROM {_NEWEST} WHERE op = 'PUT') AS live_keys, CAST(sum(CASE WHEN op = 'PUT' THEN 1 ELSE 0 END) AS BIGINT) AS writes, CAST(sum(CASE WHEN op = 'PUT' THEN 0 ELSE 1 END) AS BIGINT) AS deletes FROM {_LOG}")
def kv_stats(t):
    return changelog.stats(log(t))


@query(f"""SELECT key, trim(regexp_extract(value, '"k":([^,;}}]*)', 1)) AS field_value FROM {_NEWEST} WHERE op = 'PUT'""")
def kv_field(t):
    return changelog.state(log(t)).select("key", scalars.field(F.col("value"), "k").alias("field_value"))


@query(f"SELECT key, value FROM {_NEWEST} WHERE op = 'PUT'")
def wal_replay(t):
    entries = log(t)
    base = scratch(entries.sparkSession)
    stored = Log(entries.sparkSession, f"{base}/log")
    stored.append(entries.where(f"seq <= {AS_OF}"))
    stored.append(entries.where(f"seq > {AS_OF}"))
    return changelog.state(stored.read()).select("key", "value")


@query(f"SELECT key, value, seq FROM {_NEWEST} WHERE op = 'PUT'")
def stream_fold(t):
    from plumbline.streaming import fold

    entries = log(t)
    spark = entries.sparkSession
    base = scratch(spark)
    entries.write.parquet(f"{base}/log")
    run = fold.start_fold(spark, f"{base}/log", f"{base}/state", f"{base}/progress")
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return changelog.state(fold.state_at(spark, f"{base}/state", last))


@query(f"SELECT key, value, seq FROM {_NEWEST} WHERE op = 'PUT'")
def kv_reopen(t):
    entries = log(t)
    spark = entries.sparkSession
    path = scratch(spark)
    parts = [entries.where(f"seq <= {AS_OF}"), entries.where(f"seq > {AS_OF} AND seq <= {HORIZON}"), entries.where(f"seq > {HORIZON}")]
    for n, part in enumerate(parts):
        Engine(spark, path).log.append(part)
        Engine(spark, path).execute("COMPACT" if n % 2 == 0 else "FLUSH")
    return changelog.state(Engine(spark, path, create_if_missing=False).log.read())


@query(f"SELECT key, seq, op, value FROM {_LOG} WHERE seq = {AS_OF}")
def wal_corrupt(t):
    entries = log(t)
    stored = Log(entries.sparkSession, scratch(entries.sparkSession))
    stored.append(entries.where(f"seq <> {AS_OF}"))
    # an entry as it would be with a damaged checksum
    stored._stored(entries.where(f"seq = {AS_OF}")).withColumn("crc", F.col("crc").bitwiseXOR(F.lit(1))).write.mode("append").parquet(stored.path)
    return stored.corrupt()


@query(f"SELECT key, seq, op, value FROM {_LOG} WHERE seq >= {MIN_SEQ}")
def wal_retention(t):
    return changelog.retained(log(t), MIN_SEQ)


@query(f"SELECT seq, CASE WHEN op = 'PUT' THEN 'PUT' ELSE 'DEL' END AS type, key, CASE WHEN op = 'PUT' THEN value ELSE '<deleted>' END AS val FROM {_LOG}")
def wal_dump(t):
    return changelog.dump(log(t))


@query(f"SELECT CASE WHEN seq <= {AS_OF} THEN 1 ELSE 2 END AS run, key, value FROM {_LOG}")
def merge_runs(t):
    entries = log(t)
    runs = [entries.where(w).select(F.lit(n).alias("run"), "key", "value") for n, w in ((1, f"seq <= {AS_OF}"), (2, f"seq > {AS_OF}"))]
    return relational.merge_runs(*runs, order=["key", "run"])


@query(f"SELECT key, seq, value FROM {_NEWEST} WHERE op = 'PUT'")
def compact_latest(t):
    entries = log(t)
    stored = Log(entries.sparkSession, scratch(entries.sparkSession))
    small = stored.rewrite(changelog.compacted(entries), f"{stored.path}-compacted")
    return changelog.state(small.read()).select("key", "seq", "value")


@query(f"SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG} WHERE seq <= {HORIZON + 1000}) WHERE rn = 1 AND op = 'PUT'")
def compact_horizon(t):
    return changelog.state(changelog.compacted(log(t), HORIZON), HORIZON + 1000)


# ---- scalars


@query("SELECT c_custkey, printf('%.6f', c_acctbal) AS balance, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 'NULL' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS positive FROM customer")
def value_to_string(t):
    from pyspark.sql import types as T

    return t("customer").select(
        "c_custkey",
        scalars.value_to_string(F.col("c_acctbal"), T.DoubleType()).alias("balance"),
        scalars.value_to_string(F.col("c_nationkey"), T.IntegerType()).alias("nation"),
        scalars.value_to_string(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), T.StringType()).alias("segment"),
        scalars.value_to_string(F.col("c_acctbal") > 0, T.BooleanType()).alias("positive"),
    )


@query()
def crc32(t):
    return t("part").select("p_partkey", scalars.crc32(F.col("p_name")).alias("crc"))


@query("SELECT c_custkey, substring(c_name, 10) AS tail, substring(c_name, 1, 8) AS head, ends_with(c_name, '7') AS seven FROM customer")
def slice_ops(t):
    name = F.col("c_name")
    return t("customer").select("c_custkey", scalars.remove_prefix(name, 9).alias("tail"), scalars.truncate(name, 8).alias("head"), name.endswith("7").alias("seven"))
