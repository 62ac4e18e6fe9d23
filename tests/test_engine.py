"""Tables, SQL, the log and its states, procedures and commands."""

import random

import pytest

from plumbline.engine import Engine
from plumbline.errors import AlreadyExists, Corruption, InvalidArgument, NotFound, NotSupported
from plumbline.operators import changelog
from plumbline.plans import dialect
from plumbline.sources.logs import Log
from plumbline.streaming import fold


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_statements(engine):
    engine.sql("CREATE TABLE boats (id INTEGER, name VARCHAR(30), length DOUBLE)")
    engine.sql("INSERT INTO boats VALUES (3, 'Heron', 31.5)")
    engine.sql("INSERT INTO boats (name, id) VALUES ('Kingfisher', 4) VERACITY 0.3")
    assert rows(engine.sql("SELECT * FROM boats WHERE name FUZZY LIKE 'Kingfishr' WITH THRESHOLD 0.9")) == [(4, "Kingfisher", None)]
    assert rows(engine.sql("SELECT name FROM boats WHERE __veracity__ > 0.5")) == [("Heron",)]
    assert rows(engine.sql("SELECT length IS NULL, MAX(__veracity__) < 0.5 FROM boats GROUP BY 1")) == [(False, False), (True, True)]
    assert rows(engine.sql("DELETE FROM boats WHERE length > 30")) == [(1,)]
    assert rows(engine.sql("SELECT * FROM boats")) == [(4, "Kingfisher", None)]
    assert not engine.spark.catalog.tableExists("boats")
    with pytest.raises(AlreadyExists):
        engine.sql("CREATE TABLE boats (id INT)")
    with pytest.raises(InvalidArgument):
        engine.sql("INSERT INTO boats VALUES (1)")
    with pytest.raises(NotFound):
        engine.tables.read("nothing")


def test_reopened(spark, tmp_path):
    path = f"file://{tmp_path}/again"
    db = Engine(spark, path, error_if_exists=True)
    db.sql("CREATE TABLE x (y INT)")
    db.tables.create_index("by_y", "x", "y")
    db.put("a", "1")
    db.put("a", "2")
    db.delete("b")
    db.compact()
    assert db.put("b", "3") == 4
    db = Engine(spark, path, create_if_missing=False)
    assert rows(db.scan()) == [("a", "2"), ("b", "3")] and db.snapshot() == 4
    assert db.tables.indexes == {"by_y": ("x", "y")} and db.tables.names() == ["x"]
    db.delete("b")
    db.compact()  # nothing of numbers 3 to 5 is left
    db = Engine(spark, path)
    assert db.snapshot() == 5 and db.put("c", "4") == 6
    db.execute("FLUSH")
    db.compact()
    assert rows(Engine(spark, path).scan()) == [("a", "2"), ("c", "4")]
    with pytest.raises(AlreadyExists):
        Engine(spark, path, error_if_exists=True)
    with pytest.raises(NotFound):
        Engine(spark, f"{path}-not", create_if_missing=False)


def test_corrupt_entries_are_found(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    log.append(spark.createDataFrame([("a", 1, "PUT", "x"), ("a", 2, "PUT", ""), ("b", 3, "DELETE", None)], changelog.SCHEMA))
    log.verify()
    assert log.read().count() == 3
    spark.createDataFrame([("b", 4, "PUT", "y", 7)], f"{changelog.SCHEMA}, crc bigint").write.mode("append").parquet(log.path)
    assert rows(log.corrupt()) == [("b", 4, "PUT", "y")]
    with pytest.raises(Corruption):
        log.verify()
    with pytest.raises(Exception, match="corrupt log entry at 4"):
        changelog.state(log.read()).collect()


def test_a_key_skips_row_groups(spark, tmp_path):
    entries = spark.range(40000).selectExpr("lpad(CAST(id AS STRING), 9, '0') AS key", "id + 1 AS seq", "'PUT' AS op", "repeat('v', 50) AS value")
    log = Log(spark, f"file://{tmp_path}/log")
    small = log.rewrite(entries, f"file://{tmp_path}/sorted")
    found = changelog.get(small.read(), "000012345")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,000012345)" in plan
    scan = small.read().where("key = '000012345'")
    scan.collect()
    whole = [n for n in _scanned(scan)]
    assert whole and max(whole) < 40000


def _scanned(df):
    """Rows that each scan of a DataFrame's plan, once run, has read."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            yield node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        todo += [node.children().apply(k) for k in range(node.children().size())]


def test_fold_rewrites_the_parts_of_its_keys(spark, tmp_path):
    source, target = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    log = Log(spark, source)
    for n in range(12):
        log.append(spark.createDataFrame([("same", 2 * n + 1, "PUT", str(n)), (f"k{n}", 2 * n + 2, "PUT" if n % 3 else "DELETE", str(n) if n % 3 else None)], changelog.SCHEMA))
        run = fold.start_fold(spark, source, target, f"{tmp_path}/progress", keep=2)
        run.awaitTermination()
        last = run.lastProgress["batchId"]
        assert rows(changelog.state(fold.state_at(spark, target, last))) == rows(changelog.state(log.read()))
    versions = fold._versions(spark, target)[1]
    assert len(versions) < 12 * 2 + 1 and len({v for v, p, _ in versions if p == versions[0][1]}) <= 3 + 1


def test_insert_select_sets_its_own_confidence(engine):
    engine.sql("CREATE TABLE a (x INT)")
    engine.sql("CREATE TABLE b (x INT)")
    engine.sql("INSERT INTO a VALUES (1), (2) VERACITY 0.5")
    engine.sql("INSERT INTO b SELECT x FROM a WHERE __veracity__ < 0.6 VERACITY 7")
    assert rows(engine.sql("SELECT x, __veracity__ FROM b")) == [(1, 1.0), (2, 1.0)]
    engine.tables.create_index("i", "b", "x")
    engine.tables.cluster_by("i")
    assert engine.tables.drop("b") and not engine.tables.drop("b") and engine.tables.indexes == {}


def test_rewriting_leaves_text_alone():
    text = "SELECT 'a FUZZY LIKE b' /* FUZZY LIKE 'x' */ FROM t -- FUZZY LIKE 'y'"
    assert dialect.rewrite_fuzzy(text) == text
    assert dialect.rewrite_fuzzy("WHERE t.name FUZZY LIKE 'it''s' WITH THRESHOLD 0.9 USING levenshtein AND x") == "WHERE fuzzy_like(t.name, 'it''s', CAST(0.9 AS DOUBLE), 'levenshtein') AND x"
    assert "fuzzy_like(upper(a), 'B'" in dialect.rewrite_fuzzy("select 1 where (upper(a) FUZZY LIKE 'B')")
    with pytest.raises(ValueError):
        dialect.rewrite_fuzzy("SELECT a FUZZY LIKE 'x' WITH THRESHOLD high")


def test_commands(engine):
    assert engine.execute("PING") == "PONG" and engine.execute("PUT k 'v 1'") == 1
    engine.execute('SET j \'{"name": "Al", "age": 3}\'')
    engine.execute("DEL k")
    assert rows(engine.execute("GET k")) == [] and rows(engine.execute("GET k AS OF 1")) == [("k", "v 1", 1)]
    assert rows(engine.execute("GET j age")) == [("j", "3", 2)] and rows(engine.execute("GET j none")) == []
    assert engine.execute("EXISTS j") == 1 and engine.snapshot() == 3
    assert engine.execute("COMPACT") == "OK" and rows(engine.scan()) == [("j", '{"name": "Al", "age": 3}')]
    assert engine.put("k", "again") == 4
    with pytest.raises(InvalidArgument):
        engine.execute("NOPE")


def test_procedures(engine):
    def rename(db, old, new):
        value = db.get(old).first()
        if value is None:
            raise KeyError(old)
        db.write([(changelog.PUT, new, value.value), (changelog.DELETE, old, None)])
        return value.value

    engine.register("rename", rename)
    engine.put("from", "v")
    assert engine.call("rename", old="from", new="to") == "v" and rows(engine.scan()) == [("to", "v")]
    with pytest.raises(InvalidArgument, match="KeyError"):
        engine.call("rename", old="none", new="x")
    with pytest.raises(NotFound):
        engine.call("none")
    engine.reset()
    with pytest.raises(NotFound):
        engine.call("rename", old="to", new="x")
    engine.enable_python = False
    with pytest.raises(NotSupported):
        engine.call("rename")


def test_states_at_every_sequence_number(spark):
    r = random.Random(3)
    entries = [(f"k{r.randrange(6)}", n, r.choice(["PUT", "PUT", "DELETE"]), f"v{n}") for n in range(1, 31)]
    log = spark.createDataFrame([(k, n, op, v if op == "PUT" else None) for k, n, op, v in entries], changelog.SCHEMA).cache()
    kept = changelog.compacted(log, 15).cache()
    for seq in range(1, 31):
        want = {}
        for k, n, op, v in entries[:seq]:
            want.pop(k, None)
            if op == "PUT":
                want[k] = (v, n)
        assert {x.key: (x.value, x.seq) for x in changelog.state(log, seq).collect()} == want
        if seq >= 15:
            assert {x.key: (x.value, x.seq) for x in changelog.state(kept, seq).collect()} == want


def test_empty_log(spark):
    log = changelog.empty(spark)
    assert changelog.state(log).count() == 0
    assert tuple(changelog.stats(log).first()) == (0, 0, 0, 0, 0) and changelog.snapshot_seq(log).first()[0] == 0
