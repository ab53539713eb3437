from __future__ import annotations

import pytest

from gristmill.sources import tables

GOOD = [
    "SELECT 'drop; it -- now' AS x;", "select replace('a', 'a', 'b') as `update`", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (x)",
    "SELECT g_k, count(*) OVER (PARTITION BY g_k) AS n, row_number() OVER (ORDER BY g_v DESC) FROM guard_rows WHERE g_v IN (SELECT max(g_v) FROM guard_rows) LIMIT 3",
    "EXPLAIN SELECT 1", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y) WHERE EXISTS (SELECT 1 FROM guard_rows WHERE g_k = t.x)",
    "SELECT x FROM guard_rows LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT * FROM range(3)", "SELECT g_k FROM guard_rows UNION ALL SELECT 1 EXCEPT SELECT 2 ORDER BY 1",
    "SELECT transform(array(1, 2), x -> x + g_v) FROM guard_rows", "SELECT * FROM (SELECT g_k, g_v FROM guard_rows) PIVOT (sum(g_v) FOR g_k IN (1, 2))",
    "SELECT cast(current_date() AS string), CASE WHEN g_k > 1 THEN sha2('a', 256) END FROM guard_rows GROUP BY ALL HAVING count(*) > 0",
]
BAD = [
    "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT /* x */ 1", "WITH a AS (SELECT 1) INSERT INTO b SELECT 1", "EXPLAIN DROP TABLE x", "EXPLAIN INSERT INTO b SELECT 1",
    "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT try_reflect('java.util.UUID', 'randomUUID')",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM text.`/etc/passwd`", "WITH a AS (SELECT * FROM csv.`/x`) SELECT 1", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)",
    "SELECT 1 WHERE EXISTS (SELECT * FROM json.`/x`)", "SELECT input_file_name() FROM guard_rows", "SELECT raise_error('x')", "SELECT current_user()", "SELECT guard_twice(1)",
    "SELECT TRANSFORM(g_k) USING 'cat' AS (x) FROM guard_rows", "SELECT * FROM no_such_table", "SELECT * FROM IDENTIFIER('guard_' || 'rows')", "SELECT", "", "SHOW TABLES",
    "SELECT * FROM guard_rows WHERE g_k = (SELECT reflect('a', 'b'))", "SELECT upper(x -> java_method('a', 'b', x))", "WITH a AS (SELECT 1) SELECT * FROM A, b",
]


@pytest.fixture(scope="module")
def session(spark):
    spark.createDataFrame([(1, 2), (2, 3)], "g_k int, g_v int").createOrReplaceTempView("guard_rows")
    spark.udf.register("guard_twice", lambda x: 2 * x, "int")
    return spark


@pytest.mark.parametrize("statement", GOOD)
def test_queries_that_read_pass(session, statement):
    tables.query(session, statement).collect()


@pytest.mark.parametrize("statement", BAD)
def test_others_are_refused(session, statement):
    with pytest.raises(ValueError):
        tables.read_only(session, statement)


def test_conditions(session):
    df = session.table("guard_rows")
    for good in ("g_k = 1 and replace('a;', ';', '--') = 'a--'", "g_v between 2 and 3 or g_k is null", "g_k in (1, 2)"):
        assert df.where(tables.safe_condition(session, good)).count() > 0
    for bad in ("g_k = 1; drop table x", "g_k in (select 1)", "exists (select 1)", "java_method('a', 'b') = 1", "g_k = 1 -- x", "", "guard_twice(1) = 2"):
        with pytest.raises(ValueError):
            tables.safe_condition(session, bad)


def test_parameters_and_names_of_built_in_functions(session):
    assert tables.query(session, "SELECT g_v FROM guard_rows WHERE g_k = :k", k=2).collect() == [(3,)]
    other = session.newSession()
    other.udf.register("upper", lambda x: x, "string")  # hides the built-in one, in this session only
    with pytest.raises(ValueError, match="upper"):
        tables.read_only(other, "SELECT upper('a')")
    assert tables.query(session, "SELECT upper('a')").first()[0] == "A"
