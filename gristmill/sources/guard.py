"""Checks of ad-hoc SQL by what it parses to: only listed kinds of plan nodes, relations and functions pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: Nodes of parsed queries that only read.
PLAN_NODES = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "WithWindowDefinition",
    "UnresolvedHaving", "Window", "Generate", "Pivot", "Unpivot", "UnresolvedPivot", "LateralJoin", "UnresolvedTableValuedFunction", "UnresolvedOrderBy",
    "LocalRelation", "AsOfJoin", "ExplainCommand", "UnresolvedTVFAliases", "Sample", "UnresolvedHint", "ResolvedInlineTable",
}
#: Groups of built-in functions that pass, as Spark documents them; ``misc_funcs`` call into the JVM, read settings or stop a query.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "date_funcs", "datetime_funcs", "generator_funcs",
    "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs",
    "window_funcs", "xml_funcs", "table_funcs",
}
#: Functions of other groups that pass.
MORE_FUNCTIONS = {"typeof", "equal_null", "uuid", "monotonically_increasing_id", "bitmap_bucket_number", "bitmap_bit_position", "bitmap_count"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    for k in range(sequence.size()):
        yield sequence.apply(k)


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _parsed(spark: SparkSession, text: str, what: str) -> JavaObject:
    if re.search(r"--|/\*", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text)):
        raise ValueError("comments are not allowed")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return getattr(parser, what)(text)
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"not to be parsed: {str(e).strip().splitlines()[0][:200]}") from e


def _check_function(spark: SparkSession, parts: list[str], allowed: set[str]) -> None:
    name = ".".join(parts).lower()
    if name in allowed or name in MORE_FUNCTIONS:
        return
    jvm = spark._jvm
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)) if len(parts) == 1 else None
    # a function of the session may have the name of a built-in one, so the class must be Spark's
    if found is None or found.isEmpty() or found.get().getGroup() not in FUNCTION_GROUPS or not found.get().getClassName().startswith("org.apache.spark.sql.catalyst."):
        raise ValueError(f"the function {name} is not allowed")


def _walk(spark: SparkSession, node: JavaObject, tables: set[str], functions: set[str], with_plans: bool) -> None:
    """Checks a plan or expression and all below it; ``tables`` are names that common table expressions give."""
    held, instance_of = [(node, tables)], spark._jvm.py4j.reflection.TypeUtil.isInstanceOf
    while held:
        node, names = held.pop()
        kind = _kind(node)
        if instance_of("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", node):
            if not with_plans:
                raise ValueError("a condition has no queries")
            if kind not in PLAN_NODES:
                raise ValueError(f"{kind} is not allowed")
            if kind == "ExplainCommand":
                held.append((node.logicalPlan(), names))
            if kind == "UnresolvedWith":
                names = names | {c._1().lower() for c in _items(node.cteRelations())}
            if kind == "UnresolvedRelation":
                parts = list(_items(node.multipartIdentifier()))
                name = ".".join(parts)
                if not (len(parts) == 1 and name.lower() in names) and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                    raise ValueError(f"{name} is no table or view")
            if kind == "UnresolvedTableValuedFunction":
                name = ".".join(_items(node.name())).lower()
                if name not in TABLE_FUNCTIONS | functions:
                    raise ValueError(f"the function {name} is not allowed")
            held += [(x, names) for x in _items(node.expressions())]
        elif instance_of("org.apache.spark.sql.catalyst.expressions.PlanExpression", node):
            held.append((node.plan(), names))
        elif kind == "UnresolvedFunction":
            _check_function(spark, list(_items(node.nameParts())), functions)
        elif kind == "UnresolvedGenerator":
            _check_function(spark, [node.name().funcName()], functions | TABLE_FUNCTIONS)
        elif "UnresolvedIdentifier" in kind or "Reflect" in kind:
            raise ValueError(f"{kind} is not allowed")
        held += [(x, names) for x in [*_items(node.children()), *_items(node.innerChildren())] if x is not None]


def check_query(spark: SparkSession, statement: str, functions: tuple[str, ...] = ()) -> None:
    """An error unless a statement is one query that only reads tables and views of the catalog by built-in functions.

    Commands, scripts, files as tables, calls into the JVM, functions of the
    session (but ``functions``) and names that are made up at run time are refused; what
    words a query has doesn't matter. The statement is parsed, not run.
    """
    _walk(spark, _parsed(spark, statement, "parsePlan"), set(), {f.lower() for f in functions}, True)


def check_condition(spark: SparkSession, condition: str, functions: tuple[str, ...] = ()) -> None:
    """An error unless a text is one expression of columns and built-in functions, without queries."""
    _walk(spark, _parsed(spark, condition, "parseExpression"), set(), {f.lower() for f in functions}, False)
