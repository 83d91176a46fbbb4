"""Read-only SQL over the annotation tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lamella.sources.tables import SCHEMAS, read_annotations, read_table

VIEWS = tuple(SCHEMAS)


def register_views(spark: SparkSession, root: str, names: tuple[str, ...] = VIEWS) -> None:
    """Temporary views of the tables below ``root``."""
    spatial = read_annotations(spark, root)
    for name in names:
        df = spatial[name] if name in spatial else read_table(spark, root, name)
        df.createOrReplaceTempView(name)


#: Leaves of an analysed plan that read nothing: constants, and references to a common table
#: expression, whose definition is part of the plan.
HARMLESS = {"OneRowRelation", "LocalRelation", "CTERelationRef"}
#: Expressions that call Java methods by name.
REFLECTIVE = {"CallMethodViaReflection", "TryReflect", "Invoke", "StaticInvoke"}


def _seq(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    """All expressions of one plan node, subexpressions included."""
    todo = _seq(node.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _seq(e.children())


def _nodes(plan, closed: Callable[[object], bool] = lambda node: False) -> Iterator:
    """All nodes of a plan, those of subqueries and common table expressions included.

    What lies below a ``closed`` node is left out.
    """
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if not closed(node):
            todo += _seq(node.children()) + _seq(node.subqueries())
            if _kind(node) == "UnresolvedWith":
                todo += _seq(node.innerChildren())


def query(spark: SparkSession, sql: str, views: Iterable[str] = VIEWS) -> DataFrame:
    """Run a query on the views.

    The text is used as a subquery, where Spark's grammar has no place for commands, so
    a statement that would change or drop anything does not parse. Names that are computed
    while the query is analysed are refused before that. Every leaf of the analysed plan
    then has to be one of the views, a constant, or a reference to a common table
    expression, so neither files nor other tables nor table functions can be read, however
    they are named; expressions that call Java methods are refused, and nothing of the
    query has run by then.
    """
    text = f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)"
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for node in _nodes(parsed):
        if any("UnresolvedIdentifier" in _kind(x) for x in (node, *_expressions(node))):
            raise PermissionError("the query computes a name")
    try:
        out = spark.sql(text)
    except AnalysisException as e:
        if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
            raise PermissionError("the query reads a table that is no view") from e
        raise
    known = {v.lower() for v in views}

    def is_view(node) -> bool:
        if _kind(node) != "View" or not node.isTempView():
            return False
        name = node.desc().identifier()
        return name.database().isEmpty() and name.table().lower() in known

    for node in _nodes(out._jdf.queryExecution().analyzed(), is_view):
        if not node.children().size() and not is_view(node) and _kind(node) not in HARMLESS:
            raise PermissionError(f"the query reads {node.simpleString(25)}, which is no view")
        if any(_kind(e) in REFLECTIVE for e in _expressions(node)):
            raise PermissionError("the query calls a Java method")
    return out


def run_sql(sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run a query on the given tables, registered as views under their names."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return query(spark, sql, tables)
