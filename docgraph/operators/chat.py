"""Questions as guarded SQL over the graph's views."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsafeQuery
from ..providers import Answerer, QueryWriter
from . import graph

#: Logical nodes that only read; anything else (commands, inserts, DDL, scripts, table functions) is refused.
READING = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except",
    "Join", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "OneRowRelation", "UnresolvedInlineTable", "WithWindowDefinition", "Generate", "LateralJoin", "UnionLoop", "UnionLoopRef",
}
#: Leaves of an analysed plan that hold no stored data.
EMPTY_HANDED = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"}
BROADER = "Nothing was found. Compare names by contains(lower(name), ...), leave types out, and try both directions of an edge."


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName()


def _subplans(expression) -> list:
    """The plans of subqueries in an expression."""
    own = [expression.plan()] if _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery") else []
    return own + [p for c in _seq(expression.children()) for p in _subplans(c)]


def _no_calls(expression) -> None:
    if _kind(expression) == "UnresolvedFunction" and _seq(expression.nameParts())[-1].lower() in ("reflect", "java_method", "try_reflect"):
        raise UnsafeQuery("calls into the JVM are not allowed")
    for child in _seq(expression.children()):
        _no_calls(child)


def _check_parsed(plan, prefix: str, scope: frozenset[str] = frozenset()) -> None:
    """``scope``: names of the CTEs that are visible here; a definition sees those before it, its own if it is recursive."""
    kind = _kind(plan)
    if kind not in READING:
        raise UnsafeQuery(f"{kind} is not allowed; write a single SELECT")
    if kind == "UnresolvedRelation":
        parts = [str(x).lower() for x in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or not (parts[0] in scope or parts[0].startswith(prefix)):
            raise UnsafeQuery(f"only {prefix}* views can be read, not {'.'.join(parts)}")
    if kind == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            name = str(pair._1()).lower()
            _check_parsed(pair._2(), prefix, scope | {name} if plan.allowRecursion() else scope)
            scope = scope | {name}
    for e in _seq(plan.expressions()):
        _no_calls(e)
        for p in _subplans(e):
            _check_parsed(p, prefix, scope)
    for child in _seq(plan.children()):
        _check_parsed(child, prefix, scope)


def _check_analysed(plan, prefix: str) -> None:
    """Stored data is reached through temporary views named ``prefix``... alone, whatever names resolved to."""
    if _kind(plan) == "View":
        name = plan.desc().identifier()
        if name.database().isEmpty() and name.table().lower().startswith(prefix):
            return
    for e in _seq(plan.expressions()):
        for p in _subplans(e):
            _check_analysed(p, prefix)
    children = _seq(plan.children())
    if not children and _kind(plan) not in EMPTY_HANDED:
        raise UnsafeQuery(f"the query reads {_kind(plan)} outside the {prefix}* views")
    for child in children:
        _check_analysed(child, prefix)


def guard(spark: SparkSession, sql: str, prefix: str = "kg_") -> DataFrame:
    """The query, unless it is not one that reads only views named ``prefix``... and its own CTEs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise UnsafeQuery(f"not a query: {str(e).splitlines()[0]}") from e
    _check_parsed(plan, prefix)
    df = spark.sql(sql)
    _check_analysed(df._jdf.queryExecution().analyzed(), prefix)
    return df


def run_guarded(spark: SparkSession, sql: str, limit: int = 1000) -> list[dict]:
    return [r.asDict(recursive=True) for r in guard(spark, sql).limit(limit).collect()]


def schema_text(spark: SparkSession, entities: DataFrame, edges: DataFrame) -> str:
    """What the graph holds, for a query writer: views with their columns, labels, types, properties, and sample facts."""
    names = graph.catalog(entities, edges).orderBy("kind", "name").collect()
    views = [t.name for t in spark.catalog.listTables() if t.name.startswith("kg_")]
    columns = [f"- {v}({', '.join(c.name for c in spark.catalog.listColumns(v))})" for v in sorted(views)]
    samples = graph.facts(edges, entities).orderBy("source", "relationship", "target").limit(30).collect()
    listed = lambda kind: ", ".join(r["name"] for r in names if r["kind"] == kind)
    lines = ["VIEWS", *columns, f"ENTITY TYPES: {listed('label')}", f"PREDICATES: {listed('relationship')}", f"PROPERTIES: {listed('property')}", "A FEW FACTS"]
    return "\n".join(lines + [f"- {s['source']} | {s['relationship']} | {s['target']}" for s in samples])


def entity_text(question: str, entities: DataFrame, edges: DataFrame) -> str:
    """Entities that the question names, and their facts."""
    found = graph.match_entities(entities, graph.question_terms(question)).orderBy("position", "name", "entity_id").collect()
    first = {r["name"]: r["type"] for r in reversed(found)}
    names = list(dict.fromkeys(r["name"] for r in found))
    if not names:
        return ""
    rows = graph.neighbours(edges, entities, names[:10]).orderBy("name", "source", "relationship", "target").collect()
    lines = list(dict.fromkeys(f"- {r['source']} | {r['relationship']} | {r['target']}" for r in rows))
    return "\n".join(["NAMED IN THE QUESTION", *[f"- {n} [{first[n]}]" for n in names[:20]], *(["THEIR FACTS", *lines[:30]] if lines else [])])


def unfenced(sql: str) -> str:
    sql = sql.strip()
    if sql.startswith("```"):
        sql = sql.split("\n", 1)[1] if "\n" in sql else ""
        sql = sql.removesuffix("```").strip()
    return sql.rstrip(";").strip()


def ask(spark: SparkSession, question: str, entities: DataFrame, edges: DataFrame, writer: QueryWriter, answerer: Answerer) -> dict:
    """Two attempts: after an error or an empty result the query is written once more with a hint.

    The field ``cypher`` carries the generated query, which is SQL here; callers know it by that name.
    """
    schema, matches = schema_text(spark, entities, edges), entity_text(question, entities, edges)
    sql, results = unfenced(writer.write(question, schema, matches)), []
    for attempt in range(2):
        try:
            results = run_guarded(spark, sql)
        except (PySparkException, UnsafeQuery) as e:
            if attempt:
                return {"question": question, "cypher": sql, "error": str(e), "answer": None}
            sql = unfenced(writer.write(question, schema, matches, f"That query did not run ({e}). Correct it, and keep it plain."))
            continue
        if results or attempt:
            break
        sql = unfenced(writer.write(question, schema, matches, BROADER))
    shown = "\n".join(str(r) for r in results[:50]) if results else "(no rows)"
    prompt = f"QUESTION\n{question}\n\nROWS FROM THE GRAPH\n{shown}\n\nUse these rows and nothing else. Where they do not answer the question, say so."
    return {"question": question, "cypher": sql, "results": results[:50], "answer": answerer.answer(prompt)}
