"""Guard for ad-hoc SQL: one SELECT over known relations, known functions only, bounded by a limit.

What is checked is the plan that Spark's own parser makes, and that plan's text is what runs. Everything is an
allow-list: kinds of nodes, kinds of expressions, relations, functions, generators. A kind that isn't known is
refused, whatever it may do. Messages are written for whoever has to repair the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestream.schemas import RELATIONS

NODES = set("""Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedRelation UnresolvedWith Window
Union Intersect Except Distinct UnresolvedHaving UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedInlineTable LocalRelation
Deduplicate WithWindowDefinition UnresolvedOrdinal LateralJoin Generate Sample Pivot UnresolvedPivot""".split())
EXPRESSIONS = set("""Add Alias And BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat CreateArray CreateMap CreateNamedStruct Cube CurrentDate
CurrentRow CurrentTimestamp Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsFalse IsNaN
IsNotFalse IsNotNull IsNotTrue IsNull IsTrue LambdaFunction LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias
Multiply Not NotLikeAll NotLikeAny Or RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringTrim StringTrimLeft StringTrimRight
Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue
UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex UnresolvedStar UnresolvedStarWithColumns
UnresolvedSubscript UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition Between Extract""".split())  # fmt: skip
GENERATORS = {"explode", "explode_outer", "posexplode", "posexplode_outer"}
FUNCTIONS = set("""abs array array_agg array_contains array_distinct array_join array_max array_min array_sort avg between bround cardinality cast ceil
ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist current_date date
date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear
dense_rank element_at endswith exp explode extract filter first first_value flatten floor format_number from_unixtime greatest hour
if ifnull ilike in initcap instr int isnan isnotnull isnull lag last last_day last_value lcase lead least left length like ln locate
log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by mean median min min_by minute mod mode month monthname
months_between nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont percentile_disc pmod
position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse
right rlike round row_number rpad rtrim second sequence sign size slice some sort_array split split_part sqrt startswith std
stddev stddev_pop stddev_samp string struct substr substring substring_index sum timestamp to_date to_char transform trim trunc
try_cast try_divide try_to_date ucase unix_date upper var_pop var_samp variance weekday weekofyear when width_bucket year double float
bigint boolean decimal every any bool_and bool_or date_bin named_struct exists forall aggregate zip_with""".split())  # fmt: skip


class Rejected(ValueError):
    """A query the guard doesn't let through, with the reason."""


def _words(kind: str) -> str:
    return re.sub("(?<!^)(?=[A-Z])", " ", kind).lower()


def _each(seq) -> Iterable:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(node, relations: list[str], functions: list[str], ctes: frozenset[str]) -> None:
    kind = node.getClass().getSimpleName().rstrip("$")
    if kind not in NODES:
        raise Rejected(f"only SELECT queries are allowed; {_words(kind)} is not")
    if kind == "UnresolvedRelation":
        parts = [str(x) for x in _each(node.multipartIdentifier())]
        if len(parts) != 1:
            raise Rejected(f"'{'.'.join(parts)}' is not allowed in FROM; use a table's plain name")
        if parts[0].lower() not in ctes:
            relations.append(parts[0].lower())
    inner = ctes
    if kind == "UnresolvedWith":
        for pair in _each(node.cteRelations()):
            _walk(pair._2(), relations, functions, inner)  # a name counts from its definition on
            inner = inner | {str(pair._1()).lower()}
    for e in _each(node.expressions()):
        _walk_expression(e, relations, functions, inner)
    for child in _each(node.children()):
        _walk(child, relations, functions, inner)


def _walk_expression(e, relations: list[str], functions: list[str], ctes: frozenset[str]) -> None:
    kind = e.getClass().getSimpleName().rstrip("$")
    if kind not in EXPRESSIONS:
        raise Rejected(f"the expression '{_words(kind)}' is not allowed")
    if kind == "UnresolvedFunction":
        parts = [str(x) for x in _each(e.nameParts())]
        if len(parts) != 1:
            raise Rejected(f"function '{'.'.join(parts)}' is not allowed")
        functions.append(parts[0].lower())
    if kind == "UnresolvedGenerator":
        name = e.name()
        if name.database().isDefined() or name.funcName().lower() not in GENERATORS:
            raise Rejected(f"generator '{name.unquotedString()}' is not allowed")
    if kind in ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _walk(e.plan(), relations, functions, ctes)
    for child in _each(e.children()):
        _walk_expression(child, relations, functions, ctes)


def _limit(plan, most: int) -> int | None:
    """The outermost limit as a number; none without one."""
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        return _limit(plan.child(), most)
    if kind != "GlobalLimit":
        return None
    value = plan.limitExpr()
    if value.getClass().getSimpleName() != "Literal":
        raise Rejected("LIMIT must be a plain integer")
    return int(str(value.value()))


def check(spark: SparkSession, sql: str, allowed: Mapping[str, T.StructType] = RELATIONS, most: int = 1000) -> int:
    """The row limit that applies to an allowed query; raises Rejected otherwise."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        first = str(getattr(e, "desc", None) or e).strip().splitlines()[0][:300]
        raise Rejected(f"could not parse the SQL: {first}") from e
    relations: list[str] = []
    functions: list[str] = []
    _walk(plan, relations, functions, frozenset())
    for name in relations:
        if name not in allowed:
            raise Rejected(f"table '{name}' is not allowed; allowed tables: {', '.join(sorted(allowed))}")
    for name in functions:
        if name not in FUNCTIONS:
            raise Rejected(f"function '{name}' is not allowed")
    asked = _limit(plan, most)
    return most if asked is None else min(asked, most)


def _own_session(spark: SparkSession, views: Mapping[str, DataFrame]) -> SparkSession:
    """A session of its own, with the relations as its temporary views, so that questions asked at once never share a name."""
    own = spark.newSession()
    for name, df in views.items():
        plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical())
        plan.createOrReplaceTempView(name)
    return own


def guarded(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], most: int = 1000) -> DataFrame:
    """The bounded result of an allowed query over the given relations, which stand under their names for this query only.

    Unknown columns are reported by the analyser, in the same exception.
    """
    limit = check(spark, sql, {k: v.schema for k, v in views.items()}, most)
    try:
        return _own_session(spark, views).sql(sql).limit(limit)
    except Exception as e:
        text = str(getattr(e, "desc", None) or e).strip().splitlines()[0][:300]
        raise Rejected(f"could not analyse the SQL: {text}") from e
