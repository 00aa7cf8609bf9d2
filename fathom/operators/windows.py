"""Window functions and QUALIFY.

Spark computes a window without PARTITION BY in one task. ``distributed`` numbers such
rows in ranges of the order instead: a row's place is the number of rows in the ranges
before its own plus its place within.
"""

from __future__ import annotations

from collections.abc import Sequence

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Estimated bytes of the rows from which ``distributed`` makes as many ranges as the session has shuffle partitions; below, Spark may merge them.
SMALL = 8 << 20
#: Rows up to which a limit or a list of values leaves ranks to one task.
FEW = 100_000
#: Classes of the functions that ``distributed`` takes apart.
_RANKS = ("RowNumber", "Rank", "DenseRank")


def over(partition: Sequence[Column | str] = (), order: Sequence[Column] = ()) -> WindowSpec:
    w = Window.partitionBy(*partition)
    return w.orderBy(*order) if order else w


def row_number(w: WindowSpec) -> Column:
    return F.row_number().over(w).cast("bigint")


def rank(w: WindowSpec) -> Column:
    return F.rank().over(w).cast("bigint")


def dense_rank(w: WindowSpec) -> Column:
    return F.dense_rank().over(w).cast("bigint")


def ntile(n: int, w: WindowSpec) -> Column:
    return F.ntile(n).over(w).cast("bigint")


def filtered(agg, x: Column, where: Column, w: WindowSpec) -> Column:
    """agg(x) FILTER (WHERE where) OVER w."""
    return agg(F.when(where, x)).over(w)


def qualify(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which ``cond``, which may hold window functions, is true. A bound on a rank becomes a limit per group before the shuffle."""
    return df.withColumn("__qualify", cond).filter("__qualify").drop("__qualify")


def top_per_group(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = over(partition, order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


# -- windows over all rows -------------------------------------------------------


def _each(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _function(named) -> str:
    """The function of a window expression under its alias, such as RowNumber; of anything else its class."""
    x = _each(named.children())[0] if _name(named) == "Alias" else named
    return _name(x.windowFunction()) if _name(x) == "WindowExpression" else _name(x)


def _has(plan, *names: str) -> bool:
    return _name(plan) in names or any(_has(p, *names) for p in _each(plan.children()))


def _global(plan) -> bool:
    return _name(plan) == "Window" and not plan.partitionSpec().size() and plan.orderSpec().size() > 0 and all(_function(x) in _RANKS for x in _each(plan.windowExpressions()))


def _few(plan) -> bool:
    """Whether an optimised plan has no more than FEW rows by its form, or the first rows of a rank."""
    most = plan.maxRows()
    return _name(plan) == "WindowGroupLimit" or most.isDefined() and most.get() <= FEW


def _unbounded(plan) -> bool:
    """Whether an optimised plan has a global rank of more than few rows."""
    below = plan
    while _global(plan) and _name(below) in ("Window", "Project"):
        below = _each(below.children())[0]
    return _global(plan) and not _few(below) or any(_unbounded(p) for p in _each(plan.children()))


def _seq(df: DataFrame, items: list):
    return df.sparkSession._jvm.PythonUtils.toSeq(items)


def _frame(df: DataFrame, plan) -> DataFrame:
    session = df.sparkSession
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _fixed(df: DataFrame) -> DataFrame:
    """The same rows in partitions that stay: all that is made of them reads one shuffle with the same bounds."""
    jdf = df._jdf
    scan = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution, "LogicalRDD$"), "MODULE$")
    return _frame(df, scan.fromDataset(jdf.queryExecution().toRdd(), jdf, False))


def _before(sizes: dict[int, int]) -> Column:
    """By partition, the sum of the sizes of those before it."""
    return F.lit([0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).cast("array<bigint>")


def _numbered(df: DataFrame, window):
    """The plan that stands for a global Window: the same columns, by the same ids."""
    child = window.child()
    given = _each(child.output())
    rows = _frame(df, child).toDF(*[f"c{i}" for i in range(len(given))])
    place = {a.exprId().id(): f"c{i}" for i, a in enumerate(given)}
    order, keys = [], []
    for o in _each(window.orderSpec()):
        if _name(o.child()) == "AttributeReference":
            key = place[o.child().exprId().id()]
            way = ("asc" if o.direction().sql() == "ASC" else "desc") + ("_nulls_first" if "FIRST" in o.nullOrdering().sql() else "_nulls_last")
            order.append(getattr(F.col(key), way)())
            keys.append(key)
        elif not o.child().foldable():
            return window
    if not order:  # all rows are alike
        return window
    n = [] if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL else [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
    wanted = [_function(x) for x in _each(window.windowExpressions())]
    part = F.spark_partition_id().alias("part")
    if set(wanted) == {"RowNumber"}:
        # rows alike in the keys may be in any order, so they are spread by their hash
        hashed = [F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not any(w in t for w in ("map", "variant"))])]
        ranges = _fixed(rows.repartitionByRange(*n, *order, *hashed))
        sizes = {r.part: r.n for r in ranges.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = ranges.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())  # the partition above 33 bits for the row in it
        first = F.element_at(_before(sizes), F.shiftright("at", 33).cast("int") + 1)
        made = {"RowNumber": first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1}
    else:
        ranges = _fixed(rows.repartitionByRange(*n, *order)).withColumn("part", part)
        groups = ranges.groupBy("part", *dict.fromkeys(keys)).agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()
        w = over(["part"], order)
        before = {"RowNumber": _before({r.part: r.n for r in groups}), "DenseRank": _before({r.part: r.d for r in groups})}
        before["Rank"] = before["RowNumber"]
        local = {"RowNumber": F.row_number(), "Rank": F.rank(), "DenseRank": F.dense_rank()}
        at = ranges.select("*", *[local[f].over(w).alias(f"w{f}") for f in dict.fromkeys(wanted)])
        made = {f: F.element_at(before[f], F.col("part") + 1) + F.col(f"w{f}") for f in wanted}
    out = at.select(*[f"c{i}" for i in range(len(given))], *[made[f].cast("int").alias(f"n{i}") for i, f in enumerate(wanted)])._jdf.queryExecution().analyzed()
    jvm = df.sparkSession._jvm
    none = jvm.scala.Option.empty()
    named = [*given, *[x.toAttribute() for x in _each(window.windowExpressions())]]
    same = [jvm.org.apache.spark.sql.catalyst.expressions.Alias(now, a.name(), a.exprId(), a.qualifier(), none, _seq(df, [])) for now, a in zip(_each(out.output()), named)]
    return jvm.org.apache.spark.sql.catalyst.plans.logical.Project(_seq(df, same), out)


def _replaced(df: DataFrame, plan):
    old = _each(plan.children())
    new = [_replaced(df, p) for p in old]
    if any(a is not b for a, b in zip(old, new)):
        plan = plan.withNewChildren(_seq(df, new))
    return _numbered(df, plan) if _global(plan) and not plan.isStreaming() and not _has(plan, "CTERelationRef", "UnionLoopRef") else plan


def distributed(df: DataFrame) -> DataFrame:
    """The same result with ROW_NUMBER, RANK and DENSE_RANK over all rows computed in many tasks.

    The rows are shuffled by ranges when this is called, the rest runs with the query.
    Ranks that a filter bounds stay, as Spark keeps only the first rows of these; so do
    other functions in a window, and windows in a subquery that is an expression. Rows
    that are alike in the keys of a RANK or DENSE_RANK meet in one task.
    """
    execution = df._jdf.queryExecution()
    if not _has_global(execution.analyzed()) or not _unbounded(execution.optimizedPlan()):
        return df
    plan = execution.analyzed()
    if _has(plan, "WithCTE"):
        plan = df.sparkSession._jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(False, False).apply(plan)
    return _frame(df, _replaced(df, plan))


def _has_global(plan) -> bool:
    return _global(plan) or any(_has_global(p) for p in _each(plan.children()))
