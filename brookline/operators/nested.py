"""Relations inside a selection: each parent's children go through a pipeline of their own."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.expressions import checked, compile_expression
from ..plans.frames import ORDER, Context, Frame
from ..plans.nodes import Field, Name
from . import rows

KEY, RANK = "__parent", "__rank"
#: A parent's number, where a join's rows are dealt.
ROW = "__row"
#: Rows of a join that a task should give, and rows of each side of a key that meet in one cell.
TASK_ROWS, CELL_ROWS = 4_000_000, 1_000


def children(source: Frame, target_column: str, field: Field, context: Context) -> tuple[Frame, list[tuple[str, str]]]:
    """(frame, [(field name, type)]) of the children with their parent's key and their rank among its children.

    where and having filter; group groups within a parent; sort, limit and offset become ranks of a window over the
    parent's key, so a limit is pushed below the shuffle as a limit of each partition's groups.
    """
    frame = replace(source, df=source.df.withColumn(KEY, F.col(f"`{source.columns[target_column][0]}`")))
    ops, pending = field.ops, []  # pending: the order of the rows of a parent
    ranked, skipped = False, 0
    if any(o.kind in ("sort", "limit", "offset") for o in ops) or field.nested is not None:
        frame = rows.ordered_source(frame)
    for k, op in enumerate(ops):
        if op.kind in ("where", "having"):
            frame = rows.keep(frame, op, context)
            ranked = False
        elif op.kind == "group":
            frame, pending, ranked = rows.group(frame, op, ops[k + 1 :], field.nested, context, (KEY,)), [], False
        elif op.kind == "sort":
            pending, ranked = [*rows.sort_columns(frame, op, context), *pending], False
        elif op.kind == "unique":
            frame = replace(frame, df=frame.df.dropDuplicates([KEY, *[c for c, _ in frame.columns.values()]]))
        elif op.kind in ("limit", "offset"):
            n = rows.bound(op, context)
            if n is None:
                continue
            if not ranked:
                frame, ranked, skipped = replace(frame, df=frame.df.withColumn(RANK, _rank(frame, pending))), True, 0
            # Plain bounds on the rank, so that the planner limits each parent before the shuffle.
            if op.kind == "limit":
                frame = replace(frame, df=frame.df.where(F.col(RANK) <= skipped + n))
            else:
                skipped += n
                frame = replace(frame, df=frame.df.where(F.col(RANK) > skipped))
        elif op.kind != "inspect":
            raise QueryError(f"{op.kind} can't stand in a nested selection", "QueryExecutionError", "execution", "query", *op.pos)
    if not ranked:
        frame = replace(frame, df=frame.df.withColumn(RANK, _rank(frame, pending)) if pending else frame.df.withColumn(RANK, F.col(ORDER) if ORDER in frame.df.columns else F.lit(0)))
    fields, columns = [], []
    scope = frame.scope(context)
    chosen = field.nested.fields or [Field(field.pos, n) for n in frame.columns]
    for f in chosen:
        if f.nested is not None:
            raise QueryError("only one level of relations can be selected", "QueryExecutionError", "execution", "query", *f.pos)
        v = compile_expression(f.expr if f.expr is not None else Name(f.pos, f.name), scope)
        fields.append((f.name, v.type))
        columns.append(checked(v).alias(f"__c{len(columns)}"))
    return Frame(frame.df.select(KEY, RANK, *columns), {n: (f"__c{k}", t) for k, (n, t) in enumerate(fields)}), fields


def _rank(frame: Frame, pending: list[Column]) -> Column:
    order = [*pending, F.col(ORDER)] if ORDER in frame.df.columns else pending or [F.lit(0)]
    return F.row_number().over(Window.partitionBy(KEY).orderBy(*order))


def _same(a: Column, b: Column, nullable: bool) -> Column:
    """Null keys match; where one side has none, plain equality says the same and keeps bucketing and runtime filters usable."""
    return a.eqNullSafe(b) if nullable else a == b


@dataclass
class Deal:
    """How a join is dealt over tasks: (__heavy, __i, __j), the keys of many pairs with their cells along both sides, and numbers of tasks."""

    heavy: DataFrame | None
    tasks: int
    left_tasks: int = 1
    right_tasks: int = 1


def deals(parent: Frame, steps: list[tuple[str, Frame, bool, bool, bool]]) -> list[Deal | None]:
    """A deal for each (local column, children, nullable, one parent a key, one child a key); None for joins of few rows.

    Rows with the keys of both sides multiply when several relations are selected, and few keys are few tasks. So pairs
    are counted before, by key, from the numbers of parents and children alone. A join with one row a key on either
    side is no larger than its sides and isn't counted, nor one whose sides are so small that all their pairs are few.
    """
    out, before, ones, rows_of, most = [], parent.df.withColumn("__n", F.lit(1.0)), True, None, 0
    for k, (local, child, nullable, one_parent, one_child) in enumerate(steps):
        key, out = F.col(f"`{parent.columns[local][0]}`"), [*out, None]
        kind = _common(parent.df.schema[parent.columns[local][0]].dataType, child.df.schema[KEY].dataType)
        if one_child:
            continue
        if rows_of is None and len([s for s in steps if not s[4]]) + (not one_parent) > 1:
            rows_of = _rows([parent.df, *[s[1].df for s in steps]])
            most = rows_of[0]
        counts = child.df.groupBy(F.col(KEY).alias(f"__k{k}")).agg(F.count(F.lit(1)).cast("double").alias(f"__n{k}"))
        single, ones = one_parent and ones, False
        if not single and kind is not None and most * rows_of[k + 1] > TASK_ROWS:
            out[k] = _deal(before.groupBy(key.alias("__heavy")).agg(F.sum("__n").alias("__left")), counts.toDF("__key", "__right"), nullable)
        if rows_of is not None:
            most = most + rows_of[k + 1] if single else most * max(1, rows_of[k + 1])
        before = before.join(counts, _same(key, F.col(f"__k{k}"), nullable), "left").withColumn("__n", F.col("__n") * F.coalesce(F.col(f"__n{k}"), F.lit(1.0)))
    return out


def _rows(frames: list[DataFrame]) -> list[int]:
    """The rows of each frame, counted in one job."""
    tags = reduce(DataFrame.unionAll, [df.select(F.lit(k).alias("k")) for k, df in enumerate(frames)])
    found = dict(tags.groupBy("k").count().collect())
    return [found.get(k, 0) for k in range(len(frames))]


def _deal(left: DataFrame, right: DataFrame, nullable: bool) -> Deal | None:
    pairs = F.col("__left") * F.col("__right")
    i, j = (F.ceil(F.col(c) / CELL_ROWS) for c in ("__left", "__right"))
    heavy = F.struct("__heavy", i.alias("__i"), j.alias("__j"))
    both = left.join(right, _same(F.col("__heavy"), F.col("__key"), nullable))
    many = pairs > CELL_ROWS**2
    counted = both.agg(
        F.sum(pairs), F.sum(F.when(many, F.col("__left") * j)), F.sum(F.when(many, F.col("__right") * i)), F.collect_list(F.when(many, heavy)).alias("heavy")
    ).toArrow()
    total, lefts, rights = (counted.column(c)[0].as_py() or 0.0 for c in range(3))
    if total <= TASK_ROWS:
        return None
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _tasks(total))
    if not lefts:
        return Deal(None, tasks)
    return Deal(spark.createDataFrame(counted.select(["heavy"])).select(F.inline("heavy")), tasks, _tasks(lefts), _tasks(rights))


def _tasks(rows: float) -> int:
    return int(-(-rows // TASK_ROWS))


def joined_flat(parent: Frame, local: str, child: Frame, prefix: str, nullable: bool, deal: Deal | None = None) -> Frame:
    """Left join: a row for each parent and child, and one with nulls for a parent without children."""
    renamed = child.df.select(F.col(KEY).alias(f"{prefix}{KEY}"), F.col(RANK).alias(f"{prefix}{RANK}"), *[F.col(c).alias(f"{prefix}{c}") for c, _ in child.columns.values()])
    if deal is not None:
        return replace(parent, df=_dealt(parent.df, parent.columns[local][0], renamed, prefix, nullable, deal))
    on = _same(F.col(f"`{parent.columns[local][0]}`"), F.col(f"`{prefix}{KEY}`"), nullable)
    return replace(parent, df=parent.df.join(renamed, on, "left"))


def _dealt(left: DataFrame, local: str, right: DataFrame, prefix: str, nullable: bool, deal: Deal) -> DataFrame:
    """The left join in a given number of tasks. A heavy key's pairs are a grid of cells: each left row goes to the cells
    of a row of the grid, each child to those of a column, so a cell's rows have a bound and cells are dealt alone."""
    own, columns = [ROW, *[c for c in left.columns if c.endswith(RANK)]], left.columns
    kind = _common(left.schema[local].dataType, right.schema[f"{prefix}{KEY}"].dataType)
    ours, theirs, keep = _keys("__l", F.col(f"`{local}`"), kind, nullable), _keys("__r", F.col(f"{prefix}{KEY}"), kind, nullable), F.lit(True)
    if deal.heavy is not None:
        left = left.join(deal.heavy, _same(F.col(f"`{local}`"), F.col("__heavy"), nullable), "left")
        right = right.join(deal.heavy, _same(F.col(f"`{prefix}{KEY}`"), F.col("__heavy"), nullable), "left")
        left = left.repartition(deal.left_tasks, *own) if deal.left_tasks > 1 else left
        right = right.repartition(deal.right_tasks, f"{prefix}{KEY}", f"{prefix}{RANK}") if deal.right_tasks > 1 else right
        i, j, zero = F.coalesce("__i", F.lit(1)), F.coalesce("__j", F.lit(1)), F.lit(0).cast("bigint")
        left = left.select(*columns, F.col("__i").alias("__grid"), F.pmod(F.xxhash64(*own), i).alias("__at"), j.alias("__j"), F.explode(F.sequence(zero, j - 1)).alias("__to"))
        left = left.withColumn("__lcell", F.col("__at") * F.col("__j") + F.col("__to"))
        right = right.select(*right.columns[: -3], F.pmod(F.xxhash64(f"{prefix}{RANK}"), j).alias("__at"), j.alias("__j"), F.explode(F.sequence(zero, i - 1)).alias("__to"))
        right = right.select("*", (F.col("__to") * F.col("__j") + F.col("__at")).alias("__rcell"), F.lit(True).alias("__met")).drop("__at", "__j", "__to")
        ours["__lcell"], theirs["__rcell"] = F.col("__lcell"), F.col("__rcell")
        # A heavy key has children, so its rows that met none in a cell did so in others.
        keep = F.col("__grid").isNull() | F.col("__met").isNotNull()
        right = right.hint("merge")  # many copies of few rows: the planner takes them for small enough to broadcast
    left, right = left.withColumns(ours).repartition(deal.tasks, *ours), right.withColumns(theirs).repartition(deal.tasks, *theirs)
    on = [F.col(a) == F.col(b) for a, b in zip(ours, theirs, strict=True)]
    added = [c for c in right.columns if c.startswith(prefix)]
    return left.join(right, on, "left").where(keep).select(*columns, *added)


def _common(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which two keys are compared; None for types of two kinds, whose equality may join several keys with one."""
    whole = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    return a if a == b else whole[max(whole.index(a), whole.index(b))] if a in whole and b in whole else None


def _keys(name: str, key: Column, kind: T.DataType, nullable: bool) -> dict[str, Column]:
    """Columns that are equal where keys are the same, nulls included if they match."""
    if not nullable:
        return {f"{name}key": key.cast(kind)}
    filler = F.lit("") if kind == T.StringType() else F.lit(False) if kind == T.BooleanType() else F.lit(0).cast("timestamp" if "timestamp" in kind.simpleString() else kind)
    return {f"{name}key": F.coalesce(key.cast(kind), filler.cast(kind)), f"{name}null": key.isNull()}


def joined_tree(parent: Frame, local: str, child: Frame, fields: list[tuple[str, str]], name: str, nullable: bool) -> Frame:
    """A column with each parent's list of children, in their order; an empty list for none.

    Children are gathered by parent before the join, so a parent's other columns aren't shuffled with each child.
    """
    item = F.struct(F.col(RANK), *[F.col(f"__c{k}") for k in range(len(fields))])
    lists = child.df.groupBy(F.col(KEY).alias(f"{name}{KEY}")).agg(F.array_sort(F.collect_list(item)).alias("__children"))
    on = _same(F.col(f"`{parent.columns[local][0]}`"), F.col(f"`{name}{KEY}`"), nullable)
    df = parent.df.join(lists, on, "left")
    shaped = F.transform("__children", lambda x: F.struct(*[x[f"__c{k}"].alias(n) for k, (n, _) in enumerate(fields)]))
    return replace(parent, df=df.withColumn("__children", F.coalesce(shaped, F.array())))
