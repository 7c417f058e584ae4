"""Rows, runs and neighbours: gap-based rows, runs of like elements, line grouping, nearest values, ranks, grid joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Height of the cells in which rows and marks of one page meet.
CELL = 32.0
#: How tables meet by their cells: sorted. Either side grows with the input, and Parquet's size on disk says little of its rows, so none is broadcast.
SORTED = "merge"


def gap_rows(lines: DataFrame, keys: list[str], order: list[str], at: str, gap: float, end: float | None = None, stop: Column | None = None) -> DataFrame:
    """Adds row_id: a new row begins where `at` lies more than gap beyond the line before. From the first line on that lies more than
    `end` beyond the one before, or for which `stop` holds, all lines of the key are left out: the table has ended there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if end is not None or stop is not None:
        over = F.coalesce(F.col(at) - F.lag(at).over(w) > end, F.lit(False)) if end is not None else F.lit(False)
        over = over | F.coalesce(stop, F.lit(False)) if stop is not None else over
        lines = lines.withColumn("_over", over.cast("int")).withColumn("_over", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_over = 0").drop("_over")
    first = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return lines.withColumn("_new", first).withColumn("row_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def runs(rows: DataFrame, keys: list[str], order: list[str], kind: str, least: int = 3) -> DataFrame:
    """Runs of at least `least` consecutive rows of one kind: keys, run, kind and n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    x = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return x.groupBy(*keys, "run", kind).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ranked_value(rows: DataFrame, keys: list[str], value: str, rank: str, name: str) -> DataFrame:
    """Per key the value at place rank(n) of its n sorted values (from 0); rank is an expression over n.

    Equal values are counted before anything is ordered, so a window holds the different values of a key only.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = each.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    place = F.expr(rank)
    return upto.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)).select(*keys, F.col(value).alias(name))


#: The place of the upper median, and of the value a tenth of the way up.
UPPER_MEDIAN = "floor(n / 2)"
TENTH = "floor(n * 0.1D)"


def pitch_of(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the upper median of the gaps between consecutive rows."""
    w = Window.partitionBy(*keys).orderBy(at)
    return ranked_value(rows.withColumn("_gap", F.col(at) - F.lag(at).over(w)), keys, "_gap", UPPER_MEDIAN, "pitch")


def group_lines(spans: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Per page the lines of spans: a span joins the last line if its centre is within tolerance heights of that line's first span."""
    s = F.struct("y", "x", "seq", (F.col("y") + F.col("h") / 2).alias("cy"), "h")
    lists = spans.groupBy("drawing_id", "page").agg(F.array_sort(F.collect_list(s)).alias("all"))
    fold = F.aggregate("all", F.array().cast("array<struct<cy:double,n:bigint>>"), lambda acc, e: F.when((F.size(acc) > 0) & (F.abs(F.element_at(acc, -1)["cy"] - e["cy"]) <= e["h"] * tolerance), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["cy"].alias("cy"), (F.element_at(acc, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(e["cy"].alias("cy"), F.lit(1).cast("bigint").alias("n"))))))
    return lists.select("drawing_id", "page", F.posexplode(fold).alias("line", "l")).select("drawing_id", "page", "line", F.col("l.cy").alias("y"), F.col("l.n").alias("spans"))


def _in_cells(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join by cells as wide as the radius, the left one in the nine cells around each row, and the square of a pair's distance."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.explode(F.array(*[F.struct((cell("x") + i).alias("i"), (cell("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
    left = a.select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), near).select(*keys, "a", "ax", "ay", "c.i", "c.j")
    right = b.select(*keys, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("i"), cell("y").alias("j"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left, right.hint(SORTED), d2


def within_radius(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs of rows (id, x, y) of one key at most `radius` apart, through a grid of cells that wide: equality of cells, then the exact distance."""
    left, right, d2 = _in_cells(a, b, keys, radius)
    return left.join(right, [*keys, "i", "j"]).where(d2 <= radius * radius).select(*keys, "a", "b", F.sqrt(d2).alias("distance"))


def isolated(rows: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Rows with no other row of their keys within the radius. In each cell the first neighbour settles a row, so pairs are not listed."""
    left, right, d2 = _in_cells(rows, rows, keys, radius)
    right = right.withColumnsRenamed({k: f"_{k}" for k in [*keys, "i", "j"]})
    same = [F.col(k) == F.col(f"_{k}") for k in [*keys, "i", "j"]]
    met = left.join(right, [*same, F.col("a") != F.col("b"), d2 <= radius * radius], "left_semi").select(*keys, F.col("a").alias("id")).distinct()
    return rows.join(met.hint(SORTED), [*keys, "id"], "left_anti")


def nearest(labels: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """For each label (id, at) the value (value_id, value_at) of its keys at or right of it that is nearest; ties: the smallest id."""
    x = labels.select(*keys, "at", "id", F.lit(None).cast("struct<at:double,id:bigint>").alias("v")).unionByName(values.select(*keys, F.col("value_at").alias("at"), F.lit(None).cast("bigint").alias("id"), F.struct(F.col("value_at").alias("at"), F.col("value_id").alias("id")).alias("v")))
    # as-of by one sort instead of a join: values stand before labels of the same place when read from the right
    w = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("v").isNull(), F.col("v.id").desc())
    return x.withColumn("n", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("id is not null").select(*keys, "id", F.col("n.id").alias("value_id"), (F.col("n.at") - F.col("at")).alias("distance"))


def band_nearest(rows: DataFrame, marks: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """rows: id, top, bottom; marks: mark, at. Per row the mark nearest to its middle among those within `reach` of the row; ties: the smallest mark.

    Rows and marks meet in cells of the key's height, so that only neighbours are compared.
    """
    cell = lambda c: F.floor(c / CELL).cast("long")
    a = rows.withColumn("_cell", F.explode(F.sequence(cell(F.col("top") - reach), cell(F.col("bottom") + reach))))
    b = marks.select(*keys, "mark", "at", cell(F.col("at")).alias("_cell"))
    near = a.join(b, [*keys, "_cell"]).where((F.col("at") >= F.col("top") - reach) & (F.col("at") <= F.col("bottom") + reach))
    return near.groupBy(*keys, "id").agg(F.min(F.struct(F.abs(F.col("at") - (F.col("top") + F.col("bottom")) / 2).alias("d"), "mark")).alias("m")).select(*keys, "id", F.col("m.mark").alias("mark"))


def band_texts(rows: DataFrame, texts: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """texts: seq, str, at. Per row (id, top, bottom) the texts within `reach` of it, joined in order of seq."""
    cell = lambda c: F.floor(c / CELL).cast("long")
    a = rows.withColumn("_cell", F.explode(F.sequence(cell(F.col("top") - reach), cell(F.col("bottom") + reach))))
    b = texts.select(*keys, "seq", "str", "at", cell(F.col("at")).alias("_cell"))
    near = a.join(b, [*keys, "_cell"]).where((F.col("at") >= F.col("top") - reach) & (F.col("at") <= F.col("bottom") + reach))
    return near.groupBy(*keys, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda s: s["str"]), " ").alias("text"))


def line_members(spans: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """The spans with the number of their line on the page (see group_lines) and their place in it from left to right."""
    s = F.struct("y", "x", "seq", (F.col("y") + F.col("h") / 2).alias("cy"), "h")
    lists = spans.groupBy("drawing_id", "page").agg(F.array_sort(F.collect_list(s)).alias("all"))
    kind = "array<struct<line:int,first:double,x:double,seq:bigint>>"
    last = lambda acc: F.element_at(acc, -1)
    joins = lambda acc, e: (F.size(acc) > 0) & (F.abs(last(acc)["first"] - e["cy"]) <= e["h"] * tolerance)
    row = lambda line, first, e: F.array(F.struct(line.cast("int").alias("line"), first.alias("first"), e["x"].alias("x"), e["seq"].cast("bigint").alias("seq")))
    fold = F.aggregate("all", F.array().cast(kind), lambda acc, e: F.concat(acc, F.when(joins(acc, e), row(last(acc)["line"], last(acc)["first"], e)).otherwise(row(F.coalesce(F.when(F.size(acc) > 0, last(acc)["line"]), F.lit(-1)) + 1, e["cy"], e))))
    flat = lists.select("drawing_id", "page", F.explode(fold).alias("m")).select("drawing_id", "page", "m.line", "m.x", "m.seq")
    return flat.withColumn("place", F.row_number().over(Window.partitionBy("drawing_id", "page", "line").orderBy("x", "seq"))).drop("x")
