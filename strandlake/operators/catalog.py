"""Catalogue operations: filters, snapshot differences, top-N by rank, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.functions import scalars as S


def chosen(df: DataFrame, wanted: dict[str, list[str]], expression: str | None = None) -> DataFrame:
    """Rows whose columns are, in lower case, among those wanted, and that a user's SQL predicate accepts."""
    for column, values in wanted.items():
        df = df.where(F.lower(F.col(column)).isin([v.lower() for v in values]))
    return df.where(F.expr(expression)) if expression else df


def dated(df: DataFrame, column: Column, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose date, digits only, lies in an inclusive range with open ends."""
    d = S.plain_date(column)
    if start:
        df = df.where(d >= S.plain_date(F.lit(start)))
    return df.where(d <= S.plain_date(F.lit(end))) if end else df


def diff(old: DataFrame, new: DataFrame, key: str, differs: list[str]) -> DataFrame:
    """(key, change): updated, removed or new."""
    both = new.alias("n").join(old.alias("o"), key)
    changed = F.lit(False)
    for c in differs:
        changed = changed | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    parts = [(both.where(changed), "updated"), (old.join(new, key, "left_anti"), "removed"), (new.join(old, key, "left_anti"), "new")]
    out = None
    for rows, change in parts:
        part = rows.select(key, F.lit(change).alias("change"))
        out = part if out is None else out.unionAll(part)
    return out


def top_n(df: DataFrame, rank: list[str], order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*rank).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def overwritten(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`left` with the other side's values where those aren't null."""
    r = right.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = left.join(r, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*left.columns)


def first_match(rows: DataFrame, candidates: list[str], key: str, targets: DataFrame, target: str) -> DataFrame:
    """(key, target): the first of a row's candidate columns that is a target."""
    c = F.array(*(F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(candidates)))
    long = rows.select(key, F.explode(c).alias("c")).where("c.v is not null")
    hit = long.join(targets.select(F.col(target).alias("t")).distinct(), F.col("c.v") == F.col("t"))
    return hit.groupBy(key).agg(F.min_by("c.v", "c.i").alias(target))


def included(items: DataFrame, lineage: DataFrame, taxid: str, yes: list[int], no: list[int]) -> DataFrame:
    """Items below a wanted node and below no unwanted one; both lists are the user's."""
    hit = lineage.where(F.col("anc").isin(yes)).select(F.col("taxid").alias(taxid)).distinct()
    out = items.join(hit, taxid, "left_semi")
    bad = lineage.where(F.col("anc").isin(no)).select(F.col("taxid").alias(taxid)).distinct()
    return out.join(bad, taxid, "left_anti") if no else out


def completeness(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status): complete, missing, or extra."""
    a = expected.select(key).distinct().withColumn("e", F.lit(True))
    b = found.select(key).distinct().withColumn("f", F.lit(True))
    status = F.when(F.col("e").isNull(), "extra").when(F.col("f").isNull(), "missing").otherwise("complete")
    return a.join(b, key, "full").select(key, status.alias("status"))
