"""Views of papers, statements and programs (FLT09, PRJ08, JOIN10, AGG10, AGG11, AGG16, ORD01, MRG12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .merge import merge_maps, union_by


def section_key(section: Column) -> Column:
    """A sort key for numbers such as 2.10, which comes after 2.9."""
    return F.transform(F.split(section, r"\."), lambda x: x.try_cast("int"))


def locator_pieces(locator: Column) -> Column:
    """The number of places that a locator names; none for null or empty text."""
    return F.size(F.filter(F.split(F.coalesce(locator, F.lit("")), "; "), lambda x: x != ""))


def matching_groups(groups: DataFrame, members: DataFrame, key: str, group_text: Column, member_text: Column, needle: str) -> DataFrame:
    """``members`` whose own text or whose group's text contains the needle, in either case;
    groups without any such member have no row."""
    named = groups.select(key, group_text.alias("group_text__"))
    wanted = F.contains(text.search_text(F.col("group_text__"), member_text), F.lit(needle.lower()))
    return members.join(named, key).where(wanted).drop("group_text__")


def role_counts(rows: DataFrame, by: str, role: str, roles: list[str]) -> DataFrame:
    """A row for each value of ``by`` with one count for each role."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(role) == r).alias(r.replace("-", "_")) for r in roles])


def route_groups(proofs: DataFrame, by: list[str], order: list[str], alternative: Column) -> DataFrame:
    """``proofs`` with ``route``: with two complete alternatives or more each of them is a
    route by itself and other proofs are in none (null); else all proofs are route 1."""
    whole = W.partitionBy(*by)
    place = F.row_number().over(whole.orderBy(*order))
    split = F.count_if(alternative).over(whole) >= 2
    return proofs.withColumn("route", F.when(~split, F.lit(1)).when(alternative, place))


def formal_coverage(statements: DataFrame, by: str, declarations: str) -> DataFrame:
    """Per group: statements, those with declarations, with checked ones only, with an
    external one, all declarations, and the rounded per cent of checked statements.
    Declarations are structs with ``status``."""
    found = F.coalesce(F.col(declarations), F.array().cast(dict(statements.dtypes)[declarations]))
    checked = (F.size(found) > 0) & F.forall(found, lambda x: x["status"] == "checked")
    counted = statements.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.size(found) > 0).alias("declared"), F.count_if(checked).alias("checked"),
        F.count_if(F.exists(found, lambda x: x["status"] == "external")).alias("external"), F.sum(F.size(found)).alias("declarations"),
    )
    return counted.withColumn("percent", F.floor(F.col("checked") * 100 / F.col("total") + 0.5).cast("long"))


def neighbourhood(edges: DataFrame, citing: str, cited: str) -> DataFrame:
    """(paper, direction, other): each edge seen from both of its ends."""
    out = edges.select(F.col(citing).alias("paper"), F.lit("outgoing").alias("direction"), F.col(cited).alias("other"))
    return out.unionByName(edges.select(F.col(cited).alias("paper"), F.lit("incoming").alias("direction"), F.col(citing).alias("other")))


def promote(existing: DataFrame, gold: DataFrame, key: str, maps: list[str], lists: dict, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Provisional rows with a gold row of the same key: gold values win where they are not
    null, maps and lists (name: function of an entry that gives its key) are united and the
    columns ``keep`` stay. Second, the refused pairs: (key, reason)."""
    a, b = existing.alias("a"), gold.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    columns = []
    for c in existing.columns:
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}") if c in gold.columns else F.lit(None)
        if c == key or c in keep:
            value = mine
        elif c in maps:
            value = merge_maps(mine, theirs)
        elif c in lists:
            value = union_by(mine, theirs, lists[c])
        else:
            value = F.coalesce(theirs, mine)
        columns.append(value.alias(c))
    reason = F.when(~F.col("a.status").eqNullSafe("provisional"), "existing row is not provisional").when(~F.col("b.status").eqNullSafe("gold"), "new row is not gold")
    return both.where(reason.isNull()).select(*columns), both.where(reason.isNotNull()).select(F.col(f"a.{key}").alias(key), reason.alias("reason"))
