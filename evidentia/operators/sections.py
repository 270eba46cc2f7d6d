"""Sections of a paper's elements, from the headings among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.scalars import SECTIONS

#: A numbered heading, as number and title.
NUMBERED = r"^((?:\d{1,2}|[A-H]|[IVX]{1,4})(?:\.\d{1,2}){0,3})\.?\s+([A-Z][^\n]{1,90})$"


def heading_number(text: Column) -> Column:
    """The number before a heading's title; empty if it has none."""
    return F.coalesce(F.regexp_extract(F.trim(text), NUMBERED, 1), F.lit(""))


def heading_title(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(heading_number(text) != "", F.regexp_extract(bare, NUMBERED, 2)).otherwise(bare)


def section_of(title: Column) -> Column:
    """The section that a title names, else null."""
    low = F.lower(title)
    rules = list(SECTIONS.items())
    return reduce(lambda c, x: c.when(low.rlike(x[1]), F.lit(x[0])), rules[1:], F.when(low.rlike(rules[0][1]), F.lit(rules[0][0])))


def label_elements(elements: DataFrame, paper: str = "paper_id", order: str = "position", kind: str = "kind", text: str = "text") -> DataFrame:
    """``elements`` with ``section``, the label in force at each.

    Headings of depth one or without a number set the section they name. An unnamed one of depth one starts the methods
    once the introduction has been seen and no experiments or results. From an appendix on, or a lettered heading after
    the conclusion or references, all is ``other``. Before the first heading stands the abstract, or ``other`` where a
    heading names the abstract. Elements of one position come in any order; null texts name nothing; an empty table
    gives an empty one. The flags each rule needs are running maxima, so one sort of a paper's elements, which spills,
    serves them all.
    """
    through = Window.partitionBy(paper).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = through.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col(kind) == "heading"
    title, number = heading_title(F.col(text)), heading_number(F.col(text))
    df = elements.withColumn("_h", F.when(heading, F.struct(number.alias("number"), section_of(title).alias("named"), F.coalesce(title.rlike(r"(?i)\bappendix\b"), F.lit(False)).alias("appendix"))))
    depth = F.when(F.col("_h.number") == "", 0).otherwise(F.size(F.split("_h.number", r"\.")))
    df = df.withColumn("_depth", F.when(F.col("_h").isNotNull(), depth)).withColumn("_own", F.when(F.col("_depth") <= 1, F.col("_h.named")))
    seen = lambda *sections: F.coalesce(F.max(F.coalesce(F.col("_own").isin(*sections), F.lit(False))).over(before), F.lit(False))
    df = df.withColumn("_ended", seen("conclusion", "references")).withColumn("_methods", seen("introduction") & ~seen("experiments", "results"))
    lettered = (F.col("_depth") == 1) & F.col("_h.number").rlike("^[A-H]$") & F.col("_ended")
    df = df.withColumn("_appendix", F.max(F.coalesce(F.col("_h.appendix") | lettered, F.lit(False))).over(through))
    unnamed = (F.col("_depth") == 1) & F.col("_own").isNull() & F.col("_methods")
    df = df.withColumn("_set", F.when(F.col("_appendix"), F.lit("other")).when(F.col("_own").isNotNull(), F.col("_own")).when(unnamed, F.lit("methods")))
    has_abstract = F.max(F.coalesce(F.col("_h.named") == "abstract", F.lit(False))).over(Window.partitionBy(paper))
    label = F.coalesce(F.last("_set", ignorenulls=True).over(through), F.when(has_abstract, F.lit("other")).otherwise(F.lit("abstract")))
    return df.withColumn("section", label).drop("_h", "_depth", "_own", "_ended", "_methods", "_appendix", "_set")
