"""Verbatim reads, neighbours, table runs and grep over sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sectionlake.functions import text

#: All text that one regular-expression scan may read, in characters.
SCAN_BUDGET = 200_000


def adjacent(sections: DataFrame, document: str = "doc_id") -> DataFrame:
    """prev_id and next_id: the neighbours in document order."""
    order = Window.partitionBy(document).orderBy("ordinal")
    return sections.withColumns({"prev_id": F.lag("id").over(order), "next_id": F.lead("id").over(order)})


def table_runs(sections: DataFrame, document: str = "doc_id") -> DataFrame:
    """header_id and header_text: the first section of each run of tables under one heading; null elsewhere.

    A run is broken by any other kind or heading path. The run's first section has no header.
    """
    order = Window.partitionBy(document).orderBy("ordinal")
    same = (F.lag("kind").over(order) == "table") & (F.lag("heading_path").over(order) == F.col("heading_path"))
    starts = F.when((F.col("kind") == "table") & F.coalesce(same, F.lit(False)), 0).otherwise(1)
    run = F.sum("_start").over(order)
    marked = sections.withColumn("_start", starts).withColumn("_run", run)
    of_run = Window.partitionBy(document, "_run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (F.col("kind") == "table") & (F.col("_start") == 0)
    out = marked.withColumns({"header_id": F.when(inside, F.first("id").over(of_run)), "header_text": F.when(inside, F.first("text").over(of_run))})
    return out.drop("_start", "_run")


def header_lines(header_text: Column) -> Column:
    """The first two pipe lines of a table section."""
    pipes = F.filter(text.lines(header_text), lambda x: F.ltrim(x).startswith("|"))
    return F.array_join(F.slice(pipes, 1, 2), "\n")


def with_header(sections: DataFrame) -> DataFrame:
    """Table continuations with their run's header and separator in front, unless they start with them."""
    runs = table_runs(sections)
    head = F.coalesce(header_lines(F.col("header_text")), F.lit(""))
    whole = F.when((head != "") & ~F.col("text").startswith(head), F.concat(head, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return runs.withColumn("text", whole)


def around(sections: DataFrame, ids: DataFrame, before: int, after: int, itself: bool = True) -> DataFrame:
    """The sections at most so many places before and after each of `ids` (asked), in its document.

    Every asked place names the few places around it, so that one equi-join on document and ordinal
    finds them, however long a document is. Adds asked, the id that was asked for.
    """
    place = sections.join(ids.select(F.col("id").alias("asked")).distinct(), F.col("id") == F.col("asked"), "inner")
    spots = F.explode(F.sequence(F.col("ordinal") - before, F.col("ordinal") + after)).alias("ordinal")
    near = sections.join(place.select("asked", "doc_id", spots), ["doc_id", "ordinal"])
    near = near if itself else near.where(F.col("id") != F.col("asked"))
    return near


def grep(sections: DataFrame, pattern: str, regex: bool = False, within: Column | None = None, unicode: bool = False) -> DataFrame:
    """The first matching line of every section that has one: id, path, heading_path, line (stripped).

    Literal patterns match in any case: the whole section by A to Z alone (`unicode`: every letter),
    its lines by every letter. Regular expressions are Java's, in any case, line by line. The scan
    filters where the text is read; nothing is shuffled.
    """
    rows = sections.where(within) if within is not None else sections
    if regex:
        hit = lambda line: line.rlike("(?iu)" + pattern)
    else:
        needle = pattern.lower()
        whole = F.lower("text") if unicode else text.ascii_lower(F.col("text"))
        rows = rows.where(F.instr(whole, needle) > 0)
        hit = lambda line: F.contains(F.lower(line), F.lit(needle))
    found = rows.withColumn("_hits", F.filter(text.lines(F.col("text")), hit)).where(F.size("_hits") > 0)
    return found.select("id", "path", "heading_path", text.strip(F.get("_hits", F.lit(0))).alias("line"))


def scan_cost(sections: DataFrame, within: Column | None = None, budget: int = SCAN_BUDGET) -> DataFrame:
    """id and whether the sections up to it, by id, stay within the scan budget.

    The running sum needs the ids in order only up to where the budget ends, so at most budget + 1
    sections are ordered: an empty text costs one place.
    """
    rows = sections.where(within) if within is not None else sections
    light = rows.select("id", F.length("text").alias("n")).orderBy("id").limit(budget + 1)
    total = F.sum("n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return light.select("id", (total <= budget).alias("within_budget"))
