"""Page-order algebra: pages are rows (doc, page, pos), pos from 1; every operation gives rows with a new pos.

Operations that would leave a document without pages, or that name no full permutation, leave it as it was and say so
in `refused`. Positions beyond a document's pages name nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def renumbered(d: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """d with pos counted anew within the keys."""
    return d.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def extract(pages: DataFrame, order: DataFrame) -> DataFrame:
    """The pages that order (doc, nth, pos) names, in its order; a page may come again."""
    return renumbered(pages.join(order, ["doc", "pos"]), ["doc"], "nth").drop("nth")


def delete(pages: DataFrame, doomed: Column) -> DataFrame:
    """pages without those where `doomed` holds; a document keeps all of them if none would be left."""
    doc = Window.partitionBy("doc")
    d = pages.withColumn("_out", F.coalesce(doomed, F.lit(False))).withColumn("refused", F.min(F.col("_out").cast("int")).over(doc) == 1)
    return renumbered(d.where(~F.col("_out") | F.col("refused")).drop("_out"), ["doc"], "pos")


def duplicate(pages: DataFrame, copies: Column) -> DataFrame:
    """Each page followed by its copies; their number is a column of the page's own row."""
    d = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(copies, F.lit(0)), F.lit(0)).cast("int"))))
    return renumbered(d, ["doc"], "pos", "copy")


def reorder(pages: DataFrame, target: Column) -> DataFrame:
    """Pages at the target positions; refused for documents whose targets are no permutation of 1 to n."""
    doc = Window.partitionBy("doc")
    n = F.count(F.lit(1)).over(doc)
    d = pages.withColumn("_to", target.cast("int"))
    again = F.count(F.lit(1)).over(Window.partitionBy("doc", "_to"))
    d = d.withColumn("_bad", (~F.coalesce(F.col("_to").between(1, n), F.lit(False)) | (again > 1)).cast("int"))
    d = d.withColumn("refused", F.max("_bad").over(doc) == 1)
    return d.withColumn("pos", F.when(F.col("refused"), F.col("pos")).otherwise(F.col("_to"))).drop("_to", "_bad")


def moved(pos: Column, begin: Column, end: Column) -> Column:
    """The position of a page after the page at begin was taken out and put in at end."""
    return (
        F.when(pos == begin, end).when((begin < end) & (pos > begin) & (pos <= end), pos - 1).when((begin > end) & (pos >= end) & (pos < begin), pos + 1).otherwise(pos)
    )


def merge(pages: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Pages of the documents of each key one after another by `first`: sums per document before positions, so that a page's new place needs no sort of all pages."""
    sizes = pages.groupBy(*keys, first).agg(F.max("pos").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    return pages.join(sizes.select(*keys, first, F.coalesce(before, F.lit(0)).alias("_before")), [*keys, first]).withColumn("pos", F.col("_before") + F.col("pos")).drop("_before")


def insert(pages: DataFrame, others: DataFrame, after: Column | str, replace: bool = False) -> DataFrame:
    """others (doc, page, pos) put in after the position `after` of each document (0: at the front); with replace the page that follows goes."""
    a = pages.withColumn("_after", F.expr(after) if isinstance(after, str) else after)
    if replace:
        a = a.where(F.col("pos") != F.col("_after") + 1)
    at = pages.groupBy("doc").agg(F.first(F.expr(after) if isinstance(after, str) else after).alias("_after"))
    own = a.select("doc", "page", F.when(F.col("pos") <= F.col("_after"), 0).otherwise(2).alias("_part"), "pos")
    new = others.join(at, "doc").select("doc", "page", F.lit(1).alias("_part"), "pos")
    return renumbered(own.unionByName(new), ["doc"], "_part", "pos").drop("_part")


def piece_name(first: Column, last: Column) -> Column:
    """page-3 or pages-1-10."""
    return F.when(first == last, F.concat(F.lit("page-"), first.cast("string"))).otherwise(F.concat(F.lit("pages-"), first.cast("string"), F.lit("-"), last.cast("string")))
