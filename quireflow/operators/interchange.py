"""Form data as XFDF, FDF and JSON texts and back, and the rows of recognition output.

One document's form is one text: its fields, by name. Texts that aren't of the form give no rows; null texts neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def form_documents(fields: DataFrame) -> DataFrame:
    """doc, json, xfdf, fdf: a document's fields sorted by name; of fields of one name the last in written order counts."""
    last = fields.where(F.col("name").isNotNull()).groupBy("doc", "name").agg(F.max_by(F.coalesce("value", F.lit("")), F.struct("ord", "field_id")).alias("value"))
    g = last.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("f"))
    rows = lambda one: F.array_join(F.transform("f", one), "\n")
    xfdf = rows(lambda x: F.concat(F.lit('<field name="'), T.xml_escaped(x["name"]), F.lit('"><value>'), T.xml_escaped(x["value"]), F.lit("</value></field>")))
    fdf = rows(lambda x: F.concat(F.lit("<< /T ("), T.fdf_escaped(x["name"]), F.lit(") /V ("), T.fdf_escaped(x["value"]), F.lit(") >>")))
    return g.select("doc", F.to_json(F.map_from_entries("f")).alias("json"), xfdf.alias("xfdf"), fdf.alias("fdf"))


_FIELD = r'<field name="([^"]*)">\s*(?:<value>([^<]*)</value>|<value/>)?'


def parse_xfdf(text: Column) -> Column:
    """Array of (name, value) of the fields; a field without value has an empty one."""
    each = F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0))
    part = lambda x, n: T.xml_unescaped(F.regexp_extract(x, _FIELD, n))
    return F.transform(each, lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).alias("value")))


def _pdf_string(text: str, at: int) -> tuple[str, int]:
    """The string whose bracket opens at `at`: brackets may nest, a backslash takes the next character as it is."""
    out: list[str] = []
    depth, i = 1, at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(text[i], text[i]))
        elif c == ")" and depth == 1:
            return "".join(out), i + 1
        else:
            depth += (c == "(") - (c == ")")
            out.append(c)
        i += 1
    return "".join(out), i


def fdf_fields(text: str | None) -> list[tuple[str, str]]:
    """(name, value) of each /T and the /V after it, before the next /T; without one the value is empty."""
    out: list[tuple[str, str]] = []
    at = 0
    key = regex.compile(r"/([TV])\s*\(")
    while text and (m := key.search(text, at)):
        s, at = _pdf_string(text, m.end() - 1)
        if m[1] == "T":
            out.append((s, ""))
        elif out:
            out[-1] = (out[-1][0], s)
    return out


def parse_fdf(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, value of the fields of each FDF text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, v) for k, t in zip(pdf[key], pdf[text], strict=True) for n, v in fdf_fields(t)]
            yield pd.DataFrame(rows, columns=[key, "name", "value"])

    return df.select(key, text).mapInPandas(work, f"{key} {df.schema[key].dataType.simpleString()}, name string, value string")


def parse_tsv(lines: DataFrame, column: str, least: float) -> DataFrame:
    """Words of recognition output, one line a row: twelve columns by tabs, level 5; lines that don't parse, empty words, those without extent and those below the least confidence are left out."""
    c = F.split(F.col(column), "\t")
    part = lambda i: F.get(c, i)
    whole = lambda i: F.when(part(i).rlike(r"^[+-]?[0-9]+$"), part(i).try_cast("int"))
    d = lines.where((F.size(c) >= 12) & (part(0) == "5"))
    names = {"block": 2, "par": 3, "line": 4, "left_px": 6, "top_px": 7, "width_px": 8, "height_px": 9}
    confidence = F.when(part(10).rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), part(10).try_cast("float"))
    d = d.select(*[x for x in lines.columns if x != column], *[whole(i).alias(n) for n, i in names.items()], confidence.alias("confidence"), F.trim(part(11)).alias("text"))
    return d.where((F.col("text") != "") & (F.col("confidence") >= least) & (F.col("width_px") > 0) & (F.col("height_px") > 0)).dropna(subset=list(names))
