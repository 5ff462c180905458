"""Glyphs of a page to lines, lines to blocks, blocks to Markdown.

Bands of lines grow with the glyphs they take up, so a line depends on all glyphs before it: this is worked out page by
page in Python; a page is the unit, whatever the document's length. The style of a document (body size, heading sizes) is
an aggregate over its lines and comes back by a join. Glyphs with a null character, box or size take no part; a document
without glyphs has no rows. Further columns of the input are not passed on.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slack of a band in heights of the glyph, width of a blank in sizes of the line, step of a heading's size,
#: gap of a paragraph in body sizes, longest bold heading, most heading sizes.
SLACK, BLANK, STEP, GAP, BOLD_HEADING, LEVELS = 0.25, 0.25, 1.15, 0.6, 80, 6
_MARKER = regex.compile(r"\s*(?:([•‣▪·\-–—*])|([0-9]{1,3})[.)])(?=\s)")
_RUNS = "array<struct<text string, bold boolean, italic boolean>>"


def half_points(size: float) -> float:
    """Sizes to the nearest half point, halves away from zero."""
    return int(size * 2 + 0.5) / 2


def mode_of(values: list[float]) -> float:
    """The most frequent value; of several the one that was first seen last. 0 for none."""
    seen: dict[float, int] = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    best = 0.0
    for v, n in seen.items():
        if n >= seen.get(best, 0):
            best = v
    return best


def page_lines(glyphs: list[dict]) -> list[dict]:
    """Lines of one page from top to bottom. glyphs: ch, left, right, top, bottom, size, bold, italic in written order."""
    placed = [g for g in glyphs if unicodedata.category(g["ch"][0]) != "Cc"]
    placed.sort(key=lambda g: (-(g["top"] + g["bottom"]) / 2, g["left"]))
    bands: list[list[dict]] = []
    top = bottom = 0.0
    for g in placed:
        centre, slack = (g["top"] + g["bottom"]) / 2, abs(g["top"] - g["bottom"]) * SLACK
        if bands and bottom - slack <= centre <= top + slack:
            top, bottom = max(top, g["top"]), min(bottom, g["bottom"])
            bands[-1].append(g)
        else:
            bands.append([g])
            top, bottom = g["top"], g["bottom"]
    return [x for x in map(_line, bands) if x]


def _line(band: list[dict]) -> dict | None:
    band.sort(key=lambda g: g["left"])
    size = mode_of([half_points(g["size"] if g["size"] > 0 else abs(g["top"] - g["bottom"])) for g in band if not g["ch"].isspace()])
    runs: list[dict] = []
    gap, centre, before = 0.0, None, None
    for g in band:
        wide = before is not None and g["left"] - before > size * BLANK and not g["ch"].isspace()
        if before is not None and g["left"] - before > gap:
            gap, centre = g["left"] - before, (g["left"] + before) / 2
        if runs and (runs[-1]["bold"], runs[-1]["italic"]) == (g["bold"], g["italic"]):
            runs[-1]["text"] += (" " if wide and not runs[-1]["text"].endswith(" ") else "") + g["ch"]
        else:
            runs.append({"text": (" " if wide and runs else "") + g["ch"], "bold": g["bold"], "italic": g["italic"]})
        before = g["right"]
    while runs and not runs[0]["text"].lstrip():
        runs.pop(0)
    while runs and not runs[-1]["text"].rstrip():
        runs.pop()
    if not runs:
        return None
    runs[0]["text"], runs[-1]["text"] = runs[0]["text"].lstrip(), runs[-1]["text"].rstrip()
    box = {"left": min(g["left"] for g in band), "right": max(g["right"] for g in band), "top": max(g["top"] for g in band), "bottom": min(g["bottom"] for g in band)}
    return {**box, "size": size, "gap": gap, "centre": centre, "runs": runs, "glyphs": len(band)}


def lines_of(chars: DataFrame, faces: DataFrame) -> DataFrame:
    """doc, page, line, left, right, top, bottom, size, gap, centre, glyphs, text, runs, bold_chars.

    chars: doc, page, idx, ch, rect, size, font; faces: font, bold, italic (as many rows as a corpus has faces; a
    glyph whose font is unknown is neither).
    """
    g = chars.where(F.col("ch").isNotNull() & (F.col("ch") != "") & F.col("rect").isNotNull() & F.col("size").isNotNull())
    g = g.join(faces, "font", "left")
    g = g.select("doc", "page", "idx", "ch", "rect.left", "rect.right", "rect.top", "rect.bottom", "size", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"))

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, number = pdf["doc"].iloc[0], pdf["page"].iloc[0]
        found = page_lines(pdf.sort_values("idx", kind="stable").to_dict("records"))
        rows = []
        for n, x in enumerate(found, 1):
            bold = sum(len(r["text"]) for r in x["runs"] if r["bold"])
            rows.append((doc, number, n, x["left"], x["right"], x["top"], x["bottom"], x["size"], x["gap"], x["centre"], x["glyphs"], "".join(r["text"] for r in x["runs"]), x["runs"], bold))
        return pd.DataFrame(rows, columns=["doc", "page", "line", "left", "right", "top", "bottom", "size", "gap", "centre", "glyphs", "text", "runs", "bold_chars"])

    return g.groupBy("doc", "page").applyInPandas(
        page, f"doc string, page int, line int, left float, right float, top float, bottom float, size float, gap double, centre double, glyphs int, text string, runs {_RUNS}, bold_chars int"
    )


def style_of(lines: DataFrame) -> DataFrame:
    """doc, body_size, heading_sizes: the size that most characters have (of several the one first seen last), and the larger sizes, the largest first."""
    n = F.length(F.trim("text"))
    sizes = lines.groupBy("doc", "size").agg(F.sum(n).alias("n"), F.min(F.struct("page", "line")).alias("first"))
    body = sizes.groupBy("doc").agg(F.max_by("size", F.struct("n", "first")).alias("body_size"), F.collect_set("size").alias("sizes"))
    larger = F.filter("sizes", lambda s: s.cast("double") > F.col("body_size").cast("double") * STEP)
    return body.select("doc", "body_size", F.slice(F.sort_array(larger, asc=False), 1, LEVELS).alias("heading_sizes"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with item, marker, level and the number of the block on the page that each belongs to."""
    d = lines.join(style_of(lines), "doc")
    pg = Window.partitionBy("doc", "page").orderBy("line")
    text = F.col("text")
    marker = F.regexp_extract(text, r"^\s*([•‣▪·\-–—*]|[0-9]{1,3}[.)])\s", 1)
    item = marker != ""
    rank = F.array_position("heading_sizes", F.col("size"))
    bold = (F.col("bold_chars") * 2 > F.length("text")) & (F.length(F.trim("text")) <= BOLD_HEADING) & (F.col("size") >= F.col("body_size"))
    level = F.when(item, None).when(rank > 0, rank).when(bold, F.least(F.size("heading_sizes") + 1, F.lit(LEVELS))).cast("int")
    d = d.withColumn("item", item).withColumn("marker", marker).withColumn("level", level)
    body = F.when(F.col("body_size") > 0, F.col("body_size")).otherwise(F.greatest(F.col("size"), F.lit(1.0))).cast("double")
    prev = lambda c: F.lag(c).over(pg)
    broken = (prev("bottom").cast("double") - F.col("top") > body * GAP) | (F.col("left").cast("double") - prev("left") > body)
    starts = prev("line").isNull() | F.col("level").isNotNull() | F.col("item") | prev("level").isNotNull() | broken
    return d.withColumn("block", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(pg.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """doc, page, block, kind (heading, item, paragraph), level, ordered, text, runs: the blocks of each page."""
    d = numbered(lines)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block, part in pdf.sort_values("line").groupby("block", sort=True):
            first = part.iloc[0]
            runs: list[dict] = []
            for k, own in enumerate(part["runs"]):
                own = [dict(r) for r in own]
                if k == 0 and first["item"]:
                    own[0]["text"] = own[0]["text"].lstrip().removeprefix(first["marker"]).lstrip()
                    own = [r for r in own if r["text"]]
                elif k and runs:
                    last = runs[-1]["text"]
                    if last.endswith("-") and not last.endswith("--"):
                        runs[-1]["text"] = last[:-1]
                    elif not last.endswith(" "):
                        runs[-1]["text"] += " "
                for r in own:
                    if runs and (runs[-1]["bold"], runs[-1]["italic"]) == (r["bold"], r["italic"]):
                        runs[-1]["text"] += r["text"]
                    else:
                        runs.append(r)
            text = "".join(r["text"] for r in runs)
            if not text.strip():
                continue
            heading = pd.notna(first["level"])
            if heading:
                runs = [{"text": text, "bold": False, "italic": False}]
            kind = "heading" if heading else "item" if first["item"] else "paragraph"
            ordered = bool(first["item"]) and first["marker"][0].isdigit()
            rows.append((first["doc"], first["page"], int(block), kind, int(first["level"]) if heading else None, ordered, text, runs))
        out = pd.DataFrame(rows, columns=["doc", "page", "block", "kind", "level", "ordered", "text", "runs"])
        out["level"] = out["level"].astype("Int32")
        return out

    d = d.select("doc", "page", "block", "line", "item", "marker", "level", "runs")
    return d.groupBy("doc", "page").applyInPandas(assemble, f"doc string, page int, block int, kind string, level int, ordered boolean, text string, runs {_RUNS}")


def emphasised(runs: list[dict]) -> str:
    """Bold and italic marked, the marks against the words."""
    out = ""
    for r in runs:
        mark, core = "**" * r["bold"] + "*" * r["italic"], r["text"].strip()
        at = r["text"].find(core)
        out += r["text"][:at] + mark + core + mark + r["text"][at + len(core) :] if mark and core else r["text"]
    return out


def escape_leading(text: str) -> str:
    """Body text that would begin a heading, a list, a quotation or a table gets a backslash."""
    if text[:1] and text[0] in "#-+>*=|":
        return "\\" + text
    return regex.sub(r"^([0-9]+)([.)]\s)", r"\1\\\2", text)


def markdown_of(blocks: DataFrame) -> DataFrame:
    """doc, page, block, piece, tight: what each block is in Markdown, and whether it stands right under the one before.

    A document's Markdown is its pieces in order, joined by a line break where tight, else by a blank line. Numbers of
    ordered items go on over pages until another block comes between; they are counted within pages and carried over the
    pages of a document, so that no task holds the blocks of a document.
    """
    pg = Window.partitionBy("doc", "page").orderBy("block")
    number = (F.col("kind") == "item") & F.col("ordered")
    d = blocks.withColumn("resets", F.sum(F.when(number, 0).otherwise(1)).over(pg.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("nth", F.sum(number.cast("int")).over(Window.partitionBy("doc", "page", "resets").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("before", F.lag("kind").over(pg))
    pages = d.groupBy("doc", "page").agg(F.max("resets").alias("r"), F.max_by("nth", "block").alias("trail"), F.max_by("kind", "block").alias("last"))
    by_page = Window.partitionBy("doc").orderBy("page")
    # an era of pages begins with one that has another block; the numbers at the end of its pages add up
    pages = pages.withColumn("era", F.sum((F.col("r") > 0).cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    pages = pages.withColumn("so_far", F.sum("trail").over(Window.partitionBy("doc", "era").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    pages = pages.withColumn("carry", F.coalesce(F.lag("so_far").over(by_page), F.lit(0)))
    d = d.join(pages.select("doc", "page", "carry", F.lag("last").over(by_page).alias("page_before")), ["doc", "page"])
    ordinal = F.col("nth") + F.when(F.col("resets") == 0, F.col("carry")).otherwise(0)
    lead = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).when(number, F.concat(ordinal.cast("string"), F.lit(". "))).when(F.col("kind") == "item", "- ").otherwise("")

    @F.pandas_udf("string")
    def body(kind: pd.Series, text: pd.Series, runs: pd.Series) -> pd.Series:
        rows = zip(kind, text, runs, strict=True)
        return pd.Series([t.strip() if k == "heading" else emphasised(list(r)).strip() if k == "item" else escape_leading(emphasised(list(r)).strip()) for k, t, r in rows], dtype=object)

    tight = (F.col("kind") == "item") & (F.coalesce("before", "page_before") == "item")
    return d.select("doc", "page", "block", F.concat(lead, body("kind", "text", "runs")).alias("piece"), F.coalesce(tight, F.lit(False)).alias("tight"))
