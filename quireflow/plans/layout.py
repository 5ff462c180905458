"""Queries from glyphs to Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..sources.tables import cut_lineage
from .registry import CH, chars, query

#: The faces of the glyph table: name, declared weight (null: told by the name), italic.
FACES = [(0, "Plain", 400, False), (1, "Serif-Bold", None, False), (2, "Serif-Italic", 400, True), (3, "Heavy", 700, False)]
_FACES_SQL = "(values " + ", ".join(f"({n}, '{name}', {'null' if w is None else w}, {str(i).lower()})" for n, name, w, i in FACES) + ") as f(font, name, weight, italic)"


def faces(spark):
    """font, bold, italic: a declared weight tells, else the name does."""
    f = spark.createDataFrame(FACES, "font smallint, name string, weight int, italic boolean")
    return f.select("font", F.coalesce(F.col("weight") >= 600, F.lower("name").rlike("bold|black|heavy")).alias("bold"), "italic")


#: Lines by the rule of the growing band, a glyph a step, all pages side by side; then gaps, runs and the modal size.
LINES = f"""
face as (select font, coalesce(weight >= 600, regexp_matches(lower(name), 'bold|black|heavy')) as bold, italic from {_FACES_SQL}),
g0 as (select c.doc, c.page, c.idx, c.ch, c.rect.left::float as l, c.rect.right::float as r, c.rect.top::float as t, c.rect.bottom::float as b, c.size, coalesce(f.bold, false) as bold,
  coalesce(f.italic, false) as italic from {CH} c left join face f on f.font = c.font where c.ch <> '' and not regexp_matches(c.ch, '^\\p{{Cc}}')),
g as (select *, (t::double + b) / 2 as mid, row_number() over (partition by doc, page order by (t::double + b) / 2 desc, l, idx) as k from g0),
band as (select doc, page, k, t as top, b as bottom, 1 as line from g where k = 1
  union all select g.doc, g.page, g.k, case when j.joins then greatest(p.top, g.t) else g.t end, case when j.joins then least(p.bottom, g.b) else g.b end, p.line + case when j.joins then 0 else 1 end
  from band p join g on g.doc = p.doc and g.page = p.page and g.k = p.k + 1,
  lateral (select g.mid <= p.top + abs(g.t::double - g.b) * 0.25 and g.mid >= p.bottom - abs(g.t::double - g.b) * 0.25 as joins) j),
b1 as (select g.*, band.line from g join band using (doc, page, k)),
bucket as (select doc, page, line, floor((case when size > 0 then size else abs(t - b) end)::double * 2 + 0.5) / 2 as s, count(*) as n, min(l * 100000 + k) as seen from b1 where trim(ch) <> '' group by 1, 2, 3, 4),
sz as (select doc, page, line, arg_max(s, (n, seen)) as size from bucket group by 1, 2, 3),
b2 as (select b1.* exclude (size), sz.size, lag(r) over w as pr, lag(bold) over w as pb, lag(italic) over w as pi, lag(ch) over w as pch from b1 join sz using (doc, page, line) window w as (partition by doc, page, line order by l, k)),
ln as (select doc, page, dense_rank() over (partition by doc, page order by line)::int as line, min(l) as "left", max(r) as "right", max(t) as top, min(b) as bottom, max(size)::float as size,
  count(*)::int as glyphs, coalesce(max(l::double - pr) filter (where l::double - pr > 0), 0) as gap, (1 + count(*) filter (where pb is not null and (pb <> bold or pi <> italic)))::int as runs_n,
  string_agg(case when pr is not null and l::double - pr > size * 0.25 and trim(ch) <> '' and pch <> ' ' then ' ' || ch else ch end, '' order by l, k) as raw,
  count(*) filter (where bold) as bold_n from b2 group by doc, page, b2.line)"""


@query(f"""with recursive {LINES} select doc, page, line, round("left"::double, 2) as x0, round("right"::double, 2) as x1, round(top::double, 2) as y1, round(bottom::double, 2) as y0, size::double as size,
 glyphs, round(gap, 2)::double as gap, trim(raw) as text from ln""")
def glyph_lines(spark, d):
    """Lines of glyphs: growing bands from the top, blanks where the gap is a quarter of the line's modal size."""
    x = layout.lines_of(chars(spark, d), faces(spark))
    box = lambda c: F.round(F.col(c).cast("double"), 2)
    return x.select("doc", "page", "line", box("left").alias("x0"), box("right").alias("x1"), box("top").alias("y1"), box("bottom").alias("y0"), F.col("size").cast("double").alias("size"), "glyphs", box("gap").alias("gap"), F.trim("text").alias("text"))


@query(f"""with recursive {LINES}, w as (select doc, size, sum(length(trim(raw))) as n, min(page * 100000::bigint + line) as seen from ln group by 1, 2), s as (select doc, arg_max(size, (n, seen)) as body, list(size) as sizes from w group by doc)
select doc, body::double as body_size, array_to_string(list_transform(list_reverse_sort(list_filter(sizes, lambda x: x > body * 1.15))[1:6], lambda x: printf('%.1f', x)), ' ') as heading_sizes from s""")
def body_style(spark, d):
    """Body size by characters and the heading sizes of each document."""
    s = layout.style_of(layout.lines_of(chars(spark, d), faces(spark)))
    return s.select("doc", F.col("body_size").cast("double").alias("body_size"), F.array_join(F.transform("heading_sizes", lambda x: F.format_string("%.1f", x.cast("double"))), " ").alias("heading_sizes"))


_BLOCKS = LINES + """,
w as (select doc, size, sum(length(trim(raw))) as n, min(page * 100000::bigint + line) as seen from ln group by 1, 2), s as (select doc, arg_max(size, (n, seen)) as body, list(size) as sizes from w group by doc),
st as (select doc, body, list_reverse_sort(list_filter(sizes, lambda x: x > body * 1.15))[1:6] as heads from s),
k as (select ln.*, body, heads, regexp_extract(trim(raw), '^([•‣▪·–—*-]|[0-9]{1,3}[.)])\\s', 1) as marker from ln join st using (doc)),
lv as (select *, case when marker <> '' then null when list_position(heads, size) > 0 then list_position(heads, size)
  when bold_n * 2 > length(trim(raw)) and length(trim(raw)) <= 80 and size >= body then least(len(heads) + 1, 6) end as level from k),
pv as (select *, lag(level) over p as plevel, lag(bottom) over p as pbottom, lag("left") over p as pleft, row_number() over p as n from lv window p as (partition by doc, page order by line)),
bl as (select *, sum(case when n = 1 or level is not null or marker <> '' or plevel is not null or pbottom::double - top > body * 0.6 or "left"::double - pleft > body then 1 else 0 end) over (partition by doc, page order by line) as block from pv)"""


@query(f"""with recursive {_BLOCKS}
select doc, page, block::int as block, case when max(level) is not null then 'heading' when max(marker) <> '' then 'item' else 'paragraph' end as kind, max(level)::int as level, count(*)::int as lines,
 trim(string_agg(case when trim(raw) like '%-' and trim(raw) not like '%--' and nxt then left(t, length(t) - 1) when nxt then t || ' ' else t end, '' order by line)) as text
from (select *, lead(line) over (partition by doc, page, block order by line) is not null as nxt, trim(case when marker <> '' then substr(trim(raw), length(marker) + 1) else raw end) as t from bl) group by doc, page, block""")
def page_blocks(spark, d):
    """Headings, list items and paragraphs of each page; words parted at a line's end are joined."""
    lines = cut_lineage(layout.lines_of(chars(spark, d), faces(spark)))
    b = layout.blocks_of(lines)
    n = _lines_per_block(lines)
    return b.join(n, ["doc", "page", "block"]).select("doc", "page", "block", "kind", "level", "lines", F.trim("text").alias("text"))


def _lines_per_block(lines):
    return layout.numbered(lines).groupBy("doc", "page", "block").agg(F.count(F.lit(1)).cast("int").alias("lines"))


@query()
def markdown(spark, d):
    """Markdown of each block, in order; see markdown_of. No SQL: emphasis of runs is tested on small pages."""
    lines = cut_lineage(layout.lines_of(chars(spark, d), faces(spark)))
    return layout.markdown_of(cut_lineage(layout.blocks_of(lines)))
