"""Queries of page-order algebra, splits and trees of bookmarks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pageorder, trees
from .registry import BM, R, WO, bookmarks, query, results, words

PG = f"(select doc, page::int as page, row_number() over (partition by doc order by page)::int as pos, count(*) over (partition by doc) as n from (select distinct doc, page from {WO} where page is not null))"


def pages(spark, d):
    """doc, page, pos of every scanned page."""
    return pageorder.renumbered(words(spark, d).where(F.col("page").isNotNull()).select("doc", "page").distinct(), ["doc"], "page")


@query(f"""with p as (select * from {PG}), f as (select distinct run, ord, path as doc from {R}), s as (select run, ord, doc, max(p.n) as k from f join p using (doc) group by 1, 2, 3),
b as (select *, coalesce(sum(k) over (partition by run order by ord rows between unbounded preceding and 1 preceding), 0) as before from s)
select b.run, b.ord, p.doc, p.page, (b.before + p.pos)::bigint as pos from b join p using (doc)""")
def page_merge(spark, d):
    """The pages of all files of a run in input order, as one document; a file that comes again brings its pages again."""
    files = results(spark, d).select("run", "ord", F.col("path").alias("doc"))
    return pageorder.merge(files.join(pages(spark, d), "doc"), ["run"], "ord").select("run", "ord", "doc", "page", "pos")


@query(f"select doc, page, nth::int as pos from {PG} p, lateral (select row_number() over (order by i) as nth, v from (select unnest([1, 2, 3, 4]) as i, unnest([3, 1, 1, 2]) as v) where v <= p.n) o where v = p.pos")
def page_extract(spark, d):
    """Pages 3, 1, 1 and 2 of each document, as far as there are such."""
    order = F.posexplode(F.array(*[F.lit(x) for x in (3, 1, 1, 2)])).alias("nth", "pos")
    p = pages(spark, d)
    return pageorder.extract(p, p.select("doc").distinct().select("doc", order)).select("doc", "page", "pos")


@query(f"""with p as (select *, pos % 2 = 1 as doomed, bool_and(pos % 2 = 1) over (partition by doc) as refused from {PG})
select doc, page, row_number() over (partition by doc order by pos)::int as pos, refused from p where not doomed or refused""")
def page_delete(spark, d):
    """Odd pages deleted; refused where no page would be left."""
    return pageorder.delete(pages(spark, d), F.col("pos") % 2 == 1).select("doc", "page", "pos", "refused")


@query(f"select doc, page, copy::int as copy, row_number() over (partition by doc order by pos, copy)::int as pos from {PG} p, lateral (select unnest(range(0, case when p.pos % 3 = 0 then 3 else 1 end)) as copy) c")
def page_duplicate(spark, d):
    """Every third page followed by two copies of it."""
    return pageorder.duplicate(pages(spark, d), F.when(F.col("pos") % 3 == 0, 2).otherwise(0)).select("doc", "page", "copy", "pos")


@query(f"""select doc, page, case when n % 4 = 0 then pos when pos = n then 1 else pos + 1 end::int as pos, n % 4 = 0 as refused from {PG}""")
def page_reorder(spark, d):
    """The last page first, all others after it; a document with a multiple of four pages names a position twice and is refused."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    to = F.when(n % 4 == 0, 1).when(F.col("pos") == n, 1).otherwise(F.col("pos") + 1)
    return pageorder.reorder(pages(spark, d), to).select("doc", "page", F.col("pos").cast("int").alias("pos"), "refused")


@query(f"""select doc, page, row_number() over (partition by doc order by case when pos = 2 then n + 1 else pos end)::int as pos from {PG}""")
def page_move(spark, d):
    """The second page taken out and put in at the end."""
    p = pages(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    to = pageorder.moved(F.col("pos"), F.lit(2), F.greatest("n", F.lit(2)))
    return p.select("doc", "page", F.when(F.col("n") < 2, F.col("pos")).otherwise(to).cast("int").alias("pos"))


@query(f"""with p as (select * from {PG}), a as (select doc, page, pos, 0 as src, case when pos <= 1 then 0 else 2 end as part from p union all select doc, page, pos, 1, 1 from p where pos >= n - 1),
r as (select doc, page, row_number() over (partition by doc order by part, pos) as pos, false as replaced from a union all
 select doc, page, row_number() over (partition by doc order by part, pos), true from a where not (src = 0 and pos = 2)) select doc, page, pos::int as pos, replaced from r""")
def page_insert(spark, d):
    """The last two pages put in again after the first, with and without taking the place of the second."""
    p = pages(spark, d)
    late = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc"))).where(F.col("pos") >= F.col("n") - 1).select("doc", "page", "pos")
    both = [pageorder.insert(p, late, "1", r).withColumn("replaced", F.lit(r)) for r in (False, True)]
    return both[0].unionByName(both[1]).select("doc", "page", "pos", "replaced")


@query(f"""with p as (select * from {PG}), e as (select doc, 'every' as how, (pos - 1) // 4 as g, pos from p union all select doc, 'each', pos, pos from p union all
 select doc, 'ranges', r.g, pos from p join (values (1, 1, 3), (2, 2, 2), (3, 5, 100)) r(g, a, z) on pos between a and z), g as (select doc, how, g, min(pos) as a, max(pos) as z, count(*) as pages from e group by all)
select doc, how, case when a = z then 'page-' || a else 'pages-' || a || '-' || z end as name, pages from g""")
def page_split(spark, d):
    """Pieces of each page, of every four pages, and of the ranges 1-3, 2 and 5 on, with their names."""
    p = pages(spark, d)
    ranges = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(a).alias("a"), F.lit(z).alias("z")) for g, a, z in ((1, 1, 3), (2, 2, 2), (3, 5, 100))])).alias("r")
    every = p.select("doc", F.lit("every").alias("how"), F.floor((F.col("pos") - 1) / 4).cast("int").alias("g"), "pos")
    each = p.select("doc", F.lit("each").alias("how"), F.col("pos").alias("g"), "pos")
    some = p.select("doc", "pos", ranges).where(F.col("pos").between(F.col("r.a"), F.col("r.z"))).select("doc", F.lit("ranges").alias("how"), F.col("r.g").alias("g"), "pos")
    g = every.unionByName(each).unionByName(some).groupBy("doc", "how", "g").agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.count(F.lit(1)).alias("pages"))
    return g.select("doc", "how", pageorder.piece_name(F.col("a"), F.col("z")).alias("name"), "pages")


@query(f"""with n as (select doc, max(page) as n from {BM} where page is not null group by doc), k as (select doc, n + 3 as n from n),
s as (select distinct b.doc, b.page as a from {BM} b join k on k.doc = b.doc where b.parent is null and b.page between 1 and k.n union select doc, 1 from k),
e as (select s.doc, a, coalesce(lead(a) over (partition by s.doc order by a) - 1, k.n) as z from s join k on k.doc = s.doc) select doc, a::int as start_page, z::int as end_page, case when a = z then 'page-' || a else 'pages-' || a || '-' || z end as name from e""")
def split_at_bookmarks(spark, d):
    """Page ranges between the top bookmarks of each document: from page 1, whatever comes before the first bookmark, to the last page.

    The page count of a document is taken as three more than its last bookmarked page (on both sides), so that pages after the last bookmark occur.
    """
    b = bookmarks(spark, d).where(F.col("page").isNotNull())
    n = b.groupBy("doc").agg((F.max("page") + 3).alias("n"))
    tops = b.where(F.col("parent").isNull()).join(n, "doc").where(F.col("page").between(1, F.col("n"))).select("doc", "n", F.col("page").alias("a"))
    starts = tops.unionByName(n.select("doc", "n", F.lit(1).alias("a"))).distinct()
    z = F.coalesce(F.lead("a").over(Window.partitionBy("doc").orderBy("a")) - 1, F.col("n"))
    e = starts.select("doc", F.col("a").alias("start_page"), z.alias("end_page"))
    return e.withColumn("name", pageorder.piece_name(F.col("start_page"), F.col("end_page")))


_T = f"""b as (select doc, node, parent, ord, page, title from {BM}), t as (select doc, node, 0 as depth, [ord] as path, page as inherited from b where parent is null
 union all select b.doc, b.node, t.depth + 1, list_append(t.path, b.ord), coalesce(b.page, t.inherited) from t join b on b.doc = t.doc and b.parent = t.node)"""


@query(f"with recursive {_T} select doc, node, depth::int as depth, array_to_string(path, '.') as label from t")
def bookmark_paths(spark, d):
    """Depth and Dewey label of each bookmark that the top reaches."""
    w = trees.ways_to_top(bookmarks(spark, d), "doc", "node", "parent", "ord")
    return w.select("doc", "node", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("label"))


@query(f"with recursive {_T} select doc, node, inherited::int as page from t")
def inherited_pages(spark, d):
    """The page of each bookmark, or of the nearest bookmark above it that has one (the rule by which pages and form fields inherit attributes)."""
    w = trees.ways_to_top(bookmarks(spark, d), "doc", "node", "parent", "ord", "page")
    return w.select("doc", "node", F.col("inherited").alias("page"))


@query(f"""with recursive {_T}, w as (select distinct doc, node, path from t) select w.doc, w.node, count(x.node) as below from w left join w x on x.doc = w.doc and len(x.path) > len(w.path) and x.path[1:len(w.path)] = w.path group by w.doc, w.node, w.path""")
def subtree_sizes(spark, d):
    """How many bookmarks stand below each."""
    return trees.subtree_counts(trees.ways_to_top(bookmarks(spark, d), "doc", "node", "parent", "ord"), "doc", "node")


@query("""with e as (select user_id, event_id, event_type, sum(case when event_type = 'error' then -1 else 1 end) over w as s from events window w as (partition by user_id order by event_id)),
l as (select *, s - least(0, min(s) over (partition by user_id order by event_id rows unbounded preceding)) as level from e),
f as (select *, min(level) over (partition by user_id order by event_id rows between 1 following and unbounded following) as low from l)
select user_id, event_id, row_number() over (partition by user_id order by event_id)::int as step from f where event_type <> 'error' and (low is null or low >= level)""")
def edits_left(spark, d):
    """A log of edits where an error undoes the last one that stands: the edits that a replay applies, in order. Undoing nothing does nothing."""
    from ..sources.tables import table

    by = Window.partitionBy("user_id").orderBy("event_id")
    past, later = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, d, "events").withColumn("s", F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1)).over(past))
    e = e.withColumn("level", F.col("s") - F.least(F.lit(0), F.min("s").over(past))).withColumn("low", F.min("level").over(later))
    kept = e.where((F.col("event_type") != "error") & (F.col("low").isNull() | (F.col("low") >= F.col("level"))))
    return kept.select("user_id", "event_id", F.row_number().over(by).alias("step"))
