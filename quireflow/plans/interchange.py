"""Queries of imports, exports, search, metadata, configuration, caches and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import interchange
from ..sources.tables import table
from .registry import BM, CH, FF, R, SG, WO, bookmarks, chars, fields, query, results, signatures, words

_X = "replace(replace(replace(replace({0},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;')"
_P = "replace(replace(replace({0},'\\','\\\\'),'(','\\('),')','\\)')"
_LAST = f"(select doc, name, arg_max(coalesce(value, ''), (ord, field_id)) as value from {FF} where name is not null group by doc, name)"


@query(f"""select doc, string_agg('<field name="' || {_X.format("name")} || '"><value>' || {_X.format("value")} || '</value></field>', chr(10) order by name) as xfdf,
 string_agg('<< /T (' || {_P.format("name")} || ') /V (' || {_P.format("value")} || ') >>', chr(10) order by name) as fdf from {_LAST} group by doc""")
def form_documents(spark, d):
    """Each document's form as XFDF and FDF, fields sorted by name."""
    return interchange.form_documents(fields(spark, d)).select("doc", "xfdf", "fdf")


@query(f"select doc, name, value, value as fdf_value, value as json_value from {_LAST}")
def form_round_trip(spark, d):
    """What the three forms give when they are read again."""
    x = interchange.form_documents(fields(spark, d))
    a = x.select("doc", F.explode(interchange.parse_xfdf(F.col("xfdf"))).alias("f")).select("doc", "f.name", "f.value")
    b = interchange.parse_fdf(x, "doc", "fdf").withColumnRenamed("value", "fdf_value")
    c = x.select("doc", F.explode(F.from_json("json", "map<string,string>")).alias("name", "json_value"))
    return a.join(b, ["doc", "name"], "full").join(c, ["doc", "name"], "full")


_TSV = "case when word_id % 31 = 0 then '4' else '5' end || chr(9) || '1' || chr(9) || case when word_id % 37 = 0 then 'x' else line.block::varchar end || chr(9) || line.par || chr(9) || line.line || chr(9) || '1' || chr(9) || left_px || chr(9) || top_px || chr(9) || width_px || chr(9) || case when word_id % 41 = 0 then 0 else height_px end || chr(9) || round(coalesce(confidence, -1)::double, 1)"


@query(f"""select word_id, line.block as block, line.par as par, line.line as line, left_px, top_px, width_px, height_px, round(round(confidence::double, 1)::float::double, 1) as confidence, trim(text, ' ') as text from {WO}
where word_id % 31 <> 0 and word_id % 37 <> 0 and word_id % 41 <> 0 and word_id % 43 <> 0 and round(confidence::double, 1)::float >= 40 and trim(text, ' ') <> '' and width_px > 0 and height_px > 0""")
def ocr_rows(spark, d):
    """Recognition output as tab-separated lines (rows of another level, broken numbers, missing columns and words without height are planted), read back as words."""
    tab = F.lit("\t")
    w = F.col("word_id")
    level, block = F.when(w % 31 == 0, "4").otherwise("5"), F.when(w % 37 == 0, "x").otherwise(F.col("line.block").cast("string"))
    parts = [level, F.lit("1"), block, F.col("line.par"), F.col("line.line"), F.lit("1"), F.col("left_px"), F.col("top_px"), F.col("width_px"), F.when(w % 41 == 0, 0).otherwise(F.col("height_px"))]
    sep = [y for x in parts for y in (x.cast("string"), tab)]
    conf = F.format_string("%.1f", F.round(F.coalesce("confidence", F.lit(-1.0)).cast("double"), 1))
    line = F.when(w % 43 == 0, F.concat(*sep, conf)).otherwise(F.concat(*sep, conf, tab, F.col("text")))
    x = interchange.parse_tsv(words(spark, d).select("word_id", line.alias("row")), "row", 40.0)
    return x.withColumn("confidence", F.round(F.col("confidence").cast("double"), 1))


@query(f"with w as (select unnest(['sign_here_1', 'name_1', 'zzz', 'date_2']) as asked), d as (select distinct doc from {FF}) select d.doc, w.asked from d, w where not exists (select 1 from {FF} f where f.doc = d.doc and f.name = w.asked)")
def unknown_fields(spark, d):
    """Fields that are asked for and that a document's form doesn't have: names collected per document only as far as they are asked for."""
    asked = F.array(*[F.lit(x) for x in ("sign_here_1", "name_1", "zzz", "date_2")])
    known = F.collect_set(F.when(F.array_contains(asked, F.col("name")), F.col("name")))
    return fields(spark, d).groupBy("doc").agg(known.alias("known")).select("doc", F.explode(F.array_except(asked, "known")).alias("asked"))


@query("select a.lang as missing from (select unnest(string_split('en+fr+zz+de+qq', '+')) as lang) a where a.lang not in (select lang from documents where lang is not null)")
def missing_packs(spark, d):
    """Languages of a request that the corpus doesn't have."""
    asked = spark.createDataFrame([("en+fr+zz+de+qq",)], "asked string").select(F.explode(F.split("asked", r"\+")).alias("missing"))
    return asked.join(table(spark, d, "documents").select(F.col("lang").alias("missing")).distinct(), "missing", "left_anti")


@query(f"""select run, ord, 'out/' || regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) || '-small.pdf' as output, coalesce(error_code, 'none') = 'E_OUTPUT_EXISTS' as refused,
 row_number() over (partition by run, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) order by ord) > 1 as taken from {R}""")
def output_names(spark, d):
    """Where each input's output goes in a batch (a directory, stem and suffix), whether it was refused, and whether an earlier input of the run takes the same name."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    taken = F.row_number().over(Window.partitionBy("run", "stem").orderBy("ord")) > 1
    return results(spark, d).withColumn("stem", stem).select("run", "ord", F.concat(F.lit("out/"), "stem", F.lit("-small.pdf")).alias("output"), (F.coalesce("error_code", F.lit("none")) == "E_OUTPUT_EXISTS").alias("refused"), taken.alias("taken"))


@query(f"""select run, count(*) filter (where ok) || ' of ' || count(*) || ' file' || case when count(*) = 1 then '' else 's' end || ' done, ' || count(*) filter (where not ok) || ' failed; ' ||
 format('{{:,}}', coalesce(sum(bytes_in) filter (where ok), 0)::bigint) || ' → ' || format('{{:,}}', coalesce(sum(bytes_out) filter (where ok), 0)::bigint) || ' bytes' as line from {R} group by run""")
def batch_report(spark, d):
    """One line for people on each run."""
    ok, n = F.col("ok"), F.count(F.lit(1))
    r = results(spark, d).groupBy("run").agg(n.alias("n"), F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"), F.coalesce(F.sum(F.when(ok, F.col("bytes_in"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(ok, F.col("bytes_out"))), F.lit(0)).alias("o"))
    s = lambda c: F.col(c).cast("string")
    return r.select("run", F.concat(s("good"), F.lit(" of "), s("n"), F.lit(" file"), T.plural(F.col("n")), F.lit(" done, "), s("bad"), F.lit(" failed; "), T.thousands(F.col("i")), F.lit(" → "), T.thousands(F.col("o")), F.lit(" bytes")).alias("line"))


_META = f"""t as (select doc, arg_min(title, node) as title, arg_max(title, node) as new_title from {BM} where title is not null group by doc),
a as (select doc, arg_min(coalesce(declared_name, ''), sig_id) as author, arg_min(coalesce(reason, ''), sig_id) as subject, arg_max(coalesce(reason, ''), sig_id) as new_subject from {SG} group by doc),
m as (select coalesce(t.doc, a.doc) as doc, case when trim(t.title) <> '' then t.title end as title, case when trim(t.new_title) <> '' then t.new_title end as new_title, case when trim(author) <> '' then author end as author,
 case when trim(subject) <> '' then subject end as subject, case when trim(new_subject) <> '' then new_subject end as new_subject from t full join a on t.doc = a.doc)"""


def _metadata(spark, d):
    blank = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    b = bookmarks(spark, d).where(F.col("title").isNotNull()).groupBy("doc").agg(F.min_by("title", "node").alias("title"), F.max_by("title", "node").alias("new_title"))
    v = lambda c: F.coalesce(c, F.lit(""))
    s = signatures(spark, d).groupBy("doc").agg(F.min_by(v("declared_name"), "sig_id").alias("author"), F.min_by(v("reason"), "sig_id").alias("subject"), F.max_by(v("reason"), "sig_id").alias("new_subject"))
    return b.join(s, "doc", "full").select("doc", *[blank(c) for c in ("title", "new_title", "author", "subject", "new_subject")])


@query(f"with {_META} select doc, title, author, subject from m")
def metadata_fields(spark, d):
    """Title, author and subject of each document (its first bookmark and signature stand for the entries); blank ones are null."""
    return _metadata(spark, d).select("doc", "title", "author", "subject")


@query(f"with {_META} select doc, case when title is distinct from new_title then coalesce(new_title, '') end as title, case when subject is distinct from new_subject then coalesce(new_subject, '') end as subject, title is not distinct from new_title and subject is not distinct from new_subject as same, case when subject is distinct from new_subject then new_subject else subject end as edited_subject from m")
def metadata_difference(spark, d):
    """The edit that turns one set of entries into another: null leaves an entry, an empty text removes it; and what the edit makes of the subject."""
    diff = lambda a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.coalesce(b, F.lit("")))
    m = _metadata(spark, d).select("doc", diff("title", "new_title").alias("title"), diff("subject", "new_subject").alias("edit"), "subject")
    edited = F.when(F.col("edit").isNull(), F.col("subject")).otherwise(F.nullif("edit", F.lit("")))
    return m.select("doc", "title", F.col("edit").alias("subject"), (F.col("title").isNull() & F.col("edit").isNull()).alias("same"), edited.alias("edited_subject"))


@query(f"""with x as (select doc, name, '<meta><' || 'dc:title lang="x">' || {_X.format("name")} || '</dc:title></meta>' as packet from {FF}) select doc, name, name as title from x""")
def packet_entries(spark, d):
    """An element read out of a packet of XML by its marks, unescaped."""
    x = fields(spark, d).select("doc", "name", F.concat(F.lit('<meta><dc:title lang="x">'), T.xml_escaped(F.col("name")), F.lit("</dc:title></meta>")).alias("packet"))
    element = F.concat(T.between(F.col("packet"), "<dc:title", "</dc:title>"), F.lit("<end>"))
    return x.select("doc", "name", T.xml_unescaped(T.between(element, ">", "<end>")).alias("title"))


@query("""select doc_id, upper(hex(text)) = upper(hex(text)) as same, sha1(text) as sha1, sha256(text) as sha256, md5(text) as md5 from documents where text is not null""")
def digests(spark, d):
    """Digests of texts."""
    t = F.col("text")
    raw = t.cast("binary")
    # text strings of a document are written as UTF-16 with a byte order mark and read back
    back = F.decode(F.encode(t, "UTF-16BE"), "UTF-16BE") == t
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", back.alias("same"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"))


TERMS = ["the", "registry office", "a.b", "(", "No."]


@query(f"""with t as (select unnest({TERMS!r}) as term), docs as (select doc_id, lower(text) as low from documents where text is not null and length(text) = length(lower(text))),
h as (select term, doc_id, i from t, docs, unnest(range(1, greatest(length(low) - length(term) + 2, 1))) as u(i) where contains(low, lower(term)) and substr(low, i, length(term)) = lower(term))
select doc_id, term, count(*) as hits, min(i - 1)::int as first_pos, max(i - 1)::int as last_pos from h group by 1, 2""")
def match_positions(spark, d):
    """Places of literal terms in any case in each text: how many, the first and the last, from 0. Terms are taken literally, whatever signs they hold. Texts whose small letters differ in number aren't searched by place."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.length("text") == F.length(F.lower("text")))).select("doc_id", F.lower("text").alias("low"))
    x = docs.select("doc_id", "low", F.explode(F.array(*[F.lit(t) for t in TERMS])).alias("term"))
    parts = F.split("low", F.concat(F.lit(r"\Q"), F.lower("term"), F.lit(r"\E")), -1)
    x = x.where(F.contains("low", F.lower("term"))).withColumn("parts", parts)
    first, last = F.length(F.get("parts", F.lit(0))), F.length("low") - F.length(F.element_at("parts", -1)) - F.length("term")
    return x.select("doc_id", "term", (F.size("parts") - 1).cast("bigint").alias("hits"), first.alias("first_pos"), last.alias("last_pos"))


@query(f"""with g as (select *, row_number() over (partition by doc, page order by idx) as k from {CH}), h as (select *, ch = lead(ch, 0) over w and regexp_matches(ch, '[a-z]') as m from g window w as (partition by doc, page order by idx)),
r as (select *, case when lag(m) over w and m and abs((rect.top + rect.bottom) / 2 - (lag(rect.top) over w + lag(rect.bottom) over w) / 2) <= (rect.top - rect.bottom) / 2 then 0 else 1 end as new from h window w as (partition by doc, page order by idx)),
i as (select *, sum(new) over (partition by doc, page order by idx) as run from r where m)
select doc, page, min(idx)::int as first_idx, count(*) as glyphs, round(min(rect.left)::double, 2) as x0, round(max(rect.right)::double, 2) as x1, round(min(rect.bottom)::double, 2) as y0, round(max(rect.top)::double, 2) as y1 from i group by doc, page, run""")
def match_boxes(spark, d):
    """Boxes of matched glyphs (runs of small Latin letters stand for the hits): neighbours on one line are one box, a box ends with the line."""
    w = Window.partitionBy("doc", "page").orderBy("idx")
    mid = (F.col("rect.top") + F.col("rect.bottom")) / 2
    c = chars(spark, d).select("doc", "page", "idx", "rect", F.col("ch").rlike("[a-z]").alias("m"))
    near = F.abs(mid - F.lag(mid).over(w)) <= (F.col("rect.top") - F.col("rect.bottom")) / 2
    c = c.withColumn("new", F.when(F.lag("m").over(w) & F.col("m") & near, 0).otherwise(1)).where("m")
    c = c.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    box = lambda f, x: F.round(f(f"rect.{x}").cast("double"), 2)
    return c.groupBy("doc", "page", "run").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("glyphs"), box(F.min, "left").alias("x0"), box(F.max, "right").alias("x1"), box(F.min, "bottom").alias("y0"), box(F.max, "top").alias("y1")).drop("run")


_LAYERS = """select user_id, max(case when event_type = 'view' then event_id end) as system, max(case when event_type = 'click' then event_id end) as own, max(case when event_type = 'purchase' then event_id end) as project, max(case when event_type = 'signup' then event_id end) as env from events group by user_id"""


@query(f"select user_id, coalesce(env, project, own, system, -1) as chosen, case when env is not null then 'env' when project is not null then 'project' when own is not null then 'user' when system is not null then 'system' else 'default' end as layer from ({_LAYERS})")
def config_layers(spark, d):
    """Layered settings: a later layer overrides only what it sets (each user's newest event of a type stands for a layer's value)."""
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("event_id")))
    e = table(spark, d, "events").groupBy("user_id").agg(last("view").alias("system"), last("click").alias("own"), last("purchase").alias("project"), last("signup").alias("env"))
    layer = F.when(F.col("env").isNotNull(), "env").when(F.col("project").isNotNull(), "project").when(F.col("own").isNotNull(), "user").when(F.col("system").isNotNull(), "system").otherwise("default")
    return e.select("user_id", F.coalesce("env", "project", "own", "system", F.lit(-1)).alias("chosen"), layer.alias("layer"))


#: Names of presets with their resolution and quality.
PRESETS = [("Web", 150, 75), ("Archive", 300, 95), ("Email", 110, 65), ("Print", 300, 92), ("OCR Document", 200, 85), ("Maximum Compression", 72, 45)]
_PRESETS = "(values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in PRESETS) + ") p(name, dpi, quality)"
_ASKED = ["web", "ARCHIVE", "email", "nothing", "ocr document"]


@query(f"""with r as (select run, ord, {_ASKED!r}[ord % {len(_ASKED)} + 1] as asked, case when ord % 3 = 0 then 96 end as dpi from {R}) select r.run, r.ord, p.name as preset, coalesce(r.dpi, p.dpi)::int as dpi, p.quality::int as quality from r left join {_PRESETS} on lower(p.name) = lower(r.asked)""")
def preset_lookup(spark, d):
    """Presets by name in any case; a resolution that is given overrides the preset's; an unknown name finds none."""
    p = spark.createDataFrame(PRESETS, "preset string, preset_dpi int, quality int").withColumn("key", F.lower("preset"))
    asked = F.element_at(F.array(*[F.lit(x) for x in _ASKED]), (F.col("ord") % len(_ASKED) + 1).cast("int"))
    r = results(spark, d).select("run", "ord", F.lower(asked).alias("key"), F.when(F.col("ord") % 3 == 0, 96).alias("dpi"))
    return r.join(F.broadcast(p), "key", "left").select("run", "ord", "preset", F.coalesce("dpi", "preset_dpi").alias("dpi"), "quality")  # as many presets as are written above


@query("""with e as (select user_id, event_id, (event_id * 37 % 50 + 1)::bigint as size from events), s as (select *, sum(size) over (partition by user_id order by event_id desc) as held from e) select user_id, count(*) filter (where held <= 400) as kept, count(*) filter (where held > 400) as evicted, coalesce(sum(size) filter (where held <= 400), 0)::bigint as bytes from s group by user_id""")
def cache_kept(spark, d):
    """What a cache with a budget of bytes per key keeps when the least recently used go first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 50 + 1).alias("size")).withColumn("held", F.sum("size").over(w))
    fits = F.col("held") <= 400
    return e.groupBy("user_id").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("evicted"), F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias("bytes"))


@query(f"""with p as (select doc, max(page)::int as n from {WO} group by doc), c as (select doc, n, unnest([1, greatest(n // 2, 1), n]) as k from p), w as (select distinct doc, k, x::int as page from c, unnest(range(k - 3, k + 4)) as u(x) where x between 1 and n)
select doc, k::int as current, page, abs(page - k)::int as distance, case when page = k then 'visible' when abs(page - k) <= 2 then 'nearby' else 'thumbnail' end as lane, row_number() over (partition by doc, k order by abs(page - k), page desc)::int as turn from w""")
def prefetch_window(spark, d):
    """Pages to fetch around the current one, the nearest first, the later of two; with their lane by distance."""
    p = words(spark, d).groupBy("doc").agg(F.max("page").alias("n")).select("doc", "n", F.explode(F.array_distinct(F.array(F.lit(1), F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(1)), F.col("n")))).alias("at"))
    w = p.select("doc", "at", "n", F.explode(F.sequence(F.col("at") - 3, F.col("at") + 3)).alias("page")).where(F.col("page").between(1, F.col("n")))
    far = F.abs(F.col("page") - F.col("at"))
    lane = F.when(far == 0, "visible").when(far <= 2, "nearby").otherwise("thumbnail")
    return w.select("doc", F.col("at").alias("current"), "page", far.alias("distance"), lane.alias("lane"), F.row_number().over(Window.partitionBy("doc", "at").orderBy(far, F.desc("page"))).alias("turn"))


@query(f"""with w as (select doc, max(page) as pages, count(distinct page) as done, count(distinct page) filter (where text is not null and regexp_matches(text, '[A-Za-z]')) as with_text from {WO} where page is not null group by doc) select doc, pages::int as pages, done, done >= pages as complete, (pages - with_text)::bigint as empty from w""")
def page_completion(spark, d):
    """Whether all pages of a document have come (an export waits for it), and how many have no text."""
    w = words(spark, d).where(F.col("page").isNotNull())
    g = w.groupBy("doc", "page").agg(F.bool_or(F.coalesce(F.col("text").rlike("[A-Za-z]"), F.lit(False))).alias("t")).groupBy("doc")
    g = g.agg(F.max("page").alias("pages"), F.count(F.lit(1)).alias("done"), F.count_if("t").alias("with_text"))
    return g.select("doc", "pages", "done", (F.col("done") >= F.col("pages")).alias("complete"), (F.col("pages") - F.col("with_text")).alias("empty"))


@query("""with e as (select user_id, event_id % 7 as page, event_id, case when event_id % 5 = 0 then 0 else event_id % 11 end as hits from events), l as (select user_id, page, arg_max(hits, event_id) as hits from e group by 1, 2) select user_id, page::bigint as page, hits::bigint as hits from l where hits > 0""")
def search_state(spark, d):
    """Incremental search: the newest result of each page replaces the one before, an empty one takes the page away."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("page"), "event_id", F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 11).alias("hits"))
    return e.groupBy("user_id", "page").agg(F.max_by("hits", "event_id").alias("hits")).where(F.col("hits") > 0)


_NAMES = ["printing", "high-quality printing", "editing", "copying text", "annotating", "filling forms", "reordering pages"]
_BITS = [3, 12, 4, 5, 6, 9, 11]
_RESTRICT = " || ".join(f"case when (bits >> {b - 1}) & 1 = 0 then '{n}, ' else '' end" for n, b in zip(_NAMES, _BITS, strict=True))


@query(f"""with n as (select sig_id, (sig_id * 7919 % 4096)::bigint as bits from {SG}) select sig_id, bits, rtrim({_RESTRICT}, ', ') as restricted, {" + ".join(f"((bits >> {b - 1}) & 1) * {1 << (b - 1)}" for b in _BITS)} + 512 as encoded from n""")
def permission_limits(spark, d):
    """What a field of permission bits forbids, by name, and the field encoded again: accessibility is always allowed."""
    bits = F.col("bits")
    on = lambda b: F.getbit(bits, F.lit(b - 1)) == 1
    names = F.array_join(F.array_compact(F.array(*[F.when(~on(b), F.lit(n)) for n, b in zip(_NAMES, _BITS, strict=True)])), ", ")
    again = F.lit(512).cast("bigint")
    for b in _BITS:
        again = again + F.when(on(b), 1 << (b - 1)).otherwise(0)
    return signatures(spark, d).select("sig_id", (F.col("sig_id") * 7919 % 4096).alias("bits")).select("sig_id", "bits", names.alias("restricted"), again.alias("encoded"))


@query(f"""with i as (select doc, page, word_id, width_px, height_px, row_number() over (partition by doc, page order by word_id) as n from {WO} where page is not null and width_px > 0 and height_px > 0),
k as (select *, case when width_px < 24 or height_px < 16 then 'TooSmall' when word_id % 9 = 0 then 'Colour' when word_id % 13 = 0 then 'Mask' end as reason from i)
select doc, page, printf('page-%03d-img-%02d.%s', page, n, case when word_id % 2 = 0 then 'jpg' else 'png' end) as name, coalesce(reason, 'kept') as reason, least(width_px, greatest(1, round(width_px * 72.0 / 150.0)))::int as target from k""")
def image_names(spark, d):
    """Boxes of words as images of a page: the name an export gives each, why it is left alone, and its width at 72 for 150 dots an inch, never enlarged."""
    w = words(spark, d).where(F.col("page").isNotNull() & (F.col("width_px") > 0) & (F.col("height_px") > 0))
    i = F.col("word_id")
    w = w.withColumn("n", F.row_number().over(Window.partitionBy("doc", "page").orderBy("word_id")))
    reason = F.when((F.col("width_px") < 24) | (F.col("height_px") < 16), "TooSmall").when(i % 9 == 0, "Colour").when(i % 13 == 0, "Mask").otherwise("kept")
    name = F.format_string("page-%03d-img-%02d.%s", "page", "n", F.when(i % 2 == 0, "jpg").otherwise("png"))
    target = F.least("width_px", F.greatest(F.lit(1), F.round(F.col("width_px") * 72.0 / 150.0).cast("int")))
    return w.select("doc", "page", name.alias("name"), reason.alias("reason"), target.alias("target"))


@query(f"""with b as (select doc, page, min(rect.left)::double as l, min(rect.bottom)::double as b, max(rect.right)::double as r, max(rect.top)::double as t from {CH} where page is not null group by 1, 2), f as (select *, least((595 - 72) / (r - l), (842 - 72) / (t - b)) as s from b where r > l and t > b)
select doc, page, round(s, 6) as scale, round((595 - (r - l) * s) / 2, 4) as x, round((842 - (t - b) * s) / 2, 4) as y, r - l > t - b as landscape, round((r - l) / (t - b), 6) as aspect, round((595 / 2.0 - l) * 1 / s, 4) as back_x from f""")
def page_fit(spark, d):
    """A page's content fitted into A4 with half an inch around, centred: scale, place, orientation, aspect, and the middle of the sheet taken back by the inverse map."""
    c = lambda f, x: f(f"rect.{x}").cast("double")
    b = chars(spark, d).where(F.col("page").isNotNull()).groupBy("doc", "page").agg(c(F.min, "left").alias("l"), c(F.min, "bottom").alias("b"), c(F.max, "right").alias("r"), c(F.max, "top").alias("t"))
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    b = b.where((w > 0) & (h > 0)).withColumn("s", F.least((595 - 72) / w, (842 - 72) / h))
    s = F.col("s")
    return b.select("doc", "page", F.round(s, 6).alias("scale"), F.round((595 - w * s) / 2, 4).alias("x"), F.round((842 - h * s) / 2, 4).alias("y"), (w > h).alias("landscape"), F.round(w / h, 6).alias("aspect"), F.round((F.lit(297.5) - F.col("l")) / s, 4).alias("back_x"))


_AREAS = ["2:10,20,110,220", "1:0,0,5,5=title", "x:1,2,3,4", "3:1,2,3", "4:-5,0.5,10,20=a=b"]


@query(f"""with a as (select doc, {_AREAS!r}[ord % {len(_AREAS)} + 1] as spec, field_id from {FF}), p as (select *, regexp_extract(spec, '^([0-9]+):(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+)(=(.*))?$', ['page', 'a', 'b', 'c', 'd', 'e', 'text']) as m from a)
select field_id, spec, nullif(m.page, '')::int as page, round(abs(nullif(m.c, '')::double - nullif(m.a, '')::double) * abs(nullif(m.d, '')::double - nullif(m.b, '')::double), 6) as area, nullif(m.text, '') as text, m.page = '' as refused from p""")
def area_specs(spark, d):
    """Areas written as page:x0,y0,x1,y1, with a text after the first =; others are refused."""
    spec = F.element_at(F.array(*[F.lit(x) for x in _AREAS]), (F.col("ord") % len(_AREAS) + 1).cast("int"))
    pattern = r"^([0-9]+):(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+)(=(.*))?$"
    x = fields(spark, d).select("field_id", spec.alias("spec"))
    p = lambda n: F.nullif(F.regexp_extract("spec", pattern, n), F.lit(""))
    area = F.abs(p(4).cast("double") - p(2).cast("double")) * F.abs(p(5).cast("double") - p(3).cast("double"))
    return x.select("field_id", "spec", p(1).cast("int").alias("page"), F.round(area, 6).alias("area"), p(7).alias("text"), p(1).isNull().alias("refused"))
