"""Queries of the document operators over the test tables, each with the SQL that gives the same result.

A repeated row is the same record delivered again; queries count each record once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import instants, nested
from ..sources.tables import table
from . import findings as _findings  # noqa: F401
from . import interchange as _interchange  # noqa: F401
from . import layout as _layout  # noqa: F401
from . import pages as _pages  # noqa: F401
from .registry import BM as _BM
from .registry import CE as _CE
from .registry import CH as _CH
from .registry import FF as _FF
from .registry import QUERIES, SQL, query
from .registry import R as _R
from .registry import SG as _SG
from .registry import WO as _WO
from .registry import bookmarks as _bookmarks
from .registry import chars as _chars
from .registry import fields as _fields
from .registry import results as _results
from .registry import signatures as _signatures
from .registry import words as _words

@query(f"""
select run, count(*) as files, count(*) filter (where ok) as succeeded, count(*) filter (where not ok) as failed,
  coalesce(sum(bytes_in) filter (where ok), 0)::bigint as bytes_in, coalesce(sum(bytes_out) filter (where ok), 0)::bigint as bytes_out,
  coalesce(arg_min(exit_code, ord) filter (where not ok), case when bool_or(flagged) then 1 else 0 end)::int as exit_code
from {_R} group by run""")
def batch_summary(spark, d):
    """Totals of a batch over its successes; exit code of the first error in input order, else 1 if any file is flagged, else 0."""
    ok = F.col("ok")
    return _results(spark, d).groupBy("run").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes_in"))), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum(F.when(ok, F.col("bytes_out"))), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.min_by("exit_code", F.when(~ok, F.col("ord"))), F.when(F.bool_or("flagged"), 1).otherwise(0)).alias("exit_code"),
    )


@query()
def batch_envelope(spark, d):
    """Per run the files in input order as one JSON text; missing values are written as null. A run is one batch, so its text is bounded by the batch."""
    item = F.struct("ord", "path", "ok", "bytes_in", "bytes_out", F.col("error_code").alias("error"))
    files = F.array_sort(F.collect_list(item))
    return _results(spark, d).groupBy("run").agg(F.to_json(F.struct(F.lit("batch").alias("command"), files.alias("files")), {"ignoreNullFields": "false"}).alias("body"))


@query(f"""
with s as (select path, ord, run, bytes_in as n from {_R})
select run, ord, case when n >= 1024::bigint*1024*1024*1024 then printf('%.1f', n/1099511627776.0)||' TB' when n >= 1073741824 then printf('%.1f', n/1073741824.0)||' GB'
  when n >= 1048576 then printf('%.1f', n/1048576.0)||' MB' when n >= 1024 then printf('%.1f', n/1024.0)||' KB' else n::varchar||' B' end as size, format('{{:,}}', n) as grouped from s""")
def human_sizes(spark, d):
    return _results(spark, d).select("run", "ord", T.human_size(F.col("bytes_in")).alias("size"), T.thousands(F.col("bytes_in")).alias("grouped"))


@query(f"select run, coalesce(error_code, 'none') as error_code, count(*) as files, min(ord) as first_ord from {_R} group by 1, 2")
def error_histogram(spark, d):
    return _results(spark, d).groupBy("run", F.coalesce("error_code", F.lit("none")).alias("error_code")).agg(F.count(F.lit(1)).alias("files"), F.min("ord").alias("first_ord"))


@query(f"""
select path, ord, run, greatest(0.0, 1 - bytes_out::double / bytes_in) as reduction, (bytes_in - bytes_out >= 16384 and bytes_out <= bytes_in * 0.9) as kept
from {_R} where ok and bytes_in > 0 and bytes_out is not null""")
def compress_report(spark, d):
    r = _results(spark, d).where(F.col("ok") & (F.col("bytes_in") > 0) & F.col("bytes_out").isNotNull())
    gain = F.col("bytes_in") - F.col("bytes_out")
    return r.select("path", "ord", "run", F.greatest(F.lit(0.0), 1 - F.col("bytes_out").cast("double") / F.col("bytes_in")).alias("reduction"), ((gain >= 16384) & (F.col("bytes_out") <= F.col("bytes_in") * 0.9)).alias("kept"))


_SPECS = ["1-3,2,5-", "all", "-2", "3-1", "0", "2,2", "x", "4", "1,,2"]


def page_spec(spec, count):
    """Pages of a spec in written order, repeats kept, or an error code: parts are N, A-B, A-, -B and all."""
    parts = F.split(spec, ",")
    piece = lambda p: F.trim(p)
    a = lambda p: F.nullif(F.regexp_extract(piece(p), r"^([0-9]*)-?[0-9]*$", 1), F.lit("")).cast("int")
    b = lambda p: F.when(piece(p).contains("-"), F.nullif(F.regexp_extract(piece(p), r"-([0-9]*)$", 1), F.lit("")).cast("int")).otherwise(a(p))
    lo = lambda p: F.when(piece(p) == "all", 1).otherwise(F.coalesce(a(p), F.lit(1)))
    hi = lambda p: F.when(piece(p) == "all", count).otherwise(F.coalesce(b(p), count))
    shape = F.exists(parts, lambda p: ~piece(p).rlike(r"^([0-9]+|[0-9]+-[0-9]*|-[0-9]+|all)$"))
    wrong = F.exists(parts, lambda p: (piece(p) != "all") & ((lo(p) == 0) | (b(p).isNotNull() & (lo(p) > b(p)))))
    beyond = F.exists(parts, lambda p: (piece(p) != "all") & ((lo(p) > count) | (b(p) > count)))
    error = F.when(shape, "E_PAGE_SPEC").when(wrong, "E_PAGE_SPEC").when(count == 0, None).when(beyond, "E_PAGE_RANGE")
    pages = F.when(error.isNotNull(), None).when(count == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(parts, lambda p: F.sequence(lo(p), hi(p)))))
    return pages, error


@query(f"""
with docs as (select doc, max(page)::int as n from {_WO} group by doc), specs as (select unnest({_SPECS!r}) as spec),
p as (select doc, n, spec, i, string_split(spec, ',')[i] as part from docs, specs, unnest(range(1, len(string_split(spec, ',')) + 1)) as u(i)),
q as (select *, case when part = 'all' then 1 when part ~ '^[0-9]+' then regexp_extract(part, '^[0-9]+')::int else 1 end as lo,
  case when part = 'all' then n when part ~ '^[0-9]+$' then part::int when part ~ '-[0-9]+$' then regexp_extract(part, '-([0-9]+)$', 1)::int else n end as hi,
  part ~ '-[0-9]+$' or part ~ '^[0-9]+$' as has_end, not (part = 'all' or part ~ '^([0-9]+|[0-9]+-[0-9]*|-[0-9]+)$') as bad from p),
e as (select doc, spec, n, bool_or(bad) or bool_or(part <> 'all' and not bad and (lo = 0 or (has_end and lo > hi))) as wrong, bool_or(part <> 'all' and not bad and (lo > n or (has_end and hi > n))) as beyond from q group by all),
x as (select q.doc, q.spec, list(v order by i, v) as pages from q join e using (doc, spec), unnest(range(lo, hi + 1)) as w(v) where not wrong and not beyond group by 1, 2)
select e.doc, e.spec, case when wrong then 'E_PAGE_SPEC' when beyond then 'E_PAGE_RANGE' end as error, array_to_string(pages, ' ') as pages, array_to_string(list_sort(list_distinct(pages)), ' ') as unique_pages
from e left join x using (doc, spec)""")
def page_specs(spark, d):
    docs = _words(spark, d).groupBy("doc").agg(F.max("page").alias("n"))
    x = docs.withColumn("spec", F.explode(F.array(*[F.lit(s) for s in _SPECS])))
    pages, error = page_spec(F.col("spec"), F.col("n"))
    join = lambda a: F.array_join(a.cast("array<string>"), " ")
    return x.select("doc", "spec", error.alias("error"), join(pages).alias("pages"), join(F.array_sort(F.array_distinct(pages))).alias("unique_pages"))


_TERMS = ["the", "copy", "page", "zzz", "registry office"]


@query("""
with t as (select unnest(['the', 'copy', 'page', 'zzz', 'registry office']) as term), docs as (select doc_id, text, lower(text) as low from documents where text is not null),
h as (select term, doc_id, i, low, text from t, docs, unnest(range(1, length(low) - length(term) + 2)) as u(i) where contains(low, term) and substr(low, i, length(term)) = term),
w as (select term, doc_id, regexp_matches(substr(low, i - 1, 1), '[\\pL\\pN_]') and i > 1 as l, regexp_matches(substr(low, i + length(term), 1), '[\\pL\\pN_]') as r from h)
select t.term, count(w.doc_id)::bigint as loose, count(w.doc_id) filter (where not l and not r)::bigint as whole, count(distinct w.doc_id)::bigint as docs, count(w.doc_id) = 0 as missing
from t left join w using (term) group by t.term""")
def text_search(spark, d):
    """Hits of literal terms in any case, loose and as whole words; a term without hits has its row."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("text")
    aggs = []
    for i, t in enumerate(_TERMS):
        n = F.regexp_count("text", F.lit(r"(?iu)" + T.literal(t)))
        aggs += [F.struct(F.lit(t).alias("term"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("loose"), F.coalesce(F.sum(F.regexp_count("text", F.lit(T.whole_word(t)))), F.lit(0)).cast("bigint").alias("whole"), F.count_if(n > 0).alias("docs")).alias(f"t{i}")]
    one = docs.agg(*aggs).select(F.explode(F.array(*[f"t{i}" for i in range(len(_TERMS))])).alias("x")).select("x.*")
    return one.withColumn("missing", F.col("loose") == 0)


@query("""
with r as (select doc_id, text, regexp_extract_all(text, '[a-z]+_[0-9]{4}\\.pdf') as m from documents where text is not null)
select doc_id, len(m)::int as hits, coalesce(list_sum(list_transform(m, lambda x: length(x))), 0)::bigint as removed_chars, length(regexp_replace(text, '[a-z]+_[0-9]{4}\\.pdf', '█', 'g'))::bigint as left_chars from r where len(m) > 0""")
def redact_names(spark, d):
    """Search and redact: file names in texts, what is removed and how long the text is after."""
    p = r"[a-z]+_[0-9]{4}\.pdf"
    docs = table(spark, d, "documents").where(F.col("text").rlike(p))
    m = F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return docs.select("doc_id", F.size(m).alias("hits"), F.aggregate(F.transform(m, F.length), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("removed_chars"), F.length(F.regexp_replace("text", p, "█")).cast("bigint").alias("left_chars"))


@query(f"""
select doc, count(*) as fields, count(*) filter (where kind in ('text','checkbox','radio','choice')) as fillable,
 count(*) filter (where kind in ('text','checkbox','radio','choice') and not read_only) as writable, count(*) filter (where required and coalesce(value, '') = '') as missing,
 count(*) filter (where kind in ('choice','radio') and coalesce(value, '') <> '' and len(options) > 0 and not list_contains(options, value)) as off_options from {_FF} group by doc""")
def form_status(spark, d):
    fill = F.col("kind").isin("text", "checkbox", "radio", "choice")
    empty = F.coalesce("value", F.lit("")) == ""
    off = F.col("kind").isin("choice", "radio") & ~empty & (F.size("options") > 0) & ~F.array_contains("options", F.col("value"))
    return _fields(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("fields"), F.count_if(fill).alias("fillable"), F.count_if(fill & ~F.col("read_only")).alias("writable"), F.count_if(F.col("required") & empty).alias("missing"), F.count_if(off).alias("off_options"))


@query(f"""
select doc, name, '<field name="' || replace(replace(replace(replace(name,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;') || '"><value>' || replace(replace(replace(replace(coalesce(value,''),'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;') || '</value></field>' as xfdf,
 '<< /T (' || replace(replace(replace(name,'\\','\\\\'),'(','\\('),')','\\)') || ') /V (' || replace(replace(replace(coalesce(value,''),'\\','\\\\'),'(','\\('),')','\\)') || ') >>' as fdf from {_FF}""")
def form_export(spark, d):
    """Each field as an element of XFDF and of FDF."""
    v = F.coalesce("value", F.lit(""))
    return _fields(spark, d).select("doc", "name", F.concat(F.lit('<field name="'), T.xml_escaped(F.col("name")), F.lit('"><value>'), T.xml_escaped(v), F.lit("</value></field>")).alias("xfdf"), F.concat(F.lit("<< /T ("), T.fdf_escaped(F.col("name")), F.lit(") /V ("), T.fdf_escaped(v), F.lit(") >>")).alias("fdf"))


@query(f"""
with m as (select sig_id, list_sum(list_transform(spans, lambda x: x.len))::bigint as signed, (spans[2].start - (spans[1].start + spans[1].len))::bigint as gap, (list_max(list_transform(spans, lambda x: x.start + x.len)))::bigint as reach, spans[1].start as begins, contents_len, total, verdict from {_SG})
select sig_id, signed, (total - signed)::bigint as unsigned_bytes, array_to_string(list_filter([case when begins > 0 then 'SIG_RANGE_SKIPS_START' end, case when gap > 2 * contents_len + 2 then 'SIG_GAP_LARGER_THAN_SIGNATURE' end, case when reach > total then 'SIG_RANGE_PAST_END' end, case when reach + 8 < total then 'SIG_COVERS_EARLIER_REVISION' end], lambda x: x is not null), ' ') as notes from m""")
def signature_coverage(spark, d):
    """Bytes signed and unsigned and what the byte ranges of a signature show; a slack of 8 bytes at the end is none."""
    s = F.col("spans")
    ends = F.transform(s, lambda x: x["start"] + x["len"])
    m = _signatures(spark, d).select("sig_id", F.aggregate(F.transform(s, lambda x: x["len"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("signed"), (F.get(s, 1)["start"] - (F.get(s, 0)["start"] + F.get(s, 0)["len"])).alias("gap"), F.array_max(ends).alias("reach"), F.get(s, 0)["start"].alias("begins"), "contents_len", "total")
    notes = F.array_compact(F.array(F.when(F.col("begins") > 0, "SIG_RANGE_SKIPS_START"), F.when(F.col("gap") > 2 * F.col("contents_len") + 2, "SIG_GAP_LARGER_THAN_SIGNATURE"), F.when(F.col("reach") > F.col("total"), "SIG_RANGE_PAST_END"), F.when(F.col("reach") + 8 < F.col("total"), "SIG_COVERS_EARLIER_REVISION")))
    return m.select("sig_id", "signed", (F.col("total") - F.col("signed")).alias("unsigned_bytes"), F.array_join(notes, " ").alias("notes"))


@query(f"""
select doc, count(*) as signatures, bool_and(verdict = 'intact') as all_intact, bool_or(certification) as certified, bool_or(timestamped) as timestamped from {_SG} group by doc""")
def signature_summary(spark, d):
    return _signatures(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("signatures"), F.bool_and(F.col("verdict") == "intact").alias("all_intact"), F.bool_or("certification").alias("certified"), F.bool_or("timestamped").alias("timestamped"))


@query(f"""
select sig_id, arg_min(case when subject like 'CN=%' then substr(string_split(subject, ',')[1], 4) else coalesce(list_filter(list_transform(string_split(subject, ','), lambda x: trim(x)), lambda x: starts_with(x, 'CN='))[1][4:], subject) end, chain_pos) as signer,
 count(*) as chain, bool_or(self_signed) as rooted from {_CE} group by sig_id""")
def signer_chain(spark, d):
    """Common name of the signer, length of the chain and whether it ends in a self-signed certificate."""
    c = table(spark, d, "certificates").dropDuplicates(["cert_id"])
    return c.groupBy("sig_id").agg(F.min_by(T.common_name(F.col("subject")), "chain_pos").alias("signer"), F.count(F.lit(1)).alias("chain"), F.bool_or("self_signed").alias("rooted"))


@query(f"""
with w as (select doc, page, confidence::double as c from {_WO} where confidence >= 40 and width_px > 0 and height_px > 0 and text is not null),
p as (select doc, page, count(*) as n, avg(c) as m from w group by 1, 2)
select doc, count(*) as pages, sum(n)::bigint as words, round(avg(m), 6) as mean_of_pages from p group by doc""")
def ocr_confidence(spark, d):
    """Words kept by confidence, and the mean of the pages' means."""
    w = _words(spark, d).where((F.col("confidence") >= 40) & (F.col("width_px") > 0) & (F.col("height_px") > 0) & F.col("text").isNotNull())
    p = w.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("confidence").cast("double")).alias("m"))
    return p.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("words"), F.round(F.avg("m"), 6).alias("mean_of_pages"))


@query("select doc_id, regexp_matches(text, '[\\pL\\pN]') as has_text, not regexp_matches(text, '[^\\x20-\\x7e\\t\\r\\n\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]') as win_ansi from documents where text is not null")
def page_text_flags(spark, d):
    """Whether a text has any letter or digit, and whether all of it can be written in the Western code page."""
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", t.rlike(r"[\p{L}\p{N}]").alias("has_text"), (~t.rlike(r"[^\x20-\x7e\t\r\n\xa0-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")).alias("win_ansi"))


@query(f"""
with c as (select doc, page, idx, round(size * 2) / 2 as bucket from {_CH} where trim(ch, ' ') <> ''), g as (select doc, page, bucket, count(*) as n, min(idx) as seen from c group by 1, 2, 3)
select doc, page, arg_max(bucket, (n, seen))::double as body_size, sum(n)::bigint as glyphs, count(*) as sizes from g group by doc, page""")
def glyph_sizes(spark, d):
    """The most frequent size of a page's glyphs in half points; of several, the one first seen last."""
    c = _chars(spark, d).where(F.trim("ch") != "").groupBy("doc", "page", (F.round(F.col("size") * 2) / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("seen"))
    return c.groupBy("doc", "page").agg(F.max_by("bucket", F.struct("n", "seen")).cast("double").alias("body_size"), F.sum("n").alias("glyphs"), F.count(F.lit(1)).alias("sizes"))


@query(f"""
with r as (select doc, page, min(rect.left) + 20 as x0, max(rect.right) - 60 as x1, max(rect.top) - 100 as y0, max(rect.top) as y1 from {_CH} group by doc, page)
select c.doc, c.page, count(*) as hit, min(c.idx)::int as first_idx, max(c.idx)::int as last_idx from {_CH} c join r on r.doc = c.doc and r.page = c.page
where c.rect.left < x1 and c.rect.right > x0 and c.rect.bottom < y1 and c.rect.top > y0 group by c.doc, c.page""")
def redaction_hits(spark, d):
    """Glyphs that a rectangle on their page touches: an equi join on the page with the rest as a condition."""
    c = _chars(spark, d)
    r = c.groupBy("doc", "page").agg((F.min("rect.left") + 20).alias("x0"), (F.max("rect.right") - 60).alias("x1"), (F.max("rect.top") - 100).alias("y0"), F.max("rect.top").alias("y1"))
    hit = (F.col("rect.left") < F.col("x1")) & (F.col("rect.right") > F.col("x0")) & (F.col("rect.bottom") < F.col("y1")) & (F.col("rect.top") > F.col("y0"))
    return c.join(r, ["doc", "page"]).where(hit).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("hit"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("""
with s as (select distinct sig_id, claimed_time as t from signatures where claimed_time like 'D:%'), p as (select *, regexp_extract(t[3:], '^[0-9]*') as g, regexp_replace(t[3:], '^[0-9]*', '') as z from s)
select sig_id, case when length(g) < 8 then t else g[1:4]||'-'||g[5:6]||'-'||g[7:8] || case when length(g) >= 12 then ' '||g[9:10]||':'||g[11:12] || case when length(g) >= 14 then ':'||g[13:14] else '' end ||
 case when z like 'Z%' then ' UTC' when z ~ '^[+-][0-9]{2}' then ' '||z[1:1]||z[2:3]||':'||case when regexp_extract(z, '^[+-][0-9]{2}''?([0-9]{2})', 1) = '' then '00' else regexp_extract(z, '^[+-][0-9]{2}''?([0-9]{2})', 1) end else '' end else '' end end as written from p""")
def pdf_dates(spark, d):
    s = _signatures(spark, d).where(F.col("claimed_time").startswith("D:"))
    return s.select("sig_id", T.pdf_date(F.col("claimed_time")).alias("written"))


@query("""
with n as (select unnest(range(0, 4096))::bigint as bits) select bits, (bits >> 2) & 1 = 1 as can_print, (bits >> 3) & 1 = 1 as can_modify, (bits >> 4) & 1 = 1 as can_copy, (bits >> 5) & 1 = 1 as can_annotate,
 (bits >> 8) & 1 = 1 as can_fill, (bits >> 9) & 1 = 1 as can_access, (bits >> 10) & 1 = 1 as can_assemble, (bits >> 11) & 1 = 1 as can_print_well from n""")
def permission_bits(spark, d):
    bit = lambda n: F.getbit(F.col("bits"), F.lit(n - 1)) == 1
    names = dict(can_print=3, can_modify=4, can_copy=5, can_annotate=6, can_fill=9, can_access=10, can_assemble=11, can_print_well=12)
    return spark.range(4096).select(F.col("id").alias("bits")).select("bits", *[bit(n).alias(k) for k, n in names.items()])


@query("""
with e as (select event_id, user_id, ts, event_type, case event_type when 'purchase' then 0 when 'click' then 1 else 2 end as prio from events),
g as (select *, row_number() over (partition by user_id, prio order by ts desc, event_id desc) as k from e)
select user_id, event_id, row_number() over (partition by user_id order by prio, ts desc, event_id desc)::int as turn from g where k <= 64""")
def queue_order(spark, d):
    """A bounded queue per key: in each lane the newest 64, lanes by priority, newest first."""
    e = table(spark, d, "events").withColumn("prio", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2))
    lane = Window.partitionBy("user_id", "prio").orderBy(F.desc("ts"), F.desc("event_id"))
    e = e.withColumn("k", F.row_number().over(lane)).where(F.col("k") <= 64)
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("prio", F.desc("ts"), F.desc("event_id"))).alias("turn"))


@query(f"""
with r as (select run, ord, count(*) over (partition by run) as total, row_number() over (partition by run order by ord) as done, epoch_us(finished_at) as t, min(epoch_us(finished_at)) over (partition by run) as t0 from {_R})
select run, ord, done::int as done, round(done / total::double, 9) as fraction, case when done > 1 and done < total then round((t - t0)::double / done * (total - done), 3) end as eta_us from r""")
def progress_eta(spark, d):
    """Share done and time left at each file of a run, null while nothing or all is done."""
    w = Window.partitionBy("run")
    r = _results(spark, d).withColumn("total", F.count(F.lit(1)).over(w)).withColumn("done", F.row_number().over(w.orderBy("ord")))
    # a difference of local times, without the session's zone
    since = (F.col("finished_at").cast("timestamp_ntz") - F.min(F.col("finished_at").cast("timestamp_ntz")).over(w)).cast("interval second").cast("decimal(20,6)") * 1_000_000
    r = r.withColumn("t", since.cast("bigint")).withColumn("t0", F.lit(0))
    return r.select("run", "ord", "done", F.round(F.col("done") / F.col("total").cast("double"), 9).alias("fraction"), F.when((F.col("done") > 1) & (F.col("done") < F.col("total")), F.round((F.col("t") - F.col("t0")).cast("double") / F.col("done") * (F.col("total") - F.col("done")), 3)).alias("eta_us"))


_LEVELS = ["PDF/A-1b", "pdfa-2u", "pdfa3", "2a", "1u", "4", "3B", "x", ""]


@query("""
with l as (select unnest(['PDF/A-1b', 'pdfa-2u', 'pdfa3', '2a', '1u', '4', '3B', 'x', '']) as asked), p as (select asked, regexp_replace(lower(asked), '^(pdf/a-|pdfa-|pdfa)', '') as rest from l),
q as (select asked, regexp_extract(rest, '^([123])', 1) as part, coalesce(nullif(regexp_extract(rest, '^[123](.)', 1), ''), 'b') as letter from p)
select asked, case when part = '' or letter not in ('a', 'b', 'u') or (part = '1' and letter = 'u') then null else part || letter end as level from q""")
def archive_levels(spark, d):
    x = spark.createDataFrame([(s,) for s in _LEVELS], "asked string")
    rest = F.regexp_replace(F.lower("asked"), "^(pdf/a-|pdfa-|pdfa)", "")
    part, letter = F.regexp_extract(rest, "^([123])", 1), F.coalesce(F.nullif(F.regexp_extract(rest, "^[123](.)", 1), F.lit("")), F.lit("b"))
    return x.select("asked", F.when((part == "") | ~letter.isin("a", "b", "u") | ((part == "1") & (letter == "u")), None).otherwise(F.concat(part, letter)).alias("level"))


@query(f"""
with p as (select distinct doc, page from {_WO}), n as (select doc, page, row_number() over (partition by doc order by page) as pos, count(*) over (partition by doc) as n from p)
select doc, page::int as page, pos::int as pos, (n + 1 - pos)::int as reversed, ((pos - 1) // 5 + 1)::int as piece, ((pos * 90) % 360)::int as rotation, (sum(1) over (partition by doc order by pos rows unbounded preceding) + pos - 1)::int as after_duplicating from n""")
def page_order(spark, d):
    """Page-order algebra: position, reversed position, piece of five, rotation and the place of a page once every page is followed by its copy."""
    w = Window.partitionBy("doc").orderBy("page")
    p = _words(spark, d).select("doc", "page").distinct().withColumn("pos", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    return p.select("doc", "page", "pos", (F.col("n") + 1 - F.col("pos")).cast("int").alias("reversed"), (F.floor((F.col("pos") - 1) / 5) + 1).cast("int").alias("piece"), F.pmod(F.col("pos") * 90, F.lit(360)).alias("rotation"), (2 * F.col("pos") - 1).alias("after_duplicating"))


@query("""
with l as (select doc_id, i, regexp_split_to_array(text, '\\n')[i] as line from documents, unnest(range(1, len(regexp_split_to_array(text, '\\n')) + 1)) as u(i) where text is not null)
select doc_id, count(*) filter (where regexp_matches(line, '^\\s*[•‣▪·–—*-]\\s')) as bullets, count(*) filter (where regexp_matches(line, '^\\s*[0-9]{1,3}[.)]\\s')) as numbers, count(*) filter (where trim(line, e' \\t\\r') = '') as blanks, count(*) as lines from l group by doc_id""")
def line_kinds(spark, d):
    """Lines of texts that begin lists, by kind of marker, and empty lines."""
    l = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    k = T.list_marker(F.col("line"))
    return l.groupBy("doc_id").agg(F.count_if(k == "bullet").alias("bullets"), F.count_if(k == "number").alias("numbers"), F.count_if(F.col("line").rlike(r"^[ \t\r]*$")).alias("blanks"), F.count(F.lit(1)).alias("lines"))


@query(f"""
with d as (select doc, page, idx, round(sqrt(power((rect.left::double + rect.right::double) / 2 - 150, 2) + power((rect.bottom::double + rect.top::double) / 2 - 700, 2)), 6) as dist from {_CH})
select doc, page, arg_min(idx, (dist, idx))::int as nearest, min(dist) as dist from d group by doc, page""")
def nearest_glyph(spark, d):
    """The glyph of each page whose centre is nearest to a point, the first of several."""
    mid = lambda a, b: (F.col(f"rect.{a}").cast("double") + F.col(f"rect.{b}").cast("double")) / 2
    dist = F.round(F.sqrt(F.pow(mid("left", "right") - 150, F.lit(2)) + F.pow(mid("bottom", "top") - 700, F.lit(2))), 6)
    c = _chars(spark, d).select("doc", "page", "idx", dist.alias("dist"))
    return c.groupBy("doc", "page").agg(F.min_by("idx", F.struct("dist", "idx")).alias("nearest"), F.min("dist").alias("dist"))


@query(f"""
with l as (select doc, page, line.block as b, line.par as p, line.line as l, min(left_px) as x0, max(left_px + width_px) as x1 from {_WO} where text is not null group by all),
w as (select doc, page, line.block as b, line.par as p, line.line as l, word_id, left_px, lag(left_px + width_px) over (partition by doc, page, line.block, line.par, line.line order by left_px, word_id) as pr from {_WO} where text is not null),
g as (select doc, page, b, p, l, max(left_px - pr) as gap, arg_max((left_px + pr) / 2.0, (left_px - pr, -left_px)) as centre from w where pr is not null group by all),
s as (select doc, page, max(x1) - min(x0) as span, count(*) as lines from l group by all),
h as (select g.doc, g.page, count(*) as wide, max(centre) - min(centre) as spread from g join s on s.doc = g.doc and s.page = g.page where gap >= span / 12.0 group by all)
select s.doc, s.page, s.lines, coalesce(h.wide, 0)::bigint as wide, (s.lines >= 6 and coalesce(h.wide, 0) >= 0.4 * s.lines and h.spread <= s.span / 10.0) is true as columns from s left join h on h.doc = s.doc and h.page = s.page""")
def column_pages(spark, d):
    """Pages that look like two columns: enough lines whose widest gap is wide and stands at one place."""
    w = _words(spark, d).where(F.col("text").isNotNull()).select("doc", "page", "word_id", "left_px", (F.col("left_px") + F.col("width_px")).alias("right"), F.col("line.block").alias("b"), F.col("line.par").alias("p"), F.col("line.line").alias("l"))
    key = ["doc", "page", "b", "p", "l"]
    w = w.withColumn("pr", F.lag("right").over(Window.partitionBy(*key).orderBy("left_px", "word_id")))
    gap = F.col("left_px") - F.col("pr")
    lines = w.groupBy(*key).agg(F.min("left_px").alias("x0"), F.max("right").alias("x1"), F.max(gap).alias("gap"), F.max_by((F.col("left_px") + F.col("pr")) / 2, F.when(F.col("pr").isNotNull(), F.struct(gap, -F.col("left_px")))).alias("centre"))
    page = Window.partitionBy("doc", "page")
    lines = lines.withColumn("span", F.max("x1").over(page) - F.min("x0").over(page))
    wide = F.col("gap") >= F.col("span") / 12
    p = lines.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("lines"), F.count_if(wide).alias("wide"), F.first("span").alias("span"), (F.max(F.when(wide, F.col("centre"))) - F.min(F.when(wide, F.col("centre")))).alias("spread"))
    is_so = (F.col("lines") >= 6) & (F.col("wide") >= 0.4 * F.col("lines")) & (F.col("spread") <= F.col("span") / 10)
    return p.select("doc", "page", "lines", "wide", F.coalesce(is_so, F.lit(False)).alias("columns"))


@query("""
with e as (select user_id, event_id, ts, (event_id * 31) % 5 as gen from events), m as (select *, max(gen) over (partition by user_id order by event_id rows unbounded preceding) as newest from e)
select user_id, event_id, gen::bigint as gen from m where gen >= newest""")
def stale_requests(spark, d):
    """Requests whose generation is no older than the newest that their key has shown before (the batch form of the stream's rule)."""
    e = table(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") * 31) % 5).alias("gen"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("newest", F.max("gen").over(w)).where(F.col("gen") >= F.col("newest")).drop("newest")


@query("""
with c as (select unnest(['#ff8000', '#000000', 'ff8000', '#12', '#0A141E']) as text), v as (select text, regexp_full_match(text, '#[0-9A-Fa-f]{6}') as ok from c)
select text, case when ok then round(('0x'||text[2:3])::int / 255.0, 6)::double end as r, case when ok then round(('0x'||text[4:5])::int / 255.0, 6)::double end as g, case when ok then round(('0x'||text[6:7])::int / 255.0, 6)::double end as b from v""")
def colours(spark, d):
    c = spark.createDataFrame([(x,) for x in ("#ff8000", "#000000", "ff8000", "#12", "#0A141E")], "text string")
    ok = F.col("text").rlike("^#[0-9A-Fa-f]{6}$")
    part = lambda a: F.when(ok, F.round(F.conv(F.substring("text", a, 2), 16, 10).cast("double") / 255, 6))
    return c.select("text", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


QUERIES |= {"p3_found": instants.p3_found, "p3_readings": instants.p3_readings, "p3_likely": instants.p3_likely, "p4_found": nested.p4_found, "p4_tables": nested.p4_tables}
