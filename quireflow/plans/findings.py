"""Findings: what scans of documents report, with severities (0 info, 1 warning, 2 high, 3 critical), codes and order.

The tables hold no PDF objects. Each bookmark stands for one object of its document: its action, its link and what it
refers to are planted by arithmetic on its id, on both sides alike (OBJECTS); all rules run over these rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .registry import BM, CE, R, SG, bookmarks, certificates, query, results, signatures

URLS = [
    "javascript:alert(1)", "file:///etc/x", "\\\\host\\share", "mailto:a@b.example", "http://10.0.0.1/a", "https://[2001:db8::1]/x", "https://user@192.0.2.7:8080/q",
    "https://xn--bcher-kva.example/", "ftp://files.example/a", "example.org", "https://example.org/docs", "http://example.org", "https://example.org/" + "long/" * 20, "http://example.org/b",
]
NAMES = ["report.pdf", "setup.EXE", "photo.jpeg", "macro.vbs", "noextension", "archive.tar.gz", "run.bat", "exe"]
ACTIONS = ["URI", "GoTo", "JavaScript", "URI", "GoToR", "URI", "Launch", "URI", "GoToE", "Named", "URI"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


#: The planted objects in SQL.
OBJECTS = f"""(select doc, node as obj, bookmark_id as seq, {_list(ACTIONS)}[bookmark_id % {len(ACTIONS)} + 1] as action, case when bookmark_id % 3 <> 1 then {_list(URLS)}[bookmark_id * 7 % {len(URLS)} + 1] end as uri,
 case when bookmark_id % 17 = 0 then {_list(NAMES)}[bookmark_id % {len(NAMES)} + 1] end as file_name, bookmark_id % 29 = 0 as has_aa, bookmark_id % 2 = 0 as has_js, bookmark_id % 41 = 0 as media, bookmark_id % 53 = 0 as xfa,
 case when bookmark_id % 19 = 0 then node + 1000 else parent end as ref, bookmark_id * 7919 % 6000000 as stream_len, bookmark_id % 97 = 0 as undecodable, bookmark_id % 4 as kind, title from {BM})"""


def objects(spark, d):
    """doc, obj, seq, action, uri, file_name, has_aa, has_js, media, xfa, ref, stream_len, undecodable, kind, title of the planted objects."""
    i = F.col("bookmark_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    return bookmarks(spark, d).select(
        "doc", F.col("node").alias("obj"), i.alias("seq"), pick(ACTIONS, i).alias("action"), F.when(i % 3 != 1, pick(URLS, i * 7)).alias("uri"), F.when(i % 17 == 0, pick(NAMES, i)).alias("file_name"),
        (i % 29 == 0).alias("has_aa"), (i % 2 == 0).alias("has_js"), (i % 41 == 0).alias("media"), (i % 53 == 0).alias("xfa"), F.when(i % 19 == 0, F.col("node") + 1000).otherwise(F.col("parent")).alias("ref"),
        (i * 7919 % 6000000).alias("stream_len"), (i % 97 == 0).alias("undecodable"), (i % 4).alias("kind"), "title",
    )


_KIND_SQL = """case when low like 'javascript:%' then 'script' when low like 'file:%' or starts_with(low, '\\\\') then 'local_file' when low like 'mailto:%' then 'mail' when contains('.'||host, '.xn--') then 'punycode'
 when regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') or (contains(host, ':') and regexp_full_match(host, '[0-9a-f:.]+')) then 'ip_address'
 when low like 'https://%' then 'https' when low like 'http://%' then 'insecure' else 'other' end"""
_HOST_SQL = """case when auth like '[%' then regexp_extract(auth, '^\\[([^\\]]*)', 1) else regexp_extract(auth, '^[^:]*') end"""
_AUTH_SQL = """regexp_replace(regexp_extract(regexp_replace(low, '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*'), '^.*@', '')"""
_LABEL_SQL = "case kind " + " ".join(f"when '{k}' then '" + v.replace("'", "''") + "'" for k, v in T.URL_LABELS.items()) + " end"
_CODE_SQL = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in T.URL_CODES.items()) + " else 'S_URL' end"
_SEVERITY_SQL = "case kind when 'script' then 3 when 'local_file' then 2 when 'ip_address' then 1 when 'punycode' then 1 else 0 end"
_URL_ROWS = f"""u as (select doc, uri, min(seq) as seq from {OBJECTS} where action = 'URI' and uri is not null group by 1, 2), l as (select *, lower(trim(uri)) as low from u),
a as (select *, {_AUTH_SQL} as auth from l), h as (select *, {_HOST_SQL} as host from a), k as (select *, {_KIND_SQL} as kind from h)"""


@query(f"""with {_URL_ROWS}, r as (select *, row_number() over (partition by doc, kind order by seq) as nth, case when length(uri) > 70 then left(uri, 70) || '…' else uri end as shown from k)
select doc, kind, {_SEVERITY_SQL}::int as severity, {_CODE_SQL} as code, count(*) as urls, count(*) || ' × ' || {_LABEL_SQL} || ': ' || string_agg(shown, ', ' order by seq) filter (where nth <= 3)
 || case when count(*) > 3 then ', and ' || (count(*) - 3) || ' more' else '' end as detail from r group by doc, kind""")
def url_findings(spark, d):
    """Links of each document by kind: distinct links in the order first seen, their number, the first three cut to 70 characters, and how many more."""
    return _url_findings(objects(spark, d))


def _url_findings(o):
    u = o.where((F.col("action") == "URI") & F.col("uri").isNotNull()).groupBy("doc", "uri").agg(F.min("seq").alias("seq"))
    kind, shown = T.url_kind(F.col("uri")), T.truncated(F.col("uri"), 70)
    # three per kind are kept in each partial aggregate's place by a rank, so that no list grows with the document
    u = u.select("doc", "seq", kind.alias("kind"), shown.alias("shown"))
    u = u.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("seq")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("seq", "shown")))), lambda x: x["shown"]), ", ")
    n = F.count(F.lit(1))
    g = u.groupBy("doc", "kind").agg(n.alias("urls"), first.alias("first"))
    more = F.when(F.col("urls") > 3, F.concat(F.lit(", and "), (F.col("urls") - 3).cast("string"), F.lit(" more"))).otherwise("")
    k = F.col("kind")
    return g.select("doc", "kind", T.url_severity(k).alias("severity"), F.coalesce(T.mapped(T.URL_CODES, k), F.lit("S_URL")).alias("code"), "urls", F.concat(F.col("urls").cast("string"), F.lit(" × "), T.mapped(T.URL_LABELS, k), F.lit(": "), F.col("first"), more).alias("detail"))


_DANGEROUS_SQL = "lower(string_split(file_name, '.')[-1]) in (" + ", ".join(f"'{x}'" for x in T.DANGEROUS) + ")"
#: Counters of the scan: code, severity, condition in SQL.
_SCAN: list[tuple[str, int, str]] = [
    ("S_LAUNCH_ACTION", 3, "action = 'Launch'"), ("S_EMBEDDED_EXECUTABLE", 3, f"file_name is not null and {_DANGEROUS_SQL}"), ("S_ADDITIONAL_ACTIONS", 1, "has_aa"),
    ("S_EMBEDDED_FILE", 1, f"file_name is not null and not {_DANGEROUS_SQL}"), ("S_REMOTE_DESTINATION", 1, "action in ('GoToR', 'GoToE')"), ("S_RICH_MEDIA", 1, "media"), ("S_XFA_FORM", 1, "xfa"),
]
_SCAN_SQL = " union all ".join(f"select doc, '{code}' as code, {sev} as severity, count(*) filter (where {cond}) as n from o group by doc" for code, sev, cond in _SCAN)
_ALL_SQL = f"""o as (select * from {OBJECTS}), {_URL_ROWS}, f as ({_SCAN_SQL}
 union all select doc, 'S_JAVASCRIPT', 2, sum(case when action = 'JavaScript' then 1 + has_js::int else 0 end) from o group by doc
 union all select doc, 'S_OPEN_ACTION', case when arg_min(action, obj) = 'JavaScript' then 2 else 1 end, count(*) filter (where obj = 1) from o where obj = 1 group by doc
 union all select doc, 'S_SIGNED', 0, count(*) from {SG} group by doc
 union all select doc, {_CODE_SQL}, {_SEVERITY_SQL}, count(*) from k group by doc, kind)"""


def security_rows(spark, d):
    """doc, code, severity, n of everything a scan finds: one pass over the objects counts all detectors."""
    o = objects(spark, d)
    danger = F.col("file_name").isNotNull() & T.is_dangerous_name(F.col("file_name"))
    script = F.col("action") == "JavaScript"
    counters = {
        "S_LAUNCH_ACTION": (3, F.count_if(F.col("action") == "Launch")), "S_EMBEDDED_EXECUTABLE": (3, F.count_if(danger)), "S_ADDITIONAL_ACTIONS": (1, F.count_if("has_aa")),
        "S_EMBEDDED_FILE": (1, F.count_if(F.col("file_name").isNotNull() & ~danger)), "S_REMOTE_DESTINATION": (1, F.count_if(F.col("action").isin("GoToR", "GoToE"))),
        "S_RICH_MEDIA": (1, F.count_if("media")), "S_XFA_FORM": (1, F.count_if("xfa")), "S_JAVASCRIPT": (2, F.coalesce(F.sum(F.when(script, 1 + F.col("has_js").cast("int"))), F.lit(0))),
    }
    opens = F.min_by(F.col("action"), F.when(F.col("obj") == 1, F.col("seq")))
    one = o.groupBy("doc").agg(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), n.alias("n")).alias(c) for c, (s, n) in counters.items()], F.struct(F.lit("S_OPEN_ACTION").alias("code"), F.when(opens == "JavaScript", 2).otherwise(1).alias("severity"), F.count_if(F.col("obj") == 1).alias("n")).alias("S_OPEN_ACTION"))
    rows = one.select("doc", F.explode(F.array(*counters, "S_OPEN_ACTION")).alias("x")).select("doc", "x.*")
    signed = signatures(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit("S_SIGNED").alias("code"), F.lit(0).alias("severity"), "n")
    urls = _url_findings(o).select("doc", "code", "severity", F.col("urls").alias("n"))
    return rows.unionByName(signed).unionByName(urls).where(F.col("n") > 0)


@query(f"with {_ALL_SQL} select doc, code, severity::int as severity, n::bigint as n, row_number() over (partition by doc order by severity desc, code, n)::int as place from f where n > 0")
def security_findings(spark, d):
    """All findings of a document, the severest first, then by code."""
    order = Window.partitionBy("doc").orderBy(F.desc("severity"), "code", "n")
    return security_rows(spark, d).select("doc", "code", "severity", "n", F.row_number().over(order).alias("place"))


@query(f"with {_ALL_SQL} select doc, max(severity)::int as worst, count(*) filter (where severity >= 1) as at_least_warning, max(severity) >= 2 as flagged, max(severity) <= 0 as clean from f where n > 0 group by doc")
def scan_gate(spark, d):
    """Worst severity, findings of warning or more, whether the gate at high flags the document, and whether it is clean (nothing above info)."""
    s = F.col("severity")
    return security_rows(spark, d).groupBy("doc").agg(F.max(s).alias("worst"), F.count_if(s >= 1).alias("at_least_warning"), (F.max(s) >= 2).alias("flagged"), (F.max(s) <= 0).alias("clean"))


@query(f"select seq, file_name, coalesce({_DANGEROUS_SQL}, false) as dangerous from {OBJECTS} where file_name is not null")
def dangerous_names(spark, d):
    """Embedded files whose last extension (or whole name without one) can run."""
    return objects(spark, d).where(F.col("file_name").isNotNull()).select("seq", "file_name", T.is_dangerous_name(F.col("file_name")).alias("dangerous"))


@query(f"""with o as (select * from {OBJECTS}), x as (select doc, ref from o where ref is not null except select doc, obj from o)
select doc, count(*) as missing, min(ref)::int as first from x group by doc""")
def dangling_references(spark, d):
    """Distinct references to objects that a document doesn't have: an anti join on document and object."""
    o = objects(spark, d)
    refs = o.where(F.col("ref").isNotNull()).select("doc", F.col("ref").alias("obj")).distinct()
    return refs.join(o.select("doc", "obj").distinct(), ["doc", "obj"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("missing"), F.min("obj").alias("first"))


_DIAG = f"""o as (select * from {OBJECTS}), x as (select doc, ref from o where ref is not null except select doc, obj from o),
c as (select doc, count(*) as objects, count(*) filter (where kind = 0) as fonts, count(*) filter (where kind = 1) as images, count(*) filter (where kind = 1 and stream_len > 4194304) as oversized,
  count(*) filter (where file_name is not null) as embedded, count(*) filter (where undecodable) as broken, arg_min(title, seq) as title, arg_max(title, seq) as xmp from o group by doc),
m as (select doc, count(*) as missing, min(ref) as first from x group by doc)"""


@query(f"""with {_DIAG} select c.doc, objects, fonts, images, oversized, embedded, broken, coalesce(missing, 0) as missing from c left join m using (doc)""")
def diagnostics_counters(spark, d):
    """What a document is made of: objects, fonts, images and oversized ones, embedded files, broken streams, missing objects."""
    return _diagnostics(spark, d).select("doc", "objects", "fonts", "images", "oversized", "embedded", "broken", "missing")


def _diagnostics(spark, d):
    o = objects(spark, d)
    image = F.col("kind") == 1
    c = o.groupBy("doc").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("kind") == 0).alias("fonts"), F.count_if(image).alias("images"), F.count_if(image & (F.col("stream_len") > 4 << 20)).alias("oversized"),
        F.count("file_name").alias("embedded"), F.count_if("undecodable").alias("broken"), F.min_by("title", "seq").alias("title"), F.max_by("title", "seq").alias("xmp"),
    )
    m = dangling_references(spark, d)
    return c.join(m, "doc", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


@query(f"""with {_DIAG}, i as (
 select doc, 1 as ord, 2 as severity, 'D_STREAM_UNDECODABLE' as code, broken || ' stream' || case when broken = 1 then '' else 's' end as detail from c where broken > 0
 union all select doc, 2, 1, 'D_IMAGE_OVERSIZED', oversized || ' image' || case when oversized = 1 then '' else 's' end || ' over 4 MB' from c where oversized > 0
 union all select doc, 3, 2, 'D_DANGLING_REFERENCE', missing || ' reference' || case when missing = 1 then '' else 's' end || ', first ' || first from m
 union all select doc, 4, 0, 'D_NO_FONTS', 'no fonts' from c where fonts = 0
 union all select doc, 5, 1, 'D_XMP_STALE', 'title differs' from c where title is not null and title <> '' and not contains(coalesce(xmp, ''), title))
select doc, code, severity::int as severity, detail, row_number() over (partition by doc order by severity desc, ord)::int as place from i""")
def diagnostics_issues(spark, d):
    """Issues of each document, the severest first, else in the order of the checks."""
    c = _diagnostics(spark, d)
    text = lambda n, what: F.concat(F.col(n).cast("string"), F.lit(f" {what}"), T.plural(F.col(n)))
    stale = (F.col("title") != "") & ~F.coalesce("xmp", F.lit("")).contains(F.col("title"))
    checks = [
        ("D_STREAM_UNDECODABLE", 2, F.col("broken") > 0, text("broken", "stream")), ("D_IMAGE_OVERSIZED", 1, F.col("oversized") > 0, F.concat(text("oversized", "image"), F.lit(" over 4 MB"))),
        ("D_DANGLING_REFERENCE", 2, F.col("missing") > 0, F.concat(text("missing", "reference"), F.lit(", first "), F.col("first").cast("string"))), ("D_NO_FONTS", 0, F.col("fonts") == 0, F.lit("no fonts")), ("D_XMP_STALE", 1, stale, F.lit("title differs")),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(k).alias("ord"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), detail.alias("detail"))) for k, (code, sev, hit, detail) in enumerate(checks)]))
    i = c.select("doc", F.explode(found).alias("x")).select("doc", "x.*")
    return i.select("doc", "code", "severity", "detail", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("severity"), "ord")).alias("place"))


#: Archive rules over planted facts of a document: code, the parts of the standard it holds for, SQL condition.
ARCHIVE_RULES = [
    ("PDFA_NO_XMP", "123", "no_xmp"), ("PDFA_IDENTIFICATION_MISMATCH", "123", "claimed <> part"), ("PDFA_NO_FILE_ID", "123", "no_id"), ("PDFA_VERSION", "123", "version > case when part = 1 then 14 else 17 end"),
    ("PDFA_NO_OUTPUT_INTENT", "123", "no_intent"), ("PDFA_JAVASCRIPT", "123", "scripts > 0"), ("PDFA_FORBIDDEN_ACTION", "123", "launches > 0"), ("PDFA_EMBEDDED_FILE", "1", "files > 0"), ("PDFA_EMBEDDED_FILE_NOT_PDFA", "2", "files > 0"),
    ("PDFA_NO_AF_RELATIONSHIP", "3", "files > 0"), ("PDFA_FONT_NOT_EMBEDDED", "123", "fonts % 3 = 1"), ("PDFA_TRANSPARENCY", "1", "media > 0"), ("PDFA_ENCRYPTED", "123", "objects % 11 = 0"),
]
_FACTS = """doc, count(*) as objects, count(*) % 5 = 0 as no_xmp, (min(seq) % 3 + 1)::int as part, (max(seq) % 3 + 1)::int as claimed, count(*) % 7 = 0 as no_id, 13 + (sum(seq) % 6)::int as version, count(*) % 4 = 0 as no_intent,
 count(*) filter (where action = 'JavaScript') as scripts, count(*) filter (where action = 'Launch') as launches, count(*) filter (where file_name is not null) as files, count(*) filter (where kind = 0) as fonts, count(*) filter (where media) as media"""
_VIOLATIONS = " union all ".join(f"select doc, part, {k} as place, '{code}' as code from f where part::varchar in ({', '.join(repr(p) for p in parts)}) and {cond}" for k, (code, parts, cond) in enumerate(ARCHIVE_RULES))


@query(f"with f as (select {_FACTS} from {OBJECTS} group by doc), v as ({_VIOLATIONS}) select doc, part, code, place::int as place from v")
def archive_violations(spark, d):
    """Violations of the archive standard's part that a document asks for, in the order of the checks."""
    n = lambda c: F.count_if(c)
    f = objects(spark, d).groupBy("doc").agg(
        F.count(F.lit(1)).alias("objects"), (F.min("seq") % 3 + 1).cast("int").alias("part"), (F.max("seq") % 3 + 1).cast("int").alias("claimed"), (13 + F.sum("seq") % 6).cast("int").alias("version"), n(F.col("action") == "JavaScript").alias("scripts"),
        n(F.col("action") == "Launch").alias("launches"), F.count("file_name").alias("files"), n(F.col("kind") == 0).alias("fonts"), n(F.col("media")).alias("media"),
    )
    f = f.withColumn("no_xmp", F.col("objects") % 5 == 0).withColumn("no_id", F.col("objects") % 7 == 0).withColumn("no_intent", F.col("objects") % 4 == 0)
    hits = [F.when(F.col("part").cast("string").isin(*parts) & F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit(k).alias("place"))) for k, (code, parts, cond) in enumerate(ARCHIVE_RULES)]
    return f.select("doc", "part", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("doc", "part", "x.code", "x.place")


_EXIT_SQL = "case error_code " + " ".join(f"when '{k}' then {v}" for k, v in T.EXIT_CODES.items()) + " end"


@query(f"select coalesce(error_code, 'none') as code, {_EXIT_SQL}::int as exit_code, count(*) as files, count(*) filter (where exit_code is distinct from {_EXIT_SQL}) as other_exit from {R} where not ok group by 1, 2")
def error_catalogue(spark, d):
    """Errors by code with the exit code that the catalogue gives it, and how many files ended with another."""
    due = T.mapped(T.EXIT_CODES, F.col("error_code"))
    r = results(spark, d).where(~F.col("ok")).select(F.coalesce("error_code", F.lit("none")).alias("code"), due.alias("due"), "exit_code")
    g = r.groupBy("code", "due").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("exit_code").eqNullSafe(F.col("due"))).alias("other_exit"))
    return g.withColumnRenamed("due", "exit_code")


@query(f"""with s as (select sig_id, doc, list_sum(list_transform(spans, lambda x: x.len))::bigint as signed, list_max(list_transform(spans, lambda x: x.start + x.len)) + 8 >= total as whole, verdict from {SG})
select sig_id, doc, row_number() over (partition by doc order by whole, signed, sig_id)::int as place, whole, verdict = 'intact' and not whole as partial_but_intact from s""")
def signature_order(spark, d):
    """Signatures of a document in the order they were made: by the bytes they sign, those that reach the end of the file last."""
    s = F.col("spans")
    signed = F.aggregate(F.transform(s, lambda x: x["len"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    whole = F.array_max(F.transform(s, lambda x: x["start"] + x["len"])) + 8 >= F.col("total")
    x = signatures(spark, d).select("sig_id", "doc", signed.alias("signed"), whole.alias("whole"), "verdict")
    return x.select("sig_id", "doc", F.row_number().over(Window.partitionBy("doc").orderBy("whole", "signed", "sig_id")).alias("place"), "whole", ((F.col("verdict") == "intact") & ~F.col("whole")).alias("partial_but_intact"))


@query(f"""with c as (select * from {CE}), l as (select sig_id, cert_id, chain_pos, issuer, serial, subject from c where chain_pos = 0),
m as (select l.sig_id, l.cert_id, p.cert_id as parent, row_number() over (partition by l.cert_id order by case when p.subject = l.issuer then 0 else 1 end, p.chain_pos, p.cert_id) as k, p.subject = l.issuer as matched from l left join c p on p.sig_id = l.sig_id and p.cert_id <> l.cert_id)
select sig_id, cert_id, parent, coalesce(matched, false) as matched from m where k = 1""")
def signer_issuers(spark, d):
    """The certificate that issued the signer's: the one of the chain whose subject is its issuer, else the first."""
    c = certificates(spark, d)
    own = c.where(F.col("chain_pos") == 0).select("sig_id", F.col("cert_id").alias("own"), F.col("issuer").alias("own_issuer"))
    m = own.join(c.select("sig_id", "cert_id", "subject", "chain_pos"), "sig_id", "left").where(F.col("cert_id") != F.col("own"))
    best = m.groupBy("own").agg(F.min_by(F.struct("cert_id", (F.col("subject") == F.col("own_issuer")).alias("matched")), F.struct(F.when(F.col("subject") == F.col("own_issuer"), 0).otherwise(1), "chain_pos", "cert_id")).alias("x"))
    return own.join(best, "own", "left").select("sig_id", F.col("own").alias("cert_id"), F.col("x.cert_id").alias("parent"), F.coalesce("x.matched", F.lit(False)).alias("matched"))


@query(f"select cert_id, regexp_replace(regexp_replace(lower(serial), '(..)', '\\1:', 'g'), ':$', '') as serial from {CE}")
def certificate_serials(spark, d):
    return certificates(spark, d).select("cert_id", T.hex_serial(F.col("serial")).alias("serial"))


@query(f"""with {_URL_ROWS.replace("where action = 'URI' and uri is not null group by 1, 2", "where uri is not null group by 1, 2")}
select doc, uri as url, host, kind from k""")
def url_kinds(spark, d):
    """Kind and host of every link of the documents' objects."""
    u = objects(spark, d).where(F.col("uri").isNotNull()).select("doc", F.col("uri").alias("url")).distinct()
    return u.select("doc", "url", T.host_of(F.lower(F.trim("url"))).alias("host"), T.url_kind(F.col("url")).alias("kind"))


_TARGET = """case action when 'URI' then case when lower(uri) like 'mailto:%' then 'email' else 'url' end when 'GoTo' then 'page' when 'GoToR' then 'external' when 'GoToE' then 'external' else 'other' end"""
_DESCRIBE = """case k when 'url' then uri when 'email' then 'mailto:' || substr(uri, 8) when 'page' then 'page ' || obj when 'external' then doc || case when has_js then ', page ' || obj else '' end else action || ' (not shown)' end"""
_LINKS = f"(select *, {_DESCRIBE} as label, k in ('url', 'email', 'external') as leaves from (select *, {_TARGET} as k from {OBJECTS} where action <> 'URI' or uri is not null))"


def links(spark, d):
    """objects that are links with k (url, email, page, external, other), label and leaves (whether they lead out of the document)."""
    o = objects(spark, d).where((F.col("action") != "URI") | F.col("uri").isNotNull())
    a, mail = F.col("action"), F.lower("uri").startswith("mailto:")
    o = o.withColumn("k", F.when(a == "URI", F.when(mail, "email").otherwise("url")).when(a == "GoTo", "page").when(a.isin("GoToR", "GoToE"), "external").otherwise("other"))
    k, at = F.col("k"), F.concat(F.lit("page "), F.col("obj").cast("string"))
    label = F.when(k == "url", F.col("uri")).when(k == "email", F.concat(F.lit("mailto:"), F.substring("uri", 8, 10**6))).when(k == "page", at)
    label = label.when(k == "external", F.when(F.col("has_js"), F.concat("doc", F.lit(", "), at)).otherwise(F.col("doc"))).otherwise(F.concat(a, F.lit(" (not shown)")))
    return o.withColumn("label", label).withColumn("leaves", k.isin("url", "email", "external"))


@query(f"select seq, doc, k as kind, label, leaves from {_LINKS}")
def link_targets(spark, d):
    """Where each link leads, how a listing names it, and whether it leaves the document."""
    return links(spark, d).select("seq", "doc", F.col("k").alias("kind"), "label", "leaves")


@query(f"select doc, count(*) as links, count(*) filter (where contains(lower(label), 'example.org')) as removed, count(*) filter (where leaves) as leaving, count(*) filter (where not leaves) as kept_inside from {_LINKS} group by doc")
def link_removal(spark, d):
    """Links of each document, how many a removal by a part of their label takes, and how many a removal of all that leave takes."""
    hit = F.lower("label").contains("example.org")
    return links(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("links"), F.count_if(hit).alias("removed"), F.count_if("leaves").alias("leaving"), F.count_if(~F.col("leaves")).alias("kept_inside"))


#: Subtypes of annotations; a subtype that isn't known is a note; form widgets, pop-ups and links are none.
SUBTYPES = ["Highlight", "Underline", "StrikeOut", "Squiggly", "Text", "FreeText", "Square", "Circle", "Line", "Ink", "Stamp", "Widget", "Popup", "Link"]
_ANNOTS = f"""(select seq, doc, obj as page, 'author ' || (seq % 5) as author, t from (select *, {_list(SUBTYPES)}[seq % {len(SUBTYPES)} + 1] as t from {OBJECTS}) where t not in ('Widget', 'Popup', 'Link'))"""


@query(f"""select doc, count(*) as annotations, count(*) filter (where author <> 'author 2') as kept, count(*) filter (where author = 'author 2') as removed,
 count(*) filter (where t in ('Highlight', 'Underline', 'StrikeOut', 'Squiggly')) as marks, count(*) filter (where t in ('Text', 'Stamp')) as notes from {_ANNOTS} group by doc""")
def annotation_removal(spark, d):
    """Annotations of each document by kind, and what is left after those of one author are removed."""
    o = objects(spark, d).withColumn("t", F.element_at(F.array(*[F.lit(x) for x in SUBTYPES]), (F.col("seq") % len(SUBTYPES) + 1).cast("int")))
    o = o.where(~F.col("t").isin("Widget", "Popup", "Link")).withColumn("theirs", F.col("seq") % 5 == 2)
    return o.groupBy("doc").agg(
        F.count(F.lit(1)).alias("annotations"), F.count_if(~F.col("theirs")).alias("kept"), F.count_if("theirs").alias("removed"),
        F.count_if(F.col("t").isin("Highlight", "Underline", "StrikeOut", "Squiggly")).alias("marks"), F.count_if(F.col("t").isin("Text", "Stamp")).alias("notes"),
    )
