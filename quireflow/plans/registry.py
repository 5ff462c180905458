"""Where the queries of the document operators and their SQL are registered, and the tables they share, each record once."""

from __future__ import annotations

from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


R = "(select distinct run, ord, path, ok, error_code, exit_code, bytes_in, bytes_out, flagged, finished_at from results)"
FF = "(select distinct field_id, doc, ord, name, kind, value, options, required, read_only, pages from form_fields)"
SG = "(select distinct sig_id, doc, field, page, declared_name, spans, contents_len, total, verdict, certification, timestamped, claimed_time, reason from signatures)"
BM = "(select distinct bookmark_id, doc, node, parent, ord, title, page, is_open from bookmarks)"
CE = "(select distinct * from certificates)"
WO = "(select distinct word_id, doc, page, text, left_px, top_px, width_px, height_px, confidence, line from words)"
CH = "(select distinct char_id, doc, page, idx, ch, rect, size, font from chars)"


def results(spark, d):
    return table(spark, d, "results").drop("loaded_at").distinct()


def fields(spark, d):
    return table(spark, d, "form_fields").select("field_id", "doc", "ord", "name", "kind", "value", "options", "required", "read_only", "pages").dropDuplicates(["field_id"])


def signatures(spark, d):
    return table(spark, d, "signatures").dropDuplicates(["sig_id"])


def bookmarks(spark, d):
    return table(spark, d, "bookmarks").dropDuplicates(["bookmark_id"])


def words(spark, d):
    return table(spark, d, "words").dropDuplicates(["word_id"])


def chars(spark, d):
    return table(spark, d, "chars").dropDuplicates(["char_id"])


def certificates(spark, d):
    return table(spark, d, "certificates").dropDuplicates(["cert_id"])
