"""Scalar functions of document analytics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that can run, and bullets of lists.
DANGEROUS = "exe bat cmd com scr pif js jse vbs vbe wsf ps1 msi jar hta lnk dll reg".split()
BULLETS = "•‣▪·–—*-"


def thousands(n: Column) -> Column:
    """1248 as 1,248."""
    return F.format_number(n, 0)


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024: whole bytes, else one decimal, up to TB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n.cast("double") / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncated(s: Column, most: int) -> Column:
    """s, or its first `most` characters and an ellipsis if it is longer."""
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("…")))


def literal(term: str) -> str:
    """Pattern of a term whose signs mean nothing but themselves."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def whole_word(term: str) -> str:
    """Pattern of a literal term with no letter, digit or underscore on either side, in any case."""
    return r"(?iu)(?<![\p{L}\p{N}_])" + literal(term) + r"(?![\p{L}\p{N}_])"


def host_of(url: Column) -> Column:
    """What stands between the scheme, or the start, and the path, without user and port."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_extract(rest, "^[^/?#]*", 0)
    rest = F.regexp_replace(rest, "^.*@", "")
    return F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(rest, "^[^:]*", 0))


def is_ip_literal(host: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return host.rlike(rf"^{octet}(\.{octet}){{3}}$") | (host.contains(":") & host.rlike("^[0-9A-Fa-f:.]+$"))


def url_kind(url: Column) -> Column:
    """The first that holds: script, local_file, mail, punycode, ip_address, https, insecure, other."""
    low, host = F.lower(F.trim(url)), host_of(F.lower(F.trim(url)))
    return (
        F.when(low.startswith("javascript:"), "script")
        .when(low.startswith("file:") | low.startswith("\\\\"), "local_file")
        .when(low.startswith("mailto:"), "mail")
        .when(F.concat(F.lit("."), host).contains(".xn--"), "punycode")
        .when(is_ip_literal(host), "ip_address")
        .when(low.startswith("https://"), "https")
        .when(low.startswith("http://"), "insecure")
        .otherwise("other")
    )


def url_severity(kind: Column) -> Column:
    """0 info, 1 warning, 2 high, 3 critical."""
    return F.when(kind == "script", 3).when(kind == "local_file", 2).when(kind.isin("ip_address", "punycode"), 1).otherwise(0)


#: What a report says of each kind of link, and the code of its finding.
URL_LABELS = {
    "https": "https link", "insecure": "unencrypted http link", "mail": "email link", "script": "javascript: link — script embedded in a link target",
    "local_file": "file: link — points at the reader's own filesystem", "ip_address": "link to a bare IP address rather than a hostname",
    "punycode": "link with a punycode hostname, which can imitate another name", "other": "link with an uncommon scheme",
}
URL_CODES = {"script": "S_URL_SCRIPT", "local_file": "S_URL_LOCAL_FILE", "ip_address": "S_URL_IP_ADDRESS", "punycode": "S_URL_PUNYCODE", "insecure": "S_URL_INSECURE", "mail": "S_URL_MAIL"}
#: Exit code and advice of each error code.
EXIT_CODES = {
    "E_CANCELLED": 130, "E_IO": 2, "E_PARSE_HEADER": 3, "E_PARSE_XREF": 3, "E_PARSE_TRAILER": 3, "E_PARSE_STREAM": 3, "E_PARSE_OBJECT": 3, "E_PARSE": 3, "E_PASSWORD_REQUIRED": 4,
    "E_PASSWORD_WRONG": 4, "E_PERMISSION": 5, "E_PAGE_RANGE": 6, "E_PAGE_SPEC": 6, "E_UNSUPPORTED": 7, "E_CONFIG": 8, "E_LIMIT": 9, "E_BACKEND": 10, "E_OUTPUT_EXISTS": 11,
}


def mapped(table: dict, key: Column) -> Column:
    """What a fixed table holds for a key, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_dangerous_name(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1)).isin(DANGEROUS)


def common_name(subject: Column) -> Column:
    """The first part that begins with CN=, without it, else the whole subject."""
    part = F.get(F.filter(F.transform(F.split(subject, ","), lambda x: F.trim(x)), lambda x: x.startswith("CN=")), F.lit(0))
    return F.coalesce(F.substr(part, F.lit(4)), subject)


def pdf_date(d: Column) -> Column:
    """D:YYYYMMDDHHmmSSOHH'mm' as YYYY-MM-DD HH:MM:SS +HH:MM; less precise ones as far as they go, others unchanged."""
    digits = F.regexp_extract(F.regexp_replace(d, "^D:", ""), "^[0-9]*", 0)
    rest = F.regexp_replace(F.regexp_replace(d, "^D:", ""), "^[0-9]*", "")
    p = lambda a, n: F.substring(digits, a, n)
    day = F.concat_ws("-", p(1, 4), p(5, 2), p(7, 2))
    clock = F.when(F.length(digits) >= 14, F.concat_ws(":", p(9, 2), p(11, 2), p(13, 2))).when(F.length(digits) >= 12, F.concat_ws(":", p(9, 2), p(11, 2)))
    hh, mm = F.regexp_extract(rest, "^[+-]([0-9]{2})", 1), F.regexp_extract(rest, "^[+-][0-9]{2}'?([0-9]{2})", 1)
    zone = F.when(rest.startswith("Z"), " UTC").when(hh != "", F.concat(F.lit(" "), F.substring(rest, 1, 1), hh, F.lit(":"), F.when(mm == "", "00").otherwise(mm))).otherwise("")
    return F.when(F.length(digits) < 8, d).when(clock.isNull(), day).otherwise(F.concat(day, F.lit(" "), clock, zone))


def xml_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_unescaped(s: Column) -> Column:
    """The inverse of xml_escaped; the ampersand comes last, so that nothing is unescaped twice."""
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        s = F.replace(s, F.lit(b), F.lit(a))
    return s


def between(s: Column, begin: str, end: str) -> Column:
    """What stands between the first `begin` and the next `end`; null if either is missing."""
    rest = F.when(F.instr(s, begin) > 0, F.substring(s, F.instr(s, begin) + len(begin), F.length(s)))
    return F.when(F.instr(rest, end) > 0, F.substring(rest, F.lit(1), F.instr(rest, end) - 1))


def hex_serial(s: Column) -> Column:
    """Bytes in hexadecimal, lower case, with colons."""
    return F.regexp_replace(F.lower(s), "(..)(?!$)", "$1:")


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def fdf_escaped(s: Column) -> Column:
    for a in ("\\", "(", ")"):
        s = F.replace(s, F.lit(a), F.lit("\\" + a))
    return s


def list_marker(s: Column) -> Column:
    """bullet, number or null by how a line begins."""
    return F.when(s.rlike(r"^\s*[•‣▪·–—*-]\s"), "bullet").when(s.rlike(r"^\s*[0-9]{1,3}[.)]\s"), "number")
