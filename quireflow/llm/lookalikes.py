"""Text that looks the same made of the same characters.

Texts are taken apart into code points with their places. Broadcast joins with two fixed tables (code point to plain
form and kind; mark to its class) give each code point's plain form, windows over the text give its neighbours, its word
and the alphabets of both, and decide whether the plain form holds there: full-width punctuation belongs into Chinese and
Japanese text, joiners into emoji and some scripts, Cyrillic and Greek letters into words of their own. The marks of a
letter, however many, are put in the order of their classes and composed with it one after another by the table of
compositions; those that the letter takes up were held apart. Strings are rebuilt from the plain forms.

The tables are built from the character database that Python has; they don't grow with the data (about 3,000 rows).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage, one_per_id, table
from .letters import CYRILLIC, GREEK, HIDDEN, LATIN_LIKE, SPACES
from .mojibake import find_garbled, text_values

HYPHENS = "\u2010\u2011\ufe63"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}ー々]"
_JOINING = r"[\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsKhmer}\p{IsMyanmar}\p{IsMongolian}\p{IsSyriac}\p{IsTibetan}\p{IsThaana}]"


@cache
def code_table() -> tuple[tuple[str, str, str], ...]:
    """(ch, plain, kind) of every code point that may stand in for another that looks the same."""
    out: dict[str, tuple[str, str]] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF:
            continue
        c = chr(cp)
        if 0xFF01 <= cp <= 0xFF5E:
            n = unicodedata.normalize("NFKC", c)
            out[c] = (n, "wide" if n.isalnum() else "wide_mark")
        elif 0xFF61 <= cp <= 0xFFDC:
            out[c] = (unicodedata.normalize("NFKC", c), "half")
        elif 0xFB00 <= cp <= 0xFB06:
            out[c] = (unicodedata.normalize("NFKC", c), "ligature")
        elif 0x2160 <= cp <= 0x217F and len(unicodedata.normalize("NFKC", c)) == 1:
            out[c] = (unicodedata.normalize("NFKC", c), "numeral")
        else:
            n = unicodedata.normalize("NFC", c)
            # one code point that is canonically another; composition exclusions (several code points) stay
            if n != c and len(n) == 1:
                out[c] = (n, "same")
    out |= {c: (p, "cyrillic") for c, p in CYRILLIC.items()} | {c: (p, "greek") for c, p in GREEK.items()} | {c: (p, "same") for c, p in LATIN_LIKE.items()}
    out |= {c: (" ", "wide_space" if c == "\u3000" else "space") for c in SPACES} | {c: ("", "hidden") for c in HIDDEN} | {c: ("-", "hyphen") for c in HYPHENS}
    out |= {"\u200c": ("", "joiner"), "\u200d": ("", "joiner")}
    return tuple((c, p, k) for c, (p, k) in sorted(out.items()))


@cache
def composed_table() -> tuple[tuple[str, str, str], ...]:
    """(base, mark, composed) of all primary compositions, from the character database."""
    out = []
    for cp in range(0xC0, 0x20000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            parts = [chr(int(x, 16)) for x in d.split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", "".join(parts)) == c:
                out.append((*parts, c))
    return tuple(out)


@cache
def class_table() -> tuple[tuple[str, int], ...]:
    """(mark, combining class) of the marks that some composition takes up."""
    return tuple((m, unicodedata.combining(m)) for m in sorted({m for _, m, _ in composed_table()}))


@cache
def special_class() -> str:
    """A class of the code points that an odd text holds one of: those of the table, marks and letters of the look-alike alphabets."""
    points, ranges = [ord(c) for c, _, _ in code_table()], []
    for cp in points:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"[\p{M}\p{IsCyrillic}\p{IsGreek}\x{1100}-\x{11FF}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: Code points of one partition: windows cost time by code points, which compress to little, so bytes are no measure. A task sorts its points up to three times at once.
POINTS = 500_000


def spread_texts(points: DataFrame, number: int) -> DataFrame:
    """points by text, in partitions by their number."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return points.repartition(max(3 * cores, number // POINTS), "text_id")


def once(points: DataFrame) -> DataFrame:
    """points (text_id, pos, char_id) without repeated rows: a repeated row stands at the same place, and the order is the one that judge asks for, so that nothing is sorted again."""
    text = Window.partitionBy("text_id").orderBy("pos", "char_id")
    return points.withColumn("again", F.lag("char_id").over(text) == F.col("char_id")).where(~F.coalesce("again", F.lit(False))).drop("again")


def taken_up(points: DataFrame) -> DataFrame:
    """text_id, taken (places) of the marks that compose with the letter before them; points: text_id, pos, ch, mark, base (struct of pos and ch of the letter).

    Marks are ordered by class; one of the same class as a mark that stays apart is blocked by it.
    """
    spark = points.sparkSession
    classes = F.broadcast(spark.createDataFrame(list(class_table()), "ch string, cls int"))
    listed = lambda values: F.split(F.lit(" ".join(values)), " ")
    joined = F.map_from_arrays(listed([b + m for b, m, _ in composed_table()]), listed([c for _, _, c in composed_table()]))
    marks = points.where(F.col("mark") & F.col("base").isNotNull()).join(classes, "ch")
    clusters = marks.groupBy("text_id", "base").agg(F.collect_list(F.struct("cls", "pos", "ch")).alias("marks"))
    # a letter that is composed already is taken apart first: a mark of a lower class goes before its own (pos -1)
    whole = [(c, unicodedata.normalize("NFD", c)) for _, _, c in composed_table() if unicodedata.combining(unicodedata.normalize("NFD", c)[1])]
    apart = F.element_at(F.map_from_arrays(listed([c for c, _ in whole]), listed([d for _, d in whole])), F.col("base.ch"))
    class_of = F.map_from_arrays(listed([c for c, _ in class_table()]), F.transform(listed([str(k) for _, k in class_table()]), lambda x: x.cast("int")))
    own = F.transform(F.filter(F.split(F.substring(apart, 2, 9), ""), lambda c: c != ""), lambda c: F.struct(F.element_at(class_of, c).alias("cls"), F.lit(-1).alias("pos"), c.alias("ch")))
    clusters = clusters.select("text_id", F.coalesce(F.substring(apart, 1, 1), F.col("base.ch")).alias("b"), F.array_sort(F.concat("marks", F.coalesce(own, F.array().cast("array<struct<cls:int,pos:int,ch:string>>")))).alias("marks"))
    start = F.struct(F.col("b").alias("cur"), F.lit(-1).alias("last"), F.array().cast("array<boolean>").alias("took"))

    def step(s: Column, x: Column) -> Column:
        to = F.element_at(joined, F.concat(s["cur"], x["ch"]))
        takes = to.isNotNull() & (s["last"] != x["cls"])
        return F.struct(F.when(takes, to).otherwise(s["cur"]).alias("cur"), F.when(takes, s["last"]).otherwise(x["cls"]).alias("last"), F.array_append(s["took"], F.coalesce(takes, F.lit(False))).alias("took"))

    took = F.aggregate("marks", start, step)["took"]
    places = F.filter(F.zip_with("marks", took, lambda x, t: F.when(t & (x["pos"] >= 0), x["pos"])), lambda p: p.isNotNull())
    # one row a text, so that points stay where they are when they ask for it
    return clusters.groupBy("text_id").agg(F.flatten(F.collect_list(places)).alias("taken"))


def code_points(texts: DataFrame) -> DataFrame:
    """text_id, pos, ch of texts (text_id, text)."""
    texts = spread_texts(texts, texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    return texts.select("text_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).where(F.length("ch") > 0)


def judge(points: DataFrame, keep: list[str], all_texts: bool = True) -> DataFrame:
    """keep, text_id, pos, ch, plain, odd, undecided of code points (text_id, pos, ch; a text in one partition): whether a point should be its plain form.

    Texts without any code point of the tables, mark or letter of the look-alike alphabets can't hold an odd one; without all_texts they are left out.
    undecided: a word that could be all of another alphabet, in a text with no other letter to tell by.
    """
    spark = points.sparkSession
    codes = F.broadcast(spark.createDataFrame(list(code_table()), "ch string, plain string, kind string"))
    d = points.join(codes, "ch", "left")
    text = Window.partitionBy("text_id").orderBy("pos", *keep)
    if not all_texts:
        special = F.col("kind").isNotNull() | F.col("ch").rlike(r"^[\p{M}\p{IsCyrillic}\p{IsGreek}\x{1100}-\x{11FF}]")
        d = d.withColumn("special", F.max(special).over(text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("special").drop("special")
    ch, kind = F.col("ch"), F.col("kind")
    mark = ch.rlike(r"^\p{M}$")
    unseen = F.coalesce(kind.isin("hidden", "joiner"), F.lit(False))
    letter = ch.rlike(r"^\p{L}$") | F.coalesce(kind.isin("numeral", "ligature"), F.lit(False))
    d = d.withColumn("mark", mark).withColumn("unseen", unseen).withColumn("letter", letter & ~unseen)
    seen = F.when(~F.col("unseen"), ch)
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("prev", F.last(seen, True).over(before)).withColumn("base", F.last(F.when(~F.col("unseen") & ~F.col("mark"), F.struct("pos", "ch")), True).over(before))
    d = d.withColumn("left1", F.lag("ch").over(text)).withColumn("right1", F.lead("ch").over(text))
    d = d.withColumn("word", F.sum(F.when(F.col("letter") | F.col("mark") | F.col("unseen"), 0).otherwise(1)).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    # points are moved once: both sides read the same shuffle, which keeps a text in one partition; what is added below to every point is never moved
    d = d.join(taken_up(d.select("text_id", "pos", "ch", "mark", "base")), "text_id", "left").withColumn("joined", F.coalesce(F.array_contains("taken", F.col("pos")), F.lit(False))).drop("taken", "base")
    latin = ch.rlike(r"^\p{IsLatin}$") & ~F.coalesce(kind.isin("numeral"), F.lit(False))
    cyrillic, greek = ch.rlike(r"^\p{IsCyrillic}$") & F.col("letter"), ch.rlike(r"^\p{IsGreek}$") & F.col("letter") & (ch != "µ")
    like_cyrillic, like_greek = "".join(sorted(set(CYRILLIC.values()))), "".join(sorted(set(GREEK.values())))
    own = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    twin_c, twin_g = ch.rlike(f"^[{like_cyrillic}]$"), ch.rlike(f"^[{like_greek}]$")
    d = d.withColumns({
        "la": own(latin), "cy": own(cyrillic), "gr": own(greek),
        "cy_only": own(cyrillic & ~F.coalesce(kind == "cyrillic", F.lit(False))), "gr_only": own(greek & ~F.coalesce(kind == "greek", F.lit(False))),
        "la_not_cy": own(latin & ~twin_c), "la_not_gr": own(latin & ~twin_g),
        "small": own(ch.rlike(r"^\p{Ll}$")), "cjk": own(ch.rlike(f"^{_CJK}$")), "rtl": own(ch.rlike(r"^[\p{IsArabic}\p{IsHebrew}]$")),
    })
    word, whole = Window.partitionBy("text_id", "word"), Window.partitionBy("text_id")
    d = d.withColumns({f"t_{c}": F.sum(c).over(whole) for c in "la cy_only gr_only la_not_cy la_not_gr cjk rtl".split()})
    d = d.withColumns({f"w_{c}": F.sum(c).over(word) for c in "la cy gr cy_only gr_only la_not_cy la_not_gr small".split()})
    k = lambda c: F.col(c)
    in_cjk = k("t_cjk") > 0
    letters = own(k("letter")) == 1

    def foreign(own_kind: str, n: str, only: str, not_like: str) -> tuple[Column, Column, Column]:
        """odd among this alphabet's letters, odd among Latin letters, undecided."""
        mixed = (k("w_la") > 0) & (k(f"w_{n}") > 0)
        this_is_odd = (k(n) == 1) & mixed & (k(f"w_{only}") == 0)
        latin_is_odd = (k("la") == 1) & mixed & (k(f"w_{only}") > 0) & (k(f"w_{not_like}") == 0)
        alone = (k(n) == 1) & (k("w_la") == 0) & (k(f"w_{only}") == 0) & (k(f"t_{only}") == 0)
        in_latin = alone & (k("t_la") > 0)
        # a small Latin word that could be all of the text's alphabet; Greek letters of formulas don't make a text Greek
        latin_alone = (F.lit(own_kind == "cyrillic")) & (k("la") == 1) & (k(f"w_{n}") == 0) & (k(f"w_{not_like}") == 0) & (k("w_small") > 0) & (k(f"t_{only}") > 0) & (k(f"t_{not_like}") == 0)
        return this_is_odd | in_latin, latin_is_odd | latin_alone, alone & (k("t_la") == 0)

    c1, c2, c3 = foreign("cyrillic", "cy", "cy_only", "la_not_cy")
    g1, g2, g3 = foreign("greek", "gr", "gr_only", "la_not_gr")
    emoji = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{2300}-\x{23FF}]"
    beside = lambda pattern: k("left1").rlike(pattern) & k("right1").rlike(pattern)
    needed = (k("left1").rlike(emoji) & k("right1").rlike(emoji)) | beside(_JOINING) | (k("left1").rlike(_JOINING) & (ch == "\u200d"))
    jamo = ch.rlike(r"^[\x{1161}-\x{1175}\x{11A8}-\x{11C2}]$") & k("prev").rlike(r"^[\x{1100}-\x{1112}\x{1161}-\x{1175}\x{AC00}-\x{D7A3}]$")
    odd = (
        F.when(kind.isin("wide", "half", "ligature", "space", "hyphen", "same"), True)
        .when(kind == "wide_mark", ~in_cjk)
        .when(kind == "wide_space", ~in_cjk)
        .when(kind == "hidden", ~(ch.isin("\u200e", "\u200f") & (k("t_rtl") > 0)))
        .when(kind == "joiner", ~F.coalesce(needed, F.lit(False)))
        .when(kind == "numeral", (k("w_la") > 0) | (k("prev").rlike(r"^[\p{IsLatin}]$")) | (k("right1").rlike(r"^\p{IsLatin}$")))
        .when(k("mark"), k("joined"))
        .when(jamo, True)
        .when(k("cy") == 1, c1)
        .when(k("gr") == 1, g1)
        .when(k("la") == 1, c2 | g2)
        .otherwise(False)
    )
    plain = (
        F.when(~k("odd"), ch)
        .when((k("la") == 1) & kind.isNull(), F.when(k("w_cy") + k("t_cy_only") > 0, _back(CYRILLIC, ch)).otherwise(_back(GREEK, ch)))
        .otherwise(F.coalesce("plain", ch))
    )
    undecided = F.when((k("cy") == 1) & letters, c3).when((k("gr") == 1) & letters, g3).otherwise(False)
    d = d.withColumn("odd", F.coalesce(odd, F.lit(False)))
    return d.select(*keep, "text_id", "pos", "ch", plain.alias("plain"), "odd", F.coalesce(undecided, F.lit(False)).alias("undecided"), F.coalesce("plain", ch).alias("latin"))


def _back(table: dict[str, str], ch: Column) -> Column:
    """The letter of the other alphabet that a Latin letter stands in for; itself if there is none."""
    twins = {p: c for c, p in table.items()}
    return F.coalesce(F.nullif(F.translate(ch, "".join(twins), "".join(twins.values())), F.lit("")), ch)


def _shape(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "9")


@F.pandas_udf(StringType())
def compose(s: pd.Series) -> pd.Series:
    """Canonical composition; marks are put in the order of their classes."""
    return s.map(lambda v: unicodedata.normalize("NFC", v) if v is not None and not v.isascii() else v)


def _rebuilt(judged: DataFrame, extra: list[Column]) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("pos", "plain", "latin", "undecided")))
    d = judged.groupBy("text_id").agg(points.alias("p"), F.max("odd").alias("odd"), F.max("undecided").alias("undecided"), *extra)
    d = d.withColumn("plain", compose(F.array_join(F.transform("p", lambda x: x["plain"]), "")))
    return d.withColumn("as_latin", F.array_join(F.transform("p", lambda x: F.when(x["undecided"], x["latin"]).otherwise(x["plain"])), "")).drop("p")


def field_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts (text_id, text) of form values beyond ASCII, and the shapes of plain ASCII values."""
    values = one_per_id(table(spark, sf_dir, "form_fields"), "field_id", "value").where(F.length("value") > 0).select(F.col("field_id").alias("text_id"), F.col("value").alias("text"))
    shapes = values.where(~F.col("text").rlike(r"[^\x00-\x7f]")).select(_shape(F.col("text")).alias("shape")).distinct()
    return values.where(F.col("text").rlike(r"[^\x00-\x7f]")), shapes


def plain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, plain, odd of the form values beyond ASCII (all others are plain as they are)."""
    texts, shapes = field_points(spark, sf_dir)
    return _decided(_rebuilt(judge(code_points(texts), [], all_texts=False), []), shapes)


def _decided(d: DataFrame, shapes: DataFrame) -> DataFrame:
    """text_id, plain, odd of rebuilt form values."""
    # a value that may be all of another alphabet is judged by whether values of its Latin shape occur
    open_ones = d.where(F.col("undecided")).join(shapes, _shape(F.col("as_latin")) == F.col("shape"), "left")
    return d.where(~F.col("undecided")).select("text_id", "plain", "odd").unionByName(
        open_ones.select("text_id", F.when(F.col("shape").isNotNull(), F.col("as_latin")).otherwise(F.col("plain")).alias("plain"), (F.col("odd") | F.col("shape").isNotNull()).alias("odd"))
    )


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, line, pos, ch, char_id of the glyphs, as they stand in the table.

    line is a text: a key that holds a fraction is made equal for -0.0 and 0.0 at each step, and the points of a text, though in one partition, would be moved again each time.
    """
    chars = table(spark, sf_dir, "chars").where(F.col("char_id").isNotNull() & (F.length("ch") > 0))
    return chars.select("doc", "page", (F.round(F.col("rect.bottom") * 4) + F.lit(0.0)).cast("string").alias("line"), F.col("idx").alias("pos"), "ch", "char_id")


def glyph_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, pos, ch, char_id of the glyphs: a text is a line of a page (glyphs of one base line)."""
    chars = _glyphs(spark, sf_dir)
    points = spread_texts(chars.select(F.struct("doc", "page", "line").alias("text_id"), "pos", "ch", "char_id"), chars.count())
    return once(points)


def all_points(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """text_id, pos, ch, char_id of form values (text_id, text) and glyphs, so that one plan judges both.

    text_id holds the value's field_id, or the doc, page and line of glyphs; the char_id of a value's code points is null.
    """
    number = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) + glyphs.count()
    fields = texts.select(F.col("text_id").alias("field_id"), F.col("text").alias("ch"))
    rows = fields.unionByName(glyphs, allowMissingColumns=True).select(F.struct("field_id", "doc", "page", "line").alias("text_id"), "pos", "ch", "char_id")
    rows = spread_texts(rows, number)
    # a glyph is one point, of however many characters; values are taken apart after they were moved
    parts = F.when(F.col("char_id").isNull(), F.split("ch", "")).otherwise(F.array("ch"))
    points = rows.select("text_id", "char_id", "pos", F.posexplode(parts).alias("at", "ch"))
    return once(points.select("text_id", F.when(F.col("char_id").isNull(), F.col("at")).otherwise(F.col("pos")).alias("pos"), "ch", "char_id").where(F.length("ch") > 0))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the driver keeps every stage's plan, code and metrics: steps are planned one after another, and values and glyphs are judged by one plan
    garbled = cut_lineage(find_garbled(text_values(spark, sf_dir)).where(F.col("source_table") == "form_fields").select(F.col("row_id").alias("text_id")))
    texts, shapes = field_points(spark, sf_dir)
    # what holds no special sign is not odd, and garbled records are no case: neither is taken apart
    texts = cut_lineage(texts.where(F.col("text").rlike(special_class())).join(garbled, "text_id", "left_anti"))
    judged = judge(all_points(texts, _glyphs(spark, sf_dir)), ["char_id"], all_texts=False)
    # undecided values are put together again; of all others the odd points are enough
    again = F.col("char_id").isNull() & F.max("undecided").over(Window.partitionBy("text_id"))
    judged = cut_lineage(judged.withColumn("again", again).where(F.col("odd") | F.col("undecided") | F.col("again")).drop("again"))
    values = _rebuilt(judged.where(F.col("char_id").isNull()).withColumn("text_id", F.col("text_id.field_id")), [])
    fields = _decided(values, shapes).where(F.col("odd")).select(F.lit("form_fields").alias("source_table"), F.col("text_id").alias("row_id"))
    glyphs = judged.where(F.col("char_id").isNotNull()).select(F.lit("chars").alias("source_table"), F.col("char_id").alias("row_id"))
    return fields.unionByName(glyphs)


def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id and the consistent form of every form value that isn't null."""
    whole = one_per_id(table(spark, sf_dir, "form_fields"), "field_id", "value").where(F.col("value").isNotNull())
    return whole.join(plain_fields(spark, sf_dir), F.col("field_id") == F.col("text_id"), "left").select("field_id", F.coalesce("plain", "value").alias("plain"), F.coalesce("odd", F.lit(False)).alias("changed"))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, first_idx and the consistent text of every line of glyphs."""
    chars = one_per_id(table(spark, sf_dir, "chars"), "char_id", "doc", "page")
    d = judge(glyph_points(spark, sf_dir), ["char_id"])
    d = _rebuilt(d, [F.min("pos").alias("first_idx"), F.min("char_id").alias("char_id")])
    return d.join(chars, "char_id").select("doc", "page", "first_idx", "plain", "odd")
