"""Words of scanned pages made into continuous paragraphs, and what is wrong with each word.

Running lines are told from the body by their place and structure on the page. The body's lines are joined into one
stream; blanks, line ends and hyphens are only hints of where words end. A lattice lies over the stream: a token may be a
word as read, a word that recognition confuses with it, or two words that stuck together; two tokens may be one word, with
or without its hyphen where a line ends. The words of the lattice come from the corpus itself: words that fold to the same
key under the confusions, confirmed by an alignment. The best way through the lattice (Viterbi) weighs how often words
stand beside each other in the corpus, the confusions, the hyphens and the confidence of recognition, so that word
ends and characters are decided together. Tokens that no other way could beat, whatever stands beside them, are
fixed; they part the stream into stretches, which are decoded on their own without changing the result.

Marks without letters and digits are judged by how confident recognition was of the same mark over the whole corpus.
Paragraphs are the segments of the stream of lines with the least cost, by dynamic programming over each page.

A page is one task's unit, as a scanner delivers it; everything between pages, the corpus counts and the lattice's words
go through joins. Words with a null text have no defect; null line structures count as one line per page top.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage, table

HYPHENS = "-‐=¬­"
#: What recognition reads (left) where the other was printed, and letters read for digits.
CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("m", "in"), ("m", "rn"), ("d", "cl"), ("li", "h"), ("n", "ri"),
    ("c", "e"), ("o", "a"), ("f", "t"), ("l", "i"), ("b", "h"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("1", "l"), ("1", "i"), ("1", "I"), ("9", "g"), ("2", "z"), ("2", "Z"),
    ("6", "é"), ("I", "T"), ("rl", "n"), ("c1", "d"), ("ci", "d"), ("8", "B"), ("F", "E"), ("I", "l"), ("l", "I"), ("e", "c"), ("a", "o"), ("t", "f"), ("i", "l"), ("h", "b"), ("u", "n"), ("n", "u"), ("O", "Q"), ("D", "O"), ("P", "F"), ("C", "G"), ("u", "ii"), ("w", "vv"), ("ii", "ü"), ("rri", "m"), ("|", "I"), ("|", "l"), ("|", "i"),
)
FOR_DIGITS = dict(zip("OolISsbZzg", "0011556229", strict=True))
_ACCENTS = dict(zip("äáàâãåöóòôõüúùûéèêëíìîïñçÄÁÀÂÅÖÓÔÜÚÉÈÊÍÎÑÇ", "aaaaaaooooouuuueeeeiiiincAAAAAOOOUUEEEIINC", strict=True))
_ALNUM = r"[\p{L}\p{N}]"
_RUN = regex.compile(r"[\p{L}\p{N}]+")
#: What each character is made of for fold(): both sides of every pair of CONFUSIONS are made of the same, in any context.
_ATOMS = {x: a for xs, a in (("c e é 6", "c"), ("o a 0 O Q D", "o"), ("t f", "t"), ("i l 1 I T |", "i"), ("s 5 S", "s"), ("g 9", "g"), ("z 2 Z", "z"), ("B 8", "B"), ("F E P", "F"), ("C G", "C"), ("n u b h", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv")) for x in xs.split()}
#: Atoms that a digit may be made of, and digits.
_DIGITS = regex.compile("[oiszgcB0-9]")
#: Confidence below which recognition is unsure; printed words rarely fall below it.
UNSURE = 80
#: Chance that a word was read with one confusion, by confidence (sure, unsure, unknown); each further one halves it.
CONFUSED = (0.01, 0.1, 0.02)
#: Chances of words stuck together or torn apart within a line, and of a hyphen at a line's end that parts a word.
STUCK, PARTED = 0.001, 0.9
#: What a neighbour's count is divided by: the evidence that one word more has to bring.
PER_WORD = 3.0
#: Weight of a word's own count beside the counts of it and its neighbour.
ALONE = 0.01
#: Evidence for the lattice's words: a word, or pair of words, counts once it is seen twice, as a word seen once may itself be misread.
MIN_COUNT = 2


def normal(token: str) -> str:
    """Digits alike."""
    return regex.sub(r"\d", "#", token)


def as_number(token: str) -> str | None:
    """The normal form with letters that stand for digits taken as such, if that gives a number where letters and digits are mixed."""
    if not regex.search(r"\d", token):
        return None
    out, changed = token, False
    for m in reversed(list(_RUN.finditer(token))):
        run = m[0]
        if any(c.isdigit() or c in FOR_DIGITS for c in run) and all(c.isdigit() or c in FOR_DIGITS for c in run) and not run.isdigit():
            out = out[: m.start()] + "#" * len(run) + out[m.end() :]
            changed = True
    return normal(out) if changed else None


@lru_cache(maxsize=200_000)
def fold(token: str) -> str:
    """Equal for words that recognition confuses: what stands beside a confusion doesn't change what it is made of."""
    t = "".join(_ATOMS.get(c, c) for c in (_ACCENTS.get(c, c) for c in token))
    return regex.sub("r+(?=i)", lambda m: "i" * len(m[0]), t)


def fold_digits(token: str) -> str:
    """fold with all that may be a digit alike, whatever its length, for words that have digits."""
    t = _DIGITS.sub("#", fold(token))
    return regex.sub("r*#+", "#", t)


def keys_of(token: str) -> list[str]:
    """Keys under which candidates of a token as read are looked for."""
    out = []
    number = as_number(token)
    if number:
        out.append("n:" + number)
    if regex.search(r"\p{L}", token):
        out.append("w:" + fold(token))
    if regex.search(r"\d", token):
        out.append("d:" + fold_digits(token))
    return out


def keys_of_type(kind: str) -> list[str]:
    """Keys under which a normal form is found: words by fold, numbers as they are, words with digits with these alike."""
    if not regex.search(r"\p{L}", kind):
        return ["n:" + kind] if "#" in kind else []
    return ["w:" + fold(kind)] + (["d:" + fold_digits(kind)] if "#" in kind else [])


@lru_cache(maxsize=200_000)
def edits(read: str, printed: str) -> tuple[tuple[int, int], ...] | None:
    """Places in the token read of the least confusions that make it the printed normal form; None if there are none such."""
    n, m = len(read), len(printed)
    best: dict[tuple[int, int], tuple] = {(0, 0): (0, ())}
    for i in range(n + 1):
        for j in range(m + 1):
            at = best.get((i, j))
            if at is None:
                continue
            cost, where = at
            steps = []
            if i < n and j < m:
                a, b = read[i], printed[j]
                if a == b or (b == "#" and a.isdigit()):
                    steps.append((1, 1, 0))
                elif b == "#" and a in FOR_DIGITS:
                    steps.append((1, 1, 1))
                elif _ACCENTS.get(b) == a:
                    steps.append((1, 1, 1))
            for x, y in CONFUSIONS:
                if read.startswith(x, i) and printed.startswith(y, j):
                    steps.append((len(x), len(y), 1))
            for di, dj, c in steps:
                key, val = (i + di, j + dj), (cost + c, where + ((i, i + di),) if c else where)
                if key not in best or val[0] < best[key][0]:
                    best[key] = val
    got = best.get((n, m))
    return got[1] if got else None


def read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "words").where(F.col("word_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    return w.select("word_id", "doc", "page", "text", "left_px", "top_px", "width_px", "height_px", "confidence", "line")


def lay_out(words: DataFrame) -> DataFrame:
    """words, each once, with line_no, lines of the page, running, bare (no letter or digit) and sure (0 sure, 1 unsure, 2 unknown)."""
    pg, whole = Window.partitionBy("doc", "page").orderBy("word_id"), Window.partitionBy("doc", "page")
    # a repeated row stands in the same page: told there, without a shuffle of its own
    d = words.withColumn("again", F.lag("word_id").over(pg).eqNullSafe(F.col("word_id"))).where(~F.col("again"))
    d = d.withColumn("changed", (~F.col("line").eqNullSafe(F.lag("line").over(pg))).cast("int"))
    d = d.withColumn("line_no", F.sum("changed").over(pg.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("lines", F.max("line_no").over(whole))
    at = lambda n, c: F.max(F.when(F.col("line_no") == n, c)).over(whole)
    b, p = F.col("line.block"), F.col("line.par")
    d = d.withColumn("b1", at(1, b)).withColumn("p1", at(1, p)).withColumn("b2", at(2, b)).withColumn("p2", at(2, p))
    d = d.withColumn("bl", at(F.col("lines"), b)).withColumn("bk", at(F.col("lines") - 1, b))
    d = d.withColumn("ends1", F.max(F.when((F.col("line_no") == 1), F.struct("word_id", F.col("text").rlike("[.!?,;:]$").alias("e")))).over(whole)["e"])
    # a header stands apart as the first paragraph of the first block; a title, and a body that begins a page, don't
    header = (F.col("b1") == 1) & (F.col("p1") == 1) & ((F.col("b2") != 1) | (F.col("p2") != 1)) & ~F.coalesce("ends1", F.lit(False)) & (F.col("lines") > 1)
    # a footer is a block of its own below at least one line of body
    footer = (F.col("bl") != F.col("bk")) & ((F.col("lines") > 2) | ((F.col("lines") == 2) & ~header))
    d = d.withColumn("header", F.coalesce(header, F.lit(False)) & (F.col("line_no") == 1)).withColumn("footer", F.coalesce(footer, F.lit(False)) & (F.col("line_no") == F.col("lines")))
    # joined by page, as the windows are partitioned, so that a doc with many pages makes no hot key
    first_page = words.groupBy("doc").agg(F.min("page").alias("page")).withColumn("is_first", F.lit(True))
    d = d.join(first_page, ["doc", "page"], "left").withColumn("header", F.col("header") & F.col("is_first").isNull())
    sure = F.when(F.col("confidence").isNull(), 2).when(F.col("confidence") < UNSURE, 1).otherwise(0)
    return d.select("word_id", "doc", "page", "text", "left_px", "top_px", "width_px", "height_px", "line_no", (F.col("header") | F.col("footer")).alias("running"), (~F.col("text").rlike(_ALNUM)).alias("bare"), sure.alias("sure"))


def marks(laid: DataFrame) -> DataFrame:
    """word_id of the words without letters and digits that are no printed text.

    Printed marks are read unsurely as seldom as words are. Where a mark (in the body or in running lines) is read
    unsurely more than twice as often, its unsure occurrences are none of print; of unknown confidence, the likelier.
    """
    bare = laid.where("bare")
    rate = laid.where(~F.col("bare")).agg((F.count_if(F.col("sure") == 1) / F.greatest(F.count_if(F.col("sure") < 2), F.lit(1))).alias("rate"))
    seen = bare.groupBy("text", "running").agg(F.count_if(F.col("sure") == 0).alias("high"), F.count_if(F.col("sure") == 1).alias("low"))
    seen = seen.crossJoin(F.broadcast(rate))  # rate has one row
    none = F.when(F.col("high") < F.col("low"), 2).when(F.col("low") > 2 * F.coalesce("rate", F.lit(0.0)) * (F.col("high") + F.col("low")), 1).otherwise(0)
    d = look_up(bare.select("word_id", "text", "running", "sure"), seen.select("text", "running", none.alias("none")).where("none > 0"), ["text", "running"], "inner", F.length("text") + 16)
    return d.where((F.col("sure") == 1) | ((F.col("sure") == 2) & (F.col("none") == 2))).select("word_id")


#: A looked-up table of no more bytes than this goes to every executor.
BROADCAST_BYTES = 32 << 20


def look_up(big: DataFrame, small: DataFrame, keys: list[str], how: str, width: Column) -> DataFrame:
    """big joined with the one row that small has for each key; width: bytes of a row of small.

    small is broadcast if its measured size allows. Otherwise the keys that hold more than their part of big (at
    most as many keys as there are such parts) are joined by broadcasting their rows alone, the others by a shuffle.
    """
    if (small.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    parts = 8 * big.sparkSession.sparkContext.defaultParallelism
    hot = cut_lineage(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > big.count() // parts).select(*keys))
    often = big.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(small.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return often.unionByName(big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how))


def _core(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\p{L}\p{N}|]+|[^\p{L}\p{N}|]+$", "")


def _normal(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]", "#")


def stream(laid: DataFrame) -> DataFrame:
    """Tokens of body and running lines in reading order, lines joined: core, type, before and after (types beside it), edge (what stands between it and the next: h hyphen at a line's end, l line's end, s blank), head (core without that hyphen), over (the next page's first token where the page ends with a hyphen), taken (it is such a token)."""
    d = laid.where(~F.col("bare"))
    pg = Window.partitionBy("doc", "page", "running").orderBy("word_id")
    d = d.withColumn("core", _core(F.col("text")))
    nxt = F.lead(F.struct("word_id", "core", "text", "line_no", "sure")).over(pg)
    d = d.withColumn("next", nxt).withColumn("prev", F.lag("core").over(pg)).withColumn("hyphened", F.col("text").rlike(rf"{_ALNUM}[{HYPHENS}]$") & ~F.col("running"))
    # the last word of a page may go on with the first body word of the next
    ends = d.where(~F.col("running")).groupBy("doc", "page").agg(
        F.min(F.struct("word_id", "core", "text", F.lit(-1).cast("bigint").alias("line_no"), "sure")).alias("first"), F.max(F.struct("word_id", F.col("hyphened").alias("h")))["h"].alias("ends_open")
    )
    follow = ends.select("doc", (F.col("page") - 1).alias("page"), F.col("first").alias("over"))
    before = ends.where("ends_open").select("doc", (F.col("page") + 1).alias("page"), F.lit(True).alias("opened"))
    own = ends.select("doc", "page", F.col("first.word_id").alias("first_id"))
    side = own.join(follow, ["doc", "page"], "left").join(before, ["doc", "page"], "left")
    d = d.join(side, ["doc", "page"], "left")
    d = d.withColumn("over", F.when(F.col("hyphened") & F.col("next").isNull(), F.col("over")))
    d = d.withColumn("next", F.coalesce("over", "next"))
    goes_on = F.col("hyphened") & F.col("next").isNotNull() & (F.col("next.line_no") != F.col("line_no")) & F.col("next.text").rlike(r"^\W*[\p{L}\p{N}]")
    edge = F.when(goes_on, "h").when(F.col("next.line_no") != F.col("line_no"), "l").otherwise("s")
    head = F.when(goes_on, F.regexp_replace(F.regexp_replace("text", rf"[{HYPHENS}]$", ""), r"^[^\p{L}\p{N}|]+", ""))
    taken = F.coalesce("opened", F.lit(False)) & (F.col("word_id") == F.col("first_id")) & ~F.col("running")
    d = d.withColumn("edge", F.when(F.col("next").isNotNull(), edge)).withColumn("head", head).withColumn("taken", taken)
    tail = F.coalesce(F.lag("edge").over(pg) == "h", F.lit(False)) | F.col("taken")
    return d.select("word_id", "doc", "page", "running", "text", "core", _normal(F.col("core")).alias("type"), _normal(F.col("prev")).alias("before"), _normal(F.col("next.core")).alias("after"), F.col("next.core").alias("next_core"), "edge", "head", "sure", F.when((F.col("edge") == "h") & F.col("over").isNotNull(), F.array("over")).alias("over"), "taken", tail.alias("tail"))


_TOKEN = "struct<word_id bigint, text string, core string, type string, edge string, head string, sure int, alts array<struct<printed string, n bigint, k int>>, cuts array<struct<x string, y string>>, joined array<struct<token string, printed string, n bigint, edits array<struct<lo int, hi int>>>>, whole string>"


def decode(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(laid out words, decisions): decisions has word_id, misread, split, printed, taken, mark of words that aren't as they should be.

    taken: its text belongs to the word before; mark: what stands after the word that the next token ended.
    """
    laid = cut_lineage(lay_out(words))
    s = cut_lineage(stream(laid))
    plain = s.where((F.coalesce("edge", F.lit("s")) != "h") & ~F.col("tail"))
    counts = cut_lineage(plain.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(rf"{_ALNUM}-$")).alias("hung")))
    pairs = cut_lineage(plain.where(F.col("before").isNotNull()).groupBy(F.col("before").alias("a"), F.col("type").alias("z")).agg(F.count(F.lit(1)).alias("b")))
    tokens, joined, whole = _lattice(s, counts, pairs)
    d = look_up(s, tokens, ["core"], "left", F.length("core") + 40 * (F.size("alts") + F.size("cuts")))
    d = look_up(d, joined, ["head", "next_core"], "left", F.length("head") + F.length("next_core") + F.lit(100))
    d = look_up(d, whole, ["type", "after"], "left", F.length("type") + 2 * F.length("whole"))
    d = d.withColumn("whole", F.when((F.col("edge") != "h") & F.col("over").isNull(), F.col("whole")))
    open_here = (F.coalesce(F.size("alts"), F.lit(0)) > 0) | (F.coalesce(F.size("cuts"), F.lit(0)) > 0) | F.coalesce(F.col("edge") == "h", F.lit(False)) | F.col("whole").isNotNull() | F.col("tail")
    pg = Window.partitionBy("doc", "page", "running").orderBy("word_id")
    # a token whose predecessor may be one word with it is open too
    d = d.withColumn("open", (open_here | F.coalesce(F.lag("whole").over(pg).isNotNull(), F.lit(False))) & ~F.col("taken"))
    d = d.withColumn("stretch", F.sum(F.when(F.col("open"), 0).otherwise(1)).over(pg.rowsBetween(Window.unboundedPreceding, 0))).where("open")
    token = F.struct("word_id", "text", "core", "type", "edge", "head", "sure", "alts", "cuts", "joined", "whole")
    g = d.groupBy("doc", "page", "running", "stretch").agg(
        F.min("word_id").alias("id"), F.array_sort(F.collect_list(token)).alias("tokens"),
        F.min_by("before", "word_id").alias("before"), F.max_by("after", "word_id").alias("after"), F.max_by("over", "word_id").alias("over"),
    )
    g = cut_lineage(g.select("id", F.col("tokens").cast(f"array<{_TOKEN}>").alias("tokens"), "before", "after", "over"))
    asked = cut_lineage(g.mapInPandas(_asked, "id bigint, a string, z string"))
    model = pairs.unionByName(counts.select(F.col("type").alias("a"), F.lit("").alias("z"), F.col("n").alias("b"))).unionByName(counts.where("hung > 0").select(F.col("type").alias("a"), F.lit("-").alias("z"), F.col("hung").alias("b")))
    told = look_up(asked, model.join(asked.select("a", "z").distinct(), ["a", "z"], "left_semi"), ["a", "z"], "inner", F.length("a") + F.length("z") + 24)
    told = told.groupBy("id").agg(F.collect_list(F.struct("a", "z", "b")).alias("told"))
    decided = g.join(told, "id", "left").mapInPandas(_decoded, "word_id bigint, misread boolean, split boolean, printed string, taken boolean, mark string")
    return laid, cut_lineage(decided)


def _lattice(s: DataFrame, counts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lattice's arcs: (core, alts, cuts) of tokens, (head, next_core, joined) of hyphens at line ends, (type, after, whole) of neighbours that may be one word."""
    keyed = _keyed(counts)
    parts = s.where(F.col("edge") == "h").select("head", "next_core").distinct()
    both = cut_lineage(parts.select("head", "next_core", F.explode(F.array(F.concat("head", "next_core"), F.concat("head", F.lit("-"), "next_core"))).alias("token")))
    single = s.select(F.col("core").alias("token")).where(F.col("token").rlike(r"\p{L}|\p{N}")).distinct()
    found = cut_lineage(_candidates(single.unionByName(both.select("token")).distinct(), keyed))
    own = counts.select(F.col("type"), F.col("n").alias("own"))
    # no context can make a candidate win that is too rare beside the word as read: neighbours' counts are at most the word's own
    can_win = (F.col("n") * (1 + ALONE) + ALONE) ** 2 * max(CONFUSED) > (ALONE * F.coalesce("own", F.lit(0))) ** 2
    alts = found.withColumn("type", _normal(F.col("token"))).join(own, "type", "left").where(can_win)
    alts = alts.groupBy(F.col("token").alias("core")).agg(F.collect_list(F.struct("printed", "n", F.size("edits").alias("k"))).alias("alts"))
    # a token that may be two words which stand beside each other elsewhere, more often than the token is seen
    cut = single.withColumn("type", _normal(F.col("token"))).where(F.length("type") >= 2).join(own, "type")
    cut = cut.select("token", "own", F.explode(F.transform(F.sequence(F.lit(1), F.length("type") - 1), lambda i: F.struct(F.substring("type", F.lit(1), i).alias("x"), F.substring("type", i + 1, F.length("type")).alias("y")))).alias("c"))
    often = pairs.where(F.col("b") >= MIN_COUNT).select(F.col("a").alias("x"), F.col("z").alias("y"), "b")
    cuts = cut.select("token", "own", "c.x", "c.y").join(often, ["x", "y"]).where(F.col("b") >= F.col("own"))
    cuts = cuts.groupBy(F.col("token").alias("core")).agg(F.collect_list(F.struct("x", "y")).alias("cuts"))
    arcs = cut_lineage(alts.join(cuts, "core", "full").select("core", F.coalesce("alts", F.array().cast("array<struct<printed string, n bigint, k int>>")).alias("alts"), F.coalesce("cuts", F.array().cast("array<struct<x string, y string>>")).alias("cuts")))
    # neighbours that joined are a word more often seen than side by side
    together = pairs.where(F.col("a").rlike(r"\p{L}$") & F.col("z").rlike(r"^\p{L}")).withColumn("type", F.concat("a", "z")).join(own.where(F.col("own") >= MIN_COUNT), "type").where(F.col("own") > F.col("b"))
    whole = cut_lineage(together.select(F.col("a").alias("type"), F.col("z").alias("after"), F.col("type").alias("whole")))
    options = both.join(found, "token", "left").groupBy("head", "next_core").agg(F.collect_list(F.struct("token", "printed", "n", "edits")).alias("joined"))
    return arcs, cut_lineage(options), whole


def _ways(tokens: list[dict], over: dict | None) -> list[tuple]:
    """Arcs of a stretch: (begin, end, words, log chance, as_read, decision); decision: (kind, printed, edits) of what the arc means."""
    toks = tokens + ([{**over, "type": normal(over["core"]), "alts": None, "cuts": None, "edge": None, "joined": None, "whole": None}] if over else [])
    arcs: list[tuple] = []
    for i, t in enumerate(toks):
        plain_hyphen = 0.0
        if t["edge"] == "h" and i + 1 < len(toks):
            tail = toks[i + 1]["core"]
            seen = {t["head"] + tail, t["head"] + "-" + tail}
            for token in seen:
                arcs.append((i, i + 2, (normal(token),), log(PARTED), None, ("joined", normal(token), ())))
            unsure = max(t["sure"] == 1, toks[i + 1]["sure"] == 1)
            for c in t["joined"] if t["joined"] is not None else ():
                if c["printed"] is not None:
                    k = len(c["edits"])
                    arcs.append((i, i + 2, (c["printed"],), log(PARTED) + log(CONFUSED[int(unsure)]) + (k - 1) * log(0.5), None, ("joined", c["printed"], tuple((e["lo"], e["hi"]) for e in c["edits"]))))
            plain_hyphen = log(1 - PARTED)
        kind = t["type"] if t["edge"] != "h" else normal(t["head"])
        arcs.append((i, i + 1, (kind,), plain_hyphen, "hung" if t["edge"] == "h" else "read", None))
        for c in t["alts"] if t["alts"] is not None else ():
            arcs.append((i, i + 1, (c["printed"],), plain_hyphen + log(CONFUSED[t["sure"]]) + (c["k"] - 1) * log(0.5), "hung" if t["edge"] == "h" else None, ("word", c["printed"], ())))
        for c in t["cuts"] if t["cuts"] is not None else ():
            arcs.append((i, i + 1, (c["x"], c["y"]), log(STUCK), None, ("cut", c["x"] + " " + c["y"], ())))
        if t["whole"] is not None and i + 1 < len(toks):
            arcs.append((i, i + 2, (t["whole"],), log(STUCK), None, ("whole", t["whole"], ())))
    return arcs


def _beside(arcs: list[tuple], n: int, before: str | None, after: str | None) -> list[tuple[str, str]]:
    """What the model is asked for: pairs of words that may stand beside each other, words alone (beside ""), and words that hang a hyphen (beside "-")."""
    begins: dict[int, set] = {n: {after} if after is not None else set()}
    ends: dict[int, set] = {0: {before} if before is not None else set()}
    out: set = set()
    for i, j, words, _, read, _d in arcs:
        begins.setdefault(i, set()).add(words[0])
        ends.setdefault(j, set()).add(words[-1])
        out.update((w, "") for w in words)
        out.update(zip(words, words[1:], strict=False))
        if read == "hung":
            out.add((words[0], "-"))
    for at, left in ends.items():
        out.update((x, y) for x in left for y in begins.get(at, ()))
    return list(out)


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids: list = []
        xs: list = []
        for i, tokens, before, after, over in zip(pdf["id"], pdf["tokens"], pdf["before"], pdf["after"], pdf["over"], strict=True):
            tokens, over = list(tokens), over[0] if over is not None and len(over) else None
            got = _beside(_ways(tokens, over), len(tokens) + (over is not None), before, None if over else after)
            ids.extend([i] * len(got))
            xs.extend(got)
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "a": [a for a, _ in xs], "z": [z for _, z in xs]})


def best_way(arcs: list[tuple], n: int, before: str | None, after: str | None, count: dict[tuple[str, str], int]) -> list[tuple]:
    """The arcs of the likeliest way from 0 to n (Viterbi; states are the last word and whether it stands as read).

    A word of the lattice is weighed by its counts with its neighbours on both sides, its own count in small part. A token
    as read is one of those counted and doesn't speak for itself.
    """

    def side(word: str, pair: tuple, read: bool, both_read: bool) -> float:  # beside nothing a word is weighed by its own count
        b, alone = count.get(pair, 0), count.get((word, ""), 0)
        return log((max(b - both_read, 0) + ALONE * max(alone - read, 0) + ALONE) / PER_WORD)

    # node -> {(last word, as read): (score, arc, state before)}; the word before a stretch is fixed and isn't weighed itself
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][(before, True)] = (0.0, None, None)
    by_begin: list[list] = [[] for _ in range(n)]
    for arc in arcs:
        by_begin[arc[0]].append(arc)
    for at in range(n):
        for state, (score, _, _) in best[at].items():
            last, last_read = state
            for arc in by_begin[at]:
                _, end, words, chance, how, _ = arc
                read = how == "read"
                total = score + chance
                prior, prior_read, fixed = last, last_read, at == 0
                for w in words:
                    pair = (prior, w)
                    again = read and prior_read
                    total += side(w, pair, read, again)
                    if not fixed and prior is not None:
                        total += side(prior, pair, prior_read, again)
                    prior, prior_read, fixed = w, read, False
                if how == "hung":  # a hyphen that parts nothing: as likely as the word hangs one elsewhere
                    h, alone = count.get((words[0], "-"), 0), count.get((words[0], ""), 0)
                    total += log((h + 0.01) / (alone + 1))
                key = (prior, prior_read)
                if key not in best[end] or total > best[end][key][0]:
                    best[end][key] = (total, arc, state)
    top = None
    for (last, last_read), (score, _, _) in best[n].items():
        score += side(last, (last, after), last_read, last_read)
        if top is None or score > top[0]:
            top = (score, (last, last_read))
    out: list[tuple] = []
    at, state = n, top[1]
    while at:
        _, arc, state = best[at][state]
        out.append(arc)
        at = arc[0]
    return out[::-1]


def _mark_after(text: str) -> str:
    m = regex.search(r"[^\p{L}\p{N}]+$", text or "")
    return m[0] if m else ""


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["word_id", "misread", "split", "printed", "taken", "mark"]
    for pdf in batches:
        rows: list[tuple] = []
        for tokens, before, after, over, told in zip(pdf["tokens"], pdf["before"], pdf["after"], pdf["over"], pdf["told"], strict=True):
            tokens, over = list(tokens), over[0] if over is not None and len(over) else None
            count = {(x["a"], x["z"]): x["b"] for x in told} if told is not None else {}
            toks = tokens + ([over] if over else [])
            for i, j, _, _, _, what in best_way(_ways(tokens, over), len(toks), before, None if over else after, count):
                if what is None:
                    continue
                kind, printed, edits = what
                word, last = toks[i], toks[j - 1]
                if kind == "joined":
                    cut = len(word["head"])
                    rows.append((word["word_id"], any(lo < cut for lo, _ in edits), True, printed, False, _mark_after(last["text"])))
                    rows.append((last["word_id"], any(hi > cut for _, hi in edits), False, None, True, None))
                elif kind == "whole":
                    over_line = word["edge"] == "l"
                    rows.append((word["word_id"], not over_line, over_line, printed, False, _mark_after(last["text"])))
                    rows.append((last["word_id"], not over_line, False, None, True, None))
                else:
                    rows.append((word["word_id"], True, False, printed, False, None))
        yield pd.DataFrame(rows, columns=columns)


def _keyed(counts: DataFrame) -> DataFrame:
    """key, type, n: all types seen MIN_COUNT times under each of their keys; types are distinct, so a key has few rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, n) for t, n in zip(pdf["type"], pdf["n"], strict=True) for k in keys_of_type(t)]
            yield pd.DataFrame(rows, columns=["key", "type", "n"])

    return counts.where(F.col("n") >= MIN_COUNT).select("type", "n").mapInPandas(work, "key string, type string, n bigint")


def _candidates(tokens: DataFrame, keyed: DataFrame) -> DataFrame:
    """token, printed, n, edits: types that a token may have been printed as, with the places of its confusions."""

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, k) for t in pdf["token"] for k in keys_of(t)]
            yield pd.DataFrame(rows, columns=["token", "key"])

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, c, n in zip(pdf["token"], pdf["printed"], pdf["n"], strict=True):
                if c != normal(t) and (e := edits(t, c)):
                    rows.append((t, c, n, [{"lo": a, "hi": b} for a, b in e]))
            yield pd.DataFrame(rows, columns=["token", "printed", "n", "edits"])

    asked = tokens.mapInPandas(key_rows, "token string, key string").join(keyed, "key")
    asked = asked.select("token", F.col("type").alias("printed"), "n").where(F.col("printed") != _normal(F.col("token"))).distinct()
    return asked.mapInPandas(confirm, "token string, printed string, n bigint, edits array<struct<lo int, hi int>>")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid, decided = decode(read_words(spark, sf_dir))
    running = laid.where("running").select("word_id", F.lit("running").alias("defect"))
    noise = marks(laid).select("word_id", F.lit("misread").alias("defect"))
    misread = decided.where("misread").select("word_id", F.lit("misread").alias("defect"))
    split = decided.where("split").select("word_id", F.lit("split").alias("defect"))
    return running.unionByName(noise).unionByName(misread).unionByName(split).distinct()


def _restore(read: str, printed: str | None) -> str:
    """The text of a word with its core put as printed; digits of the normal form are those read."""
    if printed is None:
        return read
    m = regex.search(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", read)
    if not m:
        return printed
    digits = iter([FOR_DIGITS.get(c, c) for c in m[0] if c.isdigit() or c in FOR_DIGITS]) if "#" in printed else iter(())
    if printed.count("#") == sum(c.isdigit() for c in m[0]):
        digits = iter([c for c in m[0] if c.isdigit()])
    body = "".join(next(digits, "0") if c == "#" else c for c in printed)
    return read[: m.start()] + body + read[m.end() :]


def _cuts(lines: list[dict]) -> list[int]:
    """Indices of lines that begin a paragraph: least cost over all ways to cut the lines of a page.

    A cut costs less the more the gap above the line exceeds the usual one and the further the line is indented; lines
    joined within a paragraph cost by the same measures.
    """
    if not lines:
        return []
    gaps = sorted(b["top"] - a["top"] for a, b in zip(lines, lines[1:], strict=False)) or [0]
    usual = max(1, gaps[len(gaps) // 3])
    margin = min(x["left"] for x in lines)
    height = max(1, sorted(x["height"] for x in lines)[len(lines) // 2])
    n = len(lines)
    right = max(x["right"] for x in lines)
    best = [0.0] + [float("inf")] * n
    back = [0] * (n + 1)
    loose = []
    for k in range(n):
        gap = (lines[k]["top"] - lines[k - 1]["top"]) / usual if k else 2.0
        indent = (lines[k]["left"] - margin) / height
        short = k > 0 and lines[k - 1]["right"] < right - 6 * height
        loose.append(2.5 * max(0.0, gap - 1.15) + 0.6 * min(indent, 2.0) + (0.3 if short else 0.0))
    total = [0.0]
    for x in loose:
        total.append(total[-1] + x)
    least, at = float("inf"), 0  # over all begins so far, of what doesn't depend on the end
    for end in range(1, n + 1):
        if (cost := best[end - 1] - total[end]) <= least + 1e-9:  # of equal ones the last
            least, at = cost, end - 1
        best[end], back[end] = least + 0.9 + total[end], at
    out, at = [], n
    while at:
        out.append(back[at])
        at = back[at]
    return out[::-1]


def repaired_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, paragraph, text, continues: the paragraphs of each page's body, words repaired; continues: it goes on from the page before."""
    laid, decided = decode(read_words(spark, sf_dir))
    noise = marks(laid).withColumn("noise", F.lit(True))
    fixes = decided.groupBy("word_id").agg(F.max("printed").alias("printed"), F.max("split").alias("split"), F.max("mark").alias("mark"), F.max("taken").alias("taken"))
    # both sides of the decisions are keyed by word: few words have any, and no word has many
    body = laid.where(~F.col("running")).join(fixes, "word_id", "left").join(noise, "word_id", "left").where(F.col("noise").isNull())

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_id")
        lines: list[dict] = []
        for r in pdf.itertuples(index=False):
            if not lines or lines[-1]["no"] != r.line_no:
                lines.append({"no": r.line_no, "left": r.left_px, "top": r.top_px, "height": r.height_px, "right": r.left_px, "words": []})
            x = lines[-1]
            x["right"] = max(x["right"], r.left_px + r.width_px)
            if r.taken is True:
                continue
            printed = r.printed if isinstance(r.printed, str) else None
            if isinstance(r.mark, str):  # the word that it ends, or is part of, goes on in the next token
                x["words"].append(_restore(regex.sub(rf"[{HYPHENS}]$", "", r.text), printed) + r.mark)
            else:
                x["words"].append(_restore(r.text, printed))
        rows, cuts = [], set(_cuts(lines))
        for k, x in enumerate(lines):
            if k in cuts or not rows:
                rows.append([pdf["doc"].iloc[0], pdf["page"].iloc[0], len(rows) + 1, []])
            rows[-1][3].extend(x["words"])
        out = pd.DataFrame([(d, p, n, " ".join(w)) for d, p, n, w in rows], columns=["doc", "page", "paragraph", "text"])
        out["continues"] = [n == 1 and bool(regex.match(r"\p{Ll}", t)) for n, t in zip(out["paragraph"], out["text"], strict=True)]
        return out

    return body.groupBy("doc", "page").applyInPandas(page, "doc string, page int, paragraph int, text string, continues boolean")


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_paragraphs(spark, sf_dir)
