"""Text decoded with the wrong character encoding: which records, and the original text where it can be restored.

A value is cut at blanks into chunks. What goes wrong is learned from twins, pairs of a garbled record's chunk and a clean
one: chunks that are equal once all that is not ASCII is taken out, the more frequent one clean, are aligned by the ASCII
characters, and each aligned run votes for the pairs of encodings (as read, as written) that turn one into the other, or,
where none does, for the run itself as a mapping. Chunks that keep no ASCII to align by (other scripts, UTF-16) are joined
with the clean chunk that a pair of encodings turns them into. Pairs and runs with enough twins are the learned
transformations; they alone are applied to all other chunks. A restored chunk is accepted if what it is made of is common
in the corpus and what it was made of isn't.

Encodings that write with ASCII alone (UTF-7, ISO-2022, HZ) leave no character beyond ASCII: chunks that hold one of their
shifts are tried too, and where one of a value's chunks is accepted, its others were written by the same encoding.

Replacement characters, byte order marks read as text, NUL and C1 controls show a wrong decoding by themselves, even
where nothing can be restored. Null and empty values are no case; rows that repeat an id count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, one_per_id, table
from .letters import CYRILLIC, GREEK, HIDDEN
from .spread import spread

#: Encodings by what they are read as and what they are written in; `latin` writes Western letters.
READ_AS = "cp1252 cp1250 cp1251 cp1253 cp437 cp850 cp852 cp866 mac_roman koi8_r gbk cp932 cp949 big5".split()
LATIN = "cp1252 cp1250 cp437 cp850 mac_roman".split()
OTHER = "cp1251 cp1253 koi8_r cp866 cp855 mac_cyrillic gb18030 cp932 euc_jp cp949 big5 cp037 cp500 cp1140".split()
#: The pairs of encodings that twins may vote for.
PAIRS = [(w, "utf-8") for w in READ_AS] + [(w, r) for w in READ_AS for r in OTHER if w != r and not (w in ("gbk", "cp932", "cp949", "big5") and r in OTHER)] + [(w, r) for w in READ_AS[:10] for r in LATIN if w != r]
#: Distinct garbled chunks that a transformation must explain.
MIN_VOTES = 2
#: Encodings that write with ASCII alone, by the shifts that show them.
SHIFTS = {"utf-7": r"\+[A-Za-z0-9/]{2,}-?", "iso2022_jp_2": r"\x1b[$(.]", "iso2022_kr": r"\x1b\$\)C|\x0e", "hz": r"~\{"}
#: Values and chunks that may have been decoded wrongly.
ODD = "|".join([r"[^\x01-\x7e]", *SHIFTS.values()])

_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー々\ue000-\uf8ff]+")
_SURE = regex.compile("[\x00�]|^(?:þÿ|ÿþ|ï»¿)|(?<=[\\s\\d.])(?:þÿ|ÿþ)|[\x80-\x84\x86-\x9f]")
_BAD = regex.compile(r"[\p{Cc}\p{Co}\p{Cn}\p{Cs}�｡-ﾟ─-▟]")
#: Marks around words that don't count as part of them.
_EDGES = regex.compile(r"^[!-/:-@\[-`{-~«»“”„‘’…–—¿¡。，！？（）：、]+|[!-/:-@\[-`{-~«»“”„‘’…–—¿¡。，！？（）：、]+$")
_LOOK = {ord(c): p for c, p in (CYRILLIC | GREEK).items()} | {ord(c): None for c in HIDDEN + "\u200c\u200d"} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_EBCDIC = ("cp037", "cp500", "cp1140")
_PUNCHED = regex.compile(r"[A-Za-z0-9 .,:;()/&'-]{3,}")

_ALPHABETS = regex.compile(r"\p{Latin}+|\p{Cyrillic}+|\p{Greek}+|[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Hangul}]+")


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeError:
        pass
    if codec != "cp1252":
        return None
    try:  # bytes that have no character there are often kept as controls
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)
    except UnicodeError:
        return None


def _decode(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeError:
        return None


def chunk_features(chunk: str) -> list[str]:
    """What a chunk is made of: pairs of characters of scripts without blanks, else its words with digits alike."""
    out: list[str] = []
    for c in chunk.split(" "):
        c = regex.sub(r"\d", "9", c)
        runs = _WIDE.findall(c)
        for r in runs:
            out.extend(r[i : i + 2] for i in range(len(r) - 1)) if len(r) > 1 else out.append(r)
        rest = _WIDE.sub(" ", c) if runs else c
        for w in rest.split(" "):
            core = _EDGES.sub("", w) if w.isascii() or regex.search(r"\p{L}\p{L}", w) else w
            if core or w:
                out.append(core or w)
    return out


def _plain(text: str) -> bool:
    """Whether a reading could be text at all: one alphabet a word, no controls, no capital after a small letter."""
    if _BAD.search(text):
        return False
    for w in regex.findall(r"[\p{L}\p{M}]+", text):
        if len(_ALPHABETS.findall(w)) > 1:
            return False
        if regex.search(r"\p{Ll}\p{Lu}\p{Ll}?\p{Lu}", w):
            return False
    return True


def unshift(text: str, codec: str) -> str | None:
    """The text of one written by an encoding of ASCII alone; null if it isn't such, or if halves of a surrogate pair would be left (Python's UTF-7 lets them pass; they are no text and no UTF-8)."""
    if not text.isascii() or not regex.search(SHIFTS[codec], text):
        return None
    data = text.encode("ascii")
    if codec == "iso2022_kr" and not data.startswith(b"\x1b$)C"):  # announced once, at the beginning of a text
        data = b"\x1b$)C" + data
    t = _decode(data, codec)
    return None if t is None or t == text or regex.search(r"\p{Cs}", t) else t


def readings(chunk: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(restored, ways) of each text that the chunk may have been, with all ways of decoding it wrongly that lead to it."""
    found: dict[str, list[str]] = {}
    data = {w: _encode(chunk, w) for w in READ_AS}
    for w, r in PAIRS:
        if (b := data[w]) is None:
            continue
        t = _decode(b, r)
        if t is None or t == chunk:
            continue
        if t in found:
            found[t].append(f"{r} read as {w}")
            continue
        if r == "utf-8":  # the same again; what lies between need not look like text
            for w2 in ("cp1252", "cp1250", "mac_roman", "cp437"):
                b2 = _encode(t, w2)
                t2 = _decode(b2, "utf-8") if b2 is not None else None
                if t2 is not None and t2 != t and _plain(t2):
                    found.setdefault(t2, []).append(f"{r} read as {w2}, then {r} read as {w}")
        if not _plain(t):
            continue
        if r in _EBCDIC:  # letters and digits lie beyond ASCII there
            if not _PUNCHED.fullmatch(t) or sum(c > "\x7f" for c in chunk) < 0.6 * len(chunk):
                continue
        elif r != "utf-8" and t.isascii():
            continue
        elif r in OTHER and regex.search(r"\p{Latin}", t) and not regex.search(r"[\p{Cyrillic}\p{Greek}]{3}|[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]", t):
            continue
        found[t] = [f"{r} read as {w}"]
    look = chunk.translate(_LOOK)
    if look != chunk and look and _plain(look):  # nothing decoded wrongly: letters that look the same
        found[look] = ["look-alikes"]
    if all(ord(c) > 0xFF or c == "\x00" for c in chunk):
        t = _decode(chunk.encode("utf-16-be", "surrogatepass"), "utf-16-le")
        if t and _plain(t):
            found.setdefault(t, []).append("utf-16 of the other byte order")
    for codec in SHIFTS:
        t = unshift(chunk, codec)
        if t and _plain(t):
            found.setdefault(t, []).append(f"{codec} read as ascii")
    return tuple((t, tuple(ways)) for t, ways in found.items())


def restore_marked(value: str) -> str | None:
    """The text of a value that begins with, or holds, a byte order mark read as text; null if its bytes don't decode."""
    for mark, codec in (("þÿ", "utf-16-be"), ("ÿþ", "utf-16-le"), ("ï»¿", "utf-8")):
        at = value.find(mark)
        if at < 0:
            continue
        body = value[at + len(mark) :]
        if codec != "utf-8" and "\x00" not in body:
            return value[:at] + body
        data = _encode(body, "cp1252")
        if data is None:
            return None
        if codec != "utf-8" and len(data) % 2:
            data = data + b"\x00" if codec == "utf-16-le" else data[:-1]
        text = _decode(data, codec)
        return None if text is None else value[:at] + text
    return None


def _runs(chunk: str) -> list[str]:
    """Runs of characters beyond ASCII, by the ASCII characters between them: n + 1 runs, empty ones too, for n of these."""
    return regex.split(r"[\x00-\x7f]", chunk)


def votes(garbled: str, clean: str) -> list[str]:
    """Ways that turn every run of one chunk into the aligned run of its twin; where none does, each garbled run with its clean one (parted by a NUL), if it holds signs that no word has."""
    a, b = _runs(garbled), _runs(clean)
    if len(a) != len(b):
        return []
    parts = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if not parts:
        return []
    out = [f"{r} read as {w}" for w, r in PAIRS if all((e := _encode(x, w)) is not None and _decode(e, r) == y for x, y in parts)]
    if not out:
        strange = bool(regex.search(r"\p{Ll}\p{Lu}\p{Ll}", garbled)) and not regex.search(r"\p{Ll}\p{Lu}\p{Ll}", clean)  # a capital within a word
        out = [f"{x}\x00{y}" for x, y in parts if x and (strange or regex.search(r"[\p{S}\p{Cc}\p{Cn}\p{Co}]", x)) and regex.fullmatch(r"[\p{L}\p{M}]+", y)]
    return out


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, row_id, value of all records whose text isn't null or empty, each id once."""
    parts = [("form_fields", "field_id", "value"), ("signatures", "sig_id", "declared_name"), ("bookmarks", "bookmark_id", "title")]
    out = None
    for name, key, column in parts:
        d = one_per_id(table(spark, sf_dir, name), key, column).where(F.length(column) > 0)
        d = d.select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), F.col(column).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


def _feature_counts(chunks: DataFrame) -> DataFrame:
    """feature, n: in how many records' chunks each feature stands."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for chunk, n in zip(pdf["chunk"], pdf["n"], strict=True):
                for f in set(chunk_features(chunk)):
                    c[f] += n
            yield pd.DataFrame({"feature": list(c), "n": list(c.values())})

    return chunks.mapInPandas(work, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def learned_ways(chunks: DataFrame, tried: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """way, votes: transformations with at least min_votes distinct chunks that a twin explains; a run is a way of its own ("garbled NUL clean")."""
    stripped = F.regexp_replace("chunk", r"[^\x01-\x7e]", "")
    d = chunks.withColumn("bare", stripped).where(F.length(F.regexp_replace("bare", "[^A-Za-z]", "")) >= 2)
    # one twin per group: its most frequent chunk; groups of any size are folded before they are shuffled
    twin = d.groupBy("bare").agg(F.max_by("chunk", F.struct("n", "chunk")).alias("twin"), F.max("n").alias("most"))
    pairs = d.where((F.col("chunk") != F.col("bare")) & ~F.col("chunk").contains("�")).join(twin, "bare").where((F.col("chunk") != F.col("twin")) & (F.col("most") > F.col("n")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for g, t in zip(pdf["chunk"], pdf["twin"], strict=True):
                c.update(set(votes(g, t)))
            yield pd.DataFrame({"way": list(c), "n": list(c.values())})

    aligned = pairs.select("chunk", "twin").mapInPandas(work, "way string, n bigint")
    clean = chunks.where(F.col("n") >= MIN_VOTES).select(F.col("chunk").alias("restored"), F.col("n").alias("seen"))
    turned = tried.where(F.size("ways") > 0).join(clean, "restored").join(chunks.select("chunk", "n"), "chunk").where(F.col("seen") > F.col("n"))
    turned = turned.select(F.explode("ways").alias("way"), F.lit(1).cast("bigint").alias("n"))
    return aligned.unionByName(turned).groupBy("way").agg(F.sum("n").alias("votes")).where(F.col("votes") >= min_votes)


def chunks_of(values: DataFrame) -> DataFrame:
    """chunk, n: the chunks of all values, with how many values' places hold them."""
    chunks = values.groupBy("value").agg(F.count(F.lit(1)).alias("m")).select(F.explode(F.split("value", " ")).alias("chunk"), "m")
    return cut_lineage(chunks.where(F.length("chunk") > 0).groupBy("chunk").agg(F.sum("m").alias("n")))


def spaced_values(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """value, unspaced: values of 16-bit units whose zero bytes became blanks, so that every second character is one, where most of the words that this leaves are clean chunks."""
    spaced = values.where(F.col("value").rlike(r"^(?:[^ ] |  ){3,}[^ ]?$|^(?: [^ ]|  ){3,}$")).select("value").distinct()
    text = F.when(F.col("value").rlike(r"^(?:[^ ] |  )+[^ ]?$"), F.regexp_replace("value", "(.) ", "$1")).otherwise(F.regexp_replace("value", " (.)", "$1"))
    spaced = spaced.withColumn("unspaced", text)
    words = spaced.select("value", "unspaced", F.explode(F.split("unspaced", " ")).alias("chunk")).where(F.length("chunk") > 1)
    clean = chunks.where(F.col("n") >= MIN_VOTES).select("chunk", F.lit(1).alias("clean"))
    told = words.join(clean, "chunk", "left").groupBy("value", "unspaced").agg(F.avg(F.coalesce("clean", F.lit(0))).alias("known"))
    return told.where("known >= 0.5").select("value", "unspaced")


def garbled_chunks(values: DataFrame, chunks: DataFrame, learn=learned_ways) -> DataFrame:
    """chunk, restored, way of the chunks of values that were decoded wrongly."""
    counts = cut_lineage(_feature_counts(chunks))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk in pdf["chunk"]:
                rows.append((chunk, [], chunk))
                rows.extend((chunk, list(ways), t) for t, ways in readings(chunk))
            yield pd.DataFrame(rows, columns=["chunk", "ways", "restored"])

    odd = spread(chunks.where(F.col("chunk").rlike(ODD)).select("chunk"))
    tried = cut_lineage(odd.mapInPandas(work, "chunk string, ways array<string>, restored string"))
    # pairs of encodings are as many as are listed above; runs as many as twins of at least two chunks show
    learned = cut_lineage(learn(chunks, tried))
    codecs = tuple(r["way"] for r in learned.where(~F.col("way").contains("\x00")).select("way").collect())
    known = F.filter("ways", lambda w: w.isin("look-alikes", *codecs))
    told = tried.withColumn("way", F.when(F.size("ways") == 0, "").otherwise(F.get(known, F.lit(0)))).where(F.col("way").isNotNull()).select("chunk", "way", "restored")
    told = told.unionByName(_by_runs(odd, learned))
    return _judged(told, counts)


def _by_runs(odd: DataFrame, learned: DataFrame) -> DataFrame:
    """chunk, way, restored: chunks with runs that twins mapped; of several mappings of a run the one with the most votes."""
    runs = learned.where(F.col("way").contains("\x00")).select(F.split("way", "\x00").alias("p"), "votes").select(F.col("p")[0].alias("run"), F.col("p")[1].alias("to"), "votes")
    runs = runs.groupBy("run").agg(F.max_by("to", F.struct("votes", "to")).alias("to"))
    parts = odd.select("chunk", F.posexplode(F.split("chunk", r"(?<=[\x00-\x7f])(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])(?=[\x00-\x7f])")).alias("i", "run"))
    parts = parts.join(runs, "run", "left").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("to", "run").alias("t")))).alias("p"), F.count("to").alias("k"))
    return parts.where("k > 0").select("chunk", F.lit("learned runs").alias("way"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("restored"))


def _judged(told: DataFrame, counts: DataFrame) -> DataFrame:
    def made_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["features"] = [chunk_features(t) for t in pdf["restored"]]
            yield pdf

    made = told.mapInPandas(made_of, "chunk string, way string, restored string, features array<string>")
    asked = made.select("chunk", "way", "restored", F.explode_outer("features").alias("feature")).join(counts, "feature", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    # a restored chunk's features include nothing of the garbled ones, so that its counts are those of right text
    scored = asked.groupBy("chunk", "way", "restored").agg(F.avg(F.log2(n + 0.25)).alias("score"), F.avg(F.when(n >= 2, 1.0).otherwise(0.0)).alias("known"), F.avg(F.when(n >= 1, 1.0).otherwise(0.0)).alias("seen"))
    own = F.max(F.when(F.col("way") == "", F.col("score")))
    best = F.max_by(F.struct("restored", "way", "score", "known", "seen"), F.struct(F.when(F.col("way") != "", F.col("score")), F.col("restored")))
    judged = scored.groupBy("chunk").agg(own.alias("own"), best.alias("best"))
    gain = F.col("best.score") - F.col("own")
    utf8 = F.col("best.way").startswith("utf-8")
    shifted = F.col("best.way").endswith(" read as ascii")
    good = ~F.col("best.way").isin("", "look-alikes") & F.when(utf8, (gain > -0.5) | (F.col("best.known") >= 0.5)).when(shifted, (gain > -0.5) & (F.col("best.seen") >= 0.6)).otherwise((gain > 1.5) & (F.col("best.known") >= 0.6))
    return judged.where(good).select("chunk", F.col("best.restored").alias("restored"), F.col("best.way").alias("way"))


def find_garbled(values: DataFrame, learn=learned_ways) -> DataFrame:
    """source_table, row_id, value, restored, recovered of the wrongly decoded values; restored is null where nothing could be restored."""
    values = cut_lineage(values)
    chunks = chunks_of(values)
    bad = garbled_chunks(values, chunks, learn)
    apart = spaced_values(values, chunks).join(values, "value").select("source_table", "row_id", F.col("value").alias("u"), "unspaced")
    sure = values.where(F.col("value").rlike("[\\x00�\\x80-\\x84\\x86-\\x9f]|^(þÿ|ÿþ|ï»¿)|[\\s\\d.](þÿ|ÿþ)"))
    mark = F.pandas_udf(lambda s: s.map(lambda v: restore_marked(v) if v is not None else None), "string")
    sure = sure.select("source_table", "row_id", "value", mark("value").alias("marked"))
    odd = values.where(F.col("value").rlike(ODD)).select("source_table", "row_id", "value", F.posexplode(F.split("value", " ")).alias("i", "chunk"))
    # only odd chunks can be bad, so that no others are moved; a value is put together from its own chunks and the restored ones by their places
    hits = odd.where(F.col("chunk").rlike(ODD)).join(bad, "chunk")
    hits = hits.groupBy("source_table", "row_id").agg(F.any_value("value").alias("v"), F.map_from_entries(F.collect_list(F.struct("i", "restored"))).alias("at"), F.max("way").alias("way"))
    whole = F.array_join(F.transform(F.split("v", " "), lambda chunk, i: F.coalesce(F.try_element_at("at", i), chunk)), " ")
    hits = hits.select("source_table", "row_id", "v", whole.alias("joined"), "way")
    rest = F.pandas_udf(lambda v, way: pd.Series([unshift(x, y.removesuffix(" read as ascii")) for x, y in zip(v, way, strict=True)], dtype=object), "string")
    hits = hits.withColumn("joined", F.when(F.col("way").endswith(" read as ascii"), F.coalesce(rest("v", "way"), "joined")).otherwise(F.col("joined")))
    both = sure.join(hits, ["source_table", "row_id"], "full").join(apart, ["source_table", "row_id"], "full")
    lost = F.coalesce("value", "v").contains("�")
    text = F.when(lost, None).otherwise(F.coalesce("marked", "joined", "unspaced"))
    return both.select("source_table", "row_id", F.coalesce("value", "v", "u").alias("value"), text.alias("restored"), text.isNotNull().alias("recovered"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(text_values(spark, sf_dir)).select("source_table", "row_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(text_values(spark, sf_dir))
