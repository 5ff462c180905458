"""Sentence units of texts in any script, as places in the text.

Character properties (Sentence_Break: STerm, ATerm, Close, Sp, Lower, Upper, OLetter) decide as in the standard rules:
a terminator, its closing marks and the spaces after it end a unit unless what follows or precedes says otherwise.
On top of the rules: abbreviations of the languages that the paragraph is written in, ordinals, initials, ellipses,
quotation marks and brackets within a sentence (never split), the Greek question mark, list items, blank lines.

The languages of a paragraph are told by its script and its commonest words, those of the whole text where the paragraph
has none, then the text's label (which may be missing or wrong); with nothing to tell by, those of all languages count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .spread import spread

_NL = r"(?>\r\n|[\n\r\x0b\x0c\x85\u2028])"
_BLANK = regex.compile(rf"{_NL}[^\S\n\r\x0b\x0c\x85\u2028\u2029]*{_NL}\s*|\u2029\s*")
_LINE = regex.compile(_NL)
_MARKER = regex.compile(r"[^\S\n\r]*(?:(?P<bullet>[-–—*•‣▪◦·●○■])|\(?(?P<number>\d{1,3})[.)]|\(?(?P<letter>[^\W\d_])\))[^\S\n\r]+\S")
_TERM = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm};;…]+(?:[\p{SB=STerm}\p{SB=ATerm}…])*")
_MARKS = regex.compile(r"[\"“”„‟«»‹›‘’‚()\[\]{}（）［］「」『』【】〈〉《》〔〕｢｣]")
_CLOSERS = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "」": "「", "』": "『", "】": "【", "〉": "〈", "》": "《", "〕": "〔", "｣": "｢"}
_QUOTES = set("\"“”„‟«»‹›‘’‚「」『』｢｣")
#: Where a word begins, besides blanks.
_OPENING = frozenset("([{（「『【“”„«»‹›‘\"¿¡")
_LETTER = regex.compile(r"\p{L}")

#: Fixed values. Abbreviations that don't end a sentence, whatever follows, by language.
NEVER = {
    "en": "mr mrs ms dr prof capt lt col gen sgt rev hon st messrs mt ft vs viz approx cf e.g i.e eg ie dept ref para sect sec art fig figs app vol vols nos pp p ch ed eds excl incl resp jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri ca",
    "de": "hr hrn fr fa prof dr dipl ing lt geb gem betr bzgl nr nrn abs abb abschn anl anm art aufl bd bde bl bzw ca d.h z.b u.a i.d.r evtl ggf inkl exkl zzgl kap lfd s sog st str tel u v vgl z ziff vom",
    "fr": "m mm mme mlle mlles dr pr me st ste art av boul c.-à-d chap env ex fig figs janv févr avr juil sept oct nov déc p pp par réf vol cf tél no nos n",
    "es": "sr sra srta sres dr dra lic ing prof d dña ud uds vd art arts aprox cap ed fig figs núm núms pág págs p párr ref tel vol ej",
    "ru": "т.е т.к т.н т г-н г-жа ул д кв пр пл им гл изд ред рис стр с ст п пп прим прил ср см ок тыс млн млрд руб коп тел проф акад доц напр",
    "el": "κ κα κος κ.κ σ σελ σημ περ δηλ άρθρ αρθρ βλ παρ παράρτ π.χ αρ τ τόμ κεφ εικ βλέπε καθ δρ",
    "hi": "डॉ श्री सु प्रो पृ सं क्र",
    "ar": "د أ م ص ج ق هـ",
    "th": "ดร น พ ศ ค ม นาย อ ผศ รศ ศ พ.ศ ค.ศ",
}
#: Fixed values. Abbreviations that can end a sentence: they do where a capital or a letter without case follows.
MAYBE = {
    "en": "etc a.m p.m al jr inc ltd corp co bros u.s u.k u.n ff f",
    "de": "usw etc f ff co u.s.w o.ä",
    "fr": "etc cie al suiv",
    "es": "etc cía cia h s.a",
    "ru": "др г гг л в вв пр",
    "el": "κ.λπ κλπ κ.ά κ.α",
}
#: Fixed values. Of those in NEVER, the ones that stand before a number, a sign or a letter of a list; many are words too (art, app, p), and before other words they end a sentence.
NUMBERED = {
    "en": "ref para sect sec art fig figs app vol vols nos pp p ch ed eds dept fri sat sun mon may incl",
    "de": "abs abb abschn anl anm art aufl bd bde kap ziff str tel s nr nrn",
    "fr": "art chap fig figs p pp par réf vol nos n",
    "es": "art arts cap fig figs núm núms pág págs p párr ref vol ej ed",
}
#: Fixed values. Common words that tell languages of the Latin alphabet apart.
COMMON = {
    "en": "the of and to in is it that was for on with he she they this at by from are be not have has were which but his her you we my me i a an or as his its their then did".split(),
    "de": "der die das und ist nicht ein eine einer den dem des zu mit auf für von im am sich es er wir ich auch als bei nach wird wurde sind hat aus wie noch nur vor vom zum zur in dass kann sein liegt ohne".split(),
    "fr": "le la les des et est une un du en que qui dans pour pas sur au aux avec ce cette il elle nous vous je ne se sont par plus été ou son sa ses leur".split(),
    "es": "el la los las de y es una un en que por con para no se del al su sus lo como más fue está son o pero si ya este esta ha".split(),
}
_SCRIPTS = {"ru": r"\p{Cyrillic}", "el": r"\p{Greek}", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}", "th": r"\p{Thai}", "zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}]", "ko": r"\p{Hangul}"}
_SCRIPT = {k: regex.compile(v) for k, v in _SCRIPTS.items()}
_LATIN_WORD = regex.compile(r"\p{Latin}+")
_TELLS: dict[str, tuple[str, ...]] = {}
for _k, _words in COMMON.items():
    for _w in _words:
        _TELLS[_w] = (*_TELLS.get(_w, ()), _k)


class Rules:
    """The abbreviations of a set of languages."""

    def __init__(self, languages: frozenset[str]):
        pick = lambda table: frozenset(w for k in languages for w in table.get(k, "").split())
        self.never, self.maybe = pick(NEVER), pick(MAYBE)
        # a word before a number in one language that never ends a sentence in another one of the text does so in none
        self.numbered = pick(NUMBERED) - frozenset(w for k in languages for w in NEVER.get(k, "").split() if w not in NUMBERED.get(k, "").split())


@lru_cache(maxsize=1000)
def rules_of(languages: frozenset[str]) -> Rules:
    return Rules(languages)


_ALL = frozenset(NEVER)


def languages_of(text: str) -> tuple[frozenset[str], bool]:
    """Languages that a text is written in, as far as it shows: scripts by their letters, languages of the Latin alphabet by common words, all that have a third as many as the best; and whether at least two words, or no Latin letters at all, tell."""
    found = {k for k, v in _SCRIPT.items() if v.search(text)} if not text.isascii() else set()
    score: dict[str, float] = {}
    for w in _LATIN_WORD.findall(text):
        tells = _TELLS.get(w.lower(), ())
        for k in tells:
            score[k] = score.get(k, 0) + 1 / len(tells)
    best = max(score.values(), default=0)
    return frozenset(found | {k for k, n in score.items() if n >= best / 3}), best >= 2 or bool(found) and not _LATIN_WORD.search(text)


def _label(lang: str | None) -> frozenset[str]:
    short = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return frozenset([short]) & _ALL


_NOT_CASED = frozenset("KG Ltd Inc OHG GmbH AG LLC LLP SA".split())
_ORDINAL_BEFORE = frozenset("die der das dem den des am im zum zur vom bis ab seit jede jeder jedes jedem jeden dieser diese dieses diesem ein eine einer eines einem einen beim und ins".split())
_GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
_ANNEX = frozenset("annexe annex appendix anl anlage anhang прил приложение приложении anexo παράρτημα παράρτ part section group gruppe teil".split())
#: A name in small letters that can begin a sentence: iX, e-Mail, or a program's name before its version.
_SMALL_NAME = regex.compile(r"\p{Ll}+\p{Lu}|\p{Ll}-\p{Lu}|\p{Ll}+ \d+\.\d")
_GOES_ON = regex.compile("然后|随后|接着|并|而|就|便|地|的|と|って|라고|하고|고 |라며")


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(open, close) of the quotation marks and brackets of a block that have a partner; inner ones are left out."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []

    def close(openers: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in openers:
                found.append((stack[k][1], at))
                del stack[k:]
                return True
        return False

    for m in _MARKS.finditer(text, start, end):
        c, i = m[0], m.start()
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        if c in _CLOSERS:
            close(_CLOSERS[c], i)
        elif c == '"':
            if not ((before.isspace() or before in "([{“‘«—–-") and not after.isspace() and after not in ".,;:!?") and close('"', i):
                continue
            if not after.isspace():
                stack.append((c, i))
        elif c == "“":
            if not close("„‟", i):
                stack.append((c, i))
        elif c == "”":
            close("“„‟", i)
        elif c == "’":
            if not (before.isalnum() and after.isalnum()):
                close("‘‚", i)
        elif c == "‘":
            if not close("‚", i):
                stack.append((c, i))
        elif c in "»›":
            if not close("«" if c == "»" else "‹", i) and not after.isspace():
                stack.append((c, i))
        elif c in "«‹":
            if not close("»" if c == "«" else "›", i):
                stack.append((c, i))
        else:
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, k in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, k))
    return outer


def _word_before(text: str, at: int, start: int) -> str:
    k = at
    while k > start and not text[k - 1].isspace() and text[k - 1] not in _OPENING:
        k -= 1
    return text[k:at]


def _prior(text: str, at: int, start: int) -> str:
    """What stands before a blank before `at`, up to the blank before it; empty at the start."""
    k = at
    while k > start and text[k - 1].isspace():
        k -= 1
    j = k
    while j > start and not text[j - 1].isspace():
        j -= 1
    return text[j:k]


#: What a numbered abbreviation stands before: digits, capitals alone or with digits (B, III, KX-13), signs.
_NUMBERLIKE = regex.compile(r"[^\p{L}\s]|[\p{Lu}\d][\p{Lu}\d.-]*(?![\p{L}\d])")


def _ends(text: str, term: str, at: int, after: int, start: int, end: int, rules: Rules) -> bool:
    """Whether the terminators text[at:after] at top level end the unit that began at start."""
    if after >= end:
        return True
    nxt = text[after]
    spaced = nxt.isspace()
    k = after
    while k < end and text[k].isspace():
        k += 1
    if k >= end:
        return True
    follow = text[k]
    j = k
    while j < end and (text[j] in "\"“„«‹‘‚([{（「『¿¡*_—–-" or text[j].isspace()):
        j += 1
    first = text[j] if j < end else follow
    dots = term.replace("．", ".")
    if term[0] in ";;" and len(term) == 1:
        if not spaced:
            return False
        head = _LETTER.search(text, start, at)
        return bool(head) and ("Ͱ" <= head[0] <= "Ͽ" or "ἀ" <= head[0] <= "\u1fff")
    if "…" in term or ".." in dots:
        if any(c in "!?！？。" for c in term):
            return True
        return spaced and first.isupper()
    if any(c != "." and c != "．" and c not in "․﹒" for c in term):
        if spaced or ord(term[-1]) > 0x2FF:  # marks of scripts without spaces end a sentence at once
            return not (follow in "—–" and text[k + 1 : k + 2].isspace())
        return first.isupper() or (first.isalpha() and not first.islower() and ord(first) > 0x2FF)
    if term == "．":
        return True
    # a full stop
    word = _word_before(text, at, start)
    if not spaced:
        if follow in ",;:)]}»”’%" or follow.isdigit():
            return False
        low = word.lower()
        if low in rules.maybe and first.isupper() and text[j + 1 : j + 2].islower():
            return len(word) > 1 or bool(regex.search(r"\d\s$", text[max(start, at - len(word) - 2) : at - len(word)]))
        if low == "no" and first.isupper() and text[j + 1 : j + 2].islower():
            return text[start : at - len(word)].strip(" “„\"'(«¡¿") == ""
        if first.isupper():
            tail = text[j + 1] if j + 1 < end else " "
            solid = len(word) >= 2 and "." not in word and "_" not in word and "/" not in word and "\\" not in word and "@" not in word
            last = word[-1:]
            return (solid and (last.islower() or last in ")%»”" or word.isdigit()) and low not in rules.never and (tail.islower() or tail.isspace() or tail in ".'’" or tail.isupper() and word[:1].islower())) or (not word and tail.islower())
        if first.isalpha() and not first.islower():
            return bool(word) and word[-1].isalpha() and not word[-1].islower() and not word[-1].isupper() and low not in rules.never
        return False
    if follow in ",;:)]}%":
        return False
    low = word.lower().strip("-–")
    cased = first.isupper() or bool(_SMALL_NAME.match(text, j))
    caseless = first.isalpha() and not first.isupper() and not first.islower()
    if not word:
        return True
    if word.isdigit():
        prior = _prior(text, at - len(word), start)
        nextword = regex.match(r"\w*", text, pos=j)[0]
        if prior.strip("(„«“").lower() in _ORDINAL_BEFORE or nextword in _GERMAN_MONTHS:
            return False
        return True
    if low in ("no", "nº"):
        if text[start : at - len(word)].strip(" “„\"'(«¡¿") == "":
            return True
        return not first.isdigit() and (cased or caseless)
    if len(word) == 1 and word.isalpha():
        prior = _prior(text, at - 1, start)
        last = prior.lower().strip(".(’'")
        if word == "M" and prior == "d.":
            return cased or caseless
        if word.isupper():
            if last.split("'")[-1].split("’")[-1] in _ANNEX:
                return cased or caseless
            return False
        if word in "дп" and last == "т":
            return cased
        if word in "гл":
            return cased and last.isdigit()
        return low in rules.maybe and cased
    if low in rules.maybe:
        nextword = regex.match(r"\w*", text, pos=j)[0]
        return (cased or caseless or (first.isdigit() and low not in ("al", "f", "ff"))) and nextword not in _NOT_CASED
    if low in rules.numbered:
        return cased and not _NUMBERLIKE.match(text, k)
    if low in rules.never:
        return False
    if "." in low and regex.fullmatch(r"(?:\p{L}{1,3}\.-?)+\p{L}{1,3}", low):
        return cased and len(low) > 3 and low not in rules.never and not regex.fullmatch(r"(?:\p{L}\.)+\p{L}", low)
    if first.islower():
        # no abbreviation that is known: a word that goes on in small letters begins with a name such as iX or a version's name
        return cased or len(low) >= 3 or not low.isalpha()
    return True


def _closes(text: str, open_at: int, close_at: int, start: int, end: int) -> bool:
    """Whether a closed quotation or bracket, with a terminator before its end, ends the unit."""
    k = close_at - 1
    while k > open_at and text[k].isspace():
        k -= 1
    if not regex.match(r"[\p{SB=STerm}\p{SB=ATerm}…]", text[k]):
        return False
    k = close_at + 1
    while k < end and text[k].isspace():
        k += 1
    if k >= end:
        return True
    if text[k] in ",;:.!?—–-、，；：。！？)]}）" or regex.match(r"[\p{SB=STerm}\p{SB=ATerm}]", text[k]):
        return False
    j = k
    while j < end and text[j] in "\"“„«‹‘‚([{（「『¿¡":
        j += 1
    first = text[j] if j < end else text[k]
    if first.islower():
        return bool(_SMALL_NAME.match(text, j))
    head = text[start:open_at].rstrip()
    alone = head.strip("\"“„«‹‘‚([{（「『¿¡*_") == ""
    if text[open_at] not in _QUOTES:
        return alone
    opened = text[k] in "\"“„«‹‘‚「『"
    if head.endswith((":", "：")):
        return not _GOES_ON.match(text, k)
    if first.isupper() or first.isdigit() or opened:
        return True
    if alone or not first.isalpha():
        return False
    return False


def _block(text: str, start: int, end: int, out: list[tuple[int, int]], rules: Rules) -> None:
    def emit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    while start < end and text[start].isspace():
        start += 1
    if m := _MARKER.match(text, start, end):
        # a list: each line with a marker of the same kind begins an item, a number must follow the one before
        kind, number, begin = m.lastgroup, int(m["number"] or 0), start
        for line in _LINE.finditer(text, start, end):
            n = _MARKER.match(text, line.end(), end)
            if n and n.lastgroup == kind and (kind != "number" or int(n["number"]) in (number + 1, number)):
                emit(begin, line.start())
                begin, number = line.end(), int(n["number"] or 0)
        emit(begin, end)
        return
    pairs = _pairs(text, start, end)
    begin, p = start, 0

    def skip(i: int) -> int:
        while i < end and text[i].isspace():
            i += 1
        return i

    begin = skip(begin)
    events = sorted([(m.start(), 0, m) for m in _TERM.finditer(text, start, end)] + [(k, 1, (o, k)) for o, k in pairs], key=lambda e: e[:2])
    for at, kind, x in events:
        if at < begin:
            continue
        if kind:
            if _closes(text, x[0], x[1], begin, end):
                emit(begin, at + 1)
                begin = skip(at + 1)
            continue
        while p < len(pairs) and pairs[p][1] < at:
            p += 1
        if p < len(pairs) and pairs[p][0] < at:  # within quotation marks or brackets
            continue
        after = x.end()
        if p < len(pairs) and pairs[p][0] < after:
            continue
        while after < end and text[after] in "”’»›\"')]}）」』" and not any(o == after for o, _ in pairs[p : p + 1]):  # closing marks without partner
            after += 1
        if _ends(text, x[0], at, after, begin, end, rules):
            emit(begin, after)
            begin = skip(after)
    emit(begin, end)


def sentence_units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) in code points of each unit. Null, empty and blank texts have none. lang labels the text, and serves where the text itself doesn't tell its language."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    whole: frozenset[str] | None = None

    def block(a: int, b: int) -> None:
        nonlocal whole
        own, sure = languages_of(text[a:b])
        if not sure:
            if whole is None:
                found, told = languages_of(text)
                whole = found | _label(lang) if told else found | _label(lang) or _ALL
            own |= whole
        _block(text, a, b, out, rules_of(own))

    at = 0
    for m in _BLANK.finditer(text):
        block(at, m.start())
        at = m.end()
    block(at, len(text))
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, start_pos, end_pos: one row per sentence unit of each text of df. Rows are taken as they are; equal texts each give their own. A column `lang` is used if there is one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys: list = []
            a: list[int] = []
            b: list[int] = []
            for k, t, label in zip(pdf[key], pdf[text], pdf["_lang"], strict=True):
                for s, e in sentence_units(t, label):
                    keys.append(k)
                    a.append(s)
                    b.append(e)
            yield pd.DataFrame({key: keys, "start_pos": pd.Series(a, dtype="int32"), "end_pos": pd.Series(b, dtype="int32")})

    kind = df.schema[key].dataType.simpleString()
    label = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    return spread(df.where(F.col(text).isNotNull()).select(key, text, label.alias("_lang"))).mapInPandas(work, f"{key} {kind}, start_pos int, end_pos int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))
