"""Letters and blanks that look like others, or can't be seen."""

#: Letters of other alphabets that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮЗаеорсухѕіјһԁԛԝӏүԍѵ", "ABESIJKMHOPCTYXY3aeopcyxsijhdqwlygv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγικνορυχωηϲ", "ABEZHIKMNOPTYXCjayiκvopuxwnc", strict=True))
for _c in "ικЗ":
    CYRILLIC.pop(_c, None)
GREEK.pop("κ", None)
LATIN_LIKE = {"ɡ": "g", "ɑ": "a", "ⅼ": "l"}

#: Blanks other than the usual one, and characters that show nothing.
SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
HIDDEN = "\u00ad\u200b\u200e\u200f\u2060\u2061\u2062\u2063\u2064\u180e\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff"
