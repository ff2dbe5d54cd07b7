"""Text functions, Column to Column; native expressions all."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_folds: dict[str, tuple[str, str]] = {}


def _fold(form: str) -> tuple[str, str]:
    """The characters whose decomposition is one base character and marks, and those base characters."""
    if form not in _folds:
        a, b = [], []
        for i in range(0x80, min(0xFFFF, sys.maxunicode)):
            ch = chr(i)
            base = "".join(x for x in unicodedata.normalize(form, ch) if not unicodedata.combining(x) and unicodedata.category(x) != "Mn")
            if base != ch and len(base) == 1:
                a.append(ch)
                b.append(base)
        _folds[form] = ("".join(a), "".join(b))
    return _folds[form]


def once(x: Column, f) -> Column:
    """f(x), with x worked out once: a column that stands in an expression several times is worked out each time."""
    return F.transform(F.array(x), f)[0]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def unaccented(text: Column, form: str = "NFD", lower: bool = False) -> Column:
    """Without accents (and in lower case): precomposed characters become their base, free marks go. Only words that are
    not ASCII are gone through by character; no change of case looks beyond a space."""
    case = F.lower if lower else lambda x: x

    def plain(x):
        return F.regexp_replace(F.translate(case(x), *_fold(form)), r"\p{Mn}", "")

    def words(x):
        return F.array_join(F.transform(F.split(x, " "), lambda w: F.when(is_ascii(w), case(w)).otherwise(plain(w))), " ")

    return once(text, lambda x: F.when(is_ascii(x), case(x)).otherwise(words(x)))


def squeezed(text: Column) -> Column:
    """Each run of white space as one space; single spaces are not touched."""
    return F.regexp_replace(text, r" [\s\x85\p{Z}]+|[\s\x85\p{Z}&&[^ ]][\s\x85\p{Z}]*", " ")


def lexicon_form(text: Column, exclusions: tuple[str, ...] = ()) -> Column:
    """Lower case, no accents, white space squeezed (not trimmed); then each exclusion becomes a space, as it stands."""
    out = squeezed(unaccented(text, lower=True))
    for p in exclusions:
        out = F.regexp_replace(out, p, " ")
    return out


def line_form(line: Column) -> Column:
    """Lower case, compatibility forms without marks, white space squeezed and trimmed."""
    return F.btrim(squeezed(unaccented(line, "NFKD", lower=True)), F.lit(" "))


def plain_form(text: Column) -> Column:
    """Only a-z, 0-9 and single spaces."""
    return F.btrim(F.regexp_replace(line_form(text), r"[^a-z0-9]+", " "), F.lit(" "))


def model_form(text: Column, letters: str = "a-zàèéìòóù") -> Column:
    """For topic models: lower case, no links, only the given letters and single spaces."""
    out = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " ")
    out = F.regexp_replace(out, rf"[^{letters}\s]", " ")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" "))


def excerpt_form(text: Column, letters: str = "a-zàèéìòóù0-9") -> Column:
    out = F.regexp_replace(F.lower(text), rf"[^{letters} ]+", " ")
    return F.btrim(F.regexp_replace(out, r" +", " "), F.lit(" "))


def excerpt(text: Column, n: int = 500) -> Column:
    """The first n characters after white space is squeezed."""
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ")), 1, n)


def lines(text: Column, least: int = 3) -> Column:
    """The trimmed lines of a text that have `least` characters or more."""
    parts = F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")), lambda x: F.length(x) >= least)


def paragraphs(text: Column, least: int = 200) -> Column:
    """Parts between blank lines, or before a line that begins with a capital or a digit; trimmed, `least` characters or more."""
    parts = F.split(text, r"\n\s*\n|\n(?=[A-ZÀ-Ù0-9])")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)


def fingerprint(text: Column) -> Column:
    """sha1 of the normalised text."""
    return F.sha1(F.encode(line_form(text), "UTF-8"))


#: What UTF-8 read as ISO-8859-1 leaves of accented letters, of dashes and quotes, and of signs.
MOJIBAKE = "Ã[\u0080-\u00bf]|â€[\u0080-\u009f]|Â[\u00a0-\u00bf]"


def mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def repaired(text: Column) -> Column:
    """UTF-8 read as Latin-1, undone; the text as it was where that fails or the signature stays."""
    narrow = mojibake(text) & text.rlike(r"(?s)^[\x00-\xFF]*$")
    raw = F.when(narrow, F.encode(F.when(narrow, text), "ISO-8859-1"))
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(fixed.isNotNull() & ~mojibake(fixed), fixed).otherwise(text)


def unescaped(text: Column) -> Column:
    """The basic entities, the ampersand last."""
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def untagged(html: Column) -> Column:
    """Tags become spaces, entities characters, white space single spaces."""
    return F.btrim(F.regexp_replace(unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"\s+", " "), F.lit(" "))


def act_title(title: Column, most: int = 120, least: int = 20) -> Column:
    """A bill's title: untagged, without a leading list of proponents (up to `most` characters before a colon, if
    `least` characters remain), without quotation marks and a trailing number in brackets."""
    t = untagged(title)
    rest = F.regexp_extract(t, rf"(?s)^.{{1,{most}}}?: (.*)$", 1)
    t = F.when(t.rlike(r"^[^:\"]{1,%d}: " % most) & (F.length(rest) >= least), rest).otherwise(t)
    t = F.regexp_replace(t, r"[\"“”«»]", "")
    return F.btrim(F.regexp_replace(t, r"\s*\(\d+\)\s*\.?\s*$", ""), F.lit(" "))


def group_name(name: Column) -> Column:
    """Without a trailing date or interval in brackets."""
    return F.btrim(F.regexp_replace(name, r"\s*\(?\d{1,2}[./]\d{1,2}[./]\d{4}(\s*-\s*(\d{1,2}[./]\d{1,2}[./]\d{4})?)?\)?\s*$", ""), F.lit(" "))


def iso_from_compact(d: Column) -> Column:
    """20221013… to 2022-10-13; anything else as it stands."""
    return F.when(d.rlike(r"^\d{8}"), F.regexp_replace(F.substring(d, 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(d)


def iso_from_dmy(d: Column) -> Column:
    """25/9/2022 00:00:00 to 2022-09-25; anything else as it stands."""
    part = lambda i: F.regexp_extract(d, r"^(\d{1,2})/(\d{1,2})/(\d{4})", i)
    return F.when(d.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise(d)


def decimal_comma(x: Column, digits: int = 1) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", x), F.lit("."), F.lit(","))


def institute(name: Column) -> Column:
    """An institute's name without its legal form and punctuation, in title case."""
    out = F.regexp_replace(name, r"(?i)\b(s\.?p\.?a\b\.?|s\.?r\.?l\b\.?|srls\b|societa\b)", "")
    return F.initcap(F.btrim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "), F.lit(" ")))


#: Frequent words by which a language is told.
STOP_WORDS = {"en": "the and of to in that is for with as", "fr": "le la les de des et que qui pour est", "de": "der die das und ist von mit den ein nicht", "es": "el los las que y del por una con para", "it": "il di che e per un del con sono della"}


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def language(text: Column, profiles: dict[str, str] = STOP_WORDS) -> Column:
    """The language whose frequent words are most of the text's, ties by order; `unknown` without any."""
    every = sorted({w for own in profiles.values() for w in own.split()})
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), _among(every))

    def best(own_words):
        return F.array_max(F.array(*[F.struct(F.size(F.filter(own_words, _among(own.split()))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, own) in enumerate(profiles.items())]))

    return once(once(words, best), lambda b: F.when(b["n"] > 0, b["k"]).otherwise("unknown"))


def non_latin(text: Column) -> Column:
    """Has a letter beyond ASCII that is not Latin; ª, º and modifier letters count as not Latin."""
    return text.rlike(r"[\p{L}&&[^\p{IsLatin}]]|[ªº]|\p{Lm}")
