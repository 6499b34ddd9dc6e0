"""Scalar text functions as Column expressions, and exact folding as pandas UDFs.

Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# LaTeX accent commands and the combining marks they stand for.
ACCENTS = {
    "'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "v": "\u030c",
    "c": "\u0327", "H": "\u030b", "u": "\u0306", ".": "\u0307", "=": "\u0304",
}
# LaTeX letters; dotless i and j stand for the plain letters.
LETTERS = {
    r"\ss": "ß", r"\o": "ø", r"\O": "Ø", r"\aa": "å", r"\AA": "Å", r"\ae": "æ", r"\AE": "Æ",
    r"\l": "ł", r"\L": "Ł", r"\i": "i", r"\j": "j",
}
# Typographic quotes, dashes and ties, and their plain forms.
PLAIN_FROM = "’‘ʼ`´\u2010\u2011\u2012\u2013\u2014\u2212~\u00a0"
PLAIN_TO = "'''''------  "
# BibTeX's marks of an abbreviated author list.
ET_AL = ("others", "et al")
# Words that mark an author as an organisation.
ORGANISATION_WORDS = (
    "university universite universitat univ institute institut eth epfl laboratory laboratoire lab "
    "inc ltd llc gmbh corporation corp company center centre school department dept faculty "
    "consortium foundation association society team group agency ministry council committee press"
).split()
# Words that end a clause, and words that belong to no phrase.
CLAUSE_WORDS = (
    "until unless while when where because so then supports support succeeds succeed fails fail produces produce "
    "yields yield requires require allows allow enables enable combines combine addresses address validates validate "
    "repairs repair generates generate uses use using given based such both each than into over under after before "
    "during without within across via"
).split()
STOP_WORDS = (
    "a an the our we this that these those of for and or to in on with by from is are be it its as at which paper "
    "present presents presented propose proposes proposed introduce introduces introduced contribute contribution "
    "contributions study novel new approach method conclusion conclusions abstract introduction discussion section "
    "work works show shows shown demonstrate demonstrates"
).split()
# Number words and suffixes.
MAGNITUDES = {"k": 10**3, "thousand": 10**3, "m": 10**6, "million": 10**6, "b": 10**9, "billion": 10**9}


def _latin() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a plain letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _latin()
# Fixed value: anything but a-z, 0-9 and spaces. The same class negated, [^a-z0-9 ], takes Java's matcher twenty times as long.
NOT_KEY = r"[\x00-\x1f!-/:-`{-\x{10ffff}]+"
# Fixed value: what NOT_KEY names, and spaces.
_BETWEEN_WORDS = r"[\x00-/:-`{-\x{10ffff}]+"
_COMMAND = re.compile("\\\\([" + re.escape("".join(ACCENTS)) + "])\\s*\\{?([A-Za-z])\\}?")


def decode_latex(text: str) -> str:
    """LaTeX letters and accents as composed characters, braces dropped. Nested groups settle in repeated passes."""
    for command, letter in LETTERS.items():
        text = text.replace(command, letter)
    while (after := _COMMAND.sub(lambda m: unicodedata.normalize("NFC", m[2] + ACCENTS[m[1]]), text)) != text:
        text = after
    return text.translate({ord("{"): None, ord("}"): None})


def fold_text(text: str) -> str:
    """Plain lower-case form of a string: LaTeX, HTML entities, typographic marks and accents resolved."""
    text = html.unescape(decode_latex(text)).translate(str.maketrans(PLAIN_FROM, PLAIN_TO))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.casefold().strip()


@F.pandas_udf(T.StringType())
def latex_to_unicode(s: pd.Series) -> pd.Series:
    return s.map(decode_latex, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """fold_text() for any script."""
    return s.map(fold_text, na_action="ignore")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bare(col: Column) -> Column:
    """fold() before the ends are trimmed."""
    marked = F.translate(col, _MARKED + PLAIN_FROM, _BARE + PLAIN_TO)
    return F.replace(F.lower(F.regexp_replace(marked, r"\p{M}+", "")), F.lit("ß"), F.lit("ss"))


def fold(col: Column | str) -> Column:
    """fold_text() by built-in functions, exact for Latin letters without LaTeX and HTML markup."""
    return F.trim(F.regexp_replace(_bare(_c(col)), r"^\s+|\s+$", ""))


def norm_title(col: Column | str, folded: bool = False) -> Column:
    """The identity key of titles: folded, anything but a-z, 0-9 and spaces dropped. folded: col has been folded."""
    f = _c(col)
    if not folded:
        # in ASCII folding changes but capitals and characters that no key has
        f = F.when(F.octet_length(f) == F.char_length(f), F.lower(f)).otherwise(_bare(f))
    return F.trim(F.regexp_replace(f, _BETWEEN_WORDS, " "))


def beyond(a: Column | str, b: Column | str) -> Column:
    """What the longer of two strings has after the other, where it begins with it and that has an ASCII letter or digit; else null.

    norm_title() of both then differs where that of the rest isn't empty: folding goes
    character by character, and a letter or digit more is one that the other key lacks.
    """
    a, b = _c(a), _c(b)
    rest = lambda x, y: F.when(F.startswith(x, y) & y.rlike("[A-Za-z0-9]"), F.substr(x, F.char_length(y) + 1))
    return F.coalesce(rest(a, b), rest(b, a))


def split_authors(col: Column | str) -> Column:
    parts = F.split(F.trim(_c(col)), r"\s+and\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), ",+$", "")), lambda p: p != "")


def strip_homonym_number(col: Column | str) -> Column:
    """A name without the four digits by which an index tells homonyms apart."""
    return F.trim(F.regexp_replace(_c(col), r"\s+\d{4}$", ""))


def family_key(col: Column | str) -> Column:
    """Last folded word of the family part, of `Last, First` and `First Last` alike."""
    name = strip_homonym_number(col)
    part = F.when(F.contains(name, F.lit(",")), F.split_part(name, F.lit(","), F.lit(1))).otherwise(name)
    return F.element_at(F.split(fold(part), r"\s+"), -1)


def given_initial(col: Column | str) -> Column:
    """First letter of the given part, folded; empty without one."""
    name = strip_homonym_number(col)
    words = F.split(name, r"\s+")
    before = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    given = F.when(F.contains(name, F.lit(",")), F.regexp_extract(name, r"^[^,]*,(.*)$", 1)).otherwise(before)
    return F.regexp_extract(fold(given), r"\p{L}", 0)


def is_et_al(col: Column | str) -> Column:
    return F.coalesce(F.btrim(fold(col), F.lit(" .")), F.lit("")).isin(*ET_AL)


def is_latin(col: Column | str) -> Column:
    return F.coalesce(fold(col), F.lit("")).rlike("[a-z]")


def looks_like_organisation(col: Column | str) -> Column:
    words = F.split(F.translate(F.coalesce(fold(col), F.lit("")), ",", " "), r"\s+")
    return F.arrays_overlap(words, F.array(*map(F.lit, ORGANISATION_WORDS)))


def demath(col: Column | str) -> Column:
    """Math delimiters and spacing commands dropped, so that the numbers inside read as text."""
    c = F.regexp_replace(_c(col), r"\\[,;:! ]|~", " ")
    c = F.regexp_replace(F.replace(c, F.lit("{,}"), F.lit(",")), r"\$|\\\(|\\\)", "")
    return F.regexp_replace(c, r"\\times", "x")


def strip_comments(col: Column | str) -> Column:
    """Text without what follows an unescaped % on its line."""
    return F.regexp_replace(_c(col), r"(?m)(?<!\\)%.*$", "")


def arxiv_id_from_doi(col: Column | str) -> Column:
    """Null unless the DOI is that of an arXiv deposit."""
    return F.nullif(F.regexp_extract(_c(col), r"(?i)10\.48550/arxiv\.(\d{4}\.\d{4,5})", 1), F.lit(""))


def arxiv_id_of(*cols: Column | str) -> Column:
    """The first arXiv id in the fields, in their order."""
    found = [F.nullif(F.regexp_extract(_c(c), r"(\d{4}\.\d{4,5})", 1), F.lit("")) for c in cols]
    return F.coalesce(*found)


def page_range(col: Column | str) -> Column:
    """Runs of hyphens and dashes as one hyphen; null gives an empty text."""
    return F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), "[-–—]+", "-")


def usable_volume(col: Column | str) -> Column:
    """Null for an empty volume and for an index's abs/... placeholder."""
    c = _c(col)
    return F.when((c != "") & ~c.startswith("abs/"), c)


def parse_count(col: Column | str) -> Column:
    """10^5, 1,000, 60 million and 6.4M as bigint, truncated towards zero; null if the text is no count."""
    s = F.replace(F.lower(F.trim(_c(col))), F.lit("{,}"), F.lit(","))
    number = r"\d[\d,.]*"
    units = "|".join(MAGNITUDES)
    power = rf"^(\d+)\s*\^\s*\{{?(\d+)\}}?$"
    scaled = rf"^({number})\s*({units})\.?$"
    size = F.coalesce(*[F.when(F.regexp_extract(s, scaled, 2) == u, F.lit(float(m))) for u, m in MAGNITUDES.items()])

    def real(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit("")).try_cast("double")

    value = (
        F.when(s.rlike(power), F.pow(F.regexp_extract(s, power, 1).try_cast("double"), F.regexp_extract(s, power, 2).try_cast("double")))
        .when(s.rlike(scaled), real(F.regexp_extract(s, scaled, 1)) * size)
        .when(s.rlike(r"^[+-]?[\d,.]*\d[\d,.]*(e[+-]?\d+)?$"), real(s))
    )
    return value.try_cast("bigint")


def format_count(col: Column | str) -> Column:
    """6400000 as 6.4M: six significant digits with B, M or K from a thousand on; empty for null."""
    n = _c(col).cast("double")

    def scaled(size: float, suffix: str) -> Column:
        v = n / size
        digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(v)).cast("int"))
        shown = F.coalesce(*[F.when(digits == k, F.format_string(f"%.{k}f", v)) for k in range(6)], F.format_string("%.0f", v))
        trimmed = F.when(F.contains(shown, F.lit(".")), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
        return F.concat(trimmed, F.lit(suffix))

    out = F.when(n >= 1e9, scaled(1e9, "B")).when(n >= 1e6, scaled(1e6, "M")).when(n >= 1e3, scaled(1e3, "K"))
    return F.coalesce(out.otherwise(_c(col).cast("string")), F.lit(""))


def drop_markup(col: Column | str) -> Column:
    """LaTeX without its commands; sectioning and environments become sentence ends."""
    c = F.regexp_replace(_c(col), r"\\(?:sub)*(?:section|paragraph|chapter)\*?\s*(?:\[[^\]]*\])?\s*\{[^}]*\}", ". ")
    c = F.regexp_replace(c, r"\\(?:label|ref|cref|autoref|cite[a-zA-Z]*)\s*(?:\[[^\]]*\])*\{[^}]*\}", " ")
    c = F.regexp_replace(c, r"\\(?:begin|end)\{[^}]*\}", ". ")
    return F.translate(F.regexp_replace(c, r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?", " "), "{}", "  ")


def strip_labels(col: Column | str) -> Column:
    """Text without label commands, with a line that holds nothing else."""
    c = F.regexp_replace(_c(col), r"(?m)^[ \t]*\\label\{[^}]*\}[ \t]*\n", "")
    return F.regexp_replace(c, r"\\label\{[^}]*\}", "")


def content_hash(*cols: Column | str) -> Column:
    """A hash of the fields that white space doesn't change; null counts as empty."""
    parts = [F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " ")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def slug(col: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_c(col), "[^A-Za-z0-9]+", "-"), F.lit("-"))


def step_number(col: Column | str) -> Column:
    """The number after /s in a step's id, or null."""
    return F.regexp_extract(_c(col), r"/s(\d+)$", 1).try_cast("int")


def table_cell(col: Column | str, most: int | None = None) -> Column:
    """Text for a Markdown table: pipes escaped, newlines as spaces, at most so many characters; null as empty."""
    c = F.replace(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    return c if most is None else F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def sentences(col: Column | str) -> Column:
    """Sentences by end mark and white space."""
    return F.filter(F.transform(F.split(_c(col), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def is_markup(col: Column | str) -> Column:
    """Whether a sentence has more TeX symbols than max(4, length / 12); null and empty count as markup."""
    c = F.coalesce(_c(col), F.lit(""))
    symbols = F.length(c) - F.length(F.translate(c, "\\{}$&", ""))
    return (c == "") | (symbols > F.greatest(F.lit(4.0), F.length(c) / 12))


def phrases(col: Column | str, sizes: tuple[int, ...] = (4, 3, 2)) -> Column:
    """Word n-grams, longest first, that cross no stop word or clause word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit("[A-Za-z][A-Za-z-]+"), F.lit(0))
    marked = F.transform(words, lambda w: F.when(w.isin(*CLAUSE_WORDS, *STOP_WORDS), F.lit("|")).otherwise(w))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")

    def grams(n: int) -> Column:
        def of(run: Column) -> Column:
            own = F.split(run, " ")
            at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))

        return F.flatten(F.transform(runs, of))

    return F.concat(*[grams(n) for n in sizes])


def cited_keys(col: Column | str) -> Column:
    """Distinct keys of all cite-like commands, in order."""
    groups = F.regexp_extract_all(_c(col), F.lit(r"\\[a-zA-Z]*cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{([^}]*)\}"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))
