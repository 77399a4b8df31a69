"""Column functions on text and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accent folding; lower case only.
FOLD_ACUTE = ("áéíóú", "aeiou")
FOLD_WIDE = ("áäâàãéëèêẽíïĩìîóõöòôúüùûũ", "aaaaaeeeeeiiiiiooooouuuuu")
FOLD_FULL = (FOLD_WIDE[0] + "ñ", FOLD_WIDE[1] + "n")

_NOT_WORD = r"[^\p{L}\p{N}_]"
_CONSONANT = "bcdfghj-np-tvxz"
NUMBER = r"^[0-9]+$|[0-9]-?[0-9]{8}$|^[0-9]+[.|,][0-9]+$"
MAIL_OR_URL = (
    r"^(?:[A-Za-z]+:/+[A-Za-z0-9_.\-]+\.[A-Za-z0-9_./\-]+[^https:]"
    r"|[A-Za-z0-9_.\-]+@[A-Za-z]+(?:\.[A-Za-z]+)+|www\.[a-z0-9]+(?:\.[a-z]{2,4}){1,4})"
)
ABBREVIATION = "|".join(
    [
        rf"(?:^|{_NOT_WORD})[a-zA-Z](?:\.[a-zA-Z])+(?:$|{_NOT_WORD})",
        rf"[A-Z][{_CONSONANT}]+\.",
        rf"(?:^|{_NOT_WORD})[A-Z]{{2,5}}(?:$|{_NOT_WORD})",
        rf"(?:^|{_NOT_WORD})[{_CONSONANT}]{{2,4}}\.",
        rf"[A-Z][aeiou][{_CONSONANT}]\.",
        rf"(?:^|{_NOT_WORD})[a-zA-Z]{{1,2}}(?:\.[a-zA-Z]{{1,2}})+(?:$|{_NOT_WORD})",
    ]
)
DATE = r"^(?:[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{1,4}|[0-9]{2,4}[/.\-][0-9]{1,2}[/.\-][0-9]{1,2})$"
DATE_PREFIX = r"^[0-9]+[/.\-][0-9]+[/.\-][0-9]+"
PROPER_NAME = r"[^\p{L}\p{N}_]((?:[A-Z](?:[a-z]+|\.+))+(?:\s[A-Z][a-z]+)+)"
PROPER_NAME_PLAIN = r"((?:[A-Z](?:[a-z]+|\.+))+(?:\s[A-Z][a-z]+)+)"
#: Not where a text or sentence begins, as any word is in capitals there.
PROPER_NAME_INSIDE = r"(?<!\A)(?<!\.\s)[A-Z][a-z]+(?: *[A-Z][a-z]+)*[^.]"
INNER_NUMBER = r"[+\-]?(?:[0-9]+[,\-]?)*[0-9](?:[.][0-9]+)?"
QUERY_WORD = r"[a-zA-Z]{5,20}"


def fold(c, table=FOLD_FULL) -> Column:
    return F.translate(c, *table)


def normalize(c, table=FOLD_ACUTE) -> Column:
    return fold(F.lower(c), table)


def remove_punctuation(c) -> Column:
    """Only letters and numbers stay."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def remove_punctuation_keep_spaces(c) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")


def clean_special(c) -> Column:
    """For numbers, mails, URLs and dates. Hyphens go, so 2021-12-09 becomes 20211209."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s/@.:-?&|]", "")


def words(c) -> Column:
    return F.split(F.trim(c), r"\s+")


def is_number(c) -> Column:
    return F.col(c).rlike(NUMBER) if isinstance(c, str) else c.rlike(NUMBER)


def _like(c, pattern: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(pattern)


def is_mail_or_url(c) -> Column:
    return _like(c, MAIL_OR_URL)


def is_abbreviation(c) -> Column:
    return _like(c, ABBREVIATION)


def is_date(c) -> Column:
    return _like(c, DATE)


def has_date_prefix(c) -> Column:
    return _like(c, DATE_PREFIX)


def only_letters(c) -> Column:
    return _like(c, "^[a-z]+$")


def has_numbers(c) -> Column:
    return _like(c, "[0-9]")


def inner_numbers(c) -> Column:
    """All signed, grouped or decimal numbers inside a token."""
    return F.regexp_extract_all(c, F.lit(INNER_NUMBER), F.lit(0))


def proper_names(c, pattern: str = PROPER_NAME) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def proper_names_inside(c, stop_words: list[str], low: int = 3, high: int = 25) -> Column:
    """Names that don't begin a text or sentence, without stop words and by length."""
    found = F.transform(F.regexp_extract_all(c, F.lit(PROPER_NAME_INSIDE), F.lit(0)), lambda x: F.trim(x))
    return F.filter(found, lambda x: ~F.lower(x).isin(stop_words) & F.length(x).between(low, high))


def without_proper_names(c, pattern: str = PROPER_NAME_PLAIN) -> Column:
    return F.regexp_replace(c, pattern, "")


def kind(c) -> Column:
    """number, mail_url, abbreviation, date or plain; the first that fits."""
    return (
        F.when(is_number(c), "number")
        .when(is_mail_or_url(c), "mail_url")
        .when(is_abbreviation(c), "abbreviation")
        .when(is_date(c), "date")
        .otherwise("plain")
    )


def letters(c) -> Column:
    """The single letters a-z of a text."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), ""), lambda x: x != "")


def bigrams(c) -> Column:
    """Pairs of neighbours among letters and white space whose first is not a space."""
    chars = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""), ""), lambda x: x != "")
    return F.filter(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)), lambda p: p.isNotNull() & ~p.startswith(" "))


def language_name(c) -> Column:
    names = {"en": "English", "it": "Italian", "fr": "French"}
    out = F.when(F.lit(False), F.lit(None))
    for code, name in names.items():
        out = out.when(F.col(c) == code, name)
    return out.otherwise(F.col(c))


# URLs


def base_url(c) -> Column:
    """Adds http:// where there is no http prefix, and a closing slash."""
    u = F.col(c)
    u = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.when(u.endswith("/"), u).otherwise(F.concat(u, F.lit("/")))


def link_target(page, link) -> Column:
    """A relative link is the page's base URL plus the link; the fragment goes."""
    l = F.trim(F.col(link))
    return F.substring_index(F.when(l.startswith("http"), l).otherwise(F.concat(base_url(page), l)), "#", 1)


def resolved_target(page, link) -> Column:
    """A relative link within the page's host, as browsers resolve a rooted path; the fragment goes."""
    l = F.trim(F.col(link))
    host = F.regexp_extract(page, "^([A-Za-z]+://[^/?#]+)", 1)
    full = F.when(l.startswith("http"), l).when(l.startswith("/"), F.concat(host, l)).otherwise(F.concat(host, F.lit("/"), l))
    return F.substring_index(full, "#", 1)


def url_parts(c) -> Column:
    """protocol, host and path; null without ``://``."""
    m = lambda g: F.regexp_extract(c, "^([^:]*)://([^/]*)(.*)$", g)
    return F.when(F.col(c).contains("://"), F.struct(m(1).alias("protocol"), m(2).alias("host"), m(3).alias("path")))


def slashes(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.length(col) - F.length(F.replace(col, F.lit("/"), F.lit("")))


def is_dynamic(c) -> Column:
    return _like(c, "[?=&%]")


def hrefs(c) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1)), lambda x: F.trim(x) != "")
