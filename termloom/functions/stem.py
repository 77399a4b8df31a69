"""Stemmers, from the published descriptions of the Porter, Lancaster (Paice-Husk) and Spanish Snowball algorithms.

They run over distinct terms only, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Porter


def _forms(w: str) -> str:
    """The word as v (vowel) and c (consonant) letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _forms(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _forms(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    w = w.lower()
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    cut = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _forms(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and "v" in _forms(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _forms(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Lancaster: reversed ending, * (intact only), letters to remove, letters to append, > (again) or . (stop)
_LANCASTER = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. "
    "ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. "
    "lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> "
    "nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. "
    "ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> "
    "ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()
_LANCASTER_RULES: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _r in _LANCASTER:
    _m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", _r)
    _LANCASTER_RULES.setdefault(_m[1][0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(w: str) -> str:
    w, intact = w.lower(), True
    while w:
        for end, only_intact, cut, new, again in _LANCASTER_RULES.get(w[-1], ()):
            if not w.endswith(end) or (only_intact and not intact):
                continue
            stem = w[: len(w) - cut]
            if w[0] in "aeiouy":
                fits = len(stem) >= 2
            else:
                fits = len(stem) >= 3 and any(c in "aeiouy" for c in stem)
            if not fits:
                continue
            w, intact = stem + new, False
            if not again:
                return w
            break
        else:
            return w
    return w


# Spanish Snowball

_V = "aeiouáéíóúü"
_ACUTE = str.maketrans("áéíóú", "aeiou")
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_SUFFIXES = [
    ("delete", "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()),
    ("ic", "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()),
    ("log", "logía logías".split()),
    ("u", "ución uciones".split()),
    ("ente", "encia encias".split()),
    ("amente", ["amente"]),
    ("mente", ["mente"]),
    ("idad", "idad idades".split()),
    ("iva", "iva ivo ivas ivos".split()),
]
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS_G = "en es éis emos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
    "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _regions(w: str) -> tuple[int, int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{_V}][^{_V}]").search(w, start)
        return m.end() if m else len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _V), len(w))
        elif w[0] in _V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _V), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _longest(w: str, ends, start: int) -> str:
    return max((e for e in ends if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


def spanish(w: str) -> str:
    w = w.lower()
    rv, r1, r2 = _regions(w)

    def drop(end: str, start: int) -> bool:
        nonlocal w
        if end and w.endswith(end) and len(w) - len(end) >= start:
            w = w[: len(w) - len(end)]
            return True
        return False

    pronoun = _longest(w, _PRONOUNS, rv)
    if pronoun:
        stem = w[: len(w) - len(pronoun)]
        accented = _longest(stem, "iéndo ándo ár ér ír".split(), rv)
        plain = _longest(stem, "ando iendo ar er ir".split(), rv)
        if accented:
            w = stem[: len(stem) - len(accented)] + accented.translate(_ACUTE)
        elif plain or (stem.endswith("uyendo") and len(stem) - 4 >= rv):
            w = stem
    before = w
    kind, end = "", ""
    for k, ends in _SUFFIXES:
        for e in ends:
            if w.endswith(e) and len(e) > len(end):
                kind, end = k, e
    if end:
        at = len(w) - len(end)
        if kind == "amente" and at >= r1:
            w = w[:at]
            if drop("iv", r2):
                drop("at", r2)
            else:
                drop("os", r2) or drop("ic", r2) or drop("ad", r2)
        elif kind != "amente" and at >= r2:
            w = w[:at]
            if kind == "ic":
                drop("ic", r2)
            elif kind == "log":
                w += "log"
            elif kind == "u":
                w += "u"
            elif kind == "ente":
                w += "ente"
            elif kind == "mente":
                drop("ante", r2) or drop("able", r2) or drop("ible", r2)
            elif kind == "idad":
                drop("abil", r2) or drop("ic", r2) or drop("iv", r2)
            elif kind == "iva":
                drop("at", r2)
    if w == before:
        y = _longest(w, _Y_VERBS, rv)
        if y and w[: len(w) - len(y)].endswith("u"):
            w = w[: len(w) - len(y)]
        else:
            v = _longest(w, _VERBS + _VERBS_G, rv)
            if v:
                w = w[: len(w) - len(v)]
                if v in _VERBS_G and w.endswith("gu"):
                    w = w[:-1]
    last = _longest(w, "os a o á í ó".split(), rv)
    if last:
        w = w[: len(w) - len(last)]
    else:
        last = _longest(w, ("e", "é"), rv)
        if last:
            w = w[:-1]
            if w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
    return w.translate(_ACUTE)


STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter, "lancaster": lancaster, "spanish": spanish}


def stems(terms: DataFrame, *names: str, column: str = "term") -> DataFrame:
    """The distinct terms with a column for each named stemmer."""
    out = terms.select(column).distinct()
    for name in names:
        stemmer = STEMMERS[name]

        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(stemmer, na_action="ignore")

        out = out.withColumn(name, run(column))
    return out
