"""One form for text that looks the same (problem 2).

What is unstable follows from properties of the Unicode character data: characters that the
normalization quick check refuses or leaves open (combining marks, parts of syllables), blanks,
compatibility forms that differ in width, font or ligature only, and what is never seen. A JVM-side
quick check finds values that can hold anything unstable; only those reach Python. There each
unstable run is cut out with the character before it (its composition boundary), brought to its form
alone, and spliced back into the unchanged text. Letters of words that mix scripts come last.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (Unicode, EquivalentUnifiedIdeograph): the radicals of U+2E80..2EF3 without a
# compatibility decomposition, each before its ideograph.
RADICALS = (
    "⺁厂 ⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺇几 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺑尣 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗心 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 "
    "⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺳网 ⺴网 ⺵网 ⺶羊 ⺷羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉 "
    "⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阜 ⻖阝 ⻗雨 ⻘青 "
    "⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻞食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀"
)
# Fixed values (Unicode confusables): Cyrillic and Greek letters before the Latin letters they look like.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa сc ԁd еe һh іi јj оo рp ԛq ѕs ԝw хx уy ѵv ӏl"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa νv οo ρp ϲc ϳj ϹC ͿJ ɑa ɡg ıi"
ARMENIAN = "հh ոn ռn սu օo ցg զq ՍU ՕO ՏS ԼL"
CHEROKEE = "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏢP ᏙV ᏚS ᏞL ᏟC ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
# Katakana before the ideographs they look like, and the ideographs that one of them may follow as a counter.
KANA = "エ工 カ力 タ夕 ト卜 ニ二 ハ八 ロ口 ー一"
COUNTED = "一二三四五六七八九十百千数何半"
RADICAL_OF = {x[0]: x[1] for x in RADICALS.split()}
#: Small capitals are letters of their own, named after the letter they show.
SMALL_CAPITALS = {c: n[-1].lower() for c in map(chr, range(0x250, 0x2000)) if (n := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(n) == 28}
LATIN_OF = {x[0]: x[1] for x in " ".join((CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU)).split()} | SMALL_CAPITALS
IDEOGRAPH_OF = {x[0]: x[1] for x in KANA.split()}
KANA_OF = {x[1]: x[0] for x in KANA.split()}
#: Back to Cyrillic for words of that script.
CYRILLIC_OF = {x[1]: x[0] for x in CYRILLIC.split() if x[0] not in "ԌԚԜԁһԛѕԝѵӏЅІЈіј"}
#: Letters of Latin script that only look like the usual ones; the last only in words that mix scripts.
ALIKE_LATIN = "ɑɡ" + "".join(SMALL_CAPITALS)
ALIKE_LATIN_ONLY = ALIKE_LATIN + "ı"

#: Characters that are never seen, tab and line ends apart.
INVISIBLE = (
    "\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5"
    "\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
#: Kinds of compatibility decomposition that leave the look of a character.
_SAME_LOOK = ("wide", "narrow", "font", "small")
_SAME_NAMES = ("LATIN ", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL", "CJK RADICAL", "KANGXI RADICAL", "CJK COMPATIBILITY IDEOGRAPH")


@functools.cache
def _properties() -> tuple[frozenset[str], frozenset[str], frozenset[str], frozenset[str]]:
    """Characters that are never seen, blanks but U+0020, forms to fold, and all that is unstable: these, and what normalization changes or may join to the character before."""
    hidden = regex.compile(f"[{INVISIBLE}]")
    gone, blanks, folded, moved = set(), set(), set(), set()
    for p in (*range(0xD800), *range(0xF900, 0x30000), *range(0xE0000, 0xE1000)):
        c = chr(p)
        if hidden.match(c):
            gone.add(c)
        kind = unicodedata.category(c)
        if p < 0x80 or kind in ("Cn", "Co"):
            continue
        if kind == "Zs":
            blanks.add(c)
            continue
        rule = unicodedata.decomposition(c)
        tag = rule[1 : rule.find(">")] if rule.startswith("<") else ""
        name = unicodedata.name(c, "") if rule or p < 0x3000 else ""
        alike = tag in _SAME_LOOK or (tag == "compat" and ("LIGATURE" in name or "DIGRAPH" in name))
        if alike or (tag in ("", "compat") and name.startswith(_SAME_NAMES) and (tag or name.startswith("CJK"))):
            folded.add(c)
        syllable = 0x1100 <= p < 0x1200 or 0xA960 <= p < 0xA980 or 0xD7B0 <= p < 0xD800
        if kind[0] == "M" or unicodedata.combining(c) or syllable or not unicodedata.is_normalized("NFC", c):
            moved.add(c)
    return frozenset(gone), frozenset(blanks), frozenset(folded), frozenset(gone | blanks | folded | moved)


#: Runs of letters of the scripts that look alike, and a sign that one may be mixed.
_OTHER = r"\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}"
_MIXED = regex.compile(rf"[\p{{Latin}}{_OTHER}\p{{M}}]+")
_FOREIGN = regex.compile(rf"[{_OTHER}{ALIKE_LATIN}]")
_KATAKANA = "ァ-ヺーヽヾ"
#: A katakana among ideographs in a text without other kana; an ideograph among katakana.
_LONE_KANA = regex.compile(rf"(?<![{COUNTED}](?=カ))(?:(?<=\p{{Han}})|(?=.\p{{Han}}))[{''.join(IDEOGRAPH_OF)}](?![\p{{Hiragana}}{_KATAKANA}])")
_LONE_HAN = regex.compile(rf"(?<=[{_KATAKANA}])[{''.join(KANA_OF)}](?=[{_KATAKANA}])")
_KANA_RUN = regex.compile(rf"[\p{{Hiragana}}{_KATAKANA}]")
#: Finds text that may be unstable (Java syntax too): anything but characters known to stay, and neighbours that may be of a mixed word.
_STAYS = (
    r"\x09\x0A\x0D\x20-\x7E\xA1-\xA7\xA9\xAB\xB0\xB1\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F"
    r"\u0400-\u0482\u048A-\u04FF\u2010-\u2016\u2018-\u2023\u2026\u3001-\u3003\u3005-\u3011\u3041-\u3096\u30A1-\u30FE\u3400-\u4DBF\u4E00-\u9FFF"
)
#: A first sieve, which most values end at: nothing but ASCII, ideographs and the commonest marks.
_PLAIN = r"[^\x09\x0A\x0D\x20-\x7E\u3001\u3002\u3400-\u4DBF\u4E00-\u9FFF]"
_L, _C, _H = r"[A-Za-z\u00C0-\u024F]", r"[\u0400-\u04FF]", r"[\u3005\u3007\u3400-\u4DBF\u4E00-\u9FFF]"
_K, _I = "".join(IDEOGRAPH_OF), "".join(KANA_OF)
_QUICK = rf"[^{_STAYS}]|{_L}{_C}|{_C}{_L}|{_H}[{_K}]|[{_K}]{_H}|[\u30A1-\u30FE][{_I}]"


def _fold(segment: str) -> str:
    gone, blanks, folded, _ = _properties()
    out = []
    for c in segment:
        if c in gone:
            continue
        if c in blanks:
            c = " "
        elif c in folded:
            c = RADICAL_OF.get(c) or unicodedata.normalize("NFKC", c)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _spliced(s: str) -> str:
    """``s`` with each unstable run, and the character before it, brought to its form."""
    unstable = _properties()[3]
    out, at, i, n = [], 0, 0, len(s)
    for i in [i for i, c in enumerate(s) if c in unstable]:
        if i < at:
            continue
        end = i + 1
        while end < n and s[end] in unstable:
            end += 1
        start = i - 1 if i > at and not s[i - 1].isspace() else i
        out += (s[at:start], _fold(s[start:end]))
        at = end
    return "".join(out) + s[at:] if out else s


def _word(m) -> str:
    """A run of letters; accents are taken off first, as they may have joined a letter of the wrong script."""
    w = unicodedata.normalize("NFD", m.group())
    latin = regex.findall(r"\p{Latin}", w)
    foreign = regex.findall(rf"[{_OTHER}]", w)
    if not foreign:
        w = "".join(LATIN_OF.get(c, c) if c in ALIKE_LATIN else c for c in w)
    elif any(c not in ALIKE_LATIN_ONLY for c in latin):
        if all(c in LATIN_OF for c in foreign):
            w = "".join(c if c == "ı" else LATIN_OF.get(c, c) for c in w)
        elif all(c in CYRILLIC_OF for c in latin):
            w = "".join(CYRILLIC_OF.get(c, c) for c in w)
    return unicodedata.normalize("NFC", w)


def consistent(s: str | None) -> str | None:
    """The consistent form of a text; null stays null, empty stays empty; any length, in one pass.

    Applying it twice changes nothing more. Words wholly in another script, tabs, line breaks and
    repeated plain blanks stay.
    """
    if s is None or (s.isascii() and s.isprintable()):
        return s
    s = _spliced(s)
    s = _MIXED.sub(_word, s) if _FOREIGN.search(s) else s
    kana = _KANA_RUN.findall(s)
    if kana:
        if all(c in IDEOGRAPH_OF for c in kana):
            s = _LONE_KANA.sub(lambda m: IDEOGRAPH_OF[m.group()], s)
        s = _LONE_HAN.sub(lambda m: KANA_OF[m.group()], s)
    return s


@F.pandas_udf(T.StringType())
def _consistent(v: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    out = []
    for x in v:
        if x is not None and x not in seen:
            seen[x] = consistent(x)
        out.append(None if x is None else seen[x])
    return pd.Series(out, dtype=object)


def _doubtful(c: Column) -> Column:
    return c.rlike(_PLAIN) & c.rlike(_QUICK)


def consistent_form(c: Column) -> Column:
    """Column of consistent forms. Values that pass the quick check stay on the JVM side."""
    return F.coalesce(_consistent(F.when(_doubtful(c), c)), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _consistent_each(v: pd.Series) -> pd.Series:
    seen: dict[str, str | None] = {None: None}
    out = []
    for xs in v:
        for x in () if xs is None else xs:
            if x not in seen:
                seen[x] = consistent(x)
        out.append(None if xs is None else [seen[x] for x in xs])
    return pd.Series(out, dtype=object)


def consistent_forms(c: Column) -> Column:
    """As ``consistent_form``, for a column of arrays of texts."""
    return F.coalesce(_consistent_each(F.when(F.exists(c, _doubtful), c)), c)


def forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rec_id``, ``field_name``, ``value``, ``form``: each different stored non-null value of each record.

    Repeated rows count once, null values and keys give no row; only named columns are read.
    """
    own = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]
    long = df.select(F.col(key).alias("rec_id"), F.explode(F.array(*own)).alias("x")).select("rec_id", "x.*")
    return long.where("rec_id is not null and value is not null").withColumn("form", consistent_form(F.col("value")))


def changed(formed: DataFrame) -> DataFrame:
    """``rec_id``, ``field_name`` of the values that differ from their form, each once."""
    return formed.where("value <> form").select("rec_id", "field_name").distinct()
