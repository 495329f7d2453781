"""Language of documents and of their segments (problem 9).

Two steps per sentence: its family first (by script, and by a linear machine between the families
of Latin script), then one-versus-one linear support vector machines between the languages of the
family. The machines see hashed n-grams of characters, hashed words and counts of classes (function words of a
language, letters of its own, kinds of ideographs and kana), so that they also tell sentences which
are unlike all of the sample. Sentences are chained by the cheapest path, so that headings, list marks
and separators, which are hardly evidence, follow the text around them.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families by script, and the names under which labels know each language.
FAMILIES = {"han": ["ja", "zh"], "cyrillic": ["ru"], "romance": ["es", "fr", "pt"], "germanic": ["de", "en"]}
NAMES = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 zhongwen", "en": "en eng english", "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский", "ja": "ja jpn japanese 日本語 nihongo",
}
# Common function words of the languages of Latin script (those in one list only count), and letters that tell them apart.
FUNCTION_WORDS = {
    "en": "the of and to is for you with are be this we that have will from by at your it they our not was has can would their must what does here how been more than",
    "de": "der die das und zu ist für sie mit auf sind wir von den dem ein eine einen im wird werden oder bei nicht sich als nach ihre zum zur aus auch durch hier",
    "fr": "le les des et est pour vous avec sur du nous au une dans qui en il ou ce sa aux ne pas votre être sont cette leur par plus",
    "es": "el los las y con del un una lo al o su fue está son nuestro nuestra muy usted hay cuando donde pero también ser esta",
    "pt": "os uma com da dos das na no nos nas ao à não é mais seu sua ou foi são pelo você muito quando nossa nosso também isso tem",
}
LETTERS = {"de": "äöüß", "fr": "èêëîïôœùûç", "es": "ñ¿¡áíóú", "pt": "ãõâêôçáà"}
LANGUAGES = [x for xs in FAMILIES.values() for x in xs]
CODE_OF = {n: code for code, names in NAMES.items() for n in names.split()}

#: Bounds of the labelled sample that the machines are fitted to: documents, sentences a language.
SAMPLE_DOCS, SAMPLE_SENTENCES = 2500, 1000
BITS, ORDER, ROUNDS, COST = 16, 3, 60, 1e-4
#: Classes follow the hashed n-grams among the features; an occurrence of one weighs as much as so many n-grams.
CLASSES = ["none", *(f"word {x}" for x in FUNCTION_WORDS), *(f"letter {x}" for x in LETTERS), "hiragana", "katakana", "simplified", "japanese", "traditional"]
CLASS_WEIGHT = 3
DIMENSIONS = (1 << BITS) + len(CLASSES)
#: Price of a change of language between sentences, and the scale of evidence, in nats.
SWITCH, SCALE = 2.5, 4.0
#: Sentences whose evidence a task keeps, for speed only.
KNOWN = 50_000
#: Weight of the evidence of a caption, and the most of a line without a closing mark.
CAPTION, LINE = 0.02, 0.6

_LETTER = regex.compile(r"\p{L}")
_NOISE = regex.compile(r"<\|[^|>]*\|>|\[(?i:pad|unk|cls|sep|mask)\]|https?://\S+|\S+@\S+")
_END = regex.compile(r"[\r\n\u2028\u2029]+|[.!?…]+[\"'»”’)\]]*(?=\s|$)|[。！？．]+[」』”’）]*|\s/\s")
_ENDED = regex.compile(r"[.!?。！？…．][\"'»”’)\]」』）]*\s*(?:/\s*)?$")
_HAN = regex.compile(r"\p{Han}")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}ー]")
_HAN_KANA = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_LATIN = regex.compile(r"\p{Latin}")
_DIGITS = re.compile(r"\d+")
_NAME = regex.compile(
    r"(?<=[\s\p{Han}\p{Hiragana}\p{Katakana}])\p{Lu}\p{Latin}*|\p{Lu}\p{Latin}*(?=[\p{Han}\p{Hiragana}\p{Katakana}])"
)
_MARKS = re.compile(r"^\W*(?:\(?\d+[.)、)]|[a-zA-Z][.)])?\W*")

#: The machines in the order of the weight columns: (name, languages for plus, languages for minus).
MACHINES = [("latin", FAMILIES["romance"], FAMILIES["germanic"])] + [
    (f"{a}-{b}", [a], [b]) for f in ("romance", "germanic", "han") for a, b in itertools.combinations(FAMILIES[f], 2)
]


def label_code(c: Column) -> Column:
    """The two-letter code a label names, else null. Case, blanks and a region or script behind the language do not matter."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    m = F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(m, t), F.try_element_at(m, F.regexp_extract(t, r"^([^-_ (;,.]+)", 1)))


def _standing(part: str) -> float:
    """How far a part without a closing mark is evidence: a caption is hardly any, a long line nearly as good as a sentence."""
    if part[-1] in ":：":
        return CAPTION
    letters = len(_LETTER.findall(part)) + 3 * len(_HAN_KANA.findall(part))
    return min(max((letters - 34) / 20, CAPTION), LINE)


def units(text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the parts of a text that hold letters. Sentences weigh 1, lines without a closing mark less."""
    out, at = [], 0
    noisy = _may_hold_noise(text)
    for a, z in itertools.chain((m.span() for m in _END.finditer(text)), [(len(text), len(text))]):
        part = text[at:z]
        if noisy:
            part = _NOISE.sub(" ", part)
        if _LETTER.search(part):
            part = part.strip()
            out.append((at, z, 1.0 if _ENDED.search(part) else _standing(part)))
        at = z
    return out


def _may_hold_noise(s: str) -> bool:
    return "<" in s or "[" in s or "@" in s or "://" in s


def _cleaned(s: str) -> str:
    if _may_hold_noise(s):
        s = _NOISE.sub(" ", s)
    return _DIGITS.sub("0", s[_MARKS.match(s).end() :].lower()).strip()


def script(s: str) -> str:
    """han, cyrillic or latin: the script that carries a sentence; ideographs and kana weigh as the words they are."""
    han, kana = len(_HAN.findall(s)), len(_KANA.findall(s))
    cyrillic, latin = len(_CYRILLIC.findall(s)), len(_LATIN.findall(s))
    weights = {"han": 2.5 * (han + kana), "cyrillic": cyrillic, "latin": latin}
    return max(weights, key=lambda k: weights[k])


_NUMBER_OF = {c: i for i, c in enumerate(CLASSES)}
_WORD_CLASSES: dict[str, list[int]] = {}
for _x, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _WORD_CLASSES.setdefault(_w, []).append(_NUMBER_OF[f"word {_x}"])
_WORD_CLASSES = {w: xs for w, xs in _WORD_CLASSES.items() if len(xs) == 1}
_SPLIT = str.maketrans(dict.fromkeys(",;:.!?()[]\"'’«»„“”/-–", " "))


def _encodable(c: str, name: str) -> bool:
    try:
        return bool(c.encode(name))
    except UnicodeEncodeError:
        return False


@functools.cache
def char_classes(c: str) -> tuple[int, ...]:
    """The classes of a character. Ideographs are told by the national character sets that have them."""
    if "\u3040" <= c <= "\u309f":
        return (_NUMBER_OF["hiragana"],)
    if "\u30a0" <= c <= "\u30ff":
        return (_NUMBER_OF["katakana"],)
    if "\u3400" <= c <= "\u9fff":
        zh, ja, old = (_encodable(c, x) for x in ("gb2312", "shift_jis", "big5"))
        kind = "simplified" if zh and not ja and not old else "japanese" if ja and not zh and not old else "traditional" if ja and old and not zh else None
        return () if kind is None else (_NUMBER_OF[kind],)
    return tuple(_NUMBER_OF[f"letter {x}"] for x, cs in LETTERS.items() if c in cs)


def classes(text: str) -> list[int]:
    """Features of the classes met in a cleaned text and of its hashed words, once per occurrence; "none" comes first, so that no list is empty."""
    out = [0]
    if not text.isascii():
        for c in text:
            if c > "\x7f":
                out += char_classes(c)
    words = text.translate(_SPLIT).split()
    for w in words:
        out += _WORD_CLASSES.get(w, ())
    return [(1 << BITS) + x for x in out] + [zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - BITS) for w in words if len(w) < 20]


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(hashed n-grams or classes, where each text's begin) for every order and for classes, and norms; no n-gram crosses texts."""
    padded = [f" {t}   " for t in texts]
    size = np.fromiter(map(len, padded), int, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    owner = np.repeat(np.arange(len(padded)), size)
    grams, starts = [], []
    h = np.zeros(len(codes), "uint64")
    for k in range(1, ORDER + 1):
        n = len(codes) - k + 1
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :] + np.uint64(1)
        inside = owner[:n] == owner[k - 1 :]
        mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append((mixed >> np.uint64(64 - BITS)).astype("int64"))
        starts.append(np.cumsum(size - k + 1) - (size - k + 1))
    met = [np.repeat(np.array(classes(t)), CLASS_WEIGHT) for t in texts]
    grams.append(np.concatenate(met) if met else np.zeros(0, "int64"))
    starts.append(np.cumsum([0, *map(len, met)])[:-1])
    return grams, starts, np.sqrt(ORDER * size.astype(float))


def margins(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """texts x machines."""
    grams, starts, norm = features(texts)
    return sum(np.add.reduceat(weights[g], s, axis=0) for g, s in zip(grams, starts, strict=True)) / norm[:, None]


def _machine(g: np.ndarray, owner: np.ndarray, norm: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss (accelerated gradient descent)."""
    vals, n, dim = 1 / norm[owner], len(y), DIMENSIONS
    share = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    u = np.ones(n)
    for _ in range(8):
        u = np.bincount(owner, vals * np.bincount(g, vals * u[owner], dim)[g], n)
        top = float(np.linalg.norm(u))
        u /= top
    rate = n / (2.1 * float(share.max()) * top + COST * n)
    w = v = np.zeros(dim)
    t = 1.0
    for _ in range(ROUNDS):
        gap = -2 * share * y * np.maximum(0, 1 - y * np.bincount(owner, vals * v[g], n)) / n
        now = v - rate * (np.bincount(g, vals * gap[owner], dim) + COST * v)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = now + (t - 1) / nt * (now - w), now, nt
    return w


def fitted(labelled: dict[str, list[str]]) -> np.ndarray:
    """Weights of all machines, DIMENSIONS x machines; what the first fit contradicts is left out of the second."""
    texts = [t for x in LANGUAGES for t in labelled.get(x, [])]
    lang = np.array([x for x in LANGUAGES for _ in labelled.get(x, [])])
    out = np.zeros((DIMENSIONS, len(MACHINES)), "float32")
    if not texts:
        return out
    grams, starts, norm = features(texts)
    size = [np.diff(np.append(x, len(g))) for g, x in zip(grams, starts, strict=True)]
    owners = np.concatenate([np.repeat(np.arange(len(texts)), x) for x in size])
    g = np.concatenate(grams)
    for turn in range(2):
        before = margins(out, texts) if turn else None
        for i, (_, plus, minus) in enumerate(MACHINES):
            y = np.where(np.isin(lang, plus), 1.0, np.where(np.isin(lang, minus), -1.0, 0.0))
            if turn:
                y = np.where(y * before[:, i] < 0, 0.0, y)
            use = y != 0
            if (y > 0).any() and (y < 0).any():
                took = use[owners]
                out[:, i] = _machine(g[took], (np.cumsum(use) - 1)[owners[took]], norm[use], y[use])
    return out


def labelled_sample(docs: DataFrame, text: str, label: str) -> dict[str, list[str]]:
    """Different sentences by the language their documents are labelled with; a sample bounded by SAMPLE_DOCS and SAMPLE_SENTENCES.

    Documents of less than 20,000 characters are drawn by a hash of their text, copies once. Sentences that differ
    in numbers and capitalised names only are one, and the label that most of their documents bear
    is theirs, so single wrong labels carry no weight; the most frequent are taken first. A sentence in a script its label does not
    use is left out.
    """
    rows = docs.select(label_code(F.col(label)).alias("code"), F.col(text).cast("string").alias("t"))
    rows = rows.where("code is not null and t is not null and length(t) < 20000").withColumn("h", F.xxhash64("t"))
    # Copies of a text count once a label: the least hashes of different texts are drawn, below a bound
    # that four times as many texts as needed are expected to keep.
    different = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    bound = int(min(4 * SAMPLE_DOCS / max(different, 1), 1.0) * 2**32)
    drawn = rows.where(F.shiftrightunsigned("h", 32) <= F.lit(bound)).groupBy("h", "code").agg(F.min("t").alias("t")).orderBy("h", "code").limit(SAMPLE_DOCS)
    votes: dict[str, Counter] = {}
    told: dict[str, str] = {}
    for r in drawn.collect():
        for part in sorted({r["t"][a:z] for a, z, _ in units(r["t"])}):
            sign = _cleaned(_NAME.sub("X", part))
            votes.setdefault(sign, Counter())[r["code"]] += 1
            told.setdefault(sign, part)
    out: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    scripts = {x: {"romance": "latin", "germanic": "latin"}.get(f, f) for f, xs in FAMILIES.items() for x in xs}
    for sign, of in sorted(votes.items(), key=lambda kv: (-kv[1].total(), kv[0])):
        (code, n), *_ = sorted(of.items(), key=lambda kv: (-kv[1], kv[0]))
        s = _cleaned(told[sign])
        if 2 * n > of.total() and len(out[code]) < SAMPLE_SENTENCES and len(s) > 3 and script(s) == scripts[code]:
            out[code].append(s)
    return out


def _evidence(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """texts x languages: log of the probability of each language."""
    m = SCALE * margins(weights, texts)
    out = np.full((len(texts), len(LANGUAGES)), -12.0)
    index = {x: i for i, x in enumerate(LANGUAGES)}
    column = {name: i for i, (name, _, _) in enumerate(MACHINES)}
    scripts = np.array([script(t) for t in texts])

    def coupled(family: str) -> np.ndarray:
        xs = FAMILIES[family]
        if len(xs) == 1:
            return np.zeros((len(texts), 1))
        votes = np.zeros((len(texts), len(xs)))
        for a, b in itertools.combinations(range(len(xs)), 2):
            d = m[:, column[f"{xs[a]}-{xs[b]}"]]
            votes[:, a] += d * 2 / len(xs)
            votes[:, b] -= d * 2 / len(xs)
        return votes - np.log(np.exp(votes - votes.max(1, keepdims=True)).sum(1, keepdims=True)) - votes.max(1, keepdims=True)

    for family in FAMILIES:
        got = coupled(family)
        if family in ("romance", "germanic"):
            d = m[:, 0] if family == "romance" else -m[:, 0]
            here, prior = scripts == "latin", -np.logaddexp(0, -2 * d)
        else:
            here, prior = scripts == family, np.zeros(len(texts))
        for j, x in enumerate(FAMILIES[family]):
            out[here, index[x]] = np.maximum(prior + got[:, j], -12.0)[here]
    kana = np.array([len(_KANA.findall(t)) for t in texts])
    # Ideographs alone: those that simplified Chinese has not tell against it, many without any for it.
    han = np.array([len(_HAN.findall(t)) for t in texts])
    other = np.array([sum(_NUMBER_OF["japanese"] in char_classes(c) or _NUMBER_OF["traditional"] in char_classes(c) for c in _HAN.findall(t)) for t in texts])
    out[(scripts == "han") & ((kana >= 2) | (other >= 2)), index["ja"]] += 2
    out[(scripts == "han") & (kana == 0) & (other == 0) & (han >= 6), index["zh"]] += 2
    return out


def _path(e: np.ndarray) -> np.ndarray:
    """The language of each unit on the best path; a change costs SWITCH, a draw keeps the language before."""
    n, k = e.shape
    tops = e.argmax(1)
    if (tops == tops[0]).all():
        return tops
    best, back = e[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        top = int(best.argmax())
        moved = best[top] - SWITCH
        stay = best >= moved
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, moved) + e[i]
    out = np.empty(n, int)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _segment(weights: np.ndarray, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        evidence = np.zeros((0, len(LANGUAGES)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                texts = part.column(1).to_pylist()
                cut = [units(t) if t else [] for t in texts]
                if len(known) > KNOWN:
                    known, evidence = {}, evidence[:0]
                at = [[known.setdefault(_cleaned(t[a:z]), len(known)) for a, z, _ in us] for t, us in zip(texts, cut, strict=True)]
                if len(known) > len(evidence):
                    evidence = np.concatenate([evidence, _evidence(weights, list(itertools.islice(known, len(evidence), None)))])
                rows: list[tuple] = []
                for i, us in enumerate(cut):
                    if not us:
                        continue
                    e = evidence[at[i]]
                    weight = np.array([x[2] for x in us])
                    e = e * (weight / weight.max())[:, None]
                    path = _path(e)
                    first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                    for no, (a, z) in enumerate(itertools.pairwise([*first, len(us)])):
                        total = e[a:z].sum(0)
                        p = np.exp(total - total.max())
                        rows.append((i, no + 1, LANGUAGES[path[a]], us[a][0], us[z - 1][1], float(p[path[a]] / p.sum())))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), part.column(2).take(pa.array(cols[0], pa.int64())),
                     *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))],
                    names=["key", "code", "seg_no", "seg_lang", "seg_start", "seg_end", "confidence"],
                )

    return run


def language_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``key``, ``label_code``, ``seg_no`` (from 1), ``seg_lang``, ``seg_start``, ``seg_end``, ``confidence``.

    One row per longest run of sentences in one language; null, empty and blank texts and texts
    without words give none. Texts are read whole. ``label_code`` is the language the label names, if
    any. Without usable labels the machines know nothing and only scripts decide.
    """
    weights = fitted(labelled_sample(docs, text, label))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(weights)
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), label_code(F.col(label)).alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segment(shared.value)(batches)

    kind = dict(own.dtypes)["key"]
    out = own.mapInArrow(run, f"key {kind}, code string, seg_no bigint, seg_lang string, seg_start bigint, seg_end bigint, confidence double")
    return out.select(F.col("key").alias(key), F.col("code").alias("label_code"), "seg_no", "seg_lang", "seg_start", "seg_end", "confidence")


def mislabelled(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``seg_no``, ``seg_lang`` of the documents whose label is missing, names no language or not theirs, or that mix languages."""
    own = segments.groupBy(key).agg(
        F.first("label_code", ignorenulls=True).alias("label"), F.array_sort(F.collect_list(F.struct("seg_no", "seg_lang"))).alias("x")
    )
    wrong = F.col("label").isNull() | (F.size("x") > 1) | (F.col("x")[0]["seg_lang"] != F.col("label"))
    return own.where(wrong).select(key, F.explode("x").alias("x")).select(key, "x.seg_no", "x.seg_lang")
