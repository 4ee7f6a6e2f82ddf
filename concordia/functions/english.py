"""English full-text terms: words with their positions, stop words left out, and stems by the published Porter2 rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can
    will just don should now""".split()
)
# Words that don't follow the rules, words that stay after step 1a, beginnings whose first region is what follows.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_DONE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_PREFIX = re.compile("gener|commun|arsen")
_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Endings of steps 2, 3 and 4, with what stands for them.
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_LI = frozenset("cdeghkmnrt")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _vowel(word: str) -> bool:
    return any(c in "aeiouy" for c in word)


def _short_syllable(word: str) -> bool:
    """Whether word ends with a vowel and a consonant other than w, x and Y after a consonant, or is a vowel and a consonant."""
    if len(word) == 2:
        return word[0] in "aeiouy" and word[1] not in "aeiouy"
    return len(word) > 2 and word[-1] not in "aeiouywxY" and word[-2] in "aeiouy" and word[-3] not in "aeiouy"


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.removeprefix("'")
    # A y that begins the word or follows a vowel is a consonant, written Y until the end.
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    m = _PREFIX.match(w) or _REGION.match(w)
    r1 = m.end() if m else len(w)
    m = _REGION.match(w, r1)
    r2 = m.end() if m else len(w)

    e = _longest(w, ("'s'", "'s", "'"))
    w = w[: len(w) - len(e)] if e else w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _vowel(w[:-2]):
        w = w[:-1]
    if w in _DONE:
        return w.lower()

    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and _vowel(w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    e = _longest(w, (*_STEP2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in _LI else w
        else:
            w = w[: len(w) - len(e)] + _STEP2[e]
    e = _longest(w, (*_STEP3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: len(w) - len(e)] + _STEP3[e]
        elif len(w) - len(e) >= r2:
            w = w[: len(w) - len(e)]
    e = _longest(w, (*_STEP4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


_PLAIN = re.compile("[0-9a-z]+")
LEXEMES = ArrayType(StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


def _located(text: str | None, pattern: re.Pattern, term_of, known: dict[str, str | None]) -> list[tuple[str, list[int]]] | None:
    if text is None:
        return None
    out: dict[str, list[int]] = {}
    for at, word in enumerate(pattern.findall(text.lower()), 1):
        if word not in known:
            known[word] = term_of(word)
        term = known[word]
        if term is not None:
            out.setdefault(term, []).append(at)
    return sorted(out.items())


#: Characters of the texts that are located at a time: a position is four bytes in Arrow, but an object in Python.
PIECE = 1 << 20


def _pieces(texts) -> Iterator[list[str | None]]:
    """The texts of an Arrow array in lists of about PIECE characters, one text at least."""
    held, size = [], 0
    for x in texts:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= PIECE:
            yield held
            held, size = [], 0
    yield held


def _arrow(texts, one: Callable[[str | None], list | None]):
    """one() of every text of an Arrow array, as an Arrow array of LEXEMES, of which only a piece is ever held as objects."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
    return pa.concat_arrays([pa.array([one(x) for x in piece], kind) for piece in _pieces(texts)])


@F.arrow_udf(LEXEMES)
def _english(s: pa.Array) -> pa.Array:
    known: dict[str, str | None] = {}  # each distinct word of a batch is stemmed once
    return _arrow(s, lambda x: _located(x and x.replace("\u2019", "'"), _WORD, lambda w: None if w in STOP_WORDS else stem(w), known))


@F.arrow_udf(LEXEMES)
def _simple(s: pa.Array) -> pa.Array:
    known: dict[str, str | None] = {}
    return _arrow(s, lambda x: _located(x, _PLAIN, lambda w: w, known))


def lexemes(c: Column) -> Column:
    """Sorted stems of a text with their positions; positions count all words, stop words too, from 1. Null stays null.

    Words are runs of letters and digits of any script, with inner apostrophes; they are lower-cased, stop words are
    left out and every other word is stemmed. Texts of any length are read whole, and no position is left out.
    """
    return _english(c)


def words(c: Column) -> Column:
    """The same without stop words and stems: sorted lower-case words of ASCII letters and digits with their positions."""
    return _simple(c)
