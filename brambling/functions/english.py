"""English tokens: stop words left out, other words stemmed by the published Porter2 rules.

Words are split by the JVM; only the words of a batch go to Python, where each distinct word is
stemmed once for a worker's cache.  Positions count stop words, as a phrase needs.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# The usual stop words of English text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
# Fixed values of the published algorithm: words with stems of their own, and those left as they are.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less",
    "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    prefix = re.match("gener|commun|arsen", word)
    m = prefix or _REGION.search(word)
    first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, first: int) -> str:
    if ending := _ending(w, ("eed", "eedly")):
        return w[: -len(ending)] + "ee" if len(w) - len(ending) >= first else w
    ending = _ending(w, ("ed", "edly", "ing", "ingly"))
    if not ending or not _VOWEL.search(w[: -len(ending)]):
        return w
    w = w[: -len(ending)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _DOUBLE.search(w):
        return w[:-1]
    return w + "e" if len(w) <= first and _SHORT_END.search(w) else w


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of other alphabets and numbers stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _OWN:
        return _OWN[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    first, second = _regions(w)
    w = _plural(w)
    if w in _FINAL:
        return w
    w = _past(w, first)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    if (e := _ending(w, _STEP2)) and len(w) - len(e) >= first:
        before = w[: -len(e)]
        if e == "ogi":
            w = before + "og" if before.endswith("l") else w
        elif e == "li":
            w = before if before[-1:] in set("cdeghkmnrt") else w
        else:
            w = before + _STEP2[e]
    if (e := _ending(w, _STEP3)) and len(w) - len(e) >= (second if e == "ative" else first):
        w = w[: -len(e)] + _STEP3[e]
    if (e := _ending(w, _STEP4)) and len(w) - len(e) >= second and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    at = len(w) - 1
    if w.endswith("e") and (at >= second or at >= first and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and at >= second:
        w = w[:-1]
    return w.lower()


def vector(document: Column, weight: str = "D") -> Column:
    """The tokens of an English text: stems with positions, without stop words."""

    @F.pandas_udf("array<struct<lex:string,pos:int,w:string>>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for words in lists:
            out.append(None if words is None else [{"lex": stem(x), "pos": i, "w": weight} for i, x in enumerate(words, 1) if x not in STOP_WORDS])
        return pd.Series(out, dtype=object)

    return run(text.words(document))


def query(parsed: text.Query | str | None) -> text.Query | None:
    """A query whose words are stemmed; stop words drop out, and distances count them."""
    if isinstance(parsed, str):
        parsed = text.parse_query(parsed)
    if parsed is None:
        return None
    if isinstance(parsed, text.Term):
        return None if parsed.lexeme in STOP_WORDS else text.Term(stem(parsed.lexeme), parsed.prefix, parsed.weights)
    if isinstance(parsed, text.Not):
        part = query(parsed.part)
        return None if part is None else text.Not(part)
    left, right = query(parsed.left), query(parsed.right)
    if left is None or right is None:
        return right if left is None else left
    if isinstance(parsed, text.Phrase):
        return text.Phrase(left, right, parsed.distance + _dropped(parsed.left, last=True) + _dropped(parsed.right, last=False))
    return type(parsed)(left, right)


def _dropped(part: text.Query, last: bool) -> int:
    """Places of stop words at the end (or start) of a phrase's part."""
    if not isinstance(part, text.Phrase):
        return 0
    edge, rest = (part.right, part.left) if last else (part.left, part.right)
    return part.distance + _dropped(rest, last) if query(edge) is None else _dropped(edge, last)
