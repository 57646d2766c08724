"""An English stemmer by the published Porter (1980) steps, and a list of stop words."""

from __future__ import annotations

from functools import lru_cache

# English function words.
STOP_WORDS = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)
# Suffixes of steps 2, 3 and 4 with what replaces them.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, ch in enumerate(word):
        out.append(ch not in "aeiou" and not (ch == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem_: str) -> int:
    """Vowel runs followed by a consonant run."""
    c = _consonants(stem_)
    return sum(1 for a, b in zip(c, c[1:], strict=False) if not a and b)


def _vowel(stem_: str) -> bool:
    return not all(_consonants(stem_))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    c = _consonants(word)
    return len(word) > 2 and c[-3] and not c[-2] and c[-1] and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _step1(w: str) -> str:
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + by
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        suffix = _longest(w, ("ed", "ing"))
        if suffix and _vowel(w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
    return w[:-1] + "i" if w.endswith("y") and _vowel(w[:-1]) else w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    w = _step1(w)
    for table in (_STEP2, _STEP3):
        suffix = _longest(w, table)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    suffix = _longest(w, _STEP4)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w[:-1]) > 1 else w
