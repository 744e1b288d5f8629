"""The English (Porter2) stemmer, written from the published description of the algorithm."""

from __future__ import annotations

import re

_V = "aeiouy"
# Words with stems of their own.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
# The suffixes of steps 2, 3 and 4.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_LONGEST2 = sorted([*_STEP2, "ogi", "li"], key=len, reverse=True)
_LONGEST3 = sorted([*_STEP3, "ative"], key=len, reverse=True)
_R = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        m = _R.search(w)
        r1 = m.end() if m else len(w)
    m = _R.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V and w[-1] not in "wxY"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _WHOLE:
        return _WHOLE[w]
    if not w.isascii() and not any(c in _V for c in w):
        return w
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):  # step 0
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):  # step 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):  # step 1b
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _V for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _DOUBLE.search(w):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:  # step 1c
        w = w[:-1] + "i"
    for s in _LONGEST2:  # step 2
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif s == "li":
                    w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + _STEP2[s]
            break
    for s in _LONGEST3:  # step 3
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    for s in _STEP4:  # step 4
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):  # step 5
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")
