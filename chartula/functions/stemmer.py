"""The published Porter2 (Snowball English) stemming algorithm, written from its description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
#: The algorithm's exceptional forms, endings and letters.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(w: str, start: int) -> int:
    m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$", w))


@lru_cache(200_000)
def stem_word(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2 or not w.isascii():
        return w
    w = w.lstrip("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(rf"(?:^|(?<=[{VOWELS}]))y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].+s$", w):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    m = re.search(r"(?:eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(?:ingly|edly|ing|ed)$", w)) and re.search(f"[{VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, to in STEP2.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w.endswith("logi"):
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    for end, to in STEP3.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[:-3].endswith(("s", "t")):
            w = w[:-3]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
