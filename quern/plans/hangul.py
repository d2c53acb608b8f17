"""Latin letters typed for Hangul on a two-set keyboard, as syllables; for queries only."""

from __future__ import annotations

import re

# Leads, vowels and tails in the order of syllable numbers, by the keys that type them.
LEADS = "r R s e E f a q Q t T d w W c z x v g".split()
VOWELS = "k o i O j p u P h hk ho hl y n nj np nl b m ml l".split()
TAILS = " r R rt s sw sg e f fr fa fq ft fx fv fg a q qt t T d w c z x v g".split(" ")

_V = "|".join(sorted(VOWELS, key=len, reverse=True))
_T = "|".join(sorted(filter(None, TAILS), key=len, reverse=True))
#: A tail is one only where no vowel follows it.
_SYLLABLE = re.compile(f"({'|'.join(LEADS)})({_V})(?:({_T})(?![koiOjpuPhynbml]))?")


def _keys(text: str) -> str:
    """Capitals that type nothing of their own are the small letters."""
    return "".join(c if c in "RETQWOP" else c.lower() for c in text)


def typed(text: str) -> str:
    """Syllables for all keys that form some; other characters stay."""
    return _SYLLABLE.sub(lambda m: chr(0xAC00 + (LEADS.index(m[1]) * 21 + VOWELS.index(m[2])) * 28 + TAILS.index(m[3] or "")), _keys(text))


def natural(text: str) -> bool:
    """Whether Latin letters look like a word: four at least, a fifth of them vowels."""
    letters = re.findall("[A-Za-z]", text)
    return len(letters) >= 4 and sum(c in "aeiouAEIOU" for c in letters) >= 0.2 * len(letters)


def conversion(text: str) -> str:
    """What a query may have been meant as, or ''."""
    if not re.search("[A-Za-z]", text) or re.search("[가-힣]", text) or natural(text):
        return ""
    out = typed(text)
    return out if re.search("[가-힣]", out) and not re.search("[A-Za-z]", out) else ""
