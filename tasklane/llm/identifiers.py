"""Labelled samples that fit the secret scan's character models.

Both samples are made by rule from a seed, so they are the same on every
machine and their size is a stated parameter, whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np

# Words that names in code and configuration are made of.
WORDS = (
    "abstract account action adapter address agent alert api application "
    "array async auth backup base batch binary body bridge browser bucket "
    "buffer build builder button byte cache call case change channel check "
    "child class client cloud cluster code collection column command commit "
    "component config connect container content context control copy core "
    "counter create current customer data date debug default delete delivery "
    "deploy device dialog directory document domain download driver dynamic "
    "edge element email enable encode engine entity entry environment error "
    "event exchange execute export factory feature fetch field file filter "
    "format frame function gateway generate global graph group handler hash "
    "header health host http image import index info input instance interface "
    "internal invoice item job json key language layer library limit link "
    "list load local log login machine manager map master memory message "
    "method metric mock model module monitor name network node notification "
    "number object offset operation option order output package page "
    "parameter parser partition path payload permission platform policy pool "
    "port price process product profile project property provider proxy"
).split()
ACRONYMS = ("API", "CSS", "DNS", "HTML", "HTTP", "ID", "IO", "JSON", "SQL",
            "SSL", "TCP", "UI", "URL", "UTF", "UUID", "XML")
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ALPHABETS = {
    "base62": LOWER + LOWER.upper() + DIGITS,
    "base64": LOWER + LOWER.upper() + DIGITS + "+/",
    "base64url": LOWER + LOWER.upper() + DIGITS + "-_",
    "base32": LOWER.upper() + "234567",
    "base36": LOWER + DIGITS,
    "hex": "0123456789ABCDEF"}


def identifier(rng: np.random.Generator, words) -> str:
    """A name of two to five words in one of the usual styles."""
    own = [str(w) for w in rng.choice(words, rng.integers(2, 6))]
    if rng.random() < 0.25:
        own[rng.integers(len(own))] = str(rng.choice(ACRONYMS))
    style = rng.integers(6)
    if rng.random() < 0.2:
        own.append(("v", "")[style in (0, 1)] + str(rng.integers(1, 100)))
    cap = [w if w.isupper() else w.capitalize() for w in own]
    if style == 0:
        return own[0].lower() + "".join(cap[1:])
    if style == 1:
        return "".join(cap)
    low = [w.lower() for w in own]
    return ("_".join(low), "-".join(low), "_".join(own).upper(),
            "".join(low))[style - 2]


def random_string(rng: np.random.Generator, alphabet: str, lo: int = 20,
                  hi: int = 64) -> str:
    return "".join(rng.choice(list(alphabet), rng.integers(lo, hi + 1)))


def samples(per_alphabet: int, names: int, seed: int = 606
            ) -> tuple[list[str], list[str]]:
    """Random strings of every alphabet, and ordinary names."""
    rng = np.random.default_rng(seed)
    strings = [random_string(rng, a) for a in ALPHABETS.values()
               for _ in range(per_alphabet)]
    return strings, [identifier(rng, WORDS) for _ in range(names)]
