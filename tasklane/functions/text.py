"""Scalar text operators as Column expressions (JVM-side but for T8).

T1 width fold, T2 tab removal, T3 long-run squeeze, T4 bracket-emote squeeze,
T5 Latin-letter strip, T6 character split, T8 character replacement, T9 rule
lists. All but T8, a kernel on Arrow columns, stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklane.functions.naming import Lexicon

# Fixed values (width fold, must equal the reference's mapping):
# U+3000 IDEOGRAPHIC SPACE -> U+0020 SPACE, and U+FF01..U+FF5E -> U+0021..U+007E
# (code point minus 0xFEE0). Built from that rule; 95 characters each.
FULL_WIDTH = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = " " + "".join(chr(c) for c in range(0x21, 0x7F))

# Fixed value: CJK range used by the emote pattern, U+4E00..U+9FA5.
_CJK = "\\u4e00-\\u9fa5"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_width(col) -> Column:
    """Full-width -> half-width (letters and digits too)."""
    return F.translate(_c(col), FULL_WIDTH, HALF_WIDTH)


def to_full_width(col) -> Column:
    """Inverse of T1 (fixture builder)."""
    return F.translate(_c(col), HALF_WIDTH, FULL_WIDTH)


def remove_tabs(col) -> Column:
    """Delete tab characters."""
    return F.translate(_c(col), "\t", "")


def squeeze_runs(col, keep: int = 6) -> Column:
    """Every run of more than ``keep`` copies of one character -> ``keep``.

    ``(?d)`` makes ``.`` exclude only ``\\n`` (as in Python), so U+2028 and
    friends are squeezed too.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    return F.regexp_replace(_c(col), f"(?d)(.)\\1{{{keep},}}", "$1" * keep)


def squeeze_emotes(col, keep: int = 30, mode: str = "cap") -> Column:
    """T4: squeeze repeated bracket emotes such as ``[怒][怒]...``.

    ``cap``: keep the first ``keep`` copies of a repeated emote, drop the rest
    (idempotent; shorter repeats untouched).
    ``thin``: each ``[c][c][c][`` -> ``[c][`` (single-character emotes), so n
    copies become n - 2*floor(n/4); 58 copies -> 30.
    """
    if mode == "cap":
        if keep < 1:
            raise ValueError("keep must be >= 1")
        pat = f"((\\[[{_CJK}]+\\])\\2{{{keep - 1}}})\\2+"
        return F.regexp_replace(_c(col), pat, "$1")
    if mode == "thin":
        return F.regexp_replace(_c(col), f"(\\[[{_CJK}]\\])\\1\\1\\[", "$1[")
    raise ValueError(f"unknown emote mode {mode!r}")


def strip_latin(col, keep_tail: int = 0) -> Column:
    """T5: remove runs of ASCII letters; the last ``keep_tail`` characters are
    left as they are."""
    c = _c(col)
    if keep_tail <= 0:
        return F.regexp_replace(c, "[A-Za-z]+", "")
    n = F.char_length(c)
    cut = F.greatest(n - F.lit(keep_tail), F.lit(0))
    head = F.substring(c, F.lit(1), cut)
    tail = F.substring(c, cut + 1, F.lit(keep_tail))
    return F.concat(F.regexp_replace(head, "[A-Za-z]+", ""), tail)


def char_array(col) -> Column:
    """Trimmed text without spaces, split into code points."""
    s = F.replace(F.trim(_c(col)), F.lit(" "), F.lit(""))
    return F.filter(F.split(s, ""), lambda ch: ch != F.lit(""))


def replace_chars(col, lexicon: Mapping[str, str]) -> Column:
    """Each character found in ``lexicon`` becomes its description, in
    one vectorised pass over Arrow columns. The plan is the same for any lexicon; keys
    of more than one character match nothing; descriptions aren't searched
    again."""
    if not lexicon:
        return _c(col)
    names = Lexicon(lexicon)

    @F.arrow_udf("string")
    def named(texts: pa.Array) -> pa.Array:
        return names(texts)
    return named(_c(col))


def apply_rules(col, rules: Iterable[tuple[str, str]]) -> Column:
    """Ordered list of (pattern, replacement) folded into one expression."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules,
                  _c(col))


# Cleaning recipes. A recipe is an ordered list of step names.
_STEPS = {
    "fold_width": fold_width,
    "remove_tabs": remove_tabs,
    "squeeze_runs": squeeze_runs,
    "squeeze_emotes": squeeze_emotes,
    "strip_latin": strip_latin,
}

# Which steps each source gets (explicit; see README, quirk Q6).
RECIPES = {
    "pair": ["fold_width"],
    "headline": ["remove_tabs", "fold_width"],
    "emotion_train": ["squeeze_runs", "squeeze_emotes", "strip_latin"],
    "test": ["fold_width"],
}


def clean(col, recipe, lexicon: Mapping[str, str] | None = None) -> Column:
    """Apply a named recipe (or a list of step names), then T8 if a lexicon
    is given."""
    steps = RECIPES[recipe] if isinstance(recipe, str) else list(recipe)
    out = _c(col)
    for s in steps:
        if s not in _STEPS:
            raise ValueError(f"unknown cleaning step {s!r}")
        out = _STEPS[s](out)
    if lexicon:
        out = replace_chars(out, lexicon)
    return out
