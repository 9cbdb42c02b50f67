"""Run protocol patterns on the JVM with the meaning their authors gave them.

Protocol patterns are written in Python's regex dialect. Java spells four things
differently: ``\\w`` and ``\\s`` cover other characters, ``\\b`` follows ``\\w``, and a
bare ``[`` or ``&&`` inside a class is an operator. ``java_pattern`` rewrites exactly
those, so ``rlike`` / ``regexp_extract`` answer as the author expects.
"""

from __future__ import annotations

import re
import sys
from functools import reduce
from re import _parser

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# the scan ships ``sure_text`` with its job: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Class bodies. Java tests the members of a class one after the other, so they are few.
WORD = r"\p{L}\p{N}_"
SPACE = r"\p{IsWhite_Space}\x1C-\x1F"
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_OUTSIDE = {
    "w": f"[{WORD}]", "W": f"[^{WORD}]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
    "d": r"\p{Nd}", "D": r"\P{Nd}", "b": _EDGE, "B": f"(?!{_EDGE})", "Z": r"\z",
}
_INSIDE = {
    "w": WORD, "W": f"[^{WORD}]", "s": SPACE, "S": f"[^{SPACE}]", "d": r"\p{Nd}",
    "D": r"\P{Nd}", "b": r"\x08",
}
_PIECES = re.compile(r"\\.|\(\?P<|\(\?P=(\w+)\)|\[\^?\]?|\]|&&|.", re.S)

# the non-ASCII characters that match an ASCII letter when case is ignored
FOLDED = "\u0130\u0131\u017f\u212a"


# Java's Unicode \\b is fast and can differ from Python's only next to characters outside
# these ranges (combining marks, superscripts, fractions, connectors, joiners, ...). The
# ASCII test stands alone in front: most characters stop there.
_USUAL = (
    r"\x80-\xB1\xB4-\xB8\xBA\xBB\xBF-\u024F\u0391-\u03FF\u0400-\u0481\u048A-\u052F"
    r"\u2010-\u2027\u2030-\u203E\u20A0-\u20BF\u4E00-\u9FFF"
)
UNUSUAL = rf"[[^\x00-\x7F]&&[^{_USUAL}]]"
UNUSUAL_OF_PYTHON = rf"[^\x00-\x7F{_USUAL}]"


def java_pattern(pattern: str, ignore_case: bool = True, fast_edges: bool = False, ascii_only: bool = False) -> str:
    """Rewrite one Python pattern for ``java.util.regex``.

    ``fast_edges`` keeps Java's own word boundary; it is exact for texts without
    ``UNUSUAL`` characters. ``ascii_only`` keeps its ASCII rules for boundaries and case, exact for ASCII texts
    where the pattern ``is_plain``.
    """
    out, inside = [], False
    outside = {**_OUTSIDE, "b": r"\b", "B": r"\B"} if fast_edges or ascii_only else _OUTSIDE
    for m in _PIECES.finditer(pattern):
        piece = m.group(0)
        if piece[0] == "\\" and len(piece) == 2:
            out.append((_INSIDE if inside else outside).get(piece[1], piece))
        elif inside:
            if piece == "]":
                inside = False
            # "[" has no special meaning inside a class; "&&" neither
            out.append(piece.replace("[", r"\[").replace("&&", r"&\&"))
        elif piece[0] == "[":
            inside = True
            out.append(piece[:-1] + r"\]" if piece.endswith("]") else piece)
        elif piece.startswith("(?P="):
            out.append(rf"\k<{m.group(1)}>")
        else:
            out.append("(?<" if piece == "(?P<" else piece)
    if ascii_only:
        return f"(?{'i' if ignore_case else ''}d)" + "".join(out)
    flags = ("iu" if ignore_case else "") + ("U" if fast_edges else "") + "d"
    return f"(?{flags})" + "".join(out)


def sure_text(pattern: str) -> tuple[str, int | None]:
    """Longest run of ASCII letters and digits every match of a pattern must contain, and how far behind the start of the match it stands.

    Read off the parsed pattern: only literals that stand outside groups, classes, branches and repeats count. The text is
    empty when unknown; the distance is None unless everything before the run has one width.
    """
    parsed = _parser.parse(pattern, re.IGNORECASE)
    runs, run, at = [], "", 0
    for i, (op, value) in enumerate(parsed):
        c = chr(value).lower() if op is _parser.LITERAL else ""
        if len(c) == 1 and c.isascii() and c.isalnum():
            run, at = run + c, at if run else i
        else:
            runs.append((run, at))
            run = ""
    sure, at = max([*runs, (run, at)], key=lambda r: len(r[0]))
    least, most = parsed[:at].getwidth()
    return sure, least if least == most else None


def first_letters(pattern: str) -> str | None:
    """The ASCII letters and digits, lower case, with which every match of a pattern begins; None when unknown."""

    def of(parsed) -> set[str] | None:
        for op, value in parsed:
            if op is _parser.AT:
                continue
            if op is _parser.LITERAL:
                found = [{chr(value).lower()}]
            elif op is _parser.IN and all(kind is _parser.LITERAL for kind, _ in value):
                found = [{chr(v).lower() for _, v in value}]
            elif op is _parser.SUBPATTERN:
                found = [of(value[3])]
            else:
                found = [of(p) for p in value[1]] if op is _parser.BRANCH else [None]
            letters = None if None in found else set().union(*found)
            return letters if letters and all(c.isascii() and c.isalnum() for c in letters) else None
        return None

    letters = of(_parser.parse(pattern, re.IGNORECASE))
    return letters and "".join(sorted(letters))


def _guard(patterns: list[str] | tuple[str, ...], ascii_only: bool = False) -> str:
    """A look ahead for the first character of a match, which fails sooner than a word boundary; empty when it is unknown."""
    letters = [first_letters(p) for p in patterns]
    if not all(letters):
        return ""
    both = sorted({d for c in "".join(letters) for d in (c, c.upper())})
    return f"(?=[{''.join(both)}{'' if ascii_only else FOLDED}])"


def is_ascii(text: Column) -> Column:
    """Whether every character has one byte; no regex looks at the text."""
    return F.octet_length(text) == F.length(text)


def is_plain(pattern: str) -> bool:
    """Whether a pattern names ASCII characters only, so that case folding cannot lead from another one to an ASCII text."""
    return not re.search(r"[^\x00-\x7F]|\\[uUxN0-9]", pattern)


def is_unusual(text: Column) -> Column:
    """Whether Java's fast word boundary may not be used on a text."""
    return ~is_ascii(text) & text.rlike(UNUSUAL)


def may_match(text: Column, patterns: list[str] | tuple[str, ...], lowered: Column | None = None) -> Column | None:
    """False where a text lacks the literal that a match of each pattern must contain; None if one pattern has no such literal.

    A substring test is much cheaper than a regex that fails at every character.
    """
    sure = [sure_text(p)[0] for p in patterns]
    if not all(sure):
        return None
    return contains_any(F.lower(text) if lowered is None else lowered, tuple(dict.fromkeys(sure))) | (~is_ascii(text) & contains_any(text, tuple(FOLDED)))


def matches_any(text: Column, patterns: list[str] | tuple[str, ...], unusual: Column | None = None, lowered: Column | None = None) -> Column:
    """True when one pattern of a family is found; an empty family never fires.

    Pass ``unusual`` (see ``is_unusual``) and ``lowered``, the text in lower case, when several families test the same text.
    """
    if not patterns:
        return F.lit(False)

    def found(**dialect: bool) -> Column:
        rewritten = [java_pattern(p, **dialect) for p in patterns]
        if any(re.search(r"\\[1-9]|\(\?P", p) for p in patterns):  # groups are numbered or named
            return reduce(lambda x, y: x | y, [text.rlike(p) for p in rewritten])
        return text.rlike(_guard(patterns, "ascii_only" in dialect) + "(?:" + "|".join(f"(?:{p})" for p in rewritten) + ")")

    fires = F.when(is_unusual(text) if unusual is None else unusual, found()).otherwise(found(fast_edges=True))
    if all(map(is_plain, patterns)):
        fires = F.when(is_ascii(text), found(ascii_only=True)).otherwise(fires)
    possible = may_match(text, patterns, lowered)
    return fires if possible is None else possible & fires


def extract(text: Column, pattern: str, group: int, ignore_case: bool = True) -> Column:
    """First match of a pattern, or empty text."""
    exact, fast, plain = (
        F.regexp_extract(text, _guard([pattern], d == (False, True)) + java_pattern(pattern, ignore_case, *d), group) for d in ((), (True,), (False, True)))
    rest = F.when(is_unusual(text), exact).otherwise(fast)
    return F.when(is_ascii(text), plain).otherwise(rest) if is_plain(pattern) else rest


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [text.contains(w) for w in words])
