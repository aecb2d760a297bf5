"""One pattern, three engines: the rules' dialect put into Python's, Java's and RE2's.

In the rules' dialect ``\\b``, ``\\w`` and ``\\d`` are ASCII, ``\\s`` is the wide class below, and a plain space outside
of brackets stands for one or more of it, so that phrases match across line breaks.
"""

from __future__ import annotations

import re

#: Fixed value: what counts as white space in the rules' dialect (members of a character class).
SPACE_CODES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_JAVA_B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: What a boundary comes to where a letter is sure to follow it, or to stand before it.
_BEFORE_WORD, _AFTER_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _walk(pattern: str, space: str, boundary: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if two == r"\s":
                out.append(space if inside else f"[{space}]")
            elif two == r"\b" and not inside:
                out.append(boundary)
            else:
                out.append(two)
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{space}]+" if c == " " and not inside else c)
        i += 1
    return "".join(out)


def to_python(pattern: str, flags: str) -> re.Pattern:
    space = "".join(f"\\u{c:04x}" for c in SPACE_CODES)
    return re.compile(_walk(pattern, space, r"\b"), re.ASCII | (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


def _java_boundaries(p: str) -> str:
    """Boundaries next to a letter of the pattern take the short form, which costs one look instead of four."""
    p = re.sub(r"(?<![\\])\\b(?=[A-Za-z])", lambda m: _BEFORE_WORD, p)
    return re.sub(r"(?<=[a-z])\\b", lambda m: _AFTER_WORD, p)


def to_java(pattern: str, flags: str) -> str:
    space = "".join(f"\\x{{{c:x}}}" for c in SPACE_CODES)
    own = "".join(f for f in flags if f in "im")
    return (f"(?{own})" if own else "") + _walk(_java_boundaries(pattern), space, _JAVA_B)


def to_re2(pattern: str, flags: str) -> str:
    space = "".join(f"\\x{{{c:x}}}" for c in SPACE_CODES)
    own = "".join(f for f in flags if f in "im")
    return (f"(?{own})" if own else "") + _walk(pattern, space, r"\b")


def anchors(pattern: str, flags: str) -> list[str] | None:
    """Strings of which every match holds at least one (in lower case if the pattern ignores case); None if none is sure.

    Looking for these first is far cheaper than the pattern, and most texts hold none.
    """
    from re import _parser as parser

    def best(options):
        options = [o for o in options if o]
        return max(options, key=lambda o: min(map(len, o)), default=None)

    def of(items):
        options, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is parser.LITERAL and chr(arg) != " ":
                run += chr(arg)
                continue
            if len(run) > 1:
                options.append({run})
            run = ""
            if op is parser.SUBPATTERN:
                options.append(of(arg[3]))
            elif op is parser.BRANCH:
                each = [of(a) for a in arg[1]]
                options.append(set().union(*each) if all(each) else None)
            elif op is parser.MAX_REPEAT and arg[0] > 0:
                options.append(of(arg[2]))
        return best(options)

    found = of(parser.parse(pattern, re.ASCII | re.M))
    return sorted(x.lower() if "i" in flags else x for x in found) if found else None
