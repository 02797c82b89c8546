"""POSIX extended regular expressions as Java patterns.

Differences that matter: ``^`` and ``$`` match at lines, ``.`` and negated classes do not match a line
end, bracket classes have names, ``\\<`` and ``\\>`` are word borders, and among literal alternatives the
longest wins. What stays different: the longest match across non-literal alternatives.
"""

from __future__ import annotations

import re

# Names of the POSIX classes in Java's syntax.
_CLASSES = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s",
    "blank": r"\p{Blank}", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "word": r"\w",
}


def to_java(pattern: str, icase: bool = False, lines: bool = True) -> str:
    """``pattern`` for Spark's ``rlike``; ``lines``: the pattern sees lines, else the whole text as one."""
    out: list[str] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append(r"\b" if n in "<>" else "`" if n == "`" else c + n)
            i += 2
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            body = ""
            first = True
            while j < len(pattern) and (pattern[j] != "]" or first):
                if m := re.match(r"\[:(\w+):\]", pattern[j:]):
                    body += _CLASSES.get(m.group(1), "")
                    j += m.end()
                else:
                    ch = pattern[j]
                    # In POSIX a backslash in brackets is itself; the callers of this tool also write \t and \n there.
                    if ch == "\\" and pattern[j + 1 : j + 2] in ("t", "n", "r", "\\", "]", "d", "s", "w"):
                        body += ch + pattern[j + 1]
                        j += 2
                        first = False
                        continue
                    body += "\\" + ch if ch in "[&\\" else ch
                    j += 1
                first = False
            if body.startswith("]"):
                body = "\\" + body
            out.append("[" + "^" * negated + body + "\\n" * (negated and lines) + "]")
            i = j + 1
        else:
            out.append(c)
            i += 1
    text = _longest_first("".join(out))
    flags = ("m" if lines else "s") + ("i" if icase else "")
    return f"(?{flags}){text}"


def _longest_first(p: str) -> str:
    """Groups of plain words separated by ``|`` get their longer words first."""

    def order(m: re.Match) -> str:
        parts = m.group(2).split("|")
        return m.group(1) + "|".join(sorted(parts, key=lambda x: -len(x))) + m.group(3)

    p = re.sub(r"(\((?:\?:)?)((?:\w+\|)+\w+)(\))", order, p)
    return re.sub(r"\A()((?:\w+\|)+\w+)()\Z", order, p)
