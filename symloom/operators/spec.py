"""Language definitions: kinds, roles, maps, and the patterns that extract entries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# Names of the POSIX classes in Python's syntax.
_CLASSES = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "blank": r" \t", "word": r"\w",
    "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1f\x7f", "print": r"\x20-\x7e", "graph": r"\x21-\x7e",
}


def to_python(pattern: str, basic: bool = False) -> str:
    """A POSIX pattern in Python's syntax; ``basic``: groups and counts are the escaped forms."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append(r"\b" if n in "<>" else n if basic and n in "(){}|+?" else c + n)
            i += 2
        elif c == "[":
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            while j < len(pattern) and pattern[j] != "]":
                m = re.match(r"\[:\w+:\]", pattern[j:])
                j += m.end() if m else 2 if pattern[j] == "\\" and j + 1 < len(pattern) else 1
            body = re.sub(r"\[:(\w+):\]", lambda m: _CLASSES.get(m.group(1), ""), pattern[i : j + 1])
            head = 2 if body[1:2] == "^" else 1
            inner = body[head:-1].replace("[", r"\[")
            if inner.startswith("]"):
                inner = "\\" + inner
            out.append(body[:head] + inner + "]")
            i = j + 1
        else:
            out.append("\\" + c if basic and c in "(){}|+?" else c)
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Kind:
    letter: str
    name: str
    description: str = ""
    enabled: bool = True
    roles: tuple[str, ...] = ()
    ref_only: bool = False


@dataclass(frozen=True)
class Rule:
    """One pattern. ``name`` is a template with ``\\1``...; empty names make no entry."""

    pattern: str
    name: str = ""
    kind: str = ""
    exclusive: bool = False
    icase: bool = False
    postrun: bool = False
    scope: tuple[str, ...] = ()  # ref push pop clear set replace intervaltab
    placeholder: bool = False
    role: str = ""
    extra: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # field name, template
    typeref: str = ""
    signature: str = ""
    file_scope: str = ""  # template; the entry is local if it is not empty
    anonymous: str = ""
    mgroup: int = 1
    advance: tuple[int, str] = (0, "end")
    guest: tuple = ()  # language (or group number), (group, side), (group, side)
    action: tuple = ()  # tenter T [cont] / tleave / tjump T / treset T / tquit
    script: str = ""
    block: str = ""  # "{": the entry ends where the bracket opened behind it closes; "indent": by indentation
    language: str = ""
    message: tuple[str, str] = ()


@dataclass(frozen=True)
class LanguageSpec:
    name: str
    kinds: tuple[Kind, ...] = ()
    extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    base: str = ""
    direction: str = "shared"
    line_rules: tuple[Rule, ...] = ()
    multi_rules: tuple[Rule, ...] = ()
    tables: tuple[tuple[str, tuple[Rule, ...]], ...] = ()
    #: Regions of other languages: pattern over the raw text, the guest's name or the group that names it, the group of the region.
    areas: tuple[tuple[str, str | int, int], ...] = ()
    #: Parts of the source that no line or multi-line rule sees: comments and strings, blanked before.
    hide: str = ""
    separators: tuple[tuple[str, str, str], ...] = ()  # parent kind, child kind, separator
    default_separator: str = "."
    fields: tuple[tuple[str, str], ...] = ()  # name, description
    extras: tuple[str, ...] = ()
    params: tuple[tuple[str, str], ...] = ()
    prelude: str = ""
    sequel: str = ""
    function: object = None  # a hand-written extractor: f(host) fills host.entries

    def kind(self, letter: str) -> Kind | None:
        return next((k for k in self.kinds if k.letter == letter or k.name == letter), None)

    def with_kinds(self, change: str) -> LanguageSpec:
        """Kinds switched as by ``--kinds-LANG=``: ``+ab-c``, ``{name}``, ``*``; without a sign all others are off."""
        on = {k.letter for k in self.kinds if k.enabled}
        known = {k.letter for k in self.kinds}
        if change[:1] not in "+-":
            on = set()
        add = True
        for sign, name, ch in re.findall(r"([+-])|\{(\w+)\}|(.)", change):
            if sign:
                add = sign == "+"
                continue
            which = known if ch == "*" else {k.letter for k in self.kinds if k.name == name or k.letter == ch and not name}
            on = on | which if add else on - which
        return replace(self, kinds=tuple(replace(k, enabled=k.letter in on) for k in self.kinds))


@dataclass
class Registry:
    """Languages by name; aliases are found letter case aside."""

    specs: dict[str, LanguageSpec] = field(default_factory=dict)

    def add(self, spec: LanguageSpec) -> LanguageSpec:
        self.specs[spec.name] = spec
        return spec

    def get(self, name: str | None) -> LanguageSpec | None:
        if name is None:
            return None
        if name in self.specs:
            return self.specs[name]
        low = name.lower()
        return next((s for s in self.specs.values() if s.name.lower() == low or low in (a.lower() for a in s.aliases)), None)

    def catalog(self, spark):
        """``language, letter, kind, description, enabled, roles``: one row a kind."""
        rows = [(s.name, k.letter, k.name, k.description, k.enabled, list(k.roles)) for s in self.specs.values() for k in s.kinds]
        return spark.createDataFrame(rows, "language string, letter string, kind string, description string, enabled boolean, roles array<string>")

    def langmap(self, spark):
        """``language, spec, pattern_text, rank``: patterns before extensions."""
        rows = [(s.name, "extension", e, 1) for s in self.specs.values() for e in s.extensions] + [(s.name, "pattern", p, 2) for s in self.specs.values() for p in s.patterns]
        return spark.createDataFrame(rows, "language string, spec string, pattern_text string, rank int")
