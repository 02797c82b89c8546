"""Option files: languages, kinds, patterns and settings in the ``--option=value`` form.

One option a line; ``#`` begins a comment line; a ``{{`` script reaches to its ``}}``. The result is a
registry of language definitions plus settings that the index builder reads.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from symloom.operators.spec import Kind, LanguageSpec, Registry, Rule
from symloom.operators.writers import MODES

# What the short names of pattern flags stand for.
_SHORT = {"i": "icase", "x": "exclusive", "b": "basic", "e": "extend", "p": "pcre2"}


class OptionError(ValueError):
    pass


@dataclass
class Settings:
    """Switches besides the languages."""

    fields: set[str] = field(default_factory=lambda: set("NFPfkstT"))
    extras: set[str] = field(default_factory=lambda: set("Fs"))
    excludes: list[str] = field(default_factory=list)
    sort: str = "yes"
    output_format: str = MODES[0]
    excmd: str = "mix"
    pattern_limit: int = 96
    maxdepth: int | None = None
    recurse: bool = False
    append: bool = False
    languages: set[str] | None = None
    language_force: str | None = None
    tag_relative: str = "no"
    totals: bool = False
    encodings: dict[str, str] = field(default_factory=dict)
    roles: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    language_fields: dict[str, set[str]] = field(default_factory=dict)
    language_extras: dict[str, set[str]] = field(default_factory=dict)
    pretend: dict[str, str] = field(default_factory=dict)
    other: dict[str, str] = field(default_factory=dict)


def switch(current: set[str], change: str, every: set[str]) -> set[str]:
    """Letters and ``{names}`` added, removed or set: ``+ab-c{x}``, ``*``."""
    now = set(current) if change[:1] in ("+", "-") else set()
    add = True
    for sign, name, ch in re.findall(r"([+-])|\{([\w.]+)\}|(.)", change):
        if sign:
            add = sign == "+"
        else:
            which = every if ch == "*" else {name or ch}
            now = now | which if add else now - which
    return now


def split_options(text: str) -> list[str]:
    """The options of a file; scripts between ``{{`` and ``}}`` stay with theirs."""
    out: list[str] = []
    script: list[str] | None = None
    for line in text.split("\n"):
        if script is not None:
            script.append(line)
            if line.startswith("}}"):
                out.append("\n".join(script))
                script = None
            continue
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.endswith("{{"):
            script = [s]
        else:
            out.append(s)
    return out


def flags(text: str) -> tuple[dict[str, str | bool], str]:
    """Long flags ``{name}`` or ``{name=value}``, short letters, and the script of a pattern."""
    script = ""
    if "{{" in text:
        text, script = text.split("{{", 1)
        script = script.rsplit("}}", 1)[0]
    found: dict[str, str | bool] = {}
    for name, value, letter in re.findall(r"\{(\w+)(?:=((?:[^{}\\]|\\.)*))?\}|([a-zA-Z])", text):
        if letter:
            found[_SHORT.get(letter, letter)] = True
        elif name == "scope" or name == "_field":
            found.setdefault(name, [])
            found[name].append(value)  # type: ignore[union-attr]
        else:
            found[name] = re.sub(r"\\(.)", r"\1", value) if value else True
    return found, script


def _split_delimited(text: str) -> list[str]:
    """``/pattern/name/kind/flags``: the first character delimits, a backslash protects it."""
    d = text[0]
    parts, cur, i = [], "", 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] == d:
            cur += d
            i += 2
        elif text[i] == d and len(parts) < 3:
            parts.append(cur)
            cur = ""
            i += 1
        else:
            if text[i] == "\\" and i + 1 < len(text):
                cur += text[i : i + 2]
                i += 2
                continue
            cur += text[i]
            i += 1
    return [*parts, cur]


def parse_rule(spec: LanguageSpec, text: str, kind_of: str = "") -> tuple[LanguageSpec, Rule]:
    """A pattern option; an unknown kind is defined by it (``letter,name,description``)."""
    parts = _split_delimited(text)
    if len(parts) < 2:
        raise OptionError(f"a pattern has a name: {text!r}")
    pattern, name = parts[0], parts[1]
    rest = parts[2:]
    kind_text = ""
    # Without a name the kind may be left out, so that flags follow at once.
    if rest and not rest[0].startswith("{"):
        kind_text, rest = rest[0], rest[1:]
    f, script = flags("".join(rest))
    letter, _, more = kind_text.partition(",")
    if letter.startswith("{"):
        letter = letter.strip("{}")
    if letter and spec.kind(letter) is None:
        kname, _, desc = more.partition(",")
        spec = replace(spec, kinds=(*spec.kinds, Kind(letter, kname or letter, desc or kname or letter)))
    if not letter and name:
        letter = "r"
        if spec.kind("r") is None:
            spec = replace(spec, kinds=(*spec.kinds, Kind("r", "regex", "regex")))
    guest: tuple = ()
    if isinstance(g := f.get("_guest"), str):
        lang, a, b = (x.strip() for x in g.split(","))
        pos = lambda x: (int(re.match(r"\d+", x).group()), "end" if x.endswith("end") else "start")
        guest = (int(lang[1:]) if re.fullmatch(r"\\\d", lang) else lang, pos(a), pos(b))
    advance = (0, "end")
    if isinstance(a := f.get("_advanceTo"), str):
        advance = (int(re.match(r"\d+", a).group()), "start" if "start" in a else "end")
    action: tuple = ()
    for act in ("tenter", "tjump", "treset", "tleave", "tquit"):
        if act in f:
            v = f[act]
            action = (act, *(x.strip() for x in v.split(","))) if isinstance(v, str) else (act,)
    fields = tuple((x.split(":", 1)[0], x.split(":", 1)[1]) for x in f.get("_field", ()) if ":" in x)
    rule = Rule(
        pattern, name, letter, exclusive=bool(f.get("exclusive")), icase=bool(f.get("icase")), postrun=bool(f.get("postrun")), scope=tuple(f.get("scope", ())),
        placeholder=bool(f.get("placeholder")), role=str(f["_role"]) if isinstance(f.get("_role"), str) else "", extra=str(f["_extra"]) if isinstance(f.get("_extra"), str) else "",
        fields=fields, anonymous=str(f["_anonymous"]) if isinstance(f.get("_anonymous"), str) else "", mgroup=int(f["mgroup"]) if isinstance(f.get("mgroup"), str) else 0, advance=advance,
        guest=guest, action=action, script=script, language=str(f["_language"]) if isinstance(f.get("_language"), str) else "",
        message=("fatal" if "fatal" in f else "warning", str(f.get("fatal") or f.get("warning"))) if "fatal" in f or "warning" in f else (),
    )
    return spec, rule


class Options:
    """Applies options in their order."""

    def __init__(self, registry: Registry | None = None) -> None:
        self.registry = registry or Registry()
        self.settings = Settings()
        self.tables: dict[str, dict[str, list[Rule]]] = {}

    def load(self, path: str, names: str = "*") -> Options:
        """A file, or all files of a directory whose names fit ``names``, in order of name."""
        p = Path(path)
        for f in sorted(x for x in p.glob(names) if x.is_file()) if p.is_dir() else [p]:
            self.read(f.read_text())
        return self

    def read(self, text: str) -> Options:
        for option in split_options(text):
            self.apply(option)
        return self

    def _spec(self, lang: str) -> LanguageSpec:
        spec = self.registry.get(lang)
        if spec is None:
            raise OptionError(f"unknown language: {lang}")
        return spec

    def apply(self, option: str) -> None:
        m = re.match(r"--([\w-]+?(?:-[^=\s]+)?)(?:=(.*))?$", option, re.S)
        if not m:
            raise OptionError(f"not an option: {option!r}")
        name, value = m.group(1), m.group(2) or ""
        for prefix in ("_mtable-regex-", "_mtable-extend-", "mline-regex-", "regex-", "kinddef-", "_roledef-", "_fielddef-", "_extradef-", "_paramdef-", "_scopesep-", "_tabledef-", "_prelude-", "_sequel-", "_pretend-", "kinds-", "roles-", "fields-", "extras-", "map-", "alias-", "param-", "input-encoding-"):
            if name.startswith(prefix):
                getattr(self, "_" + prefix.strip("_-").replace("-", "_"))(name[len(prefix) :], value)
                return
        self._general(name, value)

    # --- languages ------------------------------------------------------------------------------

    def _langdef(self, value: str) -> None:
        name, _, rest = value.partition("{")
        f, _ = flags("{" + rest if rest else "")
        direction = next((d for d in ("shared", "dedicated", "bidirectional") if d in f), "shared")
        self.registry.add(LanguageSpec(name, base=str(f["base"]) if isinstance(f.get("base"), str) else "", direction=direction))

    def _kinddef(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        body, _, rest = value.partition("{")
        letter, name, desc = (body.split(",", 2) + ["", ""])[:3]
        f, _ = flags("{" + rest if rest else "")
        self.registry.add(replace(s, kinds=(*s.kinds, Kind(letter, name, desc, "_refonly" not in f, (), "_refonly" in f))))

    def _roledef(self, lang: str, value: str) -> None:
        lang, _, kind = lang.partition(".")
        s = self._spec(lang)
        role = value.partition(",")[0]
        kind = kind.strip("{}")
        self.registry.add(replace(s, kinds=tuple(replace(k, roles=(*k.roles, role)) if kind in (k.letter, k.name, "*") else k for k in s.kinds)))

    def _fielddef(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        n, _, d = value.partition("{")[0].partition(",")
        self.registry.add(replace(s, fields=(*s.fields, (n, d))))

    def _extradef(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        self.registry.add(replace(s, extras=(*s.extras, value.partition(",")[0])))

    def _paramdef(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        self.registry.add(replace(s, params=(*s.params, (value.partition(",")[0], ""))))

    def _param(self, lang: str, value: str) -> None:
        lang, _, name = lang.partition(".")
        s = self._spec(lang)
        self.registry.add(replace(s, params=(*[p for p in s.params if p[0] != name], (name, value))))

    def _scopesep(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        m = re.match(r"(\{\w+\}|.?)/(\{\w+\}|.):(.*)$", value)
        if not m:
            raise OptionError(f"a separator names two kinds: {value!r}")
        names = [("*" if x == "*" else (k.name if (k := s.kind(x.strip("{}"))) else x.strip("{}"))) for x in m.groups()[:2]]
        if names == ["*", "*"]:
            self.registry.add(replace(s, default_separator=m.group(3)))
        else:
            self.registry.add(replace(s, separators=(*s.separators, (names[0], names[1], m.group(3)))))

    def _regex(self, lang: str, value: str) -> None:
        s, r = parse_rule(self._spec(lang), value)
        self.registry.add(replace(s, line_rules=(*s.line_rules, r)))

    def _mline_regex(self, lang: str, value: str) -> None:
        s, r = parse_rule(self._spec(lang), value)
        self.registry.add(replace(s, multi_rules=(*s.multi_rules, r)))

    def _tabledef(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        self.registry.add(replace(s, tables=(*s.tables, (value, ()))))

    def _mtable_regex(self, lang: str, value: str) -> None:
        table, _, rest = value.partition("/")
        s, r = parse_rule(self._spec(lang), "/" + rest)
        if table not in dict(s.tables):
            raise OptionError(f"unknown table: {table}")
        self.registry.add(replace(s, tables=tuple((t, (*rs, r)) if t == table else (t, rs) for t, rs in s.tables)))

    def _mtable_extend(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        table, _, source = value.partition("+")
        more = dict(s.tables).get(source)
        if more is None or table not in dict(s.tables):
            raise OptionError(f"unknown table: {value}")
        self.registry.add(replace(s, tables=tuple((t, (*rs, *more)) if t == table else (t, rs) for t, rs in s.tables)))

    def _prelude(self, lang: str, value: str) -> None:
        self.registry.add(replace(self._spec(lang), prelude=value.strip().removeprefix("{{").removesuffix("}}")))

    def _sequel(self, lang: str, value: str) -> None:
        self.registry.add(replace(self._spec(lang), sequel=value.strip().removeprefix("{{").removesuffix("}}")))

    def _pretend(self, lang: str, value: str) -> None:
        self.settings.pretend[lang] = value

    def _kinds(self, lang: str, value: str) -> None:
        for s in list(self.registry.specs.values()) if lang == "all" else [self._spec(lang)]:
            self.registry.add(s.with_kinds(value))

    def _roles(self, lang: str, value: str) -> None:
        lang, _, kind = lang.partition(".")
        s = self._spec(lang)
        every = {r for k in s.kinds if kind.strip("{}") in (k.letter, k.name, "*") for r in k.roles}
        key = (s.name, kind.strip("{}"))
        self.settings.roles[key] = switch(self.settings.roles.get(key, every), value, every)

    def _fields(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        self.settings.language_fields[s.name] = switch(self.settings.language_fields.get(s.name, set()), value, {f for f, _ in s.fields})

    def _extras(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        self.settings.language_extras[s.name] = switch(self.settings.language_extras.get(s.name, set()), value, set(s.extras))

    def _map(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        sign = value[:1] if value[:1] in "+-" else ""
        ext, pats = list(s.extensions), list(s.patterns)
        if not sign:
            ext, pats = [], []
        for p, e in re.findall(r"\(([^)]+)\)|\.([^.()]+)", value):
            target, item = (pats, p) if p else (ext, e)
            if sign == "-":
                target[:] = [x for x in target if x != item]
            elif item not in target:
                target.append(item)
        self.registry.add(replace(s, extensions=tuple(ext), patterns=tuple(pats)))

    def _alias(self, lang: str, value: str) -> None:
        s = self._spec(lang)
        if value.startswith("-"):
            self.registry.add(replace(s, aliases=tuple(a for a in s.aliases if a != value[1:])))
        else:
            base = s.aliases if value.startswith("+") else ()
            self.registry.add(replace(s, aliases=(*base, value.lstrip("+"))))

    def _input_encoding(self, lang: str, value: str) -> None:
        self.settings.encodings[lang] = value

    # --- settings -----------------------------------------------------------------------------------

    def _general(self, name: str, value: str) -> None:
        st = self.settings
        if name == "langdef":
            self._langdef(value)
        elif name in ("fields", "extras", "extra"):
            every = set("NFPCfKklnstziamSRZprExeTo") if name == "fields" else set("Ffpqrgsz")
            key = "fields" if name == "fields" else "extras"
            setattr(st, key, switch(getattr(st, key), value, every))
        elif name == "exclude":
            st.excludes = [] if not value else [*st.excludes, value]
        elif name == "sort":
            st.sort = {"1": "yes", "0": "no"}.get(value, value)
        elif name == "excmd" and value not in ("number", "pattern", "mix", "mixed", "combine"):
            raise OptionError(f"unknown address mode: {value}")
        elif name in ("output-format", "excmd", "language-force", "tag-relative"):
            setattr(st, name.replace("-", "_"), value)
        elif name in ("maxdepth", "pattern-length-limit"):
            setattr(st, "maxdepth" if name == "maxdepth" else "pattern_limit", int(value))
        elif name in ("recurse", "append", "totals"):
            setattr(st, name, value in ("", "yes", "on", "extra"))
        elif name == "languages":
            every = set(self.registry.specs)
            now = set(every if st.languages is None else st.languages) if value[:1] in "+-" else set()
            for sign, lang in re.findall(r"([+-]?)([^,+-][^,]*)", value):
                which = every if lang in ("all", "*") else {self._spec(lang).name}
                now = now - which if sign == "-" else now | which
            st.languages = now
        elif name in ("input-encoding", "output-encoding"):
            st.encodings["" if name == "input-encoding" else "out"] = value
        elif name in ("options", "options-maybe"):
            if name == "options" or Path(value).exists():
                self.load(value)
        else:
            st.other[name] = value
