"""Extraction: source files to entries, one narrow pass, one sequential machine a file.

Line rules see each line, multi-line rules the whole text, table rules move a cursor through it with a
stack of tables. Scopes are kept on a stack of entry numbers. Regions of another language are extracted
by that language's rules and their lines shifted. A file that a rule cannot read gives what was found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symloom.functions.patterns import LIMIT, search_pattern
from symloom.functions.script import Context, Machine, Quit, ScriptError, Stop, compile_script
from symloom.operators.spec import LanguageSpec, Registry, Rule, to_python
from symloom.sources.parallel import ready, slices

ENTRY = (
    "file_id long, entry_id int, path string, language string, name string, kind string, kind_letter string, roles array<string>, line long, end long, nth int,"
    " pattern string, file_scope boolean, scope_id int, scope_kind string, scope_name string, typeref string, signature string, access string, inherits string,"
    " extras array<string>, placeholder boolean, fields map<string,string>"
)
#: Against rules that do not move: switches of tables at one place.
MAX_STILL = 65
#: Entries in one Arrow batch.
BATCH_ENTRIES = 5000


@lru_cache(maxsize=4096)
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(to_python(pattern), flags)


@lru_cache(maxsize=1024)
def _script(text: str):
    return compile_script(text)


def fill(template: str, groups: tuple) -> str:
    """``\\0``..``\\9`` replaced by groups; blanks at the ends fall away."""
    if len(template) == 2 and template[0] == "\\" and template[1].isdigit():
        n = int(template[1])
        return (groups[n] or "").strip() if n < len(groups) else ""
    if "\\" not in template:
        return template.strip()
    return re.sub(r"\\(\d)", lambda m: (groups[int(m.group(1))] or "") if int(m.group(1)) < len(groups) else "", template).strip()


def _blank(m: re.Match) -> str:
    s = m.group()
    return "\n".join(" " * len(x) for x in s.split("\n")) if "\n" in s else " " * len(s)


class Host:
    """The state of one file: entries, scopes, promises of other languages."""

    def __init__(self, spec: LanguageSpec, path: str, text: str, registry: Registry | None = None, extras: tuple[str, ...] = ()) -> None:
        self.spec, self.path, self.registry, self.extras = spec, path, registry, extras
        self.text = text
        self.entries: list[dict] = []
        self.scopes: list[int] = []
        self.promises: list[tuple[str, int, int]] = []
        self.table_action: tuple = ()
        self.advance_to: int | None = None
        self.starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
        self.seen = _compiled(spec.hide, re.S | re.M).sub(_blank, text) if spec.hide else text
        self._anonymous = 0
        self.last = len(self.starts) if text and not text.endswith("\n") else max(1, len(self.starts) - 1)

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def line_text(self, line: int) -> str:
        lo = self.starts[line - 1] if 0 < line <= len(self.starts) else len(self.text)
        return self.text[lo : self.starts[line] if line < len(self.starts) else len(self.text)].rstrip("\r\n")

    def anonymous(self, prefix: str, kind: str) -> str:
        """A name made of the prefix, a hash of the path, a counter and the kind."""
        h = 5381
        for b in self.path.encode():
            h = (h * 33 + b) & 0xFFFFFFFF
        self._anonymous += 1
        k = next((i for i, x in enumerate(self.spec.kinds) if kind in (x.name, x.letter)), 0)
        return f"{prefix}{h:08x}{self._anonymous:02x}{k:02x}"

    # --- making entries ---------------------------------------------------------------------------

    def add(self, rule: Rule, groups: tuple, offset: int, spans: tuple = (), shift: int = 0) -> int | None:
        """The entry of a match, its scope actions and its script; None if the rule makes no entry."""
        line = self.line_of(offset)
        scope = self._current()
        acts = rule.scope
        parent: int | None = None
        if "ref" in acts or "push" in acts or "replace" in acts:
            if "replace" in acts and self.scopes:
                self._close(self.scopes.pop(), line - 1)
                scope = self._current()
            parent = scope
        if "intervaltab" in acts:
            held = [(e["line"], i + 1) for i, e in enumerate(self.entries) if (e.get("end") or 0) >= line > e["line"]]
            parent = max(held)[1] if held else None
        if "clear" in acts or "set" in acts:
            for s in reversed(self.scopes):
                self._close(s, line - 1 if "set" in acts else line)
            self.scopes.clear()
        if "pop" in acts and self.scopes:
            self._close(self.scopes.pop(), line)
        number = None
        name = fill(rule.name, groups)
        if rule.anonymous and not name:
            name = self.anonymous(rule.anonymous, rule.kind)
        kind = self.spec.kind(rule.kind)
        if name and kind is not None:
            e = {
                "name": name,
                "kind": kind.name,
                "kind_letter": kind.letter,
                "line": line,
                "offset": offset,
                "scope_id": parent,
                "roles": [rule.role] if rule.role else [],
                "extras": ["reference"] if rule.role else [],
                "fields": {k: v for k, t in rule.fields if (v := fill(t, groups))},
                "placeholder": rule.placeholder,
            }
            if rule.extra:
                e["extras"].append(rule.extra)
            if rule.anonymous and not fill(rule.name, groups):
                e["extras"].append("anonymous")
            if rule.typeref and (t := fill(rule.typeref, groups)):
                e["typeref"] = "typename:" + " ".join(t.split())
            if rule.signature and (t := fill(rule.signature, groups)):
                e["signature"] = " ".join(t.split())
            if rule.file_scope and fill(rule.file_scope, groups):
                e["file_scope"] = True
                e["extras"].append("fileScope")
            if rule.language:
                e["language"] = rule.language
            if rule.block:
                e["end"] = self._block_end(rule.block, spans[0][1] if spans else offset, line)
            self.entries.append(e)
            number = len(self.entries)
            if "push" in acts or "set" in acts or "replace" in acts:
                self.scopes.append(number)
        if rule.guest:
            self._promise(rule.guest, groups, spans)
        if rule.script:
            self._run(rule.script, groups, spans, number)
        return number

    def _current(self) -> int | None:
        for s in reversed(self.scopes):
            if not self.entries[s - 1].get("placeholder"):
                return s
        return None

    def _close(self, number: int, line: int) -> None:
        self.entries[number - 1].setdefault("end", max(line, self.entries[number - 1]["line"]))

    def _promise(self, guest: tuple, groups: tuple, spans: tuple) -> None:
        lang, (g0, side0), (g1, side1) = guest
        if isinstance(lang, int):
            lang = groups[lang] if lang < len(groups) else None
        if lang and g0 < len(spans) and g1 < len(spans) and spans[g0][0] >= 0 and spans[g1][0] >= 0:
            lo, hi = spans[g0][side0 == "end"], spans[g1][side1 == "end"]
            if lo < hi:
                self.promises.append((lang, lo, hi))

    def _run(self, script: str, groups: tuple, spans: tuple, current: int | None) -> None:
        ctx = Context(groups, spans, self.entries, current, self, dict(self.spec.params), self.line_of)
        try:
            Machine(ctx).run(_script(script))
        except (ScriptError, Stop, Quit):
            pass  # an error ends the script of this match only

    def _block_end(self, how: str, offset: int, line: int) -> int | None:
        s = self.seen
        if how == "indent":
            own = self.line_text(line)
            depth = len(own) - len(own.lstrip())
            end = line
            for n in range(line + 1, self.last + 1):
                t = self.line_text(n)
                if t.strip():
                    if len(t) - len(t.lstrip()) <= depth:
                        break
                    end = n
            return end
        if how == "(":
            at, depth = self.starts[line - 1] + self.line_text(line).find("("), 0
            pair = "()"
        else:
            at = s.find("{", max(0, offset - 1))
            stop = re.compile(r"[;}]").search(s, max(0, offset - 1))
            if at < 0 or (stop and stop.start() < at):
                return None
            depth, pair = 0, "{}"
        for m in re.compile(f"[{pair}]" if pair == "{}" else r"[()]").finditer(s, at):
            depth += 1 if m.group() == pair[0] else -1
            if depth == 0:
                return self.line_of(m.start())
        return None

    # --- the three kinds of rules -------------------------------------------------------------------

    def lines(self, rules: tuple[Rule, ...]) -> None:
        compiled = [(r, _compiled(r.pattern, re.I if r.icase else 0)) for r in rules]
        for n, at in enumerate(self.starts):
            if at >= len(self.text):
                break
            end = self.starts[n + 1] if n + 1 < len(self.starts) else len(self.seen)
            s = self.seen[at:end].rstrip("\r\n")
            for r, p in compiled:
                m = p.search(s)
                if m is None:
                    continue
                spans = tuple((a + at, b + at) if a >= 0 else (-1, -1) for a, b in (m.span(g) for g in range(len(m.groups()) + 1)))
                groups = (m.group(), *m.groups())
                # A name comes from the source itself, where hidden parts stand.
                groups = tuple(self.text[a:b] if a >= 0 else None for a, b in spans) if self.spec.hide else groups
                self.add(r, groups, at, spans)
                if r.exclusive:
                    break

    def multi(self, rules: tuple[Rule, ...]) -> None:
        for r in rules:
            p = _compiled(r.pattern, re.M | (re.I if r.icase else 0))
            pos = 0
            while pos <= len(self.seen) and (m := p.search(self.seen, pos)):
                spans = tuple(m.span(g) for g in range(len(m.groups()) + 1))
                groups = tuple(self.text[a:b] if a >= 0 else None for a, b in spans)
                g = r.mgroup if r.mgroup < len(spans) and spans[r.mgroup][0] >= 0 else 0
                self.advance_to = None
                self.add(r, groups, spans[g][0], spans)
                a = r.advance
                nxt = self.advance_to if self.advance_to is not None else spans[a[0]][a[1] == "end"] if a[0] < len(spans) else m.end()
                if nxt <= pos and nxt <= m.start():
                    break  # no way forward
                pos = nxt

    def machine(self, tables: Mapping[str, tuple[Rule, ...]]) -> None:
        if not tables:
            return
        first = next(iter(tables))
        table, stack, pos, still = first, [], 0, 0
        s = self.seen
        while pos < len(s):
            for r in tables.get(table, ()):
                m = _compiled(r.pattern, re.M | (re.I if r.icase else 0)).match(s, pos)
                if m is None:
                    continue
                spans = tuple(m.span(g) for g in range(len(m.groups()) + 1))
                groups = tuple(self.text[a:b] if a >= 0 else None for a, b in spans)
                self.table_action, self.advance_to = (), None
                g = r.mgroup if r.mgroup < len(spans) and spans[r.mgroup][0] >= 0 else 0
                self.add(r, groups, spans[g][0], spans)
                act = self.table_action or r.action
                new = self.advance_to if self.advance_to is not None else m.end() if r.advance == (0, "end") else spans[r.advance[0]][r.advance[1] == "end"]
                before = table
                if act:
                    if act[0] == "tenter":
                        stack.append(act[2] if len(act) > 2 else table)
                        table = act[1]
                    elif act[0] == "tleave":
                        table = stack.pop() if stack else first
                    elif act[0] == "tjump":
                        table = act[1]
                    elif act[0] == "treset":
                        stack.clear()
                        table = act[1]
                    elif act[0] == "tquit":
                        return
                if new <= pos:
                    still += 1
                    if still > MAX_STILL or table == before:
                        new, still = pos + 1, 0
                else:
                    still = 0
                pos = max(pos, new)
                break
            else:
                # Nothing fits: back to the table below, and on by one character at the bottom.
                if stack:
                    table = stack.pop()
                else:
                    pos += 1

    def run(self) -> list[dict]:
        spec = self.spec
        if spec.prelude:
            self._run(spec.prelude, (), (), None)
        if spec.function is not None:
            spec.function(self)
        self.lines(tuple(r for r in spec.line_rules if not r.postrun))
        self.multi(spec.multi_rules)
        self.machine(dict(spec.tables))
        for pattern, guest, region in spec.areas:
            for m in _compiled(pattern, re.M | re.I).finditer(self.text):
                name = m.group(guest) if isinstance(guest, int) else guest
                if name and m.group(region):
                    self.promises.append((name, *m.span(region)))
        self.lines(tuple(r for r in spec.line_rules if r.postrun))
        for s in self.scopes:
            self._close(s, self.last)
        if spec.sequel:
            self._run(spec.sequel, (), (), None)
        return self.entries


def extract_text(spec: LanguageSpec, path: str, text: str, registry: Registry | None = None, extras: tuple[str, ...] = ()) -> list[dict]:
    """Entries of one text, those of its guest regions behind them with their lines shifted."""
    text = text.lstrip("﻿")
    host = Host(spec, path, text, registry, extras)
    found = host.run()
    for e in found:
        e.setdefault("language", spec.name)
    if registry is not None:
        for sub in registry.specs.values():
            if sub.base == spec.name and (sub.line_rules or sub.multi_rules or sub.tables):
                found = found + _shifted(extract_text(sub, path, text, None, extras), len(found), 0, "subparser")
        for lang, lo, hi in host.promises:
            guest = registry.get(lang)
            # A region is smaller than its text or of a language without regions, so guests come to an end.
            if guest is not None and (hi - lo < len(text) or guest is not spec and not guest.areas):
                more = extract_text(guest, path, text[lo:hi], registry, extras)
                found = found + _shifted(more, len(found), host.line_of(lo) - 1, "guest")
    return found


def _shifted(entries: list[dict], base: int, lines: int, extra: str) -> list[dict]:
    for e in entries:
        e["line"] += lines
        if e.get("end"):
            e["end"] += lines
        if e.get("scope_id"):
            e["scope_id"] += base
        e["extras"] = [*(e.get("extras") or []), extra]
    return entries


def separator_of(spec: LanguageSpec | None, parent: str, child: str) -> str:
    if spec is not None:
        for p, c, s in spec.separators:
            if p in (parent, "*") and c in (child, "*"):
                return s
        return spec.default_separator
    return "."


def qualify(entries: list[dict], spec: LanguageSpec | None) -> None:
    """Fills ``scope_kind`` and ``scope_name`` (fully qualified) and ``nth`` of entries in their order."""
    full: dict[int, str] = {}
    count: dict[int | None, int] = {}
    for i, e in enumerate(entries, 1):
        s = e.get("scope_id")
        if s == i or not s or s > len(entries):
            s = e["scope_id"] = None
        chain = s
        while chain and entries[chain - 1].get("placeholder"):
            chain = entries[chain - 1].get("scope_id")
        if chain:
            up = entries[chain - 1]
            e["scope_kind"], e["scope_name"] = up["kind"], full.get(chain, up["name"])
            full[i] = e["scope_name"] + separator_of(spec, up["kind"], e["kind"]) + e["name"]
        else:
            full[i] = e["name"]
        e["nth"] = count.get(s, 0)
        count[s] = e["nth"] + 1


def writable(spec: LanguageSpec | None, e: dict, references: bool, anonymous: bool = True) -> bool:
    """Whether an entry is written: no placeholder, kind enabled, references only if asked for."""
    if e.get("placeholder") or (not anonymous and "anonymous" in (e.get("extras") or ())):
        return False
    if "reference" in (e.get("extras") or ()) and not references:
        return False
    k = spec.kind(e["kind"]) if spec is not None else None
    return k is None or k.enabled


def extract_entries(files: DataFrame, registry: Registry, references: bool = False, text: str = "contents", language: str = "lang", carry: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``files(file_id, path, contents, lang)`` to entries in the schema ``ENTRY``.

    One narrow pass without a shuffle, in batches of bounded rows and bytes; null texts, null or unknown
    languages give no entries. ``limit``: bytes of a line that its pattern keeps, 0 for all. ``carry``: a column
    that each entry takes from its file; with it a file also gives one row without a name, that says it was read.
    """
    ready(files.sparkSession)
    struct = StructType.fromDDL(ENTRY + (f", `{carry}` {dict(files.dtypes)[carry]}" if carry else ""))
    arrow = to_arrow_schema(struct)
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for b in slices(batches):
            for fid, path, contents, lang, *carried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if carry:
                    out.append({n: None for n in names} | {"file_id": fid, "path": path, "language": lang, carry: carried[0]})
                spec = registry.get(lang)
                if contents is None or spec is None:
                    continue
                found = extract_text(spec, path or "", contents, registry)
                qualify(found, spec)
                lines = contents.lstrip("﻿").split("\n")
                for i, e in enumerate(found, 1):
                    own = spec if e["language"] == spec.name else registry.get(e["language"])
                    if not writable(own, e, references):
                        continue
                    at = e["line"] - 1
                    row = {n: e.get(n) for n in names}
                    row |= {"file_id": fid, "entry_id": i, "path": path, "file_scope": bool(e.get("file_scope")), "placeholder": False, "roles": e["roles"] or ["def"]}
                    row["pattern"] = e.get("pattern") or search_pattern(lines[at] if at < len(lines) else "", limit)
                    if carry:
                        row[carry] = carried[0]
                    row["fields"] = list((e.get("fields") or {}).items())
                    if own is not None and row["kind_letter"] is None and (k := own.kind(e["kind"])):
                        row["kind_letter"] = k.letter
                    out.append(row)
                    if len(out) >= BATCH_ENTRIES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out.clear()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = files.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    return rows.select(F.col("file_id").cast("long"), "path", F.col(text), F.col(language), *([carry] if carry else [])).mapInArrow(run, struct)


# --- rules that need no state: built-in expressions only ------------------------------------------


def lines_of(files: DataFrame, text: str = "contents", key: str = "file_id") -> DataFrame:
    """``key, line_no, line``: lines end at LF, CR or CRLF; a text's last line end opens no line."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    out = files.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), F.posexplode(parts).alias("p", "line"))
    return out.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def line_entries(lines: DataFrame, rules: list[Rule], line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Entries of scope-free line rules, inside whole-stage code: all matching rules, or the first exclusive one.

    Adds ``name``, ``kind`` and ``rule`` (its number) to each line that matches.
    """
    from symloom.functions.regex import to_java

    made = []
    blocked = F.lit(False)
    for i, r in enumerate(rules):
        p = to_java(r.pattern, r.icase)
        hit = F.col(line).rlike(p)
        parts = [F.regexp_extract(line, p, int(x[1])) if re.fullmatch(r"\\\d", x) else F.lit(x) for x in re.findall(r"\\\d|[^\\]+", r.name)]
        name = F.trim(F.concat(*parts)) if parts else F.lit("")
        made.append(F.when(hit & ~blocked & (name != ""), F.struct(name.alias("name"), F.lit(r.kind).alias("kind"), F.lit(i).alias("rule"))))
        if r.exclusive:
            blocked = blocked | hit
    # Columns of the input with these names give way to the made ones.
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in ("name", "kind", "rule")]
    found = lines.select(*kept, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("_made"))
    return found.select(*kept, "_made.name", "_made.kind", "_made.rule")


def multi_name_list(text: Column, rule: Rule) -> Column:
    """The names of a multi-line rule as an array, where no lines or scopes are asked for; null for null."""
    from symloom.functions.regex import to_java

    g = int(rule.name[1:]) if re.fullmatch(r"\\\d", rule.name) else 0
    return F.regexp_extract_all(text, F.lit(to_java(rule.pattern, rule.icase, lines=False)), g)
