"""The search pattern of a line, for code that runs row by row beside the column form of the writers."""

from __future__ import annotations

LIMIT = 96


def search_pattern(line: str, limit: int = LIMIT) -> str:
    """As ``operators.writers.pattern_of``: escaped, cut after ``limit`` bytes at a character border."""
    line = line.rstrip("\r\n")
    raw = line.encode("utf-8", "surrogatepass")
    long = bool(limit) and len(raw) > limit
    if long:
        end = limit
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        line = raw[:end].decode("utf-8", "surrogatepass")
    body = line.replace("\\", "\\\\").replace("/", "\\/")
    if body.endswith("$"):
        body = body[:-1] + "\\$"
    return "/^" + body + ("" if long else "$") + "/"
