"""Escapes of the index format, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters with a short escape.
SHORT = {"\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r"}


def escape(c: Column) -> Column:
    """Backslash and control characters escaped: short forms where there are, else ``\\xHH``."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for n in [*range(1, 32), 127]:
        ch = chr(n)
        out = F.replace(out, F.lit(ch), F.lit("\\" + SHORT[ch] if ch in SHORT else f"\\x{n:02X}"))
    return F.when(c.rlike(r"[\x01-\x1f\x7f\\]"), out).otherwise(c)


def escape_name(c: Column) -> Column:
    """As :func:`escape`; a leading blank or ``!``, which would read as a header, becomes ``\\x20`` or ``\\x21``."""
    e = escape(c)
    return F.when(c.startswith(" "), F.concat(F.lit("\\x20"), F.substr(e, F.lit(2)))).when(c.startswith("!"), F.concat(F.lit("\\x21"), F.substr(e, F.lit(2)))).otherwise(e)


def unescape(c: Column) -> Column:
    """The text of an escaped value; unknown escapes and ``\\xHH`` from 80 on stay as they are."""

    def piece(p: Column) -> Column:
        out = reduce(lambda x, kv: F.replace(x, F.lit("\\" + kv[1]), F.lit(kv[0])), SHORT.items(), p)
        parts = F.split(out, r"\\x", -1)
        first = F.get(parts, F.lit(0))

        def code(x: Column) -> Column:
            n = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
            return F.when(x.rlike("^[0-7][0-9A-Fa-f]") & ~x.startswith("00"), F.concat(F.chr(n), F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("\\x"), x))

        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), code)
        return F.when(F.contains(out, F.lit("\\x")), F.concat(first, F.array_join(rest, ""))).otherwise(out)

    # Escaped backslashes are split off first, so that what follows them is no escape.
    pieces = F.transform(F.split(c, r"\\\\", -1), piece)
    return F.when(F.contains(c, F.lit("\\")), F.array_join(pieces, "\\")).otherwise(c)
