"""String expressions: strip, CSV preview split, UTF-8 repair, user-id slug."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Python ``str.strip()`` removes: derived from Python's own rule.
PY_SPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())
# Characters a JavaScript ``String.prototype.trim()`` removes (WhiteSpace and
# LineTerminator of the language spec): tab, VT, FF, space, NBSP, BOM, the Zs
# category, LF, CR, LS, PS.
JS_SPACE = ("\t\x0b\x0c \xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
            + "\u202f\u205f\u3000\n\r\u2028\u2029")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` only removes spaces."""
    return F.btrim(_c(c), F.lit(PY_SPACE))


def js_trim(c: Column | str) -> Column:
    return F.btrim(_c(c), F.lit(JS_SPACE))


def utf8_lossy(content: Column | str) -> Column:
    """Decode bytes as UTF-8, replacing invalid sequences with U+FFFD."""
    return F.make_valid_utf8(_c(content).cast("string"))


def csv_line_cells(line: Column | str) -> Column:
    """Cells of one preview line: split on every comma (quotes do not protect), trim, and
    take off one leading and one trailing double quote.  A line of printable ASCII without blanks and
    quotes has nothing to trim or take off, so its cells need no work each."""
    plain = _c(line).rlike(r"\A[!#-~]*\z")
    return F.when(plain, F.split(line, ",")).otherwise(
        F.transform(F.split(js_trim(line), ","), lambda c: F.regexp_replace(js_trim(c), '^"|"$', "")))


def user_slug(email: Column | str) -> Column:
    """Local part of the e-mail with '.' and '-' turned into '_'."""
    return F.translate(F.substring_index(_c(email), "@", 1), ".-", "__")


def slug_root(slug: Column | str) -> Column:
    """The base with every trailing ``_<digits>`` removed: ids can only collide
    with suffix forms inside one root."""
    return F.regexp_replace(_c(slug), "(_[0-9]+)+$", "")


def has_quote(c: Column | str) -> Column:
    return F.coalesce(F.contains(_c(c), F.lit("'")), F.lit(False))
