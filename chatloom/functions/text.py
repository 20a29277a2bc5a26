"""String expressions with Python str semantics, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.schema import WS_CLASS_JAVA as WS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """``str.strip()``: trims Unicode whitespace (``trim`` only trims ASCII space).

    The regex runs only when the first or last character is whitespace; a scan of every
    position of a long text is the slow part otherwise.
    """
    c = _c(col)
    edge = F.substring(c, 1, 1).rlike(f"(?U){WS}") | F.substring(c, -1, 1).rlike(f"(?U){WS}")
    return F.when(edge, F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")).otherwise(c)


def tokens(col) -> Column:
    """``set(text.lower().split())`` as a sorted-free distinct array of strings."""
    parts = F.split(F.lower(_c(col)), f"(?U){WS}+")
    return F.array_distinct(F.array_remove(parts, ""))


def py_repr(col) -> Column:
    """``repr(str)``: quotes, backslashes, and escapes for characters that do not print."""
    c = F.replace(_c(col), F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(code))

    def one(ch: Column) -> Column:
        point = F.ascii(ch)
        code = (F.when(point < 0x100, F.format_string("\\x%02x", point)).when(point < 0x10000, F.format_string("\\u%04x", point))
                .otherwise(F.format_string("\\U%08x", point)))
        return F.when(ch.rlike(_UNPRINTED), code).otherwise(ch)

    c = bind(c, lambda t: F.when(t.rlike(_UNPRINTED), F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1)), one), "")).otherwise(t))
    double = F.concat(F.lit('"'), c, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    raw = _c(col)
    return F.when((F.instr(raw, "'") > 0) & (F.instr(raw, '"') == 0), double).otherwise(single)


#: Characters that repr() escapes: controls, formats, unassigned ones, and all separators but the space.
_UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def fill(template: str, **cols) -> Column:
    """Column-wise ``str.format``: every placeholder of ``template`` is a key of ``cols``."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            v = cols[field]
            parts.append(v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*parts)


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a let-binding through a one-element
    ``transform``), so an expensive expression is not copied into every use."""
    return F.get(F.transform(F.array(value), fn), 0)
