"""Text functions of screen elements as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column) -> Column:
    """Lower-cased letter by letter (no final sigma), letters and numbers only."""
    return F.regexp_replace(F.lower(F.translate(s, "Σ", "σ")), r"[^\p{IsAlphabetic}\p{N}]", "")


def normalized_equal(a: Column, b: Column) -> Column:
    """Both there, neither normally empty, and equal so; never null."""
    return F.coalesce((normalize(a) == normalize(b)) & (normalize(a) != ""), F.lit(False))


def roles_compatible(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | normalized_equal(a, b)


def exact_key(text: Column, role: Column) -> Column:
    """(text, role) by which a lost element is found again; null where it can't be."""
    t, r = normalize(text), normalize(role)
    return F.when(t.isNull() | (t == "") | (role.isNotNull() & (r == "")), F.lit(None)).otherwise(F.struct(t.alias("text"), r.alias("role")))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def spoken(s: Column) -> Column:
    """Holds a letter or number once trimmed."""
    return F.coalesce(trimmed(s).rlike(r"[\p{IsAlphabetic}\p{N}]"), F.lit(False))


def line_disposition(text: Column, has_region: Column) -> Column:
    return F.when(text.isNull(), "missing").when(~has_region, "geometry_clamp").when(~spoken(text), "text_filter").otherwise("emitted")


def quantized(confidence: Column) -> Column:
    """To tenths, in single precision, halves away from zero."""
    ten = F.lit(10).cast("float")
    return (F.round(confidence.cast("float") * ten) / ten).cast("float")


def state_text(s: Column) -> Column:
    """One line: \\e for empty, else JSON's escapes without the quotes."""
    inner = F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    for x in "ABCDEF":  # escapes of control characters are written with small letters
        inner = F.replace(F.replace(inner, F.lit(f"\\u000{x}"), F.lit(f"\\u000{x.lower()}")), F.lit(f"\\u001{x}"), F.lit(f"\\u001{x.lower()}"))
    return F.when(s == "", F.lit("\\e")).when(s.isNotNull(), inner)


def element_id(n: Column) -> Column:
    return F.format_string("e%06d", n)


def element_number(s: Column) -> Column:
    """The number of a canonical id: at least six digits, no longer than needed, not zero; else null."""
    n = F.regexp_extract(s, r"^e([0-9]{6,18})$", 1)
    v = F.when(n != "", n.cast("long"))
    return F.when((v > 0) & (F.format_string("e%06d", v) == s), v)


def same_map(a: Column, b: Column) -> Column:
    """Null-safe equality of maps."""
    flat = lambda m: F.array_sort(F.map_entries(m))
    return flat(a).eqNullSafe(flat(b))


def same_content(a: str, b: str, state: bool = False) -> Column:
    """Equal text, role, confidence to tenths and, with state, map of states, missing values being equal to one another; boxes don't count. a and b: prefixes of
    columns txt, role, conf, state."""
    same = F.lit(True)
    for c in ("txt", "role"):
        same = same & F.col(a + c).eqNullSafe(F.col(b + c))
    same = same & quantized(F.col(a + "conf")).eqNullSafe(quantized(F.col(b + "conf")))
    return same & same_map(F.col(a + "state"), F.col(b + "state")) if state else same


def little_endian(n: Column, size: int) -> Column:
    """A whole number's lowest `size` bytes, the lowest first, as binary."""
    digits = F.right(F.lpad(F.hex(n), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1))))


def lost_priority(text: Column, role: Column, x: Column, y: Column, w: Column, h: Column, number: Column, domain: bytes) -> Column:
    """SHA-256 (hex) by which lost elements are given up, the largest first; text and role are normal forms, a missing role null. Hex sorts as the bytes do."""
    sized = lambda s: F.concat(little_endian(F.octet_length(s).cast("long"), 8), s.cast("binary"))
    known = F.when(role.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), sized(F.coalesce(role, F.lit("")))))
    return F.sha2(F.concat(F.unhex(F.lit(domain.hex())), sized(text), known, *(little_endian(v, 4) for v in (x, y, w, h)), little_endian(number, 8)), 256)
