"""String and regular-expression functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(s: Column, pos: Column, length: Column | None = None) -> Column:
    """From a place that counts from the end when negative; 0 is 1."""
    return F.substr(s, pos, length) if length is not None else F.substr(s, pos)


def substrb(s: Column, pos: Column, length: Column) -> Column:
    """By bytes of UTF-8; broken characters are replaced."""
    return F.decode(F.substr(F.encode(s, "UTF-8"), pos, length), "UTF-8")


def places(s: Column, sub: Column) -> Column:
    """All places (from 1) at which sub starts, overlaps included."""
    n = F.length(s) - F.length(sub) + 1
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.length(sub)) == sub))


def instr(s: Column, sub: Column, start: int = 1, nth: int = 1) -> Column:
    """The nth place of sub from start on; with a negative start backwards from that many characters before the end."""
    if start == 1 and nth == 1:
        return F.instr(s, sub)
    found = places(s, sub)
    if start > 0:
        picked = F.get(F.filter(found, lambda i: i >= start), F.lit(nth - 1))
    else:
        picked = F.get(F.reverse(F.filter(found, lambda i: i <= F.length(s) + F.lit(start + 1))), F.lit(nth - 1))
    return F.when(s.isNotNull() & sub.isNotNull(), F.coalesce(picked, F.lit(0)))


def instrb(s: Column, sub: Column, start: int = 1, nth: int = 1) -> Column:
    """instr() by bytes of UTF-8: the bytes as characters of their own."""
    as_letters = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return instr(as_letters(s), as_letters(sub), start, nth)


def locate(sub: Column, s: Column, start: int = 1) -> Column:
    return instr(s, sub, start)


def find_in_set(s: Column, names: Column) -> Column:
    """The place of s in a list with commas; 0 where it isn't there or holds a comma."""
    return F.find_in_set(s, names)


def char(n: Column) -> Column:
    """The character of a code point; null for null and for what is none."""
    return F.when(n.between(0, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32"))


def space(n: Column) -> Column:
    return F.when(n.isNotNull(), F.lpad(F.lit(""), F.greatest(n.cast("int"), F.lit(0)), F.lit(" ")))


def like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE ... ESCAPE: the sign behind the escape sign is itself. Without one, a backslash is an ordinary sign."""
    return F.like(s, F.lit(pattern if escape else pattern.replace("\\", "\\\\")), F.lit(escape or "\\"))


def vsize(c: Column) -> Column:
    """Bytes of the value as text."""
    return F.octet_length(c.cast("string"))


def insert(s: Column, pos: Column, length: Column, new: Column) -> Column:
    return F.overlay(s, new, pos, length)


def ltrim(s: Column, letters: str = " ") -> Column:
    return F.ltrim(s, F.lit(letters))


def rtrim(s: Column, letters: str = " ") -> Column:
    return F.rtrim(s, F.lit(letters))


def trim(s: Column, letters: str = " ") -> Column:
    return F.btrim(s, F.lit(letters))


def _wide() -> tuple[str, str]:
    narrow = "".join(map(chr, range(0x20, 0x7F)))
    return narrow, "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def to_multi_byte(s: Column) -> Column:
    return F.translate(s, *_wide())


def to_single_byte(s: Column) -> Column:
    return F.translate(s, *reversed(_wide()))


def asciistr(s: Column) -> Column:
    """Characters beyond ASCII as a backslash and four hex digits for each UTF-16 unit."""

    def one(c):
        units = F.hex(F.encode(c, "UTF-16BE"))
        return F.when(c.rlike(r"^[\x00-\x7f]$"), c).when(F.length(units) == 4, F.concat(F.lit("\\"), units)).otherwise(F.concat(F.lit("\\"), F.left(units, F.lit(4)), F.lit("\\"), F.right(units, F.lit(4))))

    return F.when(s.isNotNull(), F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), ""))


def regexp_count(s: Column, pattern: str, pos: int = 1, flags: str = "") -> Column:
    return F.regexp_count(F.substr(s, F.lit(pos)), F.lit(_flagged(pattern, flags)))


def regexp_substr(s: Column, pattern: str, pos: int = 1, occurrence: int = 1, flags: str = "", sub: int = 0) -> Column:
    """The nth match, or a group of it; null where there is none."""
    return F.get(F.regexp_extract_all(F.substr(s, F.lit(pos)), F.lit(_flagged(pattern, flags)), F.lit(sub)), F.lit(occurrence - 1))


def regexp_instr(s: Column, pattern: str, pos: int = 1, occurrence: int = 1, after: bool = False, flags: str = "") -> Column:
    """Where the nth match starts (or, with after, the place behind it); 0 where there is none."""
    rest, found_by = F.substr(s, F.lit(pos)), _flagged(pattern, flags)
    found = F.regexp_extract_all(rest, F.lit(found_by), F.lit(0))
    parts = F.split(rest, found_by)
    before = F.aggregate(F.slice(parts, 1, occurrence), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, occurrence if after else occurrence - 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.size(found) >= occurrence, before + pos).when(s.isNotNull(), F.lit(0))


def regexp_replace(s: Column, pattern: str, new: str = "", flags: str = "") -> Column:
    return F.regexp_replace(s, _flagged(pattern, flags), new)


def _flagged(pattern: str, flags: str) -> str:
    """Match parameters: i (no case), c (case), n (dot matches line feeds), m (lines), x (white space ignored)."""
    java = "".join({"i": "i", "n": "s", "m": "m", "x": "x"}.get(f, "") for f in flags)
    return f"(?{java}){pattern}" if java else pattern
