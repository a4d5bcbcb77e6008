"""Column expressions for text with web-script whitespace and string rules.

Everything here stays inside Catalyst; no Python runs per row.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space code points that trimming and `\s` cover.
WS_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)
WS_CHARS = "".join(chr(c) for c in WS_CODES)
# The same set as a character class; ranges and `\\s` keep it short, which matters in both regex engines.
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

PAGE_JOINER = "\n\n"
MIN_TERM_CHARS = 3
TERM_CHARS = string.ascii_lowercase + string.digits


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use `value` several times but compute it once (lambdas get no common-subexpression elimination)."""
    return F.transform(F.array(value), body)[0]


def trim_ws(c: Column) -> Column:
    """Trim every white-space character (Spark's `trim` knows only the blank)."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse white-space runs to one blank and trim."""
    return trim_ws(F.regexp_replace(c, WS + "+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(trim_ws(c)), F.lit(0)) == 0


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def clip(c: Column, n: int | Column) -> Column:
    return F.substring(c, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def last_index(hay: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when absent."""
    return let(
        F.instr(F.reverse(hay), F.lit(needle[::-1])),
        lambda hit: F.when(hit == 0, F.lit(-1)).otherwise(F.length(hay) - hit + 1 - len(needle)),
    )


def tokens_of(c: Column) -> Column:
    """Lower-cased [a-z0-9] words of at least three characters, in order, repeats kept.

    Other characters are taken out of a word. They are what is left of a text without letters, digits and white space;
    patterns for that and for the cuts take more than twice as long.
    """

    def plain(text: Column) -> Column:
        other = F.translate(text, TERM_CHARS + WS_CHARS, "")
        return F.translate(F.call_function("translate", text, other, F.lit("")), WS_CHARS, " " * len(WS_CHARS))

    return F.filter(F.split(let(F.lower(c), plain), " "), lambda w: F.length(w) >= MIN_TERM_CHARS)


def place_of(high: Column, low: Column) -> Column:
    """One number in the order of two integers, `low` not negative; a null `high` comes first.

    The least of such numbers is found by hashing, the least of pairs by sorting all rows.
    """
    return F.coalesce(high.cast("long"), F.lit(-(1 << 31) - 1)) * F.lit(1 << 31) + low


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: F.length(w) > 0)


def quote_regex(c: Column) -> Column:
    """Turn a search term into a pattern that matches it literally."""
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|\-#&~])", r"\\$1")


def nonempty(c: Column, default: Column) -> Column:
    """`c`, or the default when it is null or the empty string."""
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)
