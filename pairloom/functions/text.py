"""Names, sizes and other texts as column expressions."""

from __future__ import annotations

from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"


def base_name(name: Column) -> Column:
    """The name without its last suffix: ``a.MP.jpg`` gives ``a.MP``, ``.jpg`` gives an empty base."""
    return F.regexp_replace(name, r"[.][^.]*$", "")


def extension(name: Column) -> Column:
    """The last suffix with its dot, or nothing."""
    return F.regexp_extract(name, r"([.][^.]*)$", 1)


@lru_cache(1)
def capitals() -> tuple[str, str]:
    """Letters and, place by place, their capitals: one character for one, ASCII only for ASCII.

    So ß, whose capitals are two, and ı and ſ, whose capitals would be ASCII, stay as they are.
    """
    pairs = []
    for code in range(0x1F000):
        letter = chr(code)
        capital = letter.upper() if len(letter.upper()) == 1 else letter.title()
        if len(capital) == 1 and capital != letter and (code < 128) == (ord(capital) < 128):
            pairs.append((letter, capital))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """The key under which names are equal whatever their case: each character's own capital, in any language."""
    return F.translate(text, *capitals())


def sort_key(text: Column) -> Column:
    """The key that orders names whatever their case, an underscore after letters, by their UTF-16 units."""
    return F.encode(folded(text), "UTF-16BE")


def ends_with_any(text: Column, endings: list[str]) -> Column:
    """Whether the text ends in one of ``endings``, whatever its case."""
    found = F.lit(False)
    for ending in endings:
        found = found | F.lower(text).endswith(ending)
    return found


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def or_else(text: Column, other: Column) -> Column:
    """The text, or ``other`` where it is null or blank."""
    return F.when(is_blank(text), other).otherwise(text)


def or_unknown(text: Column) -> Column:
    return or_else(text, F.lit(UNKNOWN))


def shortened(name: Column, head: int = 22, tail: int = 8, longest: int = 30) -> Column:
    """A name whose base is over ``longest``: its first ``head`` characters, ``...``, its last ``tail``, its suffix."""
    base = base_name(name)
    return F.when(F.length(base) <= longest, name).otherwise(
        F.concat(F.substring(base, 1, head), F.lit("..."), F.right(base, F.lit(tail)), extension(name))
    )


def quotient(number: Column, divisor: int) -> Column:
    """The whole part of a 64-bit number's division, exact, as no double is between."""
    return F.call_function("div", number, F.lit(divisor))


def kb_or_mb(size: Column) -> Column:
    """A size below 1 MiB in KB with one decimal, else in MB with two. Halves are rounded up, in whole numbers."""
    s = size.cast("long")
    kb = quotient(s * 20 + 1024, 2048)
    mb = quotient(s * 200 + 1048576, 2097152)
    kb_text = F.concat(quotient(kb, 10).cast("string"), F.lit("."), (kb % 10).cast("string"), F.lit(" KB"))
    mb_text = F.concat(quotient(mb, 100).cast("string"), F.lit("."), F.lpad((mb % 100).cast("string"), 2, "0"), F.lit(" MB"))
    return F.when(s < 1048576, kb_text).otherwise(mb_text)


def byte_size(size: Column) -> Column:
    """A size in the largest of B, KB, MB, GB and TB that leaves at least 1, with two decimals.

    Null and negative sizes are unknown. Halves are rounded up, in whole numbers.
    """
    s = size.cast("decimal(38,0)")
    out = F.when(size.isNull() | (size < 0), F.lit(UNKNOWN))
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scale = 1024**power
        halves = s * 200 + scale
        hundredths = (halves - halves % (2 * scale)) / F.lit(2 * scale).cast("decimal(20,0)")  # exact, as nothing remains
        text = F.concat((hundredths * F.lit(Decimal("0.01"))).cast("decimal(38,2)").cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == "TB" else out.when(size < 1024 ** (power + 1), text)
    return out


def duration(seconds: Column) -> Column:
    """Whole seconds as ``{days}d hh:mm:ss``."""
    s = seconds.cast("long")

    def part(unit: int, most: int) -> Column:
        return F.lpad((F.floor(s / unit).cast("long") % most).cast("string"), 2, "0")

    return F.concat(F.floor(s / 86400).cast("string"), F.lit("d "), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60))


def iso_time(time: Column) -> Column:
    """A time with date, seven decimals of a second and offset: ``2024-01-31T07:08:09.1234560+00:00``."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"), F.date_format(time, "xxx"))


def fixed(value: Column, decimals: int) -> Column:
    """A number with so many decimals, halves rounded away from zero; null is nothing."""
    return F.coalesce(F.round(value, decimals).cast(f"decimal(30,{decimals})").cast("string"), F.lit(""))


def formatted(template: Column, *arguments: Column, most_decimals: int = 3) -> Column:
    """A template with its items replaced in one pass: ``{0}``, ``{1}``, ..., and ``{0:F1}``, ``{0:F2}``, ... with decimals.

    ``{{`` and ``}}`` are braces. What an argument contains is never taken for an item. Null is nothing; an item
    without an argument, or with another format, stays as it is. A number without a
    format is shown as it is; decimals from 0 to ``most_decimals`` are known, of numeric arguments only.
    """
    parts = F.regexp_extract_all(template, F.lit(r"(?s)(\{\{|\}\}|\{[0-9]+(?::[Ff][0-9])?\}|[^{}]+|[{}])"), F.lit(1))

    def shown(part: Column) -> Column:
        out = F.when(part == "{{", "{").when(part == "}}", "}")
        for n, argument in enumerate(arguments):
            out = out.when(part == "{%d}" % n, F.coalesce(argument.cast("string"), F.lit("")))
            for d in range(most_decimals + 1):
                out = out.when(F.upper(part) == "{%d:F%d}" % (n, d), fixed(argument.try_cast("decimal(30,10)"), d))
        return out.otherwise(part)

    return F.array_join(F.transform(parts, shown), "")
