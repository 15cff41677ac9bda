"""Character references of HTML in column functions: all names of the standard's table, decimal and hexadecimal numbers.

A text is split at what looks like a reference; each is decoded and the parts are
joined again. Names come from the table of Python's standard library, as one map
literal.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: A reference: a number, or up to 32 characters that may be a name; with a semicolon or without.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that are known without a semicolon are this long.
LEGACY = {n: sign for n, sign in html5.items() if not n.endswith(";")}
LENGTHS = sorted({len(n) for n in LEGACY}, reverse=True)
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def windows_sign(code: int) -> str:
    """What a number between 128 and 159 stands for: a sign of code page 1252, where that has one."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def of_number(code: Column) -> Column:
    """The character of a code point as browsers read it: nothing for control characters and those that are none."""
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    signs = F.array(*(F.lit(windows_sign(c)) for c in range(128, 160)))
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
        .when(code.between(128, 159), F.get(signs, (code - 128).cast("int")))
        .when(none, "")
        .otherwise(sign)
    )


def of_digits(body: Column) -> Column:
    digits = F.regexp_replace(body, "^#[xX]?0*|;$", "")
    number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    return let(F.when(digits == "", F.lit(0).cast("long")).when(F.length(digits) > 7, F.lit(0x110000).cast("long")).otherwise(number), of_number)


def decoded(reference: Column) -> Column:
    """One reference, or itself where it is none. A name without semicolon may have letters after it: the longest known one counts."""
    body = F.substr(reference, F.lit(2))
    known, short = table(html5), table(LEGACY)
    begins = [F.when(F.length(body) > n, F.concat(F.try_element_at(short, F.substring(body, 1, n)), F.substr(body, F.lit(n + 1)))) for n in LENGTHS]
    return F.when(F.startswith(body, F.lit("#")), of_digits(body)).otherwise(F.coalesce(F.try_element_at(known, body), *begins, reference))


def unescape(text: Column) -> Column:
    """``text`` with its character references written out, each once; null stays null."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), 0)
    parts = F.split(text, REFERENCE)
    joined = let(found, lambda refs: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(decoded(F.get(refs, i)), F.lit("")))), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
