"""Personal data: plain and disguised identifiers, as spans of the original text.

Plain identifiers are found on the text as it stands. A transducer then rewrites
the text: characters that look like ASCII become ASCII and invisible ones go,
spelled digits become digits, and words for ``@`` and ``.`` become these.
It carries, for each character that it writes, the span of source characters
that it stands for, so what the same detectors find on the rewritten text maps
back to spans of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int, disguised: boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters that look like ASCII letters but that NFKC leaves as they are, and words for digits.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".",
    " ": " ", " ": " ", " ": " ",
}
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

#: Letters that a search without case takes for ASCII ones.
FOLDED = {ord(a): b for a, b in zip("ſİıK", "siik", strict=True)}

ODD = re.compile("[" + re.escape("".join(sorted({*LOOKALIKES, *INVISIBLE}))) + "！-～٠-٩۰-۹०-९⁰-⁹₀-₉①-⑨\U0001d400-\U0001d7ff]")


def by_first_letter(words: Iterable[str]) -> str:
    """An expression for any of the words that looks at a letter once."""
    of: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        of.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{a}(?:{'|'.join(b)})" for a, b in of.items()) + ")"


ONE_SPELLED = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Of any length: whether it is a number is for the detectors to say.
SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_]){ONE_SPELLED}(?![^\W_])(?:[\x20,-]{{1,2}}{ONE_SPELLED}(?![^\W_]))*+")
SPELLED_WORD = re.compile(rf"(?i){ONE_SPELLED}")
PLUS = re.compile(r"(?i)(?<![A-Za-z0-9])plus\x20?(?=[0-9])")
NEAR = r"[A-Za-z0-9-]"
MARKED_AT = re.compile(rf"(?i)(?<={NEAR})\x20?(?:\(\x20?(?:at|@|arroba)\x20?\)|\[\x20?(?:at|@|arroba)\x20?\]|\{{\x20?(?:at|@|arroba)\x20?\}}|<\x20?at\x20?>|_at_)\x20?(?={NEAR})")
MARKED_DOT = re.compile(rf"(?i)(?<={NEAR})\x20?(?:\(\x20?(?:dot|\.|punto|punkt|point)\x20?\)|\[\x20?(?:dot|\.|punto|punkt|point)\x20?\]|\{{\x20?(?:dot|\.|punto|punkt|point)\x20?\}}|<\x20?dot\x20?>|_dot_)\x20?(?={NEAR})")
#: Bare words count only together: ``name at host dot domain``, where the dot may be a marked one, or a dot within a number.
BARE = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\x20(?:at|arroba)\x20|@)[A-Za-z0-9-]++(?:(?:\x20(?:dot|punto|punkt|point)\x20|\.)[A-Za-z0-9-]++)++")
BARE_DOT = re.compile(r"(?i)\x20(?:dot|punto|punkt|point)\x20")
NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])\x20?(?:dot|punto|punkt|point)\x20?(?=[0-9])")
#: What a text in lower case has if anything in it is marked as ``@``, a dot or a plus ...
TRIGGER = re.compile(r"[(\[{<_]\x20?(?:at|@|arroba|dot|\.|punto|punkt|point)\x20?[)\]}>_]|\x20(?:dot|punto|punkt|point)\x20|[0-9](?:dot|punto|punkt|point)[0-9]|plus\x20?[0-9]")
#: ... or if a spelled digit belongs to a number: no identifier has a single digit, so another one, spelled or not, stands beside it.
BETWEEN = r"(?:[\x20,().\[\]{}<>_+-]|dot|punto|punkt|point|plus)*+"
SPELLED_NUMBER = re.compile(rf"[\W_]{by_first_letter(SPELLED)}(?![^\W_]){BETWEEN}(?:[0-9]|{ONE_SPELLED}(?![^\W_]))")
NUMBER_SPELLED = re.compile(rf"[0-9]{BETWEEN}(?<![^\W_]){ONE_SPELLED}(?![^\W_])")


def in_lower_case(text: str) -> str:
    """As long as ``text``, with a letter that a search without case takes for an ASCII one as that."""
    for odd, plain in FOLDED.items():
        text = text.replace(chr(odd), plain)
    return text.lower()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """A name is the whole run before an @, so each @ needs one look back and one match onwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = start < at and DOMAIN.match(text, at + 1)
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the identifiers that stand there openly, by kind, then start."""
    out = [("email", *s) for s in find_emails(text)]
    for m in IP.finditer(text):
        # More digits than an integer may be read from are more than 255 unless they are zeros.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= len(digits := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


class Rewritten:
    """A text, and for each of its characters the source characters that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """``start, end, new``, in order. The new characters share the source of all that they replace."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            text += [self.text[at:start], new]
            starts += [*self.starts[at:start], *[self.starts[start]] * len(new)]
            ends += [*self.ends[at:start], *[self.ends[end - 1]] * len(new)]
            at = end
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def look_alikes(self) -> None:
        edits = []
        for m in ODD.finditer(self.text):
            new = "" if m[0] in INVISIBLE else LOOKALIKES.get(m[0]) or unicodedata.normalize("NFKC", m[0])
            if new.isascii() or new.isdecimal():
                edits.append((m.start(), m.end(), new if new.isascii() else str(unicodedata.digit(new))))
        self.replace(edits)

    def spelled_digits(self) -> None:
        edits = []
        for m in SPELLED_RUN.finditer(self.text):
            at = m.start()
            for w in SPELLED_WORD.finditer(m[0]):
                edits.append((at, m.start() + w.end(), SPELLED[w[0].translate(FOLDED).lower()]))
                at = m.start() + w.end()
        self.replace(edits)
        self.replace([(m.start(), m.end(), "+") for m in PLUS.finditer(self.text)])

    def at_and_dot(self) -> None:
        self.replace([(m.start(), m.end(), "@") for m in MARKED_AT.finditer(self.text)])
        self.replace([(m.start(), m.end(), ".") for m in MARKED_DOT.finditer(self.text)])
        self.replace([(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(self.text)])
        edits = []
        for m in BARE.finditer(self.text):
            dots = [(m.start() + d.start(), m.start() + d.end(), ".") for d in BARE_DOT.finditer(m[0], m.end(1) - m.start())]
            marked = any(self.text[i] == "." and self.ends[i] - self.starts[i] > 1 for i in range(m.end(1), m.end()))
            if dots or marked:
                edits += [*([(m.start(1), m.end(1), "@")] if len(m[1]) > 1 else []), *dots]
        self.replace(edits)


def is_disguised(text: str) -> bool:
    """Whether rewriting can make an identifier: all texts are searched for this, few are rewritten."""
    if not text.isascii() and ODD.search(text):
        return True
    low = " " + in_lower_case(text)
    return any(p.search(low) for p in (TRIGGER, SPELLED_NUMBER, NUMBER_SPELLED))


def not_within(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> Iterator[bool]:
    """For each of ``spans``, in order of start, whether none of ``others``, in order of start, contains it: one sweep over both."""
    reach, k = -1, 0
    for start, end in spans:
        while k < len(others) and others[k][0] <= start:
            reach = max(reach, others[k][1])
            k += 1
        yield end > reach


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows and that no plain span contains."""
    if not is_disguised(text):
        return []
    new = Rewritten(text)
    new.look_alikes()
    new.spelled_digits()
    new.at_and_dot()
    found = []
    for kind, start, end in plain_spans(new.text):
        source = new.starts[start], new.ends[end - 1]
        if text[source[0] : source[1]] != new.text[start:end]:
            found.append((*source, kind))
    found.sort()
    alone = not_within([s[:2] for s in found], sorted((s, e) for _, s, e in plain))
    return [(kind, start, end) for (start, end, kind), free in zip(found, alone, strict=True) if free]


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, disguised`` by kind as in ``KINDS``, then start."""
    plain = plain_spans(text or "")
    found = [(*s, False) for s in plain] + [(*s, True) for s in disguised_spans(text or "", plain)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans``.

    A span has the kind, the code points where it starts and ends (exclusive)
    in the original text, and whether it was disguised. Plain spans of one kind
    don't overlap; no disguised span lies within a plain one. Null and empty texts have
    none. Repeated rows and other columns don't matter.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "disguised"), s, strict=True)) for s in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, SCHEMA)


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts by kind over all spans, the plain spans' digest, and all spans as one string; without spans zeros, the digest of the empty string, and that. Rows stay one by one, null ids too."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.filter("spans", lambda s: ~s["disguised"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
