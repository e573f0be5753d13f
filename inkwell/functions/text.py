"""Column functions on lines of text: predicates, normalization and n-grams, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFKC", "NFC")

#: White space and punctuation that the emoji test skips, as a regular expression class.
_SKIPPED = (
    r"\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x{A0}\x{1680}\x{2000}-\x{200A}\x{2010}-\x{2029}"
    r"\x{202F}-\x{205F}\x{2190}-\x{2BFF}\x{3000}-\x{303F}"
)
#: What counts as emoji besides: digits, five symbols, joiners and selectors, and the emoji planes.
_EMOJI = r"0-9\x{A9}\x{AE}\x{2122}\x{2139}\x{3297}\x{3299}\x{200D}\x{FE0F}\x{20E3}\x{1F000}-\x{1FAFF}"
EMOJI_ONLY = f"^[{_SKIPPED}{_EMOJI}]*[{_EMOJI}][{_SKIPPED}{_EMOJI}]*$"
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
#: Control and format characters; the last two ranges are newer than the JVM's tables.
_ASCII_CONTROL = r"[\x00-\x1F\x7F]"
_CONTROL = r"[\p{Cc}\p{Cf}\x{890}-\x{891}\x{13439}-\x{1343F}]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_blank(line: Column) -> Column:
    """Only ASCII white space, or nothing."""
    return ~line.rlike(NOT_BLANK)


def is_emoji_only(line: Column) -> Column:
    """At least one emoji, and nothing else but white space and punctuation. Digits count as emoji."""
    # most lines hold a letter, which settles it at the first one
    return F.when(line.rlike("[A-Za-z]"), F.lit(False)).otherwise(line.rlike(EMOJI_ONLY))


def is_excluded(line: Column, min_length: int = 0, max_length: int = 0) -> Column:
    """Whether a line is dropped: at most one byte, emoji only, or out of the bounds in bytes (0: no bound)."""
    size = F.octet_length(line)
    bad = (size <= 1) | is_emoji_only(line)
    if min_length > 0:
        bad = bad | (size < min_length)
    if max_length > 0:
        bad = bad | (size > max_length)
    return bad


def composed(text: Column, form: str = "NFKC") -> Column:
    """Unicode normalization by the ICU library that Spark carries; plain ASCII is left as it is."""
    if form not in FORMS:
        raise ValueError(f"unknown normalization form {form!r}")
    name = F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose")
    return F.when(_is_ascii(text), text).otherwise(F.java_method(*name, text, F.lit(form == "NFKC")))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalized_line(line: Column, form: str = "NFKC") -> Column:
    """The normalized line, or null if the line is dropped. Tabs separate fields, and an empty field drops the line.

    Fields lose control and format characters; in NFKC a field without ASCII
    digits is lower-cased. A null line stays null.
    """
    return _let(F.make_valid_utf8(line), lambda valid: _normalized(valid, form))


def _normalized(valid: Column, form: str) -> Column:
    drop = is_blank(valid) | (F.length(valid) <= 1)

    def stripped(x: Column) -> Column:
        plain = F.when(_is_ascii(x), F.regexp_replace(x, _ASCII_CONTROL, "")).otherwise(F.regexp_replace(composed(x, form), _CONTROL, ""))
        return _let(plain, lambda p: F.when(p.rlike("[0-9]"), p).otherwise(F.lower(p))) if form == "NFKC" else plain

    def joined(fields: Column) -> Column:
        return F.when(~F.exists(fields, lambda x: x == ""), F.array_join(F.transform(fields, stripped), "\t"))

    alone = F.when(~(valid.rlike(r"^[\x{10000}-\x{10FFFF}]") & is_emoji_only(valid)), stripped(valid))
    whole = F.when(F.contains(valid, F.lit("\t")), _let(F.split(valid, "\t", -1), joined)).otherwise(alone)
    return F.when(valid.isNotNull() & ~drop, whole)


def ngrams(text: Column, n: int) -> Column:
    """All windows of ``n`` code points; no windows if the text is shorter, empty or null, or n < 1."""
    if n < 1:
        return F.array().cast("array<string>")
    # each match takes one code point and looks ahead at its window: one walk over the text, where a substring counts from the start
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def occurrences(text: Column, pattern: Column) -> Column:
    """Non-overlapping occurrences of ``pattern`` from left to right; none of the empty pattern."""
    gone = F.length(text) - F.length(F.replace(text, pattern, F.lit("")))
    return F.when(F.length(pattern) > 0, F.expr("0") + (gone / F.length(pattern)).cast("long")).otherwise(F.lit(0).cast("long"))


def line_hash(text: Column) -> Column:
    """XXH64 with seed 0 of the UTF-8 bytes, as an unsigned decimal; Spark's own hash has another seed."""
    import xxhash

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else str(xxhash.xxh64_intdigest(s.encode())) for s in batch.to_pylist()], pa.string())

    return F.arrow_udf(hashed, "string")(text)


def is_valid_candidate(text: Column) -> Column:
    """Not empty, valid UTF-8, and not a single byte other than a letter or digit."""
    return (F.length(text) > 0) & F.is_valid_utf8(text) & ~((F.octet_length(text) == 1) & ~text.rlike("[0-9A-Za-z]"))


def is_functional_word(text: Column) -> Column:
    """Japanese particles and polite endings; an optional predicate that no default plan uses."""
    particles = ["は", "が", "を", "に", "で", "と", "も", "の", "へ", "や", "から", "まで", "より"]
    return text.isin(particles) | text.rlike("(です|ます|ました|でした|ください|ません)$")
