"""Text expressions. Every function takes and returns a Column, so it stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NO_BREAK = "..."

# Single letters the full-text index folds beyond lower-casing.
FOLD_FROM = "µſςϐϑϕϖϰϱϵ"
FOLD_TO = "μsσβθφπκρε"


def latin_folding() -> tuple[str, str]:
    """Arguments of ``translate`` that drop Latin diacritics.

    A letter is folded when Unicode decomposes it into one ASCII letter and one mark; letters with two marks
    stay as they are. The marks themselves have no counterpart in the second string, so ``translate`` deletes them.
    """
    source, target, marks = [], [], set()
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            parts = unicodedata.decomposition(letter).split()
            if len(parts) != 2 or parts[0].startswith("<") or letter != letter.lower():
                continue
            base, mark = (chr(int(part, 16)) for part in parts)
            if base.isascii():
                source.append(letter)
                target.append(base)
                marks.add(mark)
    return "".join(source) + FOLD_FROM + "".join(sorted(marks)), "".join(target) + FOLD_TO


LATIN_FROM, LATIN_TO = latin_folding()


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """White-space runs become one space, ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def normalize(text: Column) -> Column:
    return collapse(F.lower(F.translate(text, "_-", "  ")))


def compact(text: Column, limit: int) -> Column:
    flat = collapse(text)
    cut = F.concat(rstrip(F.substring(flat, 1, limit - len(NO_BREAK))), F.lit(NO_BREAK))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case file suffix without its dot; empty for names such as ``.txt`` or ``name``."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]+)$", 1))


def document_name(value: Column) -> Column:
    """Name used to compare a result with a list of known documents."""
    return collapse(F.translate(F.lower(basename(value)), "\\", "/"))


def query_tokens(query: Column) -> Column:
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda word: F.length(word) >= 2))


def index_tokens(text: Column) -> Column:
    folded = F.translate(F.lower(text), LATIN_FROM, LATIN_TO)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def contains_any(text: Column, markers) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(lowered, F.lit(marker.lower()))
    return found


def human_size(size: Column) -> Column:
    value = size.cast("double")
    shown = F.format_string("%.1f TiB", F.bround(value / 1024**4, 1))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        scaled = F.bround(value / 1024**power, 1)
        shown = F.when(value < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", scaled)).otherwise(shown)
    return F.when(value < 1024, F.format_string("%d B", size.cast("long"))).otherwise(shown)


def file_safe(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def strip_reasoning(answer: Column) -> Column:
    without_blocks = F.regexp_replace(answer, r"(?is)<think>.*?</think>", "")
    lead = r"(?s)\A[\s\x1c-\x1f]*Thinking\.\.\..*?(?=\n\n|\z)"
    return strip(F.regexp_replace(without_blocks, lead, ""))


def citation_ids(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    numbers = F.transform(found, lambda digits: digits.try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda number: number.isNotNull()))


def utc_now() -> Column:
    return F.current_timestamp()
