"""Ordered rule lists: the first rule in the list that fits decides, and the rule that decided is kept."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import collapse

Rule = tuple[str, str]
# Parts of a pattern: an escape, a class, a bracket or bar, or a run of characters that stand for themselves.
PARTS = re.compile(r"\\.|\[\^?\]?[^\]]*\]|\((?:\?:)?|[)|]|[^\\\[()|]")
PLAIN_START = re.compile(r"[^\W_]+|№")

# Document types and the patterns that name them, in order of precedence.
DOCUMENT_TYPES: tuple[Rule, ...] = (
    ("order", r"\bнаказ\b"),
    ("law", r"\bзакон\b|верховн[а-яіїєґ]+\s+рад[а-яіїєґ]+"),
    ("doctrine", r"доктрин"),
    ("algorithm", r"алгоритм"),
    ("instruction", r"інструкц|iнструкц|\bінстр\b|\biнстр\b"),
    (
        "standard_or_norms",
        r"норм[иа]\b|норми\s+часу|норми\s+витрат|стандарт|standardization|nga\.stnd|nga\.sig|умовн[іi]\s+знаки",
    ),
    (
        "training_manual",
        r"методич|методика|посібник|підручник|навчальн|student\s*workbook|workbook|порадник",
    ),
    ("procedure", r"порядок|правила|тимчасовий\s+порядок"),
    ("article", r"статт[яі]|газет"),
    ("report", r"\bзвіт\b"),
    ("list", r"\bсписок\b"),
    ("poster", r"плакат|фотосхема|фотокарта"),
    ("scheme", r"\bсхема\b"),
    ("code", r"\bsub\b|commandbutton|код\b"),
    ("appendix", r"додаток"),
    ("brandbook", r"брендбук|грифування"),
)

# Content categories, in order of precedence.
CONTENT_CATEGORIES: tuple[Rule, ...] = (
    (
        "reference",
        r"умовн[іi]\s+знаки|норми\s+часу|норми\s+витрат|грід|grid|довід|стандарт|standard|врізка|скорочена\s+пам",
    ),
    (
        "cartography_geodesy",
        r"геопросторов|топограф|картограф|геодез|mgrs|utm|wgs\s*84|схилен|зближен|фотокарт|спеціальн[а-яіїєґ]+\s+карт",
    ),
    (
        "training",
        r"навчальн|методич|методика|посібник|підручник|student\s*workbook|workbook|порадник|план\s+конспект",
    ),
    ("operations", r"оперативн|бойов|чергов|повітряна\s+тривога|реагування|кпп|бпла|рхб"),
    (
        "communications_it",
        r"starlink|mikrotik|веб\s*сайт|портал|arcgis|coraldraw|photoshop|acrobat|3d\s*друк|3d",
    ),
    ("legal_policy", r"\bнаказ\b|\bзакон\b|правовий\s+захист|порядок"),
    ("branding", r"брендбук|грифування"),
)

# Document numbers; the first group is the number.
DOCUMENT_NUMBERS: tuple[str, ...] = (
    r"\bнаказ(?:\s+\S+){0,5}?\s+(\d{1,5})\b",
    r"\bзакон\s*№\s*([0-9]+[-–]?[A-ZА-ЯІЇЄҐXIVLC]+)\b",
    r"\b№\s*([0-9]+[-–]?[A-ZА-ЯІЇЄҐXIVLC]*)\b",
    r"\b(ПВП\s*\d+[-–]?\([^)]+\)\d+)\b",
    r"\b(ПДП\s*\d+[-–]?\([^)]+\)\d+)\b",
    r"\b(NGA\.(?:SIG|STND)\.\d+(?:_\d+\.\d+\.\d+)?)\b",
    r"\b(\d{3}[-–]\d{10,}[-–][\d-]+)\b",
)

# Organizations, in order of precedence.
ORGANIZATIONS: tuple[Rule, ...] = (
    ("Міністерство оборони України", r"міністерство\s+оборони\s+україни"),
    ("Генеральний штаб Збройних Сил України", r"генеральн[ийого]+\s+штаб|гш\s+зсу"),
    ("Командування Сил підтримки Збройних Сил України", r"командування\s+сил\s+підтримки"),
    ("Збройні Сили України", r"збройн[іi]\s+сил[иа]\s+україни|\bзсу\b"),
    ("National Geospatial-Intelligence Agency", r"national\s+geospatial|nga\."),
    ("Esri", r"\besri\b|arcgis"),
    ("Верховна Рада України", r"верховн[а-яіїєґ]+\s+рад[а-яіїєґ]+"),
)

# Date patterns.
NUMERIC_DATE = r"\b(\d{1,2})[.](\d{1,2})[.](\d{2,4})\b"
ISO_LIKE_DATE = r"\b(20\d{2})[-_](\d{1,2})[-_](\d{1,2})\b"


@dataclass(frozen=True)
class RulePack:
    document_types: Sequence[Rule] = DOCUMENT_TYPES
    content_categories: Sequence[Rule] = CONTENT_CATEGORIES
    document_numbers: Sequence[str] = DOCUMENT_NUMBERS
    organizations: Sequence[Rule] = ORGANIZATIONS


def ignoring_case(pattern: str) -> str:
    """Letters of every script match in either case; word borders and classes follow Unicode."""
    return f"(?iU){pattern}"


def _branches(pattern: str) -> list[str]:
    """The pattern cut at the bars outside of brackets and classes."""
    found, depth = [""], 0
    for part in PARTS.findall(pattern):
        depth += part.startswith("(") - (part == ")")
        if part == "|" and not depth:
            found.append("")
        else:
            found[-1] += part
    return found


def _inner(branch: str) -> tuple[str, str] | None:
    """What is inside the bracket that a branch starts with, and what follows it."""
    depth, read = 0, ""
    for part in PARTS.findall(branch):
        depth += part.startswith("(") - (part == ")")
        read += part
        if not depth:
            return re.sub(r"^\((\?:)?", "", read)[:-1], branch[len(read) :]
    return None


def starts_of(pattern: str) -> list[str] | None:
    """Lower-case letters of which a text that fits holds at least one, as each branch of the pattern starts with one of
    them; None where a branch starts otherwise."""
    found = []
    for branch in _branches(pattern):
        branch = branch.removeprefix(r"\b")
        if branch.startswith("(") and not branch.startswith("(?!"):
            inner, rest = _inner(branch) or ("", "")
            starts = None if rest[:1] in ("*", "?", "{") else starts_of(inner)
            if starts is None:
                return None
            found += starts
            continue
        start = PLAIN_START.match(branch)
        letters = start.group() if start else ""
        if branch[len(letters) :][:1] in ("*", "?", "{"):
            letters = letters[:-1]
        if not letters:
            return None
        found.append(letters.lower())
    return list(dict.fromkeys(found))


def gate(pattern: str, text: Column, matching: Column) -> Column:
    """A cheap test that every text passes which fits the pattern: fixed letters in the normalized text ``matching``, or
    the pattern without its word borders, which are the dear part of a search."""
    starts = starts_of(pattern)
    if starts:
        return reduce(Column.__or__, (F.contains(matching, F.lit(letters)) for letters in starts))
    loose = re.sub(r"\\b", "", pattern)
    return text.rlike(ignoring_case(loose)) if loose != pattern else F.lit(True)


def fits(pattern: str, text: Column) -> Column:
    """Whether a pattern occurs in a normalized text, which is searched only where it passes the gate."""
    return gate(pattern, text, text) & text.rlike(ignoring_case(pattern))


def first_match(rules: Sequence[Rule], text: Column, note: str = "") -> Column:
    """Struct of ``value`` and ``pattern`` of the first rule that fits the normalized text, else NULL."""
    return F.coalesce(
        *(
            F.when(
                fits(pattern, text),
                F.struct(F.lit(value).alias("value"), F.lit(note + pattern).alias("pattern")),
            )
            for value, pattern in rules
        )
    )


def first_group(patterns: Sequence[str], text: Column, matching: Column | None = None) -> Column:
    """Struct of the first group of the first pattern that fits, and that pattern. ``matching`` is the normalized text,
    by which patterns that cannot fit are left out."""
    near = F.lower(text) if matching is None else matching
    return F.coalesce(
        *(
            F.when(
                gate(pattern, text, near) & text.rlike(ignoring_case(pattern)),
                F.struct(
                    collapse(F.regexp_extract(text, ignoring_case(pattern), 1)).alias("value"),
                    F.lit(pattern).alias("pattern"),
                ),
            )
            for pattern in patterns
        )
    )


def full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year <= 49, year + 2000).otherwise(year + 1900)


def _date(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(text, f"(?U){pattern}", group).try_cast("int")

    iso = F.format_string("%04d-%02d-%02d", full_year(part(year)), part(month), part(day))
    loose = re.sub(r"\\b", "", pattern)
    return F.when(text.rlike(f"(?U){loose}") & text.rlike(f"(?U){pattern}"), iso.try_cast("date"))


def document_date(text: Column) -> Column:
    """Struct of the first valid date and the kind of pattern it came from, else NULL.

    Only the first occurrence of each pattern is tried.
    """
    numeric = _date(text, NUMERIC_DATE, 3, 2, 1)
    iso_like = _date(text, ISO_LIKE_DATE, 1, 2, 3)
    return F.coalesce(
        F.when(numeric.isNotNull(), F.struct(numeric.alias("value"), F.lit("numeric_date").alias("pattern"))),
        F.when(iso_like.isNotNull(), F.struct(iso_like.alias("value"), F.lit("iso_like_date").alias("pattern"))),
    )
