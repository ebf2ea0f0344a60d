"""Rules and markers that occur in the given texts, next to the default ones."""

from __future__ import annotations

from folioscope.functions.rules import RulePack
from folioscope.operators.profile import MARKERS

SAMPLE_PACK = RulePack(
    document_types=(
        ("order", r"^7\d*\.txt"),
        ("scheme", r"src1\d"),
        ("report", r"licen[sc]e"),
        ("letter", r"\sthe\s"),
        ("law", r"avec\s|\sder\s"),
    ),
    content_categories=(
        ("reference", r"released\s+under|licensed\s+under"),
        ("training", r"\swith\s"),
        ("legal_policy", r"schaft|ciones"),
    ),
    document_numbers=(r"\bversion\s+(\d+)", r"\b(\d{3}[-–]\d{2,})\b", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d"),
    organizations=(("Public licence", r"general\s+public"), ("Institute", r"\bmit\s+license"), ("List", r"\|")),
)
SAMPLE_MARKERS = {"thinking": ("license", "hahaha"), "foreign": ("schaft", "ñue ")}
PROFILE_MARKERS = {
    **MARKERS,
    "section": r"(?iU)\sthe\s",
    "chapter": r"(?iU)\blicense\b",
    "table": r"(?U)\s\|\s",
}
