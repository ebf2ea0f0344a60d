"""Formal checks of generated answers and their roll-up per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import contains_any, strip

# Texts that give away a thinking leak, a wrong language, or a missing answer.
THINKING_MARKERS = (
    "Thinking...",
    "...done thinking",
    "Хм,",
    "мені потрібно",
    "мне нужно",
    "спочатку",
    "сначала",
    "let me",
    "okay,",
)
RUSSIAN_MARKERS = ("хорошо", "мне нужно", "источник", "пользователь", "сначала")
NO_ANSWER_MARKERS = (
    "інформацію не знайдено",
    "інформація не знайдена",
    "у наданих документах немає",
    "у наданих документах не знайдено",
    "немає інформації",
)
TOO_SHORT = 80

FLAGS = (
    "has_answer",
    "has_sources",
    "has_citations",
    "contains_thinking",
    "wrong_language_suspected",
    "empty_answer",
    "too_short_answer",
)
FLAG_LABELS = {
    "has_citations": "citations",
    "contains_thinking": "thinking leak",
    "wrong_language_suspected": "language issue",
    "empty_answer": "empty",
    "too_short_answer": "too short",
}


def is_no_answer(answer: Column) -> Column:
    return contains_any(answer, NO_ANSWER_MARKERS)


def with_flags(
    results: DataFrame,
    thinking: Sequence[str] = THINKING_MARKERS,
    foreign: Sequence[str] = RUSSIAN_MARKERS,
) -> DataFrame:
    """``results`` has answer and source_count."""
    answer = F.col("answer")
    length = F.length(strip(answer))
    return results.select(
        "*",
        F.length(answer).alias("answer_chars"),
        (length > 0).alias("has_answer"),
        (F.col("source_count") > 0).alias("has_sources"),
        answer.rlike(r"\[\d+\]").alias("has_citations"),
        contains_any(answer, thinking).alias("contains_thinking"),
        contains_any(answer, foreign).alias("wrong_language_suspected"),
        (length == 0).alias("empty_answer"),
        ((length > 0) & (length < TOO_SHORT)).alias("too_short_answer"),
    )


def select_models(results: DataFrame, include: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    chosen = results.filter(F.col("model").isin(*include)) if include else results
    return chosen.filter(~F.col("model").isin(*skip)) if skip else chosen


def model_summary(flagged: DataFrame) -> DataFrame:
    """Per model: mean times, passes per flag, and a verdict."""
    per_model = flagged.groupBy("model").agg(
        F.count("*").alias("answers"),
        F.avg("total_time_seconds").alias("avg_total_time"),
        F.avg("llm_time_seconds").alias("avg_llm_time"),
        *(F.count_if(F.col(name)).alias(name) for name in FLAGS),
    )
    verdict = (
        F.when(F.col("contains_thinking") > 0, "reject: thinking leaks")
        .when(F.col("wrong_language_suspected") > 0, "review: language issues")
        .when(F.col("has_citations") == F.col("answers"), "candidate")
        .otherwise("review")
    )
    return per_model.withColumn("notes", verdict)


def flag_list(error: Column | None = None) -> Column:
    labels = [F.when(F.col(name), label) for name, label in FLAG_LABELS.items()]
    if error is not None:
        labels.append(F.when(F.coalesce(error, F.lit("")) != "", "error"))
    text = F.concat_ws(", ", *labels)
    return F.when(text == "", "none").otherwise(text)


def compare_models(flagged: DataFrame) -> DataFrame:
    """One row per query and model with times, sizes and the list of flags."""
    error = F.col("error") if "error" in flagged.columns else None
    return flagged.select(
        "query_id",
        "model",
        "total_time_seconds",
        "llm_time_seconds",
        "answer_chars",
        "source_count",
        flag_list(error).alias("flags"),
    )


def compare_wide(comparison: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per query with the flags of every named model side by side."""
    return comparison.groupBy("query_id").pivot("model", list(models)).agg(F.first("flags"))
