"""Settings as rows: what violates their ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The settings by the range that they must keep.
POSITIVE = (
    "embedding_dimension", "embedding_batch_size", "embedding_max_seq_length", "embedding_token_budget", "max_tokens", "top_k", "excerpt_chars", "candidate_k", "final_k",
    "rrf_k", "max_query_chars", "max_query_texts", "filtered_window_multiplier", "max_filtered_window", "max_steps", "max_gate_blocks", "history_turns", "tool_text_chars",
    "tool_table_chars", "tool_max_hits", "tool_neighbor_min_chars", "digest_chars", "adapter_page_chars", "adapter_element_chars",
)
NOT_NEGATIVE = ("temperature", "quota_per_query", "memory_review_every_turns")
RANGES = {"min_score": (-1.0, 1.0), "score_floor_ratio": (0.0, 1.0)}
SHARES = ("history_context_ratio", "tool_primary_min_ratio")
AT_LEAST = {"rerank_max_length": 8}
CHOICES = {"default_mode": ("deep", "chat"), "route_mode": ("auto", "direct", "planned")}
NOT_BLANK = ("embedding_model",)


def broken_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """(setting, whether a row breaks its rule) of the settings that df has as columns."""
    out = [(c, F.col(c) < 1) for c in POSITIVE]
    out += [(c, F.col(c) < 0) for c in NOT_NEGATIVE]
    out += [(c, ~F.col(c).between(low, high)) for c, (low, high) in RANGES.items()]
    out += [(c, (F.col(c) <= 0) | (F.col(c) > 1)) for c in SHARES]
    out += [(c, F.col(c) < low) for c, low in AT_LEAST.items()]
    out += [(c, ~F.col(c).isin(*values)) for c, values in CHOICES.items()]
    out += [(c, F.trim(F.coalesce(c, F.lit(""))) == "") for c in NOT_BLANK]
    kept = [(c, rule) for c, rule in out if c in df.columns]
    if {"rerank_enabled", "rerank_model"} <= set(df.columns):
        kept.append(("rerank_model", F.col("rerank_enabled") & (F.trim(F.coalesce("rerank_model", F.lit(""))) == "")))
    return kept


def with_violations(df: DataFrame) -> DataFrame:
    """Adds violations: the names of the settings out of range, null settings being left to defaults."""
    named = [F.when(F.coalesce(rule, F.lit(False)), F.lit(c)) for c, rule in broken_rules(df)]
    return df.withColumn("violations", F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))
