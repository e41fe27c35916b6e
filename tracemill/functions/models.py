"""Model names, prices and costs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical model names, the more specific of two with a common beginning first.
CANONICAL = (
    "claude-opus-4-7", "claude-opus-4-6", "claude-opus-4-1", "claude-sonnet-4-6", "claude-sonnet-4-5", "claude-3-5-sonnet", "claude-haiku-4-5", "claude-3-5-haiku",
    "gpt-5.4-pro", "gpt-5.4-mini", "gpt-5.4-nano", "gpt-5.4", "gpt-5.3-codex", "gpt-5-mini", "gpt-5", "gpt-4o-mini", "gpt-4.1-mini", "gpt-4.1-nano", "gpt-4.1",
    "o4-mini", "o3-pro", "o3",
    "gemini-3.1-pro", "gemini-3-pro", "gemini-2.5-flash-lite", "gemini-2.5-flash", "gemini-2.5-pro", "gemini-2.0-flash",
    "grok-4.20", "grok-4.1-fast", "grok-4-fast", "grok-4",
    "deepseek-v3.2", "deepseek-v3", "deepseek-chat",
    "magistral-medium", "mistral-medium-3.1", "mistral-large", "mistral-small-4", "codestral",
    "qwen3.5-plus", "qwen3-max", "qwen3-coder-next",
    "kimi-k2.5", "kimi-k2-0905", "kimi-k2-thinking", "kimi-k2",
    "minimax-m2.7", "minimax-m2.5",
    "glm-5-code", "glm-5", "glm-4.7-flashx", "glm-4.7",
    "seed-2.0-pro", "seed-2.0-lite", "seed-2.0-mini", "seed-2.0-code",
    "llama-4-maverick", "llama-4-scout",
)
#: Names whose canonical form differs from the beginning that is matched.
RENAMED = {"grok-4.20": "grok-4.20-beta"}

# Dollars for a million tokens of input, output, cache read, cache write.
PRICES = {
    "gemini-3.1-pro": (2.00, 12.00, 0.20, 2.00),
    "deepseek-v3": (0.28, 0.42, 0.028, 0.28),
    "deepseek-v3.2": (0.28, 0.42, 0.028, 0.28),
    "kimi-k2": (0.556, 2.222, 0.139, 0.556),
    "kimi-k2-0905": (0.556, 2.222, 0.139, 0.556),
    "kimi-k2-thinking": (0.556, 2.222, 0.139, 0.556),
    "kimi-k2.5": (0.556, 2.917, 0.097, 0.556),
    "minimax-m2.5": (0.30, 1.20, 0.03, 0.375),
    "minimax-m2.7": (0.30, 1.20, 0.06, 0.375),
    "qwen3-max": (0.35, 1.39, 0.07, 0.35),
    "qwen3.5-plus": (0.26, 1.56, 0.26, 0.26),
    "qwen3-coder-next": (0.12, 0.75, 0.06, 0.12),
    "glm-5": (1.00, 3.20, 0.20, 1.00),
    "glm-5-code": (1.20, 5.00, 0.30, 1.20),
    "glm-4.7": (0.60, 2.20, 0.11, 0.60),
    "glm-4.7-flashx": (0.07, 0.40, 0.01, 0.07),
    "seed-2.0-pro": (0.47, 2.37, 0.47, 0.47),
    "seed-2.0-lite": (0.09, 0.53, 0.09, 0.09),
    "seed-2.0-mini": (0.03, 0.31, 0.03, 0.03),
    "seed-2.0-code": (0.47, 2.37, 0.47, 0.47),
    "mistral-large": (0.50, 1.50, 0.05, 0.50),
    "mistral-medium-3.1": (0.40, 2.00, 0.04, 0.40),
    "mistral-small-4": (0.15, 0.60, 0.015, 0.15),
    "magistral-medium": (2.00, 5.00, 2.00, 2.00),
    "codestral": (0.30, 0.90, 0.03, 0.30),
    "llama-4-maverick": (0.15, 0.60, 0.15, 0.15),
    "llama-4-scout": (0.08, 0.30, 0.08, 0.08),
}


def canonical_model(raw: Column) -> Column:
    """The canonical name of a raw model name; null if none fits.

    Paths and providers before the name go, dotted versions of dashed families are dashed,
    and the first canonical name that begins it counts, unless a finer dotted version follows.
    """
    # What stands before a name, and which dotted versions are dashed.
    name = F.lower(F.regexp_replace(raw, "^\\s+|\\s+$", ""))
    name = F.regexp_replace(name, "^(?:models/|accounts/[^/]+/models/)", "")
    name = F.regexp_replace(name, "^(?:[a-z0-9._-]+[/:])+", "")
    name = F.regexp_replace(name, "^(claude-[a-z]+-\\d+)\\.(\\d+)(?=$|[^0-9])", "$1-$2")
    # Alternatives are tried in their order, and one that a finer version follows gives way to the next.
    found = F.regexp_extract(name, "^(" + "|".join(re.escape(c) for c in CANONICAL) + ")(?!\\.[0-9])", 1)
    renamed = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(renamed, found), found), F.lit(""))


def real_model(model: Column) -> Column:
    """Whether a model name is that of a model: not empty and no placeholder such as <...>."""
    return model.isNotNull() & (model != "") & ~model.startswith("<")


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """model, input, output, cache_read, cache_write. Missing or zero cache rates are the input rate."""
    rows = [(m, i, o, r or i, w or i) for m, (i, o, r, w) in (prices or PRICES).items()]
    return spark.createDataFrame(rows, "price_model string, input double, output double, cache_read double, cache_write double")


def token_cost(prompt: Column, completion: Column, read: Column, write: Column) -> Column:
    """Dollars by the columns of price_table(); prompt tokens hold those read from the cache. A missing count is 0. Null without a price, or where neither prompt nor completion is counted."""
    known = prompt.isNotNull() | completion.isNotNull()
    prompt, completion, read, write = (F.coalesce(c, F.lit(0)) for c in (prompt, completion, read, write))
    fresh = F.greatest(F.lit(0), prompt - read)
    return F.when(known, (fresh * F.col("input") + read * F.col("cache_read") + write * F.col("cache_write") + completion * F.col("output")) / 1e6)


def with_cost(steps: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """steps with canonical_model and cost_usd; a cost that the log states stays. The price table is a short list, so it goes to all tasks."""
    prices = prices if prices is not None else price_table(steps.sparkSession)
    named = steps.withColumn("canonical_model", F.when(real_model(F.col("model")), canonical_model(F.col("model"))))
    joined = named.join(F.broadcast(prices), F.col("canonical_model") == F.col("price_model"), "left")
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"))
    if "cost_usd" in steps.columns:
        cost = F.coalesce("cost_usd", cost)
    return joined.withColumn("cost_usd", cost).drop("price_model", "input", "output", "cache_read", "cache_write")
