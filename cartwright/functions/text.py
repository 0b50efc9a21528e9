"""Text parsing and classification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col

NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"

# Keywords per question category; the first category with a match wins.
QUESTION_KEYWORDS = {
    "churn": ("churn", "attrition", "drop off", "dropping", "desabonnement", "désabonnement"),
    "retention": ("cohort", "cohorte", "retention", "rétention"),
    "clv": ("lifetime value", "clv", "value segment", "valeur vie", "valeur client"),
    "top_products": ("top product", "products", "items", "sku", "produit", "produits", "articles"),
    "reorder_trend": (
        "reorder", "reorders", "repeat", "recommande", "recommandes", "rachat", "rachats", "repete",
    ),
    "customer_behavior": (
        "customer", "user", "basket", "order", "client", "clients", "panier", "commande",
    ),
}
DEFAULT_CATEGORY = "general"


def _number(text: Column) -> Column:
    """Strict: a Java cast alone would also accept suffixes such as ``1d``."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_metric(value: Column) -> Column:
    """``"1,234"`` to 1234, ``"12%"`` to 0.12; missing or unreadable text to 0."""
    text = F.regexp_replace(F.trim(value), ",", "")
    percent = _number(F.trim(F.regexp_replace(text, "%$", ""))) / 100
    return F.coalesce(F.when(text.endswith("%"), percent).otherwise(_number(F.trim(text))), F.lit(0.0))


def parse_displayed_metric(value: Column) -> Column:
    """Like ``parse_metric``, but a percent keeps its size and unreadable text is NULL."""
    text = F.regexp_replace(F.trim(value), ",", "")
    return _number(F.trim(F.regexp_replace(text, "%$", "")))


#: Ways in which run stamps are written; the first that fits counts.
STAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd")


def lenient_timestamp(value: Column, formats: tuple[str, ...] = STAMP_FORMATS) -> Column:
    """A time without zone, by the first format that fits the trimmed text; NULL when none does."""
    text = F.trim(value)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def question_category(question: Column) -> Column:
    text = F.lower(question)
    rules = [
        (reduce(lambda a, b: a | b, [text.contains(word) for word in words]), category)
        for category, words in QUESTION_KEYWORDS.items()
    ]
    chain = F.when(*rules[0])
    for condition, category in rules[1:]:
        chain = chain.when(condition, category)
    return chain.otherwise(DEFAULT_CATEGORY)


# Grams of CO2 equivalent per 1,000 characters, per request and per decision run.
GRAMS_PER_THOUSAND_CHARS = 0.002
GRAMS_PER_REQUEST = 0.2
GRAMS_PER_DECISION_RUN = 0.05


def text_footprint(messages: DataFrame, key: str = "conv_id", decision_runs: int = 0) -> DataFrame:
    """Estimated footprint per conversation: all characters count, user turns are requests."""
    chars = F.coalesce(F.length("role"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0))
    per_key = messages.groupBy(key).agg(
        F.sum(chars).alias("chars"),
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(col("role") == "user").alias("ai_calls"),
    )
    units = col("chars") / 1000
    return per_key.select(
        key,
        (
            units * GRAMS_PER_THOUSAND_CHARS
            + col("ai_calls") * GRAMS_PER_REQUEST
            + F.lit(decision_runs * GRAMS_PER_DECISION_RUN)
        ).alias("estimated_gco2e"),
        "message_count",
        units.alias("text_units"),
        "ai_calls",
        F.lit(decision_runs).alias("decision_runs"),
    )
