"""Rule-based anomalies and decisions over a table of metrics, one row per entity.

Every rule reads its own row, so detection, decisions, ranking and wording are projections over
arrays of structs: no shuffle, whatever the number of entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import col

from cartwright.functions.text import parse_metric

# Rank of each priority.
PRIORITIES = ("low", "medium", "high", "critical")
PRIORITY_LABELS_FR = {"low": "faible", "medium": "moyenne", "high": "elevee", "critical": "critique"}

# Accepted input columns per metric; an empty or zero one falls through to the next.
METRIC_INPUTS = {
    "reorder_rate": ("reorder_rate",),
    "churn_rate": ("churn_rate", "avg_churn_probability"),
    "days_between_orders": ("days_between_orders", "avg_days_between_orders"),
    "data_quality_failures": ("data_quality_failures", "failed_checks"),
    "api_health": ("api_health", "render_api_status"),
    "revenue_delta": ("revenue_delta", "revenue_proxy_delta"),
}

# Signal descriptions.
REORDER_LOW = "Reorder rate is below the healthy operating threshold."
CHURN_CRITICAL = "Churn risk is critically high."
CHURN_HIGH = "Churn risk is elevated."
GAP_LONG = "Average purchase gap is unusually long."
QUALITY_FAILING = "Data quality checks are failing before downstream decisions."
SERVICE_DOWN = "Serving API is unavailable or unhealthy."

# Title, action and rationale per decision.
DECISION_TEXTS = {
    "data_quality_failures": (
        "Pause downstream analytics refresh",
        "Investigate failing data quality checks before running dbt, training, or dashboard refreshes.",
        "Data quality failures can contaminate marts, model features, and AI insights.",
    ),
    "api_health": (
        "Restore prediction API availability",
        "Check Render logs, health endpoint, model artifact availability, and environment variables.",
        "The decision and dashboard layers depend on the API for live predictions and copilot workflows.",
    ),
    "retention_risk": (
        "Launch retention intervention",
        "Target high-risk customers with reorder reminders, high-repeat products, and time-bound offers.",
        "Churn risk, weak reorder behavior, or long purchase gaps indicate declining customer engagement.",
    ),
    "revenue_delta": (
        "Review revenue proxy decline",
        "Compare order volume, basket size, and repeat purchase movement by cohort and product department.",
        "A declining revenue proxy can signal lower basket activity even without price-level data.",
    ),
    "overall_health": (
        "Continue monitoring customer health",
        "Track reorder rate, retention cohorts, churn risk, and data quality daily.",
        "No critical anomaly was detected, so the best decision is ongoing monitoring.",
    ),
}

# French wording by exact English text.
FRENCH_TEXTS = {
    "Reorder rate is below the healthy operating threshold.":
        "Le taux de recommande est sous le seuil operationnel sain.",
    "Churn risk is critically high.": "Le risque de churn est critique.",
    "Churn risk is elevated.": "Le risque de churn est eleve.",
    "Average purchase gap is unusually long.": "Le delai moyen entre commandes est anormalement long.",
    "Data quality checks are failing before downstream decisions.":
        "Des controles de qualite des donnees echouent avant les decisions downstream.",
    "Serving API is unavailable or unhealthy.": "L'API de service est indisponible ou non saine.",
    "Pause downstream analytics refresh": "Suspendre le rafraichissement analytique downstream",
    "Investigate failing data quality checks before running dbt, training, or dashboard refreshes.":
        "Analyser les controles qualite en echec avant de lancer dbt, le training ou le "
        "rafraichissement du dashboard.",
    "Data quality failures can contaminate marts, model features, and AI insights.":
        "Les echecs de qualite peuvent contaminer les marts, les features modele et les insights IA.",
    "Restore prediction API availability": "Restaurer la disponibilite de l'API de prediction",
    "Check Render logs, health endpoint, model artifact availability, and environment variables.":
        "Verifier les logs Render, le endpoint health, la disponibilite de l'artefact modele "
        "et les variables d'environnement.",
    "The decision and dashboard layers depend on the API for live predictions and copilot workflows.":
        "Les couches decision et dashboard dependent de l'API pour les predictions live et "
        "les workflows copilot.",
    "Launch retention intervention": "Lancer une intervention de retention",
    "Target high-risk customers with reorder reminders, high-repeat products, and time-bound offers.":
        "Cibler les clients a risque avec des rappels de recommande, des produits a fort rachat "
        "et des offres limitees dans le temps.",
    "Churn risk, weak reorder behavior, or long purchase gaps indicate declining customer engagement.":
        "Le risque de churn, la faiblesse des recommandes ou les longs delais entre commandes "
        "indiquent une baisse d'engagement client.",
    "Review revenue proxy decline": "Analyser la baisse du proxy de revenus",
    "Compare order volume, basket size, and repeat purchase movement by cohort and product department.":
        "Comparer le volume de commandes, la taille du panier et les rachats par cohorte "
        "et departement produit.",
    "A declining revenue proxy can signal lower basket activity even without price-level data.":
        "Une baisse du proxy de revenus peut indiquer une baisse d'activite panier meme sans "
        "donnees de prix.",
    "Continue monitoring customer health": "Continuer le suivi de la sante client",
    "Track reorder rate, retention cohorts, churn risk, and data quality daily.":
        "Suivre chaque jour le taux de recommande, les cohortes de retention, le risque de churn "
        "et la qualite des donnees.",
    "No critical anomaly was detected, so the best decision is ongoing monitoring.":
        "Aucune anomalie critique n'a ete detectee; la meilleure decision est donc de continuer "
        "la surveillance.",
}

SIGNAL_TYPE = T.ArrayType(
    T.StructType([
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
    ])
)


def priority_rank(priority: Column) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority), F.lit(0)), F.lit(1)
    ).cast("int")


def highest_priority(*priorities: Column) -> Column:
    rank = F.greatest(*[priority_rank(p) for p in priorities]) if len(priorities) > 1 else priority_rank(
        priorities[0]
    )
    return F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), rank)


def _raw_input(df: DataFrame, metric: str) -> Column:
    """First input column that exists and is neither missing, empty nor zero; the last one as is."""
    present = [c for c in METRIC_INPUTS[metric] if c in df.columns]
    if not present:
        return F.lit(None).cast("string")
    parts = []
    for name in present:
        text = col(name).cast("string")
        if isinstance(df.schema[name].dataType, T.StringType):
            filled = text != ""
        else:
            filled = col(name) != 0
        parts.append(F.when(filled, text))
    parts[-1] = col(present[-1]).cast("string")
    return F.coalesce(*parts)


def _number_input(df: DataFrame, metric: str) -> Column:
    """Numeric columns are read as numbers; only text goes through the parser."""
    present = [c for c in METRIC_INPUTS[metric] if c in df.columns]
    if present and all(isinstance(df.schema[c].dataType, T.NumericType) for c in present):
        return F.coalesce(*[F.nullif(col(c).cast("double"), F.lit(0.0)) for c in present], F.lit(0.0))
    return parse_metric(_raw_input(df, metric))


def with_signals(df: DataFrame) -> DataFrame:
    """Add ``signals``: supplied ones (column ``anomalies``, if any), then those detected."""
    numbers = {m: _number_input(df, m) for m in METRIC_INPUTS if m != "api_health"}
    health = F.lower(F.coalesce(_raw_input(df, "api_health"), F.lit("")))
    reorder, churn, gap = (numbers[m] for m in ("reorder_rate", "churn_rate", "days_between_orders"))
    failures = numbers["data_quality_failures"]

    def signal(fires: Column, metric: str, value: Column, severity: Column | str, text: Column | str) -> Column:
        return F.when(
            fires,
            F.struct(
                F.lit(metric).alias("metric"),
                value.cast("string").alias("value"),
                (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
                (text if isinstance(text, Column) else F.lit(text)).alias("description"),
            ),
        )

    critical = churn >= 0.70
    detected = F.array(
        signal((reorder != 0) & (reorder < 0.35), "reorder_rate", reorder, "high", REORDER_LOW),
        signal(
            churn >= 0.50, "churn_rate", churn,
            F.when(critical, "critical").otherwise("high"),
            F.when(critical, CHURN_CRITICAL).otherwise(CHURN_HIGH),
        ),
        signal(gap >= 21, "days_between_orders", gap, "high", GAP_LONG),
        signal(failures > 0, "data_quality_failures", failures, "critical", QUALITY_FAILING),
        signal(health.isin("failed", "down", "unhealthy"), "api_health", health, "critical", SERVICE_DOWN),
    )
    found = F.filter(detected, lambda s: s.isNotNull()).cast(SIGNAL_TYPE)
    if "anomalies" in df.columns:
        supplied = F.coalesce(col("anomalies").cast(SIGNAL_TYPE), F.array().cast(SIGNAL_TYPE))
        found = F.concat(supplied, found)
    return df.withColumns({"signals": found, "revenue_change": numbers["revenue_delta"]})


def _signal(metric: str) -> Column:
    """The last signal of a metric, so a detected one overrides a supplied one."""
    return F.try_element_at(F.filter("signals", lambda s: s["metric"] == metric), F.lit(-1))


def with_decisions(df: DataFrame) -> DataFrame:
    """Add ``decisions``, best first: by priority, then by rule order."""
    found = {m: f"_{m}" for m in METRIC_INPUTS if m != "revenue_delta"}
    rows = df.withColumns({name: _signal(metric) for metric, name in found.items()})
    quality, health = col(found["data_quality_failures"]), col(found["api_health"])
    churn, reorder, gap = (col(found[m]) for m in ("churn_rate", "reorder_rate", "days_between_orders"))
    rows = rows.withColumn(
        "_retention_priority", highest_priority(churn["severity"], reorder["severity"], gap["severity"])
    )

    def decision(rule_no: int, kind: str, metric: str, priority: Column, evidence: Column) -> Column:
        title, action, rationale = DECISION_TEXTS[metric]
        return F.struct(
            (-priority_rank(priority)).alias("order"),
            F.lit(rule_no).alias("rule_no"),
            F.lit(kind).alias("decision_type"),
            priority.alias("priority"),
            F.lit(title).alias("title"),
            F.lit(action).alias("action"),
            F.lit(rationale).alias("rationale"),
            F.lit(metric).alias("metric"),
            evidence.alias("evidence"),
        )

    def from_signal(s: Column) -> Column:
        return F.create_map(
            F.lit("value"), s["value"], F.lit("description"), s["description"]
        ).cast("map<string,string>")

    retention_evidence = F.create_map(*[
        part
        for metric in ("churn_rate", "reorder_rate", "days_between_orders")
        for part in (F.lit(metric), _raw_input(df, metric))
    ]).cast("map<string,string>")
    revenue = col("revenue_change")
    candidates = F.array(
        F.when(
            quality.isNotNull(),
            decision(1, "alert", "data_quality_failures", F.lit("critical"), from_signal(quality)),
        ),
        F.when(
            health.isNotNull(), decision(2, "alert", "api_health", F.lit("critical"), from_signal(health))
        ),
        F.when(
            churn.isNotNull() | reorder.isNotNull() | gap.isNotNull(),
            decision(
                3, "recommendation", "retention_risk",
                col("_retention_priority"), retention_evidence,
            ),
        ),
        F.when(
            revenue < -0.10,
            decision(
                4, "alert", "revenue_delta", F.lit("high"),
                F.create_map(F.lit("value"), revenue.cast("string")).cast("map<string,string>"),
            ),
        ),
    )
    observed = F.to_json(F.array(*[
        F.lit(c) for names in METRIC_INPUTS.values() for c in names if c in df.columns
    ]))
    default = decision(
        5, "recommendation", "overall_health", F.lit("low"),
        F.create_map(F.lit("observed_metrics"), observed).cast("map<string,string>"),
    )
    rows = rows.withColumn("_fired", F.filter(candidates, lambda d: d.isNotNull()))
    listed = F.when(F.size("_fired") == 0, F.array(default)).otherwise(col("_fired"))

    def by_order(a: Column, b: Column) -> Column:
        first = F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1)
        return first.otherwise(a["rule_no"] - b["rule_no"])

    return rows.withColumn("decisions", F.array_sort(listed, by_order)).drop(
        *found.values(), "_retention_priority", "_fired"
    )


def translate(text: Column, language: str = "fr") -> Column:
    """Look a text up by exact wording; an unknown one stays as it is."""
    if language != "fr":
        return text
    words = F.create_map(*[F.lit(part) for pair in FRENCH_TEXTS.items() for part in pair])
    return F.coalesce(F.try_element_at(words, text), text)


def detect_anomalies(df: DataFrame, entity: str, language: str = "en") -> DataFrame:
    """One row per entity and signal."""
    return (
        with_signals(df)
        # Outer, then a filter on the output: the inferred filter of a plain explode would
        # repeat the whole rule expression below it.
        .select(entity, F.posexplode_outer("signals").alias("signal_no", "s"))
        .where(col("s").isNotNull())
        .select(
            entity,
            (col("signal_no") + 1).alias("signal_no"),
            col("s.metric").alias("metric"),
            col("s.value").alias("value"),
            col("s.severity").alias("severity"),
            translate(col("s.description"), language).alias("description"),
        )
    )


def build_decisions(df: DataFrame, entity: str, language: str = "en") -> DataFrame:
    """One row per entity and decision, ``place`` 1 first."""
    return (
        with_decisions(with_signals(df))
        .select(entity, F.posexplode_outer("decisions").alias("place", "d"))
        .select(
            entity,
            (col("place") + 1).alias("place"),
            col("d.decision_type").alias("decision_type"),
            col("d.priority").alias("priority"),
            translate(col("d.title"), language).alias("title"),
            translate(col("d.action"), language).alias("action"),
            translate(col("d.rationale"), language).alias("rationale"),
            col("d.metric").alias("metric"),
            F.when(
                F.map_contains_key("d.evidence", "description"),
                F.transform_values(
                    "d.evidence",
                    lambda k, v: F.when(k == "description", translate(v, language)).otherwise(v),
                ),
            ).otherwise(col("d.evidence")).alias("evidence"),
        )
    )


def decision_explanations(df: DataFrame, entity: str, language: str = "en") -> DataFrame:
    """One sentence per entity: how many decisions from how many signals, and the first of them."""
    rows = with_decisions(with_signals(df))
    first = F.element_at("decisions", 1)
    counts = [F.size("decisions"), F.size("signals")]
    if language == "fr":
        labels = F.create_map(*[F.lit(part) for pair in PRIORITY_LABELS_FR.items() for part in pair])
        text = F.format_string(
            "Le moteur de decision a produit %d decision(s) a partir de %d signal(aux) d'anomalie. "
            "La priorite la plus elevee est %s. Premiere action recommandee: %s.",
            *counts, F.coalesce(F.try_element_at(labels, first["priority"]), first["priority"]),
            translate(first["title"], language),
        )
    else:
        text = F.format_string(
            "Decision engine produced %d decision(s) from %d anomaly signal(s). "
            "The highest priority is %s. Recommended first action: %s.",
            *counts, first["priority"], first["title"],
        )
    return rows.select(entity, text.alias("explanation"))


def decision_counts(df: DataFrame, entity: str) -> DataFrame:
    rows = with_decisions(with_signals(df))

    def of_type(kind: str) -> Column:
        return F.size(F.filter("decisions", lambda d: d["decision_type"] == kind))

    return rows.select(
        entity,
        F.size("signals").alias("anomalies"),
        of_type("alert").alias("alerts"),
        of_type("recommendation").alias("recommendations"),
    )


def priority_mix(decisions: DataFrame) -> DataFrame:
    """Counts for critical, high, medium and low, absent ones as 0; a missing priority counts as medium."""
    level = F.lower(F.coalesce(F.nullif("priority", F.lit("")), F.lit("medium")))
    counts = decisions.agg(*[F.count_if(level == p).alias(p) for p in PRIORITIES])
    rank = F.array_position(F.lit(list(PRIORITIES)), col("priority"))
    return counts.unpivot([], list(PRIORITIES), "priority", "count").orderBy(rank.desc())


def with_operational_signals(df: DataFrame, quality: DataFrame, api_health: str = "ok") -> DataFrame:
    """Attach the quality summary (one row) and the service status to every entity."""
    return df.withColumns({
        "data_quality_failures": quality.select("data_quality_failures").scalar(),
        "data_quality_status": quality.select("data_quality_status").scalar(),
        "api_health": F.lit(api_health),
    })
