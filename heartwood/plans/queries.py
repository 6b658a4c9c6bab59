"""Every query by its key. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heartwood.operators import alerts, curated, enrich, governance, quality, routing, scoring, search, whatif
from heartwood.operators.enrich import TEST_LEXICON
from heartwood.operators.text_index import TextIndex
from heartwood.operators.vector_index import VectorIndex
from heartwood.plans import catalog as layers
from heartwood.plans import semantic
from heartwood.plans.reports import REPORTS
from heartwood.plans.tables import LAYERS, RECIPES, Tables, build
from heartwood.sources import ingest
from heartwood.sources.tables import load_table
from heartwood.streaming import jobs

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Query] = {}

_built: dict[tuple[str, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """One mapping per session and folder, so that plans are analysed once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build(spark, sf_dir, lexicon=TEST_LEXICON)
    return _built[key]


def present(df: DataFrame) -> DataFrame:
    """Result types that compare across engines: decimals as doubles, text lists as one text."""
    columns = []
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col, "; ")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def table(name: str) -> Query:
    return lambda t: t[name]


for _layer in LAYERS.values():
    QUERIES |= {name: table(name) for name in _layer}
for _name in ("policy", "claims", "loan", "interaction", "transcript", "document"):
    QUERIES[f"{_name}_agg"] = table(f"{_name}_agg")
for _name in ("customer_sentiment", "latest_call", "search_corpus"):
    QUERIES[_name] = table(_name)

QUERIES |= REPORTS
QUERIES |= {
    "composite_risk": lambda t: t["customer_360_unified"].select(
        "customer_id",
        curated.composite_risk(F.col("max_days_past_due"), F.col("complaint_count"), F.col("lapsed_policies")).alias(
            "composite_risk_level"
        ),
    ),
    "estimated_clv": lambda t: t["customer_360_unified"].select("customer_id", "estimated_clv"),
    "call_summary": lambda t: enrich.call_summary(t["clean_call_transcripts"]),
    "call_summary_idf": lambda t: enrich.call_summary_idf(t["clean_call_transcripts"]),
    "sentiment_distribution_range": lambda t: REPORTS["sentiment_distribution"](
        t, datetime.date(2023, 6, 1), datetime.date(2023, 12, 31)
    ),
    "churn_kpis_filtered": lambda t: REPORTS["churn_kpis"](t, ("Premium", "VIP"), 0.3),
}

# ---------------------------------------------------------- model in, model out


def parse_model_json(t: Tables) -> DataFrame:
    parsed = enrich.parse_model_json(F.col("raw_text"), enrich.CHURN_FIELDS)
    return t["raw_model_output"].select("customer_id", parsed.alias("p")).select("customer_id", "p.*")


def batch_complete(t: Tables) -> DataFrame:
    def echo(prompts: list[str]) -> list[str]:
        """Stands for a model: answers with the length of each prompt."""
        return [f'{{"prompt_chars": {len(p)}}}' for p in prompts]

    prompts = t["scored"].select("customer_id", enrich.churn_prompt().alias("prompt"))
    replied = enrich.batch_complete(prompts, "prompt", echo, table_dir=ingest.new_folder(t.spark, "replies"))
    return replied.select("customer_id", "reply")


QUERIES |= {
    "churn_prompt": lambda t: t["scored"].select("customer_id", enrich.churn_prompt().alias("prompt")),
    "nba_prompt": lambda t: t["next_best_action"].select("customer_id", enrich.nba_prompt().alias("prompt")),
    "document_prompt": lambda t: t["parsed_documents"].select(
        "document_id", enrich.document_prompt(F.col("parsed_text")).alias("prompt")
    ),
    "parse_model_json": parse_model_json,
    "batch_complete": batch_complete,
    "parse_amount": lambda t: t["document_extracted"].select(
        "document_id", "amount", curated.parse_amount(F.col("amount")).alias("amount_value")
    ),
    "customer_summary": lambda t: scoring.customer_summary(t["scored"]),
}

# ---------------------------------------------------------------------- search

SEARCHES = {"renewal": "the error request and note", "dispute": "was it with that signup", "rare": "zu den kindern purchase"}
QUERY_VECTORS = (0, 7, 42)



def search_bm25_index(t: Tables) -> DataFrame:
    """Every benchmark text asked of a stored index of the corpus, in one call."""
    index = TextIndex.build(t["search_corpus"], ingest.new_folder(t.spark, "text-index"), buckets=16)
    asked = load_table(t.spark, t.sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(asked, 10)


def search_knn_pivots(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 100, asked of a stored index around pivots."""
    embeddings = load_table(t.spark, t.sf_dir, "embeddings")
    index = VectorIndex.build(embeddings, ingest.new_folder(t.spark, "vector-index"))
    asked = embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(asked, 10)[0]


QUERIES |= {
    "search_bm25_index": search_bm25_index,
    "search_knn_pivots": search_knn_pivots,
    "search_bm25": lambda t: search.search_bm25(t["search_corpus"], SEARCHES, 10),
    "search_bm25_filtered": lambda t: search.search_bm25(
        t["search_corpus"],
        SEARCHES,
        10,
        (F.col("source_type") == "interaction_note")
        & F.col("channel").isin("Chat", "Web")
        & (F.col("event_date") >= F.lit("2024-01-10").cast("date")),
    ),
    "search_knn": lambda t: search.search_knn(load_table(t.spark, t.sf_dir, "embeddings"), QUERY_VECTORS, 10),
    "search_knn_every": lambda t: search.search_knn_every(load_table(t.spark, t.sf_dir, "embeddings"), 100, 10),
}

# ------------------------------------------------------------------ governance


def mapping(t: Tables) -> DataFrame:
    return governance.role_region_mapping(t.spark)


def mask(column: str, kind: str, alias: str) -> Query:
    return lambda t: t["clean_customers"].select(
        "customer_id",
        governance.MASKS[kind](F.col(column), "ANALYST").alias(alias),
        governance.MASKS[kind](F.col(column), "SYSADMIN").alias(f"{alias}_privileged"),
    )


def access(role: str) -> Query:
    return lambda t: governance.row_access(t["customer_360_unified"], mapping(t), role).select(
        "customer_id", "full_name", "country"
    )


def pii_tag_coverage(t: Tables) -> DataFrame:
    tags = {name: {"pii_level": level} for name, level in governance.PII_LEVELS.items()}
    return governance.pii_tag_coverage(governance.tag(t["raw_customers"], tags))


def table_tag_coverage(t: Tables) -> DataFrame:
    tagged = {name: governance.tag_table(t[name], domain) for name, domain in governance.DATA_DOMAINS.items()}
    return governance.table_tag_coverage(tagged)


QUERIES |= {
    "mask_email": mask("email", "email", "email"),
    "mask_phone": mask("phone", "phone", "phone"),
    "mask_phone_strict": mask("phone", "phone_strict", "phone"),
    "mask_financial": lambda t: governance.masked(t["clean_customers"], "ANALYST").select(
        "customer_id", "email", "phone", "annual_income", "credit_score"
    ),
    "row_access_us": access("US_TEAM"),
    "row_access_apac": access("APAC_TEAM"),
    "row_access_none": access("VISITOR"),
    "role_region_mapping": lambda t: governance.role_visibility(t["customer_360_unified"], mapping(t)),
    "pii_tag_coverage": pii_tag_coverage,
    "table_tag_coverage": table_tag_coverage,
}

# --------------------------------------------------------------------- quality

VALIDATED = (
    *(name for name in LAYERS["RAW"] if name != "raw_documents"),
    *LAYERS["CLEAN"],
    *LAYERS["CURATED"],
    "transcript_sentiment",
    "churn_risk",
    "next_best_action",
)
APP_TABLES = ("role_region_mapping", "ai_quality_log", "nba_email_log")

def layer_row_counts(t: Tables) -> DataFrame:
    """Rows per table and layer."""
    counted = [
        quality.row_counts({name: t.rows(name) for name in names}).select(F.lit(layer).alias("layer"), "*")
        for layer, names in LAYERS.items()
    ]
    return quality.union(counted)


def layer_totals(t: Tables) -> DataFrame:
    return layer_row_counts(t).groupBy("layer").agg(
        F.count("*").alias("tables"), F.sum("row_count").alias("row_count")
    )


def refresh_mode_counts(t: Tables) -> DataFrame:
    """Derived tables and their rows by the way they are refreshed."""
    counts = quality.row_counts({name: t.rows(name) for layer in ("CLEAN", "CURATED", "AI") for name in LAYERS[layer]})
    mode = F.when(F.col("table_name").isin(*layers.INCREMENTAL), "INCREMENTAL").otherwise("FULL")
    return counts.groupBy(mode.alias("refresh_mode")).agg(
        F.count("*").alias("tables"), F.sum("row_count").alias("row_count")
    )


def catalog(t: Tables) -> DataFrame:
    derived = sum(len(LAYERS[layer]) for layer in ("CLEAN", "CURATED", "AI"))
    sizes = {
        "tables": len(LAYERS["RAW"]) + derived + len(APP_TABLES),
        "derived": derived,
        **registries(),
    }
    return quality.catalog_frame(t.spark, sizes)


def registries() -> dict[str, int]:
    """How many of each kind the library's own registries hold."""
    return {
        "searches": len([name for name in RECIPES if name.startswith("search_")]),
        "models": len([semantic.MODEL]),
        "masks": len(governance.MASKS),
        "tags": len(governance.PII_LEVELS),
        "dashboards": len([name for name in QUERIES if name.endswith("_dashboard")]),
    }


def app_tables(t: Tables) -> dict[str, DataFrame]:
    """The application's own tables: the access mapping, the log of quality checks, the log of drafts."""
    return {"role_region_mapping": mapping(t), "ai_quality_log": quality_checks(t), "nba_email_log": alerts.retention_campaign(t["scored"])}


_stored: dict[tuple[str, str], str] = {}


def stored_catalog(t: Tables) -> DataFrame:
    """The catalog of the layers, which are written when it is first asked for."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _stored:
        path = ingest.new_folder(t.spark, "layers")
        layers.write_layers(t, path, quality.DATA_CHECKS, app_tables)
        _stored[key] = path
    return layers.read_catalog(t.spark, _stored[key])


def stored_check_suite(t: Tables) -> DataFrame:
    return layers.stored_checks(stored_catalog(t), quality.DATA_CHECKS, quality.CATALOG_CHECKS, registries())


# Tables of which the check suite and the probes ask for counts alone, or rows by category.
COUNTED = ("clean_claims", "clean_loans", "interaction_timeline", "document_extracted")


def check_suite(t: Tables) -> DataFrame:
    names = {check.table for check in quality.DATA_CHECKS} - {"populated"}
    every = {name: t.rows(name, any_row=True) for names_ in LAYERS.values() for name in names_}
    tables = {name: t.rows(name) if name in COUNTED else t[name] for name in names} | {"populated": quality.populated(every), "catalog": catalog(t)}
    return quality.check_suite(tables, (*quality.CATALOG_CHECKS, *quality.DATA_CHECKS))


def probe_results(t: Tables) -> DataFrame:
    filled = quality.union(
        t.rows(name, any_row=True).limit(1).select(F.lit(layer).alias("layer")) for layer, names in LAYERS.items() for name in names
    )
    tables = {name: t[name] for name in ("scored", "transcript_sentiment")}
    tables |= {name: t.rows(name) for name in ("document_extracted", "interaction_timeline")}
    return quality.probe_results(tables | {"layers": filled, "role_region_mapping": mapping(t)})


QUERIES |= {
    "layer_row_counts": layer_row_counts,
    "layer_totals": layer_totals,
    "refresh_mode_counts": refresh_mode_counts,
    "check_churn_completeness": lambda t: quality.check_churn_completeness(t["churn_risk"]),
    "check_nba_completeness": lambda t: quality.check_nba_completeness(t["next_best_action"]),
    "check_churn_range": lambda t: quality.check_churn_range(t["churn_risk"]),
    "check_sentiment_range": lambda t: quality.check_sentiment_range(t["transcript_sentiment"]),
    "validation_row_counts": lambda t: quality.row_counts({name: t.rows(name) for name in VALIDATED}),
    "orphan_policies": lambda t: quality.orphan_policies(t["raw_policies"], t["raw_customers"]),
    "orphan_claims": lambda t: quality.orphan_claims(t["raw_claims"], t["raw_policies"], t["raw_customers"]),
    "orphan_loans": lambda t: quality.orphan_loans(t["raw_loans"], t["raw_customers"]),
    "risk_buckets_validation": lambda t: quality.risk_buckets_validation(t["churn_risk"]),
    "label_summary": lambda t: quality.label_summary(t["transcript_sentiment"]),
    "action_priority_counts": lambda t: quality.action_priority_counts(t["next_best_action"]),
    "completeness_report": lambda t: quality.completeness_report(
        {
            "churn_risk": (t["churn_risk"], "churn_risk_score"),
            "next_best_action": (t["next_best_action"], "action_type"),
        }
    ),
    "end_to_end_top10": lambda t: t["scored"]
    .filter(F.col("churn_risk_score").isNotNull())
    .orderBy(F.col("churn_risk_score").desc(), "customer_id")
    .limit(10)
    .select(
        "customer_id", "full_name", "customer_segment", "total_premium", "composite_risk_level", "churn_risk_score",
        "retention_urgency", "action_type", "action_description", "priority",
    ),
    "check_suite": check_suite,
    "stored_layer_counts": lambda t: layers.layer_counts(stored_catalog(t)),
    "stored_check_suite": stored_check_suite,
    "probe_results": probe_results,
    "probe_summary": lambda t: quality.probe_summary(probe_results(t)),
    "churn_parse_failure": lambda t: quality.parse_failure_rate(t["churn_risk"], "churn_risk_score"),
    "nba_parse_failure": lambda t: quality.parse_failure_rate(t["next_best_action"], "action_type"),
    "ai_quality_dashboard": lambda t: quality.ai_quality_dashboard(
        t["churn_risk"], t["next_best_action"], t["document_extracted"]
    ),
    "run_history_summary": jobs.run_history,
    "run_list": jobs.run_list,
}

# -------------------------------------------------- alerts, campaign, semantics


def dashboard(t: Tables) -> DataFrame:
    return QUERIES["ai_quality_dashboard"](t)


def campaign_log(t: Tables) -> DataFrame:
    """The drafts are written once as the audit log; what is returned comes from there."""
    log = ingest.replace_table(alerts.retention_campaign(t["scored"]), ingest.new_folder(t.spark, "campaign"))
    return log.select("customer_id", "full_name", "action_type", F.col("status").alias("email_status"))


def quality_checks(t: Tables) -> DataFrame:
    """All scheduled checks as the rows of one run."""
    checks = quality.heartbeat(t.spark)
    for name in ("check_churn_completeness", "check_nba_completeness", "check_churn_range", "check_sentiment_range"):
        checks = checks.unionByName(QUERIES[name](t))
    return checks


def quality_log(t: Tables) -> DataFrame:
    """All scheduled checks written to one log as one run, then its latest entries."""
    log_dir = ingest.new_folder(t.spark, "quality")
    quality.write_log(quality_checks(t), log_dir, "first")
    return quality.latest_log(t.spark, log_dir).drop("check_timestamp")


QUERIES |= {
    "campaign_log": campaign_log,
    "quality_log": quality_log,
    "alert_critical_churn": lambda t: alerts.alert_critical_churn(t["churn_risk"]),
    "alert_vip_complaint": lambda t: alerts.alert_vip_complaint(t["customer_360_unified"]),
    "alert_quality": lambda t: alerts.alert_quality(dashboard(t), 1.0),
    "retention_campaign": lambda t: alerts.retention_campaign(t["scored"]),
    "campaign_digest": lambda t: alerts.campaign_digest(alerts.retention_campaign(t["scored"])),
    "semantic_avg_premium_by_segment": lambda t: semantic.semantic_query(
        semantic.MODEL, t, ["customer.total_premium", "customer.total_customers"], ["customer.customer_segment"]
    ),
    "semantic_docs_by_country": lambda t: semantic.semantic_query(
        semantic.MODEL, t, ["document.total_documents"], ["customer.country"]
    ),
    "semantic_risk_and_calls_by_segment": lambda t: semantic.semantic_query(
        semantic.MODEL,
        t,
        ["churn.churn_risk_score", "call.sentiment_score", "customer.total_customers"],
        ["customer.customer_segment"],
        {"customer.country": ["USA", "UK", "INDIA"]},
    ),
    "route_questions": lambda t: routing.route_questions(load_table(t.spark, t.sf_dir, "conversations")),
    "whatif_baseline": lambda t: whatif.whatif_baseline(t["scored"]),
    "whatif_scenarios": lambda t: whatif.whatif(t["scored"]),
}

# -------------------------------------------------------- ingest and refreshing

NEW_POLICY_TYPES = ("Auto", "Home", "Life", "Health", "Travel", "Cyber")
NEW_POLICY_STATUSES = ("Active", "Active", "Active", "Renewed", "Lapsed", "Cancelled")
BATCH = ingest.batch_sizes(20)


def renewals(t: Tables) -> DataFrame:
    """New policies for the active ones past their end date, numbered after the existing policies."""
    expired = t["clean_policies"].filter("is_expired").select(
        F.col("policy_id").alias("renewed_from"), "customer_id", "policy_type"
    )
    return ingest.assign_batch_ids(expired, t["raw_policies"], "policy_id", [F.col("renewed_from").asc()])


def batch_append(t: Tables) -> DataFrame:
    existing = t["raw_policies"].select("policy_id", "customer_id", "policy_type")
    table_dir = ingest.new_folder(t.spark, "policies")
    ingest.append_batch(existing, table_dir, 0)
    ingest.append_batch(renewals(t).select("policy_id", "customer_id", "policy_type"), table_dir, 1)
    return ingest.read_batches(t.spark, table_dir, existing)


def export_csv(t: Tables) -> DataFrame:
    documents = REPORTS["documents_by_kind"](t)
    path = ingest.new_folder(t.spark, "export")
    ingest.export_csv(documents, path)
    return ingest.read_csv(t.spark, path, documents)


QUERIES |= {
    "dedup_latest_claims": lambda t: t["clean_claims"].select("claim_id", "policy_id", "claim_amount", "created_at"),
    "assign_batch_ids": renewals,
    "batch_append": batch_append,
    "newest_customers": lambda t: ingest.keys_above(t["raw_customers"], "customer_id", 1500),
    "newest_policies": lambda t: ingest.newest(t["raw_policies"], "policy_id", BATCH["policies"]).select(
        "policy_id", "customer_id"
    ),
    "sample_by_hash": lambda t: ingest.sample_by_hash(
        t["clean_customers"].select("customer_id"),
        "customer_id",
        {"policy_type": NEW_POLICY_TYPES, "policy_status": NEW_POLICY_STATUSES},
        BATCH["policies"],
    ),
    "export_csv": export_csv,
    "stream_clean_interactions": jobs.stream_clean_interactions,
    "stream_interaction_agg": jobs.stream_interaction_agg,
    "stream_parse_failure": jobs.stream_parse_failure,
    "stream_alerts": jobs.stream_alerts,
    "stream_alert_events": jobs.stream_alert_events,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: present(query(tables_for(spark, sf_dir)))

    return {key: runner(query) for key, query in QUERIES.items()}
