"""Question routing: refuse, answer by a named report, or pass on."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that put a question in scope. The insurer's own name is added by the caller.
DOMAIN_WORDS = (
    "customer", "customers", "churn", "risk", "policy", "policies", "claim", "claims",
    "loan", "loans", "premium", "segment", "segments", "sentiment", "action", "actions",
    "complaint", "complaints", "escalation", "interactions", "retention", "vip",
    "basic", "standard", "score", "transcript", "insurance", "lending", "billing",
    "coverage", "payment", "nba", "next best", "360", "call", "document", "documents",
    "robert", "lisa", "david", "donald", "dorothy", "kenji", "barbara", "sarah", "joseph",
    "tanaka", "ramirez", "harris", "smith", "martin", "singh", "jones", "miller", "brown",
)

# Fixed values: (all of these words, any of these words, the report that answers), first match wins.
PATTERNS = (
    (("top", "churn"), (), "qa_top_churn"),
    (("distribution", "churn"), (), "qa_churn_distribution"),
    (("sentiment", "segment"), (), "qa_sentiment_segment"),
    (("claim",), ("churn", "risk"), "qa_claims_risk"),
    (("premium",), ("high", "risk"), "qa_premium_high"),
    (("complaint",), (), "qa_complaints"),
    (("document",), (), "qa_documents"),
)


def in_scope(question: Column, company_words: Sequence[str] = ()) -> Column:
    words = [re.escape(w.lower()) for w in (*DOMAIN_WORDS, *company_words)]
    return F.regexp_like(F.lower(question), F.lit("|".join(words)))


def route(question: Column, company_words: Sequence[str] = ()) -> Column:
    """'guard' when out of scope, else the first matching report, else 'other'."""
    text = F.lower(question)
    chosen = F.when(~in_scope(question, company_words), "guard")
    for every, some, name in PATTERNS:
        matches = F.lit(True)
        for word in every:
            matches = matches & text.contains(word)
        if some:
            any_of = F.lit(False)
            for word in some:
                any_of = any_of | text.contains(word)
            matches = matches & any_of
        chosen = chosen.when(matches, name)
    return chosen.otherwise("other")


def route_questions(turns: DataFrame, company_words: Sequence[str] = ()) -> DataFrame:
    asked = turns.filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", route(F.col("text"), company_words).alias("route"))
