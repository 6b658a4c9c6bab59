"""Text enrichment: call sentiment and summary, model prompts, model replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heartwood.functions.columns import count_when, mean_exact, ratio
from heartwood.functions.frames import outer_key, top_per_key

SENTENCE_END = r"[.!?\n]+"
WORD = "[a-z]+"


@dataclass(frozen=True)
class Lexicon:
    """Words that raise and lower the score of a call. A fixed list, part of the plan."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]


# Words of service calls.
DEFAULT_LEXICON = Lexicon(
    positive=tuple(
        "appreciate appreciated easy excellent fantastic fast friendly glad good great happy helpful kind love nice"
        " perfect pleased polite quick resolved satisfied smooth solved thank thanks wonderful".split()
    ),
    negative=tuple(
        "angry annoyed awful bad cancel complaint confusing delay delayed denied disappointed error failed"
        " frustrated frustrating horrible late lost mistake poor problem rude slow terrible unacceptable unhappy"
        " unresolved upset waiting worst wrong".split()
    ),
)

# Fixed values for the test texts, which are syllables with common words.
TEST_LEXICON = Lexicon(
    positive=("is", "it", "with", "und", "en", "y"),
    negative=("that", "was", "by", "der", "de"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences_of(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.3, "Positive").when(score <= -0.3, "Negative").otherwise("Neutral")


def key_sentences(transcripts: DataFrame, k: int = 2) -> DataFrame:
    """Numbers of the ``k`` most representative sentences of each call.

    A sentence scores the mean frequency of its words within the call. That
    needs no statistics over other calls, so nothing moves between calls: every
    step is keyed by transcript and reuses the partitioning of the latest-row
    choice in the clean layer.
    """
    words = (
        transcripts.select("transcript_id", F.posexplode(sentences_of(F.col("transcript_text"))).alias("sentence_no", "sentence"))
        .select("transcript_id", "sentence_no", F.explode(words_of(F.col("sentence"))).alias("word"))
        .groupBy("transcript_id", "sentence_no", "word")
        .agg(F.count("*").alias("n"))
    )
    in_call = F.sum("n").over(Window.partitionBy("transcript_id", "word"))
    scored = (
        words.withColumn("in_call", in_call)
        .groupBy("transcript_id", "sentence_no")
        .agg(F.round(ratio(F.sum(F.col("n") * F.col("in_call")), F.sum("n")), 6).alias("score"))
    )
    best = top_per_key(scored, ["transcript_id"], [F.col("score").desc(), F.col("sentence_no").asc()], k)
    return best.groupBy("transcript_id").agg(F.array_sort(F.collect_list("sentence_no")).alias("chosen"))


#: Words whose document frequencies are sent to every task, the most frequent ones; all others are joined by a shuffle.
HOT_WORDS = 2000


def document_frequencies(words: DataFrame) -> DataFrame:
    """`word`, `df`: in how many calls each word occurs."""
    return words.select("transcript_id", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))


def rare_sentences(transcripts: DataFrame, k: int = 2, hot_words: int = HOT_WORDS) -> DataFrame:
    """Numbers of the ``k`` sentences of each call whose words say most: the mean inverse document frequency.

    The frequencies are over all calls. A word that is in most calls would send most rows to one task, so those of
    the ``hot_words`` most frequent words, a bounded number, go to every task inside a broadcast; only rows of rarer
    words move, and no one of these holds many. The weights are rounded to six digits and added up as decimals, so
    that the result has no summation order.
    """
    sentences = transcripts.select("transcript_id", F.posexplode(sentences_of(F.col("transcript_text"))).alias("sentence_no", "sentence"))
    words = (
        sentences.select("transcript_id", "sentence_no", F.explode(words_of(F.col("sentence"))).alias("word"))
        .groupBy("transcript_id", "sentence_no", "word")
        .agg(F.count("*").alias("n"))
    )
    frequencies = document_frequencies(words)
    hot = frequencies.orderBy(F.col("df").desc(), F.col("word").asc()).limit(hot_words)
    hot = hot.select(F.col("word").alias("_hot"), F.col("df").alias("_hot_df"))
    marked = words.join(F.broadcast(hot), F.col("word") == F.col("_hot"), "left")
    marked = marked.withColumn("_rare", outer_key(F.when(F.col("_hot").isNull(), F.col("word"))))
    rare = frequencies.select(F.col("word").alias("_word"), "df")
    counted = marked.join(rare, F.col("_rare") == F.col("_word"), "left").withColumn("df", F.coalesce("_hot_df", "df"))
    calls = transcripts.agg(F.count("*").cast("double")).scalar()
    idf = F.round(F.log(calls / F.col("df").cast("double")), 6).cast("decimal(18,6)")
    scored = (
        counted.withColumn("idf", idf)
        .groupBy("transcript_id", "sentence_no")
        .agg(F.round(F.sum(F.col("n") * F.col("idf")).cast("double") / F.sum("n"), 6).alias("score"))
    )
    best = top_per_key(scored, ["transcript_id"], [F.col("score").desc(), F.col("sentence_no").asc()], k)
    return best.groupBy("transcript_id").agg(F.array_sort(F.collect_list("sentence_no")).alias("chosen"))


def summary_text(text: Column, chosen: Column) -> Column:
    """The chosen sentences of a text in their own order; '' when the text has no words."""
    sentences = sentences_of(text)
    kept = F.transform(chosen, lambda i: F.trim(F.element_at(sentences, (i + 1).cast("int"))))
    return F.coalesce(F.concat(F.array_join(kept, ". "), F.lit(".")), F.lit(""))


def call_summary(transcripts: DataFrame, k: int = 2) -> DataFrame:
    return transcripts.join(key_sentences(transcripts, k), "transcript_id", "left").select(
        "transcript_id", summary_text(F.col("transcript_text"), F.col("chosen")).alias("call_summary")
    )


def call_summary_idf(transcripts: DataFrame, k: int = 2) -> DataFrame:
    """The summary by corpus-wide word statistics instead of those of the call."""
    return transcripts.join(rare_sentences(transcripts, k), "transcript_id", "left").select(
        "transcript_id", summary_text(F.col("transcript_text"), F.col("chosen")).alias("call_summary")
    )


def transcript_sentiment(transcripts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score in [-1, 1], label and summary of every call. The score is local to the row."""
    hits = lambda listed: F.size(F.filter("_words", lambda w: w.isin(*listed)))
    found = transcripts.withColumn("_words", words_of(F.col("transcript_text"))).withColumns(
        {"_up": hits(lexicon.positive), "_down": hits(lexicon.negative)}
    )
    up, down = F.col("_up"), F.col("_down")
    scored = found.withColumn("sentiment_score", F.coalesce(F.round(ratio(up - down, up + down), 4), F.lit(0.0)))
    return scored.join(key_sentences(transcripts), "transcript_id", "left").select(
        "transcript_id",
        "customer_id",
        "call_date",
        "call_reason",
        "agent_name",
        "duration_seconds",
        "transcript_text",
        "sentiment_score",
        sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
        summary_text(F.col("transcript_text"), F.col("chosen")).alias("call_summary"),
    )


def customer_calls(sentiment: DataFrame) -> DataFrame:
    """One grouping for everything the scores need from the calls: roll-up and latest call."""
    when = F.struct(F.col("call_date").isNull(), "call_date", "transcript_id")
    return sentiment.groupBy("customer_id").agg(
        mean_exact(F.col("sentiment_score"), "decimal(9,4)").alias("avg_sentiment_score"),
        F.min("sentiment_score").alias("worst_sentiment_score"),
        count_when(F.col("sentiment_label") == "Negative").alias("negative_call_count"),
        F.max_by("call_summary", when).alias("latest_call_summary"),
        F.max_by("sentiment_score", when).alias("latest_sentiment_score"),
        F.max_by("sentiment_label", when).alias("latest_sentiment_label"),
        F.max_by("call_reason", when).alias("latest_call_reason"),
    )


def customer_sentiment(calls: DataFrame) -> DataFrame:
    return calls.select("customer_id", "avg_sentiment_score", "worst_sentiment_score", "negative_call_count")


def latest_call(calls: DataFrame) -> DataFrame:
    return calls.select(
        "customer_id",
        F.col("latest_call_summary").alias("call_summary"),
        "latest_sentiment_score",
        "latest_sentiment_label",
        "latest_call_reason",
    )


# ------------------------------------------------------------------ prompts


def _features(pairs: Sequence[tuple[str, Column]]) -> list[Column]:
    parts: list[Column] = []
    for i, (name, value) in enumerate(pairs):
        parts += [F.lit(f"{', ' if i else ''}{name}="), value]
    return parts


def _text(name: str, missing: str | None = None) -> Column:
    value = F.col(name).cast("string")
    return value if missing is None else F.coalesce(value, F.lit(missing))


CHURN_INSTRUCTION = (
    "Assess the churn risk of this insurance and lending customer. Reply with one JSON object only, with the keys"
    " churn_risk_score (0.0 to 1.0), risk_factors (up to 4 short strings), retention_urgency (Critical, High, Medium"
    " or Low) and confidence (0.0 to 1.0). Customer: "
)
ACTION_INSTRUCTION = (
    "Choose the single best next action for this customer. Reply with one JSON object only, with the keys action_type"
    " (Retention_Offer, Policy_Review, Claims_Followup, Upsell, Payment_Assistance, Proactive_Outreach,"
    " Renewal_Reminder or Complaint_Resolution), action_description, priority (High, Medium or Low), channel (Email,"
    " Phone, InApp or Branch) and rationale. Customer: "
)
DOCUMENT_INSTRUCTION = (
    "Read this insurance document. Reply with one JSON object only, with the keys reference_number, policy_number,"
    " customer_name, customer_id, document_date, amount, category, status and description. Document: "
)


def churn_prompt() -> Column:
    """Prompt over the columns of ``scored_customers``. A NULL tenure or activity makes it NULL."""
    plain = (
        "active_policies lapsed_policies total_premium open_claims denied_claims complaint_count escalation_count"
        " max_days_past_due problem_loans days_since_last_interaction"
    ).split()
    sentiment = F.coalesce(F.col("avg_sentiment").cast("decimal(9,4)").cast("string"), F.lit("no_calls"))
    pairs = [
        ("segment", _text("customer_segment")),
        ("tenure_months", _text("tenure_months")),
        ("credit_score", _text("credit_score", "unknown")),
        *[(name, _text(name)) for name in plain],
        ("avg_call_sentiment", sentiment),
        ("negative_call_count", _text("negative_call_count", "0")),
        ("is_active", _text("is_active")),
    ]
    return F.concat(F.lit(CHURN_INSTRUCTION), *_features(pairs))


def nba_prompt() -> Column:
    """Prompt over the columns of ``next_best_action``; the call summary is cut at 300 characters."""
    pairs = [
        ("name", _text("full_name")),
        ("segment", _text("customer_segment")),
        ("churn_risk", _text("churn_risk_score", "unknown")),
        ("retention_urgency", _text("retention_urgency", "unknown")),
        ("active_policies", _text("active_policies")),
        ("total_premium", F.concat(F.lit("$"), _text("total_premium"))),
        ("open_claims", _text("open_claims")),
        ("days_to_renewal", _text("next_renewal_days", "none")),
        ("days_past_due", _text("max_days_past_due")),
        ("estimated_clv", F.concat(F.lit("$"), F.round("estimated_clv", 0).cast("decimal(38,0)").cast("string"))),
        ("latest_call_sentiment", _text("latest_sentiment_label", "no_calls")),
        ("latest_call_reason", _text("latest_call_reason", "none")),
        ("latest_call_summary", F.coalesce(F.left("latest_call_summary", F.lit(300)), F.lit("no recent calls"))),
    ]
    return F.concat(F.lit(ACTION_INSTRUCTION), *_features(pairs))


def document_prompt(text: Column) -> Column:
    """Instruction and the first 3000 characters: the limit of the model's input, not of the extraction here."""
    return F.concat(F.lit(DOCUMENT_INSTRUCTION), F.left(text, F.lit(3000)))


# ------------------------------------------------------------------ replies


def parse_model_json(raw: Column, fields: Mapping[str, str]) -> Column:
    """Cut the JSON object out of a reply and read typed fields; NULL where that fails.

    The parser stops after one value and ignores what follows, so the text is
    read as the only element of a list: anything after the object makes that
    fail. The one-element ``transform`` binds the parsed value, so each reply is
    parsed once.
    """
    text = F.regexp_substr(raw, F.lit(r"\{[\s\S]*\}"))
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))

    def typed(v: Column) -> Column:
        alone = F.try_variant_get(v, "$[1]", "variant").isNull()
        values = {name: F.try_variant_get(v, f"$[0].{name}", kind) for name, kind in fields.items()}
        return F.struct(*[F.when(alone, value).alias(name) for name, value in values.items()])

    return F.transform(F.array(parsed), typed).getItem(0)


CHURN_FIELDS = {
    "churn_risk_score": "double",
    "retention_urgency": "string",
    "risk_factors": "array<string>",
    "confidence": "double",
}


def batch_complete(
    df: DataFrame,
    prompt_col: str,
    completer: Callable[[list[str]], list[str | None]],
    output_col: str = "reply",
    table_dir: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Apply a completer to a prompt column, one Arrow batch of prompts per call.

    With ``table_dir`` the replies are written there first, so that later reads
    never ask the model twice for the same row. NULL prompts are not sent.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            sent = batch[prompt_col].notna()
            replies[sent] = completer(batch.loc[sent, prompt_col].tolist())
            yield batch.assign(**{output_col: replies})

    spread = df.repartition(partitions) if partitions else df
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{output_col}` string"])
    replied = spread.mapInPandas(answer, schema)
    if table_dir is None:
        return replied
    replied.write.mode("overwrite").parquet(table_dir)
    return df.sparkSession.read.schema(replied.schema).parquet(table_dir)
