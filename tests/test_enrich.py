from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from heartwood.operators import enrich
from heartwood.operators.routing import route_questions

CALLS = "transcript_id, customer_id, call_date, call_reason, agent_name, duration_seconds, transcript_text"


def calls(rows, *texts):
    values = ", ".join(f"({i}L, 1L, TIMESTAMP_NTZ '2024-01-0{i + 1} 00:00:00', 'Claim', 'A', 60, '{text}')" for i, text in enumerate(texts))
    return rows(CALLS, values)


LEXICON = enrich.Lexicon(positive=("good", "great"), negative=("bad", "poor"))


def test_scores_and_labels_at_their_limits(rows):
    texts = [
        "good", "bad", "nothing", "good bad",
        " ".join(["good"] * 13 + ["bad"] * 7), " ".join(["good"] * 129 + ["bad"] * 71),
        " ".join(["good"] * 7 + ["bad"] * 13), "",
    ]
    found = {r.transcript_id: (r.sentiment_score, r.sentiment_label) for r in enrich.transcript_sentiment(calls(rows, *texts), LEXICON).collect()}
    assert found == {
        0: (1.0, "Positive"), 1: (-1.0, "Negative"), 2: (0.0, "Neutral"), 3: (0.0, "Neutral"),
        4: (0.3, "Positive"), 5: (0.29, "Neutral"), 6: (-0.3, "Negative"), 7: (0.0, "Neutral"),
    }


def test_the_whole_text_counts(rows):
    text = "good " + "x " * 5000 + "bad bad bad"
    assert enrich.transcript_sentiment(calls(rows, text), LEXICON).first().sentiment_score == -0.5


def test_words_match_whole_words_in_any_case(rows):
    assert enrich.transcript_sentiment(calls(rows, "GOOD goods badly Poor great"), LEXICON).first().sentiment_score == 0.3333


def test_summary_keeps_the_order_of_the_call(rows):
    text = "Hello there. The claim is late. Weather talk again. The claim is the issue. 123."
    found = enrich.call_summary(calls(rows, text, "!!!"), 2).orderBy("transcript_id").collect()
    assert [r.call_summary for r in found] == ["The claim is late. The claim is the issue.", ""]


def test_latest_call_per_customer(rows):
    sentiment = enrich.transcript_sentiment(calls(rows, "good", "bad", "bad good"), LEXICON)
    row = enrich.customer_calls(sentiment).first()
    assert (row.latest_sentiment_label, row.latest_call_summary, row.negative_call_count) == ("Neutral", "bad good.", 1)
    assert (row.avg_sentiment_score, row.worst_sentiment_score) == (0.0, -1.0)


def test_model_replies(rows):
    fields = {"score": "double", "label": "string", "tags": "array<string>"}
    replies = [
        '```json\\n{"score": 0.7, "label": "x", "tags": ["a", "b"]}\\n```',
        '{"score": "0.7"}',
        '{"score": "high", "label": 3}',
        "no json here",
        '{"score": }',
        'first {"score": 1} then {"score": 2}',
        '{"score": 1}, {"score": 2}',
    ]
    df = rows("i, raw", ", ".join(f"({i}, '{r}')" for i, r in enumerate(replies)) + ", (7, NULL)")
    parsed = df.select("i", enrich.parse_model_json(F.col("raw"), fields).alias("p")).select("i", "p.*")
    found = {r.i: (r.score, r.label, r.tags) for r in parsed.collect()}
    assert found[0] == (0.7, "x", ["a", "b"])
    assert found[1] == (0.7, None, None)
    assert found[2] == (None, "3", None)
    assert all(found[i] == (None, None, None) for i in (3, 4, 5, 6, 7))


def test_batch_complete_asks_once_per_prompt(rows, tmp_path):
    def upper(prompts):
        assert all(p is not None for p in prompts)
        return [p.upper() for p in prompts]

    df = rows("id, prompt", "(1, 'a'), (2, NULL), (3, 'c')")
    done = enrich.batch_complete(df, "prompt", upper, "answer", str(tmp_path / "answers"), partitions=2)
    assert {r.id: r.answer for r in done.collect()} == {1: "A", 2: None, 3: "C"}
    assert "PythonMapInArrow" not in done._jdf.queryExecution().toString()
    assert "MapInPandas" not in done._jdf.queryExecution().toString()


def test_prompts_vanish_with_a_null_feature(tables):
    prompts = tables["scored"].select("tenure_months", enrich.churn_prompt().alias("p"))
    assert prompts.filter("(tenure_months IS NULL) <> (p IS NULL)").count() == 0
    assert prompts.filter("tenure_months IS NULL").count() > 0


def test_routes(rows):
    questions = [
        ("Show the TOP churn customers", "qa_top_churn"),
        ("distribution of churn", "qa_churn_distribution"),
        ("sentiment by segment", "qa_sentiment_segment"),
        ("claims with risk", "qa_claims_risk"),
        ("open claims", "other"),
        ("premium at high level", "qa_premium_high"),
        ("any complaint", "qa_complaints"),
        ("documents please", "qa_documents"),
        ("what is the weather", "guard"),
        ("tell me about acme", "guard"),
    ]
    values = ", ".join(f"({i}, 0, 'user', '{q}')" for i, (q, _) in enumerate(questions)) + ", (99, 1, 'assistant', 'claim')"
    turns = rows("conv_id, turn, role, text", values)
    assert [r.route for r in route_questions(turns).orderBy("conv_id").collect()] == [route for _, route in questions]
    assert route_questions(turns, ["Acme"]).filter("conv_id = 9").first().route == "other"


def test_the_default_list_reads_plain_english(rows):
    texts = "Thank you, that was quick and the agent was very helpful.", "I am frustrated, the claim was denied and the delay is unacceptable.", "It is with the office that was by the river."
    found = {r.transcript_id: r.sentiment_label for r in enrich.transcript_sentiment(calls(rows, *texts), enrich.DEFAULT_LEXICON).collect()}
    assert [found[k] for k in sorted(found)] == ["Positive", "Negative", "Neutral"]


def test_rare_sentences_by_brute_force_with_hot_words_sent_or_joined(rows):
    calls = {1: "the cat sat. the dog ran far! zebra", 2: "the the the. the cat", 3: "", 4: "the dog. of course the dog? the cat sat"}
    values = ", ".join(f"({k}L, '{text}')" for k, text in calls.items())
    df = rows("transcript_id, transcript_text", values)
    split = {k: [re.findall("[a-z]+", s) for s in re.split("[.!?\n]+", text)] for k, text in calls.items()}
    counts = Counter(w for some in split.values() for w in {w for s in some for w in s})
    idf = {w: round(math.log(len(calls) / n), 6) for w, n in counts.items()}
    want = {}
    for k, some in split.items():
        scores = {i: round(sum(idf[w] for w in s) / len(s), 6) for i, s in enumerate(some) if s}
        if scores:
            want[k] = sorted(sorted(scores, key=lambda i: (-scores[i], i))[:2])
    for hot in (1, 3, 2000):
        found = {r.transcript_id: r.chosen for r in enrich.rare_sentences(df, 2, hot).collect()}
        assert found == want


def test_words_of_the_caller_are_no_patterns(rows):
    turns = rows("conv_id, turn, role, text", "(1L, 1L, 'user', 'is a.b+c here'), (2L, 1L, 'user', 'is axbbc here')")
    found = {r.conv_id: r.route for r in route_questions(turns, ["A.B+C"]).collect()}
    assert found == {1: "other", 2: "guard"}
