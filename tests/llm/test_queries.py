"""What the registered queries ask of their operators."""

from __future__ import annotations

from heartwood.llm.queries import queries


def test_op5_sees_the_order_of_three_words(spark, tmp_path):
    # every pair of c's words is common, its triples are not
    texts = ["x a b y", "z a b y", "x b c y", "z b c y", "p a b c q", "p a b c q", "a b y", "x a b c q"]
    docs = [(k, t) for k, t in enumerate([*texts, "a b c q", "z b c q"])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.log_score for r in queries()["op5_lm_score"](spark, str(tmp_path)).collect()}
    words = [t.split() for _, t in docs]
    for doc_id, text in docs:
        assert abs(found[doc_id] - brute(words, doc_id)) < 1e-9, text


def brute(words, at):
    import math

    others = [w for k, w in enumerate(words) if k != at]
    total = sum(map(len, others))
    seen = lambda gram: sum(w[i : i + len(gram)] == gram for w in others for i in range(len(w)))

    def score(gram):
        if len(gram) == 1:
            return max(seen(gram), 0.5) / total
        return seen(gram) / seen(gram[:-1]) if seen(gram) else 0.4 * score(gram[1:])

    text = words[at]
    return sum(math.log(score(text[max(0, i - 2) : i + 1])) for i in range(len(text)))
