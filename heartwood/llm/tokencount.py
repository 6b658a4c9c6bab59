"""Token counts of whole texts, without encoding them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import map_arrow
from heartwood.llm.transducer import MOST_STATES, Transducer

#: Characters that are read at a time; longer texts are read in parts.
TOGETHER = 1 << 20


def _counts(transducer: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text, a text in front of which the model puts a space."""
    totals = np.zeros(len(texts), np.int64)
    if len(transducer.states) > MOST_STATES:
        transducer.forget()
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < TOGETHER):
            size += len(texts[high]) + 1
            high += 1
        spaced = [" " + text if text else "" for text in texts[low:high]]
        if size <= 2 * TOGETHER:
            letters = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
            edges = np.concatenate(([0], np.cumsum([len(text) for text in spaced])))
            totals[low:high], _ = transducer.count(transducer.classes[letters], edges)
        else:  # one very long text
            state = 0
            for at in range(0, len(spaced[0]), TOGETHER):
                letters = np.frombuffer(spaced[0][at : at + TOGETHER].encode("utf-32-le"), np.uint32)
                some, state = transducer.count(transducer.classes[letters], np.array([0, len(letters)]), state)
                totals[low] += some[0]
        low = high
    return totals


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more tokens than `limit`).

    `path` names a sentencepiece byte-pair model. It is compiled to a transducer whose transitions carry what the
    count changes by; texts are cut into chunks that are read side by side, and the chunks' state maps are composed
    by a scan. Nothing is shuffled, so no document waits for another.

    Null and empty texts have no bytes and no tokens. Strings of control tokens inside texts are ordinary text.
    Very long texts are read in parts of a million characters, with the state carried over. Null ids stay null;
    repeated rows get the same result each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer.of(path)
        for batch in batches:
            tokens = _counts(transducer, batch["text"].to_pylist())
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": tokens})

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
