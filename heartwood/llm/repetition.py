"""Quality rules on repetition: characters inside repeated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heartwood.llm.common import map_arrow, texts, utf8
from heartwood.llm.exchange import BYTE_VALUES, Block, covered, prefix_sums, window_keys
from heartwood.llm.substrings import words

#: Bytes of text that are looked at together.
TOGETHER = 1 << 20
#: Largest share of a document's characters inside repeated n-grams, by n, and inside repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: Windows of the base rule, fewest words, and most words in repeated windows in percent.
BASE_WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in text order: which are equal to another one, and which to an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    earlier, any_other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    any_other[order[1:][same]] = True
    any_other[order[:-1][same]] = True
    return any_other, earlier


def measure(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text. Windows of all texts are sorted together, their keys salted by the text."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    body = np.frombuffer(b"\n".join(bodies), np.uint8)
    block = Block(0, pa.array([], pa.int64()), body, ends - lengths, ends)
    starts, stops, firsts, lasts = words(block)
    n, docs = len(starts), len(bodies)
    salt = window_keys(np.arange(docs + 1, dtype=np.uint64), np.zeros(docs, np.int64), np.arange(1, docs + 1))
    doc = np.repeat(np.arange(docs), lasts - firsts)

    points = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))  # characters before each byte
    chars = points[stops] - points[starts]
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[body])))
    out = {
        "n_words": lasts - firsts,
        "word_chars": np.bincount(doc, weights=chars, minlength=docs).astype(np.int64),
        "n_symbols": symbols[block.ends] - symbols[block.starts],
    }

    sums = prefix_sums(BYTE_VALUES[body])
    line_ends = np.append(np.flatnonzero(body == 10), len(body))
    line_starts = np.append(0, line_ends[:-1] + 1)
    before = np.searchsorted(starts, line_starts)
    with_word = before < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(block.ends, line_starts)
    _, again = groups_of(window_keys(sums, line_starts, line_ends) ^ salt[line_doc])
    inside = np.zeros(n + 1, np.int64)
    first_word, past_word = np.searchsorted(starts, line_starts[again]), np.searchsorted(starts, line_ends[again])
    inside[first_word] += 1
    np.subtract.at(inside, past_word, 1)
    line_chars = np.where(np.cumsum(inside[:-1]) > 0, chars, 0)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    out["dup_line_chars"] = np.bincount(doc, weights=line_chars, minlength=docs).astype(np.int64)

    word_sums = prefix_sums(window_keys(sums, starts, stops))
    left = lasts[doc] - np.arange(n) if n else np.zeros(0, np.int64)  # words from here to the end of the text
    at = np.flatnonzero(left >= BASE_WINDOW)
    shared, _ = groups_of(window_keys(word_sums, at, at + BASE_WINDOW) ^ salt[doc[at]])
    at = at[shared]
    out["n_repeat_words"] = np.bincount(doc[covered(n, at, BASE_WINDOW)], minlength=docs)
    for size in sorted(NGRAM_LIMITS):  # a longer window repeats only where the shorter one does
        at = at[left[at] >= size]
        shared, again = groups_of(window_keys(word_sums, at, at + size) ^ salt[doc[at]])
        hit = covered(n, at[again], size)
        out[f"dup_chars_{size}"] = np.bincount(doc, weights=np.where(hit, chars, 0), minlength=docs).astype(np.int64)
        at = at[shared]
    return out


def verdict(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails, and whether the document is kept."""
    n, chars = found["n_words"], found["word_chars"]
    base_failed = (n < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * n)
    kept = ~base_failed & (found["dup_line_chars"] <= LINE_LIMIT * chars)
    for size, limit in NGRAM_LIMITS.items():
        kept &= found[f"dup_chars_{size}"] <= limit * chars
    return base_failed, kept


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`,
    `base_failed`, `kept`, `dup_line_chars`, `dup_chars_5` to `dup_chars_10`.

    Words are runs of characters other than ASCII white space. `dup_chars_n` counts the characters of words
    inside n-word windows that occur earlier in the text, `dup_line_chars` those in lines equal to an earlier
    one. A document is kept if the base rule holds (50 words or more, at most half of them in repeated 3-word
    windows) and each count stays within its share of the word characters.

    Null, empty and blank texts have zero counts and fail the base rule. Repeated rows get the same result each.
    An empty table gives no rows; other columns are not read. Memory: a megabyte of text, or one longer text.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    names += [f"dup_chars_{size}" for size in NGRAM_LIMITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = utf8(batch["text"])
            cuts = np.cumsum([len(b) for b in bodies]) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(bodies)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                found = measure(bodies[low:high])
                base_failed, kept = verdict(found)
                columns = {name: found[name].astype(np.int64) for name in names}
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(low, high - low), **columns, "base_failed": base_failed, "kept": kept})

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in names) + ", base_failed boolean, kept boolean"
    order = [*names[:5], "base_failed", "kept", *names[5:]]
    return map_arrow(texts(docs, id_col, text_col), run, schema).select("doc_id", *order)
