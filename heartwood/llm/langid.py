"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from heartwood.llm.common import map_arrow, texts


#: Units per direction and bytes that the state is carried over: texts are cut into windows of this length.
HIDDEN, STEPS = 8, 64
#: Windows that run at a time.
WIDE = 4096
#: The bound on what the network learns from: labelled documents per language, passages of each, and passes.
SAMPLE, PASSAGES, UPDATES, BATCH = 400, 4, 160, 256
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class Direction:
    """Weights of one direction: per byte, between states, and to the labels. Gates are update, reset, candidate."""

    embed: np.ndarray  # 3 HIDDEN x 256
    carry: np.ndarray  # 3 HIDDEN x HIDDEN
    out: np.ndarray  # labels x HIDDEN

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.carry, self.out]


@dataclass
class Network:
    labels: list[str]
    forth: Direction
    back: Direction
    bias: np.ndarray


def windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows as STEPS columns side by side, their lengths, and the text each belongs to."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    counts = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(bodies)), counts)
    last = np.cumsum(counts) - 1
    lengths = np.full(len(owner), STEPS, np.int64)
    some = counts > 0
    lengths[last[some]] = sizes[some] - (counts[some] - 1) * STEPS
    padded = b"".join([b + bytes(-len(b) % STEPS) for b in bodies])
    return np.frombuffer(padded, np.uint8).reshape(-1, STEPS).T, lengths, owner


def run_direction(d: Direction, x: np.ndarray, live: np.ndarray, reverse: bool, trace: list | None = None) -> np.ndarray:
    """States (steps, HIDDEN, windows). Gates are hard sigmoids, the candidate is softsign: cheap and exact to derive."""
    steps, wide = x.shape
    h = np.zeros((HIDDEN, wide), np.float32)
    states = np.empty((steps, HIDDEN, wide), np.float32)
    full = live.all(axis=1)
    u = np.empty((3 * HIDDEN, wide), np.float32)
    g = np.empty_like(u)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.dot(d.carry, h, out=u)
        np.take(d.embed, x[t], axis=1, out=g, mode="clip")
        gate = g[: 2 * HIDDEN]
        gate += u[: 2 * HIDDEN]
        gate *= np.float32(0.25)
        gate += np.float32(0.5)
        np.clip(gate, 0, 1, out=gate)
        z, r = gate[:HIDDEN], gate[HIDDEN:]
        a = r * u[2 * HIDDEN :]
        a += g[2 * HIDDEN :]
        soft = np.abs(a)
        soft += np.float32(1)
        a /= soft
        if trace is not None:
            trace.append((t, h.copy(), gate.copy(), u[2 * HIDDEN :].copy(), a.copy(), soft.copy()))
        h -= a
        h *= z
        h += a
        if not full[t]:
            h *= live[t]
        states[t] = h
    return states


def label_chances(net: Network, forth: np.ndarray, back: np.ndarray, t: int) -> np.ndarray:
    """Probabilities (labels, windows) at one position."""
    p = net.forth.out @ forth[t]
    p += net.back.out @ back[t]
    p += net.bias
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p


def predict(net: Network, bodies: list[bytes]) -> np.ndarray:
    """Per text, the mean over all its positions of the label probabilities (texts, labels); no bytes, zeros."""
    x, lengths, owner = windows(bodies)
    pooled = np.zeros((len(bodies), len(net.labels)))
    for at in range(0, x.shape[1], WIDE):
        part = np.ascontiguousarray(x[:, at : at + WIDE])
        live = np.arange(STEPS)[:, None] < lengths[at : at + WIDE][None, :]
        forth, back = run_direction(net.forth, part, live, False), run_direction(net.back, part, live, True)
        total = np.zeros((len(net.labels), part.shape[1]), np.float32)
        full = live.all(axis=1)
        for t in range(STEPS):
            p = label_chances(net, forth, back, t)
            total += p if full[t] else p * live[t]
        for k, row in enumerate(total):
            pooled[:, k] += np.bincount(owner[at : at + WIDE], weights=row, minlength=len(bodies))
    sizes = np.array([max(1, len(b)) for b in bodies])
    return pooled / sizes[:, None]


def backward(d: Direction, x: np.ndarray, live: np.ndarray, trace: list, grad_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of a direction's weights, by backpropagation through time."""
    g_embed, g_carry = np.zeros_like(d.embed), np.zeros_like(d.carry)
    flowing = np.zeros_like(trace[0][1])
    for t, before, gate, un, a, soft in reversed(trace):
        g = (flowing + grad_states[t]) * live[t]
        z, r = gate[:HIDDEN], gate[HIDDEN:]
        g_a = g * (1 - z) / (soft * soft)
        inside = (gate > 0) & (gate < 1)
        g_gate = np.concatenate([g * (before - a), g_a * un]) * np.float32(0.25) * inside
        g_u = np.concatenate([g_gate, g_a * r])
        flowing = g * z + d.carry.T @ g_u
        g_carry += g_u @ before.T
        g_x = np.concatenate([g_gate, g_a])
        for k in range(3 * HIDDEN):
            g_embed[k] += np.bincount(x[t], weights=g_x[k], minlength=256)
    return [g_embed, g_carry]


def train(passages: list[bytes], labels: list[str], seed: int = 5) -> Network:
    """Fit the network to label every position of the passages with their language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.searchsorted(names, labels)

    def direction() -> Direction:
        draw = [rng.standard_normal(s).astype(np.float32) for s in ((3 * HIDDEN, 256), (3 * HIDDEN, HIDDEN), (len(names), HIDDEN))]
        return Direction(draw[0] * 0.5, draw[1] * 0.3, draw[2] * 0.3)

    net = Network(names, direction(), direction(), np.zeros((len(names), 1), np.float32))
    weights = [*net.forth.arrays(), *net.back.arrays(), net.bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    x, lengths, owner = windows(passages)
    for update in range(1, UPDATES + 1):
        pick = rng.integers(0, x.shape[1], BATCH)
        part, size, goal = np.ascontiguousarray(x[:, pick]), lengths[pick], target[owner[pick]]
        live = np.arange(STEPS)[:, None] < size[None, :]
        traces: list[list] = [[], []]
        forth, back = run_direction(net.forth, part, live, False, traces[0]), run_direction(net.back, part, live, True, traces[1])
        error = np.empty((STEPS, len(names), BATCH), np.float32)
        for t in range(STEPS):
            p = label_chances(net, forth, back, t)
            p[goal, np.arange(BATCH)] -= 1
            error[t] = p * live[t] / live.sum()
        grads = []
        for d, states, trace in ((net.forth, forth, traces[0]), (net.back, back, traces[1])):
            to_states = np.einsum("lh,tlb->thb", d.out, error)
            grads += [*backward(d, part, live, trace, to_states), np.einsum("tlb,thb->lh", error, states)]
        grads.append(error.sum(axis=(0, 2))[:, None])
        rate = 0.03 * min(1.0, 2 * (1 - update / (UPDATES + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**update)) / (np.sqrt(v / (1 - 0.99**update)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """PASSAGES passages of at most STEPS characters from each of SAMPLE texts per language, chosen by hash; copies count once."""
    usable = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    body, size = F.col(text_col), F.length(text_col)
    cuts = [F.substring(body, F.pmod(F.xxhash64(body, F.lit(k)), F.greatest(size - STEPS, F.lit(1))).cast("int") + 1, F.lit(STEPS)) for k in range(PASSAGES)]
    rows = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(body).alias("order"), F.array(*cuts).alias("cuts")).dropDuplicates(["lang", "order"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).orderBy("lang", "order").select("lang", "cuts").collect()
    pairs = [(cut.encode(), row.lang) for row in chosen for cut in row.cuts if has_letter(cut)]
    return [p for p, _ in pairs], [lang for _, lang in pairs]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the documents whose language is known and that are not held out; None if there are none."""
    passages, labels = sample(docs.where(fold(id_col) != 2), text_col, lang_col)
    return train(passages, labels) if passages else None


def has_letter(text: str) -> bool:
    """Whether a character is a letter; fractions, raised figures and circled numbers are none."""
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def tagged(docs: DataFrame, net: Network | None, carried: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc` (a struct of the carried columns), `lang_pred`, `score` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part["text"].to_pylist()
                known = [bool(net and has_letter(text)) for text in column]
                bodies = [text.encode() if yes else b"" for text, yes in zip(column, known, strict=True)]
                best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
                if net and any(known):
                    chances = predict(net, bodies)
                    best, score = chances.argmax(axis=1), chances.max(axis=1)
                names = [net.labels[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), known, strict=True)]
                yield pa.record_batch({"doc": part["doc"], "lang_pred": pa.array(names, pa.string()), "score": np.clip(score, 0, 1)})

    rows = texts(docs, id_col, text_col, carried)
    schema = StructType([rows.schema["doc"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_arrow(rows, run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score`: one row per document, over its whole text.

    The network learns from text and language of the documents whose language is known and whose crc32(doc_id as
    text) mod 4 is not 2; the others are `held_out`. It reads windows of 64 bytes in both directions and labels
    every byte; a document's probabilities are the mean over all its bytes, and `score` is that of the predicted
    language. Neither language, source nor id is read for a prediction.

    Text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to learn
    from. A null doc_id is not held out and not learnt from. Repeated rows get the same prediction. An empty
    table gives no rows; other columns are not read.
    """
    found = tagged(docs, learn(docs, id_col, text_col, lang_col), [id_col], id_col, text_col)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    doc = F.col("doc")[id_col].cast("long").alias("doc_id")
    return found.select(doc, "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in a language the network is sure of, all columns as they are but a null language filled.

    Rejected are texts without letters and those where no language has `least` of the probability. Without any
    known language nothing is rejected: there is no evidence against a text.
    """
    net = learn(docs, id_col, text_col, lang_col)
    if net is None:
        return docs
    sure = tagged(docs, net, docs.columns, id_col, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    filled = F.coalesce(F.col("doc")[lang_col], F.col("lang_pred")).alias(lang_col)
    return sure.select(*[filled if name == lang_col else F.col("doc")[name].alias(name) for name in docs.columns])
