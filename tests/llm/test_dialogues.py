"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import heartwood.llm.dialogues as dialogues
from heartwood.llm.dialogues import Row, Weights, applied, cheapest, damage, repair, stretch
from heartwood.llm.queries import queries

PATTERN = re.compile(r"(s?(ua)+)?\Z")
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def searched(rows, pruned=False):
    """Cost, audit and emitted initials of the cheapest edits; the queue hands out paths by cost and audit."""
    queue, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, at, out = heapq.heappop(queue)
        if at == len(rows) and PATTERN.match(out):
            return cost, audit, out
        key = at, out[-1:] if len(out) != 1 or out != "s" else "s"
        if pruned and key in seen:
            continue
        seen.add(key)
        for role in "ua":
            if len(out) < 2 * len(rows) + 2:
                heapq.heappush(queue, (cost + 2, audit + "I", at, out + role))
        if at < len(rows):
            row = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, out))
            if not row.goes:
                if row.initial:
                    heapq.heappush(queue, (cost + row.cut, audit + "K", at + 1, out + row.initial))
                for role in "ua":
                    heapq.heappush(queue, (cost + 2 + row.cut, audit + "R", at + 1, out + role))
        queue = [q for q in queue if re.match(r"(s?(ua)*u?)?\Z", q[3])]
        heapq.heapify(queue)


rows = st.lists(st.builds(Row, st.sampled_from(["u", "a", "s", "x", ""]), st.booleans(), st.booleans()), max_size=5)


@given(rows)
@settings(max_examples=300, deadline=None)
def test_integers_find_the_cheapest_and_least_edits(some):
    assert cheapest(some) == searched(some)[:2]


@given(rows, rows, rows)
@settings(max_examples=200, deadline=None)
def test_stretches_compose_to_the_whole(a, b, c):
    parts = [part for part in (a, b, c) if part]
    weights = Weights(sum(map(len, parts)))
    at = weights.end()
    for part in reversed(parts):
        ways = stretch(part)
        at = [min(weights.never if ways[4 * p + q] is None else weights.joined(*ways[4 * p + q], at[q]) for q in range(4)) for p in range(4)]
    assert weights.told(at[0]) == cheapest(a + b + c)


def test_edits_are_applied():
    turns = [("assistant", "x."), ("system", "y."), ("user", "z.")]
    assert applied("IKDKI", 0, turns) == [("user", ""), ("assistant", "x."), ("user", "z."), ("assistant", "")]
    assert applied("", 0, []) == []


def brute(given):
    """The report of every conversation, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in given}:
        text = lambda v: " " if v is None else str(v)
        after = []
        for _, turn, role, body in sorted((r for r in given if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            fault, role, body = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20, text(role), text(body)
            if fault == 0:
                continue
            body = "" if fault == 1 else re.sub("[.!?]", "", body) if fault == 2 else body
            after += [(turn, "user" if fault == 4 else role, body)] * (2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, seen = [], set()
        for _, role, body in after:
            words = re.findall(r"[^\x20\x09-\x0D]", body)
            kinds.append("b" if not words else "d" if (role, body) in seen else "t" if words[-1] not in ".!?" else "")
            seen.add((role, body))
        initials = [role[:1] for _, role, _ in after]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        cost, audit, emitted = searched([Row(i, k in ("b", "d"), k == "t") for i, k in zip(initials, kinds, strict=True)], pruned=True)
        told, left = [], iter(after)
        for letter in audit:
            _, role, body = (None, "", "") if letter == "I" else next(left)
            if letter != "D":
                name = role if letter == "K" else {"u": "user", "a": "assistant"}[emitted[len(told)]]
                told.append(f"{name}:{body}")
        numbers = [t for t, _, _ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(told).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[name] for name in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_the_query_equals_the_search(spark, sf_dir):
    given = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(queries()["op11_conversation_repair"](spark, sf_dir)) == brute(given)


def awkward_rows():
    draw = random.Random(5)
    texts = ["Yes.", "No!", "what", " ", "", "a\nb?", "Yes.", None, "\x0b\t", "é…", "x" * 40 + ".", "x" * 40 + "!"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(texts)) for c in range(40) for t in range(draw.randint(1, 7))]
    rows += [(None, t, "user", f"null {t}.") for t in range(5)] + [(50, None, "user", "Hi."), (50, None, "assistant", "Hi."), (50, 9, "user", "Hi.")]
    rows += [(60, 1, "user", "same.")] * 6 + [(61, None, None, None)] + [(62, t, "user", f"t{t}.") for t in (-3, 5, 900)]
    rows += [(70, t, "user" if t % 2 else "assistant", f"word {t % 50}.") for t in range(260)]
    return rows


@pytest.mark.parametrize("segment", [3, 512])
def test_awkward_rows_whole_or_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(dialogues, "SEGMENT", segment)
    rows = awkward_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumn("times", F.lit("x")).withColumn("part", F.lit(1))
    assert found(repair(damage(df))[0]) == brute(rows)
    assert repair(damage(df.limit(0)))[0].collect() == []


def test_repaired_turns_are_those_of_the_digest(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "SEGMENT", 4)
    df = spark.createDataFrame(awkward_rows(), "conv_id long, turn long, role string, text string")
    reports, turns = repair(damage(df))
    told = {}
    for r in turns.orderBy("conv_id", "part", "piece").collect():
        told.setdefault(r.conv_id, []).extend(f"{t.role}:{t.text}" for t in r.turns)
    for r in reports.collect():
        lines = told.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_a_conversation_of_which_nothing_is_left(spark):
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, 0, "user", "x.") for c in lost], "conv_id long, turn long, role string, text string")
    zeros = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert lost and found(repair(damage(df))[0]) == dict.fromkeys(lost, zeros)
