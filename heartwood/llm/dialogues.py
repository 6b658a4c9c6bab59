"""Repair of damaged conversations by the cheapest edits, decided by whole numbers alone.

A conversation's rows are read from left to right; its edits are a path through a graph without cycles, from row to
row and between four places in the pattern `(s?(ua)+)?` of role initials. The weight of a path is one whole number:
its high digits are the cost, its low digits spell the audit letters, three bits each, first letter on top, zeros
behind the last one. The smallest number is the cheapest path, and among equally cheap ones the one whose audit
comes first in ASCII, as a shorter spelling that another continues ends in zeros. So plain minima of integers settle
costs and ties at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.llm.common import keep, map_arrow

#: Rows and characters of a conversation that a task holds; longer ones are repaired in segments of so many rows.
SEGMENT, MOST_CHARS = 512, 1 << 22

WHITE = " \t\n\x0b\x0c\r"
#: Places in the pattern: nothing yet, after the system's row, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a row of the one role that may come next leads to.
FILLS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Edits in ASCII order, as octal digits; 0 is the padding.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
DIGITS = str.maketrans("DIKR", "1234")
DELETE_COST, INSERT_COST, REROLE_COST = 3, 2, 2


class Row(NamedTuple):
    """What an edit needs to know of a row: role initial, whether it has to go, whether it costs to leave it."""

    initial: str
    goes: bool
    cut: bool


class Weights:
    """Path weights with room for the audit of `rows` rows: each row's letter and two inserts around each."""

    def __init__(self, rows: int):
        self.room = 3 * rows + 2
        self.shift = 3 * self.room
        self.mask = (1 << self.shift) - 1
        self.never = 1 << self.shift + 64

    def before(self, letter: int, cost: int, rest: int) -> int:
        """The weight of an edit followed by the path `rest`: the other letters move down by one place."""
        if rest >= self.never:
            return self.never
        return (rest >> self.shift) + cost << self.shift | letter << self.shift - 3 | (rest & self.mask) >> 3

    def joined(self, cost: int, audit: str, rest: int) -> int:
        """The weight of a stretch with this audit followed by the path `rest`."""
        if rest >= self.never:
            return self.never
        digits = int(audit.translate(DIGITS), 8) << self.shift - 3 * len(audit) if audit else 0
        return (rest >> self.shift) + cost << self.shift | digits | (rest & self.mask) >> 3 * len(audit)

    def told(self, weight: int) -> tuple[int, str] | None:
        """Cost and audit of a path, None if there is no path."""
        if weight >= self.never:
            return None
        return weight >> self.shift, f"{weight & self.mask:0{self.room}o}".rstrip("0").translate(LETTERS)

    def inserted(self, at: Sequence[int]) -> list[int]:
        """The least weights from each place if rows may be inserted first."""
        user = min(at[USER], self.before(INSERT, INSERT_COST, at[ASSISTANT]))
        assistant = min(at[ASSISTANT], self.before(INSERT, INSERT_COST, at[USER]))
        led = self.before(INSERT, INSERT_COST, user)
        return [min(at[START], led), min(at[SYSTEM], led), user, assistant]

    def end(self) -> list[int]:
        """The least weights from each place behind the last row."""
        return self.inserted([0, self.never, self.never, 0])

    def swept(self, rows: Sequence[Row], at: Sequence[int]) -> list[int]:
        """The least weights from each place in front of the rows, given those behind them."""
        for row in reversed(rows):
            fresh = []
            for place in range(4):
                best = self.before(DELETE, DELETE_COST, at[place])
                if not row.goes:
                    kept = KEEPS.get((place, row.initial))
                    if kept is not None:
                        best = min(best, self.before(KEEP, int(row.cut), at[kept]))
                    best = min(best, self.before(REROLE, REROLE_COST + row.cut, at[FILLS[place]]))
                fresh.append(best)
            at = self.inserted(fresh)
        return list(at)


def cheapest(rows: Sequence[Row]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation."""
    weights = Weights(len(rows))
    return weights.told(weights.swept(rows, weights.end())[START])


def stretch(rows: Sequence[Row]) -> list[tuple[int, str] | None]:
    """Cost and audit from each place in front of the rows to each place behind them, sixteen in a row."""
    weights = Weights(len(rows))
    ends = [weights.swept(rows, [0 if place == last else weights.never for place in range(4)]) for last in range(4)]
    return [weights.told(ends[last][first]) for first in range(4) for last in range(4)]


def applied(audit: str, place: int, rows: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits of an audit that starts at a place in the pattern."""
    out, left = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        place = KEEPS[place, role[:1]] if letter == "K" else FILLS[place]
        out.append((role if letter == "K" else NAMES[place], text))
    return out


class Turn(NamedTuple):
    """A row after damage; `times` is 0 for one that is lost and 2 for one that is repeated."""

    turn: int | None
    role: str
    text: str
    times: int
    again: bool = False


class Faults(NamedTuple):
    """Counts over consecutive rows, and what neighbours need to know of their ends."""

    rows: list[Row]
    turns: list[tuple[str, str]]
    numbers: list[int]
    blank: int
    duplicate: int
    truncated: int
    illegal: int


def faults(given: Iterable[Turn]) -> Faults:
    """The first fault of each row; copies next to each other are seen here, others are marked `again`."""
    rows, turns, numbers = [], [], []
    blank = duplicate = truncated = illegal = 0
    for one in given:
        for copy in range(one.times):
            body = one.text.rstrip(WHITE)
            empty = not body
            twice = not empty and (one.again or copy > 0)
            cut = not empty and not twice and body[-1] not in ".!?"
            blank, duplicate, truncated = blank + empty, duplicate + twice, truncated + cut
            if rows and rows[-1].initial + one.role[:1] not in LEGAL:
                illegal += 1
            rows.append(Row(one.role[:1], empty or twice, cut))
            turns.append((one.role, one.text))
            if one.turn is not None:
                numbers.append(one.turn)
    return Faults(rows, turns, numbers, blank, duplicate, truncated, illegal)


def sha256_of(turns: Iterable[tuple[str, str]], digest: hashlib._Hash | None = None, first: bool = True) -> hashlib._Hash:
    """The digest of `role:text` lines, carried on from earlier turns."""
    digest = digest or hashlib.sha256()
    for role, text in turns:
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return digest


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "turns array<struct<role: string, text: string>>"
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_REPORT_NAMES = [part.split()[0] for part in REPORT.split(", ")]
_SEEN = f"conv_id long, {REPORT}, repaired_sha256 string, {TURNS}, long boolean, part int, at long, turn long, role string, text string, times int"


def report(given: Sequence[Turn]) -> tuple[dict, list[tuple[str, str]]]:
    """The counts and edits of a whole conversation, and its rows after them."""
    seen, marked = set(), []
    for one in given:
        if one.times:
            marked.append(one._replace(again=(one.role, one.text) in seen))
            seen.add((one.role, one.text))
    found = faults(marked)
    cost, audit = cheapest(found.rows)
    numbers = found.numbers
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    values = (gaps, found.blank, found.duplicate, found.truncated, found.illegal, cost, audit)
    return dict(zip(_REPORT_NAMES, values, strict=True)), applied(audit, START, found.turns)


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id`, `turn`, `role`, `text`, `times`: the rows with faults chosen by a hash of conversation and turn.

    Nulls of role and text, and of the two numbers inside the hash, are one space. A lost row stays as one with
    `times` 0, so that its conversation is still known; a repeated one has `times` 2.
    """
    space = F.lit(" ")
    conv, turn = F.col(f"`{id_col}`").cast("long"), F.col(f"`{turn_col}`").cast("long")
    role, text = F.coalesce(F.col(f"`{role_col}`"), space), F.coalesce(F.col(f"`{text_col}`"), space)
    name = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("int").alias("times"),
    )


def _short_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations that lie wholly inside the partition; the rows of all others as they are.

    The first and the last conversation may go on in the partitions beside it.
    """
    part, at = TaskContext.get().partitionId(), 0
    nothing = {"conv_id": None, **dict.fromkeys(_REPORT_NAMES), "repaired_sha256": None, "turns": None, "long": True}
    kinds = pa.schema(
        [
            ("conv_id", pa.int64()),
            *[(name, pa.string() if name == "audit" else pa.int64()) for name in _REPORT_NAMES],
            ("repaired_sha256", pa.string()),
            ("turns", _TURN_TYPE),
            ("long", pa.bool_()),
            ("part", pa.int32()),
            ("at", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("text", pa.string()),
            ("times", pa.int32()),
        ]
    )
    current, held, chars, first, begun = None, [], 0, True, False
    out: list[dict] = []

    def let_go() -> None:
        nonlocal at, held, chars
        for one in held:
            out.append(nothing | {"conv_id": current, "part": part, "at": at, "turn": one.turn, "role": one.role, "text": one.text, "times": one.times})
            at += 1
        held, chars = [], 0

    def close() -> None:
        nonlocal held, chars
        values, turns = report(held)
        told = [{"role": role, "text": text} for role, text in turns]
        out.append({"conv_id": current, **values, "repaired_sha256": sha256_of(turns).hexdigest(), "turns": told, "long": False})
        held, chars = [], 0

    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("conv_id", "turn", "role", "text", "times")]
        for conv, *values in zip(*columns, strict=True):
            if begun and conv != current:
                if first or not held:
                    let_go()
                    first = False
                else:
                    close()
            current, begun = conv, True
            held.append(Turn(*values))
            chars += len(values[2])
            if len(held) > SEGMENT or chars > MOST_CHARS:
                let_go()
                first = True  # the rest of this one is let go as well
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
            out.clear()
    let_go()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """A join on conversation, which may be null, and on the named columns."""
    right = right.withColumnsRenamed({name: f"own_{name}" for name in ("conv_id", *names)})
    same = F.col("conv_id").eqNullSafe(F.col("own_conv_id"))
    for name in names:
        same = same & (F.col(name) == F.col(f"own_{name}"))
    return left.join(right, same, how).drop("own_conv_id", *[f"own_{name}" for name in names])


def _segments(rows: DataFrame) -> DataFrame:
    """One row per segment of the long conversations: counts, ends, and the paths through it from place to place."""
    body = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.where("times > 0").withColumn("name", F.sha2(body, 256))
    seen = rows.groupBy("conv_id", "name").agg(F.min(F.struct("part", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = _joined(rows, seen, ["name"], "left").select(
        "conv_id", "part", F.expr(f"at div {SEGMENT}").alias("piece"), "at", "turn", "role", "text", "times",
        F.coalesce((F.col("first.part") != F.col("part")) | (F.col("first.at") != F.col("at")), F.lit(False)).alias("again"),
    )
    numbers = ("lowest", "highest", "different", "opens", "closes")
    counts = ("blank", "duplicate", "truncated", "illegal")

    def tell(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        given = [Turn(*values) for values in zip(*[group[name].to_pylist() for name in Turn._fields], strict=True)]
        found = faults(given)
        paths = stretch(found.rows)
        n = found.numbers
        row = {
            **{name: group[name][0].as_py() for name in ("conv_id", "part", "piece")},
            "n": len(found.rows),
            **dict(zip(numbers, (min(n), max(n), len(set(n)), n[0], n[-1]) if n else [None] * 5, strict=True)),
            **{name: getattr(found, name) for name in counts},
            "starts": found.rows[0].initial,
            "stops": found.rows[-1].initial,
            "costs": [None if path is None else path[0] for path in paths],
            "audits": [None if path is None else path[1] for path in paths],
            "turns": [{"role": role, "text": text} for role, text in found.turns],
        }
        longs = ("conv_id", "piece", "n", *numbers, *counts)
        kinds = {"part": pa.int32(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "turns": _TURN_TYPE}
        kinds |= dict.fromkeys(longs, pa.int64()) | dict.fromkeys(("starts", "stops"), pa.string())
        return pa.table({name: pa.array([value], kinds[name]) for name, value in row.items()})

    longs = ", ".join(f"{name} long" for name in ("n", *numbers, *counts))
    schema = f"conv_id long, part int, piece long, {longs}, starts string, stops string, costs array<long>, audits array<string>, {TURNS}"
    return keep(marked.groupBy("conv_id", "part", "piece").applyInArrow(tell, schema), "segments")


def _composed(segments: DataFrame) -> DataFrame:
    """The edits of each segment and the place they start from; the first segment carries its conversation's report.

    A segment is sixteen paths; they are composed from the last segment to the first by the same integer minimum.
    """
    names = [name for name in segments.columns if name != "turns"]

    def decide(group: pa.Table) -> pa.Table:
        pieces = group.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
        weights = Weights(sum(piece["n"] for piece in pieces))
        at, behind = weights.end(), []
        for piece in reversed(pieces):
            behind.append(at)
            ways = list(zip(piece["costs"], piece["audits"], strict=True))
            at = [
                min(weights.never if ways[4 * p + q][0] is None else weights.joined(*ways[4 * p + q], at[q]) for q in range(4))
                for p in range(4)
            ]
        cost, audit = weights.told(at[START])
        gaps, last, place, used, edits, places = 0, None, START, 0, [], []
        illegal, stop, low = 0, None, None
        for piece in pieces:
            rows, end = piece["n"], used
            while rows:  # inserts in front of a row belong to its segment
                rows -= audit[end] != "I"
                end += 1
            edits.append(audit[used:end])
            places.append(place)
            used, place = end, _place_after(audit[used:end], place, piece["first_initials"])
            illegal += piece["illegal"] + (stop is not None and stop + piece["starts"] not in LEGAL)
            stop = piece["stops"]
            if piece["lowest"] is not None:
                low = piece["lowest"] if low is None else low
                gaps -= piece["different"] - (piece["opens"] == last)
                last = piece["closes"]
        edits[-1] += audit[used:]
        if low is not None:
            gaps += last - low + 1
        totals = [sum(piece[name] for piece in pieces) for name in ("blank", "duplicate", "truncated")]
        told = dict(zip(_REPORT_NAMES, (gaps, *totals, illegal, cost, audit), strict=True))
        out = []
        for nth, piece in enumerate(pieces):
            own = {name: piece[name] for name in ("conv_id", "part", "piece")} | {"edits": edits[nth], "place": places[nth]}
            out.append(own | (told if nth == 0 else dict.fromkeys(_REPORT_NAMES)))
        kinds = [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("edits", pa.string()), ("place", pa.int32())]
        kinds += [(name, pa.string() if name == "audit" else pa.int64()) for name in _REPORT_NAMES]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    initials = F.transform("turns", lambda turn: F.left(turn["role"], F.lit(1))).alias("first_initials")
    some = segments.select(*names, initials)
    return some.groupBy("conv_id").applyInArrow(decide, f"conv_id long, part int, piece long, edits string, place int, {REPORT}")


def _place_after(audit: str, place: int, initials: Sequence[str]) -> int:
    left = iter(initials)
    for letter in audit:
        initial = "" if letter == "I" else next(left)
        if letter != "D":
            place = KEEPS[place, initial] if letter == "K" else FILLS[place]
    return place


def _long_ones(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of conversations that are dealt out over several tasks."""
    segments = _segments(rows)
    decided = _composed(segments)
    bodies = segments.select("conv_id", "part", "piece", "turns")
    chosen = _joined(decided, bodies, ["part", "piece"], "inner").select("conv_id", "part", "piece", "edits", "place", *_REPORT_NAMES, "turns")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for audit, place, turns in zip(*[batch[name].to_pylist() for name in ("edits", "place", "turns")], strict=True):
                after = applied(audit, place, [(turn["role"], turn["text"]) for turn in turns])
                done.append([{"role": role, "text": text} for role, text in after])
            kept = batch.drop_columns(["edits", "place", "turns"])
            yield kept.append_column("turns", pa.array(done, _TURN_TYPE))

    repaired = keep(map_arrow(chosen, edit, f"conv_id long, part int, piece long, {REPORT}, {TURNS}"), "repaired")
    in_order = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, digest, empty = None, None, True
        for batch in batches:
            for at in range(batch.num_rows):  # one segment at a time
                row = batch.slice(at, 1).to_pylist()[0]
                if row["audit"] is not None:  # a conversation begins
                    if told is not None:
                        yield pa.RecordBatch.from_pylist([told | {"repaired_sha256": digest.hexdigest()}], schema=kinds)
                    told, digest, empty = {name: row[name] for name in ("conv_id", *_REPORT_NAMES)}, None, True
                digest = sha256_of([(turn["role"], turn["text"]) for turn in row["turns"]], digest, empty)
                empty = empty and not row["turns"]
        if told is not None:
            yield pa.RecordBatch.from_pylist([told | {"repaired_sha256": digest.hexdigest()}], schema=kinds)

    kinds = pa.schema([("conv_id", pa.int64()), *[(n, pa.string() if n == "audit" else pa.int64()) for n in _REPORT_NAMES], ("repaired_sha256", pa.string())])
    reports = map_arrow(in_order, hashed, f"conv_id long, {REPORT}, repaired_sha256 string")
    return reports, repaired.select("conv_id", "part", "piece", "turns")


def repair(damaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of conversations as `damage` gives them: `conv_id`, `turn`, `role`, `text`, `times`.

    The report has one row per conversation: `conv_id`; `gaps`, the turn numbers missing between the least and the
    largest; the rows whose first fault is `blank`, `duplicate` (role and text seen earlier) or `truncated` (no full
    stop at the end); `illegal` neighbours of roles; `cost` and `audit` of the cheapest edits; `repaired_sha256` over
    the lines `role:text` after them. The turns come as `conv_id`, `part`, `piece`, `turns`: arrays of role and text
    in the order of part and piece. Edits: keep (free, one more for a truncated row), change the role to user or
    assistant (2, one more if truncated), delete (3, demanded for blank and duplicate rows), insert an empty row of
    either role (2), so that the role initials are `(s?(ua)+)?`.

    Rows are put in order of conversation and turn by a range shuffle. A conversation that lies in one partition is
    repaired there. Those at the partitions' ends and those of more than 512 rows or 4 million characters, however
    many rows one has, are cut into segments: duplicates are found by a join on digests, each segment is reduced to
    sixteen paths, the paths are composed, and the segments are edited each by itself. Only the digest over the
    repaired text reads a conversation in one go, as a stream of segments, one held at a time.

    Null turns come first; rows of one turn are ordered by role and text. A null id is a conversation of its own. A
    row whose role begins with another letter (or is empty) cannot be kept as it is. A conversation all of whose rows
    are lost has zeros, an empty audit and the digest of nothing. Repeated rows are duplicates. An empty table gives
    no rows; other columns are not read.
    """
    keys = ["conv_id", "turn", "role"]
    placed = damaged.select("conv_id", "turn", "role", "text", "times").repartitionByRange(*keys, F.left("text", F.lit(32)))
    seen = keep(map_arrow(placed.sortWithinPartitions(*keys, "text"), _short_ones, _SEEN), "conversations")
    names = ["conv_id", *_REPORT_NAMES, "repaired_sha256"]
    short, long = seen.where("NOT long"), seen.where("long")
    whole = short.select(names), short.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("piece"), "turns")
    reports, turns = _long_ones(long.select("conv_id", "part", "at", "turn", "role", "text", "times"))
    lost = long.groupBy("conv_id").agg(F.sum("times").alias("n")).where("n = 0")
    zeros = [F.lit(0).cast("long").alias(name) for name in _REPORT_NAMES[:-1]]
    lost = lost.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return whole[0].unionByName(reports).unionByName(lost), whole[1].unionByName(turns)
