"""A piece tokenizer compiled to a deterministic transducer that counts tokens.

Merging by score never lets what follows change the tokens before a place no token spans, so the encoding of a
prefix is the encoding of a shorter prefix and one more token, and two neighbouring tokens stand together exactly
when they do in the encoding of both alone. A state therefore holds the tokens that may still be growing: for each
place from which the text read so far goes on as the start of a piece, that start (a node of the trie of pieces),
the token in front of the place, and how many tokens the present count lies above the count there. Reading a
character gives the next state and what the count changes by (below zero where a longer token takes over).

States are numbered and transitions stored when a text first needs them, as regular expression engines do. Between
two characters that no piece holds side by side nothing survives, so what follows is the same from every state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import sentencepiece

#: Characters of a chunk; chunks are read side by side.
CHUNK = 128
#: Chunks below which reading them one by one is quicker.
FEW = 48
#: States a worker remembers; beyond that it starts anew.
MOST_STATES = 400_000

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2
_SPACE, _MARK = 0x20, 0x2581
_START = 0

_loaded: dict[str, Transducer] = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a model file; the rules that the transducer relies on are checked."""
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds, settings = set(), {2: {}, 3: {}}
    for field, value in _fields(processor.serialized_model_proto()):
        if field == 1:
            kinds.add(dict(_fields(value)).get(3, _NORMAL))
        elif field in settings:
            settings[field] = dict(_fields(value))
    trainer, normalizer = settings[2], settings[3]
    sound = (
        kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        and trainer.get(3) == _BPE
        and trainer.get(35, 0) == 1  # bytes stand for what has no piece
        and not trainer.get(24, 0)  # white space leads its word
        and not normalizer.get(2, b"")  # characters stay as they are
        and normalizer.get(3, 1) == 1  # a space in front of the text
        and normalizer.get(4, 1) == 0  # runs of spaces stay
        and normalizer.get(5, 1) == 1  # spaces become marks
    )
    if not sound:
        raise ValueError("needs a byte-pair model with byte fallback, without a normalizer or pieces of the user")
    special = (processor.is_control, processor.is_unknown, processor.is_byte)
    ids = [i for i in range(processor.get_piece_size()) if not any(test(i) for test in special)]
    return {processor.id_to_piece(i): processor.get_score(i) for i in ids}


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The tokens of a short text: the best pair first, of equal ones the leftmost."""
    parts = list(text)
    while True:
        pairs = [(-scores[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not pairs:
            return parts
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """States and transitions of one model file, as far as texts have needed them."""

    def __init__(self, path: str):
        self.scores = read_pieces(path)
        self.goto: dict[tuple[int, str], int] = {}
        self.piece = [""]  # the piece that ends at a node of the trie
        self.grows = [True]  # whether pieces go on below it
        letters, pairs = set(), set()
        for piece in self.scores:
            node = 0
            for at, letter in enumerate(piece):
                self.grows[node] = True
                if (node, letter) not in self.goto:
                    self.goto[node, letter] = len(self.piece)
                    self.piece.append("")
                    self.grows.append(False)
                node = self.goto[node, letter]
                letters.add(letter)
                if at:
                    pairs.add((piece[at - 1], letter))
            self.piece[node] = piece
        self.pairs = pairs
        # Classes 1 to 4: characters outside all pieces, by their bytes; then one per character.
        self.letters = ["", "", "", "", "", *sorted(letters)]
        self.classes = np.full(0x110000, 4, np.int32)
        for size, beyond in ((3, 0x10000), (2, 0x800), (1, 0x80)):
            self.classes[:beyond] = size
        number = {letter: at for at, letter in enumerate(self.letters) if letter}
        for letter, at in number.items():
            self.classes[ord(letter)] = at
        self.classes[_SPACE] = self.classes[_MARK]
        self.width = len(self.letters)
        self.joined = np.zeros(self.width * self.width, bool)
        for a, b in pairs:
            self.joined[number[a] * self.width + number[b]] = True
        self.valid: dict[tuple[str, str], bool] = {}
        self.forget()

    @staticmethod
    def of(path: str) -> Transducer:
        if path not in _loaded:
            _loaded[path] = Transducer(path)
        return _loaded[path]

    def forget(self) -> None:
        fresh = ((0, None, 0),)
        self.states, self.number = [fresh], {fresh: _START}
        self.edges: dict[int, int] = {}
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        """The transitions in arrays with open addresses: key (state, class), value (next state, change)."""
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.shift = 64 - size.bit_length() + 1
        if self.edges:
            self._store(np.fromiter(self.edges, np.int64), np.fromiter(self.edges.values(), np.int64))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands or would stand."""
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)
        found = self.keys[slots]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return slots

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):  # keys that want the same slot take turns
            slots = self._slots(keys)
            _, first = np.unique(slots, return_index=True)
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def _stands(self, before: str, token: str) -> bool:
        pair = before, token
        if pair not in self.valid:
            if len(self.valid) > 4 * MOST_STATES:
                self.valid.clear()
            self.valid[pair] = merged(before + token, self.scores) == [before, token]
        return self.valid[pair]

    def _edge(self, key: int) -> int:
        """The transition of a state on a class, built anew: next state times 256, and the change plus 128."""
        state, kind = divmod(key, self.width)
        if kind <= 4:  # as many byte tokens as the character has bytes
            return _START << 8 | kind + 128
        letter, growing, ends = self.letters[kind], [], []
        for node, before, above in self.states[state]:
            child = self.goto.get((node, letter))
            if child is None:
                continue
            if node == 0 and before is not None and (before[-1], letter) not in self.pairs:
                before = None  # nothing can span this place
            growing.append((child, before, above))
            if self.piece[child] and (before is None or self._stands(before, self.piece[child])):
                ends.append((self.piece[child], above))
        if len(ends) != 1:
            raise AssertionError(f"{len(ends)} tokens end here")
        token, above = ends[0]
        change = 1 - above
        fresh = (*((n, b, a + change) for n, b, a in growing if self.grows[n]), (0, token, 0))
        if fresh not in self.number:
            self.number[fresh] = len(self.states)
            self.states.append(fresh)
        return self.number[fresh] << 8 | change + 128

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of many keys; missing ones are built."""
        slots = self._slots(keys)
        missing = self.keys[slots] != keys
        if not missing.any():
            return self.values[slots]
        new = np.unique(keys[missing])
        values = [self._edge(key) for key in new.tolist()]
        self.edges.update(zip(new.tolist(), values, strict=True))
        if 2 * len(self.edges) > len(self.keys):
            self._table(4 * len(self.keys))
        else:
            self._store(new, np.array(values, np.int64))
        return self.values[self._slots(keys)]

    def read(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each stretch and the change of the count along it, from the given states."""
        out, total = states.copy(), np.zeros(len(starts), np.int64)
        if len(starts) < FEW:
            for at, (low, high) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                state, count = int(states[at]), 0
                for kind in kinds[low:high].tolist():
                    key = state * self.width + kind
                    edge = self.edges.get(key)
                    if edge is None:
                        edge = int(self.step(np.array([key]))[0])
                    state, count = edge >> 8, count + (edge & 255) - 128
                out[at], total[at] = state, count
            return out, total
        order = np.argsort(starts - ends, kind="stable")
        at, state, count = starts[order], states[order].astype(np.int64), np.zeros(len(order), np.int64)
        lengths = (ends - starts)[order]
        for k in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -k))  # stretches longer than k
            edge = self.step(state[:live] * self.width + kinds[at[:live] + k])
            state[:live] = edge >> 8
            count[:live] += (edge & 255) - 128
        out[order], total[order] = state, count
        return out, total

    def count(self, kinds: np.ndarray, edges: np.ndarray, entry: int = _START) -> tuple[np.ndarray, int]:
        """Tokens of consecutive texts in an array of classes, text k from `edges[k]` to `edges[k + 1]`.

        The first text goes on from the state `entry`; the state after the last one is returned as well.

        Each text is cut into chunks. From a chunk's first place that nothing spans its map is constant: all states
        go to one state, and it is read from there without knowing what stands before. An exclusive scan hands each
        chunk the state its predecessor leaves, and the head up to that place is read from there.
        """
        lengths = np.diff(edges)
        chunks = -(-lengths // CHUNK)
        text = np.repeat(np.arange(len(lengths)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = edges[text] + nth * CHUNK
        ends = np.minimum(starts + CHUNK, edges[text + 1])
        free = np.ones(len(kinds), bool)
        free[1:] = ~self.joined[kinds[:-1] * self.width + kinds[1:]]
        free[edges[:-1][lengths > 0]] = True
        if len(kinds) and entry != _START:
            free[0] = False
        places = np.append(np.flatnonzero(free), len(kinds))
        heads = np.minimum(places[np.searchsorted(places, starts)], ends)
        leaves, counts = self.read(kinds, heads, ends, np.full(len(starts), _START, np.int64))
        known = heads < ends
        waiting = np.flatnonzero(heads > starts)
        while len(waiting):
            before = waiting - 1
            ready = (waiting == 0) | known[before]
            some = waiting[ready]
            given = np.where(some == 0, entry, leaves[before[ready]])
            states, more = self.read(kinds, starts[some], heads[some], given)
            counts[some] += more
            whole = ~known[some]
            leaves[some[whole]] = states[whole]
            known[some] = True
            waiting = waiting[~ready]
        totals = np.bincount(text, weights=counts, minlength=len(lengths)).astype(np.int64)
        return totals, int(leaves[-1]) if len(leaves) else entry
