"""Token ids: whole texts through a tokenizers file, and flat binary files of ids with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heartwood.llm.common import keep, map_arrow, new_folder, texts

#: Pieces a worker remembers the ids of; beyond that the half met last goes, as frequent pieces are met early.
REMEMBERED = 400_000
#: Of these so many stay when a task of a pipeline ends, as workers live on.
STAYING = 100_000
#: Pieces that are encoded in one call, and characters of texts that are cut together: the more, the fewer words
#: are looked up twice.
TOGETHER, TOGETHER_CHARS = 4096, 10 << 20
#: Ids that are read back at a time.
READ_IDS = 1 << 21
NO_ID = np.iinfo(np.int64).min

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Places where no token spans: both patterns give pieces whose ids follow one another as those of the whole
#: text. A run of letters counts only up to a space, line end, full stop or comma; all else goes to the next space.
SPACE_LED = re.compile(rf" ?[{_LETTERS}]+(?=[ .,\n]|\Z)|[.,](?=[ \n]|\Z)|\n(?=[{_LETTERS}])| ?[^ ]+| +")
SPACE_FREE = re.compile(rf"[{_LETTERS}]+(?=[ .,\n]|\Z)|[.,](?=[ \n]|\Z)|\n(?=[{_LETTERS}])|[^ ]+")
#: Pieces that no tokenizer's pattern cuts: the model alone may encode them, where it is tried to give the same ids.
LETTERS, LOWER = re.compile(rf" ?[{_LETTERS}]+"), re.compile(" ?[a-zß-öø-ÿ]+")
#: White space that a byte-level tokenizer reads as one run around a space: such texts are encoded in one go.
WIDE_SPACE = re.compile(r"\s \s|\s \Z|  |\A |[\x1c-\x1f\x85]")
#: What such white space needs at least, quicker to look for: a space before other white space, or these characters.
SPACE_BEFORE_SPACE, ODD_SPACE = re.compile(r" (?:\s|\Z)"), re.compile("[\x1c-\x1f\x85]")
#: Characters of which lower case may depend on more than the character, or on the library.
BEYOND_LATIN = re.compile("[İ\u0250-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + at) for at, byte in enumerate(hidden)}


#: For pieces of letters, one a line: what stands for their bytes.
SHOWN = {c: "".join(map(_byte_letters().get, chr(c).encode())) for c in range(256) if c != ord("\n")}

_loaded: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """A tokenizers file with a memory of the pieces seen, as most words of a corpus are repeated."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values() if token.content]
        # A special token inside a text ends what stands before it: such texts are encoded in one go.
        self.special = re.compile("|".join(special) or r"(?!)", re.IGNORECASE)
        marks = {token.content[0] for token in self.tokenizer.get_added_tokens_decoder().values() if token.content}
        self.marks = None if any(mark.isalpha() for mark in marks) else marks  # quicker to look for
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ids: dict[str, bytes] = {}
        spaced = [self._encode([x])[0] for x in ("a b", "a", " b", "b")]
        self.free = spaced[0] == spaced[1] + spaced[3]
        self.folds = self.free and self._encode(["A"]) == self._encode(["a"])
        self.led = not self.free and spaced[0] == spaced[1] + spaced[2]
        self.letters = LOWER if self.folds else LETTERS
        self.direct = (self.free or self.led) and self._model_suffices()

    @staticmethod
    def of(path: str) -> PieceEncoder:
        if path not in _loaded:
            _loaded[path] = PieceEncoder(path)
        return _loaded[path]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are encoded each by itself, in one call."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces) + 1)) * self.dtype.itemsize
        raw = np.array(found.ids, self.dtype).tobytes()
        return [raw[low:high] for low, high in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def _by_model(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of letters by the model alone, without the steps before it and the records of its places."""
        if not pieces:
            return []
        tokenize, lines = self.tokenizer.model.tokenize, "\n".join(pieces)
        shown = lines.replace(" ", SHOWN[32]) if lines.isascii() else lines.translate(SHOWN)
        found = [[t.id for t in tokenize(p)] for p in shown.split("\n")]
        ends = np.cumsum([0, *map(len, found)]) * self.dtype.itemsize
        raw = np.array(list(chain.from_iterable(found)), self.dtype).tobytes()
        return [raw[low:high] for low, high in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def _model_suffices(self) -> bool:
        """Whether the model alone gives the same ids for every letter, at all places of a piece."""
        letters = [c for c in map(chr, range(256)) if self.letters.fullmatch(c) and c != " "]
        tried = [p for c in letters for p in (c, f"{c}a", f"a{c}a", f"e{c}", c * 3)]
        tried += ["".join(letters[at : at + 9]) for at in range(len(letters))]
        if self.led:
            tried += [f" {p}" for p in tried]
        try:
            return self._by_model(tried) == self._encode(tried)
        except Exception:  # noqa: BLE001 - a model that does not know the letters of bytes
            return False

    def _learn(self, pieces: list[str]) -> list[str]:
        """Remember the ids of the distinct pieces of letters, and give back the others."""
        if not self.direct:
            return pieces
        whole = self.letters.fullmatch
        rest = [p for p in pieces if not whole(p)]
        plain = list(filter(whole, pieces)) if len(rest) < len(pieces) else []
        for text in (True, False):  # those in ASCII need no table
            some = [p for p in plain if p.isascii() is text]
            self.ids.update(zip(some, self._by_model(some), strict=True))
        return rest

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _in_one_go(self, text: str) -> bool:
        if not (self.free or self.led):
            return True
        if (self.marks is None or any(mark in text for mark in self.marks)) and self.special.search(text):
            return True
        if not self.led or not (text[:1] == " " or SPACE_BEFORE_SPACE.search(text) or ODD_SPACE.search(text)):
            return False
        return WIDE_SPACE.search(text) is not None

    @staticmethod
    def _folded(text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text if BEYOND_LATIN.search(text) else text.lower()
        return text.lower()

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words between spaces (with the one before them, if it counts): of their pieces, one by one.

        Words of one piece are remembered, others joined anew from theirs.
        """
        known, pattern = self.ids, SPACE_FREE if self.free else SPACE_LED
        if len(known) + len(words) > REMEMBERED:
            for piece in list(known)[REMEMBERED // 2 :]:
                del known[piece]
        rest = self._learn([word for word in words if word not in known])
        pieces = [pattern.findall(word) for word in rest]
        new = self._learn(list({p for some in pieces for p in some if p not in known}))
        for low in range(0, len(new), TOGETHER):
            some = new[low : low + TOGETHER]
            known.update(zip(some, self._encode(some), strict=True))
        look = known.__getitem__
        joined = {word: b"".join(map(look, some)) for word, some in zip(rest, pieces, strict=True)}
        return [joined[word] if word in joined else known[word] for word in words]

    def forget(self) -> None:
        """Give the memory of all but the pieces met first back."""
        self.ids = dict(islice(self.ids.items(), STAYING))

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian integers of `dtype`.

        Texts are cut at spaces; each distinct word of a batch is looked up once, and the ids are gathered by its
        number.
        """
        out: list[bytes] = [b""] * len(batch)
        cut = []
        for at, text in enumerate(batch):
            if self._in_one_go(text):
                out[at] = self._whole(text)
            elif text:
                cut.append(at)
        low = 0
        while low < len(cut):
            high, size = low, 0
            while high < len(cut) and (high == low or size + len(batch[cut[high]]) <= TOGETHER_CHARS):
                size += len(batch[cut[high]])
                high += 1
            some = cut[low:high]
            for at, ids in zip(some, self._gathered([batch[at] for at in some]), strict=True):
                out[at] = ids
            low = high
        yield from out

    def _gathered(self, texts: list[str]) -> Iterator[bytes]:
        if self.folds:
            texts = [self._folded(text) for text in texts]
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        distinct, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        if self.led:  # the first word of a text has no space before it
            firsts = flat.take(pa.array(ends[:-1])).to_pylist()
            codes[ends[:-1]] = np.arange(len(firsts)) + len(distinct)
            distinct = [" " + word for word in distinct] + firsts
        found = self._of_words(distinct)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(found), self.dtype)
        taken = lengths[codes]
        places = np.cumsum(taken)
        picked = ids[np.repeat(starts[codes] - (places - taken), taken) + np.arange(int(places[-1]))] if len(places) else ids[:0]
        edges = np.concatenate(([0], places))[ends] * self.dtype.itemsize
        raw = picked.tobytes()
        for low, high in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            yield raw[low:high]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold about as much text as is cut together."""
    held, size = [], 0
    for batch in batches:
        more = batch["text"].nbytes
        if held and size + more > TOGETHER_CHARS:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """`doc_id` of the documents cut together, and each whole text's ids and `end_id`, little-endian integers of
    `id_type(path)`. It runs inside the task that uses them: two Python steps in a row would hold a worker each."""
    encoder = PieceEncoder.of(path)
    end = np.array([end_id], encoder.dtype).tobytes()
    for batch in gathered(batches):
        yield batch["doc_id"], [ids + end for ids in encoder.encode(batch["text"].to_pylist())]
    encoder.forget()


def id_type(path: str) -> np.dtype:
    """Two bytes where the whole vocabulary fits, else four."""
    return PieceEncoder.of(path).dtype


def write_token_files(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write token files in ascending doc_id order; returns the kept list of shards.

    A shard is three flat little-endian files without headers: `.tokens` (unsigned, two bytes an id if the
    vocabulary fits, else four), `.offsets` (64-bit, where each document starts, and the end) and `.docs`
    (64-bit doc_id; the smallest number stands for null). The list has `shard` (its order), `file`, `docs`,
    `tokens`, `bytes_per_id` and `base` (ids in all shards before it, a prefix sum over the shards).

    A task writes under a name of its own, and only files of tasks that ended well are listed, so a lost
    executor leaves at most files that nothing refers to. Null ids come first; null text has the end id alone;
    rows that share an id follow one another, ordered by a hash of the text. An empty table gives no shards.
    `folder` is any address that pyarrow's file systems open; by default one below the shared folder.
    """
    spark = docs.sparkSession
    target = folder or new_folder(spark, "tokens")
    order = ["doc_id", F.xxhash64("text")]
    rows = texts(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    width = id_type(path).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid4().hex}"
        ids_out = None
        counts, docs_seen = [], []
        system, root = pafs.FileSystem.from_uri(target)
        for batch in gathered(batches):
            if ids_out is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                ids_out = system.open_output_stream(f"{root}/{name}.tokens")
            for ids in encoder.encode(batch["text"].to_pylist()):
                ids_out.write(ids)
                ids_out.write(end)
                counts.append(len(ids) // width + 1)
            docs_seen.append(batch["doc_id"].fill_null(NO_ID).to_numpy())
        if ids_out is None:
            return
        ids_out.close()
        offsets = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
        for kind, values in (("offsets", offsets), ("docs", np.concatenate(docs_seen).astype("<i8"))):
            with system.open_output_stream(f"{root}/{name}.{kind}") as out:
                out.write(values.tobytes())
        yield pa.record_batch(
            {
                "shard": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "file": [f"{target}/{name}"],
                "docs": pa.array([len(counts)], pa.int64()),
                "tokens": pa.array([int(offsets[-1])], pa.int64()),
                "bytes_per_id": pa.array([width], pa.int32()),
            }
        )

    shards = keep(map_arrow(rows, write, "shard int, file string, docs long, tokens long, bytes_per_id int"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return keep(shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))), "shards")


def _flat(system: pafs.FileSystem, file: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped where the file system is local, else read."""
    if isinstance(system, pafs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(file).read_buffer(), dtype)
    with system.open_input_file(file) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """`doc_id`, `start` (ids before it in all shards), `n_tokens`, `ids` (unsigned 32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, root = pafs.FileSystem.from_uri(row["file"])
                ids = _flat(system, f"{root}.tokens", f"<u{row['bytes_per_id']}")
                offsets = _flat(system, f"{root}.offsets", "<i8")
                docs = _flat(system, f"{root}.docs", "<i8")
                first = 0
                while first < len(docs):
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, side="right")) - 1)
                    edges = offsets[first : last + 1]
                    some = ids[edges[0] : edges[-1]].astype("<u4").tobytes()
                    cuts = ((edges - edges[0]) * 4).tolist()
                    blobs = [some[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(docs[first:last], mask=docs[first:last] == NO_ID),
                            "start": edges[:-1] + row["base"],
                            "n_tokens": np.diff(edges),
                            "ids": pa.array(blobs, pa.binary()),
                        }
                    )
                    first = last

    count = max(1, shards.count())
    return map_arrow(shards.repartition(count, "shard"), read, "doc_id long, start long, n_tokens long, ids binary")
