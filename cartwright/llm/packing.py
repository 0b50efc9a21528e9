"""Best-fit packing of token sequences.

Documents become token ids plus one end token; longer ones are cut into full pieces and a rest. Pieces
are placed by best-fit decreasing: in order of falling length, each into the open bin with the least
room that still takes it, which a segment tree over remaining capacities finds in logarithmic time.

Pieces are dealt at random over shards of bounded size and each shard is packed by one task, so no task
sees more than ``SHARD`` pieces; the price is at most about one part-filled sequence per shard.

Edge cases: a null or empty text is one piece that holds the end token alone. Repeated rows are packed
once per row. Other columns ride along unless they clash with the columns made here, which win. An
empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import ship, texts_of

CAPACITY = 2048
END_ID = 0
#: Pieces per shard, on average: what one task sorts and packs.
SHARD = 25_000
#: Distinct words whose ids a task keeps.
CACHE = 1_000_000

#: Letters whose lower case and composed form are single characters.
_LETTERS = frozenset(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha())
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class WordIds(dict):
    """Little-endian ids of every piece of a text between spaces, by the given tokenizer.

    Neither normalisation nor the model ever looks across a space, so the ids of a text are those of
    its pieces in a row. Plain words go to the model directly, all other pieces through the whole
    tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LETTERS if not c.isascii()}
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= CACHE:
                self.runs.clear()
            shown = run if run.isascii() else run.translate(self.shown)
            ids = self.runs[run] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if word and _LETTERS.issuperset(word):
            ids = self._run(word.lower())
            if len(word) < len(piece):
                ids += self._run(piece[len(word) :])
        elif piece:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b""
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        """Drop all word ids, so that a worker without a task holds none."""
        self.clear()
        self.runs.clear()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tokenizers: dict[str, WordIds] = {}


def tokenizer_for(path: str) -> WordIds:
    """One per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces of all texts: the columns ``keep``, piece, start, length and ids as little-endian 32-bit
    numbers in one binary value."""
    ship(docs.sparkSession)
    where = tokenizer or os.path.abspath(default_tokenizer())
    kept = [name for name in keep if name not in ("piece", "start", "length", "ids")]
    schema = docs.select(*kept).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary")):
        schema = schema.add(name, kind)
    end = np.array([END_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_for(where)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, pieces, ids = [], [], []
                for row, text in enumerate(texts_of(part, "text")):
                    whole = words.encode(text) + end
                    for piece, first in enumerate(range(0, len(whole), step)):
                        rows.append(row)
                        pieces.append(piece)
                        ids.append(whole[first : first + step])
                taken = part.select(range(len(kept))).take(pa.array(rows, pa.int32()))
                number = pa.array(pieces, pa.int32())
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                starts = pa.array([p * capacity for p in pieces], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, number, starts, lengths, pa.array(ids, pa.binary())], names=schema.names
                )
        words.forget()

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class Openings:
    """Open bins by remaining capacity: a segment tree whose leaf ``c`` tells whether a bin with
    exactly ``c`` places left is open."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that is open, or -1."""
        node, seen = length + self.leaves, self.any
        if seen[node]:
            return length
        while node > 1:
            if not node & 1 and seen[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if seen[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            node = room + self.leaves
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return number


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of at most ``capacity``, by best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    openings, opened = Openings(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        room = openings.tightest(length)
        if room < 0:
            number, room, opened = opened, capacity, opened + 1
        else:
            number = openings.take(room)
        bins[i], offsets[i] = number, capacity - room
        if room > length:
            openings.add(room - length, number)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a written table, as it is read twice.

    Full pieces are sequences of their own. The number of shards follows the number of others.
    """
    ship(pieces.sparkSession)
    part = F.col("length") < capacity
    many = pieces.where(part).count()
    shards = max(1, -(-many // shard))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_shard")]
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(group["length"].to_numpy(), capacity)
        # Even numbers, consecutive within the shard: odd ones are the full pieces.
        number = (bins * shards + int(group["_shard"].iloc[0])) * 2
        return group[names].assign(sequence_id=number, offset=offsets)

    # By row, not by document: rows may repeat. The ids are stable, as the table is written.
    row = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.where(part).withColumn("_shard", F.pmod(row, F.lit(shards)))
    packed = dealt.groupBy("_shard").applyInPandas(place, schema)
    whole = pieces.where(~part).select(
        *names,
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(whole)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packed sequences themselves: sequence_id, length, ids as little-endian 32-bit numbers, and the
    pieces in order. ``pieces`` needs ids, sequence_id and offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return whole.select(
        "sequence_id",
        "length",
        joined.alias("ids"),
        F.transform("parts", lambda x: x.dropFields("ids")).alias("parts"),
    )


def packed_digests(docs: DataFrame) -> DataFrame:
    """One row per piece of the packed documents, its ids as a checksum."""
    pieces = tokenise(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(settle(pieces)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
