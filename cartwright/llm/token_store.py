"""Token ids of a corpus as Re-Pair compressed shards that decode from any place.

Documents are ordered by doc_id over range partitions and every partition is one stream of ids: the ids
of its documents in a row, each ended by ``END_ID``. The stream is cut into shards of ``SHARD`` ids, so a
long document spans several shards and no shard grows with a document. A shard is a grammar: frequent
pairs of neighbouring symbols are replaced by a new symbol, over and over, until no pair pays for
its rule any more. It stores the rules, the number of ids that each rule expands to and the place of
every ``STEP``-th symbol, from which a reader expands just the symbols that cover the ids it wants.

A stored row holds the shard as one binary value and the documents in it. Readers check its checksum.

Edge cases: a null or empty text is the end id alone. Rows that share a doc_id are stored one by one, in
the order of a hash of their text; a null doc_id comes first. Columns other than doc_id and text are not
read. An empty table gives an empty store.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cartwright.session import settle

from .common import ship, texts_of
from .packing import default_tokenizer, tokenizer_for

END_ID = 1
#: Ids per shard.
SHARD = 1 << 18
#: A pair becomes a rule if this many places use it: below that its rule takes more room than it saves.
LEAST_USES = 8
#: Replacement ends with a round that removes a smaller share of the symbols.
LEAST_SHARE = 0.02
#: Rules of a shard whose ids need more than 16 bits.
WIDE_RULES = 1 << 15
#: One in so many symbols has its place stored.
STEP = 128

_MAGIC = b"RPR1"
_HEAD = struct.Struct("<4s5I")
_SLOT_BITS = 18

SCHEMA = (
    "part int, shard int, first long, n_ids int, first_doc long, last_doc long, "
    "docs array<struct<doc_id: long, start: long, length: long, at: int, taken: int, skipped: long>>, grammar binary"
)


# ---------------------------------------------------------------- the grammar


def _wanted(pairs: np.ndarray, turn: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs in falling order, at most ``room``, and per place the weight of its pair
    (their number for the first, 1 for the last, 0 for any other).

    Pairs are counted in a table of slots. Of pairs that share a slot one is counted; slots differ
    from turn to turn.
    """
    size = 8 * pairs.itemsize
    spread = pairs.dtype.type((0x9E3779B97F4A7C15 * (2 * turn + 1) % (1 << 64)) >> (64 - size) | 1)
    slots = ((pairs * spread) >> pairs.dtype.type(size - _SLOT_BITS)).astype(np.intp)
    holder = np.zeros(1 << _SLOT_BITS, pairs.dtype)
    holder[slots] = pairs
    held = holder[slots] == pairs
    counts = np.bincount(slots[held], minlength=1 << _SLOT_BITS)
    often = np.flatnonzero(counts >= LEAST_USES)
    often = often[np.argsort(-counts[often], kind="stable")][:room]
    weights = np.zeros(1 << _SLOT_BITS, np.int32)
    weights[often] = np.arange(len(often), 0, -1, dtype=np.int32)
    return holder[often], weights[slots] * held


def _places(weights: np.ndarray) -> np.ndarray:
    """Places to replace. Where wanted pairs overlap, the more frequent one wins; a run of one pair
    (aaaa) is replaced at every other place."""
    around = np.concatenate(([0], weights, [0]))
    here, left, right = around[1:-1], around[:-2], around[2:]
    taken = (here > left) & (here >= right)
    runs = np.flatnonzero((here == left) & (here > 0))
    if len(runs):
        begins = np.concatenate(([True], np.diff(runs) > 1))
        begin = np.maximum.accumulate(np.where(begins, np.arange(len(runs)), 0))
        odd = (np.arange(len(runs)) - begin) % 2 == 1  # the run's first place is not among ``runs``
        # A run whose first place gave way to its left neighbour waits for the next round.
        free = around[runs[begin] - 1] < here[runs]
        taken[runs] = odd & free & (right[runs] <= here[runs])
    return np.flatnonzero(taken)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, rule k being symbol ``base + k``) and the symbols left for ``ids``.

    There are as many rules as 16-bit symbols allow; a vocabulary that needs more bits has ``WIDE_RULES``.
    """
    narrow = base < 1 << 16
    room = (1 << 16) - base if narrow else WIDE_RULES
    kind, bits = (np.uint32, 16) if narrow else (np.uint64, 32)
    sequence = ids.astype(kind)
    rules = [np.empty((0, 2), np.uint32)]
    made = turn = 0
    while len(sequence) > LEAST_USES and room > made:
        pairs = (sequence[:-1] << kind(bits)) | sequence[1:]
        chosen, weights = _wanted(pairs, turn, room - made)
        places = _places(weights)
        which = len(chosen) - weights[places]
        kept = np.bincount(which, minlength=len(chosen)) >= LEAST_USES
        used = kept[which]
        places, which = places[used], which[used]
        if not len(places):
            break
        new = chosen[kept]
        rules.append(np.stack([new >> kind(bits), new & kind((1 << bits) - 1)], 1).astype(np.uint32))
        sequence[places] = (np.cumsum(kept) - 1 + base + made)[which]
        left = np.ones(len(sequence), bool)
        left[places + 1] = False
        enough = len(places) >= LEAST_SHARE * len(sequence)
        sequence = sequence[left]
        made, turn = made + len(new), turn + 1
        if not enough:
            break
    return np.concatenate(rules), sequence.astype(np.uint32)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to. A rule refers to ids and earlier rules only."""
    lengths = np.ones(base + len(rules), np.int64)
    known = base
    while known < len(lengths):
        # Rules are made in rounds: all that refer to known symbols follow at once.
        ready = (rules[known - base :] < known).all(axis=1)
        upto = known + (len(ready) if ready.all() else int(np.argmin(ready)))
        lengths[known:upto] = lengths[rules[known - base : upto - base]].sum(axis=1)
        known = upto
    return lengths[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    while True:
        ruled = symbols >= base
        if not ruled.any():
            return symbols
        wide = np.repeat(symbols, ruled + 1)
        heads = np.flatnonzero(ruled) + np.arange(int(ruled.sum()))
        pairs = rules[symbols[ruled] - base]
        wide[heads], wide[heads + 1] = pairs[:, 0], pairs[:, 1]
        symbols = wide


class Grammar(NamedTuple):
    """A shard as read from its bytes."""

    base: int
    n_ids: int
    step: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    samples: np.ndarray

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids in ``[start, stop)``; only symbols around them are expanded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        if start == 0 and stop == self.n_ids:
            return expand(self.symbols, self.rules, self.base)
        first = int(np.searchsorted(self.samples, start, side="right")) - 1
        last = int(np.searchsorted(self.samples, stop, side="left"))
        part = self.symbols[first * self.step : last * self.step]
        sizes = np.ones(len(part), np.int64)
        ruled = part >= self.base
        sizes[ruled] = self.lengths[part[ruled].astype(np.int64) - self.base]
        ends = int(self.samples[first]) + np.cumsum(sizes)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = start - int(ends[a] - sizes[a])
        return expand(part[a:b], self.rules, self.base)[skipped : skipped + stop - start]


def to_bytes(ids: np.ndarray, base: int) -> bytes:
    """A shard: head, rules, their lengths, places of every STEP-th symbol, symbols, checksum."""
    rules, symbols = compress(ids, base)
    lengths = lengths_of(rules, base)
    sizes = np.ones(len(symbols), np.int64)
    ruled = symbols >= base
    sizes[ruled] = lengths[symbols[ruled] - np.uint32(base)]
    samples = (np.cumsum(sizes) - sizes)[::STEP]
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    body = b"".join((
        _HEAD.pack(_MAGIC, base, len(rules), len(symbols), len(ids), STEP),
        rules.astype(kind).tobytes(),
        lengths.astype("<u4").tobytes(),
        samples.astype("<u4").tobytes(),
        symbols.astype(kind).tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def from_bytes(data: bytes) -> Grammar:
    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a shard is damaged: its checksum differs")
    magic, base, n_rules, n_symbols, n_ids, step = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError(f"not a shard: it begins with {magic!r}")
    kind = np.dtype("<u2" if base + n_rules <= 1 << 16 else "<u4")
    at, found = _HEAD.size, []
    for dtype, n in ((kind, 2 * n_rules), (np.dtype("<u4"), n_rules), (np.dtype("<u4"), -(-n_symbols // step)), (kind, n_symbols)):
        found.append(np.frombuffer(data, dtype, n, at))
        at += dtype.itemsize * n
    rules, lengths, samples, symbols = found
    return Grammar(base, n_ids, step, rules.reshape(-1, 2).astype(np.uint32), lengths.astype(np.int64), symbols, samples)


# ---------------------------------------------------------------- the store


def _rows(part: int, stream: Iterable[tuple[int | None, bytes]], size: int, base: int) -> Iterator[tuple]:
    """The shards of one partition's documents, given in order with their ids."""
    shard, first, position = 0, 0, 0
    held: list[np.ndarray] = []
    docs: list[dict] = []
    room = size

    def close() -> tuple:
        ids = np.concatenate(held)
        named = [d["doc_id"] for d in docs if d["doc_id"] is not None]
        return (part, shard, first, len(ids), min(named, default=None), max(named, default=None), list(docs), to_bytes(ids, base))

    for doc_id, data in stream:
        ids = np.frombuffer(data, "<u4")
        skipped = 0
        while skipped < len(ids):
            taken = min(room, len(ids) - skipped)
            docs.append({"doc_id": doc_id, "start": position, "length": len(ids), "at": size - room, "taken": taken, "skipped": skipped})
            held.append(ids[skipped : skipped + taken])
            skipped, room = skipped + taken, room - taken
            if not room:
                yield close()
                shard, first, room = shard + 1, first + size, size
                held.clear()
                docs.clear()
        position += len(ids)
    if held:
        yield close()


def shards(docs: DataFrame, tokenizer: str | None = None, size: int = SHARD) -> DataFrame:
    """The rows of a store of all texts in ascending doc_id order (``SCHEMA``): write them as Parquet.

    ``part`` and ``shard`` order the shards. In ``docs``, start is the document's place in the stream of
    its partition, at its place in the shard, taken its ids there and skipped those in earlier shards.
    """
    spark = docs.sparkSession
    ship(spark)
    where = tokenizer or os.path.abspath(default_tokenizer())
    ordered = ["doc_id", "_tie", "_row"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("_tie"),
        F.monotonically_increasing_id().alias("_row"),
    )
    ranged = (
        rows.repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    schema = spark.createDataFrame([], SCHEMA).schema

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_for(where)
        base = words.tokenizer.get_vocab_size()
        end = np.array([END_ID], "<u4").tobytes()
        kinds = to_arrow_schema(schema)
        part = None

        def stream(rest: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
            for batch in rest:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    for doc_id, text in zip(some.column("doc_id").to_pylist(), texts_of(some)):
                        yield doc_id, words.encode(text) + end

        def counted(rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in rest:
                if batch.num_rows:
                    part = batch.column("part")[0].as_py() if part is None else part
                    yield batch

        source = counted(batches)
        head = next(source, None)
        if head is None:
            return
        again = (b for group in ([head], source) for b in group)
        for row in _rows(part, stream(again), size, base):
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row))], schema=kinds)

    return ranged.mapInArrow(store, schema)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, size: int = SHARD) -> None:
    shards(docs, tokenizer, size).write.parquet(path)


_PIECE = "part int, doc_id long, start long, length long, skipped long, ids binary, ids_crc32 long"


def _pieces(store: DataFrame, wanted: list[int] | None = None, keep_ids: bool = True) -> DataFrame:
    """The stored pieces of documents, decoded. Without ``keep_ids`` a whole document comes as its
    checksum. With ``wanted`` only those documents are expanded, each from its own place."""
    ship(store.sparkSession)
    chosen = None if wanted is None else frozenset(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, docs, data in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "grammar"))):
                grammar = from_bytes(data)
                whole = grammar.ids().astype("<u4") if chosen is None else None
                rows: list[tuple] = []
                for d in docs:
                    if chosen is not None and d["doc_id"] not in chosen:
                        continue
                    a, b = d["at"], d["at"] + d["taken"]
                    ids = (grammar.ids(a, b).astype("<u4") if whole is None else whole[a:b]).tobytes()
                    bare = not keep_ids and d["taken"] == d["length"]
                    rows.append((part, d["doc_id"], d["start"], d["length"], d["skipped"], None if bare else ids, zlib.crc32(ids) if bare else None))
                columns = zip(*rows) if rows else [[]] * 7
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["part", "doc_id", "start", "length", "skipped", "ids", "ids_crc32"],
                )

    rows = store.select("part", "docs", "grammar")
    if chosen is not None:
        spans = F.lit(False)
        for doc_id in sorted(chosen):
            spans = spans | ((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        rows = store.where(spans).select("part", "docs", "grammar")
    return rows.mapInArrow(decode, _PIECE)


def _documents(pieces: DataFrame) -> DataFrame:
    """Pieces put together: part, doc_id, start, length, ids (null if only its checksum came), ids_crc32."""
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("skipped", "ids"))), F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    whole = pieces.groupBy("part", "start").agg(
        F.first("doc_id").alias("doc_id"), F.first("length").alias("length"), joined.alias("ids"), F.max("ids_crc32").alias("ids_crc32")
    )
    return whole.withColumn("ids_crc32", F.coalesce("ids_crc32", F.crc32("ids")))


def _placed(documents: DataFrame, store: DataFrame) -> DataFrame:
    """``documents`` with start as the ids of all documents before it, over all partitions."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per range partition of the writer, two numbers each.
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("_offset"))
    return documents.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("_offset")).drop("_offset")


def fetch(store: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids (little-endian 32-bit numbers, end id included) of the rows with these ids."""
    found = _documents(_pieces(store, doc_ids))
    return _placed(found, store).select("doc_id", "start", "ids")


def digests(store: DataFrame) -> DataFrame:
    """One row per stored document, read back from a written store."""
    read = _placed(_documents(_pieces(store, keep_ids=False)), store)
    return read.select("doc_id", "start", F.col("length").alias("n_tokens"), "ids_crc32")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Write all texts to a store in the scratch folder and read them back as checksums."""
    return digests(settle(shards(docs)))
