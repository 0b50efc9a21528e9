"""What each of five filters removes, in every order in which they can be applied.

A document fails up to five filters (``FILTERS``); which of them it fails is a mask of five bits. Masks of all
documents are counted per part, and every figure of every order follows from those counts.

Four filters look at one text. E, identical to the text of a smaller doc_id, needs the whole table. Texts
go through radix tries: paths of bytes shared by texts with the same beginning, and a terminal per
text that holds the smallest doc_id seen.

1. Tasks insert their texts into tries of ``TRIE_BYTES`` and walk them in order. The walk gives cuts: in each run
   of ``CUT_BYTES`` the shortest beginning that parts two neighbours. Cuts of all tasks deal the byte
   strings into ranges of about equal size, by prefixes as long as the texts there need.
2. Tasks insert their texts again. A row behind its terminal's id is a duplicate at once; the others go
   on, one for all equal rows of a trie, to the trie of their range. A text that many tasks hold is dealt over
   salts first, so that no task receives it from every other one.
3. The tries of the ranges settle who is a duplicate. Only flags leave them.

Edge cases: a null text is empty and takes part in E. Rows that share doc_id and text do not count as
smaller than each other. A null doc_id is no smaller than any other and has none smaller: it passes E.
A null language is the part with the empty name. Several labels of a doc_id count as one that is good or
toxic if any of them is. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial, isqrt

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import ship

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Bytes of texts in a trie.
TRIE_BYTES = 32 << 20
#: Bytes of texts per cut.
CUT_BYTES = 64 << 10
#: A text that holds one in so many rows of a trie is reported as frequent.
OFTEN = 64
#: Cuts per range, and for all ranges together: enough to even the ranges out, few enough for a list.
CUTS_PER_RANGE = 50
MOST_CUTS = 1_000_000

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"


# ---------------------------------------------------------------- tries


class Node:
    """A beginning of texts. ``label`` is what it adds to its parent's, ``least`` the smallest id of the text that
    ends here; ``held`` what a caller stores with that text."""

    __slots__ = ("children", "held", "label", "least", "rows")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] | None = None
        self.rows = 0
        self.least: int | None = None
        self.held = None


class Trie:
    """A radix trie over whole texts."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, text: bytes, doc_id: int | None, rows: int = 1) -> Node:
        """The terminal of ``text``, its least id brought up to date."""
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                node = child
                break
            label = child.label
            if text.startswith(label, at):
                at += len(label)
                node = child
                continue
            shared = _shared(label, text, at)
            middle = Node(label[:shared])
            child.label = label[shared:]
            middle.children = {child.label[0]: child}
            node.children[text[at]] = middle
            node, at = middle, at + shared
        node.rows += rows
        if doc_id is not None and (node.least is None or doc_id < node.least):
            node.least = doc_id
        return node

    def walk(self) -> Iterator[tuple[Node, int, int]]:
        """Terminals in the order of their texts, each with its length and the number of bytes that it shares
        with the one before."""
        stack = [(self.root, 0, 0)]
        shared = 0
        while stack:
            node, depth, above = stack.pop()
            shared = min(shared, above)
            if node.rows:
                yield node, depth, shared
                shared = depth
            for first in sorted(node.children or (), reverse=True):
                child = node.children[first]
                stack.append((child, depth + len(child.label), depth))


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text`` from ``at`` have in common."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


# ---------------------------------------------------------------- cuts


def _tries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of several batches, with about ``most`` bytes of texts, as tuples in column order."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                held.append(row)
                size += len(row[0])
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _cuts_of(texts: list[bytes], every: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """From each run of different texts with ``every`` bytes the shortest beginning that parts two neighbours;
    and the hashes and rows of texts that hold one in ``OFTEN`` rows or more."""
    trie = Trie()
    for text in texts:
        trie.insert(text, None).held = text
    cuts, often = [], []
    best, size = None, 0
    for number, (node, depth, shared) in enumerate(trie.walk()):
        if node.rows > 1 and node.rows * OFTEN >= len(texts):
            often.append((_hash(node.held), node.rows))
        if number and (best is None or shared < best[0]):
            best = (shared, node.held)
        size += depth
        if size >= every and best is not None:
            cuts.append(best[1][: best[0] + 1])
            best, size = None, 0
    # The rest counts with the share that it is of a whole run, so many small tries make as many cuts as one.
    if best is not None and _hash(best[1]) % every < size:
        cuts.append(best[1][: best[0] + 1])
    return cuts, often


def ranges(texts: DataFrame, least: int) -> tuple[int, list[bytes], list[int]]:
    """The number of ranges, cuts that deal the texts (one binary column) into them evenly, and the
    hashes of the texts that many tries hold.

    They decide where work is done and never a result: of more than ``MOST_CUTS`` cuts a random share is
    taken, and of frequent texts the most frequent ones, at most one per range.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tries(batches, TRIE_BYTES):
            cuts, often = _cuts_of([r[0] for r in rows], CUT_BYTES)
            found = [*((cut, None, None) for cut in cuts), *((None, *x) for x in often), (None, None, len(rows))]
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["cut", "often", "rows"])

    found = settle(texts.mapInArrow(find, "cut binary, often long, rows long"))
    cut, often = F.col("cut"), F.col("often")
    made = found.agg(F.count(cut).alias("cuts"), F.count_if(cut.isNull() & often.isNull()).alias("tries")).first()
    n = max(least, made["tries"])
    most = min(MOST_CUTS, n * CUTS_PER_RANGE)
    some = found.where(cut.isNotNull()).select("cut")
    if made["cuts"] > most:
        some = some.where(F.rand(1) < most / made["cuts"])
    ordered = sorted(bytes(r["cut"]) for r in some.collect())
    bounds = sorted({ordered[i * len(ordered) // n] for i in range(1, n)}) if ordered else []
    hot = found.where(often.isNotNull()).groupBy("often").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tries"))
    hot = hot.where(F.col("tries") > 4).orderBy(F.desc("rows"), "often").limit(n)
    return n, bounds, [r["often"] for r in hot.collect()]


# ---------------------------------------------------------------- flags


def mask_of(text: bytes, code_points: int) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 3 * code_points) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


_ROW = "target int, text binary, doc_id long, part string, mask int, rows long"
_COLUMNS = ["target", "text", "doc_id", "part", "mask", "rows"]
_KINDS = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64())
_DUPLICATE = 1 << FILTERS.index("E")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_COLUMNS)


def _sift(rows: list[tuple]) -> Iterator[tuple]:
    """Of rows (text, doc_id, part, mask, rows) those that stay open, with their text, and the settled ones
    without it.

    A row behind its terminal's smallest id is a duplicate. Equal rows become one with their number.
    """
    trie = Trie()
    ends = [trie.insert(text, doc_id, n) for text, doc_id, _, _, n in rows]
    settled, open_ = Counter(), Counter()
    for node, (text, doc_id, part, mask, n) in zip(ends, rows):
        if doc_id is None:
            settled[None, part, mask] += n
        elif doc_id > node.least:
            settled[doc_id, part, mask | _DUPLICATE] += n
        else:
            node.held = text
            open_[id(node), doc_id, part, mask] += n
    texts = {id(node): node.held for node in ends}
    for (doc_id, part, mask), n in settled.items():
        yield None, doc_id, part, mask, n
    for (node, doc_id, part, mask), n in open_.items():
        yield texts[node], doc_id, part, mask, n


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit 4 for E) and the number of such rows."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n, bounds, hot = ranges(docs.select(text.cast("binary").alias("text")), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Prefixes and hashes, at most one of each per range.
    shared = spark.sparkContext.broadcast((bounds, frozenset(hot)))
    salts = isqrt(n)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, hot = shared.value
        mine = TaskContext.get().partitionId()
        for number, rows in enumerate(_tries(batches, TRIE_BYTES), mine):
            out = []
            for row in _sift([(text, doc_id, part, mask_of(text, points), 1) for text, doc_id, part, points in rows]):
                if row[0] is None:
                    target = number % n
                else:
                    target = bisect_right(bounds, row[0])
                    if _hash(row[0]) in hot:
                        target = (target + number % salts * (n // salts)) % n
                out.append((target, *row))
            yield _batch(out)

    def merge(again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Settle the open rows of a range; with ``again`` the texts of many tries stay open, for their own range."""

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds, hot = shared.value
            rows = []
            for batch in batches:
                known = pc.is_null(batch.column("text"))
                yield batch.filter(known)
                opened = batch.filter(pc.invert(known))
                rows.extend(zip(*(opened.column(c).to_pylist() for c in _COLUMNS[1:])))
            out = []
            for text, doc_id, *rest in _sift(rows):
                if again and text is not None and _hash(text) in hot:
                    out.append((bisect_right(bounds, text), text, doc_id, *rest))
                else:
                    out.append(((doc_id or 0) % n, None, doc_id, *rest))
            yield _batch(out)

        return sift

    rows = docs.select(
        text.cast("binary").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.char_length(text).alias("points"),
    )
    dealt = rows.mapInArrow(begin, _ROW).repartitionById(n, "target").mapInArrow(merge(again=bool(hot)), _ROW)
    if hot:
        dealt = dealt.repartitionById(n, "target").mapInArrow(merge(again=False), _ROW)
    return dealt.select("doc_id", "part", "mask", "rows")


# ---------------------------------------------------------------- the audit


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and mask, and the good and toxic ones among them."""
    # Equal rows become one before they meet labels, so a doc_id is no hot key.
    rows = flagged(docs).groupBy("doc_id", "part", "mask").agg(F.sum("rows").alias("rows"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic")
    )
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("rows").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("rows")).otherwise(0)).alias("toxic"),
    )


def _steps() -> str:
    """The 120 orders of the filters as JSON, an entry per step: its filter's bit, and the bits of those before."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": name, "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    return json.dumps(rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what the step's filter does there."""
    # Per part at most 32 masks, in an array; the 600 steps are the same for every part.
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    table = F.from_json(F.lit(_steps()), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "masks", F.explode(table).alias("s")).select("part", "masks", "s.*")

    def total(name: str, holds: Callable[[Column], Column]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(holds(m["mask"]), m[name]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def reached(mask: Column) -> Column:
        return mask.bitwiseAND(before) == 0

    # Of the orders, one in as many as the filters that a document fails has this one before the others.
    share = F.aggregate(
        "masks",
        F.lit(0).cast("long"),
        lambda t, m: t + F.when(fails(m["mask"]), m["n"] * (F.lit(factorial(len(FILTERS))) / F.bit_count(m["mask"])).cast("long")).otherwise(0),
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: reached(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: reached(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~reached(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: reached(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: reached(m) & fails(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


#: The same by joins and windows.
AUDIT_SQL = """
with docs as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), facts as (
    select *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '') as words, min(doc_id) over (partition by text) as least
    from docs
), flags as (
    select doc_id, part,
        (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
            + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask
    from facts
), marks as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), counts as (
    select f.part, f.mask, count(*) as n, coalesce(sum(m.good), 0) as good, coalesce(sum(m.toxic), 0) as toxic
    from flags f left join marks m on m.doc_id = f.doc_id group by f.part, f.mask
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e
    where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
    select filter_order, s.step::int as step, bits[s.step] as bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::int as before
    from orders, (select unnest([1, 2, 3, 4, 5]) as step) s
), shapley as (
    select c.part, s.bit, sum(c.n) as shapley from counts c, steps s where c.mask & s.before = 0 and c.mask & s.bit <> 0 group by c.part, s.bit
)
select c.part, s.filter_order, s.step,
    coalesce(sum(c.n) filter (c.mask & s.before = 0 and c.mask & s.bit = 0), 0)::bigint as kept,
    coalesce(sum(c.n) filter (c.mask & s.before = 0 and c.mask & s.bit <> 0), 0)::bigint as removed,
    coalesce(sum(c.n) filter (c.mask & s.before <> 0 and c.mask & s.bit <> 0), 0)::bigint as redundant,
    coalesce(sum(c.n) filter (c.mask = s.bit), 0)::bigint as unique_fails,
    coalesce(sum(c.good) filter (c.mask & s.before = 0 and c.mask & s.bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(c.toxic) filter (c.mask & s.before = 0 and c.mask & s.bit <> 0), 0)::bigint as toxic_lost,
    coalesce(max(h.shapley), 0)::bigint as shapley
from counts c join steps s on true left join shapley h on h.part = c.part and h.bit = s.bit
group by c.part, s.filter_order, s.step
"""
