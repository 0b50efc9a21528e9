"""Merkle manifest of a corpus: an append log of tree nodes in the order in which they are completed.

Every row is a leaf. Per language, leaves stand in ascending doc_id order; two consecutive nodes (a
last one without a partner: it alone) become their hash, until one is left, the subroot. The subroots in
the order of the languages become the root in the same way.

Nodes are logged in postorder: a node follows its last leaf as soon as all below it is there. Builders
take aligned blocks of ``BLOCK`` leaves, so a block is a complete subtree and its nodes are one stretch of
the log; the nodes above the blocks are built by the same builder with the blocks' tops as its leaves.
Where a node stands follows from the sizes of the subtrees before it (``position``), so siblings are
addressed, not searched: a proof reads its block's stretch once, and each block's own proof serves all
of its leaves.

Edge cases: a null field counts as ``-``. Null doc_ids come first. Rows that share a doc_id are ordered
by their leaf; equal rows are leaves of their own, and interchangeable. A null language is a language of
its own. A language with one leaf has it as subroot, and a single language's subroot is the root. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import ship

#: Levels of a builder's block, and its leaves.
LEVELS = 10
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- hashes and positions


def digest(value: bytes) -> bytes:
    """A hash as the hexadecimal text that enters further hashes."""
    return sha256(value).hexdigest().encode()


def leaf(**changed: Column) -> Column:
    """The leaf of a row, as hexadecimal text."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    return max(0, leaves - 1).bit_length()


def size(leaves: int, level: int) -> int:
    """Nodes of a subtree of that many leaves, from them up to its node of ``level``."""
    return sum(-(-leaves >> t) for t in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the log of a tree of that many leaves.

    Before its subtree stand all nodes whose leaves end before its first leaf s: the sum of s / 2^t, rounded
    down, which is 2 s less the one bits of s. The node itself is the last of its subtree.
    """
    first = index << level
    below = min(1 << level, leaves - first)
    return 2 * first - first.bit_count() + size(below, level) - 1


def log_of(leaves: list[bytes], levels: int) -> list[bytes]:
    """Nodes of a tree in completion order, up to ``levels`` above the leaves: each leaf, then every node
    that it completes."""
    log: list[bytes] = []
    last = len(leaves) - 1
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]
    for number, node in enumerate(leaves):
        level = 0
        log.append(node)
        while level < levels:
            open_[level].append(node)
            if len(open_[level]) < 2 and number < last:
                break
            node = digest(b"".join(open_[level]))
            open_[level].clear()
            log.append(node)
            level += 1
    return log


def siblings(log: list[bytes], leaves: int, index: int, levels: int) -> list[bytes]:
    """From the leaf upward, the other node of each pair: empty where there is none."""
    found = []
    for level in range(levels):
        other = (index >> level) ^ 1
        found.append(log[position(level, other, leaves)] if other << level < leaves else b"")
    return found


def fold(node: bytes, index: int, path: list[bytes]) -> bytes:
    """The top that a node and its siblings lead to."""
    for level, other in enumerate(path):
        node = digest(other + node if index >> level & 1 else node + other)
    return node


# ---------------------------------------------------------------- ranks


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` within its group from 0 and ``leaves``, the group's size.

    Rows are dealt over ranges of (group, order), so no task holds a whole group; what stands before a
    range follows from the ranges' counts alone. Equal rows are told apart by their place in the table.
    """
    order = [*order, "_row"]
    ranged = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(group, *order)
    held = settle(ranged.sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range that meet: few more than there are ranges and groups.
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("leaves"),
    )
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return (
        held.withColumn("_local", local)
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn("rank", F.col("_local") + F.col("_before"))
        .drop("_part", "_g", "_p", "_local", "_before", "_row")
    )


# ---------------------------------------------------------------- the log

LOG = "lang string, block long, leaves long, first_position long, doc_ids array<long>, nodes binary, top string"


def _log_rows(ranks: DataFrame, tier: int) -> DataFrame:
    """One row per aligned block of ranked nodes: its stretch of the log, and its top."""
    blocks = (
        ranks.withColumn("block", F.shiftright("rank", LEVELS))
        .groupBy("lang", "block")
        .agg(
            F.max("leaves").alias("leaves"),
            F.sort_array(F.collect_list(F.struct((F.col("rank") % BLOCK).cast("int").alias("at"), "doc_id", "node"))).alias("members"),
        )
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                members = [m["node"].encode() for m in row["members"]]
                levels = min(LEVELS, height(row["leaves"]))
                log = log_of(members, levels)
                first = row["block"] * BLOCK
                rows.append((
                    row["lang"], row["block"], row["leaves"], 2 * first - first.bit_count(),
                    [m["doc_id"] for m in row["members"]], b"".join(map(bytes.fromhex, map(bytes.decode, log))), log[-1].decode(),
                ))
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
            names = ["lang", "block", "leaves", "first_position", "doc_ids", "nodes", "top"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return blocks.mapInArrow(build, LOG).withColumn("tier", F.lit(tier))


def logs(ranks: DataFrame) -> list[DataFrame]:
    """The written log of trees of ranked nodes (lang, doc_id, node, rank, leaves): one table per tier.

    Tier 0 holds the blocks of leaves; a block's top is a leaf of the next tier, up to single blocks. In
    the tiers above, first_position counts nodes of that tier.
    """
    written = [settle(_log_rows(ranks, 0))]
    while written[-1].where(F.col("block") > 0).limit(1).count():
        tops = written[-1].select(
            "lang",
            F.lit(None).cast("long").alias("doc_id"),
            F.col("top").alias("node"),
            F.col("block").alias("rank"),
            F.ceil(F.col("leaves") / BLOCK).alias("leaves"),
        )
        written.append(settle(_log_rows(tops, len(written))))
    return written


_PATH = "lang string, at long, doc_id long, node string, path binary, sides array<int>"


def paths(log: DataFrame) -> DataFrame:
    """For every leaf of a tier's blocks its siblings up to the block's top, read from the log.

    ``path`` holds their digests, ``sides`` per level 0 without sibling, 1 if it stands left, 2 if right.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, n = row["nodes"], len(row["doc_ids"])
                levels = min(LEVELS, height(row["leaves"]))
                log_ = [data[i : i + 32] for i in range(0, len(data), 32)]
                found, sides, nodes = [], [], []
                for index in range(n):
                    path = siblings(log_, n, index, levels)
                    found.append(b"".join(path))
                    sides.append([0 if not other else 1 if index >> level & 1 else 2 for level, other in enumerate(path)])
                    nodes.append(log_[position(0, index, n)].hex())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["lang"]] * n, pa.string()),
                        pa.array(range(row["block"] * BLOCK, row["block"] * BLOCK + n), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(nodes, pa.string()),
                        pa.array(found, pa.binary()),
                        pa.array(sides, pa.list_(pa.int32())),
                    ],
                    names=["lang", "at", "doc_id", "node", "path", "sides"],
                )

    return log.select("lang", "block", "leaves", "doc_ids", "nodes").mapInArrow(read, _PATH)


def _whole_paths(tiers: list[DataFrame]) -> DataFrame:
    """Paths of all leaves up to the tops of their trees, with the top."""
    upper = tiers[-1].select("lang", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("path"), F.array().cast("array<int>").alias("sides"), "top")
    for log in reversed(tiers):
        above = upper.select(
            F.col("lang").alias("_lang"), F.col("at").alias("_at"), F.col("path").alias("_path"), F.col("sides").alias("_sides"), "top"
        )
        below = paths(log).withColumn("_block", F.shiftright("at", LEVELS))
        same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_block") == F.col("_at"))
        upper = below.join(above, same).select(
            "lang", "at", "doc_id", "node", F.concat("path", "_path").alias("path"), F.concat("sides", "_sides").alias("sides"), "top"
        )
    return upper


_CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(rows: DataFrame) -> DataFrame:
    """Proof digests and recomputed roots of rows with doc_id, leaf, candidate, path, sides, subroot and root."""
    ship(rows.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in ("doc_id", "leaf", "subroot", "root")}
            proofs, roots = [], []
            for candidate, path, sides in zip(*(batch.column(c).to_pylist() for c in ("candidate", "path", "sides"))):
                node, at, all_ = candidate.encode(), 0, path.hex().encode()
                for side in sides:
                    other = all_[at : at + 64] if side else b""
                    at += len(other)
                    node = digest(other + node if side == 1 else node + other)
                proofs.append(digest(all_).decode())
                roots.append(node.decode())
            columns["proof_sha256"] = pa.array(proofs, pa.string())
            columns["folded_root"] = pa.array(roots, pa.string())
            columns["verified"] = pa.array([a == b for a, b in zip(roots, columns["root"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.select("doc_id", "leaf", "candidate", "path", "sides", "subroot", "root").mapInArrow(check, _CHECKED)


# ---------------------------------------------------------------- documents


def proofs(docs: DataFrame, candidate: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its leaf, the subroot, the root, its proof, and the root that the
    leaf ``candidate`` (where null: the leaf itself) folds to with that proof."""
    ship(docs.sparkSession)
    other = F.lit(None).cast("string") if candidate is None else candidate
    # Whole texts are read once, here.
    leaves = settle(docs.select("doc_id", "lang", leaf().alias("node"), other.alias("candidate")))
    ranks = settle(ranked(leaves.withColumn("candidate", F.coalesce("candidate", "node")), "lang", ["doc_id", "node", "candidate"]))
    tiers = logs(ranks)
    whole = _whole_paths(tiers)
    # The tree over the subroots has one leaf per language.
    tops = tiers[-1].select(F.lit(0).alias("_all"), "lang", F.col("top").alias("node"))
    ordered = settle(ranked(tops, "_all", ["lang"]))
    over = _whole_paths(logs(ordered.select(
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("doc_id"), "node", "rank", "leaves"
    )))
    roots = settle(
        ordered.select("lang", "rank").join(over.select("at", "path", "sides", "top", "node"), F.col("rank") == F.col("at")).select(
            F.col("lang").alias("_lang"), F.col("path").alias("_path"), F.col("sides").alias("_sides"), F.col("top").alias("root"), F.col("node").alias("subroot")
        )
    )
    named = ranks.select(F.col("lang").alias("_l"), F.col("rank").alias("_r"), F.col("node").alias("leaf"), "candidate")
    rows = (
        whole.join(named, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("at") == F.col("_r")))
        .join(roots, F.col("lang").eqNullSafe(F.col("_lang")))
        .select("doc_id", "leaf", "candidate", F.concat("path", "_path").alias("path"), F.concat("sides", "_sides").alias("sides"), "subroot", "root")
    )
    return folded(rows)


def tampered() -> Column:
    """The leaf of a row with n_chars one too high where 7 divides the checksum of its doc_id, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(n_chars=F.col("n_chars") + 1))


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, with tampered rows as candidates."""
    return proofs(docs, tampered()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The same by recursion over whole levels. crc32 is worked out bit by bit.
AUDIT_SQL = """
with recursive fields as (
    select doc_id, lang, n_chars,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as tail,
        list_reduce(
            flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda crc, x: case when x >= 0 then xor(crc, x) when crc % 2 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end,
            4294967295::bigint) as crc
    from documents
), leaves as (
    select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
        sha256(head || coalesce(strlen((n_chars + bad)::varchar) || ':' || (n_chars + bad), '-') || tail) as candidate
    from (select *, case when xor(crc, 4294967295) % 7 = 0 then 1 else 0 end as bad from fields)
), ranks as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf, candidate) - 1 as r, count(*) over (partition by lang) as n
    from leaves
), tree as (
    select lang, 0 as level, r as i, leaf as node, n from ranks
    union all
    select lang, level + 1, i // 2, sha256(string_agg(node, '' order by i)), (n + 1) // 2 from tree where n > 1 group by lang, level, i // 2, n
), subroots as (
    select lang, node, row_number() over (order by lang nulls first) - 1 as r, count(*) over () as n from tree where n = 1
), top as (
    select 0 as level, r as i, node, n from subroots
    union all
    select level + 1, i // 2, sha256(string_agg(node, '' order by i)), (n + 1) // 2 from top where n > 1 group by level, i // 2, n
), steps as (
    select x.lang, x.r, t.level, t.node, (x.r >> t.level) % 2 as odd
    from ranks x join tree t on t.lang is not distinct from x.lang and t.i = xor(x.r >> t.level, 1)
    where t.n > 1
    union all
    select x.lang, x.r, 1000 + t.level, t.node, (s.r >> t.level) % 2
    from ranks x join subroots s on s.lang is not distinct from x.lang join top t on t.i = xor(s.r >> t.level, 1)
    where t.n > 1
), alone as (
    select x.lang, x.r, t.level from ranks x join tree t on t.lang is not distinct from x.lang and t.i = x.r >> t.level where t.n > 1
    union all
    select x.lang, x.r, 1000 + t.level
    from ranks x join subroots s on s.lang is not distinct from x.lang join top t on t.i = s.r >> t.level where t.n > 1
), path as (
    select a.lang, a.r, row_number() over (partition by a.lang, a.r order by a.level) as step, s.node, s.odd
    from alone a left join steps s on s.lang is not distinct from a.lang and s.r = a.r and s.level = a.level
), fold as (
    select lang, r, 0 as step, candidate as node from ranks
    union all
    select f.lang, f.r, f.step + 1, sha256(case when p.node is null then f.node when p.odd = 1 then p.node || f.node else f.node || p.node end)
    from fold f join path p on p.lang is not distinct from f.lang and p.r = f.r and p.step = f.step + 1
), folded as (
    select lang, r, arg_max(node, step) as folded_root from fold group by lang, r
), proof as (
    select lang, r, sha256(coalesce(string_agg(node, '' order by step), '')) as proof_sha256 from path group by lang, r
)
select x.doc_id, x.leaf, s.node as subroot, root.node as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
    f.folded_root, f.folded_root = root.node as verified
from ranks x
join subroots s on s.lang is not distinct from x.lang
join (select node from top where n = 1) root on true
join folded f on f.lang is not distinct from x.lang and f.r = x.r
left join proof p on p.lang is not distinct from x.lang and p.r = x.r
"""
