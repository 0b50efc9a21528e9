"""Near-duplicate groups by weighted MinHash.

Every text becomes a weighted set of its five-word shingles, weight = occurrences times a smoothed inverse
document frequency. Improved consistent weighted sampling draws samples that agree between two texts with
probability equal to their weighted Jaccard similarity. Samples are banded; texts that share a band are
candidates, verified by their exact weighted Jaccard similarity of at least ``THRESHOLD``; connected
documents form a class.

Inverse document frequency: ``1 + IDF_WEIGHT * ln(N / max(df, N * SHARE)) / ln(1 / SHARE)``, from 1 for a
shingle of all documents to 1 + IDF_WEIGHT for one in at most a share of ``SHARE``. So only shingles of
more documents than that need a table, and those number at most 1 / SHARE times the mean length of a
document, whatever the corpus holds. They are found exactly: a first pass counts documents per hashed slot in a table
of ``SLOTS`` numbers per task, whatever its rows; a shingle that frequent lies in a slot at least that full, so a second
pass counts only the shingles of such slots, which are few: at most 1 / SHARE times the mean number of shingles.

Large groups: a bucket of few texts compares all pairs. In a larger one the most central text (that whose
buckets are largest) is compared with all others. Such a pair is verified by its texts only if at least
``AGREE`` of its samples agree, which a pair at the threshold misses about once in 10^5 times. A bucket that then
still holds several classes is cut into blocks of about ``BLOCK`` texts, large classes by themselves, and blocks
meet in pairs unless both are of one class: a matrix product gives the exact similarities of two
blocks, and only a spanning set of their links comes out. So one large class costs no more than its members,
rows grow with pairs of blocks and not of texts, and nothing is cut off.

Edge cases: words are runs of digits, letters (A-Z as a-z) and characters outside ASCII; a text of one to
four words is one shingle; texts without words (null, empty, only signs) are classes of their own.
Rows with the same text share a class. class_id is the least doc_id of a class (null if all are null).
Other columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import blocks, encoded, mix, ship, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Least number of agreeing samples before texts are compared.
AGREE = SAMPLES // 2
SHARE = 0.005
IDF_WEIGHT = 0.5
#: Buckets up to this size compare all pairs.
SMALL = 8
#: Texts and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 256, 200_000
#: Hashed slots of the document counts, and how many of them travel in one row.
SLOTS, PART = 1 << 20, 1 << 9

_BITS = 18
_MASK = np.uint64((1 << 52) - 1)


def _tables() -> tuple[np.ndarray, ...]:
    """The random numbers of consistent weighted sampling, drawn once for 2^18 hash values: r and c are
    Gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(20_10)
    n = 1 << _BITS
    r = rng.gamma(2.0, 1.0, n)
    ln_c = np.log(rng.gamma(2.0, 1.0, n))
    beta = rng.random(n)
    multipliers = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
    return r.astype("f4"), (1 / r).astype("f4"), beta.astype("f4"), (ln_c + r * beta - r).astype("f4"), multipliers


_drawn: list[tuple[np.ndarray, ...]] = []


def drawn() -> tuple[np.ndarray, ...]:
    if not _drawn:
        _drawn.append(_tables())
    return _drawn[0]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of several texts: index of the text (ascending), hash (ascending within a
    text, 52 bits), occurrences. At most 4,096 texts."""
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    first = ends - counts
    made = np.maximum(counts - WORDS + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), made)
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + first[text]
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    factor = 1
    for i in range(WORDS):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        inside = at + i < ends[text]
        total += np.where(inside, padded[at + i], np.uint64(i + 1)) * np.uint64(factor)
    keys = np.sort((text.astype(np.uint64) << np.uint64(52)) | (mix(total) & _MASK))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    repeats = np.diff(new, append=len(keys))
    keys = keys[new]
    return (keys >> np.uint64(52)).astype(np.int64), keys & _MASK, repeats


class Frequencies:
    """Weights from the table of frequent shingles (sorted hashes and document counts)."""

    def __init__(self, documents: int, hashes: np.ndarray, df: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], _MASK)
        scale = IDF_WEIGHT / math.log(1 / SHARE)
        idf = 1 + scale * np.log(max(documents, 1) / np.maximum(df[order], max(documents, 1) * SHARE))
        self.rare = 1 + IDF_WEIGHT
        self.idf = np.append(idf, self.rare)

    def weights(self, hashes: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return repeats * np.where(self.hashes[at] == hashes, self.idf[at], self.rare)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.intp)


def samples(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """Consistent weighted samples of several texts, one row per text; texts without shingles get zeros."""
    r, inverse_r, beta, constant, multipliers = drawn()
    out = np.zeros((texts, SAMPLES), np.uint64)
    if not len(hashes):
        return out
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    present = text[starts]
    sizes = np.diff(starts, append=len(text))
    ln_w = np.log(weights).astype("f4")
    spread = mix(hashes)
    shift = np.uint64(64 - _BITS)
    for k, factor in enumerate(multipliers):
        at = ((spread * factor) >> shift).astype(np.intp)
        step = np.floor(ln_w * inverse_r[at] + beta[at])
        value = constant[at] - r[at] * step
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        drawn_here = mix(hashes[hit] * np.uint64(0x9FB21C651E98DF25) + (step[hit].astype(np.int64) + k).astype(np.uint64))
        owner = np.searchsorted(starts, hit, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[present, k] = np.minimum.reduceat(drawn_here, first)
    return out


def _tallied(docs: DataFrame, n: int) -> DataFrame:
    """part, at and df (binary): how many documents of a task hold a shingle of each of ``n`` hashed slots, in parts of ``PART``
    slots, without empty ones; so a batch of rows takes 3 kB each at most, and a small task sends little."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(n, np.uint32)
        for part in blocks(batches):
            slots += np.bincount(_slot(shingles(encoded(part))[1], n), minlength=n).astype(np.uint32)
        parts = slots.reshape(-1, PART)
        held = np.flatnonzero(parts.any(axis=1))
        at = [np.flatnonzero(parts[k]) for k in held]
        sent = [pa.array(held, pa.int32()), pa.array([x.astype(np.uint16).tobytes() for x in at], pa.binary()),
                pa.array([parts[k][x].tobytes() for k, x in zip(held, at)], pa.binary())]
        yield pa.RecordBatch.from_arrays(sent, names=["part", "at", "df"])

    return docs.select("text").mapInArrow(tally, "part int, at binary, df binary")


def _crowded(tallied: DataFrame, n: int, least: float) -> np.ndarray:
    """A mask of the slots that more than ``least`` documents fall into."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, df in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "df"))):
                sums.setdefault(part, np.zeros(PART, np.int64))
                sums[part][np.frombuffer(at, np.uint16)] += np.frombuffer(df, np.uint32)
        slots = [part * PART + np.flatnonzero(df > least) for part, df in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64))], names=["slot"])

    mask = np.zeros(n, bool)
    mask[[r["slot"] for r in tallied.repartition("part").mapInArrow(add, "slot long").collect()]] = True  # at most ``n`` rows
    return mask


def _counted(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Per block of rows and shingle of the given slots: the number of its documents with it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes = shingles(encoded(batch))[1]
            hashes, df = np.unique(hashes[slots[_slot(hashes, len(slots))]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(df.astype(np.int64))], names=["h", "df"])

    return docs.select("text").mapInArrow(count, "h long, df long")


def frequencies(docs: DataFrame, n: int = SLOTS) -> Frequencies:
    """Exact document frequencies of all shingles in more than a share of ``SHARE`` of ``docs``."""
    documents = docs.count()
    slots = _crowded(_tallied(docs, n), n, documents * SHARE)
    often = _counted(docs, slots).groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") > documents * SHARE)
    rows = often.collect()  # at most 1 / SHARE times the mean length of a document
    return Frequencies(documents, np.array([r["h"] for r in rows], np.int64).astype(np.uint64), np.array([r["df"] for r in rows], np.int64))


def _signatures(docs: DataFrame, known: Frequencies) -> DataFrame:
    """doc_id, body (digest of the text), number of shingles, and the samples as ``sig`` (32-bit hashes)."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text, hashes, repeats = shingles(encoded(batch))
            drawn_samples = samples(text, hashes, known.weights(hashes, repeats), batch.num_rows)
            made = pa.array(np.bincount(text, minlength=batch.num_rows))
            flat = pa.array((drawn_samples >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, SAMPLES, dtype=np.int32))
            sig = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), made, sig], names=["doc_id", "body", "shingles", "sig"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "body", "text")
    return rows.mapInArrow(sample, f"doc_id {id_type}, body string, shingles long, sig array<int>")


def _with_body(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("body", F.md5("text"))


def _similar(pairs: DataFrame, bodies: DataFrame, known: Frequencies) -> DataFrame:
    """The pairs (a, b) of texts whose weighted Jaccard similarity reaches the threshold."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sides = []
                for name in ("text_a", "text_b"):
                    text, hashes, repeats = shingles(encoded(batch, name))
                    keys = (text.astype(np.uint64) << np.uint64(52)) | hashes
                    sides.append((text, keys, known.weights(hashes, repeats)))
                (ta, ka, wa), (tb, kb, wb) = sides
                n = batch.num_rows
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                common = np.bincount(ta[ia], np.minimum(wa[ia], wb[ib]), n)
                union = np.bincount(ta, wa, n) + np.bincount(tb, wb, n) - common
                keep = pa.array(common >= (THRESHOLD - 1e-9) * union)
                yield batch.select(["a", "b"]).filter(keep)

    left = bodies.select(F.col("body").alias("body_a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("body").alias("body_b"), F.col("text").alias("text_b"))
    pairs = pairs.withColumns({"body_a": _body("a"), "body_b": _body("b")})
    return pairs.join(right, "body_b").join(left, "body_a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a string, b string")


def _components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, root: the least node connected with it; for all nodes in a link. ``start``: the same of some of the links."""
    both = settle(links.select("a", "b").union(links.select("b", "a")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    if start is not None:
        before = start.select("node", F.col("root").alias("before"))
        labels = labels.join(before, "node", "left").select("node", F.least("root", "before").alias("root"))
    labels = settle(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        # The root of the root, and the root of that: long chains shrink to a quarter each time.
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        far = lower.join(jump, "low").select("node", F.col("far").alias("low"), "was").join(jump, "low")
        stepped = settle(far.select("node", F.col("far").alias("root"), "was"))
        labels = stepped.select("node", "root")
        if stepped.where("root != was").isEmpty():
            return labels


def _body(name: str) -> Column:
    """The body within a node: nodes are bodies behind their centrality, so that the most central comes first."""
    return F.right(F.col(name), F.lit(32))


def _agreeing(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough equal samples, each once."""
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    left = distinct.select(F.col("body").alias("body_a"), F.col("sig").alias("sig_a"))
    right = distinct.select(F.col("body").alias("body_b"), F.col("sig").alias("sig_b"))
    pairs = pairs.select("a", "b").distinct().withColumns({"body_a": _body("a"), "body_b": _body("b")})
    return pairs.join(right, "body_b").join(left, "body_a").where(same >= AGREE).select("a", "b")


def _bodies(source: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """body, text of all texts in the pairs: of equal texts, one."""
    wanted = pairs.select(_body("a").alias("body")).union(pairs.select(_body("b"))).distinct()
    wanted = wanted.join(distinct.select("body", "doc_id"), "body")
    same_row = [source["body"] == wanted["body"], source["doc_id"].eqNullSafe(wanted["doc_id"])]
    return settle(source.join(wanted, same_row, "left_semi").select("body", "text").dropDuplicates(["body"]))


def _spanning(table: pa.Table, known: Frequencies) -> pa.Table:
    """Links that connect what similar pairs between side 0 and side 1 (side 0 and itself, if alone) connect."""
    names = np.array(table.column("order").to_pylist(), object)
    by_name = np.argsort(names)
    names, side = names[by_name], table.column("side").to_numpy()[by_name]
    texts = encoded(table)
    text, hashes, repeats = shingles([texts[i] for i in by_name])
    # Every further occurrence of a shingle is a feature of its own, so common weight is a product of 0/1 rows.
    owner, shingle = np.repeat(text, repeats), np.repeat(hashes, repeats)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    weight = known.weights(shingle, np.ones(len(shingle)))
    n = len(names)
    total = np.bincount(owner, weight, n)
    _, feature, held = np.unique(mix(shingle) + mix(nth.astype(np.uint64)), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    shared = held[feature] > 1
    owner, weight, feature = owner[shared], weight[shared], number[feature[shared]]
    by_feature = np.argsort(feature, kind="stable")
    owner, weight, feature = owner[by_feature], weight[by_feature], feature[by_feature]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    common = np.zeros((len(a), len(b)))
    width = 4096
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        part = slice(*np.searchsorted(feature, [low, low + width]))
        has, weighs = np.zeros((n, width)), np.zeros(width)
        has[owner[part], feature[part] - low] = 1
        weighs[feature[part] - low] = weight[part]
        common += (has[a] * weighs) @ has[b].T
    linked = np.eye(n, dtype=bool)
    linked[np.ix_(a, b)] |= common >= (THRESHOLD - 1e-9) * (total[a][:, None] + total[b][None, :] - common)
    linked |= linked.T
    label = np.arange(n)
    while True:
        lower = np.where(linked, label[None, :], n).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    rest = np.flatnonzero(label != np.arange(n))
    return pa.table({"a": pa.array(names[label[rest]], pa.string()), "b": pa.array(names[rest], pa.string())})


def _across(rows: DataFrame, bodies: DataFrame, known: Frequencies) -> DataFrame:
    """Links (a, b) that connect what similar texts of different classes in one bucket connect. ``rows``: band, h, order, root, shingles."""
    bucket = ["band", "h"]
    size = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s")]
    groups = rows.groupBy(*bucket, "root").agg(*sums).withColumn("own", size)
    small = groups.where("own = 1").groupBy(*bucket).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(*bucket, size.alias("shared"))
    groups = groups.drop("n", "s").join(small, bucket, "left")
    by_itself = F.concat_ws(":", "root", F.pmod(F.xxhash64("order"), "own"))
    block = F.when(F.col("own") > 1, by_itself).otherwise(F.pmod(F.xxhash64("root"), "shared").cast("string"))
    of_class = F.when(F.col("own") > 1, F.col("root"))
    placed = settle(rows.join(groups, [*bucket, "root"]).select(*bucket, "order", block.alias("block"), of_class.alias("of")))
    blocks_ = placed.select(*bucket, "block", "of").distinct()
    one = blocks_.withColumnsRenamed({"block": "block_a", "of": "of_a"})
    other = blocks_.withColumnsRenamed({"block": "block_b", "of": "of_b"})
    meet = one.join(other, bucket).where("block_a <= block_b and not coalesce(of_a = of_b, false)")
    meet = settle(meet.select(*bucket, "block_a", "block_b"))
    texts = placed.select(*bucket, "block", "order", _body("order").alias("body")).join(bodies, "body").drop("body")
    left = meet.join(texts.withColumnRenamed("block", "block_a"), [*bucket, "block_a"]).withColumn("side", F.lit(0))
    right = meet.where("block_a < block_b").join(texts.withColumnRenamed("block", "block_b"), [*bucket, "block_b"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).groupBy(*bucket, "block_a", "block_b")
    return both.applyInArrow(lambda table: _spanning(table, known), "a string, b string").distinct()


def connected(docs: DataFrame, known: Frequencies | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (body, doc_id = the least, copies) and the classes (body, root) of those in a verified link."""
    ship(docs.sparkSession)
    source = _with_body(docs)
    known = known or frequencies(source)
    signed = _signatures(source, known)
    per_text = [F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig")]
    distinct = settle(signed.groupBy("body").agg(*per_text))

    # Buckets with more than one text.
    bands = F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)).alias("h")) for b in range(BANDS)
    ])
    rows = distinct.where("shingles > 0").select("body", "shingles", F.explode(bands).alias("x")).select("body", "shingles", "x.*")
    sizes = rows.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(rows.join(sizes, ["band", "h"]))
    weight = members.groupBy("body").agg(F.sum("size").alias("central"))
    order = F.concat(F.lpad((F.lit(10**15) - F.col("central")).cast("string"), 16, "0"), "body")
    ranked = settle(members.join(weight, "body").withColumn("order", order).drop("central"))

    def side(frame: DataFrame, name: str, *more: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{c}_{name}") for c in ("order", *more)]
        return frame.select("band", "h", *renamed)

    few, many = ranked.where(F.col("size") <= SMALL), ranked.where(F.col("size") > SMALL)
    pairs = side(few, "a").join(side(few, "b"), ["band", "h"]).where("order_a < order_b").selectExpr("order_a a", "order_b b")
    first = many.groupBy("band", "h").agg(F.min("order").alias("order"))
    heads = many.join(first, ["band", "h", "order"])
    stars = side(heads, "a").join(side(many, "b"), ["band", "h"]).where("order_a < order_b").selectExpr("order_a a", "order_b b")
    candidates = settle(_agreeing(pairs.unionByName(stars), distinct))
    found = settle(_similar(candidates, _bodies(source, distinct, candidates), known))

    roots = _components(found)
    # Buckets above the small size that still hold several classes.
    placed = many.join(roots.withColumnRenamed("node", "order"), "order", "left").withColumn("root", F.coalesce("root", "order"))
    mixed = placed.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = mixed.where("lo != hi").select("band", "h")
    rows = settle(placed.join(mixed, ["band", "h"]).select("band", "h", "order", "root", "shingles"))
    fresh = settle(_across(rows, _bodies(source, distinct, rows.selectExpr("order a", "order b")), known))
    if not fresh.isEmpty():
        roots = _components(found.unionByName(fresh), roots)
    return distinct, roots.select(_body("node").alias("body"), _body("root").alias("root"))


def class_table(docs: DataFrame) -> DataFrame:
    """One row per distinct text: body, class (a body), class_id (the least doc_id), class_copies."""
    distinct, roots = connected(docs)
    placed = distinct.join(roots, "body", "left").select("body", "doc_id", "copies", F.coalesce("root", F.when(F.col("shingles") > 0, F.col("body"))).alias("class"))
    groups = placed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("class_texts")
    )
    return settle(placed.join(groups, "class", "left"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size (documents) and class_texts (different texts), one row per row."""
    table = class_table(docs).select("body", "class", "class_id", "class_size", "class_texts")
    rows = _with_body(docs).select("doc_id", "body").join(table, "body", "left")
    alone = F.col("class").isNull()
    one = F.lit(1).cast("long")
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, one).otherwise(F.col("class_size")).alias("class_size"),
        F.when(alone, one).otherwise(F.col("class_texts")).alias("class_texts"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that with the least doc_id; of rows that agree in
    doc_id and text one stays. Documents without words all stay. The columns are those of ``docs``."""
    table = class_table(docs)
    leaders = table.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "body")).alias("x"))
    kept = leaders.select(F.col("x.doc_id").alias("_doc"), F.col("x.body").alias("_body"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.md5(text).alias("_md5"))
    copies = table.where("class is not null").select(F.col("body").alias("_body"), "copies")
    kept = settle(kept.join(copies, "_body"))
    chosen = marked.join(kept, (F.col("_md5") == F.col("_body")) & F.col("_id").eqNullSafe(F.col("_doc")))
    single = chosen.where("copies = 1").select("row.*")
    several = chosen.where("copies > 1").dropDuplicates(["_md5"]).select("row.*")
    wordless = docs.where(~text.rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))
    return single.unionByName(several).unionByName(wordless)
