"""Quality of documents by an interpolated modified Kneser-Ney model.

Per language, a model of character n-grams (``ORDER`` characters, white space as one kind) is trained on all
trusted text: documents labelled as good and not toxic. Counts are summed by grouped jobs; counts of lower
orders are numbers of different left neighbours; each order has three discounts from its counts of counts.
Documents are dealt into two halves by hash, and each is scored by the model of the other half's trusted text: so
no document, and no threshold, rests on a model that has seen it.

Scoring never joins positions. Blocks of rows list their different n-grams; the different n-grams of all blocks
join with the sharded count tables of all orders and get their probability; those are then handed back. Up to
``MOST_SENT`` n-grams that is one table sent to every task, beyond it each block of documents is
met by the n-grams of that block alone (``by_blocks``), with the same result. A document's perplexity is the exponential of
its mean negative log probability per character; that must be at most the ``QUANTILE`` of the trusted documents of its
language and length class (powers of two of the characters, ``CLASSES``; approximate quantile with relative rank
error 1e-4). So the few odd and very short trusted texts raise the threshold of their own class alone. A class without trusted
text takes the threshold of the language.

Characters do not show a toxic word, so words are counted besides, by documents: toxic ones (labelled so, whatever
their quality) against trusted ones, again of the other half. A word in at least ``LEAST_TOXIC`` toxic documents and ``RATIO``
times as often there as in trusted ones is marked, with the root of its log-likelihood ratio as weight. Marked words go the
way of the n-grams. A document's toxicity is the weight of its different words by the root of their number; that too must
be at most the ``QUANTILE`` of the trusted documents of its language. A document is kept if both hold.

Edge cases: null language is a language of its own. Documents without characters, or in a language without
trusted text, have no perplexity (null) and are kept: there is nothing to judge them by. Characters beyond
U+FFFE count modulo that number. Rows that share a doc_id with a label row are trusted if any label says so.
Rows that share a doc_id with a toxic label row and are not trusted are toxic. Without toxic or trusted documents in a
language no word is marked and toxicity is 0. Words are those of ``common.word_hashes``.
Repeated rows count and are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import blocks, ship, word_hashes

ORDER = 4
QUANTILE = 0.995
#: Least and largest length class: 2^5 characters and fewer, 2^12 and more.
CLASSES = (5, 12)
#: Least number of toxic documents with a marked word, and how much more often toxic documents have it.
LEAST_TOXIC, RATIO = 3, 10.0
#: Most labelled documents that are sent to every task; beyond it texts are shuffled to meet them.
MOST_MARKS = 500_000
MOST_SENT = 2_000_000
#: Documents of one block of the second way to hand out probabilities.
BLOCK_ROWS = 4000

_START = 0xFFFF
_SPACE = np.zeros(0x10000, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0xA0]] = True


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every character of several texts with the three before it, as one number, and the length of each text."""
    lead = chr(_START) * (ORDER - 1)
    codes = np.frombuffer("".join(lead + x for x in texts).encode("utf-32-le", "surrogatepass"), "<u4") % 0x1FFFF
    codes = np.where(codes > _START, codes % _START, codes).astype(np.uint64)
    codes[_SPACE[codes.astype(np.int64)]] = 32
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + ORDER - 1)
    real = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        real[ends - sizes - 1 - k] = False
    at = np.flatnonzero(real)
    out = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | codes[at - (ORDER - 1 - k)]
    return out, sizes


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different words of several texts: index of the text (ascending) and hash."""
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    ends = np.cumsum([len(x) for x in texts])
    cuts = np.flatnonzero(np.diff(ends // (4 << 20), prepend=0)).tolist()
    for low, high in zip([0, *cuts], [*cuts, len(texts)]):
        if low == high:
            continue
        hashes, counts = word_hashes([x.encode("utf-8", "surrogatepass") for x in texts[low:high]])
        owner = np.repeat(np.arange(low, high), counts)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owners.append(owner[new])
        found.append(hashes[new])
    return np.concatenate(owners), np.concatenate(found)


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _per_block(docs: DataFrame, counted: bool) -> DataFrame:
    """lang, g, n: different n-grams of blocks of rows, with their number in the block."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 16 << 20, 1 << 20):
            names = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(names)):
                found, n = np.unique(grams([texts[i] for i in np.flatnonzero(names == lang)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"]
                )

    return docs.select(_language(docs).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(read, "lang string, g long, n long")


def _suffix(gram: Column, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << (16 * order)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def model(trusted: DataFrame) -> dict[str, DataFrame]:
    """Tables ``alpha{k}`` (lang, g, alpha) and ``gamma{k}`` (lang, c, gamma) for every order k: the probability of
    an n-gram is alpha + gamma of its context times the probability of one order less."""
    ship(trusted.sparkSession)
    top = settle(_per_block(trusted, True).groupBy("lang", "g").agg(F.sum("n").alias("n")))
    tables, counts = {}, top
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            counts = settle(counts.groupBy("lang", _suffix(F.col("g"), order).alias("g")).agg(F.count(F.lit(1)).alias("n")))
        # The discounts of Chen and Goodman from the numbers of n-grams seen 1 to 4 times.
        of = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        seen = counts.groupBy("lang").agg(*of)
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [
            F.coalesce(F.least(F.lit(float(k)), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(f"n{k}", F.lit(0.0)))), F.lit(0.5 * k)).alias(f"d{k}")
            for k in (1, 2, 3)
        ]
        seen = seen.select("lang", *cut)
        rows = counts.join(F.broadcast(seen), "lang")  # one row per language
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", discount).withColumn("c", _context(F.col("g")))
        contexts = settle(rows.groupBy("lang", "c").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("left")))
        alpha = rows.join(contexts, ["lang", "c"]).select("lang", "g", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
        tables[f"alpha{order}"] = settle(alpha)
        tables[f"gamma{order}"] = contexts.select("lang", "c", (F.col("left") / F.col("total")).alias("gamma"))
    return tables


def probabilities(wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """lang, g, lp (natural logarithm) of different n-grams, by joins with the tables of all orders; languages
    without a model drop out."""
    symbols = tables["alpha1"].groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    rows = wanted.join(symbols, "lang").withColumn("p", 1.0 / (F.col("v") + 1)).drop("v")
    for order in range(1, ORDER + 1):
        rows = rows.withColumn("key", _suffix(F.col("g"), order)).withColumn("c", _context(F.col("key")))
        alpha = tables[f"alpha{order}"].withColumnRenamed("g", "key")
        rows = rows.join(tables[f"gamma{order}"], ["lang", "c"], "left").join(alpha, ["lang", "key"], "left")
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")
        rows = rows.select("lang", "g", p.alias("p"))
    return rows.select("lang", "g", F.log("p").alias("lp"))


def marked(labelled: DataFrame) -> DataFrame:
    """lang, g, lp: marked words (hashes) and their weights, from ``labelled`` (lang, trusted, text): trusted and toxic documents.
    The language stands behind a ``w``, so that no n-gram is taken for a word."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 16 << 20, 1 << 20):
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("trusted").to_pylist()))
            texts = batch.column("text").to_pylist()
            for lang, trusted in sorted(set(keys)):
                mine = words([x for x, key in zip(texts, keys) if key == (lang, trusted)])[1]
                found, n = np.unique(mine, return_counts=True)
                columns = [pa.array([lang] * len(found), pa.string()), pa.array([trusted] * len(found), pa.bool_()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "trusted", "g", "n"])

    def of(trusted: bool, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("trusted") == trusted, value)), F.lit(0)).cast("double")

    counts = labelled.mapInArrow(read, "lang string, trusted boolean, g long, n long")
    counts = counts.groupBy("lang", "g").agg(of(False, F.col("n")).alias("t"), of(True, F.col("n")).alias("c")).where(F.col("t") >= LEAST_TOXIC)
    documents = labelled.groupBy("lang").agg(of(False, F.lit(1)).alias("toxic"), of(True, F.lit(1)).alias("clean"))
    rows = counts.join(F.broadcast(documents.where("toxic > 0 and clean > 0")), "lang")  # one row per language
    often = (F.col("t") + 0.5) / (F.col("toxic") + 1) >= RATIO * (F.col("c") + 0.5) / (F.col("clean") + 1)

    def part(n: str, of_: str) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (F.col("toxic") + F.col("clean")) / ((F.col("t") + F.col("c")) * F.col(of_)))).otherwise(0.0)

    weight = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("t", "toxic") + part("c", "clean"))))
    return rows.where(often).select(F.concat(F.lit("w"), "lang").alias("lang"), "g", weight.alias("lp"))


class Scores:
    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.of = {}
        for lang, (keys, lp) in tables.items():
            order = np.argsort(keys)
            self.of[lang] = (keys[order], lp[order])

    def perplexities(self, lang: str, texts: list[str]) -> np.ndarray:
        found, sizes = grams(texts)
        if lang not in self.of:
            return np.full(len(texts), np.nan)
        keys, lp = self.of[lang]
        unique, back = np.unique(found, return_inverse=True)
        sums = np.concatenate([[0.0], np.cumsum(lp[np.searchsorted(keys, unique)][back])])
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.exp(-(sums[ends] - sums[ends - sizes]) / np.where(sizes, sizes, np.nan))


    def toxicities(self, lang: str, texts: list[str]) -> np.ndarray:
        if "w" + lang not in self.of:
            return np.zeros(len(texts))
        keys, weights = self.of["w" + lang]
        owner, found = words(texts)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        weight = np.where(keys[at] == found, weights[at], 0.0)
        return np.bincount(owner, weight, len(texts)) / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(texts))))


def _by_language(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    frame = table.select(["lang", "g", "lp"]).to_pandas()
    return {lang: (part["g"].to_numpy().view(np.uint64), part["lp"].to_numpy()) for lang, part in frame.groupby("lang")}


def _collected(known: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """At most MOST_SENT rows on the driver, packed to 16 bytes each: as rows they would fill it."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _by_language(pa.Table.from_batches([batch]))
            columns = [pa.array(list(parts), pa.string())] + [pa.array([x[k].tobytes() for x in parts.values()], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "g", "lp"])

    parts: dict[str, list] = {}
    for row in known.mapInArrow(pack, "lang string, g binary, lp binary").collect():
        parts.setdefault(row["lang"], []).append((np.frombuffer(row["g"], np.uint64), np.frombuffer(row["lp"], float)))
    return {lang: (np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both])) for lang, both in parts.items()}


def _scored(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (doc_id, lang, trusted, text) with their perplexity and toxicity, by one table for every task."""
    scores = Scores(_collected(known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 8 << 20, 1 << 20):
            yield _with_scores(batch, scores)

    return rows.mapInArrow(score, _SCORED.format(rows.schema["doc_id"].dataType.simpleString()))


_SCORED = "doc_id {}, lang string, trusted boolean, perplexity double, toxicity double, chars long"


def _with_scores(batch: pa.RecordBatch, scores: Scores) -> pa.RecordBatch:
    names = np.array(batch.column("lang").to_pylist(), object)
    texts = batch.column("text").to_pylist()
    out, toxic = np.full(len(texts), np.nan), np.zeros(len(texts))
    for lang in set(names):
        mine = np.flatnonzero(names == lang)
        out[mine] = scores.perplexities(lang, [texts[i] for i in mine])
        toxic[mine] = scores.toxicities(lang, [texts[i] for i in mine])
    columns = [batch.column("doc_id"), batch.column("lang"), batch.column("trusted"), pa.array(out, from_pandas=True), pa.array(toxic), pa.array(list(map(len, texts)), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "trusted", "perplexity", "toxicity", "chars"])


def by_blocks(rows: DataFrame, known: DataFrame, documents: int, block_rows: int = BLOCK_ROWS, *, toxic: DataFrame, send: bool) -> DataFrame:
    """``_scored`` for any number of n-grams: documents and the n-grams of their block meet. Marked words (``toxic``) are sent
    to every task (``send``) or go the same way."""
    sent = _collected(toxic) if send else {}
    known = known if send else known.unionByName(toxic)
    many = max(1, -(-documents // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 16 << 20, 1 << 20):
            names, number = np.array(batch.column("lang").to_pylist(), object), np.array(batch.column("block").to_pylist())
            texts = batch.column("text").to_pylist()
            for lang, block in sorted(set(zip(names, number))):
                mine = [texts[i] for i in np.flatnonzero((names == lang) & (number == block))]
                for name, all_ in ((lang, grams(mine)[0]), *([] if send else [("w" + lang, words(mine)[1])])):
                    found = np.unique(all_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(found), pa.int64()), pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64))], names=["block", "lang", "g"]
                    )

    asked = dealt.mapInArrow(listed, "block long, lang string, g long").distinct()
    given = asked.join(known, ["lang", "g"])

    def score(documents_: pa.Table, table: pa.Table) -> pa.Table:
        scores = Scores({**_by_language(table), **sent})
        batches = [_with_scores(b, scores) for b in documents_.combine_chunks().to_batches()]
        return pa.Table.from_batches(batches, schema=_empty(documents_.schema.field("doc_id").type))

    out = _SCORED.format(rows.schema["doc_id"].dataType.simpleString())
    return dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, out)


def _empty(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("lang", pa.string()), ("trusted", pa.bool_()), ("perplexity", pa.float64()), ("toxicity", pa.float64()), ("chars", pa.int64())])


def _length_class(chars: Column) -> Column:
    return F.greatest(F.lit(CLASSES[0]), F.least(F.lit(CLASSES[1]), F.floor(F.log2(F.greatest(F.lit(1), chars)))))


def _quantile(value: str) -> Column:
    return F.percentile_approx(value, F.lit(QUANTILE), F.lit(10000))


def judged(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, perplexity, threshold (of the language and length class), toxicity, toxic_threshold (of the language) and kept."""
    ship(docs.sparkSession)
    good = F.max((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    marks = settle(marks.where("good or bad"))
    if marks.count() <= MOST_MARKS:
        marks = F.broadcast(marks)  # so texts are not shuffled for them
    base = docs.select("doc_id", _language(docs).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = base.join(marks, F.col("doc_id") == F.col("_id"), "left").withColumn("trusted", F.coalesce("good", F.lit(False)))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = rows.select("doc_id", F.concat(half.cast("string"), "lang").alias("lang"), "trusted", "text", "bad")
    other = F.concat(F.when(F.col("lang").startswith("0"), "1").otherwise("0"), F.substring("lang", 2, 1 << 30))
    tables = model(rows.where("trusted").withColumn("lang", other))
    wanted = _per_block(rows, False).select("lang", "g").distinct()
    toxic = settle(marked(rows.where("trusted or bad").select(other.alias("lang"), "trusted", "text")))
    known = settle(probabilities(wanted, tables))
    n_grams, n_words = known.count(), toxic.count()
    rows = rows.drop("bad")
    if n_grams + n_words <= most_sent:
        scored = _scored(rows, known.unionByName(toxic))
    else:
        scored = by_blocks(rows, known, docs.count(), toxic=toxic, send=n_words <= most_sent)
    scored = settle(scored.withColumns({"lang": F.substring("lang", 2, 1 << 30), "class": _length_class(F.col("chars"))}))
    trusted = scored.where("trusted and perplexity is not null")
    whole = trusted.groupBy("lang").agg(_quantile("perplexity").alias("of_lang"), _quantile("toxicity").alias("toxic_threshold"))
    limits = trusted.groupBy("lang", "class").agg(_quantile("perplexity").alias("of_class"))
    # One row per language, and eight.
    both = scored.join(F.broadcast(whole), "lang", "left").join(F.broadcast(limits), ["lang", "class"], "left")
    both = both.withColumn("threshold", F.coalesce("of_class", "of_lang"))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("toxicity") <= F.col("toxic_threshold"), F.lit(True))
    return both.select("doc_id", "perplexity", "threshold", "toxicity", "toxic_threshold", kept.alias("kept"))
