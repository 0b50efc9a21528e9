"""Removal of benchmark passages from a corpus.

Words are runs of digits, letters (A-Z as a-z) and characters outside ASCII. Every window of 13 words of a
benchmark item, or the whole of a shorter item, enters a hash set that all tasks receive. Each text is
scanned at every position; where the hash of its window is in the set, the words themselves are compared.
A word inside any match is hit. Only positions of a window's longest word
are looked up. The scan is one pass over the texts without any shuffle; its result stands in the row.

The set is sent out only up to ``MOST_WINDOWS`` windows, counted first. Beyond that the positions are joined with
the table of windows by hash and verified there (``by_join``), with the same result.

Edge cases: null, empty and wordless texts have no words and no hits; a wordless item has no windows. Equal
windows of several items count for each item. Repeated rows are judged each; an item_id that stands in
several rows counts once. A null item_id is left out of the list of items, but its words are hit. An empty
benchmark hits nothing. Other columns are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import bound, sha256_hex

WINDOW = 13
NOTHING = "array<struct<`from`: int, `to`: int, items: array<string>>>"
#: Windows of the benchmark that are sent to every task; about 200 bytes each.
MOST_WINDOWS = 200_000
#: A document is contaminated if at least one word of this many is hit.
ONE_IN = 20
#: What separates words.
BETWEEN = "[^0-9A-Za-z\\x80-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z and all other characters as they are."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN)
    exact = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # The plain function is much faster and the same where all characters are ASCII.
    lower = lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(exact(x))
    return F.transform(F.array_remove(parts, ""), lower)


def _fold(text: Column) -> Column:
    """All letters in lower case, without the two forms of one letter that depends on what follows."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def _folded(text: Column) -> Column:
    """As ``words``, but all letters in lower case: equal words stay equal, at a fraction of the cost."""
    return F.array_remove(F.split(_fold(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every different window of the items: n (length), parts (words), h (hash of the folded words), items
    (sorted ids), and its longest word: anchor (hash) and place."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("n"))
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))
    each = items.select("item", "n", F.explode(parts).alias("parts"))
    windows = each.groupBy("n", "parts").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = windows.withColumn("folded", F.transform("parts", _fold))
    longest = F.array_max(F.transform("folded", lambda x, i: F.struct(F.length(x), F.xxhash64(x).alias("h"), i.alias("i"))))
    windows = windows.withColumn("longest", longest).withColumn("h", F.xxhash64("folded"))
    return windows.select("n", "parts", "items", "h", F.col("longest.h").alias("anchor"), F.col("longest.i").alias("place"))


def _places(n: int) -> int:
    """Buckets for ``n`` entries: a power of two, most of them empty."""
    return 1 << max(4, (4 * n).bit_length())


def _buckets(keys: list[int], entries: list, kind: str) -> Column:
    """A literal hash table: entries by the low bits of their key."""
    buckets: list[list] = [[] for _ in range(_places(len(keys)))]
    for key, entry in zip(keys, entries):
        buckets[key % len(buckets)].append(entry)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{kind}>>")


def _bucket(table: Column, key: Column, n: int) -> Column:
    return F.get(table, key.bitwiseAND(F.lit(_places(n) - 1)).cast("int"))


def _positions(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _slices(words_: Column, n: int) -> Column:
    return F.transform(_positions(F.size(words_) - n + 1), lambda i: F.slice(words_, i + 1, n))


def _scan(windows: list, text: Column) -> Column:
    """n (words of the text) and found: all matches as (from, to, items), by position.

    Windows hang at the hash of their longest word, which most positions do not have. Where it is, the
    hash of the window there is looked up, and on a hit the words are compared.
    """
    anchors = sorted({w["anchor"] for w in windows})
    known = _buckets(anchors, anchors, "bigint")
    entries = [w.asDict() for w in windows]
    kind = "struct<n: int, parts: array<string>, items: array<string>, h: bigint, anchor: bigint, place: int>"
    table = _buckets([w["anchor"] for w in windows], entries, kind)

    def scan(folded: Column) -> Column:
        def match(hashes: Column) -> Column:
            def at_anchor(i: Column) -> Column:
                def same(e: Column) -> Column:
                    first = i - e["place"]
                    inside = (e["anchor"] == F.get(hashes, i)) & (first >= 0) & (first + e["n"] <= F.size(hashes))
                    return F.when(inside, F.xxhash64(F.slice(folded, F.greatest(first, F.lit(0)) + 1, e["n"])) == e["h"]).otherwise(False)

                hit = F.filter(_bucket(table, F.get(hashes, i), len(windows)), same)
                return F.transform(hit, lambda e: F.struct(
                    (i - e["place"]).alias("from"), (i - e["place"] + e["n"]).alias("to"), e["items"].alias("items"), e["parts"].alias("parts")
                ))

            is_anchor = lambda i: F.array_contains(_bucket(known, F.get(hashes, i), len(anchors)), F.get(hashes, i))
            return F.flatten(F.transform(F.filter(_positions(F.size(hashes)), is_anchor), at_anchor))

        def verified(likely: Column) -> Column:
            exact = lambda w: F.filter(likely, lambda x: F.slice(w, x["from"] + 1, x["to"] - x["from"]) == x["parts"])
            return F.when(F.size(likely) == 0, likely).otherwise(bound(words(text), exact))

        likely = bound(F.transform(folded, lambda x: F.xxhash64(x)), match)
        found = F.transform(F.sort_array(bound(likely, verified)), lambda x: x.dropFields("parts"))
        return F.struct(F.size(folded).alias("n"), found.alias("found"))

    return bound(_folded(text), scan)


def _summary(row: Column) -> Column:
    """Words, hit words, items and matches of a row with its number of words and its matches."""
    def merged(found: Column) -> Column:
        # Matches stand in order of their first word; each adds the words beyond the furthest so far.
        reach = F.aggregate(
            found,
            F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
            lambda s, x: F.struct(
                (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["end"]))).alias("n"),
                F.greatest(s["end"], x["to"]).alias("end"),
            ),
        )
        return F.struct(
            row["n"].cast("long").alias("n_words"),
            reach["n"].cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"])))).alias("items"),
            F.transform(found, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias("matches"),
        )

    return merged(row["found"])


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """row (all columns of ``docs``) and hits: n_words, n_hit, items (sorted ids), matches (word ranges)."""
    windows = settle(benchmark_windows(benchmark, window))
    if windows.count() > most:
        return by_join(docs, windows)
    listed = windows.collect()  # at most ``most`` rows
    found = _scan(listed, F.col("text"))
    return docs.select(F.struct("*").alias("row"), bound(found, _summary).alias("hits"))


def by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``scanned`` for a benchmark of any size: positions and windows meet in a shuffled join, and matches
    return to their rows by (doc_id, digest of the text)."""
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most WINDOW numbers
    body = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    source = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), body.alias("_body"), words(F.col("text")).alias("w"))
    once = source.select("_id", "_body", "w").dropDuplicates(["_body"])
    found = None
    for n in lengths:
        parts = _slices(F.col("w"), n)
        here = once.select("_body", F.posexplode(parts).alias("from", "parts"))
        here = here.join(windows.where(F.col("n") == n), "parts")
        part = here.select("_body", F.struct("from", (F.col("from") + n).alias("to"), "items").alias("m"))
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("_body").agg(F.sort_array(F.collect_list("m")).alias("found"))
    nothing = F.from_json(F.lit("[]"), NOTHING)
    both = source.join(grouped, "_body", "left").withColumn("found", F.coalesce("found", nothing))
    return both.select("row", _summary(F.struct(F.size("w").alias("n"), "found")).alias("hits"))


def contaminated(hits: Column) -> Column:
    return (hits["n_hit"] > 0) & (ONE_IN * hits["n_hit"] >= hits["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return scanned(docs, benchmark).where(~contaminated(F.col("hits"))).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the matched passages cut out of the texts: from the first to the last character of
    each run of hit words, and what stands between words of the run. Other text is left as it is."""
    word = "[0-9A-Za-z\\x80-\\x{10FFFF}]+"
    marked = scanned(docs, benchmark)
    text = F.col("row").getField("text")
    hit_words = F.array_distinct(F.flatten(F.transform(F.col("hits.matches"), lambda x: F.sequence(x["from"], x["to"] - 1))))

    def rebuilt(found: Column) -> Column:
        # found: words, gaps (one more than words) and numbers of hit words.
        keep = F.array_except(F.sequence(F.lit(0), F.size(found["words"]) - 1), found["gone"])
        kept = F.transform(keep, lambda i: F.concat(F.get(found["words"], i), F.get(found["gaps"], i + 1)))
        return F.concat(F.get(found["gaps"], F.lit(0)), F.array_join(kept, ""))

    parts = F.struct(
        F.array_remove(F.split(text, BETWEEN), "").alias("words"),
        F.split(F.concat(F.lit(""), text), word).alias("gaps"),
        hit_words.alias("gone"),
    )
    new = F.when(F.col("hits.n_hit") > 0, bound(parts, rebuilt)).otherwise(text)
    return marked.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, digest of the items, verdict."""
    hits = F.col("hits")
    return scanned(docs, benchmark).select(
        F.col("row.doc_id").alias("doc_id"),
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        sha256_hex(F.array_join(hits["items"], ",")).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )


REPORT_SQL = r"""
with b as (
  select distinct item_id, w from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0
), bw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b)
), d as (
  select row_number() over () as k, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), dw as (
  select k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
), hit as (
  select k, i, dw.n, item_id from dw join bw using (n, g)
), h as (
  select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from (select distinct k, i, n from hit)) group by 1
), items as (
  select k, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct k, item_id::varchar as item_id from hit where item_id is not null) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (k) left join items using (k)
"""
