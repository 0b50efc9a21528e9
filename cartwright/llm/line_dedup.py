"""Removal of repeated runs of lines, by winnowing over line hashes.

A run is a sequence of consecutive lines with at least ``MIN_WORDS`` words. Windows are shortest runs: for
every line the one that starts there and the one that ends there. Each window selects its least line hash, the
leftmost of equal ones, as fingerprint. What is kept of a document are the positions so selected, each once, with the
windows that select it and the lines that these reach. Two equal runs, wherever they stand, hold equal windows, and
those select the same line of them: a repeated run always shows as two positions with one fingerprint.

Only positions meet. A fingerprint that stands at one position is dropped. At the others the match is extended from
the fingerprint to the left and to the right as far as a window that selects it reaches, and meets the first
position whose lines on both sides are equal (two independent 64-bit hashes of each line). Matches that overlap in a
document are one repeated run, and every line of a run that occurred before is deleted.

"Before" is the order of (doc_id, md5 of the text, position), null doc_ids last; an occurrence that
overlaps the first one in the same document does not count as a repeat. No pairs of occurrences are formed:
each meets the first only, so a line shared by a third of all documents costs one row per occurrence. Keys that
hold more than one row in ``HOT`` of the table, at most ``HOT`` keys, meet their rows by broadcast; the others by a
shuffle, which no single one of them can load.

Edge cases: lines are split at \\n and compared without differences of blanks; lines without a word never count
and stay unless all other lines of the text go. A document all of whose words are deleted is dropped; one
without words from the start (null, empty, blanks) is kept unchanged. Rows that agree in doc_id and text
are one document: they share its outcome. Rows that share only a doc_id are different documents. Other columns
are kept as they are, and columns whose names clash with those used here do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import bound

MIN_WORDS = 50
#: A key with more than one row in so many is hot; there are at most this many such keys.
HOT = 10_000
#: What makes a document.
ONE = ["doc_id", "body"]


def _raw(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(_raw(text)))


def _without(text: Column, lines: Column) -> Column:
    """A text without the lines of the given numbers."""
    def rest(split: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), lines)
        return F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")

    return bound(F.split(text, "\n"), rest)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, body, line (from 0), h and g (two hashes), n (words), total (words of the text): lines with words,
    each document once."""
    flat = F.regexp_replace(_raw(F.col("text")), "[ \\t\\x0b\\f\\r]+", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    hashed = F.transform(
        lines,
        lambda x, i: F.struct(
            i.alias("line"),
            F.xxhash64(x).alias("h"),
            F.xxhash64(F.lit(1), x).alias("g"),
            F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"),
        ),
    )
    arrays = docs.select("doc_id", _digest(F.col("text")).alias("body"), F.filter(hashed, lambda x: x["n"] > 0).alias("lines"))
    once = arrays.groupBy(*ONE).agg(F.first("lines").alias("lines"))
    total = F.aggregate("lines", F.lit(0), lambda s, x: s + x["n"])
    return once.select(*ONE, total.alias("total"), F.inline("lines"))


def fingerprints(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, body, at (word where the selected line starts), h (its hash), windows (from, to; words) that select it,
    and the lines within reach, by their start and by their stop: every selected position once."""
    document = Window.partitionBy(*ONE)
    ahead = document.orderBy("start").rangeBetween(0, min_words - 1)
    back = document.orderBy("stop").rangeBetween(1 - min_words, 0)
    by_start = document.orderBy("start").rangeBetween(1 - min_words, min_words - 1)
    by_stop = document.orderBy("stop").rangeBetween(1 - min_words, min_words - 1)
    least, line = F.min(F.struct("h", "start")), F.collect_list(F.struct("start", "stop", "h", "g"))
    seen = rows.select(
        *ONE, "start", "stop", "h",
        F.max("stop").over(ahead).alias("to"), least.over(ahead).alias("first"),
        F.min("start").over(back).alias("from"), least.over(back).alias("last"),
        line.over(by_start).alias("starts"), line.over(by_stop).alias("stops"),
    )
    # Every line tells what is around it, and the lines that its two windows select that they do.
    nothing = F.lit(None)
    told = F.array(
        F.struct(F.col("start").alias("at"), "h", "starts", "stops", nothing.cast("struct<`from`: bigint, `to`: bigint>").alias("window")),
        F.struct(F.col("first.start").alias("at"), F.col("first.h").alias("h"), nothing.alias("starts"), nothing.alias("stops"),
                 F.struct(F.col("start").alias("from"), "to").alias("window")),
        F.struct(F.col("last.start").alias("at"), F.col("last.h").alias("h"), nothing.alias("starts"), nothing.alias("stops"),
                 F.struct("from", F.col("stop").alias("to")).alias("window")),
    )
    full = F.filter(told, lambda x: x["window"].isNull() | (x["window"]["to"] - x["window"]["from"] >= min_words))
    positions = seen.select(*ONE, F.inline(full)).groupBy(*ONE, "at").agg(
        F.first("h").alias("h"), F.collect_set("window").alias("windows"),
        F.first("starts", ignorenulls=True).alias("starts"), F.first("stops", ignorenulls=True).alias("stops"),
    )
    return positions.where(F.size("windows") > 0)


def _meet(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``found``, one row per key and ``times`` it stands in ``rows``, has for their key. Both are written tables."""
    most = rows.count() / HOT
    hot = F.broadcast(found.where(F.col("times") > most))  # at most HOT rows
    cold = found.where(F.col("times") <= most).hint("merge")  # grows with the documents: one plan for every size
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return rows.join(hot, keys).unionByName(rest)


def extended(positions: DataFrame) -> DataFrame:
    """doc_id, body, from, to, h, sides and check: matches to both sides of positions, from the fingerprint outwards."""
    def sides(window: Column, lines: Column) -> Column:
        inside = F.filter(lines, lambda x: (x["start"] >= window["from"]) & (x["stop"] <= window["to"]))
        left = F.transform(F.reverse(F.filter(inside, lambda x: x["start"] < F.col("at"))), lambda x: x["h"])
        right = F.transform(F.filter(inside, lambda x: x["start"] > F.col("at")), lambda x: x["h"])
        return F.struct(
            window["from"].alias("from"), window["to"].alias("to"), "h",
            F.xxhash64(F.size(left), left, right).alias("sides"),
            F.xxhash64(F.transform(inside, lambda x: x["g"])).alias("check"),
        )

    near = F.array_sort(F.array_union("starts", "stops"))
    return positions.select(*ONE, F.inline(bound(near, lambda lines: F.transform("windows", lambda w: sides(w, lines)))))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, body, lines (deleted line numbers, ascending), words (deleted), total (words of the text);
    documents that lose a line."""
    along = Window.partitionBy(*ONE).orderBy("line")
    rows = settle(line_rows(docs).withColumn("stop", F.sum("n").over(along)).withColumn("start", F.col("stop") - F.col("n")))

    positions = settle(fingerprints(rows, min_words))
    times = F.count(F.lit(1)).alias("times")
    several = settle(positions.groupBy("h").agg(times).where("times > 1"))
    matches = settle(extended(_meet(positions, several, ["h"])))

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body", "from", "to")
    key = ["h", "sides", "check"]
    first = settle(matches.groupBy(*key).agg(F.min(place).alias("first"), times).where("times > 1"))
    later = _meet(matches, first, key).where(
        ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.body") == F.col("body")))
        | (F.col("from") >= F.col("first.to"))
    )
    runs = later.groupBy(*ONE, F.col("from").alias("start")).agg(F.max("to").alias("until"))

    # A line goes if a repeated run that starts no later reaches it.
    line = rows.select(*ONE, "total", "line", "n", "start")
    same = [line["doc_id"].eqNullSafe(runs["doc_id"]), line["body"] == runs["body"], line["start"] == runs["start"]]
    met = line.join(runs, same, "left").select(line["*"], "until")
    reach = F.max("until").over(Window.partitionBy(*ONE).orderBy("start"))
    gone = met.withColumn("reach", reach).where(F.col("reach") > F.col("start"))
    return gone.groupBy(*ONE).agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.sum("n").alias("words"), F.first("total").alias("total")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated runs, and without documents that lose all words. An n_chars column
    is recounted."""
    gone = settle(removed_lines(docs, min_words)).hint("merge")  # grows with the documents: one plan for every size
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), _digest(F.col("text")).alias("_body"))
    both = marked.join(gone, marked["_id"].eqNullSafe(gone["doc_id"]) & (marked["_body"] == gone["body"]), "left")
    kept = both.where(F.col("lines").isNull() | (F.col("words") < F.col("total")))
    text = _without(F.col("row.text"), F.col("lines"))
    kept = kept.withColumn("new", F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(text))
    columns = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.col("new")
        elif name == "n_chars":
            old = F.when(F.col("lines").isNull(), old).otherwise(F.length("new").cast(docs.schema[name].dataType))
        columns.append(old.alias(name))
    return kept.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: its lines with words, the deleted ones as a list of numbers, the deleted words, and
    the digest of the remaining text's lines with words."""
    gone = settle(removed_lines(docs)).hint("merge")
    base = docs.select("doc_id", _digest(F.col("text")).alias("body"), _raw(F.col("text")).alias("text"))
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["doc_id"]) & (base["body"] == gone["body"]), "left")
    nothing = F.array().cast("array<int>")
    both = both.select(
        base["doc_id"],
        "text",
        F.coalesce("lines", nothing).alias("lines"),
        F.coalesce("words", F.lit(0)).cast("long").alias("n_removed_words"),
    )
    text = F.when(F.size("lines") == 0, F.col("text")).otherwise(_without(F.col("text"), F.col("lines")))
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_removed"),
        "n_removed_words",
        F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("removed_lines"),
        F.sha2(text, 256).alias("text_sha256"),
    )


#: The same by definition: every window against all others, without fingerprints.
REPORT_SQL = r"""
with d as (
  select distinct doc_id, coalesce(text, '') as text from documents
), l as (
  select doc_id, text, i - 1 as line, trim(regexp_replace(string_split(text, chr(10))[i], '[ \t\x0b\f\r]+', ' ', 'g'), ' ') as body
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d)
), n as (
  select doc_id, text, line, body, len(body) - len(replace(body, ' ', '')) + 1 as n from l where body <> ''
), p as (
  select *, sum(n) over (partition by doc_id, text order by line) as stop,
    sum(n) over (partition by doc_id, text order by line) - n as start from n
), w as (
  select a.doc_id, a.text, a.start, max(b.stop) as stop, string_agg(b.body, chr(10) order by b.line) as content
  from p a join p b on a.doc_id is not distinct from b.doc_id and a.text = b.text and b.start >= a.start and b.start < a.start + 50
  group by 1, 2, 3
  union
  select a.doc_id, a.text, min(b.start), a.stop, string_agg(b.body, chr(10) order by b.line)
  from p a join p b on a.doc_id is not distinct from b.doc_id and a.text = b.text and b.stop <= a.stop and b.stop > a.stop - 50
  group by 1, 2, 4
), v as (
  select *, first_value(doc_id) over o as f_doc, first_value(text) over o as f_text, first_value(stop) over o as f_stop
  from w where stop - start >= 50
  window o as (partition by content order by doc_id nulls last, md5(text), start, stop)
), r as (
  select doc_id, text, start, stop from v
  where not (f_doc is not distinct from doc_id and f_text = text) or start >= f_stop
), g as (
  select distinct p.doc_id, p.text, p.line, p.n from p join r
  on p.doc_id is not distinct from r.doc_id and p.text = r.text and p.start >= r.start and p.start < r.stop
), x as (
  select doc_id, text, count(*) as n_removed, sum(n) as words, string_agg(line::varchar, ',' order by line) as removed,
    list(line) as gone from g group by 1, 2
)
select t.doc_id, coalesce(x.n_removed, 0)::bigint as n_removed, coalesce(x.words, 0)::bigint as n_removed_words,
  coalesce(x.removed, '') as removed_lines,
  sha256(array_to_string(list_transform(list_filter(range(0, len(string_split(coalesce(t.text, ''), chr(10)))),
    lambda i: x.gone is null or not list_contains(x.gone, i)), lambda i: string_split(coalesce(t.text, ''), chr(10))[i + 1]), chr(10))) as text_sha256
from documents t left join x on t.doc_id is not distinct from x.doc_id and coalesce(t.text, '') = x.text
"""
