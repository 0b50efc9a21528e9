"""Quality rules as a short-circuit cascade.

Every rule is a condition on a text that rejects it. What a rule costs and how many texts it rejects is
estimated on a sample; the rules then stand in the order of rejections per cost, and each text is tested
only until the first rule rejects it. The order changes the work, never the verdict.

Words are runs of other characters than blank, tab, newline, vertical tab, form feed and carriage return;
lengths are in code points. Default rules, rejecting a text

* ``few_words`` with under 10 words,
* ``repetition`` with over 20 % of its words in five-word windows that occur twice or more in it,
* ``symbols`` with over one of the characters ``#*$%&|<>`` per ten words,
* ``capitals`` with 25 capitals or more that are over half of the characters of its words,
* ``letters`` with over 60 % of the characters of its words neither letters nor marks,
* ``lines`` with over half of its lines equal to earlier ones, if four or more lines hold words,
* ``word_length`` with a mean word length over 40.

Edge cases: a null or empty text has no words and is rejected as ``few_words``. Equal rows get equal
verdicts. An empty table gives an empty result (the rules then stand as listed). Other columns are kept, and columns whose
names clash with those used here do no harm.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import bound, words_of

MIN_WORDS = 10
#: Rows of the sample that orders the rules; it decides nothing else.
SAMPLE_ROWS = 1000
#: Longest text of the sample, in bytes, so it takes at most 64 MB.
SAMPLE_BYTES = 65_536
#: How often a row of the sample is tested, so that the rule outweighs the job around it.
REPEATS = 4

#: Characters of words that are neither letters nor marks.
OTHER = "[^\\p{L}\\p{M} \\t-\\r]+"

Rules = dict[str, "Rule"]


@dataclass(frozen=True)
class Rule:
    """``reject`` of (text, words) is true for a text to reject."""

    reject: object

    def __call__(self, text: Column, words: Column) -> Column:
        return self.reject(text, words)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def _with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\f\r"))) > 0)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bound(_with_word(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words in windows of ``n`` words that occur twice or more in the text."""
    def windows(w: Column) -> Column:
        last = F.size(w) - n + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k - 1) for k in range(n)]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

        covered = F.aggregate(
            F.sort_array(bound(pairs, twice)),
            F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(n), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )
        # Most texts repeat no window; only the others are sorted.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)

    return bound(bound(words, windows), count)


def _found(text: Column, pattern: str) -> Column:
    """Characters in all matches of a pattern."""
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), ""))


def _capitals(text: Column, words: Column) -> Column:
    capitals = _found(text, "\\p{Lu}+")
    return bound(capitals, lambda n: (n >= 25) & (2 * n > word_chars(words)))


def _lines(text: Column, words: Column) -> Column:
    return bound(_with_word(text), lambda x: (F.size(x) >= 4) & (2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x)))


DEFAULT_RULES: Rules = {
    "few_words": Rule(lambda text, words: F.size(words) < MIN_WORDS),
    "repetition": Rule(lambda text, words: 100 * repeat_words(words) > 20 * F.size(words)),
    "symbols": Rule(lambda text, words: 10 * symbols(text) > F.size(words)),
    "capitals": Rule(_capitals),
    "letters": Rule(lambda text, words: 10 * _found(text, OTHER) > 6 * word_chars(words)),
    "lines": Rule(_lines),
    "word_length": Rule(lambda text, words: word_chars(words) > 40 * F.size(words)),
}
#: Rules whose rejection is fixed from outside; the method's own are the others.
BASE_RULES = ("few_words", "repetition")


def _texts(docs: DataFrame) -> DataFrame:
    """row (all columns), text (null as empty) and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text"), words_of(text).alias("words"))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """text and words of some rows, ``REPEATS`` times each, as a written table. Rows are taken as a limit on the driver takes
    them: from as few partitions as hold enough, without a shuffle; longer texts than ``SAMPLE_BYTES`` only decide no order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = docs.select(text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(rows).collect()
    some = docs.sparkSession.createDataFrame([(r["text"],) for r in taken], "text string")
    each = F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))
    return settle(some.select("text", words_of(F.col("text")).alias("words"), each.alias("k")).drop("k"))


def ordered(docs: DataFrame, rules: Rules = DEFAULT_RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The names of ``rules`` by falling rejections per second, measured on some rows. A cost is the shorter of two timings,
    less that of a job over the same rows that tests nothing; the first round, which compiles the plans, does not count."""
    sample = _sample(docs, sample_rows)
    rejected = {name: F.count_if(rule(F.col("text"), F.col("words"))) for name, rule in rules.items()}
    timed = {"": F.count(F.when(F.size("words") + F.length("text") < 0, 1)), **rejected}
    shares, cost = {}, dict.fromkeys(timed, math.inf)
    for again in range(3):
        for name, what in timed.items():
            start = time.perf_counter()
            shares[name] = sample.agg(what).first()[0]
            if again:
                cost[name] = min(cost[name], time.perf_counter() - start)
    return sorted(rules, key=lambda name: -shares[name] / max(cost[name] - cost[""], 1e-3))


def cascade(text: Column, words: Column, rules: Rules, order: list[str]) -> Column:
    """The first rule, in the given order, that rejects a text; null if none does."""
    first, *rest = order
    chain = F.when(rules[first](text, words), F.lit(first))
    for name in rest:
        chain = chain.when(rules[name](text, words), F.lit(name))
    return chain


def judged(docs: DataFrame, rules: Rules = DEFAULT_RULES, order: list[str] | None = None) -> DataFrame:
    """row (all columns of ``docs``) and rejected_by: the rule that rejected it, or null."""
    order = order or ordered(docs, rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rejected = bound(words_of(text), lambda words: cascade(text, words, rules, order))
    return docs.select(F.struct("*").alias("row"), rejected.alias("rejected_by"))


def kept(docs: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """``docs`` without the rejected texts."""
    return judged(docs, rules).where("rejected_by is null").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document the base statistics, whether they reject it, and the verdict of all rules. The base rules use
    the statistics as they stand here; the others follow as a cascade."""
    own = {name: rule for name, rule in DEFAULT_RULES.items() if name not in BASE_RULES}
    order = ordered(docs, own)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def stats(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_chars(words).cast("long").alias("word_chars"),
            symbols(text).cast("long").alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def verdict(s: Column, words: Column) -> Column:
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        rejected = F.when(failed, F.lit("base")).otherwise(cascade(text, words, own, order))
        return F.struct(s.alias("s"), failed.alias("base_failed"), rejected.isNull().alias("kept"))

    found = bound(words_of(text), lambda words: bound(stats(words), lambda s: verdict(s, words)))
    return docs.select("doc_id", found.alias("x")).select("doc_id", "x.s.*", "x.base_failed", "x.kept")


REPORT_SQL = r"""
with d as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select k, i, array_to_string(list_slice(w, i, i + 4), ' ') as g
  from (select k, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
), r as (
  select k, count(distinct p) as n from (
    select k, unnest(range(i, i + 5)) as p from (select k, i, count(*) over (partition by k, g) as c from g) where c > 1) group by 1
), l as (
  select k, count(*) as n_lines, count(*) - count(distinct line) as dup
  from (select k, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1
), s as (
  select doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    len(regexp_extract_all(text, '\p{Lu}')) as capitals,
    len(array_to_string(regexp_extract_all(text, '[^\p{L}\p{M} \x09-\x0D]+'), '')) as other
  from d left join l using (k) left join r using (k)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or (capitals >= 25 and 2 * capitals > word_chars)
    or 10 * other > 6 * word_chars or (n_lines >= 4 and 2 * n_dup_lines > n_lines) or word_chars > 40 * n_words) as kept
from s
"""
