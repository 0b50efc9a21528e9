"""Token store, filter audit and manifest on small made tables with edge rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from cartwright.llm import filter_audit, manifest, packing, token_store
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = [" ".join(rng.choice(vocabulary, 260)) for _ in range(4)]
    return [
        (0, None, "en", "s", None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, prose[0], "en", "t", 3), (3, prose[0], "de", "t", 3),
        (3, prose[0], "de", "t", 3), (4, prose[0] + "x", None, "t", 3), (5, prose[0][:-1], "zz", None, 3), (None, prose[0], "en", "t", 3),
        (6, "A B C $ d", "en", "s", 9), (7, "é\x1cà " * 300, "fr", "s", 9), (7, prose[1], "fr", "s", 9), (8, prose[2] * 30, "fr", "s", 9),
        (9, "x <|endoftext|> y <|startoftext|>", "en", "s", 9), (10, prose[3], "en", "s", 9), (11, prose[3] + " #", "en", "s", 9),
        (12, prose[3], "en", "s", 9), (13, prose[3], "de", "s", 9), (14, "ab" * 3000, "en", "s", 9), (15, "\n \t", "en", "s", 9),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(rows(), DOC).repartition(5)
    # Names that the operators use inside.
    return made.withColumns({c: F.lit(c) for c in ("part", "mask", "target", "rank", "block", "node", "leaves", "_row", "_tie", "start", "ids", "candidate")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# ---------------------------------------------------------------- token store


@pytest.mark.parametrize("base", [64, 1 << 16])
def test_grammar_gives_back_any_stretch(base):
    rng = np.random.default_rng(3)
    cases = [[], [5], [7] * 1000, [1, 2] * 500 + [3] * 17, [9, 9, 8] * 100, list(rng.integers(0, 3, 5000)), list(rng.zipf(1.5, 4000) % 60)]
    for case in cases:
        ids = np.array(case, np.uint32)
        grammar = token_store.from_bytes(token_store.to_bytes(ids, base))
        assert (grammar.ids() == ids).all()
        assert sum(int(grammar.lengths[s - base]) if s >= base else 1 for s in grammar.symbols.tolist()) == len(ids)
        for start in range(0, len(ids), 11):
            for stop in (start + 1, start + 23, start + 600):
                assert grammar.ids(start, stop).tolist() == ids[start:stop].tolist()
    assert len(token_store.from_bytes(token_store.to_bytes(np.full(4096, 7, np.uint32), base)).symbols) < 40


def test_damaged_shard_is_refused():
    data = bytearray(token_store.to_bytes(np.arange(50, dtype=np.uint32), 64))
    data[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_store.from_bytes(bytes(data))


def stored(made):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    at, found = 0, []
    for doc_id, text in made:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, token_store.END_ID], "<u4")
        found.append((doc_id, at, len(ids), ids.tobytes()))
        at += len(ids)
    return found


@pytest.mark.parametrize("size", [64, token_store.SHARD])
def test_store_reads_back_every_document(spark, docs, tmp_path, size):
    path = f"{tmp_path}/store"
    token_store.write(docs, path, size=size)
    store = spark.read.parquet(path)
    assert store.agg(F.max("n_ids")).first()[0] <= size
    got = sorted(token_store.digests(store).collect(), key=lambda r: r.start)
    # Rows that share a doc_id may stand in either order.
    places = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    want = stored(sorted(((i, t) for i, t, *_ in rows()), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert places == {(i, n, zlib.crc32(ids)) for i, _, n, ids in want} and len(got) == len(want)
    assert [r.doc_id for r in got] == [i for i, *_ in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    few = {(r.doc_id, bytes(r.ids)) for r in token_store.fetch(store, [8, 9, 14, 99]).collect()}
    assert few == {(i, ids) for i, _, _, ids in want if i in (8, 9, 14)}


def test_store_of_nothing(empty):
    assert token_store.stored_digests(empty).collect() == []


# ---------------------------------------------------------------- filter audit


def test_trie_walks_texts_in_order():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice([97, 98, 255], rng.integers(0, 9)).astype(np.uint8)) for _ in range(300)]
    trie = filter_audit.Trie()
    for number, text in enumerate(texts):
        node = trie.insert(text, 1000 - number)
        node.held = text
    walked = [(node.held, node.least, node.rows, shared, depth) for node, depth, shared in trie.walk()]
    ordered = sorted(set(texts))
    assert [w[0] for w in walked] == ordered and all(w[4] == len(w[0]) for w in walked)
    assert all(w[1] == 1000 - max(i for i, t in enumerate(texts) if t == w[0]) and w[2] == texts.count(w[0]) for w in walked)
    for a, b in zip(walked, walked[1:]):
        assert b[3] == next((i for i, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))


def audited(made, labels):
    def mask(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in made)
        failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                  bool(re.search(r"[#$%&*|]", text)), smaller)
        return {f for f, bad in zip("ABCDE", failed) if bad}

    facts = [(lang or "", mask(i, t or ""), labels.get(i, (0, 0))) for i, t, lang, *_ in made]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in facts}:
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                here = [(m, good, toxic) for p, m, (good, toxic) in facts if p == part]
                reached = [x for x in here if not x[0] & set(order[: step - 1])]
                gone = [x for x in reached if name in x[0]]
                shapley[part, name] += len(gone)
                out[part, order, step] = [
                    len(reached) - len(gone), len(gone), sum(name in x[0] for x in here) - len(gone), sum(x[0] == {name} for x in here),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_audit_by_definition(spark, docs, monkeypatch, small):
    made = rows()
    if small:  # many tries, cuts within the texts, and texts that are dealt over salts
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3000)
        monkeypatch.setattr(filter_audit, "CUT_BYTES", 500)
        made = made + [(100 + k, made[14][1], "en", "s", 1) for k in range(120)] + [(300 + k, made[3][1] + str(k % 40), "de", "s", 1) for k in range(80)]
        docs = spark.createDataFrame(made, DOC).repartition(12)
        n, bounds, hot = filter_audit.ranges(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")), 9)
        assert n > 9 and len(bounds) > 4 and hot and max(map(len, bounds)) > 20
    labels = [(2, 1, 0), (3, 1, 1), (3, 0, 0), (8, 0, 1), (13, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]
    known = {2: (1, 0), 3: (1, 1), 8: (0, 1), 13: (1, 1)}
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(made, known) and len(got) % 600 == 0


def test_audit_of_nothing(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).collect() == []


# ---------------------------------------------------------------- manifest


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 77])
def test_positions_in_the_log(n):
    levels = levels_of([joined(str(k)) for k in range(n)])
    log = manifest.log_of([x.encode() for x in levels[0]], manifest.height(n))
    assert len(log) == sum(map(len, levels)) and log[-1].decode() == levels[-1][0]
    for level, nodes in enumerate(levels):
        for index, node in enumerate(nodes):
            assert log[manifest.position(level, index, n)].decode() == node
    for index in range(n):
        path = manifest.siblings(log, n, index, manifest.height(n))
        assert manifest.fold(levels[0][index].encode(), index, path) == log[-1]


def manifested(made):
    def leaf(row, more=0):
        doc_id, text, lang, source, n_chars = row
        fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
        return joined(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def path(levels, index):
        return [(level[index >> k ^ 1] if (index >> k ^ 1) < len(level) else "", index >> k & 1) for k, level in enumerate(levels[:-1])]

    langs = sorted({r[2] for r in made}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in made if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels_of([leaf(r) for r in groups[x]]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for index, row in enumerate(groups[lang]):
            steps = path(trees[lang], index) + path(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(bad))
            for other, right in steps:
                node = joined(other, node) if right else joined(node, other)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, joined(*(s for s, _ in steps)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_by_definition(spark, docs, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 1 << levels)
    got = sorted((tuple(r) for r in manifest.audit(docs).collect()), key=str)
    assert got == manifested(rows())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, empty):
    one = [(1, "a", None, "s", 1)]
    assert [tuple(r) for r in manifest.audit(spark.createDataFrame(one, DOC)).collect()] == manifested(one)
    assert manifest.audit(empty).collect() == []
