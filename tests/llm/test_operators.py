"""The text operators against plain loops and the libraries, on odd documents."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from tidewatch.llm import (  # noqa: E402
    components, decontaminate, jaccard, language, licenses, lines, pieces, quality, suffixes, token_store, urls,
)
from tidewatch.llm.catalog import PIECES, WORDS, tokenizer  # noqa: E402


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


# --- 1: pieces ---


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer(PIECES))


def test_pieces_equal_library(odd, plain_rows, library):
    got = pieces.encode(odd, tokenizer(PIECES), keep=["doc_id", "text", "key", "ids"]).drop("key")
    expected = []
    for i, t, _ in plain_rows:
        ids = library.encode(t or "")
        expected.append((i, t, ids, True, library.decode(ids) if ids else ""))
    same(got.collect(), expected)


def test_agenda_equals_library_on_random_texts(library):
    merger, rng = pieces.Merger(library), random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab ▁ \né中😀\x00\tZ<s>.the") for _ in range(rng.randrange(1, 60)))
        ids = library.encode(t)
        assert [i for w in merger.words(t) for i in merger.encode("▁" + w)] == ids
        # the heap and the list give the same pieces
        whole = "▁" + t.replace(" ", "▁")
        assert merger._short(whole) == merger.pieces(whole + "▁" * 0) or len(whole) > pieces.SHORT
        assert merger.encode(whole) == ids


def test_pieces_of_nothing(empty):
    assert pieces.encode(empty, tokenizer(PIECES)).collect() == []


# --- 2: language ---


def _model(texts):
    names = sorted(texts)
    counts, scripts = np.zeros((len(names), language.BUCKETS)), np.zeros((len(names), len(language.NAMES)))
    for i, n in enumerate(names):
        own = Counter(language.WORD.findall(texts[n].lower()))
        owner, bucket, script = language.features(list(own))
        weight = np.array(list(own.values()), float)
        counts[i] = np.bincount(bucket, weight[owner], language.BUCKETS)
        scripts[i] = np.bincount(script, weight, len(language.NAMES))
    return language.Model.of_counts(names, counts, scripts)


ENGLISH = "the house of the river and the hill that we saw with them when it was there for the evening "
GERMAN = "das haus und der fluss mit dem berg den wir sahen als es dort am abend und nicht zu spät war "
RUSSIAN = "дом и река на холме где мы были вечером и это было хорошо "


def test_words_held_are_bounded_over_all_languages():
    from collections import Counter

    some = Counter(map(str, range(language.HELD // 2)))
    assert not language.too_many({"a": some, "b": some})
    assert language.too_many({"a": some, "b": some, "c": Counter("x")})


def test_learned_counts_are_of_all_texts(spark):
    rows = [("en", ENGLISH)] * 3 + [("de", GERMAN), ("ru", RUSSIAN), (None, "zzz"), ("en", None)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    expected = _model({"en": ENGLISH * 3, "de": GERMAN, "ru": RUSSIAN})
    assert model.languages == expected.languages
    assert np.allclose(model.scores, expected.scores) and (model.scripts == expected.scripts).all()


def test_mixed_texts_have_spans(spark):
    model = _model({"en": ENGLISH, "de": GERMAN, "ru": RUSSIAN})
    rows = [(1, ENGLISH + GERMAN + RUSSIAN), (2, GERMAN), (3, None), (4, "12 !"), (5, ""), (6, "дом")]
    got = {r.i: r for r in language.label(spark.createDataFrame(rows, "i int, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"]
    assert abs(got[1].spans[0].words - len(ENGLISH.split())) <= 2
    assert (got[2].lang_pred, got[2].score) == ("de", 1.0)
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (3, 4, 5)] == [("und", 0.0, [])] * 3
    assert got[6].lang_pred == "ru"


def test_best_path_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    texts = [rng.integers(-3, 4, (n, 3)).astype(float) for n in (1, 2, 5, 7, 6)]
    for t, path in zip(texts, language.viterbi(texts, 2.0)):
        def worth(p, t=t):
            return sum(t[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))

        best = max(worth(p) for p in product(range(3), repeat=len(t)))
        assert worth(path) == best
        one = language.constant_path(t, 2.0)
        assert one is None or worth([one] * len(t)) == best


def test_language_of_odd_documents(odd, empty):
    model = language.learn(odd)
    got = language.label(odd, model, keep=["doc_id", "text", "spans"])
    assert got.count() == odd.count()
    assert got.where("text is null and lang_pred <> 'und'").isEmpty()
    assert language.learn(empty).languages == []
    assert set(r[0] for r in language.label(odd, language.learn(empty)).select("lang_pred").collect()) == {"und"}


# --- 3: suffixes ---


def test_removed_bytes_equal_loops(odd, plain_rows):
    small = odd.where("doc_id is null or doc_id <> 19")
    rows = [(i, t) for i, t, _ in plain_rows if i != 19]
    for batch in (500, 4_000_000):
        got = suffixes.removed(small, batch_bytes=batch)
        same([(r.id, r.text, bytes(r.kept), len(r.spans)) for r in got.collect()], brute.removed_bytes(rows))


def test_removed_bytes_of_random_copies(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abc \n") for _ in range(400)) for _ in range(4)] + ["ab" * 150, "a" * 300]
    rows = []
    for i in rng.sample(range(1000), 60):
        x, a = rng.choice(base), rng.randrange(200)
        t = x[a : a + rng.randrange(10, 200)] + rng.choice(base)[: rng.randrange(150)]
        rows.append((i, t[:30] + "é" + t[31:] if rng.random() < 0.3 else t))
    got = suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=2_000)
    same([(r.id, r.text, bytes(r.kept), len(r.spans)) for r in got.collect()], brute.removed_bytes(rows))


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for w in (3, 9, 20):
        for letters in ("ab", "a", "abcdefgh"):
            raw = "".join(rng.choice(letters) for _ in range(300)).encode()
            text = np.frombuffer(raw + bytes(w + 8), np.uint8)
            places = np.arange(len(raw) - w + 1)
            array = suffixes.suffix_array(text, np.array([len(raw) - 1]), places, w)
            assert sorted(array.tolist()) == places.tolist()
            assert [raw[i : i + w] for i in array] == sorted(raw[i : i + w] for i in places)
            lcp = suffixes.common_prefixes(text, array, w)
            for k in range(1, len(array)):
                a, b = raw[array[k - 1] :][:w], raw[array[k] :][:w]
                assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), w)


def test_removed_of_nothing(empty):
    assert suffixes.removed(empty).collect() == []


# --- 4: addresses ---


def test_rules_by_rarest_token():
    rules = [urls.host_rule("com", "/", "allow"), urls.host_rule("shop.com", "/x", "block"), urls.Rule("*ads^", "block", "ads")]
    index = urls.RuleIndex(rules)
    assert {k: [r.name for r, _ in v] for k, v in index.filed.items()} == {"com": ["com/"], "shop": ["shop.com/x"], "": ["ads"]}
    assert [r.name for r, _ in index.candidates("other.org/p")] == ["ads"]


def test_verdicts(spark):
    rules = [urls.host_rule("com", "/", "allow"), urls.host_rule("a.com", "/en/", "block")]
    rows = [
        ("http://A.com/en/x", "a.com/en/", "block"), ("https://b.a.com/en/", "a.com/en/", "block"), ("ftp://ba.com/en/", "com/", "allow"),
        ("http://x.com", None, "allow"), ("http://x.com/?q", "com/", "allow"), ("no address", None, "allow"), (None, None, "allow"),
        ("", None, "allow"), ("http://x.org/casino/1", None, "block"), ("http://x.org/casinos", None, "allow"), ("a://x.com:80/", None, "allow"),
        ("http://X.org/" + "y" * 100_000, None, "allow"),
    ]
    df = spark.createDataFrame([(u, u) for u, _, _ in rows], "url string, host string")
    got = urls.judge(df, rules, [urls.Rule("^casino^", "block", "casino")]).select("url", "rule", "verdict")
    same(got.collect(), rows)


def test_candidates_lose_no_rule():
    rng = random.Random(4)
    rules = [
        urls.Rule("".join(rng.choice(["a", "bc", "/", ".", "*", "^", "d"]) for _ in range(rng.randrange(1, 7))), "block", str(i))
        for i in range(200)
    ] + [urls.Rule("||a.bc^d|", "block", "x"), urls.Rule("|bc/a", "block", "y")]
    index = urls.RuleIndex(rules)
    for _ in range(500):
        address = "".join(rng.choice(["a", "bc", "/", ".", "d", "-"]) for _ in range(rng.randrange(1, 12)))
        found = {r.name for r, e in index.candidates(address) if e.search(address)}
        assert found == {r.name for r in rules if urls.expression(r.pattern).search(address)}


# --- 5: benchmark ---

ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Kurz und gut"), (3, None), (4, "!!"), (5, "kurz UND gut"), (None, "allein")]
TEXTS = [
    (1, "vor " + ITEMS[0][1] + " nach"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w12"), (3, "so kurz, und gut. kurz und gut"), (4, None), (5, ""),
    (6, "Allein!"), (7, "W3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (7, "kurz und gut"), (None, "kurz und gut und gut"),
]


@pytest.mark.parametrize("block", [1, 1000])
def test_hits_equal_loops(spark, block):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, items string, n_words_1 string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, benchmark, block_words=block)
    expected = []
    for i, t in TEXTS:
        n, hit, items = brute.windows_hit(t, ITEMS)
        expected.append((i, t, "y", n, hit, sorted("null" if x is None else str(x) for x in items)))
    same([(r.doc_id, r.text, r.n_words_1, r.n_words, len(r.hit_words), r["items"]) for r in got.collect()], expected)


def test_clean_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b kurz, und gut! c d"), (2, "nur das hier"), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r[0] for r in decontaminate.without_hits(docs, benchmark).collect()} == {2, 3}
    got = dict(map(tuple, decontaminate.without_hits(docs, benchmark, spans=True).collect()))
    assert got[2] == "nur das hier" and got[3] is None and got[1].split() == ["a", "b", "c", "d"]


def test_one_benchmark_block_at_a_time(spark, monkeypatch):
    made, real = [], decontaminate.with_columns

    def counted(*args):
        made.append(args)
        return real(*args)

    def blocks(*_):
        for i in range(3):
            assert len(made) == i
            yield [(str(i), "one two three four")]

    monkeypatch.setattr(decontaminate, "with_columns", counted)
    monkeypatch.setattr(decontaminate, "blocks", blocks)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    decontaminate.scan(docs, docs)
    assert len(made) == 3


def test_empty_benchmark_and_documents(odd, empty, spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.scan(odd, benchmark)
    assert got.count() == odd.count() and got.where("size(hit_words) > 0").isEmpty()
    assert decontaminate.scan(empty, benchmark).collect() == []


# --- 6: licenses ---


def test_base_phrases_equal_loops(spark, odd):
    texts = [
        "the MIT License, mit-license; Mit\nlicense", "mit licenses apache license general public  license", None, "", "license mit",
        "apache license " * 300,
    ]
    got = licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string"))
    same(
        [(r.text, r.n_words, [(p.first, p.label) for p in r.base_places]) for r in got.collect()],
        [(t, len(brute.words(t)), brute.phrase_places(t, licenses.BASE)) for t in texts],
    )
    assert licenses.scan(odd).count() == odd.count()


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("This work is licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("under the GNU Lesser General Public License version 2.1 license", ["lgpl-2.1"]),
    ("released under the MIT license. All rights reserved", ["mit", "proprietary"]), ("we had a limited license to talk", []),
    ("https://www.gnu.org/licenses/gpl-3.0.html", ["gpl-3.0"]), ("licensed under the GNU General Public License, version 3", ["gpl-3.0"]),
])
def test_signatures(text, labels):
    assert sorted({d[2] for d in licenses.Scanner().scan(text)[2]}) == labels


def test_hundreds_of_rules_and_their_words():
    rules = licenses.signature_rules()
    assert len(rules) > 300
    for r in rules:  # the word to select by is in every text that the pattern fits
        assert r.word.encode() in r.pattern.pattern


def test_suppression_equals_all_pairs():
    rng = random.Random(6)
    rule = licenses.Rule("x", "x", None, 0, 1.0)
    for _ in range(300):
        found = []
        for i in range(rng.randrange(12)):
            a = rng.randrange(15)
            b = a + rng.randrange(1, 8)
            found.append((-rng.randrange(3), a - b, a, i, b, rule))
        kept = []
        for f in sorted(found, key=lambda x: x[:4]):
            if not any(k[0] <= f[2] and f[4] <= k[1] for k in kept):
                kept.append((f[2], f[4]))
        assert [(x[0], x[1]) for x in licenses.suppress(found)] == sorted(kept)


# --- 7: Jaccard ---


def _near_copies(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 30, 90]))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(10_000), n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_all_pairs(spark, seed):
    rows = _near_copies(seed)
    got = jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    same([(r.id, r.size, r.component) for r in got.collect()], brute.groups(rows))


def test_groups_of_odd_documents(odd, plain_rows, empty):
    got = jaccard.join_groups(odd)
    same([(r.id, r.size, r.component) for r in got.collect()], brute.groups([(i, t) for i, t, _ in plain_rows]))
    assert jaccard.join_groups(empty).collect() == []
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    expected = {i for i, _, c in brute.groups([(i, t) for i, t, _ in plain_rows]) if i is not None and i == c}
    assert {i for i in ids if i is not None} == expected and ids.count(None) == 2


def test_list_blocks_lose_no_pair():
    rng = np.random.default_rng(1)
    n = 700
    shingle, group = rng.integers(0, 3, n), rng.integers(0, 5, n)
    size = rng.integers(5, 40, n)
    at, node = rng.integers(0, 6, n) % size, np.arange(n)
    got = set()
    for a, b in jaccard.list_pairs(shingle, group, node, size, at, 80):
        got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    expected = {
        (i, j) for i in range(n) for j in range(i + 1, n)
        if shingle[i] == shingle[j] and group[i] != group[j] and 100 * size[i] >= 80 * size[j] and 100 * size[j] >= 80 * size[i]
        and min(size[i] - at[i], size[j] - at[j]) >= -(-80 * (size[i] + size[j]) // 180)
    }
    assert got == expected


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    union = components.Union()
    for a, b in links:
        if a is not None:
            union.join(a, b)
    expected = {(x, union.find(x)) for x in union.parent if union.find(x) != x}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {(r.node, r.root) for r in got.collect()} == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 8: token files ---


def test_files_give_back_all_ids(odd, plain_rows, shared, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(WORDS))
    entries = token_store.write(odd, shared, tokenizer(WORDS), end_id=1)
    got = token_store.lookup(spark, shared, entries).collect()
    expected, start = [], 0
    for i, t in sorted(((i, t) for i, t, _ in plain_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same([(r.id, r.start, r["count"], zlib.crc32(r["ids"])) for r in got], expected)
    unknown = spark.createDataFrame([(10**9, 0), (0, 7)], "id long, ordinal int")
    assert token_store.lookup(spark, shared, unknown).collect() == []


def test_words_equal_library():
    from tokenizers import Tokenizer

    path = tokenizer(WORDS)
    library, rng = Tokenizer.from_file(path), random.Random(9)
    words = token_store.WordIds(Path(path).read_text(), "<u2")
    assert words.plain
    letters = [*"abA É\nßſİıŉ.,!?'s0½́Σς中<|>|-\"()_~€ªµ", "<|endoftext|>", "don't", "'ll", "\x1c", "\x00"]
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        assert np.frombuffer(words.blob(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_perfect_hash():
    ids = np.arange(0, 50_000, 5)
    order = np.zeros(len(ids), np.int64)
    index = token_store.PerfectHash.build(ids, order)
    assert sorted(index.slots(ids, order).tolist()) == list(range(len(ids)))


def test_perfect_hash_of_keys_that_once_collided():
    # ids a power of two apart with repeats, and no id beside the least id
    ids = np.array([0, 1 << 40, 0, 1 << 40, 1 << 41, 0, token_store.NO_ID, token_store.NO_ID], np.int64)
    ordinals = np.array([0, 0, 1, 1, 0, 2, 0, -1], np.int64)
    index = token_store.PerfectHash.build(ids, ordinals)
    assert sorted(index.slots(ids, ordinals).tolist()) == list(range(8))
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([5, 5]), np.array([1, 1]))


def test_store_of_odd_ids_over_many_shards(spark, shared):
    # no id and one id fill several shards each
    rng = random.Random(7)
    rows = [(None, f"a{i} b") for i in range(150)] + [(7, f"c{i}") for i in range(150)] + [(token_store.NO_ID, "x"), (7 + (1 << 40), "y"), (8, "z")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        entries = token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shared, tokenizer(WORDS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert entries.select("shard").distinct().count() > 5
    keys = {(r.id, r.ordinal) for r in entries.collect()}
    assert keys == {(None, k) for k in range(150)} | {(7, k) for k in range(150)} | {(token_store.NO_ID, 0), (7 + (1 << 40), 0), (8, 0)}
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer(WORDS))
    got = {(r.id, r.ordinal): np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.lookup(spark, shared, entries).collect()}
    for want in (None, 7):
        texts = sorted(t for i, t in rows if i == want)
        for k, t in enumerate(texts):
            assert got[want, k] == [*encoder.encode(t, add_special_tokens=False).ids, 1]


def test_empty_store(empty, shared, spark):
    entries = token_store.write(empty, shared, tokenizer(WORDS))
    assert token_store.lookup(spark, shared, entries).collect() == []


# --- 9: lines ---


def test_similarity_equals_full_table():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = list(a) if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc"))
        b = "".join(b)
        for s in (0.8, 0.5):
            assert lines.within(a, b, s) == (brute.edits(a, b) <= int((1 - s) * max(len(a), len(b)) + 1e-9))


def _lines_loop(rows):
    """Removed lines by comparing all lines with all."""
    places = {}
    for i, t in rows:
        for n, raw in enumerate(t.split("\n") if t else []):
            line = lines.normalised_lines(raw)[0] if raw else b""
            if i is not None and len(line.split()) >= lines.MIN_WORDS:
                places.setdefault(line, set()).add((i, t, n))
    distinct = sorted(places)
    union = components.Union()
    for a in range(len(distinct)):
        for b in range(a):
            if lines.within(distinct[a].decode(), distinct[b].decode(), lines.SIMILARITY):
                union.join(a, b)
    grouped = {}
    for x, line in enumerate(distinct):
        grouped.setdefault(union.find(x), set()).update(places[line])
    gone = set()
    for found in grouped.values():
        keep = min(found, key=lambda p: (p[0], p[2]))
        gone |= {p for p in found if p != keep}
    return gone


def _line_rows():
    rng = random.Random(12)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 6, 40, 120]))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("xyz") + x[at + 1 :]
            own.append(x.upper() + "!" if rng.random() < 0.3 else x)
        rows.append((i, "\n".join(own)))
    return rows


def test_lines_equal_all_pairs(spark):
    rows = _line_rows()
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=True).collect()
    gone = _lines_loop(rows)
    assert gone
    expected = []
    for i, t in rows:
        kept = [x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone]
        expected.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    same(got, expected)


def test_lines_with_words_changed_go(spark):
    rng = random.Random(21)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))

    pairs = []
    while len(pairs) < 200:
        own = [word() for _ in range(rng.randrange(8, 61))]
        copy = list(own)
        for at in rng.sample(range(len(own)), rng.randrange(1, 3)):
            copy[at] = word()
        if lines.within(" ".join(own), " ".join(copy), lines.SIMILARITY):
            pairs.append((" ".join(own), " ".join(copy)))
    rows = [(i + 1000 * k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    assert not any(r.n_removed for r in got if r.doc_id < 1000)
    assert sum(r.n_removed for r in got) >= 0.98 * len(pairs)


def test_short_and_wordless_lines_repeat(spark):
    text = "Kurz\n今天天气很好我们去公园散步\n12 34 56\n---\n\n}"
    rows = [(1, text), (2, text), (3, "kurz!\n今天天气很好我们去公园散步吧\n\neigen"), (4, " \n\t\n ")]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert (got[1].text, got[2].text, got[3].text) == (text, "", "\neigen")
    assert (got[2].n_removed, got[3].n_removed, got[4].n_removed) == (5, 2, 0)


def test_lines_with_other_figures_stay(spark):
    own = ["04.03.2021 17:00 Gleis 5", "28.11.1998 09:35 Gleis 7", "Posten 4711: 12,50", "Posten 9832: 63,74", "1234567890", "9876054321"]
    rows = [(i, x) for i, x in enumerate([*own, own[0]])]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted([*own, ""])


def test_pairs_of_lines_that_agree(spark):
    rng = random.Random(3)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 6, 20, 40]))) for _ in range(40)]
    texts = set(pool)
    for x in pool * 4:
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(["xyz", "q", ""]) + x[at + rng.randrange(4) :]
        texts.add(x)
    texts = sorted(texts)
    chars, sketches = lines.Signer().sketches([x.encode() for x in texts], 0.8)
    rows = [(k, c, [(p["posts"], p["sim"]) for p in s], k % 3) for k, (c, s) in enumerate(zip(chars, sketches.to_pylist()))]
    distinct = spark.createDataFrame(rows, "key long, chars int, sketches array<struct<posts:array<int>,sim:long>>, n long").repartition(3)
    expected = set()
    for a, c, s, _ in rows:
        for b, d, t, _ in rows[a + 1 :]:
            shared = prints = 0
            for posts, sim in s:
                for posts_b, sim_b in t:
                    agree = sum(x == y for x, y in zip(np.int64(sim).tobytes(), np.int64(sim_b).tobytes()))
                    found = sum(x == y for x, y in zip(posts, posts_b)) if agree else 0
                    shared, prints = shared + found, max(prints, agree if found else 0)
            if min(c, d) >= 0.8 * max(c, d) - 1e-9 and shared and shared + prints >= lines.LEAST_AGREEING:
                expected.add((a, b))
    found = lines.first_pairs(distinct)
    assert found.where("a is null").isEmpty() and len(expected) > 100
    assert {tuple(r) for r in found.where("a is not null").select("a", "b").collect()} == expected
    # with pivots for all lists, hot or read by one task, the pivots' pairs and the others' hold the same
    alone = spark.createDataFrame([], "node long, root long")
    for share in (10**6, 1):
        found = lines.first_pairs(distinct, long_list=1, hot_share=share)
        first = {tuple(r) for r in found.where("a is not null").select("a", "b").collect()}
        later = {tuple(r) for r in lines.other_pairs(found.where("a is null"), alone).collect()}
        assert not found.where("a is null").isEmpty() and first | later == expected


@pytest.mark.parametrize(("batch", "long"), [(1, 2), (3, 2), (7, 4), (1000, 3), (1000, 1000)])
def test_lists_met_over_batches(batch, long):
    rng = np.random.default_rng(batch)
    post = np.sort(rng.integers(0, 12, 80))
    key, chars = np.arange(80, dtype=np.int64), rng.integers(10, 14, 80).astype(np.int32)
    sim = np.array([np.frombuffer(bytes(rng.integers(0, 3, 8).astype(np.uint8)), np.int64)[0] for _ in range(80)])
    entries = pa.RecordBatch.from_arrays([pa.array(x) for x in (post, key, sim, chars)], names=["post", "key", "sim", "chars"])
    met = list(lines._lists_met((entries.slice(i, batch) for i in range(0, 80, batch)), long, 0.8))
    rows = [r for b in met for r in b.to_pylist()]
    sizes = {int(p): int((post == p).sum()) for p in post}
    assert sorted((r["shared"], r["key"]) for r in rows if r["shared"] is not None) == [(int(p), int(k)) for p, k in zip(post, key) if sizes[int(p)] > long]
    expected = []
    for i in range(80):
        for j in range(i + 1, 80):
            first = int(np.searchsorted(post, post[i])) == i
            agree = sum(x == y for x, y in zip(sim[i].tobytes(), sim[j].tobytes()))
            if post[i] == post[j] and (sizes[int(post[i])] <= long or first) and agree and min(chars[i], chars[j]) >= 0.8 * max(chars[i], chars[j]) - 1e-9:
                expected.append((i, j, agree))
    assert sorted((r["a"], r["b"], r["prints"]) for r in rows if r["a"] is not None) == sorted(expected)


def test_edits_by_anchors_are_an_upper_bound():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 300)))
        b = a
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + rng.choice(["", "x", "yz ab", "c" * 90]) + b[at + rng.randrange(12) :]
        most = int(0.2 * max(len(a), len(b)))
        found = lines._edits_by_anchors(a, b, most)
        assert found > most or found >= brute.edits(a, b)


def test_pairs_far_apart_are_ruled_out():
    rng = random.Random(17)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh é日") for _ in range(rng.randrange(160)))
        b = list(a) if rng.random() < 0.6 else [rng.choice("abcdefgh é") for _ in a]
        for _ in range(rng.randrange(len(a) // 3 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "日本"])
        pairs.append((a, "".join(b)))
    for least in (0.8, 0.5):
        for too_few in (1, lines.TOO_FEW):
            apart = lines.apart([a for a, _ in pairs], [b for _, b in pairs], least, too_few)
            alike = np.array([brute.edits(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9) for a, b in pairs]) if too_few == 1 else alike
            assert not (apart & alike).any() and alike.sum() > 100
            # most of those not alike cost no table
            assert least < 0.8 or apart.sum() > 0.7 * (~alike).sum()
    assert lines.apart([], [], 0.8).tolist() == [] and lines.apart(["", "a", ""], ["", "", "ab"], 0.8, 1).tolist() == [False, True, True]


def test_tables_behind_line_groups_go(spark, tmp_path):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        gone = lines.repeated(spark.createDataFrame(_line_rows(), "doc_id long, text string"))
        assert gone.count()
    finally:
        if before:
            context.setCheckpointDir(before)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("*/*")}
    # what the result is read from, and nodes of groups
    assert left == {"line-places", "first-places", "links"}


def test_lines_of_odd_documents(odd, empty):
    got = lines.dedup(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {}
    for r in got.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[13] == [None] and texts[14] == [""] and texts[15] == ["   \n\t "] and set(texts[None]) == {None, texts[3][0]}
    assert texts[10] == ["", ""]  # equal to document 0
    assert lines.dedup(empty).collect() == []


def _crowded_lines():
    """Lines that share passages, some of them alike, many not."""
    rng = random.Random(31)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    texts = set()
    for passage in (words(5), words(6), words(12)):
        for _ in range(90):
            line = f"{words(rng.randrange(2, 9))} {passage} {words(rng.randrange(1, 5))}"
            texts.add(line)
            for _ in range(rng.choice([0, 0, 0, 1, 4])):
                at = rng.randrange(len(line))
                texts.add(" ".join((line[:at] + rng.choice("xyz") + line[at + 1 :]).split()))
    return sorted(texts)


def _joined(pairs):
    union = components.Union()
    for a, b in pairs:
        union.join(a, b)
    return {x: union.find(x) for x in list(union.parent)}


def _distinct(spark, texts):
    chars, sketches = lines.Signer().sketches([x.encode() for x in texts], 0.8)
    rows = [(k, 1, c, x, [(p["posts"], p["sim"]) for p in s]) for k, (c, x, s) in enumerate(zip(chars, texts, sketches.to_pylist()))]
    return spark.createDataFrame(rows, lines.DISTINCT).repartition(3)


def test_dealt_links_join_what_pairs_join(spark, monkeypatch):
    texts = _crowded_lines()
    distinct = _distinct(spark, texts).cache()
    pairs = lines.first_pairs(distinct, long_list=10**6).select("a", "b")
    expected = _joined(tuple(r) for r in lines.verified(distinct.select("key", "line"), pairs, 0.8).collect())
    assert len(set(expected.values())) > 50
    # all at once, by rounds, with lists cut in parts, and with long lines apart from the others
    longer = sorted(map(len, texts))[len(texts) // 2]
    for rounds, settings in ((1, {}), (4, {"ROUND_CHARS": 4 * sum(map(len, texts)), "PART": 8}), (3, {"DEALT_CHARS": longer})):
        with monkeypatch.context() as patch:
            for name, value in settings.items():
                patch.setattr(lines, name, value)
            made = []
            found = lines.dealt_links(distinct, 0.8, made) + lines._longest_links(distinct, 0.8, made)
            assert len(found) == rounds
            links = [tuple(r) for df in found for r in df.collect()]
            assert all(lines.within(texts[a], texts[b], 0.8) for a, b in links)
            assert _joined(links) == expected


@pytest.mark.parametrize("settings", [{"SHORT_LIST": 2, "BLOCK": 30, "VERIFIED": 7, "UNIT": 5}, {"SHORT_LIST": 10, "VERIFIED": 100, "LIKELY": 9}, {"LIKELY": 0}])
@pytest.mark.parametrize("batch", [3, 1000])
def test_links_of_lists_over_batches(monkeypatch, settings, batch):
    texts = _crowded_lines()
    chars, sketches = lines.Signer().sketches([x.encode() for x in texts], 0.8)
    rows = []
    for k, (c, x, s) in enumerate(zip(chars, texts, sketches.to_pylist())):
        rows += [((at << 32) | (least & 0xFFFFFFFF), c, k, p["sim"], p["posts"][:3], x) for p in s for at, least in enumerate(p["posts"][:4])]
    rows.sort(key=lambda r: r[:3])
    post, chars, key, sim, before, line = (list(c) for c in zip(*rows))
    ints = {"post": post, "sub": [0] * len(rows), "part": [0] * len(rows), "key": key, "sim": sim, "chars": chars}
    entries = pa.table({**ints, "before": pa.array(before, pa.list_(pa.int32())), "line": line})
    expected, begin = set(), 0
    for i, (p, c, k, s, _, x) in enumerate(rows):
        begin = i if post[i] != post[begin] else begin
        for j in range(begin, i):
            agree = any(u == v for u, v in zip(np.int64(s).tobytes(), np.int64(sim[j]).tobytes()))
            if agree and key[j] != k and lines.within(x, line[j], 0.8):
                expected.add((key[j], k))
    for name, value in settings.items():
        monkeypatch.setattr(lines, name, value)
    found = [tuple(r.values()) for b in lines._lists_linked(iter(entries.to_batches(max_chunksize=batch)), 0.8) for r in b.to_pylist()]
    assert _joined(found) == _joined(expected) and len(set(found)) < len(expected)


def test_lines_that_share_a_passage_fill_no_disk(spark, monkeypatch):
    texts = _crowded_lines()
    rows, kept = [(i, x) for i, x in enumerate(texts)], lines.stored

    def counted(df, what, *args, **more):
        out = kept(df, what, *args, **more)
        written.append((what, out.count()))
        return out

    written = []
    monkeypatch.setattr(lines, "stored", counted)
    gone = lines.repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id for r in gone.collect()} == {i for i, _, _ in _lines_loop(rows)}
    # a line is stored a few times, but neither the pairs of lines that are not alike nor the lists they stand in
    assert sum(n for _, n in written) < 4 * len(rows), written


def test_counts_of_characters_keep_what_is_alike():
    rng = random.Random(23)
    apart = 0
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(2, 90)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("xyz ") for _ in a]
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "日"])
        most = rng.randrange(10)
        if lines._counts_apart(a, "".join(b), most):
            apart += 1
            assert brute.edits(a, "".join(b)) > most
    assert apart > 30


# --- 10: quality ---


def test_counts_equal_loops(odd, plain_rows, spark):
    more = [(100, "a b c a b c x", None), (101, "z z z z z", None), (102, "l\nl\n \nl\r\n|#<>|", None), (103, "u v w\u00a0x u v w\u00a0x u", None)]
    docs = odd.select("doc_id", "text", "lang", "score").unionByName(
        spark.createDataFrame([(*r, "x") for r in more], "doc_id long, text string, lang string, score string")
    )
    got = quality.score(docs, np.zeros(quality.BUCKETS))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(
        [(r.doc_id, r.text, *(r[n] for n in names)) for r in got.collect()],
        [(i, t, *brute.quality_counts(t)) for i, t, _ in [*plain_rows, *more]],
    )


def test_ratio_prefers_the_target(spark, odd, empty):
    rows = [(i, "good plain words here " * 5) for i in range(30)] + [(100 + i, "JUNK!! SPAM!! " * 8) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long")
    counts = quality.count_grams(docs, trusted)
    assert counts[0].sum() == sum(2 * len(t.split()) - 1 for _, t in rows)
    assert counts[1].sum() == sum(2 * len(t.split()) - 1 for i, t in rows if i < 20)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.log_ratios(counts)).collect()}
    assert min(got[i] for i in range(30)) > 0 > max(got[100 + i] for i in range(10))
    nothing = quality.count_grams(empty, trusted)
    assert not nothing.any() and not quality.log_ratios(nothing).any()
    assert quality.score(odd, quality.log_ratios(quality.count_grams(odd, trusted.limit(0)))).where("score <> 0").isEmpty()


def test_edit_similarity_equals_the_table():
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            after = [i]
            for j, y in enumerate(b, 1):
                after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
            row = after
        return row[-1]

    rnd = random.Random(5)
    for size in (*[12] * 1500, 90, 700, 900):
        a = "".join(rnd.choice("ab cé") for _ in range(rnd.randint(size // 2, size)))
        b = list(a)
        for _ in range(rnd.choice([0, 2, size // 4])):
            b.insert(rnd.randint(0, len(b)), "z")
            b.pop(rnd.randrange(len(b)))
        b = "".join(b)
        edits = table(a, b)
        assert lines.edit_distance(a, b) == edits
        for least in (0.5, 0.8):
            assert lines.within(a, b, least) == (edits <= int((1 - least) * max(len(a), len(b)) + 1e-9))
