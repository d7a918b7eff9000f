"""The text queries and the pipeline on the benchmark tables."""

import hashlib
import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from oracle import connect, difference  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidewatch.llm import catalog, components, language, licenses, lines  # noqa: E402

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return {r[0]: r for r in catalog.QUERIES[name](spark, FOLDER).collect()}


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_op1(spark, docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=catalog.tokenizer(catalog.PIECES))
    for i, r in run(spark, "op1_pieces").items():
        ids = library.encode(docs[i].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op2_held_out_accuracy(spark, docs):
    got = run(spark, "op2_language")
    assert len(got) == len(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[i].lang_pred == docs[i].lang for i in held]) > 0.97


def test_op3(spark, docs):
    got = run(spark, "op3_suffix_dedup")
    for i, t, kept, runs in brute.removed_bytes([(i, r.text) for i, r in docs.items()]):
        n = len(t.encode())
        assert tuple(got[i]) == (i, n, n - len(kept), runs, sha(kept))


def test_op6(spark, docs):
    for i, r in run(spark, "op6_licenses").items():
        places = brute.phrase_places(docs[i].text, licenses.BASE)
        starts = [p for p, _ in places]
        base = sorted({b for _, b in places})
        assert (r.n_words, r.n_base) == (len(brute.words(docs[i].text)), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(base) and set(base) <= set(r["labels"].split(",")) | set()
        assert 0 <= r.score <= 1


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    library, got, start = Tokenizer.from_file(catalog.tokenizer(catalog.WORDS)), run(spark, "op8_token_store"), 0
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i].text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9_keeps_first_lines(spark, docs):
    got = run(spark, "op9_line_dedup")
    assert len(got) == len(docs) and sum(r.n_removed for r in got.values()) > 0
    assert all(r.n_bytes <= len(docs[i].text.encode()) for i, r in got.items())


def test_lines_against_all_pairs_by_edit_similarity(spark, docs):
    rows = [(i, n, x) for i, r in sorted(docs.items()) for n, x in enumerate((r.text or "").split("\n")) if x.strip() and len(x) <= 300]
    texts = sorted({lines.normalised_lines(x)[0].decode() for _, _, x in rows})
    union = components.Union()
    for a in range(len(texts)):
        for b in range(a):
            if lines.within(texts[a], texts[b], 0.8):
                union.join(a, b)
    place, seen, gone = {x: k for k, x in enumerate(texts)}, set(), set()
    for k, (_, _, x) in enumerate(rows):
        root = union.find(place[lines.normalised_lines(x)[0].decode()])
        gone |= {k} if root in seen else set()
        seen.add(root)
    found = lines.dedup(spark.createDataFrame([(k, x) for k, (_, _, x) in enumerate(rows)], "doc_id long, text string"), counts=True)
    got = {r.doc_id for r in found.where("n_removed > 0").collect()}
    print(f"lines {len(rows)}, to go {len(gone)}, found {len(got & gone)}, wrong {len(got - gone)}")
    assert gone and got <= gone and len(got) >= 0.98 * len(gone)


def test_op10(spark, docs):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = run(spark, "op10_quality")
    for i, r in got.items():
        assert tuple(r)[1:6] == brute.quality_counts(docs[i].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.kept for i, r in got.items() if i in labels and labels[i].quality and not r.base_failed]
    assert np.mean(good) == 1


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    from oracle import connect, difference

    assert difference(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name], connect(FOLDER)) is None


def test_pipeline_stages(spark, docs):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = documents.withColumn("score", F.lit("x"))
    sizes = [got.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = got
        got = stage(spark, before, FOLDER)
        if name != "encoding":
            assert got.columns == before.columns
        got = spark.createDataFrame(got.collect(), got.schema)
        sizes.append(got.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert got.where("not agrees").isEmpty()
    final = corpus_pipeline.run(spark, FOLDER)
    assert final.count() == sizes[-1]
    # no two left are near copies, none has a passage of the benchmark
    left = {r[0] for r in final.select("doc_id").collect()}
    assert left <= {i for i, r in docs.items() if r.text}


def test_pipeline_of_odd_documents(spark, odd, empty):
    for start in (odd.withColumn("source", F.lit("s")), empty):
        got = start
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, FOLDER)
            got = spark.createDataFrame(got.collect(), got.schema)
        assert got.count() <= start.count()


def test_held_out_remainder(spark):
    got = spark.range(200).select("id", language.held_out("id").alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_line_dedup_leaves_no_blank_documents(spark):
    text = "Der erste Absatz hat einige Worte.\n\nEin zweiter folgt nach einer leeren Zeile.\n \t\n\u00a0\nKurz."
    rows = [(i, text) for i in range(5)] + [(9, "Ein eigener Text.\n\nKurz."), (10, "\n\n"), (11, None)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert {r.doc_id: r.text for r in got} == {0: text, 9: "Ein eigener Text.\n"}


def test_url_patterns_decide_as_sql(spark, tmp_path):
    """Addresses made of what the patterns look for, whole and damaged, where no base rule fits."""
    rnd = random.Random(5)
    words = [
        *catalog.URL_WORDS, *catalog.URL_HOSTS, *catalog.URL_SECTIONS, *(f"{o}-{g}" for o in catalog.URL_OFFERS for g in catalog.URL_GOODS[:4]),
    ]

    def word():
        w = rnd.choice(words)
        return w if rnd.random() < 0.7 else rnd.choice([f"{w}s", f"x{w}", f"{w}-2", w.upper(), "news", "a_b", ""])

    urls = [
        f"https://{'.'.join([word() for _ in range(rnd.randint(0, 2))] + ['site.org'])}/"
        f"{'/'.join(word() for _ in range(rnd.randint(0, 3)))}{rnd.choice(['', '.' + rnd.choice(catalog.URL_ENDINGS), '?login', '.html'])}"
        for _ in range(3000)
    ] + [None, "", "cart", "://", "http://ads.", "http://cdn.net/es/docs", "http://ads.site.org/x\n/docs", "http://é.org/login"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    # as one file: a table the driver finds under its name
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = connect(str(tmp_path))
    assert difference(catalog.QUERIES["op4_urls"](spark, str(tmp_path)), catalog.ORACLES["op4_urls"], con) is None
    counts = dict(con.execute(f"SELECT verdict, count(*) FROM ({catalog.ORACLES['op4_urls']}) WHERE pattern IS NOT NULL GROUP BY 1").fetchall())
    assert counts["block"] > 500 and counts["allow"] > 10
