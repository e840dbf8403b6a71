"""Very long texts without blanks, ids of other types, clashing column names, repeated labelled ids."""

import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulespark.llm import fingerprints, mixing, pii, token_counts, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_prefix_counts_around_combining_marks(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "e", "b", "'", "r", "l", " ", "é", "é", "ộ", "́", "̣", "ᄀ", "ᅡ", "ᆨ", "İ", "Σ", "Å", "1", "!", "日", "re", "ͅ", "Å", "क़"]
    count = token_counts.counter(token_counts.default_vocabulary())
    for i in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))
        if i % 7 == 0:
            text = ("x" if i % 2 else "!") * 70 + text + "é" * 3 + "q"
        got = np.concatenate([[0], np.cumsum(count.text_steps(text), dtype=np.int64)]).tolist()
        assert got == [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], ascii(text)


@pytest.mark.parametrize("make", [lambda n: "é" + "a" * n, lambda n: "é" * (n // 2), lambda n: "e" + "́" * n, lambda n: "!?" * (n // 2) + "Å", lambda n: "qzjx" * (n // 4)])
def test_token_counts_are_linear(tokenizer, make):
    count = token_counts.counter(token_counts.default_vocabulary())
    took = []
    for n in (25_000, 200_000):
        began = time.process_time()
        got = int(count.text_steps(make(n)).sum(dtype=np.int64))
        took.append(time.process_time() - began)
        assert got == len(tokenizer.encode(make(n), add_special_tokens=False).ids)
    assert took[1] < 30 * max(took[0], 0.05)


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " 5", "a5" * 500_000, "x[at]" * 200_000, "+1 " * 300_000, "(" * 1_000_000 + "5"])
def test_personal_data_is_linear(text):
    model = pii.fit([])
    began = time.process_time()
    pii.find(text, model)
    assert time.process_time() - began < 15


def test_spelt_addresses_of_any_length():
    long = "a" * 500
    assert pii.spelt(f"write to {long} [at] example [dot] org now") == [(9, 9 + len(f"{long} [at] example [dot] org"))]
    assert pii.spelt("a (at) b (at) c") == [(0, 8)]
    assert pii.spelt("[at] x") == [] and pii.spelt("x [at]") == []


@pytest.mark.parametrize("make", [lambda i: f"doc-{i:05d}", lambda i: str(i), lambda i: float(i)])
def test_fingerprints_of_any_ordered_ids(spark, make):
    rng = random.Random(5)
    rows = [(make(i), " ".join(rng.choice(["a", "bb", "ccc", "d d"]) for _ in range(30))) for i in range(300)] + [(None, "no id")]
    got = {r["id"]: r for r in fingerprints.edit_likeness(spark.createDataFrame(rows, f"doc_id {'double' if isinstance(rows[0][0], float) else 'string'}, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else rows[0][0]), reverse=True)
    import hashlib

    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest()


def test_near_duplicates_keep_columns_of_any_name_and_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 77, 88, {"a": 1}, "x"), (2, text + " more", 78, 89, {"b": 2}, "y"), (3, "other words altogether", 79, 90, None, "z"), (4, None, 80, 91, {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _more int, row map<string,int>, `odd.name` string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted((r["doc_id"], r["_row"], r["_more"], r["row"], r["odd.name"]) for r in got.collect()) == [(1, 77, 88, {"a": 1}, "x"), (3, 79, 90, None, "z"), (4, 80, 91, {}, None)]


def test_redaction_without_a_count_of_characters(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string")
    assert sorted(corpus_pipeline.redact_personal_data(spark, docs, "").collect()) == [(1, "mail [EMAIL] now"), (2, None)]


def test_a_labelled_id_on_many_rows_counts_once(spark):
    many = spark.range(20_000).select(F.lit(5).cast("long").alias("id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    docs = many.unionAll(spark.createDataFrame([(i, f"good words here {i}") for i in range(10, 30)], "id long, text string"))
    labels = spark.createDataFrame([(5, "poor")] + [(i, "good") for i in range(10, 30)], "id long, domain string")
    seen = []
    fit = mixing.fit
    mixing.fit = lambda rows, domains: seen.append(len(rows)) or fit(rows, domains)
    try:
        mixing.train(docs, labels, ("good", "poor"))
    finally:
        mixing.fit = fit
    assert seen == [21]
    toxicity.train(docs, labels.select("id", (F.col("domain") == "poor").cast("int").alias("label")))


def test_normal_forms_of_prefixes():
    for segment in ("ẹ́́", "각", "ậ̣̂", "q́́"):
        normal = lambda s: unicodedata.normalize("NFC", s).lower()
        whole = normal(segment)
        for k, (n, own) in enumerate(token_counts.prefixes(segment, normal), 1):
            assert (whole[:n] if own is None else own) == normal(segment[:k])
