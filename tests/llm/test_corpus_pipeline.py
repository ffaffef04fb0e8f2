"""Every stage of the pipeline against a brute-force version of what it must do."""

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerwise.llm import bpe
from ledgerwise.llm.common import table
from ledgerwise.scale import cut_lineage

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, by name."""
    docs, out = table(spark, FOLDER, "documents"), {}
    for name, function in corpus_pipeline.STAGES:
        made = cut_lineage(function(spark, docs, FOLDER))
        out[name] = (docs, made)
        docs = made
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_return_the_columns_of_documents(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mix", "tokens"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])


def test_quality_keeps_clean_documents_whole(spark, stages):
    before, after = stages["quality"]
    assert after.exceptAll(before).count() == 0 and after.count() > 0
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = table(spark, FOLDER, "labels").collect()
    clean = [r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.95 * len(clean)


def test_lines_of_ten_documents_go(stages):
    before, after = stages["line_dedup"]
    rows = before.collect()
    key = {r.doc_id: [x.strip(" \t\n\x0b\x0c\r").lower() if x.isascii() else x.strip(" \t\n\x0b\x0c\r") for x in r.text.split("\n")] for r in rows}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = {i: [k.translate(lower) for k in own] for i, own in key.items()}
    held = Counter(k for own in key.values() for k in set(own))
    got = {r.doc_id: r for r in after.collect()}
    for r in rows:
        kept = "\n".join(x for x, k in zip(r.text.split("\n"), key[r.doc_id]) if not k or held[k] < 10)
        assert (got[r.doc_id].text, got[r.doc_id].n_chars) == (kept, len(kept))


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = {r.doc_id: shingles(r.text) for r in before.collect()}
    least = {i: i for i in rows}
    links = [(a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b])]
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i in rows if least[i] == i}


def test_mix_takes_half_as_much_again(stages):
    before, after = stages["mix"]
    size = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    own = {r.doc_id: r.n for r in before.select("doc_id", size.alias("n")).collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum(size).alias("n")).collect()}
    assert all(got[i] <= 2 * own[i] for i in got)
    assert sum(got.values()) == pytest.approx(1.5 * sum(own.values()), rel=0.01)
    again = corpus_pipeline.mix(before.sparkSession, before.repartition(5), FOLDER)
    assert again.exceptAll(after).count() == 0 == after.exceptAll(again).count()


def test_tokens_are_those_of_the_library(stages):
    before, after = stages["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    expected = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == expected


def test_stages_bear_awkward_documents(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", "en", "a", 15),
        (3, "x " * 50_000, "en", None, 100_000), (4, "same text", "en", "b", 9), (4, "same text", "en", "b", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "label", "_key", "mask", "kept_text", "size", "run", "shard", "node", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), FOLDER).count() == 0
        made = function(spark, docs, FOLDER)
        assert re.fullmatch("tokens", name) or made.columns == docs.columns
        made.collect()


def test_near_dedup_bears_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [
        (None, "some words of a document without an id", "a"), (None, "other words of another such document", "a"),
        (None, long + " more", "b"), (1, long, "a"), (7, long + " again", "a"), (7, "text that only this row of the id has", "a"),
        (4, "the same row twice in the table", "b"), (4, "the same row twice in the table", "b"),
        (5, "", "a"), (5, None, "a"), (None, None, "a"), (None, None, "b"),
        (None, "a copy that has no id at all", "a"), (None, "a copy that has no id at all", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = [rows[2], rows[4], rows[7]]
    made = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()]
    copies = Counter(made) & Counter(rows[12:])
    assert Counter(made) - copies == Counter(rows[:12]) - Counter(gone)
    assert sum(copies.values()) == 1
    again = corpus_pipeline.near_dedup(spark, docs.orderBy("source", "text").repartition(3), FOLDER)
    assert Counter(tuple(r) for r in again.collect()) == Counter(made)


def test_run_gives_the_last_stage(spark, stages):
    run = corpus_pipeline.run(spark, FOLDER)
    assert run.exceptAll(stages["tokens"][1].select(run.columns)).count() == 0
