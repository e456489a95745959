"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns, for every operator and stage."""

import random

import pytest

import corpus_pipeline
from orogen.llm import bpe, languages, licenses, line_dedup, ngram_join, packing, periodic, pii, quality, token_files, topk, toxicity
from orogen.llm.common import stored
from tests.llm.test_operators import prose

#: Columns that the operators might use themselves.
EXTRA = ["kept", "n_lines", "n_dropped", "_row", "_words", "_lines", "_kept", "_gone", "gone", "row", "r1", "r2", "words", "lines", "left", "slot", "chunk", "payload", "piece", "block", "score", "predicted", "mark", "held_out", "digest", "hashes", "node", "component_id", "n_shingles", "spans", "start", "part", "bucket", "label", "learned", "gram", "language", "n_runs", "period", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    texts = [(i, prose(rng, 60) + "\nshared by many") for i in range(40)] + [(50, None), (51, ""), (52, " \n "), (None, "a row without an id at all, none"), (53, prose(rng, 60_000)), (54, "+1 (743) 555-3824 then 743 555 3824 " * 3000)]
    texts += [texts[3]] * 3 + [(60, texts[5][1]), (61, texts[5][1])]
    return stored(spark.createDataFrame([(i, t, "en", "s", 0, *[f"{c} {i}" for c in EXTRA]) for i, t in texts], SCHEMA), "edges")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def runs(labels):
    return {
        1: bpe.encode_decode, 2: lambda d: pii.find(d, pii.fit(d)), 4: packing.pack, 5: lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        6: token_files.round_trip, 8: lambda d: quality.judge(d, labels), 9: line_dedup.dedup, 10: ngram_join.link,
        11: lambda d: languages.identify(d, languages.fit(d)), 13: periodic.find,
    }


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 8, 9, 10, 11, 13])
def test_each_row_has_its_result_and_empty_tables_none(docs, runs, n):
    got = runs[n](docs)
    rows = got.where("piece = 0").collect() if n == 4 else got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    by = {r["doc_id"]: r for r in rows}
    assert runs[n](docs.limit(0)).count() == 0
    want = {1: ("n_tokens", 0), 2: ("spans", ""), 4: ("length", 1), 5: ("n_tokens", 0), 6: ("n_tokens", 1), 8: ("n_words", 0), 9: ("n_dropped", 0), 10: ("n_shingles", 0), 11: ("lang_pred", "und"), 13: ("n_runs", 0)}[n]
    assert by[50][want[0]] == by[51][want[0]] == want[1]
    if n == 5:
        assert by[50]["score"] == by[51]["score"]
    if n == 8:
        assert by[50]["base_failed"] and not by[51]["kept"]
    if n == 2:
        assert by[54]["spans"].count("phone:") == 6000  # of a very long text, all of it
    if n == 9:
        assert all(r["_row"] == f"_row {r['doc_id']}" and r["words"] == f"words {r['doc_id']}" for r in rows) and "shared" not in by[4]["kept"]
    if n == 10:
        assert by[60]["component_id"] == by[61]["component_id"] == 5 and by[None]["component_id"] is None


def test_licenses_and_searches_take_what_comes(spark, docs):
    assert licenses.scan(docs).count() == 0 == licenses.scan(docs.limit(0)).count()
    long = spark.createDataFrame([(1, prose(random.Random(1), 30_000) + " Released under the MIT License. " + prose(random.Random(2), 30_000), "x")], "doc_id long, text string, license string")
    assert [tuple(r)[:2] for r in licenses.scan(long).collect()] == [(1, "MIT notice")]
    same = spark.createDataFrame([(i, [1.0, 2.0], "x", "y") for i in [*range(20), 50, 50]], "vec_id long, embedding array<double>, score string, rank string")
    got = topk.top_k(same).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0] == [1, 2, 3, 4, 5]  # ties to the smaller


def test_stages_leave_clashing_columns_alone(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, empty = (stored(stage(spark, d, str(tmp_path)), name) for d in (now, empty))
        assert now.columns == docs.columns and empty.count() == 0
        assert all(r[c] == f"{c} {r['doc_id']}" for r in now.collect() for c in EXTRA)
        if name == "line_dedup":
            assert not any("shared by many" in (r["text"] or "") for r in now.collect())
    left = [r["doc_id"] for r in now.collect()]
    assert None in left and 50 in left and 51 in left and 60 not in left and 61 not in left and 5 in left and left.count(3) == 4
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert packed.where("piece = 0").count() == len(left) and corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
