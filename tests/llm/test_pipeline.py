"""The pipeline's stages, each on its predecessor's rows."""

import random

import corpus_pipeline
from orogen.llm.common import stored
from tests.llm.test_operators import brute_components, prose


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = prose(rng, 60).split(" ")
        if i % 10 == 0:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(["vilefoo", "vilebar", "nastyqux"])
        tail = "\nthis line stands in many documents" if i % 3 == 0 else ""
        rows.append((i, " ".join(words) + f"\nmail a{i}@b.org" + tail, "en", "s", 0))
    rows += [(300, rows[1][1], "en", "s", 0), (301, None, "en", "s", 0), (302, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, str(tmp_path)), name)
        seen.append(now)
        if name != "packing":
            assert now.columns == docs.columns
        if name == "toxicity":
            left = {r["doc_id"] for r in now.collect()}
            assert sum(i % 10 == 0 for i in left if i < 300) <= 3 and sum(i % 10 != 0 for i in left if i < 300) >= 265
        if name == "line_dedup":
            assert now.count() == before.count() and not any("stands in many" in (r["text"] or "") for r in now.collect())
        if name == "ngram_jaccard":
            roots = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in now.collect()} == {i for i, (_, c) in roots.items() if c == i}
        if name == "pii":
            assert all("@" not in (r["text"] or "") for r in now.collect()) and all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] is not None)
    assert seen[-1].select("doc_id").distinct().count() == seen[-2].count()
