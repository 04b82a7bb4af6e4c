"""Very long texts, empty tables, null and equal ids, columns with the operators' own names."""

import random

import pytest

import corpus_pipeline
from terrace.llm import decontam, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["1 as row", "2 as of", "'x' as line", "3 as fp", "4 as hash", "5 as view", "6 as place", "'y' as key", "7 as shift", "8 as root", "9 as sequence_id", "10 as length"]


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def write(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], int(d[0] % 4 > 0), int(d[0] % 9 == 0)) for d in docs if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Which river runs through the old town of Brelan and how long is it in the dry season of the year?")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = prose(rng, 200_000)
    item = "Which river runs through the old town of Brelan and how long is it in the dry season of the year?"
    docs = spark.createDataFrame([(1, long), (2, long[:600_000] + " " + item + " " + long[600_000:]), (3, long), (4, "short")], "doc_id long, text string")
    found = {r.doc_id: r.contaminated for r in decontam.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False}
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert near[1] == near[3] == (f"{simhash.fingerprint(long):016x}", 1) and near[4][1] == 4
    m = toxicity.Model(["moron", "worthless"], toxicity.PRIOR.copy())
    end = spark.createDataFrame([(1, long + " you moron, worthless moron, you moron"), (2, long)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(end, m).collect()}
    assert scores[1] > scores[2]


def test_toxicity_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    m = toxicity.fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(empty, m).count() == 0
    one = toxicity.score_toxicity(spark.createDataFrame([(1, "x")], "doc_id long, text string"), m).first()
    assert 0 <= one.score < 0.7 and one.predicted == 0


def test_shards_of_equal_ids(spark):
    rows = [(7, f"text {i}", "en", "s", 1) for i in range(50)] + [(7, "same", "en", "s", 1)] * 50 + [(None, "x", None, None, None)] * 20
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 24).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 120 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())


def test_the_pipeline_on_no_documents(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_stages_with_null_ids_and_clashing_columns(spark, tmp_path, extra):
    """Every stage takes rows without an id or a text and columns of any name, and gives back what it got."""
    rng = random.Random(2)
    docs = [(i, prose(rng, 60) + f"\nline {i} of its own\n" + prose(rng, 30), "en", f"s{i % 3}", 9) for i in range(40)]
    docs += [(None, prose(rng, 80), "de", None, 1), (None, None, None, None, None), (3, docs[3][1], "en", "s0", 9), (5, None, "fr", "s", 0), (6, "", "fr", "s", 0)]
    write(spark, tmp_path, docs)
    df = spark.createDataFrame(docs, SCHEMA)
    df = df.selectExpr("*", *CLASH) if extra else df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), out.schema)
        assert name == "quality classifier" or df.count() > 20
        if extra:
            assert all((r["row"], r["line"], r["root"]) == (1, "x", 8) for r in df.collect())
        if name == "quality classifier":  # whatever the small network keeps, the next stages get them all
            df = spark.createDataFrame(docs, SCHEMA)
            df = df.selectExpr("*", *CLASH) if extra else df
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() >= df.count()
