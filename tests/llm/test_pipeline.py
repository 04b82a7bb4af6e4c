"""The pipeline against a plain one over the same stages' definitions, and the registered queries."""

import os

import pytest

import corpus_pipeline
from terrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert seen[2] == seen[1]  # line dedup takes lines, not documents
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == ids
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    whole = lambda rows: {d: max(r.doc_tokens for r in rows if r.doc_id == d) for d in {r.doc_id for r in rows}}
    assert whole(again) == whole(pieces) and len({key(r) for r in again}) == len(again)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("op2")])
def test_queries_return_every_document_once(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_three_of_the_operators_use_no_python(spark):
    for name in ("op1_edit_join_line_dedup", "op3_hilbert_sharding", "op10_feistel_pseudonyms"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_pipeline_against_brute_force(spark, tmp_path):
    import random
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from terrace.llm import decontam, quality
    from terrace.llm.tokens import vocabulary_path
    from tests.llm.test_dedup import change, classes, rest_of, slow_drops, slow_print

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(9))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    shared = [line() for _ in range(4)]
    texts = []
    for i in range(60):
        lines = [line() for _ in range(rng.randrange(1, 6))]
        if i % 5 == 0:
            lines = [" ".join(w + "***" for w in x.split()) for x in lines]
        if i % 4 == 1:
            lines.insert(rng.randrange(len(lines) + 1), change(rng, rng.choice(shared), rng.randrange(3)))
        if i % 9 == 2:
            lines.append(f"{line()} {items[i % 3][1]}")
        texts.append("\n".join(lines))
    texts += [texts[1], texts[2].upper(), "", None, "tiny", "tiny"]
    docs = list(enumerate(texts, 1))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int((d - 1) % 5 != 0), 0) for d, _ in docs[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    source, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    net = quality.fit_quality(source, labels)
    left = [(d, t) for d, t in docs if net.score(t) >= 0.3]
    assert 30 < len(left) < len(docs)
    gone = slow_drops(left)
    left = [(d, rest_of(d, t, gone)) for d, t in left]
    prints = {d: slow_print(t) for d, t in left}
    nodes = sorted(set(prints.values()))
    c = classes(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if bin(a ^ b).count("1") <= 2])
    first = {}
    for d, _ in left:
        first.setdefault(c[prints[d]], d)
    left = [(d, t) for d, t in left if first[c[prints[d]]] == d]
    windows = lambda t: {(v, int(h)) for v, hs, _ in decontam.templates(t) for h in hs if h}
    leaks = lambda t: any(len(windows(t) & windows(x)) >= 0.8 * len(windows(x)) for _, x in items)
    clean = [(d, t) for d, t in left if not leaks(t)]
    assert len(clean) < len(left)
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {d: plain.encode(t or "", add_special_tokens=False).ids + [0] for d, t in clean}
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, want.values()))
