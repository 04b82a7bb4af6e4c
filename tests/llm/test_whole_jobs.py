"""Jobs done in part before: what a reviewer found missing."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from terrace.llm import decontam, linededup, packing
from terrace.llm.queries import QUERIES


def test_short_repeated_lines_go(spark, tmp_path, monkeypatch):
    """Equal lines of any length with a word go in the query and the stage; rules, blanks and near short ones stay. The
    commonest line is dealt over several tasks."""
    docs = [(k, f"All rights reserved.\n---\n\nline {k}\n  all rights RESERVED. \né\n1") for k in range(80)] + [(None, "é"), (200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op1_edit_join_line_dedup"](spark, str(tmp_path)).collect()}
    assert (rows[0].n_compared, rows[0].n_equal, rows[0].n_near, rows[0].n_kept) == (5, 2, 0, 5)
    assert all((rows[k].n_equal, rows[k].n_near, rows[k].n_kept) == (4, 0, 3) for k in range(1, 80))
    assert rows[None].n_equal == 0 and rows[200].n_lines == 0
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, str(tmp_path)).collect()}
    assert texts[0] == "All rights reserved.\n---\n\nline 0\n1" and texts[None] == "é" and texts[200] is None
    assert all(texts[k] == f"---\n\nline {k}" for k in range(1, 80))
    monkeypatch.setattr(linededup, "HEAVY", 1)
    calm = {r.doc_id: r.text for r in linededup.without_repeated_lines(df, short=True).collect()}
    assert calm == texts


def test_names_at_the_start_of_sentences_are_slots(spark):
    """Also names of other shapes, and names that are spelt like units."""
    text = "{0} has 3 apples. {0} buys 4 more. How many apples does {0} have now?"
    bench = spark.createDataFrame([(1, text.format("Alice")), (2, "{0} met {1} at noon. {1} gave {0} a red book and {0} read it twice. Who read it?".format("O'Brien", "Jean-Luc"))], "item_id long, text string")
    other = "{0} met {1} at noon. {1} gave {0} a red book and {0} read it twice. Who read it?"
    docs = [(1, text.format("Bob").replace("3", "8")), (2, "Question: " + text.format("Miles")), (3, text.format("McDonald")), (4, other.format("NASA", "Eve")), (5, text.format("Alice"))]
    docs += [(6, "Bob has 3 apples. Carl buys 4 more. How many apples does Dan have now?"), (7, "Alice sold the house. Bob bought it."), (8, "")]
    got = {r.doc_id: r for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {d: r.item_id for d, r in got.items() if r.contaminated} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1}
    assert got[5].verbatim and not got[1].verbatim


def test_items_without_a_usable_window_are_found_as_a_whole(spark):
    long = " ".join(map(str, range(40)))
    items = [(1, "What is 12 * 7 + 3?"), (2, "7 * 8"), (3, f"Add {long}!"), (4, "- ?"), (5, "")]
    docs = [(1, "Today: What is 12 * 7 + 3 ? Nobody knew."), (2, "he said: 7 * 8, please"), (3, f"please add {long} now"), (4, "What is 12 + 7 * 3?"), (5, "What is 12 * 7 + 4?")]
    docs += [(6, "7 + 8"), (7, f"add {long[2:]}"), (8, "- ?"), (9, None), (10, "What is 12 * 7 + 3?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {d: r.item_id for d, r in got.items() if r.contaminated} == {1: 1, 2: 2, 3: 3, 10: 1}
    assert all(got[d].verbatim for d in (1, 2, 3, 10))


def test_windows_of_any_length():
    """Equal runs have equal hashes wherever they stand, different runs and other lengths do not."""
    a = np.random.default_rng(0).integers(0, 1 << 63, 70, np.uint64)
    for k in (1, 2, 33, 64):
        assert set(decontam.whole_windows(a[5 : 5 + k], [k])) <= set(decontam.whole_windows(a, [k, 69]))
        assert not set(decontam.whole_windows(a[::-1][:k], [k])) & set(decontam.whole_windows(a, [k])) or k == 1
    assert len(decontam.whole_windows(a, [1, 2, 70, 71])) == 70 + 69 + 1


def test_the_curve_fits_documents_that_come_late(spark):
    """The cuts are quantiles of the whole table, also where one source fills its first rows."""
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), 60))
    docs = [(i, word("0123456789 ")) for i in range(2400)] + [(i, "~" * 40 + word("aé")) for i in range(2400, 3300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    curve = {r.doc_id: r.curve for r in packing.pack(df).collect()}
    late = {curve[i] for i in range(2400, 3300)}
    assert len(curve) == len(docs) and len(late) > 500


def test_slots_agree_across_words_put_in(spark):
    """A number that the item has twice stands for one number in a copy, also where words between its halves shift them."""
    item = "The old farmer keeps {} brown cows in the wide north field and later he buys exactly {} white goats for the small barn near the river."
    docs = [(1, item.format(5, 5)), (2, item.format(5, 9)), (3, item.format(5, 5).replace("and later", "and much later")), (4, item.format(5, 9).replace("and later", "and much later")), (5, item.format(12, 12))]
    bench = spark.createDataFrame([(1, item.format(12, 12))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), bench, ).collect()}
    assert {d for d, r in got.items() if r.contaminated} == {1, 3, 5}
    assert got[5].verbatim and not got[3].verbatim
