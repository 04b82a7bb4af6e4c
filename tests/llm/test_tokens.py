"""The cached encoder, token files and packing."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrace.llm import packing, tokenfiles
from terrace.llm.common import scratch_path
from terrace.llm.tokens import encoder, vocabulary_path

ODD = [
    "", " ", "  a  b", "a\n\nb", "<|endoftext|> x", "x  y ", "\x1c a", "it's  I'll\n", "a\x00b c", "Σας ΣΑΣ. ΟΔΟΣ é x", "a ́b",
    "日本語 テキスト。 😀 ok", "\ta\t b", "don't", "a b  c", "x" * 5000, "12 345,6 km",
]
DOCS = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (5, "again five"), (5, "again five"), (None, "no id"), (101, "word " * 3000)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    plain = Tokenizer.from_file(vocabulary_path(name))
    enc = encoder(vocabulary_path(name))
    for _ in range(2):  # cold and warm
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(ODD)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as offset", "2 as ids_crc32", "3 as curve", "4 as file")


def test_packing_is_whole_and_unpadded(spark):
    got = packing.pack(frame(spark)).collect()
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {}
    for d, t in DOCS:
        want.setdefault(d, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].padded and (at == 1024 or at & (at - 1) == 0) and at <= 1024
    for d, texts in want.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, texts))
        for r in by_doc[d]:
            assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in texts)


def test_packing_an_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 4)])
def test_hilbert_keys_visit_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = packing.hilbert_keys(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("values", [[], [0], [5], [1, 2, 3], [0, 0, 7, 7, 1000], list(range(0, 9000, 7)), [1] * 2000, [10**12]])
def test_elias_fano_round_trip(values):
    ef = tokenfiles.EliasFano.encode(np.array(values, np.int64), values[-1] if values else 0)
    assert ef.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert ef.select(i) == values[i]
    for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values), len(values))):
        assert ef.select_range(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 3000, 20_000))
    ef = tokenfiles.EliasFano.encode(ends, int(ends[-1]))
    assert 8 * (len(ef.lower) + len(ef.upper)) / len(ends) < 3 + np.log2(ends[-1] / len(ends))


def test_file_bytes_round_trip():
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [1], [60_000, 1])]
    docs, ends, tokens = tokenfiles.unpack_file(tokenfiles.pack_file([7, None, 9], ids, 2))
    assert docs == [7, None, 9] and ends.all().tolist() == [3, 4, 6] and tokens.tolist() == [1, 2, 3, 1, 60_000, 1]
    with pytest.raises(ValueError, match="token file"):
        tokenfiles.unpack_file(b"x" * 80)


@pytest.mark.parametrize("file_ids", [10, 4_000_000])
def test_token_files_match_brute_force(spark, file_ids):
    got = sorted(tokenfiles.token_files(frame(spark), file_ids=file_ids).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    order = sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
    at = 0
    assert [r.doc_id for r in got] == [d for d, _ in order]
    for r, (_, t) in zip(got, order, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_an_empty_table(spark):
    assert tokenfiles.token_files(frame(spark, [])).count() == 0


def test_files_are_the_same_when_written_again(spark):
    import os

    folders = [scratch_path(spark, "twice") for _ in range(2)]
    seen = []
    for f in folders:
        tokenfiles.write_token_files(frame(spark), f).collect()
        at = f.removeprefix("file://")
        seen.append({n: open(os.path.join(at, n), "rb").read() for n in sorted(os.listdir(at)) if n.endswith(".efids")})
    assert seen[0] == seen[1] and seen[0]


def test_reading_goes_through_select(spark, monkeypatch):
    """Files are read in steps smaller than a file, with the same result."""
    whole = sorted(map(tuple, tokenfiles.token_files(frame(spark)).collect()), key=str)
    monkeypatch.setattr(tokenfiles, "SELECTED", 2)
    assert sorted(map(tuple, tokenfiles.token_files(frame(spark)).collect()), key=str) == whole
    starts = sorted((r[1], r[2]) for r in whole)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
