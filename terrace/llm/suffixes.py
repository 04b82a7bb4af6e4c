"""Suffix-array dedup: bytes under a string of fixed length that a document with a smaller id holds too.

Sorting every suffix of a corpus moves far more than the corpus. Three steps bring together what can be equal, and the
difference-cover algorithm then sorts the suffixes of distinct texts only.

1. Every window of LENGTH bytes has one anchor, the leftmost least hash among its K-byte strings, so equal windows have
   equal anchors at equal places. Neighbouring windows with the same anchor form one piece of text. Anchors' hashes are
   exchanged in sorted blocks; the pieces of an anchor that only one document has go (as names that occur once do in
   the sorting of suffixes).
2. The other pieces are made distinct where they are read: of equal pieces the one with the smallest id travels on, the
   others are repeats as a whole. Pieces are dealt by their anchor's hash. An anchor of very many documents has its
   pieces dealt as single windows, by the windows' own hash, so no task gets all the different texts around it.
3. A task leaves out windows around whose anchor nothing but the anchor recurs, and sorts the suffixes of the others:
   suffixes at two of three places are the sample; their triples are sorted and named, the names' string is sorted in
   the same way until names are unique or as long as a window, the other third is sorted by first byte and the sample's
   ranks and merged in. Neighbours in the suffix array are compared over LENGTH bytes; windows of one run are equal, and
   the smallest id of the run decides.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import prepare, release, settle

#: Fixed by the task: bytes of a repeated string.
LENGTH = 50
#: Bytes of an anchor.
K = 16
#: Windows whose anchors stand at so many neighbouring places are looked up together, by what all of them hold.
STEP = 6
#: Anchors and pieces of text that a task gathers before it hands them on; windows of one pass of the hash.
CHUNK, PIECES, SPAN = 1_000_000, 200_000, 1 << 18
#: An anchor in more documents than this is dealt by windows; so many different texts around one fit into a task.
HOT = 65_536
#: Bytes of texts for each group, so that a group's arrays stay small whatever the corpus and the shuffle's partitions;
#: groups are no finer, because each block has a row for each of them.
GROUP_BYTES = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-byte string: hashes of two halves make that of the whole, for the powers of two in k."""
    h, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            out = h if out is None else h[: len(h) - done] * np.uint64(pow(_MULTIPLIER, done, 1 << 64)) + out[size : size + len(h) - done]
            done += size
        size *= 2
        if size > k:
            return _mixed(out)
        h = h[: -(size // 2)] * np.uint64(pow(_MULTIPLIER, size // 2, 1 << 64)) + h[size // 2 :]


def pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """``doc, first, last, anchor, hash`` of every piece of the documents that end at ``ends``: windows ``first`` to
    ``last`` have the k-byte string at ``anchor`` (places in the whole data)."""
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie in one document
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    wide, low = length - k + 1, np.uint64((1 << 24) - 1)
    found = []
    for at in range(0, len(data), SPAN):
        part = data[at : at + SPAN + length - 1]
        if len(part) < length:
            break
        h = string_hashes(part, k)
        # The place in the low bits: of equal hashes the leftmost is least.
        m, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= wide:
            m, size = np.minimum(m[:-size], m[size:]), 2 * size
        if size < wide:
            m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
        good = np.flatnonzero(inside[at : at + len(m)])
        if not len(good):
            continue
        anchor = (m[good] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)]))
        last = np.append(first[1:], len(good)) - 1
        a = anchor[first]
        found.append((good[first] + at, good[last] + at, a + at, h[a]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    first, last, anchor, h = map(np.concatenate, zip(*found, strict=True))
    # A run of windows never crosses into the next document: between both lie windows that are in none, or the anchor
    # changes; where documents follow each other without a gap, runs are cut here.
    doc = np.searchsorted(ends, first, "right")
    return doc, first, last, anchor, h


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are ordered as the pairs are."""
    if (int(a.max(initial=0)) + 1) * (int(b.max(initial=0)) + 1) >= 1 << 62:
        a, b = _dense(a), _dense(b)
    return a * (int(b.max(initial=0)) + 1) + b


def suffix_order(s: np.ndarray, enough: int, covered: int = 1) -> np.ndarray:
    """Places of a string of numbers above 0 in the order of their suffixes, over ``enough`` characters at least (each
    number stands for ``covered`` of them); the order of those that are equal so far is open."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _dense(_pair(_pair(t[sample], t[sample + 1]), t[sample + 2]))
    if int(names.max()) + 1 < len(sample) and 3 * covered < enough:
        rank = np.empty(len(sample), np.int64)
        rank[suffix_order(names + 1, enough, 3 * covered)] = np.arange(len(sample))
    else:
        rank = np.empty(len(sample), np.int64)
        rank[np.argsort(names)] = np.arange(len(sample))
    r = np.zeros(n + 3, np.int64)
    r[sample] = rank + 1
    rest = np.arange(0, n, 3)
    by_one = _pair(np.concatenate([t[rest], t[one]]), np.concatenate([r[rest + 1], r[one + 1]]))
    by_two = _pair(_pair(np.concatenate([t[rest], t[two]]), np.concatenate([t[rest + 1], t[two + 1]])), np.concatenate([r[rest + 2], r[two + 2]]))
    # Smaller ones of the rest are counted for the sample, smaller ones of the sample for the rest.
    m, place = len(rest), np.empty(n, np.int64)
    less = np.zeros(m, np.int64)
    for key, other in ((by_one, one), (by_two, two)):
        order = np.argsort(key)
        mine = order < m
        passed = np.cumsum(mine)
        of = other[order[~mine] - m]
        counted = of < n
        place[of[counted]] = r[of[counted]] - 1 + passed[~mine][counted]
        less[order[mine]] += np.flatnonzero(mine) - (passed[mine] - 1)
        own = order[mine]
    place[rest[own]] = np.arange(m) + less[own]
    return np.argsort(place)


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The windows that start at ``starts`` in suffix order, and where a run of equal ones begins."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_order(text.astype(np.int64) + 1, length)
    order = order[wanted[order]]
    word = np.zeros(len(text), np.uint64)
    for i in range(8):
        word[: len(text) - 7] |= text[i : len(text) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for at in [*range(0, length - 8, 8), length - 8]:
        w = word[order + at]
        new[1:] |= w[1:] != w[:-1]
    return order, np.flatnonzero(new)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _bytes_of(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's binary column as one array and the texts' ends in it."""
    c = b.column(column).cast(pa.large_binary())
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def _packed(a: np.ndarray) -> bytes:
    """An array's bytes, those of one significance side by side, compressed."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return struct.pack("<q", len(raw)) + (pa.Codec("zstd", 6).compress(raw, asbytes=True) if raw else b"")


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    (size,) = struct.unpack_from("<q", blob)
    raw = pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _groups(h: np.ndarray, groups: int) -> np.ndarray:
    """Groups of hashes, mixed once more: anchors have the least hashes of their windows, so most of them are small."""
    return ((_mixed(h * np.uint64(_MULTIPLIER)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _cut(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(group)), strict=True):
        if b > a:
            yield int(group[a]), slice(a, b)


_ASKED = "chunk bigint, grp bigint, hashes binary, docs binary"
_MARKS = "doc_id bigint, row bigint, hashes binary, hot binary"
_PIECES = "grp bigint, texts binary, sizes binary, counts binary, docs binary, rows binary, places binary"
_SPANS = "doc_id bigint, row bigint, start int, end int"


def _anchors_of(docs: DataFrame, groups: int) -> DataFrame:
    """Distinct anchors of each document, in blocks by group; group -1 has the block's documents (id, row)."""
    arrow = _arrow(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, hashes, owners, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal ids, hashes, owners, size, number
            h, d = np.concatenate(hashes), np.concatenate(owners).astype(np.int32)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
            h, d = h[keep], d[keep]
            chunk = part << 33 | number
            group = _groups(h, groups)
            order = np.argsort(group, kind="stable")
            h, d, group = h[order], d[order], group[order]
            # A group's sorted hashes by their differences, which are smaller numbers.
            step = np.diff(h, prepend=np.uint64(0))
            rows = []
            for g, s in _cut(group):
                step[s.start] = h[s.start]
                rows.append((chunk, g, _packed(step[s]), _packed(d[s])))
            rows.append((chunk, -1, b"", _packed(np.concatenate(ids))))
            ids, hashes, owners, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            data, ends = _bytes_of(b, 2)
            doc, _, _, _, h = pieces(data, ends)
            hashes.append(h)
            owners.append(doc + sum(map(len, ids)) // 2)
            ids.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype(np.int64).ravel())
            size += len(h)
            if size >= CHUNK:
                yield block()
        if ids:
            yield block()

    return docs.mapInArrow(run, _ASKED)


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one group of anchors, those of several documents: back to their blocks. The most frequent are told apart."""
    each = [np.cumsum(_unpacked(x, np.uint64)) for x in rows["hashes"]]
    _, at, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    often = n[at]
    out, start = [], 0
    for chunk, x, d in zip(rows["chunk"], each, rows["docs"], strict=True):
        count = often[start : start + len(x)]
        start += len(x)
        keep = count > 1
        # The lowest bit of what goes back says whether the anchor is a hot one.
        out.append((chunk, 0, _packed(x[keep]), _packed((_unpacked(d, np.int32) * 2 + (count > HOT))[keep].astype(np.int32))))
    return pd.DataFrame(out, columns=["chunk", "grp", "hashes", "docs"])


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's shared anchors by document."""
    own = rows[rows["grp"] < 0]
    ids = _unpacked(own["docs"].iloc[0], np.int64).reshape(-1, 2)
    rest = rows[rows["grp"] >= 0]
    h = np.concatenate([np.zeros(0, np.uint64), *[_unpacked(x, np.uint64) for x in rest["hashes"]]])
    d = np.concatenate([np.zeros(0, np.int32), *[_unpacked(x, np.int32) for x in rest["docs"]]])
    order = np.lexsort((h, d >> 1))
    h, d = h[order], d[order]
    out = [(*ids[k].tolist(), h[s].tobytes(), h[s][(d[s] & 1) > 0].tobytes()) for k, s in _cut(d >> 1)]
    return pd.DataFrame(out, columns=["doc_id", "row", "hashes", "hot"])


class _Held:
    """Distinct texts with the smallest id that has them, and where; what larger ids have is lost as a whole."""

    def __init__(self) -> None:
        self.texts: dict[bytes, list] = {}  # hash, place of the anchor, id, then row and place of each
        self.lost: list[int] = []  # id, row, place, length of each

    def put(self, text: bytes, h: int, anchor: int, doc: int, spots: list[int]) -> None:
        old = self.texts.get(text)
        if old is None:
            self.texts[text] = [h, anchor, doc, *spots]
            return
        if doc < old[2]:
            old[2], old[3:], spots, doc = doc, spots, old[3:], old[2]
        elif doc == old[2]:
            old += spots
            return
        n = len(text)
        for k in range(0, len(spots), 2):
            self.lost += (doc, spots[k], spots[k + 1], n)

    def split(self, hot: set[int]) -> None:
        """Texts around the given anchors are taken apart into single windows, dealt by their own hash."""
        # Also those that are one window already: it is dealt as the same window out of a longer text.
        for text in [t for t, v in self.texts.items() if v[0] in hot]:
            h, anchor, doc, *spots = self.texts.pop(text)
            for i in range(len(text) - LENGTH + 1):
                w = text[i : i + LENGTH]
                self.put(w, zlib.crc32(w) << 32, anchor - i, doc, [x + i * (k & 1) for k, x in enumerate(spots)])

    def rows(self, groups: int) -> list[tuple]:
        group = _groups(np.array([v[0] for v in self.texts.values()], np.uint64), groups)
        items, out = list(self.texts.items()), []
        order = np.argsort(group, kind="stable")
        for g, s in _cut(group[order]):
            # Alike texts side by side, for the shuffle's compression.
            some = sorted((items[i] for i in order[s]), key=lambda x: (x[1][0], x[0]))
            sizes = np.array([(len(t), v[1]) for t, v in some], np.uint8)
            counts = np.array([len(v) // 2 - 1 for _, v in some], np.int32)
            spots = np.array([x for _, v in some for x in v[3:]], np.int64)
            docs = np.array([v[2] for _, v in some], np.int64)
            texts = np.frombuffer(b"".join(t for t, _ in some), np.uint8)
            out.append((g, *map(_packed, (texts, sizes.T.ravel(), counts, docs, spots[::2], spots[1::2].astype(np.int32)))))
        if self.lost:
            a = np.array(self.lost, np.int64).reshape(-1, 4)
            out.append((-1, b"", _packed(a[:, 3].astype(np.uint8)), b"", _packed(a[:, 0]), _packed(a[:, 1]), _packed(a[:, 2].astype(np.int32))))
        return out


def _pieces_of(docs: DataFrame, groups: int) -> DataFrame:
    """``doc_id, row, data, hashes, hot`` to the distinct pieces with shared anchors, in blocks by group. Group -1 has
    the places of pieces that a smaller id of the same block has as well."""
    arrow = _arrow(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = _Held(), set()

        def block() -> pa.RecordBatch:
            nonlocal held
            held.split(hot)
            rows, held = held.rows(groups), _Held()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            data, ends = _bytes_of(b, 2)
            raw = data.tobytes()
            starts = np.concatenate([[0], ends[:-1]])
            doc, first, last, anchor, h = pieces(data, ends)
            ids, its = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marks = [np.frombuffer(x or b"", np.uint64) for x in b.column(3).to_pylist()]
            hot.update(np.frombuffer(b"".join(x or b"" for x in b.column(4).to_pylist()), np.uint64).tolist())
            # An anchor counts in the documents that it is marked in; a chance equality here lets in more, never less.
            salt = np.arange(len(ends), dtype=np.uint64) * np.uint64(_MULTIPLIER)
            wanted = np.concatenate([np.zeros(0, np.uint64), *[m ^ x for m, x in zip(marks, salt, strict=True)]])
            near = np.isin(h ^ salt[doc], wanted)
            cols = (doc, first, last, anchor, h, ids[doc], its[doc], starts[doc])
            for _, p, q, a, x, at, row, start in zip(*[c[near].tolist() for c in cols], strict=True):
                held.put(raw[p : q + LENGTH], x, a - p, at, [row, p - start])
                if len(held.texts) >= PIECES or len(held.lost) >= CHUNK:
                    yield block()
        if held.texts:
            yield block()

    return docs.mapInArrow(run, _PIECES)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under spans; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])[: len(starts)]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(ends)) - 1] if len(ends) else ends


def _spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans, those of one document that touch or overlap as one."""
    order = np.lexsort((start, row, doc))
    doc, row, start, end = (x[order] for x in (doc, row, start, end))
    number = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])[: len(doc)])
    # Documents one behind the other on one line.
    far = (int(end.max(initial=0)) + 2) * number
    a, b = _merged(start + far, end + far)
    at = np.searchsorted(start + far, a)
    return pd.DataFrame({"doc_id": doc[at], "row": row[at], "start": (a - far[at]).astype(np.int32), "end": (b - far[at]).astype(np.int32)})


def _recurring(data: np.ndarray, origin: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (last before first for none) of each piece that may recur in another piece: windows whose
    anchors stand at STEP neighbouring places share LENGTH - STEP + 1 bytes, and those bytes recur beside the anchor."""
    core = LENGTH - STEP + 1
    h = string_hashes(data, core)
    low = np.full(len(origin), np.iinfo(np.int64).max)
    high = np.full(len(origin), -1)
    for block in range(-(-(LENGTH - K + 1) // STEP)):
        # Windows whose anchor stands from STEP * block on, clipped to the windows that there are.
        a, b = np.maximum(anchor - STEP * block - STEP + 1, 0), np.minimum(anchor - STEP * block, count - 1)
        has = np.flatnonzero(a <= b)
        _, at, n = np.unique(h[(origin + anchor)[has] - STEP * block], return_inverse=True, return_counts=True)
        again = has[n[at] > 1]
        low[again], high[again] = np.minimum(low[again], a[again]), np.maximum(high[again], b[again])
    return low, high


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one group of pieces, the bytes under windows that a smaller id has too."""
    at = lambda c, kind: np.concatenate([_unpacked(x, kind) for x in rows[c]])
    docs, owners, places = at("docs", np.int64), at("rows", np.int64), at("places", np.int32).astype(np.int64)
    if rows["grp"].iloc[0] < 0:
        return _spans(docs, owners, places, places + at("sizes", np.uint8))
    # Lengths and anchors' places fit into a byte each, one block of them after the other.
    sizes, anchors = np.concatenate([_unpacked(x, np.uint8).reshape(2, -1) for x in rows["sizes"]], 1).astype(np.int64)
    n_spots = at("counts", np.int32)
    text = at("texts", np.uint8).tobytes()
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    piece = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, docs)
    anchor = np.zeros(len(known), np.int64)
    anchor[piece] = anchors
    length = np.array([len(x) for x in known], np.int64)
    data = np.frombuffer(b"".join(known), np.uint8)
    origin = np.cumsum(length) - length
    low, high = _recurring(data, origin, length - LENGTH + 1, anchor)
    some = np.flatnonzero(low <= high)
    runs = pd.DataFrame({"piece": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if len(some):
        # What is left of the pieces, a byte behind each that no text has: no window reaches over it.
        count = high[some] - low[some] + 1
        wide = count + LENGTH
        to = np.cumsum(wide) - wide
        index = np.repeat(origin[some] + low[some] - to, wide) + np.arange(int(wide.sum()))
        string = data[np.minimum(index, len(data) - 1)]
        string[to + wide - 1] = 255
        string = np.concatenate([string, np.full(8, 255, np.uint8)])
        of = np.repeat(np.arange(len(some)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        order, new = equal_windows(string, to[of] + inside)
        number = np.zeros(len(string), np.int64)
        number[to[of] + inside] = np.arange(len(of))
        window = number[order]
        own = least[some[of]]
        lowest = np.minimum.reduceat(own[window], new)
        gone = np.zeros(len(of), bool)
        gone[window] = np.repeat(lowest, np.diff(np.append(new, len(window)))) < own[window]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (gone[1:] != gone[:-1])]))
        last = np.append(first[1:], len(of)) - 1
        first, last = first[gone[first]], last[gone[first]]
        shift = low[some[of[first]]]
        runs = pd.DataFrame({"piece": some[of[first]], "a": inside[first] + shift, "b": inside[last] + shift + LENGTH})
    whole = np.repeat(docs > least[piece], n_spots)
    spots = pd.DataFrame({"piece": np.repeat(piece, n_spots), "doc": np.repeat(docs, n_spots), "row": owners, "place": places})
    part, full = spots[~whole].merge(runs, on="piece"), spots[whole]
    start = np.concatenate([part["place"] + part["a"], full["place"]])
    end = np.concatenate([part["place"] + part["b"], full["place"] + length[full["piece"]]])
    return _spans(np.concatenate([part["doc"], full["doc"]]), np.concatenate([part["row"], full["row"]]), start, end)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, start, end``: runs of bytes to remove; those of a document may still touch or overlap. ``row`` is
    the hash of the text."""
    spark = docs.sparkSession
    prepare(spark)
    bytes_of = F.col(text).cast("binary")
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), bytes_of.alias("data")).filter("doc_id is not null and octet_length(data) >= 50")
    groups = 8 + (given.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // GROUP_BYTES
    marks = _marks(given, groups)
    # In a fixed order: what a task makes of its documents must be the same if it runs again.
    marked = given.join(marks, ["doc_id", "row"]).select("doc_id", "row", "data", "hashes", "hot").sortWithinPartitions("doc_id", "row")
    found = _pieces_of(marked, groups)
    spread = F.when(F.col("grp") < 0, -1 - F.abs(F.xxhash64("docs")) % groups).otherwise(F.col("grp"))
    spans = settle(found.withColumn("grp", spread).groupBy("grp").applyInPandas(_repeats, _SPANS), "spans")
    del marked, found
    release(spark, marks)
    return spans


def _marks(given: DataFrame, groups: int) -> DataFrame:
    """The anchors of each document that other documents have too. Nothing of the way there is left on disk."""
    spark = given.sparkSession
    asked = settle(_anchors_of(given, groups), "anchors")
    shared = settle(asked.filter("grp >= 0").groupBy("grp").applyInPandas(_shared, _ASKED), "shared")
    owners = settle(asked.filter("grp < 0"), "owners")
    release(spark, asked)
    # Rows that are equal in id and text have equal marks.
    marks = settle(shared.unionByName(owners).groupBy("chunk").applyInPandas(_by_document, _MARKS).dropDuplicates(["doc_id", "row"]), "marks")
    release(spark, shared, owners)
    return marks


def _result(data: np.ndarray, spans: np.ndarray) -> tuple[int, int, int, str]:
    if not len(spans):
        return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
    a, b = _merged(spans >> 32, spans & 0xFFFFFFFF)
    gone = np.zeros(len(data) + 1, np.int32)
    gone[a] += 1
    gone[b] -= 1
    return len(data), int((b - a).sum()), len(a), hashlib.sha256(data[np.cumsum(gone[:-1]) == 0].tobytes()).hexdigest()


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its bytes, how many are removed, in how many runs, and the digest of the rest.

    Null and short texts lose nothing (null counts as empty). A row without an id neither loses bytes nor takes any from
    others; rows that share an id lose nothing to each other. Repeated rows give repeated rows. Extra columns are not
    read; an empty table gives no rows.
    """
    spans = repeated_spans(docs, doc_id, text)
    release(docs.sparkSession)
    row = F.xxhash64(text)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row.alias("row"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"))
    # A document's spans: no more than its bytes.
    both_ends = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")
    lists = spans.groupBy("doc_id", "row").agg(F.collect_list(both_ends).alias("spans"))
    both = own.join(lists, ["doc_id", "row"], "left").select("doc_id", "data", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _bytes_of(b, 1)
            begins = np.concatenate([[0], ends[:-1]])
            lists = b.column(2)
            edges, spans = lists.offsets.to_numpy(), lists.values.to_numpy()
            got = [_result(data[i:j], spans[k:m]) for i, j, k, m in zip(begins, ends, edges, edges[1:], strict=False)]
            cols = list(zip(*got, strict=True)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]], schema=arrow)

    return both.mapInArrow(run, schema)
