"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes, each with a mark that its word equals the word before, become short vectors; learned filters eight
bytes wide run over all of them in steps of four, so neighbouring filter places overlap and every byte is covered.
Filter responses are max-pooled over chunks of 128 places, the chunks' values are combined into their maximum and mean,
and one dense unit gives the probability. Training (Adam, cross entropy) uses a bounded sample of labelled rows on the
driver; scoring is a map over batches of whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import by_row, crc_bucket

EMBED, WIDTH, STEP, FILTERS, POOL = 6, 8, 4, 24, 128
#: Labelled documents and characters of each that training takes at most. A longer one is trained on its first, middle
#: and last parts; scoring always reads all.
TRAIN_DOCS, TRAIN_CHARS, EPOCHS, RATE, SEED = 1_600, 4_096, 5, 0.01, 5
#: Few examples are gone over more often, until there were so many steps.
MIN_STEPS, MOST_EPOCHS = 300, 60
#: Conv places that one matrix product handles; bounds memory on long texts.
BLOCK = 32_768


def symbols(data: bytes) -> np.ndarray:
    """Codes 0 to 511: the byte, plus 256 where its word equals the previous word. Padded with blanks at the end so
    that at least one filter place exists and the last bytes are covered."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    out = np.full(max(WIDTH, -(-max(0, n - WIDTH) // STEP) * STEP + WIDTH), 32, np.int64)
    if not n:
        return out
    out[:n] = b
    # Word number of each byte and a sum hash of each word; equal neighbours of two bytes or more are marked.
    word = np.cumsum(b <= 32)
    pos = np.arange(n)
    first = np.concatenate([[-1], np.flatnonzero(b <= 32)])  # the blank before each word
    weight = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * ((pos - first[word]).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    weight[b <= 32] = 0
    mixed = weight ^ (weight >> np.uint64(29))
    h = np.add.reduceat(mixed, np.maximum(first, 0))
    size = np.bincount(word, minlength=len(first))
    same = np.zeros(len(first), bool)
    same[1:] = (h[1:] == h[:-1]) & (size[1:] > 2)
    out[:n] += 256 * (same[word] & (b > 32))
    return out


@dataclass
class Net:
    embed: np.ndarray  # 512 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # one number

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.offset]

    def _places(self, codes: np.ndarray) -> np.ndarray:
        x = self.embed[codes]
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, 0)[::STEP]  # places x EMBED x WIDTH
        return view.transpose(0, 2, 1).reshape(len(view), WIDTH * EMBED)

    def chunks(self, codes: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses of each chunk of a text."""
        places = (len(codes) - WIDTH) // STEP + 1
        out = []
        for k in range(0, places, BLOCK):
            m = min(BLOCK, places - k)
            r = self._places(codes[k * STEP : (k + m - 1) * STEP + WIDTH]) @ self.filters
            pad = (-m) % POOL
            if pad:
                r = np.concatenate([r, np.repeat(r[-1:], pad, 0)])
            out.append(r.reshape(-1, POOL, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def score(self, text: str | None) -> float:
        c = self.chunks(symbols((text or "").encode("utf-8", "surrogatepass")))
        z = float(np.concatenate([c.max(0), c.mean(0)]) @ self.dense + self.offset[0])
        return 1 / (1 + float(np.exp(-max(-60.0, min(60.0, z)))))


def train(rows: list[tuple[str | None, int]], seed: int = SEED) -> Net:
    """Fit the network. Classes weigh equally; without rows of both classes the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(
        rng.normal(0, 0.5, (512, EMBED)).astype(f32),
        rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(f32),
        np.zeros(1, f32),
    )
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        net.dense[:] = 0
        net.offset[0] = 0.0 if not rows else 4.0 if ones else -4.0
        return net
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    codes = [symbols((t or "").encode("utf-8", "surrogatepass")) for t, _ in rows]
    params = net.params()
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    grads = [np.zeros_like(p) for p in params]
    step, batch = 0, min(16, len(rows))
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-MIN_STEPS * batch // len(rows))))
    total = epochs * len(rows)
    done = 0
    for _ in range(epochs):
        for n, i in enumerate(rng.permutation(len(rows))):
            c, y = codes[i], rows[i][1]
            x = net._places(c)
            r = x @ net.filters
            k = len(r)
            pools = -(-k // POOL)
            pad = pools * POOL - k
            padded = np.concatenate([r, np.full((pad, FILTERS), -np.inf, f32)]) if pad else r
            arg = padded.reshape(pools, POOL, FILTERS).argmax(1) + np.arange(pools)[:, None] * POOL
            val = np.take_along_axis(r, arg, 0) + net.bias
            act = np.maximum(val, 0)
            top = act.argmax(0)
            feats = np.concatenate([act.max(0), act.mean(0)])
            p = 1 / (1 + np.exp(-np.clip(feats @ net.dense + net.offset[0], -30, 30)))
            dz = f32((p - y) * weight[y])
            grads[3] += dz * feats
            grads[4] += dz
            da = np.tile(dz * net.dense[FILTERS:] / pools, (pools, 1))
            da[top, np.arange(FILTERS)] += dz * net.dense[:FILTERS]
            da *= val > 0
            grads[2] += da.sum(0)
            for q in range(pools):
                rows_q = arg[q]
                grads[1] += x[rows_q].T * da[q]
                gx = (net.filters * da[q]).T.reshape(FILTERS, WIDTH, EMBED)
                at = rows_q[:, None] * STEP + np.arange(WIDTH)
                np.add.at(grads[0], c[at].ravel(), gx.reshape(-1, EMBED))
            if n % batch == batch - 1:
                step += 1
                rate = RATE * (1 - 0.9 * done / total)
                for p_, g, a, b in zip(params, grads, m1, m2, strict=True):
                    g /= batch
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                    g[:] = 0
            done += 1
    return net


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int, most_chars: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of labelled rows, half of each class where there are enough, in a hash order of the ids.

    Rows with a null id or label are no examples. Ids go first: only the texts of the chosen rows travel, and of one
    longer than ``most_chars`` its first, middle and last parts, so what reaches the driver is bounded.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(crc_bucket("doc_id", parts) != held)
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(most // 2) for y in (0, 1)]
    # At most ``most`` ids: a bounded broadcast.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    t, part = F.col(text), most_chars // 3
    middle = F.substring(t, (F.length(t) / 2).cast("int"), F.lit(part))
    short = F.when(F.length(t) > most_chars, F.concat(F.substring(t, 1, part), middle, F.substring(t, -part, part))).otherwise(t)
    got = docs.select(F.col(doc_id).alias("doc_id"), short.alias("text")).join(picked, "doc_id").orderBy("doc_id", "text").limit(most)
    return [(r["text"], r["y"]) for r in got.select("text", "y", "doc_id").collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Net:
    return train(training_rows(docs, labels, "quality", 5, 0, TRAIN_DOCS, TRAIN_CHARS, doc_id, text))


def score_quality(docs: DataFrame, net: Net, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text. Null texts count as empty and get the empty text's score; repeated rows are scored alike;
    extra columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(ids: list, texts: list) -> list[tuple]:
        made = shared.value
        return [(i, s, int(s >= cut)) for i, s in zip(ids, map(made.score, texts), strict=True)]

    scored = by_row(docs, [doc_id, text], "doc_id bigint, score double, predicted int", rows)
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, net: Net, cut: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score reaches the cut, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.filter(score(F.col(text)) >= cut)
