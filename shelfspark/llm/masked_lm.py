"""Masked pseudo-likelihood scores from a bidirectional window network.

All distinct words of the corpus are counted in a table. The frequent ones get a leaf each, the others share leaves by
hash, within which every distinct word is as likely. The network sees two words on each side of a masked word (embeddings by
place), one hidden layer, and predicts the word by a tree: 32 branches, and 32 branches of each, both from the context; within
the last branch, which holds one of the thousand most frequent words and rarer ones, leaves follow the corpus counts. Every
task trains a copy of the network on its own documents, all of them, and the copies are averaged by their words, round by
round. The score of a document is the sum of the conditional log-probabilities of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import groups

#: Leaves of frequent words, and those that the other words share.
FREQUENT = RARE = 1 << 15
LEAVES = FREQUENT + RARE
BRANCHES = 32
EMBEDDINGS = 1 << 12
WIDTH = 8
HIDDEN = 24
SIDES = (-2, -1, 1, 2)
BATCH = 1024
#: Words counted together before they leave a task.
COUNTED = 1 << 20
SHAPES = ((EMBEDDINGS + 1, WIDTH), (len(SIDES) * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, BRANCHES), (BRANCHES,), (BRANCHES, HIDDEN), (HIDDEN, BRANCHES), (BRANCHES, BRANCHES))
#: Weights travel as integers of this resolution, so that their sums do not depend on the order of tasks.
_UNIT = float(1 << 24)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """``(word, n)``: every distinct word (runs without white space, A-Z lower-cased; its 64-bit hash) and how often it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for group in groups(batch.column(0), lower=True):
                held.append(group.hashes())
                n += len(held[-1])
                if n >= COUNTED:
                    yield _counted(held)
                    held, n = [], 0
        if held:
            yield _counted(held)

    return cut(texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
    words, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


@dataclass
class Leaves:
    """The tree's leaves: the frequent words in order of their hashes with their leaves, counts, and log-shares of words in them."""

    words: np.ndarray
    leaf: np.ndarray
    counts: np.ndarray
    inner: np.ndarray  # log P(word | leaf)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return (FREQUENT + hashes % np.uint64(RARE)).astype(np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.leaf[at], FREQUENT + (hashes % np.uint64(RARE)).astype(np.int64)).astype(np.int32)

    def branch_shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log P(first branch), log P(second | first), log P(leaf | both), with one pseudo-count a leaf, by corpus counts."""
        held, leaf = self.counts + 1.0, np.arange(LEAVES)
        node = leaf % (BRANCHES * BRANCHES)
        nodes = np.bincount(node, held, minlength=BRANCHES * BRANCHES)
        both = nodes.reshape(BRANCHES, BRANCHES).T  # [first, second]
        return np.log(both.sum(axis=1) / both.sum()), np.log(both / both.sum(axis=1, keepdims=True)), np.log(held / nodes[node])


def leaves_of(vocab: DataFrame) -> Leaves:
    """Two bounded pieces come to the driver: the FREQUENT most frequent words, and two numbers of each shared leaf."""
    top = vocab.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    counts, inner = np.zeros(LEAVES), np.zeros(LEAVES)
    order = np.lexsort((words.view(np.int64), -n))
    counts[: len(n)] = n[order]
    by_hash = np.argsort(words[order])
    if len(n) == FREQUENT:
        last = order[-1]
        rest = vocab.where((F.col("n") < int(n[last])) | ((F.col("n") == int(n[last])) & (F.col("word") > int(words.view(np.int64)[last]))))
        shared = rest.groupBy((F.col("word").bitwiseAND(F.lit(RARE - 1))).alias("r")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
        r = shared.column("r").to_numpy() + FREQUENT
        counts[r], inner[r] = shared.column("n").to_numpy(), -np.log(shared.column("k").to_numpy())
    return Leaves(words[order][by_hash], by_hash, counts, inner)


def initial(leaves: Leaves, seed: int = 1) -> list[np.ndarray]:
    """Random weights; the biases start at the corpus shares, so that the untrained tree is the context-free one."""
    rng = np.random.default_rng(seed)
    scale = (0.3, 0.3, 0.0, 0.02, 0.0, 0.0, 0.02, 0.0)
    weights = [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(SHAPES, scale, strict=True)]
    first, second, _ = leaves.branch_shares()
    weights[4], weights[5], weights[7] = first.astype(np.float32), np.ones(SHAPES[5], np.float32), second.astype(np.float32)
    return weights


def split_weights(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def contexts(leaf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Embedding rows around each word of several texts; beyond a text's ends stands the last row."""
    sizes = np.diff(edges)
    line = np.full(len(leaf) + 2 * (len(sizes) + 1), EMBEDDINGS, np.int32)
    at = np.arange(len(leaf)) + np.repeat(2 * (1 + np.arange(len(sizes))), sizes)
    line[at] = leaf % EMBEDDINGS
    return line[at[:, None] + np.array(SIDES)[None, :]]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def forward(weights: list[np.ndarray], rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(inputs, hidden, gated hidden, log P of first branches, log P of second branches under the given first ones)."""
    e, w, b, v, c, g, u, d = weights
    x = e[rows].reshape(len(rows), -1)
    h = np.tanh(x @ w + b)
    gated = h * g[first]
    return x, h, gated, _log_softmax(h @ v + c), _log_softmax(gated @ u + d[first])


class Trainer:
    """Adaptive gradient steps on a copy of the weights."""

    def __init__(self, weights: list[np.ndarray], rate: float = 0.2):
        self.weights, self.rate, self.words = [w.copy() for w in weights], rate, 0
        self.seen = [np.full(w.shape, 1e-2, np.float32) for w in weights]

    def learn(self, rows: np.ndarray, leaf: np.ndarray) -> None:
        for lo in range(0, len(rows), BATCH):
            self.step(rows[lo : lo + BATCH], leaf[lo : lo + BATCH])
        self.words += len(rows)

    def step(self, rows: np.ndarray, leaf: np.ndarray) -> None:
        _, w, _, v, _, g, u, _ = self.weights
        first, second, every = leaf % BRANCHES, leaf // BRANCHES % BRANCHES, np.arange(len(rows))
        x, h, gated, p, q = forward(self.weights, rows, first)
        dz, dy = np.exp(p), np.exp(q)
        dz[every, first] -= 1
        dy[every, second] -= 1
        dz /= len(rows)
        dy /= len(rows)
        dgated = dy @ u.T
        one = np.zeros((len(rows), BRANCHES), np.float32)
        one[every, first] = 1
        dh = (dz @ v.T + dgated * g[first]) * (1 - h * h)
        dx = (dh @ w.T).reshape(-1, WIDTH)
        place = (rows.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).reshape(-1)
        de = np.bincount(place, dx.reshape(-1), minlength=(EMBEDDINGS + 1) * WIDTH).reshape(-1, WIDTH)
        grads = (de, x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0), one.T @ (dgated * h), gated.T @ dy, one.T @ dy)
        for weight, seen, grad in zip(self.weights, self.seen, grads, strict=True):
            grad = grad.astype(np.float32)
            seen += grad * grad
            weight -= self.rate * grad / np.sqrt(seen)


def train_round(texts: DataFrame, leaves: Leaves, weights: list[np.ndarray]) -> list[np.ndarray]:
    """One pass over all documents: every task trains a copy, the copies are averaged by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(weights)
        for batch in batches:
            for group in groups(batch.column(0), lower=True):
                leaf = leaves.of(group.hashes())
                trainer.learn(contexts(leaf, group.edges), leaf)
        if trainer.words:
            flat = np.concatenate([w.reshape(-1) for w in trainer.weights])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.round(flat * _UNIT).astype(np.int64)), pa.array(np.full(len(flat), trainer.words, np.int64))],
                names=["i", "w", "n"],
            )

    sums = texts.select("text").mapInArrow(run, "i int, w long, n long").groupBy("i").agg(
        F.sum(F.col("w").cast("decimal(20,0)") * F.col("n")).cast("double").alias("w"), F.sum("n").alias("n")
    )
    flat = np.concatenate([w.reshape(-1) for w in weights]).astype(np.float64)
    got = sums.toArrow()  # as many rows as the network has weights
    if got.num_rows:
        flat[got.column("i").to_numpy()] = got.column("w").to_numpy() / got.column("n").to_numpy() / _UNIT
    return split_weights(flat.astype(np.float32))


def word_scores(leaves: Leaves, weights: list[np.ndarray], leaf: np.ndarray, edges: np.ndarray, within: np.ndarray) -> np.ndarray:
    """log P of each word under its context; ``within`` is log P(word | last branch) by leaf."""
    rows, out = contexts(leaf, edges), np.empty(len(leaf))
    for lo in range(0, len(leaf), BATCH):
        part = leaf[lo : lo + BATCH]
        first, second, every = part % BRANCHES, part // BRANCHES % BRANCHES, np.arange(len(part))
        *_, p, q = forward(weights, rows[lo : lo + BATCH], first)
        out[lo : lo + BATCH] = p[every, first] + q[every, second] + within[part]
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` per row of docs; the mean is NULL for texts without words.

    NULL and empty texts score zero; very long texts are taken whole, in groups of their own; repeated rows score alike and
    count each in counts and training; an empty table gives no rows; other columns are ignored. Words of equal count are
    taken in order of their hashes. Scores are rounded to three decimals; they depend on which documents share a task, as
    the copies of the network do.
    """
    texts = _texts(docs, id_col, text_col)
    leaves = leaves_of(vocabulary(texts))
    weights = initial(leaves)
    for _ in range(rounds):
        weights = train_round(texts, leaves, weights)
    within = leaves.branch_shares()[2] + leaves.inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch.column(1), lower=True):
                logs = word_scores(leaves, weights, leaves.of(group.hashes()), group.edges, within)
                n = np.diff(group.edges)
                total = np.round(np.diff(np.concatenate([[0.0], np.cumsum(logs)])[group.edges]), 3)
                mean = np.round(total / np.maximum(1, n), 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, len(group)), pa.array(n.astype(np.int64)), pa.array(total), pa.array(mean, mask=n == 0)],
                    names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
                )

    return texts.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")
