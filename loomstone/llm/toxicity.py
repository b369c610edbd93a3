"""Operator 6, toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's inputs are a learned embedding of the word, the mean of learned embeddings of its character 4-grams (both hashed), and
its evidence: class log-odds of the word and of its 4-grams (largest and mean) from hashed tables, and how often it was seen.
Network and embeddings are trained together, tables are counted, on a bounded sample of labelled documents, in numpy, on the
driver. The network reads windows of `WINDOW` words, `STRIDE` apart so that they overlap and cover every word of a text; a
document's score is the calibrated score of its highest window.

Sample bounds: `most_toxic` and `most_clean` labelled documents (chosen by a hash of doc_id, whole texts of at most
`sample_bytes` bytes). Held-out rows are never learned from. Out-of-fold tables feed the network in training, so that it
learns how far to trust a word that the tables know from other documents; one fold is kept from the network, which is
calibrated on it.

Defined results: a null or empty text, or one without words, has the score of a text without any evidence; repeated rows
score alike; very long texts are scored whole, one at a time; a null doc_id is scored, not held out and not learned from; with no
labels of both kinds every score is the share of toxic labels (0 without labels); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import _text as X
from loomstone.llm._runtime import ship
from loomstone.llm.language_id import held_out

WINDOW, STRIDE, HIDDEN, FOLDS = 24, 16, 8, 5
#: Places of the evidence tables and of the embeddings, numbers of evidence and of each embedding.
WORD_BITS, GRAM_BITS, SLOT_BITS, EVIDENCE, DIM = 18, 17, 14, 4, 8
INPUTS = EVIDENCE + 2 * DIM
PRIOR = 3.0
SLICE = 1 << 19
_TABLE = X.word_bytes("alnum")


class Words:
    """The words of a list of texts with the hashed places of each and of its 4-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        lens = np.diff(offsets)
        # A separator after each text, so that no word or gram runs over.
        at = np.arange(int(lens.sum())) + np.repeat(np.arange(n), lens)
        low = np.full(int(lens.sum()) + n + 4, 0x20, np.uint8)
        low[at] = X._LOWER[data]
        offs = np.append(offsets[:-1] + np.arange(n), len(low))
        self.starts, self.ends, self.first = X.words(low, offs, _TABLE)
        h = X.range_hashes(low, self.starts, self.ends, lower=False)
        self.place = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.slot = (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        m = _TABLE[low]
        whole = m[:-3] & m[1:-2] & m[2:-1] & m[3:]
        b = low.astype(np.uint32)
        g = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
        gram = ((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
        # Words under 4 bytes have one gram: themselves, at another place.
        short = np.flatnonzero(self.ends - self.starts < 4)
        whole[self.starts[short]] = True
        gram[self.starts[short]] = (h[short] >> np.uint64(40)).astype(np.int64) & ((1 << GRAM_BITS) - 1)
        self.gram_at = np.flatnonzero(whole)
        self.gram = gram[self.gram_at]
        self.gram_first = np.searchsorted(self.gram_at, self.starts)

    def grams(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram slots, first of each) of the words at the given places."""
        ends = np.append(self.gram_first[1:], len(self.gram))
        n = (ends - self.gram_first)[at]
        first = np.cumsum(n) - n
        return self.gram[np.repeat(self.gram_first[at] - first, n) + np.arange(n.sum())] & ((1 << SLOT_BITS) - 1), first

    def evidence(self, t: Tables, fold: np.ndarray | None = None) -> np.ndarray:
        """The evidence of every word; fold: per word, which of the stacked tables to use."""
        if not len(self.starts):
            return np.zeros((0, EVIDENCE), np.float32)
        word = self.place if fold is None else self.place + (fold << WORD_BITS)
        n = np.diff(np.append(self.gram_first, len(self.gram)))
        gram = self.gram if fold is None else self.gram + np.repeat(fold << GRAM_BITS, n)
        v = t.gram[gram]
        out = np.empty((len(self.starts), EVIDENCE), np.float32)
        out[:, 0] = t.word[word]
        out[:, 1] = np.maximum.reduceat(v, self.gram_first)
        out[:, 2] = np.add.reduceat(v, self.gram_first) / n
        out[:, 3] = t.known[word]
        return out


class Tables:
    """Class log-odds by hashed word and gram, from document counts (first axis: clean, toxic): the toxic count against what
    the clean rate lets expect, both with PRIOR counts more, so that a word seen once says little."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, docs: np.ndarray):
        def odds(c):
            return (np.log((c[1] + PRIOR) / (c[0] * (docs[1] + 1.0) / (docs[0] + 1.0) + PRIOR)) / 2).astype(np.float32)

        self.word, self.gram = odds(words), odds(grams)
        self.known = np.log1p(words.sum(0)).astype(np.float32) / 4

    @classmethod
    def stack(cls, tables: list[Tables]) -> Tables:
        out = cls.__new__(cls)
        for k in ("word", "gram", "known"):
            setattr(out, k, np.concatenate([getattr(t, k) for t in tables]))
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of every window: each STRIDE words, the last one ending with the text."""
    n = np.diff(first)
    many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first[doc] + np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0)), np.minimum(n[doc], WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers (forward, backward), additive attention over their states, one logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, INPUTS
        self.p = {}
        for s in "fb":
            self.p |= {f"W{s}": r.normal(0, 0.4, (d, 3 * h)), f"U{s}": r.normal(0, 0.4, (h, 3 * h)), f"c{s}": np.zeros(3 * h)}
        # Embeddings begin at zero, so that a word which training never met adds nothing.
        self.e = {k: np.zeros((1 << SLOT_BITS, DIM), np.float32) for k in ("word", "gram")}
        self.p |= {"A": r.normal(0, 0.4, (2 * h, h)), "a": np.zeros(h), "v": r.normal(0, 0.4, h), "o": r.normal(0, 0.4, 2 * h), "k": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, evidence: np.ndarray, slot: np.ndarray, gram: np.ndarray, gram_first: np.ndarray) -> np.ndarray:
        """The inputs of words: evidence, the word's embedding, and the mean of its grams' embeddings."""
        if not len(slot):
            return np.zeros((0, INPUTS), np.float32)
        n = np.diff(np.append(gram_first, len(gram)))[:, None]
        return np.concatenate([evidence, self.e["word"][slot], np.add.reduceat(self.e["gram"][gram], gram_first) / n], axis=1, dtype=np.float32)

    def _run(self, side: str, proj: np.ndarray, at: np.ndarray, on: np.ndarray, keep: bool):
        """States (T, N, h) of one direction. proj: input projections of all words; at: (T, N) word places; on: which are in the window."""
        h, u_ = HIDDEN, self.p["U" + side]
        t_, n_ = at.shape
        state = np.zeros((n_, h), np.float32)
        states, trace = np.empty((t_, n_, h), np.float32), []
        for t in range(t_) if side == "f" else range(t_ - 1, -1, -1):
            x = proj[at[t]]
            q = state @ u_
            g = _sigmoid(x[:, : 2 * h] + q[:, : 2 * h])
            cand = np.tanh(x[:, 2 * h :] + g[:, :h] * q[:, 2 * h :])
            new = cand + g[:, h:] * (state - cand)
            m = on[t][:, None]
            if keep:
                trace.append((t, state, g, cand, q[:, 2 * h :]))
            state = np.where(m, new, state)
            states[t] = state
        return states, trace

    def forward(self, inputs: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        p = self.p
        t_ = int(length.max())
        steps = np.arange(t_)[:, None]
        on = steps < length[None, :]
        at = np.where(on, start[None, :] + steps, start[None, :])
        runs = {s: self._run(s, inputs @ p["W" + s] + p["c" + s], at, on, keep) for s in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        act = np.tanh(both @ p["A"] + p["a"])
        e = np.where(on, act @ p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * both).sum(0)
        z = pooled @ p["o"] + p["k"][0]
        return z, (at, on, runs, both, act, alpha, pooled)

    def gradients(self, inputs, start, length, y):
        p, h = self.p, HIDDEN
        z, (at, on, runs, both, act, alpha, pooled) = self.forward(inputs, start, length, keep=True)
        dz = ((_sigmoid(z) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dz, "k": np.array([dz.sum()])}
        dp = dz[:, None] * p["o"]
        da = (both * dp).sum(2)
        de = alpha * (da - (alpha * da).sum(0))
        dact = de[:, :, None] * p["v"] * (1 - act**2)
        g["v"] = (act * de[:, :, None]).sum((0, 1))
        g["A"] = both.reshape(-1, 2 * h).T @ dact.reshape(-1, h)
        g["a"] = dact.sum((0, 1))
        dboth = alpha[:, :, None] * dp + dact @ p["A"].T
        din = np.zeros(inputs.shape, np.float32)
        for s, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            dw, du, dc = np.zeros_like(p["W" + s]), np.zeros_like(p["U" + s]), np.zeros_like(p["c" + s])
            dstate = np.zeros((len(y), h), np.float32)
            for t, prev, gate, cand, qn in reversed(runs[s][1]):
                dstate = dstate + part[t]
                m = on[t][:, None]
                dnew = np.where(m, dstate, 0)
                upd = gate[:, h:]
                dcand = dnew * (1 - upd) * (1 - cand**2)
                dupd = dnew * (prev - cand) * upd * (1 - upd)
                dres = dcand * qn * gate[:, :h] * (1 - gate[:, :h])
                dx = np.concatenate([dres, dupd, dcand], axis=1)
                dq = np.concatenate([dres, dupd, dcand * gate[:, :h]], axis=1)
                dw += inputs[at[t]].T @ dx
                din[at[t]] += dx @ p["W" + s].T  # each window has rows of its own; outside it dx is zero
                du += prev.T @ dq
                dc += dx.sum(0)
                dstate = np.where(m, dnew * upd, dstate) + dq @ p["U" + s].T
            g["W" + s], g["U" + s], g["c" + s] = dw, du, dc
        return g | {"inputs": din}

    def loss(self, examples: Examples, y: np.ndarray, batch: int = 1024) -> float:
        """Mean logistic loss, both classes weighed alike."""
        w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        total = 0.0
        for lo in range(0, len(y), batch):
            i = np.arange(lo, min(lo + batch, len(y)))
            evidence, slot, gram, first, length = examples.take(i)
            z = self.forward(self.embed(evidence, slot, gram, first), np.arange(len(i)) * WINDOW, length)[0]
            total += float((w[i] * np.logaddexp(0, np.where(y[i] == 1, -z, z))).sum())
        return total

    def fit(self, examples: Examples, y: np.ndarray, other: Examples, other_y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, slow: float = 0.3, patience: int = 4, seed: int = 5):
        """Adam until the loss on other examples has not fallen for `patience` epochs of 30 steps or all examples at least; the
        best state stays. Embeddings learn at `slow` times the rate."""
        r = np.random.default_rng(seed)
        learned = self.p | self.e
        mean, var, n = {k: np.zeros_like(v) for k, v in learned.items()}, {k: np.zeros_like(v) for k, v in learned.items()}, 0
        best, kept, since = self.loss(other, other_y), {k: v.copy() for k, v in learned.items()}, 0
        for _ in range(epochs):
            order = np.concatenate([r.permutation(len(y)) for _ in range(max(1, 30 * batch // len(y)))])
            for lo in range(0, len(order), batch):
                i = order[lo : lo + batch]
                n += 1
                evidence, slot, gram, first, length = examples.take(i)
                got = self.gradients(self.embed(evidence, slot, gram, first), np.arange(len(i)) * WINDOW, length, y[i])
                din, many = got.pop("inputs"), np.diff(np.append(first, len(gram)))
                got["word"], got["gram"] = np.zeros_like(self.e["word"]), np.zeros_like(self.e["gram"])
                np.add.at(got["word"], slot, din[:, EVIDENCE : EVIDENCE + DIM])
                np.add.at(got["gram"], gram, np.repeat(din[:, EVIDENCE + DIM :] / many[:, None], many, axis=0))
                for k, x in got.items():
                    mean[k] += 0.1 * (x - mean[k])
                    var[k] += 0.001 * (x * x - var[k])
                    by = rate * slow if k in self.e else rate
                    learned[k] -= (by * (mean[k] / (1 - 0.9**n)) / (np.sqrt(var[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
            now, since = self.loss(other, other_y), since + 1
            if now < best:
                best, kept, since = now, {k: v.copy() for k, v in learned.items()}, 0
            if since >= patience:
                break
        for k, v in kept.items():
            learned[k][...] = v


class Examples:
    """Windows to train on: per window WINDOW words (the last one repeated past its end) with evidence, slots and gram slots."""

    def __init__(self):
        self.evidence, self.slot, self.gram, self.many, self.length = [], [], [], [], []

    def add(self, w: Words, evidence: np.ndarray, start: np.ndarray, length: np.ndarray):
        at = (start[:, None] + np.minimum(np.arange(WINDOW), length[:, None] - 1)).ravel()
        gram, first = w.grams(at)
        self.evidence.append(evidence[at].reshape(-1, WINDOW, EVIDENCE))
        self.slot.append(w.slot[at].reshape(-1, WINDOW).astype(np.int32))
        self.many.append(np.diff(np.append(first, len(gram))).reshape(-1, WINDOW).astype(np.int32))
        self.gram.append(gram.astype(np.int32))
        self.length.append(length)

    def close(self) -> Examples:
        for k in ("evidence", "slot", "gram", "many", "length"):
            setattr(self, k, np.concatenate(getattr(self, k)))
        n = self.many.sum(1, dtype=np.int64)
        self.first = np.cumsum(n) - n
        return self

    def take(self, i: np.ndarray):
        n = self.many[i].sum(1, dtype=np.int64)
        gram = self.gram[np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        many = self.many[i].ravel()
        return self.evidence[i].reshape(-1, EVIDENCE), self.slot[i].ravel(), gram, np.cumsum(many) - many, self.length[i]


class Model:
    """Tables, network and calibration (score = sigmoid(slope * z + level) of the highest window's z)."""

    def __init__(self, tables=None, network=None, slope=1.0, level=0.0, nothing=0.0):
        self.tables, self.network, self.slope, self.level, self.nothing = tables, network, slope, level, nothing

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, -np.inf)
        if self.network is not None:
            w = Words(data, offsets)
            highest(self.network, w, w.evidence(self.tables), z)
        return np.where(np.isfinite(z), _sigmoid(self.slope * np.where(np.isfinite(z), z, 0) + self.level), self.nothing)


def highest(network: Network, w: Words, evidence: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Put each document's highest window score into z; returns all windows' scores."""
    start, length, doc = windows(w.first)
    inputs = network.embed(evidence, w.slot, w.gram & ((1 << SLOT_BITS) - 1), w.gram_first)
    if not len(start):
        return np.zeros(0)
    got = np.concatenate([network.forward(inputs, start[i : i + 8192], length[i : i + 8192])[0] for i in range(0, len(start), 8192)])
    np.maximum.at(z, doc, got)
    return got


def train(texts: list[str], toxic: np.ndarray, share: float | None = None, **learning) -> Model:
    """Fit on texts with 0/1 labels (folds go by place); share: of toxic documents where the sample is not in proportion;
    learning: of Network.fit()."""
    if share is None:
        share = float(toxic.mean()) if len(toxic) else 0.0
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(nothing=share)
    fold = np.zeros(len(texts), np.int64)
    for value in (0, 1):  # alike shares in all folds
        own = np.flatnonzero(toxic == value)
        fold[own] = np.arange(len(own)) % FOLDS
    counts_w = np.zeros((FOLDS, 2, 1 << WORD_BITS), np.int32)
    counts_g = np.zeros((FOLDS, 2, 1 << GRAM_BITS), np.int32)
    docs = np.zeros((FOLDS, 2))
    step = 100

    def parts():
        """The words of the texts, some texts at a time: what is kept between passes does not grow with the sample's bytes."""
        for lo in range(0, len(texts), step):
            yield lo, Words(*X.buffers(pa.array(texts[lo : lo + step], pa.string())))

    for lo, w in parts():
        gram_word = np.searchsorted(w.gram_first, np.arange(len(w.gram)), "right") - 1
        gram_doc = np.searchsorted(w.first, gram_word, "right") - 1
        g_first = np.searchsorted(gram_doc, np.arange(len(w.first)))
        for i in range(len(w.first) - 1):
            f, y = fold[lo + i], int(toxic[lo + i])
            counts_w[f, y, np.unique(w.place[w.first[i] : w.first[i + 1]])] += 1
            counts_g[f, y, np.unique(w.gram[g_first[i] : g_first[i + 1]])] += 1
            docs[f, y] += 1
    final = Tables(counts_w.sum(0), counts_g.sum(0), docs.sum(0))
    rng = np.random.default_rng(3)
    per_fold = []
    for f in range(FOLDS):
        others = [k for k in range(FOLDS) if k != f]
        per_fold.append(Tables(counts_w[others].sum(0), counts_g[others].sum(0), docs[others].sum(0)))
    stacked = Tables.stack(per_fold)
    del counts_w, counts_g, per_fold

    def fitted(lo: int, w: Words) -> np.ndarray:
        word_doc = np.searchsorted(w.first, np.arange(len(w.starts)), "right") - 1
        return w.evidence(stacked, fold[lo + word_doc])

    #: Fold 0 says when to stop and how to calibrate; the network learns from the others.
    own, ys = (Examples(), Examples()), ([], [])
    for lo, w in parts():
        fit = fitted(lo, w)
        s, n, doc = windows(w.first)
        if not len(s):
            continue
        best = fit[:, :2].max(1)
        strong = best[np.minimum(s[:, None] + np.arange(WINDOW), (s + n - 1)[:, None])].max(1)
        order = np.lexsort((-strong, doc))
        firsts = order[np.searchsorted(doc[order], np.unique(doc))]
        other = rng.integers(0, len(s), len(firsts))
        other = other[toxic[lo + doc[other]] == 0]
        pick = np.concatenate([firsts, other])
        for k, part in enumerate((pick[fold[lo + doc[pick]] != 0], pick[fold[lo + doc[pick]] == 0])):
            if len(part):
                own[k].add(w, fit, s[part], n[part])
                ys[k].append(toxic[lo + doc[part]])
    net = Network()
    if ys[0]:
        k = 1 if ys[1] else 0
        net.fit(own[0].close(), np.concatenate(ys[0]).astype(np.float32), own[k].close() if k else own[0], np.concatenate(ys[k]).astype(np.float32), **learning)
    z = np.full(len(texts), -np.inf)
    for lo, w in parts():
        part = np.full(len(w.first) - 1, -np.inf)
        highest(net, w, fitted(lo, w), part)
        z[lo : lo + len(part)] = part
    ok = np.isfinite(z) & ((fold == 0) if len(texts) >= 40 * FOLDS else True)
    slope, level = _calibrate(z[ok], toxic[ok].astype(float), share)
    low = np.median(z[ok & (toxic == 0)]) if (ok & (toxic == 0)).any() else 0.0
    return Model(final, net, slope, level, float(_sigmoid(slope * low + level)))


def _calibrate(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression of y on z by Newton steps, the classes weighed to their shares, lightly regularised."""
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    x = np.column_stack([z, np.ones(len(z))])
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ b)
        grad = x.T @ (w * (p - y)) + 1e-3 * (b - [1.0, 0.0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.linalg.solve(hess, grad)
    return float(b[0]), float(b[1])


def fit(documents: DataFrame, labels: DataFrame, most_toxic: int = 2500, most_clean: int = 3500, sample_bytes: int = 20_000) -> Model:
    """Train on a bounded sample of documents whose label is known and which are not held out (crc32 of doc_id modulo 5 not 0)."""
    ship(documents.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).select("doc_id", "toxic")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("toxic") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionAll(part)
    rows = documents.select("doc_id", "text").where(F.octet_length("text").between(1, sample_bytes)).join(F.broadcast(ids), "doc_id")
    # Rows may share a doc_id: one of its texts, by hash, speaks for it, so that the sample is as large as its bounds say.
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    got = sorted(one.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "t.text").collect())
    # A text that occurs often is one witness: the first of its rows speaks for all.
    first = {}
    for r in got:
        first.setdefault(r["text"], r["toxic"])
    return train(list(first), np.array(list(first.values()), np.int64), n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, over all windows of its whole text."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offs = X.buffers(b.column("text"))
            for lo, hi in X.slices(offs, SLICE):
                p = m.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(X.tidy(run), "doc_id long, held_out boolean, score double, predicted int")
