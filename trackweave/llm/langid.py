"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads one word at a time, from both ends, and labels every byte position; a document's probabilities are the mean
over the positions of all its words.  Since a word's labels depend on the word alone, each distinct word of a task is read
once.  Weights are fitted by backpropagation through time on a bounded sample: `PER_LANGUAGE` texts of each language that
occurs at most, `SNIPPET` characters of each, chosen by a hash of the text.  Prediction reads all words of all texts.

Defined cases: a null text and one without a letter are `und` with score 0; without any labelled row every text is `und`;
words longer than `PIECE` bytes are read in pieces; output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.words import LOWER, Words, slices

PER_LANGUAGE, SNIPPET = 500, 600
HIDDEN, STEPS, BATCH, PIECE, KNOWN = 16, 400, 256, 24, 1 << 19
UNKNOWN = "und"


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte letters of Latin-1."""
    out = LOWER[buf]
    if len(out) > 1:
        upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[upper] += 0x20
    return out


class Network:
    """Two recurrent layers, one per direction, and a softmax over both states at every position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {"out": rng.normal(0, 0.2, (2 * hidden, classes)), "bias": np.zeros(classes)}
        for way in "fb":
            self.w[f"in_{way}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.w[f"rec_{way}"] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _layer(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """x: bytes (words, positions); the state at every position."""
        h_size, table, rec = self.hidden, self.w[f"in_{way}"], self.w[f"rec_{way}"]
        h = np.zeros((len(x), h_size), np.float32)
        out = np.empty((x.shape[1], len(x), h_size), np.float32)
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            g, u = table[x[:, t]], h @ rec
            gates = _sigmoid(g[:, :2 * h_size] + u[:, :2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            n = np.tanh(g[:, 2 * h_size:] + r * u[:, 2 * h_size:])
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * h_size:]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(positions, words, classes)"""
        states = np.concatenate([self._layer(x, way, None if keep is None else keep.setdefault(way, [])) for way in "fb"], axis=2)
        if keep is not None:
            keep["states"] = states
        logits = states @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        keep: dict = {}
        p = self.probabilities(x, keep)
        states, size, h_size = keep["states"], p.shape[0] * p.shape[1], self.hidden
        loss = -float(np.mean(np.log(p[:, np.arange(len(x)), label] + 1e-9)))
        d = p.copy()
        d[:, np.arange(len(x)), label] -= 1
        d /= size
        grad = {"out": np.einsum("tbi,tbc->ic", states, d), "bias": d.sum((0, 1))}
        d_states = d @ self.w["out"].T
        for i, way in enumerate("fb"):
            rec = self.w[f"rec_{way}"]
            g_in, g_rec = np.zeros((256, 3 * h_size), np.float32), np.zeros_like(rec)
            d_h = np.zeros((len(x), h_size), np.float32)
            for t, h, z, r, n, u_n in reversed(keep[way]):
                d_h = d_h + d_states[t, :, i * h_size:(i + 1) * h_size]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = d_h * (h - n) * z * (1 - z)
                d_r = d_n * u_n * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(g_in, x[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
                g_rec += h.T @ d_u
                d_h = d_h * z + d_u @ rec.T
            grad[f"in_{way}"], grad[f"rec_{way}"] = g_in, g_rec
        return grad, loss

    def fit(self, groups: list[tuple[np.ndarray, np.ndarray]], steps: int, batch: int, rate: float = 0.01, seed: int = 11) -> None:
        """groups: words of one length with their labels; Adam, a batch of one length at a time."""
        rng = np.random.default_rng(seed)
        weight = np.array([x.size for x, _ in groups], float)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, y = groups[rng.choice(len(groups), p=weight / weight.sum())]
            at = rng.integers(0, len(x), min(batch, len(x)))
            grad, _ = self.gradients(x[at], y[at])
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                decay = rate * (1 - 0.9 * step / steps)
                self.w[k] -= (decay * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)


def has_letter(byte: np.ndarray) -> np.ndarray:
    return ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90)) | (byte >= 0x80)


class Span:
    """Starts and ends alone."""

    def __len__(self) -> int:
        return len(self.start)


def pieces(words: Words | Span) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and word of the pieces of at most PIECE bytes of all words."""
    n = -(-(words.end - words.start) // PIECE)
    word = np.repeat(np.arange(len(words)), n)
    start = words.start[word] + PIECE * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(PIECE, words.end[word] - start), word


def by_length(buf: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Per length: the indices of the pieces and their bytes between two spaces."""
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        x = np.full((len(at), length + 2), 0x20, np.uint8)
        x[:, 1:-1] = buf[start[at][:, None] + np.arange(length)]
        yield at, x


def train(docs: DataFrame, label: Column, learn: Column, per_language: int = PER_LANGUAGE, seed: int = 7):
    """The labels and the fitted network, or none without labelled rows."""
    rows = docs.where(learn & label.isNotNull() & F.col("text").rlike("\\p{L}")).select(label.cast("string").alias("y"), F.col("text"))
    counts = rows.groupBy("y").count().orderBy(F.desc("count"), "y").collect()
    if not counts:
        return [], None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, 1.2 * per_language / r["count"]))])
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < share[F.col("y")] * (1 << 30))
    sample = picked.select("y", F.substring("text", 1, SNIPPET).alias("text")).orderBy(F.xxhash64("text"), "text").limit(2 * per_language * len(counts)).collect()
    labels = sorted(r["y"] for r in counts)
    sample = [r for r in sample if r["text"]]
    if not sample:
        return labels, Network(len(labels))
    words = Words(pa.array([r["text"] for r in sample]))
    buf = folded(words.buf)
    start, size, word = pieces(words)
    of_text = np.array([labels.index(r["y"]) for r in sample])
    y = of_text[words.text_of()][word]
    lettered = np.array([has_letter(buf[s:s + n]).any() for s, n in zip(start, size)], bool)
    start, size, y = start[lettered], size[lettered], y[lettered]
    # every language weighs the same
    rng = np.random.default_rng(seed)
    most = max(np.bincount(y, minlength=len(labels)).max(), 1)
    again = np.concatenate([rng.choice(at, most) for at in (np.flatnonzero(y == c) for c in range(len(labels))) if len(at)])
    network = Network(len(labels), seed=seed)
    network.fit([(x, y[again][at]) for at, x in by_length(buf, start[again], size[again])], STEPS, BATCH)
    return labels, network


def _predicted(labels: list[str], network: Network):
    classes = len(labels)

    def measure(words: Words, buf: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Per word the sum of its positions' probabilities, and their number last."""
        sub = Span()
        sub.start, sub.end = words.start[which], words.end[which]
        start, size, word = pieces(sub)
        each = np.zeros((len(start), classes + 1), np.float32)
        for at, x in by_length(buf, start, size):
            for a in range(0, len(at), 4096):
                each[at[a:a + 4096], :classes] = network.probabilities(x[a:a + 4096])[1:-1].sum(axis=0)
            each[at, classes] = x.shape[1] - 2
        if not len(which):
            return each
        out = np.add.reduceat(each, np.flatnonzero(np.append(True, word[1:] != word[:-1])), axis=0)
        letters = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(has_letter(buf), out=letters[1:])
        out[letters[sub.end] == letters[sub.start]] = 0  # words without a letter say nothing
        return out

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, value = np.zeros(0, np.uint64), np.zeros((0, classes + 1), np.float32)
        for text in texts:
            names, scores = [], []
            for part in slices(pa.record_batch({"text": text}), limit=4 << 20):
                words = Words(part.column("text"))
                buf = folded(words.buf)
                h, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                new = known[at] != h if len(known) else np.ones(len(h), bool)
                own = np.empty((len(h), classes + 1), np.float32)
                if len(known):
                    own[~new] = value[at[~new]]
                own[new] = measure(words, buf, first[new])
                if len(known) + new.sum() > KNOWN:
                    known, value = h, own
                elif new.any():
                    order = np.argsort(np.concatenate([known, h[new]]), kind="stable")
                    known, value = np.concatenate([known, h[new]])[order], np.concatenate([value, own[new]])[order]
                total = np.zeros((len(words.count), classes + 1))
                full = np.flatnonzero(words.count)
                for c in range(classes + 1):
                    if len(full):
                        total[full, c] = np.add.reduceat(own[back, c].astype(np.float64), words.first[full])
                mean = total[:, :classes] / np.maximum(total[:, classes:], 1)
                best = mean.argmax(axis=1)
                names += [labels[i] for i in best]
                scores += mean[np.arange(len(best)), best].clip(0, 1).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, labels: list[str], network: Network | None) -> DataFrame:
    """All rows and columns of `docs` with lang_pred and score."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    known = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if network is None:
        return docs.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def struct(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _predicted(labels, network)(it)

    read = F.arrow_udf(struct, "struct<lang_pred: string, score: double>")
    done = docs.withColumn("__tw_read", read("text")).withColumn("__tw_known", known)
    return done.select(*others, F.when(F.col("__tw_known"), F.col("__tw_read.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(F.col("__tw_known"), F.col("__tw_read.score")).otherwise(0.0).alias("score"))


def held_out(folds: int) -> Column:
    """Rows kept from learning: the crc32 of the id as text is a multiple of `folds`.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
