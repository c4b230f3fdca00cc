"""Language identification: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes forwards and backwards; together they label every byte position
with a language, and the mean over the positions gives the document's probabilities. The network is trained in
numpy by backpropagation through time, on windows of a bounded sample of labelled texts (per language the
``ROWS_PER_LANGUAGE`` different texts with the smallest hashes, so that no language is left out); the
prediction covers every byte of every text, in lanes of ``LANE`` bytes that are computed side by side.

Defined results: a null text and one without any letter get ``und`` and score 0, as does everything when no row
is labelled; ties go to the language that sorts first; repeated rows are each predicted; other columns pass
through, and those with the names of the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from firmatlas.llm.common import rows_in_slices, shipped, with_column

ROWS_PER_LANGUAGE, SALTS, WINDOW, WINDOWS_PER_ROW = 1000, 64, 96, 3
HIDDEN, EPOCHS, BATCH, RATE, LANE, LANES = 8, 6, 128, 0.02, 128, 4096
UNKNOWN = "und"
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


@dataclass
class Network:
    """Weights: per direction the byte table (3H x 256), the recurrent matrix (3H x H); the output layer (K x 2H).

    Arrays hold features first and lanes last, so that each gate is one contiguous block.
    """

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(labels: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        drawn = {}
        for side in "fb":
            drawn[f"{side}_in"] = rng.normal(0, 0.3, (3 * HIDDEN, 256))
            drawn[f"{side}_re"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN))
        drawn["out"] = rng.normal(0, 0.3, (len(labels), 2 * HIDDEN))
        drawn["bias"] = np.zeros((len(labels), 1))
        return Network(labels, {k: v.astype(np.float32) for k, v in drawn.items()})

    def states(self, side: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T x H x lanes) of one direction; ``steps`` is T x lanes, already in reading order."""
        w_in, w_re = self.weights[f"{side}_in"], self.weights[f"{side}_re"]
        h = np.zeros((HIDDEN, steps.shape[1]), dtype=w_in.dtype)
        out = np.empty((len(steps), *h.shape), dtype=w_in.dtype)
        two = 2 * HIDDEN
        for t, byte in enumerate(steps):
            given, back = w_in.take(byte, axis=1), w_re @ h
            gates = given[:two]
            gates += back[:two]  # the logistic function as a scaled hyperbolic tangent
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            update, reset = gates[:HIDDEN], gates[HIDDEN:]
            fresh = reset * back[two:]
            fresh += given[two:]
            np.tanh(fresh, out=fresh)
            if keep is not None:
                keep.append((h, update, reset, fresh, back[two:]))
            h = np.subtract(h, fresh, out=out[t])
            h *= update
            h += fresh
        return out

    def position_probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """T x K x lanes."""
        out = self.weights["out"]
        score = out[:, :HIDDEN] @ forward
        score += out[:, HIDDEN:] @ backward
        score += self.weights["bias"]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        return score

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions; windows: lanes x T bytes, truth: lanes."""
        steps = np.ascontiguousarray(windows.T)
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {"f": self.states("f", steps, kept["f"]), "b": self.states("b", steps[::-1], kept["b"])}
        p = self.position_probabilities(hidden["f"], hidden["b"][::-1])
        p[:, truth, np.arange(len(truth))] -= 1
        p /= p.shape[0] * p.shape[2]
        both = np.concatenate([hidden["f"], hidden["b"][::-1]], axis=1)
        grad = {"bias": p.sum(axis=(0, 2))[:, None], "out": np.einsum("tkn,thn->kh", p, both, optimize=True)}
        from_out = self.weights["out"].T @ p
        for side, given in (("f", from_out[:, :HIDDEN]), ("b", from_out[::-1, HIDDEN:])):
            order = steps if side == "f" else steps[::-1]
            w_re = self.weights[f"{side}_re"]
            g_re, inner = np.zeros_like(w_re), np.empty((len(order), 3 * HIDDEN, len(truth)), dtype=w_re.dtype)
            carried = np.zeros_like(given[0])
            for t in range(len(order) - 1, -1, -1):
                h, update, reset, fresh, back = kept[side][t]
                dh = carried + given[t]
                d_fresh = dh * (1 - update) * (1 - fresh * fresh)
                d_update = dh * (h - fresh) * update * (1 - update)
                d_reset = d_fresh * back * reset * (1 - reset)
                inner[t] = np.concatenate([d_update, d_reset, d_fresh])
                through = np.concatenate([d_update, d_reset, d_fresh * reset])
                g_re += through @ h.T
                carried = dh * update + w_re.T @ through
            at = order.ravel()
            grad[f"{side}_re"] = g_re
            grad[f"{side}_in"] = np.stack([np.bincount(at, row, 256) for row in inner.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)])
        return grad

    def train(self, windows: np.ndarray, truth: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam over shuffled batches of windows."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, rounds = 0, epochs * -(-len(truth) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(truth))
            for start in range(0, len(order), BATCH):
                pick = order[start : start + BATCH]
                step += 1
                rate = RATE * (1 - 0.9 * step / rounds)
                for k, g in self.gradients(windows[pick], truth[pick]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    fixed = np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6
                    self.weights[k] -= (rate / (1 - 0.9**step) * mean[k] / fixed).astype(np.float32)
        return self

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (texts x K); every byte counts, an empty text gets zeros."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        lanes_of = -(-sizes // LANE)
        lanes = np.full((int(lanes_of.sum()), LANE), 32, dtype=np.uint8)
        filled = np.full(len(lanes), LANE, dtype=np.int64)
        at = 0
        for text, n, size in zip(texts, lanes_of.tolist(), sizes.tolist(), strict=True):
            if n:
                lanes[at : at + n].reshape(-1)[:size] = np.frombuffer(text, dtype=np.uint8)
                filled[at + n - 1] = size - (n - 1) * LANE
                at += n
        sums = np.empty((len(lanes), len(self.labels)), dtype=np.float64)
        for start in range(0, len(lanes), LANES):
            steps = np.ascontiguousarray(lanes[start : start + LANES].T)
            p = self.position_probabilities(self.states("f", steps), self.states("b", steps[::-1])[::-1])
            real = np.arange(LANE)[:, None] < filled[start : start + LANES]
            sums[start : start + LANES] = np.einsum("tkn,tn->nk", p, real.astype(p.dtype))
        out = np.zeros((len(texts), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(texts)), lanes_of), sums)
        return out / np.maximum(sizes, 1)[:, None]


def sampled(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """lang, windows: per language the different labelled texts whose hash is smallest."""
    # windows leave the executors, whole texts don't
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_ROW - 1)),
        lambda k: F.substring(text, (F.length(text) * k / F.lit(WINDOWS_PER_ROW)).cast("int") + 1, F.lit(WINDOW)),
    )
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(text, lang).alias("h"), spread.alias("windows")).distinct()
    # first within parts of a language, so that no task reads all of its texts
    for keys in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "windows")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_language).drop("rank")
    return rows.select("lang", "windows")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Network:
    """A network trained on a sample of the labelled texts of every language."""
    found = sampled(docs, text, lang, rows_per_language).select("lang", F.explode("windows").alias("window")).collect()
    labels = sorted({r["lang"] for r in found})
    pairs = [(r["window"].encode()[:WINDOW].ljust(WINDOW), labels.index(r["lang"])) for r in found if has_letter(r["window"])]
    pairs.sort(key=lambda p: (zlib.crc32(p[0]), p))
    if not pairs:
        return Network([])
    windows = np.frombuffer(b"".join(w for w, _ in pairs), dtype=np.uint8).reshape(-1, WINDOW)
    return Network.new(labels).train(windows, np.array([k for _, k in pairs]))


def predict(docs: DataFrame, network: Network, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the most likely language of each text and its probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_slices(batches, text):
            texts = [t if t and network.labels and has_letter(t) else "" for t in batch.column(text).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if network.labels:
                p = network.document_probabilities([t.encode() for t in texts])
                best = p.argmax(axis=1)
                scores = np.clip(p.max(axis=1), 0, 1)
                names = [network.labels[k] if t else UNKNOWN for k, t in zip(best, texts, strict=True)]
            out = with_column(batch, lang, pa.array(names, type=pa.string()))
            yield with_column(out, score, pa.array(scores, type=pa.float64()))

    kept = [f for f in docs.schema.fields if f.name not in (lang, score)]
    added = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return shipped(docs).mapInArrow(run, T.StructType(kept + added))
