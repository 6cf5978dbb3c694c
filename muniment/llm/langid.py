"""Language identification by a bidirectional gated recurrent network over bytes.

The network: an input table per byte, one GRU forward and one backward (update gate, reset gate,
candidate), and a softmax layer that labels every byte position. A document's probabilities are the mean
over the positions of its letters. Training is backpropagation through time in numpy with Adam on windows
from a bounded, stratified, hash-drawn sample of labelled documents. Prediction covers whole texts: they
are cut into windows of WINDOW bytes, thousands of which run side by side; the state starts at zero in
each window, and a short last window is filled with zero bytes.

Defined results: a null text or one without a letter is `und` with score 0. Without any labelled row
every text is `und`. Repeated rows repeat. Ties go to the label first in code-point order. An empty table
gives no rows. The label, source and id are never inputs of a prediction; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, HIDDEN, LANES = 128, 6, 2048
_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])


class Network:
    """Parameters by name; activations are laid out as (features, lanes)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        self.labels, self.hidden = labels, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = draw(3 * hidden, 256, s=0.4)
            self.p[f"u{d}"] = draw(3 * hidden, hidden, s=0.5 / np.sqrt(hidden))
        self.p["v"] = draw(len(labels), 2 * hidden, s=0.3)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def states(self, codes: np.ndarray, d: str, out: np.ndarray, keep: list | None = None) -> None:
        """Hidden states of one direction over codes (time, lanes) into out (time, hidden, lanes).
        keep: gets what backpropagation needs, step by step."""
        h_n, x, u = self.hidden, self.p[f"x{d}"], self.p[f"u{d}"]
        h, g = np.zeros((h_n, codes.shape[1]), u.dtype), np.empty((3 * h_n, codes.shape[1]), u.dtype)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            a = x.take(codes[t], axis=1)
            np.dot(u, h, out=g)
            zr, c = a[: 2 * h_n], a[2 * h_n :]
            zr += g[: 2 * h_n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:h_n], zr[h_n:]
            gc = g[2 * h_n :]
            if keep is not None:
                keep.append((t, h.copy(), z, r, c, gc.copy()))
            gc *= r
            c += gc
            np.tanh(c, out=c)
            new = c - h if keep is not None else np.subtract(c, h, out=c)
            new *= z
            h = h + new
            out[t] = h

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, labels, lanes) for codes (time, lanes)."""
        t, n = codes.shape
        both = np.empty((t, 2 * self.hidden, n), np.float32)
        self.states(codes, "f", both[:, : self.hidden])
        self.states(codes, "b", both[:, self.hidden :])
        return softmax(np.matmul(self.p["v"], both) + self.p["c"])

    def gradients(self, codes: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the masked positions, each labelled with its window's label, and its gradients."""
        (t_n, n), h_n = codes.shape, self.hidden
        both = np.empty((t_n, 2 * h_n, n), self.p["v"].dtype)
        kept: dict = {"f": [], "b": []}
        for k, d in enumerate("fb"):
            self.states(codes, d, both[:, k * h_n : (k + 1) * h_n], kept[d])
        prob = softmax(np.matmul(self.p["v"], both) + self.p["c"])
        scale = mask / max(1, mask.sum())
        loss = float(-(np.log(np.maximum(np.take_along_axis(prob, np.broadcast_to(label, (t_n, 1, n)), 1)[:, 0], 1e-9)) * scale).sum())
        prob[:, label, np.arange(n)] -= 1
        d_out = prob * scale[:, None, :]
        grad = {"v": np.einsum("tcn,thn->ch", d_out, both, optimize=True), "c": d_out.sum(axis=(0, 2))[:, None]}
        d_both = np.matmul(self.p["v"].T, d_out)
        for k, d in enumerate("fb"):
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            d_in, carry = np.empty((t_n, 3 * h_n, n), u.dtype), np.zeros((h_n, n), u.dtype)
            for t, h, z, r, c, gc in reversed(kept[d]):
                dh = d_both[t, k * h_n : (k + 1) * h_n] + carry
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r])
                d_in[t, : 2 * h_n], d_in[t, 2 * h_n :] = dg[: 2 * h_n], dc
                du += dg @ h.T
                carry = dh * (1 - z) + u.T @ dg
            flat = codes.ravel()
            grad[f"x{d}"] = np.stack([np.bincount(flat, weights=d_in[:, i].ravel(), minlength=256) for i in range(3 * h_n)])
            grad[f"u{d}"] = du
        return loss, grad

    def fit(self, codes: np.ndarray, label: np.ndarray, rounds: int, batch: int = 256, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over windows codes (windows, time); returns the losses."""
        rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(rounds):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick, step = order[at : at + batch], step + 1
                part = np.ascontiguousarray(codes[pick].T)
                loss, grad = self.gradients(part, label[pick], _LETTER_BYTE[part].astype(np.float32))
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


def softmax(x: np.ndarray) -> np.ndarray:
    """Over axis 1, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as (windows, size), zero-filled at each text's end, and each window's text."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-length // size)
    first = np.cumsum(per) - per
    out = np.zeros(int(per.sum()) * size, np.uint8)
    for text, at in zip(texts, (first * size).tolist(), strict=True):
        out[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, size), np.repeat(np.arange(len(texts)), per)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if not net.labels:
        return ["und"] * len(texts), [0.0] * len(texts)
    raw = [b"" if t is None or not _LETTER.search(t) else t.encode("utf-8", "replace") for t in texts]
    total = np.zeros((len(texts), len(net.labels) + 1))
    at = 0
    while at < len(raw):  # some megabytes at a time
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= 1 << 22):
            size += len(raw[end])
            end += 1
        for a in range(0, max(1, size), 1 << 24):  # and very long texts piece by piece
            part, owner = windows([x[a : a + (1 << 24)] for x in raw[at:end]])
            for k in range(0, len(part), LANES):
                codes = np.ascontiguousarray(part[k : k + LANES].T)
                use = _LETTER_BYTE[codes]
                prob = net.probabilities(codes)
                prob *= use[:, None, :]
                np.add.at(total, at + owner[k : k + LANES], np.concatenate([prob.sum(axis=0), use.sum(axis=0)[None]]).T)
        at = end
    best = total[:, :-1].argmax(axis=1)
    seen = total[:, -1]
    label = [net.labels[b] if s > 0 else "und" for b, s in zip(best, seen, strict=True)]
    score = [min(1.0, float(total[i, b] / s)) if s > 0 else 0.0 for i, (b, s) in enumerate(zip(best, seen, strict=True))]
    return label, score


def training_windows(docs: DataFrame, label: str, per_label: int, per_doc: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, and the windows and label numbers of about per_label documents of each label, drawn
    by a hash of id and text, repeated rows once; per_doc windows from each, spread over the whole text."""
    counts = {r["l"]: r["n"] for r in docs.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int)
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_label / counts[k]))])
    drawn = docs.where(common.unit_hash("doc_id", "text") < F.element_at(share, F.col(label))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("l"), F.col("text").cast("string").alias("t"))

    def run(batches):
        for batch in common.slices(batches):
            ids, names, out = [], [], []
            for i, l, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part = windows([(t or "").encode("utf-8", "replace")])[0]
                for k in sorted({(len(part) * j) // per_doc for j in range(per_doc)} if len(part) else ()):
                    ids.append(i)
                    names.append(l)
                    out.append(part[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(out, pa.binary())], ["doc_id", "l", "w"])

    rows = sorted((r["doc_id"], bytes(r["w"]), r["l"]) for r in drawn.mapInArrow(run, "doc_id long, l string, w binary").distinct().collect())
    codes = np.frombuffer(b"".join(w for _, w, _ in rows), np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(labels)}
    return labels, codes, np.array([number[l] for *_, l in rows], int)


def train(docs: DataFrame, label: str = "lang", per_label: int = 400, per_doc: int = 3, rounds: int = 8) -> Network:
    """A network fitted on (doc_id, text, label) rows with a label; at most about per_label documents of
    each label are used, per_doc windows of each."""
    labels, codes, number = training_windows(docs.where(F.col(label).isNotNull()), label, per_label, per_doc)
    net = Network(labels)
    if len(codes) and len(labels) > 1:
        net.fit(codes, number, rounds)
    return net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches):
        for part in common.slices(batches, 2000):
            label, score = predict(net, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.fold_of("doc_id", 5) == 0
    net = train(docs.where(~F.coalesce(held, F.lit(True))).select("doc_id", "text", "lang"))
    return identify(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
