"""Language identification: a bidirectional gated recurrent network over bytes.

A text is cut into windows of `WINDOW` bytes; within a window one recurrent layer runs forwards and one
backwards, and every byte gets a distribution over the languages from both states. A document's
probabilities are the mean over all bytes of all its windows. The network is trained in numpy by
backpropagation through time on the driver, from a bounded sample of labelled windows; prediction runs
in the tasks over every byte of every text. Gates use the softsign family, which keeps numpy fast.

Defined cases: a null text, or one without a letter, is `und` with score 0. Where no labelled row can
be learned from, every text is `und`. Equally likely languages go by name, and
equal texts get equal results, in repeated rows too. Other columns are not read; lang only as a training label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, fold, pick, pieces, utf8

WINDOW = 96
HIDDEN = 8
#: Windows learned from, in all: the bound of the training sample.
SAMPLE = 24_000
_LETTER = regex.compile(r"\p{L}")


def _windows(data: np.ndarray, offs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, n) bytes of all windows, each window's length and text; the last window of a text may be short."""
    per = -(-np.diff(offs) // t)
    owner = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[:-1][owner] + nth * t
    length = np.minimum(offs[1:][owner] - start, t)
    at = start[None, :] + np.arange(t)[:, None]
    cells = np.take(data, np.minimum(at, max(len(data) - 1, 0)))
    return cells, length, owner


class Network:
    """Weights of both directions: input tables (3H, 256), recurrent U (3H, H), output (L, H) each."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
            self.w[f"o{d}"] = rng.normal(0, 0.3, (len(langs), hidden)).astype(np.float32)
        self.w["c"] = np.zeros((len(langs), 1), np.float32)

    def states(self, cells: np.ndarray, length: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(t, H, n) states of one direction; a window's bytes beyond its length leave the state alone."""
        h, (t, n) = self.h, cells.shape
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        state, out = np.zeros((h, n), np.float32), np.empty((t, h, n), np.float32)
        for i in range(t) if d == "f" else reversed(range(t)):
            a = np.take(table, cells[i], axis=1)
            g = u[: 2 * h] @ state + a[: 2 * h]
            gate = g / (1 + np.abs(g))
            gate = 0.5 + 0.5 * gate
            z, r = gate[:h], gate[h:]
            past = r * state
            k = u[2 * h :] @ past + a[2 * h :]
            cand = k / (1 + np.abs(k))
            new = state + z * (cand - state)
            live = i < length
            if not live.all():
                new = np.where(live, new, state)
            if keep is not None:
                keep.append((i, state, g, z, r, past, k, cand, live))
            state = out[i] = new
        return out

    def probabilities(self, cells: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(L, n): sums over each window's bytes of the distributions at every byte."""
        fw, bw = self.states(cells, length, "f"), self.states(cells, length, "b")
        total = np.zeros((len(self.langs), cells.shape[1]), np.float32)
        for i in range(len(cells)):
            logit = self.w["of"] @ fw[i] + self.w["ob"] @ bw[i] + self.w["c"]
            e = np.exp(logit - logit.max(axis=0))
            total += np.where(i < length, e / e.sum(axis=0), 0)
        return total

    def step(self, cells: np.ndarray, length: np.ndarray, label: np.ndarray, moments: dict, rate: float) -> float:
        """One step of Adam on the mean loss of all positions; returns the loss."""
        w, h, (t, n) = self.w, self.h, cells.shape
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        state = {d: self.states(cells, length, d, kept[d]) for d in "fb"}
        truth = np.eye(len(self.langs), dtype=np.float32)[label].T
        loss, count = 0.0, float(length.sum())
        down = {d: np.empty((t, h, n), np.float32) for d in "fb"}
        for i in range(t):
            logit = w["of"] @ state["f"][i] + w["ob"] @ state["b"][i] + w["c"]
            e = np.exp(logit - logit.max(axis=0))
            p = e / e.sum(axis=0)
            live = i < length
            loss -= float((np.log(np.maximum((p * truth).sum(axis=0), 1e-9)) * live).sum())
            err = (p - truth) * live / count
            grad["c"] += err.sum(axis=1, keepdims=True)
            for d in "fb":
                grad[f"o{d}"] += err @ state[d][i].T
                down[d][i] = w[f"o{d}"].T @ err
        for d in "fb":
            u, back = w[f"u{d}"], np.zeros((h, n), np.float32)
            for i, old, g, z, r, past, k, cand, live in reversed(kept[d]):
                dh = back + down[d][i]
                on = dh * live
                dz, dc = on * (cand - old), on * z
                dk = dc / (1 + np.abs(k)) ** 2
                dpast = u[2 * h :].T @ dk
                dg = np.concatenate([dz, dpast * old]) * (0.5 / (1 + np.abs(g)) ** 2)
                both = np.concatenate([dg, dk])
                grad[f"u{d}"][: 2 * h] += dg @ old.T
                grad[f"u{d}"][2 * h :] += dk @ past.T
                for row in range(3 * h):
                    grad[f"x{d}"][row] += np.bincount(cells[i], both[row], 256).astype(np.float32)
                back = dh - on + on * (1 - z) + dpast * r + u[: 2 * h].T @ dg
        moments["n"] = moments.get("n", 0) + 1
        for k, g in grad.items():
            m, v = moments.get(k, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[k] = (m, v)
            w[k] -= rate * (m / (1 - 0.9 ** moments["n"])) / (np.sqrt(v / (1 - 0.99 ** moments["n"])) + 1e-8)
        return loss / count


def train(langs: list[str], cells: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = 260, batch: int = 256, seed: int = 7) -> Network:
    """A network for windows (t, n) and their labels; batches draw the languages alike."""
    net, rng, moments = Network(langs, seed=seed), np.random.default_rng(seed), {}
    by = [np.flatnonzero(label == k) for k in range(len(langs))]
    for i in range(steps):
        pick_ = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
        net.step(cells[:, pick_], length[pick_], label[pick_], moments, 0.02 * (1 - 0.9 * i / steps))
    return net


def fit(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Network | None:
    """Learn from text and lang outside the held-out fold. Each language gives at most about
    sample / languages windows: a share of its documents chosen by a hash of the id, one window each
    from a place that the hash chooses."""
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.where(fold(F.col("doc_id"), folds) != held)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    part = F.abs(F.xxhash64("doc_id", F.lit("windows"))) / F.lit(float(2**63))
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, sample / len(langs) / n)))])
    chars = F.lit(WINDOW)
    place = (F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - chars, F.lit(1))) + 1).cast("int")
    cut = F.substring(F.col("text"), place, chars)
    got = rows.where(part <= share[F.col("lang")]).select("lang", cut.alias("cut"), "doc_id").orderBy("doc_id").limit(2 * sample).toPandas()
    data, offs = utf8(pa.array(got["cut"], pa.string()))
    cells, length, owner = _windows(data, offs, WINDOW)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # the rest are tails of a few bytes
    label = np.searchsorted(langs, got["lang"].to_numpy(str))[owner[first]]
    there = sorted(set(label.tolist()))
    return train([langs[k] for k in there], cells[:, first], length[first], np.searchsorted(there, label))


def _predict(net: Network | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    data, offs = utf8(batch.column("text"))
    known = [net is not None and v.is_valid and _LETTER.search(v.as_py()) is not None for v in batch.column("text")]
    sums = np.zeros((batch.num_rows, len(net.langs) if net else 1))
    if net and len(data):
        cells, length, owner = _windows(data, offs, WINDOW)
        for a in range(0, cells.shape[1], 4096):
            p = net.probabilities(cells[:, a : a + 4096], length[a : a + 4096])
            np.add.at(sums, owner[a : a + 4096], p.T)
    mean = sums / np.maximum(np.diff(offs), 1)[:, None]
    best = mean.argmax(axis=1)
    lang = [net.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
    return lang, np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predictions(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the mean probability of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 19):
            lang, score = _predict(net, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.3, **how) -> DataFrame:
    """The documents whose language is told with at least `least`, with all their columns."""
    net = fit(docs, **how)

    def judge(batch: pa.RecordBatch) -> np.ndarray:
        lang, score = _predict(net, batch)
        return (np.array(lang, object) != "und") & (score >= least)

    return filtered(docs, judge)
