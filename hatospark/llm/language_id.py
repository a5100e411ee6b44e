"""Language identification by a bidirectional gated recurrent network over bytes.

Two networks of gated recurrent units read windows of a text's UTF-8 bytes, one from either end; the
two states at a position give its label.  A document's probabilities are the mean over all its
positions.  The network is trained in numpy by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import held_out, map_batches

#: Bytes of a window, and units in each direction (for up to 8 languages; twice as many beyond).
WINDOW, UNITS = 64, 8
#: The bounded sample a model is trained on: documents of each language, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 4096
STEPS, BATCH, RATE = 200, 256, 0.02
#: Windows that are run through the network at once.
BLOCK = 2048
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _gate(x):
    """Piecewise linear sigmoid: cheap, and zero or one for good when far from the middle."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x):
    return x / (1 + np.abs(x))


@dataclass(frozen=True)
class Model:
    """``table`` (2, 256, 3H): what a byte adds to the gates, ``inner`` (2, H, 3H): what the state adds;
    ``outer`` (2, H, L) and ``bias`` (L): the label of a position from both states."""

    languages: tuple[str, ...]
    table: np.ndarray = field(repr=False)
    inner: np.ndarray = field(repr=False)
    outer: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(languages, time, windows) probabilities at every position of ``windows`` (rows of bytes)."""
        x = np.ascontiguousarray(windows.T).astype(np.intp)
        steps, rows = x.shape
        h = self.inner.shape[1]
        states = np.empty((2, steps, rows, h), np.float32)
        z, r, new, add = (np.empty((rows, h), np.float32) for _ in range(4))
        for way in (0, 1):
            # The slope and the middle of the gates are taken into their weights.
            tables = [np.ascontiguousarray(a) for a in np.split(self.table[way], 3, axis=1)]
            inners = [np.ascontiguousarray(a) for a in np.split(self.inner[way], 3, axis=1)]
            for k in (0, 1):
                tables[k], inners[k] = 0.25 * tables[k] + np.float32(0.5), 0.25 * inners[k]
            state = np.zeros((rows, h), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                for gate, table, inner in ((z, tables[0], inners[0]), (r, tables[1], inners[1])):
                    np.take(table, x[t], axis=0, out=gate, mode="clip")
                    np.matmul(state, inner, out=add)
                    gate += add
                    np.clip(gate, 0, 1, out=gate)
                np.matmul(state, inners[2], out=add)
                add *= r
                np.take(tables[2], x[t], axis=0, out=new, mode="clip")
                new += add
                np.abs(new, out=add)
                add += 1
                new /= add
                at = states[way, t]  # the new state: new + z * (state - new)
                np.subtract(state, new, out=at)
                at *= z
                at += new
                state = at
        flat = states.reshape(2, steps * rows, h)
        # Languages first: sums over a few languages then run along the long axis.
        scores = self.outer[0].T @ flat[0].T + self.outer[1].T @ flat[1].T + self.bias[:, None]
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        scores /= scores.sum(0)
        return scores.reshape(-1, steps, rows)


def _train(texts: list[bytes], labels: list[int], languages: tuple[str, ...], seed=7) -> Model:
    """Adam on the mean log loss of all positions of random windows, languages drawn equally often."""
    rng = np.random.default_rng(seed)
    h, n = UNITS * (1 if len(languages) <= 8 else 2), len(languages)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"table": draw(2, 256, 3 * h), "inner": draw(2, h, 3 * h), "outer": draw(2, h, n)}
    p["bias"] = np.zeros(n, np.float32)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    data = [np.frombuffer(t.ljust(WINDOW), np.uint8) for t in texts]
    of = [np.flatnonzero(np.array(labels) == k) for k in range(n)]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, n, BATCH)
        x = np.empty((WINDOW, BATCH), np.uint8)
        for b, k in enumerate(y):
            t = data[rng.choice(of[k])]
            at = rng.integers(0, len(t) - WINDOW + 1)
            x[:, b] = t[at : at + WINDOW]
        slopes = _slopes(p, x, y)
        rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
        for k, g in slopes.items():
            np.clip(g, -0.1, 0.1, out=g)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            fair = (mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step))
            p[k] -= rate * fair[0] / (np.sqrt(fair[1]) + 1e-6)
    return Model(languages, p["table"], p["inner"], p["outer"], p["bias"])


def _slopes(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss by backpropagation through time, both directions."""
    steps, rows = x.shape
    h = p["inner"].shape[1]
    runs = []
    for way in (0, 1):
        order = range(steps) if way == 0 else range(steps - 1, -1, -1)
        state, kept = np.zeros((rows, h), np.float32), []
        out = np.empty((steps, rows, h), np.float32)
        for t in order:
            add = state @ p["inner"][way]
            both = _gate(p["table"][way][x[t]][:, : 2 * h] + add[:, : 2 * h])
            new = _squash(p["table"][way][x[t]][:, 2 * h :] + both[:, h:] * add[:, 2 * h :])
            kept.append((t, state, both, new, add[:, 2 * h :]))
            state = new + both[:, :h] * (state - new)
            out[t] = state
        runs.append((kept, out))
    scores = runs[0][1] @ p["outer"][0] + runs[1][1] @ p["outer"][1] + p["bias"]
    scores = np.exp(scores - scores.max(-1, keepdims=True))
    d = scores / scores.sum(-1, keepdims=True)
    d[:, np.arange(rows), y] -= 1
    d /= steps * rows
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"] += d.sum((0, 1))
    for way, (kept, out) in enumerate(runs):
        g["outer"][way] = np.einsum("tbh,tbl->hl", out, d)
        from_labels = d @ p["outer"][way].T
        carry = np.zeros((rows, h), np.float32)
        for t, state, both, new, add in reversed(kept):
            dh = carry + from_labels[t]
            z, r = both[:, :h], both[:, h:]
            dn = dh * (1 - z) * (1 - np.abs(new)) ** 2
            dz = dh * (state - new) * (0.25 * ((z > 0) & (z < 1)))
            dr = dn * add * (0.25 * ((r > 0) & (r < 1)))
            to_table = np.concatenate([dz, dr, dn], 1)
            to_add = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(g["table"][way], x[t], to_table)
            g["inner"][way] += state.T @ to_add
            carry = dh * z + to_add @ p["inner"][way].T
    return g


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> Model | None:
    """Train on at most ``rows`` documents of each language, the first in hash order of their ids.

    Rows of the held-out fifth, null languages, null ids and texts without a letter are never read.
    None if there is no language to learn.
    """
    known = docs.filter(
        F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
        & F.col(text).rlike(r"\p{L}")
    ).select(F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("_lang"))
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    few = known.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows)
    # At most ``rows`` ids of each language: small whatever the corpus.
    few = few.groupBy("_id").agg(F.min("_lang").alias("_lang"))
    cut = F.substring(F.col(text).cast("binary"), 1, SAMPLE_BYTES).alias("_t")
    found = docs.select(F.col(id_col).alias("_id"), cut).join(F.broadcast(few), "_id")
    sample = found.groupBy("_id").agg(F.min("_lang").alias("_lang"), F.min("_t").alias("_t"))
    sample = sorted((r["_id"], r["_lang"], bytes(r["_t"] or b"")) for r in sample.collect())
    languages = tuple(sorted({r[1] for r in sample}))
    if not languages:
        return None
    labels = [languages.index(r[1]) for r in sample]
    return _train([r[2] for r in sample], labels, languages)


def predict(model: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its probability for each whole text; UNKNOWN, 0 for null or letterless texts."""
    sums = np.zeros((len(texts), len(model.languages) if model else 1))
    block, owners, counted = [], [], []

    def flush():
        if block:
            p = model.probabilities(np.frombuffer(b"".join(block), np.uint8).reshape(-1, WINDOW))
            # The last window of a text overlaps the one before it: only its new positions count.
            new = np.arange(WINDOW)[:, None] >= np.array(counted)[None, :]
            np.add.at(sums, owners, (p * new).sum(1).T)
            block.clear(), owners.clear(), counted.clear()

    for i, text in enumerate(texts):
        if model is None or not text or not LETTER.search(text):
            continue
        data = text.encode("utf-8", "surrogatepass")
        size = len(data)
        for at in range(0, size, WINDOW):
            begin = max(0, min(at, size - WINDOW))
            block.append(data[begin : begin + WINDOW].ljust(WINDOW))
            owners.append(i)
            counted.append(at - begin)
            if len(block) == BLOCK:
                flush()
    flush()
    out = []
    for total in sums:
        whole = total.sum()
        if whole:
            k = int(total.argmax())
            out.append((model.languages[k], float(min(1.0, total[k] / whole))))
        else:
            out.append((UNKNOWN, 0.0))
    return out


def languages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred and score (0 to 1).

    Predictions read the text alone. Null and letterless texts are ``und`` with score 0, and so is
    every text if there is nothing to learn from. Null ids and repeated rows come back as they are.
    """
    model = fit(docs, id_col, text, lang)
    keep = [F.col(id_col), held_out(id_col).alias("held_out")]
    return map_batches(
        docs, keep, text, lambda: lambda texts: predict(model, texts), "lang_pred string, score double"
    )
