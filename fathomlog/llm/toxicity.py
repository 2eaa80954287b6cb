"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words. A word's input is an embedding of the
word, the mean of embeddings of its first characters (stems of three to six), and that of
its character trigrams; two gated recurrent units
read a window forwards and backwards, attention pools their states, and a logistic
output scores the window. A document's score is that of its worst window; every window
of the whole text is scored.

Inputs of a chunk are computed once per distinct word, up to and including the product
with the input weights, so a step of the network gathers rows, multiplies the small state
and applies the gates for all windows at once.

Training (numpy, Adam, backpropagation through time) sees documents as bags of windows:
the worst window of a toxic document and the worst and random ones of a clean one, chosen
anew each round. Embeddings of words and stems start with their log-odds in the sample; those
that are rare there have none, and the word's trigrams alone speak for it.

Defined results: a null text is empty; a text without words gets the score of a window
without words; repeated rows get the same score; without labelled rows of both classes
every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import released, slices, with_text
from fathomlog.llm.training import fitted, sample_of
from fathomlog.llm.word_bpe import gather, split_words

WINDOW, STRIDE = 32, 24
#: Lengths of stems, and numbers of a stem's embedding.
STEMS, STEM_DIM = (3, 4, 5, 6), 4
#: Words (and stems) of the sample that have an embedding of their own: the most frequent ones, in this share of documents at least.
VOCABULARY, RARE, WORD_DIM = 20_000, 0.002, 6
#: Pull of the embeddings towards zero, and optimizer steps in a round, at least.
DECAY, STEPS = 3e-4, 40
GRAMS, GRAM_DIM = 1 << 11, 6
HIDDEN = 6
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2000
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WINDOWS_AT_ONCE, _WORDS_AT_ONCE = 1024, 1 << 16


def bare(words: list[str]) -> list[str]:
    """Words lower-cased and without signs around them."""
    return [w.lower().strip(_SIGNS) for w in words]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): hashes of the character trigrams of words with their ends marked."""
    if len(words) > _WORDS_AT_ONCE:
        parts = [trigrams(words[lo : lo + _WORDS_AT_ONCE]) for lo in range(0, len(words), _WORDS_AT_ONCE)]
        return np.concatenate([g for g, _ in parts]), np.cumsum(np.concatenate([[0], *(np.diff(at) for _, at in parts)]))
    raw = [w.encode() for w in words]
    text = np.frombuffer(b"".join(b"\2" + w + b"\3" for w in raw) + b"\0\0", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    grams = (text[:-2] * 1_000_003 + text[1:-1] * 8191 + text[2:] * 131) % GRAMS
    stops = np.cumsum(sizes)
    # The last two places of a word start no trigram of it (the last one, if it has no letter).
    inside = np.ones(int(stops[-1]) if len(stops) else 0, bool)
    inside[stops - 1] = False
    inside[(stops - 2)[sizes > 2]] = False
    return grams[: len(inside)][inside].astype(np.int16), np.concatenate(([0], np.cumsum(np.maximum(sizes - 2, 1))))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the windows of documents; a document without words has one without words."""
    counts = np.diff(offsets)
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    document = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[document] + k * STRIDE
    return document, start, np.minimum(WINDOW, offsets[document + 1] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, all float32; ``share`` stands in for a model that could not be fitted."""

    def __init__(self, vocabulary: list[str] = (), stems: list[str] = (), seed: int = 3):
        rng = np.random.default_rng(seed)
        made = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        d, h = WORD_DIM + GRAM_DIM + STEM_DIM, HIDDEN
        self.stems = {w: i + 1 for i, w in enumerate(stems)}
        self.rows = {w: i + 1 for i, w in enumerate(vocabulary)}  # row 0 is for all other words, and stays zero
        self.p = {"word": made(len(self.rows) + 1, WORD_DIM, s=0.05), "gram": made(GRAMS, GRAM_DIM, s=0.1), "attend": made(2 * h), "out": made(2 * h), "bias": np.full(1, -1.0, np.float32)}
        self.p["stem"] = made(len(self.stems) + 1, STEM_DIM, s=0.05)
        self.p["word"][0] = self.p["stem"][0] = 0
        for side in "fb":
            self.p |= {f"w{side}": made(d, 3 * h), f"u{side}": made(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.share: float | None = None

    def word_inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(embedding row, trigram buckets, trigram offsets, stem rows) of distinct words."""
        known = bare(words)
        get = self.stems.get
        stems = np.column_stack([np.fromiter((get(w[:k], 0) if len(w) >= k else 0 for w in known), np.int32, len(known)) for k in STEMS])
        return np.fromiter((self.rows.get(w, 0) for w in known), np.int64, len(known)), *trigrams(known), stems

    def embed(self, row: np.ndarray, grams: np.ndarray, at: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Inputs of distinct words, with a row of zeros (no word) before them."""
        x = np.zeros((len(row) + 1, WORD_DIM + GRAM_DIM + STEM_DIM), np.float32)
        if len(row):
            x[1:, :WORD_DIM] = self.p["word"][row]
            x[1:, -STEM_DIM:] = self.p["stem"][stems].sum(axis=1) / np.maximum((stems > 0).sum(axis=1), 1)[:, None]
            for lo in range(0, len(row), _WORDS_AT_ONCE):
                own = at[lo : lo + _WORDS_AT_ONCE + 1]
                x[1 + lo : len(own) + lo, WORD_DIM:-STEM_DIM] = np.add.reduceat(self.p["gram"][grams[own[0] : own[-1]]], own[:-1] - own[0], axis=0) / np.diff(own)[:, None]
        return x

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Inputs times the input weights, for both directions."""
        return {side: x @ self.p[f"w{side}"] + self.p[f"c{side}"] for side in "fb"}

    def forward(self, tables: dict[str, np.ndarray], places: np.ndarray, keep: bool = False):
        """Logits of windows; ``places`` (step, window) names rows of the tables, 0 where a window has ended."""
        steps, n = places.shape
        real = (places > 0).astype(np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        kept = {}
        for k, side in enumerate("fb"):
            table, u = tables[side], self.p[f"u{side}"]
            h = np.zeros((n, HIDDEN), np.float32)
            trace = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                g, r = table.take(places[t], axis=0), h @ u
                gates = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                new = np.tanh(g[:, 2 * HIDDEN :] + gates[:, :HIDDEN] * r[:, 2 * HIDDEN :])
                if keep:
                    trace.append((t, h, gates, new, r[:, 2 * HIDDEN :]))
                # A window keeps its state outside its words.
                h = h + gates[:, HIDDEN:] * (new - h) * real[t][:, None]
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            kept[side] = trace
        scores = np.where(real > 0, states @ self.p["attend"], np.float32(-1e4))
        scores = np.exp(scores - scores.max(axis=0))
        attention = scores / scores.sum(axis=0)
        pooled = (attention[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, states, attention, pooled, kept, real) if keep else logits

    def gradients(self, words: tuple, places: np.ndarray, target: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows, by backpropagation through time."""
        row, grams, at, stems = words
        x = self.embed(*words)
        logits, states, attention, pooled, kept, real = self.forward(self.tables(x), places, keep=True)
        error = ((_sigmoid(logits) - target) * importance / len(target)).astype(np.float32)
        out = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.p["out"]
        weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = attention * (weight - (attention * weight).sum(axis=0)) * real
        out["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = attention[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, w = self.p[f"u{side}"], self.p[f"w{side}"]
            d_u, d_table = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(target), HIDDEN), np.float32)
            for t, h, gates, new, pushed in reversed(kept[side]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                moved = d_h * real[t][:, None]
                reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
                d_new = moved * update * (1 - new * new)
                d_update = moved * (new - h) * update * (1 - update)
                d_reset = d_new * pushed * reset * (1 - reset)
                d_r = np.hstack((d_reset, d_update, d_new * reset))
                np.add.at(d_table, places[t], np.hstack((d_reset, d_update, d_new)))
                d_u += h.T @ d_r
                d_h = d_h - moved * update + d_r @ u.T
            d_table[0] = 0
            out |= {f"u{side}": d_u, f"w{side}": x.T @ d_table, f"c{side}": d_table.sum(axis=0)}
            d_x += d_table @ w.T
        d_x = d_x[1:]
        out["word"], out["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(out["word"], row, d_x[:, :WORD_DIM])
        out["word"][0] = 0
        d_stem = d_x[:, -STEM_DIM:] / np.maximum((stems > 0).sum(axis=1), 1)[:, None]
        out["stem"] = np.zeros_like(self.p["stem"])
        for k in range(len(STEMS)):
            np.add.at(out["stem"], stems[:, k], d_stem)
        out["stem"][0] = 0
        np.add.at(out["gram"], grams, np.repeat(d_x[:, WORD_DIM:-STEM_DIM] / np.diff(at)[:, None], np.diff(at), axis=0))
        return out

    def score_windows(self, x: np.ndarray, positions: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows (start, length) over word ``positions`` of a chunk."""
        out = np.zeros(len(start), np.float32)
        padded, tables = _padded(positions), self.tables(x)
        for at in range(0, len(start), _WINDOWS_AT_ONCE):
            some = slice(at, at + _WINDOWS_AT_ONCE)
            out[some] = self.forward(tables, place_rows(padded, start[some], length[some]))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Score of each text, 0 to 1."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        offsets, positions, words = split_words(texts)
        x = self.embed(*self.word_inputs(words.to_pylist()))
        document, start, length = windows(offsets)
        logits = self.score_windows(x, positions, start, length)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, document, logits)
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def _padded(positions: np.ndarray) -> np.ndarray:
    """Rows of the inputs by word place, 0 beyond the last."""
    return np.concatenate((positions + 1, np.zeros(WINDOW, np.int64)))


def place_rows(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(step, window): rows of the inputs, 0 past a window's end."""
    step = np.arange(WINDOW)[:, None]
    return np.where(step < length, padded[start + step], 0)


def _log_odds(offsets: np.ndarray, positions: np.ndarray, names: Iterator[list[str]], target: np.ndarray) -> tuple[list[str], np.ndarray]:
    """What the words (given by their names) of enough documents are called, and the log-odds of those documents being toxic."""
    number: dict[str, int] = {}
    sizes, numbers = array("q"), array("q")
    for own in names:
        sizes.append(len(own))
        numbers.extend([number.setdefault(n, len(number)) for n in own])
    starts, flat = np.concatenate(([0], np.cumsum(np.asarray(sizes)))), np.asarray(numbers)
    toxic, clean = np.zeros(len(number)), np.zeros(len(number))
    at = 0
    while at < len(target):  # some documents at a time
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _WORDS_AT_ONCE, "right")) - 1)
        own = positions[offsets[at] : offsets[stop]]
        counts = starts[own + 1] - starts[own]
        row = np.repeat(np.repeat(np.arange(at, stop), np.diff(offsets[at : stop + 1])), counts)
        of, name = np.divmod(np.unique(row * max(1, len(number)) + gather(starts, flat, own)), max(1, len(number)))
        toxic += np.bincount(name[target[of] == 1], minlength=len(number))
        clean += np.bincount(name[target[of] == 0], minlength=len(number))
        at = stop
    frequent = np.argsort(-(toxic + clean), kind="stable")[:VOCABULARY]
    frequent = frequent[(toxic + clean)[frequent] >= max(4, RARE * len(target))]
    odds = np.log((toxic + 0.5) / (target.sum() + 1)) - np.log((clean + 0.5) / ((1 - target).sum() + 1))
    called = list(number)
    return [called[i] for i in frequent], np.clip(odds, -3, 3)[frequent]


def fit(texts: list[str], target: np.ndarray, *, rounds: int = 5, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on documents; each round picks windows with the model as it is."""
    share = float(target.mean()) if len(target) else 0.5
    if not len(target) or share in (0.0, 1.0):
        net = Network()
        net.share = share
        return net
    rng = np.random.default_rng(seed)
    offsets, positions, words = split_words(pa.array(texts, pa.string()))
    known = bare(words.to_pylist())
    frequent, odds = _log_odds(offsets, positions, ([w] for w in known), target)
    stems, stem_odds = _log_odds(offsets, positions, ([w[:k] for k in STEMS if len(w) >= k] for w in known), target)
    del known
    net = Network(frequent, stems, seed)
    net.p["word"][1:, 0], net.p["stem"][1:, 0] = odds, stem_odds
    inputs = net.word_inputs(words.to_pylist())
    document, start, length = windows(offsets)
    # A fifth of the texts, copies together, is not learned from: the best round by it is kept.
    tried = np.fromiter((zlib.crc32(t.encode()) % 5 == 0 for t in texts), bool, len(texts))
    if not all(0 < target[part].sum() < part.sum() for part in (tried, ~tried)):
        tried[:] = False
    least, kept = np.inf, net.p
    padded = _padded(positions)
    peak = np.zeros(len(start), np.float32)
    first = np.concatenate(([0], np.maximum(net.p["word"][inputs[0], 0], net.p["stem"][inputs[3], 0].max(axis=1, initial=0))))
    for at in range(0, len(start), _WINDOWS_AT_ONCE):
        some = slice(at, at + _WINDOWS_AT_ONCE)
        peak[some] = first[place_rows(padded, start[some], length[some])].max(axis=0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for r in range(rounds + 1):
        if r:
            peak = net.score_windows(net.embed(*inputs), positions, start, length)
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, document, peak)
            fresh = tried if tried.any() else ~tried
            loss = np.where(target == 1, np.logaddexp(0, -worst), np.logaddexp(0, worst))[fresh].mean()
            if loss < least:
                least, kept = loss, {k: v.copy() for k, v in net.p.items()}
        if r == rounds:
            break
        order = np.lexsort((rng.random(len(start)), -peak, document))
        head = np.ones(len(order), bool)
        head[1:] = document[order][1:] != document[order][:-1]
        some = rng.permutation(len(start))
        chosen = np.concatenate((order[head], some[target[document[some]] == 0][: len(texts)]))
        chosen = rng.permutation(chosen[~tried[document[chosen]]])
        size = min(256, max(32, len(chosen) // 8))
        passes = -(-STEPS * size // len(chosen))
        for at in range(0, passes * len(chosen), size):
            part = np.take(chosen, np.arange(at, at + size), mode="wrap")
            places = place_rows(padded, start[part], length[part])
            used, local = np.unique(np.append(places, 0), return_inverse=True)  # 0, no word, is always row 0
            local, used = local[:-1].reshape(places.shape), used[1:] - 1
            counts = np.diff(inputs[2])[used]
            own = np.concatenate(([0], np.cumsum(counts)))
            grams = inputs[1][np.repeat(inputs[2][used] - own[:-1], counts) + np.arange(own[-1])]
            y = target[document[part]].astype(np.float32)
            weight = np.where(y == 1, min(4.0, 0.5 / max(share, 0.01)), 1.0).astype(np.float32)
            grads = net.gradients((inputs[0][used], grams, own, inputs[3][used]), local, y, weight)
            step += 1
            for k in ("word", "gram", "stem"):
                grads[k] += DECAY * net.p[k]
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.p = kept
    fresh = np.flatnonzero(tried if tried.any() else ~tried)
    _set_threshold(net, [texts[i] for i in fresh], target[fresh])
    return net


def _set_threshold(net: Network, texts: list[str], target: np.ndarray) -> None:
    """Shift the output so that 0.5 parts documents with the fewest errors, in the middle of that gap."""
    scores = net.score(pa.array(texts, pa.string()))
    logits = np.log(np.clip(scores, 1e-12, 1) / np.clip(1 - scores, 1e-12, 1))
    order = np.argsort(logits, kind="stable")
    y = target[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    edges = np.concatenate(([logits[order[0]] - 1], logits[order], [logits[order[-1]] + 1]))
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(edges[best + 1] - edges[best])]  # the widest gap
    net.p["bias"] -= np.float32((edges[k] + edges[k + 1]) / 2)


def train(documents: DataFrame, labels: DataFrame, allowed: Column, *, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """A model of ``label`` from at most ``2 * per_class`` rows that ``allowed`` (a column over ``labels``) admits."""
    sample = sample_of(documents, labels, label, allowed, per_class=per_class)
    return fitted(sample, lambda rows: fit([r[1] for r in rows], np.array([r[0] for r in rows], np.float32)))


def score(documents: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(net)  # fixed size
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(batch.column("text")))], ["id", "score"])

    rows = with_text(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return rows.mapInArrow(released(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, net: Network, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``documents`` without the rows that score ``threshold`` or more, all columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = pa.compute.fill_null(batch.column(text_col).cast(pa.string()), "")
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return documents.mapInArrow(released(run), documents.schema)
