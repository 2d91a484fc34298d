"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole document at STRIDE bytes. A segment's
strongest response per filter is kept; a chunk is two neighbouring segments, so chunks overlap by
half and together cover every byte. Over the chunks, the maximum, the mean and the minimum of
each filter's response and the logarithm of the length feed a small hidden layer, which gives
one probability.

The network is fitted on the driver on a bounded sample of labelled rows: `train_rows` of them at
most, the smallest by a hash of their id in each class. Of a longer text, a run of `train_chars`
characters at a place by that hash stands for it, with the whole text's length. Scoring is one map
over the table: every byte of every text is seen, in slices of SLICE bytes, a text has no influence
on another, and the model that tasks receive has a fixed size.

Defined results: a null text counts as empty; an empty text is scored as one window of zero
bytes; repeated rows and ids keep a row each; a null id counts as the empty text in the
hold-out rule; labels that are null are ignored, and so is an id whose labels differ; of several
texts of one labelled id the smallest is learned from; without labels of both classes every score
is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardlens.llm.text import byte_column, is_held_out, quoted, row_of, slices, tidy

WIDTH, STRIDE, FILTERS, SEGMENT, HIDDEN, EMBEDDED = 8, 4, 24, 128, 16, 8
SLICE = 192 << 10
#: Segments whose windows are held at a time when gradients are summed.
ROWS_AT_ONCE = 2048


@dataclass
class Network:
    """Weights; `table` holds the filters' responses to each byte at each of WIDTH places."""

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    a: np.ndarray
    a0: np.ndarray
    o: np.ndarray
    o0: np.ndarray
    constant: float | None = None
    table: np.ndarray = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        return cls(n(256, EMBEDDED), n(WIDTH, EMBEDDED, FILTERS, by=0.15), n(FILTERS, by=0.01), n(3 * FILTERS + 1, HIDDEN, by=0.15), np.zeros(HIDDEN, np.float32), n(HIDDEN, by=0.2), np.zeros(1, np.float32))

    def weights(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("e", "w", "b", "a", "a0", "o", "o0")}

    def tabulate(self) -> Network:
        self.table = np.ascontiguousarray(np.einsum("vd,kdf->kvf", self.e, self.w), dtype=np.float32)
        return self


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded bytes, window starts, and windows of each text (one at least)."""
    count = np.array([max(1, -(-len(t) // STRIDE)) for t in texts], dtype=np.int64)
    size = count * STRIDE + WIDTH
    buffer = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, size.tolist(), strict=True)), dtype=np.uint8)
    first = np.cumsum(size) - size
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return buffer, np.repeat(first, count) + STRIDE * step, count


def responses(net: Network, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Filter responses at window starts."""
    out = net.table[0][buffer[at]]
    for k in range(1, WIDTH):
        out += net.table[k][buffer[at + k]]
    return out


def _starts(count: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of `unit` items inside consecutive groups of `count` items; runs of each group."""
    runs = -(-count // unit)
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.cumsum(count) - count, runs) + unit * step, runs


def _size(windows: np.ndarray) -> np.ndarray:
    """The logarithm of the length, centred at a few hundred bytes."""
    return (np.log(windows) - 5).astype(np.float32)


def _segments(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strongest responses in each segment of each text, and the segments of each text."""
    buffer, at, count = _layout(texts)
    starts, segments = _starts(count, SEGMENT)
    return np.maximum.reduceat(responses(net, buffer, at), starts, axis=0), segments


def _long_segments(net: Network, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text of more than SLICE bytes, a slice of whole segments at a time."""
    parts = []
    for at in range(0, len(text), SLICE):
        piece = text[at : at + SLICE]
        buffer, starts, _ = _layout([piece])
        buffer = buffer.copy()
        ahead = np.frombuffer(text[at + SLICE : at + SLICE + WIDTH], dtype=np.uint8)
        buffer[len(piece) : len(piece) + len(ahead)] = ahead  # what the slice's last windows see of the next one
        parts.append(np.maximum.reduceat(responses(net, buffer, starts), np.arange(0, len(starts), SEGMENT), axis=0))
    return np.concatenate(parts), np.array([sum(map(len, parts))])


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Maximum, mean and minimum over overlapping chunks of the strongest responses; the length."""
    seg, segments = _long_segments(net, texts[0]) if len(texts) == 1 and len(texts[0]) > SLICE else _segments(net, texts)
    count = np.array([max(1, -(-len(t) // STRIDE)) for t in texts])
    first = np.cumsum(segments) - segments
    last = np.zeros(len(seg), dtype=bool)
    last[first + segments - 1] = True
    chunk = seg.copy()
    inner = np.flatnonzero(~last)
    chunk[inner] = np.maximum(seg[inner], seg[inner + 1])
    weight = np.ones(len(seg), np.float32)
    weight[first + segments - 1] = (segments == 1).astype(np.float32)  # the last segment alone is no chunk of its own
    mean = np.add.reduceat(chunk * weight[:, None], first, axis=0) / np.maximum(segments - 1, 1)[:, None]
    chunk[(weight == 0)] = np.inf
    least = np.minimum.reduceat(chunk, first, axis=0)
    three = np.concatenate([np.maximum.reduceat(seg, first, axis=0), mean, least], axis=1) + np.tile(net.b, 3)
    return np.concatenate([three, _size(count)[:, None]], axis=1)


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    parts = [pooled(net, texts[a:b]) for a, b in slices(texts, SLICE)]
    if not parts:
        return np.zeros(0)
    hidden = np.tanh(np.concatenate(parts) @ net.a + net.a0)
    return 1 / (1 + np.exp(-np.clip((hidden @ net.o + net.o0).astype(np.float64), -40, 40)))


def _best_windows(net: Network, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The window of the strongest response of each filter in each segment, and that response; a slice of the text at a time."""
    best, value = [], []
    for at in range(0, max(1, len(text)), SLICE):
        piece = text[at : at + SLICE]
        buffer, starts, _ = _layout([piece])
        buffer = buffer.copy()
        ahead = np.frombuffer(text[at + SLICE : at + SLICE + WIDTH], dtype=np.uint8)
        buffer[len(piece) : len(piece) + len(ahead)] = ahead  # what the slice's last windows see of the next one
        out = responses(net, buffer, starts)
        segments = -(-len(out) // SEGMENT)
        full = np.full((segments * SEGMENT, FILTERS), -np.inf, np.float32)
        full[: len(out)] = out
        own = full.reshape(segments, SEGMENT, FILTERS).argmax(1) + SEGMENT * np.arange(segments)[:, None]
        value.append(full[own, np.arange(FILTERS)])
        best.append(own + at // STRIDE)
    return np.concatenate(best), np.concatenate(value)


def _gradients(net: Network, text: bytes, label: float, weight: float) -> dict[str, np.ndarray]:
    count = np.array([max(1, -(-len(text) // STRIDE))])
    best, value = _best_windows(net, text)
    f = np.arange(FILTERS)
    if len(best) > 1:
        pick, strongest = np.where(value[:-1] >= value[1:], best[:-1], best[1:]), np.maximum(value[:-1], value[1:])
    else:
        pick, strongest = best, value
    top, weak = best[value.argmax(0), f], pick[strongest.argmin(0), f]
    v = np.concatenate([np.concatenate([value.max(0), strongest.mean(0), strongest.min(0)]) + np.tile(net.b, 3), _size(count)])
    h = np.tanh(v @ net.a + net.a0)
    p = 1 / (1 + np.exp(-np.clip(h @ net.o + net.o0, -30, 30)))
    d = (p - label) * weight
    dh = d * net.o * (1 - h * h)
    dv = net.a @ dh
    rows = np.concatenate([top[None], weak[None], pick])
    to_max, to_mean, to_min = dv[:-1].reshape(3, FILTERS)
    padded = np.frombuffer(text + b"\0" * (STRIDE + WIDTH), dtype=np.uint8)
    dw, de = np.zeros_like(net.w), np.zeros_like(net.e)
    for at in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[at : at + ROWS_AT_ONCE]
        grad = np.repeat(to_mean[None] / len(pick), len(part), axis=0)
        if at == 0:
            grad[:2] = to_max, to_min
        near = padded[part[..., None] * STRIDE + np.arange(WIDTH)]  # rows, filters, places
        dw += np.einsum("rfkd,rf->kdf", net.e[near], grad, optimize=True)
        np.add.at(de, near, grad[..., None, None] * net.w.transpose(2, 0, 1)[None])
    return {"e": de, "w": dw, "b": dv[:-1].reshape(3, FILTERS).sum(0), "a": np.outer(v, dh), "a0": dh, "o": d * h, "o0": d}


def fit(texts: list[bytes], labels: list[int], weights: list[float], steps: int = 540, batch: int = 24, rate: float = 0.006, seed: int = 1) -> Network:
    """Adam over the weighted log loss, for at least `steps` batches of whole passes."""
    net = Network.fresh(seed).tabulate()
    params = net.weights()
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    r, step = np.random.default_rng(seed), 0
    each = -(-len(texts) // batch)
    epochs = -(-steps // each)
    total = epochs * each
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            for i in part:
                shift = int(r.integers(0, STRIDE)) if len(texts[i]) > WIDTH else 0
                for k, g in _gradients(net, texts[i][shift:], labels[i], weights[i]).items():
                    grads[k] += g
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, p in params.items():
                g = grads[k] / len(part) + 1e-4 * p
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                p -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
            net.tabulate()
    return net


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 1600, modulus: int = 5, remainder: int = 0) -> Network:
    """A network fitted on a bounded sample of the labelled rows that are not held out: `train_rows` whole texts at most, held by the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    share = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two classes
    if not share.get(0) or not share.get(1):
        net = Network.fresh(0)
        net.constant = share.get(1, 0) / sum(share.values()) if share else 0.5
        return net
    each = train_rows // 2
    sample = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        sample = part if sample is None else sample.unionByName(part)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.orderBy("quality", F.xxhash64("doc_id"), "doc_id").collect()  # train_rows at most
    if {r.quality for r in rows} != {0, 1}:
        net = Network.fresh(0)
        net.constant = share[1] / (share[0] + share[1])
        return net
    n = {label: sum(r.quality == label for r in rows) for label in (0, 1)}
    whole = share[0] + share[1]
    weight = {label: share[label] / whole * len(rows) / n[label] for label in (0, 1)}
    return fit([r.text.encode() for r in rows], [r.quality for r in rows], [weight[r.quality] for r in rows])


def _with_score(rows: DataFrame, net: Network, score: str) -> DataFrame:
    """`row, <score>` of rows(row, text): the text does not come back from the tasks' Python."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(model.value, byte_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], names=["row", score])

    return rows.mapInArrow(tidy(run), rows.select("row").schema.add(score, "double"))


def scored(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """The input rows, whatever their columns, with a score column (replaced if the input has one, in any case of letters)."""
    kept = docs.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() != score.lower()))
    return _with_score(docs.select(row_of(kept).alias("row"), F.col(quoted(text)).alias("text")), net, "_score").select("row.*", F.col("_score").alias(score))


def kept(docs: DataFrame, net: Network, least: float, text: str = "text") -> DataFrame:
    """The input rows, whatever their columns, whose score is `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), text).cast(pa.large_binary()).to_pylist()
            p = probabilities(model.value, [t or b"" for t in texts])
            yield batch.filter(pa.array(p >= least))

    rows = docs.select(row_of(docs).alias("row"))
    return rows.mapInArrow(tidy(run), rows.schema).select("row.*")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row."""
    net = train(docs, labels, modulus=modulus, remainder=remainder)
    out = _with_score(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text"), net, "score").select("row.doc_id", "score")
    return out.select("doc_id", is_held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
