"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: consecutive ranges of PASSAGE bytes that cover the whole text,
however long it is. Every passage is encoded
as character-class shares, hashed character-pair shares and repetition measures. A hidden layer and
gated attention (a tanh branch times a sigmoid branch, softmax over the bag) are learned from document labels
alone, and the attention-weighted passage representation is scored by a logistic layer.

Training takes a sample of at most `limit` labelled documents, those of smallest hash of doc_id, with up to
MOST passages of each, evenly spread; of rows that share a doc_id the one of smallest hash of its text. Scoring
covers all passages of all documents, in one pass without a shuffle.

Defined results: null texts count as empty, and an empty text is one passage of zeros; several
labels of one document are averaged and null ones left out; documents that share a doc_id are all
scored; with labels of fewer than two kinds, or none, the score is constant, (ones + 1) / (labels + 1);
passages of equal attention count alike, and the first is named; empty tables give no rows; other columns
pass through, but for score, n_passages and best_passage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches
from ._words import blocks, split

PASSAGE = 512
MOST = 256  # most passages of a document to learn from
SAMPLE = 4000  # most labelled documents to learn from
THRESHOLD = 0.7
HIDDEN, GATE, PAIRS = 32, 16, 64

# fixed values: bytes that count as one class each; bytes not listed are one more
CLASSES = [b" ", b"\n", b"\t\r\x0b\x0c", b"0123456789", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b".", b",;:", b"'\"`", b"|", b"#", b"*", b"%", b"&", b"$", b"!", b"?", b"()[]{}<>", b"/\\", b"-_+=~^@", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
N_CLASSES = len(CLASSES) + 1
FEATURES = N_CLASSES + PAIRS + 8


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for i, members in enumerate(CLASSES):
        table[list(members)] = i
    return table


_CLASS = _class_table()
_LINE = np.ones(256, bool)
_LINE[10] = False
_AS_IS = np.arange(256, dtype=np.uint8)


def _repeats(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 for every unit that another one of the same text equals."""
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(hashes))
    out[order[1:][same]] = 1
    out[order[:-1][same]] = 1
    return out


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text) of a block of texts."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    base = np.cumsum(count) - count
    total = int(count.sum())
    x = np.zeros((total, FEATURES))
    n = len(data)
    if n:
        text = np.repeat(np.arange(len(size)), size)
        of = base[text] + (np.arange(n) - offsets[:-1][text]) // PASSAGE
        kind = _CLASS[data]
        x[:, :N_CLASSES] = np.bincount(of * N_CLASSES + kind, minlength=total * N_CLASSES).reshape(total, -1)
        low = data.astype(np.uint32)
        pair = ((low[:-1] * np.uint32(31) + low[1:]) * np.uint32(2654435761) >> np.uint32(26)).astype(np.int64) % PAIRS
        x[:, N_CLASSES : N_CLASSES + PAIRS] = np.bincount(of[:-1] * PAIRS + pair, minlength=total * PAIRS).reshape(total, -1)
        x /= np.maximum(1, np.bincount(of, minlength=total))[:, None]
        for at, table in ((FEATURES - 8, None), (FEATURES - 4, _LINE)):
            units = split(data, offsets) if table is None else split(data, offsets, table, _AS_IS)
            if not len(units.starts):
                continue
            p, length = of[units.starts], units.ends - units.starts
            weight = np.maximum(1, np.bincount(p, minlength=total))
            again = _repeats(units.hashes, text[units.starts])
            x[:, at] = np.bincount(p, again * length, total) / np.maximum(1, np.bincount(p, length, total))
            x[:, at + 1] = np.log1p(np.bincount(p, length, total) / weight)
            x[:, at + 2] = np.log1p(np.bincount(p, minlength=total))
            stutter = np.zeros(len(p))
            stutter[1:] = (units.hashes[1:] == units.hashes[:-1]) & (text[units.starts][1:] == text[units.starts][:-1])
            x[:, at + 3] = np.bincount(p, stutter, total) / weight
    return x, count


def _encoded(batches):
    """Bags: their features as bytes."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            x, count = encode(data, offsets)
            x = x.astype(np.float32)
            cut = np.cumsum(count)
            spread = [np.arange(b - c, b) if c <= MOST else b - c + np.arange(MOST) * c // MOST for b, c in zip(cut.tolist(), count.tolist(), strict=True)]
            bags = [x[some].tobytes() for some in spread]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(bags, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["doc_id", "bag", "label"])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


@dataclass
class Model:
    """Weights by name; without weights, the constant score."""

    constant: float = 1.0
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w, begin = self.w, np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        x = np.clip((x - w["mean"]) / w["std"], -6, 6)
        h = np.maximum(0, x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage)."""
        if not self.w:
            return np.full(len(count), self.constant), np.repeat(1 / count, count)
        f = self.forward(x, count)
        return f["p"], f["a"]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log-loss of the bags."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(float((labels.sum() + 1) / (len(labels) + 1)))
    draw = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(float)
    std = x.std(axis=0)
    w = {"mean": x.mean(axis=0), "std": np.where(std > 1e-6, std, 1.0)}
    for name, shape in (("W", (FEATURES, HIDDEN)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("a", (GATE,)), ("c", (HIDDEN,))):
        w[name] = draw.normal(0, 1 / np.sqrt(shape[0]), shape)
    w["b"], w["d"] = np.zeros(HIDDEN), np.zeros(1)
    model = Model(w=w)
    learned = ("W", "b", "V", "U", "a", "c", "d")
    first, second, n = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            count = np.array([len(bags[k]) for k in some])
            f = model.forward(np.concatenate([bags[k] for k in some]).astype(float), count)
            begin, bag = np.cumsum(count) - count, f["bag"]
            dp = (f["p"] - labels[some]) / len(some)
            dz = dp[:, None] * w["c"]
            da = (f["h"] * dz[bag]).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, begin)[bag])
            dtg = de[:, None] * w["a"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (f["h"] > 0)
            grad = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dp, "d": dp.sum(keepdims=True)}
            n += 1
            for k in learned:
                g = grad[k] + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """A null doc_id is not held out; as it can't name a label, it isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Learn from the labelled documents that aren't held out, at most `limit` of them."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    # the sample's bound is what allows it to be broadcast and its bags to be collected
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
    rows = rows.select("doc_id", "text", "label").mapInArrow(_encoded, "doc_id long, bag binary, label double")
    got = sorted(rows.toLocalIterator(prefetchPartitions=True), key=lambda r: (r.doc_id, bytes(r.bag)))
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in got], np.array([r.label for r in got]))


def _scored(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                x, count = encode(data, offsets)
                score, attention = model.score(x, count)
                begin = np.cumsum(count) - count
                best = [int(attention[b : b + c].argmax()) for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
                rest = [batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *rest, pa.array(score), pa.array(count.astype(np.int32)), pa.array(best, pa.int32())], names=[*batch.schema.names, "score", "n_passages", "best_passage"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and the other columns given, then score, n_passages, and best_passage (that of most weight).

    Input columns of the last three names give way.
    """
    bound_batches(docs.sparkSession)
    first = ["doc_id", "text"]
    rows = docs.select(*first, *[docs[c] for c in docs.columns if c not in (*first, "score", "n_passages", "best_passage")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), f"{schema}, score double, n_passages int, best_passage int")
