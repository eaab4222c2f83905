"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 512 bytes, all of them, down to the end of its text. A passage is encoded from
the kinds of its neighbouring bytes and from how often it repeats itself, all stretches of eight bytes looked at. A gated
attention layer, learned from the labels of whole documents, weighs the passages; the weighted passage representation is
scored by a logistic layer. Tasks encode and score their own rows, a bounded number of passages at a time; the weights are
a few thousand numbers, fitted on the driver on a bounded sample of labelled documents.

Scores do not depend on which texts are scored together: features and weights are whole multiples of 2 ** -20, so that
products and their sums over features are exact in double precision, in whatever order they are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.shared import read, text_of

PASSAGE = 512
#: Labelled documents that the model is fitted on at most (those with the smallest hash of their id), and passages of each
#: (evenly spread over its text). Scoring takes all passages of all documents.
TRAIN_ROWS, TRAIN_PASSAGES = 3000, 64
#: Passages that one array step encodes.
STEP = 1024
HIDDEN, GATE, STEPS, RATE, DECAY = 24, 12, 160, 0.02, 1e-4
CUT = 0.3

#: Kinds of bytes: lower, upper, digit, space, line break, end mark, comma, exclamation, bar, other marks, not ASCII, control.
KINDS = 12
_KIND = np.full(256, 11, dtype=np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".?", b",;:", b"!", b"|")):
    _KIND[list(_bytes)] = _k
_KIND[[x for x in range(33, 127) if _KIND[x] == 11]] = 9
_KIND[128:] = 10
FEATURES = KINDS * KINDS + 2


def _new_share(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each passage the share of distinct ones among all its stretches of eight bytes; 1 for a passage without any."""
    share = np.ones(len(size))
    some = np.flatnonzero(size >= 8)
    if len(some):
        eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            last = size[part] - 8
            rows = eights[begin[part, None] + np.minimum(np.arange(last.max() + 1), last[:, None])]  # shorter passages repeat their last one
            rows.sort(axis=1)
            share[part] = (1 + (rows[:, 1:] != rows[:, :-1]).sum(1)) / (last + 1)
    return share


def _exact(x: np.ndarray) -> np.ndarray:
    """The nearest whole multiples of 2 ** -20."""
    return np.rint(x * 2**20) / 2**20


def cut_passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bag sizes, and where each passage begins and how long it is, of the texts data[offsets[i] : offsets[i + 1]]."""
    starts, lengths = offsets[:-1], np.diff(offsets)
    bags = np.maximum(1, -(-lengths // PASSAGE))
    place = np.arange(bags.sum()) - np.repeat(np.cumsum(bags) - bags, bags)
    return bags, np.repeat(starts, bags) + place * PASSAGE, np.clip(np.repeat(lengths, bags) - place * PASSAGE, 0, PASSAGE)


def encode(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One row of features for each of the passages data[begin : begin + size], which come one after the other."""
    out = np.zeros((len(size), FEATURES))
    if size.any():
        data, begin = data[begin[0] : begin[-1] + size[-1]], begin - begin[0]
        if len(data) > size.sum():  # leave out what lies between the passages
            data = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            begin = np.cumsum(size) - size
        kind = _KIND[data]
        pair = np.repeat(np.arange(len(size), dtype=np.int32) * (KINDS * KINDS), size)
        pair[:-1] += kind[:-1] * np.uint8(KINDS) + kind[1:]
        inner = np.ones(len(data), dtype=bool)
        inner[(begin + size - 1)[size > 0]] = False  # the last byte of a passage has no neighbour in it
        counts = np.bincount(pair[inner], minlength=len(size) * KINDS * KINDS).reshape(len(size), -1)
        out[:, : KINDS * KINDS] = counts / np.maximum(size - 1, 1)[:, None]
    out[:, -2] = _new_share(data, begin, size)
    out[:, -1] = np.log1p(size) / np.log1p(PASSAGE)
    return _exact(out)


def _in_steps(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(begin), STEP):
        yield encode(data, begin[at : at + STEP], size[at : at + STEP])


@dataclass
class QualityModel:
    """Weights of the classifier; `score` gives a probability for each bag."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts data[offsets[i] : offsets[i + 1]], each text's alone."""
        bags, begin, size = cut_passages(offsets)
        if self.constant is not None or not len(bags):
            return np.full(len(bags), self.constant or 0.0)
        w = {k: v.astype(np.float64) for k, v in self.weights.items()}
        wide, shift = _exact(self.scale[:, None] * w["W"]), w["b"] - (self.mean * self.scale) @ w["W"]
        gates, low = _exact(np.concatenate((w["V"], w["U"]), axis=1)), _exact(w["w"])
        h, e = np.empty((len(begin), HIDDEN), dtype=np.float32), np.empty(len(begin))  # 21 bits of h are exact in 32
        at = 0
        for rows in _in_steps(data, begin, size):
            own = _exact(np.tanh(rows @ wide + shift))
            both = own @ gates
            e[at : at + len(rows)] = _exact(np.tanh(both[:, :GATE]) / (1 + np.exp(-both[:, GATE:]))) @ low
            h[at : at + len(rows)] = own
            at += len(rows)
        z, _ = _attend(h, e, bags)
        return 1 / (1 + np.exp(-np.clip(_exact(z) @ _exact(w["c"]) + w["d"], -30, 30)))


def _attend(h: np.ndarray, e: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted representation of each bag, and the weights: a softmax over the passages of the bag."""
    heads = np.cumsum(bags) - bags
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), bags))
    a /= np.repeat(np.add.reduceat(a, heads), bags)
    return np.add.reduceat(a[:, None] * h, heads), a


def _forward(w: dict, x: np.ndarray, bags: np.ndarray) -> dict:
    """Gated attention over each bag: softmax of w'(tanh(HV) * sigmoid(HU)), then a logistic layer on the mean."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    z, a = _attend(h, (t * s) @ w["w"], bags)
    return {"heads": np.cumsum(bags) - bags, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": np.clip(z @ w["c"] + w["d"], -30, 30)}


def fit(bags: np.ndarray, rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Adam on the mean log loss of the documents. With one class only, or none, the score is constant."""
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), {}, float(labels[0]) if len(labels) else 0.5)
    mean, scale = rows.mean(0, dtype=np.float64), 1 / (rows.std(0, dtype=np.float64) + 0.05)
    x, y = ((rows - mean) * scale).astype(np.float32), labels.astype(np.float32)
    draw = np.random.default_rng(seed)
    w = {
        "W": draw.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": draw.normal(0, GATE**-0.5, GATE), "c": draw.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = _forward(w, x, bags)
        h, t, s, a, heads = (f[k] for k in ("h", "t", "s", "a", "heads"))
        by_doc = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        dz = np.repeat(by_doc, bags)[:, None] * w["c"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, heads), bags))
        dts = de[:, None] * w["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ by_doc, "d": by_doc.sum(keepdims=True)}
        for k, g in grad.items():
            g = g + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, scale, w)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, as they lie in the batch."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), at


def held_out(id_column: str = "doc_id") -> Column:
    """A fifth of the ids, by crc32 of their text: they are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", text_column: str = "text", most: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most `most` labelled documents that are not held out; tasks encode them, the driver gets features.

    Of a longer document TRAIN_PASSAGES passages, evenly spread, are learned from, so the driver gets a bounded number of
    features. Labels other than 0 and 1, null ids and labels without a document are passed over; of repeated labels of one
    id the larger counts, and of repeated documents the least text. Without labels, or with those of one kind only,
    the model gives one score to all.
    """
    chosen = (
        labels.filter(F.col(label_column).isin(0, 1) & ~held_out(id_column) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    texts = docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("id").cast("string"), "label", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column(2))
            bags, begin, size = cut_passages(offsets)
            taken = np.minimum(bags, TRAIN_PASSAGES)
            nth = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            own = np.repeat(np.cumsum(bags) - bags, taken) + nth * np.repeat(bags, taken) // np.repeat(taken, taken)
            begin, size, ends, at = begin[own], size[own], np.cumsum(taken).tolist(), 0
            for k, end in enumerate(ends):
                coded = encode(data, begin[at:end], size[at:end]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([coded], type=pa.binary())], names=["id", "label", "features"])
                at = end

    got = sorted(rows.mapInArrow(task, "id string, label int, features binary").collect(), key=lambda r: r.id)
    each = [np.frombuffer(r.features, dtype=np.float32).reshape(-1, FEATURES) for r in got]
    bags = np.array([len(x) for x in each], dtype=np.int64)
    return fit(bags, np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32), np.array([r.label for r in got]))


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """The columns of `docs` with `score` (0 to 1), which replaces a column of that name.

    Every passage of every text is scored. Null and empty texts are a bag of one empty passage and get a score too; equal
    texts get equal scores, however the table is partitioned; repeated rows stay, and an empty table gives no rows.
    """
    rows = docs.drop("score")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    where = rows.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(*_texts(pc.fill_null(batch.column(where), ""))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=schema.names)

    return rows.mapInArrow(task, schema)


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
