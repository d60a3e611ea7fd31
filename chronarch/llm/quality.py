"""Quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages.  A passage is encoded by learned embeddings of its
hashed words and their first and last letters, and by measures of its characters and
words; gated attention, learned with them from document labels alone, weighs the
passages, and a logistic layer scores their weighted mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.tables import Scratch, prepare, with_results
from chronarch.llm.toxicity import labelled_sample

_U = np.uint64
#: Bounds of the sample: labelled documents, and bytes of all their texts.
MOST_EXAMPLES, MOST_BYTES = 4000, 64 << 20
#: Words of a passage; size of an encoded passage and of the attention; hashed embeddings; letters at a word's ends.
PASSAGE, HIDDEN, BUCKETS, LETTERS = 48, 16, 4096, 3
#: Steps of the fit, documents in each, and its rate.
STEPS, AT_ONCE, RATE = 400, 128, 0.02
#: Documents scored at once.
ROWS = 512


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures of each passage, hashed features of each word, words of each passage, passages of each text).

    A text without words is one passage of zeros.
    """
    rows, features, words_of, sizes = [], [], [], []
    kinds = np.zeros((8, 256), np.float32)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b".,;:", b"#*$%&<>@^~_=+/\\{}[]", b"\"'()-")):
        kinds[k, list(chars)] = 1
    kinds[7, 128:] = 1
    for w in ta.chunks(column):
        n_words = np.diff(w.offsets)
        parts = np.maximum(1, -(-n_words // PASSAGE))
        part_of = np.repeat(np.cumsum(parts) - parts, n_words) + (np.arange(len(w.starts)) - np.repeat(w.offsets[:-1], n_words)) // PASSAGE
        n = int(parts.sum())
        count = np.bincount(part_of, minlength=n)[:n]
        some = np.maximum(count, 1)
        length = (w.ends - w.starts).astype(np.float64)
        chars = np.maximum(np.bincount(part_of, weights=length, minlength=n), 1)
        out = [np.minimum(count / PASSAGE, 1), np.log1p(chars / some), np.log1p(np.bincount(part_of, weights=length**2, minlength=n) / some)]
        for kind in kinds:
            sums = np.r_[0, np.cumsum(kind[w.data], dtype=np.float64)]
            out.append(np.bincount(part_of, weights=sums[w.ends] - sums[w.starts], minlength=n) / chars)
        letters = w.letters(lower=True)
        words = ta.spans(letters, w.starts, w.ends)
        head = ta.spans(letters, w.starts, np.minimum(w.starts + LETTERS, w.ends))
        tail = ta.spans(letters, np.maximum(w.ends - LETTERS, w.starts), w.ends)
        features.append(np.stack([(ta.mix(x + _U(k)) % _U(BUCKETS)).astype(np.uint16) for k, x in enumerate((words, head, tail))], 1))
        own = ta.mix(words ^ ta.mix(part_of.astype(_U) + _U(3)))
        _, first = np.unique(own, return_index=True)
        out.append(np.bincount(part_of[first], minlength=n) / some)
        same = np.r_[False, words[1:] == words[:-1]] if len(words) else np.zeros(0, bool)
        out.append(np.bincount(part_of[same], minlength=n) / some)
        for other in (2, 3):  # words that come again at a distance
            again = np.zeros(len(words), bool)
            again[other:] = words[other:] == words[:-other]
            out.append(np.bincount(part_of[again], minlength=n) / some)
        ends = w.data[w.ends - 1] if len(words) else np.zeros(0, np.uint8)
        odd = kinds[5][ends] + kinds[3][ends] + kinds[2][ends]
        out.append(np.bincount(part_of, weights=odd, minlength=n) / some)
        rows.append(np.stack(out, 1).astype(np.float32))
        words_of.append(count), sizes.append(parts)
    if not rows:
        return np.zeros((0, 16), np.float32), np.zeros((0, 3), np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(words_of), np.concatenate(sizes)


def _sum_by(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _mean_embedding(table: np.ndarray, features: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean of the embeddings of each passage's words; zeros without words."""
    out = np.zeros((len(words), table.shape[1]), table.dtype)
    some = words > 0
    if some.any():
        each = table[features[:, 0]] + table[features[:, 1]] + table[features[:, 2]]
        out[some] = _sum_by(each, (np.cumsum(words) - words)[some]) / words[some, None]
    return out


def forward(m: dict, x: np.ndarray, features: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> dict:
    x = np.clip((x - m["mean"]) / m["deviation"], -6, 6)
    starts = np.cumsum(sizes) - sizes
    h = np.tanh(_mean_embedding(m["W"], features, words) + x @ m["E"] + m["e"])  # the encoded passage
    v, u = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (v * u) @ m["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    a = a / np.repeat(_sum_by(a, starts), sizes)
    z = _sum_by(h * a[:, None], starts)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))
    return {"x": x, "starts": starts, "h": h, "v": v, "u": u, "a": a, "z": z, "p": p}


def gradients(m: dict, x: np.ndarray, features: np.ndarray, words: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss, by each of the model's arrays."""
    f = forward(m, x, features, words, sizes)
    error = (f["p"] - y) / len(y)
    g = {"c": f["z"].T @ error, "b": np.sum(error)}
    dz = np.repeat(error[:, None] * m["c"], sizes, axis=0)
    da = np.sum(dz * f["h"], 1)
    da = f["a"] * (da - np.repeat(_sum_by(da * f["a"], f["starts"]), sizes))
    g["w"] = (f["v"] * f["u"]).T @ da
    dv = da[:, None] * m["w"] * f["u"] * (1 - f["v"] ** 2)
    du = da[:, None] * m["w"] * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dh = (dz * f["a"][:, None] + dv @ m["V"].T + du @ m["U"].T) * (1 - f["h"] ** 2)
    g["E"], g["e"] = f["x"].T @ dh, dh.sum(0)
    each = np.repeat(dh / np.maximum(words, 1)[:, None], words, axis=0)
    g["W"] = np.stack([sum(np.bincount(features[:, k], weights=each[:, d], minlength=len(m["W"])) for k in range(3)) for d in range(each.shape[1])], 1)
    return g


def fit(x: np.ndarray, features: np.ndarray, words: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
    """Fit by Adam on ``AT_ONCE`` examples a step, from a fixed seed; returns the model's arrays."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    shape = {"W": (BUCKETS, HIDDEN), "E": (d, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "w": (HIDDEN,), "c": (HIDDEN,), "b": ()}
    m = {k: rng.normal(0, 0.05 if k == "W" else 0.3, s) for k, s in shape.items()}
    m["b"] = np.zeros(())
    m["mean"], m["deviation"] = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    if len(np.unique(y)) < 2:  # nothing to tell apart: the label there is, or 1
        m["c"][:] = 0
        m["b"] = np.array(8.0 if not len(y) or y[0] else -8.0)
        return m
    passage, word = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(words)]
    first = {k: np.zeros(s) for k, s in shape.items()}
    second = {k: np.zeros(s) for k, s in shape.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < min(AT_ONCE, len(y)):
            order = np.concatenate([order, rng.permutation(len(y))])
        own, order = order[:AT_ONCE], order[AT_ONCE:]
        p = np.concatenate([np.arange(passage[k], passage[k + 1]) for k in own])
        f = np.concatenate([np.arange(word[passage[k]], word[passage[k + 1]]) for k in own])
        g = gradients(m, x[p], features[f], words[p], sizes[own], y[own])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))  # even at first, then down to none
        for k in shape:
            g[k] = g[k] + 1e-5 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score_quality(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with score and predicted; without ``keep_text``, not the text.

    Learns from labels (id_col, label 0 or 1) where ``learnable`` holds; the sample
    has at most ``MOST_EXAMPLES`` documents of ``MOST_BYTES`` in all, whose measures and
    hashed words (not texts) the driver fits.  score: likelihood of label 1; predicted:
    1 if it is ``threshold`` or more.  A null or empty text is one passage of zeros and
    gets what the model says of that.  Null labels and labels of unknown ids are left
    out; repeated labels count once, as the greatest, and so do repeated ids.  Without
    labels, or labels of one kind, all documents get that label (1 without any).  No
    rows: no rows.  Input columns named like a result are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, features, words, sizes = passages(batch["text"])
            at = np.cumsum(sizes)[:-1]
            split = lambda a, at: [p.tobytes() for p in np.split(a, at)] if len(sizes) else []
            in_words = np.r_[0, np.cumsum(words)][at]
            parts = {"x": split(x, at), "f": split(features, in_words), "w": split(words.astype(np.int32), at)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "y": batch["y"]} | {k: pa.array(v, pa.binary()) for k, v in parts.items()})

    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").alias(label))
    sample = scratch.written(labelled_sample(texts, own, label, learnable, MOST_EXAMPLES, MOST_BYTES), "examples")
    rows = sorted(sample.mapInArrow(example, "doc_id long, y int, x binary, f binary, w binary").collect(), key=lambda r: r["doc_id"])  # of at most MOST_BYTES of texts
    scratch.close()
    width = passages(pa.array(["a"]))[0].shape[1]
    of = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows] or [np.zeros(0, kind)]
    words = of("w", np.int32)
    model = fit(np.concatenate(of("x", np.float32)).reshape(-1, width).astype(np.float64), np.concatenate(of("f", np.uint16)).reshape(-1, 3), np.concatenate(words).astype(np.int64), np.array([len(w) for w in words] if rows else [], np.int64), np.array([r["y"] for r in rows], np.float64))
    shared = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                score = forward(shared.value, *passages(batch["text"]))["p"]
                yield pa.RecordBatch.from_pydict({"row": batch["row"], "score": pa.array(score.astype(np.float64), pa.float64())} | ({"text": batch["text"]} if keep_text else {}))

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double" + ", text string" * keep_text)
    back = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if keep_text or c != text_col]
    done = done.select(*back, F.col("score").alias("__score"))
    return with_results(done, {"score": F.col("__score"), "predicted": (F.col("__score") >= threshold).cast("int")}).drop("__score")
