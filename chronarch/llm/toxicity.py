"""Toxicity by the nearest labelled examples, in exact TF-IDF cosine over all terms.

A bounded sample of labelled documents gives the examples; their terms are words, and
beginnings of words where these tell labels, as inflected words share little else.
Document frequencies are counted over all documents.  Terms that tell labels may weigh
more than TF-IDF has it, if the examples' own votes are told better so; no term is left
out, and the norm is over all.  The inverted index is cut
into blocks of similar examples.  Terms that few examples have are scored in full;
of the others a block has the greatest weight, so that the best that a block can
reach is known before its examples are scored.  Blocks that cannot reach the k-th
best cosine are passed over: the neighbours found are those of a full comparison.

Votes are weighted by cosine.  Their share is calibrated by a logistic curve fitted
to the examples' own votes, each without itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.sketch import counts
from chronarch.llm.tables import Scratch, prepare, with_results

_U = np.uint64
#: Bounds of the sample: labelled documents, and bytes of all their texts.
MOST_EXAMPLES, MOST_BYTES = 4000, 64 << 20
#: Nearest examples that vote (with all that tie with the last of them), and weight of the prior among them.
NEAREST, PRIOR_WEIGHT = 47, 0.5
#: Fewer that vote where the examples' own votes are told better by them.
FEWER = (11, 23)
#: Characters of words' beginnings that can be terms; least likelihood-ratio statistic (chi-square, one degree) of a term that tells
#: labels, as many are tried; how much more such terms may weigh, for each unit of the logarithm of how much likelier one label makes them.
STEMS, TELLING, BOOSTS = (3, 4, 5, 6), 30.0, (0.0, 0.25, 4.0)
_STEM = _U(0x5DEECE66D)
#: Terms added up at once.
MOST_HELD = 1 << 20
#: Cosines that differ by less are ties.
TIE = 1e-6
#: Examples in a block; a term is common if one example in so many has it, for so many terms at most; texts scored at once.
BLOCK, COMMON, MOST_COMMON, AT_ONCE = 32, 16, 1024, 128


def beginnings(w: ta.Words, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes) for each number of characters in ``STEMS``; shorter words have no such beginning."""
    first = (w.data & 0xC0) != 0x80  # bytes that begin a character
    at = np.cumsum(first)[w.starts] - 1
    ends = np.r_[np.flatnonzero(first), len(w.data), np.full(max(STEMS), len(w.data) + 1)]
    for n in STEMS:
        end = ends[at + n]
        long = np.flatnonzero(end <= w.ends)
        yield long, ta.mix(ta.spans(letters, w.starts[long], end[long]) ^ _STEM)


def term_counts(column: pa.Array, stems: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text, as sorted 64-bit hashes, and their counts.

    Terms are words (A-Z as a-z) and those of their beginnings that are in ``stems`` (sorted); None: all.
    """
    own = np.zeros(1 << 16, bool)
    own[(stems if stems is not None else np.zeros(0, _U)) & _U(0xFFFF)] = True
    for w in ta.chunks(column, ta.NOT_ALPHANUMERIC_RAW):
        letters = w.letters(lower=True)
        parts = [(w.offsets, ta.spans(letters, w.starts, w.ends))]  # where each text begins among the terms, and the terms
        for place, h in beginnings(w, letters) if stems is None or len(stems) else ():
            if stems is not None:
                likely = np.flatnonzero(own[h & _U(0xFFFF)])
                likely = likely[np.isin(h[likely], stems)]
                place, h = place[likely], h[likely]
            parts.append((np.searchsorted(place, w.offsets), h))
        for k in range(len(w.offsets) - 1):
            yield np.unique(np.concatenate([h[at[k] : at[k + 1]] for at, h in parts]), return_counts=True)


def idf(frequency: np.ndarray, n_documents: int) -> np.ndarray:
    """A term of no document weighs as much as one of a single document."""
    return np.log((1 + n_documents) / np.clip(frequency, 1, max(1, n_documents)))


def _halves(ids: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Examples in blocks of similar ones: cut in two along the direction in which they differ most, again and again."""
    if len(ids) <= BLOCK:
        yield ids
        return
    x = rows[:, ids] - rows[:, ids].mean(axis=1, keepdims=True)
    side = np.sin(np.arange(len(ids)) + 1.0)
    for _ in range(6):
        side = x.T @ (x @ side)
        side = side / (np.linalg.norm(side) or 1.0)
    order = ids[np.argsort(side, kind="stable")]
    half = -(-len(ids) // (2 * BLOCK)) * BLOCK
    yield from _halves(np.sort(order[:half]), rows)
    yield from _halves(np.sort(order[half:]), rows)


@dataclass
class Index:
    """Inverted lists of the examples; term t's postings are from ``ends[t]`` to ``ends[t + 1]``.

    Weights, blocks and the rows of common terms follow from the counts, so they are
    made anew where an index arrives, and only the counts are sent.
    """

    terms: np.ndarray  #: the examples' terms, sorted
    frequency: np.ndarray  #: of those terms, in ``n_documents``
    n_documents: int
    names: np.ndarray  #: ids of the examples, in the order of blocks
    labels: np.ndarray
    prior: float
    ends: np.ndarray
    example: np.ndarray  #: postings
    count: np.ndarray
    k: int = NEAREST  #: how many vote
    lean: np.ndarray | None = None  #: how far each term tells labels; None: none does
    boost: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        n, many = len(self.names), np.diff(self.ends)
        self.idf, self.no_idf = idf(self.frequency, self.n_documents), float(np.log(1 + max(1, self.n_documents)))
        if self.lean is not None:
            self.idf = self.idf * (1 + self.boost * self.lean)
        weight = (1 + np.log(self.count)) * np.repeat(self.idf, many)
        norms = np.sqrt(np.bincount(self.example, weights=weight**2, minlength=n))
        self.weight = (weight / np.where(norms > 0, norms, 1)[self.example]).astype(np.float32)
        common = np.sort(np.argsort(-many, kind="stable")[:MOST_COMMON])
        common = common[COMMON * many[common] >= n]
        self.row = np.full(len(many), -1, np.int32)  # of each term its row, or -1
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common):
            s = slice(self.ends[t], self.ends[t + 1])
            self.rows[k, self.example[s]] = self.weight[s]
        self.starts = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.rows, self.starts, axis=1) if n else self.rows

    def __reduce__(self):
        values = [getattr(self, f.name) for f in fields(self)]
        return _unpacked, tuple((zlib.compress(v.tobytes(), 1), v.dtype.str) if isinstance(v, np.ndarray) else v for v in values)

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``terms`` and weights; the norm is over all terms of the text, in an example or not."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = self.terms[at] == terms
        w = (1 + np.log(tf)) * np.where(own, self.idf[at], self.no_idf)
        w = w / (np.sqrt(np.sum(w * w)) or 1.0)
        return at[own], w[own].astype(np.float32)

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """(cosines of texts (rows) with all examples that can be among the k nearest, others -1; number of blocks scored).

        ``without``: an example for each text that is left out.
        """
        n, e, k = len(vectors), len(self.names), self.k
        common, out = np.zeros((n, len(self.rows)), np.float32), np.zeros((n, e), np.float32)
        for i, (at, w) in enumerate(vectors):
            row = self.row[at]
            common[i, row[row >= 0]] = w[row >= 0]
            at, w = at[row < 0], w[row < 0]
            begin = self.ends[at]
            many = self.ends[at + 1] - begin
            total = int(many.sum())
            if total:
                s = np.arange(total) + np.repeat(begin - (np.cumsum(many) - many), many)
                out[i] = np.bincount(self.example[s], weights=self.weight[s] * np.repeat(w, many), minlength=e)
        bound = np.maximum.reduceat(out, self.starts, axis=1) + common @ self.most + TIE
        done = np.zeros(bound.shape, bool)
        first = min(bound.shape[1], 2 * -(-k // BLOCK) + 1)
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        for last in (False, True):
            for b in np.flatnonzero(wanted.any(axis=0)):
                who = np.flatnonzero(wanted[:, b])
                s = slice(self.starts[b], self.starts[b] + BLOCK)
                out[who, s] += common[who] @ self.rows[:, s]
            done |= wanted
            if not last:  # what the blocks scored so far reach decides which others are needed
                seen = np.where(np.repeat(done, BLOCK, axis=1)[:, :e], out, -1)
                if without is not None:
                    seen[np.arange(n), without] = -1
                kth = np.partition(seen, -k, axis=1)[:, -k] if e > k else np.full(n, -1.0)
                wanted = ~done & (bound >= np.maximum(kth - TIE, TIE)[:, None])
        out[~np.repeat(done, BLOCK, axis=1)[:, :e]] = -1
        if without is not None:
            out[np.arange(n), without] = -1
        return out, int(done.sum())

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0, with all that tie with the last of them, and the cosines."""
        least = np.partition(score, -self.k)[-self.k] - TIE if len(score) > self.k else 0.0
        who = np.flatnonzero((score > TIE) & (score >= least))
        top = np.lexsort((self.names[who], -score[who]))
        return who[top], score[who][top]

    def nearest(self, vectors: Iterable[tuple[np.ndarray, np.ndarray]], themselves: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest of each text; with ``themselves``, texts are the examples and each is left out for itself."""
        vectors, at = iter(vectors), 0
        while some := list(islice(vectors, AT_ONCE)):
            if not len(self.names):
                yield from [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(some)
                continue
            for score in self.scores(some, np.arange(at, at + len(some)) if themselves else None)[0]:
                yield self.best(score)
            at += len(some)

    def share(self, who: np.ndarray, what: np.ndarray) -> float:
        return float((np.sum(what * self.labels[who]) + PRIOR_WEIGHT * self.prior) / (np.sum(what) + PRIOR_WEIGHT))

    def calibrated(self, share: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))) if len(self.labels) else 0.0


def _unpacked(*values) -> Index:
    return Index(*[np.frombuffer(zlib.decompress(v[0]), v[1]) if isinstance(v, tuple) else v for v in values])


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(examples: list[tuple[int, int, np.ndarray, np.ndarray]], frequency, n_documents: int, nearest: int = NEAREST, telling: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
    """Invert the examples (id, label, terms, counts) and calibrate.  Without examples the prior is 0.

    ``frequency`` gives the document frequencies of terms; ``telling``: terms (sorted) that tell labels, and how far.
    """
    examples = sorted(examples, key=lambda e: e[0])
    labels = np.array([e[1] for e in examples], np.int64)
    n, ones = len(labels), int(labels.sum())
    every = np.concatenate([e[2] for e in examples]) if n else np.zeros(0, _U)
    of, tf = np.repeat(np.arange(n), [len(e[2]) for e in examples]), np.concatenate([e[3] for e in examples]) if n else np.zeros(0, np.int64)
    terms, inverse = np.unique(every, return_inverse=True)
    seen = np.bincount(inverse, minlength=len(terms))
    found = frequency(terms)
    lean = None
    if telling is not None and len(telling[0]):
        at = np.minimum(np.searchsorted(telling[0], terms), len(telling[0]) - 1)
        lean = np.where(telling[0][at] == terms, telling[1][at], 0.0)

    def index(order: np.ndarray, boost: float) -> Index:
        """The index of the examples in that order."""
        place = np.zeros(n, np.int64)
        place[order] = np.arange(n)
        sort = np.lexsort((place[of], inverse))
        return Index(terms, found, n_documents, np.array([examples[k][0] for k in order], np.int64), labels[order], ones / n if n else 0.0, np.r_[0, np.cumsum(seen)], place[of][sort].astype(np.uint16 if n < 1 << 16 else np.int32), tf[sort].astype(np.int32), nearest, lean, boost)

    # Each example's vote without itself tells how much terms should weigh, how many neighbours should vote and how far votes can be trusted.
    best, made = None, None
    for boost in BOOSTS if lean is not None else BOOSTS[:1]:
        rows = index(np.arange(n), boost).rows
        order = np.concatenate(list(_halves(np.arange(n), rows))) if n else np.arange(0)
        one = index(order, boost)
        votes = list(one.nearest((one.vector(examples[k][2], examples[k][3]) for k in order), themselves=True))
        for k in sorted({min(k, nearest) for k in (*FEWER, nearest)}, reverse=True):
            x = _logit(np.array([one.share(*_first(k, *v)) for v in votes])) if n else np.zeros(0)
            slope, shift, loss = _curve(x, one.labels)
            if best is None or loss < best[0]:
                best, made = (loss, k, slope, shift), one
    _, made.k, made.slope, made.shift = best
    return made


def _first(k: int, who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` voters and those that tie with the last of them."""
    some = what >= what[k - 1] - TIE if len(what) > k else slice(None)
    return who[some], what[some]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, shift, mean loss) of the logistic curve that tells labels from votes, with a little shrinkage towards slope 1."""
    slope, shift = 1.0, 0.0
    if not 0 < y.sum() < len(y):
        return slope, shift, 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = np.array([np.sum((p - y) * x) + (slope - 1), np.sum(p - y) + 0.1 * shift])
        v = p * (1 - p)
        h = np.array([[np.sum(v * x * x) + 1, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 0.1]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-(slope * x + shift))), 1e-9, 1 - 1e-9)
    return float(slope), float(shift), float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents of ``docs`` (doc_id, text) and at most ``most_bytes`` bytes of text.

    Documents come by least hash of the id, so the choice is even and the same every
    time; one that would pass ``most_bytes`` is left out and the next is tried.  An id that
    stands in several rows is one document, with the greatest of its texts and labels.  If there
    are labelled documents and each is longer than ``most_bytes``, that is an error.
    """
    chance = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(*chance).limit(most)
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))  # at most ``most`` ids
    sizes = one.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(*chance).collect()  # of at most ``most`` documents
    held, room = [], most_bytes
    for r in sizes:
        if r["bytes"] <= room:
            held.append((r["doc_id"],))
            room -= r["bytes"]
    if sizes and not held:
        raise ValueError(f"none of {len(sizes)} labelled documents is within {most_bytes} bytes")
    fit_in = docs.sparkSession.createDataFrame(held, "doc_id long")
    return one.join(F.broadcast(fit_in), "doc_id")


def telling_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(terms, how far they tell labels) of all words and beginnings of the examples (text, y), sorted.

    A term tells labels if the likelihood-ratio statistic of its presence against them is ``TELLING``
    or more; how far: the logarithm, without sign, of how much likelier one label makes it.
    """

    def added_up(found: list[np.ndarray], y: list[int]) -> pa.RecordBatch:
        terms, which = np.unique(np.concatenate([np.zeros(0, _U), *found]), return_inverse=True)
        label = np.repeat(np.array(y, float), [len(t) for t in found])
        ones, every = (np.bincount(which, weights=x, minlength=len(terms)).astype(np.int64) for x in (label, None))
        return pa.RecordBatch.from_pydict({"term": terms.view(np.int64), "ones": ones, "every": every})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, y, held = [], [], 0
            for label, (terms, _) in zip(batch["y"].to_pylist(), term_counts(batch["text"])):
                found.append(terms), y.append(label)
                held += len(terms)
                if held > MOST_HELD:
                    yield added_up(found, y)
                    found, y, held = [], [], 0
            yield added_up(found, y)

    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return np.zeros(0, _U), np.zeros(0)
    a, t = F.col("ones"), F.col("every")
    cells = [(a, t * ones / n), (t - a, t * (n - ones) / n), (ones - a, (n - t) * ones / n), (n - ones - t + a, (n - t) * (n - ones) / n)]
    statistic = 2 * sum(F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells)
    lean = F.abs(F.log((a + 0.5) / (ones + 1) / ((t - a + 0.5) / (n - ones + 1))))
    counted = sample.mapInArrow(count, "term long, ones long, every long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("every").alias("every"))
    rows = counted.where(statistic >= TELLING).select("term", lean.alias("lean")).collect()  # each in several examples, which are at most MOST_EXAMPLES
    terms = np.array([r["term"] for r in rows], np.int64).view(_U)
    order = np.argsort(terms)
    return terms[order], np.array([r["lean"] for r in rows], float)[order]


def score_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", nearest: int = NEAREST) -> DataFrame:
    """All columns of ``docs`` but the text, with score, predicted and evidence.

    Learns from labels (id_col, label 0 or 1) where ``learnable`` holds; the sample
    has at most ``MOST_EXAMPLES`` documents of ``MOST_BYTES`` in all.  score:
    likelihood of label 1, by the cosine-weighted votes of the ``nearest`` examples, or fewer
    if the examples' own votes are told better so, and all that tie with the last of them; predicted: 1 if it is 0.5 or more;
    evidence: ids, labels and cosines of all that voted, nearest first.  Terms are words, and
    beginnings of 3 to 6 characters that tell the examples' labels; terms that tell them weigh
    more where the examples' own votes are told better so, else cosines are of plain TF-IDF.
    A term of no example counts in a text's norm as one of a single document.

    A null or empty text, and one without any term of an example, has no evidence and
    gets what the curve says of the prior.  Null labels and labels of unknown ids are
    left out; repeated labels count once, as the greatest, and so do repeated ids.
    No labels: score 0.  No rows: no rows.  Input columns named like a result are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(term_counts(batch["text"], stems.value))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "y": batch["y"], "t": pa.array([t.tobytes() for t, _ in found], pa.binary()), "c": pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())})

    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").alias(label))
    sample = scratch.written(labelled_sample(texts, own, label, learnable, MOST_EXAMPLES, MOST_BYTES), "examples")
    telling = telling_terms(sample)
    stems = spark.sparkContext.broadcast(telling[0])
    rows = sample.mapInArrow(example, "doc_id long, y int, t binary, c binary").collect()  # terms of at most MOST_BYTES of texts
    scratch.close()
    examples = [(r["doc_id"], r["y"], np.frombuffer(r["t"], _U), np.frombuffer(r["c"], np.int32)) for r in rows]

    def frequency(terms: np.ndarray) -> np.ndarray:
        """In how many of all documents each of the sorted terms is."""
        if not len(terms):
            return np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast(terms)

        def places(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            known = shared.value
            for t, _ in term_counts(batch["text"], stems.value):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                yield at[known[at] == t].astype(_U)

        return counts(texts.select("text"), len(terms), places)

    index = spark.sparkContext.broadcast(fit(examples, frequency, texts.count(), nearest, telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for batch in batches:
            scores, who, what, many = [], [], [], [0]
            for a, b in model.nearest(model.vector(t, c) for t, c in term_counts(batch["text"], stems.value)):
                scores.append(model.calibrated(model.share(a, b)))
                who.append(a), what.append(b), many.append(len(a))
            who, what = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, what))
            voters = pa.StructArray.from_arrays([pa.array(model.names[who], pa.int64()), pa.array(model.labels[who].astype(np.int32), pa.int32()), pa.array(what.astype(np.float32), pa.float32())], ["example", "label", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum(many), pa.int32()), voters)
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "score": pa.array(scores, pa.float64()), "evidence": evidence})

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, evidence array<struct<example: long, label: int, cosine: float>>")
    done = done.select("row.*", F.col("score").alias("__score"), F.col("evidence").alias("__evidence"))
    return with_results(done, {"score": F.col("__score"), "predicted": (F.col("__score") >= 0.5).cast("int"), "evidence": F.col("__evidence")}).drop("__score", "__evidence")
