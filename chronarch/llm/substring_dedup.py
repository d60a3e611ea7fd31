"""Removal of passages that occur more than once, level by level with windows of doubling length.

The first level has windows of a quarter of the full length.  Of all that lie in one
full window only the one of least hash stands for it, so a level has few windows of
each text; a full window can be repeated only if the one that stands for it is.  Only
where windows were found repeated do full windows survive, and what stands for them
at twice the length is looked at next.  The loop ends when no candidate survives, or
with the full length, which decides.  A longer repeat is the union of the repeated
full windows in it, so longer levels could remove no more words.

What is repeated at a level reaches the next as a table of bits, sized by the number
of windows up to a bound; a bit set by chance makes a candidate more, which the full
length decides.  Texts are told apart by a 64-bit key and windows by 64-bit hashes:
among w windows, one is taken for repeated by chance with a likelihood of w / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.packed import repeated
from chronarch.llm.tables import Scratch, bits, prepare, text_key, with_results

_U = np.uint64
#: Largest table of what is repeated at a level, in bits: 64 MB when broadcast.
MOST_FLAGS = 1 << 29
#: Parts into which rows of one text are dealt where they meet what is removed from it.
SALTS = 16


def lengths(size: int) -> list[int]:
    """Lengths of the levels before the full one."""
    out = [size]
    while len(out) < 3 and out[0] > 4:
        out.insert(0, -(-out[0] // 2))
    return out[:-1]


def standing(grams: np.ndarray, n_full: int) -> np.ndarray:
    """The least of the hashes of a level's windows in each full window."""
    width, have, out = len(grams) - n_full + 1, 1, grams
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: n_full], out[width - have :]) if have < width else out


def _flagged(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values.view(np.int64) % (8 * (len(table) - 8192))
    return table[cell >> 3] >> (cell & 7) & 1 > 0


def survivors(w: ta.Words, size: int, levels: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, word after the last, surviving full windows) of each text; ``levels``: length and table of those done."""
    words = w.hashes(lower=False)
    grams = [(w.grams(words, n)[0], n, table) for n, table in levels]
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        many = b - a - size + 1
        alive = np.ones(max(0, many), bool)
        for g, n, table in grams:
            if alive.any():
                alive &= _flagged(table, standing(g[a : b - n + 1], many))
        yield a, b, np.flatnonzero(alive)


def _level(texts: DataFrame, size: int, length: int, done: list) -> DataFrame:
    """(value, n): windows of ``length`` that stand for surviving full windows, and in how many places a task met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [(n, np.frombuffer(table.value, np.uint8)) for n, table in done]
        for batch in batches:
            values, times = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for w in ta.chunks(batch["text"]):
                grams, _ = w.grams(w.hashes(lower=False), length)
                for a, b, at in survivors(w, size, levels):
                    if len(at):
                        own, count = np.unique(grams[a : b - length + 1], return_counts=True)
                        stands = np.isin(own, standing(grams[a : b - length + 1], b - a - size + 1)[at])
                        values.append(own[stands]), times.append(count[stands])
            value, inverse = np.unique(np.concatenate(values), return_inverse=True)
            many = np.bincount(inverse, weights=np.concatenate(times), minlength=len(value))
            yield pa.RecordBatch.from_pydict({"value": pa.array(value.view(np.int64), pa.int64()), "n": pa.array(np.minimum(many, 2).astype(np.int32), pa.int32())})

    return texts.mapInArrow(run, "value long, n int")


def _stretches(starts: np.ndarray, size: int) -> list[dict[str, int]]:
    """Words [first, last] that windows from ``starts`` on cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return [{"first": int(a), "last": int(b) + size - 1} for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]])]


def repeated_stretches(texts: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((key, stretches) of the texts (text, key) with repeated windows of ``size``; (length, number of repeated windows) of each level before)."""
    spark = texts.sparkSession
    done, told = [], []
    for length in lengths(size):
        values = scratch.written(_level(texts, size, length, done).groupBy("value").agg(F.sum("n").alias("n")).where("n > 1").select("value"), "level")
        told.append((length, values.count()))
        if not told[-1][1]:  # no candidate survives
            break
        done.append((length, spark.sparkContext.broadcast(bits(values, "value", min(MOST_FLAGS, 1 << max(15, (16 * told[-1][1]).bit_length()))))))
        scratch.drop(values)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [(n, np.frombuffer(table.value, np.uint8)) for n, table in done]
        for batch in batches:
            key, where, what = [], [], []
            for w in ta.chunks(batch["text"]):
                grams, _ = w.grams(w.hashes(lower=False), size)
                for k, (a, _, at) in enumerate(survivors(w, size, levels)):
                    if len(at):
                        key.append(w.first + k), where.append(at.astype(np.int32).tobytes()), what.append(grams[a + at].tobytes())
            yield pa.RecordBatch.from_pydict({"key": batch["key"].take(pa.array(key, pa.int32())), "starts": pa.array(where, pa.binary()), "windows": pa.array(what, pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, copies, places in zip(batch["starts"].to_pylist(), batch["copies"].to_pylist(), batch["places"].to_pylist()):
                starts = np.frombuffer(starts, np.int32)
                if copies == 1:
                    starts = starts[np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in places]))]
                out.append(_stretches(starts, size))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "stretches": pa.array(out, kind)})

    none = spark.createDataFrame([], "key long, stretches array<struct<first: int, last: int>>")
    if len(done) < len(told):
        return none, told
    # Rows of one text are made one before the shuffle and after it; all its windows are in two places then.
    once = texts.mapInArrow(full, "key long, starts binary, windows binary").groupBy("key").agg(F.first("starts").alias("starts"), F.first("windows").alias("windows"), F.count("*").alias("copies"))
    once = scratch.written(once, "full")
    values = F.when(F.col("copies") > 1, F.concat("windows", "windows")).otherwise(F.col("windows"))
    found = repeated(once.select(F.col("key").alias("owner"), values.alias("values"))).groupBy("owner").agg(F.collect_list("places").alias("places"))
    rows = once.join(found, F.col("key") == F.col("owner")).select("key", "starts", "copies", "places")
    out = scratch.written(rows.mapInArrow(joined, none.schema), "stretches")
    scratch.drop(once)
    return out, told


def remove_repeats(docs: DataFrame, text_col: str = "text", size: int = 35, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with text_col without repeated passages, n_words, n_removed and kept_sha256.

    Words are runs of other than ASCII white space, taken unchanged.  Removed are the
    words in any window of ``size`` words whose sequence also starts anywhere else,
    in the same text or another; windows are judged on the input.  The kept words
    are joined by one space.  Without ``keep_text`` the text column is left out.

    Null and empty texts have no words, and kept words "" (so a null text becomes
    "").  Texts of fewer words than ``size`` are kept.  A repeated row is another
    place where its passages stand.  Input columns named like a result are replaced.
    No rows: no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stretches, _ = repeated_stretches(docs.select(text.alias("text"), text_key(text).alias("key")), size, scratch)
    many = stretches.count()
    flags = spark.sparkContext.broadcast(bits(stretches, "key", min(MOST_FLAGS, 1 << max(15, (16 * many).bit_length()))))
    schema = "row {}, key long, text string, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def cover(batch: pa.RecordBatch, texts: pa.Array, gone: list, wait: np.ndarray) -> dict:
        """The results of a batch; ``gone``: stretches of each text; texts that ``wait`` get none yet."""
        n_words, removed, sha, kept = [], [], [], []
        for w in ta.chunks(texts):
            raw = w.data.tobytes()
            for k, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:]), w.first):
                stay = np.ones(b - a, bool)
                for r in [] if wait[k] else gone[k] or []:
                    stay[r["first"] : r["last"] + 1] = False
                at = np.flatnonzero(stay) + a if not wait[k] else np.zeros(0, np.int64)
                out = b" ".join([raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())])
                n_words.append(int(b - a)), removed.append(int(b - a - len(at))), sha.append(hashlib.sha256(out).hexdigest()), kept.append(out)
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if keep_text else {})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            wait = _flagged(table, batch["key"].to_numpy())
            later = pa.array(wait, pa.bool_())
            out = {"row": batch["row"], "key": batch["key"], "text": pa.compute.if_else(later, batch["text"], pa.scalar(None, pa.string()))}
            yield pa.RecordBatch.from_pydict(out | cover(batch, batch["text"], [None] * len(wait), wait))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"row": batch["row"]} | cover(batch, batch["text"], batch["stretches"].to_pylist(), np.zeros(batch.num_rows, bool)))

    # Documents without repeats are done at once; of the others, only those meet their stretches in a shuffle.
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("row"), text_key(text).alias("key"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    settled = scratch.written(rows.mapInArrow(settle, schema.format(kind)), "settled")
    salted = stretches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    waiting = settled.where("text IS NOT NULL").withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    waiting = waiting.join(salted, ["key", "salt"], "left").select("row", "text", "stretches")
    finished = waiting.mapInArrow(finish, "row {}, n_words long, n_removed long, kept_sha256 string".format(kind) + ", kept string" * keep_text)
    done = settled.where("text IS NULL").drop("key", "text").unionByName(finished)
    results = ({text_col: F.col("kept")} if keep_text else {}) | {c: F.col(c) for c in ("n_words", "n_removed", "kept_sha256")}
    clash = {k.lower() for k in results}
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in others if c.lower() not in clash], *[c.alias(k) for k, c in results.items()])
