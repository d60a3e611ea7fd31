"""Phrase collocations: phrases that stand together more often than their parts would by chance.

Equal pieces of text become one with a multiplicity.  Their n-grams are dealt by hash
into buckets, and DuckDB counts each bucket's weighted rows out of core, in three rounds:
hashes of one and two words, then those of longer n-grams all of whose pairs may be
frequent; what may be frequent by its hash is counted by its words.  Candidates ask for their parts' counts by a shuffled join.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronarch.llm import textarrays as ta
from chronarch.llm.tables import Scratch, bits, prepare

_U = np.uint64
LONGEST = 5
UNKNOWN = "und"
#: Lower case of A-Z, and what ends a piece or separates words (fixed values).
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))
#: Bytes of pieces, pairs of hash and weight, and rows of phrases that a task holds before it sends them on.
PIECE_BYTES, PAIRS, PHRASES = 16 << 20, 1 << 21, 1 << 19
#: Memory of one bucket's count; beyond it DuckDB spills.
COUNT_MEMORY = "192MB"
#: Most bits of the table of frequent n-grams, 32 MB; more of them than a part of that let others pass, which the exact count drops.
MOST_FLAGS = 1 << 28
#: Parts of a language whose best phrases are found before those of the whole.
PARTS = 16

PIECES = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("many", pa.int64())])
HASHES = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("weights", pa.binary())])
GRAMS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("many", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, piece, many): the pieces of texts in lower case, words one blank apart, equal ones of a task put together."""
    count: dict[tuple[str, bytes], int] = {}
    held = 0

    def told() -> pa.RecordBatch:
        langs, pieces = [k for k, _ in count], [p.decode("utf-8", "replace") for _, p in count]
        return pa.RecordBatch.from_pydict({"lang": langs, "piece": pieces, "many": list(count.values())}, PIECES)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for piece in (text.as_py() or "").encode("utf-8", "replace").translate(TABLE).split(b"\n"):
                words = piece.split()
                if not words:
                    continue
                key = (lang, b" ".join(words))
                if key in count:
                    count[key] += 1
                else:
                    count[key] = 1
                    held += len(piece) + 100
            if held > PIECE_BYTES:
                yield told()
                count, held = {}, 0
    if count:
        yield told()


def _hashes(batch: pa.RecordBatch) -> Iterator[tuple[ta.Words, np.ndarray, np.ndarray]]:
    """Chunks of pieces, with the row of each word in the batch and the hash of each word in its language."""
    lang = batch["lang"].dictionary_encode()
    of = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()], _U)[lang.indices.to_numpy()]
    for w in ta.chunks(batch["piece"]):
        row = w.first + np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.offsets))
        yield w, row, ta.mix(w.hashes(lower=False) ^ of[row])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: str) -> Iterator[pa.RecordBatch]:
    """What ``sql`` makes of the rows, a bucket's worth of them, in DuckDB.  Its spill files, like Spark's own, go with the task."""
    with tempfile.TemporaryDirectory(prefix="count-") as spill, duckdb.connect() as db:
        for setting in (f"memory_limit = '{COUNT_MEMORY}'", f"temp_directory = '{spill}'", "threads = 1", "preserve_insertion_order = false"):
            db.execute(f"SET {setting}")
        rows = pa.RecordBatchReader.from_batches(schema, batches)
        db.register("given", rows)
        yield from db.sql(sql).to_arrow_reader(1 << 16)


def _known(flags: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    table = np.frombuffer(flags, np.uint8)
    at = hashes.view(np.int64) % (8 * len(table))
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _grams(w: ta.Words, h: np.ndarray, pairs: bytes | None, all_: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of n-grams: without ``pairs`` those of one and two words; with it, the longer ones whose pairs are all flagged; with ``all_``, all sizes that are flagged there too."""
    pair, inside = w.grams(h, 2)
    if pairs is None:
        yield 1, np.arange(len(h)), h
        yield 2, (at := np.flatnonzero(inside)), pair[at]
        return
    joined = inside & _known(pairs, pair)
    if all_ is not None:
        yield 1, (at := np.flatnonzero(_known(pairs, h))), h[at]
        yield 2, (at := np.flatnonzero(joined)), pair[at]
    ok = joined
    for size in range(3, LONGEST + 1):
        ok = ok[:-1] & joined[size - 2 :]
        at = np.flatnonzero(ok)
        if not len(at):
            return
        gram = w.grams(h, size)[0][at]
        if all_ is not None:
            at, gram = (x[_known(all_, gram)] for x in (at, gram))
        yield size, at, gram


def frequent_hashes(pieces: DataFrame, least: int, pairs: bytes | None = None) -> DataFrame:
    """(h) of the n-grams whose hash counts ``least`` or more: all frequent ones, and such as share their hash.

    First of words and pairs of words; then, with the flags of these, of longer n-grams all of
    whose pairs may be frequent.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(pairs)

    def dealt(keys: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, weight = _summed(np.concatenate(keys), np.concatenate(weights))
        bucket = (ta.mix(key) % _U(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, weight = key[order], weight[order]
        ends = np.searchsorted(bucket[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        cut = lambda x: [x[ends[k] : ends[k + 1]].tobytes() for k in full]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "hashes": cut(key), "weights": cut(weight)}, HASHES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0
        for batch in batches:
            many = batch["many"].to_numpy()
            for w, row, h in _hashes(batch):
                for _, at, gram in _grams(w, h, shared.value):
                    keys.append(gram), weights.append(many[row[at]])
                    held += len(at)
                if held > PAIRS:
                    yield from dealt(keys, weights)
                    keys, weights, held = [], [], 0
        if held:
            yield from dealt(keys, weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("h", pa.int64()), ("w", pa.int64())])
        given = (pa.RecordBatch.from_pydict({"h": np.frombuffer(h.as_py(), np.int64), "w": np.frombuffer(w.as_py(), np.int64)}, kind) for b in batches for h, w in zip(b["hashes"], b["weights"]))
        yield from _counted(given, kind, f"SELECT h FROM given GROUP BY h HAVING sum(w) >= {least}")

    return pieces.mapInArrow(pack, "bucket int, hashes binary, weights binary").repartition(n, "bucket").mapInArrow(count, "h long")


def flagged(hashes: DataFrame) -> bytes:
    """A table of bits of the hashes, 64 bits for each as far as ``MOST_FLAGS`` allow."""
    room = min(MOST_FLAGS, 1 << max(16, (64 * hashes.count()).bit_length()))
    return bits(hashes, "h", room)[: room // 8]


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of bytes between ``starts`` and ``ends``."""
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)]
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes()))


def frequent_phrases(pieces: DataFrame, pairs: bytes, longer: bytes, least: int) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``LONGEST`` words with f >= ``least``, counted by their words.

    ``pairs`` and ``longer`` have the bits of ``frequent_hashes`` of up to two, and of more words.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((pairs, longer))

    def together(tables: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(tables).group_by(GRAMS.names[:3], use_threads=False).aggregate([("many", "sum"), ("h", "min")])
        return summed.select([*GRAMS.names[:3], "many_sum", "h_min"]).rename_columns([*GRAMS.names, "h"])

    def dealt(table: pa.Table) -> pa.RecordBatch:
        """A row for each bucket, with lists of the phrases that fall into it."""
        bucket = (ta.mix(table["h"].to_numpy().view(_U)) % _U(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        full, first = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.r_[first, len(order)].astype(np.int32))
        own = table.take(pa.array(order))
        return pa.RecordBatch.from_pydict({"bucket": full} | {c: pa.ListArray.from_arrays(ends, own[c].combine_chunks()) for c in GRAMS.names})

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            many = batch["many"].to_numpy()
            for w, row, h in _hashes(batch):
                for size, at, gram in _grams(w, h, *shared.value):
                    if len(at):
                        phrase = _slices(w.data, w.starts[at], w.ends[at + size - 1]).cast(pa.string())
                        columns = {"lang": batch["lang"].take(pa.array(row[at])), "size": pa.array(np.full(len(at), size, np.int32)), "phrase": phrase, "many": pa.array(many[row[at]]), "h": pa.array(gram.view(np.int64))}
                        held.append(together([pa.table(columns)]))
                        rows += held[-1].num_rows
                if rows > 2 * PHRASES:
                    held = [together(held)]
                    rows = held[0].num_rows
                    if rows > PHRASES:
                        yield dealt(held[0])
                        held, rows = [], 0
        if held:
            yield dealt(together(held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (pa.RecordBatch.from_arrays([b[c].flatten() for c in GRAMS.names], schema=GRAMS) for b in batches)
        yield from _counted(given, GRAMS, f"SELECT lang, size, phrase, sum(many)::BIGINT AS f FROM given GROUP BY ALL HAVING sum(many) >= {least}")

    packed = pieces.mapInArrow(grams, "bucket int, lang array<string>, size array<int>, phrase array<string>, many array<long>")
    return packed.repartition(n, "bucket").mapInArrow(count, "lang string, size int, phrase string, f long")


def _words(phrase: str | Column, first: Column | int, many: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array_join(F.slice(F.split(phrase, " "), lit(first), lit(many)), " ")


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of four columns of whole numbers, exact up to 38 digits."""
    return F.expr(f"cast({a} as decimal(17,0)) * cast({n} as decimal(17,0)) * 1000BD div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to five words of each language.

    Texts in lower case (A-Z) end at ``.,;:!?`` and line ends; words are what blanks and tabs
    separate.  n counts a language's words, a a phrase's occurrences, ``least`` at least.  Of the
    ways to cut a phrase in two, with l and r occurrences of its parts, the one of least
    score floor(1000 * a * n / (l * r)) counts, of equal ones the first.  A phrase within a longer
    one that occurs as often is left out.  Ranks go by score and a, descending, and phrase.

    A null language is ``und``; null and empty texts have no words.  Repeated rows and copies
    count as often as they stand there.  No rows, or nothing frequent: no rows.  Other columns,
    whatever their names, play no part.  Counts are exact; numbers of words up to 10**14 fit.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    own = texts.mapInArrow(_pieces, "lang string, piece string, many long")
    pieces = scratch.written(own.groupBy("lang", "piece").agg(F.sum("many").alias("many")), "pieces")
    totals = scratch.written(pieces.groupBy("lang").agg(F.sum(F.col("many") * F.size(F.split("piece", " "))).alias("n")), "totals")
    short = scratch.written(frequent_hashes(pieces, least), "short")
    pairs = flagged(short)
    long = scratch.written(frequent_hashes(pieces, least, pairs), "long")
    counts = scratch.written(frequent_phrases(pieces, pairs, flagged(long), least), "phrases")
    scratch.drop(pieces, short, long)

    candidates = counts.where("size > 1")
    cut = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asks = cut.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), _words("phrase", 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _words("phrase", F.col("k") + 1, LONGEST).alias("part")))).alias("ask"))
    asks = asks.select("lang", "phrase", "a", "k", "ask.*")
    told = asks.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{k}_{s}")
    parts = told.groupBy("lang", "phrase", "a").agg(*[side(k, s) for k in range(1, LONGEST) for s in (0, 1)])

    shorter = candidates.where("size > 2").select("lang", F.col("f").alias("within"), F.explode(F.array(_words("phrase", 1, F.col("size") - 1), _words("phrase", 2, LONGEST))).alias("phrase"))
    covered = shorter.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    whole = parts.join(covered, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a"))).join(totals, "lang")

    ways = [F.when(F.col(f"f{k}_0").isNotNull(), F.struct(score("a", "n", f"f{k}_0", f"f{k}_1").alias("score"), F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"))) for k in range(1, LONGEST)]
    scored = whole.select("lang", "phrase", "a", "n", F.least(*ways).alias("way")).select("lang", "phrase", "a", "way.l", "way.r", "n", "way.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = scratch.written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")  # ``top`` of a language
    scratch.drop(counts, totals)
    return out
