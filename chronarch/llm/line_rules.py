"""Quality rules of a document, and of its lines across the documents of a host.

A line that stands in many documents of a host is no part of their text: menus,
notices, licences, or a page that is there again and again.  Such lines are removed,
and a document of which too little is left is rejected.  Lines are compared by a hash
of their words, A-Z as a-z and every digit as 0.  Equal texts of a host are looked at
once and counted as many times as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.tables import Scratch, prepare, text_key, with_results

_U = np.uint64
#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"


def _lines(w: ta.Words) -> np.ndarray:
    """Number of the line of each word, over the whole piece; a text's end ends a line."""
    breaks = np.union1d(np.flatnonzero(w.data == 10), w.bounds[1:-1] - 0.5)
    return np.searchsorted(breaks, w.starts)


def _normal(w: ta.Words) -> np.ndarray:
    """Hashes of words with A-Z as a-z and digits as 0."""
    plain = w.data.copy()
    plain[(plain >= 48) & (plain <= 57)] = 48
    return ta.Words(w.first, plain, w.bounds, w.starts, w.ends, w.offsets).hashes(lower=True)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(x)].astype(np.int64)


def _line_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its row, the hashes of its lines with words, and their first and last words' places in the text."""
    for w in ta.chunks(batch["text"]):
        line = _lines(w)
        a, b = _runs(line)
        hashes = ta.spans(ta.rolling(_normal(w)), a, b)
        own = np.searchsorted(a, w.offsets)
        for i in range(len(w.bounds) - 1):
            s = slice(own[i], own[i + 1])
            yield w.first + i, hashes[s], a[s] - w.offsets[i], b[s] - w.offsets[i]


def common_lines(docs: DataFrame, text_col: str, host_col: str, limit: int, clean: bool, scratch: Scratch) -> DataFrame:
    """(owner, n_common, lines): for each host and text, the lines that more than ``limit`` of the host's documents have, and their words."""
    rows = _owned(docs, text_col, host_col)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, host = batch["owner"].to_numpy(), batch["host"].to_numpy().view(_U)
            _, first, copies = np.unique(owner, return_index=True, return_counts=True)  # equal texts of a host are read once
            first = dict(zip(first.tolist(), copies.tolist()))
            owners, lines, words, documents = [], [], [], []
            for k, hashes, a, b in _line_rows(batch):
                if k in first and len(hashes):
                    value, inverse = np.unique(hashes, return_inverse=True)
                    lines.append(ta.mix(value ^ ta.mix(host[k : k + 1] + _U(1))))
                    words.append(np.bincount(inverse, weights=b - a).astype(np.int32))
                    owners.append(np.full(len(value), owner[k]))
                    documents.append(np.full(len(value), first[k], np.int64))
            if owners:
                yield pa.RecordBatch.from_pydict({"owner": pa.array(np.concatenate(owners), pa.int64()), "line": pa.array(np.concatenate(lines).view(np.int64), pa.int64()), "words": pa.array(np.concatenate(words), pa.int32()), "documents": pa.array(np.concatenate(documents), pa.int64())})

    lines = rows.mapInArrow(emit, "owner long, line long, words int, documents long").groupBy("line", "owner").agg(F.max("words").alias("words"), F.sum("documents").alias("documents"))
    lines = scratch.written(lines, "lines")
    many = lines.groupBy("line").agg(F.sum("documents").alias("documents")).where(F.col("documents") > limit).select("line")
    which = F.collect_set("line") if clean else F.lit(None).cast("array<long>")
    common = scratch.written(lines.join(many, "line").groupBy("owner").agg(F.sum("words").alias("n_common"), which.alias("lines")), "common")
    scratch.drop(lines)
    return common


def _owned(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    host = F.xxhash64(F.col(f"`{host_col}`").cast("string"))
    return docs.select(text.alias("text"), host.alias("host"), F.xxhash64(host, F.xxhash64(text)).alias("owner"))


def base_measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    for batch in batches:
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        for w in ta.chunks(batch["text"]):
            count = np.diff(w.offsets)
            text_of_word = np.repeat(np.arange(len(count)), count)
            per_text = lambda at, n=len(count): np.bincount(at, minlength=n)
            heads = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]  # bytes that begin a character
            chars = np.bincount(text_of_word, weights=heads[w.ends] - heads[w.starts], minlength=len(count))
            symbols = np.r_[0, np.cumsum(symbol[w.data])][w.bounds]
            # Lines as they stand, from break to break.
            breaks = np.flatnonzero(w.data == 10)
            cuts = np.union1d(np.union1d(breaks, w.bounds), [0, len(w.data)]).astype(np.int64)
            words = w.hashes(lower=False)
            raw = ta.rolling(ta.mix(np.arange(1, 257, dtype=_U))[w.data])
            a, _ = _runs(_lines(w))
            own = text_of_word[a]
            begin = np.maximum(cuts[np.searchsorted(cuts, w.starts[a], "right") - 1], 0)
            begin = np.where((begin < len(w.data)) & (w.data[np.minimum(begin, max(0, len(w.data) - 1))] == 10), begin + 1, begin) if len(a) else begin
            end = cuts[np.searchsorted(cuts, w.starts[a], "right")]
            line = ta.mix(ta.spans(raw, begin, end) ^ ta.mix(own.astype(_U) + _U(5)))
            _, first = np.unique(line, return_index=True)
            again = np.ones(len(line), bool)
            again[first] = False
            # Windows of five words, found again in the same text.
            grams, whole = w.grams(words, 5)
            at = np.flatnonzero(whole)
            value = ta.mix(grams[at] ^ ta.mix(text_of_word[at].astype(_U) + _U(5)))
            _, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
            at = at[times[inverse] > 1]
            cover = np.zeros(len(words) + 6, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            hit = np.cumsum(cover)[: len(words)] > 0
            out["n_words"] += count.tolist()
            out["word_chars"] += chars.astype(np.int64).tolist()
            out["n_symbols"] += np.diff(symbols).tolist()
            out["n_dup_lines"] += per_text(own[again]).tolist()
            out["n_repeat_words"] += per_text(text_of_word[hit]).tolist()
        rest = {c: batch[c] for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(rest | {k: pa.array(v, pa.int64()) for k, v in out.items()})


def line_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: int = 50, least_share: float = 0.5, least_words: int = 10, clean: bool = True) -> DataFrame:
    """All columns of ``docs`` with the measures of the base rules, n_common, base_failed and kept.

    Words are runs of other than ASCII white space.  word_chars: code points in
    words; n_symbols: characters of ``SYMBOLS``; n_dup_lines: lines with a word,
    equal to an earlier line; n_repeat_words: words in windows of five words found
    twice or more in the text.  base_failed: fewer than ``least_words`` words, or
    more than a fifth of them in such windows.  n_common: words in lines that more
    than ``limit`` documents of the same host have, copies included.  kept: not base_failed, and
    without those lines at least ``least_words`` words and ``least_share`` of all are
    left.  With ``clean``, text_col is left without common lines; the lines that stay are
    joined by line breaks.  Without, the text column is left out.

    Null and empty texts have no words: base_failed.  Rows with a null host are of
    one host.  Repeated rows are documents each.  Input columns named like a result are
    replaced.
    """
    prepare(docs.sparkSession)
    common = common_lines(docs, text_col, host_col, limit, clean, Scratch(docs.sparkSession))
    host = F.xxhash64(F.col(f"`{host_col}`").cast("string"))
    rows = docs.withColumns({"__host": host, "__owner": F.xxhash64(host, text_key(F.col(f"`{text_col}`")))})
    others = [c for c in docs.columns if c != text_col]
    if clean:
        rows = rows.withColumn("__text", F.col(f"`{text_col}`"))
    measured = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), "__owner", F.col(f"`{text_col}`").alias("text"), *(["__text", "__host"] if clean else []))
    kept = [f for f in measured.schema.fields if f.name != "text"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} long" for n in names)])
    measured = measured.mapInArrow(base_measures, schema)
    out = measured.join(common.select(F.col("owner").alias("__owner"), "n_common", "lines"), "__owner", "left")
    if clean:
        out = out.mapInArrow(_without_lines, out.schema)
    n, lost = F.col("n_words"), F.coalesce(F.col("n_common"), F.lit(0))
    failed = (n < least_words) | (100 * F.col("n_repeat_words") > 20 * n)
    results = {k: F.col(k) for k in names} | {"n_common": lost, "base_failed": failed, "kept": ~failed & (n - lost >= least_words) & (n - lost >= least_share * n)}
    results = ({text_col: F.col("__text")} if clean else {}) | results
    clash = {k.lower() for k in results}
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in others if c.lower() not in clash], *[c.alias(k) for k, c in results.items()])


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, common, hosts = batch["__text"].to_pylist(), batch["lines"].to_pylist(), batch["__host"].to_numpy().view(_U)
        for k in [k for k, x in enumerate(common) if x]:
            lines = (texts[k] or "").split("\n")
            gone = set()
            for at, hashes, _, _ in _line_rows(pa.RecordBatch.from_pydict({"text": pa.array(lines, pa.string())})):
                own = ta.mix(hashes ^ ta.mix(hosts[k : k + 1] + _U(1))).view(np.int64)
                if np.isin(own, common[k]).any():
                    gone.add(at)
            texts[k] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        at = batch.schema.get_field_index("__text")
        yield batch.set_column(at, "__text", pa.array(texts, pa.string()))
