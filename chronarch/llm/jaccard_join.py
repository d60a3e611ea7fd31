"""Self-join of documents on the Jaccard similarity of their word n-grams.

Every document orders its n-grams from rare to frequent and gives a prefix of them
as tokens.  Two sets of n and m n-grams with a similarity of at least t have at least
o = t / (1 + t) * (n + m) in common; then their prefixes of length n - o + k and
m - o + k share at least k tokens, for every k.  Each document picks the k of least
estimated cost: a longer prefix costs more postings, but fewer of its candidates
share k tokens and have to be verified.  A pair is a candidate if it shares as many
tokens as the less demanding of its two documents asks for, in prefixes of the
lengths that follow for it.

Frequencies come from a table of counts of fixed size over all documents (see
``sketch``); they set the order and the cost, never the result.

Documents with equal sets are one class and take part once.  Where many classes
share a token, each is first compared with a few leaders, other ones in each round.
Classes that this joins into one component are not compared with each other again;
all other pairs are, across components, so the components are exact, and a group of
thousands of near copies does not cost all the pairs within it.  A round whose
comparisons with leaders would be more than all those that are left is not run, and
none follows a round that finds no link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.components import connected_components
from chronarch.llm.packed import repeated
from chronarch.llm.sketch import counts
from chronarch.llm.tables import Scratch, bits, cut, prepare, text_key

#: Cells of the count table: 8 MB when broadcast.
CELLS = 1 << 20
#: Largest number of tokens that a document may ask for.
MOST_SHARED = 8
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 50
#: Largest table of flags by which texts are passed over, in bits: 64 MB when broadcast.
MOST_FLAGS = 1 << 29
#: From so many classes on, a token's classes are first compared with some leaders, in so many rounds.
CROWD, LEADERS, ROUNDS = 32, 12, 3

_U = np.uint64


def gram_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; texts of fewer words are one n-gram, texts without words have none."""
    for w in ta.chunks(column):
        words = w.hashes(lower=True)
        grams, whole = w.grams(words, size)
        sums = ta.rolling(words)
        for a, b in zip(w.offsets[:-1], w.offsets[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield ta.spans(sums, np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, _U)


def _node(u: np.ndarray) -> int:
    """64-bit key of a set of n-grams."""
    digest = np.array([u.sum(dtype=_U), ta.mix(u + _U(7)).sum(dtype=_U), len(u)], _U)
    return int(ta.spans(ta.rolling(ta.mix(digest)), np.array([0]), np.array([3])).view(np.int64)[0])


def _signatures(docs: DataFrame, size: int, percent: int, frequencies: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(frequencies, 2**31 - 1).astype(np.int32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        noise = float(np.median(table))
        asks = np.arange(1, MOST_SHARED + 1)
        for batch in batches:
            node, n_set, need, prefix = [], [], [], []
            for u in gram_sets(batch["text"], size):
                n = len(u)
                n_set.append(n)
                if not n:
                    node.append(None), need.append(None), prefix.append(None)
                    continue
                node.append(_node(u))
                count = np.maximum(table[(u % _U(CELLS)).astype(np.int64)] - noise, 0)
                rank = np.log2(1 + count / (noise / 2 + 1)).astype(np.int8)
                order = np.lexsort((ta.mix(u + _U(99)), rank))
                reads = np.cumsum(count[order] + 1)
                longest = n - -(-percent * n // 100)  # with the smallest partner there may be
                usual = n - -(-2 * percent * n // (100 + percent))  # with one of equal size
                k = asks[: max(1, min(MOST_SHARED, n - longest))]
                best = int(k[np.argmin(reads[usual + k - 1] * (1 + VERIFY_COST / k))])
                need.append(best)
                prefix.append(u[order[: longest + best]].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "text_key": batch["text_key"], "node": pa.array(node, pa.int64()), "n": pa.array(n_set, pa.int64()), "need": pa.array(need, pa.int32()), "prefix": pa.array(prefix, pa.binary())})

    return docs.mapInArrow(sign, "doc_id long, text_key long, node long, n long, need int, prefix binary")


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, packed) of the classes ``wanted`` (text_key), and of some others: a text of each class, compressed.

    A table of hashed keys, sized by their number up to a bound, lets tasks pass over
    most other texts, so few but those wanted are shuffled.  A compressed text has a
    third of the bytes of its n-gram hashes, which are made again where they are used.
    """
    prepare(texts.sparkSession)
    cells = min(MOST_FLAGS, 1 << max(15, int(16 * wanted.count()).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(bits(wanted, "text_key", cells))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            key = batch["text_key"].to_numpy()
            _, first = np.unique(key, return_index=True)  # equal texts once
            some = np.zeros(len(key), bool)
            some[first] = True
            cell = key % cells
            some &= flags[cell >> 3] >> (cell & 7) & 1 > 0
            batch = batch.filter(pa.array(some, pa.bool_()))
            node = [_node(u) for u in gram_sets(batch["text"], size)]
            packed = [zlib.compress(t.as_buffer() if t.is_valid else b"") for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return texts.mapInArrow(pick, "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed"))


def _unpacked(packed: pa.BinaryScalar, size: int) -> np.ndarray:
    """The n-gram set of a compressed text."""
    return next(gram_sets(pa.array([zlib.decompress(packed.as_buffer())], pa.binary()).cast(pa.string()), size))


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets are similar enough.  Texts are sent for classes in pairs only."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(texts, cut(classes.join(nodes, "node", "left_semi").select("text_key")), size)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held, of_b = [], None, None
            for x, b, y in zip(batch["x"], batch["b"].to_pylist(), batch["y"]):  # one pair after the other: sets are long
                if b != held:  # rows of one b come together
                    held, of_b = b, _unpacked(y, size)
                x, y = _unpacked(x, size), of_b
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def _across(postings: DataFrame, joined: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, table they rest on): postings of tokens that more than one component has, each with its component and whether that is not the token's largest."""
    if joined is None:  # each class is a component of its own
        rows = postings.withColumn("component", F.col("node"))
    else:
        rows = postings.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = scratch.written(rows, "across")
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("many"))
    sizes = sizes.groupBy("token").agg(F.max_by("component", F.struct("many", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    return rows.join(sizes.select("token", "largest"), "token").withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), rows


def _candidates(left: DataFrame, rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) of a class of ``left`` and another component's, that share as many tokens as they ask for and whose sizes allow a link.

    With ``all_pairs``, left has the rows outside each token's largest component, and
    each pair comes once for each shared token.
    """
    left = left.select("token", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "need", "place", "component")])
    common = f"(({percent} * (n + n1) + {99 + percent}) div {100 + percent})"
    asked = "least(need, need1)"
    pairs = left.join(rows, "token").where(
        f"component <> component1 AND {percent} * greatest(n, n1) <= 100 * least(n, n1) AND place < n - {common} + {asked} AND place1 < n1 - {common} + {asked}"
    )
    a, b = F.least("node", "node1"), F.greatest("node", "node1")
    if all_pairs:
        pairs, group = pairs.where("NOT outside OR node1 < node"), [a.alias("a"), b.alias("b")]
    else:
        group = [a.alias("a"), b.alias("b"), (F.col("node") < F.col("node1")).alias("turned")]
    pairs = pairs.groupBy(*group).agg(F.count("*").alias("shared"), F.first(F.expr(asked)).alias("need")).where("shared >= need").select("a", "b")
    return pairs if all_pairs else pairs.distinct()


def _few_left(rows: DataFrame) -> bool:
    """Whether all pairs across components that rows outside each token's largest one make are fewer than those of all rows with leaders."""
    tokens = rows.groupBy("token").agg(F.count("*").alias("many"), F.count_if("outside").alias("outside"))
    reads, most = tokens.agg(F.sum(F.col("many") * F.col("outside").cast("double")), F.sum(F.col("many") * LEADERS)).first()
    return not reads or reads <= most


def _joined(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) with new links (a, b): those found before stand for the links that made them."""
    return connected_components(links if joined is None else joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _all_links(postings: DataFrame, joined: DataFrame | None, texts: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of classes of different components: of each token, rows outside its largest component look for partners."""
    rows, base = _across(postings, joined, scratch)
    pairs = scratch.written(_candidates(rows.where("outside"), rows, percent, all_pairs=True), "candidates")
    scratch.drop(base)
    links = scratch.written(_verified(pairs, texts, classes, size, percent), "links")
    scratch.drop(pairs)
    return links


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("text_key", text_key(F.col("text")))


def _prepared(texts: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of rows, classes of equal sets, postings of the classes' shared tokens)."""
    frequencies = counts(texts.select("text"), CELLS, lambda batch: gram_sets(batch["text"], size))
    signed = scratch.written(_signatures(texts, size, percent, frequencies), "signatures")

    classes = signed.where("node IS NOT NULL").groupBy("node", "n", "need", "prefix")  # all equal within a class
    once = scratch.written(classes.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("text_key").alias("text_key")), "classes")
    tokens = repeated(once.select(F.col("node").alias("owner"), F.col("prefix").alias("values")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(p, np.int32) for p in batch["places"].to_pylist()]
            times = [len(p) for p in places]
            if sum(times):
                token = np.concatenate([np.frombuffer(v.as_buffer(), _U)[p].view(np.int64) for v, p in zip(batch["values"], places)])
                yield pa.RecordBatch.from_pydict({"token": pa.array(token, pa.int64()), "place": pa.array(np.concatenate(places), pa.int32())} | {c: pa.array(np.repeat(batch[c].to_numpy(), times), t) for c, t in (("node", pa.int64()), ("n", pa.int64()), ("need", pa.int32()))})

    postings = tokens.join(once, tokens["owner"] == once["node"]).select("node", "n", "need", F.col("prefix").alias("values"), "places").mapInArrow(spread, "token long, place int, node long, n long, need int")
    return signed, once.select("node", "class_id", "class_size", "text_key"), scratch.written(postings, "postings")


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): class_id of each two classes of different sets that link, a < b, every link once.

    Classes, sets and links are those of ``similar_components``, which tells the
    members of each class.  A group of many near copies has as many rows here as it
    has links.  No rows, or no links: no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = _texts(docs, id_col, text_col)
    signed, classes, postings = _prepared(texts, size, percent, scratch)
    links = _all_links(postings, None, texts, classes, size, percent, scratch)
    ids = classes.select("node", "class_id")
    named = links.join(ids.select(F.col("node").alias("a"), F.col("class_id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("class_id").alias("y")), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, class_size, component_id, group) of every row of ``docs``.

    group is one number for all rows that links join, whatever their ids, and null for
    a row with an empty set; the rest is as ``similar_components`` tells it.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = _texts(docs, id_col, text_col)
    signed, classes, postings = _prepared(texts, size, percent, scratch)

    joined = None
    crowds = postings.groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") >= CROWD)
    crowds = scratch.written(postings.join(crowds, "token").drop("many"), "crowds")
    if not crowds.isEmpty():
        central = crowds.groupBy("node").agg(F.count("*").alias("central"))
        crowds = scratch.written(crowds.join(central, "node"), "crowds")
        for k in range(ROUNDS):
            rows, base = _across(crowds, joined, scratch)
            if _few_left(rows):
                scratch.drop(base)
                break
            # A text from which others are copied shares more tokens than its copies, whose rarest are their own.
            order = [F.xxhash64("node", F.lit(k)), F.col("node")]
            first = Window.partitionBy("token").orderBy(*([F.desc("central")] if k % 2 == 0 else []), *order)
            leaders = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= LEADERS).drop("rank")
            pairs = scratch.written(_candidates(leaders, rows, percent, all_pairs=False), "candidates")
            scratch.drop(base)
            found = scratch.written(_verified(pairs, texts, classes, size, percent), "links")
            scratch.drop(pairs)
            none = found.isEmpty()
            joined = joined if none else _joined(joined, found)
            scratch.drop(found)
            if none:
                break
    scratch.drop(crowds)

    components = _joined(joined, _all_links(postings, joined, texts, classes, size, percent, scratch))
    named = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select("node", "class_id", "class_size", "component_id", "component")
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("component").alias("group"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, class_size, component_id) of every row of ``docs``.

    Words are runs of other than ASCII white space, A-Z as a-z.  Two rows link if
    100 * |intersection| >= percent * |union| of their sets of ``size``-word
    n-grams; component_id is the least doc_id reachable by links, class_id the
    least doc_id with an equal set, class_size the number of such rows.

    A text of fewer words than ``size`` has one n-gram, all its words.  A row whose
    text is null, empty or white space has an empty set and links with nothing.
    Repeated rows are rows of one class.  A null id is never chosen as the least,
    unless a component has no other.  No rows: no rows.  Other columns play no part.
    """
    return similar_groups(docs, id_col, text_col, size, percent).drop("text_key", "group")
