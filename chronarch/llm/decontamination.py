"""Benchmark passages in documents, found by one Aho-Corasick automaton over words.

Any window of w consecutive words holds a whole segment of g = (w + 1) // 2 words
that begins at a multiple of g in its item.  The automaton holds these segments, a
node for each word at most, so it is about as large as the items; items shorter than
a window stand in it whole.  It reads every document once.  Where a segment is
found, the windows about it are looked up among all windows of items, each of which is there once
with the items that hold it; so text that many items share costs no more than any other.  Words keep their places, so hits are told as byte offsets of
the original text.

A document's words are read in many lanes side by side, each overlapping the one
before by the longest pattern, so that a step of the automaton is one step of arrays.
Words are told apart by 64-bit hashes.  The automaton is one memory-mapped file; the
items of ``MOST_BYTES`` make one, and more items another one, with hits merged by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.shipping import ship, shipped
from chronarch.llm.tables import Scratch, prepare, text_key, with_results

_U = np.uint64
#: Bytes of item texts in one automaton.
MOST_BYTES = 64 << 20
#: Words of a lane, without the overlap.
LANE = 64
RUN = "array<struct<first: int, last: int, start: int, end: int>>"


def _find(edges: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node reached, whether there is an edge): edge k leads to node k + 1."""
    at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
    return at + 1, edges[at] == key


def build(items: list[tuple[str | None, str | None]], size: int) -> tuple[dict[str, np.ndarray], list[list[str]]]:
    """(arrays of the automaton, names of each class of items with equal words)."""
    texts = pa.array([t for _, t in items], pa.string())
    classes: dict[bytes, int] = {}
    names: list[set[str]] = []
    words: list[np.ndarray] = []
    k = 0
    for w in ta.chunks(texts, ta.NOT_ALPHANUMERIC_RAW):
        hashes = w.hashes(lower=True)
        for a, b in zip(w.offsets[:-1], w.offsets[1:]):
            own = hashes[a:b]
            if len(own):
                c = classes.setdefault(own.tobytes(), len(words))
                if c == len(words):
                    words.append(own), names.append(set())
                if items[k][0] is not None:
                    names[c].add(items[k][0])
            k += 1
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, _U)
    n_words = max(1, len(vocabulary))
    item_words = np.searchsorted(vocabulary, np.concatenate(words)).astype(np.int32) if words else np.zeros(0, np.int32)
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    # Patterns: where in item_words each begins, and its length.
    g = (size + 1) // 2
    short = sizes < size
    segments = np.where(short, 1, sizes // g)
    item = np.repeat(np.arange(len(sizes)), segments)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(segments) - segments, segments)
    start = begins[item] + nth * g
    length = np.where(short[item], sizes[item], g)
    # Level by level: nodes are numbered in the order of their edges (node * n_words + word), which are sorted.
    node, first = np.zeros(len(item), np.int64), 0
    edges, fail, levels = np.zeros(0, np.int64), np.zeros(1, np.int32), []
    for d in range(int(length.max()) if len(length) else 0):
        going = np.flatnonzero(length > d)
        key = node[going] * n_words + item_words[start[going] + d]
        own, inverse = np.unique(key, return_inverse=True)
        node[going] = len(edges) + 1 + inverse
        edges = np.concatenate([edges, own])
        levels.append((first, len(edges)))
        first = len(edges)
    fail = np.zeros(len(edges) + 1, np.int32)
    for a, b in levels[1:]:
        parent, word = edges[a:b] // n_words, edges[a:b] % n_words
        at, open_ = fail[parent].astype(np.int64), np.arange(b - a)
        while len(open_):
            to, there = _find(edges, at[open_] * n_words + word[open_])
            fail[a + 1 + open_[there]] = to[there]
            open_ = open_[~there]
            open_ = open_[at[open_] > 0]
            at[open_] = fail[at[open_]]
    # Of the patterns that end at a node: whether one is a segment, and which are whole items; and the next node on the way of failures at which a pattern ends.
    n_nodes = len(edges) + 1
    segment = np.zeros(n_nodes, bool)
    segment[node[~short[item]]] = True
    own = np.flatnonzero(short[item])
    own = own[np.argsort(node[own], kind="stable")]
    short_ends = np.r_[0, np.cumsum(np.bincount(node[own], minlength=n_nodes))]
    ended = segment | (np.diff(short_ends) > 0)
    depth, link = np.zeros(n_nodes, np.int32), np.zeros(n_nodes, np.int32)
    for d, (a, b) in enumerate(levels):
        at = fail[a + 1 : b + 1]
        link[a + 1 : b + 1] = np.where(ended[at], at, link[at])
        depth[a + 1 : b + 1] = d + 1
    root = np.zeros(n_words, np.int32)
    top = edges[: levels[0][1]] if levels else edges
    root[top] = np.arange(1, len(top) + 1)
    # Every window once, by its hash, with a place where it stands and the items that hold it.
    many = np.where(short, 0, sizes - size + 1)
    holder = np.repeat(np.arange(len(sizes)), many)
    at = begins[holder] + np.arange(len(holder)) - np.repeat(np.cumsum(many) - many, many)
    hashes = ta.spans(ta.rolling(vocabulary[item_words]), at, at + size) if len(at) else np.zeros(0, _U)
    windows, first_at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    pairs = np.unique(inverse * max(1, len(sizes)) + holder)
    in_window, holders = pairs // max(1, len(sizes)), pairs % max(1, len(sizes))
    arrays = {
        "vocabulary": vocabulary, "edges": edges, "fail": fail, "link": link, "root": root, "ended": ended.astype(np.uint8), "segment": segment.astype(np.uint8), "depth": depth,
        "short_ends": short_ends, "short": item[own].astype(np.int32), "item_words": item_words, "windows": windows, "window_at": at[first_at],
        "holder_ends": np.r_[0, np.cumsum(np.bincount(in_window, minlength=len(windows)))], "holders": holders.astype(np.int32),
    }
    return arrays, [sorted(x) for x in names]


def _ranges(ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``of``, place) of all places from ends[k] to ends[k + 1] for each k of ``of``."""
    many = ends[of + 1] - ends[of]
    which = np.repeat(np.arange(len(of)), many)
    return which, ends[of][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)


def _lanes(offsets: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each lane, its text's first word); lanes begin every ``LANE`` words of a text."""
    many = -(-np.diff(offsets) // LANE)
    text = np.repeat(offsets[:-1], many)
    return text + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)), text


def scan(m, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, node) of every pattern found in the texts, whose words (places in the vocabulary, -1 if not there) are ``ids``."""
    edges, fail, link, root = (m[k] for k in ("edges", "fail", "link", "root"))
    if not len(edges) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_words, overlap = len(root), int(m["depth"].max()) - 1
    first, text = _lanes(offsets, overlap)
    last = np.minimum(first + LANE, np.repeat(offsets[1:], -(-np.diff(offsets) // LANE)))
    state = np.zeros(len(first), np.int64)
    places, nodes = [], []
    ended = np.asarray(m["ended"]) > 0
    for t in range(-overlap, LANE):
        at = first + t
        inside = (at >= text) & (at < last)
        word = np.where(inside, ids[np.minimum(np.maximum(at, 0), len(ids) - 1)], -1)
        go = np.flatnonzero(word >= 0)
        now, word = state[go], word[go]
        new = root[word].astype(np.int64)
        open_ = np.flatnonzero(now > 0)
        while len(open_):
            to, there = _find(edges, now[open_] * n_words + word[open_])
            new[open_[there]] = to[there]
            open_ = open_[~there]
            now[open_] = fail[now[open_]]
            open_ = open_[now[open_] > 0]
        state[:] = 0
        state[go] = new
        if t < 0:
            continue
        hit = go[new > 0]
        found = np.where(ended[state[hit]], state[hit], link[state[hit]])
        while len(hit := hit[found > 0]):
            found = found[found > 0]
            places.append(at[hit]), nodes.append(found)
            found = link[found]
    return (np.concatenate(places), np.concatenate(nodes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _hits(m, hashes: np.ndarray, ids: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, class) of each window that occurs; classes are windows, and after them whole items.

    About a segment that is found lie ``size`` - its length + 1 windows; those that are an item's
    count, each once, however many items share it.
    """
    place, node = scan(m, ids, offsets)
    depth = np.asarray(m["depth"])[node].astype(np.int64)
    which, at = _ranges(np.asarray(m["short_ends"]), node)
    a, b, kind = [(place - depth + 1)[which]], [(place + 1)[which]], [len(m["windows"]) + np.asarray(m["short"])[at].astype(np.int64)]
    found = np.asarray(m["segment"])[node] > 0
    g = (size + 1) // 2
    begin = np.unique((place[found] - g + 1)[:, None] - np.arange(size - g + 1))
    text = np.searchsorted(offsets, begin, "right") - 1
    begin = begin[(begin >= 0) & (text >= 0)]
    text = np.searchsorted(offsets, begin, "right") - 1
    begin = begin[begin + size <= offsets[text + 1]]
    if len(begin) and len(m["windows"]):
        told = ta.spans(ta.rolling(hashes), begin, begin + size)
        windows = m["windows"]
        k = np.minimum(np.searchsorted(windows, told), len(windows) - 1)
        real = windows[k] == told
        begin, k = begin[real], k[real]
        where = np.asarray(m["window_at"])[k]
        real = np.ones(len(k), bool)
        for d in range(size):
            real &= ids[begin + d] == m["item_words"][where + d]
        a.append(begin[real]), b.append(begin[real] + size), kind.append(k[real])
    return np.concatenate(a), np.concatenate(b), np.concatenate(kind)


def _items(m, kinds: np.ndarray) -> np.ndarray:
    """The items of distinct classes of ``_hits``."""
    n = len(m["windows"])
    _, at = _ranges(np.asarray(m["holder_ends"]), kinds[kinds < n])
    return np.unique(np.r_[np.asarray(m["holders"])[at].astype(np.int64), kinds[kinds >= n] - n])


def _blocks(items: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items of ``MOST_BYTES`` at a time, one block held at once; at least one block."""
    rows, held, any_ = [], 0, False
    for row in items.toLocalIterator():
        rows.append((row["item"], row["text"]))
        held += len((row["text"] or "").encode())
        if held > MOST_BYTES:
            yield rows
            rows, held, any_ = [], 0, True
    if rows or not any_:
        yield rows


def _scanned(rows: DataFrame, block: list, size: int, hits_only: bool) -> DataFrame:
    """``rows`` (text and others) with n_words, runs and names in place of the text; with ``hits_only``, those with runs."""
    arrays, names = build(block, size)
    file = ship(rows.sparkSession, arrays, "automaton")
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped(file)
        vocabulary = m["vocabulary"]
        for batch in batches:
            n, runs, found = [], [], []
            for w in ta.chunks(batch["__text"], ta.NOT_ALPHANUMERIC_RAW):
                n += np.diff(w.offsets).tolist()
                first = len(runs)
                runs += [None] * (len(w.offsets) - 1)
                found += [None] * (len(w.offsets) - 1)
                if not len(vocabulary) or not len(w.starts):
                    continue
                hashes = w.hashes(lower=True)
                ids = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                ids = np.where(vocabulary[ids] == hashes, ids, -1)
                a, b, kind = _hits(m, hashes, ids, w.offsets, size)
                if not len(a):
                    continue
                cover = np.bincount(a, minlength=len(ids) + 1) - np.bincount(b, minlength=len(ids) + 1)
                mark = np.cumsum(cover)[:-1] > 0
                text = np.searchsorted(w.offsets, a, "right") - 1
                for i in np.unique(text):
                    s, e = w.offsets[i], w.offsets[i + 1]
                    edge = np.diff(np.r_[0, mark[s:e], 0].astype(np.int8))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                    at = w.bounds[i]
                    runs[first + i] = [{"first": int(x), "last": int(y), "start": int(w.starts[s + x] - at), "end": int(w.ends[s + y] - at)} for x, y in zip(begin, end)]
                    found[first + i] = sorted({x for c in _items(m, np.unique(kind[text == i])) for x in shared.value[c]})
            spans = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
            out = {c: batch[c] for c in batch.schema.names if c != "__text"}
            out = pa.RecordBatch.from_pydict(out | {"__n": pa.array(n, pa.int64()), "__runs": pa.array(runs, spans), "__names": pa.array(found, pa.list_(pa.string()))})
            yield out.filter(out["__runs"].is_valid()) if hits_only else out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return rows.mapInArrow(run, f"{kept}, __n long, __runs {RUN}, __names array<string>")


def _united(runs: Column) -> Column:
    """Runs in order, those that meet made one."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) == 0) | (r["first"] > F.try_element_at(done, F.lit(-1))["last"] + 1), F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUN), add)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, per_hit: int = 20, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    Words are runs of letters, digits and characters outside ASCII, A-Z as a-z.  A
    document's word in any occurrence of an item's window of ``size`` words is hit;
    hit_spans has the byte offsets [start, end) of runs of hit words in the original
    text.  contaminated: n_hit > 0 and per_hit * n_hit >= n_words.

    Null and empty texts have no words; neither they nor items without words hit.
    Items with a null id are left out of n_items.  Items with equal texts are all
    counted, an item_id that stands in several rows once.  Repeated rows are told
    alike.  Input columns named like a result are replaced.  No items: no hits.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    blocks = _blocks(items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")))
    block, after = next(blocks), next(blocks, None)
    others = [f"`{c}`" for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("__row"), text_key(text).alias("__key"), text.alias("__text"))
    out = _scanned(rows, block, size, hits_only=False)
    if after is not None:
        # More items than one automaton takes: the hits of each further one, by text, are joined to those of the first.
        more, scratch = None, Scratch(spark)
        while after is not None:
            found = scratch.written(_scanned(docs.select(text_key(text).alias("__key"), text.alias("__text")), after, size, hits_only=True).dropDuplicates(["__key"]), "hits")
            more = found if more is None else more.union(found)
            after = next(blocks, None)
        more = more.groupBy("__key").agg(F.flatten(F.collect_list("__runs")).alias("__more"), F.flatten(F.collect_list("__names")).alias("__others"))
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        out = out.join(more, "__key", "left")
        runs = _united(F.concat(none(F.col("__runs"), RUN), none(F.col("__more"), RUN)))
        out = out.select("__row", "__n", runs.alias("__runs"), F.array_sort(F.array_distinct(F.concat(none(F.col("__names"), "array<string>"), none(F.col("__others"), "array<string>")))).alias("__names"))
    runs, names = F.col("__runs"), F.coalesce("__names", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0).cast("long"))
    spans = F.coalesce(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))), F.array().cast("array<struct<start: int, end: int>>"))
    told = out.select("__row.*", F.col("__n"), n_hit.alias("__hit"), names.alias("__names"), spans.alias("__spans"))
    results = {
        "n_words": F.col("__n"), "n_hit": F.col("__hit"), "n_items": F.size("__names").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "__names"), 256),
        "contaminated": (F.col("__hit") > 0) & (per_hit * F.col("__hit") >= F.col("__n")), "hit_spans": F.col("__spans"),
    }
    return with_results(told, results).drop("__n", "__hit", "__names", "__spans")
