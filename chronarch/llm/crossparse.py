"""Languages of texts by cross-parsing (Ziv and Merhav, 1993).

Labelled text of a language becomes a suffix automaton.  A text is read by it from
left to right: each phrase is the longest match that begins where the last one ended,
so a text in that language needs few phrases.  Phrases times the logarithm of the
automaton's text length estimate the text's entropy relative to the language, and the
language of least entropy wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.shipping import Mapped, ship, shipped
from chronarch.llm.tables import prepare, with_results

#: Bounds of the sample: passages of a language, bytes of a passage, languages, bytes of all (the languages share them).
PASSAGES, PASSAGE, MOST_LANGUAGES, MOST_BYTES = 256, 512, 200, 512 << 10
#: Bytes of a language, where there is room for as many.
LANGUAGE_BYTES = 64 << 10
#: A text is parsed in segments of so many bytes, so many at once.
SEGMENT, AT_ONCE = 256, 4096
UNKNOWN = "und"
#: Letters of any script.
LETTER = r"\p{L}"


def _folded() -> np.ndarray:
    """What a byte counts as: letters in lower case, bytes of characters outside ASCII as they are, all else a blank."""
    out = np.full(256, 0x20, np.uint8)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


FOLDED = _folded()


def fold(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with blanks run together, and where each text begins and the last one ends."""
    out = FOLDED[data]
    blank = out == 0x20
    again = np.r_[False, blank[:-1]] & blank
    first = bounds[:-1][bounds[:-1] < len(out)]
    again[first] = False
    kept = np.r_[0, np.cumsum(~again)]
    return out[~again], kept[bounds]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``text``, from state 0."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def model(texts: dict[str, bytes]) -> dict[str, np.ndarray]:
    """The automata of all languages as lists of steps: state, class of bytes and next state, numbered through, with the states and weight of each language."""
    used = sorted(set(b"".join(texts.values())))
    classes = np.full(256, len(used), np.uint8)  # the last class is that of bytes which no language has
    classes[used] = np.arange(len(used))
    source, kind, target, states = [], [], [], []
    for text in texts.values():
        at, step = sum(states), suffix_automaton(text)
        many = [len(s) for s in step]
        source.append(at + np.repeat(np.arange(len(step)), many))
        kind.append(classes[np.fromiter((c for s in step for c in s), np.int64, sum(many))])
        target.append(at + np.fromiter((t for s in step for t in s.values()), np.int64, sum(many)))
        states.append(len(step))
    join = lambda x, d: np.concatenate(x).astype(d) if x else np.zeros(0, d)
    weight = np.array([np.log2(max(len(t), 2)) for t in texts.values()])
    return {"classes": classes, "width": np.array([len(used) + 1]), "states": np.array(states, np.int64), "source": join(source, np.int32), "kind": join(kind, np.uint8), "target": join(target, np.int32), "weight": weight}


def spread(m: Mapped | dict) -> dict[str, np.ndarray]:
    """The automata as one table with a cell for each state and class: the place of the next state's cells, times 2, and 1 more if the byte begins a phrase.

    Where nothing matches, the next state is the one that the byte leads to from the start.
    """
    width, states = int(m["width"][0]), np.asarray(m["states"])
    first = np.cumsum(states) - states
    source, kind, target = (np.asarray(m[k]).astype(np.int64) for k in ("source", "kind", "target"))
    roots = np.repeat((first * width)[:, None], width, 1)
    begins = np.isin(source, first)
    roots[np.searchsorted(first, source[begins], "right") - 1, kind[begins]] = target[begins] * width
    table = np.repeat((2 * roots + 1).astype(np.int32), states, axis=0)
    table[source[~begins], kind[~begins]] = 2 * target[~begins] * width
    return {"classes": np.asarray(m["classes"]), "table": table.ravel(), "starts": (first * width).astype(np.int32), "weight": np.asarray(m["weight"])}


@lru_cache(maxsize=2)
def _spread(file: str) -> dict[str, np.ndarray]:
    """Made once by each worker process, from the file that all of a machine's workers map."""
    return spread(shipped(file))


def parse(m: dict, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases of each folded text (rows) in each language (columns), all segments of all texts read in step."""
    table, starts = m["table"], m["starts"]
    coded = m["classes"][data].astype(np.int32)
    sizes = np.diff(bounds)
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), parts)
    begin = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
    length = np.minimum(bounds[1:][text] - begin, SEGMENT)
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(starts), len(sizes)), np.int64)
    for k in range(0, len(order), AT_ONCE):
        own = order[k : k + AT_ONCE]
        b, n = begin[own], length[own]
        place = np.repeat(starts[:, None], len(own), 1)
        phrases = np.zeros(place.shape, np.int32)
        active = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # segments with a byte at each step
        for i, many in enumerate(active):
            cell = table[place[:, :many] + coded[b[:many] + i]]
            phrases[:, :many] += cell & 1
            place[:, :many] = cell >> 1
        for language in range(len(starts)):
            out[language] += np.bincount(text[own], weights=phrases[language], minlength=len(sizes)).astype(np.int64)
    return out.T


def sample(docs: DataFrame, learnable: Column, lang_col: str, text_col: str) -> dict[str, bytes]:
    """Folded text of each language.

    Texts are dealt to ``PASSAGES`` slots of a language by their hash, and each slot
    takes the ``PASSAGE`` bytes in the middle of the text of least hash, so copies count once
    and what is sent to the driver has a bound.  Of over ``MOST_LANGUAGES`` languages,
    those of most labelled texts are learned.
    """
    text = F.col(f"`{text_col}`")
    own = docs.where(learnable & F.col(f"`{lang_col}`").isNotNull() & text.rlike(LETTER))
    key = F.xxhash64(text)
    from_ = F.greatest(F.lit(1), F.floor((F.length(text) - PASSAGE) / 2).cast("int"))
    rows = own.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.pmod(key, F.lit(PASSAGES)).alias("slot"), key.alias("key"), F.substr(text, from_, F.lit(PASSAGE)).alias("passage"))
    slots = rows.groupBy("lang", "slot").agg(F.min(F.struct("key", "passage")).alias("least"), F.count("*").alias("n"))
    top = slots.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("least")).alias("passages"))  # PASSAGES of a language
    told = sorted(top.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect(), key=lambda r: r["lang"])
    room = min(LANGUAGE_BYTES, MOST_BYTES // max(1, len(told)))
    out = {}
    for r in told:
        data = np.frombuffer("\n".join(p["passage"] for p in r["passages"]).encode(), np.uint8)
        out[r["lang"]] = fold(data, np.array([0, len(data)]))[0][:room].tobytes()
    return out


def identify_language(docs: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred, score and entropies.

    Learns from rows with a language where ``learnable`` holds, a sample of
    ``MOST_BYTES`` in all and ``LANGUAGE_BYTES`` a language (``sample``); the rest of a row never
    counts.  Whole texts are read, in segments of ``SEGMENT`` bytes.  entropies: bits a
    byte by language; lang_pred: the language of least entropy, of equal ones the first
    by name; score: by how much the next one is worse, from 0 (a tie) to 1 (only one
    language was learned).

    A null text, and one without a letter, is ``und`` with score 0 and no entropies, as are
    all texts if no language is learned.  Null languages teach nothing; repeated rows
    come out alike and copies teach once.  No rows: no rows.  Input columns named like a
    result are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = sample(docs, learnable, lang_col, text_col)
    names = list(texts)
    file = ship(spark, model(texts), "languages") if names else None
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _spread(file)
        for batch in batches:
            lettered = np.array(batch["lettered"].to_pylist(), bool)
            rows = [np.zeros((0, len(names)))]
            for w in ta.chunks(batch["text"]):
                data, bounds = fold(w.data, w.bounds)
                rows.append(parse(m, data, bounds) * m["weight"] / np.maximum(np.diff(bounds), 1)[:, None])
            bits = np.concatenate(rows)
            best = bits.argmin(1)
            ranked = np.sort(bits, 1)
            score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-300) if len(names) > 1 else np.ones(len(bits))
            told = [names[k] if some else UNKNOWN for k, some in zip(best, lettered)]
            entropies = [list(map(tuple, zip(names, b))) if some else None for b, some in zip(bits.tolist(), lettered)]
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "told": pa.array(told, pa.string()), "score": pa.array(np.where(lettered, score, 0.0), pa.float64()), "bits": pa.array(entropies, pa.map_(pa.string(), pa.float64()))})

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("row"), text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("lettered"))
    if not names:
        done = rows.select("row", F.lit(UNKNOWN).alias("told"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("bits"))
    else:
        done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, told string, score double, bits map<string,double>")
    flat = done.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *[F.col(c).alias(f"__{c}") for c in ("told", "score", "bits")])
    return with_results(flat, {"lang_pred": F.col("__told"), "score": F.col("__score"), "entropies": F.col("__bits")}).drop("__told", "__score", "__bits")
