"""Encoding with a word BPE vocabulary file and decoding, equal to the tokenizers library.

Frequent words of the corpus are compiled, with their ids, into an automaton with
shared suffixes (``lexicon``); every other word is merged exactly.  Word counts
are Misra-Gries summaries of bounded size, one for each task, which cover all
documents; which words they choose sets the speed and never the result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.llm import textarrays as ta
from chronarch.llm.lexicon import Lexicon, build
from chronarch.llm.shipping import ship, shipped
from chronarch.llm.tables import prepare, with_results

#: Words in the lexicon, and counters of a task's summary.
LEXICON_WORDS, COUNTERS = 1 << 14, 1 << 15
#: Rank of a pair that is not merged.  Up to so many letters looking through all pairs is faster than a heap; the ids are the same.
NO_RANK, SHORT = 1 << 30, 40
#: Words that a worker keeps decided, so that it does not walk the automaton for each.
KEPT_WORDS = 1 << 17
#: All but ASCII letters and characters outside ASCII.
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
#: White space as the vocabulary's patterns mean it (fixed values).
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Pieces of normalised text: the vocabulary's pattern (fixed values), and the same for texts of which all letters outside ASCII are of the Latin blocks.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
LATIN = r"a-zß-öø-ňŊ-ɏ"
LATIN_ONLY = re.compile(rf"[\x00-\x7f{LATIN}]*")
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{SPACE}{LATIN}0-9]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The vocabulary of a file, its merges, and what follows from them for a word or a text."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.characters = _byte_characters()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: the leftmost pair of least rank is merged until none is left."""
        parts: list[str | None] = [self.characters[b] for b in word]
        parts[-1] += self.suffix
        rank = self.ranks.get
        if len(parts) > SHORT:
            return self._merge_long(parts)
        open_ = [rank(p, NO_RANK) for p in zip(parts, parts[1:])]  # rank of each pair of neighbours
        while open_:
            least = min(open_)
            if least == NO_RANK:
                break
            k = open_.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del open_[k]
            if k:
                open_[k - 1] = rank((parts[k - 1], parts[k]), NO_RANK)
            if k < len(open_):
                open_[k] = rank((parts[k], parts[k + 1]), NO_RANK)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge_long(self, parts: list[str | None]) -> list[int]:
        """The same with a heap of pairs by rank and place: n letters take n log n steps."""
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapify(waiting)  # by rank, then place
        while waiting:
            r, i = heappop(waiting)
            k = after[i]
            if parts[i] is None or k >= n or rank((parts[i], parts[k])) != r:
                continue  # one of the two has been merged since
            parts[i] += parts[k]
            parts[k] = None
            after[i] = to = after[k]
            before[to] = i
            if to < n and (r := rank((parts[i], parts[to]))) is not None:
                heappush(waiting, (r, i))
            at = before[i]
            if at >= 0 and (r := rank((parts[at], parts[i]))) is not None:
                heappush(waiting, (r, at))
        return [self.ids[p] for p in parts if p in self.ids]

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return LATIN_PIECES.findall(text) if LATIN_ONLY.fullmatch(text) else PIECES.findall(text)

    def sections(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at odd places."""
        return self.at_special.split(text) if "<|" in text else [text]


class _Kept(dict):
    """Results by piece; what is missing is found in the lexicon, or merged."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None, form) -> None:
        self.bpe, self.lexicon, self.form = bpe, lexicon, form

    def __missing__(self, piece: str):
        word = piece.encode()
        ids = self.lexicon.get(word) if self.lexicon else None
        out = self.form(self.bpe.merge(word) if ids is None else ids)
        if len(self) < KEPT_WORDS:  # frequent words come early; those that no longer fit are decided each time
            self[piece] = out
        return out


class Coder:
    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None = None) -> None:
        self.bpe = bpe
        self.lists = _Kept(bpe, lexicon, list)
        # Decoding joins the tokens of the ids by one space.
        self.texts = _Kept(bpe, lexicon, lambda ids: (" ".join(map(str, ids)), " ".join(map(bpe.tokens.__getitem__, ids))))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, section in enumerate(self.bpe.sections(text or "")):
            out += [self.bpe.special[section]] if k % 2 else [x for p in self.bpe.pieces(section) for x in self.lists[p]]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.bpe.tokens[i] for i in ids if i in self.bpe.tokens)

    def told(self, text: str | None) -> tuple[str, str]:
        """The ids in decimal and the decoded text, as ``encode`` and ``decode`` give them."""
        out = []
        for k, section in enumerate(self.bpe.sections(text or "")):
            out += [(str(self.bpe.special[section]), section)] if k % 2 else map(self.texts.__getitem__, self.bpe.pieces(section))
        if not out:
            return "", ""
        ids, words = zip(*out)
        return " ".join(filter(None, ids)), " ".join(filter(None, words))


_CODERS: dict[str, Coder] = {}


def _coder(bpe: WordBpe, file: str) -> Coder:
    """The coder of a worker process, which maps the lexicon's file once."""
    if file not in _CODERS:
        _CODERS.clear()
        _CODERS[file] = Coder(bpe, Lexicon(shipped(file)))
    return _CODERS[file]


def frequent_words(texts: DataFrame) -> list[str]:
    """The words of greatest count over all rows of ``texts`` (text), by summaries of bounded size."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        for batch in batches:
            for w in ta.chunks(batch["text"], NOT_LETTERS):
                _, at, times = np.unique(w.hashes(lower=True), return_index=True, return_counts=True)
                raw = w.data.tobytes().lower()
                for s, e, n in zip(w.starts[at].tolist(), w.ends[at].tolist(), times.tolist()):
                    word = raw[s:e]
                    count[word] = count.get(word, 0) + n
                if len(count) > 4 * COUNTERS:
                    least = sorted(count.values(), reverse=True)[COUNTERS]
                    count = {k: n - least for k, n in count.items() if n > least}
        top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:COUNTERS]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode().lower() for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = texts.select("text").mapInArrow(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(LEXICON_WORDS).collect()]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, with n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also ids (``decode`` makes texts of them).

    ids_sha256 is that of the decimal ids joined by one space, decoded_sha256 that
    of the decoded text in UTF-8.  A null or empty text has no ids and decodes to "".
    The special tokens' strings in a text are those tokens.  Input columns named
    like a result are replaced; repeated rows are encoded each.

    ``vocabulary`` is the path of the tokenizer file, read by the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    bpe = WordBpe(vocabulary)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    words = [w for w in frequent_words(texts) if bpe.pieces(w) == [w]]
    file = ship(spark, build({w.encode(): bpe.merge(w.encode()) for w in words}), "lexicon")
    shared = spark.sparkContext.broadcast(bpe)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, file)
        for batch in batches:
            n, sha, decoded, numbers = [], [], [], []
            for text in batch["text"]:  # one after the other: the strings of a batch's ids would fill the memory
                i, t = coder.told(text.as_py())
                n.append(len(i) and i.count(" ") + 1)
                sha.append(hashlib.sha256(i.encode()).hexdigest())
                decoded.append(hashlib.sha256(t.encode()).hexdigest())
                if ids:
                    numbers.append(np.fromstring(i, np.int32, sep=" "))
            out = {"row": batch["row"], "n": pa.array(n, pa.int64()), "i": pa.array(sha, pa.string()), "d": pa.array(decoded, pa.string())}
            if ids:
                out |= {"ids": pa.array(numbers, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n long, i string, d string" + ", ids array<int>" * ids)
    results = {"n_tokens": F.col("n"), "ids_sha256": F.col("i"), "decoded_sha256": F.col("d")} | ({"ids": F.col("ids")} if ids else {})
    clash = {k.lower() for k in results}
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in others if c.lower() not in clash], *[c.alias(k) for k, c in results.items()])


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` with decoded: the tokens of ids_col joined by one space; null ids give "", unknown ones nothing."""
    prepare(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(WordBpe(vocabulary).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(table.value[i] for i in x or [] if i in table.value) for x in batch[ids_col].to_pylist()]
            yield batch.append_column("__decoded", pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return with_results(df.mapInArrow(run, f"{schema}, __decoded string"), {"decoded": F.col("__decoded")}).drop("__decoded")
