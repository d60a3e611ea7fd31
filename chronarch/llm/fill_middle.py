"""Fill-in-the-middle by bit-parallel arithmetic on big integers.

A text's bytes become one integer with a bit for each byte: ``bytes.translate`` marks
the bytes of a class, and shifts and boolean operations mark the last byte of every
token for the whole text at once.  ``bit_count`` gives the number of tokens, and
halving finds the byte at which the k-th of them ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm.tables import prepare, with_results

#: Marks of prefix, suffix and middle, and the forms (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes between words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: "1" for the bytes of a class, "0" for others: those of words, and those that begin a code point.
WORD = bytes(ord("0") if c in SPACES else ord("1") for c in range(256))
LEAD = bytes(ord("0") if 0x80 <= c < 0xC0 else ord("1") for c in range(256))


def mask(data: bytes, kind: bytes) -> int:
    """The integer whose bit i tells whether byte i of ``data`` is of the class."""
    return int(data[::-1].translate(kind), 2) if data else 0


def token_ends(data: bytes) -> int:
    """A bit at the last byte of each token: of each word, with the blanks before it, and of blanks that end the text."""
    word = mask(data, WORD)
    ends = word & ~(word >> 1)
    return ends | (1 << (len(data) - 1)) if data and data[-1] in SPACES else ends


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, from 1; ``bits`` has as many at least."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - n
    return at


def chances(seed: int, name: object) -> list[int]:
    """Four numbers of 32 bits, the same for a name every time."""
    told = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(text: str, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and of middle, output) of one text."""
    data = text.encode("utf-8", "surrogatepass")
    ends = token_ends(data)
    n = ends.bit_count()
    if not data or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (select(ends, k) + 1 if k else 0 for k in (first, last))
    lead = mask(data, LEAD)
    before, until = ((lead & ((1 << x) - 1)).bit_count() for x in (a, b))
    prefix, middle, suffix = text[:before], text[before:until], text[until:]
    if h[3] % 100 < spm:
        return n, SPM, before, until - before, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, before, until - before, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text again, from what ``fill_in_middle`` made of it."""
    second = F.when(form == SPM, F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    i, j = F.instr(output, second), F.instr(output, F.lit(MIDDLE))
    one, two, middle = F.substr(output, F.lit(4), i - 4), F.substr(output, i + 3, j - i - 3), F.substr(output, j + 3)
    return F.when(form == PLAIN, output).when(form == SPM, F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with n, form, prefix_chars, middle_chars and output.

    n counts tokens: words with the blanks before them, and blanks at the end.
    ``rate`` of 100 texts are cut in three at token ends that their id and ``seed``
    decide; ``spm`` of 100 of these put the suffix first.  ``restored`` undoes it.

    A null text counts as the empty one, which is plain, as is a text that holds one
    of the marks.  A null id counts as the empty name.  Repeated rows come out alike,
    each row for itself.  No rows: no rows.  Input columns named like a result are replaced.
    """
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transformed(t.as_py() or "", chances(seed, k), rate, spm) for k, t in zip(batch["id"].to_pylist(), batch["text"])]
            columns = list(zip(*made)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_pydict({"row": batch["row"]} | {f"r{k}": pa.array(c, kind) for k, (c, kind) in enumerate(zip(columns, kinds))})

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, r0 long, r1 string, r2 long, r3 long, r4 string")
    results = {"n": F.col("__r0"), "form": F.col("__r1"), "prefix_chars": F.col("__r2"), "middle_chars": F.col("__r3"), "output": F.col("__r4")}
    flat = done.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *[F.col(f"r{k}").alias(f"__r{k}") for k in range(5)])
    return with_results(flat, results).drop(*[f"__r{k}" for k in range(5)])
