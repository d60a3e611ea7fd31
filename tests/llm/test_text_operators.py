"""Fill-in-the-middle, collocations and languages against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronarch.llm import crossparse as cp
from chronarch.llm import fill_middle as fim
from chronarch.llm import textarrays as ta
from chronarch.llm.collocations import collocations, score
from chronarch.llm.queries import QUERIES, remainder

from conftest import DATA

BIG = DATA.replace("sf0.001", "sf0.01")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "\x1c", " ", "é", "ß", "日本", "😀", "<", "P", ">", "\x0b", "\x00"]


def texts(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_token_ends_equal_the_pattern():
    for text in [*texts(400, 1), "", " ", "\n\n", "x", " x ", "日" * 3000 + " end "]:
        ends = fim.token_ends(text.encode())
        want = [len(text[: m.end()].encode()) - 1 for m in TOKEN.finditer(text)]
        assert ends.bit_count() == len(want)
        assert [fim.select(ends, k + 1) for k in range(len(want))] == want


def plain_fim(doc_id, text, rate, spm):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 40), (0, 0)])
def test_fill_in_middle_equals_plain_python(spark, rate, spm):
    rows = [(k, t) for k, t in enumerate([*texts(120, 2), None, "", "has <P> mark", "< P> <S no <M", "word " * 20_000])] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(k, t, "mine", "x") for k, t in rows], "doc_id long, text string, output string, other string").repartition(3)
    out = fim.fill_in_middle(docs, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted([(k, *plain_fim(k, t, rate, spm), t or "") for k, t in rows], key=key)
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got], key=key) == want
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    own = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in own.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for (g, q), b in own.items()):
            continue
        ways = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(ways)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, rank, p.decode(), -a, l, r, m, -s) for lang, x in out.items() for rank, (s, a, p, l, r, m) in enumerate(sorted(x)[:top], 1)}


def test_collocations_equal_plain_python(spark):
    rng = random.Random(4)
    words = ["new", "york", "of", "the", "é", "日本", "a<b", "x"]
    prose = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(rng.randrange(40)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), prose()) for _ in range(150)]
    rows += [("en", "New York City never sleeps. " * 4), ("en", "ha " * 60), ("en", None), (None, ""), ("fr", " \n.,")] + [("de", "Eins zwei drei vier funf sechs")] * 7
    docs = spark.createDataFrame([(k, *r, "mine") for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    for least, top in ((3, 2000), (5, 6)):
        out = collocations(docs, least=least, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in out.collect()} == plain_collocations(rows, least, top)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs, least=10_000).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    cases = [(10**12, 9 * 10**13, 10**12 + 7, 3 * 10**12), (100, 10**14, 100, 100), (7, 11, 13, 17), (10**12, 10**14, 1, 10**12)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").select("*", score("a", "n", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got]


def folded(text):
    out = re.sub(rb" +", b" ", bytes(cp.FOLDED[c] for c in text.encode()))
    return out


def plain_phrases(text, known):
    """Each phrase is the longest match in the known text, or one byte; segments begin anew."""
    n = 0
    for at in range(0, len(text), cp.SEGMENT):
        part = text[at : at + cp.SEGMENT]
        i = 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in known and part[i : i + k] in known:
                k += 1
            i += k
            n += 1
    return n


def test_phrases_equal_longest_matches():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    known = {k: folded(" ".join(word() for _ in range(300))) for k in ("one", "two")} | {"ß": folded("straße zzz")}
    batch = ["", "a", "...", "Zebra zzz straße", "日本 only", *[" ".join(word() for _ in range(rng.randrange(400))) for _ in range(20)], None]
    m = cp.spread(cp.model(known))
    got = []
    for w in ta.chunks(pa.array(batch)):
        got += cp.parse(m, *cp.fold(w.data, w.bounds)).tolist()
    assert got == [[plain_phrases(folded(t or ""), k) for k in known.values()] for t in batch]


def test_suffix_automaton_reads_substrings_only():
    text = b"abracadabra banana"
    step = cp.suffix_automaton(text)

    def reads(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    rng = random.Random(3)
    assert all(reads(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    for _ in range(2000):
        s = bytes(rng.choice(b"abrcdn ") for _ in range(rng.randrange(1, 8)))
        assert reads(s) == (s in text)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op13_cross_parsing"](spark, BIG).where("held_out").join(docs, "doc_id").where("lang_pred <> 'und'").collect()
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_languages_of_odd_rows(spark):
    rows = [(k, "the cat and the dog and the house", "en") for k in range(20)] + [(100 + k, "der hund und die katze und das haus", "de") for k in range(20)]
    rows += [(200, None, "de"), (201, "", "en"), (202, "123 -- 4!", "en"), (203, "日本", None), (204, "und der hund " * 9000, None), (None, "the dog", "xx"), (205, "the dog", None), (205, "the dog", None)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    out = cp.identify_language(docs, remainder(4) != 2)
    assert out.columns == ["doc_id", "lang", "lang_pred", "score", "entropies"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["entropies"] is None for k in (200, 201, 202))
    assert got[204]["lang_pred"] == "de" and got[205]["lang_pred"] == got[None]["lang_pred"] == "en"
    assert got[203]["lang_pred"] in ("de", "en") and set(got[203]["entropies"]) == {"de", "en"}
    none = cp.identify_language(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = cp.identify_language(docs, F.col("lang") == "de").where("doc_id = 205").first()
    assert one["lang_pred"] == "de" and one["score"] == 1
    assert cp.identify_language(docs.limit(0), remainder(4) != 2).count() == 0
