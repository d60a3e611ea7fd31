"""The corpus queries against SQL, on the test tables and on a table of edge cases."""

import os
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from chronarch.llm.queries import ORACLE_SQL, QUERIES

from against import assert_same
from conftest import DATA

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Nulls, empty and very long texts, copies, near copies, repeated rows and passages."""
    at = str(tmp_path_factory.mktemp("edges"))
    for name in os.listdir(DATA):
        shutil.copy(f"{DATA}/{name}", at)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = prose(60), prose(40)
    near = base.split()
    near[30] = "other"
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    texts = [
        None, "", " \t\n\r\x0b\x0c ", "one", "one two", "ONE two", base, base, base.upper(), " ".join(near), f"x {passage} y", f"{passage} z {passage}",
        item, f"Intro. {item} End.", item.upper().replace(" ", " -- "), "é   ü ü | <|endoftext|> Σς", "a\n" * 30, prose(30_000), "line one\n\nline one\nother", "x" * 50_000,
    ]
    rows = [(k, t, "en", None if k % 3 == 0 else f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(100 + k, f"menu of the house\ntext {prose(20)}", "en", "src0", 1) for k in range(60)]
    rows += [rows[6], rows[6]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    os.remove(f"{at}/documents.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    html = '<html><head>{}</head><body>x</body></html>'
    pages = [
        (1, "http://a.net/", html.format('<link rel="canonical" href="https://ok.com/x">')), (2, "https://ok.com/x", None), (3, "HTTPS://OK.com/x#top", ""),
        (4, "http://b.org/fr/1", html.format('<meta http-equiv="refresh" content="0; url=http://a.net/">')), (5, "http://b.org/en/1", html.format("<link href='//ok.com/x' rel='canonical'>")),
        (6, None, html), (7, "no address", html), (8, "http://www.Example.NET/en/5?q", html), (9, "http://example.net/de/5", html), (10, "http://sub.example.com/de/", html), (10, "http://sub.example.com/de/", html),
        (11, "http://c.com/x/y", html.format("<base href='http://example.com/de/f?q'><link rel='canonical' href='z'>")), (12, "http://d.com/", html.format("<script>'<link rel=canonical href=http://a.net/>'</script>")),
        (13, "http://e.com/de/x/", html.format("<link rel='canonical' href='../../en/./f/..'>")), (14, "http://e.com/en/", html.format("<base href='//f.net'><link href='?a' rel='canonical'>")),
        (15, "http://g.com", html.format("<link rel='canonical' href='/../h'>")), (16, "http://g.com/h", html.format("<link rel='canonical' href='mailto:x@a.net'>")), (17, "http://g.com/h?z", html.format("<title><link rel='canonical' href='http://a.net/'></title>")),
    ]
    os.remove(f"{at}/pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def views(at):
    c = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        path = f"{at}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert_same(spark, duck, QUERIES[name], ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_edge_cases_equal_sql(spark, edges, name):
    # Repeated rows make SQL joins by doc_id multiply; keep one of each for the comparison.
    c = views(edges)
    at = edges + "-once"
    if not os.path.exists(at):
        shutil.copytree(edges, at)
        shutil.rmtree(f"{at}/documents.parquet")
        spark.read.parquet(f"{edges}/documents.parquet").dropDuplicates(["doc_id"]).write.parquet(f"{at}/documents.parquet")
    c = views(at)
    assert_same(spark, c, QUERIES[name], ORACLE_SQL[name], at)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_collocations"}))  # its rows are phrases
def test_edge_cases_keep_all_rows(spark, edges, name):
    table = "pages" if name == "op3_url_redirects" else "documents"
    out = QUERIES[name](spark, edges)
    assert out.count() == spark.read.parquet(f"{edges}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


CLASHES = ("score", "predicted", "evidence", "n_shingles", "component_id", "shard", "slot", "host", "path", "rule", "verdict", "n_words", "n_hit", "kept", "kept_sha256", "ids", "n_tokens", "surrogates", "n_entities", "__key", "row", "key", "n", "group", "salt", "form", "output", "phrase", "rank", "lang_pred", "piece", "many")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns_change_nothing(spark, edges, tmp_path, name):
    for table in ("documents", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{edges}/{table}.parquet")
        df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns}).write.parquet(f"{tmp_path}/{table}.parquet")
    plain, more = ([str(r) for r in QUERIES[name](spark, at).collect()] for at in (edges, str(tmp_path)))
    if name not in ("op4_toxicity_neighbours", "op5_quality_attention"):
        assert sorted(plain) == sorted(more)
    else:
        assert len(plain) == len(more)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Rows for the pipeline: nulls, no words, repeated ids, copies and near copies of different ids, extra columns."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    t, u = prose(60), prose(70)
    near = " ".join([*t.split()[:-1], "other"])
    rows = [(1, t), (2, t), (2, u), (3, near), (None, t), (None, u), (4, None), (4, ""), (4, " \n"), (5, "two words"), (6, "Two words"), (7, prose(40)), (7, prose(40)), (8, u), (8, u)]
    return spark.createDataFrame([(k, x, "en", "s", 1, "extra") for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_near_duplicates_equal_brute_force(spark, odd_docs):
    import corpus_pipeline as p

    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            groups.setdefault(find(k), []).append((i is None, i or 0))
    got = [(r["doc_id"], r["text"]) for r in p.near_duplicates(spark, odd_docs, DATA).collect()]
    assert sum(not grams(t) for _, t in got) == 3
    kept = [(i is None, i or 0) for i, t in got if grams(t)]
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_pipeline_stages_on_odd_rows(spark, odd_docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, odd_docs, DATA)
        assert stage(spark, odd_docs.limit(0), DATA).count() == 0
        rows = out.collect()
        if name != "tokens":
            assert out.columns == odd_docs.columns
            assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
        if name in ("decontaminate", "personal_data", "tokens"):
            assert len(rows) == odd_docs.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    for name, stage in p.STAGES[:-1]:
        from chronarch.llm.tables import written

        docs = written(stage(spark, docs, DATA), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= kept and now
        assert name != "personal_data" or now == kept
        kept = now
    last = p.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in last.collect()} == kept
