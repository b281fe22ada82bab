"""Operators on vectors and pages against brute force, and the pipeline's stages."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import neighbours, top_k, web_text
from corpusmill.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.05 if i % 3 else 0.5, size=8)], i % 2, "x") for i in range(900)]
    rows += [(1000 + i, [1.0] * 8, 0, "x") for i in range(40)] + [(5, rows[5][1], 1, "x")]
    rows += [(2000, None, 0, "x"), (2001, [], 0, "x"), (2002, [0.0] * 8, 0, "x"), (2003, [math.nan] * 8, 0, "x"),
             (2004, [1.0] * 8, None, "x"), (2005, [1.0, None] * 4, 0, "x"), (2006, [1.0] * 3, 0, "x"), (None, [1.0] * 8, 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").repartition(3)


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors(vectors):
    rows = vectors.collect()
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.array(r.embedding) / np.linalg.norm(r.embedding) if usable(r.embedding) and any(r.embedding) and r.label is not None else None for r in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i].label == rows[j].label and a @ b >= 0.98 - 1e-15:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.vec_id)
    least = {g: min(ids, key=lambda x: (x is None, x or 0)) for g, ids in groups.items()}
    expected = sorted(((r.vec_id, links[i], least[find(i)]) for i, r in enumerate(rows)), key=repr)
    found = neighbours.near_vectors(vectors).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert {r.recall for r in found} == {1.0} and len({r.audited for r in found}) == 1


def test_isolated_pairs_in_dense_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64)) * 1.5
    rows = centres[rng.integers(0, 20, 20_000)] + rng.normal(size=(20_000, 64)) * 0.6
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    away = rng.normal(size=(300, 64))
    away -= (away * rows[:300]).sum(axis=1, keepdims=True) * rows[:300]
    twins = rows[:300] * 0.982 + away / np.linalg.norm(away, axis=1, keepdims=True) * math.sqrt(1 - 0.982**2)
    # One hot group beside them holds nearly all links.
    hot = rows[19_999] + rng.normal(size=(6_000, 64)) * 0.002
    every = np.concatenate([rows, twins, hot])
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.component_id for r in neighbours.near_vectors(table.repartition(4)).collect()}
    assert sum(found[20_000 + i] == found[i] for i in range(300)) >= 0.99 * 300
    assert len({found[i] for i in range(20_300, 26_300)}) == 1


def test_audit_counts_each_vertex_once(spark):
    rng = np.random.default_rng(8)
    pairs = rng.normal(size=(200, 64))
    every = np.concatenate([pairs, pairs + rng.normal(size=(200, 64)) * 0.001, np.ones((300, 64)) + rng.normal(size=(300, 64)) * 0.001])
    nodes = spark.createDataFrame([(i, "64 x", bytearray(v.tobytes())) for i, v in enumerate(every)], "node long, group string, vector binary")
    # The large group and half of the pairs are found: few of all links are missing, but half of the pairs.
    roots = spark.createDataFrame([(i, 400) for i in range(400, 700)] + [(i % 200, i % 200) for i in range(100)]
                                  + [(200 + i, i) for i in range(100)], "node long, root long")
    outside, inside = neighbours.audit(nodes, roots)
    assert outside == (400, 0.5) and inside[0] > 0 and inside[1] == 1.0


def test_no_vectors(vectors):
    assert neighbours.near_vectors(vectors.limit(0)).count() == 0
    assert top_k.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k(vectors):
    whole = {(r.vec_id, tuple(int(math.floor(64 * x)) for x in r.embedding)) for r in vectors.collect() if usable(r.embedding) and r.vec_id is not None}
    expected = []
    for q, v in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole if c != q and len(w) == len(v))[:20]
            expected += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    found = top_k.top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(expected)


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(700, 16)) * 0.2).astype(np.int64)
    x[::9] = 0
    ids = rng.permutation(700)
    index = top_k.BlockIndex(ids, x, top_k.postings(x))
    for number, found, scores in index.search(ids[:50], x[:50], 7):
        plain = x @ x[number]
        order = [i for i in np.lexsort((ids, -plain)) if ids[i] != ids[number]][:7]
        assert list(found) == list(ids[order]) and list(scores) == list(plain[order])


def test_given_vectors_leave_postings_unread(spark, sf_dir):
    rows = top_k.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([np.frombuffer(r.data, np.int64) for r in rows])
    index, asked = top_k.BlockIndex(ids, x, top_k.postings(x)), np.flatnonzero(ids % 20 == 0)
    found = {number: (list(best), list(scores)) for number, best, scores in index.search(ids[asked], x[asked], 20)}
    for number, at in enumerate(asked):
        plain = x @ x[at]
        order = [i for i in np.lexsort((ids, -plain)) if i != at][:20]
        assert found[number] == (list(ids[order]), list(plain[order]))
    assert index.read < len(index.rows) * len(asked)


PAGES = [
    (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"),
    ("<nav>n</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<p>d<div class='comments'>no</div><form>no</form></article><footer>f</footer>", "T a bc d"),
    ("<main><ul><li>1<li>2</ul><aside>s</aside></main><div class=sidebar>x</div>", "1 2"),
    ('<article>k<script>var a="</p>";</script><!-- <p>no</p> -->&nbsp;&eacute;<p title="a>b">t</p></article>', "k é t"),
    ("<div>" * 5000 + "deep", "deep"), ("<p>un<b>closed<br>x</i>y", "unclosed xy"), ("a < b <", "a < b <"),
]


def test_page_text():
    assert [web_text.Page(p).text() for p, _ in PAGES] == [t for _, t in PAGES]


def test_names_alone_do_not_take_the_article():
    article = "<article><p>The whole story.</p></article>"
    for wrapper in ("site has-sidebar", "with-banner", "share-enabled", "sidebar", "widget header"):
        assert web_text.Page(f"<div>Logo</div><div class='{wrapper}'>{article}</div>").text() == "The whole story.", wrapper
    assert web_text.Page("<article class='post comments-open'>The story.</article>").text() == "The story."
    assert web_text.Page("<body class='comments'><div id=banner><main>The story.</main></div></body>").text() == "The story."
    # Other articles than the page's own stay away, and so do comments.
    assert web_text.Page(f"{article}<div class=related><article>Another.</article></div>").text() == "The whole story."
    comments = "<div class=comments><article class='comment'>First!</article></div>"
    assert web_text.Page(f"<main>Text. {comments}</main>").text() == "Text."
    assert web_text.Page(f"<p>Text.</p><div class='sidebar'>Links</div>{comments}").text() == "Text."


def test_templates_are_blocks(spark):
    pages = [(i, f"http://h.org/{i}", f"<article><p>Story {i} is <em>not</em> long.</p><table><tr><th>Price</th><td>{i}</td></tr></table>"
              "<div>Read <b>more</b></div></article>") for i in range(20)]
    found = web_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"Story {i} is not long. Price {i}" for i in range(20)}


def test_recurrence_alone_finds_the_text(spark):
    """Sites without an article, a main or telling names; recurring blocks are counted once per distinct page."""
    rng = np.random.default_rng(2)

    def page(host, i):
        links = "".join(f"<li><a href='/{n}'>{n} of {host}</a>" for n in ("News", "Shop", "Team", "Help"))
        note = "<div><p>We changed our opening hours, please call before you visit us.</p></div>" if i % 2 else ""
        body = f"<h1>Title {i}</h1><p>Story {rng.integers(1 << 40)} of {host}, told at length.</p><p>It ends.</p>" + ("<p>Often said.</p>" if i % 4 == 0 else "")
        end = f"<div><div>Copyright {host}</div><span>All rights reserved</span></div>"
        return f"<body><div><ul>{links}</ul></div>{note}<div class='x{i}'>{body}</div>{end}</body>", body

    def plain(body):
        return " ".join(re.sub("<[^>]*>", " ", body).split())

    made = [(h, i, *page(h, i)) for h in ("a.org", "b.org") for i in range(30)]
    rows = [(n, f"http://{h}/{i}", text) for n, (h, i, text, _) in enumerate(made)]
    # A host with few pages keeps what it repeats; copies of a page are no evidence.
    few = [(100 + i, f"http://few.org/{i}", page("few.org", i)[0]) for i in range(5)] + [(110 + i, "http://few.org/0", "<div>Copied</div>") for i in range(20)]
    pages = spark.createDataFrame(rows + few, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in web_text.main_text(pages).collect()}
    for n, (_, i, _, body) in enumerate(made):
        kept = body.replace("<p>It ends.</p>", "")  # a block that closes every story is a template like any other
        assert found[n] == plain(kept), n
    assert all(found[100 + i].startswith("News of few.org") for i in range(5)) and found[110] == "Copied"

    keyed = pages.withColumn("page_key", F.xxhash64("url", "html"))
    counts = Counter((h, m) for h, _, text, _ in made for m in web_text.Page(text).marks())
    hits = {r.page_key: set(r.marks) for r in web_text.template_subtrees(keyed).collect()}
    for r in keyed.collect():
        often = {m for m in web_text.Page(r.html).marks() if counts[web_text.host_of(r.url), m] >= 10}
        assert hits.get(r.page_key, set()) == often


def test_templates_of_a_host(spark):
    rows = [(i, f"http://h/{i}", f"<article><div><i>Read our rules</i></div><p>story {i} of its own</p></article>", "x") for i in range(30)]
    rows += [(100 + i, "http://copies/x", "<article><p>the same story</p></article>", "x") for i in range(30)]
    rows += [(200, None, None, "x"), (200, None, None, "x"), (None, "http://h/0", "<p>x</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, marks string").repartition(3)
    found = sorted(((r.page_id, r.text, r.n_chars) for r in web_text.main_text(pages).collect()), key=repr)
    expected = [(i, f"story {i} of its own", len(f"story {i} of its own")) for i in range(30)]
    expected += [(100 + i, "the same story", 14) for i in range(30)] + [(200, "", 0)] * 2 + [(None, "x", 1)]
    assert found == sorted(expected, key=repr)
    assert web_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    import os

    import duckdb

    sql = duckdb.connect()
    for file in os.listdir(sf_dir):
        sql.sql(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    table, expected = QUERIES[name](spark, sf_dir), sql.sql(ORACLE[name])
    columns = sorted(table.columns)
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in table.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in expected.fetchall()), key=repr)


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {}
    from corpusmill.session import materialize

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        rows[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
        if name in ("language", "near duplicates", "personal data"):
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert rows["near duplicates"] == rows["personal data"] <= rows["language"]
    assert docs.agg({"length": "sum"}).first()[0] == docs.select("doc_id", "start", "length").agg({"length": "sum"}).first()[0]
