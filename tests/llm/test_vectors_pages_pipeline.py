"""Nearest neighbours, HTML extraction, the pipeline, and odd tables for every operator."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrace.llm import ann, decontaminate, html_extract, language_id, near_dedup, packing, queries, secret_scan, sharding, suffix_dedup, token_count
from test_kernel_and_dedup import frame, prose

VEC = "vec_id bigint, embedding array<float>"


def recall(rows, x, k):
    d = ann.squared(x, x)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    return np.mean([len(got.get(i, set()) & set(np.argsort(d[i], kind="stable")[:k])) / k for i in range(len(x))])


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_neighbours_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "sphere" else (rng.normal(size=(30, 16)) * 5)[rng.integers(0, 30, 1500)].astype(np.float32) + x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    rows = ann.nearest_neighbours(df, bucket_rows=200).collect()
    assert recall(rows, x, 10) >= 0.93  # the walk is measured for 0.96 on a sample of queries
    for r in rows[:200]:
        assert r["vec_id"] != r["neighbour_id"] and abs(r["distance"] - np.linalg.norm(x[r["vec_id"]].astype(float) - x[r["neighbour_id"]])) < 1e-5


def test_the_walk_visits_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(9), rng.random(7)
    counts = rng.integers(0, 4, 63)
    cells, last, passed = ann.walk(d1, d2, counts.tolist(), 10**9)
    sums = np.add.outer(d1, d2).ravel()
    assert sorted(cells) == list(range(63)) and np.all(np.diff(sums[cells]) >= 0) and last == sums.max() and passed[-1] == counts.sum()
    part, stop, got = ann.walk(d1, d2, counts.tolist(), 20)
    assert got[-1] >= 20 > (got[-2] if len(got) > 1 else 0) and stop == sums[part[-1]]


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_a_query_set_asks_all_vectors(spark, kind):
    """Recall of the registered form, every id divisible by 100 against all rows, by brute force."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "sphere" else (rng.normal(size=(40, 16)) * 5)[rng.integers(0, 40, 6000)].astype(np.float32) + x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = {}
    for r in ann.nearest_neighbours(df, bucket_rows=500, queries=F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
    assert set(got) == set(range(0, 6000, 100)) and all(set(v) == set(range(1, 11)) for v in got.values())
    found = 0
    for i, v in got.items():
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        found += len(set(v.values()) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert found / (10 * len(got)) >= 0.9
    assert ann.nearest_neighbours(df, queries=F.lit(None).cast("boolean")).count() == 0


def test_codebooks_of_a_bounded_sample(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    monkeypatch.setattr(ann, "FIT_ROWS", 500)
    rows = ann.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)).collect()
    assert recall(rows, x, 10) >= 0.93


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_copies_of_one_vector_find_each_other(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 64)) * 3
    x = (centres[np.arange(4000) % 4] * (1 + spread * rng.normal(size=(4000, 64)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = {}
    for r in ann.nearest_neighbours(df, bucket_rows=1000).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert len(got) == 4000 and all(len(v) == 10 and all(j % 4 == i % 4 for j in v) for i, v in got.items())


def test_vector_edges(spark):
    odd = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [5.0, 5.0]), (3, None), (4, []), (5, [1.0, float("nan")]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0])]
    rows = ann.nearest_neighbours(spark.createDataFrame(odd, VEC)).collect()
    assert {(r["vec_id"], r["neighbour_id"]) for r in rows} == {(1, 2), (2, 1), (1, None), (None, 1), (2, None), (None, 2)}
    assert ann.nearest_neighbours(spark.createDataFrame([], VEC)).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([(1, [1.0, 2.0])], VEC)).count() == 0
    extra = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], VEC).selectExpr("*", "'x' as id", "'x' as v", "'x' as key", "'x' as asks", "'x' as cell", "'x' as `a.b`")
    assert ann.nearest_neighbours(extra, queries=F.col("vec_id") == 0).columns == ["vec_id", "neighbour_id", "rank", "distance"]
    assert [r["neighbour_id"] for r in ann.nearest_neighbours(extra, queries=F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3, 4]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], VEC)
    got = {}
    for r in ann.nearest_neighbours(same).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert got == {i: set(range(11)) - {i} if i < 11 else set(range(10)) for i in range(30)}  # ties: the lowest ids


def test_the_labeller_does_without_the_marks():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    model, right, n = html_extract.fit(pages[:120]), 0, 0
    held = pages[120:]
    bare = [re.sub(r"</?(article|main)[^>]*>", "", p) for p in held]
    for page, (_, labels) in zip(held, html_extract.label_pages(bare, model, html_extract.Vectors())):
        truth = [any(t in ("article", "main") for t in path) for path, _, _ in html_extract.blocks(page)]
        right, n = right + sum(a == b for a, b in zip(truth, labels)), n + len(truth)
    assert right / n > 0.97


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    m = html_extract.Labeller(hidden=3)
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    x, live = rng.normal(size=(4, 3, html_extract.WIDTH)), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], dtype=bool)
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        p = m.scores(x, live)
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * live).sum() / live.sum()

    for k, g in m.gradients(x, live, y).items():
        at = tuple(int(rng.integers(0, s)) for s in m.w[k].shape)
        old, sides = m.w[k][at], []
        for step in (1e-3, -1e-3):
            m.w[k][at] = old + step
            sides.append(loss())
        m.w[k][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - g[at]) < 3e-5


def test_blocks_of_broken_pages():
    page = '<!doctype html><head><title>t</title></head><body><nav><a href="x">Home</a></nav><p>One<p>Two <b>bold &amp; more<br>next</div></p><script>var a = "<p>no</p>"</script><!-- <p>no --><li>item<li>last <img src="a>b"> end'
    assert [(path[-1], text) for path, text, _ in html_extract.blocks(page)] == [("nav", "Home"), ("p", "One"), ("p", "Two bold & more"), ("p", "next"), ("li", "item"), ("li", "last end")]
    assert html_extract.blocks("") == [] and html_extract.blocks("<" * 50)[0][1] == "<" * 50 and html_extract.blocks("<p") == []


@pytest.mark.parametrize(
    "head, rest",
    [
        ("<head><title>x</title>", "<body>"),
        ("<head><meta charset=utf-8><title>x <b> y</title><script>'<body>'</script><!-- <p> --><link rel=a>", ""),
        ("<HEAD lang=en><title>x", "<body class=a>"),
        ("<head><title>x", ""),
        ("<head><title>x</title></head>", "<body>"),
        ("<head><style>p{}</style>", "<header></header>"),
    ],
)
def test_a_head_without_end_ends_where_the_body_begins(head, rest):
    page = f"<html>{head}{rest}<article><p>Main text</p><p>more</article>"
    assert [(path[-1], text) for path, text, _ in html_extract.blocks(page)][:2] == [("p", "Main text"), ("p", "more")]
    assert [t for _, t, _ in html_extract.blocks("<head><title>x</title>Plain text")] == ["Plain text"]
    assert html_extract.blocks("<head><title>x") == [] and html_extract.blocks("<head>" + "<title>" * 50_000) == []


def plain_scores(model, x):
    """One page at a time, one block at a time, in double precision: the recurrence as written down."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    h, sides = model.h, {}
    squash = lambda z: 1 / (1 + np.exp(-z))
    for d in "fb":
        hid, cell, out = np.zeros(h), np.zeros(h), [None] * len(x)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = x[t].astype(np.float64) @ w["x" + d] + w["c" + d] + hid @ w["h" + d]
            cell = squash(z[h : 2 * h]) * cell + squash(z[:h]) * np.tanh(z[3 * h :])
            hid = squash(z[2 * h : 3 * h]) * np.tanh(cell)
            out[t] = hid
        sides[d] = out
    return [float(squash(np.concatenate([f, b]) @ w["o"] + w["q"][0])) for f, b in zip(sides["f"], sides["b"])]


def test_the_query_equals_a_plain_page_at_a_time_labeller(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_extract.fit(html_extract.training_pages(pages))
    got = {r["page_id"]: r for r in html_extract.op10_html_extraction(spark, sf).collect()}
    rows, vectors, sure = pages.collect(), html_extract.Vectors(), 0
    assert len(got) == len(rows)
    for r in rows:
        found = html_extract.blocks(r["html"])
        p = plain_scores(model, vectors.page(found))
        assert got[r["page_id"]]["n_blocks"] == len(found)
        if all(abs(v - 0.5) > 1e-4 for v in p):
            sure += 1
            main = [t for (_, t, _), v in zip(found, p) if v > 0.5]
            assert (got[r["page_id"]]["n_main"], got[r["page_id"]]["text"]) == (len(main), "\n".join(main))
    assert sure >= 0.95 * len(rows)


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>x</title><meta charset=utf-8><body><p>hello</p>", ["hello"]),
        ("<p class=it's>text it's</p>" * 3001, ["text it's"] * 3001),
        ('<p class="a>lost</p><p>kept</p>', ["lost", "kept"]),
        ("<p title='a>b'>c</p><p x=\"1\" y = '2>'>d", ["c", "d"]),
        ("<template>a<p>b", ["a", "b"]),
        ("<noscript><p>no</p></noscript><p>yes", ["yes"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<script>if (a<b) '</p>'</script><p>x", ["x"]),
    ],
)
def test_nothing_is_lost_to_a_stray_quote_or_tag(page, texts):
    assert [t for _, t, _ in html_extract.blocks(page)] == texts


@pytest.mark.parametrize("page", ['<p class="a>text' * 60_000, "<a href='x" * 90_000, "<div>" * 200_000 + "x", "<div>" * 50_000 + "</foo>" * 50_000, "<head><title>" * 50_000, "<template>a" * 50_000, "<" * 500_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 30


def test_a_very_long_page_and_extra_columns(spark):
    long = "<nav>menu</nav>" + "".join(f"<p>Sentence {i}, with words. And more of them.</p>" for i in range(30_000))
    rows = [(1, "u", long), (2, "u", "<article><p>Sentence one, with words.</p></article>"), (2, "u", "<article><p>Sentence one, with words.</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as i", "'x' as page", "'x' as h", "'x' as x", "1 as n_blocks", "'x' as text", "'x' as `a.b`")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[1]["n_blocks"] == 30_001 and got[1]["text"].count("\n") == got[1]["n_main"] - 1 and html_extract.extract(df).columns == ["page_id", "n_blocks", "n_main", "text"]


def test_training_takes_rows_not_ids(spark):
    df = spark.createDataFrame([(1, f"<article><p>{i}</article>") for i in range(300)] + [(2, "<main><p>x</main>")] * 50, "page_id bigint, html string")
    assert len(html_extract.training_pages(df, limit=40)) == 40 and len(html_extract.training_pages(df.where("page_id = 2"))) == 1


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>only</p>"), (None, "u", "<article><p>x</article>"), (3, "u", "<p>only</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_blocks"], r["text"]) for r in html_extract.extract(df).collect() if r["page_id"] != 1)
    assert got == [(0, 1, "x"), (2, 0, ""), (3, 1, "only"), (3, 1, "only")]
    assert [r["text"] for r in html_extract.extract(df.where("page_id = 1")).collect()] == [None]
    assert html_extract.extract(df.limit(0)).count() == 0


def odd_documents(spark):
    """Nulls everywhere, ties, repeated rows, a long text, and extra columns with names the operators use inside."""
    rng = random.Random(9)
    long = prose(rng, 150_000)
    texts = [prose(rng, 80), None, "", "same text here", "same text here", long, 'token = "q7Zx9LmN2vB4kT8s"', "漢字", "?", prose(rng, 80)]
    df = frame(spark, texts, [1, 2, 3, 4, 4, 5, 6, None, None, 1])
    df = df.withColumn("lang", F.when(F.col("doc_id") == 2, None).otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") == 6, None).otherwise(F.col("n_chars")))
    for name in ("sig", "node", "Row_Key", "nth", "redacted", "h", "g", "size", "part", "key", "text_key", "bin", "item_id", "a.b"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def test_every_operator_takes_odd_documents(spark):
    df = odd_documents(spark)
    bench = spark.createDataFrame([(1, None), (None, "alpha beta"), (2, "")], "item_id bigint, text string")
    n = df.count()
    assert packing.pack(df).select("doc_id").distinct().count() == 7
    assert decontaminate.contained_items(df, bench).count() == 0
    assert suffix_dedup.repeated_passages(df).count() == 0
    assert df.select(token_count.token_count(spark).alias("t")).where("t is null").count() == 1
    assert df.select(language_id.identify(language_id.train(df)).alias("r")).count() == n
    assert {r["doc_id"] for r in near_dedup.near_duplicate_groups(df).collect()} == {4}
    assert df.select(F.explode(secret_scan.findings())).count() == 1
    assert sharding.assign_shards(df).count() == n


def test_every_stage_takes_odd_documents(spark, sf):
    df = odd_documents(spark)
    for docs in (df, df.limit(0), df.drop("a.b")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "piece", "start", "size", "bin"]
    assert corpus_pipeline.STAGES[1][1](spark, df, sf).count() == df.count() - 1
    assert corpus_pipeline.STAGES[3][1](spark, df, sf).where("text like '%[secret]%'").count() == 1


def test_pipeline_against_brute_force(spark, sf):
    """Stage by stage on the real documents: what each should drop is worked out without its operator's search."""
    import itertools

    import pyarrow as pa

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t)}
    ids = sorted(kept)
    sigs = np.stack([np.frombuffer(s, dtype="<u2") for s in near_dedup.signatures(pa.array([kept[i].lower() for i in ids])).to_pylist()])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if np.count_nonzero(sigs[a] != sigs[b]) <= near_dedup.RADIUS:
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    words = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")

    def grams(t):
        w = words.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(q and len(q & grams(t)) >= 0.5 * len(q) for q in items)}
    masked = {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', rf"\1{secret_scan.MASK}\"", t) for i, t in kept.items()}
    pieces = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
    sizes = {i: len(pieces.findall(t)) for i, t in masked.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
    assert got == sizes
    flat = [(i, min(packing.CAPACITY, s - p)) for i, s in sorted(sizes.items()) for p in range(0, max(1, s), packing.CAPACITY)]
    bins = packing.sum_of_squares(np.array([s for _, s in flat]), packing.CAPACITY)
    assert [(r["doc_id"], r["bin"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"]))] == [(i, int(b)) for (i, _), b in zip(flat, bins)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0
