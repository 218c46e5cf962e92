"""Word kernel, near duplicates, repeated passages."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kinetrace.llm import near_dedup, suffix_dedup, textkernel

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(9999)}" for w in text.split())


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_words_and_shingles_match_a_regex():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é.1 -ñ\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "x" * 70_000, "".join(rng.choice("ab é.1 -ñ\n") for _ in range(2_300_000))]
    known = {}
    for w in textkernel.words(pa.array(texts)):
        for d in range(w.n_docs):
            want = [m.encode() for m in WORD.findall(texts[w.first_row + d] or "")]
            a, b = w.doc_at[d], w.doc_at[d + 1]
            assert want == [bytes(w.data[x:y]) for x, y in zip(w.begin[a:b], w.end[a:b])]
            assert all(known.setdefault(g, int(c)) == int(c) for g, c in zip(want, w.code[a:b]))
        x, at = textkernel.shingles(w, 3)
        for d in range(w.n_docs):
            n = len(WORD.findall(texts[w.first_row + d] or ""))
            assert at[d + 1] - at[d] == (max(1, n - 2) if n else 0)
    assert len(set(known.values())) == len(known)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    bases = [prose(rng, rng.randrange(30, 300)) for _ in range(60)]
    texts = list(bases)
    for b in bases[:20]:
        texts += [b, edited(rng, b, 0.03), edited(rng, b, 0.05)]
    for _ in range(40):
        texts.append(edited(rng, bases[0], 0.02))
    return texts


def test_all_pairs_within_the_radius_are_linked(spark, copies):
    """Brute force over signatures gives the same components."""
    sigs = [np.frombuffer(s, dtype="<u2") for s in near_dedup.signatures(pa.array(copies)).to_pylist()]
    root = list(range(len(sigs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sigs)), 2):
        if np.count_nonzero(sigs[i] != sigs[j]) <= near_dedup.RADIUS:
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {(i, find(i)) for i in range(len(sigs)) if sum(find(k) == find(i) for k in range(len(sigs))) > 1}
    rows = near_dedup.near_duplicate_groups(frame(spark, copies)).collect()
    got = {(r["doc_id"], r["group_id"]) for r in rows}
    assert got == want and len(rows) == len(want)
    links = [sum(np.count_nonzero(x != y) <= near_dedup.RADIUS for y in sigs) - 1 for x in sigs]
    assert {r["doc_id"]: r["links"] for r in rows} == {i: n for i, n in enumerate(links) if n}
    planted = set(range(20)) | set(range(60, 160))
    assert len({i for i, _ in got} & planted) >= 0.97 * len(planted)
    assert not {i for i, _ in got} & set(range(20, 60))  # clean documents are left alone


def test_chunk_keys_miss_no_pair_at_the_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, near_dedup.HASHES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.HASHES, near_dedup.RADIUS, replace=False)] ^= 1
    ka, kb = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka, kb))


@pytest.mark.parametrize("block", [5, 1000])
def test_links_are_those_of_all_pairs(spark, block):
    """Many near signatures under many shared keys, in one block or dealt into several: counts and components of brute force."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (3, near_dedup.HASHES), dtype=np.uint16)
    sigs = base[rng.integers(0, 3, 60)]
    for row in sigs:
        at = rng.choice(near_dedup.HASHES, int(rng.integers(0, 24)), replace=False)
        row[at] = rng.integers(0, 1 << 16, len(at))
    sigs = np.unique(sigs, axis=0)
    copies = rng.integers(1, 4, len(sigs))
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes()), int(c)) for i, (s, c) in enumerate(zip(sigs, copies))], "node bigint, sig binary, copies bigint")
    found = near_dedup.near_links(nodes, block).collect()
    near = (sigs[:, None] != sigs[None]).sum(2) <= near_dedup.RADIUS
    np.fill_diagonal(near, False)
    got = np.zeros(len(sigs), dtype=int)
    root = list(range(len(sigs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        if r["b"] is None:
            got[r["a"]] += r["links"]
        else:
            assert near[r["a"], r["b"]]
            root[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
    assert got.tolist() == (near * copies[None]).sum(1).tolist() and near.sum() > 200
    assert all(find(i) == find(j) for i, j in zip(*np.nonzero(near)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (95, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}


def test_deduplicate_keeps_one_of_each_group(spark, copies):
    kept = near_dedup.deduplicate(frame(spark, copies))
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= set(range(60)) and len(ids) <= 63 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_edges(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", None, "", "?!", "a b c d e f", "one", "one"], [3, 3, 4, 5, None, None, 8, 9])
    assert sorted((r["doc_id"] or -1, r["group_id"]) for r in near_dedup.near_duplicate_groups(df).collect()) == [(-1, 3), (3, 3), (3, 3), (8, 8), (9, 8)]
    assert sorted(r["doc_id"] or -1 for r in near_dedup.deduplicate(df).collect()) == [-1, 3, 4, 5, 8]
    extra = df.selectExpr("*", "1 as k1", "2 as K2", "3 as node", "4 as `a.b`")
    assert near_dedup.deduplicate(extra).columns == extra.columns and near_dedup.deduplicate(extra).count() == 5
    assert near_dedup.deduplicate(df.limit(0)).count() == 0 and near_dedup.near_duplicate_groups(df.limit(0)).count() == 0


def brute_spans(texts):
    n, where = suffix_dedup.LENGTH, {}
    words = [WORD.findall((t or "").lower()) for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    starts = sorted(p for ps in where.values() if len(ps) > 1 for p in ps)
    out = []
    for d, i in starts:
        if out and out[-1][0] == d and i <= out[-1][2]:
            out[-1] = (d, out[-1][1], i + n)
        else:
            out.append((d, i, i + n))
    return out


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (50, 51, 53, 60, 90, 200, 49, 40)]
    texts = [prose(rng, rng.randrange(0, 60)) + " " + rng.choice(shared) + " " + prose(rng, rng.randrange(0, 60)) for _ in range(120)]
    texts += [prose(rng, 400) for _ in range(10)]
    texts += ["same " * 300, "same " * 40, "a b " * 200, "a b " * 130 + prose(rng, 30)]
    texts += [texts[0], texts[0], None, "", shared[1], shared[1] + " tail", prose(rng, 30) + " " + shared[5] + " " + shared[5]]
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, texts)).collect())
    assert got == brute_spans(texts)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_passages_of_a_small_vocabulary(spark, seed):
    """Few words and many copies with edits: long overlapping repeats."""
    rng = random.Random(seed)
    base = prose(rng, 300, 6)
    texts = [" ".join(w if rng.random() > 0.01 else "z" for w in base.split()[rng.randrange(60) : rng.randrange(150, 300)]) for _ in range(40)]
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, texts)).collect())
    assert got == brute_spans(texts)


@pytest.mark.parametrize("vocabulary", [4, 30, 4000])
def test_corpus_order_equals_a_plain_suffix_sort(vocabulary):
    """Phrases, triggers and parse suffixes of random texts combine into the order of the words themselves."""
    rng = random.Random(vocabulary)
    base = prose(rng, 400, vocabulary)
    texts = [" ".join(w if rng.random() > 0.02 else f"w{rng.randrange(vocabulary)}" for w in base.split()[rng.randrange(100) : rng.randrange(200, 400)]) for _ in range(25)]
    array, wanted = pa.array(texts), []
    for w in textkernel.words(array):
        doc, at, _, _, _ = suffix_dedup.anchors(w)
        wanted += [[int(p - w.doc_at[i]) for i2, p in zip(doc, at) if i2 == i] for i in range(w.n_docs)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), array, pa.array(wanted, type=pa.list_(pa.int32()))], names=["text_key", "text", "ats"])
    t = pa.Table.from_batches(list(suffix_dedup._fragments(iter([batch])))).sort_by([("key", "ascending"), ("right", "ascending")]).combine_chunks()
    left, serves = suffix_dedup._table(t.column("left").chunk(0), suffix_dedup.REACH)
    trigger, _ = suffix_dedup._table(t.column("trigger").chunk(0), suffix_dedup.WINDOW)
    key, text, at = (t.column(c).to_numpy() for c in ("key", "text_key", "at"))
    bucket = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    fragment, d, suffix = suffix_dedup.corpus_order(bucket, left, serves, trigger)
    codes = {}
    for w in textkernel.words(array):
        c = (w.code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        codes |= {w.first_row + i: c[w.doc_at[i] : w.doc_at[i + 1]].tolist() for i in range(w.n_docs)}
    spelled = [codes[text[f]][at[f] - x : at[f] + suffix_dedup.LENGTH] for f, x in zip(fragment, d)]
    assert len(fragment) == (serves + 1).sum() > 1000
    assert all(bucket[f] < bucket[g] or bucket[f] == bucket[g] and a <= b for f, g, a, b in zip(fragment, fragment[1:], spelled, spelled[1:]))
    heads = [(bucket[f], tuple(s[: x + suffix_dedup.WINDOW])) for f, x, s in zip(fragment, d, spelled)]
    assert all((a == b) == (x == y) for a, b, x, y in zip(heads, heads[1:], suffix, suffix[1:]))
    first, phrase = suffix_dedup.dictionary(bucket, left, serves)
    assert len(first) == len({(bucket[i], left[i].tobytes(), serves[i]) for i in range(len(key))}) and all(bucket[first[p]] == bucket[i] and (left[first[p]] == left[i]).all() for i, p in enumerate(phrase))


def test_repeated_passages_edges(spark):
    df = frame(spark, [None, "", "short", "word " * 49, "word " * 50, "word " * 50], [1, 2, 3, 4, None, None])
    assert sorted(tuple(r)[1:] for r in suffix_dedup.repeated_passages(df).collect()) == [(0, 50), (0, 50)]
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0
