"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased, every run of non-letters becomes one space, and a space is set at both ends. Its 1-, 2- and
3-grams (without the lone space) are ranked by count, then length, then code point; the first ``RANKS`` make its
profile. A language's profile is made alike from labelled documents: ``keep_identified`` counts every one; the query, whose
SQL says so, only a bounded sample of at most ``SAMPLE_PER_LANGUAGE`` a language, those of smallest md5 of the id. The distance of a text
to a language is the sum, over the text's n-grams, of the difference of the two ranks, ``RANKS`` where the language hasn't the n-gram.
The nearest language wins (ties: the first by name), unless the mean over the text's n-grams exceeds ``REJECT``.
That alone, the SQL's definition, passes almost any text in Latin letters, so ``keep_identified`` takes the limit from all labelled
documents, by number of n-grams: each half of them is measured, whole and cut short, against profiles of the other half. The
limit lies a share ``BETWEEN`` of the way from the 99th percentile of the nearest language's mean distance to the median of the second
nearest's, which is how far a language without labels is. Under ``BANDS[0]`` n-grams the two overlap, and ``REJECT`` holds; so
it does where fewer than ``MEASURED`` texts say otherwise.

Scale: the query judges in one scan of the texts, after one of the sample; ``keep_identified`` counts, measures and judges in three. Vectorised
over code points, no shuffle of texts: counts of n-grams, summed over texts in the worker, and of distances are shuffled; what is broadcast
is RANKS rows a language and half. A worker holds about a megabyte of text at a time (or one document, if longer) and ``_HELD`` counts.

Defined edge cases: null, empty and letter-free texts, and all texts when nothing is labelled, are rejected
(language null, distance null, 0 n-grams); rows without label aren't trained on, nor, in the query, those
without id; repeated rows are judged alike; an empty table gives no rows; long texts are read whole; ties in rank go by length and code point, ties in distance to
the first language by name; letters of every script have codes of their own; only id, label and text are read, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import cut

RANKS, SAMPLE_PER_LANGUAGE, REJECT = 300, 1000, 0.80
BANDS, CUTS, MEASURED, BETWEEN = (101, 151, 201, RANKS), (50, 80, 120, 160, None), 100, 0.6
BROADCAST_ROWS = 500_000
_SLICE, _DOCS, _HELD = 1 << 19, 4096, 1 << 20
_BITS = 18  # letters lie below U+3FFFF; an n-gram's code is its length and three of them
_MASK = np.uint64(0xFFFFFFFF)


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Code of each code point after lower-casing: 0 for what isn't a letter, ordered like the code points."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range((1 << _BITS) - 1):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0]) + 1
    return table


def _grams(sym: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Code of each n-gram of symbols of so many bits: its length, then its symbols."""
    m = max(0, len(sym) - n + 1)
    code = np.full(m, n << 3 * bits, dtype=np.uint64)
    for j in range(n):
        code |= sym[j : m + j].astype(np.uint64) << np.uint64((2 - j) * bits)
    return code


def _long(text: str) -> tuple[np.ndarray, ...]:
    """Codes and counts of one long text, a bounded piece of it at a time."""
    sym, last = [], np.uint32(1)
    for low in range(0, len(text) + 2, _SLICE):
        piece = f" {text} "[low : low + _SLICE] if low == 0 else (text + " ")[low - 1 : low - 1 + _SLICE]
        part = _symbols()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = part != 0
        keep[1:] |= part[:-1] != 0
        keep[0] |= last != 0 or low == 0
        last = part[-1]
        sym.append(part[keep])
    sym = np.concatenate(sym)
    codes, counts = [], []
    for n in (1, 2, 3):
        for low in range(0, len(sym) - n + 1, _SLICE):
            code = _grams(sym[low : low + _SLICE + n - 1], n, _BITS)
            if n == 1:
                code = code[sym[low : low + _SLICE] != 0]
            u, c = np.unique(code, return_counts=True)
            codes.append(u)
            counts.append(c)
    u, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def _distinct(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(owner << 32 | short code, ascending; its count; the n-gram codes of short codes, in the same order) of the texts of each owner."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    sym = _symbols()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    keep[np.cumsum(sizes) - sizes] = True
    sym, doc = sym[keep], doc[keep]
    alphabet = np.flatnonzero(np.bincount(sym, minlength=1)) if len(sym) else np.zeros(1, dtype=np.int64)
    few = len(alphabet) < 1 << 10  # then the letters of these texts get short codes, in the same order
    if few:
        alphabet = alphabet if alphabet[0] == 0 else np.append(0, alphabet)
        short = np.zeros(int(alphabet[-1]) + 1, dtype=np.uint32)
        short[alphabet] = np.arange(len(alphabet))
        sym = short[sym]
    codes, docs = [], []
    for n in (1, 2, 3):
        code = _grams(sym, n, 10 if few else _BITS)
        own = sym != 0 if n == 1 else doc[: len(code)] == doc[len(doc) - len(code) :]
        codes.append(code[own])
        docs.append(owner[doc[: len(code)][own]])
    codes = np.concatenate(codes)
    known = None
    if not few:
        known, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint64)
    key = np.sort(np.concatenate(docs) << np.uint64(32) | codes)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)

    def spell(code: np.ndarray) -> np.ndarray:
        if not few:
            return known[code.astype(np.int64)]
        spelled = code >> np.uint64(30) << np.uint64(3 * _BITS)
        for j in range(3):
            spelled |= alphabet[(code >> np.uint64(10 * j) & np.uint64(1023)).astype(np.int64)].astype(np.uint64) << np.uint64(_BITS * j)
        return spelled

    return key[head], np.diff(np.append(head, len(key))).astype(np.uint64), spell


def ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram code, count, rank from 0) of every distinct n-gram, by document and rank."""
    if len(texts) == 1 and len(texts[0]) > _SLICE:
        code, count = _long(texts[0])
        order = np.lexsort((code, -count))
        return np.zeros(len(code), dtype=np.int64), code[order], count[order], np.arange(len(code))
    key, count, spell = _distinct(texts, np.arange(len(texts), dtype=np.uint64))
    top = np.uint64((1 << 20) - 1)  # a slice has fewer symbols than that
    packed = np.sort((key >> np.uint64(32)) << np.uint64(52) | (top - count) << np.uint64(32) | key & _MASK)
    of, code, count = (packed >> np.uint64(52)).astype(np.int64), spell(packed & _MASK), top - (packed >> np.uint64(32) & top)
    first = np.searchsorted(of, np.arange(len(texts)))
    return of, code, count.astype(np.int64), np.arange(len(of)) - first[of]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    row, size = 0, 0
    for i, t in enumerate(texts):
        if i > row and (size + len(t) > _SLICE or i - row >= _DOCS):
            yield row, i
            row, size = i, 0
        size += len(t)
    if row < len(texts):
        yield row, len(texts)


def distances(texts: list[str], codes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: [languages] out-of-place distances, and the number of n-grams they are made of."""
    total = np.zeros((len(texts), ranks.shape[1]), dtype=np.int64)
    used = np.zeros(len(texts), dtype=np.int64)
    for lo, hi in _runs(texts):
        of, code, _, rank = ranked(texts[lo:hi])
        take = rank < RANKS
        of, code, rank = of[take], code[take], rank[take]
        used[lo:hi] = np.bincount(of, minlength=hi - lo)
        pos = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = codes[pos] == code
        for j in range(ranks.shape[1]):
            theirs = ranks[pos, j]
            out = np.where(known & (theirs < RANKS), np.abs(rank - theirs), RANKS)
            total[lo:hi, j] = np.bincount(of, weights=out, minlength=hi - lo).astype(np.int64)
    return total, used


def tally(texts: list[str], owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, n-gram codes, counts) over the texts of each owner; owners are small numbers."""
    if len(texts) == 1 and len(texts[0]) > _SLICE:
        yield int(owner[0]), *_long(texts[0])
        return
    key, count, spell = _distinct(texts, owner)
    edges = np.searchsorted(key, np.arange(int(owner.max()) + 2, dtype=np.uint64) << np.uint64(32))
    for g, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        yield g, spell(key[lo:hi] & _MASK), count[lo:hi].astype(np.int64)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, half, text) -> (lang, half, code, n), summed over as many texts as _HELD counts allow."""
    held: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merge() -> int:
        for name, parts in held.items():
            code, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[name] = [(code, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64))]
        return sum(len(parts[0][0]) for parts in held.values())

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, half), [(code, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(code)), pa.repeat(half, len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "half", "code", "n"])

    for b in it:
        langs, halves, texts = (c.to_pylist() for c in b.columns)
        for lo, hi in _runs(texts):
            place: dict[tuple[str, str], int] = {}
            owner = np.array([place.setdefault(x, len(place)) for x in zip(langs[lo:hi], halves[lo:hi], strict=True)], dtype=np.uint64)
            names = list(place)
            for g, code, n in tally(texts[lo:hi], owner):
                held.setdefault(names[g], []).append((code, n))
                size += len(code)
            if size > _HELD:
                size = merge()
                if size > _HELD // 2:
                    yield from rows()
                    held.clear()
                    size = 0
    merge()
    yield from rows()


def _half(key: Column) -> Column:
    return F.when(F.substring(F.md5(key), 32, 1) < "8", "0").otherwise("1")


def _labelled(docs: DataFrame) -> DataFrame:
    """(lang, half, text): every labelled row, halved by id, or by text without one."""
    return docs.where("lang is not null and text is not null").select("lang", _half(F.coalesce(F.col("doc_id").cast("string"), "text")).alias("half"), "text")


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, half, text): a bounded sample of the labelled rows, halved by id."""
    chosen = docs.where("doc_id is not null and lang is not null and text is not null").select("lang", "doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = cut(chosen.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "doc_id", _half(F.col("doc_id").cast("string")).alias("half")).distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids  # with very many languages, a shuffled join
    return docs.select("doc_id", "lang", "text").join(few, ["doc_id", "lang"]).select("lang", "half", "text")


def _profiles(rows: DataFrame) -> dict[str, dict[str, dict[int, int]]]:
    """"0", "1" for the halves and "" for both -> language -> n-gram code -> rank, from rows (lang, half, text)."""
    counts = rows.mapInArrow(_count, "lang string, half string, code bigint, n bigint").groupBy("lang", "code")
    sums = counts.agg(*(F.sum(F.when(F.col("half") == x, F.col("n")).otherwise(0)).alias(f"n{x}") for x in "01"))
    parts = F.array(*(F.struct(F.lit(x).alias("half"), n.alias("n")) for x, n in (("0", F.col("n0")), ("1", F.col("n1")), ("", F.col("n0") + F.col("n1")))))
    nth = F.row_number().over(Window.partitionBy("half", "lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, dict[str, dict[int, int]]] = {"0": {}, "1": {}, "": {}}
    found = sums.select("lang", "code", F.inline(parts)).where("n > 0").withColumn("rank", nth).where(F.col("rank") <= RANKS)
    for r in found.select("half", "lang", "code", "rank").collect():
        profiles[r["half"]].setdefault(r["lang"], {})[r["code"]] = r["rank"] - 1
    return profiles


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, dict[int, int]]:
    """Language -> n-gram code -> rank, from a bounded sample of the labelled rows."""
    return _profiles(_sample(docs, per_language))[""]


def _table(profiles: dict[str, dict[int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-gram codes, [codes, languages] ranks)."""
    langs = sorted(profiles)
    codes = np.array(sorted({c for p in profiles.values() for c in p}), dtype=np.uint64)
    return langs, codes, np.array([[profiles[x].get(int(c), RANKS) for x in langs] for c in codes], dtype=np.int64).reshape(len(codes), len(langs))


def limits(docs: DataFrame) -> np.ndarray:
    """By number of n-grams: the mean distance beyond which a text is in none of the labelled languages; from every labelled row."""
    rows = _labelled(docs)
    return _limits(rows, _profiles(rows))


def _limits(labelled: DataFrame, profiles: dict[str, dict[str, dict[int, int]]]) -> np.ndarray:
    limit = np.full(RANKS + 1, REJECT)
    tables = {own: _table(profiles[other]) for own, other in ("01", "10")}

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for own, (langs, codes, ranks) in tables.items():
                texts = [t[:n] for lang, half, t in rows if half == own and lang in langs for n in CUTS]
                if len(langs) < 2 or not texts:
                    continue
                total, used = distances(texts, codes, ranks)
                some = used >= BANDS[0]
                near = np.sort(total[some], axis=1)[:, :2]
                for second in (0, 1):
                    key, n = np.unique(used[some] << 32 | near[:, second], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([second] * len(key), pa.int64()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["second", "used", "total", "n"])

    seen = labelled.mapInArrow(measure, "second bigint, used bigint, total bigint, n bigint").groupBy("second", "used", "total").agg(F.sum("n").alias("n"))
    band = sum((F.col("used") >= low).cast("int") for low in BANDS[1:])
    seen = seen.select("second", band.alias("band"), (F.col("total") / (RANKS * F.col("used"))).alias("mean"), "n")
    group = Window.partitionBy("second", "band")
    seen = seen.withColumn("upto", F.sum("n").over(group.orderBy("mean"))).withColumn("all", F.sum("n").over(group))
    shares = {"least": 0.01, "other": 0.5, "own": 0.99}  # exact percentiles, from counts of equal distances
    at = {(x, end): f(p * (F.col("all") - 1)) for x, p in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = seen.groupBy("second", "band").agg(F.max("all").alias("all"), *(F.min(F.when(F.col("upto") > place, F.col("mean"))).alias(f"{x}_{end}") for (x, end), place in at.items()))
    both: tuple[dict[int, Row], dict[int, Row]] = ({}, {})
    for r in found.collect():
        both[r["second"]][r["band"]] = r

    def share(r: Row, x: str) -> float:
        return r[f"{x}_low"] + (shares[x] * (r["all"] - 1)) % 1 * (r[f"{x}_high"] - r[f"{x}_low"])

    for k, nearest in both[0].items():
        own, least, other = share(nearest, "own"), share(both[1][k], "least"), share(both[1][k], "other")
        if nearest["all"] >= MEASURED and own < least:
            limit[BANDS[k] : [*BANDS, RANKS + 1][k + 1]] = min(REJECT, own + BETWEEN * (other - own))
    return limit


def identify(profiles: dict[str, dict[int, int]], text_col: str = "text", reject: float | np.ndarray = REJECT) -> Column:
    """struct<language, distance, ngrams> of a text column; language is null where it is rejected. reject: one, or by number of n-grams."""
    langs, codes, ranks = _table(profiles)
    most = np.broadcast_to(np.asarray(reject, dtype=np.float64), RANKS + 1)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            texts = [t or "" for t in col.to_pylist()]
            if not langs:
                total, used = np.zeros((len(texts), 1), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            else:
                total, used = distances(texts, codes, ranks)
            best = total.argmin(axis=1)
            least = total[np.arange(len(texts)), best]
            ok = (used > 0) & (least <= most[used] * RANKS * used)
            names = [langs[j] if o else None for j, o in zip(best, ok, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(names, type=pa.string()), pa.array(least, mask=used == 0), pa.array(used)], names=["language", "distance", "ngrams"]
            )

    return F.arrow_udf(run, "struct<language:string,distance:bigint,ngrams:bigint>").asNondeterministic()(F.col(text_col))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", identify(train(docs)).alias("r")).select("doc_id", "lang", "r.*")


def keep_identified(docs: DataFrame, reject: float | None = None) -> DataFrame:
    """``docs`` without the rows whose language is rejected; the profiles and, unless given, the limits come from all labelled rows of ``docs``."""
    rows = _labelled(docs)
    profiles = _profiles(rows)
    return docs.where(identify(profiles[""], reject=_limits(rows, profiles) if reject is None else reject)["language"].isNotNull())


SQL = f"""
WITH norm AS (
  SELECT doc_id, lang, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS t
  FROM (SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) AS t FROM documents)),
places AS (SELECT doc_id, lang, unnest(c) AS a, unnest(c[2:]) AS b, unnest(c[3:]) AS d FROM (SELECT doc_id, lang, string_split(t, '') AS c FROM norm WHERE t <> '')),
grams AS (
  SELECT doc_id, lang, g, count(*) AS n
  FROM (SELECT doc_id, lang, a AS g FROM places UNION ALL SELECT doc_id, lang, a || b FROM places UNION ALL SELECT doc_id, lang, a || b || d FROM places)
  WHERE g IS NOT NULL AND g <> ' ' GROUP BY ALL),
ranked AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM grams),
sample AS (
  SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= {SAMPLE_PER_LANGUAGE}),
profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r
  FROM (SELECT lang, g, sum(n) AS n FROM grams JOIN sample USING (doc_id) GROUP BY lang, g)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) <= {RANKS}),
own AS (SELECT * FROM ranked WHERE r < {RANKS}),
dist AS (
  SELECT o.doc_id, l.lang AS language, sum(coalesce(abs(o.r - p.r), {RANKS}))::BIGINT AS distance, count(*) AS ngrams
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g
  GROUP BY o.doc_id, l.lang),
best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, language) = 1)
SELECT d.doc_id, d.lang, CASE WHEN b.distance <= {REJECT} * {RANKS} * b.ngrams THEN b.language END AS language, b.distance, coalesce(b.ngrams, 0) AS ngrams
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
"""
