"""Repeated passages by a suffix array over a prefix-free parse.

A passage of ``LENGTH`` words that occurs twice in the corpus (in two texts, or twice in one) is repeated; the result is the union of
all repeated passages of each document. The parse: a rolling hash over ``WINDOW`` words triggers wherever it is
0 modulo ``MODULUS``; a phrase runs from one trigger to the next. Triggers depend on the words alone, so equal passages are
cut alike, and of two phrase suffixes none is a proper prefix of the other beyond the trigger. Every word position is
thus a suffix of a phrase (the words left of the next trigger) followed by the parse from that trigger on, and the corpus
order of positions is the order of (phrase suffix, rank of the parse suffix).

Both arrays are built only as far as the question needs, and in buckets that no equal pair can straddle:

1. The parse suffixes, one a trigger, are filed under their first ``LENGTH - REACH`` words, all of which belong to every
   passage that begins up to REACH words before. Most of the corpus occurs once and ends here.
2. The others meet their texts again and become fragments: left of the trigger the words of the phrase (the dictionary's
   side), right of it the words up to LENGTH.
3. A bucket's different phrases are its dictionary, each held once. The dictionary's suffix array comes from prefix doubling over
   the phrases with their trigger: equal suffixes share a rank. Sorting the fragments by their words on the right gives the
   parse's suffix array and, between neighbours, its LCP array (the order of phrase ranks is that of their words, since none is a proper prefix of another).
4. Both combine into corpus order: a position is (rank of its phrase suffix, rank of the parse suffix). It is repeated
   if a neighbour in that order has the same phrase suffix and no smaller LCP in between than LENGTH asks for.

The dictionary is a bucket's, not the corpus's: words that occur once are gone before any phrase is stored or sorted.

Positions farther than REACH from the next trigger (about 1 in 60) are triggers of their own. All of this is exact but for
collisions of 64-bit hashes.

Scale: three shuffles, of 20 bytes a phrase, of the texts that have candidates, and of the fragments; sorting is Spark's and
spills. Copies of a whole text count once from the start, and of fragments that are alike throughout a bucket keeps two: the
others are repeated as they stand. A worker holds the different fragments of one bucket (about 500 bytes each).

Defined edge cases: null and short texts (under LENGTH words) have no passages; repeated rows are copies; null ids are kept;
texts that are one word over and over are handled as they are; long texts are read whole, about a megabyte at a time; equal passages tie in corpus
order and go by text; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import Words, mix64, words

LENGTH, REACH, WINDOW, MODULUS = 50, 30, 4, 8
SURE = LENGTH - REACH
_STEP = 0xD6E8FEB86659FD93
_TAG = np.uint64(0x5851F42D4C957F2D)


def _grams(code: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k words in a row (the last k - 1 positions are left out)."""
    m = len(code) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = np.ones(len(code) + 1, dtype=np.uint64)
    np.cumprod(np.full(len(code), _STEP, dtype=np.uint64), out=power[1:])
    inverse = pow(_STEP, -1, 1 << 64)
    back = np.ones(len(code) + 1, dtype=np.uint64)
    np.cumprod(np.full(len(code), inverse, dtype=np.uint64), out=back[1:])
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * power[:-1], out=total[1:])
    return mix64((total[k:] - total[:-k]) * back[:m])


def anchors(w: Words) -> tuple[np.ndarray, ...]:
    """(document, word position in the slice, key, words left of it that it serves, least distance) of each parse suffix."""
    n = len(w.code)
    sizes = w.counts()
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH or not (sizes >= LENGTH).any():
        return none, none, none.astype(np.uint64), none, none
    doc = np.repeat(np.arange(w.n_docs), sizes)
    pos = np.arange(n)
    stop = w.doc_at[1:][doc]
    last_start = stop - LENGTH  # no passage of the document begins after it
    begin = w.doc_at[:-1][doc]
    hit = np.zeros(n, dtype=bool)
    g = _grams(w.code, WINDOW)
    hit[: len(g)] = g % np.uint64(MODULUS) == 0
    hit &= pos + WINDOW <= stop
    at = np.flatnonzero(hit)
    # the next trigger at or after each position, within its document
    nxt = np.append(at, n + REACH + 1)[np.searchsorted(at, pos)]
    far = np.where(nxt < stop, nxt - pos, REACH + 1) > REACH
    alone = np.flatnonzero(far & (pos <= last_start))
    before = np.maximum(np.concatenate([[-1], at[:-1]]), begin[at] - 1)
    serves = np.minimum(at - before - 1, REACH)
    least = np.maximum(0, at - last_start[at])
    use = (least <= serves) & (sizes[doc[at]] >= LENGTH)
    at, serves, least = at[use], serves[use], least[use]
    sure = _grams(w.code, SURE)
    everything = np.concatenate([at, alone])
    key = np.concatenate([sure[at], sure[alone] ^ _TAG])
    zero = np.zeros(len(alone), dtype=np.int64)
    return doc[everything], everything, key, np.concatenate([serves, zero]), np.concatenate([least, zero])


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids = b.column(0).to_numpy()
        for w in words(b.column(1)):
            doc, at, key, _, _ = anchors(w)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[w.first_row + doc]), pa.array((at - w.doc_at[doc]).astype(np.int32))], names=["key", "text_key", "at"])


def _windows(code: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated 4-byte codes of ``count`` words from each ``start`` on, in steps of 1 or -1, and byte offsets."""
    first = np.cumsum(count) - count
    within = np.arange(int(count.sum())) - np.repeat(first, count)
    return code[np.repeat(start, count) + step * within], np.append(first, count.sum()) * 4


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype(">u4"))])


def _fragments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids, wanted = b.column(0).to_numpy(), b.column(2)
        lens = np.diff(wanted.offsets.to_numpy())
        flat, first = wanted.flatten().to_numpy(), np.cumsum(lens) - lens
        for w in words(b.column(1)):
            doc, at, key, serves, least = anchors(w)
            rel = (at - w.doc_at[doc]).astype(np.int64)
            lo, hi = first[w.first_row], first[w.first_row + w.n_docs - 1] + lens[w.first_row + w.n_docs - 1]
            asked = np.repeat(np.arange(w.n_docs), lens[w.first_row : w.first_row + w.n_docs]) << 40 | flat[lo:hi]
            keep = np.isin(doc.astype(np.int64) << 40 | rel, asked)
            doc, at, key, serves, least, rel = doc[keep], at[keep], key[keep], serves[keep], least[keep], rel[keep]
            code = (w.code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            right = np.minimum(LENGTH, w.doc_at[doc + 1] - at) - SURE
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[w.first_row + doc]), pa.array(rel.astype(np.int32)), pa.array(least.astype(np.int32)), _binary(*_windows(code, at - 1, serves, -1)), _binary(*_windows(code, at, np.full(len(at), WINDOW), 1)), _binary(*_windows(code, at + SURE, right, 1))],
                names=["key", "text_key", "at", "least", "left", "trigger", "right"],
            )


def _offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def _table(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as a zero-padded matrix of words, and the number of words of each."""
    offs = _offsets(col)
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(raw[offs[0] : offs[-1]].tobytes(), dtype=">u4").astype(np.uint32)
    n = np.diff(offs) // 4
    out = np.zeros((len(col), width), dtype=np.uint32)
    out[np.arange(width)[None, :] < n[:, None]] = data
    return out, n


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) of n[0] + n[1] + ... places."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def dictionary(bucket: np.ndarray, left: np.ndarray, serves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a fragment of each different phrase of a bucket, phrase of each fragment)."""
    rows = np.ascontiguousarray(np.column_stack([bucket, serves, left]).astype(np.uint32))
    _, first, phrase = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return first, phrase.ravel()


def suffix_ranks(bucket: np.ndarray, left: np.ndarray, serves: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every suffix of every phrase, where each phrase's ranks begin): the dictionary's suffix array, inverted.

    A phrase is its words and its trigger; the rank at begin + d is that of its last d words and the trigger. Buckets come in order,
    and within one, suffixes by their words; equal ones share a rank. Prefix doubling: after k rounds 2^k words are compared.
    """
    size = serves + WINDOW
    phrase, at = _places(size)  # at: words to the end of the trigger, less one
    inside = at < WINDOW
    word = np.where(inside, trigger[phrase, WINDOW - 1 - np.minimum(at, WINDOW - 1)], left[phrase, np.maximum(at - WINDOW, 0)]) if len(phrase) else np.zeros(0, dtype=np.uint32)
    rank = np.unique(bucket[phrase].astype(np.uint64) << np.uint64(32) | word, return_inverse=True)[1].ravel() + 1
    step, place = 1, np.arange(len(at))
    while step < REACH + WINDOW:
        rest = np.where(at >= step, rank[np.maximum(place - step, 0)], 0)  # the suffix that begins after the first step words
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64), return_inverse=True)[1].ravel() + 1
        step *= 2
    return rank, np.cumsum(size) - size + WINDOW - 1


def corpus_order(bucket: np.ndarray, left: np.ndarray, serves: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, words left of its trigger, rank of the phrase suffix) of every position, in corpus order.

    Fragments come in the order of the parse's suffix array: by bucket, then by the words on the right.
    """
    first, phrase = dictionary(bucket, left, serves)
    rank, begin = suffix_ranks(bucket[first], left[first], serves[first], trigger[first])
    fragment, d = _places(serves + 1)
    suffix = rank[begin[phrase[fragment]] + d]
    order = np.lexsort((fragment, suffix))
    return fragment[order], d[order], suffix[order]


def repeated_starts(key: np.ndarray, left: np.ndarray, serves: np.ndarray, trigger: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """[fragments, REACH + 1] whether the passage that begins d words left of the trigger is repeated.

    Fragments come in suffix-array order: by key, then by the words on the right.
    """
    n = len(key)
    out = np.zeros((n, REACH + 1), dtype=bool)
    same = right[1:] == right[:-1]
    lcp = np.where(same.all(1), REACH, same.argmin(1))
    lcp[key[1:] != key[:-1]] = -1
    bucket = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    fragment, d, suffix = corpus_order(bucket, left, serves, trigger)
    # two positions with one phrase suffix are equal if no LCP in between is smaller: if they are in one interval
    interval = np.zeros((REACH + 1, n), dtype=np.int32)
    for x in range(REACH + 1):
        np.cumsum(lcp < REACH - x, out=interval[x, 1:])
    where = interval[d, fragment]
    twin = (suffix[1:] == suffix[:-1]) & (where[1:] == where[:-1])
    out[fragment[1:][twin], d[1:][twin]] = True
    out[fragment[:-1][twin], d[:-1][twin]] = True
    return out & (least[:, None] <= np.arange(REACH + 1)[None, :])


def _repeats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        left, serves = _table(t.column("left").chunk(0), REACH)
        right, _ = _table(t.column("right").chunk(0), REACH)
        trigger, _ = _table(t.column("trigger").chunk(0), WINDOW)
        key, at = t.column("key").to_numpy(), t.column("at").to_numpy().astype(np.int64)
        yes = repeated_starts(key, left, serves, trigger, right, t.column("least").to_numpy())
        # runs of neighbouring starts: distance d runs leftwards, so a run is first = at - high, last = at - low
        edge = np.diff(np.pad(yes.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        ids = t.column("text_key").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((at[row] - high).astype(np.int32)), pa.array((at[row] - low).astype(np.int32))], names=["text_key", "first", "last"])

    held: list[pa.RecordBatch] = []
    for b in it:
        copy = b.column("nth").to_numpy() > 2
        if copy.any():  # like two others throughout: all of its starts are repeated, and it proves nothing new
            c = b.filter(pa.array(copy))
            at, words_left = c.column("at").to_numpy(), np.diff(_offsets(c.column("left"))) // 4
            low = c.column("least").to_numpy()
            yield pa.RecordBatch.from_arrays([c.column("text_key"), pa.array((at - words_left).astype(np.int32)), pa.array((at - low).astype(np.int32))], names=["text_key", "first", "last"])
            b = b.filter(pa.array(~copy))
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        split = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if split or (held and held[-1].column("key")[held[-1].num_rows - 1].as_py() != key[0]):
            yield solve(pa.Table.from_batches([*held, b.slice(0, split)]))
            held = []
        held.append(b.slice(split))
    if held:
        yield solve(pa.Table.from_batches(held))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word): the repeated passages of every document, joined where they touch or overlap."""
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.lower(text_col).alias("text")).where("text is not null")
    parsed = texts.mapInArrow(_parse, "key bigint, text_key bigint, at int")
    bucket = Window.partitionBy("key")
    place = F.struct("text_key", "at")
    twice = parsed.withColumns({"lo": F.min(place).over(bucket), "hi": F.max(place).over(bucket)}).where("lo <> hi")
    wanted = twice.groupBy("text_key").agg(F.collect_set("at").alias("ats"))
    once = Window.partitionBy("text_key").orderBy("text_key")
    found = texts.join(wanted, "text_key").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("text_key", "text", "ats")
    pieces = found.mapInArrow(_fragments, "key bigint, text_key bigint, at int, least int, left binary, trigger binary, right binary")
    alike = Window.partitionBy("key", "right", "left", "least").orderBy("text_key", "at")
    numbered = pieces.repartition("key").withColumn("nth", F.row_number().over(alike))
    runs = numbered.sortWithinPartitions("key", "right", "left", "least").mapInArrow(_repeats, "text_key bigint, first int, last int")
    return _spans(docs, runs, id_col, text_col)


def _spans(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of repeated starts become spans of words; a text that has copies is a span as a whole."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = np.concatenate([w.counts() for w in words(b.column(2))] or [np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32))], names=["doc_id", "text_key", "n_words"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.lower(text_col).alias("text"))
    rows = rows.mapInArrow(count, f"doc_id {dict(docs.dtypes)[id_col]}, text_key bigint, n_words int").where(F.col("n_words") >= LENGTH)
    rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy("text_key")))
    order = Window.partitionBy("text_key").orderBy("first")
    opens = F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + LENGTH, F.lit(True))
    islands = runs.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order))
    spans = islands.groupBy("text_key", "island").agg(F.min("first").alias("start_word"), (F.max("last") + LENGTH).alias("end_word")).drop("island")
    whole = rows.where("copies > 1").select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"))
    part = rows.where("copies = 1").join(spans, "text_key").select("doc_id", "start_word", "end_word")
    return whole.unionAll(part)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {LENGTH}], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(0, len(w) - {LENGTH} + 1)) AS i FROM w WHERE len(w) >= {LENGTH})),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY hash(g), md5(g)) AS n FROM grams) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS opens FROM starts),
islands AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) + {LENGTH})::INTEGER AS end_word FROM islands GROUP BY doc_id, island
"""
