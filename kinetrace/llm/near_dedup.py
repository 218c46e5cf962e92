"""MinHash near-duplicate removal by a multi-index Hamming join.

Every text gets a b-bit MinHash signature: ``HASHES`` minima over its 3-word shingles, ``b`` = 16 low bits of each.
The distance of two signatures is the number of places where they differ; two documents are near duplicates if
it is at most ``RADIUS``. The join splits a signature into ``CHUNKS`` chunks. By the pigeonhole principle, two
signatures within RADIUS differ in at most RADIUS // CHUNKS = 1 places of some chunk, so each document is filed under
every chunk with each one of its places left out: that enumerates the allowed chunk errors on both sides, and
no pair within the radius can be missed. A key is the 48 bits that are left, with the chunk and the place,
packed in one integer without hashing.

Links: every pair of different signatures within the radius is found once, under the first of its keys, and counted for both
sides, copies weighing as many as they are; a document's links are the other rows within the radius. The pairs themselves are not
emitted: a key gives its members' counts and a spanning forest, from which large-star/small-star rounds over checkpointed edges make the components.

Scale: exact copies (one signature) are one node from the start. The key table holds 16 bytes a key; only keys
with two or more nodes go on to meet signatures, and of keys that file the very same nodes one. Members of a key that has more than
``BLOCK`` are dealt into blocks, and every two blocks meet in a task of their own, so no task holds more than two blocks. Pairs that have
met under an earlier key drop out by one comparison of chunks. Counts, fingerprints and smallest ids are aggregates with
map-side combining and joins that adaptive execution can split; there is no window over a key or a group. No cap on members, partners or candidates.
Nodes, rows and sets of nodes are told apart by 128 bits.

Defined edge cases: null texts and texts without any word have no signature and are in no group; a text of one
or two words has one shingle; repeated rows are copies of each other; null ids are allowed (a group is named by
its smallest non-null id, or null if it has none); ties in the smallest id go to the smaller row key; long texts are read whole, about a
megabyte at a time; an empty table gives no rows; extra columns are ignored, or kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.textkernel import cut, fresh, shingles, words

HASHES, BITS, CHUNKS, RADIUS, SHINGLE, BLOCK = 64, 16, 16, 31, 3, 2048
_PLACES = HASHES // CHUNKS
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(texts: pa.Array, k: int = SHINGLE) -> pa.Array:
    """Binary signature (2 * HASHES bytes) of each lower-cased text; null where it has no word."""
    out: list[bytes | None] = []
    for w in words(texts):
        x, at = shingles(w, k)
        full = np.flatnonzero(np.diff(at) > 0)
        sig = np.zeros((w.n_docs, HASHES), dtype="<u2")
        if len(full):
            low = (x >> np.uint64(32)).astype(np.uint32)
            starts, work = at[full], np.empty(len(low), dtype=np.uint32)
            for i in range(HASHES):
                np.multiply(low, _A[i], out=work)
                np.add(work, _B[i], out=work)
                sig[full, i] = _fmix(np.minimum.reduceat(work, starts)) & np.uint32(0xFFFF)
        has = np.zeros(w.n_docs, dtype=bool)
        has[full] = True
        out += [sig[i].tobytes() if has[i] else None for i in range(w.n_docs)]
    return pa.array(out, type=pa.binary())


def _signature_udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield signatures(texts)


def signature_column(text: str) -> Column:
    return F.arrow_udf(_signature_udf, "binary").asNondeterministic()(F.lower(F.col(text)))


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """[n, CHUNKS * _PLACES] keys of uint16 signatures [n, HASHES]: a chunk without one of its places, and which."""
    s = sigs.reshape(len(sigs), CHUNKS, _PLACES).astype(np.int64)
    keys = np.empty((len(sigs), CHUNKS, _PLACES), dtype=np.int64)
    for gone in range(_PLACES):
        value = np.zeros((len(sigs), CHUNKS), dtype=np.int64)
        for j in range(_PLACES):
            if j != gone:
                value = (value << BITS) | s[:, :, j]
        keys[:, :, gone] = (np.arange(CHUNKS)[None, :] * _PLACES + gone) << (BITS * (_PLACES - 1)) | value
    return keys.reshape(len(sigs), -1)


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if not b.num_rows:
            continue
        sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2").reshape(-1, HASHES)
        node = b.column("node").to_numpy()
        for i in range(0, len(node), 4096):
            k = chunk_keys(sigs[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(node[i : i + 4096], k.shape[1]))], names=["key", "node"])


def link(sigs: np.ndarray, copies: np.ndarray, key: int, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each member, spanning edges) of the pairs within the radius that have ``key`` as the first that they share.

    key: a chunk and the place left out, as ``chunk_keys`` numbers them; every two members share it. side: of two blocks, only
    pairs across count.
    """
    chunk, gone = divmod(key, _PLACES)
    whole = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), CHUNKS)
    links, label, edges = np.zeros(len(sigs), dtype=np.int64), np.arange(len(sigs)), []
    others = np.arange(len(sigs)) if side is None else np.flatnonzero(side)
    for p in range(len(sigs)) if side is None else np.flatnonzero(~side):
        q = others[p + 1 :] if side is None else others
        for c in range(chunk + (gone > 0)):  # equal there: they have met
            if not len(q):
                break
            q = q[whole[q, c] != whole[p, c]]
        if not len(q):
            continue
        errors = (sigs[q] != sigs[p]).reshape(len(q), CHUNKS, _PLACES).sum(2)
        first = (errors[:, :chunk] > 1).all(1)
        if gone:
            first &= errors[:, chunk] == 1
        q = q[first & (errors.sum(1) <= radius)]
        links[p] += copies[q].sum()
        links[q] += copies[p]
        for x in q[label[q] != label[p]]:
            if label[x] != label[p]:
                edges.append((int(p), int(x)))
                label[label == label[x]] = label[p]
    return links, edges


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, links) of rows sorted by (key, i, j): edges have a b, the counts of a node none."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key, i, j, sub, node, copies = (t.column(c).to_numpy() for c in ("key", "i", "j", "sub", "node", "copies"))
        col = t.column("sig").chunk(0)
        raw = np.frombuffer(col.buffers()[2], dtype=np.uint8)
        sigs = raw[np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset] :][: 2 * HASHES * len(col)].view("<u2").reshape(-1, HASHES) if len(col) else np.zeros((0, HASHES), dtype="<u2")
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        a, b, n = [], [], []
        for lo, hi in zip(edge, np.append(edge[1:], len(key)), strict=True):
            if hi - lo < 2:
                continue
            side = None if i[lo] == j[lo] else sub[lo:hi] == j[lo]
            links, edges = link(sigs[lo:hi], copies[lo:hi], int(key[lo] >> BITS * (_PLACES - 1)), side)
            some = np.flatnonzero(links)
            at = np.array(edges, dtype=np.int64).reshape(-1, 2) + lo
            a += [node[at[:, 0]], node[lo + some]]
            b += [node[at[:, 1]], np.full(len(some), -1)]
            n += [np.zeros(len(at), dtype=np.int64), links[some]]
        if a:
            b = np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(b, mask=b < 0), pa.array(np.concatenate(n))], names=["a", "b", "links"])

    held: list[pa.RecordBatch] = []
    for x in it:
        if not x.num_rows:
            continue
        last = x.slice(x.num_rows - 1)
        same = np.ones(x.num_rows, dtype=bool)
        for c in ("key", "i", "j"):
            same &= x.column(c).to_numpy() == last.column(c)[0].as_py()
        split = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last block may go on in the next batch
        if split or (held and any(held[-1].column(c)[-1].as_py() != last.column(c)[0].as_py() for c in ("key", "i", "j"))):
            yield from solve(pa.Table.from_batches([*held, x.slice(0, split)]))
            held = []
        held.append(x.slice(split))
    if held:
        yield from solve(pa.Table.from_batches(held))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the connected component of every node that has an edge."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    star = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(star)) != before:
        before = now
        both = star.unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        pairs = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        star = cut(pairs.where("a <> b").distinct())
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(star.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Checkpointed (a, b, links) of nodes (node BIGINT, sig BINARY, copies BIGINT; one row a node): edges that link all that
    lie within the radius, and (b null) parts of the number of rows that are linked to a node, its own copies apart."""
    keys = nodes.select("node", "sig").mapInArrow(_keys, "key bigint, node bigint")
    shared = keys.groupBy("key").count().where("count > 1")
    members = cut(keys.join(shared, "key"))
    print_of = [F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("f2")]
    sets = members.groupBy("key").agg(F.first("count").alias("n"), *print_of).groupBy("n", "f1", "f2").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / block)
    met = members.join(sets.select("key", "n"), "key").withColumn("sub", F.pmod(F.xxhash64("node", "key"), parts)).join(nodes.select("node", "sig", "copies"), "node")
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda t: F.struct(F.least("sub", t).alias("i"), F.greatest("sub", t).alias("j")))
    dealt = met.withColumn("p", F.explode(pairs)).select("key", "p.i", "p.j", "sub", "node", "copies", "sig")
    return cut(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links, "a bigint, b bigint, links bigint"))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(F.col(id_col), F.lit(0), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.lit(0), F.col(text_col))]


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, group_id, group_size, links, root, k1, k2) of every row that has a link."""
    k1, k2 = _row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), signature_column(text_col).alias("sig")).where("sig is not null")
    signed = cut(rows.withColumns({"h1": F.xxhash64("sig"), "h2": F.xxhash64(F.lit(1), "sig")}))
    once = signed.groupBy("h1", "h2").agg(F.first("sig").alias("sig"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    nodes = cut(once.withColumn("node", F.monotonically_increasing_id()))  # written once, so a number stays
    found = near_links(nodes)
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    linked = nodes.drop("sig").join(roots, "node", "left").join(degree, "node", "left")
    linked = cut(linked.select("h1", "h2", "least", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0"))
    groups = linked.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("copies").alias("group_size"))
    return signed.drop("sig").join(linked.join(groups, "root").select("h1", "h2", "root", "links", "group_id", "group_size"), ["h1", "h2"])


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size, links): one row for every document that has a near or exact copy.

    group_id is the smallest doc_id of the connected component, group_size counts its rows, links the other rows within the radius.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "group_id", "group_size", "links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group left: the one of the smallest id (then the smallest row key).

    Rows that repeat both id and text count as one. Rows without a signature stay, unless they repeat each other so.
    """
    rows = cut(_grouped(docs, id_col, text_col).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("row")))
    keep = rows.groupBy("root").agg(F.min("row").alias("kept"))
    k1, k2, nth = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "nth")
    gone = rows.join(keep, "root").where("row <> kept").select(F.col("row.k1").alias(k1), F.col("row.k2").alias(k2)).distinct()
    keyed = docs.withColumns(dict(zip((k1, k2), _row_key(id_col, text_col), strict=True)))
    left = keyed.join(gone, [k1, k2], "left_anti")
    once = left.withColumn(nth, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))).where(F.col(nth) == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
