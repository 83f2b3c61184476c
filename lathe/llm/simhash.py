"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: bit j of 64 is 1 if it is set in over half of the XXH64 hashes of
the text's 3-word shingles. Documents link at RADIUS or fewer differing bits.

Candidates: each bit position i has a vector m(i) of RADIUS + 1 bits. Table v
(every v but 0) keeps the positions where <m(i), v> is odd. For any RADIUS
differing positions some v is orthogonal to all their vectors, as RADIUS linear
conditions on RADIUS + 1 bits leave a non-zero solution; that table keeps none
of them. So every pair within the radius collides in some table: no link is lost.

Scale: copies collapse first (tables hold distinct fingerprints, of which a
bucket is checked as a sorted stream). A bucket above ``WIDE`` is dealt again by
a second covering family on other vectors, under which any pair still collides;
what then shares a bucket agrees on about 48 bits, so a bucket holds at most
2**17 or so distinct fingerprints. Inside a bucket pairs are compared in numpy
blocks and only a spanning forest of the links leaves the task, never all pairs.
Components: each round every node moves to its smallest neighbour and edges
between moved nodes remain; rounds are written to the shared folder.

Defined cases: texts without words (null, empty) have fingerprint zero and link
like others; null doc_id never names a component unless all ids there are null;
repeated rows share a fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, gathered, lean, numbered, read, row_number_base, tidied

RADIUS = 3
SHINGLE = 3
SEED = 42
WIDE = 2048
BLOCK = 1024


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words in order; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    edges = [0]
    for w in words:
        edges.append(edges[-1] + len(w) + 1)
    n = min(size, len(words))
    return np.fromiter((xxhash.xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(edges, edges[n:])), np.uint64)  # noqa: B905


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text."""
    h = shingle_hashes(text, SHINGLE)
    step, ones = 1 << 16, np.zeros(64, np.int64)
    for at in range(0, len(h), step):
        ones += np.unpackbits(h[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


@tidied
def _fingerprints(batches):
    uid = row_number_base()
    for batch in batches:
        n = batch.num_rows
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(uid, uid + n)), pa.array(values.view(np.int64))], names=["doc_id", "uid", "fp"])
        uid += n


def masks(seed: int, radius: int = RADIUS) -> list[int]:
    """Kept bits of each table of a covering family, as signed 64-bit numbers."""
    rng = np.random.default_rng(seed)
    # Every non-zero vector equally often, so that tables keep about half of the bits each.
    vectors = rng.permutation(np.resize(np.arange(1, 2 ** (radius + 1)), 64))
    out = []
    for v in range(1, 2 ** (radius + 1)):
        kept = sum(1 << i for i, m in enumerate(vectors) if (int(m) & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


FIRST, SECOND = masks(1), masks(2)


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Star-shaped spanning forest of the links among distinct fingerprints, by blocks.

    Pairs inside what is joined already drop out in numpy, so a dense group costs
    comparisons but no loop over its pairs.
    """
    root = np.arange(len(fp))
    for a in range(0, len(fp), BLOCK):
        for b in range(a, len(fp), BLOCK):
            x, y = np.nonzero(np.bitwise_count(fp[a : a + BLOCK, None] ^ fp[None, b : b + BLOCK]) <= RADIUS)
            p, q = root[x + a], root[y + b]
            apart = p != q
            if not apart.any():
                continue
            pairs = np.unique(np.stack([np.minimum(p, q)[apart], np.maximum(p, q)[apart]], axis=1), axis=0)
            for i, j in pairs.tolist():
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                root[max(i, j)] = min(i, j)
            while (root[root] != root).any():
                root = root[root]
    return [(int(r), i) for i, r in enumerate(root) if r != i]


@tidied
def _links(batches):
    """Sorted stream of (table, key, fp) to links (a, b). A bucket may span batches."""
    rest: list[np.ndarray] = []

    def emit(table, key, fp):
        edge = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], edge, [len(fp)]])
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        a, b = [], []
        small = np.flatnonzero((size > 1) & (size <= 32))
        f, g = fp[small], group[small]
        for d in range(1, 32):
            if len(f) <= d:
                break
            hit = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= RADIUS))
            a.append(f[hit])
            b.append(f[hit + d])
        for lo, hi in pairwise(bounds.tolist()):
            if hi - lo > 32:
                pairs = np.array(_forest(fp[lo:hi]), np.int64).reshape(-1, 2)
                a.append(fp[lo:hi][pairs[:, 0]])
                b.append(fp[lo:hi][pairs[:, 1]])
        a, b = np.concatenate([*a, np.zeros(0, np.uint64)]).astype(np.uint64), np.concatenate([*b, np.zeros(0, np.uint64)]).astype(np.uint64)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = [np.concatenate([r, c]) for r, c in zip(rest, now, strict=True)] if rest else now
        table, key, fp = rest
        last = np.flatnonzero((table != table[-1]) | (key != key[-1])) if len(fp) else []
        if len(last):
            to = int(last[-1]) + 1
            yield emit(table[:to], key[:to], fp[:to].view(np.uint64))
            rest = [r[to:] for r in rest]
    if rest and len(rest[0]):
        yield emit(rest[0], rest[1], rest[2].view(np.uint64))


def _tables(df: DataFrame, family: list[int], offset) -> DataFrame:
    """Each fingerprint once for each table, with the bits that the table keeps."""
    entry = F.explode(F.array(*(F.struct((offset + F.lit(v)).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(family))))
    return df.select("fp", entry.alias("e"), *(c for c in df.columns if c in ("was", "kept"))).select("fp", "e.table", "e.key", *(c for c in df.columns if c in ("was", "kept")))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join the same components as all pairs within the radius."""
    first = _tables(distinct, FIRST, F.lit(0))
    counts = first.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = first.join(counts, ["table", "key"])
    small = sized.filter(F.col("n") <= WIDE).select(F.col("table").cast("long").alias("table"), "key", "fp")
    stream = lambda df: df.repartition("table", "key").sortWithinPartitions("table", "key", "fp").select("table", "key", "fp").mapInArrow(_links, "a long, b long")
    wide = sized.filter(F.col("n") > WIDE)
    again = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(SECOND))))
    dealt = wide.select("table", "key", "fp", again.alias("e")).select(
        # Table and both keys in one number each; two keys that met here by chance would only add comparisons.
        (F.lit(1000) + F.col("table") * 100 + F.col("e.v")).cast("long").alias("table"), F.xxhash64("key", "e.k").alias("key"), "fp"
    )
    return stream(small).unionByName(stream(dealt)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the component of each node that has an edge; every root is a node of it."""
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b").filter("a <> b"), "edges", narrow=True)
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node")
        # Chains of moves are followed twice more in each round.
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            step = step.join(jump, "to").select("node", F.col("next").alias("to"))
        step = cut(step, "moves", narrow=True)
        if found is None:
            found = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            found = cut(found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", narrow=True)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = cut(edges.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "edges", narrow=True)
    return found if found is not None else spark.createDataFrame([], "node long, root long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, fp, component_id for each row; uid numbers the rows as read."""
    narrow = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(narrow.mapInArrow(_fingerprints, "doc_id long, uid long, fp long"), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", narrow=True)
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "uid", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more=None) -> DataFrame:
    """The document with the smallest id of each component, with all their columns.

    ``more`` takes (row, text) and (row, c) and gives (row, c) with further components joined.
    """
    own = fresh(docs, "own_row")
    rows = numbered(docs, own)
    ids = rows.select(F.col(own).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    # Components over row numbers, which no two rows share; the smallest document id of each is chosen next.
    found = classes(rows.select(F.col(own).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    place = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("c"))
    if more is not None:
        place = more(rows.select(F.col(own).alias("row"), F.col(text_col).cast("string").alias("text")), cut(place, "place", narrow=True))
    ranked = place.join(ids, "row")
    best = ranked.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("best"))
    return rows.join(best, rows[own] == best["best"], "left_semi").select(docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gathered(classes(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
