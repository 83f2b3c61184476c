"""Near copies by the share of common word shingles: MinHash proposes, the shingles decide.

Two texts are near copies if the Jaccard similarity of their sets of 5-word
shingles is SIMILARITY or more. Such pairs differ in ten SimHash bits on average
and often in more, where a covering family would need 2 ** 10 tables and up;
BANDS keys of ROWS minima each miss a pair at 0.8 with a chance of 3 in 10**6
(1 - 0.8 ** 5 to the power of 32), and less above. This chance is the one thing
that the stage leaves out; every proposed pair is checked on its shingle sets.

Scale: first each row is compared with the smallest row that it shares a key
with, which joins most copies at the cost of one comparison a row. Then the rows
of a bucket that are still apart meet in a sorted stream with their minima and
shingles, and all pairs of them are compared in numpy, by minima and, with enough
equal ones, by shingles. What is joined there is compared no more, and pairs never
become rows: a bucket gives one link at most for each component that it joins.
Buckets above SMALL go a growing number of hubs at a time, salted, and are done
when all their rows are joined.

Defined cases: texts of fewer than five words have one shingle, texts without
words none and no near copies here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer_of, cut, lean, tidied
from .simhash import SEED, components, shingle_hashes

SIMILARITY = 0.8
WORDS = 5
BANDS = 32
ROWS = 5
#: Buckets of so many rows are compared whole, each in one place; of larger ones so many hubs at a time.
SMALL = 2048
HUBS = 1024
SALTS = 64
#: Of BANDS * ROWS minima, each equal with a chance of the similarity, so many at least agree: 0.55 for 0.8, eight deviations below.
LEAST_EQUAL = 88
#: Bytes of minima that are compared at once, and rows of a large bucket for each salt.
COMPARED = 16 << 20
ROWS_PER_SALT = 1024
#: Of two texts that may be near copies, the logarithms of the numbers of shingles differ by less; so their bins by one at most.
LENGTH_STEP = float(np.log(1 / SIMILARITY)) + 1e-6
#: Shingles that meet all minima at once, so that memory doesn't grow with the text.
BLOCK = 2048

_FACTORS = np.random.default_rng(5).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, WORDS))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def minima(own: np.ndarray) -> np.ndarray:
    """The least product with each factor."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(own), BLOCK):
        np.minimum(least, (own[at : at + BLOCK, None] * _FACTORS).min(axis=0), out=least)
    return least


def keys(least: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band."""
    raw = least.astype("<u8").tobytes()
    size = 8 * ROWS
    out = np.array([xxhash.xxh64_intdigest(raw[b * size : (b + 1) * size], SEED + b) for b in range(BANDS)], np.uint64)
    return out.view(np.int64).tolist()


@tidied
def _keys(batches):
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        least = [minima(s) if len(s) else None for s in sets]
        found = [[] if x is None else keys(x) for x in least]
        prints = [bytes(len(_FACTORS)) if x is None else (x & np.uint64(255)).astype(np.uint8).tobytes() for x in least]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "keys", "print"])


@tidied
def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())], names=["row", "shingles"])


def _shared(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each of the sets has in common with ``own``."""
    if len(sets) < 8:
        return np.array([len(np.intersect1d(own, x, assume_unique=True)) for x in sets], np.int64)
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))


class _Cell:
    """Rows of a bucket and salt, hubs first; finds near copies among those that are still apart, and joins them."""

    def __init__(self):
        self.hubs, self.sets, self.moved = None, [], {}

    def place(self, c: np.ndarray) -> np.ndarray:
        """Components after what was joined here."""
        for old, new in self.moved.items():
            c[c == old] = new
        return c

    def add(self, at, row, c, n, prints, sets) -> None:
        new = [at.copy(), row.copy(), self.place(c.copy()), n.copy(), prints.copy()]
        self.hubs = new if self.hubs is None else [np.concatenate(x) for x in zip(self.hubs, new, strict=True)]
        self.sets += [x.copy() for x in sets]

    def join(self, c: np.ndarray, old: int, new: int) -> None:
        for known in (k for k, v in self.moved.items() if v == old):
            self.moved[known] = new
        self.moved[old] = new
        c[c == old] = new
        self.hubs[2][self.hubs[2] == old] = new

    def links(self, at, row, c, n, prints, sets):
        """Links (hub, row) that join the same components as all near copies among hubs and these rows."""
        hub_at, hub_row, hub_c, hub_n, hub_prints = self.hubs
        step = max(1, COMPARED // (len(hub_at) * len(_FACTORS)))
        for low in range(0, len(at), step):
            part = slice(low, low + step)
            own = self.place(c[part].copy())
            small, large = np.minimum(hub_n, n[part, None]), np.maximum(hub_n, n[part, None])
            fits = (hub_at < at[part, None]) & (hub_c != own[:, None]) & (small >= (SIMILARITY - 1e-9) * large)
            if not fits.any():
                continue
            fits &= (hub_prints[None] == prints[part][:, None]).sum(axis=2) >= LEAST_EQUAL
            for j in np.flatnonzero(fits.any(axis=0)):
                i = np.flatnonzero(fits[:, j] & (own != hub_c[j]))
                if not len(i):
                    continue
                both = _shared(self.sets[j], [sets[low + k] for k in i])
                for k in i[both / np.maximum(1, hub_n[j] + n[part][i] - both) >= SIMILARITY]:
                    if own[k] != hub_c[j]:
                        yield hub_row[j], row[low + k]
                        self.join(own, own[k], hub_c[j])


@tidied
def _near(batches):
    """Stream of bucket rows (key, salt, role, own, at, row, c, n, print, shingles), hubs (role 0) first, to links (a, b) of near copies; ``own`` tells the rows that hubs are compared with."""
    held, cell = None, None
    for batch in batches:
        key, salt, role, own, at, row, c, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
        prints = buffer_of(batch.column(8))[0].reshape(-1, len(_FACTORS))
        data, ends = buffer_of(batch.column(9))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])) if len(key) else []
        pairs = [[], []]
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            if (name := (int(key[a]), int(salt[a]))) != held:
                held, cell = name, _Cell()
            sets = [data[ends[k] : ends[k + 1]].view("<u8") for k in range(a, b)]
            middle = a + int(np.searchsorted(role[a:b], 1))
            if middle > a:
                cell.add(at[a:middle], row[a:middle], c[a:middle], n[a:middle], prints[a:middle], sets[: middle - a])
            chosen = np.flatnonzero(own[a:b])
            if cell.hubs is None or not len(chosen):
                continue
            for x, y in cell.links(*(v[a:b][chosen] for v in (at, row, c, n, prints)), [sets[k] for k in chosen]):
                pairs[0].append(x)
                pairs[1].append(y)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], names=["a", "b"])


@tidied
def _same(batches):
    """Stream of (a, b, text), each hub's own text first with b = -1, to the pairs that are near copies."""
    hub, own = None, None
    for batch in batches:
        rows = [[], []]
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            other = shingle_set(text.as_py())
            if b < 0:
                hub, own = a, other
            elif a == hub and similarity(own, other) >= SIMILARITY:
                rows[0].append(a)
                rows[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["a", "b"])


def checked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near copies."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    hubs = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("row", "a"), "a").select("a", "salt", F.lit(-1).cast("long").alias("b"), "text")
    rest = salted.join(texts.withColumnRenamed("row", "b"), "b").select("a", "salt", "b", "text")
    stream = hubs.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return lean(stream.select("a", "b", "text")).mapInArrow(_same, "a long, b long")


def _joined(place: DataFrame, links: DataFrame) -> DataFrame:
    """``place`` after its components are joined along the links of rows."""
    one, two = place.select(F.col("row").alias("a"), F.col("c").alias("ca")), place.select(F.col("row").alias("b"), F.col("c").alias("cb"))
    edges = links.join(one, "a").join(two, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    roots = components(edges)
    return cut(place.join(roots.withColumnRenamed("node", "c"), "c", "left").select("row", F.coalesce("root", "c").alias("c")), "near-place", narrow=True)


def merged(texts: DataFrame, place: DataFrame) -> DataFrame:
    """(row, c): the components of ``place`` (row, c), joined where texts (row, text) are near copies."""
    found = cut(lean(texts).mapInArrow(_keys, "row long, n long, keys array<long>, print binary"), "near-keys")
    bucket = Window.partitionBy("key")
    sized = found.select("row", "n", F.explode("keys").alias("key")).withColumn("size", F.count("*").over(bucket)).filter("size > 1")
    buckets = cut(sized.withColumns({"at": F.row_number().over(bucket.orderBy("row")), "least": F.min("row").over(bucket)}), "near-buckets", narrow=True)
    rows = cut(buckets.groupBy("row").agg(F.min("least").alias("least")), "near-rows", narrow=True)
    own = cut(texts.join(rows.select("row"), "row", "left_semi"), "near-texts")

    def unlike(pairs):
        one, two = place.select(F.col("row").alias("a"), F.col("c").alias("ca")), place.select(F.col("row").alias("b"), F.col("c").alias("cb"))
        return pairs.distinct().join(one, "a").join(two, "b").filter("ca <> cb").select("a", "b")

    first = unlike(rows.filter("least < row").select(F.col("least").alias("a"), F.col("row").alias("b")))
    place = _joined(place, cut(checked(own, first), "near-links", narrow=True))
    done, hubs, sets = 0, 1, None
    while True:
        live = buckets.filter((F.col("at") > done) & (F.col("size") > done + 1)).join(place, "row")
        if done:
            live = live.filter(F.col("size") > SMALL)
        # Rows stay that have a row of another component and of like size in their bucket.
        live = live.withColumn("bin", F.floor(F.log("n") / LENGTH_STEP))
        ends = live.groupBy("key", "bin").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        beside = Window.partitionBy("key").orderBy("bin").rangeBetween(-1, 1)
        apart = ends.select("key", "bin", F.min("lo").over(beside).alias("lo"), F.max("hi").over(beside).alias("hi")).filter("lo <> hi").select("key", "bin")
        live = cut(live.join(apart, ["key", "bin"], "left_semi"), "near-live", narrow=True)
        if live.isEmpty():
            return place
        if sets is None:  # later rounds have no other rows
            chosen = own.join(live.select("row").distinct(), "row", "left_semi").select("row", "text")
            sets = cut(lean(chosen).mapInArrow(_sets, "row long, shingles binary").join(found.select("row", "print"), "row"), "near-sets")
        salts = F.when(F.col("size") <= SMALL, 1).otherwise(F.ceil(F.col("size") / ROWS_PER_SALT)).cast("int")
        mine = F.pmod(F.xxhash64("row"), salts).cast("int")
        is_hub = (F.col("at") <= done + hubs) | (F.col("size") <= SMALL)
        entry = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("salt"), (x == mine).alias("own"))
        entries = F.explode(F.when(is_hub, F.transform(F.sequence(F.lit(0), salts - 1), lambda x: entry(0, x))).otherwise(F.array(entry(1, mine))))
        stream = live.select("key", entries.alias("e"), F.col("at").cast("long").alias("at"), "row", "c", "n").join(sets, "row")
        stream = stream.select("key", "e.salt", "e.role", "e.own", "at", "row", "c", "n", "print", "shingles").repartition("key", "salt").sortWithinPartitions("key", "salt", "role", "at")
        place = _joined(place, cut(lean(stream).mapInArrow(_near, "a long, b long").distinct(), "near-links", narrow=True))
        done, hubs = done + hubs, min(hubs * 4, HUBS)
