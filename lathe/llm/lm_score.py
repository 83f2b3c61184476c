"""Language-model scoring by subword lattice likelihood.

Base: add-one word model over training documents (crc32 of the id mod 7 is not 2).

Model: a text is a sequence of vocabulary pieces drawn independently, then one
end. A word's probability is the sum over all of its segmentations, by a forward
recursion in log space over byte positions; as pieces hold no inner word start,
the text's marginal is the product over its words. Piece scores start from the
existing vocabulary's scores, read as ranks (1 / (rank + 3)), and are
re-estimated by one pass of expected counts over the training words, to which
the starting weights are added as a prior. Every single byte is a piece, so no
text has probability zero.

Scale: words are counted with local pre-aggregation; scores are computed once
for each distinct word, on the word table. Words that make up at least
1 / HOT_SHARE of all tokens go to every task (their number is at most HOT_SHARE
by arithmetic); the other (document, word, count) triples join the word table.

Defined cases: null and empty texts are one end token; without training
documents V and N are 0 and only the prior scores; a null id hashes as the empty
string; repeated rows are scored one by one; an empty table gives an empty
result; texts of any length are scored whole, an unbroken word of megabytes too.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffer_of, chunks, cut, lean, lowered, read, row_number_base, tidied

PIECES = "piece_bpe_32k.model"
HELD_MODULO, HELD_REST = 7, 2
HOT_SHARE = 500_000
PRIOR_TOKENS = 1000.0
FLUSH_WORDS = 500_000
START = b"\xe2\x96\x81"
ROWS = 20_000
#: Words above this many bytes are scored on their own, in blocks of BLOCK bytes.
LONG_WORD = 1024
BLOCK = 1 << 15


class Lattice:
    """Piece scores with a hash table for substrings of many words at once."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        rng = np.random.default_rng(5)
        self.code = rng.integers(1, 2**63 - 1, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.longest = max(map(len, pieces))
        self.power = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.longest):
                self.power[i + 1] = self.power[i] * self.base
        bits = 21
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        mask = (1 << 64) - 1
        for n, piece in enumerate(pieces):
            key = 0
            for c in piece:
                key = (key * int(self.base) + int(self.code[c])) & mask
            item, slot = (key, n), self._slot(key, 0)
            for _ in range(500):  # two places for each key: whoever is displaced moves to its other one
                old = (int(self.keys[slot]), int(self.values[slot]))
                self.keys[slot], self.values[slot] = item
                if old[1] < 0:
                    break
                first = self._slot(old[0], 0)
                item, slot = old, self._slot(old[0], 1) if slot == first else first
            else:
                raise ValueError("the piece table is too small")

    def _slot(self, key: int, which: int) -> int:
        mult = 0xD6E8FEB86659FD93 if which == 0 else 0xC2B2AE3D27D4EB4F
        return ((key * mult) & ((1 << 64) - 1)) >> int(self.shift)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece numbers, or -1."""
        a = ((key * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)
        got = np.where(self.keys[a] == key, self.values[a], -1)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            k = key[miss]
            b = ((k * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift).astype(np.int64)
            got[miss] = np.where(self.keys[b] == k, self.values[b], -1)
        return got

    def _same_length(self, rows: np.ndarray, weight: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        n, size = rows.shape
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            prefix = np.zeros((size + 1, n), np.uint64)
            for j in range(size):
                prefix[j + 1] = prefix[j] * self.base + self.code[rows[:, j]]
            alpha = np.full((size + 1, n), -np.inf)
            alpha[0] = 0.0
            arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for j in range(1, size + 1):
                terms = []
                for i in range(max(0, j - self.longest), j):
                    which = self.find(prefix[j] - prefix[i] * self.power[j - i])
                    if (which >= 0).any():
                        arc = np.where(which >= 0, self.log_p[which], -np.inf)
                        terms.append(alpha[i] + arc)
                        if counts is not None:
                            arcs.append((i, j, which, arc))
                terms = np.stack(terms)
                top = terms.max(axis=0)
                alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
            if counts is not None:
                beta = np.full((size + 1, n), -np.inf)
                beta[size] = 0.0
                for i, j, which, arc in reversed(arcs):
                    beta[i] = np.logaddexp(beta[i], arc + beta[j])
                    share = weight * np.exp(alpha[i] + arc + beta[j] - alpha[size])
                    hit = which >= 0
                    counts += np.bincount(which[hit], weights=share[hit], minlength=len(counts))
        return alpha[size]

    def _arcs(self, prefix: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, piece) of all pieces that end in (low, high], by end; prefix holds hashes of prefixes less than ``longest`` before low on."""
        start = max(0, low + 1 - self.longest)
        found = []
        with np.errstate(over="ignore"):
            for length in range(1, self.longest + 1):
                ends = np.arange(max(low + 1, length), high + 1)
                if not len(ends):
                    break
                which = self.find(prefix[ends - start] - prefix[ends - length - start] * self.power[length])
                hit = np.flatnonzero(which >= 0)
                found.append((ends[hit], np.full(len(hit), length), which[hit]))
        end, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], length[order], piece[order]

    def _prefixes(self, data: np.ndarray, start: int, high: int) -> np.ndarray:
        """Hashes of data[start:start], ..., data[start:high]."""
        with np.errstate(over="ignore"):
            size = high - start
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base)]))
            back = np.cumprod(np.full(size, self.inverse)) if size else np.zeros(0, np.uint64)
            return np.concatenate([[np.uint64(0)], np.cumsum(self.code[data[start:high]] * back) * power[1:]])

    def _blocks(self, data: np.ndarray, backwards: bool = False):
        """(end, length, piece) of the arcs of each block of one word."""
        lows = range(0, len(data), BLOCK)
        for low in reversed(lows) if backwards else lows:
            high = min(low + BLOCK, len(data))
            yield self._arcs(self._prefixes(data, max(0, low + 1 - self.longest), high), low, high)

    def _alone(self, data: np.ndarray, weight: float | None, counts: np.ndarray | None) -> float:
        """The same recursion over one long word: arcs come by the block, so memory is 16 bytes for each byte of the word."""
        alpha = array("d", bytes(8 * (len(data) + 1)))
        exp, log = math.exp, math.log

        def add(into, at, terms):
            top = max(terms)
            into[at] = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top

        for end, length, piece in self._blocks(data):
            at, terms = -1, []
            for e, n, lp in zip(end.tolist(), length.tolist(), self.log_p[piece].tolist(), strict=True):
                if e != at:
                    if terms:
                        add(alpha, at, terms)
                    at, terms = e, []
                terms.append(alpha[e - n] + lp)
            add(alpha, at, terms)
        total = alpha[len(data)]
        if counts is not None:
            beta = array("d", [-math.inf]) * len(data) + array("d", [0.0])
            ahead = np.frombuffer(alpha)
            for end, length, piece in self._blocks(data, backwards=True):
                # Arcs by their start, last ones first: all arcs out of a place come after those that lead on from their ends.
                order = np.lexsort((-length, length - end))
                end, length, piece = end[order], length[order], piece[order]
                lp = self.log_p[piece]
                for e, n, p in zip(end.tolist(), length.tolist(), lp.tolist(), strict=True):
                    old, new = beta[e - n], p + beta[e]
                    top = old if old > new else new
                    beta[e - n] = top + log(exp(old - top) + exp(new - top)) if old > -math.inf else new
                share = weight * np.exp(ahead[end - length] + lp + np.frombuffer(beta)[end] - total)
                counts += np.bincount(piece, weights=share, minlength=len(counts))
        return total

    def score(self, words: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each word's marginal; with weights, also expected piece counts."""
        data, offsets = buffer_of(words)
        sizes = np.diff(offsets)
        out = np.zeros(len(sizes))
        counts = np.zeros(len(self.pieces)) if weight is not None else None
        head = np.frombuffer(START, np.uint8)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            if not len(group):
                continue
            size = int(sizes[group[0]])
            if size > LONG_WORD:
                for n in group:
                    word = np.concatenate([head, data[offsets[n] : offsets[n + 1]]])
                    out[n] = self._alone(word, None if weight is None else float(weight[n]), counts)
                continue
            step = max(1, ROWS * 12 // (size + len(START)))
            if counts is not None:
                step = max(1, step // 4)
            for at in range(0, len(group), step):
                own = group[at : at + step]
                rows = np.empty((len(own), size + len(head)), np.uint8)
                rows[:, : len(head)] = head
                rows[:, len(head) :] = data[offsets[own][:, None] + np.arange(size)]
                out[own] = self._same_length(rows, None if weight is None else weight[own], counts)
        return out, counts


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their starting weights, from the vocabulary's own scores; then all bytes, then the end."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    rank: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:]:
            continue
        raw = piece.encode()
        rank[raw] = min(rank.get(raw, math.inf), max(0.0, -model.get_score(i)))
    for b in range(256):
        rank.setdefault(bytes([b]), 1e6)
    pieces = sorted(rank)
    weight = np.array([1.0 / (rank[p] + 3.0) for p in pieces])
    return pieces, weight / weight.sum()


def _gathered(batches, rows: int = 200_000):
    """Batches put together to about ``rows`` rows: the recursion works on all words of one length at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@tidied
def _count(batches):
    held: dict[bytes, int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        held.clear()
        return out

    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = buffer_of(part.column(0))
            number, distinct = Words(lowered(data), offsets).encoded()
            for word, n in zip(distinct.to_pylist(), np.bincount(number, minlength=len(distinct)).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) > FLUSH_WORDS:
                yield flush()
    if held:
        yield flush()


def _expected(pieces: list[bytes], log_p: np.ndarray):
    @tidied
    def run(batches):
        lattice, total = Lattice(pieces, log_p), np.zeros(len(pieces))
        for batch in _gathered(batches):
            total += lattice.score(batch.column(0), batch.column(1).to_numpy().astype(float))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["piece", "n"])

    return run


def _score_words(pieces: list[bytes], log_p: np.ndarray):
    @tidied
    def run(batches):
        lattice = Lattice(pieces, log_p)
        for batch in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.score(batch.column(0))[0])], names=[*batch.schema.names, "lp"])

    return run


_SUMS = "struct<doc_id:long,held_out:boolean,n_tokens:long,known:long,base:double,lp:double>"


def _score_docs(hot):
    """Documents to sums over hot words, and (uid, word, n) for the others."""

    @tidied
    def run(batches):
        table, uid = hot.value, row_number_base()
        words_of, gain, lp = table["words"], table["gain"], table["lp"]
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = buffer_of(part.column(2))
                words = Words(lowered(data), offsets)
                number, distinct = words.encoded()
                at = pc.fill_null(pc.index_in(distinct, value_set=words_of), -1).to_numpy().astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
                place = at[number] if len(number) else np.zeros(0, np.int64)
                is_hot = place >= 0
                rows = part.num_rows
                by_row = lambda x: np.bincount(words.doc[is_hot], weights=x, minlength=rows)  # noqa: B023, E731
                ids = np.arange(uid, uid + rows)
                uid += rows
                sums = pa.StructArray.from_arrays(
                    [part.column(0), part.column(1), pa.array(words.count + 1), pa.array(np.bincount(words.doc[is_hot], minlength=rows).astype(np.int64)), pa.array(by_row(gain[place[is_hot]])), pa.array(by_row(lp[place[is_hot]]))],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "lp"],
                )
                # A blank never occurs in a word: these keys match nothing and spread evenly.
                own = pa.array([b" " + int(i).to_bytes(8, "little") for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), own, pa.array(np.zeros(rows, np.int64)), sums], names=["uid", "word", "n", "sums"])
                rest = ~is_hot
                key, n = np.unique(words.doc[rest] * max(1, len(distinct)) + number[rest], return_counts=True)
                if len(key):
                    doc, word = key // len(distinct), key % len(distinct)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), distinct.take(pa.array(word)).cast(pa.binary()), pa.array(n.astype(np.int64)), pa.nulls(len(key), sums.type)], names=["uid", "word", "n", "sums"])

    return run


def _fill(pieces: list[bytes], log_p: np.ndarray):
    """Score the words that training never saw, and weigh by count."""

    @tidied
    def run(batches):
        lattice = Lattice(pieces, log_p)
        for batch in _gathered(batches):
            uid, word, n, sums, c, lp = batch.columns
            c = pc.fill_null(c, 0).to_numpy().astype(np.int64)
            n = n.to_numpy()
            value = pc.fill_null(lp, np.nan).to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(np.isnan(value) & (n > 0))
            if len(new):
                distinct = word.take(pa.array(new)).dictionary_encode()
                value[new] = lattice.score(distinct.dictionary)[0][distinct.indices.to_numpy()]
            value = np.where(n > 0, value, 0.0)
            yield pa.RecordBatch.from_arrays([uid, sums, pa.array(np.where(c > 0, n, 0)), pa.array(n * np.log10(c + 1.0)), pa.array(n * value)], names=["uid", "sums", "known", "base", "lp"])

    return run


def fit(docs: DataFrame) -> dict:
    """Word table with counts and scores, piece scores and totals, from (text) rows."""
    spark = docs.sparkSession
    words = cut(docs.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    ends = docs.count()
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)
    pieces, prior = vocabulary()
    seen = words.mapInArrow(_expected(pieces, np.log(prior)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = prior * PRIOR_TOKENS
    for row in seen:
        counts[row["piece"]] += row["n"]
    end_count = ends + 1.0
    whole = counts.sum() + end_count
    log_p = np.log(counts / whole)
    scored = cut(words.mapInArrow(_score_words(pieces, log_p), "word binary, c long, lp double"), "lm-words")
    return {"words": scored, "pieces": pieces, "log_p": log_p, "end": math.log(end_count / whole), "tokens": tokens, "distinct": distinct, "ends": ends, "spark": spark}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of scores for each document."""
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    held = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_MODULO)) == HELD_REST
    rows = lean(docs).select(doc_id.alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows.filter(~F.col("held_out")).select("text"))
    words, n, v = model["words"], model["tokens"], model["distinct"]
    hot = words.filter(F.col("c") >= max(2.0, n / HOT_SHARE)).toArrow()
    shared = spark.sparkContext.broadcast({"words": hot["word"].combine_chunks().cast(pa.large_binary()), "gain": np.log10(hot["c"].to_numpy() + 1.0), "lp": hot["lp"].to_numpy()})
    pairs = rows.mapInArrow(_score_docs(shared), f"uid long, word binary, n long, sums {_SUMS}")
    met = pairs.join(words, "word", "left").select("uid", "word", "n", "sums", "c", "lp")
    filled = met.mapInArrow(_fill(model["pieces"], model["log_p"]), f"uid long, sums {_SUMS}, known long, base double, lp double")
    each = lambda name, kind: F.sum(F.coalesce(F.col(f"sums.{name}"), F.lit(0).cast(kind)))
    totals = filled.groupBy("uid").agg(
        F.max("sums.doc_id").alias("doc_id"), F.bool_or("sums.held_out").alias("held_out"), F.max("sums.n_tokens").alias("n_tokens"),
        (F.sum("known") + each("known", "long")).alias("known"), (F.sum("base") + each("base", "double")).alias("base"), (F.sum("lp") + each("lp", "double")).alias("lp"),
    )
    ends = model["ends"]
    return totals.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        ((F.col("lp") + F.lit(model["end"])) / F.lit(math.log(10))).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
