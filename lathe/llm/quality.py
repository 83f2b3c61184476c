"""Quality rules by repetition coverage.

Words get exact numbers, so the hash of an n-gram is a rolling polynomial of
mixed word numbers. Equal hashes inside a document mark an n-gram as duplicated; each
such pair is compared word by word, so a collision cannot count. For each n the
measure is the share of word characters that lie inside duplicated n-grams
(each character once); for lines, the share inside repeated lines.

Short n-grams (up to ``SHORT`` words) are looked for within stretches of
``STRETCH`` words, in which a text is cut from its start: in clean prose the share
of any repeated word pair grows with the length of what is looked at, and would
else condemn every very long text. Longer n-grams and lines count over the whole
text.

Rules: a document goes if it has fewer than ``MIN_WORDS`` words, if over 30 % of
its words lie in repeated 8-word windows (these two are the base), or if a
coverage exceeds its bound in ``NGRAM_BOUNDS`` or ``LINE_BOUND``.

Defined cases: null and empty texts have no words and fail; very long texts are
handled whole (memory is about 60 bytes for each byte of the longest text);
repeated rows are measured one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffer_of, chunks, fresh, lean, read, tidied

#: Largest share of characters in duplicated n-grams, by n.
NGRAM_BOUNDS = {2: 0.60, 3: 0.45, 5: 0.35, 8: 0.30, 10: 0.30}
LINE_BOUND = 0.40
SHORT, STRETCH = 3, 4000
MIN_WORDS = 20
BASE_WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits, one to one."""
    x = (x + _STEP) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def duplicated(number: np.ndarray, doc: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """By n: mask of the words that lie in an n-gram found twice or more in their document.

    The hash of a window is a difference of running sums of code * BASE ** place,
    divided by BASE ** start (BASE is odd, so it has an inverse mod 2 ** 64). A
    longer n-gram can only repeat where its shorter start does, so each size
    looks at the hits of the size before.
    """
    words, out = len(number), {}
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, words - 1), _BASE)])) if words else np.zeros(0, np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, words - 1), _INVERSE)])) if words else np.zeros(0, np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(number.astype(np.uint64)) * power)])
        salt = _mix(doc.astype(np.uint64)) * _STEP
        at = np.arange(words)
        for n in sorted(sizes):
            at = at[at + n <= words]
            at = at[doc[at] == doc[at + n - 1]]
            key = _mix((upto[at + n] - upto[at]) * back[at] + salt[at])
            order = np.argsort(key)
            key, at = key[order], at[order]
            twin = np.flatnonzero(key[1:] == key[:-1])
            a, b = at[twin], at[twin + 1]
            same = doc[a] == doc[b]
            for j in range(n):
                same &= number[a + j] == number[b + j]
            if same.all():
                hit = np.zeros(words, bool)
                hit[a] = hit[b] = True
                at = np.flatnonzero(hit)
            else:  # a 64-bit collision: group the n-grams themselves
                rows = np.stack([doc[at], *(number[at + j] for j in range(n))], axis=1)
                _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
                at = np.sort(at[times[which.ravel()] > 1])
            edge = np.zeros(words + 1, np.int64)
            edge[at] += 1
            edge[at + n] -= 1
            out[n] = np.cumsum(edge[:-1]) > 0
    return out


def _lines(words: Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: lines with a word that repeat an earlier line, and the word characters in them."""
    data, offsets, rows = words.data, words.offsets, words.rows
    breaks = np.flatnonzero(data == 10)
    # A line ends at its break or at the end of its text; a text that ends where another starts has its own last line.
    ends = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(rows)])
    order = np.lexsort((ends, owner))
    ends, owner = ends[order], owner[order]
    starts = np.empty_like(ends)
    starts[1:] = np.where(owner[1:] == owner[:-1], ends[:-1] + 1, offsets[owner[1:]])
    if len(starts):
        starts[0] = offsets[owner[0]]
    full = np.concatenate([[0], np.cumsum(words.solid)])
    inside = np.concatenate([[0], np.cumsum(chars)])
    keep = full[ends] > full[starts]
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    span = np.zeros(len(data) + 1, np.int64)
    np.add.at(span, starts, 1)
    np.add.at(span, ends, -1)
    flat = np.cumsum(span)[:-1] > 0
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data[flat]))])
    number = text.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((np.arange(len(number)), number, owner))
    again = np.zeros(len(number), bool)
    if len(order) > 1:
        again[order[1:]] = (number[order[1:]] == number[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    times = np.bincount(owner[again], minlength=rows)
    held = np.bincount(owner[again], weights=(inside[ends] - inside[starts])[again], minlength=rows)
    return times.astype(np.int64), held


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of each text."""
    data, offsets = buffer_of(texts)
    words = Words(data, offsets)
    rows = words.rows
    chars = words.solid & ((data & 0xC0) != 0x80)
    upto = np.concatenate([[0], np.cumsum(chars)])
    word_chars = upto[words.end] - upto[words.start]
    by_row = lambda x: np.bincount(words.doc, weights=x, minlength=rows)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    number, _ = words.encoded()
    out = {"n_words": words.count, "word_chars": (upto[offsets[1:]] - upto[offsets[:-1]]).astype(np.int64), "n_symbols": (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)}
    out["n_dup_lines"], held = _lines(words, chars)
    total = np.maximum(out["word_chars"], 1)
    out["line_coverage"] = held / total
    sizes = {*NGRAM_BOUNDS, BASE_WINDOW}
    if rows and words.count.max() <= STRETCH:
        inside = duplicated(number, words.doc, tuple(sizes))
    else:
        parts = -(-words.count // STRETCH)
        place = np.arange(len(number)) - words.first[words.doc]
        stretch = (np.cumsum(parts) - parts)[words.doc] + place // STRETCH
        inside = duplicated(number, stretch, tuple(n for n in sizes if n <= SHORT)) | duplicated(number, words.doc, tuple(n for n in sizes if n > SHORT))
    out["n_repeat_words"] = by_row(inside[BASE_WINDOW]).astype(np.int64)
    for n in NGRAM_BOUNDS:
        out[f"coverage_{n}"] = by_row(inside[n] * word_chars) / total
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the measures."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    kept = ~failed & (m["line_coverage"] <= LINE_BOUND)
    for n, bound in NGRAM_BOUNDS.items():
        kept &= m[f"coverage_{n}"] <= bound
    return failed, kept


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SHARES = ("line_coverage", *(f"coverage_{n}" for n in NGRAM_BOUNDS))


@tidied
def _run(batches):
    for batch in batches:
        for part in chunks(batch, "_text"):
            m = measure(part.column(part.num_columns - 1))
            failed, kept = judge(m)
            columns = [*part.columns[:-1], *(pa.array(m[c], pa.int64()) for c in _LONGS), pa.array(failed), pa.array(kept), *(pa.array(m[c], pa.float64()) for c in _SHARES)]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *_LONGS, "base_failed", "kept", *_SHARES])


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and verdicts for each document."""
    narrow = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _LONGS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in _SHARES)
    return narrow.mapInArrow(_run, schema)


@tidied
def _keep(batches):
    for batch in batches:
        for part in chunks(batch, batch.schema.names[-1]):
            _, kept = judge(measure(part.column(part.num_columns - 1)))
            rest = part.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(rest.columns[:-1], names=rest.schema.names[:-1])


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; the text is read once."""
    return lean(docs).withColumn(fresh(docs, "whole_text"), F.col(text_col).cast("string")).mapInArrow(_keep, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"))
