"""Secret scans: base patterns, and a linear-chain conditional random field.

The field tags each word O (outside), B (secret begins) or I (inside). Scores
come from the word's shape (length, digits, case, hex, signs, changes between
kinds of signs), the kinds of the two words before and the one after (key word,
assignment sign, other), which words stand before and after (their letters,
hashed to ``IDENTITIES`` numbers), features of the whole file (share of digits
and of code signs), and label transitions. It is trained by gradient ascent on exact
log-likelihood (forward-backward): background words come from at most
``SAMPLE_ROWS`` documents, labels from the base patterns in them and from secrets
that are generated and planted among them.

Decoding is Viterbi over whole documents. A document in which no word could pay
for leaving O, whatever the path, is O throughout by a bound on path scores, and
needs no recursion; all others are decoded in full.

Texts are scanned whole. The base stays: tagged spans that touch a base span
are left out, others are added as kind ``crf``.

Defined cases: null counts as empty; documents without spans have the digest of
the empty string; null ids and repeated rows are scanned one by one; an empty
table gives an empty result (the field is then trained on generated lines only).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffer_of, chunks, lean, lowered, read, tidied

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 20_000
KINDS = ("assign", "access", "hex", "crf")
O, B, I = 0, 1, 2  # noqa: E741

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What a text must hold, in lower case, before ASSIGN is tried.
KEYS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; the flags skip patterns that are known not to occur."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# ---- features -------------------------------------------------------------

_CLASS = np.full(256, 4, np.int64)  # letters of other scripts count as letters
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
for _c in range(128):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3
_HEX = np.zeros(256, np.int64)
_HEX[list(b"0123456789abcdefABCDEF")] = 1
_JOINTS = np.zeros(256, np.int64)
_JOINTS[list(b"_-+/=.")] = 1
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])
_CODE = np.zeros(256, np.int64)
_CODE[list(b"={}();<>[]\"")] = 1

#: Number of values of each shape feature.
SHAPES = (10, 6, 4, 2, 4, 7, 4, 10 * 6 * 4)
NEARS = 6  # none, other, assignment sign alone, key word, key word with sign, ends with sign
FILES = (4, 3)
#: Hashed identities of a neighbour; 0 is none.
IDENTITIES = 256


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64 if values.dtype == np.uint64 else np.int64), np.cumsum(values)])
    return total[end] - total[start]


def shape_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features by word, kind of the word as a neighbour)."""
    data, offsets = buffer_of(words)
    start, end = offsets[:-1], offsets[1:]
    size = np.maximum(end - start, 1)
    kind = _CLASS[data]
    digits, upper, lower, signs = (_sums(kind == k, start, end) for k in range(4))
    change = np.zeros(len(data), np.int64)
    if len(data):
        own = np.where(kind == 4, 2, kind)  # an accent inside a word is no change
        change[1:] = (own[1:] != own[:-1]) & (own[1:] != 3) & (own[:-1] != 3)
        inner = offsets[:-1][offsets[:-1] < len(data)]
        change[inner] = 0
    length = np.searchsorted(_LENGTHS, size, "right")
    digit = np.where(digits == 0, 0, np.where(digits == size, 5, 1 + np.minimum(3, 4 * digits // size)))
    case = (upper > 1) + 2 * (lower > 0)
    hexed = ((_sums(_HEX[data], start, end) == size) & (digits > 0)).astype(np.int64)
    joints = np.minimum(3, _sums(_JOINTS[data], start, end))
    changes = np.searchsorted([1, 2, 3, 5, 8, 12], _sums(change, start, end), "right")
    # Mostly signs, and an at sign as in addresses.
    heavy = (2 * signs > size) + 2 * (_sums(data == 64, start, end) > 0)
    features = np.stack([length, digit, case, hexed, joints, changes, heavy, (length * 6 + digit) * 4 + case], axis=1)
    low = pc.ascii_lower(words.cast(pa.large_string())) if len(words) else pa.array([], pa.large_string())
    key = np.zeros(len(words), bool)
    for k in ("password", "passwd", "secret", "token", "key", "credential", "auth", "pwd"):
        key |= pc.match_substring(low, k).to_numpy(zero_copy_only=False)
    sign = pc.match_substring_regex(low, r"[:=]['\"]?$").to_numpy(zero_copy_only=False)
    alone = sign & (size <= 2)
    near = np.where(key & sign, 4, np.where(key & (size <= 24), 3, np.where(alone, 2, np.where(sign, 5, 1))))
    return features, near


def identities(words: pa.Array) -> np.ndarray:
    """1 to IDENTITIES of each word: a hash of its letters in lower case, in order."""
    data, offsets = buffer_of(words)
    low = lowered(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    # Place of each letter among its word's letters.
    upto = np.concatenate([[0], np.cumsum(letter)])
    place = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(place.max(initial=0))), np.uint64(0xD1342543DE82EF95))]))
        key = _sums(np.where(letter, (low.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0)).astype(np.uint64), offsets[:-1], offsets[1:])
        return 1 + ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % IDENTITIES


def file_sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(bytes, digits, code signs) of each text."""
    return np.stack([np.diff(offsets), _sums(_CLASS[data] == 0, offsets[:-1], offsets[1:]), _sums(_CODE[data], offsets[:-1], offsets[1:])], axis=1)


def file_features(sums: np.ndarray) -> np.ndarray:
    size = np.maximum(sums[:, 0], 1)
    return np.stack([np.searchsorted([0.005, 0.02, 0.1], sums[:, 1] / size, "right"), np.searchsorted([0.005, 0.05], sums[:, 2] / size, "right")], axis=1)


_AT = np.cumsum([0, *SHAPES, NEARS, NEARS, NEARS, *FILES, IDENTITIES + 1, IDENTITIES + 1])
WIDTH = int(_AT[-1])


def _neighbours(near: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of the words one and two before and one after, 0 outside the document."""
    one, two, after = (np.zeros(len(near), np.int64) for _ in range(3))
    one[1:] = np.where(doc[1:] == doc[:-1], near[:-1], 0)
    two[2:] = np.where(doc[2:] == doc[:-2], near[:-2], 0)
    after[:-1] = np.where(doc[1:] == doc[:-1], near[1:], 0)
    return one, two, after


class Field:
    """Weights (features x labels) and transitions (from, to)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        inner = moves[1:, 1:].max()
        into, out = moves[O, 1:].max(), moves[1:, O].max()
        stay = moves[O, O]
        #: No stretch outside O gains more by transitions than this for each of its words.
        self.slack = max(0.0, into + out - 2 * stay, inner - stay, out - stay, into - stay, inner)

    def emissions(self, distinct: pa.Array, number: np.ndarray, doc: np.ndarray, files: np.ndarray) -> np.ndarray:
        features, near = shape_features(distinct)
        w = self.weights
        own = sum(w[_AT[i] + features[:, i]] for i in range(len(SHAPES))) if len(features) else np.zeros((0, 3))
        one, two, after = _neighbours(near[number], doc)
        n = len(SHAPES)
        file = w[_AT[n + 3] + files[:, 0]] + w[_AT[n + 4] + files[:, 1]]
        before_id, _, after_id = _neighbours(identities(distinct)[number], doc)
        return own[number] + w[_AT[n] + one] + w[_AT[n + 1] + two] + w[_AT[n + 2] + after] + file[doc] + w[_AT[n + 5] + before_id] + w[_AT[n + 6] + after_id]

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best labels of one document."""
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        rows = e.tolist()
        a, b, c = rows[0]
        back = []
        for x, y, z in rows[1:]:
            to_o = max((a + oo, 0), (b + bo, 1), (c + io, 2))
            to_b = max((a + ob, 0), (b + bb, 1), (c + ib, 2))
            to_i = max((a + oi, 0), (b + bi, 1), (c + ii, 2))
            a, b, c = to_o[0] + x, to_b[0] + y, to_i[0] + z
            back.append((to_o[1], to_b[1], to_i[1]))
        at = max((a, 0), (b, 1), (c, 2))[1]
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return path[::-1]

    def tag(self, words: Words) -> dict[int, list[int]]:
        """Labels of each document that isn't O throughout by the bound."""
        number, distinct = words.encoded()
        e = self.emissions(distinct, number, words.doc, file_features(file_sums(words.data, words.offsets)))
        hot = e[:, 1:].max(axis=1) - e[:, 0] + self.slack >= 0 if len(e) else np.zeros(0, bool)
        return {d: self.viterbi(e[words.first[d] : words.first[d + 1]]) for d in np.unique(words.doc[hot]).tolist()}


# ---- training -------------------------------------------------------------

WINDOW, PLANTS, STEPS, RATE, RIDGE = 24, 2500, 160, 0.15, 2e-4
#: Identities are many and each is rare; their weights are held down more.
IDENTITY_RIDGE = 0.05
#: A tagged stretch of fewer signs is no secret.
LEAST_CHARS = 8


def _invent(rng: np.random.Generator) -> str:
    """A secret as one or more words."""
    pick = lambda signs, n: "".join(rng.choice(list(signs), n))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kind = int(rng.integers(7))
    n = int(rng.integers(20, 44))
    body = [
        lambda: pick("0123456789abcdef", n),
        lambda: "AKIA" + pick(upper + digit, 16),
        lambda: pick(upper + lower + digit, n),
        lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(upper + lower + digit, n),
        lambda: pick(upper + lower + digit + "_-", 20) + "." + pick(upper + lower + digit + "_-", 40) + "." + pick(upper + lower + digit, 30),
        lambda: pick(upper + lower + digit + "+/", n) + "==",
        lambda: pick(lower, 5) + pick(digit, 4) + pick("!#_-", 1) + pick(upper, 4) + pick(digit, 3),
    ][kind]()
    if kind == 6 or rng.random() < 0.4:
        key = rng.choice(["password", "token", "secret", "api_key", "auth", "client_secret", "passwd"])
        form = int(rng.integers(4))
        quote = rng.choice(["", '"', "'"])
        return [f"{key}={quote}{body}{quote}", f"{key}: {body}", f"{key} = {quote}{body}{quote}", f"{key}:{body}"][form]
    return body


def training_lines(texts: list[str], seed: int = 3) -> tuple[list[str], list[list[tuple[int, int]]], np.ndarray]:
    """Lines of about WINDOW words, the spans of secrets in each, and the sums of the whole files that they stand in, secret included."""
    rng = np.random.default_rng(seed)
    held = [t for t in texts if len(t.split()) >= 4] or ["the part was drawn in 2019 by hand and then +49 151 2345 for 4711 pieces (see page 12) at info@example.org"]
    pool = [t.split() for t in held]
    sums = file_sums(*buffer_of(pa.array(held, pa.string())))
    lines, spans, files = [], [], []
    for n in range(PLANTS):
        source = int(rng.integers(len(pool)))
        words, added = pool[source], ""
        at = int(rng.integers(max(1, len(words) - WINDOW)))
        own = words[at : at + WINDOW]
        marks = []
        if n % 2 == 0:
            place = int(rng.integers(len(own) + 1))
            secret = added = _invent(rng)
            before = " ".join(own[:place])
            line = " ".join([*own[:place], secret, *own[place:]])
            start = len(before) + (1 if before else 0)
            marks.append((start, start + len(secret)))
        else:
            line = " ".join(own)
        marks += [(s, e) for s, _, e in base_spans(line) if not any(s < y and x < e for x, y in marks)]
        lines.append(line)
        spans.append(sorted(marks))
        files.append(sums[source] + file_sums(*buffer_of(pa.array([added])))[0])
    return lines, spans, np.array(files)


def _design(lines: list[str], sums: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words and active feature numbers (words x active)."""
    words = Words(*buffer_of(pa.array(lines, pa.string())))
    number, distinct = words.encoded()
    features, near = shape_features(distinct)
    one, two, after = _neighbours(near[number], words.doc)
    files = file_features(sums)[words.doc]
    before_id, _, after_id = _neighbours(identities(distinct)[number], words.doc)
    n = len(SHAPES)
    columns = [*(_AT[i] + features[number, i] for i in range(n)), _AT[n] + one, _AT[n + 1] + two, _AT[n + 2] + after, _AT[n + 3] + files[:, 0], _AT[n + 4] + files[:, 1], _AT[n + 5] + before_id, _AT[n + 6] + after_id]
    return words, np.stack(columns, axis=1)


def _labels(words: Words, lines: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    gold = np.zeros(len(words.start), np.int64)
    for d, marks in enumerate(spans):
        for s, e in marks:
            a, b = len(lines[d][:s].encode()), len(lines[d][:e].encode())
            base = words.offsets[d]
            own = [i for i in range(words.first[d], words.first[d + 1]) if words.start[i] - base < b and words.end[i] - base > a]
            gold[own] = I
            gold[own[:1]] = B
    return gold


def train(texts: list[str], seed: int = 3) -> Field:
    """Fit by Adam on the exact log-likelihood; all sequences advance together."""
    lines, spans, files = training_lines(texts, seed)
    words, active = _design(lines, files)
    ridge = [np.full((WIDTH, 1), RIDGE), np.full((3, 1), RIDGE)]
    ridge[0][_AT[len(SHAPES) + 5] :] = IDENTITY_RIDGE
    gold = _labels(words, lines, spans)
    rows, longest = words.rows, int(words.count.max())
    place = np.arange(len(gold)) - words.first[words.doc]
    index = np.full((rows, longest), -1)
    index[words.doc, place] = np.arange(len(gold))
    real = index >= 0
    truth = np.where(real, gold[index], 0)
    theta = [np.zeros((WIDTH, 3)), np.zeros((3, 3))]
    seen = [np.zeros((WIDTH, 3)), np.zeros((3, 3))]
    np.add.at(seen[0], (active, gold[:, None]), 1.0)
    pair = real[:, 1:] & real[:, :-1]
    np.add.at(seen[1], (truth[:, :-1][pair], truth[:, 1:][pair]), 1.0)
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    # Words with the same features share one row of sums.
    kinds, kind_of = np.unique(active, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for step in range(1, STEPS + 1):
        weights, moves = theta
        flat = weights[kinds].sum(axis=1)[kind_of]
        e = np.where(real[..., None], flat[index], 0.0)
        alpha, beta = np.zeros((longest, rows, 3)), np.zeros((longest, rows, 3))
        alpha[0] = e[:, 0]
        for t in range(1, longest):
            alpha[t] = np.where(real[:, t, None], soft(alpha[t - 1][:, :, None] + moves, 1) + e[:, t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(real[:, t + 1, None], soft(moves[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2), 0.0)
        z = soft(alpha[-1], 1)
        p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        hoped = [np.zeros_like(weights), np.zeros_like(moves)]
        posterior = p[words.doc, place]
        for c in range(3):
            mass = np.bincount(kind_of, weights=posterior[:, c], minlength=len(kinds))
            hoped[0][:, c] = np.bincount(kinds.ravel(), weights=np.repeat(mass, kinds.shape[1]), minlength=WIDTH)
        for t in range(1, longest):
            both = alpha[t - 1][:, :, None] + moves + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]
            hoped[1] += (np.exp(both) * real[:, t, None, None]).sum(axis=0)
        for k in range(2):
            grad = (seen[k] - hoped[k]) / rows - ridge[k] * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            theta[k] = theta[k] + RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(*theta)


# ---- scanning -------------------------------------------------------------


def _trim(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """Without quotes and closing signs around a tagged stretch."""
    while start < end and raw[start : start + 1] in b"\"'(<[{":
        start += 1
    while end > start and raw[end - 1 : end] in b"\"',;.)>]}":
        end -= 1
    return start, end


def scan_texts(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text in code points; kind as in KINDS."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    has = np.zeros(len(texts), bool)
    for key in KEYS:
        has |= pc.match_substring(low, key).to_numpy(zero_copy_only=False)
    access = pc.match_substring(low, "akia").to_numpy(zero_copy_only=False)
    data, offsets = buffer_of(texts)
    run = np.zeros(len(data), bool)
    hexed = (_HEX[data] == 1) & ~((data >= 65) & (data <= 70))
    if len(data) >= 16:
        total = np.concatenate([[0], np.cumsum(hexed)])
        run[: len(data) - 15] = total[16:] - total[:-16] == 16
    has_hex = np.zeros(len(texts), bool)
    hits = np.searchsorted(offsets, np.flatnonzero(run), "right") - 1
    has_hex[hits] = True
    tagged = field.tag(words := Words(data, offsets))
    out = []
    for d in range(len(texts)):
        if not (has[d] or access[d] or has_hex[d] or d in tagged):
            out.append([])
            continue
        raw = data[offsets[d] : offsets[d + 1]].tobytes()
        text = raw.decode()
        found = base_spans(text, has[d], access[d], has_hex[d])
        base = list(found)
        for i, label in enumerate(path := tagged.get(d, [])):
            if label == O or (label == I and i and path[i - 1] != O):
                continue
            j = i + 1
            while j < len(path) and path[j] == I:
                j += 1
            first = words.first[d]
            a, b = _trim(raw, int(words.start[first + i] - offsets[d]), int(words.end[first + j - 1] - offsets[d]))
            s, e = len(raw[:a].decode()), len(raw[:b].decode())
            if e - s >= LEAST_CHARS and not any(s < y and x < e for x, _, y in base):
                found.append((s, 3, e))
        out.append(sorted(found))
    return out


def _run(field: Field):
    @tidied
    def run(batches):
        shown = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = scan_texts(part.column(1), field)
                counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(4)]
                digest = [hashlib.sha256(shown([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digest), pa.array([shown(s) for s in found]), pa.array(counts[3], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return run


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> list[str]:
    """Texts of at most ``rows`` documents of at most ``longest`` bytes: those with the smallest hashes of id and text.

    The number of documents gives a threshold under which about four times as
    many hashes lie; only texts below it are ordered, wherever they stand, so the
    sample is the same however the table is split.
    """
    share = min(1.0, 4 * rows / max(1, docs.count()))
    draw = F.xxhash64("doc_id", "text")
    low, span = -(1 << 63), 1 << 64
    near = docs.filter(F.octet_length("text").between(1, longest)).withColumn("draw", draw).filter(F.col("draw") <= F.lit(min((1 << 63) - 1, low + int(share * span))))
    return [r["text"] for r in near.select("draw", "text").orderBy("draw", "text").limit(rows).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row of counts and spans for each document."""
    rows = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    field = train(sample(rows, sample_rows))
    return rows.mapInArrow(_run(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
