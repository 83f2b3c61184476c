"""BPE encoding and decoding with a given vocabulary file, by tree concatenation.

Words between ASCII white space are encoded on their own, which equals encoding
the whole text: the vocabulary's normaliser and splitter never look across white
space. Distinct words of a worker go through the tokenizers library once.

A word above ``leaf_chars`` (text without a break) is normalised whole and cut in
halves until pieces fit; pieces are rows that any task may encode. Then halves
are joined up the tree, whose lower levels are rows of any task too: the text around each cut is encoded again in a window
that doubles until it agrees with both sides, and the window replaces the tokens
between the points of agreement. Two encodings agree at a byte position if

- both start a split there: splitting reads left to right without memory, so
  all that follows is the same; or
- both hold the same token there, inside one run of letters or one of other
  signs, away from any cut: BPE output is right exactly if every two adjacent
  tokens are, and each adjacent pair of the joined list stands in an encoding.

A window that reaches both ends is a plain encoding, so the loop always ends.

Defined cases: null counts as empty and gives no tokens; the vocabulary's
special tokens in a text become their ids, as the library does by default;
repeated rows and null ids are encoded one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffer_of, chunks, lean, lowered, numbered, read, row_number_base, tidied

VOCABULARY = "word_bpe_49k.json"
LEAF_CHARS = 4096
FIRST_WINDOW = 16
#: Leaves, then nodes, that one task joins before they move on.
FAN_IN = 64
#: Fixed values of the vocabulary file: where a file states just these, its splits inside plain words are known beforehand.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: A word between other words in one call of the library; words that hold it go alone.
SEPARATOR = "\x01"
WORDS_AT_ONCE = 500
#: Bound of a worker's table of words; WORD_BYTES is what an entry takes beside its signs.
CACHE_BYTES = 32 << 20
WORD_BYTES = 120
#: Bytes of text split at once; index arrays take some thirty times as much.
SPLIT_BYTES = 512 << 10

_local = threading.local()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_known(coder) -> bool:
    """Asked of the open vocabulary: its file, read as JSON, would take more than the vocabulary itself."""
    normalizer, splitter = (json.loads(x.__getstate__()) if x else {} for x in (coder.normalizer, coder.pre_tokenizer))
    split = (splitter.get("pretokenizers") or [{}])[0]
    return normalizer.get("normalizers") == NORMALIZERS and split.get("pattern") == {"Regex": SPLITS}


#: 0 white space, 1 letter, 2 digit, 3 other sign of printable ASCII, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1


class Coder:
    """A vocabulary file opened for whole words and for pieces of normalised text.

    Words seen before are held as numbers into one flat array of ids, for the
    life of the worker; above ``CACHE_BYTES`` the table starts anew. The
    encoders share one vocabulary in memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # A task has one core; threads of the library would each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        if self._ids(" a  b ") != self._ids("a") + self._ids("b"):
            raise ValueError(f"{path} encodes white space; words cannot be encoded on their own")
        self.normalizer = self.whole.normalizer
        # Special tokens are cut out beforehand; a vocabulary that adds others is opened again.
        added = self.whole.get_added_tokens_decoder().values()
        self.piece = Tokenizer(self.whole.model) if all(t.special for t in added) else Tokenizer.from_file(path)
        self.piece.no_truncation()
        self.piece.no_padding()
        self.piece.pre_tokenizer = self.whole.pre_tokenizer
        self.piece.normalizer = normalizers.Sequence([])
        self.piece.encode_special_tokens = True
        self.size = self.whole.get_vocab_size()
        self.token = [self.whole.id_to_token(i) or "" for i in range(self.size)]
        # Token i followed by a blank; token i alone is number size + i.
        self.shown = pa.array([f"{t} ".encode() for t in self.token] + [t.encode() for t in self.token], pa.large_binary())
        self.length = np.array([len(t.removesuffix("</w>")) for t in self.token], np.int64)
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        alone = self._ids(SEPARATOR)
        self.separator = alone[0] if len(alone) == 1 and self._ids(f"a {SEPARATOR} a") == self._ids("a") + alone + self._ids("a") else None
        self.parted = _splits_known(self.whole)
        # One split each: no normaliser, no pattern to run.
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.array([t.endswith("</w>") for t in self.token])
        self.odd = np.zeros(256, bool)
        self.odd[[ord("'"), *(t.encode()[0] for t in self.special)]] = True
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Empty the table of words."""
        self.number: dict[bytes, int] = {}
        self.flat, self.at, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros((1 << 15) + 1, np.int64), 0

    def _new(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each word): many words to a call, told apart by where they end."""
        letters = np.fromiter((w.isalpha() and w.islower() for w in found), bool, len(found)) & self.parted
        marks = [m.encode() for m in (SEPARATOR, *self.special)] if self.separator is not None else [b""]
        own = ~letters
        own[own] = [any(m in found[i] for m in marks) for i in np.flatnonzero(own)]
        counts, parts, order = np.zeros(len(found), np.int64), [], []
        for chosen, coder, mark in ((letters, self.letters, None), (~letters & ~own, self.whole, SEPARATOR), (own, self.whole, "")):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            words = [found[i].decode("utf-8", "replace") for i in at]
            if mark == "":
                texts = words
            else:
                between = f" {mark} " if mark else " "
                texts = [between.join([*words[i : i + WORDS_AT_ONCE], ""]) for i in range(0, len(words), WORDS_AT_ONCE)]
            coded = [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate([np.array(x, np.uint32) for x in coded])
            if mark is None:
                counts[at] = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
            elif mark:
                ends = np.flatnonzero(flat == self.separator)
                counts[at] = np.diff(ends, prepend=-1) - 1
                flat = np.delete(flat, ends)
            else:
                counts[at] = [len(x) for x in coded]
            parts.append(flat)
            order.append(at)
        # Words of each kind, put back in the order they came in.
        order, flat = np.concatenate(order), np.concatenate(parts)
        size = counts[order]
        place = np.empty(len(found), np.int64)
        place[order] = np.cumsum(size) - size
        return flat[np.repeat(place - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))], counts

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Numbers of the words in the table, to which new words are added."""
        known = self.number
        new = [w for w in found if w not in known]
        if new and self.bytes > CACHE_BYTES:
            self.forget()
            known, new = self.number, list(dict.fromkeys(found))
        if new:
            flat, count = self._new(new)
            had, used = len(known), int(self.at[len(known)])
            while used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while had + len(new) >= len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.flat[used : used + len(flat)] = flat
            self.at[had + 1 : had + len(new) + 1] = used + np.cumsum(count)
            known.update(zip(new, range(had, had + len(new)), strict=True))
            self.bytes += sum(map(len, new)) + WORD_BYTES * len(new) + 4 * len(flat)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, place of each word's first and, at last, the number of all)."""
        start = self.at[number]
        count = self.at[number + 1] - start
        place = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.repeat(start - place[:-1], count) + np.arange(place[-1])], place

    def words(self, found: list[bytes]) -> np.ndarray:
        """Ids of words that follow each other."""
        return self.gather(self.numbers(found))[0] if found else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray, place: np.ndarray) -> pa.Array:
        """Texts of the ids from each place to the next: tokens joined by blanks."""
        at = ids.astype(np.int64)
        at[place[1:][place[1:] > place[:-1]] - 1] += self.size
        told = self.shown.take(pa.array(at))
        ends = np.frombuffer(told.buffers()[1], np.int64)[told.offset : told.offset + len(at) + 1][place]
        if ends[-1] >= 1 << 31:
            raise ValueError("the decoded text exceeds 2 GB, the bound of a value")
        return pa.StringArray.from_buffers(len(place) - 1, pa.py_buffer(ends.astype(np.int32)), told.buffers()[2])

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(numbers of the parts of all texts, distinct parts, each text's first part and, at last, the number of all).

        Parts are words. Words of printable ASCII and of the letters U+00C0 to
        U+024F are split further where the vocabulary is known to split: into
        runs of letters, single digits and runs of other signs, and A-Z become
        lower case; so fewer of them differ. Words with an apostrophe, which may
        start a contraction, or with a sign that starts a special token, stay whole.
        """
        words = Words(data, offsets)
        if not self.parted or not len(words.start):
            number, distinct = words.encoded()
            return number, distinct, words.first
        kind = _KIND[data]
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        letter = np.flatnonzero((pair >= 0xC380) & (pair <= 0xC98F) & ((pair & 0xC0) == 0x80) & (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0))
        kind[letter] = kind[letter + 1] = 1
        kind[self.odd[data]] = 4
        whole = np.bitwise_or.reduceat(kind == 4, words.start)
        whole = np.repeat(whole, words.end - words.start)
        solid = np.flatnonzero(words.solid)
        kind, plain = kind[solid], lowered(data[solid])
        plain[whole] = data[solid[whole]]
        head = np.ones(len(solid), bool)
        head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        head[whole] = False
        size = words.end - words.start
        head[np.cumsum(size) - size] = True
        start = np.flatnonzero(head)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(solid)).astype(np.int64)), pa.py_buffer(plain)])
        found = texts.dictionary_encode()
        first = np.searchsorted(start, np.searchsorted(solid, offsets))
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, first

    def normalize(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def split_special(self, text: str) -> list[tuple[bool, str]]:
        """(is special, text) pieces, leftmost first."""
        import re

        pattern = "|".join(map(re.escape, self.special))
        if not pattern:
            return [(False, text)]
        return [(x in self.special, x) for x in re.split(f"({pattern})", text) if x]

    def leaf(self, data: bytes) -> Piece:
        """Tokens of a piece of normalised text with byte positions."""
        text = data.decode()
        found = self.piece.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        if not len(ids):
            return Piece(data, ids, ids.copy(), ids.copy(), np.zeros(0, bool))
        at = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.fromiter((len(c.encode()) for c in text), np.int64, len(text)), out=at[1:])
        group = np.array(found.word_ids, np.int64)
        head = np.concatenate([[True], group[1:] != group[:-1]])
        size = self.length[ids]
        before = np.cumsum(size) - size
        first = np.flatnonzero(head)
        base = at[np.array([found.offsets[i][0] for i in first])] - before[first]
        start = before + np.repeat(base, np.diff(np.concatenate([first, [len(ids)]])))
        return Piece(data, ids, start, start + size, head)


class Piece:
    """Encoded text: token ids, byte positions, and where a split starts."""

    def __init__(self, data: bytes, ids: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray):
        self.data, self.ids, self.start, self.end, self.head = data, ids, start, end, head
        self.first = np.flatnonzero(head)
        self.kinds: dict[int, bool | None] = {}

    def part(self, a: int, b: int, shift: int) -> tuple[np.ndarray, ...]:
        return self.ids[a:b], self.start[a:b] + shift, self.end[a:b] + shift, self.head[a:b]

    def kind(self, i: int) -> bool | None:
        """Of token i's split: all letters (True), no letter (False), or neither, or with numbers (None)."""
        n = int(np.searchsorted(self.first, i, "right")) - 1
        if n not in self.kinds:
            a, b = self.first[n], self.first[n + 1] if n + 1 < len(self.first) else len(self.ids)
            text = self.data[self.start[a] : self.end[b - 1]].decode("utf-8", "replace")
            letters = text.isalpha()
            pure = (letters or not any(map(str.isalpha, text))) and not any(map(str.isnumeric, text))
            self.kinds[n] = letters if pure else None
        return self.kinds[n]


def _meet(side: Piece, shift: int, window: Piece, at: int, low: int, high: int, from_left: bool) -> tuple[int, int] | None:
    """(index in side, index in window) of a point where both agree. at: the window's place in the text; positions in (low, high) may be used."""
    a, b = np.searchsorted(side.start, [low - shift, high - shift])
    where = {p + shift: i for i, p in enumerate(side.start[a:b].tolist(), int(a))}
    order = range(len(window.ids)) if from_left else range(len(window.ids) - 1, -1, -1)
    for j in order:
        p = int(window.start[j]) + at
        i = where.get(p)
        if i is None:
            continue
        if side.head[i] and window.head[j]:
            return i, j
        last = j == len(window.ids) - 1 or i == len(side.ids) - 1
        if side.ids[i] == window.ids[j] and not last and low < p:
            kind = side.kind(i)
            if kind is not None and kind == window.kind(j):
                return i, j
    return None


def join(coder: Coder, left: Piece, right: Piece, first_window: int = FIRST_WINDOW) -> Piece:
    """The encoding of left's text followed by right's."""
    data, cut_at = left.data + right.data, len(left.data)
    k = first_window
    while True:
        a = 0 if k >= len(left.ids) else int(left.start[len(left.ids) - k])
        b = len(data) if k >= len(right.ids) else int(right.end[k - 1]) + cut_at
        while a > 0 and (data[a] & 0xC0) == 0x80:
            a -= 1
        while b < len(data) and (data[b] & 0xC0) == 0x80:
            b += 1
        window = coder.leaf(data[a:b])
        i, j = (0, 0) if a == 0 else _meet(left, 0, window, a, a, cut_at, True) or (None, None)
        n, m = (len(right.ids), len(window.ids)) if b == len(data) else _meet(right, cut_at, window, a, cut_at, b, False) or (None, None)
        if i is not None and n is not None and j <= m:
            parts = zip(left.part(0, i, 0), window.part(j, m, a), right.part(n, len(right.ids), cut_at), strict=True)
            return Piece(data, *(np.concatenate(p) for p in parts))
        k *= 2


def halves(text: str, leaf_chars: int) -> list[str]:
    """Leaves of the tree, left to right: halves until each has at most leaf_chars."""
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf_chars) + halves(text[middle:], leaf_chars)


def concatenate(coder: Coder, leaves: list[Piece]) -> Piece:
    """Join neighbours level by level."""
    while len(leaves) > 1:
        leaves = [join(coder, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _coder(path: str) -> Coder:
    held = getattr(_local, "coders", None)
    if held is None:
        held = _local.coders = {}
    if path not in held:
        held[path] = Coder(path)
    return held[path]


def _encode(path: str):
    """(doc_id, text, others) to (doc_id, ids, decoded, others): texts without a long word."""

    @tidied
    def run(batches):
        coder = _coder(path)
        for batch in batches:
            for part in chunks(batch, "text", SPLIT_BYTES):
                number, distinct, first = coder.parts(*buffer_of(part.column(1)))
                ids, place = coder.gather(coder.numbers(distinct.to_pylist())[number])
                place = place[first]
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(4 * place), pa.py_buffer(ids.astype("<u4", copy=False))])
                yield pa.RecordBatch.from_arrays([part.column(0), packed.cast(pa.binary()), coder.decode(ids, place), *part.columns[2:]], names=["doc_id", "ids", "decoded", *part.schema.names[2:]])

    return run


def _pieces(path: str, leaf_chars: int):
    """Texts with a long word (doc_id, text, uid if they are numbered) to rows (uid, unit, leaf, doc_id, whole, text)."""

    @tidied
    def run(batches):
        coder, uid = _coder(path), row_number_base()
        for batch in batches:
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else range(uid, uid + batch.num_rows)
            uid += batch.num_rows
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, strict=True):
                rows, unit, short = [], 0, []

                def flush():
                    nonlocal unit, short
                    if short:
                        rows.append((n, unit, 0, key, True, b" ".join(short).decode()))
                        unit, short = unit + 1, []

                for word in text.encode().split():
                    if len(word) <= leaf_chars:
                        short.append(word)
                        continue
                    flush()
                    for special, piece in coder.split_special(word.decode()):
                        if special:
                            rows.append((n, unit, 0, key, True, piece))
                        else:
                            rows.extend((n, unit, place, key, False, leaf) for place, leaf in enumerate(halves(coder.normalize(piece), leaf_chars)))
                        unit += 1
                flush()
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["uid", "unit", "leaf", "doc_id", "whole", "text"])

    return run


def _leaves(path: str):
    """Encode pieces; a leaf keeps its text and positions, a plain unit only its ids."""

    @tidied
    def run(batches):
        coder = _coder(path)
        for batch in batches:
            ids, start, head = [], [], []
            for whole, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if whole:
                    ids.append(coder.words(text.encode().split()).astype(np.int64))
                    start.append(None)
                    head.append(None)
                else:
                    p = coder.leaf(text.encode())
                    ids.append(p.ids)
                    start.append(p.start)
                    head.append(p.head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(start, pa.list_(pa.int64())), pa.array(head, pa.list_(pa.bool_()))], names=[*batch.schema.names, "ids", "start", "head"])

    return run


def _piece(coder: Coder, text: str, ids, start, head) -> Piece:
    ids, start = np.asarray(ids, np.int64), np.asarray(start, np.int64)
    return Piece(text.encode(), ids, start, start + coder.length[ids], np.asarray(head, bool))


def _joined(path: str):
    """Neighbouring nodes of one unit to the node above them, a row like theirs; plain units stay."""

    def run(frame):
        import pandas as pd

        if len(frame) > 1:
            coder = _coder(path)
            frame = frame.sort_values("leaf")
            whole = concatenate(coder, [_piece(coder, r.text, r.ids, r.start, r.head) for r in frame.itertuples()])
            frame = frame.head(1).assign(text=[whole.data.decode()], ids=pd.Series([whole.ids], frame.index[:1]), start=pd.Series([whole.start], frame.index[:1]), head=pd.Series([whole.head], frame.index[:1]))
        return frame.assign(leaf=frame["leaf"] // FAN_IN)

    return run


def _assemble(path: str):
    """What is left of each text, joined to one row."""

    def run(frame):
        import pandas as pd

        coder, out = _coder(path), []
        for _, unit in frame.sort_values(["unit", "leaf"]).groupby("unit", sort=True):
            if len(unit) == 1:
                out.append(np.asarray(unit["ids"].iloc[0], np.int64))
            else:
                out.append(concatenate(coder, [_piece(coder, r.text, r.ids, r.start, r.head) for r in unit.itertuples()]).ids)
        ids = np.concatenate(out) if out else np.zeros(0, np.int64)
        decoded = coder.decode(ids, np.array([0, len(ids)]))[0].as_py()
        return pd.DataFrame({"uid": [frame["uid"].iloc[0]], "doc_id": pd.array([frame["doc_id"].iloc[0]], "Int64"), "ids": [ids.astype("<u4").tobytes()], "decoded": [decoded]})

    return run


def encode(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32 bit), decoded for each row; ``whole``: and the row itself as a struct ``row``.

    A vocabulary that encodes white space (byte-level ones do) is refused.
    """
    path = vocabulary or vocabulary_path()
    own = [F.struct(*docs.columns).alias("row")] if whole else []
    narrow = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
    out = narrow.select("doc_id", F.lit(b"").alias("ids"), F.lit("").alias("decoded"), *(["row"] if whole else [])).schema
    long_word = F.col("text").rlike(rf"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{{{leaf_chars // 4 + 1}}}")
    plain = narrow.filter(~long_word).mapInArrow(_encode(path), out)
    held = numbered(narrow.filter(long_word), "uid") if whole else narrow.filter(long_word)
    pieces = held.drop("row").mapInArrow(_pieces(path, leaf_chars), "uid long, unit long, leaf long, doc_id long, whole boolean, text string")
    columns = "uid long, unit long, leaf long, doc_id long, whole boolean, text string, ids array<long>, start array<long>, head array<boolean>"
    nodes = pieces.repartition("uid", "unit", "leaf").mapInArrow(_leaves(path), columns)
    # Two levels of the tree, each spread by rows; the last task of a text joins nodes of FAN_IN ** 2 leaves.
    for _ in range(2):
        nodes = nodes.groupBy("uid", "unit", F.floor(F.col("leaf") / FAN_IN).alias("node")).applyInPandas(_joined(path), columns)
    joined = nodes.groupBy("uid").applyInPandas(_assemble(path), "uid long, doc_id long, ids binary, decoded string")
    if whole:
        joined = joined.join(held.select("uid", "row"), "uid")
    return plain.unionByName(joined.drop("uid"))


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(read(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
