"""Byte-level BPE, encoded and decoded column-wise.

A text is cut into pieces by the byte-level pattern (vectorised over code points), each distinct piece of a
batch is merged once, and ids are gathered by piece.  Merging keeps a segment tree over the ranks of adjacent
pairs: the root is the lowest rank at its leftmost place, and a merge is three point updates, each of
logarithmic cost.  Trees of many pieces of one size are one matrix, so a merge step runs over all pieces at
once; long pieces get a tree of their own.

Defined results: a null or empty text has no ids and decodes to the empty text; the special strings of the
tokenizer inside a text become their ids, as in the public library; rows are independent, so repeated rows
give repeated results; columns of the input are kept, and one of the same name as an output is replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .storage import read, small_batches

#: Pieces remembered by a worker, and the characters handled at once: both bound its memory.
CACHED_PIECES, SLICE = 800_000, 1 << 19
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_NEVER = np.int64(1 << 62)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, random 64-bit number of each code point)."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = _LETTER
        elif c == "N":
            kind[cp] = _NUMBER
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kind, np.random.default_rng(77).integers(0, 1 << 64, sys.maxunicode + 1, dtype=np.uint64)


def pieces(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts given as code points; every piece ends where the next begins.

    The pattern: 's 't 're 've 'm 'll 'd, then runs of letters, numbers or other characters with one blank
    before them if there is one, then white space that isn't followed by a character, then white space.
    """
    n = len(cps)
    kind = _classes()[0][cps]
    first = np.zeros(n + 3, bool)
    first[off[:-1]] = True
    first[n:] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    flag = np.zeros(n + 3, bool)
    flag[:n] = run
    begins = np.flatnonzero(run)
    if not len(begins):
        return begins
    ends = np.append(begins[1:], n)
    spaces = kind[begins] == _SPACE
    followed = spaces & ~first[ends]
    flag[ends[followed] - 1] = True
    solid = begins[~spaces]
    after = solid[(solid > 0) & ~first[solid]]
    flag[after[cps[after - 1] == 0x20]] = False
    ticks = begins[(cps[begins] == 0x27) & (ends - begins == 1) & flag[begins] & ~first[ends]]
    if len(ticks):
        c1 = cps[ticks + 1]
        there = ~first[ticks + 2]
        c2 = np.where(there, cps[np.minimum(ticks + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        flag[ticks[one | two] + 1] = False
        flag[ticks[one] + 2] = True
        flag[ticks[two] + 3] = True
    return np.flatnonzero(flag[:n])


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file of the public tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the rest from 256 on
        hidden = [b for b in range(256) if b not in set(shown)]
        char_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte_of = {c: b for b, c in char_of.items()}
        self.base = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values(), 0) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            table[i] = token.encode()
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NEVER)

    def merge(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raw])
        out: list = [None] * len(raw)
        width = 2
        while len(sizes) and width < 2 * max(2, int(sizes.max())):
            own = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            if width > 256:
                for i in own:
                    out[i] = self._one(raw[i])
            else:
                for k in range(0, len(own), max(1, (1 << 18) // width)):
                    part = own[k : k + max(1, (1 << 18) // width)]
                    for i, ids in zip(part, self._many([raw[i] for i in part], sizes[part], width)):
                        out[i] = ids
            width *= 2
        return [np.zeros(0, np.uint32) if x is None else x for x in out]

    def _many(self, raw: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        """One tree of ``width`` leaves for each piece; leaf p holds rank * width + p of the pair that starts at p."""
        n = len(raw)
        sym = np.full((n, width + 2), -1, np.int64)  # column width: the place after the last symbol; the last: before the first
        at = tv.ranges(np.zeros(n, np.int64), sizes)
        sym[np.repeat(np.arange(n), sizes), at] = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        nxt[np.arange(1, width + 1) >= sizes[:, None]] = width
        prv = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NEVER, np.int64)
        r = self.ranks(sym[:, :width], sym[:, 1 : width + 1])
        tree[:, width:] = np.where(r == _NEVER, _NEVER, r * width + np.arange(width))
        w = width
        while w > 1:
            tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
            w //= 2
        rows = np.flatnonzero(tree[:, 1] < _NEVER)
        while len(rows):
            root = tree[rows, 1]
            pos, rank = root % width, root // width
            gone = nxt[rows, pos]
            far = nxt[rows, gone]
            sym[rows, pos] = self.made[rank]
            sym[rows, gone] = -1
            nxt[rows, pos] = far
            prv[rows, far] = pos
            near = prv[rows, pos]
            here = self.ranks(sym[rows, pos], sym[rows, far])
            self._put(tree, rows, pos, np.where(here == _NEVER, _NEVER, here * width + pos), width)
            self._put(tree, rows, gone, np.full(len(rows), _NEVER), width)
            some = near >= 0
            if some.any():
                rr, pp, nn = rows[some], pos[some], near[some]
                back = self.ranks(sym[rr, nn], sym[rr, pp])
                self._put(tree, rr, nn, np.where(back == _NEVER, _NEVER, back * width + nn), width)
            rows = rows[tree[rows, 1] < _NEVER]
        live = sym[:, :width] >= 0
        flat = sym[:, :width][live].astype(np.uint32)
        return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def _one(self, raw: bytes) -> np.ndarray:
        """The same tree for one long piece, in plain Python: some twenty steps a merge."""
        n = len(raw)
        width = 1 << max(1, (n - 1).bit_length())
        sym, never, rank_of = self.base[np.frombuffer(raw, np.uint8)].tolist(), int(_NEVER), self.rank_of
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))

        def leaf(p: int) -> int:
            q = nxt[p]
            r = rank_of.get(sym[p] << 32 | sym[q]) if q >= 0 else None
            return never if r is None else r * width + p

        tree = [never] * width + [leaf(p) for p in range(n)] + [never] * (width - n)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(p: int, value: int) -> None:
            i = p + width
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] < never:
            rank, p = divmod(tree[1], width)
            q = nxt[p]
            sym[p], sym[q], nxt[p] = int(self.made[rank]), -1, nxt[q]
            if nxt[q] >= 0:
                prv[nxt[q]] = p
            put(q, never)
            put(p, leaf(p))
            if prv[p] >= 0:
                put(prv[p], leaf(prv[p]))
        return np.array([s for s in sym if s >= 0], np.uint32)


class Encoder:
    """Texts to ids through a bounded memory of merged pieces.  ``merge``: ids of each of some pieces."""

    def __init__(self, merges: Merges, merge: Callable[[list[str]], list[np.ndarray]], most: int = CACHED_PIECES):
        self.merges, self.merge, self.most = merges, merge, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, keys: np.ndarray, first: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each distinct piece are; merges those not seen before."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + len(keys) > self.most:
                self.forget()
                known[:] = False
            fresh = np.flatnonzero(~known)
            where = first[fresh]
            ids = self.merge([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            sizes = np.array([len(x) for x in ids], np.int64)
            base = len(self.length)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.length = np.concatenate([self.length, sizes])
            self.flat = np.concatenate([self.flat, *ids]).astype(np.uint32, copy=False)
            put = np.searchsorted(self.keys, keys[fresh])
            self.keys = np.insert(self.keys, put, keys[fresh])
            self.slot = np.insert(self.slot, put, base + np.arange(len(fresh)))
            at = np.searchsorted(self.keys, keys)
        return self.slot[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        if any(s in t for s in self.merges.special for t in texts):
            return self._with_special(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = pieces(cps, np.append(off[:-1][sizes > 0], len(cps)))
        ends = np.append(starts[1:], len(cps))
        values = _classes()[1][cps]
        hashes = np.concatenate([tv.run_hashes(values[a:b], starts[i:j] - a, ends[i:j] - a) for i, j, a, b in _runs(starts, ends)])
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(keys, first, text, starts, ends)[inverse]
        lengths = self.length[slots]
        ids = self.flat[tv.ranges(self.start[slots], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, off)]

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import re

        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")
        parts = [cut.split(t) for t in texts]
        plain = [p if i % 2 == 0 else "" for row in parts for i, p in enumerate(row)]
        ids, off = Encoder.encode(self, plain)
        out, k = [], 0
        for row in parts:
            got = []
            for i, p in enumerate(row):
                got.append(np.array([self.merges.special[p]], np.uint32) if i % 2 else ids[off[k] : off[k + 1]])
                k += 1
            out.append(np.concatenate(got))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of each run of ids."""
        m = self.merges
        lengths = m.length[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return m.flat[tv.ranges(m.start[ids], lengths)], total[off]

    def checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes.  Were two pieces ever to share a 64-bit hash, a text would decode to another: then it is done anew, piece by piece."""
        ids, off = self.encode(texts)
        raw, at = self.decode(ids, off)
        if raw.tobytes() != "".join(texts).encode("utf-8", "replace"):
            parts = []
            for t in texts:
                self.forget()
                parts.append(self.encode([t])[0])
            ids, off = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            raw, at = self.decode(ids, off)
        return ids, off, raw, at


def _runs(starts: np.ndarray, ends: np.ndarray):
    """Pieces in runs of about PIECE characters, so that the table of powers stays small."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + tv.PIECE, side="right")))
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


@lru_cache(2)
def segment_tree_encoder(path: str) -> Encoder:
    merges = Merges(path)
    return Encoder(merges, merges.merge)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows of at most ``most`` bytes of text (or one longer text), with their texts; null: empty."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = tv.text_buffers(col)
    for i, j in tv.slices(off, most):
        part = batch.slice(i, j - i)
        yield part, [t or "" for t in col.slice(i, j - i).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    taken = {n.lower() for n in new}
    old = [n for n in batch.schema.names if n.lower() not in taken]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in old), *new.values()], names=[*old, *new])


def _schema(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    small_batches(df.sparkSession)
    names = {n.lower() for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in new])


def binary(raw: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Adds ``ids`` array<int>: the tokens of each whole text, special strings included, nothing added."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segment_tree_encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                got, off, _, _ = enc.checked(texts)
                yield with_columns(part, {ids: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got.astype(np.int32)))})

    return df.mapInArrow(run, _schema(df, [(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds ``text``: the string of an array<int> of ids; bytes that are no UTF-8 become U+FFFD; null ids: the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segment_tree_encoder(path)
        for batch in batches:
            rows = [r or [] for r in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            flat, off = np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            raw, at = enc.decode(flat, off)
            data = raw.tobytes()
            yield with_columns(batch, {text: pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())})

    return df.mapInArrow(run, _schema(df, [(text, T.StringType())]))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Encodes, then decodes the ids: adds ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (string)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = segment_tree_encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                got, off, raw, at = enc.checked(texts)
                yield with_columns(part, {ids: binary(got.astype("<u4").view(np.uint8), 4 * off, pa.binary()), decoded: _strings(raw, at)})

    return df.mapInArrow(run, _schema(df, [(ids, T.BinaryType()), (decoded, T.StringType())]))


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    try:
        raw.tobytes().decode("utf-8")
        return binary(raw, at, pa.string())
    except UnicodeDecodeError:
        data = raw.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    docs = round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
