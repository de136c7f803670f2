"""Tokenising whole texts inside Spark tasks with the ``tokenizers`` library.

The tokenizer file is read once on the driver (its path is a parameter, the
file holds one vocabulary) and shipped to the tasks. Byte-level BPE never
merges across certain places (before white space after another character,
between an ASCII letter and an ASCII mark or digit, after a single line end),
so the texts of a batch are cut there by table lookups on their bytes, Arrow
finds the distinct pieces, and only those that a bounded memo lacks go to the
tokenizer, many of them joined to one text. Token bytes add up to piece bytes,
which gives back the ids of each piece. Wherever a character might be white
space of another kind, nothing is cut; texts with the strings of added tokens
are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Pieces that stay when the memo is full (at twice as many): those used last.
MEMO_PIECES = 100_000
#: Longer pieces are not remembered, so the memo's bytes are bounded too.
MEMO_BYTES = 64
#: Pieces joined to one text for the tokenizer (and texts that it gets at once), bytes cut and pieces put out at once.
JOINED = 64
CUT_BYTES = 1 << 18
OUT_PIECES = 1 << 16
_WORKER: dict = {}

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_GRAPHIC = (_BYTES > 32) & (_BYTES < 127)
_MARK = _GRAPHIC & ~_LETTER
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
#: Bytes that begin a character that is not white space (U+0080 to U+00BF, U+1000 to U+3FFF are left out as a whole).
_STARTS = _GRAPHIC | (_BYTES >= 0xC3) & (_BYTES <= 0xE0) | (_BYTES >= 0xE4)
#: Bytes that may end such a character, and the two bytes before that decide.
_ENDS = _GRAPHIC | (_BYTES >= 128)
_MAYBE_PAIR = np.isin(_BYTES, [0xE1, 0xE2, 0xE3])
_MAYBE = np.isin(np.arange(1 << 16), [0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380])


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (a rule of the format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _solid(data: np.ndarray) -> np.ndarray:
    """Whether a character that ends at a byte is certainly neither white space nor a control character."""
    out = _ENDS[data]
    out[1:] &= data[:-1] != 0xC2
    at = np.flatnonzero(_MAYBE_PAIR[data[:-2]])
    out[at[_MAYBE[data[at].astype(np.uint16) << 8 | data[at + 1]]] + 2] = False
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of texts and places (each: before this byte) where a text may be cut without any change of its words."""
    out = np.zeros(len(data) + 1, bool)
    out[offsets] = True
    for at in range(0, len(data), CUT_BYTES):
        low = max(0, at - 4)
        d = data[low:at + CUT_BYTES + 1]
        solid, letter = _solid(d), _LETTER[d]
        cut = np.zeros(len(d), bool)
        cut[1:] = _SPACE[d[1:]] & solid[:-1] | _MARK[d[1:]] & letter[:-1]
        cut[2:] |= (d[1:-1] == 10) & solid[:-2] & _STARTS[d[2:]]
        cut = cut[at - low:at - low + CUT_BYTES]
        out[at:at + len(cut)] |= cut
    return np.flatnonzero(out)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The values of ``data`` between neighbouring ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array without nulls."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _strings(values: pa.Array) -> list[str]:
    return values.cast(pa.large_string()).to_pylist()


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` from ``starts``, one behind the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, definition: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.tok.encode_special_tokens = special_as_text
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        pre = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        model, vocab = self.tok.model, self.tok.get_vocab(with_added_tokens=False)
        self.added = ([] if special_as_text else
                      [a.content for a in self.tok.get_added_tokens_decoder().values()])
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not self.tok.normalizer
                         and not self.tok.post_processor and type(model).__name__ == "BPE"
                         and not model.continuing_subword_prefix and not model.end_of_word_suffix
                         and all(c in vocab for c in _byte_characters().values()))
        if not self.by_piece:
            return
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the memo takes its place
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.token_bytes[list(vocab.values())] = [len(t) for t in vocab]  # one stand-in per byte
        self.clock = 0
        self.pieces = _binary(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.ids = np.zeros(0, self.code)
        self.starts = self.sizes = self.used = np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for at in range(0, len(texts), JOINED)
                for e in self.tok.encode_batch_fast(texts[at:at + JOINED], add_special_tokens=False)]

    def _learn(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number of ids) of pieces; those that may stand behind one another are joined."""
        data, offsets = _parts(fresh)
        joined = _SPACE[data[offsets[:-1]]] & _solid(data)[offsets[1:] - 1]
        sizes = np.zeros(len(fresh), np.int32)
        together = fresh.filter(pa.array(joined))
        raw, ends = _parts(together)
        at = np.append(ends[:-1:JOINED], ends[-1])
        texts = _strings(_binary(raw, at)) if len(together) else []
        if any(a in t for a in self.added for t in texts):
            joined[:], texts = False, []
        got = self._whole(texts)
        if texts:
            last = np.cumsum(self.token_bytes[np.frombuffer(b"".join(got), self.code)])
            upto = np.searchsorted(last, ends[1:])
            if last[-1] != ends[-1] or (last[upto] != ends[1:]).any():
                raise ValueError("the tokens of joined pieces do not end where the pieces end")
            sizes[joined] = np.diff(upto, prepend=-1)
        alone = self._whole(_strings(fresh.filter(pa.array(~joined))))
        sizes[~joined] = [len(x) // np.dtype(self.code).itemsize for x in alone]
        order = np.append(np.flatnonzero(joined), np.flatnonzero(~joined))
        starts = np.zeros(len(fresh), np.int64)
        starts[order] = np.cumsum(sizes[order], dtype=np.int64) - sizes[order]
        return np.frombuffer(b"".join(got + alone), self.code), starts, sizes

    def _known(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_learn`` through the memo."""
        self.clock += 1
        at = pc.index_in(distinct, value_set=self.pieces).fill_null(-1).to_numpy()
        new = at < 0
        self.used[at[~new]] = self.clock
        fresh = distinct.filter(pa.array(new))
        ids, begin, count = self._learn(fresh)
        starts, sizes = np.empty(len(at), np.int64), np.empty(len(at), np.int32)
        starts[~new], sizes[~new] = self.starts[at[~new]], self.sizes[at[~new]]
        starts[new], sizes[new] = begin + len(self.ids), count
        pool = np.concatenate([self.ids, ids])
        short = np.diff(_parts(fresh)[1]) <= MEMO_BYTES
        pieces = pa.concat_arrays([self.pieces, fresh.filter(pa.array(short))])
        first, many = np.append(self.starts, (begin + len(self.ids))[short]), np.append(self.sizes, count[short])
        used = np.append(self.used, np.full(int(short.sum()), self.clock, np.int32))
        if len(pieces) > 2 * MEMO_PIECES:
            kept = np.sort(np.argsort(used, kind="stable")[-MEMO_PIECES:])
            pieces, first, many, used = pieces.take(pa.array(kept)), first[kept], many[kept], used[kept]
        self.ids = _gather(pool, first, many)
        self.pieces, self.starts, self.sizes, self.used = pieces, np.cumsum(many, dtype=np.int32) - many, many, used
        return pool, starts, sizes

    def _by_piece(self, texts: pa.Array) -> list[bytes]:
        data, offsets = _parts(texts)
        if not len(data):
            return [b""] * len(texts)
        begins = _cuts(data, offsets)
        coded = _binary(data, begins).dictionary_encode()
        which = coded.indices.to_numpy()
        pool, starts, sizes = self._known(coded.dictionary)
        at = np.searchsorted(begins, offsets)
        out: list[bytes] = []
        low = 0
        while low < len(texts):  # whole texts of about OUT_PIECES pieces at a time
            high = max(low + 1, int(np.searchsorted(at, at[low] + OUT_PIECES, side="right")) - 1)
            part = which[at[low]:at[high]]
            many = sizes[part]
            raw = _gather(pool, starts[part], many).tobytes()
            ends = (np.append(0, np.cumsum(many, dtype=np.int64)) * pool.itemsize)[at[low:high + 1] - at[low]].tolist()
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
            low = high
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_piece:
            return self._whole(texts.to_pylist())
        odd = np.zeros(len(texts), bool)
        for a in self.added:
            odd |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_piece(texts.cast(pa.large_binary()))
        rest = iter(self._by_piece(texts.filter(pa.array(~odd)).cast(pa.large_binary())))
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        return [next(whole if o else rest) for o in odd.tolist()]


def worker_encoder(definition: str, special_as_text: bool) -> PieceEncoder:
    """The encoder of this Python worker; kept between tasks."""
    key = (hash(definition), len(definition), special_as_text)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceEncoder(definition, special_as_text)
    return _WORKER[key]


def id_bytes(vocab_size: int) -> int:
    """Bytes of one id in the flat form."""
    return 2 if vocab_size <= 1 << 16 else 4


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_ids(docs: DataFrame, definition: str, *, text: str = "text", out: str = "ids",
              special_as_text: bool = False, compress: bool = False) -> DataFrame:
    """``docs`` plus binary ``out``: the ids of the whole text, little endian.

    Null text has no ids (an empty value). ``compress`` stores each value as a
    zstandard frame, for intermediate tables.
    """
    def make(batches):
        enc = worker_encoder(definition, special_as_text)
        pack = None
        if compress:
            import zstandard

            pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            got: list[bytes] = []
            for at in range(0, b.num_rows, 512):
                part = enc.encode(b.column(text).slice(at, 512))
                got += [pack(x) for x in part] if pack else part
            yield [pa.array(got, pa.binary())]

    return append_columns(docs, [T.StructField(out, T.BinaryType())], make)
