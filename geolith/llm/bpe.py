"""Byte-level BPE ids of whole texts, by the tokenizers library, each distinct chunk of a batch encoded once.

A text is cut before each blank that stands between two signs which are no white
space. The pre-tokenizer of a byte-level BPE always cuts there, too: its pieces are
white space, or an optional blank and a run of one class of other characters, and
none looks behind its start. So the ids of the text are those of its chunks in a
row. The chunks of a batch are dictionary-encoded by Arrow, the distinct ones that
the worker doesn't know yet are encoded as one text, which is divided again by the
bytes that each id stands for, and numpy gathers the ids of all texts. Texts that
hold a special token, and all texts of other kinds of tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks that a worker remembers: the first it meets, among which the frequent ones are.
CACHE_BYTES = 8 << 20
#: Bytes of text that are handled together, and of chunks that are encoded as one text.
SLICE_BYTES, JOINED_BYTES = 4 << 20, 1 << 17
#: White space by any reading of it, and what has a width of nothing: no cut is made beside it.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"
_CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Signs that are a piece of their own after a letter.
TAIL = ".,;:!?"

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; ``forget`` empties its memory of chunks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values of ``flat`` from each ``start``, one after the other."""
    n = n.astype(np.int32, copy=False)
    first = start.astype(np.int32, copy=False) - np.cumsum(n, dtype=np.int32)
    first += n
    at = np.repeat(first, n)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``most`` or a little more; one row at least."""
    cuts, ends = [0], np.cumsum(sizes)
    while cuts[-1] < len(sizes):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + most, side="right"))))
    return list(zip(cuts, cuts[1:]))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.chunked = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(special) or None
        #: Bytes of each id: a byte-level vocabulary writes each byte as one character.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.n = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has."""
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def _joined(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks with a blank before each; those that don't end in white space are encoded as one text."""
        ids, _ = self._each([" " + " ".join(chunks)])
        ends, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum(sizes + 1)
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self._each([" " + c for c in chunks])
        return ids, np.diff(at + 1, prepend=0)

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_joined``, of any number and kind of chunks."""
        loose = np.asarray(pc.or_(pc.equal(pc.binary_length(chunks), 0), pc.match_substring_regex(chunks, f"{_CLASS}$|{self.special or '$^'}")))
        sizes, texts = np.asarray(pc.binary_length(chunks)).astype(np.int64), chunks.to_pylist()
        order = np.argsort(loose, kind="stable")
        firm = int((~loose).sum())
        flats, counts = [], []
        for lo, hi in slices(sizes[order[:firm]], JOINED_BYTES):
            some = order[lo:hi]
            flat, n = self._joined([texts[i] for i in some], sizes[some])
            flats.append(flat)
            counts.append(n)
        for lo in range(firm, len(texts), 256):
            flat, n = self._each([" " + texts[i] for i in order[lo : lo + 256]])
            flats.append(flat)
            counts.append(n)
        flat, n = np.concatenate([np.empty(0, self.dtype), *flats]), np.concatenate([np.empty(0, np.int64), *counts])
        start = np.empty(len(n), np.int64)
        start[order] = np.cumsum(n) - n
        back = np.empty(len(n), np.int64)
        back[order] = n
        return flat, start, back

    def _base(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``flat, start, n`` of distinct chunks, remembered as far as there is room."""
        place = pc.index_in(chunks, value_set=self.known)
        missing = np.asarray(pc.is_null(place))
        new = chunks.filter(pa.array(missing))
        at = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
        flat, start, n = self._new(new)
        start += len(self.flat)
        whole = np.concatenate([self.flat, flat])
        starts, counts = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        if len(self.start):
            starts[:], counts[:] = self.start[at], self.n[at]
        starts[missing], counts[missing] = start, n
        if len(new) and self.known.nbytes < CACHE_BYTES:
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.start, self.n = whole, np.concatenate([self.start, start]), np.concatenate([self.n, n])
        return whole, starts, counts

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``flat, start, n`` of distinct chunks with a blank before each; a word's ids are used for it with signs after it, too."""
        trimmed = pc.utf8_rtrim(chunks, TAIL)
        stem, size = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (trimmed, chunks))
        ends = np.frombuffer(trimmed.buffers()[1], np.int64)[trimmed.offset + 1 : trimmed.offset + len(trimmed) + 1]
        data = np.frombuffer(trimmed.buffers()[2] or b"", np.uint8)
        # The sign before the tail must be an ASCII letter.
        last = np.where(stem > 0, data[np.maximum(ends, 1) - 1] if len(data) else 0, 0) | 0x20
        has = (size > stem) & (last >= 0x61) & (last <= 0x7A)
        tailed = np.flatnonzero(has)
        stems = pc.if_else(pa.array(has), trimmed, chunks).dictionary_encode()
        flat, start, n = self._base(stems.dictionary)
        base = np.asarray(stems.indices)
        start, n = start[base], n[base]
        if not len(tailed):
            return flat, start, n
        ending = [c[-k:] for c, k in zip(chunks.take(pa.array(tailed)).to_pylist(), (size - stem)[tailed].tolist())]
        tails = pa.array(ending, pa.large_string()).dictionary_encode()
        more, m = self._each(tails.dictionary.to_pylist())
        which = np.asarray(tails.indices)
        begin = len(flat) + np.cumsum(m) - m
        # The words with their tails follow behind, as runs of their own.
        both = np.concatenate([flat, more])
        pairs = np.stack([start[tailed], begin[which]], axis=1).ravel(), np.stack([n[tailed], m[which]], axis=1).ravel()
        joined = gather(both, *pairs)
        total = n[tailed] + m[which]
        start, n = start.copy(), n.copy()
        start[tailed], n[tailed] = len(both) + np.cumsum(total) - total, total
        return np.concatenate([both, joined]), start, n

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All chunks in a row, how many each text has, and the texts in that order."""
        doubt = np.asarray(pc.match_substring_regex(texts, f"{_CLASS} | {_CLASS}"))
        plain, odd = np.flatnonzero(~doubt), np.flatnonzero(doubt)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        rest = [_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
        values = pa.concat_arrays([split.flatten(), pa.array([c for r in rest for c in r], pa.large_string())])
        counts = np.concatenate([np.asarray(pc.list_value_length(split)).astype(np.int64), np.array([len(r) for r in rest], np.int64)])
        return values, counts, np.concatenate([plain, odd])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with ``end`` behind it, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.ones(len(texts), bool)
        if self.chunked:
            whole[:] = np.asarray(pc.match_substring_regex(texts, self.special)) if self.special else False
        cut, kept = np.flatnonzero(~whole), np.flatnonzero(whole)
        values, counts, order = self._pieces(texts.take(pa.array(cut)))
        first = np.cumsum(counts) - counts
        following = np.ones(len(values), bool)
        following[first] = False
        coded = values.filter(pa.array(following)).dictionary_encode()
        fronts, f = self._each(values.take(pa.array(first)).to_pylist())
        del values
        flat, start, n = self._chunks(coded.dictionary)
        which = np.asarray(coded.indices)
        wholes, w = self._each(texts.take(pa.array(kept)).to_pylist())
        both = np.concatenate([flat, fronts, wholes, np.array([end], self.dtype)])

        # Every text is a row of runs: its first chunk, or the whole of it, then the other chunks, then the end.
        runs = np.ones(len(texts), np.int64)
        runs[cut[order]] = counts
        runs += 1
        last = np.cumsum(runs) - 1
        at, length = np.empty(int(runs.sum()), np.int32), np.empty(int(runs.sum()), np.int32)
        begin = last - runs + 1
        at[last], length[last] = len(both) - 1, 1
        at[begin[kept]], length[begin[kept]] = len(flat) + len(fronts) + np.cumsum(w) - w, w
        places = np.repeat((begin[cut[order]] - first).astype(np.int32), counts) + np.arange(len(following), dtype=np.int32)
        at[places[first]], length[places[first]] = len(flat) + np.cumsum(f) - f, f
        places = places[following]
        at[places], length[places] = start[which], n[which]
        del places, which, following, coded
        return gather(both, at, length), np.add.reduceat(length, begin, dtype=np.int64) if len(begin) else length.astype(np.int64)

    def batches(self, texts: pa.Array, end: int):
        """``lo, hi, ids, counts`` of runs of the texts of about SLICE_BYTES."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        for lo, hi in slices(sizes, SLICE_BYTES):
            yield lo, hi, *self.encode(texts.slice(lo, hi - lo), end)
