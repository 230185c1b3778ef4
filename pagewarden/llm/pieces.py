"""Exact tokenizing of long texts in pieces, with the tokenizers library.

The byte-level pre-tokenizer never joins what stands before a white-space character
with what follows it, if that white space stands alone. So a text may be cut before each
single space or line feed with other characters on both sides: the pieces' ids, in order,
are the text's ids. It never joins a letter with a sign that follows it, so a text may be cut
between an ASCII letter and such signs, too. Special strings must hold no white space and none of
these signs, and stay whole. Most pieces occur often: a worker's pieces and a batch's are dictionary-encoded together, and the library
encodes, many in one call, those that are new. The memory of pieces is bounded.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import flat_text

#: Pieces that a worker remembers (about 50 bytes each) before it keeps only those met again.
MEMORY_PIECES = 500_000
#: Pieces handed to the library at once, and those of them that make one text.
ENCODE_PIECES, JOINED_PIECES = 4096, 64
#: Bytes of text worked on at once.
BATCH_BYTES = 8 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SIGNS = b'.,;:!?)"'
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(_SIGNS)] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _white_before(data: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether the characters that end at ``to`` are, or may be, Unicode white space."""
    back, back2, back3 = (data[to - k] for k in (1, 2, 3))
    return _WHITE[back] | ((back2 == 0xC2) & ((back == 0x85) | (back == 0xA0))) | ((back3 >= 0xE1) & (back3 <= 0xE3) & (back >= 0x80))


def _white_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters at ``at`` are, or may be, Unicode white space."""
    then, then2 = data[at], data[np.minimum(at + 1, len(data) - 1)]
    return _WHITE[then] | ((then == 0xC2) & ((then2 == 0x85) | (then2 == 0xA0))) | ((then >= 0xE1) & (then <= 0xE3))


def safe_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all pieces of the texts, and the number of each text's first piece (n + 1).

    Beside Unicode white space, and beside characters whose UTF-8 begins with the same byte
    as wide spaces do (E1 to E3), no cut is made."""
    n = len(data)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 2) & (at < n - 2)]
    first = np.zeros(n + 1, bool)
    first[at[~(_white_before(data, at) | _white_at(data, at + 1))]] = True
    first[1:n] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    first[offsets] = True
    first[n] = False
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


class PieceEncoder:
    """Ids of texts by pieces; one for each worker and vocabulary file."""

    _held: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(set(m) & set(_SIGNS.decode()) or re.search(r"\s", m) for m in self.marks):
            raise ValueError(f"special strings of {path} may hold no white space and none of {_SIGNS.decode()}")
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # one letter of a token stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)
        # ids are kept as 16 bits if the vocabulary allows
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known = pa.array([], pa.large_string())
        self.ids, self.begins, self.lengths = np.zeros(0, self.width), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _joinable(self, pieces: pa.Array) -> np.ndarray:
        """Pieces that begin with a single white space and end with none: they are again safe side by side."""
        data, offsets = flat_text(pieces)
        at, to = offsets[:-1], offsets[1:]
        fine = ((data[at] == 0x20) | (data[at] == 0x0A)) & (to - at > 1)
        fine &= ~(_white_at(data, np.minimum(at + 1, len(data) - 1)) | _white_before(data, to))
        for mark in self.marks:
            fine &= ~pc.match_substring(pieces, mark).to_numpy(zero_copy_only=False)
        return fine

    def _encode_joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joinable pieces and how many each has: one call encodes many as one text, and
        the ids' known byte lengths tell where each piece ends."""
        data, offsets = flat_text(pieces)
        cuts = np.append(offsets[:-1:JOINED_PIECES], offsets[-1]).tolist()
        whole = data.tobytes()
        got = self.tokenizer.encode_batch_fast([whole[a:b].decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int64) for e in got])
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), offsets[1:]) + 1
        return ids, np.diff(ends, prepend=0)

    def _encode_apart(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.array(x, np.int64) for x in got]), np.array([len(x) for x in got], np.int64)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces, and where in them each piece's begin and how many they are."""
        joinable = self._joinable(pieces)
        parts, begins, lengths, used = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        for some, encode in ((np.flatnonzero(joinable), self._encode_joined), (np.flatnonzero(~joinable), self._encode_apart)):
            for k in range(0, len(some), ENCODE_PIECES):
                which = some[k : k + ENCODE_PIECES]
                ids, n = encode(pieces.take(pa.array(which)))
                parts.append(ids.astype(self.width))
                begins[which], lengths[which] = used + np.cumsum(n) - n, n
                used += len(ids)
        return np.concatenate(parts), begins, lengths

    def _keep(self, met: np.ndarray) -> None:
        """Forgets all pieces but those whose numbers are ``met``."""
        places, ends = self._places(met)
        self.ids, self.lengths = self.ids[places], self.lengths[met]
        self.begins, self.known = ends[:-1], self.known.take(pa.array(met))

    def _places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the pieces lie, in order, and how many there are before each piece (n + 1)."""
        lengths = self.lengths[numbers]
        ends = np.append(0, np.cumsum(lengths))
        return np.arange(ends[-1]) + np.repeat(self.begins[numbers] - ends[:-1], lengths), ends

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all pieces of the texts, their numbers in this memory, and each text's first piece."""
        starts, first = safe_pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), first
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        )
        # the dictionary begins with the known pieces, which are distinct: their numbers stay
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]  # an empty first chunk is left out
        every, numbers = coded.dictionary, coded.indices.to_numpy()
        n = len(self.known)
        if n > MEMORY_PIECES:
            seen = np.zeros(len(every), bool)
            seen[numbers] = True
            self._keep(np.flatnonzero(seen[:n]))
            every, numbers, n = every.take(pa.array(np.flatnonzero(seen))), (np.cumsum(seen) - 1)[numbers], len(self.known)
        if len(every) > n:
            ids, begins, lengths = self._learn(every.slice(n))
            self.begins = np.concatenate([self.begins, begins + len(self.ids)])
            self.ids, self.lengths, self.known = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths]), every
        return numbers, first

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ids in each text."""
        numbers, first = self.look_up(data, offsets)
        return np.diff(np.append(0, np.cumsum(self.lengths[numbers]))[first])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, in order, and each text's first (n + 1)."""
        numbers, first = self.look_up(data, offsets)
        places, ends = self._places(numbers)
        return self.ids[places], ends[first]
