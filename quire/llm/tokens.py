"""Token ids of whole texts with a public tokenizer, made cheap by a cache of pieces.

A byte-level BPE splits a text into pretokens first, and never merges across their borders. Two kinds of
border can be seen in the bytes: before a single blank or line end between two non-blank characters, and
before a mark [.,;:!?] after a Latin letter. Pieces between such borders are looked up by a 64-bit hash;
those not seen before go through the library, plain Latin words through its BPE model alone. A text that
holds the literal of an added token goes through the library as a whole, with its defaults.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from quire.llm.bytetext import prefix_hash, span_hash, texts

END_ID = 0
CACHE = 300_000  # pieces; about 40 bytes each, twice that while new ones go in
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that are blank, or that can lead a blank of more than one byte.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE1, 0xE2, 0xE3]] = True
_encoders: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible character: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


def _borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        blank = _BLANK[data]
        before = np.zeros(n, bool)  # whether the character before may be blank
        before[1:] = blank[:-1]
        before[2:] |= data[:-2] == 0xC2
        before[3:] |= _LEAD3[data[:-3]]
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        cut = ((data == 32) | (data == 10)) & ~before & ~after
        letter = np.zeros(n, bool)
        letter[1:] = _LETTER[data[:-1]]
        letter[2:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut |= _MARK[data] & letter
    first, last = off[:-1], off[1:]
    cut[last[last > 0] - 1] &= data[last[last > 0] - 1] != 32
    cut[last[last > 0] - 1] &= data[last[last > 0] - 1] != 10
    cut[first[first < last]] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.model, self.chars = self.lib.model, _byte_chars()
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        lead = piece[:1] if piece[:1] in " \n" else ""
        rest = piece[len(lead) :]
        if rest.isascii() and rest.isalpha():
            if lead == "\n":
                return [t.id for t in self.model.tokenize("Ċ")] + [t.id for t in self.model.tokenize(rest)]
            return [t.id for t in self.model.tokenize("Ġ" + rest if lead else rest)]
        if rest.isalpha() and max(rest) < "ɐ":
            shown = [lead, rest] if lead == "\n" else [piece]
            return [t.id for x in shown for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.chars))]
        return self.lib.encode(piece, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        made = [self._piece(p.decode()) for p in pieces]
        n = np.fromiter(map(len, made), np.int64, len(made))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.array([i for x in made for i in x], np.uint32)])
        where = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.n = np.insert(self.hash, where, hashes), np.insert(self.at, where, at), np.insert(self.n, where, n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as bytes and offsets: all ids, and the offset of each text in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = _borders(data, off)
        ends = np.append(starts[1:], len(data))
        uniq, first, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > CACHE:
            self._clear()
        where = np.searchsorted(self.hash, uniq)
        known = self.hash[np.minimum(where, len(self.hash) - 1)] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        if not known.all():
            raw = data.tobytes()
            new = first[~known]
            self._learn(uniq[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            where = np.searchsorted(self.hash, uniq)
        n = self.n[where][back]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.at[where][back] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, off)]

    def column(self, column: pa.Array):
        """Yields (index of the text, its ids with END_ID after them) for a column of texts."""
        for i, data, off in texts(column):
            ids, at = self.encode(data, off)
            raw = data.tobytes() if self.added else b""
            added = [x for x in self.added if x in raw]
            for j in range(len(off) - 1):
                own = ids[at[j] : at[j + 1]]
                if added and any(x in raw[off[j] : off[j + 1]] for x in added):
                    own = np.array(self.lib.encode(raw[off[j] : off[j + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                yield i + j, np.append(own, np.uint32(END_ID)).astype("<u4", copy=False)


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
