"""Token ids of whole texts, by the tokenizers library, with each distinct stretch of text encoded once per batch.

A text is cut before each run of ASCII white space, and between a letter and a full stop or the like. No pre-token of
the vocabularies used here crosses such a cut, so the ids of a text are the ids of its stretches in a row. Arrow's
dictionary encoding finds the distinct stretches of a batch; a bounded memo in each Python worker keeps those it has met.
Texts that hold the writing of a special token, in any case of letters, are given to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cueframe.llm.common import _LOWER, _SPACE, buffers

MEMO = 250_000  # stretches a worker remembers
LONG = 256  # longer stretches are encoded each time


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _after_odd_space(raw: np.ndarray) -> np.ndarray:
    """Positions behind white space other than ASCII's, where a cut could fall inside a run of white space."""
    out = np.zeros(len(raw) + 3, bool)
    out[1 : len(raw) + 1] = (raw >= 0x1C) & (raw <= 0x1F)
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    b = np.concatenate([raw, np.zeros(3, np.uint8)])
    one, two = b[lead + 1], b[lead + 2]
    head = raw[lead]
    out[lead[(head == 0xC2) & ((one == 0x85) | (one == 0xA0))] + 2] = True
    e2 = (head == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
    three = e2 | ((head == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((head == 0xE3) & (one == 0x80) & (two == 0x80))
    out[lead[three] + 3] = True
    return out[: len(raw)]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True
#: One pre-token in every vocabulary here: ASCII or Latin-1 letters, behind one space at most.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _before_stop(raw: np.ndarray) -> np.ndarray:
    """Positions of a full stop or the like right behind a letter: there a pre-token of letters always ends."""
    letter = _LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    out = _STOP[raw]
    out[1:] &= letter[:-1]
    out[:1] = False
    return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        #: Vocabularies with word ends drop white space and fold case; in the others a word's first id holds its space.
        self.ends = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        self.marks[[i for t, i in vocab.items() if (t.endswith("</w>") if self.ends else t.startswith("\u0120"))]] = True

    def _plain(self, stretches: list[bytes]) -> list[bytes] | None:
        """The ids of many plain stretches from one call, cut where the ids show a word's end or start."""
        text = b" ".join(stretches) if self.ends else b"".join(stretches)
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.marks[ids])
        at = np.concatenate([[0], at + 1]) if self.ends else np.append(at, len(ids))
        if len(at) != len(stretches) + 1 or at[0] or at[-1] != len(ids):
            return None
        data, at = ids.tobytes(), (4 * at).tolist()
        return [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _singly(self, stretches: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast([x.decode() for x in stretches], add_special_tokens=False)]

    def _stretches(self, distinct: list[bytes]) -> list[bytes]:
        got = list(map(self.memo.get, distinct))
        new = [i for i, x in enumerate(got) if x is None]
        plain, other = [], []
        for i in new:
            m = PLAIN.fullmatch(distinct[i])
            (plain if m and (self.ends or distinct[i][0] == 32) else other).append(i)
        for which, encode in ((plain, self._plain), (other, self._singly)):
            for k in range(0, len(which), 2000):
                part = which[k : k + 2000]
                stretches = [distinct[i] for i in part]
                for i, ids in zip(part, encode(stretches) or self._singly(stretches), strict=True):
                    got[i] = ids
                    if len(self.memo) < MEMO and len(distinct[i]) <= LONG:
                        self.memo[distinct[i]] = ids
        return got

    def _whole(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The rows that hold the writing of a special token."""
        low, rows = _LOWER[raw].tobytes(), set()
        for x in self.special:
            at = low.find(x)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = low.find(x, at + 1)
        return sorted(rows)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, as uint32, and the n + 1 offsets of the rows in them."""
        raw, offsets = buffers(text)
        out, at = self._by_stretches(raw, offsets)
        whole = self._whole(raw, offsets)
        if not whole:
            return out, at
        parts = [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in whole:
            parts[i] = np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _by_stretches(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = _SPACE[raw]
        if not len(raw) or self.ends and space.all():
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.ends:
            start = ~space
            start[1:] &= space[:-1]
            start[firsts] = ~space[firsts]
        else:
            start = space.copy()
            start[1:] &= ~space[:-1]
            start &= ~_after_odd_space(raw)
            start[firsts] = True
        start |= _before_stop(raw)
        rows = np.concatenate([[0], np.cumsum(start)])[offsets]
        if self.ends:
            raw, start = _LOWER[raw[~space]], start[~space]
        ends = np.append(np.flatnonzero(start), len(raw)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = column.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = self._stretches(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(sizes) - sizes
        size = sizes[index]
        ahead = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(first[index] - ahead[:-1], size) + np.arange(ahead[-1])]
        return out, ahead[rows]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per Python worker, which lives on over tasks."""
    return Encoder(path)
