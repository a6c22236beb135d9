"""Exact encoding and decoding with a SentencePiece merge model, by backtracking over longest matches.

A merge model joins, again and again, the two neighbours whose join is the piece of the highest score, the leftmost of
equals. Tokens in a row are what it makes of their text exactly if it makes each token of the token's own text, and each
two neighbours of theirs. So a text is read from the left: the longest piece that matches is taken if it and the token
before agree, else the next shorter one; where none is left, the place is marked as failed and the token before gives
way. Matches of all pieces come from one Aho-Corasick pass, agreement from merging two tokens' text again (kept per pair),
failed places are bits.

A text is cut where white space stands behind other characters and between two ASCII characters that no piece has side
by side: no merge crosses these cuts. Arrow's dictionary encoding finds the distinct stretches of a batch and a bounded
memo in each worker keeps the ones it has met. The model's white-space sign is a space in here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm.common import buffers, read, slices
from cueframe.llm.encoding import vocabulary

SIGN = "▁"
MEMO, LONG = 1_000_000, 256  # stretches a worker remembers, and their longest


class Pieces:
    """The model's normal pieces as a merge vocabulary, and the ids of bytes for characters it lacks."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, size = self.model, self.model.vocab_size()
        odd = [k for k in range(size) if model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)]
        self.ids = {model.id_to_piece(k).replace(SIGN, " "): k for k in sorted(set(range(size)) - set(odd))}
        self.scores = {piece: model.get_score(k) for piece, k in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if model.normalize("AÅ ﬁ　a") != f"{SIGN}AÅ{SIGN}ﬁ　a" or any(" " in p.lstrip(" ") for p in self.ids) or not all(map(model.is_byte, self.bytes)):
            raise ValueError("only models with byte fallback, white space in front and no normalisation can be used")
        self.letters = {c for p in self.ids for c in p}
        self.apart = np.zeros((256, 256), bool)  # pairs of bytes between which no merge takes place
        self.apart[:128, :128] = True
        for pair in {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}:
            if pair.isascii():
                self.apart[ord(pair[0]), ord(pair[1])] = False
        self.matcher = ahocorasick.Automaton()
        for piece in self.letters | self.ids.keys():
            self.matcher.add_word(piece, len(piece))
        self.matcher.make_automaton()
        self.own: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.written = [str(k) for k in range(size)]

    def merged(self, text: str) -> list[str]:
        """The rule itself, for short texts: join the best pair of neighbours until none is a piece."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stands(self, piece: str) -> bool:
        """Whether the rule makes this piece of its own text; some pieces no merge leads to."""
        if piece not in self.own:
            self.own[piece] = self.merged(piece) == [piece]
        return self.own[piece]

    def _agree(self, left: str, right: str) -> bool:
        pair = left, right
        if pair not in self.pairs:
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            self.pairs[pair] = self.merged(left + right) == [left, right]
        return self.pairs[pair]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text of known characters."""
        if text in self.scores and self._stands(text):
            return [text]
        lengths = [0] * len(text)  # for each place the lengths of the pieces that match there, as bits
        for end, length in self.matcher.iter(text):
            lengths[end + 1 - length] |= 1 << length
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        own, pairs, size = self.own, self.pairs, len(text)
        at, longest = 0, size
        while at < size:
            fits = lengths[at] & ((2 << longest) - 1)
            while fits:
                length = fits.bit_length() - 1
                fits ^= 1 << length
                end, token = at + length, text[at : at + length]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                stands = own.get(token)
                if stands is False or stands is None and not self._stands(token):
                    continue
                agree = pairs.get((out[-1], token)) if out else True
                if agree or agree is None and self._agree(out[-1], token):
                    out.append(token)
                    at, longest = end, size
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at, longest = at - len(token), len(token) - 1
        return out

    def stretch(self, raw: bytes) -> tuple[int, ...]:
        """The ids of a stretch of text; characters that no piece has stand alone, as bytes."""
        ids = self.memo.get(raw)
        if ids is not None:
            return ids
        text = raw.decode()
        if self.letters.issuperset(text):
            tokens = self.tokens(text)
        else:
            tokens = [t for known, run in groupby(text, self.letters.__contains__) for t in (self.tokens("".join(run)) if known else run)]
        ids = tuple(i for t in tokens for i in ((self.ids[t],) if t in self.ids else [self.bytes[b] for b in t.encode()]))
        if len(raw) <= LONG and len(self.memo) < MEMO:
            self.memo[raw] = ids
        return ids

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and the n + 1 offsets of the rows in them."""
        raw, offsets = buffers(pc.replace_substring(text, SIGN, " "))
        filled = offsets[1:] > offsets[:-1]
        own = np.ones(len(raw) + int(filled.sum()), bool)
        own[offsets[:-1][filled] + np.arange(int(filled.sum()))] = False  # the space before each text
        spaced = np.full(len(own), 32, np.uint8)
        spaced[own] = raw
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        start = np.ones(len(spaced), bool)
        start[1:] = self.apart[spaced[:-1], spaced[1:]]
        start[offsets[:-1][filled]] = True
        ends = np.append(np.flatnonzero(start), len(spaced)).astype(np.int64)
        if len(ends) == 1:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(spaced)])
        coded = column.dictionary_encode()
        found = [self.stretch(x) for x in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        first, size = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ahead = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first - ahead[:-1], size) + np.arange(ahead[-1])]
        return ids, ahead[np.searchsorted(ends, offsets)]


@lru_cache(4)
def pieces(path: str) -> Pieces:
    """One per Python worker, which lives on over tasks."""
    return Pieces(path)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row, exactly as the library encodes its text without begin and end ids.

    A null text counts as empty and has no ids. Repeated rows and null ids stay; other columns are not read. White space
    of every kind stays as it is; a white-space sign in a text counts as a space. No rows give no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in slices(batches):
            ids, at = model.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (doc_id, ids array<int>) with text: what the library's decode makes of the ids. Null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path).model
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                texts = [None if x is None else model.decode(x) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, in one pass; see encoded and decoded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in slices(batches):
            ids, at = model.encode(batch.column("text"))
            shas, texts = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b].tolist()
                shas.append(hashlib.sha256(",".join(map(model.written.__getitem__, own)).encode()).hexdigest())
                texts.append(hashlib.sha256(model.model.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": np.diff(at), "ids_sha256": shas, "decoded_sha256": texts})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
