"""SentencePiece encoding and decoding for merge-type vocabularies.

A word starts as a list of characters. Every adjacent pair whose concatenation is a
piece stands on an agenda ordered by score, then by place; the best pair merges and
its new neighbours join the agenda, until none is left. Characters without a piece
become byte pieces. Spaces are written as U+2581, with one put before the text.

No piece has U+2581 after another character, so merges never cross the start of a
word: texts are cut there, words are encoded once and remembered in a bounded
table. Each newly seen word is checked against the library, and a difference stops
the job; ``check_texts`` checks whole texts as well.

The model file's bytes travel with the job, so executors need no copy of the file.
Null text counts as empty and encodes to the begin and end ids alone. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import table

SPACE = "▁"
WORDS_HELD = 1_000_000
WORD_CHARS_HELD = 64
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCoder:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        self.ids, self.costs, self.bytes_of, self.byte_ids = {}, {}, [], [0] * 256
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} spans words; texts cannot be cut into words")
                self.ids[piece], self.costs[piece] = i, -lib.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        # Words seen lately; when the newer half is full it becomes the older one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Ids of the word that stands before the one to be checked.
        self.ahead = len(lib.encode("a"))

    def merge(self, word: str) -> list[int]:
        """Ids of a word in which spaces are already written as U+2581."""
        symbols, costs = list(word), self.costs
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # (negated score, place of the left symbol, place of the right one, their text)
        agenda = [
            (costs[pair], i, i + 1, pair) for i in range(size - 1) if (pair := word[i : i + 2]) in costs
        ]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            # Out of date where either symbol has merged elsewhere since.
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following < size:
                before[following] = left
                longer = pair + symbols[following]
                if longer in costs:
                    heapq.heappush(agenda, (costs[longer], left, following, longer))
            preceding = before[left]
            if preceding >= 0:
                longer = symbols[preceding] + pair
                if longer in costs:
                    heapq.heappush(agenda, (costs[longer], preceding, left, longer))
        found: list[int] = []
        for symbol in symbols:
            if symbol:
                number = self.ids.get(symbol)
                found += [number] if number is not None else [self.byte_ids[b] for b in symbol.encode()]
        return found

    def _check(self, new: dict[str, list[int]]) -> None:
        """Stop where the library encodes a new word otherwise, behind a word of its own."""
        theirs = self.library.encode(["a" + word for word in new])
        for (word, mine), other in zip(new.items(), theirs):
            if other[self.ahead :] != mine:
                raise ValueError(f"the library encodes {word!r} differently")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, older = self.known, self.older
        missing = {w for words in split for w in words if w not in known}
        learned = {w: older[w] for w in missing if w in older}
        new = {w: self.merge(w) for w in missing if w not in learned}
        if new:
            self._check(new)
            learned.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in new.items())
        if len(known) >= WORDS_HELD // 2:
            self.older, self.known = known, {}
        self.known.update((w, code) for w, code in learned.items() if len(w) <= WORD_CHARS_HELD)
        return [self._framed(b"".join([known.get(w) or learned[w] for w in words])) for words in split]

    def _framed(self, body: bytes) -> bytes:
        begin, end = (i.to_bytes(4, "little") for i in (self.library.bos_id(), self.library.eos_id()))
        return begin + body + end

    def decode(self, ids: bytes) -> str:
        """The text of these ids, without the space that encoding put before it."""
        table_ = self.bytes_of
        raw = b"".join([table_[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


_CODERS: dict[int, PieceCoder] = {}


def _coder(model: bytes) -> PieceCoder:
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def encode_decode(docs: DataFrame, model: bytes, check_texts: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            bodies = [text or "" for text in batch.column(1).to_pylist()]
            ids = coder.encode(bodies)
            decoded = [coder.decode(packed) for packed in ids]
            if check_texts:
                theirs = coder.library.encode(bodies, add_bos=True, add_eos=True)
                if theirs != [np.frombuffer(packed, "<u4").tolist() for packed in ids]:
                    raise ValueError("the library encodes a text differently")
                if coder.library.decode(theirs) != decoded:
                    raise ValueError("the library decodes a text differently")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([len(packed) // 4 for packed in ids], pa.int64()),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids binary, n_tokens long, decoded string"
    )


def model_bytes(path: str | None = None) -> bytes:
    """The model file's bytes; by default the public 32k merge model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as source:
        return source.read()


@register("op7_piece_agenda")
def op7_piece_agenda(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_decode(table(spark, folder, "documents"), model_bytes())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
