"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass one tokenises each document once and writes the ids with the document's place
in its own partition (the partition's running total). Pass two adds up the totals
of the partitions, one row each, to global offsets and joins them to the rows. From there every document is
cut on its own where a window ends; a document over a boundary leaves one record on
each side. Only the last window is padded. Nothing is sorted or shuffled.

The partition number is written with the rows, so a lost executor or a later read
by other splits changes nothing. Null text counts as empty and has the end id only.
Repeated rows are packed once each; other columns are ignored; an empty table gives
no pieces.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import BLANKS, slices, staged, table

WINDOW = 2048
END_ID = 1
PIECES_HELD = 150_000
PIECE_CHARS_HELD = 64
# Bytes of text that become Python strings, and characters that are cut into pieces, at a time.
SLICE_BYTES = 1 << 20
CUT_CHARS = 1 << 18
# The split pattern of the public word model, and the same for lower-cased Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT_LATIN = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    rb"|[^\x09-\x0d\x20\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_LATIN_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_BLANKS = re.compile(f"[{BLANKS}]+")
TOKEN_SCHEMA = "doc_id long, part int, place long, n_tokens long, ids binary"


# The letters that stand for bytes in byte-level models: printable ones for themselves, then those from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCoder:
    """The tokenizer with a bounded memory of the pieces that texts are made of.

    The model never joins across white space, and the word model cuts what is left by a
    fixed pattern before it looks anything up, so a text's ids are those of its pieces.
    Latin-1 words are lower-cased and cut here; other words, and all words of models
    with another pattern, are remembered whole. A text with one of the model's special
    strings, whose ids may span words, goes to the library as it is. A piece may have
    no ids at all, such as a lone U+2028.
    """

    def __init__(self, model: str):
        # A task has one core; the library's own threads would only compete for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cuts_latin = self._has_word_pattern()
        # Pieces seen lately; when they are too many they become the older ones.
        self.known: dict[bytes | str, bytes] = {}
        self.older: dict[bytes | str, bytes] = {}

    def _has_word_pattern(self) -> bool:
        """Whether the model normalises and splits as ``_SPLIT_LATIN`` does."""

        def parts(step, name: str) -> list[dict]:
            # The step's own state, so that the vocabulary is not parsed once more.
            read = json.loads(step.__getstate__()) if step is not None else {}
            return read.get(name) or [read]

        normal = [n.get("type") for n in parts(self.library.normalizer, "normalizers")]
        steps = parts(self.library.pre_tokenizer, "pretokenizers")
        split, last = steps[0], steps[-1]
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and split.get("type") == "Split"
            and split.get("pattern") == {"Regex": SPLIT}
            and split.get("behavior") == "Removed"
            and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
            and not last.get("add_prefix_space")
            and not last.get("use_regex")
        )

    def _pieces(self, text: str) -> list[bytes | str]:
        if self.cuts_latin:
            try:
                return _SPLIT_LATIN.findall(text.encode("latin-1").translate(_LATIN_LOWER))
            except UnicodeEncodeError:
                pass
        found: list[bytes | str] = []
        for word in _BLANKS.split(text):
            if self.cuts_latin and max(word, default="") <= "\xff":
                found += _SPLIT_LATIN.findall(word.encode("latin-1").translate(_LATIN_LOWER))
            elif word:
                found.append(word)
        return found

    def _learn(self, pieces: set[bytes | str]) -> list[bytes | str]:
        """Makes all of these known; returns those too long to be kept."""
        if len(self.known) > PIECES_HELD // 2:
            self.older, self.known = self.known, {}
        new = pieces.difference(self.known)
        self.known.update((piece, self.older[piece]) for piece in new if piece in self.older)
        new = list(new.difference(self.older))
        cut = [piece for piece in new if isinstance(piece, bytes)]
        self.known.update(zip(cut, map(self._model_code, cut)))
        whole = [piece for piece in new if isinstance(piece, str)]
        self.known.update(zip(whole, self._library_codes(whole)))
        return [piece for piece in new if len(piece) > PIECE_CHARS_HELD]

    def _model_code(self, piece: bytes) -> bytes:
        """Ids of a piece that is normalised and cut already: straight from the library's model."""
        if not piece.isalnum():  # of bytes: other than ASCII letters and digits
            piece = piece.decode("latin-1").encode().decode("latin-1").translate(_BYTE_LETTERS).encode()
        return _ids([token.id for token in self.model.tokenize(piece.decode())])

    def _library_codes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from one call: they go joined by a special string, and the ids are cut at its id."""
        if not self.special or len(texts) < 2:
            return [_ids(self.library.encode(text, add_special_tokens=False).ids) for text in texts]
        mark = self.special[0]
        joined = self.library.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        cuts = np.flatnonzero(ids == self.library.token_to_id(mark)) * 4
        if len(cuts) != len(texts) - 1:
            raise ValueError("the model does not keep its special strings apart")
        data = ids.tobytes()
        return [data[start:end] for start, end in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)])]

    def _cut_codes(self, text: str) -> bytes:
        pieces = self._pieces(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            passing = self._learn(set(pieces))
        ids = b"".join(map(self.known.__getitem__, pieces))
        for piece in passing:
            del self.known[piece]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(mark in text for mark in self.special):
            return _ids(self.library.encode(text, add_special_tokens=False).ids)
        if len(text) <= CUT_CHARS:
            return self._cut_codes(text)
        found, at = [], 0
        while at < len(text):
            blank = _BLANKS.search(text, at + CUT_CHARS)
            end = blank.start() if blank else len(text)
            found.append(self._cut_codes(text[at:end]))
            at = end
        return b"".join(found)


_CODERS: dict[int, WordCoder] = {}


def _coder(model: str) -> WordCoder:
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(model)
    return _CODERS[key]


def tokenise(docs: DataFrame, model: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, place, n_tokens and ids; place is the partition's total before the document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, place = _coder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                codes = [coder.encode(text or "") + end for text in rows.column(1).to_pylist()]
                lengths = np.array([len(code) // 4 for code in codes], np.int64)
                ends = place + np.cumsum(lengths)
                place = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).cast(pa.int64()),
                        pa.array(np.full(len(codes), part, np.int32)),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(codes, pa.binary()),
                    ],
                    ["doc_id", "part", "place", "n_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKEN_SCHEMA)


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of documents: sequence_id, offset, start, length, ids (binary), doc_tokens.

    ``tokens`` must be a written table, since its rows are read twice. The running
    total over its partitions is a window over one row per partition, joined back.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    size = F.lit(window)
    # A row per write task of the token table: 16 bytes each, a few megabytes at 100,000 tasks.
    placed = tokens.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("place"))
    last = F.col("first") + F.col("n_tokens") - 1

    def piece(sequence):
        begin = F.greatest(sequence * size, F.col("first"))
        end = F.least((sequence + 1) * size, last + 1)
        start = begin - F.col("first")
        return F.struct(
            sequence.alias("sequence_id"),
            (begin - sequence * size).alias("offset"),
            start.alias("start"),
            (end - begin).alias("length"),
            F.substring("ids", (start * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
        )

    sequences = F.sequence(F.floor(F.col("first") / size), F.floor(last / size))
    pieces = placed.select(
        "doc_id",
        F.col("n_tokens").alias("doc_tokens"),
        F.explode(F.transform(sequences, piece)).alias("p"),
    )
    return pieces.select("doc_id", "p.*", "doc_tokens")


def pack(docs: DataFrame, model: str, window: int = WINDOW) -> DataFrame:
    """Tokenise, write, cut."""
    return cut(staged(tokenise(docs, model), "tokens"), window)


def model_text(path: str | None = None) -> str:
    """The model file's text; by default the public 49k word model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as source:
        return source.read()


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The registered form: ids as their CRC-32."""
    return pack(docs, model_text()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register("op9_concat_cut")
def op9_concat_cut(spark: SparkSession, folder: str) -> DataFrame:
    return packed_pieces(table(spark, folder, "documents"))
