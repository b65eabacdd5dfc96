"""Byte-level BPE encoding and decoding over Arrow batches.

Byte-level BPE writes each byte as one printable character and merges characters.
The tokenizers library does the merging.  Its rules split a text into
pre-tokens and merge each by itself, so a text's ids are those of its chunks in
turn, wherever the chunks end between pre-tokens.  A chunk's ids are computed
once by the library and then looked up; lookups are bounded by ``CACHE`` chunks.

Cuts: a space or newline between two characters that aren't white space always
starts a pre-token (`` ?x`` takes one space along; a lone newline is one
pre-token).  Texts with other white space, or with runs of it, are handed to the
library whole.

Null texts count as empty and give no ids.  Lone surrogates can't occur in
Arrow strings.  Very long texts are encoded whole.  Each row is encoded by itself, so
repeated rows and ids each get a row, and an empty table gives none.  Of the input's
columns only id and text are read, so others can't clash.  Where a character's bytes
fall to several ids, each of these starts at that character.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, clean, rows_of, to_batch

#: Chunks whose ids a worker remembers.
CACHE = 400_000
#: Marks that end a word's chunk as one pre-token of their own; the apostrophe, which starts contractions, isn't one.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file in the tokenizers library's format."""

    _open: dict[tuple[str, bool], ByteBPE] = {}

    def __init__(self, path: str, special: bool = False):
        """``special``: the vocabulary's special tokens are found in texts, as the library does by default."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not special
        self.characters = byte_characters()
        back = {c: b for b, c in enumerate(self.characters)}
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.wide = np.uint16 if size <= 1 << 16 else np.uint32
        self.code = "H" if size <= 1 << 16 else "I"
        added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special = [c for c in added.values() if c] if special else []
        self.bytes_of = [
            added[i].encode() if i in added else bytes(back[c] for c in self.lib.id_to_token(i) or "") for i in range(size)
        ]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.seen: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.newline = self._merge("\n")

    @classmethod
    def get(cls, path: str, special: bool = False) -> ByteBPE:
        """One encoder for each worker process, file and use of special tokens."""
        if (path, special) not in cls._open:
            cls._open[path, special] = cls(path, special)
        return cls._open[path, special]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pre_token: str) -> bytes:
        """Ids of one pre-token, by the library's model on the bytes' characters."""
        text = "".join(map(self.characters.__getitem__, pre_token.encode()))
        return array(self.code, [t.id for t in self.lib.model.tokenize(text)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Remember chunks: words with marks after them by their parts, others by the library as they are."""
        seen, others = self.seen, []
        for c in chunks:
            lead = c[0]
            bare = lead == "\0" or lead == "\n"
            body = c[1:] if bare else c
            word = body.rstrip(_MARKS)
            if not word.isalpha():
                others.append(c)
                continue
            key = "\0" + word if bare else word
            if (ids := seen.get(key)) is None:
                ids = seen[key] = self._merge(word if bare else " " + word)
            if marks := body[len(word) :]:
                if (tail := self.marks.get(marks)) is None:
                    tail = self.marks[marks] = self._merge(marks)
                ids = ids + tail
            seen[c] = self.newline + ids if lead == "\n" else ids
        plain = [c[1:] if c[0] == "\0" else c if c[0] == "\n" else " " + c for c in others]
        for at in range(0, len(others), 20_000):
            seen.update(zip(others[at : at + 20_000], self._library(plain[at : at + 20_000])))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        if len(self.seen) > CACHE:
            self.seen.clear()
            self.marks.clear()
        # " x" is looked up as "x", "\nx" as itself, and a text's first chunk as "\0" + chunk
        cut: list[list[str] | None] = []
        whole: list[str] = []
        new: set[str] = set()
        for text in texts:
            text = text or ""
            chunks = text.replace("\n", " \n").split(" ")
            if "\0" in text or "" in chunks or "\n" in chunks or len(text.split()) != len(chunks) or any(s in text for s in self.special):
                cut.append(None)  # white space other than single spaces and newlines between words, or special tokens
                whole.append(text)
            else:
                chunks[0] = "\0" + chunks[0]
                cut.append(chunks)
                new.update(chunks)
        seen = self.seen
        self._learn(new.difference(seen))
        others = iter(self._library(whole))
        get = seen.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)) if chunks else next(others), self.wide) for chunks in cut]

    def decode(self, ids) -> bytes:
        """The bytes of the ids; any cut between ids is allowed, also inside a character."""
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def byte_offsets(self, ids) -> np.ndarray:
        """Start of each id's bytes in the encoded text, and the end of the last."""
        return np.concatenate(([0], np.cumsum(self.lengths[np.asarray(ids, np.int64)])))


def character_offsets(text: str, byte_offsets: np.ndarray) -> np.ndarray:
    """Character positions for byte positions; a split character counts where it starts."""
    if text.isascii():
        return np.asarray(byte_offsets)
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.concatenate((np.cumsum((raw & 0xC0) != 0x80), [len(text)]))
    at = np.asarray(byte_offsets)
    inside = np.append((raw & 0xC0) == 0x80, False)[at]
    before = np.where(at > 0, starts[np.maximum(at - 1, 0)], 0)
    return np.where(inside, before - 1, before)


def decode_stream(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of byte pieces that may split characters: an unfinished character waits for the next piece."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """One Arrow list of 32-bit integers for each array."""
    edges = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32)))


_TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("byte_starts", pa.list_(pa.int32())), ("char_starts", pa.list_(pa.int32()))])


def _encoded(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = ByteBPE.get(path)
    for batch in batches:
        keys, texts = rows_of(batch, "id", "text")
        ids = bpe.encode_batch(texts)
        offsets = [bpe.byte_offsets(i)[:-1] for i in ids]
        chars = [character_offsets(t or "", o) for t, o in zip(texts, offsets)]
        yield to_batch(_TOKENS, [keys, _lists(ids), _lists(offsets), _lists(chars)])


def _decoded(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the decoded bytes in the place of the ids."""
    bpe = ByteBPE.get(path)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        decoded = [bpe.decode(ids.values.drop_null().to_numpy()) if ids.is_valid else b"" for ids in batch.column(at)]
        yield batch.set_column(at, "decoded", pa.array(decoded, pa.binary()))


def encode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per input row: id, ids, and where each id starts in bytes and characters."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    bounded_batches(spark)
    rows = clean(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _encoded(path, b), "id long, ids array<int>, byte_starts array<int>, char_starts array<int>").withColumnRenamed("id", id_col)


def decode(spark: SparkSession, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """One row per input row: id and the decoded bytes.  Null ids, whole lists or single ones, give no bytes."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    rows = clean(tokens, id=id_col, ids=ids_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(lambda b: _decoded(path, b), "id long, decoded binary").withColumnRenamed("id", id_col)


def _listed(column: pa.ListArray) -> list[str]:
    """Digests of the numbers of each list in decimal, joined by one space."""
    words = pa.ListArray.from_arrays(column.offsets, column.values.cast(pa.string()))
    joined = pa.compute.binary_join(words, " ").cast(pa.binary())
    return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]


def digest(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Digests of what ``encode`` and ``decode`` give: ids, decoded bytes, and byte and character offsets.

    A batch is encoded, decoded from its ids and digested in one worker: no shuffle, nothing written.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    fields = ("ids", "byte_starts", "char_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _encoded(path, batches):
            lists = {c: tokens.column(tokens.schema.get_field_index(c)) for c in fields}
            own = {f"{c}_sha256": _listed(v) for c, v in lists.items()}
            own["n_tokens"] = lists["ids"].value_lengths().cast(pa.int64())
            for back in _decoded(path, [tokens.select(["id", "ids"])]):
                own["decoded_sha256"] = [hashlib.sha256(x.as_buffer()).hexdigest() for x in back.column(1)]
            yield to_batch(_DIGEST, [tokens.column(0), *[own[c] for c in _DIGEST.names[1:]]])

    bounded_batches(spark)
    rows = clean(docs, id=id_col, text=text_col)
    columns = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, byte_starts_sha256 string, char_starts_sha256 string"
    return rows.mapInArrow(run, columns).withColumnRenamed("id", id_col)


_DIGEST = pa.schema(
    [("id", pa.int64()), ("n_tokens", pa.int64())] + [(f"{c}_sha256", pa.string()) for c in ("ids", "decoded", "byte_starts", "char_starts")]
)
