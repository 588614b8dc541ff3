"""Byte-level BPE encoding and decoding with a public vocabulary.

The tokenizers library encodes; every match of the vocabulary's split pattern
is encoded by itself and special tokens are ordinary text.  A piece boundary
always lies before a blank or line feed that follows a character other than
white space, so texts are cut there.  Each distinct short cut is handed to the
library once per worker, until the table of known cuts reaches a fixed number of
bytes and is emptied; longer cuts are not remembered.

Decoding reverses the library's byte-to-character table: ids give bytes, and a
character split over several tokens is whole again once the bytes are joined.

Defined results: a null text is empty and has no tokens; repeated rows are
encoded alike; an empty table gives an empty table; input columns that clash
with the outputs (in any case) are replaced.  When decoding, null ids give no
bytes; a null or an id outside the vocabulary inside a list raises a ValueError.

A worker holds one tokenizer and one table of cuts: encoding and checking that
the ids decode to the text again happen in one pass, on blocks of rows that hold
about 2 MB of text, and ids stay in flat arrays.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termgrid.llm.common import blocks, lists, release, without

KNOWN_BYTES = 128 << 20  # what the cuts remembered by a worker take, with their ids
SHORT = 64  # characters of a cut that is remembered
ENTRY = 240  # bytes that an entry of the table takes beside the characters and the ids
BLOCK = 4 << 20  # characters of texts handed to the library at a time
DECODE_IDS = 1 << 20  # ids decoded at a time
CHAIN = 500  # new cuts handed to the library as one text
AFTER_BLANK = re.compile(r"\s[ \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n])")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One worker's tokenizer, its known cuts, and the bytes of every id."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        to_byte = byte_characters()
        tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode_cuts(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, given as cuts, as little-endian unsigned 32-bit numbers."""
        known, long = self.known, {}
        new = set(itertools.chain.from_iterable(texts)).difference(known)
        chained = [c for c in new if c[0] in " \n" and not c[-1].isspace()]
        alone = list(new.difference(chained))
        encoded = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        self._remember(alone, [np.array(e.ids, dtype="<u4").tobytes() for e in encoded], long)
        # cuts with a leading blank or line feed may stand one after another in a text without changing each other's tokens
        chains = [chained[i : i + CHAIN] for i in range(0, len(chained), CHAIN)]
        encoded = self.tokenizer.encode_batch_fast(["".join(c) for c in chains], add_special_tokens=False)
        for cuts, e in zip(chains, encoded):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.cumsum(list(map(len, map(str.encode, cuts))))
            last = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self._remember(cuts, [raw[a:b] for a, b in zip([0, *last], last)], long)
        if long:
            joined = [b"".join([known[c] if c in known else long[c] for c in cuts]) for cuts in texts]
        else:
            joined = [b"".join(map(known.__getitem__, cuts)) for cuts in texts]
        if self.known_bytes > KNOWN_BYTES:
            self.forget()
        return joined

    def forget(self) -> None:
        self.known.clear()
        self.known_bytes = 0

    def _remember(self, cuts: list[str], ids: list[bytes], long: dict[str, bytes]) -> None:
        if max(map(len, cuts), default=0) > SHORT:
            long.update((c, i) for c, i in zip(cuts, ids) if len(c) > SHORT)
            kept = [(c, i) for c, i in zip(cuts, ids) if len(c) <= SHORT]
            cuts, ids = [c for c, _ in kept], [i for _, i in kept]
        self.known.update(zip(cuts, ids))
        # one string of all cuts takes as many bytes a character as the widest of them, or more
        self.known_bytes += sys.getsizeof("".join(cuts)) + sum(map(len, ids)) + ENTRY * len(cuts)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, first, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= BLOCK or end == len(texts):
                out += self.encode_cuts([cut_text(t) for t in texts[first:end]])
                first, size = end, 0
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids one after another."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.lengths):
            raise ValueError("an id outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(total)].tobytes()

    def decode_lists(self, column: pa.Array):
        """The bytes of each row of a list column, null rows empty; some rows' flat ids at a time."""
        if column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).null_count:
            raise ValueError("a null among the ids")
        values, offsets, valid = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets), column.is_valid().to_numpy(zero_copy_only=False)
        first = 0
        while first < len(column):
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + DECODE_IDS, side="right")) - 1)
            ids = values[offsets[first] : offsets[end]].astype(np.int64)
            raw, at = self.decode(ids), np.concatenate(([0], np.cumsum(self.lengths[ids])))
            for row in range(first, end):
                yield raw[at[offsets[row] - offsets[first]] : at[offsets[row + 1] - offsets[first]]] if valid[row] else b""
            first = end

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First character and end character that each token covers, in whole or in part."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        return np.stack([character[ends - self.lengths[ids]], character[ends - 1] + 1], axis=1)


def cut_text(text: str) -> list[str]:
    """The text cut before every blank or line feed that follows another character than white space."""
    if not text:
        return []
    if "\0" in text or AFTER_BLANK.search(text):
        return CUT.split(text)
    cuts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return cuts if cuts[0] else cuts[1:]


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def encoded_blocks(batches, vocabulary: str, text: str):
    """(codec, rows, their texts, the ids of each as bytes), for blocks of rows of about 2 MB of text."""
    c = codec(vocabulary)
    try:
        for batch in batches:
            for first, end, _, _ in blocks(batch, text):
                rows = batch.slice(first, end - first)
                texts = [t or "" for t in rows.column(text).to_pylist()]
                yield c, rows, texts, c.encode(texts)
    finally:  # a worker is kept for other tasks, which need the memory
        c.forget()
        release()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", offsets: bool = False, exact: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, if asked for, ``offsets`` (character start and end of each token)
    and ``exact`` (the ids decode to the text's bytes)."""
    added = {"ids": T.ArrayType(T.IntegerType(), False)}
    if offsets:
        added["offsets"] = T.ArrayType(T.ArrayType(T.IntegerType()))
    if exact:
        added["exact"] = T.BooleanType()
    base = without(docs, *(a for a in added if a != text))

    def run(batches):
        for c, rows, texts, raw in encoded_blocks(batches, vocabulary, text):
            ids = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
            ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)))
            each = [ids[a:b] for a, b in zip(ends, ends[1:])]
            columns = [*rows.columns, lists(ends, ids)]
            if offsets:
                columns.append(pa.array([c.offsets(t, i).tolist() for t, i in zip(texts, each)], pa.list_(pa.list_(pa.int32()))))
            if exact:
                columns.append(pa.array([c.decode(i) == t.encode() for t, i in zip(texts, each)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, *added])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary: the bytes of the ids; null ids have none)."""
    base = without(docs, "decoded")

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                out = pa.array(c.decode_lists(rows.column(ids)), pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], [*rows.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encode, decode, and add n_tokens, ids_sha256 and decoded_sha256 in one pass, without carrying the ids."""

    base = without(docs, *(o for o in ("n_tokens", "ids_sha256", "decoded_sha256") if o != text))
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def run(batches):
        for c, rows, _, raw in encoded_blocks(batches, vocabulary, text):
            sizes = pa.array([len(r) // 4 for r in raw], pa.int64())
            ids = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
            back = pa.array([hashlib.sha256(c.decode(np.frombuffer(r, dtype="<u4"))).hexdigest() for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, sizes, ids, back], [*rows.schema.names, *added])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))
