"""Byte-level BPE over Arrow batches with the ``tokenizers`` library.

A text is cut before each blank that follows a character other than white space. The split pattern
always begins a new match there, so the pieces can be encoded one by one and each distinct piece
only once per worker: natural text repeats its words.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, memory

CACHE_PIECES, CACHE_WORDS = 300_000, 60_000  # entries of one generation of a worker's memory (about 70 MB together)
LONG_PIECE = 200  # longer pieces are not remembered
_GAP = re.compile(r"(?<=\S) ")
_WIDE_GAP = re.compile(r"\s ")
# a word, a mark behind it, a line end and the next word: letters of the Latin blocks only, so that
# the pattern's matches are certain
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+"
_PLAIN = re.compile(f"( ?{_LETTERS})([.,]?)(?:(\n)({_LETTERS})([.,]?))?")


def byte_table() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(c) for _, c in sorted([*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(other))])]


def read_vocabulary(path: str) -> bytes:
    """The content of a ``.json`` tokenizer or a ``.tiktoken`` rank file (about 1 MB, fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_of(content: bytes, pattern: str | None = None):
    """A ``tokenizers.Tokenizer`` from a JSON file's content, or from ranks and their split pattern.

    Ranks hold no merges: every split of a token into two tokens is one, in the order of the ranks.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if content.lstrip()[:1] == b"{":
        t = Tokenizer.from_str(content.decode("utf-8"))
        t.encode_special_tokens = True
        return t
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    char = byte_table()
    name = {k: "".join(char[b] for b in k) for k in ranks}
    merges = [
        (name[k[:i]], name[k[i:]])
        for k in sorted(ranks, key=ranks.get) for i in range(len(k) - 1, 0, -1) if k[:i] in ranks and k[i:] in ranks
    ]
    t = Tokenizer(models.BPE(vocab={name[k]: r for k, r in ranks.items()}, merges=merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocabulary = tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for text, i in vocabulary.items():
        out[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
    return out


def pieces(text: str) -> list[str]:
    """Cut before each blank behind a non-space character; the joined pieces are the text."""
    cut = text.split(" ") if _WIDE_GAP.search(text) is None else _GAP.split(text)
    return cut[:1] + [" " + x for x in cut[1:]]


class Remembered:
    """A dictionary of two generations: when the young one is full it becomes the old one."""

    def __init__(self, most: int = CACHE_PIECES):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        if len(key) <= LONG_PIECE:
            self.young[key] = value


class Coder:
    """Encodes whole texts; remembers the ids of pieces and of the pattern's matches in them."""

    def __init__(self, content: bytes, pattern: str | None = None):
        self.tokenizer = tokenizer_of(content, pattern)
        self.model = self.tokenizer.model
        self.tokens = token_bytes(self.tokenizer)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.char = dict(enumerate(byte_table()))
        self.pieces, self.words = Remembered(), Remembered(CACHE_WORDS)
        self.blank = self.char[0x20]

    def _ids(self, shown: str) -> bytes:
        """Ids of one match of the pattern, whose bytes are written as characters, by the merges alone."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            # each byte as the character that stands for it
            got = self._ids(word.encode("utf-8").decode("latin-1").translate(self.char))
            self.words.put(word, got)
        return got

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():  # ASCII letters stand for themselves
            if piece.isalpha():
                return self._ids(piece)
            if piece[:1] == " " and piece[1:].isalpha():
                return self._ids(self.blank + piece[1:])
        plain = _PLAIN.fullmatch(piece)
        if plain:
            return b"".join([self._word(x) for x in plain.groups() if x])
        e = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0]
        return np.array(e.ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null has none."""
        if not text:
            return np.zeros(0, "<u4")
        parts = pieces(text)
        young = self.pieces.young
        ids = [*map(young.get, parts)]
        if None in ids:
            old, most = self.pieces.old, self.pieces.most
            for i, x in enumerate(ids):
                if x is None:
                    p = parts[i]
                    x = young.get(p)  # met earlier in this text
                    if x is None:
                        x = old.get(p)
                        if x is None:
                            x = self._piece(p)
                        if len(young) >= most:
                            old, young = young, {}
                            self.pieces.old, self.pieces.young = old, young
                        if len(p) <= LONG_PIECE:
                            young[p] = x
                    ids[i] = x
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, raw: bytes) -> np.ndarray:
        """Code point at which each token starts; a token inside a split character has its code point."""
        at = np.cumsum(np.r_[0, self.sizes[ids]])[:-1]
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first) - 1)[at] if len(at) else at


def decode_text(data: bytes) -> str:
    """Text of decoded bytes; what is left of a split character becomes U+FFFD."""
    return data.decode("utf-8", "replace")


MEMORY = "coders"
_lock = threading.Lock()


def worker_coder(content: bytes, pattern: str | None) -> Coder:
    """The coder of this Python worker, built once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    key = (hashlib.md5(content).digest(), pattern)
    with _lock:
        coders = memory(MEMORY)
        if key not in coders:
            coders[key] = Coder(content, pattern)
        return coders[key]


_COLUMNS = {
    "ids": "array<int>", "offsets": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string",
    "decoded": "string",
}


def encode_documents(
    docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "offsets", "n_tokens"),
) -> DataFrame:
    """One row per input row: ``doc_id`` and the asked outputs.

    ``ids`` and ``offsets`` (code point where each token starts), ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by blanks), ``decoded`` (text decoded from the ids) and ``decoded_sha256`` (of
    the decoded bytes). The content of ``path`` is read on the driver and broadcast. A null or empty
    text has no tokens; ids may be null or repeat; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(vocabulary.value, pattern)
        digits = [str(i) for i in range(len(coder.tokens))] if "ids_sha256" in outputs else []
        for b in batches:
            out = {c: [] for c in outputs}
            for text in b["text"].to_pylist():
                ids = coder.encode(text)
                if "decoded_sha256" in outputs or "decoded" in outputs:
                    data = coder.decode(ids)
                for c in outputs:
                    if c == "ids":
                        x = ids.astype(np.int32)
                    elif c == "offsets":
                        x = coder.offsets(ids, (text or "").encode("utf-8")).astype(np.int32)
                    elif c == "n_tokens":
                        x = len(ids)
                    elif c == "ids_sha256":
                        x = hashlib.sha256(" ".join(map(digits.__getitem__, ids.tolist())).encode()).hexdigest()
                    elif c == "decoded":
                        x = decode_text(data)
                    else:
                        x = hashlib.sha256(data).hexdigest()
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(out[c], _ARROW[_COLUMNS[c]]) for c in outputs)], names=["doc_id", *outputs])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, " + ", ".join(f"{c} {_COLUMNS[c]}" for c in outputs))


_ARROW = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}

