"""Packing by power-of-two decomposition.

A document's tokens (and its end id) are cut into full windows and the rest by
the binary digits of its length, largest first, so every piece is as long as a
power of two, at most the window. Each piece is a sequence of its own: sequences
of one length form a bucket, need no padding, and never cross documents.

Tokens come from a public tokenizer file. One of the form in ``CUTS`` drops white space and looks at no
context beyond it, so texts are cut at ASCII white space (plain texts also where
letters, digits and the rest meet) and the ids of each word are looked up in a
bounded cache of the worker; words that it lacks are encoded together, batch by
batch. That gives the ids of the whole text exactly. With a file of any other form whole
texts are given to the tokenizer.

Scale: one map over the rows, no shuffle, and the writing of the buckets; memory is bounded by the Arrow batch,
the cache and one document's ids. Ids of sequences are partition and counter, so
a task that runs again numbers its pieces as before.

Defined results: a null or empty text has only its end id, one piece of length
1. A null doc_id stays null; repeated rows are packed each. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, map_arrow, read

WINDOW = 2048
END_ID = 1
#: Words that a worker remembers, and the longest of them in characters.
CACHED_WORDS, CACHED_CHARS = 300_000, 40
#: Letters whose lower case is one letter and that no composition changes. In texts of
#: these, digits, other ASCII (without the apostrophe, which joins some endings) and
#: white space, the tokenizer takes runs of letters, digits, and runs of the rest apart.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x26\x28-\x7e\n\t\r{_LETTERS}]*")
_TOKENS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_RUN = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Byte-level tokenizers show bytes that aren't printable in Latin-1 as the characters from 256 on, in order.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD))}
#: Characters of a text that are split into words at once.
PART_CHARS = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: The normaliser and the splits of tokenizers that treat words apart.
CUTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
)


def cuts(path: str) -> bool:
    """Whether the file's tokenizer is of the form in CUTS."""
    made = json.loads(Path(path).read_text(encoding="utf-8"))
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") for t in made.get("added_tokens") or ())
    return plain and (made.get("normalizer"), splits[0]) == CUTS and [s["type"] for s in splits[1:]] == ["ByteLevel"] and made["model"]["type"] == "BPE"


class WholeEncoder:
    """Little-endian 32-bit ids of texts, each given to the tokenizer whole."""

    whole = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder:
    """Little-endian 32-bit ids of texts, by a tokenizer that treats words apart."""

    whole = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._ids: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        whole = [w for w in words if not _RUN.fullmatch(w)]
        found = zip(whole, (e.ids for e in self._tokenizer.encode_batch_fast(whole, add_special_tokens=False)), strict=True)
        # a lower-case run is one unit of the tokenizer, so its model is asked at once
        runs = ((w, [t.id for t in self._model.tokenize(w.encode().decode("latin-1").translate(_SHOWN))]) for w in words if _RUN.fullmatch(w))
        return {w: array("I", ids).tobytes() for w, ids in (*found, *runs)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Only ASCII white space cuts: other kinds are left to the tokenizer."""
        split = [_words(t) for t in texts]
        known = self._ids
        missing = set(chain.from_iterable(split)).difference(known)
        if missing:
            known.update(self._encode(list(missing)))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        room = CACHED_WORDS + len(missing) - len(known)
        for word in missing:
            if len(word) > CACHED_CHARS or room <= 0:
                del known[word]
            else:
                room -= 1
        return out


def _words(text: str) -> list[str]:
    if "<|" not in text and _PLAIN.fullmatch(text):  # else perhaps a special token
        return _TOKENS.findall(text.lower())
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end at a space, or all of it where it has none."""
    at = 0
    while len(text) - at > PART_CHARS:
        end = text.find(" ", at + PART_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def pieces(n: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then the binary digits of the rest."""
    for at in range(0, n - window + 1, window):
        yield at, window
    at = n - n % window
    for bit in range(window.bit_length() - 2, -1, -1):
        if n >> bit & 1:
            yield at, 1 << bit
            at += 1 << bit


_encoders: dict[str, WordEncoder | WholeEncoder] = {}


def encoder(path: str) -> WordEncoder | WholeEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path) if cuts(path) else WholeEncoder(path)
    return _encoders[path]


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PIECES, sequence_id and offset (always 0: a piece is a sequence)."""
    if window & (window - 1) or window < 1:
        raise ValueError(f"the window must be a power of two, not {window}")
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if encode.whole or sum(map(len, texts)) <= PART_CHARS:
                    ids = encode(texts)
                else:
                    ids = [b"".join(encode([p])[0] for p in _parts(t)) for t in texts]
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, own in zip(part.column(0).to_pylist(), ids, strict=True):
                    own += end
                    n = len(own) // 4
                    view = memoryview(own)
                    for start, length in pieces(n, window):
                        out[1].append(start)
                        out[2].append(length)
                        out[3].append(zlib.crc32(view[4 * start : 4 * (start + length)]))
                    more = len(out[1]) - len(out[0])
                    out[0].extend(repeat(doc, more))
                    out[4].extend(repeat(n, more))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, pack, PIECES).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def bucketed(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """The pieces, written as one folder for each length and read again: a reader of one folder needs no padding.

    Ids of sequences are fixed by the writing.
    """
    return scratch.cut(pieces, "buckets", by="length").select(*pieces.columns)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(packed(read(spark, sf_dir, "documents"), tokenizer_path()), Scratch(spark, "op9"))
