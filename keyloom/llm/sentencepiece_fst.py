"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from the model file, each with states, arcs and weights:

* the normaliser reads characters and writes them in the model's form: a word-boundary mark
  before the text, blanks to marks, and, where the model says so, no blanks at either end
  or in a row;
* the lexicon is a trie that reads characters and writes pieces. Where a character is no piece,
  byte arcs write the ids of its bytes;
* the grammar reads pieces. Of a unigram model it has one state, and the pieces' weights are
  their negative scores. Of a BPE model its states are the piece read last, and it has an
  arc exactly where two pieces are what BPE makes of their joint text: of all segmentations
  BPE's is the only one whose neighbours all agree in that sense. An arc costs one; missing arcs
  weigh infinity. Which arcs there are is found out when they are first asked for, and kept.

Each input is composed with the machines place by place, without building the product, and
the shortest path is taken in the tropical semiring: weights along a path are added, and of
the paths to one place and state the least stays. Models that need anything else (a
character map, pieces of the user, marks as suffixes, no byte fallback) are refused.

Inputs are composed segment by segment: where no piece holds two neighbouring
characters side by side, no path depends on what lies across, and the path of the
whole text is the sequence of the segments' paths. Frequent segments' ids are kept
in a bounded cache of the worker.

Decoding maps ids to bytes, marks back to spaces, and drops the first mark; bytes
that are no UTF-8 become replacement characters. The mark itself in a text decodes
to a space, as in the model's own decoder.

Scale: one map over the rows, no shuffle, whole texts; memory is bounded by the
caches and one document's ids. Defined results: null or empty text has no ids;
repeated rows give equal values. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import map_arrow, read

MARK = "▁"
#: Segments that a worker remembers, the longest of them in characters, and pairs of pieces.
CACHED_SEGMENTS, CACHED_CHARS, CACHED_PAIRS = 300_000, 40, 1_000_000
_INFINITE = float("inf")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x00-\x7f{MARK}{_LETTERS}]*")
_RUNS = re.compile(rf"{MARK}*[{_LETTERS}]+|[0-9]|{MARK}*[^{MARK}{_LETTERS}0-9]+|{MARK}+")


#: How much less than the least score an unknown character scores, and the kinds of model and of pieces.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Normaliser:
    """``arcs[state]`` has (next state, output) by character; "" stands for all others, and an output of None for a copy."""

    START, BODY, BLANK = range(3)

    def __init__(self, spec):
        if spec.precompiled_charsmap or spec.normalization_rule_tsv or not spec.escape_whitespaces:
            raise ValueError("a normaliser with a character map, or that keeps blanks, is not supported")
        first = MARK if spec.add_dummy_prefix else ""
        if spec.remove_extra_whitespaces:  # a blank is written with the character after it, if there is one
            self.arcs = [
                {" ": (self.START, ""), "": (self.BODY, None)},
                {" ": (self.BLANK, ""), "": (self.BODY, None)},
                {" ": (self.BLANK, ""), "": (self.BODY, None)},
            ]
            self.before = [first, "", MARK]  # written before a copy
        else:
            self.arcs = [{" ": (self.BODY, first + MARK), "": (self.BODY, None)}, {" ": (self.BODY, MARK), "": (self.BODY, None)}]
            self.before = [first, ""]
        # states that all arcs lead back to: the rest of an input is rewritten at once, for no output is read again
        self.rest = [
            [(c, out) for c, (_, out) in arcs.items() if c] if all(to == state for to, _ in arcs.values()) and not self.before[state] else None
            for state, arcs in enumerate(self.arcs)
        ]

    def __call__(self, text: str) -> str:
        state, out = self.START, []
        for at, char in enumerate(text):
            if (pairs := self.rest[state]) is not None:
                rest = text[at:]
                for read, written in pairs:
                    rest = rest.replace(read, written)
                out.append(rest)
                break
            arcs = self.arcs[state]
            to, written = arcs.get(char) or arcs[""]
            out.append(self.before[state] + char if written is None else written)
            state = to
        return "".join(out)


class Lexicon:
    """A trie: ``arcs[state]`` has the next state by character, ``ends[state]`` the (piece, weight) that ends there."""

    def __init__(self, weights: dict[str, float], unknown: float):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, float] | None] = [None]
        self.unknown = unknown  # the weight of a character's byte arcs
        for piece, weight in weights.items():
            state = 0
            for char in piece:
                if char not in self.arcs[state]:
                    self.arcs[state][char] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][char]
            self.ends[state] = (piece, weight)


class OneState:
    """The grammar of a unigram model: any piece may follow any other."""

    unique = False

    def weight(self, state: str, piece: str) -> float:
        return 0.0

    def after(self, state: str, piece: str) -> str:
        return state


class Agreement:
    """The grammar of a BPE model: states are the piece read last, "" at a segment's start."""

    #: No place has two finite paths.
    unique = True

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.weights: dict[tuple[str, str], float] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that BPE leaves of a short text: the best-scored pair first, the leftmost of equals."""
        symbols, score = list(text), self.scores.get
        pairs = [score(a + b, -_INFINITE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) > -_INFINITE:
            at = pairs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], -_INFINITE)
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], -_INFINITE)
        return symbols

    def weight(self, state: str, piece: str) -> float:
        found = self.weights.get((state, piece))
        if found is None:
            wanted = [state, piece] if state else [piece]
            found = 0.0 if self.merged(state + piece) == wanted else _INFINITE
            if len(self.weights) >= CACHED_PAIRS:
                self.weights.clear()
            self.weights[state, piece] = found
        return found

    def after(self, state: str, piece: str) -> str:
        return piece


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, trainer = [p.type for p in model.pieces], model.trainer_spec
        if trainer.model_type not in (UNIGRAM, BPE) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
            raise ValueError("only unigram and BPE models with byte fallback and no pieces of the user are supported")
        if trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("marks as suffixes and denormalisers are not supported")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.prefixed = model.normalizer_spec.add_dummy_prefix
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = [p.piece.encode() if p.type == NORMAL else b"" for p in model.pieces]
        for byte, i in self.byte_ids.items():
            self.bytes[i] = bytes([byte])
        self.joined = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        if trainer.model_type == BPE:
            self.lexicon, self.grammar = Lexicon(dict.fromkeys(scores, 1.0), 1.0), Agreement(scores)
        else:
            worst = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
            self.lexicon, self.grammar = Lexicon({p: -score for p, score in scores.items()}, -worst), OneState()
        # runs may be cut by character class only if no piece spans two classes
        kind = lambda c: "_" if c == MARK else "L" if re.fullmatch(f"[{_LETTERS}]", c) else "N" if c in "0123456789" else "P"
        plain = [pair for pair in self.joined if _PLAIN.fullmatch(pair)]
        self.by_class = all(a == b and a != "N" or a == "_" and b in "LP" for a, b in ((kind(p[0]), kind(p[1])) for p in plain))
        self.cache: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        return self.normaliser(text)

    def shortest(self, text: str) -> list[str]:
        """The pieces on the shortest path of one segment through lexicon and grammar."""
        return self._only(text) if self.grammar.unique else self._least(text)

    def _only(self, text: str) -> list[str]:
        """As ``_least`` for a grammar that gives each place one finite path: the first that comes is the least."""
        n, lexicon, grammar = len(text), self.lexicon, self.grammar
        arcs, ends, known, pieces = lexicon.arcs, lexicon.ends, grammar.weights, self.pieces
        states: list[str | None] = [None] * (n + 1)  # the grammar's, which is the piece read last
        weights = [0.0] * (n + 1)
        states[0] = ""
        for at in range(n):
            state = states[at]
            if state is None:
                continue
            char = text[at]
            if char not in pieces and states[at + 1] is None and (more := grammar.weight(state, char)) < _INFINITE:
                states[at + 1], weights[at + 1] = char, weights[at] + lexicon.unknown + more
            node = 0
            for end in range(at, n):
                node = arcs[node].get(text[end])
                if node is None:
                    break
                if states[end + 1] is None and (arc := ends[node]) is not None:
                    more = known.get((state, arc[0]))
                    if more is None:
                        more = grammar.weight(state, arc[0])
                    if more < _INFINITE:
                        states[end + 1], weights[end + 1] = arc[0], weights[at] + arc[1] + more
        path, at = [], n
        while at:
            path.append(states[at])
            at -= len(path[-1])
        return path[::-1]

    def _least(self, text: str) -> list[str]:
        n, lexicon, grammar = len(text), self.lexicon, self.grammar
        # by place: grammar state to (weight so far, state before, piece read)
        best: list[dict[str, tuple[float, str, str]]] = [{} for _ in range(n + 1)]
        best[0][""] = (0.0, "", "")
        for at in range(n):
            for state, (so_far, _, _) in best[at].items():
                found = [] if text[at] in self.pieces else [(at + 1, text[at], lexicon.unknown)]
                node = 0
                for end in range(at, n):
                    node = lexicon.arcs[node].get(text[end])
                    if node is None:
                        break
                    if lexicon.ends[node] is not None:
                        found.append((end + 1, *lexicon.ends[node]))
                for place, piece, weight in found:
                    total = so_far + weight + grammar.weight(state, piece)
                    after, to = grammar.after(state, piece), best[place]
                    if total < (to[after][0] if after in to else _INFINITE):
                        to[after] = (total, state, piece)
        path, at = [], n
        state = min(best[n], key=lambda s: best[n][s][0])
        while at:
            _, before, piece = best[at][state]
            path.append(piece)
            at, state = at - len(piece), before
        return path[::-1]

    def segments(self, text: str) -> list[str]:
        """A normalised text, cut wherever no piece joins the two characters."""
        if self.by_class and _PLAIN.fullmatch(text):
            return _RUNS.findall(text)
        joined, out, at = self.joined, [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in joined:
                out.append(text[at:k])
                at = k
        out.append(text[at:])
        return out

    def _ids(self, segment: str) -> bytes:
        out = []
        for piece in self.shortest(segment):
            if (known := self.pieces.get(piece)) is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "replace"))
        found = b"".join(i.to_bytes(4, "little") for i in out)
        if len(segment) <= CACHED_CHARS and len(self.cache) < CACHED_SEGMENTS:
            self.cache[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not (text := self.normalised(text)):
            return b""
        known, ids = self.cache.get, self._ids
        return b"".join([known(s) or ids(s) for s in self.segments(text)])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefixed and text.startswith(" ") else text


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process and file."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(fst.encode(t or ""), "<i4") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(i) for i in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids: an empty text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            texts = [fst.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select(F.col("doc_id").cast("bigint"), "ids"), make, "doc_id bigint, text string")


DIGESTS = "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, text_crc32 bigint, round_trip boolean"


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGESTS of every row's ids and of the text that they decode to."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        bytewise = np.zeros(len(fst.bytes), bool)
        bytewise[list(fst.byte_ids.values())] = True
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                own = fst.encode(text or "")
                ids = np.frombuffer(own, "<i4")
                back = fst.decode(ids)
                for column, value in zip(out, (len(ids), int(bytewise[ids].sum()), zlib.crc32(own), zlib.crc32(back.encode()), back == (text or "")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.bool_())], [f.split()[0] for f in DIGESTS.split(", ")])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, DIGESTS)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), model_path())
