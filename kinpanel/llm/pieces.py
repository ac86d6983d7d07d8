"""SentencePiece encoding and decoding: one Viterbi pass driven by an Aho-Corasick automaton over the pieces."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_REMEMBERED = 400_000
#: Rows of an Arrow batch that are worked on at a time.
_ROWS = 250
#: Runs that no piece crosses, given that the space sign stands only at the front of pieces.
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Pieces:
    """Pieces of a model file: texts by id, scores by id, ids of the byte pieces, id for unknown, and the prefix rule."""

    texts: list[str]
    scores: list[float]
    types: list[int]
    prefix: bool

    @property
    def unknown(self) -> int:
        return self.types.index(_UNKNOWN)

    @property
    def bytes_(self) -> dict[int, int]:
        return {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.types, strict=True)) if k == _BYTE}


def read_pieces(content: bytes, scores: str = "auto") -> Pieces:
    """Pieces of a SentencePiece model file.

    ``scores``: "file" takes the scores as they are (log probabilities in unigram files); "zipf" takes
    -log(rank + 2.7), since files of the BPE kind hold ranks in place of probabilities; "auto" decides by the file's kind.
    Files with a character map, or that cut white space, are refused.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(content)
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that leave the text as it is can be used")
    if scores == "auto":
        scores = "file" if model.trainer_spec.model_type == 1 else "zipf"
    kinds = [p.type for p in model.pieces]
    first = next(i for i, k in enumerate(kinds) if k in (_NORMAL, _USER))
    values = [p.score if scores == "file" else -math.log(max(i - first, 0) + 2.7) for i, p in enumerate(model.pieces)]
    return Pieces([p.piece for p in model.pieces], values, kinds, norm.add_dummy_prefix)


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        usable = [(t, s, i) for i, (t, s, k) in enumerate(zip(pieces.texts, pieces.scores, pieces.types, strict=True)) if k in (_NORMAL, _USER) and t]
        for text, score, i in usable:
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        self.by_run = not any(SPACE in t.lstrip(SPACE) for t, _, _ in usable)
        self.penalty = min((s for _, s, _ in usable), default=0.0) - 10
        self.byte_ids = pieces.bytes_
        self.unknown = pieces.unknown
        self.known: dict[str, bytes] = {}

    def best(self, run: str) -> bytes:
        """Ids (int32) of the best path over one run: the automaton gives the pieces that end at each position, longest
        first, along its output links, and each relaxes the best score of its end. A character that no piece ends
        may be crossed at a penalty; it becomes its UTF-8 bytes, or unknown where the file has no byte pieces."""
        n = len(run)
        score = [0.0] + [-math.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done, penalty = 0, self.penalty

        def cross(to: int) -> None:  # positions that no match has ended at
            for j in range(done + 1, to + 1):
                if score[j - 1] + penalty > score[j]:
                    score[j], back[j] = score[j - 1] + penalty, (1, -1)

        for end, (length, s, i) in self.automaton.iter(run):
            end += 1
            if end > done + 1:  # ends before this one have had all their pieces
                cross(end - 1)
                done = end - 1
            total = score[end - length] + s
            if total > score[end]:
                score[end], back[end] = total, (length, i)
        cross(n)
        ids: list[int] = []
        at = n
        while at > 0:
            length, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(run[at - 1].encode("utf-8", "replace")))
            else:
                ids.append(self.unknown)
            at -= length
        return np.array(ids[::-1], dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        line = (SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE)
        if not self.by_run:
            return np.frombuffer(self.best(line), np.int32)
        if len(self.known) > _REMEMBERED:
            self.known = {}
        get, out = self.known.get, []
        for run in _RUN.findall(line):
            ids = get(run)
            if ids is None:
                ids = self.known[run] = self.best(run)
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    def __init__(self, pieces: Pieces):
        self.prefix = pieces.prefix
        of_byte = {i: bytes([b]) for b, i in pieces.bytes_.items()}
        self.parts = [of_byte[i] if i in of_byte else b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(pieces.texts, pieces.types, strict=True))]

    def decode(self, ids) -> str:
        parts = self.parts
        whole = b"".join([parts[i] for i in ids]).decode("utf-8", "replace")
        return whole[1:] if self.prefix and whole[:1] == " " else whole


#: One encoder a Python worker and model: its memory of runs outlives a task.
_ENCODERS: dict[int, tuple[Encoder, Decoder]] = {}


def _ready(content: bytes, scores: str) -> tuple[Encoder, Decoder]:
    key = hash((content, scores))
    if key not in _ENCODERS:
        pieces = read_pieces(content, scores)
        _ENCODERS[key] = Encoder(pieces), Decoder(pieces)
    return _ENCODERS[key]


def encode(documents: DataFrame, model_path: str = MODEL, text_col: str = "text", scores: str = "auto") -> DataFrame:
    """``documents`` with ``tokens`` (ids), ``n_tokens``, ``n_byte_tokens`` and ``round_trip`` (decoding gives the text again).

    A null text has null tokens, count 0 and a null round trip; an empty text has no tokens. Whole texts are encoded,
    whatever their length, in one pass without a shuffle. Repeated rows, ties (the longer piece first) and null ids need no
    care. Input columns of these names are replaced, others kept. A text that holds the space sign itself decodes to a space
    there, so its round trip is false; nothing else is lost.
    """
    with open(model_path, "rb") as f:  # a few hundred KB on the driver; the vocabulary is the bound
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    names = ["tokens", "n_tokens", "n_byte_tokens", "round_trip"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _ready(sent.value, scores)
        spelled = np.zeros(len(encoder.pieces.texts) + 1, bool)
        spelled[list(encoder.byte_ids.values())] = True
        for batch in batches:
            found, same = [], []
            for i in range(0, len(batch), _ROWS):
                for t in batch.slice(i, _ROWS).to_pylist():
                    found.append(None if t is None else encoder.encode(t))
                    same.append(None if t is None else decoder.decode(found[-1].tolist()) == t)
            lengths = np.array([0 if f is None else len(f) for f in found], np.int64)
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum(lengths, out=ends[1:])
            flat = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(f is None for f in found), False])), pa.array(flat, pa.int32()))
            spelled_out = [0 if f is None else int(spelled[f].sum()) for f in found]
            yield pa.StructArray.from_arrays([lists, pa.array(lengths), pa.array(spelled_out, pa.int64()), pa.array(same, pa.bool_())], names=names)

    kind = "tokens array<int>, n_tokens bigint, n_byte_tokens bigint, round_trip boolean"
    ran = F.arrow_udf(run, kind)
    rest = [c for c in documents.columns if c not in names]
    return documents.select(*rest, ran(F.col(text_col)).alias("__e")).select(*rest, *[F.col(f"__e.{n}") for n in names])


def decode(tokens: DataFrame, model_path: str = MODEL, tokens_col: str = "tokens", to: str = "text") -> DataFrame:
    """``tokens`` with the decoded text in ``to``; null tokens give a null text, an empty list an empty text."""
    with open(model_path, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _ready(sent.value, "auto")[1]
        for batch in batches:
            yield pa.array([None if ids is None else decoder.decode(ids) for ids in batch.to_pylist()], pa.string())

    return tokens.withColumn(to, F.arrow_udf(run, "string")(F.col(tokens_col)))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(documents).select("doc_id", "tokens", "n_tokens", "n_byte_tokens", "round_trip")
