"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of L tokens costs ``linear * L + quadratic * L * L`` (attention stays
inside a document).  Pieces go in descending order to the sequence of lowest
cost that still has room; what fits nowhere whole is cut into the holes, so all
sequences but the last of a task are full.  Tails become sequences of
power-of-two lengths, which need no padding.

A task packs the stream of its own partition, a few hundred sequences at a time:
nothing is shuffled, memory is bounded by the sequences at once plus one
document, and a task that runs again packs the same rows into the same ids.

Defined results: a null text is empty and still has its end token; equal rows are
packed as often as they occur; an empty table gives no pieces.  Special-token
strings in a text are encoded the way the tokenizer file says.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

KEPT_WORDS = 800_000


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    end_id: int = 2
    tokenizer: str = "word_bpe_49k.json"
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    at_once: int = 512


@dataclass
class Piece:
    """Tokens ``ids`` of a document; ``start`` counts the document's tokens before them."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class Encoder:
    """Token ids of texts.  The tokenizer never joins across white space, so the ids' bytes are kept by word."""

    def __init__(self, name: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.end, self.known = array("I", [end_id]).tobytes(), {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = set(words)
        if new:
            self._learn(new)
        return np.frombuffer(b"".join([*map(self.known.__getitem__, words), self.end]), dtype="<u4")

    def _learn(self, new: set[bytes]) -> None:
        """The tokenizer lower-cases and parts letters from marks, so words share the ids of their lower-case stems."""
        parts = {w: stem_and_marks(w.lower()) for w in new}
        todo = list({part for pair in parts.values() for part in pair}.difference(self.known))
        found = self.tokenizer.encode_batch_fast([p.decode() for p in todo], add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(todo, found))
        self.known.update((w, self.known[stem] + self.known[marks]) for w, (stem, marks) in parts.items())


def stem_and_marks(word: bytes) -> tuple[bytes, bytes]:
    """Cuts trailing full stops and commas off where a letter or digit of ASCII stands before them."""
    stem = word.rstrip(b".,")
    return (stem, word[len(stem):]) if stem[-1:].isalnum() else (word, b"")


@lru_cache(maxsize=2)
def encoder(name: str, end_id: int) -> Encoder:
    """One for each worker process, so that its words serve all of the process's tasks."""
    return Encoder(name, end_id)


def pack(pieces: list[Piece], how: Packing) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences and the pieces left over (fewer tokens than one sequence holds)."""
    whole = [[p] for p in pieces if len(p.ids) == how.capacity]
    rest = sorted((p for p in pieces if len(p.ids) < how.capacity), key=lambda p: -len(p.ids))
    n = sum(len(p.ids) for p in rest) // how.capacity
    if not n:
        return whole, rest
    bins: list[list[Piece]] = [[] for _ in range(n)]
    room, cost = np.full(n, how.capacity), np.zeros(n)

    def put(at: int, piece: Piece) -> None:
        size = len(piece.ids)
        bins[at].append(piece)
        room[at] -= size
        cost[at] += how.linear * size + how.quadratic * size * size

    over = []
    for piece in rest:
        fits = room >= len(piece.ids)
        if fits.any():
            put(int(np.argmin(np.where(fits, cost, np.inf))), piece)
        else:
            over.append(piece)
    left = []
    for piece in over:
        while len(piece.ids) and room.any():
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            head, piece = piece.cut(min(len(piece.ids), int(room[at])))
            put(at, head)
        if len(piece.ids):
            left.append(piece)
    return whole + bins, left


def tail(pieces: list[Piece]) -> list[list[Piece]]:
    """The last tokens of a task in sequences of falling powers of two: none of them is padded."""
    total, out, queue = sum(len(p.ids) for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        filled: list[Piece] = []
        while need:
            head, rest = queue.pop().cut(need)
            need -= len(head.ids)
            filled.append(head)
            if len(rest.ids):
                queue.append(rest)
        if filled:
            out.append(filled)
    return out


def _batch(sequences: list[list[Piece]], first_id: int, with_ids: bool) -> pa.RecordBatch:
    columns: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
    for number, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            values = (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, first_id + number, offset, p.ids)
            for name, value in zip(columns, values):
                columns[name].append(value)
            offset += len(p.ids)
    arrays = {n: pa.array(v, type=pa.int64()) for n, v in columns.items() if n != "ids"}
    if with_ids:
        arrays["ids"] = pa.array([i.astype(np.int32) for i in columns["ids"]], type=pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(arrays)


def pack_documents(docs: DataFrame, how: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if wanted.

    ``sequence_id`` is the partition number times 2^32 plus the sequence's number in that partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = encoder(how.tokenizer, how.end_id), TaskContext.get().partitionId() << 32
        waiting: list[Piece] = []
        held = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                tokens = encode(texts[row].as_py())
                doc_id = ids[row].as_py()
                waiting += [Piece(doc_id, at, tokens[at:at + how.capacity], len(tokens)) for at in range(0, len(tokens), how.capacity)]
                held += len(tokens)
                if held >= how.at_once * how.capacity:
                    sequences, waiting = pack(waiting, how)
                    held = sum(len(p.ids) for p in waiting)
                    yield _batch(sequences, next_id, with_ids)
                    next_id += len(sequences)
        sequences, waiting = pack(waiting, how)
        sequences += tail(waiting)
        if sequences:
            yield _batch(sequences, next_id, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
