"""Vector bin packing of token sequences by the dot-product heuristic.

Every piece asks for three resources at once: tokens, a segment, and loss-bearing tokens.  A
sequence takes, of the waiting documents, the one whose demand has the largest dot product with
what the sequence has left, until it is full; where nothing fits whole, the best document is
cut.  A sequence that runs out of segments or loss before tokens is cut back to a power of two,
and what is cut off waits again; so sequences are full or a power of two and hold no padding.

Each task packs its own input rows in one pass with a bounded pool of waiting documents.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tarnish.session import ship

#: Documents that wait for a place, per task.
POOL = 256
#: Bytes of pieces and their ids that a Python worker keeps, about, and bytes of an entry beside these.
MEMORY, ENTRY = 128 << 20, 220
#: Pieces of a space and letters, and how many of them are encoded side by side.
_WORD, JOINED = re.compile(r" [^\W\d_]+"), 2000
#: Documents that are tokenized together.
ROWS = 128
ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                 ("n_loss", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                 ("segment", pa.int64())])
ROW_DDL = ("doc_id long, start long, length long, ids binary, n_loss long, doc_tokens long, sequence_id long, "
           "offset long, segment long")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokens:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library, as little-endian 32-bit bytes.

    The library's own splitting is repeated here, so that it encodes each distinct piece once;
    texts that name a special token go through the library whole.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        from tarnish.llm.pieces import Splitter

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.splitter = Splitter(PATTERN)
        self.end = np.array([end], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.size = 0
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of a token: each is written as one character
        for token, rank in vocabulary.items():
            self.sizes[rank] = len(token)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; pieces new to the memory are encoded in one call."""
        texts = [t or "" for t in texts]
        plain = [not any(s in t for s in self.special) for t in texts]
        split = [self._pieces(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if self.size > MEMORY:
            self.known.clear()
            self.size = 0
        known = self.known
        self._learn(list(set().union(*[s for s in split if s]).difference(known)))
        for text, pieces in zip(texts, split, strict=True):
            if pieces is None:
                yield _bytes_of(self.library.encode(text, add_special_tokens=False).ids) + self.end
            else:
                yield b"".join(map(known.__getitem__, pieces)) + self.end

    def _learn(self, new: list[str]) -> None:
        """Pieces of a space and letters are encoded side by side: the library splits them again where they meet."""
        words = [p for p in new if _WORD.fullmatch(p)]
        for at in range(0, len(words), JOINED):
            part = words[at:at + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(p.encode()) for p in part])
            stops = np.searchsorted(ends, wanted)
            if len(ids) == 0 or ends[-1] != wanted[-1] or not np.array_equal(ends[stops], wanted):
                raise ValueError("the tokenizer does not split words at spaces")
            data, start = ids.astype("<u4").tobytes(), 0
            for piece, stop in zip(part, (4 * (stops + 1)).tolist(), strict=True):
                self._keep(piece, data[start:stop])
                start = stop
        rest = [p for p in new if not _WORD.fullmatch(p)]
        for piece, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self._keep(piece, _bytes_of(found.ids))

    def _keep(self, piece: str, ids: bytes) -> None:
        self.known[piece] = ids
        self.size += ENTRY + 2 * len(piece) + len(ids)

    def _pieces(self, text: str) -> list[str]:
        lists = list(self.splitter.split(text))
        return lists[0] if len(lists) == 1 else list(chain.from_iterable(lists))


class _Waiting:
    """What is left of a document."""

    __slots__ = ("doc_id", "ids", "at", "total", "first_loss")

    def __init__(self, doc_id, ids: bytes, first_loss: int):
        self.doc_id, self.ids, self.at, self.total, self.first_loss = doc_id, ids, 0, len(ids) // 4, first_loss

    def loss(self, start: int, stop: int) -> int:
        return max(0, stop - max(start, self.first_loss))

    def room(self, tokens: int, loss: int) -> int:
        """The longest next piece within these limits."""
        return min(tokens, self.total - self.at, max(0, self.first_loss - self.at) + loss)


class Packer:
    """Packs documents in the order they come; ``rows`` holds finished pieces."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss])
        self.pool: list[_Waiting] = []
        self.demand = np.zeros((POOL, 3))
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, loss_tokens: int | None) -> None:
        """``loss_tokens``: the last so many ids bear loss; None: all but the document's first."""
        total = len(ids) // 4
        first = 1 if loss_tokens is None else total - max(0, min(loss_tokens, total))
        doc = _Waiting(doc_id, ids, first)
        top = self.limits
        while doc.total - doc.at >= top.tokens and doc.room(top.tokens, top.loss) == top.tokens:
            self._close([(doc, doc.at, top.tokens)])
            doc.at += top.tokens
        if doc.at < doc.total:
            self._wait(doc)
            if len(self.pool) >= POOL:
                self._fill()

    def _wait(self, doc: _Waiting) -> None:
        if len(self.pool) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pool)] = (doc.total - doc.at, 1, doc.loss(doc.at, doc.total))
        self.pool.append(doc)

    def _take(self, k: int) -> _Waiting:
        doc, last = self.pool[k], self.pool.pop()
        if last is not doc:
            self.pool[k] = last
            self.demand[k] = self.demand[len(self.pool)]
        return doc

    def _fill(self) -> None:
        """One sequence from the pool."""
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
        pieces = []
        while self.pool and left[0] >= 1 and left[1] >= 1:
            demand = self.demand[: len(self.pool)]
            gain = (demand * self.scale) @ (left * self.scale)
            fits = (demand <= left).all(axis=1)
            k = int(np.argmax(np.where(fits, gain, -1.0) if fits.any() else gain))
            doc = self.pool[k]
            size = doc.room(int(left[0]), int(left[2]))
            if size <= 0:
                break
            left -= (size, 1, doc.loss(doc.at, doc.at + size))
            pieces.append((doc, doc.at, size))
            self._take(k)
            doc.at += size
            if doc.at < doc.total:
                self._wait(doc)
                break  # a cut fills the tokens or the loss of the sequence
        total = sum(size for _, _, size in pieces)
        spare = total - (1 << total.bit_length() - 1) if total < self.limits.tokens else 0
        back = []
        while spare:
            doc, at, size = pieces.pop()
            if doc.at < doc.total:  # its rest waits already: it takes the cut-off part back
                self._take(self.pool.index(doc))
            cut = min(size, spare)
            spare -= cut
            if size > cut:
                pieces.append((doc, at, size - cut))
            doc.at = at + size - cut
            back.append(doc)
        self._close(pieces)
        for doc in back:
            self._wait(doc)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for k, (doc, at, size) in enumerate(pieces):
            self.rows.append((doc.doc_id, at, size, doc.ids[4 * at:4 * (at + size)], doc.loss(at, at + size), doc.total,
                              self.next, offset, k))
            offset += size
        self.next += 1

    def finish(self) -> None:
        while self.pool:
            self._fill()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(ROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], schema=ROW)


_TOKENS: dict[tuple[str, int], Tokens] = {}


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    if (path, end) not in _TOKENS:
        _TOKENS[path, end] = Tokens(path, end)
    tokens = _TOKENS[path, end]
    packer = Packer(limits, TaskContext.get().partitionId() << 40)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            doc_ids, texts, losses = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
            for doc_id, ids, loss in zip(doc_ids, tokens.encode(texts), losses, strict=True):
                packer.add(doc_id, ids, loss)
            yield packer.batch()
    packer.finish()
    yield packer.batch()


def pack(docs: DataFrame, tokenizer: str, end: int, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text",
         loss_tokens: Column | None = None) -> DataFrame:
    """A row per piece: its document, place there, ids (little-endian 32-bit), sequence and place there.

    ``loss_tokens`` says how many ids at a document's end bear loss, as in instruction data the
    answer's (NULL, or no such column: all but the first).  A NULL or empty text is its end id
    alone; rows that repeat or share an id are packed each for itself, a NULL id stays NULL; an
    empty table gives no sequence.  Sequence ids are unique; they name the input partition and
    so do not change when a lost task runs again.
    """
    ship(docs.sparkSession)
    given = loss_tokens.cast("long") if loss_tokens is not None else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), given.alias("loss"))
    return rows.mapInArrow(partial(_pack, path=tokenizer, end=end, limits=limits), ROW_DDL)
