"""Byte-level byte-pair encoding by a lazily determinised transducer, and its streaming inverse.

A sequence of tokens is the encoding of its bytes exactly when each token, and each pair of
neighbours, is what the merges make of its bytes: merges of lowest rank first never cross a
border that the pair alone would keep.  So the encoder is a non-deterministic machine: its
states are (last token, bytes of the next token so far), and it may end a token that follows
the last one.  Reading a byte moves all of its states at once; what their outputs have in
common is emitted, the rest is kept with the states.  Only one of them ends a token at any
byte, and a state lives no longer than the longest token, which bounds the lookahead.

Sets of states become numbered states of the deterministic machine when a text first reaches
them; the table of moves is dropped when it grows too large, and built again as needed.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tarnish.llm.common import fresh
from tarnish.session import ship

#: Moves of the machine, and bytes of pieces with their ids, that a Python worker keeps, about.
MOVES = 260_000
PIECES = 112 << 20
#: Keys of a row from here on are bytes that end a piece; such an entry takes this part of a move's memory, about.
END, ENDS = 256, 0.2
#: Bytes that an entry of a dictionary of strings takes beside the characters.
ENTRY = 220
#: Rows of an output batch.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class _Begun:
    """Bytes that begin a token: what each further byte makes of them, and the rank if they are a token."""

    __slots__ = ("then", "rank", "length")

    def __init__(self, length: int):
        self.then: dict[int, _Begun] = {}
        self.rank, self.length = -1, length

    def __len__(self) -> int:
        return self.length


class _Row(dict):
    """A state of the deterministic machine and its moves: byte -> (next row, ranks emitted).

    Under ``END`` + byte: all that is emitted if no byte follows, for which no row is needed.
    ``states`` holds (rank of the last token, bytes of the next one, tokens not yet emitted) of
    each, one after the other in one tuple.
    """

    __slots__ = ("machine", "states")

    def __init__(self, machine: "Transducer", states: tuple):
        self.machine, self.states = machine, states

    def __missing__(self, byte: int) -> tuple["_Row", tuple]:
        move = self[byte] = self.machine.move(self.states, byte)
        return move


class _Follows(dict):
    """Whether a token may follow another: (rank of the first * ``pairs`` + rank of the second) -> answer."""

    __slots__ = ("machine",)

    def __init__(self, machine: "Transducer"):
        self.machine = machine

    def __missing__(self, pair: int) -> bool:
        tokens = self.machine.tokens
        last, rank = divmod(pair, self.machine.pairs)
        fits = self[pair] = self.machine.may_follow(tokens[last], tokens[rank])
        return fits


class Transducer:
    """Encodes one piece, within which all merges may happen, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()} | {-1: b""}
        self.pairs = max(ranks.values()) + 1
        self.none = _Begun(0)
        for token, rank in ranks.items():
            at = self.none
            for byte in token:
                begun = at.then.get(byte)
                if begun is None:
                    begun = at.then[byte] = _Begun(at.length + 1)
                at = begun
            at.rank = rank
        self.halves: dict[bytes, tuple | None] = {bytes([b]): () for b in range(256)}
        self.rows: dict[tuple, _Row] = {}
        self._reset()

    def _reset(self) -> None:
        start = (-1, self.none, ())
        for row in self.rows.values():
            row.clear()  # rows may lead back to themselves, which would keep them in memory
        self.start = _Row(self, start)
        self.rows = {start: self.start}
        self.made = 0
        self.follows = _Follows(self)

    @property
    def states(self) -> list[tuple]:
        """The sets that have been reached."""
        return [tuple(zip(*[iter(states)] * 3)) for states in self.rows]

    def split(self, token: bytes) -> tuple | None:
        """The two parts of the token's last merge; none for a byte; None if merges do not make the token."""
        if token not in self.halves:
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if rank == 1 << 62:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, last: bytes, token: bytes) -> bool:
        """Whether the token can stand after the last one (empty: at the start).

        Undoes the merges of both, the latest first, and looks at the two parts that touch the
        border: the pair is broken if these would have merged before either went into its own
        token.  Of equal ranks the left merge comes first.
        """
        if self.split(token) is None:
            return False
        if not last:
            return True
        ranks, halves = self.ranks, self.halves
        left, right, left_ends, right_ends = last, token, 1 << 62, 1 << 62
        while True:
            joined = ranks.get(left + right)
            if joined is not None and joined < left_ends and joined <= right_ends:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None:
                a = self.split(left)
            if b is None:
                b = self.split(right)
            if a and (not b or ranks[left] > ranks[right]):
                left_ends, left = ranks[left], a[1]
            elif b:
                right_ends, right = ranks[right], b[0]
            else:
                return True

    def move(self, states: tuple, byte: int) -> tuple[_Row, tuple]:
        """The row of the states that the byte leads to, and what is emitted on the way."""
        after, ended, common, pairs, follows = [], None, True, self.pairs, self.follows
        each = iter(states)
        for last, begun, held in zip(each, each, each):  # the longest beginning first; one of each length
            now = begun.then.get(byte)
            if now is None:
                continue
            after += (last, now, held)
            if not held:
                common = False
            if ended is None and now.rank >= 0 and follows[last * pairs + now.rank]:
                ended = (*held, now.rank)
        after += (ended[-1], self.none, ended)
        emitted = ()
        if common:  # all of them hold something back
            outputs = after[2::3]
            low, high = min(outputs), max(outputs)
            if low[0] == high[0]:
                n, most = 1, min(len(low), len(high))
                while n < most and low[n] == high[n]:
                    n += 1
                after[2::3], emitted = [held[n:] for held in outputs], low[:n]
        target = tuple(after)
        row = self.rows.get(target)
        if row is None:
            row = self.rows[target] = _Row(self, target)
        self.made += 1
        return row, emitted

    def end(self, row: _Row, byte: int) -> tuple:
        """What is emitted if the byte is the last: by the one state that ends a token there."""
        move = row.get(byte)
        if move is not None:
            return (*move[1], *move[0].states[-1])
        each = iter(row.states)
        for last, begun, held in zip(each, each, each):
            now = begun.then.get(byte)
            if now is not None and now.rank >= 0 and self.follows[last * self.pairs + now.rank]:
                break
        out = row[END + byte] = (*held, now.rank)
        self.made += ENDS
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; one that is a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if self.made > MOVES:
            self._reset()
        out, row = [], self.start
        for byte in piece[:-1]:
            row, emitted = row[byte]
            if emitted:
                out.extend(emitted)
        out.extend(row.get(END + piece[-1]) or self.end(row, piece[-1]))
        return out


class _Known(dict):
    """Pieces and their ids as decimal text; new pieces run through the transducer.

    Two generations, each of half the memory: a full one becomes the older, from which pieces
    that are met again come back, so frequent ones are never encoded twice.
    """

    def __init__(self, transducer: Transducer):
        self.transducer, self.size, self.older = transducer, 0, {}

    def __missing__(self, piece: str) -> str:
        text = self.older.get(piece)
        if text is None:
            text = " ".join(map(str, self.transducer.encode(piece.encode())))
        self.size += ENTRY + 2 * len(piece) + len(text)
        if 2 * self.size > PIECES:
            self.older.clear()
            self.older = dict(self)
            self.clear()
            self.size = 0
        self[piece] = text
        return text


class Encoder:
    """Whole texts to decimal ids joined by one space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tarnish.llm.pieces import Splitter

        self.splitter = Splitter(pattern)
        self.known = _Known(Transducer(ranks))

    def encode(self, text: str | None) -> str:
        return " ".join([" ".join(map(self.known.__getitem__, pieces)) for pieces in self.splitter.split(text or "") if pieces])


class _Moves(dict):
    """Moves of the UTF-8 machine from one state: id -> (complete characters, next state)."""

    def __init__(self, pending: bytes, tokens: dict[str, bytes]):
        self.pending, self.tokens = pending, tokens

    def __missing__(self, token: str) -> tuple[bytes, bytes]:
        data = self.pending + self.tokens[token]
        cut = len(data) - unfinished(data)
        move = self[token] = (data[:cut], data[cut:])
        return move


def unfinished(data: bytes) -> int:
    """How many bytes at the end begin a character that more bytes may complete."""
    for n in range(1, min(3, len(data)) + 1):
        byte = data[-n]
        if byte >= 0xC0:  # a first byte: of 2, 3 or 4
            return n if n < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
        if byte < 0x80:
            return 0
    return 0


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class Decoder:
    """Ids to bytes, whole characters at a time.

    The state is the beginning of an unfinished character, at most three bytes; the moves of a
    state are learnt token by token.  Bytes that are no UTF-8 pass through unchanged.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {str(rank): token for token, rank in ranks.items()}
        self.whole = {rank: token for rank, token in self.tokens.items() if _whole(token)}
        self.states: dict[bytes, _Moves] = {}

    def stream(self, ids: Iterable[str]) -> Iterator[bytes]:
        """Chunks that end at characters; the last one may hold an unfinished character.

        Between characters, tokens that are whole characters pass as they are, a run at a time;
        the machine steps over the others, until it is between characters again.
        """
        ids = list(ids)
        tokens, states, whole_tokens, at = self.tokens, self.states, self.whole, 0
        try:
            chunk = b"".join(map(whole_tokens.__getitem__, ids))
        except KeyError:  # a part of a character among them
            chunk = None
        if chunk is not None:
            yield chunk
            return
        for stop in [*[i for i, token in enumerate(ids) if token not in whole_tokens], len(ids)]:
            if stop < at:
                continue  # the machine has gone over it
            if stop > at:
                yield b"".join(map(tokens.__getitem__, ids[at:stop]))
            at, pending = stop, b""
            while at < len(ids) and (at == stop or pending):
                moves = states.get(pending)
                if moves is None:
                    moves = states[pending] = _Moves(pending, tokens)
                whole, pending = moves[ids[at]]
                at += 1
                if whole:
                    yield whole
            if pending:
                yield pending

    def decode(self, ids: str | None) -> bytes:
        return b"".join(self.stream(ids.split(" "))) if ids else b""


_READY: dict[tuple, object] = {}


def _ready(kind, path: str, *rest):
    """One coder per Python worker and rank file."""
    key = (kind, path, *rest)
    if key not in _READY:
        _READY[key] = kind(read_ranks(path), *rest)
    return _READY[key]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: it would go over all that a coder remembers, again and again, and find none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    coder = _ready(Encoder, path, pattern)
    with _uncollected():
        for batch in _rows(batches):
            ids = [coder.encode(t.as_py()) for t in batch.column(text)]
            counts = np.array([x.count(" ") + 1 if x else 0 for x in ids], np.int64)
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.string()), pa.array(counts)], [*names, "ids", "n_tokens"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    coder = _ready(Decoder, path)
    for batch in _rows(batches):
        out = pa.array([coder.decode(x.as_py()) for x in batch.column(ids)], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], out], [*names, "decoded"])


def _plus(frame: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*frame.schema.fields, *fields])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` (decimal, joined by one space) and ``n_tokens``.

    ``ranks`` is the path of a rank file that executors can open; no special tokens.  A NULL
    text counts as empty: no ids.  Rows stand alone, repeated ones included; a column of
    ``docs`` named ids or n_tokens is replaced.
    """
    ship(docs.sparkSession)
    body, = fresh(docs, "b_text")
    rest = docs.drop(text, "ids", "n_tokens")
    source = docs.withColumn(body, F.col(text)).select(*rest.columns, body)
    schema = _plus(rest, T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.LongType()))
    return source.mapInArrow(partial(_encode, path=ranks, pattern=pattern, text=body, names=rest.columns), schema)


def decode(frame: DataFrame, ranks: str, ids: str = "ids", keep: bool = True) -> DataFrame:
    """``frame`` with ``decoded`` (BINARY), the bytes of its ids; a NULL list of ids gives none.

    An id that the ranks lack raises.  With ``keep`` false the ids are left out.
    """
    ship(frame.sparkSession)
    rest = frame.drop("decoded") if keep else frame.drop("decoded", ids)
    schema = _plus(rest, T.StructField("decoded", T.BinaryType()))
    return frame.drop("decoded").mapInArrow(partial(_decode, path=ranks, ids=ids, names=rest.columns), schema)
