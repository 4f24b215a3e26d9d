"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with hierarchical Dirichlet smoothing,

    p1(w)    = (c(w) + 1) / (N + V + 1)
    pk(w|h)  = (c(hw) + MASS p(w|h')) / (c(h) + MASS)        h' is h without its first token,

so each context has explicit arcs for what followed it in training and one failure arc of
weight MASS / (c(h) + MASS) to the shorter context.  A text is scored in one pass from left to
right: take the arc of the token, or fail and add the failure's weight, until an arc is found.

The whole model never exists in one place.  Documents are written in blocks of bounded size;
a block knows how often its n-grams occur in its own training documents.  Their hashes, in
packed arrays, meet in shards; a shard adds up the counts and sends back to a block only what
other blocks add to.  Each block then builds the part of the automaton that its own texts can
reach, which is bounded by the block, and runs over its texts.  A frequent n-gram is one entry
per block, so no shard is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tarnish.session import cut_lineage, ship

MASS = 2.0
ORDER = 2
#: Bytes of text in a block, and n-grams that a shard adds up, about.
BLOCK = 2 << 20
SHARD = 2_000_000

BLOCKS_DDL = "block long, doc_ids binary, no_id binary, held_out binary, sizes binary, texts binary, grams long, train_tokens long, train_docs long"
COUNTS_DDL = "shard int, block long, level int, hashes binary, counts binary"
TOTALS_DDL = "block long, shard int, level int, short binary, counts binary, types long"
SCORES_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

_START, _END = 0, 1  # token numbers of the start, which is only a context, and of the end


def is_held_out(doc_id: int | None) -> bool:
    """One document in seven, by its id; one without an id is training text."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _block_row(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    held_out = np.array([is_held_out(i) for i in ids], bool)
    tokens = np.array([len(t.split()) + 1 for t in texts], np.int64)
    values = [number, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], bool).tobytes(),
              held_out.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), zlib.compress(b"".join(texts), 1),
              int(tokens.sum()), int(tokens[~held_out].sum()), int((~held_out).sum())]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], _names(BLOCKS_DDL))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents in lower case, gathered into blocks of about ``size`` bytes; a longer one is its own."""
    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            lowered = (text.as_py() or "").encode().lower()  # bytes: only A-Z change
            if held and held + len(lowered) > size:
                yield _block_row(number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(doc_id.as_py())
            texts.append(lowered)
            held += len(lowered)
    if ids:
        yield _block_row(number, ids, texts)


class Block:
    """The texts of a block as token numbers, and their n-grams.

    Each text is the start token, its words and the end token.  ``levels[k]`` describes the
    grams of k + 1 tokens: ``hash``, ``own`` count in the block's training documents, ``token``
    (the last one), ``context`` (the gram of the tokens before it, one level below) and
    ``suffix`` (the gram without its first token); ``at`` is the gram that ends at each
    position, or -1 where the text is shorter.
    """

    def __init__(self, row, order: int):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        self.held_out = np.frombuffer(row["held_out"], bool)
        data, at = zlib.decompress(row["texts"]), 0
        number: dict[bytes, int] = {}
        parts, lengths = [], []
        for size in np.frombuffer(row["sizes"], np.int64).tolist():
            words = data[at:at + size].split()
            at += size
            parts.append(np.fromiter((_START, *(number.setdefault(w, len(number) + 2) for w in words), _END), np.int64, len(words) + 2))
            lengths.append(len(words) + 2)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        tokens = np.concatenate(parts)
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in (b"\n<s>", b"\n</s>", *number)), np.uint64, len(number) + 2)
        place = np.arange(len(tokens)) - np.repeat(self.ends - self.lengths, self.lengths)
        training = np.repeat(~self.held_out, self.lengths)

        own = np.bincount(tokens, training, len(word_hash)).astype(np.int64)
        self.levels = [{"hash": word_hash, "own": own, "at": tokens, "token": np.arange(len(word_hash))}]
        for k in range(1, order):
            below = self.levels[-1]
            where = np.flatnonzero(place >= k)
            context, token = below["at"][where - 1], tokens[where]
            kinds, first, gram = np.unique(context * len(word_hash) + token, return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1)
            at[where] = gram
            context, token = context[first], token[first]
            self.levels.append({
                "hash": _joined(below["hash"][context], word_hash[token], k), "at": at, "token": token, "context": context,
                "own": np.bincount(gram, training[where], len(kinds)).astype(np.int64), "suffix": below["at"][where[first]]})


def _joined(context: np.ndarray, token: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (context + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) ^ token
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_LOW = np.uint64((1 << 48) - 1)


def _low_bytes(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash, byte by byte."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _from_low(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def _dealt(grams: dict, shards: int) -> list[tuple[int, np.ndarray]]:
    """The grams of each shard, in the order of their low bits; the same whenever a block is read."""
    shard = (grams["hash"] >> np.uint64(48)) % np.uint64(shards)
    by = np.lexsort((grams["hash"] & _LOW, shard))
    ends = np.searchsorted(shard[by], np.arange(shards + 1, dtype=np.uint64))
    return [(s, by[a:b]) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]


def _counts(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A row per shard and level of each block: n-grams by the low bits of their hashes, and own counts."""
    for batch in batches:
        for row in batch.to_pylist():
            for level, grams in enumerate(Block(row, order).levels):
                rows = _dealt(grams, shards)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in rows], pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()),
                    pa.array([level] * len(rows), pa.int32()), pa.array([_low_bytes(grams["hash"][k]) for _, k in rows], pa.binary()),
                    pa.array([grams["own"][k].astype("<u4").tobytes() for _, k in rows], pa.binary())], _names(COUNTS_DDL))


def _packed(counts: np.ndarray) -> bytes:
    """Counts byte by byte, so that the high ones, nearly all zero, take no room."""
    return zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard, for the blocks whose own counts fall short; and its number of trained words.

    A block knows its grams of the shard in order, so it gets a bit for each (``short``: whether
    others add to it) and the totals of those.
    """
    out, types, shard = [], 0, int(group["shard"].iloc[0])
    for level, rows in group.groupby("level"):
        hashes = [_from_low(h) for h in rows["hashes"]]
        ends = np.cumsum([len(h) for h in hashes])
        own = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"]]).astype(np.int64)
        kinds, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, own, len(kinds)).astype(np.int64)
        if level == 0:
            types = int((total > 0).sum())
        total = total[at]
        for block, a, b in zip(rows["block"], [0, *ends[:-1]], ends):
            short = total[a:b] != own[a:b]
            if short.any():
                out.append((block, shard, level, np.packbits(short).tobytes(), _packed(total[a:b][short]), 0))
    out.append((None, shard, 0, b"", b"", types))
    return pd.DataFrame(out, columns=_names(TOTALS_DDL)).astype({"block": "Int64"})


class Automaton:
    """The part of the model that the texts of a block can reach.

    A state is a context: 0 the empty one, then the grams of the levels below the last.
    ``arcs`` maps state and token to (log weight, next state), ``fail`` a state to (log weight,
    state of the context without its first token).  The empty context has an arc for every token.
    """

    def __init__(self, levels: list[dict], totals: list[np.ndarray], n: int, v: int, mass: float):
        top, self.size = len(levels) - 1, len(totals[0])
        first = np.cumsum([1, *(len(t) for t in totals)]).tolist()  # the state of a level's gram 0
        p = (totals[0] + 1) / (n + v + 1)
        self.word = np.log10(p)
        self.arcs: dict[int, tuple[float, int]] = {}
        self.fail: list[tuple[float, int]] = [(0.0, 0)]
        self._add(np.zeros(self.size, np.int64), levels[0]["token"], self.word,
                  first[0] + levels[0]["token"] if top else np.zeros(self.size, np.int64))
        for k in range(1, top + 1):
            grams = levels[k]
            weight = np.log10(mass / (totals[k - 1] + mass))
            shorter = first[k - 2] + levels[k - 1]["suffix"] if k > 1 else np.zeros(len(weight), np.int64)
            self.fail += zip(weight.tolist(), shorter.tolist(), strict=True)
            p = (totals[k] + mass * p[grams["suffix"]]) / (totals[k - 1][grams["context"]] + mass)
            seen = np.flatnonzero(totals[k] > 0)
            target = first[k] + seen if k < top else first[k - 1] + grams["suffix"][seen]
            self._add(first[k - 1] + grams["context"][seen], grams["token"][seen], np.log10(p[seen]), target)
        self.start = first[0] + _START if top else 0

    def _add(self, state: np.ndarray, token: np.ndarray, weight: np.ndarray, target: np.ndarray) -> None:
        self.arcs.update(zip((state * self.size + token).tolist(), zip(weight.tolist(), target.tolist())))

    def score(self, tokens: list[int]) -> float:
        """log10 of the text's probability, in one pass; the last token is the end."""
        arcs, fail, size = self.arcs, self.fail, self.size
        state, total = self.start, 0.0
        for token in tokens:
            arc = arcs.get(state * size + token)
            while arc is None:
                weight, state = fail[state]
                total += weight
                arc = arcs.get(state * size + token)
            total += arc[0]
            state = arc[1]
        return total


def _score(blocks: pd.DataFrame, added: pd.DataFrame, order: int, mass: float, n: int, v: int, shards: int) -> pd.DataFrame:
    block = Block(blocks.iloc[0], order)
    more = {(r.shard, r.level): (r.short, r.counts) for r in added.itertuples()}
    totals = []
    for level, grams in enumerate(block.levels):
        total = grams["own"].copy()
        for shard, mine in _dealt(grams, shards):
            if (shard, level) in more:
                short, counts = more[shard, level]
                total[mine[np.unpackbits(np.frombuffer(short, np.uint8), count=len(mine)).astype(bool)]] = _unpacked(counts)
        totals.append(total)
    machine = Automaton(block.levels, totals, n, v, mass)
    tokens = block.levels[0]["at"]
    rows = []
    for doc, (end, length) in enumerate(zip(block.ends.tolist(), block.lengths.tolist(), strict=True)):
        own = tokens[end - length + 1:end]  # without the start
        rows.append((None if block.no_id[doc] else int(block.doc_ids[doc]), bool(block.held_out[doc]), len(own),
                     int((totals[0][own] > 0).sum()), n, float(machine.word[own].sum()), machine.score(own.tolist())))
    return pd.DataFrame(rows, columns=_names(SCORES_DDL)).astype({"doc_id": "Int64"})


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS,
           block_bytes: int = BLOCK, shard_grams: int = SHARD) -> DataFrame:
    """A row per document: n_tokens, n_known (seen in training), train_tokens, base_score, score.

    Training text is that of the documents that ``is_held_out`` leaves; all rows are scored.  A
    NULL text is the end token alone; a NULL id is training text and stays NULL; repeated rows
    count, and are scored, each for itself.  An empty table gives no rows.  ``order`` is the length of
    the longest n-grams.  Hashes have 48 bits within a shard.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = cut_lineage(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(partial(_blocks, size=block_bytes), BLOCKS_DDL))
    grams, n, trained = blocks.agg(F.sum("grams"), F.sum("train_tokens"), F.sum("train_docs")).first()
    shards = max(1, -(-(grams or 0) * order // shard_grams))
    counts = blocks.mapInArrow(partial(_counts, order=order, shards=shards), COUNTS_DDL)
    totals = cut_lineage(counts.repartition(shards, "shard").groupBy("shard").applyInPandas(_totals, TOTALS_DDL))
    kinds = totals.agg(F.sum("types")).first()[0] or 0
    run = partial(_score, order=order, mass=mass, n=n or 0, v=kinds - (1 if trained else 0), shards=shards)  # the start is no word

    def grouped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right)

    return blocks.groupBy("block").cogroup(totals.where("block is not null").groupBy("block")).applyInPandas(grouped, SCORES_DDL)
