"""Ranked lexical search over bit-sliced Bloom signatures, exact.

``build`` turns documents into blocks of documents with similarly many terms.  A block holds a
bitmap whose rows are signature bits and whose columns are documents (a term sets a few bits of
its documents' columns, a term that occurs twice a few more), and beside it the terms with
their counts.  ``search`` ands the rows of a query's terms: the result has a bit for every
document that holds the term, and a few too many.  Sums of term weights over these bits bound a
document's score from above; documents whose bound is below the k-th best score met so far are
excluded, all others are scored exactly.  Each task keeps its own best k, which then meet.

The queries are worked off in blocks of bounded size, the blocks of documents where they lie.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tarnish.llm.common import LOWER, UPPER
from tarnish.session import cut_lineage, ship

#: Signature bits that a term sets, signature bits for each term at most held, and bits of a block.
HASHES, BITS_PER_TERM, BLOCK_BITS = 3, 8, 1 << 19
#: Documents of a block, at most.
BLOCK_DOCS = 128
#: Writer options: blocks are large rows, and a reader holds a row group at once.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}
#: Items, and distinct terms, of queries that are searched for together (a longer item alone).
ITEMS, TERMS = 512, 2048
#: Documents that are scored exactly before the threshold is looked at again.
CHUNK = 32
#: Terms whose hash a Python worker keeps, and the longest one kept.
KNOWN, LONGEST = 200_000, 64

INDEX_DDL = ("docs int, bits int, n_terms long, slices binary, ids array<long>, lengths binary, tops binary, "
             "starts binary, terms binary, counts binary")
FOUND_DDL = "query int, item_id long, doc_id long, score long"

#: ASCII letters and digits, letters in lower case, and all bytes of other characters; the rest is a gap.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(data: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of other characters beyond ASCII; A-Z lower-cased."""
    return data.translate(_FOLD).split()


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh64_intdigest(term)
        if len(term) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[term] = h
        return h


_HASHES = _Hashes()


def _hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, terms), np.uint64, len(terms))


def _rows(hashes: np.ndarray, bits: int, twice: bool) -> np.ndarray:
    """The signature bits of terms, or of terms as ones that occur twice; a row of HASHES per term."""
    if twice:
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


# -- index ------------------------------------------------------------------------------


def _bits_for(terms: int) -> int:
    """Signature bits of a document: a power of two, the same for documents of similar size."""
    return max(256, BITS_PER_TERM << (terms - 1).bit_length())


class _Block:
    def __init__(self, bits: int):
        self.bits, self.room = bits, max(1, min(BLOCK_DOCS, BLOCK_BITS // bits))
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def row(self) -> dict:
        docs = len(self.ids)
        sizes = [len(t) for t in self.terms]
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        column = np.repeat(np.arange(docs), sizes)
        bitmap = np.zeros((self.bits, docs), np.uint8)
        bitmap[_rows(terms, self.bits, False), column[:, None]] = 1
        often = counts > 1
        bitmap[_rows(terms[often], self.bits, True), column[often][:, None]] = 1
        return {"docs": docs, "bits": self.bits, "n_terms": sum(self.lengths), "slices": np.packbits(bitmap, axis=1).tobytes(),
                "ids": self.ids, "lengths": np.array(self.lengths, np.int64).tobytes(),
                "tops": np.array([c.max() for c in self.counts], np.int64).tobytes(),
                "starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes(),
                "terms": terms.tobytes(), "counts": counts.tobytes()}


_INDEX = pa.schema([("docs", pa.int32()), ("bits", pa.int32()), ("n_terms", pa.int64()), ("slices", pa.binary()),
                    ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "tops", "starts", "terms", "counts")]])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _Block] = {}
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_py()
            terms = terms_of(data) if data else []
            if not terms:
                continue
            tally = Counter(terms)
            counts = np.fromiter(tally.values(), np.int32, len(tally))
            bits = _bits_for(len(tally) + int((counts > 1).sum()))
            block = open_blocks.get(bits) or open_blocks.setdefault(bits, _Block(bits))
            block.ids.append(doc_id)
            block.lengths.append(len(terms))
            block.terms.append(_hashed(list(tally)))
            block.counts.append(counts)
            if len(block.ids) >= block.room:
                yield pa.RecordBatch.from_pylist([open_blocks.pop(bits).row()], schema=_INDEX)
    for block in open_blocks.values():
        yield pa.RecordBatch.from_pylist([block.row()], schema=_INDEX)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents, written to the shared folder; documents without a term are in none.

    Whole texts, of any length; a NULL text has no term.  Rows that repeat are documents of their
    own.  Ids are integers or NULL; an empty table gives no block.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    return cut_lineage(rows.mapInArrow(_index, INDEX_DDL), **ROW_GROUPS)


# -- search -----------------------------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In how many documents of this task each of the sorted hashes occurs."""
    found = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for data in batch.column(0):
            terms = np.frombuffer(data.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
            found += np.bincount(at[wanted[at] == terms], minlength=len(wanted))
    met = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(found[met])], ["t", "df"])


class _Best:
    """The best documents for one query so far; equal scores by ascending id, NULL last."""

    __slots__ = ("k", "scores", "keys", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.keys, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def floor(self) -> int:
        """A document must reach this score."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray, ids: list) -> None:
        scores, keys, ids = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys]), self.ids + ids
        order = [i for i in np.lexsort((keys, -scores)).tolist()[: self.k] if scores[i] > 0]
        self.scores, self.keys, self.ids = scores[order], keys[order], [ids[i] for i in order]


def saturated(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's occurrences count in a document of this length norm."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _search(batches: Iterator[pa.RecordBatch], k: int, items: list, picks: list[np.ndarray], wanted: np.ndarray, weights: np.ndarray,
            n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of this task for each query; ``picks`` are the places of its terms in ``wanted``."""
    best = [_Best(k) for _ in items]
    matrix = np.zeros((len(items), len(wanted)), np.float32)
    for q, pick in enumerate(picks):
        matrix[q, pick] = weights[pick]
    slack = 1 + (len(wanted) + 1) * 2.0**-22  # more than single precision loses
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            _search_block(row, best, picks, wanted, weights, matrix, slack, n_docs, n_terms)
    rows = [(q, items[q], i, s) for q, b in enumerate(best) for i, s in zip(b.ids, b.scores.tolist(), strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "item_id", "doc_id", "score"])


def _bounds(row: dict, wanted: np.ndarray, matrix: np.ndarray, once: np.ndarray, most: np.ndarray) -> np.ndarray:
    """An upper bound of each query's score in each document of the block."""
    slices = np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)
    present = [np.unpackbits(np.bitwise_and.reduce(slices[_rows(wanted, row["bits"], twice)], axis=1), axis=1, count=row["docs"])
               for twice in (False, True)]
    sums = [(matrix @ p.astype(np.float32)).astype(np.float64) for p in present]
    return sums[0] * once + sums[1] * (most - once)


def _search_block(row: dict, best: list[_Best], picks: list[np.ndarray], wanted: np.ndarray, weights: np.ndarray, matrix: np.ndarray,
                  slack: float, n_docs: int, n_terms: int) -> None:
    lengths, tops = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tops"], np.int64)
    norm = 10 + (90 * lengths * n_docs) // n_terms
    bounds = _bounds(row, wanted, matrix, saturated(np.int64(1), norm), saturated(tops, norm)) * slack
    floors = np.array([b.floor() for b in best], np.float64)
    alive = bounds >= floors[:, None]
    some = np.flatnonzero(alive.any(axis=0))
    if not len(some):
        return
    exact = _occurrences(row, some, wanted)
    place = np.zeros(row["docs"], np.int64)
    place[some] = np.arange(len(some))
    ids = row["ids"]
    keys = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
    for q in np.flatnonzero(alive.any(axis=1)).tolist():
        mine = np.flatnonzero(alive[q])
        mine = mine[np.argsort(-bounds[q, mine], kind="stable")]
        found, pick = best[q], picks[q]
        for at in range(0, len(mine), CHUNK):
            if bounds[q, mine[at]] < found.floor():
                break
            some_docs = mine[at:at + CHUNK]
            counts = exact[place[some_docs]][:, pick].astype(np.int64)
            scores = saturated(counts, norm[some_docs][:, None]) @ weights[pick]
            found.add(scores, keys[some_docs], [ids[d] for d in some_docs.tolist()])


def _occurrences(row: dict, some: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted term occurs in each of these documents."""
    starts, terms = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["terms"], np.uint64)
    counts = np.frombuffer(row["counts"], np.int32)
    sizes = starts[some + 1] - starts[some]
    owner = np.repeat(np.arange(len(some)), sizes)
    entry = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[some], sizes)
    at = np.minimum(np.searchsorted(wanted, terms[entry]), len(wanted) - 1)
    hit = wanted[at] == terms[entry]
    out = np.zeros((len(some), len(wanted)), np.int32)
    out[owner[hit], at[hit]] = counts[entry[hit]]
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Queries with their terms, in blocks of bounded size, as they come to the driver."""
    held: list[tuple[int | None, set[bytes]]] = []
    distinct: set[bytes] = set()
    for item_id, data in items.toLocalIterator():
        terms = set(terms_of(bytes(data))) if data else set()
        if not terms:
            continue
        if held and (len(held) >= ITEMS or len(distinct | terms) > TERMS):
            yield held
            held, distinct = [], set()
        held.append((item_id, terms))
        distinct |= terms
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores rank by ascending doc_id, NULL last.  Items without a term have no row; items
    that repeat are ranked each for themselves.  An item's terms count once each.
    """
    spark = index.sparkSession
    ship(spark)
    total = index.agg(F.sum("docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    names = ["item_id", "rank", "doc_id", "score"]
    ranked = None
    rows = items.select(F.col(item_id).cast("long"), F.col(text).cast("binary"))
    for block in _blocks(rows) if n_docs else ():
        hashes = [np.unique(_hashed(sorted(terms))) for _, terms in block]
        wanted = np.unique(np.concatenate(hashes))
        counted = index.select("terms").mapInArrow(partial(_frequencies, wanted=wanted), "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))
        df = np.zeros(len(wanted), np.int64)
        for t, n in counted.collect():  # at most a row per wanted term
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        find = partial(_search, k=k, items=[i for i, _ in block], picks=[np.searchsorted(wanted, h) for h in hashes], wanted=wanted,
                       weights=weights, n_docs=n_docs, n_terms=n_terms)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = index.mapInArrow(find, FOUND_DDL).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*names)
        found = cut_lineage(found)
        ranked = found if ranked is None else ranked.unionByName(found)
    return ranked if ranked is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
