"""Packing documents into training sequences by lexical retrieval.

Documents are encoded once and written with their token ids. An inverted index is built per shard of about ``SHARD_TOKENS``
tokens: postings of token ids with BM25 weights, whose document frequencies and mean length cover all documents. Shards are
ranges of a min-hash of token pairs, so that similar texts meet in one shard; ties are broken by id and row, so a text with
very many copies spreads over shards.

Within a shard, the first unused document is the seed of a sequence. The index ranks the unused documents by the seed's
``QUERY_TERMS`` terms of the largest weight; the best neighbours are appended until the sequence is full. The document that
does not fit is cut there, and what is left of it is the seed of the next sequence. So only a shard's last sequence is
padded.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.bpe import encoder
from hirelake.llm.words import mix
from hirelake.session import Scratch

LENGTH = 2048
END = 1
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 64
K1, B = 1.2, 0.75

ENCODED = "id long, n long, mark long, kind string, ids binary"
PIECES = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


def _mark(ids: np.ndarray) -> int:
    """Min-hash of neighbouring token ids."""
    wide = ids.astype(np.uint64)
    pairs = wide[:-1] << np.uint64(32) | wide[1:] if len(wide) > 1 else wide
    return int(mix(pairs, 5).min().view(np.int64))


def _encode(path: str, end: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("kind", pa.string()),
                        ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        frequency = np.zeros(max(coder.size, end + 1), dtype=np.int64)
        for batch in batches:
            rows, size = [], 0
            texts = (t.as_py() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(texts), strict=True):
                ids = np.append(ids, coder.kind(end)).astype(np.uint32 if coder.size > 1 << 16 else np.uint16)
                frequency[np.unique(ids)] += 1
                rows.append({"id": doc_id, "n": len(ids), "mark": _mark(ids), "kind": ids.dtype.str, "ids": ids.tobytes()})
                size += len(rows[-1]["ids"])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        # One more row per task: in how many of its documents each id occurs.
        yield pa.RecordBatch.from_pylist([{"id": None, "n": len(frequency), "mark": None, "kind": "df",
                                           "ids": frequency.tobytes()}], schema)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            counts = np.frombuffer(data.as_py(), dtype=np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "n"])


class Index:
    """BM25 postings of a bounded number of documents."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, weights, owners = [], [], []
        for number, ids in enumerate(documents):
            own, counts = np.unique(ids, return_counts=True)
            norm = K1 * (1 - B + B * len(ids) / mean)
            terms.append(own)
            weights.append((idf[own] * counts * (K1 + 1) / (counts + norm)).astype(np.float32))
            owners.append(np.full(len(own), number, dtype=np.int32))
        self.terms, self.weights = terms, weights
        every = np.concatenate(terms)
        order = np.argsort(every, kind="stable")
        self.postings = np.concatenate(owners)[order]
        self.values = np.concatenate(weights)[order]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(idf)))])

    def scores(self, document: int, query_terms: int) -> np.ndarray:
        """Scores of all documents for the heaviest terms of one; equal weights by the smaller id."""
        own, weights = self.terms[document], self.weights[document]
        if len(own) > query_terms:
            own = own[np.argsort(-weights, kind="stable")[:query_terms]]
        total = np.zeros(len(self.terms), dtype=np.float32)
        for a, b in zip(self.bounds[own].tolist(), self.bounds[own + 1].tolist(), strict=True):
            total[self.postings[a:b]] += self.values[a:b]
        return total


def fill(documents: list[np.ndarray], index: Index, length: int, query_terms: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of ``(document, start, end)``; every token of every document stands in one of them."""
    unused = np.ones(len(documents), dtype=bool)
    order = iter(range(len(documents)))
    carried = None
    while True:
        if carried is None:
            seed = next((d for d in order if unused[d]), None)
            if seed is None:
                return
            unused[seed] = False
            carried = (seed, 0)
        seed, start = carried
        carried = None
        sequence, room = [], length
        scores = None
        current = (seed, start)
        while current is not None:
            document, at = current
            take = min(room, len(documents[document]) - at)
            sequence.append((document, at, at + take))
            room -= take
            if at + take < len(documents[document]):
                carried = (document, at + take)
            if not room:
                break
            if scores is None:
                scores = np.where(unused, index.scores(seed, query_terms), -1)
            best = int(scores.argmax())
            if scores[best] < 0:
                break
            scores[best] = -1
            unused[best] = False
            current = (best, 0)
        yield sequence


def _pack(shared, length: int, shard_tokens: int, query_terms: int, with_ids: bool):
    from pyspark import TaskContext

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def packed(names: list, documents: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            for sequence in fill(documents, Index(documents, idf, mean), length, query_terms):
                number, offset = next(numbers), 0
                for document, start, end in sequence:
                    piece = documents[document][start:end].astype("<u4")
                    rows.append((names[document], start, end - start, zlib.crc32(piece.tobytes()),
                                 len(documents[document]), number, offset, piece.tolist() if with_ids else None))
                    offset += end - start
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        names, documents, size = [], [], 0
        for batch in batches:
            for doc_id, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                          strict=True):
                names.append(doc_id)
                documents.append(np.frombuffer(data.as_py(), dtype=kind))
                size += len(documents[-1])
                if size >= 2 * shard_tokens:  # a range of unlucky size becomes several shards
                    yield packed(names, documents)
                    names, documents, size = [], [], 0
        if documents:
            yield packed(names, documents)

    return run


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         end: int = END, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, query_terms: int = QUERY_TERMS,
         with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A document is its ids by the file ``vocabulary`` (of the ``tokenizers`` library; the same path on every machine),
    without special tokens, then ``end``; a null text is empty. Pieces of a document follow one another without gap;
    so do the pieces of a sequence, which has at most ``length`` tokens. ``ids`` is null unless ``with_ids``. Repeated
    rows are documents of their own; null ids are kept. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = scratch.table(rows.mapInArrow(_encode(vocabulary, end), ENCODED), "encoded")
    documents = stored.filter("kind <> 'df'")
    counted = stored.filter("kind = 'df'").select("ids").mapInArrow(_frequencies, "term long, n long")
    found = dict(map(tuple, counted.groupBy("term").agg(F.sum("n").alias("n")).collect()))  # one per vocabulary entry
    total = documents.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    frequency = np.zeros(max([end, *found], default=0) + 1)
    frequency[list(found)] = list(found.values())
    idf = np.log(1 + (total["docs"] - frequency + 0.5) / (frequency + 0.5))
    tokens = total["n"] or 0
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, tokens / max(1, total["docs"]))))
    shards = max(1, -(-tokens // shard_tokens))
    ranged = documents.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, "mark", "id", "row")
    ordered = ranged.sortWithinPartitions("mark", "id", "row").select("id", "kind", "ids")
    return ordered.mapInArrow(_pack(shared, length, shard_tokens, query_terms, with_ids), PIECES)
