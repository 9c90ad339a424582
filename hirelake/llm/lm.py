"""Language model scores of documents: a log-bilinear model trained by noise-contrastive estimation.

Texts become table rows of token numbers once (``CHUNK_BYTES`` of text each, written in buckets); everything else reads those.

1. Every chunk sends its distinct words with their counts in learnable documents; Spark adds them up. That is the vocabulary of
   the whole corpus, and it grows with the corpus. Joined back, it tells each chunk the counts of its words.
2. The ``words`` most frequent words, the end of a text and one class for all other words are the model's outcomes. The model (Mnih
   and Hinton, ICML 2007; diagonal context weights and noise-contrastive estimation: Mnih and Teh, ICML 2012) predicts the
   vector of the next token as the weighted sum of the vectors of the ``context`` tokens before it. It is trained on all learnable
   tokens, once: in each of ``ROUNDS`` rounds every task goes on from the common weights with its share of the tokens, and Spark
   averages what the tasks return, weighted by their tokens. Only weights, whose size does not depend on the data, are told.
3. Each chunk is scored by matrix products over batches of its contexts, normalised over all outcomes. A word of the class of other words
   has the class's probability times its own share ``(c + 1) / (N' + V' + 1)`` in the class, with the counts and the number of
   the words in it; one word of the class stands for all that were never seen. So probabilities add up to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hirelake.llm.columns import free
from hirelake.llm.words import BYTE_VALUES, SEGMENT_BYTES, _power_tables, mix
from hirelake.session import Scratch

WORDS, SIZE, CONTEXT = 1022, 24, 2
ROUNDS, BATCH, NOISE, RATE = 4, 1024, 128, 0.1
CHUNK_BYTES = 6 << 20
# Chunks that one task works on; there are as many copies of the weights under way as tasks.
CHUNKS_PER_TASK = 4
# Tokens scored at a time, and weights that are averaged in one task.
ROWS, SLAB = 512, 1 << 15
SEED = 13

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True

CHUNK_SCHEMA = ("chunk long, tokens long, learnt long, rest binary, lengths binary, learn binary, "
                "words array<long>, counts array<long>, body binary")


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal to that of ``words.word_hashes``; temporary arrays are bounded by the longest span."""
    made = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + SEGMENT_BYTES, side="right")))
        size = int(ends[last - 1] - origin)
        up, down = _power_tables(max(size, SEGMENT_BYTES) + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[origin:origin + size]] * up[:size], out=sums[1:])
        at = starts[first:last] - origin
        made[first:last] = (sums[ends[first:last] - origin] - sums[at]) * down[at]
        first = last
    return mix(made ^ (ends - starts).astype(np.uint64), 1)


def _chunk_row(number: int, texts: list[bytes], learn: list[bool], rest: list[pa.RecordBatch]) -> dict:
    """Token numbers of a chunk: places among its distinct words, then one for the end of a text."""
    data = np.frombuffer(b" ".join(texts).lower(), dtype=np.uint8)
    starts, ends = _spans(data)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    lengths = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    words, tokens = np.unique(_hashes(data, starts, ends), return_inverse=True)
    learn = np.array(learn, dtype=bool)
    counts = np.bincount(tokens[np.repeat(learn, lengths)], minlength=len(words))
    body = np.full(len(tokens) + len(texts), len(words), dtype=np.uint32)
    body[np.arange(len(tokens)) + np.repeat(np.arange(len(texts)), lengths)] = tokens
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in rest:
            writer.write_batch(batch)
    return {"chunk": number, "tokens": len(body), "learnt": int((lengths[learn] + 1).sum()),
            "rest": sink.getvalue().to_pybytes(), "lengths": (lengths + 1).astype(np.int64).tobytes(), "learn": learn.tobytes(),
            "words": words.view(np.int64), "counts": counts, "body": _packed(body)}


def _make_chunks(chunk_bytes: int):
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("learnt", pa.int64()), ("rest", pa.binary()),
                        ("lengths", pa.binary()), ("learn", pa.binary()), ("words", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, texts, learn, rest = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            others, cut = batch.select(range(2, batch.num_columns)), 0
            for at, (flag, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                texts.append(text.as_py() or b"")
                learn.append(bool(flag))
                size += len(texts[-1]) + 16
                if size >= chunk_bytes:
                    rest.append(others.slice(cut, at - cut))
                    yield pa.RecordBatch.from_pylist([_chunk_row(number, texts, learn, rest)], schema)
                    number, size, texts, learn, rest, cut = number + 1, 0, [], [], [], at
            if cut < batch.num_rows:
                rest.append(others.slice(cut))
        if texts:
            yield pa.RecordBatch.from_pylist([_chunk_row(number, texts, learn, rest)], schema)

    return run


@dataclass
class Model:
    """Outcomes are the words by place, then the end of a text, then all other words; as context there is also the text's start.

    ``weights`` holds all that is trained; its parts are views by name.
    """

    words: np.ndarray  # 64-bit hashes, rising
    share: np.ndarray  # of each outcome in learnable tokens, smoothed
    size: int
    context: int
    weights: np.ndarray
    tokens: int = 0
    known: int = 0
    end: int = 0
    other_tokens: int = 0
    other_words: int = 0

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        n = len(self.share)
        return {"target": (n, self.size), "bias": (n,), "vector": (n + 1, self.size), "mixing": (self.context, self.size),
                "target_sum": (n,), "bias_sum": (n,), "vector_sum": (n + 1,), "mixing_sum": (self.context,)}

    def parts(self) -> dict[str, np.ndarray]:
        made, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            made[name] = self.weights[at:at + size].reshape(shape)
            at += size
        return made


def fresh(words: np.ndarray, counts: np.ndarray, size: int = SIZE, context: int = CONTEXT, **known) -> Model:
    """A model that predicts each outcome by its share. ``counts`` are those of the words, the end and the other words."""
    share = (counts + 1) / (counts.sum() + len(counts))
    model = Model(words, share, size, context, np.zeros(0, np.float32), **known)
    model.weights = np.zeros(sum(int(np.prod(s)) for s in model.shapes.values()), dtype=np.float32)
    draw, parts = np.random.default_rng(SEED), model.parts()
    for name in ("target", "vector"):
        parts[name][:] = draw.normal(0, 0.1, parts[name].shape)
    parts["mixing"][:] = 1
    parts["bias"][:] = np.log(share)
    return model


def contexts(ids: np.ndarray, place: np.ndarray, width: int, start: int) -> np.ndarray:
    """The ``width`` tokens before each token, nearest first; ``start`` before the text."""
    made = np.full((len(ids), width), start, dtype=np.int32)
    for k in range(1, width + 1):
        inside = place >= k
        made[inside, k - 1] = ids[np.flatnonzero(inside) - k]
    return made


def _add(total: np.ndarray, sums: np.ndarray, at: np.ndarray, change: np.ndarray, rate: float) -> None:
    """A step of adaptive gradient ascent (one rate per row) with the summed gradients of equal rows."""
    order = np.argsort(at, kind="stable")  # 16-bit numbers are sorted by radix
    rows = at[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    _step(total, sums, rows[first], np.add.reduceat(change[order], first, axis=0), rate)


def _step(total: np.ndarray, sums: np.ndarray, rows: np.ndarray | slice, step: np.ndarray, rate: float) -> None:
    square = step * step
    sums[rows] += square if step.ndim == 1 else square.mean(axis=1)
    scale = rate / np.sqrt(sums[rows] + np.float32(1e-6))
    total[rows] += step * scale if step.ndim == 1 else step * scale[:, None]


def train(model: Model, targets: np.ndarray, before: np.ndarray, seed: int, batch: int = BATCH, noise: int = NOISE,
          rate: float = RATE) -> None:
    """One pass over the tokens in random order; changes ``model.weights``. Each batch is told from ``noise`` shared samples of
    the outcomes' shares."""
    draw, p = np.random.default_rng([SEED, seed]), model.parts()
    kind = np.uint16 if len(model.share) < 1 << 16 else np.int32
    ladder, likely = np.cumsum(model.share), (np.log(model.share) + np.log(noise)).astype(np.float32)
    order = draw.permutation(len(targets))
    targets, before = targets[order].astype(kind), before[order].astype(kind)
    for at in range(0, len(order), batch):
        t, c = targets[at:at + batch], before[at:at + batch]
        sample = np.minimum(np.searchsorted(ladder, draw.random(noise)), len(ladder) - 1).astype(kind)
        vectors = [p["vector"][c[:, k]] for k in range(model.context)]
        hidden = vectors[0] * p["mixing"][0]
        for k in range(1, model.context):
            hidden += vectors[k] * p["mixing"][k]
        true, false = p["target"][t], p["target"][sample]
        real = np.einsum("bd,bd->b", hidden, true)
        real += p["bias"][t] - likely[t]
        real = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        guess = hidden @ false.T
        guess += p["bias"][sample] - likely[sample]
        guess = -1 / (1 + np.exp(-np.clip(guess, -30, 30, out=guess)))
        change = guess @ false
        change += real[:, None] * true
        both = np.concatenate([t, sample])
        _add(p["target"], p["target_sum"], both, np.concatenate([real[:, None] * hidden, guess.T @ hidden]), rate)
        # The bias of a frequent outcome has many gradients: they are counted, not sorted.
        slope = np.bincount(both, np.concatenate([real, guess.sum(axis=0)]), len(model.share)).astype(np.float32)
        _step(p["bias"], p["bias_sum"], slice(None), slope, rate)
        turned = np.stack([np.einsum("bd,bd->d", v, change) for v in vectors])
        spread = np.concatenate([change * m for m in p["mixing"]])
        _add(p["vector"], p["vector_sum"], c.T.ravel(), spread, rate)
        _step(p["mixing"], p["mixing_sum"], slice(None), turned, rate)


def log_probabilities(model: Model, targets: np.ndarray, before: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Natural logarithm of each target's probability, normalised over all outcomes. Tokens with the same context share its sum."""
    p, base = model.parts(), len(model.share) + 1
    key = np.zeros(len(targets), dtype=np.int64)
    for k in range(model.context):  # contexts that do not fit into a number are told apart by a hash-free renumbering
        key = key * base + before[:, k]
        if k + 1 < model.context and base ** (k + 2) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    own = before[first]
    hidden = p["vector"][own[:, 0]] * p["mixing"][0]
    for k in range(1, model.context):
        hidden += p["vector"][own[:, k]] * p["mixing"][k]
    table, bias, ones = np.ascontiguousarray(p["target"].T), p["bias"], np.ones(len(model.share), dtype=np.float32)
    total = np.empty(len(own))
    for at in range(0, len(own), rows):
        scores = hidden[at:at + rows] @ table
        scores += bias
        with np.errstate(over="ignore"):
            total[at:at + rows] = np.log((np.exp(scores) @ ones).astype(float))
        if not np.isfinite(total[at:at + rows]).all():
            most = scores.max(axis=1).astype(float)
            total[at:at + rows] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    made = np.empty(len(targets))
    for at in range(0, len(targets), 1 << 16):
        t, w = targets[at:at + (1 << 16)], which[at:at + (1 << 16)]
        made[at:at + len(t)] = np.einsum("bd,bd->b", hidden[w], p["target"][t]).astype(float) + bias[t] - total[w]
    return made


def _chunks(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """Rows of chunks; the words stay an array."""
    for k in range(table.num_rows):
        yield {name: table.column(name)[k].values.to_numpy() if name == "words" else table.column(name)[k].as_py()
               for name in table.schema.names}


class _Tokens:
    """The tokens of one chunk as outcomes of the model."""

    def __init__(self, row, model: Model):
        self.words = row["words"].view(np.uint64)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.learn = np.frombuffer(row["learn"], dtype=bool)
        self.body = _unpacked(row["body"], np.uint32)
        k = len(model.words)
        self.outcome = np.full(len(self.words) + 1, k + 1, dtype=np.int32)
        at = np.searchsorted(self.words, model.words)
        found = np.flatnonzero(at < len(self.words))
        found = found[self.words[at[found]] == model.words[found]]
        self.outcome[at[found]] = found
        self.outcome[-1] = k
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.outcome[self.body]
        self.before = contexts(self.ids, np.arange(len(self.ids)) - np.repeat(self.starts, self.lengths), model.context, k + 2)


def _train_round(model: Model, number: int, rounds: int):
    """Every task trains on every ``rounds``-th learnable document of its chunks and returns its weights in slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.weights = model.weights.copy()
        done = 0
        for batch in batches:
            for row in _chunks(batch):
                tokens = _Tokens(row, model)
                chosen = tokens.learn & (np.arange(len(tokens.learn)) % rounds == number)
                own = np.flatnonzero(np.repeat(chosen, tokens.lengths))
                train(model, tokens.ids[own], tokens.before[own], (row["chunk"] << 8) + number)
                done += len(own)
        if done:
            slabs = range(0, len(model.weights), SLAB)
            yield pa.RecordBatch.from_pydict({
                "slab": np.arange(len(slabs)), "task": np.full(len(slabs), TaskContext.get().partitionId()),
                "n": np.full(len(slabs), done), "part": [model.weights[a:a + SLAB].tobytes() for a in slabs]})

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of the tasks' weights by their tokens, added in the order of the tasks."""
    table = table.sort_by("task")
    share = table["n"].to_numpy() / sum(table["n"].to_pylist())
    total = sum(s * np.frombuffer(p, dtype=np.float32) for s, p in zip(share, table["part"].to_pylist(), strict=True))
    return pa.table({"slab": table["slab"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()])})


def _score(model: Model, names: tuple[str, ...]):
    log_all = np.log10(model.tokens + model.known + 1)
    log_other = np.log10(model.other_tokens + model.other_words + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        at, found = right["at"].to_numpy(), right["total"].to_numpy()
        for row in _chunks(left):
            tokens = _Tokens(row, model)
            counts = np.zeros(len(tokens.words) + 1)
            counts[at] = found
            counts[-1] = model.end
            own = np.log10(counts + 1)
            scores = log_probabilities(model, tokens.ids, tokens.before) / np.log(10)
            inside = np.where(tokens.outcome == len(model.words) + 1, own - log_other, 0)
            scores += inside[tokens.body]
            sums = [np.add.reduceat(x, tokens.starts) for x in (
                (counts > 0).astype(np.int64)[tokens.body], (own - log_all)[tokens.body], scores)]
            with pa.ipc.open_stream(row["rest"]) as reader:
                rest = reader.read_all()
            for name, column in zip(names, [tokens.lengths, *sums], strict=True):
                rest = rest.append_column(name, pa.array(column))
            made.append(rest)
        return pa.concat_tables(made) if made else None

    return run


def score(docs: DataFrame, scratch: Scratch, keep: list[str], learn_col: str, text_col: str = "text", words: int = WORDS,
          size: int = SIZE, context: int = CONTEXT, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES,
          names: tuple[str, str, str, str] = ("n_tokens", "n_known", "base_score", "score")) -> tuple[DataFrame, Model]:
    """The columns ``keep``, then ``n_tokens, n_known, base_score, score`` (or other ``names``): one row per input row, read lazily
    from ``scratch``; and the model. Scores are logarithms to base 10 of a text's probability.

    Tokens are runs of bytes other than space and ``\\t\\n\\v\\f\\r`` after lower-casing A-Z, then one end. A null text is an empty one:
    its only token is the end. Learnt from are the rows whose ``learn_col`` is true (null: not); repeated rows count as often as
    they occur. Without learnable rows every word is unseen and the model knows the end and the class of other words only.
    An empty table gives no rows; other columns are not read and may have any names. Words are told apart by a 64-bit hash.
    """
    own_learn, own_text = free(docs.columns, "learn", "text")
    rows = docs.select(F.col(learn_col).alias(own_learn), F.col(text_col).cast("binary").alias(own_text), *keep)
    total = docs.agg(F.sum(F.octet_length(text_col) + 16).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (chunk_bytes * CHUNKS_PER_TASK)))
    chunks = scratch.bucketed(rows.mapInArrow(_make_chunks(chunk_bytes), CHUNK_SCHEMA), "chunks", buckets, "chunk")

    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select(
        "chunk", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    vocabulary = scratch.table(entries.filter("n > 0").groupBy("word").agg(F.sum("n").alias("total")), "vocabulary")
    sums = vocabulary.agg(F.count(F.lit(1)).alias("known"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens")).first()
    learnt = chunks.agg(F.coalesce(F.sum("learnt"), F.lit(0)).alias("n")).first()["n"]
    end = learnt - sums["tokens"]
    best = vocabulary.orderBy(F.desc("total"), "word").limit(words).collect()
    best = sorted((np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF), r["total"]) for r in best)
    inside = sum(n for _, n in best)
    counts = np.array([*(n for _, n in best), end, sums["tokens"] - inside], dtype=np.int64)
    model = fresh(np.array([w for w, _ in best], dtype=np.uint64), counts, size, context, tokens=learnt,
                  known=sums["known"] + (end > 0), end=end, other_tokens=sums["tokens"] - inside,
                  other_words=sums["known"] - len(best))

    narrow = chunks.select("chunk", "lengths", "learn", "words", "body")
    for number in range(rounds):
        parts = narrow.mapInArrow(_train_round(model, number, rounds), "slab long, task long, n long, part binary")
        mean = parts.groupBy("slab").applyInArrow(_average, "slab long, part binary").orderBy("slab").collect()
        if mean:
            model.weights = np.frombuffer(b"".join(r["part"] for r in mean), dtype=np.float32)

    told = scratch.table(entries.select("chunk", "at", "word").join(vocabulary.hint("merge"), "word").select(
        "chunk", "at", "total"), "told")
    kinds = zip(names, (LongType(), LongType(), DoubleType(), DoubleType()), strict=True)
    result = StructType([docs.schema[c] for c in keep] + [StructField(n, k) for n, k in kinds])
    wanted = chunks.select("chunk", "rest", "lengths", "learn", "words", "body")
    return wanted.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(model, names), result), model
