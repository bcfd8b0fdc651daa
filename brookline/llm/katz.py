"""Katz backoff language model of words, trained and evaluated over whole corpora.

P(w | h) is d(c) * c(h, w) / c(h) if the bigram was seen in training, else alpha(h) * P(w); P(w) is d(c) * c(w) / N for a
known word, and the mass that the discounts leave is the unknown word's. d are Good-Turing discounts of each order for
counts up to RELIABLE; higher counts keep all but TRUST of their mass, so that every history leaves some. alpha(h) is
computed from all seen continuations of h, so each distribution sums to 1 over the known words, the end and the unknown
word.

The n-gram tables are partitioned by a hash of the n-gram. A chunk of documents sends its distinct n-grams to their
partitions, with how often they occur in its training documents; a partition adds up, keeps its part of the table and
answers each chunk. So a third of all rows with one text, or one word, cost one row a chunk and no more. The sums that
alpha(h) needs are additive: of the chunks that hold a bigram in training one is told to count it, and the sums of a
history are added up in its partition. Tokens are then scored from the answers: the bigram if seen, else alpha of the
history and the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POSITION, Scratch, documents, hashed_words, mix

RELIABLE, TRUST = 5, 1e-6
#: Bytes of text of a chunk, and n-grams of a partition, about.
CHUNK, PARTITION = 8_000_000, 4_000_000
#: Of a document's flags (held out is 1): it has no doc_id.
NO_ID = 2
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CHUNKS = "docs binary, held binary, lengths binary, words binary, tokens binary"
SENT = "chunk long, bucket int, keys binary, counts binary"
ANSWERS = "kind string, bucket int, chunk long, keys binary, counts binary, mine binary"


def chunk_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: CHUNKS of (doc_id, text, held). tokens: places in words, the end included. Frequent words come first,
    and the low halves of the places stand before the high ones, which makes them short when compressed."""
    docs, held, lengths, parts, size = [], [], [], [], 0

    def chunk() -> pa.RecordBatch:
        words, tokens, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        halves = place[tokens].view(np.uint16).reshape(-1, 2).T
        columns = [np.array(docs, np.int64), np.array(held, np.uint8), np.array(lengths, np.int32), words[order], np.ascontiguousarray(halves)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["docs", "held", "lengths", "words", "tokens"])

    for batch in rows:
        ids, out = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        for start, end, words, offsets in hashed_words(batch.column("text")):
            parts.append(np.insert(words, offsets[1:], END))
            lengths += (np.diff(offsets) + 1).tolist()
            docs += [0 if x is None else x for x in ids[start:end]]
            held += [h | NO_ID * (x is None) for h, x in zip(out[start:end], ids[start:end], strict=True)]
            size += 8 * len(words)
            if size > CHUNK:
                yield chunk()
                docs, held, lengths, parts, size = [], [], [], [], 0
    if docs:
        yield chunk()


class Chunk:
    """A chunk with its distinct words and bigrams."""

    def __init__(self, row: dict):
        self.docs, self.flags = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["held"], np.uint8)
        self.held = self.flags & 1 == 1
        self.lengths, self.words = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["words"], np.uint64)
        self.tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], np.uint16).reshape(2, -1).T).view(np.uint32).ravel().astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.training = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.words)).astype(np.uint32)

    def histories(self) -> np.ndarray:
        """The place of each token's history; len(words) is the begin."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.ends - self.lengths] = len(self.words)
        return before

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, place of each token's bigram)."""
        hashes = np.append(self.words, BEGIN)
        keys = mix(hashes[self.histories()] * POSITION[1] + self.words[self.tokens] * POSITION[2])
        return np.unique(keys, return_inverse=True)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket, offsets of the buckets): the same each time, so answers need no keys."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def sends(order: int, buckets: int):
    """mapInArrow: the chunk's distinct n-grams of an order as SENT."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                c = Chunk(row)
                if order == 1:
                    keys, counts = c.words, c.word_counts()
                else:
                    keys, at = c.bigrams()
                    counts = np.bincount(at[c.training], minlength=len(keys)).astype(np.uint32)
                place, offsets = dealt(keys, buckets)
                keys, counts = keys[place], counts[place]
                used = np.flatnonzero(np.diff(offsets))
                cut = lambda x: pa.array([x[offsets[b] : offsets[b + 1]].tobytes() for b in used], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(used), pa.int64()), pa.array(used.astype(np.int32)), cut(keys), cut(counts)], ["chunk", "bucket", "keys", "counts"])

    return run


def add_up(table: pa.Table) -> pa.Table:
    """A partition's counts (chunk null), and its answers: the count of each n-gram sent, and which ones are the chunk's to count."""
    chunks = table.column("chunk").to_pylist()
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.uint64)
    # The first chunk that has the n-gram in training counts it.
    first = np.full(len(found), len(at), np.int64)
    own = np.flatnonzero(counts)
    np.minimum.at(first, at[own], own)
    mine = np.zeros(len(at), bool)
    mine[first[first < len(at)]] = True
    known = total > 0
    answer = np.minimum(total, 2**32 - 1).astype(np.uint32)[at]
    cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    bucket = table.column("bucket")[0].as_py()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table([
        pa.array(["table", *["answers"] * len(chunks)], pa.string()), pa.array([bucket] * (len(chunks) + 1), pa.int32()), pa.array([None, *chunks], pa.int64()), pa.array([found[known].tobytes(), *[None] * len(chunks)], pa.binary()),
        pa.array([total[known].tobytes(), *[answer[a:b].tobytes() for a, b in spans]], pa.binary()), pa.array([None, *[np.packbits(mine[a:b]).tobytes() for a, b in spans]], pa.binary()),
    ], names=["kind", "bucket", "chunk", "keys", "counts", "mine"])


def _sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(types, total, n1 .. n of RELIABLE + 1) of a task's partitions."""
    out = np.zeros(RELIABLE + 3, np.int64)
    for batch in rows:
        for x in batch.column("counts"):
            counts = np.frombuffer(x.as_buffer(), np.uint64)
            out[0] += len(counts)
            out[1] += int(counts.sum())
            out[2:] += np.bincount(np.minimum(counts, RELIABLE + 2).astype(np.int64), minlength=RELIABLE + 3)[1 : RELIABLE + 2]
    yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.int64()))], ["s"])


def statistics(table: DataFrame) -> np.ndarray:
    """The sums of all partitions; a few numbers a task."""
    sums = table.select("counts").mapInArrow(_sums, "s array<long>")
    row = sums.agg(*[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(RELIABLE + 3)]).first()
    return np.array([x or 0 for x in row], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d for the counts 0 .. RELIABLE + 1 (that and above) from n1 .. n of RELIABLE + 1, by Good and Turing.

    Where those counts of counts give none between 0 and 1 (few data), half a count is taken off.
    """
    out = np.full(RELIABLE + 2, 1 - TRUST)
    out[0] = 0.0
    above = (RELIABLE + 1) * n[RELIABLE] / n[0] if n[0] else 1.0
    for r in range(1, RELIABLE + 1):
        d = 0.0
        if n[r - 1] and above < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - above) / (1 - above)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """What all tasks need besides their answers: a few numbers."""

    def __init__(self, words: np.ndarray, bigrams: np.ndarray, documents: int):
        self.types, self.total, self.documents = int(words[0]), int(words[1]), documents
        self.d1, self.d2 = discounts(words[2:]), discounts(bigrams[2:])
        r = np.arange(1, RELIABLE + 1)
        low = words[2 : 2 + RELIABLE] * r
        kept = float((low * self.d1[1:-1]).sum() + (self.total - low.sum()) * self.d1[-1])
        self.unknown = 1.0 - kept / self.total if self.total else 1.0

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these training counts."""
        p = self.d1[np.minimum(counts, RELIABLE + 1)] * counts / max(1, self.total)
        return np.where(counts > 0, p, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))


STATE = "chunk long, bucket int, keys binary, sums binary, docs binary, held binary, lengths binary, known binary, base binary, score binary, places binary, counts binary"


def _answers(table: pa.Table, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, mine) of each key, from a chunk's answers of one order."""
    place, offsets = dealt(keys, buckets)
    counts, mine = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for b, c, m in zip(table.column("bucket").to_pylist(), table.column("counts"), table.column("mine"), strict=True):
        at = place[offsets[b] : offsets[b + 1]]
        counts[at] = np.frombuffer(c.as_buffer(), np.uint32)
        mine[at] = np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8))[: len(at)].astype(bool)
    return counts, mine


def evaluate(model: Model, buckets: int):
    """cogrouped map: a chunk and its answers -> its state, and the sums of its histories for their partitions (STATE)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = Chunk(row)
        order = np.array(right.column("n").to_pylist())
        w_count, _ = _answers(right.filter(pa.array(order == 1)), c.words, buckets)
        keys, at = c.bigrams()
        b_count, mine = _answers(right.filter(pa.array(order == 2)), keys, buckets)
        p_word = model.word(w_count)
        history = c.histories()
        h_count = np.append(w_count, model.documents)
        one = np.zeros(len(keys), np.int64)  # a token of each bigram
        one[at] = np.arange(len(at))
        h, w = history[one], c.tokens[one]
        with np.errstate(divide="ignore", invalid="ignore"):
            p_big = model.d2[np.minimum(b_count, RELIABLE + 1)] * b_count / h_count[h]
            log = np.where(b_count > 0, np.log10(p_big), np.log10(p_word[w]))
        # Of the histories: the mass of the seen continuations, and what they have as words.
        seen = np.bincount(h[mine], weights=p_big[mine], minlength=len(c.words) + 1)
        as_words = np.bincount(h[mine], weights=p_word[w[mine]], minlength=len(c.words) + 1)
        backed_off = (b_count[at] == 0) & (h_count[history] > 0)
        doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
        per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(c.lengths))
        # Backed-off tokens by document and history.
        pairs, times = np.unique(doc[backed_off] * (len(c.words) + 1) + history[backed_off], return_counts=True)
        asked, places = np.unique(pairs % (len(c.words) + 1), return_inverse=True)
        hashes = np.append(c.words, BEGIN)
        sent = np.union1d(asked, np.flatnonzero(seen))
        places = np.searchsorted(sent, asked)[places]
        by_doc = np.bincount(pairs // (len(c.words) + 1), minlength=len(c.lengths)).astype(np.int32)
        place, offsets = dealt(hashes[sent], buckets)
        used = np.flatnonzero(np.diff(offsets))
        sums = np.column_stack((seen[sent], as_words[sent]))[place]
        rest = [None] * len(used)
        texts = lambda own: pa.array([own.tobytes(), *rest], pa.binary())
        cut = lambda x: pa.array([None, *[np.ascontiguousarray(x[offsets[b] : offsets[b + 1]]).tobytes() for b in used]], pa.binary())
        known = per_doc(w_count[c.tokens] > 0).astype(np.int64)
        return pa.table([
            pa.array([row["chunk"]] * (len(used) + 1), pa.int64()), pa.array([None, *used.tolist()], pa.int32()), pa.array([hashes[sent].tobytes(), *[hashes[sent][place][offsets[b] : offsets[b + 1]].tobytes() for b in used]], pa.binary()), cut(sums),
            texts(c.docs), texts(c.flags), texts(c.lengths), texts(known), texts(per_doc(model.base(w_count)[c.tokens])), texts(per_doc(log[at])), texts(np.concatenate((by_doc, places.astype(np.int32)))), texts(times.astype(np.int32)),
        ], names=[x.split()[0] for x in STATE.split(", ")])

    return run


def weigh(table: pa.Table) -> pa.Table:
    """A partition's histories -> (chunk, bucket, weights): log10 alpha of each history sent, 0 for one that was never seen."""
    chunks = table.column("chunk").to_pylist()
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    sums = np.concatenate([np.frombuffer(x.as_buffer(), np.float64).reshape(-1, 2) for x in table.column("sums")])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    seen = np.bincount(at, weights=sums[:, 0], minlength=len(found))
    words = np.bincount(at, weights=sums[:, 1], minlength=len(found))
    log = np.log10(np.maximum(1 - seen, 1e-300) / np.maximum(1 - words, 1e-300))
    log = np.where(seen > 0, log, 0.0)[at]
    cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    bucket = table.column("bucket")[0].as_py()
    return pa.table([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array([log[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["chunk", "bucket", "weights"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def finish(buckets: int):
    """cogrouped map: a chunk's state and the weights of its histories -> SCORES."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        read = lambda c, kind: np.frombuffer(row[c], kind)
        keys, docs = read("keys", np.uint64), read("docs", np.int64)
        place, offsets = dealt(keys, buckets)
        weights = np.zeros(len(keys))
        for b, w in zip(right.column("bucket").to_pylist(), right.column("weights"), strict=True):
            weights[place[offsets[b] : offsets[b + 1]]] = np.frombuffer(w.as_buffer(), np.float64)
        places = read("places", np.int32)
        by_doc, places = places[: len(docs)], places[len(docs) :]
        doc = np.repeat(np.arange(len(docs)), by_doc)
        more = np.bincount(doc, weights=weights[places] * read("counts", np.int32), minlength=len(docs)) if len(places) else np.zeros(len(docs))
        flags = read("held", np.uint8)
        return pa.table([pa.array(docs, mask=flags & NO_ID > 0), pa.array(flags & 1 == 1), pa.array(read("lengths", np.int32).astype(np.int64)), pa.array(read("known", np.int64)), pa.array(read("base", np.float64)), pa.array(read("score", np.float64) + more)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, one row for each row.

    Trained on the rows where ``held_out`` is false (null: false). Tokens: lower-cased (A-Z) words and one end; a null
    or empty text is its end alone. A null doc_id stays null. Without training rows all tokens are unknown, with
    probability 1. An empty table gives an empty result. Other columns are ignored. Words and bigrams are told apart
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = documents(docs, F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = rows.mapInArrow(chunk_rows, CHUNKS).withColumn("chunk", F.monotonically_increasing_id())
    chunks = scratch.table(chunks, "chunks")
    size = chunks.agg(F.sum(F.octet_length("tokens")), F.count("*")).first()
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) if (size[0] or 0) > 4 * PARTITION else 4, 10**6), -(-(size[0] or 0) // 4 // PARTITION))
    answers, sums = None, []
    for order in (1, 2):
        sent = chunks.mapInArrow(sends(order, buckets), SENT)
        path = scratch.write(sent.groupBy("bucket").applyInArrow(add_up, ANSWERS), f"order-{order}", "kind")
        read = spark.read.schema(ANSWERS.removeprefix("kind string, "))
        sums.append(statistics(read.parquet(f"{path}/kind=table")) if (size[1] or 0) else np.zeros(RELIABLE + 3, np.int64))
        # The tables have served: what is asked of them is answered.
        scratch.drop(f"order-{order}/kind=table")
        own = read.parquet(f"{path}/kind=answers" if size[1] else path).select("chunk", "bucket", "counts", "mine", F.lit(order).alias("n"))
        answers = own if answers is None else answers.union(own)
    training = documents(docs).where(~F.coalesce(held_out, F.lit(False))).count()
    model = Model(*sums, training)
    state = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(evaluate(model, buckets), STATE)
    state = scratch.table(state, "state")
    scratch.drop("chunks", "order-1", "order-2")
    weights = state.where("bucket is not null").select("chunk", "bucket", "keys", "sums").groupBy("bucket").applyInArrow(weigh, "chunk long, bucket int, weights binary")
    own = state.where("bucket is null").drop("bucket", "sums")
    out = own.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(finish(buckets), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
