"""Jaccard self-join of documents on word shingles, by prefixes of token combinations.

A document's tokens are the 64-bit hashes of its distinct word shingles; equal sets are one node. Tokens are ordered by
class (lone, rare, frequent: held by one node, by up to RARE, by more) and by hash. A set of n tokens may miss at most
d = n - ceil(t * n) tokens of a partner. Lone tokens are missed by every partner, so

* a node whose shared tokens are fewer than t * n has no partner and goes at once, which few nodes survive where most
  shingles stand in one text only;
* the rare class is indexed by single tokens: of the first d + 1 lone and rare tokens the rare ones;
* if a node has only r <= d lone and rare tokens, its prefix is extended into the frequent class, which is cut into
  blocks of the hash space. The prefix grows until its blocks hold d + 1 - r tokens beyond the first of each block;
  by the pigeonhole principle a partner then shares a pair of tokens of one block, and all such pairs are indexed.
  The number of blocks depends on the size level of the smaller partner, so a node indexes its pairs for its own
  level and for that of the smallest partner that it may have: about as many pairs as tokens, whatever its length.

Classes are counted exactly. A chunk of documents sends each of its distinct tokens once to the token's part of the hash
space, packed many to a row, with the number of its nodes that hold it; the part adds up and answers with the tokens
that several nodes hold. So a token of a third of all documents costs one entry a chunk. Any rule that gives a token
one class everywhere leaves the join exact: copies in other chunks may make a lone token a rare one, no more.

Each indexed key refers its nodes to one of them, its pivot, and at first each node is checked against the pivot with
which it shares most keys: no more candidates than nodes. The sizes and the numbers of lone tokens of two nodes bound
their overlap, bit signatures do so more closely; what is left is verified on all shared tokens.
Nodes of one component need no more checks. Keys that still hold several components get other pivots for some rounds;
of those left then, the members outside a key's largest component are compared to its other members, packed into
blocks, so that no key is one task and only pairs that signatures don't rule out become rows. Near copies by the million
that don't link with each other although they share keys cost a comparison of signatures for each pair of them: lossless
pruning by sizes, lone tokens and components is all that helps there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, documents, hashed_words, mix, release, set_hash, shingles
from .pretokens import forget_words

#: Tokens of a chunk, and tokens sent to a part of the hash space, about; documents of a chunk at most.
CHUNK, PART, MOST_DOCUMENTS = 1_000_000, 1_500_000, 60_000
#: Tokens of a packed row (12 bytes each, below half a region of the JVM's heap) and documents of one.
ROW, DOCUMENTS = 32_000, 8_000
#: Bytes that go between the JVM and Python at once, of a row group, and of texts hashed at once, about.
BATCH, GROUP, SLICE = 1 << 20, 4 << 20, 400_000
#: A token of more nodes is frequent.
RARE = 32
#: Rounds of further pivots before what is left is compared across components: nodes of a key pair by pair, or in blocks.
PIVOT_ROUNDS, SHORT, BLOCK = 1, 32, 512
#: Bits of a signature for each token, and bits of a signature at most.
SPARSE, MOST_BITS = 8, 4096
#: The holder of a token that several nodes of a chunk hold.
SEVERAL = 0xFFFF

PACKED = "kind string, part long, chunk long, ids array<long>, sizes array<long>, nodes array<long>, tokens binary, holders binary, counts binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
SCHEMA = pa.schema(list(zip(NAMES, TYPES, strict=True)))


def packed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH bytes of tokens and holders, each built when it is asked for."""
    start, held = 0, 0
    for k, r in enumerate(rows):
        held += len(r.get("tokens") or b"") * 3 // 2
        if held >= BATCH or k == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows[start : k + 1]], t) for n, t in zip(NAMES, TYPES, strict=True)], NAMES)
            start, held = k + 1, 0


def cut(n: int, most: int) -> list[slice]:
    """Slices of at most ``most`` of n places."""
    return [slice(k, min(n, k + most)) for k in range(0, n, most)]


def chunk_of(chunk: int, parts: int, ids: list, sizes: list[int], nodes: list[int | None], sets: list[np.ndarray], own: list[int]) -> list[dict]:
    """The rows of one chunk. docs: its documents; own: its nodes, and the tokens that several of them hold; sent: each distinct token. Empties ``sets``."""
    out = [{"kind": "docs", "part": -1 - chunk, "chunk": chunk, "ids": ids[c], "sizes": sizes[c], "nodes": nodes[c]} for c in cut(len(ids), DOCUMENTS)]
    if sets:
        lengths = np.array([len(x) for x in sets], np.int64)
        tokens, holder = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
        order = np.argsort(tokens, kind="stable")
        tokens, holder = tokens[order], holder[order]
        sets.clear()
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        counts = np.diff(np.append(first, len(tokens)))
        several = np.repeat(counts > 1, counts)
        out.append({"kind": "own", "part": -1 - chunk, "chunk": chunk, "sizes": lengths.tolist(), "nodes": own})
        several = np.flatnonzero(several)
        out += [{"kind": "own", "part": -1 - chunk, "chunk": chunk, "tokens": tokens[several[c]].tobytes(), "holders": holder[several[c]].tobytes()} for c in cut(len(several), ROW)]
        holder = np.where(counts > 1, SEVERAL, holder[first]).astype(np.uint16)
        tokens, counts = tokens[first], counts.astype(np.uint16)
        # By holder within each part, so that holders compress well as steps from one to the next.
        part = part_of(tokens, parts)
        order = np.argsort(part << 16 | holder, kind="stable")
        tokens, holder, counts, part = tokens[order], holder[order], counts[order], part[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        steps = lambda x: np.diff(x, prepend=np.uint16(0))
        rows = [slice(a + c.start, a + c.stop) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for c in cut(b - a, ROW)]
        out += [{"kind": "sent", "part": int(part[c.start]), "chunk": chunk, "tokens": tokens[c].tobytes(), "holders": steps(holder[c]).tobytes(), "counts": counts[c].tobytes()} for c in rows]
    return out


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space, ascending with the token."""
    return ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def chunks(n: int, parts: int):
    """mapInArrow: documents (doc_id, text) -> PACKED, chunk by chunk; copies of a set are one node of a chunk."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_words()
        chunk = TaskContext.get().partitionId() << 32
        ids, sizes, nodes, sets, own, size, known = [], [], [], [], [], 0, set()
        for batch in rows:
            batch_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for start, _, words, offsets in hashed_words(batch.column("text"), SLICE):
                for k, tokens in enumerate(shingles(words, offsets, n)):
                    node = set_hash(tokens) if len(tokens) else None
                    ids.append(batch_ids[start + k])
                    sizes.append(len(tokens))
                    nodes.append(node)
                    if node is not None and node not in known:
                        known.add(node)
                        own.append(node)
                        sets.append(tokens)
                        size += len(tokens)
                    if size >= CHUNK or len(ids) >= MOST_DOCUMENTS:
                        yield from packed(chunk_of(chunk, parts, ids, sizes, nodes, sets, own))
                        ids, sizes, nodes, sets, own, size, known = [], [], [], [], [], 0, set()
                        chunk += 1
                        release()
        if ids:
            yield from packed(chunk_of(chunk, parts, ids, sizes, nodes, sets, own))
            ids, sizes, nodes, sets, own, known = [], [], [], [], [], set()
        release()

    return run


def add_up(table: pa.Table) -> pa.Table:
    """Of the tokens sent to a part: those that several nodes hold, for each chunk that holds them. Other rows pass."""
    if table.column("kind")[0].as_py() != "sent":
        return table
    sent = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("counts")])
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in sent])))
    held = totals(np.concatenate(sent), counts)
    out = []
    for k, (chunk, holders) in enumerate(zip(table.column("chunk").to_pylist(), table.column("holders"), strict=True)):
        own = held[cuts[k] : cuts[k + 1]]
        keep = own > 1
        if keep.any():
            out.append({"kind": "shared", "chunk": chunk, "tokens": sent[k][keep].tobytes(), "holders": np.cumsum(np.frombuffer(holders.as_buffer(), np.uint16), dtype=np.uint16)[keep].tobytes(), "counts": own[keep].tobytes()})
    out = pa.Table.from_batches(packed(out), SCHEMA)
    release()
    return out


def totals(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place the sum of the counts of its token, 0xFFFF at most."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    del ordered
    total = np.minimum(np.add.reduceat(counts[order], first, dtype=np.int64), 0xFFFF).astype(np.uint16)
    held = np.empty(len(tokens), np.uint16)
    held[order] = np.repeat(total, np.diff(np.append(first, len(tokens))))
    return held


def signature(tokens: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of bits that is at least SPARSE times the tokens, 64 to MOST_BITS."""
    width = min(MOST_BITS, 1 << max(6, (SPARSE * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures, a row each, in fewer words: a bit is set if one of those that it stands for is."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def most_common_tokens(x: bytes, y: bytes, m: int, n: int) -> int:
    """An upper bound of the overlap of two sets of m and n tokens from their signatures."""
    words = min(len(x), len(y)) // 8
    p, q = (folded(np.frombuffer(z, np.uint64)[None], words) for z in (x, y))
    hidden = min(m - int(np.bitwise_count(p).sum()), n - int(np.bitwise_count(q).sum()))
    return int(np.bitwise_count(p & q).sum()) + hidden


def smallest(n: int, percent: int) -> int:
    """The least overlap, and the least size of a partner, of a set of n tokens."""
    return -(-percent * n // 100)


def only_equal(n: int, percent: int) -> bool:
    """Whether a set of n tokens has no partners but equal ones: one more token is too many."""
    return 100 * n < percent * (n + 1)


def keys_of(rare: np.ndarray, frequent: np.ndarray, n: int, lone: int, percent: int) -> np.ndarray:
    """The index keys of a set of n tokens: lone ones, rare and frequent ones (each in ascending order)."""
    need = n - smallest(n, percent) + 1 - lone
    rare = rare[: max(0, need)]
    out = [mix(rare)]
    if (need := need - len(rare)) > 0:
        for level in sorted({n.bit_length() - 1, max(1, smallest(n, percent)).bit_length() - 1}):
            blocks = frequent >> np.uint64(64 - max(0, level - 2)) if level > 2 else np.zeros(len(frequent), np.uint64)
            same = np.zeros(len(frequent), np.int64)
            same[1:] = blocks[1:] == blocks[:-1]
            at = int(np.searchsorted(np.cumsum(same), need)) + 1
            if at > len(frequent):  # a small set, of which a partner may share no pair
                out.append(mix(frequent))
            prefix, blocks = frequent[:at], blocks[:at]
            ends = np.flatnonzero(np.concatenate((blocks[1:] != blocks[:-1], [True]))) + 1 if len(prefix) else np.zeros(0, np.int64)
            first = 0
            for end in ends.tolist():
                i, j = np.triu_indices(end - first, 1)
                own = prefix[first:end]
                out.append(mix(own[i] * np.uint64(3) + mix(own[j] + np.uint64(level))))
                first = end
    return np.unique(np.concatenate(out))


SETS = "node long, n long, lone long, rare long, tokens binary, bits binary"


def sets_of(percent: int):
    """Grouped map: a chunk's own and shared rows -> SETS, the nodes of it that may have a partner.

    tokens: the shared ones, rare ones first, both kinds in ascending order; bits: their signature.
    """

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table.column("kind"), "own"))
        shared = table.filter(pc.equal(table.column("kind"), "shared"))
        read = lambda t, c, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in t.column(c) if x.is_valid]])
        named = own.filter(pc.is_valid(own.column("nodes")))
        sizes, nodes = np.array(named.column("sizes")[0].as_py(), np.int64), named.column("nodes")[0].as_py()
        tokens, holders, counts = read(shared, "tokens", np.uint64), read(shared, "holders", np.uint16), read(shared, "counts", np.uint16)
        # Tokens of several nodes of the chunk: for each of these nodes.
        several = holders == SEVERAL
        order = np.argsort(tokens[several], kind="stable")
        known, their = tokens[several][order], counts[several][order]
        more, holding = read(own, "tokens", np.uint64), read(own, "holders", np.uint16)
        at = np.searchsorted(known, more)
        tokens, holders, counts = np.concatenate((tokens[~several], more)), np.concatenate((holders[~several], holding)), np.concatenate((counts[~several], their[at]))
        order = np.lexsort((tokens, counts > RARE, holders))
        tokens, holders, rare = tokens[order], holders[order].astype(np.int64), counts[order] <= RARE
        held = np.bincount(holders, minlength=len(sizes))
        few = np.bincount(holders[rare], minlength=len(sizes))
        ends = np.cumsum(held)
        chosen = [k for k in np.flatnonzero((100 * held >= percent * sizes) & (held > 0)).tolist() if not only_equal(int(sizes[k]), percent)]
        each = [tokens[ends[k] - held[k] : ends[k]] for k in chosen]
        return pa.table([
            pa.array([nodes[k] for k in chosen], pa.int64()), pa.array(sizes[chosen], pa.int64()), pa.array((sizes - held)[chosen], pa.int64()), pa.array(few[chosen], pa.int64()),
            pa.array([x.tobytes() for x in each], pa.binary()), pa.array([signature(x) for x in each], pa.binary()),
        ], names=[x.split()[0] for x in SETS.split(", ")])

    return run


def index_keys(percent: int):
    """mapInArrow: (key, node, n, lone) of SETS without bits."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for tokens, n, lone, rare in zip(batch.column("tokens"), *(batch.column(c).to_pylist() for c in ("n", "lone", "rare")), strict=True):
                own = np.frombuffer(tokens.as_buffer(), np.uint64)
                found.append(keys_of(own[:rare], own[rare:], n, lone, percent))
            times = np.array([len(x) for x in found], np.int64)
            for a in range(0, len(found), 500):
                part = slice(a, a + 500)
                rest = [pa.array(np.repeat(batch.column(c).to_numpy()[part], times[part])) for c in ("node", "n", "lone")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[part]).view(np.int64)), *rest], ["key", "node", "n", "lone"])

    return run


def may_link(percent: int):
    """mapInArrow: those of the pairs (a, b) that their signatures (x, y), sizes (m, n) and lone tokens (p, q) don't rule out."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y, m, n, p, q in zip(*(batch.column(c) for c in ("x", "y")), *(batch.column(c).to_pylist() for c in ("m", "n", "p", "q")), strict=True):
                most = min(m - p, n - q, most_common_tokens(x.as_buffer(), y.as_buffer(), m - p, n - q))
                keep.append(100 * most >= percent * (m + n - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def block_pairs(percent: int):
    """mapInArrow: the pairs (a, b) of nodes of two blocks (x, y) that are in different components and may link."""

    def by_width(block: pa.StructScalar) -> Iterator[tuple]:
        """(node, n, shared tokens, root, bits as a matrix of 64-bit words) of the members with signatures of one width."""
        rows = block.values
        node, n, lone, root = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "lone", "root"))
        bits = [x.as_buffer() for x in rows.field("bits")]
        width = np.array([x.size for x in bits])
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            yield node[own], n[own], (n - lone)[own], root[own], np.frombuffer(b"".join(bits[k] for k in own.tolist()), np.uint64).reshape(len(own), -1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found_a, found_b = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                for node, n, held, root, bits in by_width(x):
                    for node2, n2, held2, root2, bits2 in by_width(y):
                        words = min(bits.shape[1], bits2.shape[1])
                        p, q = folded(bits, words), folded(bits2, words)
                        hidden, hidden2 = held - np.bitwise_count(p).sum(1), held2 - np.bitwise_count(q).sum(1)
                        step = max(1, 500_000 // (len(node) * words))
                        for k in range(0, len(node2), step):
                            own = slice(k, k + step)
                            most = np.bitwise_count(p[None] & q[own, None]).sum(2, dtype=np.int64) + np.minimum(hidden[None], hidden2[own, None])
                            most = np.minimum(most, np.minimum(held[None], held2[own, None]))
                            j, i = np.nonzero((100 * most >= percent * (n[None] + n2[own, None] - most)) & (root[None] != root2[own, None]))
                            found_a.append(np.maximum(node[i], node2[own][j]))
                            found_b.append(np.minimum(node[i], node2[own][j]))
            if found_a:
                both = np.unique(np.column_stack((np.concatenate(found_a), np.concatenate(found_b))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return run


def do_link(percent: int):
    """mapInArrow: those of the pairs (a, b) that link, from their shared tokens (x, y) and sizes (m, n)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y, m, n in zip(batch.column("x"), batch.column("y"), *(batch.column(c).to_pylist() for c in ("m", "n")), strict=True):
                own = np.sort(np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))))
                both = int((own[1:] == own[:-1]).sum())
                keep.append(100 * both >= percent * (m + n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def bound(percent: int, m: str, p: str, n: str, q: str) -> str:
    """SQL: sets of m and n tokens, p and q of them lone, may link."""
    most = f"least({m} - {p}, {n} - {q})"
    return f"100 * {most} >= {percent} * ({m} + {n} - {most})"


def ngram_jaccard_join(docs: DataFrame, ngram: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, node): all links of documents with 100 * |A and B| >= percent * |A or B|.

    component_id is the least doc_id that links reach. A null or empty text, or one of white space, has no shingles
    and links with nothing; a text of fewer than ``ngram`` words is one shingle of all its words. Equal sets link.
    Repeated rows (the same doc_id again) come out as often as they came in; rows with a null doc_id link as others do
    and take the least doc_id of their component, null if it has none. Other columns are ignored. An empty table gives
    an empty result. ``percent`` is 50 to 100. Node identities are 64-bit hashes of sets of 64-bit hashes. One text is
    handled whole: about 100 bytes a word.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark, texts = docs.sparkSession, documents(docs)
    scratch = Scratch(spark, "ngram-join", batch=BATCH, group=GROUP)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // 6 // PART)  # words of some six bytes
    first = texts.mapInArrow(chunks(ngram, parts), PACKED).groupBy("part").applyInArrow(add_up, PACKED)
    first = scratch.table(first, "first")
    rows = first.where("kind = 'docs'").select(F.explode(F.arrays_zip("ids", "sizes", "nodes")).alias("d"))
    nodes = scratch.table(rows.select(F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n"), F.col("d.nodes").alias("node")), "nodes")
    sets = first.where("kind in ('own', 'shared')").groupBy("chunk").applyInArrow(sets_of(percent), SETS)
    # A set in several chunks stands in all of them; its classes are the same everywhere.
    sets = scratch.table(sets.dropDuplicates(["node"]), "sets")
    scratch.drop("first")
    alone = nodes.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node")
    least = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = _roots(scratch, sets, percent)
    if roots is None:
        named = least.select("node", F.col("least").alias("component_id"))
    else:
        # The least doc_id of each component, then of each document by its node.
        lowest = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = lowest.join(lowest.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return alone.drop("component_id").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def _roots(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of the nodes that have links, null if none has."""
    keys = sets.select("node", "n", "lone", "rare", "tokens").mapInArrow(index_keys(percent), "key long, node long, n long, lone long")
    keys = scratch.table(keys, "all-keys")
    # A key of one node links nothing. The pivot of a key is its node with most shared keys: of a group of copies, the
    # one that has least of its own.
    several = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    shared = scratch.table(keys.join(several, "key"), "keys")
    scratch.drop("all-keys")
    degrees = shared.groupBy("node").agg(F.count("*").alias("degree"))
    pivots = shared.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n", "lone")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.lone").alias("pivot_lone"))

    # At first each node is checked against the pivot with which it shares most keys.
    paired = shared.join(pivots, "key").where("node <> pivot").where(bound(percent, "n", "lone", "pivot_n", "pivot_lone"))
    often = paired.groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = often.groupBy("node").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
    links = _verified(scratch, sets, _likely(sets, best, percent), percent, "0")
    roots = components(scratch, links, "roots-0")
    for k in range(1, PIVOT_ROUNDS + 2):
        # Only keys whose nodes are in several components can still give a new connection.
        labelled = shared.select("key", "node", "n", "lone").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = labelled.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
        shared = scratch.table(labelled.join(open_keys, "key"), f"open-{k}")
        scratch.drop(f"open-{k - 1}" if k > 1 else "keys")
        if scratch.empty(shared):
            break
        if k <= PIVOT_ROUNDS:
            # Another pivot for each key: the least by a hash that changes with the round.
            own = F.struct(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("lone").alias("pivot_lone"), F.col("root").alias("own"))
            other = shared.groupBy("key").agg(F.min_by(own, F.xxhash64(F.lit(k), "node")).alias("p")).select("key", "p.*")
            pairs = shared.join(other, "key").where("root <> own").where(bound(percent, "n", "lone", "pivot_n", "pivot_lone"))
            likely = _likely(sets, pairs.select("node", "pivot").distinct(), percent)
        else:
            likely = _likely_of_all(sets, shared, percent)
        links = links.union(_verified(scratch, sets, likely, percent, str(k)))
        roots = components(scratch, links, f"roots-{k}")
    return None if scratch.empty(roots) else roots


def _likely(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (node, pivot) that their signatures don't rule out."""
    known = sets.select("node", "n", "lone", "bits")
    both = pairs.toDF("a", "b").join(known.toDF("a", "m", "p", "x"), "a").join(known.toDF("b", "n", "q", "y"), "b")
    return both.mapInArrow(may_link(percent), "a long, b long")


def _likely_of_all(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes that share a key, in different components, which their signatures don't rule out.

    The members of a key of more than SHORT are packed into blocks of about BLOCK. Those outside its largest component
    are compared to all, block by block, so a key of any size is dealt over many tasks, and only likely pairs become rows.
    """
    # A node that the least size among a key's nodes is too much for has no partner there: see ``bound``.
    smallest_there = members.groupBy("key").agg(F.min("n").alias("least_n"))
    members = members.join(smallest_there, "key").where(f"100 * (n - lone) >= {percent} * (least_n + lone)").drop("least_n")
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    rows = members.join(sizes, "key")
    short, long_keys = rows.where(F.col("m") <= SHORT), rows.where(F.col("m") > SHORT)
    other = short.where("root <> main").select("key", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("lone").alias("pivot_lone"), F.col("root").alias("own"))
    pairs = short.join(other, "key").where("root <> own").where(bound(percent, "n", "lone", "pivot_n", "pivot_lone"))
    pairs = pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    packed_rows = long_keys.join(sets.select("node", "bits"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)))
    members_of = F.collect_list(F.struct("node", "n", "lone", "root", "bits"))
    blocks = packed_rows.groupBy("key", "block").agg(members_of.alias("x"))
    minor = packed_rows.where("root <> main").groupBy("key", F.col("block").alias("minor_block")).agg(members_of.alias("y"))
    compared = blocks.join(minor, "key").select("x", "y").mapInArrow(block_pairs(percent), "a long, b long")
    return _likely(sets, pairs, percent).union(compared.distinct())


def _verified(scratch: Scratch, sets: DataFrame, likely: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the node pairs (a, b) that link, as a table."""
    likely = scratch.table(likely, f"likely-{name}")
    own = sets.select("node", "n", "tokens")
    links = likely.join(own.toDF("a", "m", "x"), "a").join(own.toDF("b", "n", "y"), "b").mapInArrow(do_link(percent), "a long, b long")
    links = scratch.table(links, f"links-{name}")
    scratch.drop(f"likely-{name}")
    return links


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


def oracle_sql(ngram: int = 5, percent: int = 75) -> str:
    """DuckDB SQL for the rows of the query: all pairs that share a shingle, for small tables."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingle = " || chr(10) || ".join(f"w[i + {k}]" for k in range(ngram))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {ngram - 2})) AS i FROM d WHERE len(w) >= {ngram}) UNION ALL SELECT DISTINCT doc_id, array_to_string(w, chr(10)) FROM d WHERE len(w) BETWEEN 1 AND {ngram - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= {percent} * (m.n + o.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT x, b FROM reach JOIN e ON a = y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""
