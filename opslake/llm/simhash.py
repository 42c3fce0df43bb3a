"""Near-duplicates by SimHash and generalised pigeonhole search.

A fingerprint has 64 bits: bit b is 1 if bit b is set in over half the hashes of the text's word shingles. Texts whose
fingerprints differ in at most ``distance`` bits are linked, and linked texts form components.

Search (over distinct fingerprints, so copies cost nothing): bits that go together are grouped into 2 to 4
partitions. If partition i may differ in t_i bits and the t_i sum to distance - partitions + 1, any two linked
fingerprints agree up to t_i bits in some partition (t_i = -1: the partition is not probed). A dynamic program allots
the t_i by the candidate pairs that each would make, estimated from exact counts over all fingerprints, and the
cheapest number of partitions is taken. Each fingerprint is probed under its partition's value with every choice of
t_i bits masked; groups under one key are verified by exact bit counts. A group keeps a spanning forest of its links,
never all pairs; a group over ``group_limit`` rows is split by further bits (rows that may link agree in one of
``distance`` + 1 sets of bits), and only where that leaves over ``group_limit`` rows are chunks of it compared pairwise in
separate tasks.

Cases: null texts count as empty; texts without words have fingerprint zero and link like any other; repeated rows
and ids are fine (the smallest non-null id names a component); an empty table gives an empty result. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, join_keyed, pieces, remove_tables, shuffle_partitions, written

SHINGLE = 3
SEED = 42
GROUP_LIMIT = 8192
# The multipliers of XXH64.
PRIMES = tuple(map(np.uint64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)))
ROW_COST = 40  # shuffling one probe costs as much as verifying so many pairs


def hash_ranges(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of raw[start:end] for each range. Ranges under 32 bytes, nearly all shingles, are hashed together, those of
    equally many eight-byte lanes at a time; longer ones by the library."""
    import xxhash

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    size = end - start
    out = np.empty(len(start), np.uint64)
    padded = raw + bytes(8)
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(raw) + 1, "<u4", padded, strides=(1,))
    one = np.frombuffer(padded, np.uint8)
    p1, p2, p3, p4, p5 = PRIMES
    for lanes in range(4):
        which = np.flatnonzero(size >> 3 == lanes)
        n, at = size[which], start[which]
        h = n.astype(np.uint64) + np.uint64((seed + int(p5)) & (1 << 64) - 1)
        for k in range(lanes):
            h = turned(h ^ turned(eight[at + 8 * k] * p2, 31) * p1, 27) * p1 + p4
        at = at + 8 * lanes
        some = np.flatnonzero(n & 4)
        h[some] = turned(h[some] ^ four[at[some]].astype(np.uint64) * p1, 23) * p2 + p3
        at[some] += 4
        for k in range(3):
            some = np.flatnonzero((n & 3) > k)
            h[some] = turned(h[some] ^ one[at[some] + k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[which] = h ^ (h >> np.uint64(32))
    long = np.flatnonzero(size >= 32)
    out[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def bit_sums(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit, [texts, 64]; counts (none is 0) are the texts' numbers of hashes. A sum
    of up to 255 hashes fits into the eight bytes of a word that each hold one bit of every byte."""
    chunks = -(-counts // 255)
    first = np.cumsum(chunks) - chunks
    inside = np.arange(chunks.sum()) - np.repeat(first, chunks)
    at = np.repeat(np.cumsum(counts) - counts, chunks) + 255 * inside
    sums = np.empty((len(at), 8, 8), np.uint8)
    for bit in range(8):
        sums[:, :, bit] = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), at).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(sums.reshape(-1, 64), first, axis=0, dtype=np.int64)


def _fingerprints(words: Words, shingle: int) -> np.ndarray:
    """uint64 per text; sums of hash bits are taken over all texts of the piece at once."""
    n = len(words.first) - 1
    out = np.zeros(n, np.uint64)
    sizes = np.diff(words.first)
    raw = b" ".join(words.raw.split())  # words keep their order; one space between them
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    counts = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    begin = np.repeat(words.first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(begin + shingle, np.repeat(words.first[1:], counts)) - 1
    full = np.flatnonzero(counts)
    if len(full):
        h = hash_ranges(raw, start[begin], end[last])
        sums = bit_sums(h, counts[full])
        ones = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, content (a hash of the text), fp (the fingerprint's bits as a signed long) per row."""

    def hashed(batches):
        for batch in pieces(batches, limit=1 << 20):
            fp = _fingerprints(Words(batch.column("text"), lower_ascii=True), shingle)
            yield pa.record_batch([batch.column("doc_id"), batch.column("content"), pa.array(fp.view(np.int64))], ["doc_id", "content", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.col("text").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, content long, fp long")


def group_bits(agree: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of like size: each group starts at the free bit that is most correlated with the free bits
    and takes the bit most correlated with its members until it is full."""
    free, groups = set(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, groups))) // (m - i)
        members = [max(sorted(free), key=lambda b: agree[b, sorted(free - {b})].sum())]
        free.remove(members[0])
        while len(members) < size:
            members.append(max(sorted(free), key=lambda b: agree[b, members].sum()))
            free.remove(members[-1])
        groups.append(sorted(members))
    return groups


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of at least -1 that sum to total with the least cost; costs[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                if (v := c + row[t + 1]) < nxt.get(s + t, (float("inf"),))[0]:
                    nxt[s + t] = (v, [*ts, t])
        best = nxt
    return best[total]


def extract(fp, bits: list[int]):
    """Column with the bits of fp at the given places, packed."""
    out = F.lit(0).cast("long")
    for j, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), j))
    return out


def plan_partitions(nodes: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, from counts over all distinct fingerprints."""

    def sums(batches):
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 16):
                x = np.unpackbits(fp[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
                n += len(x)
        if n:
            yield pa.record_batch([pa.array(np.append(np.arange(4096), -1)), pa.array(np.append(total.ravel(), n))], ["k", "n"])

    rows = nodes.select("fp").mapInArrow(sums, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    both = {r["k"]: r["n"] for r in rows}
    n = both.get(-1, 0)
    if n < 2:
        return [(list(range(64)), 0)]  # nothing to link: one probe will do
    joint = np.array([both[k] for k in range(4096)], float).reshape(64, 64) / n
    p = np.diag(joint)
    agree = np.abs(joint - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)) + 1e-9)
    differ = 2 * p * (1 - p)
    plans = {m: group_bits(agree, m) for m in range(2, distance + 2)}
    keyed = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), extract(F.col("fp"), bits).alias("v")) for m, groups in plans.items() for i, bits in enumerate(groups)]
    counts = nodes.select(F.explode(F.array(*keyed)).alias("x")).groupBy("x.m", "x.i", "x.v").count()
    same = {(r["m"], r["i"]): r["pairs"] for r in counts.groupBy("m", "i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    options = []
    for m, groups in plans.items():
        costs = []
        for i, bits in enumerate(groups):
            within = np.zeros(distance + 2)  # chance of 0.. differing bits, were bits independent
            within[0] = 1
            for q in differ[bits]:
                within[1:] = within[1:] * (1 - q) + within[:-1] * q
                within[0] *= 1 - q
            row = [0.0]
            for t in range(distance - m + 2 + (m - 1)):
                growth = min(within[: t + 1].sum() / max(within[0], 1e-12), 1 / max(within[0], 1e-12))
                probes = comb(len(bits), t)
                row.append(same[m, i] * growth * max(1, comb(len(bits), t)) ** 0.5 + ROW_COST * n * probes)
            costs.append(row)
        cost, thresholds = allot(costs, distance - m + 1)
        options.append((cost, m, [(b, t) for b, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of one group. Rows not yet reached are compared with each reached row once."""
    left = np.arange(len(fp))
    out = []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                got = left[near]
                out += [(at, g) for g in got.tolist()]
                stack += got.tolist()
                left = left[~near]
    return out


def links(nodes: DataFrame, distance: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """u, v: links (u < v) that connect what is within ``distance`` bits; a spanning set, each pair verified."""
    spark = nodes.sparkSession
    keys = []
    for number, (bits, t) in enumerate(plan_partitions(nodes, distance)):
        for j, masked in enumerate(combinations(bits, t)):
            keys.append(F.struct(F.lit(number * 100_000 + j).alias("part"), extract(F.col("fp"), [b for b in bits if b not in masked]).alias("value")))
    probes = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.part", "key.value")
    # groups over the limit: rows that differ in at most `distance` bits agree in one of distance + 1 sets of bits, so such
    # a group is split by each set; what is then still over the limit is compared chunk with chunk
    count = lambda rows: rows.groupBy("part", "value", "sub", "rest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
    probes = probes.withColumn("sub", F.lit(-1)).withColumn("rest", F.lit(0).cast("long"))
    large = count(probes).select("part", "value", F.lit(True).alias("large"))
    parts = [F.struct(F.lit(j).alias("sub"), extract(F.col("fp"), list(range(j, 64, distance + 1))).alias("rest")) for j in range(distance + 1)]
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))
    probes = probes.drop("sub", "rest").join(large, ["part", "value"], "left").select("fp", "part", "value", F.explode(F.when(F.col("large"), F.array(*parts)).otherwise(whole)).alias("s")).select("fp", "part", "value", "s.sub", "s.rest")
    still = count(probes.where("sub >= 0")).withColumn("chunks", F.ceil(F.col("n") / group_limit).cast("int")).drop("n")
    probes = probes.join(still, ["part", "value", "sub", "rest"], "left")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, chunk) * F.col("chunks") + F.greatest(c, chunk)))
    probes = probes.select("fp", "part", "value", F.explode(cells).alias("cell"), (F.col("sub") + 1).alias("sub"), "rest")
    dealt = probes.repartition(shuffle_partitions(spark), "part", "value", "sub", "rest", "cell").sortWithinPartitions("part", "value", "sub", "rest", "cell")

    def verified(batches):
        tail = [np.zeros(0, np.int64)] * 6
        for batch in _with_end(batches):
            columns = tail if batch is None else [np.concatenate([t, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for t, c in zip(tail, ("fp", "part", "value", "sub", "rest", "cell"))]
            n = len(columns[0])
            if not n:
                continue
            cut = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[1:]], axis=0), [True]]))
            if batch is not None:  # the last group may go on in the next batch
                tail = [c[cut[-2] :] for c in columns]
                cut = cut[:-1]
            fp = columns[0].view(np.uint64)
            size = np.diff(cut)
            u, v = [], []
            group = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= 16, size)
            for lag in range(1, min(16, int(size.max(initial=0)))):
                a = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
                a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= distance]
                u.append(fp[a])
                v.append(fp[a + lag])
            for g in np.flatnonzero(size > 16):
                rows = fp[cut[g] : cut[g + 1]]
                pairs = np.array(forest(rows, distance), np.int64).reshape(-1, 2)
                u.append(rows[pairs[:, 0]])
                v.append(rows[pairs[:, 1]])
            if u and len(a := np.concatenate(u)):
                a, b = a.view(np.int64), np.concatenate(v).view(np.int64)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    return dealt.mapInArrow(verified, "u long, v long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with a link: the smallest node that is reachable. Alternates stars over the larger and
    over the smaller neighbours (a logarithmic number of rounds); each round is a table in the shared folder."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        remove_tables(old)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _grouped(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and the group's root of each distinct fingerprint."""
    prints = written(fingerprints(docs, shingle))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes, distance))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "first", "n", F.coalesce("root", "fp").alias("root"))
    return prints, placed


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) per row of docs."""
    prints, placed = _grouped(docs, shingle, distance)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(placed.join(named, "root").select("fp", "n", "component_id"))
    return join_keyed(prints, names, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, distance: int = 3) -> DataFrame:
    """The rows of docs, all columns, of which one of each group stays: the one with the smallest id (of equal ids the
    one with the smaller hash of its text; rows without an id only where their group has no id)."""
    prints, placed = _grouped(docs, shingle, distance)
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.content").alias("_content"))
    rows = docs.withColumn("_row_content", F.xxhash64("text"))
    out = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_row_content") == F.col("_content")), "left_semi")
    if not prints.groupBy("doc_id", "content").count().where("count > 1").isEmpty():  # repeated rows
        out = out.dropDuplicates(["doc_id", "_row_content"])
    return out.drop("_row_content")
