"""SimHash near-duplicates: generalised pigeonhole over groups of correlated bits.

A text's fingerprint has a bit where more than half of the XXH64 (seed 42) of its 4-word shingles have it.
Fingerprints link if at most ``RADIUS`` bits differ; a class is what links reach.

How it runs:
1. Fingerprints in one pass; equal ones collapse to one node, so copies cost nothing later.
2. Over all nodes: 64 x 64 counts of bits set together.  Bits of high correlation go to the same one of m
   groups; m is that of least expected cost.  A second pass counts the values of each group (at most
   2^16 counts a chunk of it, whatever the table's size).
3. Generalised pigeonhole: give group i a threshold t_i >= -1 so that the (t_i + 1) add up to RADIUS + 1;
   then two fingerprints within RADIUS are within t_i in some group i.  Each node gets its own
   thresholds: dynamic programming over the groups on the number of nodes that each threshold would make
   it meet (from the counts of step 2) and the number of keys that it would have to probe.  A group whose
   value is common gets -1 and is not probed.
4. Stars: in each bucket (group, value) all nodes are held against one of them, twice, in plain joins.
   Their components swallow groups of near copies, so what follows costs by what is left between
   components and not by the square of a group.
5. Probe and verify: every node is in the index under its m values.  The nodes of all components but
   the largest probe the keys within their thresholds; a pair counts if the probing side's component is the
   smaller one.  Keys with many rows are dealt to units of at most ``UNIT`` rows a side.  Links leave a unit
   as a forest over components.
6. The components of these are the classes.

No cap on buckets, candidates or partners: every link between different components is verified.

Defined results: a null text, or one without a word, has fingerprint zero, which links like any other;
fewer than four words are one shingle; component_id is the smallest doc_id of the class (null if all are
null); rows that repeat a document are documents of their own; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches, settings
from tempest.llm.components import components
from tempest.llm.text import whole
from tempest.session import materialise, run_folder

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: A probed key costs about as much as this many comparisons.
KEY_COST = 20
#: Values are counted in chunks of at most this many bits of a group.
CHUNK_BITS = 16
UNIT = 1024
STAR_ROUNDS = 2
PAIRS = 1 << 22

LARGE_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16384"}


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # of bytes: A-Z, and the six white space characters
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    votes, step, digest = np.zeros(BITS, np.int64), 1 << 16, xxhash.xxh64_intdigest
    for at in range(0, len(starts), step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + step], ends[at:at + step], strict=True)], np.uint64)
        votes += bits_of(h).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def bits_of(h: np.ndarray) -> np.ndarray:
    """A row of 64 bits per number, lowest first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, fp long")


# ------------------------------------------------------------------ groups of bits and thresholds

def ball(width: int, t: int) -> int:
    """Number of values within ``t`` bits of one of ``width`` bits (none for t = -1)."""
    return sum(comb(width, i) for i in range(t + 1))


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of about equal size: each starts at the free bit of highest correlation to the free
    bits, and takes the free bits of highest correlation to its own."""
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs(np.nan_to_num(cov / np.outer(sd, sd)))
    free, groups = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        groups.append(sorted(group))
    return groups


def allocate(costs: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (nodes x groups) of least total cost whose (t + 1) add up to ``radius + 1``, and that cost.

    ``costs[i][u]``: per node, the cost of threshold u - 1 in group i (0 for u = 0).
    """
    n, spend = costs[0].shape[1], radius + 1
    least = np.full((spend + 1, n), np.inf)
    least[0] = 0
    chosen = []
    for c in costs:
        new, pick = np.full_like(least, np.inf), np.zeros(least.shape, np.int8)
        for u in range(min(len(c), spend + 1)):
            total = least[:spend + 1 - u] + c[u]
            better = total < new[u:]
            new[u:][better], pick[u:][better] = total[better], u
        least = new
        chosen.append(pick)
    out, left, at = np.zeros((n, len(costs)), np.int64), np.full(n, spend), np.arange(n)
    for i in reversed(range(len(costs))):
        out[:, i] = chosen[i][left, at]
        left = left - out[:, i]
    return out - 1, least[spend]


def expected_cost(groups: list[list[int]], share: np.ndarray, n: int) -> float:
    """Least cost of a node against ``n`` others whose bits are set independently."""
    costs = []
    for g in groups:
        differ = np.zeros(RADIUS + 2)
        differ[0] = 1
        for b in g:
            q = 2 * share[b] * (1 - share[b])
            differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
            differ[0] *= 1 - q
        met = np.cumsum(differ)[:RADIUS + 1] * n
        costs.append(np.array([[0.0]] + [[met[t] + KEY_COST * ball(len(g), t)] for t in range(min(RADIUS, len(g)) + 1)]))
    return float(allocate(costs)[1][0])


def spheres(counts: np.ndarray, width: int) -> np.ndarray:
    """Row t, column v: number of nodes at distance t from value v, for t up to ``RADIUS``."""
    out = np.zeros((RADIUS + 1, 1 << width))
    out[0] = counts
    for b in range(width):
        other = np.arange(1 << width) ^ (1 << b)
        for t in range(RADIUS, 0, -1):
            out[t] += out[t - 1][other]
    return out


class Groups:
    """The groups of bits, the counts of their values, and what follows for arrays of fingerprints."""

    def __init__(self, groups: list[list[int]], n: int) -> None:
        self.groups, self.n = groups, n
        self.chunks = []  # (group, its bits)
        for i, g in enumerate(groups):
            pieces = -(-len(g) // CHUNK_BITS)
            self.chunks += [(i, [int(b) for b in part]) for part in np.array_split(g, pieces)]
        self.tables: list[np.ndarray] = []

    @staticmethod
    def pick(bits: np.ndarray, which: list[int]) -> np.ndarray:
        """The values of the chosen bits, the first one lowest."""
        return bits[:, which].astype(np.int64) @ (1 << np.arange(len(which), dtype=np.int64))

    def set_counts(self, counts: list[np.ndarray]) -> None:
        self.tables = [spheres(c, len(bits)) for c, (_, bits) in zip(counts, self.chunks, strict=True)]

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """Nodes x groups: the thresholds of least cost.  The chunks of one group count as independent."""
        costs = []
        for i, g in enumerate(self.groups):
            met = None
            for (of, which), table in zip(self.chunks, self.tables, strict=True):
                if of == i:
                    here = table[:, self.pick(bits, which)]
                    met = here if met is None else np.array(
                        [sum(met[a] * here[t - a] for a in range(t + 1)) / self.n for t in range(RADIUS + 1)])
            met = np.cumsum(met, axis=0)
            costs.append(np.stack([np.zeros(len(bits))] + [met[t] + KEY_COST * ball(len(g), t) for t in range(min(RADIUS, len(g)) + 1)]))
        return allocate(costs)[0]

    def key(self, group: int, values: np.ndarray) -> np.ndarray:
        return values * len(self.groups) + group

    def within(self, group: int, t: int) -> np.ndarray:
        """Masks of at most ``t`` bits of the group."""
        width, out, last = len(self.groups[group]), [0], [(0, -1)]
        for _ in range(t):
            last = [(mask | 1 << b, b) for mask, top in last for b in range(top + 1, width)]
            out += [mask for mask, _ in last]
        return np.array(out, np.int64)


def _sums(node: DataFrame, count, schema: str):
    """Table of (keys, total): what ``count`` makes of the bits of a batch, added up per key in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                arrays = count(bits_of(b.column("fp").to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [c.split()[0] for c in schema.split(", ")])

    keys = [c.split()[0] for c in schema.split(", ")][:-1]
    return node.select("fp").mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n")).toPandas()


def plan(node: DataFrame, n: int) -> Groups:
    """Groups of bits, with the counts of their values, from all nodes."""
    def pairs(bits: np.ndarray):
        x = bits.astype(np.float32)
        return np.arange(BITS * BITS), (x.T @ x).ravel().astype(np.int64)

    found = _sums(node, pairs, "at long, n long")  # 4,096 rows
    together = np.zeros(BITS * BITS)
    together[found["at"]] = found["n"]
    together = together.reshape(BITS, BITS)
    options = [group_bits(together, n, m) for m in range(2, RADIUS + 2)]
    g = Groups(min(options, key=lambda o: expected_cost(o, np.diag(together) / n, n)), n)

    def values(bits: np.ndarray):
        parts = [np.unique(g.pick(bits, which), return_counts=True) for _, which in g.chunks]
        which = np.repeat(np.arange(len(parts)), [len(v) for v, _ in parts])
        return which, np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])

    found = _sums(node, values, "chunk long, value long, n long")  # at most 2^CHUNK_BITS rows a chunk
    counts = []
    for i, (_, which) in enumerate(g.chunks):
        c, of = np.zeros(1 << len(which)), found["chunk"] == i
        c[found["value"][of]] = found["n"][of]
        counts.append(c)
    g.set_counts(counts)
    return g


# ------------------------------------------------------------------ stars, probes, verification

def _keys(node: DataFrame, g: Groups, probe: bool) -> DataFrame:
    """A row per key of a node: key, then the columns of ``node``.  Index: its own values; probe: those within its thresholds."""
    names = node.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = bits_of(b.column("fp").to_numpy().view(np.uint64))
            t = g.thresholds(bits) if probe and len(bits) else np.zeros((len(bits), len(g.groups)), np.int64)
            for i, which in enumerate(g.groups):
                value = g.pick(bits, which)
                for r in np.unique(t[:, i][t[:, i] >= 0]):
                    rows, masks = np.flatnonzero(t[:, i] == r), g.within(i, int(r))
                    step = max(1, (1 << 16) // len(masks))
                    for at in range(0, len(rows), step):
                        some = rows[at:at + step]
                        key = g.key(i, value[some][:, None] ^ masks[None, :]).ravel()
                        there = b.take(pa.array(np.repeat(some, len(masks))))
                        yield pa.RecordBatch.from_arrays([pa.array(key), *there.columns], ["key", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in node.schema.fields)
    return node.mapInArrow(run, f"key long, {kinds}")


def stars(index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): nodes within ``radius`` of the first node of a bucket that they share, by component.

    The first is that with most documents among those of the bucket's least component.
    """
    first = index.groupBy("key").agg(F.min(F.struct("label", -F.col("n_docs"), "id", "fp")).alias("f"), F.max("label").alias("last"))
    first = first.where("f.label < last").select(F.col("key").alias("f_key"), F.col("f.id").alias("f_id"), F.col("f.label").alias("f_label"),
                                                 F.col("f.fp").alias("f_fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("f_fp"))) <= radius
    return (index.join(first, F.col("key") == F.col("f_key")).where((F.col("label") != F.col("f_label")) & near)
            .select(F.col("label").alias("a"), F.col("f_label").alias("b")))


def relabel(node: DataFrame, edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node`` with its labels replaced by those of their components under ``edges``."""
    joined = components(edges, f"{folder}/{name}-components").select(F.col("id").alias("c_id"), F.col("label").alias("c_label"))
    out = node.join(joined, F.col("label") == F.col("c_id"), "left").drop("c_id")
    return materialise(out.withColumn("label", F.coalesce("c_label", "label")).drop("c_label"), folder, name)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, root) with the components of the edges a - b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        new, least = root.copy(), np.minimum(rx, ry)
        np.minimum.at(new, rx, least)
        np.minimum.at(new, ry, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _verify_units(key, i, j, probe, fp, size, label, radius: int):
    """Links (label, label) of whole units in sorted order, index rows before probe rows."""
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    unit = np.repeat(np.arange(len(start)), np.diff(start, append=len(key)))
    held = np.bincount(unit[~probe], minlength=len(start))  # index rows, which come first
    asking = np.flatnonzero(probe)
    n_pairs = held[unit[asking]]
    ends = np.cumsum(n_pairs)
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some, n = asking[at:to], n_pairs[at:to]
        p = np.repeat(some, n)
        x = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[unit[some]], n)
        good = np.bitwise_count((fp[p] ^ fp[x]).view(np.uint64)) <= radius
        p, x = p[good], x[good]
        good = (size[p] < size[x]) | ((size[p] == size[x]) & (label[p] < label[x]))
        if good.any():
            yield forest(label[p[good]], label[x[good]])
        at = to


def verify(rows: DataFrame, folder: str, unit: int = UNIT, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between components, from (key, probe, fp, size, label)."""
    full = rows.groupBy("key").agg(F.count_if(~F.col("probe")).alias("n_i"), F.count_if("probe").alias("n_p"))
    full = full.where(F.greatest("n_i", "n_p") > unit)
    full = materialise(full.select(F.col("key").alias("h_key"), F.ceil(F.col("n_i") / unit).cast("int").alias("b_i"),
                                   F.ceil(F.col("n_p") / unit).cast("int").alias("b_p")), folder, "full-keys")
    # a row of a full key goes to one block of its own side and meets all blocks of the other side
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("probe"), F.col("b_p")).otherwise(F.col("b_i"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("probe"), F.col("b_i")).otherwise(F.col("b_p")) - 1)
    dealt = rows.join(full, F.col("key") == F.col("h_key"), "left").where("coalesce(b_i, 1) > 0 and coalesce(b_p, 1) > 0")
    dealt = dealt.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(F.coalesce(other, F.array(F.lit(0)))))
    units = dealt.select("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")).alias("i"),
                         F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")).alias("j"), "probe", "fp", "size", "label")
    names = units.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cols):
            for a, b in _verify_units(*cols, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, i, j = held[:3]
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(change):  # the last unit may go on in the next batch
                cut = int(change[-1]) + 1
                yield from done([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from done(held)

    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "probe")
    return materialise(units.mapInArrow(check, "a long, b long").distinct(), folder, "links")


# ------------------------------------------------------------------ the operator

def classes(signed: DataFrame, folder: str) -> DataFrame:
    """fp, component_id of every different fingerprint of ``signed`` (doc_id, fp)."""
    # ids are unrelated to the fingerprints' order (a bijection of 64 bits), as the components want them
    node = signed.groupBy("fp").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
    node = materialise(node.withColumn("id", F.xxhash64("fp")).withColumn("label", F.col("id")), folder, "nodes")
    n = node.count()
    if n > 1:
        with settings(signed.sparkSession, LARGE_BATCHES):
            g = plan(node, n)
            for k in range(STAR_ROUNDS):
                index = materialise(_keys(node.select("fp", "id", "label", "n_docs"), g, False), folder, f"index-{k}")
                node = relabel(node, stars(index), folder, f"stars-{k}")
            size = node.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("label", "s_label")
            sized = materialise(node.join(size, F.col("label") == F.col("s_label")).select("fp", "size", "label"), folder, "sized")
            top = sized.agg(F.max(F.struct("size", "label")).alias("t")).first()["t"]  # finds nothing larger, so need not ask
            asking = sized.where((F.col("size") != top["size"]) | (F.col("label") != top["label"]))
            rows = (_keys(sized, g, False).withColumn("probe", F.lit(False))
                    .unionByName(_keys(asking, g, True).withColumn("probe", F.lit(True))))
            rows = materialise(rows.select("key", "probe", "fp", "size", "label"), folder, "keys")
            node = relabel(node, verify(rows, folder), folder, "classes")
    least = node.groupBy("label").agg(F.min("min_doc").alias("component_id")).withColumnRenamed("label", "l_label")
    return materialise(node.join(least, F.col("label") == F.col("l_label")).select("fp", "component_id"), folder, "result")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    folder = run_folder(docs.sparkSession, "simhash")
    signed = run_batches(fingerprints(docs), folder, "fingerprints")
    of = classes(signed, folder).withColumnRenamed("fp", "c_fp")
    return (signed.join(of, F.col("fp") == F.col("c_fp"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
