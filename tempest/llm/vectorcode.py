"""Compression of vectors to product codes: Lloyd rounds over resident members.

A vector's components become integers ``floor(4096 * x)``, the vector is cut into ``PARTS`` consecutive
parts, and each part position has a codebook of ``ENTRIES`` entries that ``ROUNDS`` Lloyd rounds fit.

How it runs:
1. The vectors are cut once.  Their parts are dealt to owners, one owner for each (position, entry,
   salt), under the first codebook, and each owner packs its members into blocks of at most
   ``BLOCK_MEMBERS`` parts: ids, components, and the sum of the components.
2. A round starts from the owners' sums: a few numbers per block make the new codebook (at most
   ``ENTRIES`` * dimensions numbers, which the driver holds; the members stay where they are).
3. Every owner compares its members with the new entries of its position.  Members that stay are written
   back by the task that read them, without a shuffle.  Only those whose nearest entry changed go through
   the next shuffle, to the owner of their new entry with the same salt, and become blocks there.
4. After the last assignment a shuffle of (row, entry, distance) puts the codes together.

A hot entry has as many owners as there are salts, and the number of salts follows the number of rows, so
no owner grows with the table.  A round's tables are deleted once the next round's are written; until then
a lost executor costs only its own tasks.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped, and an
empty table gives an empty result.  Vectors shorter than the longest, or than a multiple of ``PARTS``,
count as filled up with zeros.  So that distances fit the 64 bits of ``error``, integers beyond
``isqrt(2^61 / dimensions)`` (for 64 dimensions: components beyond 46,340) count as that bound.  The
codebooks start from the rows with the smallest vec_ids (null last; equal ids by their components); with
fewer rows than entries there are fewer entries.  Rows that repeat are rows of their own.  ``label_error``
is null if it passes 64 bits.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import discard, settings
from tempest.session import materialise, run_folder

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_MEMBERS = 1 << 16

BLOCK = "position int, entry int, salt long, moved boolean, n long, sums array<bigint>, rows binary, parts binary"
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
#: Vectors cut together; their parts share a salt.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Blocks are megabytes: few at a time.
BLOCKS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


# ------------------------------------------------------------------ integers in arrays

def to_integers(vectors: list[list[float]], width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of all vectors, filled up to ``width`` and held to the bound."""
    out = np.zeros((len(vectors), width), np.float64)
    if vectors and all(len(v) == width for v in vectors):
        out[:] = vectors
    else:
        for row, v in zip(out, vectors, strict=True):
            row[:len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -_bound(width), _bound(width)).astype(np.int64)


def _bound(width: int) -> int:
    return math.isqrt((1 << 61) // max(width, 1))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; ties to the lower entry."""
    entry, least = np.zeros(len(parts), np.int64), None
    for e, centre in enumerate(book):
        d = parts - centre
        d = np.einsum("ij,ij->i", d, d)
        if least is None:
            least = d
        else:
            closer = d < least
            entry[closer], least = e, np.where(closer, d, least)
    return entry, least


def _block(position: int, entry: int, salt: int, moved: bool, rows: np.ndarray, parts: np.ndarray) -> tuple:
    return position, entry, salt, moved, len(rows), parts.sum(axis=0).tolist(), rows.tobytes(), parts.astype(np.int32).tobytes()


def _record_batch(blocks: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*blocks, strict=True), _KINDS, strict=True)], _NAMES)


# ------------------------------------------------------------------ steps of a round

def _cut(books: np.ndarray, salts: int, width: int):
    """Task function: vectors to packets of their parts, by position and nearest entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column("row").to_numpy()
            x = to_integers(b.column("vector").to_pylist(), width).reshape(len(rows), PARTS, -1)
            salt = (int(rows[0]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % salts
            out = []
            for p in range(PARTS):
                entry = nearest(x[:, p], books[p])[0]
                for e in np.unique(entry):
                    here = entry == e
                    out.append(_block(p, int(e), salt, True, rows[here], x[here, p]))
            yield _record_batch(out)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        for r in b.to_pylist():
            rows = np.frombuffer(r["rows"], np.int64)
            yield r["position"], r["entry"], r["salt"], rows, np.frombuffer(r["parts"], np.int32).reshape(len(rows), -1).astype(np.int64)


def _assign(books: np.ndarray):
    """Task function: an owner's block to the block of those that stay and packets of those that go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for position, entry, salt, rows, parts in _members(batches):
            to = nearest(parts, books[position])[0]
            yield _record_batch([_block(position, int(e), salt, bool(e != entry), rows[to == e], parts[to == e]) for e in np.unique(to)])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the packets of an owner, which come one after the other, to blocks."""
    at, held, n = None, [], 0

    def full() -> pa.RecordBatch:
        rows, parts = (np.concatenate(x) for x in zip(*held, strict=True))
        return _record_batch([_block(*at, False, rows[i:i + BLOCK_MEMBERS], parts[i:i + BLOCK_MEMBERS])
                              for i in range(0, len(rows), BLOCK_MEMBERS)])

    for position, entry, salt, rows, parts in _members(batches):
        if held and (at != (position, entry, salt) or n + len(rows) > BLOCK_MEMBERS):
            yield full()
            held, n = [], 0
        at = position, entry, salt
        held.append((rows, parts))
        n += len(rows)
    if held:
        yield full()


def _arrived(packets: DataFrame) -> DataFrame:
    """Moved parts at their owners: the one shuffle of a round."""
    owner = ["position", "entry", "salt"]
    return packets.repartition(*owner).sortWithinPartitions(*owner).mapInArrow(_settle, BLOCK)


def _update(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry to the floored mean of its owners' members; unused entries stay."""
    sums = (blocks.select("position", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("position", "entry", "i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")))
    out = books.copy()
    for r in sums.collect():  # at most ENTRIES * dimensions numbers
        out[r["position"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return out


def _distances(books: np.ndarray):
    """Task function: (row, entry in its place of the code, distance) of every member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for position, _, _, rows, parts in _members(batches):
            entry, d = nearest(parts, books[position])
            digits = entry << (8 * (PARTS - 1 - position))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(digits), pa.array(d)], ["row", "digits", "d"])

    return run


# ------------------------------------------------------------------ the operator

def _vectors(rows: DataFrame, folder: str) -> DataFrame:
    """row, vec_id, label, vector (double) of the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = rows.where(x.isNotNull() & good)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), x.alias("vector"))
    return materialise(kept.select(F.monotonically_increasing_id().alias("row"), "*"), folder, "vectors")


def _first_books(vectors: DataFrame, width: int) -> np.ndarray:
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector", "row").limit(ENTRIES)
    x = to_integers([r["vector"] for r in first.select("vector").collect()], width)
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2).copy()


def fit(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None, np.ndarray | None]:
    """(kept rows, owners' blocks under the last codebooks, codebooks by position and entry)."""
    spark = rows.sparkSession
    vectors = _vectors(rows, folder)
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return vectors, None, None
    width = max(-(-width // PARTS), 1) * PARTS
    books = _first_books(vectors, width)
    with settings(spark, BATCH):
        packets = materialise(vectors.select("row", "vector").mapInArrow(_cut(books, -(-n // BLOCK_MEMBERS), width), BLOCK), folder, "moves-0")
    with settings(spark, BLOCKS):
        blocks = materialise(_arrived(packets), folder, "blocks-0")
        for k in range(1, ROUNDS):
            books = _update(blocks, books)
            told = materialise(blocks.drop("moved", "n", "sums").mapInArrow(_assign(books), BLOCK), folder, f"moves-{k}")
            discard(spark, folder, f"blocks-{k - 1}")
            discard(spark, folder, f"moves-{k - 1}")
            # those that stay keep their task's files and are read from there; only packets are shuffled
            arrived = materialise(_arrived(told.where("moved")), folder, f"blocks-{k}")
            blocks = told.where("not moved").unionByName(arrived)
        books = _update(blocks, books)
    return vectors, blocks, books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    folder = run_folder(spark, "vectorcode")
    vectors, blocks, books = fit(rows, folder)
    if blocks is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    with settings(spark, BLOCKS):
        each = blocks.drop("moved", "n", "sums").mapInArrow(_distances(books), "row long, digits long, d long")
        coded = each.groupBy("row").agg(F.lower(F.lpad(F.hex(F.sum("digits")), 2 * PARTS, "0")).alias("code"), F.sum("d").alias("error"))
        coded = materialise(coded.withColumnRenamed("row", "c_row"), folder, "coded")
    coded = coded.join(vectors.select("row", "vec_id", "label"), F.col("c_row") == F.col("row"))
    coded = materialise(coded.select("vec_id", "label", "code", "error"), folder, "labelled")
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    per_label = per_label.withColumnRenamed("label", "l_label")
    return (coded.join(per_label, F.col("label").eqNullSafe(F.col("l_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")))
