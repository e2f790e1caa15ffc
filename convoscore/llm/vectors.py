"""Embedding near-dedup by iterative quantisation.

Rotations are learnt so that the signs of the rotated unit vectors lose as little as possible (ITQ); a code's substrings
are the keys of multi-index tables.  Only codes travel to the tables' buckets: there, vectors whose codes are near by
Hamming distance are told from the rest, many buckets at a time.  The original vectors follow for those alone, and are
reranked by cosine in their buckets: links are counted and linked there, and no pair leaves a bucket.  A pair counts in
the first table that brings it together.  Buckets are cut into blocks, and each block meets each other once, so that a
bucket with a third of all rows is many tasks.

Substrings get longer with the number of vectors, and tables more, so that buckets stay small and the chance to miss a
pair at the limit stays below ``miss``.  Vectors are not centred: around a dense cluster that would turn small angles
into large ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import binary, matrix, pairs_in, whole_cells
from .common import cut, free, n_shuffle, pieces
from .components import components

#: Vectors of one bucket that meet in one block.
BLOCK = 512
#: Bits of the codes that travel, in whole rotations.
CODE_BITS = 256
#: So many named buckets at most are sent to every executor (some 16 bytes each); more are joined by a shuffle.
NAMED = 100_000


def learn_rotations(x, count: int, steps: int = 25, seed: int = 11):
    """``count`` orthogonal matrices, each from another random start: alternate between codes and the best rotation."""
    import numpy as np

    d = x.shape[1]
    _, basis = np.linalg.eigh(x.T @ x)
    v, rng, out = x @ basis, np.random.default_rng(seed), []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        out.append(basis @ r)
    return np.stack(out)


class Tables:
    """Keys and codes of vectors: substrings of ``width`` bits of the codes, ``tables`` of them over all rotations."""

    def __init__(self, rotations, width: int, tables: int, cosine: float):
        import numpy as np

        self.rotations, self.width, self.tables = rotations, width, tables
        self.all = np.concatenate(list(rotations), 1)
        self.coded = min(rotations.shape[0], math.ceil(CODE_BITS / rotations.shape[1])) * rotations.shape[1]
        flip = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        #: Bits of a code that may differ: five standard deviations above what is expected at the limit.
        self.far = self.coded * flip + 5 * math.sqrt(self.coded * flip * (1 - flip))

    def signs(self, x):
        return x @ self.all >= 0

    def codes(self, signs):
        """The first bits of ``signs`` as rows of 64-bit words."""
        import numpy as np

        packed = np.packbits(signs[:, : self.coded], axis=1)
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)

    def keys(self, signs):
        """One number for each vector and table."""
        import numpy as np

        d, w = self.rotations.shape[1], self.width
        per = d // w
        out = np.zeros((len(signs), self.tables), np.int64)
        for t in range(self.tables):
            at = t // per * d + t % per * w
            for bit in range(w):
                out[:, t] = out[:, t] * 2 + signs[:, at + bit]
        return out


def plan_tables(n: int, d: int, cosine: float, miss: float) -> tuple[int, int, int]:
    """(bits of a substring, tables, rotations) for n vectors of d components."""
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    width = max(1, min(d, 24, max(8, n.bit_length() - 5)))
    tables = math.ceil(math.log(miss) / math.log1p(-min(1 - 1e-9, same**width)))
    return width, tables, math.ceil(tables / (d // width))


def _unit(raw: list[bytes], kind: str):
    import numpy as np

    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(kind: str):
    """Vectors as bytes; null for those that link with nothing."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, 4096):
            out = []
            for v in batch.column(1).to_pylist():
                x = None if not v or any(c is None for c in v) else np.array(v, kind)
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return pack


def _place(model, kind: str):
    """A row for each vector and table: the table's key, and the code."""

    def place(batches):
        import numpy as np
        import pyarrow as pa

        tables: Tables = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                signs = tables.signs(_unit(batch.column(1).to_pylist(), kind))
                codes = np.repeat(tables.codes(signs), tables.tables, 0)
                ids = np.repeat(batch.column(0).to_numpy(), tables.tables)
                t = np.tile(np.arange(tables.tables, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(tables.keys(signs).ravel()), pa.array(ids), binary(codes)], ["t", "key", "rep", "code"])

    return place


_CELL = ("t", "key", "i", "j")


def _near_pairs(codes, block, ends, far: float):
    """Index pairs of rows of one cell whose codes are near; in a cell of two blocks, those of different blocks."""
    import numpy as np

    begins = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    two = np.repeat(block[begins] != block[ends[begins] - 1], ends[begins] - begins)  # whether the row's cell has two blocks

    def test(a, b):
        some = np.flatnonzero(~two[a] | (block[a] != block[b]))
        return some[np.bitwise_count(codes[a[some]] ^ codes[b[some]]).sum(1, dtype=np.int32) <= far]

    return pairs_in(ends, test)


def _sift(model):
    """The rows of a cell that are near another one of it, by their codes."""

    def sift(batches):
        import numpy as np

        for table, ends in whole_cells(batches, len(_CELL)):
            a, b = _near_pairs(matrix(table.column(6), np.uint64), table.column(4).to_numpy(), ends, model.value.far)
            if len(a):
                yield from table.select([0, 1, 2, 3, 4, 5]).take(np.union1d(a, b)).to_batches()

    return sift


def _meet(model, kind: str, cosine: float):
    """Links inside cells: for each row how many, and the smallest row that it is linked with there."""

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        tables: Tables = model.value
        for table, ends in whole_cells(batches, len(_CELL)):
            x, ids, n, t = _unit(table.column(6).to_pylist(), kind), table.column(5).to_numpy(), table.column(7).to_numpy(), table.column(0).to_numpy()
            signs = tables.signs(x)
            a, b = _near_pairs(tables.codes(signs), table.column(4).to_numpy(), ends, tables.far)
            keys, keep = tables.keys(signs), []
            for k in range(0, len(a), 65536):
                p, q = a[k : k + 65536], b[k : k + 65536]
                close = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                before = np.arange(tables.tables) < t[p, None]  # an earlier table has brought them together
                keep.append(close & ~((keys[p] == keys[q]) & before).any(1))
            if not keep or not (keep := np.concatenate(keep)).any():
                continue
            a, b = a[keep], b[keep]
            links = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
            root = np.arange(len(x))
            while True:
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
                if (before == root).all():
                    break
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    return meet


def _links(classes: DataFrame, count: int, kind: str, cosine: float, sample: int, miss: float) -> DataFrame:
    """Links among ``count`` classes of vectors of one length."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()
    x = _unit(rows.v.tolist(), kind)
    width, tables, rotations = plan_tables(count, x.shape[1], cosine, miss)
    spark = classes.sparkSession
    model = spark.sparkContext.broadcast(Tables(learn_rotations(x, rotations), width, tables, cosine))
    placed = classes.select("rep", "v").mapInArrow(_place(model, kind), "t int, key long, rep long, code binary")
    # Only buckets of more than a block are named: a row for at least BLOCK placed ones.
    large = placed.groupBy("t", "key").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select(F.col("t").alias("l_t"), F.col("key").alias("l_key"), F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    large = cut(large)
    if large.count() <= NAMED:
        large = F.broadcast(large)
    g = F.coalesce("g", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), g).cast("int")
    cells = placed.join(large, (F.col("t") == F.col("l_t")) & (F.col("key") == F.col("l_key")), "left").select("t", "key", "rep", "code", mine.alias("block"), F.explode(F.sequence(F.lit(0), g - 1)).alias("other"))
    cells = cells.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "code")
    place = "t int, key long, i int, j int, block int, rep long"

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(n_shuffle(spark), *_CELL).sortWithinPartitions(*_CELL, "block", "rep")

    near = cut(together(cells).mapInArrow(_sift(model), place))
    known = near.join(classes, "rep").select("t", "key", "i", "j", "block", "rep", "v", "n")
    out = cut(together(known).mapInArrow(_meet(model, kind, cosine), "a long, b long, links long"))
    free(near)
    return out


def vector_dedup(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, miss: float = 1e-3) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest id reachable, itself included), kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    lengths don't link, and each length has tables of its own.  A row with a null id is linked with what its vector is
    linked with, but counts for no other row and names no component; rows that repeat an id count each.  Other columns
    are ignored, and an empty table gives an empty result.  Equal vectors are one class with a multiplicity, so copies
    never meet in a bucket.  The rotations are fitted on ``sample`` vectors, the first by a hash of the id; all vectors
    are indexed.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in dict(vectors.dtypes).get(vector_col, "") else "<f8"
    packed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))
    packed = cut(packed.mapInArrow(_pack(kind), "vec_id long, v binary"))
    every = cut(packed.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    links = spark.createDataFrame([], "a long, b long, links long")
    for size, count in sorted(map(tuple, every.groupBy(F.length("v")).count().filter("count > 1").collect())):
        links = links.unionByName(_links(every.filter(F.length("v") == size), count, kind, cosine, sample, miss))
    labels = components(links.filter("a != b"))
    degree = links.groupBy("a").agg(F.sum("links").alias("others"))
    known = every.select("v", "rep", "n").join(degree, F.col("rep") == F.col("a"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("v").alias("w"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component"))
    out = packed.join(known, F.col("v") == F.col("w"), "left")
    mine = F.when(F.col("n_links").isNotNull(), F.col("n_links") + F.col("vec_id").isNull().cast("int"))
    out = out.select("vec_id", F.coalesce(mine, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
