"""MinHash near-dedup with circulant permutations.

A shingle's hash is its position after the first permutation of [0, 2**20); coordinate k of a signature is the smallest
value of the second permutation, circularly shifted by k, over a document's positions.  So each shingle contributes one
contiguous window of the second permutation, and a signature is the minimum over windows.  Signatures of 160 coordinates
make 32 bands of 5: a pair with similarity 0.8 shares no band with probability 3e-6.

Documents with one and the same shingle set form a class, represented by its smallest id.  Classes are first compared
with the smallest of their buckets (stars, never all pairs), in a few bands and then, where a bucket still holds several
components, in all of them.  In buckets that then still hold several, whatever lies outside the largest component is
compared with all that lies in another one, in cells of two blocks: signatures tell which classes have a partner at all,
and only those get their full sets and are confirmed.  A pair counts in the first band that brings it together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import matrix, pairs_in, whole_cells
from .common import cut, free, id_bitmap, n_shuffle, pieces, sift_by_bitmap, utf8, worker_cache
from .components import components, merge_labels

COORDINATES, BAND = 160, 5
BANDS = COORDINATES // BAND
RING = 1 << 20
#: Bands whose buckets are looked at before all others: they join most of what belongs together.
FIRST_BANDS = 4
#: Members of a bucket side that meet in one block of the last comparison, and shingles of all of them.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
#: So many named buckets at most are sent to every executor (8 bytes each); more are joined by a shuffle.
NAMED = 100_000


def word_list(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z only and splits at ASCII white space only."""
    return raw.lower().split()


def shingle_set(words: list[bytes], width: int):
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; with fewer words, of all of them as one."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def _windows():
    """A row for each position: the second permutation's next COORDINATES values, on a ring."""
    import numpy as np

    cache = worker_cache()
    if "ring" not in cache:
        ring = np.random.default_rng(20_240_229).permutation(RING).astype(np.uint32)
        cache["ring"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: COORDINATES - 1]]), COORDINATES)
    return cache["ring"]


def signature(shingles):
    """COORDINATES minima, uint32; the set must not be empty."""
    import numpy as np

    windows, at = _windows(), (shingles % np.uint64(RING)).astype(np.int64)
    low = np.full(COORDINATES, RING, np.uint32)
    for i in range(0, len(at), 1024):
        np.minimum(low, windows[at[i : i + 1024]].min(0), out=low)
    return low


_SLIM = "doc_id long, n_shingles long, cls binary, bands array<long>, sig binary"


def _sketch(width: int):
    def sketch(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in pieces(batches):
            rows = []
            for raw in utf8(batch.column(1)):
                s = shingle_set(word_list(raw), width)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s)
                bands = [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) - 2**63 for k, part in enumerate(sig.reshape(-1, BAND))]
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands, sig.astype(np.uint8).tobytes()))
            n, cls, bands, sig = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SLIM.split(", ")])

    return sketch


def _alike(limit: int):
    """Keeps pairs whose signatures agree in ``limit`` coordinates; adds how many do."""

    def alike(batches):
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, 4096):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
                same = (x == y).sum(1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int32())], ["a", "b", "same"])
                yield out.filter(pa.array(same >= limit))

    return alike


def _linked(percent: int):
    """Keeps pairs with 100 * |x & y| >= percent * |x | y| for their full sets."""

    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, 256):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


_CELL = ("key", "i", "j")


def _partners(table, ends, percent: int, limit: int):
    """Index pairs of a cell's rows in different components, of fitting sizes and signatures, that no earlier band has
    brought together; one of the two, at least, is on side 1."""
    import numpy as np

    i, at, side, block, label, n = (table.column(k).to_numpy() for k in (1, 3, 4, 5, 7, 8))
    sig, bands, order = matrix(table.column(9), np.uint8), table.column(10).combine_chunks().flatten().to_numpy().reshape(-1, BANDS), np.arange(BANDS)

    def test(a, b):
        meant = np.where(i[a] < 0, block[a] != block[b], (side[a] != side[b]) | (side[a] == 1) & (i[a] == 0))
        some = np.flatnonzero(meant & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])))
        some = some[(sig[a[some]] == sig[b[some]]).sum(1) >= limit]
        p, q = a[some], b[some]
        return some[~((bands[p] == bands[q]) & (order < at[p, None])).any(1)]

    return pairs_in(ends, test)


_MEMBER = "key long, i int, j int, at int, side int, block int, rep long, label long"


def _sift(percent: int, limit: int):
    """The rows of a cell that have a partner there."""

    def sift(batches):
        import numpy as np

        for table, ends in whole_cells(batches, len(_CELL)):
            a, b = _partners(table, ends, percent, limit)
            if len(a):
                yield from table.select(range(8)).take(np.union1d(a, b)).to_batches()

    return sift


def _meet(percent: int, limit: int):
    """Links of a cell, confirmed on full sets.  Those between components that it has joined already are passed over."""

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        for table, ends in whole_cells(batches, len(_CELL)):
            ids, label, raw = table.column(6).to_numpy(), table.column(7).to_pylist(), table.column(11)
            root: dict = {}

            def find(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            out = []
            for i, j in zip(*_partners(table, ends, percent, limit), strict=True):
                x, y = find(label[i]), find(label[j])
                if x != y:
                    p, q = (np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in (i, j))
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        root[x] = y
                        out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return meet


def _cells_of(side: F.Column) -> F.Column:
    """The cells of a row as (i, j, own block): a block of side 0 with one of side 1; and -1 - i with j for two blocks of
    side 1.  Rows of one block of side 1 meet in the cells with i = 0."""
    mine = F.pmod(F.xxhash64("rep"), F.when(side == 0, F.col("g0")).otherwise(F.col("g1"))).cast("int")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"), mine.alias("block"))
    as_main = F.transform(F.sequence(F.lit(0), F.col("g1") - 1), lambda j: cell(mine, j))
    as_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("g0") - 1), lambda i: cell(i, mine)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("g1") - 1), lambda j: j != mine), lambda j: cell(-1 - F.least(mine, j), F.greatest(mine, j))),
    )
    return F.when(side == 0, as_main).otherwise(as_rest)


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included), kept.

    Two rows are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` hundredths or
    more.  With fewer words the whole sequence is the only shingle; null, empty and blank texts have no shingle and no
    link.  Ids should differ; rows that repeat an id and its text share their fate, a row with a null id is in the class
    of its text but names no component.  Very long texts count whole.  An empty table gives an empty result; other columns
    are ignored.
    """
    # 5.5 standard deviations below the agreement expected at the limit.
    share = percent / 100
    limit = int(COORDINATES * share - 5.5 * (COORDINATES * share * (1 - share)) ** 0.5)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = cut(texts.mapInArrow(_sketch(width), _SLIM))
    first = F.min_by(F.struct("doc_id", "n_shingles", "bands", "sig"), "doc_id")
    classes = slim.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(first.alias("r"))
    classes = cut(classes.select("cls", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.bands", "r.sig"))

    sigs = classes.select("rep", "sig", "n_shingles")
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures are similar enough."""
        pairs = pairs.distinct().join(sigs.toDF("b", "sb", "nb"), "b").join(sigs.toDF("a", "sa", "na"), "a").filter(fit).select("a", "b", "sa", "sb")
        return cut(pairs.mapInArrow(_alike(limit), "a long, b long, same int"))

    def ends(pairs: DataFrame) -> DataFrame:
        """Every id of the pairs, once."""
        return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()

    def sets_for(ids: DataFrame) -> DataFrame:
        """The full sets of the ids in question only, made of their texts again.  Each id should come once."""
        ids = cut(ids)
        found = sift_by_bitmap(texts.filter("doc_id IS NOT NULL"), "doc_id", id_bitmap(ids))
        found = found.join(ids.toDF("doc_id").hint("merge"), "doc_id", "left_semi")

        def sets_of(batches):
            import pyarrow as pa

            for batch in pieces(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(word_list(raw), width).tobytes() for raw in utf8(batch.column(1))], pa.binary())], ["id", "set"])

        # behind the join's shuffle: one Python worker a task, not two
        out = cut(found.select("doc_id", "text").mapInArrow(sets_of, "id long, set binary"))
        free(ids)
        return out

    def confirm(some: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are links, by their full sets."""
        joined = some.select("a", "b").join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return cut(joined.mapInArrow(_linked(percent), "a long, b long"))

    def apart(some: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that lie in different components so far."""
        of = labels.select("node", "label")
        ends = some.join(of.toDF("a", "la"), "a", "left").join(of.toDF("b", "lb"), "b", "left")
        return cut(ends.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.toDF("l_rep", "l"), F.col("rep") == F.col("l_rep"), "left").withColumn("label", F.coalesce("l", "rep")).drop("l_rep", "l")

    def several(members: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components.  One small aggregate a bucket is shuffled, and then the rows of
        those buckets alone."""
        apart = cut(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"))
        named = F.broadcast(apart) if apart.count() <= NAMED else apart
        rows = cut(members.join(named, "key", "left_semi"))
        free(apart)
        return rows

    def around_largest(rows: DataFrame) -> DataFrame:
        """``rows`` with the largest component of their bucket, its smallest class, and the blocks of it and of the others."""
        blocks = lambda rows, shingles: F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
        sizes = rows.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("mass"), F.min("rep").alias("first"))
        top = F.max_by(F.struct("label", "size", "mass", "first"), F.struct("size", "label"))
        split = sizes.groupBy("key").agg(top.alias("top"), F.count("*").alias("labels"), F.sum("size").alias("all"), F.sum("mass").alias("whole")).filter("labels > 1")
        split = split.select(F.col("key").alias("s_key"), F.col("top.label").alias("main"), F.col("top.first").alias("hub"), blocks(F.col("top.size"), F.col("top.mass")).alias("g0"), blocks(F.col("all") - F.col("top.size"), F.col("whole") - F.col("top.mass")).alias("g1"))
        return rows.join(split, F.col("key") == F.col("s_key"))

    # Stars in the first bands: each class with the likeliest of its centres, then the centres that this leaves apart.
    few = classes.select("rep", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("key"))
    hubs = few.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 1").select(F.col("key").alias("h_key"), "hub")
    pairs = alike(few.join(hubs, (F.col("key") == F.col("h_key")) & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")).select("a", "b")
    likely = sets_for(ends(pairs))
    labels = cut(components(confirm(best, likely)))
    labels = merge_labels(labels, confirm(apart(pairs, labels), likely))
    free(pairs, likely)

    # Stars in all bands, in buckets that hold several components: the others' classes with the largest one's first.
    every = labelled(classes.select("rep", "n_shingles", "bands"), labels).select("rep", "label", "n_shingles", F.posexplode("bands").alias("at", "key"))
    open_ = several(every)
    pairs = alike(around_largest(open_).filter("label != main").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")))
    if not pairs.isEmpty():
        likely = sets_for(ends(pairs))
        labels = merge_labels(labels, confirm(pairs, likely))
        free(likely)
    free(pairs)

    # What is left: those of the same buckets that still hold several components.
    rows = around_largest(labelled(open_.drop("label"), labels)).withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    rows = rows.select("key", "at", "side", "rep", "label", F.explode(_cells_of(F.col("side"))).alias("c"))
    rows = rows.select("key", "c.i", "c.j", "at", "side", "c.block", "rep", "label")
    details = classes.select("rep", "n_shingles", "sig", "bands")

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(n_shuffle(docs.sparkSession), *_CELL).sortWithinPartitions(*_CELL, "side", "rep")

    near = cut(together(rows.join(details, "rep").select(*(f.split()[0] for f in _MEMBER.split(", ")), "n_shingles", "sig", "bands")).mapInArrow(_sift(percent, limit), _MEMBER))
    if not near.isEmpty():
        sets = sets_for(near.select("rep").distinct()).toDF("rep", "set")
        whole = near.join(details, "rep").join(sets, "rep").select(*near.columns, "n_shingles", "sig", "bands", "set")
        links = cut(together(whole).mapInArrow(_meet(percent, limit), "a long, b long"))
        labels = merge_labels(labels, links)
        free(links, sets)
    free(near, open_)

    named = classes.select("cls", "rep").join(labels.toDF("rep", "label"), "rep", "left").select("cls", F.coalesce("label", "rep").alias("component"))
    out = slim.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
