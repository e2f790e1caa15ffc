"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each partition fingerprints its texts (64 bits of SHA-256 of the text without ASCII white space), sorts the
   distinct fingerprints of each owner's range and sends them Golomb-Rice coded, with one bit for each that it holds twice.
2. Owners decode, find fingerprints held twice in all, and return a duplicate bitmap over their range: 64 bits for each
   such fingerprint, 64 MB for all owners at most.  That is the bound of what is broadcast; a bitmap that has to do with
   less costs selectivity, never results.
3. Partitions test their fingerprints; only suspects' texts are shuffled, one copy a partition and text, and grouped
   by all of their bytes.  A group that holds a third of all rows is a row a partition by then.
"""

from __future__ import annotations

import math
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, MOST_BITS, bits_for, cut, free, n_shuffle, pieces, utf8

#: Suspects' distinct texts that a task keeps before it passes them on.
HELD_BYTES = 16 << 20


def golomb_encode(values, universe_bits: int) -> tuple[bytes, int, int]:
    """Sorted distinct uint64 -> (code, count, Rice parameter): unary quotients, then remainders."""
    import numpy as np

    n = len(values)
    if not n:
        return b"", 0, 0
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1.0, 2.0**universe_bits / n)
    k = max(0, min(62, int(math.log2(mean * math.log(2))) if mean > 2 else 0))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    rest = np.zeros((n, k), np.uint8)
    for bit in range(k):
        rest[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    return len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes(), n, k


def golomb_decode(code: bytes, n: int, k: int):
    import numpy as np

    if not n:
        return np.zeros(0, np.uint64)
    length = int.from_bytes(code[:8], "little")
    stop = 8 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(code[8:stop], np.uint8), count=length)
    ends = np.flatnonzero(unary == 0)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    rest = np.unpackbits(np.frombuffer(code[stop:], np.uint8), count=n * k).reshape(n, k)
    for bit in range(k):
        gaps += rest[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64)


def _sha(body: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(body).digest()


def _send(owner_bits: int):
    def send(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        prints = array("Q", (int.from_bytes(_sha(b.translate(None, ASCII_SPACE))[:8], "big") for batch in pieces(batches) for b in utf8(batch.column(0))))
        found, counts = np.unique(np.frombuffer(prints, np.uint64), return_counts=True)
        shift = np.uint64(64 - owner_bits)
        owners = (found >> shift).astype(np.int64) if owner_bits else np.zeros(len(found), np.int64)
        cuts = np.searchsorted(owners, np.arange((1 << owner_bits) + 1))
        rows = []
        for owner in np.unique(owners):
            part = slice(cuts[owner], cuts[owner + 1])
            base = np.uint64(int(owner) << (64 - owner_bits)) if owner_bits else np.uint64(0)
            code, n, k = golomb_encode(found[part] - base, 64 - owner_bits)
            rows.append((pid, int(owner), n, k, code, np.packbits(counts[part] > 1).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["pid", "owner", "n", "k", "code", "twice"])

    return send


def _own(owner_bits: int):
    """The fingerprints of an owner's range that were held twice, coded again."""

    def own(pdf):
        import numpy as np
        import pandas as pd

        held = [golomb_decode(c, n, k) for c, n, k in zip(pdf.code, pdf.n, pdf.k, strict=True)]
        again = [h[np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)).astype(bool)] for h, t in zip(held, pdf.twice, strict=True)]
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        code, n, k = golomb_encode(np.union1d(found[counts > 1], np.concatenate(again)), 64 - owner_bits)
        return pd.DataFrame({"owner": [int(pdf.owner.iloc[0])], "n": [n], "k": [k], "code": [code]})

    return own


def _mark(owner_bits: int, bitmap_bits: int):
    def mark(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            maps = []
            for code, n, k in zip(*(batch.column(i).to_pylist() for i in (3, 1, 2)), strict=True):
                bits = np.zeros(1 << (bitmap_bits - owner_bits), np.uint8)
                bits[(golomb_decode(code, n, k) >> np.uint64(64 - bitmap_bits)).astype(np.int64)] = 1
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["owner", "bitmap"])

    return mark


def duplicate_bitmap(docs: DataFrame, text: str, most_bits: int = MOST_BITS) -> bytes:
    """Steps 1 and 2; the bitmap of all owners, of at most 2 ** most_bits bits."""
    import zlib

    owner_bits = max(0, min(most_bits - 6, 12, (n_shuffle(docs.sparkSession) - 1).bit_length()))
    sent = docs.select(text).mapInArrow(_send(owner_bits), "pid int, owner int, n int, k int, code binary, twice binary")
    doubled = cut(sent.groupBy("owner").applyInPandas(_own(owner_bits), "owner int, n int, k int, code binary").filter("n > 0"))
    bitmap_bits = max(owner_bits + 6, bits_for(doubled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], most_bits))
    width = (1 << (bitmap_bits - owner_bits)) // 8
    whole = bytearray((1 << bitmap_bits) // 8)
    for row in doubled.mapInArrow(_mark(owner_bits, bitmap_bits), "owner int, bitmap binary").collect():  # bounded by the bitmap
        whole[row.owner * width : (row.owner + 1) * width] = zlib.decompress(row.bitmap)
    free(doubled)
    return bytes(whole)


_SIFTED = "is_text boolean, doc_id long, sha binary, n_cp long, body binary, n long"


def _sift(bitmap):
    def sift(batches):
        import pyarrow as pa

        bits = bitmap.value
        shift = 65 - (8 * len(bits)).bit_length()
        held: dict[bytes, list] = {}
        size = 0

        def texts():
            rows = [(s, *v) for s, v in held.items()]
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([True] * n, pa.bool_()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0][0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                ["is_text", "doc_id", "sha", "n_cp", "body", "n"],
            )

        for batch in pieces(batches):
            ids, shas = batch.column(0).to_pylist(), []
            for doc_id, raw in zip(ids, utf8(batch.column(1)), strict=True):
                body = raw.translate(None, ASCII_SPACE)
                shas.append(sha := _sha(body))
                at = int.from_bytes(sha[:8], "big") >> shift
                if bits[at >> 3] >> (7 - (at & 7)) & 1:
                    n_cp = len(raw.decode("utf-8", "replace"))
                    if (mine := held.get((body, sha))) is None:
                        held[body, sha] = [1, n_cp, doc_id]
                        size += len(body) + 300
                    else:
                        mine[0] += 1
                        if n_cp > mine[1] or n_cp == mine[1] and doc_id is not None and (mine[2] is None or doc_id < mine[2]):
                            mine[1:] = n_cp, doc_id
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([False] * n, pa.bool_()), pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], ["is_text", "doc_id", "sha", "n_cp", "body", "n"])
            if size > HELD_BYTES:
                yield texts()
                held.clear()
                size = 0
        yield texts()

    return sift


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, and empty texts equal each other.
    Of equal texts the one with the most code points stays, then the smallest id; a null id comes last.  Rows that
    share an id share their fate; rows that repeat count each.  Very long texts are hashed and compared whole.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bitmap = spark.sparkContext.broadcast(duplicate_bitmap(docs, "text", most_bits))
    sifted = cut(docs.mapInArrow(_sift(bitmap), _SIFTED))
    # Grouping by (sha, body) compares all bytes; (no id) is greater than (some id), so that min() takes null ids last.
    first = F.min(F.struct((-F.col("n_cp")).alias("minus"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    verified = sifted.filter("is_text").groupBy("sha", "body").agg(F.sum("n").alias("group_size"), first.alias("best"))
    groups = verified.groupBy("sha").agg(F.count("*").alias("texts"), F.max("group_size").alias("group_size"), F.min("best").alias("best"))
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.assert_true(F.col("texts") == 1, "two texts have one SHA-256").alias("sure"))
    # Written, so that the join reads two plain exchanges and Spark can split the one text that a third of the rows share.
    groups = cut(groups)
    return (
        sifted.filter("NOT is_text")
        .select("doc_id", "sha")
        .join(groups, "sha", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("sure").isNull(), F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
