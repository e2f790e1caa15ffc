"""Quality classifier: histogram gradient-boosted trees over document statistics.

The forest is fitted on the driver from a bounded sample of labelled rows (``max_labels``, the one bounded step),
flattened into arrays and sent to the tasks, which walk all trees for a batch of documents with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, utf8

#: Names of the statistics, in the order of the columns of ``statistics()``.
STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "non_ascii", "control",
    "word_bytes", "longest_word", "distinct_words", "root_ttr", "top_word", "stutter", "short_words", "log_lines", "repeated_lines", "line_bytes", "last_is_stop", "distinct_pairs",
)


def statistics(texts: list[bytes]):
    """A row of numbers for each text; an empty text has zeros."""
    from collections import Counter
    from operator import eq

    import numpy as np

    kind = np.full(256, 9)  # of each byte
    for codes, k in ((range(0x41, 0x5B), 0), (range(0x61, 0x7B), 1), (range(0x30, 0x3A), 2), (b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,;:'\"()-?", 5), (b"!", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7), (range(0x80, 0x100), 8)):
        kind[list(codes)] = k
    rows = np.zeros((len(texts), len(STATISTICS)))
    for row, b in zip(rows, texts, strict=True):
        if not b:
            continue
        n = len(b)
        shares = np.bincount(kind, weights=np.bincount(np.frombuffer(b, np.uint8), minlength=256), minlength=10) / n
        words, lines = b.split(), b.split(b"\n")
        m = len(words) or 1
        count = Counter(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
        row[:] = (
            np.log1p(n), np.log1p(len(words)), *shares,
            lengths.mean() if words else 0, lengths.max(initial=0), len(count) / m, len(count) / m**0.5, max(count.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, (lengths <= 3).mean() if words else 0,
            np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines), b.rstrip()[-1:] in (b".", b"!", b"?"), pairs,
        )
    return rows


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth in flat arrays: node k of a tree has children 2k+1 and 2k+2."""

    base: float
    depth: int
    feature: object  # trees x inner nodes
    threshold: object  # go right where the value is above
    leaf: object  # trees x leaves

    def score(self, x):
        import numpy as np

        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_forest(x, y, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the logistic loss; the split of a node is the best over histograms of the binned values.

    Ties go to the first feature and the lowest bin.  Without both classes every score is the (smoothed) share of ones.
    """
    import numpy as np

    n, n_features = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(base, 0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: edges[b-1] < value <= edges[b]
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, pick = np.zeros(width), [(0, -1)] * width
            for f in range(n_features):
                if not len(edges[f]):
                    continue
                key = (at - first) * bins + binned[:, f]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                value = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                value[(nl < least) | (nt - nl < least)] = 0
                value[:, len(edges[f]) :] = 0
                best = value.argmax(1)
                top = value[np.arange(width), best]
                for node in np.flatnonzero(top > gain + 1e-9):
                    gain[node], pick[node] = top[node], (f, best[node])
            for node, (f, b) in enumerate(pick):
                if b >= 0:
                    feature[t, first + node], threshold[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        slot = at - inner
        leaf[t] = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        margin += leaf[t, slot]
    return Forest(base, depth, feature, threshold, leaf)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, **params) -> Forest:
    """Learn from at most ``max_labels`` labelled rows whose crc32(doc_id) modulo 5 is not 0, the first by a hash of the id.

    Labels other than 0 and 1, and those without an id, are left out; a document labelled twice counts with its larger
    label, and of rows that repeat an id one counts (the first by its statistics).  Without labelled rows, as in an empty
    table, every score is 0.5.
    """
    import numpy as np

    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )
    # max_labels rows of 12 bytes: the bound of this broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("__y", "doc_id", "text")

    def measure(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            x = statistics(utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "doc_id", "x"])

    measured = sample.mapInArrow(measure, "y int, doc_id long, x array<double>")
    # one row an id, so that repeated ids don't add to what the driver gets
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    x = np.array(rows.x.tolist()).reshape(-1, len(STATISTICS))
    return fit_forest(x, rows.y.to_numpy(float), **params)


def quality_scores(docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "score", least: float | None = None) -> DataFrame:
    """``docs`` with one more column, the score of the whole text (null and empty texts get one too).

    With ``least``, only rows that reach it.  Columns that are already there keep their names and values, but one named
    like ``score_col`` gives way to it.  Very long texts are measured whole.  Rows that repeat are scored each; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != score_col.lower()))
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at, model = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(forest)

    def walk(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            scores = model.value.score(statistics(utf8(batch.column(at))))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])
            yield out if least is None else out.filter(pa.array(scores >= least))

    return docs.mapInArrow(walk, schema)
