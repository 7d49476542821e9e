"""Embedding near-duplicates by a sorted projection pass with exact windows.

The pass orders all distinct vectors lexicographically by a key of bits: bit k tells on which side of a cut the vector's projection on the k-th direction
lies. Directions are orthonormal, the widest of a sample first, and a cut is the median of the sample among the vectors that share the bits before, so runs of
equal keys are about as long in dense regions as in sparse ones. A window of a run is every run that can hold a partner: unit vectors with a cosine of at least the
threshold are no further apart than sqrt(2 - 2 * threshold), in any projection, so runs whose projections lie further apart hold none. Long runs are split into
parts, and tasks compare two parts. The links found are united into components.

No pair that reaches the threshold is left out, whatever the size of the table: its size and the sample decide how many pairs are compared, never which
links there are. Where vectors have no wide directions (independent ones of many dimensions), windows hold most runs and the work is quadratic; a task still holds two
parts only. The links inside each component are then counted exactly, block against block: no pair is written, only sums per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.common import save
from tidemark.llm.components import components

#: Vectors of a part, of the sample of a dimension, bytes of that sample, and directions that tell runs apart.
PART, SAMPLE, SAMPLE_BYTES, DIRECTIONS = 4096, 16_384, 64 << 20, 24
#: Slack of a distance between projections, far above what double precision may be off by.
SLACK = 1e-6
#: Vectors of one component in a block; tasks compare two blocks at a time.
BLOCK = 512
#: Rows of a part that are compared at once, and close calls that are computed again in double precision at once.
STRIP, AGAIN = 256, 65_536


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    # By the largest component first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its class, and one row per class of equal vectors: node (a hash of the vector), least (smallest vec_id), copies, vector.

    Vectors that are null, empty, zero or hold null or non-finite components have no class.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, F.transform(x, lambda v: v + 0.0)).alias("vector"))
    rows = rows.withColumn("_k1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("_k2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(7), F.reverse("vector"))))
    rows = save(rows)
    one = rows.filter("vector is not null and vec_id is not null").groupBy("_k1", "_k2").agg(F.xxhash64("_k1", "_k2").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    return rows.drop("vector"), save(one)


@dataclass
class Pass:
    """Orthonormal directions (dim x some), and the cut for each beginning of a key (the empty one 1, longer ones 2i and 2i + 1)."""

    directions: np.ndarray
    cuts: np.ndarray

    def keys(self, projected: np.ndarray) -> np.ndarray:
        at = np.ones(len(projected), dtype=np.int64)
        for column in _bits(projected, self.cuts):
            at = 2 * at + (column > self.cuts[at])
        return at - len(self.cuts)


def _bits(projected: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    """The projections that a key's bits are taken from, directions in turn."""
    for bit in range(len(cuts).bit_length() - 1):
        yield projected[:, bit % projected.shape[1]]


def plan(sample: np.ndarray, n: int) -> Pass:
    """Directions and cuts for n vectors of which sample (unit length) is a random part: runs of about PART vectors, as far as the sample tells them apart."""
    m, dim = sample.shape
    # Widest directions of the sample first; without one, those of the axes.
    middle = sample - sample.mean(0) if m else sample
    directions = np.linalg.eigh(middle.T @ middle)[1][:, ::-1][:, :DIRECTIONS]
    depth = min(int(np.ceil(np.log2(max(n / PART, 1)))), int(np.log2(max(m, 1))))
    cuts = np.zeros(1 << depth)
    projected, at = sample @ directions, np.ones(m, dtype=np.int64)
    for column in _bits(projected, cuts):
        order = np.lexsort((column, at))
        nodes, start, count = np.unique(at[order], return_index=True, return_counts=True)
        half = start + count // 2
        cuts[nodes] = (column[order[half]] + column[order[np.maximum(half - 1, start)]]) / 2
        at = 2 * at + (column > cuts[at])
    return Pass(directions, cuts)


def plans(one: DataFrame) -> dict[int, Pass]:
    """The pass for each length of vector."""
    out = {}
    for dim, n in one.groupBy(F.size("vector")).count().collect():
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        share = -(-n // most)
        some = one.filter((F.size("vector") == dim) & (F.pmod(F.xxhash64("node", F.lit(23)), F.lit(share)) == 0)).select("node", "vector").toPandas()
        out[dim] = plan(_unit(some.sort_values("node")["vector"]) if len(some) else np.zeros((0, dim)), n)
    return out


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels after joining the ends of all links, and the few links that join them."""
    kept = []
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        if not apart.any():
            return label, kept
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        tops, first = np.unique(high, return_index=True)
        kept.append(np.stack([a[first], b[first]], 1))
        parent = np.arange(len(label))
        parent[tops] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _links(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Rows (i, j) of x, i of left and j of right, that reach the threshold in double precision: a spanning forest of all such pairs."""
    narrow = x.astype(np.float32)
    label, kept = np.arange(len(x)), [np.zeros((0, 2), dtype=np.int64)]
    # Single precision may be off by this much; what is as close as that is computed again.
    near = 1e-6 * max(100, x.shape[1])
    other = narrow[right].T
    for start in range(0, len(left), STRIP):
        rows = left[start : start + STRIP]
        cosine = narrow[rows] @ other
        r, c = np.nonzero(cosine >= threshold - near)
        sure = cosine[r, c] >= threshold + near
        a, b = rows[r], right[c]
        apart = label[a] != label[b]
        a, b, sure = a[apart], b[apart], sure[apart]
        for at in range(0, len(a), AGAIN):
            close = at + np.flatnonzero(~sure[at : at + AGAIN])
            sure[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]]) >= threshold
        label, more = _forest(label, a[sure], b[sure])
        kept += more
    return np.concatenate(kept)


def window_links(one: DataFrame, threshold: float, kind: str = "double") -> DataFrame:
    """Links (a, b) that join all vectors of a cosine of at least the threshold, directly or by other links; kind: in what type vectors are shuffled."""
    passes = plans(one)
    width = min(DIRECTIONS, max(passes, default=1))

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vector"].map(len)):
                for start in range(0, len(part), 2048):
                    some = part.iloc[start : start + 2048]
                    on = _unit(some["vector"]) @ passes[dim].directions
                    yield dim, some, on, passes[dim].keys(on)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, some, _, keys in projected(frames):
            yield pd.DataFrame({"dim": np.int32(dim), "key": keys, "node": some["node"].to_numpy(), "vector": some["vector"].to_numpy()})

    def extent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, _, on, keys in projected(frames):
            on = np.pad(on, ((0, 0), (0, width - on.shape[1])))
            names, place, count = np.unique(keys, return_inverse=True, return_counts=True)
            low, high = np.full((len(names), width), np.inf), np.full((len(names), width), -np.inf)
            np.minimum.at(low, place, on)
            np.maximum.at(high, place, on)
            yield pd.DataFrame({"dim": np.int32(dim), "key": names, "n": count, "low": list(low), "high": list(high)})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        node, own = frame["node"].to_numpy(), frame["part"].to_numpy()
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        pairs = _links(_unit(frame["vector"]), left, right, threshold) if len(left) and len(right) else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame(np.sort(node[pairs], 1), columns=["a", "b"])

    vectors = one.select("node", "vector")
    runs = vectors.mapInPandas(extent, "dim int, key long, n long, low array<double>, high array<double>")
    ends = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(width))).alias(c)
    runs = runs.groupBy("dim", "key").agg(F.sum("n").alias("n"), ends(F.min, "low"), ends(F.max, "high"))
    # Parts are numbered through all runs of a dimension, in the order of the keys.
    parts = F.ceil(F.col("n") / PART).cast("long")
    before = F.coalesce(F.sum(parts).over(Window.partitionBy("dim").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = save(runs.withColumns({"parts": parts, "first": before}))
    blocks = runs.select("dim", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("i"), "low", "high")
    other = blocks.select("dim", F.col("i").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = lambda k: F.greatest(F.get("low", F.lit(k)) - F.get("high2", F.lit(k)), F.get("low2", F.lit(k)) - F.get("high", F.lit(k)), F.lit(0.0))
    distance = F.lit(0.0)
    for k in range(width):
        distance = distance + apart(k) * apart(k)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    tasks = blocks.join(other, "dim").filter((F.col("i") <= F.col("j")) & (distance <= reach * reach)).select("dim", "i", "j")
    dealt = save(tasks.withColumn("part", F.explode(F.array_distinct(F.array("i", "j")))))

    rows = vectors.mapInPandas(deal, "dim int, key long, node long, vector array<double>")
    rows = rows.join(runs.select("dim", "key", "parts", "first"), ["dim", "key"]).withColumn("part", F.col("first") + F.pmod(F.xxhash64("node"), "parts"))
    rows = rows.select("dim", "part", "node", F.col("vector").cast(f"array<{kind}>").alias("vector")).join(dealt, ["dim", "part"])
    return rows.groupBy("dim", "i", "j").applyInPandas(run, "a long, b long").distinct()


def count_links(one: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """node, links: how many rows of other classes in its component each class links with directly."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("_n"))
    rows = groups.join(sizes, "component").join(one.select("node", "copies", "vector"), "node")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("component", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "node", "copies", "vector")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, copies = _unit(frame["vector"]), frame["copies"].to_numpy()
        own = frame["_b"].to_numpy()
        near = x @ x.T >= threshold
        near &= (own[:, None] != own[None]) if key[1] != key[2] else ~np.eye(len(x), dtype=bool)
        return pd.DataFrame({"node": frame["node"], "links": near @ copies})

    return rows.groupBy("component", "_i", "_j").applyInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept (vec_id = component_id). A row
    without vec_id takes the links and component of the rows that have its vector, if any, and counts for none of them.

    Equal vectors are linked with each other and share their links. Rows that link with nothing are
    their own component, rows that repeat a vec_id count as vectors of their own. Vectors of different
    length never link. An empty table gives an empty table; extra columns are left out.
    """
    rows, one = classes(vectors)
    # Floats stay floats: what is shuffled is the vector as given.
    kind = "float" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "double"
    groups = components(window_links(one, threshold, kind))
    links = count_links(one, groups, threshold)
    # Classes go by names of their own, as a vec_id may stand for several vectors; components take the smallest vec_id.
    named = groups.join(one.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("_least"))
    known = one.select("_k1", "_k2", "node", "least", "copies").join(groups, "node", "left").join(links, "node", "left").join(named, "component", "left")
    known = known.select(F.col("_k1").alias("_a"), F.col("_k2").alias("_b"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("_least", "least").alias("component_id"))
    out = rows.join(save(known), (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
