"""Near-duplicate embeddings: int8 tile products with error bounds, exact where they can't decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import batches_of, checkpoint
from tiermark.llm.components import components

#: Vectors of a tile, about; vectors that the grid's directions are fitted on, at most; directions at most.
TILE, SAMPLE, DIRECTIONS = 2048, 4096, 6
#: Rows of a block of a tile product, and pairs whose cosines are computed at once.
BLOCK, PAIRS = 1024, 1 << 16
#: More than rounding can add to a bound.
MARGIN = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are scaled by their largest component first, so that no square overflows."""
    y = x / np.abs(x).max(axis=1)[:, None]
    return y / np.linalg.norm(y, axis=1)[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, and the length of what each row loses by it."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def decided(x: Quantised, y: Quantised, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers i, j of pairs possibly above the threshold, block by block, and which of them surely are.

    With x = x' + e and y = y' + f, |x.y - x'.y'| <= |e| |y'| + |f| |x'| + |e| |f|,
    and |x'| <= 1 + |e|. Codes are multiplied as floats wide enough to hold their sums
    exactly.
    """
    (cx, sx, ex), (cy, sy, ey) = x, y
    wide = np.float32 if cx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for p in range(0, len(cx), BLOCK):
        left, e = cx[p : p + BLOCK].astype(wide), ex[p : p + BLOCK, None]
        for q in range(0, len(cy), BLOCK):
            f = ey[q : q + BLOCK]
            near = (left @ cy[q : q + BLOCK].T.astype(wide)).astype(np.float64) * sx[p : p + BLOCK, None] * sy[q : q + BLOCK]
            bound = e * (1 + f) + f * (1 + e) + e * f + MARGIN
            i, j = np.nonzero(near + bound >= threshold)
            yield i + p, j + q, near[i, j] - bound[i, j] >= threshold


def verified(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs i, j of unit rows (double) have a cosine of at least the threshold."""
    good = [np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) >= threshold for k in range(0, len(i), PAIRS)]
    return np.concatenate(good) if good else np.zeros(0, bool)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of rows of x and y (double) with cosine >= threshold."""
    x, y = unit(x), unit(y)
    found = []
    for i, j, sure in decided(quantised(x), quantised(y), threshold):
        sure[~sure] = verified(x, y, i[~sure], j[~sure], threshold)
        found.append((i[sure], j[sure]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))


def _local(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links i-j reach within the tile pair."""
    least = np.arange(n)
    while True:
        new = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of vec_id, label, embedding that can link: a label, and finite components that are not all zero."""
    fine = "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    return vectors.where(fine)


def _directions(distinct: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each length of vectors, the main directions of a bounded sample."""
    rows = distinct.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    found = {}
    for dim, some in by.items():
        x = unit(np.array(some, dtype=np.float64))
        found[dim] = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))[1][:, ::-1][:, :most]
    return found


def _summed(nodes: np.ndarray, reps: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """node, n, a, b of what links i-j add to nodes: n linked vectors, and a link a-b of reps; no more rows than nodes."""
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, i, weights[j])
    np.add.at(n, j, weights[i])
    least = _local(len(nodes), i, j)
    yes = n > 0
    return pa.RecordBatch.from_arrays([pa.array(nodes[yes]), pa.array(n[yes]), pa.array(reps[yes]), pa.array(reps[least[yes]])], ["node", "n", "a", "b"])


def tile_links(distinct: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """node, n, a and b for vectors with links: n other vectors linked, found in one pair of tiles, and a link of reps.

    distinct: node, rep, copies, label, embedding, each vector once for a label. Unit
    vectors with cosine >= threshold are at most sqrt(2 - 2 threshold) apart, and so are
    their coordinates along any unit direction. So each label is cut into cells of that
    width along some main directions, more of them for more vectors; only neighbouring
    cells are compared. Cells are cut into tiles of about `tile` vectors by a hash, and
    a row is made for each pair of tiles: what it holds is bounded. Tiles hold int8
    codes; what these leave open names its vectors, and only those are fetched, in
    double. a and b join what is linked within the pair, in no more rows than vectors.
    """
    spark = distinct.sparkSession
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * 1.0001 + 1e-9
    count = distinct.count()
    most = max(0, min(DIRECTIONS, int(math.log(max(1.0, count / (8 * tile)), 4))))
    axes = _directions(distinct, most) if most else {}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = vectors.value_lengths().to_numpy()
            cells, codes = np.full(len(sizes), "", dtype=object), np.full(len(sizes), b"", dtype=object)
            scales, errors = np.zeros(len(sizes)), np.zeros(len(sizes))
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                x = unit(_matrix(vectors.take(pa.array(at)), len(at)))
                made, scales[at], errors[at] = quantised(x)
                codes[at] = [c.tobytes() for c in made]
                if dim in axes:
                    cells[at] = [",".join(map(str, g)) for g in np.floor(x @ axes[dim] / width).astype(int)]
            own = [batch.column(c) for c in ("node", "rep", "copies", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int32()), pa.array(cells, pa.string()), pa.array(codes, pa.binary()), pa.array(scales), pa.array(errors)], ["node", "rep", "copies", "label", "dim", "cell", "codes", "scale", "error"])

    schema = distinct.select("node", "rep", "copies", "label", F.lit(0).alias("dim"), F.lit("").alias("cell"), F.lit(b"").alias("codes"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("error")).schema
    with batches_of(spark, 4096):
        cut = checkpoint(distinct.mapInArrow(coded, schema))
    at = ["label", "dim", "cell"]
    per = cut.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / tile))
    tiles = cut.join(per, at).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    held = ["node", "rep", "copies", "codes", "scale", "error"]
    rows = tiles.groupBy(*at, "part").agg(F.collect_list(F.struct(*held)).alias("x"))
    rows = checkpoint(rows.select(*at, "part", *[F.col(f"x.{c}").alias(c) for c in held]))
    moves = [m for m in product((-1, 0, 1), repeat=most)]
    here = F.split("cell", ",")
    other = F.array(*[F.array_join(F.array(*[(F.get(here, F.lit(k)).cast("int") + d).cast("string") for k, d in enumerate(m)]), ",") for m in moves]) if most else F.array(F.lit(""))
    # a length without directions is one cell, without neighbours; one with fewer directions than most has cells with fewer places
    other = F.when(F.col("cell") == "", F.array(F.lit(""))).otherwise(F.array_distinct(other))
    left = rows.select("label", "dim", F.col("cell").alias("from"), F.col("part").alias("p"), *[F.col(c).alias(f"a_{c}") for c in held], F.explode(other).alias("cell")).where("cell >= from")
    right = rows.select(*at, F.col("part").alias("q"), *[F.col(c).alias(f"b_{c}") for c in held])
    pairs = left.join(right, at).where("cell > from or q >= p").select(F.expr("cell = from and p = q").alias("same"), *[f"{s}_{c}" for s in "ab" for c in held])

    def sides(one: pa.RecordBatch) -> tuple[list, list]:
        """What a pair's two tiles hold: nodes, reps and copies, and codes, scales and errors."""
        plain = [[one.column(f"{s}_{c}").flatten().to_numpy() for c in held if c != "codes"] for s in "ab"]
        made = []
        for s, (nodes, *_, scale, error) in zip("ab", plain, strict=True):
            raw = b"".join(one.column(f"{s}_codes").flatten().to_pylist())
            made.append((np.frombuffer(raw, np.int8).reshape(len(nodes), -1), scale, error))
        return plain, made

    def product_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                (a, b), (x, y) = sides(one)
                same, cut_at = one.column("same")[0].as_py(), len(a[0])
                links, open_a, open_b = [], [], []
                for i, j, sure in decided(x, y, threshold):
                    if same:
                        i, j, sure = i[i < j], j[i < j], sure[i < j]
                    links.append((i[sure], j[sure]))
                    open_a.append(np.unique(i[~sure]))
                    open_b.append(np.unique(j[~sure]))
                i, j = (np.concatenate([x[k] for x in links]) for k in (0, 1))
                nodes, reps, copies = a[:3] if same else [np.concatenate([p, q]) for p, q in zip(a[:3], b[:3], strict=True)]
                by = np.argsort(reps, kind="stable")  # the smallest rep stands first
                place = np.empty_like(by)
                place[by] = np.arange(len(by))
                made = _summed(nodes[by], reps[by], copies[by], place[i], place[j if same else j + cut_at])
                need = [np.unique(np.concatenate(x)) for x in ((open_a + open_b, open_a + open_b) if same else (open_a, open_b))]
                need = [a[0][need[0]], b[0][need[1]]]
                n = made.num_rows
                if n or len(need[0]):
                    lists = [pa.array([None] * n + [x.tolist()] * bool(len(need[0])), pa.list_(pa.int64())) for x in need]
                    pad = lambda c, n=n, more=bool(len(need[0])): pa.concat_arrays([c, pa.nulls(int(more), pa.int64())])
                    yield pa.RecordBatch.from_arrays([*map(pad, made.columns), pa.array([None] * n + [same] * bool(len(need[0])), pa.bool_()), *lists], ["node", "n", "a", "b", "same", "open_a", "open_b"])

    with batches_of(spark, 4):
        each = checkpoint(pairs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(product_, "node long, n long, a long, b long, same boolean, open_a array<long>, open_b array<long>"))
    known = each.where("node is not null").select("node", "n", "a", "b")
    opened = checkpoint(each.where("open_a is not null").select(F.monotonically_increasing_id().alias("pair"), "same", "open_a", "open_b"))
    wanted = opened.select("pair", "same", F.explode("open_a").alias("node"), F.lit(True).alias("first")).union(opened.select("pair", "same", F.explode("open_b").alias("node"), F.lit(False)))
    exact = wanted.join(distinct.select("node", "rep", "copies", "embedding"), "node")
    side = lambda yes: F.collect_list(F.when(F.col("first") == yes, F.struct("node", "rep", "copies", "embedding")))
    grouped = exact.groupBy("pair", "same").agg(side(True).alias("x"), side(False).alias("y"))

    def opened_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (nx, rx, wx, x), (ny, ry, wy, y) = ([np.array(v.values.field(f).to_numpy(zero_copy_only=False)) for f in ("node", "rep", "copies")] + [unit(_matrix(v.values.field("embedding"), len(v)))] for v in (batch.column("x")[k], batch.column("y")[k]))
                found = []
                for i, j, sure in decided(quantised(x), quantised(y), threshold):
                    left = ~sure & (nx[i] < ny[j]) if batch.column("same")[k].as_py() else ~sure
                    i, j = i[left], j[left]
                    good = verified(x, y, i, j, threshold)
                    found.append((nx[i[good]], ny[j[good]]))
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                nodes, first = np.unique(np.concatenate([nx, ny]), return_index=True)
                reps, weights = np.concatenate([rx, ry])[first], np.concatenate([wx, wy])[first]
                by = np.argsort(reps, kind="stable")
                place = np.empty_like(by)
                place[by] = np.arange(len(by))
                yield _summed(nodes[by], reps[by], weights[by], place[np.searchsorted(nodes, i)], place[np.searchsorted(nodes, j)])

    with batches_of(spark, 4):
        return known.union(checkpoint(grouped.mapInArrow(opened_, "node long, n long, a long, b long")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors.

    vectors: vec_id, embedding (array of numbers), label; other columns do not matter.
    Rows link if their labels are equal, not null, and their cosine in double
    precision is at least threshold. Vectors that are null, empty or zero or hold null
    or non-finite components link with nothing, nor do vectors of different lengths.
    Equal vectors of a label are compared once; each copy is a link. A vec_id that is
    repeated counts as so many vectors, of one component. An empty table gives an
    empty one. Components are named by their smallest vec_id.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = usable(plain)
    distinct = checkpoint(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    found = tile_links(distinct, threshold)
    # a vec_id may stand for several vectors, of one label or of several
    same = good.join(distinct, ["label", "embedding"]).select("vec_id", "node", "rep", "copies")
    links = found.select("a", "b").union(same.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    named = components(links)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    direct = same.join(counts, "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = plain.select("vec_id").join(direct, "vec_id", "left").join(named.withColumnRenamed("node", "_node"), F.col("vec_id") == F.col("_node"), "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
