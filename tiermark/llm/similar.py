"""Near-duplicates of a given shingle similarity: exact Jaccard verifies what shared min-hash bands suggest.

Blocks of a fingerprint find pairs that differ in a few bits. At a similarity of 0.8 two
texts differ in about 15 % of the bits, and blocks that such a pair surely shares would
have four bits. So pairs are found by bands of min-hashes, besides the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint, small_batches
from tiermark.llm.components import components
from tiermark.llm.embedding_dedup import _local
from tiermark.llm.simhash import SEED, _key

#: Bands of min-hashes and hashes of a band: two texts of similarity 0.8 share a band with a chance of 0.998.
BANDS, ROWS = 20, 6
#: A bucket of more texts than this is compared within tasks, by pairs of tiles, so that its pairs are no rows.
BUCKET = 16
#: Texts of a tile, and hashes of all its texts, about.
TILE, HASHES = 256, 1 << 18
#: Standard deviations by which a pair's bits may differ more than is expected of the similarity. The bits only
#: spare the exact comparison of what is far from it: a pair at the similarity is lost with a chance of 0.00003.
SLACK = 4
WIDE = 4
#: Bits of a filter of names for each name, and the power of two that they are at most; past that it lets more through.
BITS, MOST = 16, 25

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def most_bits(similarity: float) -> int:
    """The bits of 256 in which two texts of that Jaccard similarity differ, with some slack."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WIDE
    return round(n * share + SLACK * math.sqrt(n * share * (1 - share)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def hashes(text: str | None, width: int) -> np.ndarray:
    """The hash of each word shingle of a text, in its order; a text of fewer words than width is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = zip(*(found[i:] for i in range(width)), strict=False) if len(found) > width else [found] if found else []
    return np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)


def digest(h: np.ndarray) -> list[int]:
    """128 bits that name a set of shingles (its sorted hashes), as two signed numbers; zero for none."""
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=">i8").tolist() if len(h) else [0, 0]


def signature(text: str | None, width: int) -> tuple[list[int], list[int]]:
    """A text's SimHash, the wide SimHash of its set of word shingles, and its bands' keys, as signed numbers.

    First come the five numbers of the SimHashes, then the keys; without words all bits are zero and there are no bands.
    """
    every = hashes(text, width)
    return _signed(every, np.unique(every))


def _signed(every: np.ndarray, h: np.ndarray) -> tuple[list[int], list[int]]:
    """The signature of a text with these hashes; h: each once, sorted."""
    if not len(every):
        return [0] * (1 + WIDE), []
    plain = sum(_ones(every[i : i + 4096]) for i in range(0, len(every), 4096))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros((WIDE, 64), np.int64)
    for i in range(0, len(h), 2048):
        part = h[i : i + 2048]
        for k in range(WIDE):
            ones[k] += _ones(_mixed(part, k))
        low = np.minimum(low, _high(part).min(axis=1))
    bits = np.concatenate([2 * plain[None] > len(every), 2 * ones > len(h)])
    wide = np.frombuffer(np.packbits(bits, axis=1).tobytes(), dtype=">i8").tolist()
    raw = low.tobytes()
    size = 8 * ROWS
    bands = [xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)]
    return wide, [b - (1 << 64) if b >= 1 << 63 else b for b in bands]


def _high(part: np.ndarray) -> np.ndarray:
    """Each min-hash function's values: the product's low bits are weak, so its high ones are put to the front and mixed in."""
    x = _MULTIPLY[:, None] * part[None] + _ADD[:, None]
    return x ^ (x >> np.uint64(32))


def _named(docs: DataFrame) -> DataFrame:
    """Adds _t and _u, two hashes of doc_id and text, by which a row is found again; null ids and texts have theirs."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    return docs.withColumn("_t", F.xxhash64(*parts)).withColumn("_u", F.xxhash64(F.lit(1), *parts))


def told_apart(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of rows whose names may be among names, and those whose names surely are not; rows are not shuffled.

    rows and names have _t and _u. Each name sets the bit that its first digits point to,
    and the bits, 64 in a row, are sent to all tasks. They are bounded in number, so more
    names let more rows through, but none that is named is ever missed.
    """
    size = min(MOST, max(10, (names.count() * BITS - 1).bit_length()))
    at = F.shiftrightunsigned("_t", 64 - size)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_t, {64 - size}) & 63 as int))")
    bits = checkpoint(names.groupBy(F.shiftright(at, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    held = (F.shiftright(at, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(bits), held, "left_semi"), rows.join(F.broadcast(bits), held, "left_anti")


def marked(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, _t, _u, component_id and kept for each row of docs, as in similar_groups; kept: it is its group's first row.

    A group's first row is the one of the smallest doc_id, null last, and hash.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [hashes(x, width) for x in batch.column("text").to_pylist()]
            sets = [np.unique(x) for x in every]
            made = [_signed(x, h) for x, h in zip(every, sets, strict=True)]
            numbers = [[*digest(h), len(h), *w] for h, (w, _) in zip(sets, made, strict=True)]
            columns = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(4 + WIDE)]
            own = [batch.column(c) for c in ("doc_id", "_t", "_u")]
            yield pa.RecordBatch.from_arrays([*own, *columns, pa.array([b for _, b in made], pa.list_(pa.int64()))], ["doc_id", "_t", "_u", *same, *about, "bands"])

    same, names = ["d0", "d1"], [f"w{k}" for k in range(WIDE)]
    about = ["size", "fp", *names]
    plain = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    each = checkpoint(plain.select("doc_id", "_t", "_u", "text").mapInArrow(of, f"doc_id long, _t long, _u long, {', '.join(f'{n} long' for n in [*same, *about])}, bands array<long>"))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t", "_u")
    first = F.min_by(F.struct(*about, "bands"), lead)
    # a node is a number of its own: an id may stand for several texts, and rows may have none
    reps = each.groupBy(*same).agg(F.min(lead).alias("lead"), first.alias("x")).select(*same, "lead", *[f"x.{c}" for c in [*about, "bands"]])
    reps = checkpoint(reps.withColumn("rep", F.monotonically_increasing_id()))
    cuts = [0, 16, 32, 48, 64]
    blocks = [F.xxhash64(F.lit(i), _key(F.col("fp"), c, cuts)) for i, c in enumerate(combinations(range(4), 2))]
    keys = reps.where("size > 0").select("rep", "d0", "size", F.explode(F.concat("bands", F.array(*blocks))).alias("key"))
    members = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep", "d0")).alias("who")]
    sizes = keys.groupBy("key").agg(*members).where("n > 1").groupBy("n", "total", "first", "last", "who").agg(F.min("key").alias("key"))
    shared = checkpoint(keys.join(sizes.select("key", "n", "total"), "key"))
    some = shared.where(F.col("n") <= BUCKET).select("key", "rep")
    candidates = some.withColumnRenamed("rep", "a").join(some.withColumnRenamed("rep", "b"), "key").where("a > b").select("a", "b").distinct()
    crowd = shared.where(F.col("n") > BUCKET)
    side = lambda s: reps.select(F.col("rep").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in about])
    bits = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names[1:]), F.bit_count(F.col(f"a_{names[0]}").bitwiseXOR(F.col(f"b_{names[0]}"))))
    alike = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(similarity) - 1e-6
    likely = checkpoint(candidates.join(side("a"), "a").join(side("b"), "b").where(alike & (bits <= most_bits(similarity))).select("a", "b"))
    needed = likely.select(F.col("a").alias("rep")).union(likely.select(F.col("b").alias("rep"))).union(crowd.select("rep")).distinct()
    sets = shingle_sets(plain, checkpoint(reps.select("rep", "d0", "lead").join(needed, "rep").select("rep", "d0", "lead._t", "lead._u")), width)
    links = verified(likely, sets, similarity).union(crowd_links(crowd, sets, similarity))
    found = components(links)
    of_set = checkpoint(reps.join(found, F.col("rep") == F.col("node"), "left").select(*same, "lead", F.coalesce("component", "rep").alias("component")))
    leads = of_set.groupBy("component").agg(F.min("lead").alias("first"))
    named = of_set.join(leads, "component").select(*same, "first")
    rows = each.join(named, same)
    kept = (F.col("_t") == F.col("first._t")) & (F.col("_u") == F.col("first._u"))
    return rows.select("doc_id", "_t", "_u", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of the near-duplicates, for each row of docs.

    docs: doc_id, text; other columns do not matter. Texts whose sets of word shingles
    have a Jaccard similarity of at least `similarity` are linked: those that share a
    band, or a SimHash but for two bits, and whose sets, compared exactly, are that
    similar. Pairs whose sizes or 256-bit SimHashes rule it out are not compared. Texts
    with equal sets are one from the start, so large groups of copies make no pairs; a
    large bucket is cut into tiles and each pair of tiles compared whole in a task, which
    returns no more links than texts. Buckets of the same texts are compared once.
    A null text counts as an empty one; texts without words are one group. A row without
    a doc_id is in a group like any other; component_id is null if none of it has one.
    Rows of one doc_id but of different texts are different documents. An empty table
    gives an empty one.
    """
    return marked(docs, width, similarity).select("doc_id", "component_id")


def shingle_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep, d0 and hashes (the sorted hashes of its shingles) of each of reps, whose texts are made of docs again.

    docs: text, _t, _u; reps: rep, d0, _t, _u, each name once. Texts that none of reps names are not shuffled.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(x, width)).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("d0"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "d0", "hashes"])

    small_batches(docs.sparkSession)
    # rows that repeat an id and its text give the same set
    once = told_apart(docs.select("_t", "_u", "text"), reps)[0].dropDuplicates(["_t", "_u"])
    return checkpoint(once.join(reps, ["_t", "_u"]).select("rep", "d0", "text").mapInArrow(of, "rep long, d0 long, hashes array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have a Jaccard similarity of at least `similarity`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(s) for s in ("x", "y")), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both / (len(p) + len(q) - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    small_batches(pairs.sparkSession, 32)
    side = lambda s, h: sets.select(F.col("rep").alias(s), F.col("hashes").alias(h))
    return checkpoint(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(of, "a long, b long").distinct())


def overlaps(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many hashes each set of one tile shares with each of another. x, y: the sets end to end; p, q: their sizes."""
    rows, others = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)
    known = np.intersect1d(x, y)
    both = np.zeros((len(p), len(q)))
    if not len(known):
        return both
    i, j = np.searchsorted(known, x).clip(max=len(known) - 1), np.searchsorted(known, y).clip(max=len(known) - 1)
    yes, fine = known[i] == x, known[j] == y
    i, rows, j, others = i[yes], rows[yes], j[fine], others[fine]
    for k in range(0, len(known), 4096):
        a, b = np.zeros((len(p), 4096), np.float32), np.zeros((len(q), 4096), np.float32)
        here, there = (i >= k) & (i < k + 4096), (j >= k) & (j < k + 4096)
        a[rows[here], i[here] - k] = 1
        b[others[there], j[there] - k] = 1
        both += a @ b.T
    return both


def crowd_links(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all members of a bucket whose sets have a Jaccard similarity of at least `similarity`.

    crowd: key, n, total, rep, d0, the members of buckets, how many their bucket has, and
    hashes it has. Each bucket is cut into tiles, and every two of them are compared
    whole; a pair of tiles returns a spanning forest of its links.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, flat = ([batch.column(f"{s}_{c}")[k].values.to_numpy() for s in "ab"] for c in ("ids", "sizes", "flat"))
                both = overlaps(flat[0], sizes[0], flat[1], sizes[1])
                i, j = np.nonzero(both / (sizes[0][:, None] + sizes[1] - both) >= similarity)
                nodes, at = np.unique(np.concatenate(ids), return_inverse=True)
                least = _local(len(nodes), at[i], at[j + len(ids[0])])
                yes = least != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[yes]), pa.array(nodes[least[yes]])], ["a", "b"])

    spark = crowd.sparkSession
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("total") / HASHES))
    cut = crowd.withColumn("part", F.pmod(F.xxhash64("rep", "d0"), parts)).join(sets, ["rep", "d0"])
    tiles = cut.groupBy("key", "part").agg(F.collect_list(F.struct("rep", F.size("hashes").cast("long").alias("size"), "hashes")).alias("x"))
    tiles = checkpoint(tiles.select("key", "part", F.col("x.rep").alias("ids"), F.col("x.size").alias("sizes"), F.flatten("x.hashes").alias("flat")))
    side = lambda s: tiles.select("key", F.col("part").alias(f"{s}_part"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "sizes", "flat")])
    pairs = side("a").join(side("b"), "key").where("a_part <= b_part").drop("key", "a_part", "b_part")
    small_batches(spark, 4)
    return checkpoint(pairs.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(of, "a long, b long").distinct())


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near-duplicates, that of the smallest doc_id.

    Rows are grouped as in similar_groups; of rows that repeat a doc_id and its text, one
    is kept. Columns are those of docs. Rows that a filter tells from all that go or are
    repeated stay where they are; only the others are shuffled, and decided by their names.
    """
    names = marked(docs, width, similarity).groupBy("_t", "_u").agg(F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    doubtful = checkpoint(names.where("not _kept or _n > 1").select(F.col("_t").alias("_kt"), F.col("_u").alias("_ku"), "_kept"))
    rows = _named(docs.select(F.struct("*").alias("_row"), "doc_id", "text")).select("_row", "_t", "_u")
    some, clear = told_apart(rows, doubtful.withColumnsRenamed({"_kt": "_t", "_ku": "_u"}))
    known = some.dropDuplicates(["_t", "_u"]).join(doubtful, (F.col("_t") == F.col("_kt")) & (F.col("_u") == F.col("_ku")), "left")
    return clear.select("_row").union(known.where("_kept is null or _kept").select("_row")).select("_row.*")
