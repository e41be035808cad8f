"""Repair of conversations by a survivor-coalescence Viterbi.

A conversation's roles must read `(s?(ua)+)?` by their initials. Rows are kept, get
another role, are deleted, or have rows inserted before them; of the cheapest edits those
whose initials come first in ASCII are taken. A trellis of four states keeps the best
edits that end in each; they form a tree of backpointers with reference counts, and what
all survivors share is emitted at once, so that only the unresolved end is held.

Every row takes exactly one of K, R and D, and insertions stand before the row that they
lead to, so no two readings of the same rows are prefixes of one another. Comparing two
complete unresolved suffixes therefore comes down to where they first part, which a rank
among the survivors keeps; and the best edits of a long conversation can be put together
from those of its segments, for each state at either end.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import batches_of, checkpoint, table

#: Rows beyond which a conversation is cut into segments, and rows of a segment, about, at most.
LONG, SEGMENT = 1_000, 50_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user's, after an assistant's. What may be inserted, what closes.
STATES = range(4)
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
TAIL = ("", "II", "I", "")
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = ("su", "ua", "au")
#: At what cost a state (row) can do at most whatever another one (column) does: by insertions, and by deleting a system row that only the other may keep.
IMITATED = ((0, 0, 2, 4), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


@lru_cache(maxsize=64)
def options(initial: str, gone: bool, truncated: bool) -> tuple[tuple[int, int, int, str, str], ...]:
    """What can be done with a row: from state, to state, cost and (as key and as step) initials of the edits; the best for each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in STATES:
        q, inserted, seen = p, 0, set()
        while q not in seen:
            seen.add(q)
            ways = [(q, DELETE, "D")]
            if not gone:
                ways.append((NEXT[q][0], REROLE + TRUNCATED * truncated, "R"))
                if (q, initial) in KEPT:
                    ways.append((KEPT[q, initial], KEEP + TRUNCATED * truncated, "K"))
            for to, cost, edit in ways:
                way = (cost + INSERT * inserted, "I" * inserted + edit)
                best[p, to] = min(best.get((p, to), way), way)
            q, inserted = NEXT[q][0], inserted + 1
    return tuple((p, to, cost, edits, edits) for (p, to), (cost, edits) in best.items())


class Node:
    """A survivor's step: its parent, what it did, and how many steps or survivors stand on it."""

    __slots__ = ("parent", "step", "refs", "child")

    def __init__(self, parent: Node | None, step):
        self.parent, self.step, self.refs, self.child = parent, step, 0, None


class Trellis:
    """Survivors by state: cost, rank of what is unresolved, and the leaf of the backpointer tree."""

    def __init__(self, start: int):
        self.root = Node(None, None)
        self.root.refs = 1
        self.best: dict[int, tuple[int, int, Node]] = {start: (0, 0, self.root)}

    def feed(self, ways) -> list:
        """Takes what can be done with the next row (from, to, cost, key by which ties are decided, step); returns the steps that are now certain."""
        found: dict[int, tuple] = {}
        for p, q, cost, key, step in ways:
            if p in self.best:
                have, rank, leaf = self.best[p]
                way = (have + cost, rank, key, step, leaf)
                if q not in found or way[:3] < found[q][:3]:
                    found[q] = way
        # one that another state undercuts by more than it takes to imitate it can never win
        found = {q: x for q, x in found.items() if all(x[0] <= y[0] + IMITATED[p][q] for p, y in found.items())}
        ranks = {x: i for i, x in enumerate(sorted({x[1:3] for x in found.values()}))}
        old, self.best = self.best, {}
        for q, (cost, rank, key, step, leaf) in found.items():
            node = Node(leaf, step)
            node.refs = 1
            leaf.refs, leaf.child = leaf.refs + 1, node
            self.best[q] = (cost, ranks[rank, key], node)
        for _, _, leaf in old.values():
            self._drop(leaf)
        return self._resolved()

    def _drop(self, node: Node) -> None:
        """A survivor leaves node; what nothing stands on any more goes with it."""
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node, gone = node.parent, node
            node.refs -= 1
            if node.child is gone:
                node.child = None

    def _resolved(self) -> list:
        """The steps from the root that all survivors share."""
        out, leaves = [], {id(x[2]) for x in self.best.values()}
        while self.root.refs == 1 and id(self.root) not in leaves:
            if self.root.child is None:  # the last one that came went: all survivors stand on the one that is left
                node = next(iter(self.best.values()))[2]
                while node is not self.root:
                    node.parent.child, node = node, node.parent
            self.root = self.root.child
            self.root.parent = None
            out.append(self.root.step)
        return out

    def path(self, state: int) -> list:
        """The unresolved steps of a survivor."""
        out, node = [], self.best[state][2]
        while node is not self.root:
            out.append(node.step)
            node = node.parent
        return out[::-1]

    def finish(self) -> tuple[int, int, list, str]:
        """Cost, state, unresolved steps and closing insertions of the best survivor."""
        cost, _, tail, state = min((c + INSERT * len(TAIL[q]), rank, TAIL[q], q) for q, (c, rank, _) in self.best.items())
        return cost, state, self.path(state), tail


class Edits:
    """Applies edits to rows in order and hands on the repaired ones."""

    def __init__(self, state: int, put: Callable[[str, str], None]):
        self.state, self.put = state, put

    def _insert(self) -> None:
        self.state, role = NEXT[self.state]
        self.put(role, "")

    def apply(self, step: str, role: str, text: str) -> None:
        for _ in step[:-1]:
            self._insert()
        if step[-1] == "R":
            self.state, role = NEXT[self.state]
            self.put(role, text)
        elif step[-1] == "K":
            self.state = KEPT[self.state, role[:1]]
            self.put(role, text)

    def close(self, tail: str) -> None:
        for _ in tail:
            self._insert()


class Counts:
    """What a conversation's rows show before they are repaired; parts of it can be put together in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, initial: str, turn: int | None, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.then(initial, initial, turn, turn, int(turn is not None), 0)

    def then(self, first: str, last: str, low: int | None, high: int | None, turns: int, illegal: int) -> None:
        """Goes on with rows in the order of their turns."""
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.first = first if self.first is None else self.first
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def faults_of(blank: bool, duplicate: bool, truncated: bool) -> str:
    return "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""


def steps_in(audit: str) -> list[str]:
    """Edits' initials cut behind each row's."""
    out, at = [], 0
    for i, c in enumerate(audit):
        if c != "I":
            out.append(audit[at : i + 1])
            at = i + 1
    return out


REPORT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
MESSAGE_SQL = "conv_id long, part long, place long, role string, text string"


def in_turn() -> list:
    """The order of a conversation's rows."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]


class Digest:
    """SHA-256 of rows joined by line feeds, as they come."""

    def __init__(self):
        self.made, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.piece(f"{role}:{text}")

    def piece(self, text: str) -> None:
        self.made.update((("\n" if self.begun else "") + text).encode("utf-8", "surrogatepass"))
        self.begun = True


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 500, wide: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many rows and about so many characters at most."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or n >= wide:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _whole(messages: bool) -> Callable:
    """Repairs conversations that come one after the other, each whole and in order."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        none = object()
        now, at = none, None

        def begin(conv):
            nonlocal now, trellis, counts, digest, edits, pending, seen, audit, out
            now, trellis, counts, digest, pending, seen, audit, out = conv, Trellis(0), Counts(), Digest(), deque(), set(), [], []
            edits = Edits(0, (lambda role, text: out.append((role, text))) if messages else digest.put)

        def settle(steps):
            for step in steps:
                edits.apply(step, *pending.popleft())
                audit.append(step)

        def end():
            cost, _, steps, tail = trellis.finish()
            settle(steps)
            edits.close(tail)
            if not messages:
                yield (now, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, "".join(audit) + tail, digest.made.hexdigest())
            yield from given()

        def given():
            nonlocal at
            for role, text in out:
                yield (now, 0, at, role, text)
                at += 1
            out.clear()

        trellis = counts = digest = edits = pending = seen = audit = out = None
        for conv, turn, role, text, key, blank, cut, gone in rows_of(batches, "conv_id", "turn", "role", "text", "digest", "blank", "cut", "gone"):
            if now is none or conv != now:
                if now is not none:
                    yield from end()
                begin(conv)
                at = 0
            if gone:
                continue
            fault = faults_of(blank, (role, key) in seen, cut)
            seen.add((role, key))
            counts.add(role[:1], turn, fault)
            pending.append((role, text))
            settle(trellis.feed(options(role[:1], fault in ("blank", "duplicate"), fault == "truncated")))
            yield from given()
        if now is not none:
            yield from end()

    schema = MESSAGE if messages else REPORT
    return lambda batches: batched(repaired(batches), schema)


#: A segment: where it is, what its rows show, and for each two states at its ends cost, rank and edits.
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
SEGMENTS_SQL = "conv_id long, part long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, ranks array<long>, audits array<string>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best edits of each segment, from each state to each."""

    def made() -> Iterator[tuple]:
        now = None

        def end():
            found = {}
            for p, trellis in enumerate(trellises):
                for q, (cost, _, _) in trellis.best.items():
                    found[p, q] = (cost, "".join(said[p] + trellis.path(q)))
            ranks = {a: i for i, a in enumerate(sorted({a for _, a in found.values()}))}
            each = [found.get((p, q)) for p in STATES for q in STATES]
            yield (*now, counts.blank, counts.duplicate, counts.truncated, counts.illegal, counts.turns, counts.low, counts.high, counts.first, counts.last, [x and x[0] for x in each], [x and ranks[x[1]] for x in each], [x and x[1] for x in each])

        for conv, part, turn, initial, blank, duplicate, cut in rows_of(batches, "conv_id", "part", "turn", "initial", "blank", "duplicate", "cut"):
            if (conv, part) != now:
                if now is not None:
                    yield from end()
                now, counts, trellises, said = (conv, part), Counts(), [Trellis(p) for p in STATES], [[] for _ in STATES]
            fault = faults_of(blank, duplicate, cut)
            counts.add(initial, turn, fault)
            ways = options(initial, fault in ("blank", "duplicate"), fault == "truncated")
            for p in STATES:
                said[p] += trellises[p].feed(ways)
        if now is not None:
            yield from end()

    return batched(made(), SEGMENTS, 8)


CHOSEN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("tail", pa.string()), ("cost", pa.int64())])
CHOSEN_SQL = "conv_id long, part long, start long, end long, tail string, cost long"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which states each segment of a conversation begins and ends in; the last one has what closes it and the whole cost."""

    def made() -> Iterator[tuple]:
        none = object()
        now, trellis, parts, held = none, None, deque(), []

        def end():
            cost, _, steps, tail = trellis.finish()
            steps = held + steps
            for i, (p, q) in enumerate(steps):
                last = i == len(steps) - 1
                yield (now, parts.popleft(), p, q, tail if last else "", cost if last else 0)

        for conv, part, costs, ranks in rows_of(batches, "conv_id", "part", "costs", "ranks"):
            if now is none or conv != now:
                if now is not none:
                    yield from end()
                now, trellis, held = conv, Trellis(0), []
            parts.append(part)
            ways = [(p, q, costs[4 * p + q], ranks[4 * p + q], (p, q)) for p in STATES for q in STATES if costs[4 * p + q] is not None]
            held += trellis.feed(ways)
            for p, q in held[:-1]:  # the last one may have to say what closes the conversation
                yield (now, parts.popleft(), p, q, "", 0)
            held = held[-1:]
        if now is not none:
            yield from end()

    return batched(made(), CHOSEN)


PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.string())])


def _pieces(messages: bool) -> Callable:
    """Applies each segment's edits to its rows: its repaired rows, or its repaired text (null if none is left)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, at = None, 0
        for conv, part, place, role, text, start, audit in rows_of(batches, "conv_id", "part", "place", "role", "text", "start", "audit"):
            if place < 0:  # the edits, which come before the rows
                if now is not None and not messages:
                    yield (*now, "\n".join(out) if out else None)
                now, at, out, steps, row = (conv, part), 0, [], steps_in(audit), 0
                tail = audit[len("".join(steps)) :]
                put = (lambda r, t: out.append((r, t))) if messages else (lambda r, t: out.append(f"{r}:{t}"))  # noqa: B023
                edits = Edits(start, put)
            else:
                edits.apply(steps[row], role, text)
                row += 1
                if row == len(steps):
                    edits.close(tail)
                if messages:
                    for r, t in out:
                        yield (*now, at, r, t)
                        at += 1
                    out.clear()
        if now is not None and not messages:
            yield (*now, "\n".join(out) if out else None)

    schema = MESSAGE if messages else PIECES
    return lambda batches: batched(made(batches), schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report from a conversation's segments in order; its text goes through the hash piece by piece."""

    def made() -> Iterator[tuple]:
        none = object()
        now = none

        def end():
            yield (now, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, "".join(audit), digest.made.hexdigest())

        names = ("conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "cost", "audit", "piece")
        for conv, blank, duplicate, truncated, illegal, turns, low, high, first, last, paid, edits, piece in rows_of(batches, *names):
            if now is none or conv != now:
                if now is not none:
                    yield from end()
                now, counts, digest, audit, cost = conv, Counts(), Digest(), [], 0
            counts.blank, counts.duplicate, counts.truncated = counts.blank + blank, counts.duplicate + duplicate, counts.truncated + truncated
            counts.then(first, last, low, high, turns, illegal)
            cost += paid
            audit.append(edits)
            if piece is not None:
                digest.piece(piece)
        if now is not none:
            yield from end()

    return batched(made(), REPORT)


def _long(rows: DataFrame, n: int, messages: bool, segment: int) -> DataFrame:
    """Repairs n rows of conversations that are cut into segments, by ranges of their order."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // segment))
    # equal rows may lie in any order, so they can be dealt out
    spread = (F.monotonically_increasing_id() % 1024).alias("_spread")
    dealt = rows.where("not gone").select("*", spread).repartitionByRange(parts, *in_turn(), "_spread").sortWithinPartitions(*in_turn())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(range(at, at + batch.num_rows), pa.int64())]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "place"])

    columns = dealt.select("conv_id", "turn", "role", "text", "digest", "blank", "cut")
    placed = checkpoint(columns.mapInArrow(numbered, "conv_id long, turn long, role string, text string, digest string, blank boolean, cut boolean, part long, place long"))
    # the first of equal rows, reduced within tasks before it is shuffled
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "place")).alias("_x")).select(F.col("_x.part").alias("part"), F.col("_x.place").alias("place"), F.lit(False).alias("duplicate"))
    light = placed.select("conv_id", "part", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "cut").join(firsts, ["part", "place"], "left")
    light = light.withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))
    segments = checkpoint(light.repartition(parts, "part").sortWithinPartitions("part", "place").mapInArrow(_segments, SEGMENTS_SQL))
    in_order = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    chosen = in_order(segments.select("conv_id", "part", "costs", "ranks")).mapInArrow(_chosen, CHOSEN_SQL)
    s = segments.withColumnRenamed("conv_id", "_conv").withColumnRenamed("part", "_part")
    both = chosen.join(s, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("audit", F.concat(F.get("audits", (4 * F.col("start") + F.col("end")).cast("int")), "tail"))
    edits = checkpoint(both.select("conv_id", "part", "start", "cost", "audit", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last"))
    null = lambda kind: F.lit(None).cast(kind)
    told = edits.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), null("string").alias("role"), null("string").alias("text"), "start", "audit")
    said = placed.select("conv_id", "part", "place", "role", "text", null("long").alias("start"), null("string").alias("audit"))
    # a conversation's rows of one part are in order of place, and its edits come before them
    begun = told.unionByName(said).repartition(parts, "part").sortWithinPartitions("part", F.col("conv_id").asc_nulls_first(), "place")
    if messages:
        return begun.mapInArrow(_pieces(True), MESSAGE_SQL)
    pieces = checkpoint(begun.mapInArrow(_pieces(False), "conv_id long, part long, piece string"))
    p = pieces.withColumnRenamed("conv_id", "_conv").withColumnRenamed("part", "_part")
    whole = edits.join(p, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_part")
    return in_order(whole).mapInArrow(_joined, REPORT_SQL)


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, blank, cut (no end of a sentence) and gone (false unless rows have it)."""
    space = F.lit(" \t\n\x0b\x0c\r")
    ended = F.rtrim(F.col("text"), space)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    return plain.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"), (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"), "gone")


def repair(rows: DataFrame, messages: bool = False, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """A report for each conversation, or its repaired rows (conv_id, part, place, role, text).

    rows: conv_id, turn, role, text and perhaps gone, which marks rows that are there only
    so that their conversation has a report; other columns do not matter. A conversation's
    rows are taken by turn, null ones first; rows of one turn by role and the MD5 of their
    text. A null role or text counts as one space; rows of a null conv_id are one
    conversation. The first fault of a row counts: blank, duplicate (role and text stood
    in the conversation before), truncated (does not end like a sentence). A conversation
    without rows has zeros, no edits, and the hash of an empty text. Of an empty table
    nothing is returned. Repaired rows are in order of part, then place.

    Conversations of up to `long` rows are repaired whole in one pass. Longer ones are
    dealt out as segments by ranges of their order; each segment's best edits between any
    two states are found by themselves, segments are chosen by their costs and ranks
    alone, then edited by themselves. Only the hash runs over such a conversation's whole
    text, piece by piece in one task, as SHA-256 has no other way.
    """
    spark = rows.sparkSession
    made = marked(rows)
    sizes = checkpoint(rows.groupBy(F.col("conv_id").cast("long").alias("_conv")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > long))
    totals = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    columns, schema = ("conv_id", "turn", "role", "text", "digest", "blank", "cut", "gone"), MESSAGE_SQL if messages else REPORT_SQL
    with batches_of(spark, 1000):
        few = made
        if totals[0]:
            # conversations over the limit are no more than rows / limit
            big = F.broadcast(sizes.select("_conv")) if totals[0] <= 100_000 else sizes.select("_conv")
            same = F.col("conv_id").eqNullSafe(F.col("_conv"))
            few = made.join(big, same, "left_anti")
            lot = made.join(big, same, "left_semi")
        short = few.select(*columns).repartition("conv_id").sortWithinPartitions(*in_turn()).mapInArrow(_whole(messages), schema)
        if not totals[0]:
            return checkpoint(short)
        found = _long(lot, totals[1], messages, segment)
        if messages:
            return checkpoint(short.unionByName(found))
        # a long conversation may have lost all its rows
        zero = sizes.select(F.col("_conv").alias("conv_id"), *[F.lit(0).cast("long").alias(f.name) for f in REPORT if f.name not in ("conv_id", "audit", "repaired_sha256")], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
        found = checkpoint(found)
        lost = zero.join(found.select(F.col("conv_id").alias("_conv")), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
        return checkpoint(short.unionByName(found).unionByName(lost))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped (marked as gone), emptied, cut, repeated and given to the user, by a hash of conv_id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    plain = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), twice.alias("_copy")).drop("_copy")


def op13(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The trellis as a recursive query: a row of four states a conversation and place. crc32 by its table.
OP13_SQL = r"""
with recursive
bits as (select i, 0 as k, i::bigint as v from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as t from bits where k = 8),
original as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hashed as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ord(c)::bigint)),
                         lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1])), 4294967295) % 20 as kind
  from original, crc),
bad as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from hashed),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i from bad),
told as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core,
         row_number() over (partition by conv_id, role, text order by i) > 1 as again,
         lag(left(role, 1)) over (partition by conv_id order by i) as prior
  from placed),
faults as (
  select *, case when core = '' then 'blank' when again then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from told),
-- from a state: the one that an insertion leads to, and the row that it puts in
moves as (
  select p, q, ins, said from (values
    (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
    (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])) m(p, q, ins, said)),
acts as (
  select conv_id, i, m.p, case act when 'D' then m.q when 'R' then case when m.q = 2 then 3 else 2 end
              else case left(role, 1) when 's' then 1 when 'u' then 2 else 3 end end as q,
         2 * length(ins) + case act when 'D' then 3 when 'R' then 2 else 0 end + case when act <> 'D' and fault = 'truncated' then 1 else 0 end as cost,
         ins || act as step,
         case act when 'D' then said when 'R' then list_append(said, case when m.q = 2 then 'assistant:' else 'user:' end || text) else list_append(said, role || ':' || text) end as rows_
  from faults, moves m, (values ('D'), ('R'), ('K')) a(act)
  where (act = 'D' or fault not in ('blank', 'duplicate'))
    and (act <> 'K' or (left(role, 1) = 's' and m.q = 0) or (left(role, 1) = 'u' and m.q in (0, 1, 3)) or (left(role, 1) = 'a' and m.q = 2))),
steps as (select conv_id, i, list({p: p, q: q, c: cost, s: step, r: rows_}) as ways from acts group by conv_id, i),
walk as (
  select conv_id, 0::bigint as i, [{q: 0, c: 0::bigint, a: '', r: []::varchar[]}] as best from (select distinct conv_id from faults)
  union all
  select w.conv_id, s.i,
         list_filter(list_transform(range(4), lambda q: list_min(
           list_transform(list_filter(flatten(list_transform(w.best, lambda b: list_transform(s.ways, lambda x: {b: b, x: x}))), lambda y: y.b.q = y.x.p and y.x.q = q),
             lambda y: {c: (y.b.c + y.x.c)::bigint, a: y.b.a || y.x.s, q: q::int, r: list_concat(y.b.r, y.x.r)}))), lambda v: v is not null)
         .list_transform(lambda v: {q: v.q, c: v.c, a: v.a, r: v.r})
  from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1),
final as (
  select conv_id, list_min(list_transform(best, lambda b: {c: b.c + case b.q when 1 then 4 when 2 then 2 else 0 end,
           a: b.a || case b.q when 1 then 'II' when 2 then 'I' else '' end,
           r: list_concat(b.r, case b.q when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else []::varchar[] end)})) as z
  from (select conv_id, best, row_number() over (partition by conv_id order by i desc) as k from walk) where k = 1),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (prior is not null and prior || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(z.c, 0)::bigint as cost,
       coalesce(z.a, '') as audit, sha256(coalesce(array_to_string(z.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join final f on f.conv_id is not distinct from o.conv_id
"""
