"""Secret scans: plain patterns, and a character convolutional network over candidates in context."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint, small_batches

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: What a candidate of some known use looks like, which is no secret: numbers, dates and network addresses, names of hosts and files, words.
PLAIN = re.compile(r"[0-9.+/_=-]+|[.+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,2}|[0-9]{1,6})(?:[.+/_=-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,2}|[0-9]{1,6}))*[.+/_=-]*")
#: Words that announce a secret, with what stands between it and them.
CUE = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?\Z""", re.I | re.A)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# How keys of known services begin, the characters that follow, and how many.
FORMATS = (
    ("", "0123456789abcdef", 24), ("", "0123456789ABCDEF", 32), ("", LOWER + DIGITS, 28), ("", UPPER + "234567", 32), ("", LOWER + UPPER + DIGITS, 22), ("", LOWER + UPPER + DIGITS, 40), ("", LOWER + UPPER + DIGITS + "+/", 44), ("", LOWER + UPPER, 32),
    ("AKIA", UPPER + DIGITS, 16), ("ghp_", LOWER + UPPER + DIGITS, 36), ("sk_live_", LOWER + UPPER + DIGITS, 24), ("xoxb-", DIGITS + "-" + LOWER + UPPER, 40), ("AIza", LOWER + UPPER + DIGITS + "-_", 35), ("glpat-", LOWER + UPPER + DIGITS, 20), ("npm_", LOWER + UPPER + DIGITS, 36), ("eyJ", LOWER + UPPER + DIGITS + "-_", 60),
)
#: Characters of a candidate's window: before it, of it and after it.
BEFORE, INSIDE, AFTER = 24, 40, 16
#: The network is fitted on findings in this many documents, the first by hash, and on so many windows of each label at most.
SAMPLE_DOCS, SAMPLE_EACH = 20_000, 4_000
#: Windows made of each finding, and numbers and addresses made of it as examples of what is none.
MADE, NONE = 12, 4
#: Share of held-out findings that the threshold must reach, and the least probability it may have.
RECALL, LEAST = 0.99, 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; leftmost matches that do not overlap, for each kind."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def other_candidates(text: str, base: list[tuple[int, int, int]], beyond: bool) -> list[tuple[int, int]]:
    """Long tokens apart from the base spans; beyond: also those that overlap some, but lie in none."""
    every = [m.span() for m in CANDIDATE.finditer(text)]
    if not base:
        return every
    starts, upto = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    # of the spans that begin before a place, whether the one that ends last ends after another
    after = lambda n, place: n > 0 and upto[n - 1] > place
    if beyond:
        return [(s, e) for s, e in every if not after(bisect_right(starts, s), e - 1)]
    return [(s, e) for s, e in every if not after(bisect_left(starts, e), s)]


def uncertain(token: str) -> bool:
    """Whether a token that no pattern finds may yet be a secret: it mixes letters and digits, and is of no known use."""
    return not PLAIN.fullmatch(token) and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate's characters and its context, always as long; other than ASCII becomes ?.

    A candidate of more than INSIDE characters has several windows, which overlap by half.
    """
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE), text[end : end + AFTER].ljust(AFTER)
    last = max(start, end - INSIDE)
    made = [before + text[i : min(end, i + INSIDE)].ljust(INSIDE) + after for i in [*range(start, last, INSIDE // 2), last]]
    return [x.encode("ascii", "replace").decode("ascii") for x in made]


@dataclass
class Network:
    """Embedding, one convolution, the largest response before, in and after the candidate, a linear output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    WIDTH = 5
    CUTS = (0, BEFORE - WIDTH + 1, BEFORE + INSIDE - WIDTH + 1, BEFORE + INSIDE + AFTER - WIDTH + 1)

    @staticmethod
    def new(rng: np.random.Generator, dims: int = 8, filters: int = 24) -> Network:
        w = Network.WIDTH
        return Network(rng.normal(0, 0.5, (128, dims)), rng.normal(0, (2 / (w * dims)) ** 0.5, (w * dims, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), np.zeros(1))

    def forward(self, codes: np.ndarray):
        x = self.embed[codes]
        n, length, dims = x.shape
        steps = length - self.WIDTH + 1
        cols = np.concatenate([x[:, i : i + steps] for i in range(self.WIDTH)], axis=2)
        act = np.maximum(cols @ self.conv + self.bias, 0)
        at = [act[:, a:b].argmax(axis=1) + a for a, b in zip(self.CUTS, self.CUTS[1:], strict=False)]
        top = np.concatenate([np.take_along_axis(act, i[:, None], 1)[:, 0] for i in at], axis=1)
        return top @ self.out + self.out_bias[0], (cols, at, top)

    def logits(self, windows: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(windows).encode("ascii"), dtype=np.uint8).reshape(len(windows), -1) & 127
        return np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])

    def probability(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows) + self.shift, -30, 30)))

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        z, (cols, at, top) = self.forward(codes)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        d_out, d_top = top.T @ g, g[:, None] * self.out * (top > 0)
        filters = self.conv.shape[1]
        d_conv, d_bias, d_embed = np.zeros_like(self.conv), np.zeros_like(self.bias), np.zeros_like(self.embed)
        rows = np.arange(len(codes))
        for k, i in enumerate(at):
            part = d_top[:, k * filters : (k + 1) * filters]
            d_bias += part.sum(axis=0)
            for f in range(filters):
                d_conv[:, f] += cols[rows, i[:, f]].T @ part[:, f]
                spread = (part[:, f, None] * self.conv[:, f]).reshape(len(codes), self.WIDTH, -1)
                for w in range(self.WIDTH):
                    np.add.at(d_embed, codes[rows, i[:, f] + w], spread[:, w])
        return [d_embed, d_conv, d_bias, d_out, np.array([g.sum()])]


def fitted(windows: list[str], labels: list[int], epochs: int = 8, seed: int = 11) -> Network:
    """A network fitted by Adam on three quarters of the findings, calibrated on the rest.

    The logit's slope and shift are fitted to the held-out labels; the threshold is
    the largest that reaches RECALL of the held-out positives, but LEAST at least.
    Without examples of both labels the network accepts nothing.
    """
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    y = np.array(labels, dtype=float)
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return net
    codes = np.frombuffer("".join(windows).encode("ascii"), dtype=np.uint8).reshape(len(windows), -1) & 127
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 4], order[len(y) // 4 :]
    weights = [net.embed, net.conv, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 128):
            t += 1
            some = train[i : i + 128]
            for w, g, a, b in zip(weights, net.gradients(codes[some], y[some]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    z, yh = net.logits([windows[i] for i in held]), y[held]
    for _ in range(200):  # logistic regression of the label on the logit
        p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -30, 30)))
        net.slope -= 0.05 * float(((p - yh) * z).mean()) / max(1.0, float((z * z).mean()))
        net.shift -= 0.05 * float((p - yh).mean())
    found = net.probability([windows[i] for i in held])[yh == 1]
    net.threshold = max(LEAST, float(np.quantile(found, 1 - RECALL))) if len(found) else 2.0
    return net


def examples(text: str) -> list[tuple[str, int]]:
    """Windows of a text's findings with label 1, and of what is no secret with label 0.

    A finding gives windows without what the patterns know it by: the words that
    announce it become others of the text, and its value one of another format of keys.
    So the network can't relearn the patterns. Numbers and addresses in a finding's
    place, and long tokens apart from findings, have label 0, but for those of which
    it is not known: what mixes letters and digits may be a secret that no pattern finds.
    """
    base = base_spans(text)
    made = []
    plain = [w for w in text[:4000].split() if w.isalpha()] or ["the"]
    for s, kind, e in base:
        value = ASSIGN.match(text, s)[1] if kind == 0 else text[s:e]
        begin = text.rfind(value, s, e)
        if PLAIN.fullmatch(value):
            continue
        rng = random.Random(value)
        before, after = text[max(0, begin - 3 * BEFORE) : begin], text[e : e + AFTER]
        for k in range(MADE + NONE):
            lead = CUE.sub(lambda _: f"{rng.choice(plain)} ", before)  # noqa: B023
            if k == 0:
                new = value
            elif k < MADE:
                head, letters, n = rng.choice(FORMATS)
                new = head + "".join(rng.choice(letters) for _ in range(n + rng.randint(-2, 6)))
            else:
                new = rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), "-".join(str(rng.randint(1, 9999)) for _ in range(3)), str(rng.randint(10**12, 10**16)), f"{rng.choice(plain)}.{rng.choice(plain)}.com", f"{rng.choice(plain)}-{rng.randint(1, 99)}.{rng.randint(1, 30)}.{rng.randint(0, 9)}", "".join(w.title() for w in rng.choices(plain, k=3))])
            made += [(w, int(k < MADE)) for w in windows(lead + new + after, len(lead), len(lead) + len(new))]
    return made + [(w, 0) for s, e in other_candidates(text, base, False) if not uncertain(text[s:e]) for w in windows(text, s, e)]


def labelled(docs: DataFrame) -> DataFrame:
    """window and label of examples from the findings in the first SAMPLE_DOCS documents by hash."""
    small_batches(docs.sparkSession)
    kind = "array<struct<window:string,label:int>>"

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        rows = [[{"window": w, "label": y} for w, y in examples(text or "")] for text in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("window", pa.string()), ("label", pa.int32())])))

    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"], "left_semi").select(F.col("text").cast("string").alias("text"))
    return checkpoint(some.select(F.explode(of("text")).alias("x")).select("x.window", "x.label").distinct())


def trained(docs: DataFrame) -> Network:
    """The network fitted on a bounded sample of the findings in docs, the same in each run."""
    found = labelled(docs)
    first = lambda n: found.where(F.col("label") == n).orderBy(F.xxhash64("window"), "window").limit(SAMPLE_EACH)
    rows = first(1).union(first(0)).collect()
    rows.sort(key=lambda r: (r["window"], r["label"]))
    return fitted([r["window"] for r in rows], [r["label"] for r in rows])


def all_spans(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """For each text the patterns' spans, and those of other candidates of which the network accepts a window."""
    found = [base_spans(x) if x else [] for x in texts]
    if net.threshold > 1:
        return found
    more: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    some: list[str] = []
    of: list[tuple[int, int, int]] = []

    def score() -> None:
        for (k, s, e), p in zip(of, net.probability(some) if some else [], strict=True):
            if p >= net.threshold and not PLAIN.fullmatch(texts[k], s, e):
                more[k].add((s, KINDS.index("model"), e))
        some.clear()
        of.clear()

    for k, x in enumerate(texts):
        for s, e in other_candidates(x or "", found[k], True):
            for w in windows(x, s, e):
                some.append(w)
                of.append((k, s, e))
                if len(some) == 512:
                    score()
    score()
    return [sorted([*a, *b]) for a, b in zip(found, more, strict=True)]


def spans(text: Column, net: Network) -> Column:
    """array<struct<start, kind, end>> for each text; none for null. Code points, the end exclusive."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<start:long,kind:string,end:long>>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in all_spans(texts.to_pylist(), net)], shape)

    return of(text)


def blotted(text: Column, net: Network, by: str = "[secret]") -> Column:
    """Each text with its spans, overlapping ones together, replaced."""

    def one(x: str, found: list[tuple[int, int, int]]) -> str:
        parts, done = [], 0
        for s, _, e in found:
            if s >= done:
                parts += [x[done:s], by]
            done = max(done, e)
        return "".join([*parts, x[done:]])

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        return pa.array([one(x, found) if x else x for x, found in zip(rows, all_spans(rows, net), strict=True)], pa.string())

    return of(text)


def scanned(docs: DataFrame) -> DataFrame:
    """row (docs' columns, as a struct) and spans for each row of docs.

    docs: doc_id, text and any others. The patterns' spans are always there; the
    network, fitted on a bounded sample of examples made of them and of other long
    tokens, adds spans of kind model where it finds another long token as likely as they
    are; a token that reaches beyond a pattern's span may be one, a number, network
    address, name of a host or file or a plain word is none. A null
    or empty text has no spans. Repeated rows are scanned as often as they are there.
    An empty table gives an empty one. Texts are scanned whole.
    """
    net = trained(docs)
    return docs.select(F.struct("*").alias("row"), spans(F.col("text").cast("string"), net).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text; n_chars, if there, follows."""
    net = trained(docs)
    small_batches(docs.sparkSession)
    made = docs.select(F.struct("*").alias("_row"), blotted(F.col("text").cast("string"), net).alias("_text"))
    other = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")}
    return made.select(*[other[x].alias(x) if x in other else F.col("_row")[x].alias(x) for x in docs.columns])


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs).select("row.doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
