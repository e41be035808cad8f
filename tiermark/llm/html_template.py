"""HTML extraction by template deduction from equivalence classes of tokens over same-host pages."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint, small_batches

# Names of HTML elements, and words of class and id attributes.
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "html", "body", "head"}
NOT_TEXT = frozenset("head nav header footer aside form button select option dialog menu object audio video canvas map".split()) | RAW
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
#: A tag as nearly all are, found up to the next < at most: its quotes are closed and hold no < or >.
USUAL = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)(?=[\s/>])([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"""[>"']""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Pages of a host from which its template is deduced, at least.
LEAST = 3
#: Template tokens that are sent to all tasks, at most; beyond it, pages and templates are joined by host.
SENT = 200_000
#: Stands for the page itself among its tokens, if it has any.
PAGE = -1


def _named(attributes: str) -> str:
    """The words of class, id and role, without numbers, as part of a path."""
    found = [w.lower() for m in NAMED.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "") if not w.isdigit()]
    return "." + ".".join(found) if found else ""


def after_raw(html: str, name: str, at: int) -> int:
    """Where an element whose inside is no markup ends; it goes on to the page's end if it is not closed."""
    done = re.compile(rf"</{name}\s*>", re.I).search(html, at)
    return done.end() if done else len(html)


def scanned(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page: text, open and close with an element's name; comments, declarations and the insides of RAW elements are skipped.

    An attribute's quotes hide a > if they are closed, else the tag ends at the first >; a <
    that begins nothing is text. Every character is looked at a bounded number of times:
    a place outside of quotes from which no tag can end is remembered.
    """
    at, n, last = 0, len(html), html.rfind(">")
    dead: set[int] = set()
    while at < n:
        here = html.find("<", at)
        if here != at:
            here = n if here < 0 else here
            yield "text", html[at:here], ""
            at = here
            continue
        m = USUAL.match(html, at)
        if m is not None:
            closing, name, attributes = m[1], m[2].lower(), m[3]
            at = m.end()
            if not closing and name in RAW:
                at = after_raw(html, name, at)
                continue
            yield ("close" if closing else "open"), name, attributes
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if at < last and html[at + 1] in "!?":
            at = html.index(">", at + 2 if html[at + 2 : at + 3] else at) + 1 if last >= at + 2 else n
            continue
        m = NAME.match(html, at) if at < last else None
        if m is None or m.end() > last:
            yield "text", "<", ""
            at += 1
            continue
        place, passed, end = m.end(), [], -1
        while place not in dead:
            passed.append(place)
            q = QUOTE.search(html, place)
            if q is None:
                break
            if q[0] == ">":
                end = q.start()
                break
            close = html.find(q[0], q.end())
            if close < 0:
                break
            place = close + 1
        if end < 0:
            dead.update(passed)
            end = html.index(">", m.end())
        name, closing = m[1].lower(), html[at + 1] == "/"
        at = end + 1
        if not closing and name in RAW:
            at = after_raw(html, name, at)
            continue
        yield ("close" if closing else "open"), name, html[m.end() : end]


def tokens(html: str | None) -> Iterator[tuple[str, str, bool, bool, str]]:
    """(kind, value, content, inside, around) in page order.

    kind "tag": value is the path of an element that opens. kind "text": value is the
    text as written, with the path before a line feed. kind "block": a border of
    blocks. A path is a digest of its element and the path around. content: not within an
    element of another use; inside: within an article or, in a page without one, main.
    Elements left open end with those around them.
    """
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, content, inside
    open_ = Counter()

    def end(k: int) -> None:
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    for kind, name, attributes in scanned(html or ""):
        around, content, inside = stack[-1][1:] if stack else ("", True, False)
        if kind == "text":
            yield "text", f"{around}\n{name}", content, inside, around
            continue
        if name in BLOCK:
            yield "block", "", True, False, ""
        if kind == "close":
            if open_[name]:
                end(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in ENDS_P and open_["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    end(k)
                    break
                if stack[k][0] in ENDS_P:
                    break
            around, content, inside = stack[-1][1:] if stack else ("", True, False)
        named = _named(attributes)
        words = COMMENT_WORDS if name in ("article", "main") else frozenset() if name in ("html", "body") else NOT_TEXT_WORDS
        path = xxhash.xxh64_hexdigest(f"{around}/{name}{named}".encode("utf-8", "surrogatepass"))
        content = content and name not in NOT_TEXT and not words.intersection(named.split("."))
        inside = inside or name in ("article", "main")
        yield "tag", path, content, inside, around
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, path, content, inside))
            open_[name] += 1


def token_id(kind: str, value: str) -> int:
    """A token's 63-bit name; a text's white space and character references do not matter."""
    if kind == "text":
        path, _, text = value.partition("\n")
        value = f"{path}\n{' '.join(entities.unescape(text).split())}"
    return xxhash.xxh64_intdigest(f"{kind}\n{value}".encode("utf-8", "surrogatepass")) >> 1


def counted(html: str | None) -> dict[tuple[int, bool], tuple[int, int, bool]]:
    """How often each token (its id, and whether it is text) occurs in a page, the element around it, and if an article is.

    White space is no token. The page stands around the outermost elements.
    """
    found: dict[tuple[int, bool], tuple[int, int, bool]] = {}
    ids: dict[str, int] = {"": PAGE}
    for kind, value, _, inside, around in tokens(html):
        if kind == "tag":
            key = (ids.setdefault(value, token_id("tag", value)), False)
        elif kind == "text" and not value.partition("\n")[2].isspace():
            key = (token_id(kind, value), True)
        else:
            continue
        n = found[key][0] if key in found else 0
        found[key] = (n + 1, ids.get(around, PAGE), inside)
    return found


def main_text(html: str | None, constant: frozenset[int]) -> str:
    """The text in the template's slots: blocks in page order, joined by a space.

    constant: ids of texts that are part of the host's template; in an article too they
    are left out. If the page has an article with a slot that is not empty, its slots alone
    are taken. Elements of another use, by their names, hold no main text.
    """
    blocks: dict[bool, list[list[str]]] = {True: [[]], False: [[]]}
    article = False
    for kind, value, content, inside, _ in tokens(html):
        if kind == "block":
            blocks[True].append([])
            blocks[False].append([])
        elif kind == "text" and content:
            text = value.partition("\n")[2]
            if constant and not text.isspace() and token_id(kind, value) in constant:
                text = " "
            article = article or inside and not text.isspace()
            blocks[inside][-1].append(text)
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks[article])
    return " ".join(b for b in joined if b)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def classes(pages: DataFrame) -> DataFrame:
    """host, token, text, pages, vector, around and inside of each token on LEAST pages or more; token PAGE counts the pages with tokens.

    pages: host, page_id, html. Tokens of a host with the same vector, a digest of how
    often each of its pages has the token, are an equivalence class. Digests are sums,
    so they are built within tasks first and no host's tokens meet in one task. around is
    the element that a token stands in. Of pages of one host with the same html only one
    counts, as copies of a page are no evidence of its template.
    """
    small_batches(pages.sparkSession)
    named = pages.withColumn("same", F.xxhash64("html"))
    first = named.groupBy("host", "same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "same", "first")
    copies = checkpoint(first.withColumnsRenamed({"host": "_h", "same": "_s"}))
    few = copies.limit(SENT + 1).count() <= SENT
    single = named.join(F.broadcast(copies) if few else copies, (F.col("host") == F.col("_h")) & (F.col("same") == F.col("_s")) & (F.col("page_id") > F.col("first")), "left_anti").select("host", "page_id", "html")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [counted(h) for h in batch.column("html").to_pylist()]
            made = [[{"token": t, "text": x, "n": n, "around": a, "inside": i} for (t, x), (n, a, i) in [*c.items(), *([((PAGE, False), (1, PAGE, False))] if c else [])]] for c in each]
            kind = pa.list_(pa.struct([("token", pa.int64()), ("text", pa.bool_()), ("n", pa.int64()), ("around", pa.int64()), ("inside", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), pa.array(made, kind)], ["host", "page_id", "found"])

    each = single.mapInArrow(of, "host long, page_id long, found array<struct<token:long,text:boolean,n:long,around:long,inside:boolean>>").select("host", "page_id", F.explode("found").alias("x"))
    digest = F.xxhash64("page_id", "x.n")
    half = lambda h: F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))
    sums = [F.count(F.lit(1)).alias("pages"), half(digest).alias("low"), half(F.shiftrightunsigned(digest, 32)).alias("high"), F.min("x.around").alias("around"), F.bool_or("x.inside").alias("inside")]
    found = each.groupBy("host", F.col("x.token").alias("token"), F.col("x.text").alias("text")).agg(*sums)
    return found.where(F.col("pages") >= LEAST).select("host", "token", "text", "pages", F.struct("low", "high").alias("vector"), "around", "inside")


def templates(pages: DataFrame) -> DataFrame:
    """host and constant, the ids of the texts that are part of the host's template, for hosts that have any.

    A class, the tokens of one vector, is valid if it nests: each of its tokens stands in
    an element of the same class, or in one of an outer class on LEAST pages or more, of
    which it is on more than half; but for elements that all begin in one outer element,
    in whose slot the class lies. So a page of another kind does not undo the template,
    and a layout of few pages has its own within what wraps it. Texts of valid classes are
    constant; in an article they must be on more than half of all the host's pages with
    tokens, as what a few articles share may be their text. All other text of the pages
    stands in the template's slots.
    """
    found = checkpoint(classes(pages))
    outer = found.where("not text").select("host", F.col("token").alias("around"), F.col("pages").alias("all"))
    size = found.where(F.col("token") == PAGE).select("host", F.col("pages").alias("size"))
    each = found.join(outer, ["host", "around"])
    apart = F.col("pages") * 2 <= F.col("all")
    sides = [F.bool_or(apart & F.col("text")).alias("loose"), *[f(F.when(apart, F.col("around"))).alias(f.__name__) for f in (F.min, F.max)]]
    valid = each.groupBy("host", "vector").agg(*sides).where("not loose and (min is null or min = max)").select("host", "vector")
    texts = each.where("text").join(valid, ["host", "vector"]).join(size, "host").where("not inside or pages * 2 > size")
    return texts.groupBy("host").agg(F.collect_list("token").alias("constant"))


def extracted(pages: DataFrame) -> DataFrame:
    """row (pages' columns, as a struct) and text, the main text, for each row of pages.

    pages: page_id, url, html and any others. A null html counts as an empty one and
    has no text. What the host's template has as constant text is gone everywhere; of
    the slots, those in an article or main element are the text, in a page without one
    all that no element of another use holds. A null
    url is a host of its own. Repeated rows count as pages of their own. An empty
    table gives an empty one. Pages are read whole.
    """
    plain = pages.select(F.xxhash64(host(F.col("url"))).alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    made = checkpoint(templates(plain))
    some = made.limit(SENT + 1).select(F.size("constant").alias("n")).agg(F.sum("n")).first()[0] or 0
    rows = pages.select(F.struct("*").alias("row"), F.xxhash64(host(F.col("url"))).alias("_host"), F.col("html").cast("string").alias("_html"))
    if some:
        made = made.withColumnRenamed("host", "_h")
        rows = rows.join(F.broadcast(made) if some <= SENT else made, F.col("_host") == F.col("_h"), "left")
    else:
        rows = rows.withColumn("constant", F.lit(None).cast("array<long>"))
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array, hosts: pa.Array, constant: pa.Array) -> pa.Array:
        # templates are the same for a host's pages: a set is made once for each in a batch
        sets: dict[int, frozenset[int]] = {}
        ids, starts, ends = constant.values.to_numpy(zero_copy_only=False), constant.offsets.to_numpy()[:-1], constant.offsets.to_numpy()[1:]
        out = []
        for h, of_host, a, b in zip(texts.to_pylist(), hosts.to_pylist(), starts, ends, strict=True):
            if of_host not in sets:
                sets[of_host] = frozenset(ids[a:b].tolist())
            out.append(main_text(h, sets[of_host]))
        return pa.array(out, pa.string())

    return rows.select("row", of("_html", "_host", F.coalesce("constant", F.array().cast("array<long>"))).alias("text"))


def op4(spark, sf_dir: str) -> DataFrame:
    made = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return made.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
