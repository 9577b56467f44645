"""HTML extraction: structure gives the candidate blocks, a suffix array per host finds boilerplate.

A page is parsed to blocks. The token streams of up to PAGES pages of a host are concatenated and their
suffix array is built; substrings of at least RUN tokens that are on RUN_PAGES distinct pages are boilerplate
and cover tokens. Outside articles, blocks that are mostly covered go, of others the long covered runs; unique runs stay.

The suffix array alone cannot give right results here: an article may be published on several pages of its
host, and its text must then stay, while a footer or an advert may be on one page only. So a page's article
container, where it has one, bounds its text, and elements that are boilerplate by kind (navigation,
headers, forms, comments, ...) always go.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

PAGES, RUN, RUN_PAGES, COVERED, LONG = 64, 6, 3, 0.7, 12
#: Up to so many hosts of more than PAGES pages are broadcast (name and count, some MB); more are joined by shuffle.
MOST_HOT = 50_000

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label map mark object q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr picture track".split())
_GONE = frozenset("nav footer aside form head script style noscript template textarea iframe button select option svg canvas menu dialog object audio video datalist fieldset".split())
#: Parts of names that mark boilerplate, and those of reader comments, which may be longer than the article.
_LAYOUT = frozenset("nav navbar navigation menu header masthead footer sidebar side aside cookie cookies consent gdpr notice alert banner ad ads advert advertisement adsense sponsor sponsored promo promotion share sharing social breadcrumb breadcrumbs related recommended newsletter subscribe subscription popup modal overlay login signup search pagination pager copyright widget toolbar skip".split())
_COMMENTS = frozenset("comment comments disqus respond replies".split())
_PARTS = re.compile(r"[^\W_]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_MAIN = frozenset(("article", "main"))
#: What an open element is ended by when its end tag is left out.
_ENDS = {
    "p": frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "colgroup": frozenset("thead tbody tfoot tr td th".split()),
    "td": frozenset("td th tr tbody tfoot thead".split()), "th": frozenset("td th tr tbody tfoot thead".split()), "tr": frozenset("tr tbody tfoot thead".split()),
    "thead": frozenset(("tbody", "tfoot")), "tbody": frozenset(("tbody", "tfoot")), "tfoot": frozenset(("tbody",)),
}


def _goes(name: str, attributes: str, in_main: bool) -> str:
    """Whether an element is boilerplate: ``yes`` by kind, ``comments`` or ``layout`` by its names, else empty."""
    if name in _GONE or (name == "header" and not in_main):
        return "yes"
    if name in ("html", "body", "article", "main") or name in _HEADINGS or len(attributes) < 4:
        return ""
    if _HIDDEN.search(attributes) or re.search(r"role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu)", attributes, re.I):
        return "yes"
    parts = {x.lower() for m in _NAMES.findall(attributes) for x in _PARTS.findall(next(filter(None, m), ""))}
    return "comments" if parts & _COMMENTS else "layout" if parts & _LAYOUT else ""


def blocks(page: str | None, trust: bool = True) -> list[tuple[str, bool]]:
    """(text, whether inside an article or main element) of a page's blocks in order, without what goes by kind.

    With ``trust`` false no element but script, style and the like goes by kind or is an article.

    An element that only its names mark as layout stays if it holds an article or main element or most of the text that it
    could be taken from, so that a page's text is never lost to a class name.
    """
    out: list[tuple[str, bool, tuple[int, ...]]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # name, gone, main, marked elements around
    marks: list[tuple[str, bool]] = []  # kind, whether inside main
    opened: Counter[str] = Counter()
    gone = main = False
    inside: tuple[int, ...] = ()

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append((text, main, inside))
            buffer.clear()

    def close(i: int) -> None:
        nonlocal gone, main, inside
        flush()
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]
        gone, main, inside = stack[-1][1:] if stack else (False, False, ())

    page, at = page or "", 0
    while at < len(page):
        m = _MARK.search(page, at)
        if not m:
            if not gone:
                buffer.append(page[at:])
            break
        if m.start() > at and not gone:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            flush()
        elif name == "br" and not gone:
            buffer.append(" ")
        if m[1]:
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        cut = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] not in _ENDS and stack[i][0] not in _INLINE:
                break
            if name in _ENDS.get(stack[i][0], ()):
                cut = i
        if cut is not None:
            close(cut)
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in _VOID or (m[3] or "").endswith("/>") and name not in _MAIN:
            continue
        goes = "" if gone or not trust else _goes(name, m[3] or "", main)
        if goes or name in _MAIN:
            flush()
        elif name in _INLINE:
            continue  # may stay open; neither starts nor ends anything
        if goes in ("comments", "layout"):
            marks.append((goes, main))
            inside = (*inside, len(marks) - 1)
        gone, main = gone or goes == "yes", main or (trust and name in _MAIN and not gone)
        stack.append((name, gone, main, inside))
        opened[name] += 1
    flush()
    if not marks:
        return [(t, m) for t, m, _ in out]
    has_main = any(m for _, m, _ in out)
    total, of_main = sum(len(t) for t, _, _ in out), sum(len(t) for t, m, _ in out if m)
    size, holds = Counter(), set()
    for t, m, around in out:
        for i in around:
            size[i] += len(t)
            if m and not marks[i][1]:
                holds.add(i)

    def stays(i: int) -> bool:
        kind, within = marks[i]
        return i in holds or (kind == "layout" and (within or not has_main) and 2 * size[i] > (of_main if within else total))

    lost = {i for i in range(len(marks)) if not stays(i)}
    return [(t, m) for t, m, around in out if lost.isdisjoint(around)]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of an integer sequence by prefix doubling, and its ranks."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        both = rank * (n + 1) + second + 1
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return order, rank


def windows(tokens: list[str], run: int = RUN) -> np.ndarray:
    """The hash of the ``run`` tokens from each token on, as far as there are as many."""
    n = max(0, len(tokens) - run + 1)
    if not n:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(t.encode(), 7) for t in tokens), dtype=np.uint64, count=len(tokens))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def covered(streams: list[np.ndarray], run: int = RUN, pages: int = RUN_PAGES, known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of ``run`` tokens that is on ``pages`` distinct streams.

    Substrings that start where ``known`` (per stream, of its length) is true count as well.
    """
    if not streams:
        return []
    # A separator of its own ends each stream, so no substring crosses two.
    top = max((int(x.max()) for x in streams if len(x)), default=0) + 1
    s = np.concatenate([np.append(x, top + i) for i, x in enumerate(streams)])
    owner = np.repeat(np.arange(len(streams)), [len(x) + 1 for x in streams])
    order, _ = suffix_array(s)
    n = len(s)
    # Neighbours in the suffix array that agree in their first ``run`` tokens are one class.
    at = np.minimum(order[:, None] + np.arange(run), n - 1)
    first = s[at]
    fits = (order + run <= n) & (first < top).all(axis=1)
    new = np.concatenate([[True], (first[1:] != first[:-1]).any(axis=1) | ~fits[1:] | ~fits[:-1]])
    cls = np.cumsum(new) - 1
    who = np.unique(cls * len(streams) + owner[order])
    many = np.bincount(who // len(streams), minlength=cls[-1] + 1) >= pages
    told = np.concatenate([np.append(x, False) for x in known])[order] if known else np.zeros(n, dtype=bool)
    starts = order[(many[cls] | told) & fits]
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + run, n), -1)
    cover = np.cumsum(delta[:n]) > 0
    edges = np.cumsum([0, *[len(x) + 1 for x in streams]])
    return [cover[a : b - 1] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def unique_runs(tokens: list[str], cover: np.ndarray) -> list[str]:
    """What stays of a block outside any article: nothing if COVERED of it or more is covered, else its text without covered runs of LONG tokens or more (one text, if any is left)."""
    if not len(tokens) or cover.mean() >= COVERED:
        return []
    edge = np.nonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))[0]
    drop = np.zeros(len(tokens), dtype=bool)
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        drop[a:b] = b - a >= LONG
    text = " ".join(t for t, d in zip(tokens, drop, strict=True) if not d)
    return [text] if text else []


def main_texts(pages: list[list[tuple[str, bool]]], known: np.ndarray | None = None) -> list[str]:
    """The main text of each of some pages of one host (as ``blocks`` gives them).

    ``known`` has the hashes of windows that are on RUN_PAGES pages of the host, here or elsewhere.
    """
    ids: dict[str, int] = {}
    streams = [np.fromiter((ids.setdefault(t, len(ids)) for text, _ in p for t in text.split()), dtype=np.int64) for p in pages]
    first: dict[bytes, int] = {}
    same = [first.setdefault(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), i) for i, x in enumerate(streams)]
    distinct = sorted(set(same))
    told = None
    if known is not None and len(known):
        told = [np.zeros(len(streams[i]), dtype=bool) for i in distinct]
        for x, i in zip(told, distinct, strict=True):
            found = np.isin(windows([t for text, _ in pages[i] for t in text.split()]), known)
            x[: len(found)] = found
    cover = dict(zip(distinct, covered([streams[i] for i in distinct], known=told), strict=True))
    out = []
    for p, i in zip(pages, same, strict=True):
        has_main, at, kept = any(m for _, m in p), 0, []
        for text, is_main in p:
            n = len(text.split())
            if is_main:
                kept.append(text)
            elif not has_main:
                kept.extend(unique_runs(text.split(), cover[i][at : at + n]))
            at += n
        out.append("\n\n".join(kept))
    return out


def _host_windows(parsed: DataFrame, hot: DataFrame, pages: int) -> DataFrame:
    """(__host, __shard, __window): for each group of a hot host its windows that are on RUN_PAGES distinct pages of the host."""
    bare = parsed.join(hot, "__host", "left_semi").where(~F.exists("__main", lambda m: m)).where(F.size("__texts") > 0)
    asked = saved(hot.join(bare.select("__host").distinct(), "__host", "left_semi"))
    if asked.isEmpty():
        return asked.select("__host", F.lit(0).cast("long").alias("__shard"), F.lit(0).cast("long").alias("__window")).limit(0)

    def one(batches):
        for batch in batches:
            tokens = [[t for x in p for t in x.split()] for p in batch.column(2).to_pylist()]
            stream = [xxhash.xxh64_intdigest("\n".join(t).encode(), 9) - (1 << 63) for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stream, pa.int64()), pa.array([np.unique(windows(t)) for t in tokens], pa.list_(pa.int64()))], names=["__host", "__shard", "__stream", "__windows"])

    rows = parsed.join(asked, "__host").select("__host", F.pmod("__deal", F.ceil(F.col("__n") / pages).cast("long")).alias("__shard"), "__texts")
    found = rows.mapInArrow(one, "__host string, __shard long, __stream long, __windows array<long>")
    each = saved(found.dropDuplicates(["__host", "__shard", "__stream"]))
    # Equal pages count once, in whatever groups they are.
    once = each.dropDuplicates(["__host", "__stream"]).select("__host", F.explode("__windows").alias("__window"))
    often = once.groupBy("__host", "__window").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") >= RUN_PAGES).select("__host", "__window")
    own = each.select("__host", "__shard", F.explode("__windows").alias("__window")).distinct()
    return own.join(often, ["__host", "__window"]).select("__host", "__shard", "__window")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", pages: int = PAGES) -> DataFrame:
    """(key, url, text, n_chars) of every page.

    The pages of a host are dealt by hash in groups of about ``pages``, so a hot host is many groups, and no task
    holds more of it than one group at a time. Only hosts of more than ``pages`` pages need their count. Where such a
    host has a page without an article, the windows of RUN tokens on its pages are counted over the whole host,
    and each group is told those on RUN_PAGES distinct pages; elsewhere the structure alone decides. Null html
    is empty and gives an empty text; a null or odd url has the empty host; repeated rows count as one page for
    boilerplate and each gives its own row; an empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(key).alias("__key"), F.col(url).alias("__url"), host.alias("__host"), F.col(html).cast("string").alias("__html"), F.xxhash64(key, url, html).alias("__deal"))

    def parse(batches):
        for batch in batches:
            found = [blocks(h) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array([[t for t, _ in p] for p in found], pa.list_(pa.string())), pa.array([[m for _, m in p] for p in found], pa.list_(pa.bool_()))],
                names=["__key", "__url", "__host", "__deal", "__texts", "__main"],
            )

    hot = saved(df.select(host.alias("__host")).groupBy("__host").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > pages))
    schema = f"__key {kinds[key]}, __url {kinds[url]}, __host string, __deal long, __texts array<string>, __main array<boolean>"
    parsed, few = rows.mapInArrow(parse, schema), hot.count() <= MOST_HOT
    counted = parsed.join(F.broadcast(hot) if few else hot, "__host", "left")
    # Pages of other hosts are not parsed twice.
    of_hot = rows.join(F.broadcast(hot), "__host", "left_semi").select(*rows.columns).mapInArrow(parse, schema) if few else parsed
    shard = F.coalesce(F.pmod("__deal", F.ceil(F.col("__n") / pages).cast("long")), F.lit(0))
    # Dealt by host and shard together: grouping alone would be content with a partitioning by host.
    dealt = counted.select("__host", shard.alias("__shard"), "__key", "__url", "__texts", "__main").repartition("__host", "__shard")

    def group(at: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        pages_ = [list(zip(a, b, strict=True)) for a, b in zip(t.column("__texts").to_pylist(), t.column("__main").to_pylist(), strict=True)]
        texts = main_texts(pages_, told.column("__window").to_numpy())
        return pa.table({"__key": t.column("__key"), "__url": t.column("__url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    known = _host_windows(of_hot, hot, pages)
    done = dealt.groupBy("__host", "__shard").cogroup(known.groupBy("__host", "__shard")).applyInArrow(group, f"__key {kinds[key]}, __url {kinds[url]}, text string, n_chars long")
    return done.select(F.col("__key").alias(key), F.col("__url").alias(url), "text", "n_chars")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html": op10_html}
ORACLE: dict[str, str] = {}
