"""HTML extraction by site style trees.

The DOMs of all pages of a host are merged: elements of the same path (tags with their classes and ids, without
digits) are one node of the host's style tree. Every element that is shown counts, menus, notices and articles alike. Of
a node that is on m pages:

* content importance is one minus the entropy of a text over the pages, to the base m, averaged over its distinct texts:
  a text that is on every page is worth 0, one of a single page 1;
* presentation importance is the entropy, to the base m, of the child sequences that it has in the pages.

The importance of the texts of a node is its content importance, and of what that lacks up to a share of ``LIFT``, as the
presentation importance of its parent is, the arrangement that they are part of. Few pages prove little, so a host's node
starts from the importance that the same node has over all hosts, and that from ``START``; evidence weighs as the
logarithm of m, starts as ``INERTIA`` says, and nodes on fewer than ``FEWEST`` pages say nothing.

A block of text stays if its importance is enough. What a page says about an element, by its tag, class, id or role, is a
prior: it moves the importance that is enough (``LEAST``). Elements named like parts of a frame need more than any node
reaches; those outside of a page's ``article`` (else ``main``) need to be all but certain, those inside stay unless they
are all but certainly repeated. Where pages name nothing, the tree alone decides.

Only counts of (host, path, feature) leave a page, summed before and after the shuffle, so a host with a third of all
pages is no group anywhere. The importances that can matter are broadcast if they are at most ``BROADCAST_ROWS``, and else
joined with the pages' hosts, salted; the result is the same. Pages are read in one pass, in time linear in their length
however deep they nest.

Defined results: null and empty html give an empty text; pages without a host are judged by themselves, with the
importance ``START`` throughout; broken markup is read as far as it goes, unclosed comments and scripts to the end;
repeated rows are pages of their own; white space is what ``str.split`` takes for it; an empty table gives an empty
table; other columns pass through, and a column named as the output is replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm.support import fresh, small_batches
from pixelloom.llm.text_arrays import bounded_batches
from pixelloom.session import cut

LIFT, START, INERTIA, FEWEST = 0.3, 0.95, (2.0, 8.0), 5
BROADCAST_ROWS, SALTS = 200_000, 16
#: How a page names the place of a block: a part of the frame; outside of its article; nothing; inside of its article.
FRAME, OUTSIDE, PLAIN, INSIDE = range(4)
LEAST = (1.01, 0.97, 0.88, 0.12)

# Names from the HTML standard and common page vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea xmp noembed noframes".split())
UNSHOWN = frozenset("head title script style noscript template select option input textarea button iframe object embed svg canvas audio video map".split())
FRAME_TAGS = frozenset("nav footer aside form dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEM_OF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget".split()
)
ARTICLE_PARTS = frozenset("comment comments reply replies related promo ad ads sponsored".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_WORD = (1 << 64) - 1
#: The host of a URL, with or without a scheme: the same rule wherever a host is needed.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::[^/?#]*)?(?:[/?#]|$)"


def host_column(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


_name_hash = lru_cache(maxsize=20_000)(_hash)


def _step(state: int, added: int) -> int:
    """The hash of a path or a sequence with one name more."""
    state = ((state ^ added) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _WORD
    return state ^ (state >> 29)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Element:
    """An open or closed block element: the hash of its path, its parent, and how it is named."""

    __slots__ = ("path", "parent", "standing", "shown")

    def __init__(self, path: int, parent: _Element | None, standing: int, shown: bool):
        self.path, self.parent, self.standing, self.shown = path, parent, standing, shown


class Page:
    """Blocks of text in page order with their elements, the child sequence of every path, and the parent of every path."""

    __slots__ = ("blocks", "sequences", "parents", "has_article", "has_main")

    def __init__(self, source: str | None):
        self.blocks: list[tuple[_Element, str, bool, bool]] = []
        self.sequences: dict[int, int] = {}
        self.parents: dict[int, int] = {}
        self.has_article = self.has_main = False
        root = _Element(0, None, PLAIN, True)
        # Open elements: tag, element that its texts belong to, inside an article, inside main.
        stack: list[tuple[str, _Element, bool, bool]] = [("", root, False, False)]
        places: dict[str, list[int]] = {}
        pending: list[str] = []

        def flush() -> None:
            if pending:
                text = " ".join(html.unescape("".join(pending)).split())
                pending.clear()
                _, element, article, main = owner
                if text:
                    self.blocks.append((element, text, article, main))

        def close(depth: int) -> None:
            while len(stack) > depth:
                places[stack.pop()[0]].pop()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        owner = stack[0]
        source, at, end = source or "", 0, len(source or "")
        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                if stack[-1][1].shown:
                    pending.append(source[at:])
                break
            if found.start() > at and stack[-1][1].shown:
                pending.append(source[at : found.start()])
            token, at = found.group(), found.end()
            if token[1] in "!?":
                continue
            tag = _NAME.match(token)[1].lower()
            inline = tag in INLINE
            if not inline:
                flush()
            if token[1] == "/":
                if depth := last((tag,)):
                    if stack[-1][1] is not stack[depth - 1][1]:
                        flush()
                    close(depth)
                    owner = stack[-1]
                continue
            if tag in CLOSES_P:
                depth = last(("p",))
                if depth > last(("table", "td", "th", "button", "object")):
                    close(depth)
            if tag in ITEM_OF:
                stop = last(ITEM_OF[tag])
                peers = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else ("tr",) if tag == "tr" else (tag,)
                depth = last(peers)
                if depth > stop:
                    close(depth)
            _, element, article, main = stack[-1]
            marks = {k.lower(): a or b or c for k, a, b, c in _MARKS.findall(token)} if " " in token or "\n" in token else {}
            standing, shown = element.standing, element.shown and tag not in UNSHOWN
            if standing != FRAME and shown and self._of_frame(tag, marks, article):
                standing = FRAME
            article = article or (tag == "article" and shown and standing != FRAME)
            main = main or ((tag == "main" or marks.get("role", "").lower() == "main") and shown and standing != FRAME)
            self.has_article |= article
            self.has_main |= main
            if not inline or standing != element.standing or shown != element.shown:
                flush()
                name = tag + "".join("." + _DIGITS.sub("", marks[k].lower()) for k in ("class", "id") if marks.get(k))
                own = _name_hash(name)
                if shown:
                    self.sequences[element.path] = _step(self.sequences.get(element.path, 0), own)
                    path = _step(element.path, own)
                    self.parents[path] = element.path
                    element = _Element(path, element, standing, True)
                else:
                    element = _Element(element.path, element, standing, False)
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                stop = closing.start() if closing else end
                if shown:
                    owner = (tag, element, article, main)
                    pending.append(source[at:stop])
                    flush()
                at = stop
                if not closing:
                    owner = stack[-1]
                    continue
            if tag not in VOID and not (token.endswith("/>") and tag in ("svg", "path")):
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, element, article, main))
            owner = stack[-1]
        flush()

    @staticmethod
    def _of_frame(tag: str, marks: dict[str, str], article: bool) -> bool:
        """Whether an element is named like a part of the frame."""
        if tag in FRAME_TAGS or (tag == "header" and not article):
            return True
        if tag in ("html", "body", "main"):
            return False
        words = {w for k in ("class", "id") if marks.get(k) for w in _PARTS.findall(marks[k].lower())}
        if tag == "article":
            return bool(words & ARTICLE_PARTS)
        return marks.get("role", "").lower() in PART_ROLES or bool(words & PART_WORDS)

    def placed_blocks(self) -> Iterator[tuple[int, int, str]]:
        """(path, place, text) of every block."""
        for element, text, article, main in self.blocks:
            if element.standing == FRAME:
                place = FRAME
            elif self.has_article or self.has_main:
                place = INSIDE if article or (main and not self.has_article) else OUTSIDE
            else:
                place = PLAIN
            yield _signed(element.path), place, text

    def main_blocks(self, worth: dict[int, float] | None = None) -> list[tuple[int, str]]:
        """What stays. worth: the importances of the host's nodes that are below the highest of ``LEAST`` that nodes reach;
        None: nothing is known of the host."""
        if worth is None:
            return [(path, text) for path, place, text in self.placed_blocks() if START >= LEAST[place]]
        return [(path, text) for path, place, text in self.placed_blocks() if worth.get(path, 1.0) >= LEAST[place]]


def _tree_counts(pages: DataFrame, host: str, source: str) -> DataFrame:
    """(host, path, kind, feature, k): k pages have it. Kinds: 0 the path, whose feature is its parent; 1 a text in it; 2 a child sequence of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, source):
            counts: Counter = Counter()
            for name, h in zip(batch.column(host).to_pylist(), batch.column(source).to_pylist()):
                if not name:
                    continue
                page = Page(h)
                counts.update({(name, _signed(p), 0, _signed(parent)) for p, parent in page.parents.items()})
                counts.update({(name, 0, 0, 0)})
                counts.update({(name, _signed(element.path), 1, _signed(_hash(text))) for element, text, *_ in page.blocks})
                counts.update({(name, _signed(p), 2, _signed(s)) for p, s in page.sequences.items()})
            if counts:
                columns = list(zip(*counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    names=["host", "path", "kind", "feature", "k"],
                )

    rows = pages.select(F.col(host), F.col(source)).mapInArrow(run, "host string, path long, kind int, feature long, k long")
    return rows.groupBy("host", "path", "kind", "feature").agg(F.sum("k").alias("k"))


def _measured(each: DataFrame, *keys: str) -> DataFrame:
    """(*keys, path, parent, m, evidence): for nodes that have texts, the importance of these; evidence is null on fewer than ``FEWEST`` pages."""
    k = F.col("k").cast("double")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    node = each.groupBy(*keys, "path").agg(
        of(0, k).alias("m"), F.max(F.when(F.col("kind") == 0, F.col("feature"))).alias("parent"),
        of(1, F.lit(1.0)).alias("texts"), of(1, F.log(k)).alias("text_logs"), of(2, k).alias("styles"), of(2, k * F.log(k)).alias("style_logs"),
    )
    base = F.log("m")
    node = node.select(
        *keys, "path", "parent", "m",
        F.when((F.col("m") >= FEWEST) & (F.col("texts") > 0), 1 - F.col("text_logs") / F.col("texts") / base).alias("content"),
        F.when((F.col("m") >= FEWEST) & (F.col("styles") > 0), (F.log("styles") - F.col("style_logs") / F.col("styles")) / base).alias("presentation"),
        (F.col("texts") > 0).alias("has_texts"),
    )
    around = node.select(*(F.col(c).alias(f"{c}_above") for c in (*keys, "path")), F.col("presentation").alias("around"))
    above = [F.col(c) == F.col(f"{c}_above") for c in keys] + [F.col("parent") == F.col("path_above")]
    joined = node.where("has_texts").join(around, above, "left")
    evidence = 1 - (1 - F.col("content")) * (1 - LIFT * F.coalesce("around", F.lit(0.0)))
    return joined.select(*keys, "path", "m", "content", F.coalesce("around", F.lit(0.0)).alias("presentation"), evidence.alias("evidence"))


def _moved(start: Column, inertia: float) -> Column:
    """The start, moved by the evidence of m pages."""
    weight = F.log("m")
    return F.when(F.col("evidence").isNull(), start).otherwise((weight * F.col("evidence") + inertia * start) / (weight + inertia))


def node_importance(pages: DataFrame, host: str, source: str = "html") -> DataFrame:
    """(host, path, m, content, presentation, worth) of every node with texts; content is null on too few pages."""
    each = cut(_tree_counts(pages, host, source))
    everywhere = _measured(each.groupBy("path", "kind", "feature").agg(F.sum("k").alias("k")))
    everywhere = everywhere.select(F.col("path").alias("same"), _moved(F.lit(START), INERTIA[0]).alias("start"))
    # A path may be that of a third of all hosts: its start is looked up in SALTS places.
    everywhere = everywhere.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = _measured(each, "host").withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    nodes = nodes.join(everywhere, (F.col("path") == F.col("same")) & (F.col("salt") == F.col("place")))
    return nodes.select("host", "path", "m", "content", "presentation", F.round(_moved(F.col("start"), INERTIA[1]), 6).alias("worth"))


def _extracted(pages: DataFrame, host: str, source: str, text: str, low_of: str | None, low: dict[str, dict[int, float]]) -> DataFrame:
    """low_of: a column with the importances of the host's nodes, or None if ``low`` has them all."""
    shared = pages.sparkSession.sparkContext.broadcast(low)
    kept = [c for c in pages.columns if c not in (text, low_of, host)]
    nothing: dict[int, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, source):
            out = []
            lists = batch.column(low_of).to_pylist() if low_of else None
            for i, (name, h) in enumerate(zip(batch.column(host).to_pylist(), batch.column(source).to_pylist())):
                if not name:
                    worth = None
                elif lists is None:
                    worth = shared.value.get(name, nothing)
                else:
                    worth = {x["path"]: x["worth"] for x in lists[i] or ()}
                out.append(" ".join(t for _, t in Page(h).main_blocks(worth)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in kept), T.StructField(text, T.StringType())]))


def html_extraction(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds each page's main text, replacing a column of that name."""
    small_batches(pages.sparkSession)
    pages = pages.drop(text)
    host, salt, gone, place = fresh(pages, "host", "salt", "gone", "place")
    named = pages.withColumn(host, host_column(F.col(url)))
    low = cut(node_importance(named, host, source).where(F.col("worth") < max(LEAST[OUTSIDE:])).select("host", "path", "worth"))
    if low.count() <= broadcast_rows:
        by_host: dict[str, dict[int, float]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r["host"], {})[r["path"]] = r["worth"]
        return _extracted(named, host, source, text, None, by_host)
    lists = low.groupBy(F.col("host").alias(place)).agg(F.collect_list(F.struct("path", "worth")).alias(gone))
    lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(url, F.length(source)), F.lit(SALTS)).cast("int")
    joined = named.join(lists, (F.col(host) == F.col(place)) & (F.col(salt) == own), "left").drop(place, salt)
    return _extracted(joined, host, source, text, gone, {})
