"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. An element node is an element at one place of its parent's style, a style the row of labels
(tag and classes, runs taken together) of an element's children, and text is a leaf. A leaf is important if its texts differ from page
to page, an element if its pages lay it out differently or what it holds is important; both by entropy. Elements that hold text and, with
all they contain, are of low importance go from each page. What HTML or its names mark as menu, header, footer, form, advert ... is of no importance on any page.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import join_hot, materialize, ship, slices

#: Weight of an element's own presentation falls with the number of its styles; importance below which a branch goes; pages of a host that must show it.
GAMMA, THRESHOLD, LEAST_PAGES = 0.9, 0.4, 5
#: Levels of the tree; what is nested deeper belongs to the element of the last level.
DEPTH = 24
#: Bytes of all hosts' unimportant branches that are sent to all tasks at most; more are joined by host.
SENT_BYTES = 16_000_000

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are of no importance, and words of class, id or role that say the same of any element.
NO_PART = frozenset("head nav aside footer form button select option datalist dialog menu object audio video map".split())
NO_PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe "
    "subscription signup login register nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead toolbar share sharing social related recommended "
    "recommendations pagination pager widget widgets search dialog comment comments commentlist disqus respond reply replies discussion disclaimer copyright".split()
)
#: The same, but only outside an article; and those that tell a comment from an article.
OUTER_WORDS = frozenset("header heading top".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p "
    "pre section select summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open element of the named kinds, but not beyond the elements after the bar.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_P_SCOPE = frozenset("button table td th caption object body html".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|=)*+)>")
_ATTR = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))|([^\s/>=]+)")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    """The host of an absolute address in lower case; otherwise empty."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Element:
    """down: its level; top: itself, or above DEPTH the element that it counts as."""

    __slots__ = ("down", "key", "label", "no_part", "parent", "style", "tag", "top", "words")

    def __init__(self, tag: str, parent: Element | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.down = parent.down + 1 if parent else 0
        self.top = self if self.down <= DEPTH else parent.top
        self.label, self.words, self.no_part = tag, frozenset(), False
        if attrs:
            held = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m[1]}
            bare = {m[5].lower() for m in _ATTR.finditer(attrs) if m[5]}
            names = f"{held.get('class', '')} {held.get('id', '')}"
            self.words = frozenset(w.lower() for w in _NAMES.findall(f"{names} {held.get('role', '')}"))
            self.label = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in held.get("class", "").split()})])
            self.no_part = "hidden" in bare or "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(held.get("style", "")))

    def is_article(self) -> bool:
        return (self.tag in ("article", "main") or "main" in self.words and self.tag not in ("html", "body")) and not self.words & COMMENT_WORDS


def read(page: str) -> tuple[list[Element], list[tuple[Element, int, str]]]:
    """The elements and the texts (element, block, decoded text) in their order. Comments, raw text and what a broken tag leaves open are passed over."""
    root = at = Element("html", None)
    elements = [root]
    texts: list[tuple[Element, int, str]] = []
    block, pos, n = 0, 0, len(page)

    def text(s: str) -> None:
        texts.append((at, block, entities.unescape(s)))

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        if lt > pos:
            text(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = end + 3 if end >= 0 else n
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                pos = end + 1 if end >= 0 else n
            elif re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                pos = n  # a tag that never ends
            else:
                text("<")
                pos = lt + 1
            continue
        pos = m.end()
        tag = m[2].lower()
        if tag in BLOCKS:
            block += 1
        if m[1]:
            if tag == "br":
                text(" ")
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up is not root:
                at = up.parent
            continue
        if tag in ("br", "td", "th", "hr", "wbr"):
            texts.append((at, block, "" if tag == "wbr" else " "))
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            pos = page.find(">", end.end()) + 1 if end else n
            pos = pos or n
            continue
        if tag in VOID:
            continue
        if tag == "html":
            continue
        ends, stop = _ENDS.get(tag, (None, None))
        if ends is None and tag in BLOCKS:
            ends, stop = {"p"}, _P_SCOPE
        if ends:
            up, close = at, None
            while up is not root and up.tag not in stop:
                if up.tag in ends:
                    close = up
                up = up.parent
            if close is not None:
                at = close.parent
        made = Element(tag, at, m[3])
        elements.append(made)
        at = made
    return elements, texts


def parts(page: str | None) -> tuple[list[tuple[Element, int, str]], bool]:
    """The texts that may be of the article, and whether the page names its article. A page that does has no part outside of it.

    What holds the longest article is no menu or the like, whatever its classes say; nor is a form that holds most of a page without one.
    """
    elements, texts = read(page or "")
    size = dict.fromkeys(map(id, elements), 0)
    for e, _, t in texts:
        size[id(e)] += len(t.strip())
    for e in reversed(elements):
        if e.parent is not None:
            size[id(e.parent)] += size[id(e)]
    articles = [e for e in elements if e.is_article()]
    around: set[int] = set()
    if articles:
        # The longest <article>, unless most of the longest <main> is outside of it.
        longest = max(size[id(e)] for e in articles)
        up = max(articles, key=lambda e: (e.tag == "article" and 2 * size[id(e)] >= longest, size[id(e)])).parent
        while up is not None:
            around.add(id(up))
            up = up.parent
    else:
        around = {id(e) for e in elements if e.tag == "form" and 2 * size[id(e)] > size[id(elements[0])]}
    gone: set[int] = set()
    within: dict[str, set[int]] = {"article": set(), "main": set()}
    for e in elements:
        up = id(e.parent)
        inner = up in within["article"] or up in within["main"]
        own = e.is_article()
        named = e.tag in NO_PART or e.tag == "header" and not inner
        named = named or e.tag not in ("html", "body") and not own and bool(e.words & NO_PART_WORDS or not inner and e.words & OUTER_WORDS)
        if up in gone or e.no_part or named and id(e) not in around:
            gone.add(id(e))
            continue
        for kind, held in within.items():
            if up in held or own and (e.tag == "article") == (kind == "article"):
                held.add(id(e))
    live = [(e, b, t) for e, b, t in texts if id(e) not in gone]
    for held in within.values():
        if held:
            return [(e, b, t) for e, b, t in live if id(e) in held], True
    return live, False


def _hash(*values) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, values))) - (1 << 63)


def style_tree(texts: list[tuple[Element, int, str]]) -> tuple[list[tuple], list[tuple], list[int]]:
    """The page's part of its site's tree: elements (key, parent's key, parent's style, level, style), text leaves (element's key, its style, feature), and the key of each text's element.

    Only elements with text in them are in the tree.
    """
    texts = [(e.top, b, t) for e, b, t in texts]
    kids: dict[int, list] = {}
    seen: set[int] = set()
    order: list[Element] = []
    for i, (e, _, t) in enumerate(texts):
        if not t.strip():
            continue
        chain, up = [], e
        while up is not None and id(up) not in seen:
            seen.add(id(up))
            chain.append(up)
            up = up.parent
        for x in reversed(chain):
            order.append(x)
            kids[id(x)] = []
            if x.parent is not None:
                kids[id(x.parent)].append(x)
        kids[id(e)].append(i)
    nodes, leaves, keys = [], [], [0] * len(texts)
    for e in order:
        row: list[str] = []
        places = []
        for c in kids[id(e)]:
            label = "#text" if isinstance(c, int) else c.label
            if not row or row[-1] != label:
                row.append(label)
            places.append(len(row) - 1)
        e.style = _hash(*row)
        if e.parent is None:
            e.key = _hash("root")
            nodes.append((e.key, 0, 0, 0, e.style))
        for c, place in zip(kids[id(e)], places, strict=True):
            if isinstance(c, int):
                leaves.append((e.key, e.style, place, _hash(" ".join(texts[c][2].split()))))
            else:
                c.key = _hash(e.key, e.style, place, c.label)
    for e in order:
        if e.parent is not None:
            nodes.append((e.key, e.parent.key, e.parent.style, e.down, e.style))
    for i, (e, _, t) in enumerate(texts):
        if t.strip():
            keys[i] = e.key
    return nodes, leaves, keys


def joined(texts: list[tuple[int, str]]) -> str:
    """Texts (block, text) as blocks: white space inside a block as one space, blocks apart by an empty line."""
    blocks: list[str] = []
    last, held = None, []
    for b, t in [*texts, (None, "")]:
        if b != last and held:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held = []
        last = b
        held.append(t)
    return "\n\n".join(blocks)


_NODE = "struct<key: long, up: long, up_style: long, level: int, style: long>"
_LEAF = "struct<key: long, style: long, place: int, feature: long>"
_TEXT = "struct<key: long, block: int, text: string>"


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, digest, named, nodes, leaves, texts): each page read once. A null html is empty."""
    kind = T.StructType([*pages.select("page_id", "url").schema, *T.StructType.fromDDL(f"host string, digest long, named boolean, nodes array<{_NODE}>, leaves array<{_LEAF}>, texts array<{_TEXT}>")])
    kinds = [pa.list_(pa.struct([(n, pa.int32() if n in ("level", "place", "block") else pa.string() if n == "text" else pa.int64()) for n in names.split()])) for names in ("key up up_style level style", "key style place feature", "key block text")]

    def work(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    texts, named = parts(page)
                    nodes, leaves, keys = style_tree(texts)
                    kept = [{"key": k, "block": b, "text": t} for k, (_, b, t) in zip(keys, texts, strict=True)]
                    digest = _hash(*[f for *_, f in leaves])
                    rows.append((host_of(url), digest, named, [dict(zip(("key", "up", "up_style", "level", "style"), x, strict=True)) for x in nodes], [dict(zip(("key", "style", "place", "feature"), x, strict=True)) for x in leaves], kept))
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), pa.int64(), pa.bool_(), *kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], kind.names)

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(work, kind)


def importance(parsed: DataFrame) -> DataFrame:
    """(host, key, pages, importance, most): of each element of each host's tree its composite importance, and the largest one in its branch.

    Pages of a host with the same texts count once. A host's features and styles are summed before they are shuffled, and the tree is
    gone up level by level, so no task holds a host.
    """
    once = parsed.where("host <> ''").select("host", "digest", "nodes", "leaves").withColumn("nth", F.monotonically_increasing_id())
    first = once.groupBy("host", "digest").agg(F.min("nth").alias("nth"))
    once = once.join(first.select("nth"), "nth", "left_semi")
    nodes = once.select("host", "nth", F.explode("nodes").alias("x")).select("host", "nth", "x.*").groupBy("host", "nth", "key", "up", "up_style", "level", "style").agg(F.count("*").alias("times"))
    styles = nodes.groupBy("host", "key", "up", "up_style", "level", "style").agg(F.sum("times").alias("times"))
    styles = materialize(styles, "styles")
    shown = materialize(nodes.select("host", "nth", "key").distinct().groupBy("host", "key").agg(F.count("*").alias("pages")), "shown")
    tf = once.select("host", "nth", F.explode("leaves").alias("x")).groupBy("host", "x.key", "x.style", "x.place", "x.feature", "nth").agg(F.count("*").cast("double").alias("tf"))
    of_feature = tf.groupBy("host", "key", "style", "place", "feature").agg(F.sum("tf").alias("t"), F.sum(F.col("tf") * F.log("tf")).alias("s"))
    # The entropy of a feature over pages, times ln(pages): ln T - sum(tf ln tf) / T.
    leaves = of_feature.groupBy("host", "key", "style", "place").agg(F.avg(F.log("t") - F.col("s") / F.col("t")).alias("h"))
    leaves = leaves.join(shown, ["host", "key"]).select("host", F.col("key").alias("up"), F.col("style").alias("up_style"), F.when(F.col("pages") == 1, 1.0).otherwise(1 - F.least(F.lit(1.0), F.col("h") / F.log("pages"))).alias("importance"))
    leaves = materialize(leaves.withColumn("most", F.col("importance")), "leaves")
    deepest = styles.agg(F.max("level")).first()[0]
    below, found = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = styles.where(F.col("level") == level)
        # A text's element is the one that its key names; elements below have told theirs.
        children = leaves if below is None else leaves.unionByName(below.select("host", "up", "up_style", "importance", "most"))
        held = children.groupBy("host", "up", "up_style").agg(F.avg("importance").alias("within"), F.max("most").alias("most")).withColumnsRenamed({"up": "key", "up_style": "style"})
        each = here.join(held, ["host", "key", "style"]).join(shown, ["host", "key"])
        by_key = each.groupBy("host", "key", "up", "up_style", "pages").agg(
            F.count("*").alias("l"), F.sum("times").alias("n"), F.sum(F.col("times") * F.log("times")).alias("s"), F.sum(F.col("times") * F.col("within")).alias("w"), F.max("most").alias("most")
        )
        layout = F.when(F.col("pages") == 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log("n") - F.col("s") / F.col("n")) / F.log("pages")))
        fade = F.pow(F.lit(GAMMA), F.col("l"))
        own = by_key.withColumn("importance", (1 - fade) * layout + fade * F.col("w") / F.col("n"))
        below = materialize(own.select("host", "key", "up", "up_style", "pages", "importance", F.greatest("importance", "most").alias("most")), "level")
        found = below if found is None else found.unionByName(below)
    if found is None:
        return parsed.sparkSession.createDataFrame([], "host string, key long, pages long, importance double, most double")
    return found.select("host", "key", "pages", "importance", "most")


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html): its main text.

    A branch goes if least_pages different pages of its host show it and all importance in it is below the threshold; but a named article
    loses at most half of its text that way, and no page all of it. Pages without a host (no absolute address) are of no site. Null and
    empty pages, and those without text, have an empty text. Rows may repeat; each has a row of its own.
    """
    spark = pages.sparkSession
    ship(spark)
    parsed = materialize(parse(pages), "parsed")
    low = importance(parsed).where((F.col("most") < threshold) & (F.col("pages") >= least_pages))
    low = materialize(low.groupBy("host").agg(F.collect_set("key").alias("low")), "low")
    size = low.agg(F.sum(F.length("host") + 8 * F.size("low") + 32)).first()[0] or 0
    texts = parsed.select("page_id", "url", "host", "named", "texts")
    together = texts.join(F.broadcast(low), "host", "left") if size <= SENT_BYTES else join_hot(texts, low, "host", "left")
    together = together.select("page_id", "url", "named", "texts", "low")
    kind = T.StructType([*together.schema[:2], *T.StructType.fromDDL("text string, n_chars long")])

    def choose(batches):
        for batch in batches:
            out = []
            for named, texts, low in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                low = set(low or ())
                every = [(t["block"], t["text"]) for t in texts]
                kept = [(t["block"], t["text"]) for t in texts if t["key"] not in low] if low else every
                if len(kept) < len(every):
                    whole, rest = (sum(len(t.strip()) for _, t in x) for x in (every, kept))
                    if 2 * rest < whole if named else not rest:
                        kept = every
                out.append(joined(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], kind.names)

    return together.mapInArrow(choose, kind)
