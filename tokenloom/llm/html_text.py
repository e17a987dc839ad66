"""Main text of web pages by a site style tree: the pages of a host are merged node by node, and low-importance branches go.

Every element goes into the tree, under the names (tag and class) from the root down. What a node's text is worth is 1 less the
entropy of its contents over the pages: text that many pages repeat tells nothing about any of them. Names are never
asked whether they look like adverts or menus. Priors that no tree can replace are few and stated: elements and roles that
HTML defines as no main text, an article or main element, and reader comments, which differ from page to page. The tree is asked
inside an article, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import pieces
from ._spark import materialize, pick

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
DIGITS = re.compile(r"[0-9]+")
PLAIN = re.compile(r"[\d\W]+")

# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
SKIPPED = frozenset("noscript template svg select button object video audio canvas".split())  # elements like others, but no main text
MATH = frozenset("math maction menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
SAME_CLOSES = frozenset("p li dd dt tr td th option thead tbody tfoot".split())
# Fixed values, the priors: elements and roles that are no main text, ones that are, and names of reader comments.
NO_CONTENT = frozenset("head nav footer aside form menu dialog".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
COMMENTS = frozenset("comment comments comment-list commentlist comments-area comment-section disqus_thread".split())
PAGE = frozenset(("html", "body"))  # often left out, so no nodes


class Node:
    """An element: ``prior`` is its own, -1 no main text, 1 main text; ``noise`` and ``inside`` hold once priors are settled."""

    __slots__ = ("children", "inside", "key", "main", "name", "noise", "parent", "prior", "size", "text")

    def __init__(self, name: str, key: int, parent, prior: int = 0):
        self.name, self.key, self.parent, self.prior = name, key, parent, prior
        self.children: list[str] = []
        self.text: list[str] = []  # blocks of its own, none of its children's
        self.size, self.main, self.noise, self.inside = 0, int(prior > 0), False, False


def _names(tag: str, attributes: str) -> tuple[str, int]:
    """The node's name in the style tree, tag and class, and its prior."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    cls = found.get("class", "").split()
    role = found.get("role", "").lower()
    prior = 1 if tag in MAIN or role == "main" else -1 if tag in NO_CONTENT or tag == "header" or role in NO_CONTENT_ROLES else 0
    if COMMENTS & {x.lower() for x in (*cls, found.get("id", ""))}:
        prior = -1
    return f"{tag}.{DIGITS.sub('0', ' '.join(sorted(cls)))}", prior


def _settle(nodes: list[Node]) -> None:
    """Priors hold for all that stands inside; headers inside an article are its own.

    None holds against an element that has all of the page's articles in it, nor against a form with over half of its text.
    """
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.main += node.main
    for node in nodes[1:]:
        up, tag = node.parent, node.name.partition(".")[0]
        against = node.prior < 0 and not 0 < node.main == nodes[0].main and not (tag == "header" and up.inside) and not (tag == "form" and 2 * node.size > nodes[0].size)
        node.noise = up.noise or against
        node.inside = up.inside or node.prior > 0


def _ends(html: str, place: int) -> dict[int, int]:
    """Where the SKIPPED elements from here on end, by the place after their start tags; without those that nothing closes.

    An end tag closes the last open element of its name.
    """
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    n = len(html)
    while place < n and (m := TAG.search(html, place)):
        place = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1] and not m[3].rstrip().endswith("/"):
            end = _raw_end(tag, html, place)
            place = end.end() if end else n
        elif tag in SKIPPED and not m[1] and not m[3].rstrip().endswith("/"):
            opened[tag].append(place)
        elif tag in SKIPPED and m[1] and opened[tag]:
            found[opened[tag].pop()] = place
    return found


def _raw_end(tag: str, html: str, place: int) -> re.Match | None:
    return re.compile(rf"</{tag}\s*>", re.I).search(html, place)


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order, and the blocks of text between their bounds, each with its innermost element.

    Inline elements don't bound blocks, void ones are white space; raw ones, skipped ones and the head go, with all inside;
    an end tag closes up to the last open element of its name, and is nothing where there is none. What nothing closes
    goes on to the end of the page if it is raw, and ends with its parent or before an article if it is skipped.
    """
    root = Node("", 0, None)
    nodes, blocks, at = [root], [], root
    words: list[str] = []
    place, n = 0, len(html)
    ends: dict[int, int] | None = None
    loose = False  # a skipped element that nothing closes is open

    def flush() -> None:
        if words:
            text = " ".join(unescape("".join(words)).split())
            words.clear()
            if text:
                blocks.append((at, text))
                at.text.append(text)
                at.size += len(text)

    while place < n:
        m = TAG.search(html, place)
        if m is None:
            words.append(html[place:])
            break
        if m.start() > place:
            words.append(html[place : m.start()])
        place = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            if html.startswith("<![CDATA[", m.start()):
                words.append(html[m.start() + 9 : m.end() - 3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag in INLINE or tag in MATH:
            continue
        if tag in PAGE:
            flush()
            if tag == "body" and not m[1]:
                at = root
            continue
        if tag in VOID:
            words.append(" ")
            continue
        if m[1]:
            node = at
            while node is not root and node.name.partition(".")[0] != tag:
                node = node.parent
            flush()
            if node is not root:
                at = node.parent
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _raw_end(tag, html, place)
                place = end.end() if end else n
            words.append(" ")
            continue
        if tag in SKIPPED:
            ends = _ends(html, m.start()) if ends is None else ends
            if place in ends or m[3].rstrip().endswith("/"):
                place = ends.get(place, place)
                words.append(" ")
                continue
        flush()
        if tag in SKIPPED:
            at = Node(tag, xxhash.xxh64_intdigest(f"{at.key}/{tag}".encode()), at, -1)
            nodes.append(at)
            loose = True
            continue
        if loose:
            up = outer = at
            while up is not root:
                if up.name in SKIPPED:
                    outer = up.parent
                up = up.parent
            name = outer.name.partition(".")[0]
            if tag in MAIN or name == "p" or (name == tag and tag in SAME_CLOSES):
                at = outer
        name = at.name.partition(".")[0]
        if name == "p" or (name == tag and tag in SAME_CLOSES):
            at = at.parent
        name, prior = _names(tag, m[3])
        if not at.children or at.children[-1] != name:
            at.children.append(name)
        at = Node(name, xxhash.xxh64_intdigest(f"{at.key}/{name}".encode()), at, prior)
        nodes.append(at)
    flush()
    _settle(nodes)
    return nodes, blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_features(html: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(the page's longest block, (node, kind, value, children) of its tree): kind 1 is a node's presentation, once, 2 one of its contents.

    Nodes of one key count as one. Contents are blocks of text, without digits and punctuation.
    """
    nodes, blocks = parse(html)
    merged: dict[int, tuple[dict[str, None], dict[int, None]]] = {}
    for node in nodes:
        styles, texts = merged.setdefault(node.key, ({}, {}))
        styles.update(dict.fromkeys(node.children))
        for text in node.text:
            texts[xxhash.xxh64_intdigest(PLAIN.sub(" ", text).strip().lower().encode())] = None
    rows = []
    for key, (styles, texts) in merged.items():
        if texts:
            rows.append((_signed(key), 1, _signed(xxhash.xxh64_intdigest("|".join(styles).encode())), len(styles)))
            rows += [(_signed(key), 2, _signed(x), len(styles)) for x in texts]
    longest = max((text for _, text in blocks), key=len, default="")
    return _signed(xxhash.xxh64_intdigest(longest.encode())), sorted(rows)


ITEMS = "array<struct<node:bigint,kind:int,value:bigint,children:int>>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("children", pa.int32())])
    for piece in pieces(batches, "html", 8 << 20):
        found = [page_features(h or "") for h in piece.column("html").to_pylist()]
        items = [[dict(zip(("node", "kind", "value", "children"), r, strict=True)) for r in rows] for _, rows in found]
        yield pa.RecordBatch.from_arrays([piece.column("host"), pa.array([x for x, _ in found], pa.int64()), pa.array(items, pa.list_(item))], ["host", "capture", "items"])


def _counted(pages: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Of each tree: (node, kind, value) with n, how many pages have it, and m, how many have the node."""
    rows = pages.select(*by, F.explode("items").alias("i")).select(*by, "i.*")
    counts = rows.groupBy(*by, "node", "kind", "value").agg(F.count("*").alias("n"), F.max("children").alias("children"))
    counts, _ = materialize(counts, "counts")
    nodes = counts.filter("kind = 1").groupBy(*by, "node").agg(
        F.sum("n").alias("m"), F.max("children").alias("l"), F.sum(F.col("n") * F.log("n")).alias("styles"),
    )
    return counts.filter("kind = 2").select(*by, "node", "value", "n"), nodes


def importance(pages: DataFrame, gamma: float = 0.9, smooth: float = 10.0) -> DataFrame:
    """pages (host, html) -> (host, node, m, importance) of each node of a host's tree that has text of its own.

    Pages that share their longest block are one capture and count once, on a host and among all hosts: copies and
    recaptures of an article don't make it boilerplate. Of a node that m captures have, a content that c of them share has
    entropy log c / log m (0 if m is 1); so in the host's tree and in that of all hosts, and the larger counts. The mean of
    these, taken together with ``smooth`` times the mean of the same node in the tree of all hosts, is what its contents are short of
    1: a host of a few pages is judged by what is known of all, one of many by itself, without a bound between them. Its
    presentations (kinds of children) are worth the entropy of their distribution. With l kinds of children presentation weighs 1 -
    gamma^l and content gamma^l. A node without anything repeated has importance 1: a single page shows nothing.
    """
    rows = pages.mapInArrow(_features, f"host string, capture long, items {ITEMS}")
    own, _ = materialize(rows.groupBy("host", "capture").agg(F.min("items").alias("items")), "captures")
    every = own.groupBy("capture").agg(F.min("items").alias("items"))
    contents, nodes = _counted(own, "host")
    all_contents, all_nodes = _counted(every)
    all_means = all_contents.groupBy("node").agg(F.avg(F.log(F.col("n").cast("double"))).alias("mean"))
    known = all_nodes.select("node", F.col("m").alias("m_all")).join(all_means, "node")
    info = nodes.join(known, "node")  # a row for each host's node; contents, of which one node may have most, never meet by node alone
    entropy = lambda log_n, m: F.when(F.col(m) > 1, log_n / F.log(F.col(m).cast("double"))).otherwise(0.0)
    log = lambda n: F.log(F.col(n).cast("double"))
    both = contents.join(info.select("host", "node", "m", "m_all"), ["host", "node"]).join(all_contents.withColumnRenamed("n", "n_all"), ["node", "value"])
    sums = both.groupBy("host", "node").agg(F.sum(F.greatest(entropy(log("n"), "m"), entropy(log("n_all"), "m_all"))).alias("sum"), F.count("*").alias("k"))
    found = info.join(sums, ["host", "node"])
    shared = (F.col("sum") + smooth * entropy(F.col("mean"), "m_all")) / (F.col("k") + smooth)
    style = F.when(F.col("m") > 1, (F.log("m") - F.col("styles") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.pow(F.lit(gamma), F.col("l"))
    return found.select("host", "node", "m", ((1 - weight) * style + weight * (1 - shared)).alias("importance"))


def low_branches(pages: DataFrame, threshold: float = 0.8, prior: float = 40.0) -> DataFrame:
    """(host, low array<node>, firm array<node>): nodes of low importance; they are of the host's templates, as a node on one page alone has importance 1.

    Firm are those of them that stay low if an article or main element is counted as ``prior`` captures of importance 1.
    """
    firm = (F.col("m") * F.col("importance") + prior) / (F.col("m") + prior) < threshold
    found = importance(pages).filter(F.col("importance") < threshold)
    return found.groupBy("host").agg(F.collect_list("node").alias("low"), F.collect_list(F.when(firm, F.col("node"))).alias("firm"))


def main_text(html: str, low: set[int], firm: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks that are left: none in a node of low importance, so a branch goes where all its nodes are low, and none against which a prior holds.

    An article or main element is a prior, too: where a page marks one, only what is in it; the tree decides there as well,
    but needs more captures to speak against it (``firm``).
    """
    _, blocks = parse(html)
    blocks = [(node, text) for node, text in blocks if not node.noise]
    marked = any(node.inside for node, _ in blocks)
    out = firm if marked else low
    return " ".join(text for node, text in blocks if node.inside >= marked and _signed(node.key) not in out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "html", 8 << 20):
        lows, firms = ([set(x or ()) for x in piece.column(c).to_pylist()] for c in ("low", "firm"))
        texts = [main_text(h or "", *x) for h, *x in zip(piece.column("html").to_pylist(), lows, firms, strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): each page's main text, blocks joined by a space; an empty string where there is none (null html, too).

    Pages without a host share one tree. Repeated rows are captures of one page, and give repeated rows. Very long pages
    are parsed whole; an empty table gives no rows; other columns, clashing names too, are left behind. Ties don't arise.
    Counts of hot hosts are summed before they move; to the pages go only the low nodes of their host.
    """
    pages = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("id", F.col("id").cast("long"))
    pages = pages.withColumn("host", F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit("")))
    low, _ = materialize(low_branches(pages.select("host", "html")), "low")
    joined = pages.join(low, "host", "left").select("id", "url", "html", "low", "firm")
    return joined.mapInArrow(_extract, "id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
