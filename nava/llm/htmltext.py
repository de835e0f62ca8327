"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with the path of tags (and classes) from the root. For each distinct path the text
length and the punctuation of all its nodes are added up and divided by the number of nodes. Both ratios are smoothed over the page
order with a Gaussian and fused by multiplication with what the path's tags, classes, ids and roles say: nothing for menus, headers, footers,
sidebars, notices, adverts, forms and comments, more for <article> and <main>. The threshold is a share of the scores' spread, and paths above it
are content. The lowest element that holds nearly all of the content (length by score) is the region: a path
inside of it has at least the region's score, so that an article's headings and short items stand with it, and one outside has none. The
nodes whose path reaches the threshold are the result. Scripts, styles and the like hold no text and are no nodes.

Blocks: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by \n;
<br> is white space.

Nulls, ties and edges: a null page is an empty one; a page without text gives ""; broken and unclosed markup is read as HTML
does, as far as paragraphs and list items close by themselves; pages of any length are read whole; equal rows give equal rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nava.session import ship

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SILENT = frozenset("script style noscript template iframe head title svg object canvas".split())
DROPPED = frozenset(
    "script style noscript template iframe noembed noframes head title nav header footer aside form button select textarea menu dialog svg object canvas".split()
)
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption hr address details summary fieldset hgroup center".split()
)
CLOSES_P = BLOCK - frozenset("html body li dt dd td th tr tbody thead tfoot caption figcaption summary".split())
#: What a class, id or role says of a part that isn't the article. In the article's own header, headings are kept.
NAMED = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar rail aside widget related recommend recommended recommendations "
    "notice notices cookie cookies consent gdpr banner alert popup modal newsletter subscribe subscription signup paywall "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "form search login comment comments commentlist respond replies reply disqus discussion "
    "share sharing social toolbar pagination pager copyright legal disclaimer skiplink contentinfo complementary hidden".split()
)
#: Words that may stand beside those in one class; any other word (with-sidebar, ad-free, search-result) makes it a class of its own.
BESIDE = frozenset(
    "site page global top bottom left right main primary secondary list box block bar container wrapper wrap area section slot unit item items links icons buttons "
    "post posts article articles entry".split()
)
#: With these an article's own header is meant.
OWN = frozenset("post posts article articles entry section".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PUNCTUATION = re.compile(r"[.,;:!?…،؛؟。、！？]")
TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<[!?](?P<other>[^>]*)(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|</(?P<bogus>[^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


class Node:
    """An open element."""

    __slots__ = ("tag", "key", "parent", "why", "dropped", "index")

    def __init__(self, tag: str, key: str, parent: "Node | None", why: str, index: int):
        self.tag, self.key, self.parent, self.why, self.index = tag, key, parent, why, index
        self.dropped = bool(why or parent and parent.dropped)


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(text)}


def is_named(token: str) -> bool:
    """Whether a class, id or role names something else than the article, as a whole."""
    token = token.lower().replace("side-bar", "sidebar").replace("skip-link", "skiplink")
    parts = [x for x in (x.rstrip("0123456789") for x in re.split(r"[-_]+", token)) if x]
    names = NAMED.intersection(parts)
    if not names or not all(x in NAMED or x in BESIDE for x in parts):
        return False
    return not (names <= {"header", "banner"} and OWN.intersection(parts))


def unwanted(tag: str, found: dict[str, str], inside_article: bool) -> str:
    """"tag" or "name" by what says that an element isn't part of the article, or ""."""
    if tag in DROPPED:
        return "" if tag == "header" and inside_article else "tag"
    if tag in ("html", "body", "main", "article"):
        return ""
    if "hidden" in found or found.get("aria-hidden") == "true":
        return "tag"
    said = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    if not any(map(is_named, said.split())):
        return ""
    return "" if tag in HEADINGS and not re.search(r"comment|related|share|ad", said, re.I) else "name"


def blocks(page: str) -> list[tuple[str, Node, bool]]:
    """The page's text nodes joined to blocks: text, element, and whether it is part of what is dropped."""
    root = Node("", "", None, "", 0)
    top, made = root, 0
    out: list[tuple[str, Node, bool]] = []
    held: list[str] = []
    owner = root
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append((text, owner, owner.dropped))
            held.clear()

    def add(text: str) -> None:
        nonlocal owner
        if not text:
            return
        block = top
        while block.parent is not None and block.tag not in BLOCK and not block.dropped:
            block = block.parent
        if held and block is not owner:
            flush()
        owner = block
        held.append(text)

    def close(upto: Node) -> None:
        nonlocal top
        node = top
        while node is not upto.parent:
            if node.tag in BLOCK or node.dropped:
                flush()
            node = node.parent
        top = upto.parent

    def opened(tags: frozenset[str] | set[str], stop: frozenset[str] | set[str]) -> Node | None:
        node = top
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.parent
        return None

    stops = {"table", "td", "th", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form", "button"}
    while at < n:
        match = TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["close"]:
            if tag == "br":
                add(" ")
            elif tag == "p" and opened({"p"}, stops) is None:
                flush()
            elif tag not in VOID and (node := opened({tag}, frozenset() if tag in stops or tag in ("html", "ul", "ol", "dl") else stops)) is not None:
                close(node)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES_P or tag in DROPPED and tag not in ("script", "style", "template", "noscript", "button", "select", "textarea", "svg", "object", "canvas", "iframe"):
            if (node := opened({"p"}, stops)) is not None:
                close(node)
        for own, limit in (({"li"}, {"ul", "ol"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"table"}), ({"tr"}, {"table"}), ({"option"}, {"select"})):
            if (tag in own or tag == "tr" and "td" in own) and (node := opened(own, limit)) is not None:
                close(node)
        if tag in BLOCK or tag in DROPPED:
            flush()
        if tag in VOID:
            continue
        found = attributes(match["attrs"]) if match["attrs"].strip(" /\t\n") else {}
        inside = opened({"article", "main"}, frozenset()) is not None
        made += 1
        name = tag + "".join("." + c for c in sorted(found.get("class", "").split()))
        node = Node(tag, f"{top.key}/{name}", top, unwanted(tag, found, inside), made)
        if match["attrs"].endswith("/") and tag in ("svg", "path", "use", "g"):
            continue
        top = node
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out


def smooth(values: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the ends are repeated."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


#: What a path's tags say: its weight inside <article>, inside <main>, and elsewhere.
ARTICLE, MAIN, PLAIN = 8.0, 2.0, 1.0
#: The threshold as a share of the scores' standard deviation, and the share of the content that the region must hold.
SPREAD = 0.5
HOLDS = 0.9
#: The share of the page's text that keeps an element from being dropped by its name.
MOST = 0.75

Block = tuple[str, Node, bool]


def up_from(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def roles(found: list[Block]) -> list[float]:
    """The weight of each block's path by its tags and names: 0 for what isn't part of an article. A name counts for nothing on
    elements that hold the longest article or, on pages without one, MOST of the page's text."""
    chains = [list(up_from(node)) for _, node, _ in found]
    sizes: dict[int, int] = {}
    whole = 0
    for (text, _, _), chain in zip(found, chains):
        if all(x.why != "tag" for x in chain):
            whole += len(text)
            for x in chain:
                sizes[x.index] = sizes.get(x.index, 0) + len(text)
    articles = [x for chain in chains for x in chain if x.tag in ("article", "main") and x.index in sizes]
    if articles:
        spared = {x.index for x in up_from(max(articles, key=lambda x: sizes[x.index]))}
    else:
        spared = {i for i, size in sizes.items() if size >= MOST * whole}
    out = []
    for chain in chains:
        tags = {x.tag for x in chain}
        dropped = any(x.why == "tag" or x.why and x.index not in spared for x in chain)
        out.append(0.0 if dropped else ARTICLE if "article" in tags else MAIN if "main" in tags else PLAIN)
    return out


def ratios(found: list[Block]) -> np.ndarray:
    """Text and punctuation of each block's path, a node of it, smoothed over the page order and fused."""
    totals: dict[str, list[float]] = {}
    for text, node, _ in found:
        total = totals.setdefault(node.key, [0, 0, 0])
        total[0] += len(text)
        total[1] += len(PUNCTUATION.findall(text))
        total[2] += 1
    lengths = smooth(np.array([totals[node.key][0] / totals[node.key][2] for _, node, _ in found]))
    marks = smooth(np.array([totals[node.key][1] / totals[node.key][2] for _, node, _ in found]))
    return lengths * (1 + marks)


def path_scores(found: list[Block]) -> list[float]:
    """The score of each block's path: its highest fused ratio, by its role. Paths without a role are no neighbours of others."""
    own = roles(found)
    used = [i for i, role in enumerate(own) if role]
    scores: dict[tuple[str, float], float] = {}
    if used:
        for i, ratio in zip(used, ratios([found[i] for i in used])):
            path = found[i][1].key, own[i]
            scores[path] = max(scores.get(path, 0.0), float(ratio))
    return [role * scores.get((node.key, role), 0.0) for (_, node, _), role in zip(found, own)]


def region(found: list[Block], scores: list[float], least: float) -> Node | None:
    """The lowest element of several blocks that holds HOLDS of the content, None without one."""
    held: dict[int, list] = {}
    whole = 0.0
    for (text, node, _), score in zip(found, scores):
        if score < least or not score:
            continue
        weight = len(text) * score
        whole += weight
        for depth, up in enumerate(reversed([x for x in up_from(node) if x.parent is not None])):
            if up.tag in BLOCK and up.tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", *HEADINGS):
                entry = held.setdefault(up.index, [0.0, depth, up])
                entry[0] += weight
    best = max((x for x in held.values() if x[0] >= HOLDS * whole), key=lambda x: x[1], default=None)
    return best and best[2]


def main_text(page: str | None) -> str:
    """The blocks whose path reaches the threshold, joined by a line feed."""
    found = [x for x in blocks(page or "") if not any(y.tag in SILENT for y in up_from(x[1]))]
    if not found:
        return ""
    scores = path_scores(found)
    values = np.array(list({(node.key, score): score for (_, node, _), score in zip(found, scores) if score}.values()) or [0.0])
    least = min(float(values.max()), SPREAD * float(values.std()))
    within = region(found, scores, least)
    final = []
    for (_, node, _), score in zip(found, scores):
        if within is not None and score:
            score = max(score, least) if any(x is within for x in up_from(node)) else 0.0
        final.append(score)
    return "\n".join(text for (text, _, _), score in zip(found, final) if score and score >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
