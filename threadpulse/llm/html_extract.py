"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, in_batches, text_of

NAMING = re.compile(r"class|id|role|hidden|style", re.I)
OPEN = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*|<!--|<[!?]")
#: the rest of a tag up to its end, which doesn't count inside quotes
REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and that never belong to an article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary figcaption".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input object embed video audio canvas map dialog menu search title".split())
#: Words of class, id and role that name what is not the article
CHROME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|masthead|footer|sidebar|aside|ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|cookie\w*|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|share|sharing|social|related|recommend\w*|comments?|commentlist|discussion|disqus|replies|respond|breadcrumbs?|pagination|pager|toolbar|login|search|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: names of headers, but not with words that name an article's own; layout words say what stands beside an element, not what it is
HEADER = re.compile(r"(?:^|[\s_-])(?:header|top-bar|site-header)(?:$|[\s_-])", re.I)
OWN_HEADER = re.compile(r"(?:post|entry|article|story|content|title|section|chapter)[_-]?header|header[_-]?(?:title|text|content)", re.I)
LAYOUT = re.compile(r"^(?:has|with|without|no|is|layout|page|js)[_-]", re.I)
#: chrome that stays chrome however much of a page it holds
SURELY = re.compile(r"comment|discussion|disqus|replies|respond|related|recommend", re.I)
SPACE = re.compile(r"\s+")
ROOTS = ("article", "main")


class Node:
    __slots__ = ("by_name", "chrome", "children", "label", "tag")

    def __init__(self, tag: str, label: str, chrome: bool, by_name: bool = False):
        self.tag, self.label, self.chrome, self.by_name, self.children = tag, label, chrome, by_name, []


def tags(html: str):
    """(start, end, closing, tag name, attributes) of each tag in turn; name None for comments and declarations. Each character is looked at a bounded
    number of times: what once has no end is not searched for again."""
    at, n, quotes, no_comment_end = 0, len(html), True, False
    last = html.rfind(">")
    while at < n:
        m = OPEN.search(html, at)
        if m is None or m.start() > last:
            return
        if m[0] == "<!--":
            end = -1 if no_comment_end else html.find("-->", m.end())
            no_comment_end = end < 0
            at = yield m.start(), end + 3 if end >= 0 else n, False, None, ""
            continue
        rest = REST.match(html, m.end()) if quotes else None
        if rest is None:
            quotes = False  # a quote without its pair: from here on the next > ends a tag
            end = html.find(">", m.end()) + 1
            if not end:
                return
        else:
            end = rest.end()
        name = m[0].lstrip("</").lower()
        at = yield m.start(), end, m[0][1] == "/", None if m[0][1] in "!?" else name, html[m.end() : end - 1]


def names_chrome(said: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id or role name what is no part of an article, and whether they name a header."""
    words = [w for k in ("class", "id", "role") for w in (said.get(k) or "").split() if not LAYOUT.match(w)]
    names = " ".join(words)
    return bool(CHROME.search(names)), any(HEADER.search(w) and not OWN_HEADER.search(w) for w in words)


def parse(html: str) -> Node:
    """A tolerant DOM tree: nodes and strings. Void, raw and unclosed elements as in HTML; an end tag without a start is ignored."""
    root = Node("#root", "", False)
    stack, at, n, raw_end, open_tags, by_name = [root], 0, len(html), {}, Counter(), []
    found = tags(html)
    token = next(found, None)
    while token is not None:
        start, end, closing, tag, attributes = token
        if start > at:
            stack[-1].children.append(html[at:start])
        at = end
        if tag is not None:
            if closing:
                _close(stack, tag, open_tags)
            else:
                node = _open(stack, tag, attributes, open_tags)
                if node.by_name:
                    by_name.append(node)
                closed = attributes.endswith("/")
                if tag in RAW and not closed:
                    stop = None
                    if tag not in raw_end:
                        stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                        if stop is None:
                            raw_end[tag] = n
                    node.children.append(html[at : stop.start() if stop else n])
                    at = stop.end() if stop else n
                elif tag not in VOID and not (closed and tag not in BLOCK):
                    stack.append(node)
                    open_tags[tag] += 1
        try:
            token = found.send(at)
        except StopIteration:
            token = None
    if at < n:
        stack[-1].children.append(html[at:])
    _spare_dominant(root, by_name)
    return root


def _cut(stack: list[Node], k: int, open_tags: Counter) -> None:
    for node in stack[k:]:
        open_tags[node.tag] -= 1
    del stack[k:]


def _close(stack: list[Node], tag: str, open_tags: Counter) -> None:
    if not open_tags[tag]:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            _cut(stack, k, open_tags)
            return
        if stack[k].tag in ("article", "main", "table") and tag not in BLOCK:
            return


def _open(stack: list[Node], tag: str, attributes: str, open_tags: Counter) -> Node:
    stop = SIBLINGS.get(tag, ())
    if tag in CLOSES_P and open_tags["p"] or stop and any(open_tags[x] for x in stop):
        for k in range(len(stack) - 1, 0, -1):
            open_ = stack[k].tag
            if open_ == "p" and tag in CLOSES_P or open_ in stop:
                _cut(stack, k, open_tags)
                if open_ == "p" or tag != "tr":
                    break
            elif open_ in BLOCK:
                break
    chrome, by_name, label = tag in CHROME_TAGS, False, tag
    inside = open_tags["article"] > 0 or open_tags["main"] > 0
    if NAMING.search(attributes):
        said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        label = f"{tag}.{said.get('class', '')}" if said.keys() & {"class", "id", "role", "hidden", "aria-hidden", "style"} else tag
        if tag not in ("html", "body", "main"):
            named, header = names_chrome(said)
            by_name = (named or header and not inside) and not chrome
            chrome |= by_name or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower()
            if by_name and SURELY.search(" ".join(said.get(k, "") for k in ("class", "id", "role"))):
                by_name = False
    if tag == "header" and not inside:
        chrome = True
    node = Node(tag, label, chrome, by_name)
    stack[-1].children.append(node)
    return node


def _is_small(node: Node, most: int) -> bool:
    """Whether a subtree holds no article or main element and at most so much text; looks no further once it is more."""
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len(x)
            if n > most:
                return False
        elif x.tag in ROOTS:
            return False
        else:
            todo += x.children
    return True


def _spare_dominant(root: Node, by_name: list[Node]) -> None:
    """An element that only its names call chrome, but that holds an article or main element or most of the page's text outside of sure chrome (over 200 characters), is none."""
    if all(_is_small(node, 200) for node in by_name):
        return
    order, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(c, node) for c in node.children if isinstance(c, Node)]
    size, holds = {}, {}
    for node, parent in reversed(order):
        k = id(node)
        sure = node.chrome and not node.by_name
        n = 0 if sure else size.get(k, 0) + sum(len(c.strip()) for c in node.children if isinstance(c, str))
        size[k], holds[k] = n, holds.get(k, False) or node.tag in ROOTS
        if parent is not None:
            size[id(parent)] = size.get(id(parent), 0) + n
            holds[id(parent)] = holds.get(id(parent), False) or holds[k]
    for node, _ in order:
        if node.by_name and (holds[id(node)] or 2 * size[id(node)] > size[id(root)] > 400):
            node.chrome = False


def clean(s: str) -> str:
    return SPACE.sub(" ", entities.unescape(s)).strip()


def text_blocks(root: Node) -> list[tuple[str, str, bool, bool]]:
    """(slot, text, chrome, inside an article or main element) of each block in page order; a slot is the path of labels."""
    out, buffer, where = [], [], ["", False, False]

    def flush() -> None:
        if buffer:
            text = clean("".join(buffer))
            if text:
                out.append((where[0], text, where[1], where[2]))
            buffer.clear()

    todo = [(root, "", False, False, False)]
    while todo:
        node, slot, chrome, inside, leave = todo.pop()
        if isinstance(node, str):
            if not buffer:
                where[:] = [slot, chrome, inside]
            buffer.append(node)
        elif leave:
            flush()
        else:
            block = node.tag in BLOCK or node.chrome
            if node.tag == "br":
                buffer.append(" ") if buffer else None
            if block:
                flush()
                todo.append((node, "", False, False, True))
            if node.tag in RAW and node.tag not in ("textarea", "title"):
                continue
            below = f"{slot}/{node.label}" if block else slot
            todo += [(c, below, chrome or node.chrome, inside or node.tag in ROOTS, False) for c in reversed(node.children)]
    flush()
    return out


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def skeleton(blocks: list[tuple[str, str, bool, bool]]) -> list[list]:
    """The tree of blocks for alignment: [depth, label, hash of its own text]; a text outside any inner block is a leaf `#`."""
    out, seen = [], []
    for slot, text, _, _ in blocks:
        path = slot.split("/")[1:]
        k = 0
        while k < min(len(path), len(seen)) and path[k] == seen[k]:
            k += 1
        k = min(k, max(len(path) - 1, 0))
        out += [[d, path[d], 0] for d in range(k, len(path))]
        out.append([len(path), "#", text_hash(text)])
        seen = path
    return out


def _tree(rows: list) -> tuple:
    """(label, text hash, children) from a skeleton."""
    root = ("", 0, [])
    stack = [root]
    for depth, label, text in rows:
        del stack[depth + 1 :]
        node = (label, text, [])
        stack[-1][2].append(node)
        stack.append(node)
    return root


def _digest(node: tuple, known: dict) -> int:
    """A number of the subtree's labels and texts; equal subtrees have equal ones. `known` keeps the nodes, so that their ids stay theirs."""
    got = known.get(id(node))
    if got is not None:
        return got[0]
    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        if id(x) in known:
            continue
        if ready:
            known[id(x)] = (hash((x[0], x[1], tuple(known[id(c)][0] for c in x[2]))), x)
        else:
            todo.append((x, True))
            todo += [(c, False) for c in x[2]]
    return known[id(node)][0]


def _equal_leaves(node: tuple, slot: str, pairs: list) -> int:
    """What `tree_matching` gives for a subtree and its equal."""
    size, todo = 0, [(node, slot)]
    while todo:
        x, at = todo.pop()
        if x[0] == "#":
            pairs.append((at, x[1], x[1]))
            size += 2
            continue
        at = f"{at}/{x[0]}" if x[0] else at
        size += 1
        todo += [(c, at) for c in reversed(x[2])]
    return size


def tree_matching(a: tuple, b: tuple, slot: str, pairs: list | None, known: dict | None = None) -> int:
    """Simple tree matching: the size of the largest ordered top-down match of two trees with equal root labels; appends the matched
    leaves as (slot, text of a, text of b). With `pairs` None only the size is found, once for each pair of different subtrees. Trees of any depth: calls are kept on a list of their own."""
    calls, value = [_matching(a, b, slot, pairs, {} if known is None else known)], None
    while calls:
        try:
            calls.append(_matching(*calls[-1].send(value)))
            value = None
        except StopIteration as done:
            calls.pop()
            value = done.value
    return value


def _matching(a: tuple, b: tuple, slot: str, pairs: list | None, known: dict):
    """The step of `tree_matching` for two nodes; yields the arguments of the steps it needs and is sent their sizes.

    Equal children at the head and the tail of both lists match each other, which loses nothing as no match of theirs is larger; the lists
    between them are aligned whole, whatever their length. Of the sums only two rows are kept, of the choices a byte for each pair."""
    chain = 0
    while a[0] == b[0] != "#" and len(a[2]) == 1 == len(b[2]):
        slot = f"{slot}/{a[0]}" if a[0] else slot
        a, b, chain = a[2][0], b[2][0], chain + 1
    if a[0] != b[0]:
        return chain
    if a[0] == "#":
        if pairs is not None:
            pairs.append((slot, a[1], b[1]))
        return chain + (2 if a[1] == b[1] else 1)
    slot = f"{slot}/{a[0]}" if a[0] else slot
    xs, ys = a[2], b[2]
    key = (_digest(a, known), _digest(b, known))
    if pairs is None and key in known:
        return chain + known[key]
    dx, dy = [_digest(c, known) for c in xs], [_digest(c, known) for c in ys]
    head, got = 0, 1
    leaves: list = [] if pairs is None else pairs
    while head < min(len(xs), len(ys)) and dx[head] == dy[head]:
        got += _equal_leaves(xs[head], slot, leaves)
        head += 1
    m, n = len(xs), len(ys)
    while m > head and n > head and dx[m - 1] == dy[n - 1]:
        m, n = m - 1, n - 1
        got += _equal_leaves(xs[m], slot, leaves)
    xs, ys = xs[head:m], ys[head:n]
    m, n = len(xs), len(ys)
    before, choices = [0] * (n + 1), []
    for x in xs:
        label, row, chosen, left = x[0], [0] * (n + 1), bytearray(n + 1), 0
        for j, y in enumerate(ys):
            up = before[j + 1]
            best, how = (up, 1) if up >= left else (left, 2)
            if label == y[0]:
                w = before[j] + ((2 if x[1] == y[1] else 1) if label == "#" else (yield (x, y, slot, None, known)))
                if w >= best:
                    best, how = w, 0
            row[j + 1] = left = best
            chosen[j + 1] = how
        before = row
        if pairs is not None:
            choices.append(chosen)
    if pairs is None:
        known[key] = got + before[n]
        return chain + known[key]
    i, j = m, n
    while i and j:
        how = choices[i - 1][j]
        if how == 0:
            yield (xs[i - 1], ys[j - 1], slot, pairs, known)
        i, j = i - (how != 2), j - (how != 1)
    return chain + got + before[n]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lit(""))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, tree (see `skeleton`, as JSON), slots and texts (see `main_blocks`): a page is parsed once, for the wrapper and for its text."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        import json

        trees, slots, texts = [], [], []
        for h in frame["html"]:
            blocks = text_blocks(parse(text_of(h)))
            trees.append(json.dumps(skeleton(blocks)))
            main = main_blocks(blocks)
            slots.append([s for s, _ in main])
            texts.append([t for _, t in main])
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "host": frame["host"], "tree": trees, "slots": slots, "texts": texts})

    rows = pages.select("page_id", "url", host_of("url").alias("host"), "html")
    return in_batches(rows, f, "page_id long, url string, host string, tree string, slots array<string>, texts array<string>", 1000)


def induce_wrappers(trees: DataFrame, bundle: int = 8, least_pairs: int = 3, constant: float = 0.5) -> DataFrame:
    """host, template: what is constant on the host's pages (host, tree), as `slot` (all its texts) or `slot<tab>text hash`.

    Pages of a host are dealt into bundles of about `bundle`; in a bundle each page's tree is aligned with the one before.
    Matched leaves with equal text are constant, others vary; pairs of pages without any varying leaf are copies and
    don't count. A text is template where it was constant in at least `constant` of the host's alignments, and a slot where
    four fifths of all its matches were; hosts with fewer than `least_pairs` alignments have no wrapper.
    """

    size = trees.groupBy("host").count().select("host", F.greatest(F.lit(1), F.col("count") / bundle).cast("long").alias("bundles"))
    dealt = trees.join(size, "host").select("host", F.pmod(F.xxhash64("tree"), F.col("bundles")).alias("bundle"), "tree").repartition("host", "bundle").groupBy("host", "bundle").agg(F.sort_array(F.collect_set("tree")).alias("trees"))

    def votes(frames):
        import json

        for frame in frames:
            rows: Counter = Counter()
            for host, found in zip(frame["host"], frame["trees"]):
                parsed = [_tree(json.loads(t)) for t in found]
                for a, b in zip(parsed, parsed[1:]):
                    pairs: list = []
                    tree_matching(a, b, "", pairs)
                    if all(x == y for _, x, y in pairs):
                        continue
                    rows[host, "", 0, "pairs"] += 1
                    for slot, x, y in pairs:
                        rows[host, slot, x if x == y else 0, "same" if x == y else "varies"] += 1
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["host", "slot", "text", "kind", "n"])

    counts = cut_lineage(dealt.mapInPandas(votes, "host string, slot string, text long, kind string, n long").groupBy("host", "slot", "text", "kind").agg(F.sum("n").alias("n")))
    pairs = counts.where("kind = 'pairs'").select("host", F.col("n").alias("pairs")).where(F.col("pairs") >= least_pairs)
    texts = counts.where("kind = 'same'").join(pairs, "host").where(F.col("n") >= constant * F.col("pairs")).select("host", F.concat_ws("\t", "slot", F.col("text").cast("string")).alias("t"))
    slots = counts.where("kind != 'pairs'").groupBy("host", "slot").agg(F.sum(F.when(F.col("kind") == "same", F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("all"))
    slots = slots.where("same >= 0.8 * all").join(pairs, "host").where(F.col("all") >= constant * F.col("pairs")).select("host", F.col("slot").alias("t"))
    return texts.unionByName(slots).groupBy("host").agg(F.collect_set("t").alias("template"))


def main_blocks(blocks: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """(slot, text) of the blocks outside of chrome, from article (or else main) elements where a page has them."""
    blocks = [(s, t, i) for s, t, chrome, i in blocks if not chrome]
    inside = any(i for _, _, i in blocks)
    return [(s, t) for s, t, i in blocks if i or not inside]


def without_template(blocks: Iterable[tuple[str, str]], template: frozenset | set) -> str:
    return "\n".join(t for s, t in blocks if not template or s not in template and f"{s}\t{text_hash(t)}" not in template)


def main_text(html: str, template: frozenset | set = frozenset()) -> str:
    """The article's blocks, joined by line feeds: those outside of chrome and of the host's template, from article (or else main) elements where a page has them."""
    return without_template(main_blocks(text_blocks(parse(html))), template)


def extract_articles(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null html is empty and gives an empty text.

    Pages without a host (null or odd url) share the empty host. Character references are decoded; white space in a
    block becomes one space. Pages of any depth and length are read whole. Repeated rows each give a row and equal pages equal texts; null ids
    stay null; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    parsed = cut_lineage(parsed_pages(pages), "zstd")
    wrappers = cut_lineage(induce_wrappers(parsed.select("host", "tree")))
    both = parsed.select("page_id", "url", "host", "slots", "texts").join(wrappers, "host", "left")

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, frozenset] = {}
        texts = []
        for host, slots, blocks, template in zip(frame["host"], frame["slots"], frame["texts"], frame["template"]):
            if host not in known:
                known[host] = frozenset(template) if template is not None else frozenset()
            texts.append(without_template(zip(slots, blocks), known[host]))
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return in_batches(both, f, "page_id long, url string, text string, n_chars long", 1000)
