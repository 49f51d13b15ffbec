"""Op 1: main text of web pages by wrapper induction.

Every page becomes a tree of its block tags (siblings of one tag and class names are one node, digits in class names
don't count, ids not at all) and a list of its blocks of text, each at its node. Trees of one host are folded into
the host's wrapper by simple tree matching: the largest order-keeping match of nodes whose tags are equal and whose
class names are alike. All pages are then aligned with their wrapper, and for each of its nodes the texts are counted:
a text that stands at one node of four fifths of the host's different pages, two at least, is template; what varies is
content. The content's root is the node, from the wrapper's root down, that holds four fifths of the varying text
outside links on the host as a whole; an article is not left, and headings beside the way stay. A page's main text is
its varying blocks below that root.

What varies and is none of the article all the same (menus, adverts, related pages, reader comments) can't be told by
variation; such parts are known by their tags, and by names in their class, id and role (the fixed lists below).
A host of a single different page has no wrapper: there the page's own tree decides, and an article tag if there is
one. A page keeps template texts if they are most of its content (near copies on one host are no template).

Wrappers are folded from the distinct trees in an order of their own, so texts don't depend on how the pages are
split. Only trees, counts and hashes are grouped by host, never pages; wrappers are broadcast to the pages while they
are small (checked), and joined over SALTS shares of each host beyond.

Nulls: a null or empty html has the empty text; null urls and urls without ``://`` form one host. Pages of any length
and depth are read whole, in time that grows with their length. Ties: of equally heavy nodes the first, of equally
good matches the one of earlier nodes. Repeated rows are extracted one by one and count once for the wrapper; empty
tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_groups, stored, with_only

#: A tag; quotes count only after an equals sign, and one that is never closed doesn't count.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: Where markup begins; any other sign is text.
MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose contents are no markup, and are skipped.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Block tags that hold text rather than further blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr figcaption caption br hr img address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends an open paragraph, and what ends which open sibling.
NOT_IN_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div section article main aside nav header footer form table pre blockquote figure address hr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Fixed lists: tags of furniture; parts of its class, id and role names; and whole such names.
FURNITURE = frozenset("nav footer aside form head button dialog menu object canvas audio video noscript template svg iframe select".split())
PARTS = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr comment comments disqus reply replies newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal widget".split())
WHOLE = frozenset("header masthead banner notice notices search login complementary contentinfo site-header page-header topbar toolbar alert".split())
#: Share of a host's different pages that a template text is on, and of the varying text that the content's root holds.
CONSTANT, MOST, LEAST_PAGES = 0.8, 0.8, 2
SALTS, SMALL = 64, 64_000_000


class Tree:
    """Nodes in document order: label (tag and class names), parent, and pages that have the node."""

    def __init__(self, labels: list[str], parents: list[int], counts: list[int] | None = None):
        self.labels, self.parents, self.counts = labels, parents, counts or [1] * len(labels)
        self.kids: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(i)

    @property
    def text(self) -> str:
        return "\n".join(f"{p} {n} {label}" for label, p, n in zip(self.labels, self.parents, self.counts))

    @classmethod
    def read(cls, text: str) -> Tree:
        rows = [line.split(" ", 2) for line in text.split("\n")]
        return cls([r[2] for r in rows], [int(r[0]) for r in rows], [int(r[1]) for r in rows])

    @classmethod
    def ordered(cls, labels: list[str], kids: list, counts: list[int]) -> tuple[Tree, list[int]]:
        """The tree from lists of children, and each node's new number."""
        number, out = [0] * len(labels), ([], [], [])
        todo = [(0, -1)]
        while todo:
            i, p = todo.pop()
            number[i] = len(out[0])
            for o, x in zip(out, (labels[i], p, counts[i])):
                o.append(x)
            todo += [(k, number[i]) for k in reversed(list(kids[i]))]
        return cls(*out), number


@lru_cache(maxsize=8192)
def names_of(attributes: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(class names without digits, sorted; class, id and role names)."""
    classes, names = set(), []
    for m in NAMES.finditer(attributes):
        words = (m[2] or m[3] or m[4] or "").lower().split()
        names += words
        if m[1].lower() == "class":
            classes.update(re.sub(r"\d+", "#", w) for w in words)
    return tuple(sorted(classes)), tuple(names)


@lru_cache(maxsize=8192)
def furniture(tag: str, names: tuple[str, ...], inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main") or tag in INLINE:
        return False
    return any(n in WHOLE or any(p in PARTS for p in re.split(r"[-_]", n)) for n in names)


def parse(html: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """(tree, blocks): node, text and characters in links of each block, in page order; none of furniture."""
    labels, kids, blocks = ["html"], [{}], []
    # tag, node, furniture, inside an article, inside a link
    stack = [("html", 0, False, False, False)]
    opened: Counter = Counter()
    held: list[str] = []
    link = at = 0

    def flush():
        nonlocal link
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                blocks.append((stack[-1][1], text, min(link, len(text))))
            held.clear()
            link = 0

    def shut(k: int):
        """Ends all open elements from the k-th on."""
        ended = [e[0] for e in stack[k:]]
        if not INLINE.issuperset(ended):
            flush()
        for t in ended:
            opened[t] -= 1
        del stack[k:]

    def say(a: int, b: int):
        nonlocal link
        if b > a and not stack[-1][2]:
            held.append(html[a:b])
            if stack[-1][4]:
                link += len(html[a:b].strip())

    while True:
        m = MARKUP.search(html, at)
        less = m.start() if m else len(html)
        say(at, less)
        if not m:
            break
        if html.startswith("<!--", less):
            end = html.find("-->", less + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        m = TAG.match(html, less)
        if not m:
            end = html.find(">", less)
            if end < 0:
                break  # a tag that never ends
            at = end + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in ("br", "p") and not opened[tag]:
                flush()
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                shut(k)
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "html":
            continue
        ends = CLOSES.get(tag, ()) if tag not in NOT_IN_P else ("p",)
        if any(opened[e] for e in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    shut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        _, node, skip, inside, in_link = stack[-1]
        classes, names = names_of(m[3]) if m[3] else ((), ())
        if tag not in INLINE:
            flush()
            if not skip:
                skip = furniture(tag, names, inside)
                if not skip and tag not in VOID:
                    label = ".".join((tag, *classes)) if classes else tag
                    if label not in kids[node]:
                        kids[node][label] = len(labels)
                        labels.append(label)
                        kids.append({})
                    node = kids[node][label]
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, node, skip, inside or tag in ("article", "main"), in_link or tag == "a"))
            opened[tag] += 1
    flush()
    tree, number = Tree.ordered(labels, [k.values() for k in kids], [1] * len(labels))
    return tree, [(number[n], text, links) for n, text, links in blocks]


@lru_cache(maxsize=65536)
def alike(a: str, b: str) -> bool:
    """Equal tags, and class names of which half at least are shared."""
    if a == b:
        return True
    (s, *x), (t, *y) = a.split("."), b.split(".")
    return s == t and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))


def chain(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (i, j, weight), in order of i, the heaviest set that ascends in both i and j."""
    js = sorted({j for _, j, _ in pairs})
    best: list[tuple[int, int]] = [(0, -1)] * (len(js) + 1)  # a Fenwick tree of maxima: weight, last pair
    back, k = [-1] * len(pairs), 0
    while k < len(pairs):
        same = [k]
        while same[-1] + 1 < len(pairs) and pairs[same[-1] + 1][0] == pairs[k][0]:
            same.append(same[-1] + 1)
        found = []
        for x in same:
            at, top = bisect_left(js, pairs[x][1]), (0, -1)
            while at > 0:
                top = max(top, best[at], key=lambda t: t[0])
                at -= at & -at
            back[x] = top[1]
            found.append((bisect_left(js, pairs[x][1]) + 1, (top[0] + pairs[x][2], x)))
        for at, value in found:
            while at <= len(js):
                best[at] = max(best[at], value, key=lambda t: t[0])
                at += at & -at
        k = same[-1] + 1
    at, top = len(js), (0, -1)
    while at > 0:
        top = max(top, best[at], key=lambda t: t[0])
        at -= at & -at
    out, x = [], top[1]
    while x >= 0:
        out.append(pairs[x][:2])
        x = back[x]
    return out[::-1]


def match(a: Tree, b: Tree) -> tuple[int, list[int]]:
    """Simple tree matching: size of the largest order-keeping match, and each node of b's partner in a, or -1."""
    if a.labels == b.labels and a.parents == b.parents:
        return len(a.labels), list(range(len(b.labels)))
    pairs = [(0, 0)]
    for x, y in pairs:  # grows: children of alike nodes
        tags: dict[str, list[int]] = {}
        for d in b.kids[y]:
            tags.setdefault(b.labels[d].split(".", 1)[0], []).append(d)
        for c in a.kids[x]:
            pairs += [(c, d) for d in tags.get(a.labels[c].split(".", 1)[0], ()) if alike(a.labels[c], b.labels[d])]
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in reversed(pairs):
        known = [(c, d, size[c, d]) for c in a.kids[x] for d in b.kids[y] if (c, d) in size] if a.kids[x] and b.kids[y] else []
        chosen[x, y] = chain(known)
        size[x, y] = 1 + sum(size[p] for p in chosen[x, y])
    partner, todo = [-1] * len(b.labels), [(0, 0)]
    for x, y in todo:
        partner[y] = x
        todo += chosen[x, y]
        done = {d for _, d in chosen[x, y]}
        # What stands in another order, but is called the same, is the same node.
        todo += [(c, d) for d in b.kids[y] if d not in done for c in a.kids[x] if a.labels[c] == b.labels[d]][: len(b.kids[y])]
    return size[0, 0], partner


def merge(a: Tree, b: Tree) -> Tree:
    """The wrapper of both: matched nodes keep the class names they share; others go in after their left sibling."""
    partner = match(a, b)[1]
    labels, counts, kids = list(a.labels), list(a.counts), [list(k) for k in a.kids]
    for y, x in enumerate(partner):
        if x >= 0:
            counts[x] += b.counts[y]
            if labels[x] != b.labels[y]:
                tag, *names = labels[x].split(".")
                labels[x] = ".".join((tag, *sorted(set(names) & set(b.labels[y].split(".")[1:]))))
    for y, x in enumerate(partner):
        if x < 0:
            up = partner[b.parents[y]]
            partner[y] = x = len(labels)
            labels.append(b.labels[y])
            counts.append(b.counts[y])
            kids.append([])
            before = [partner[d] for d in b.kids[b.parents[y]] if d < y and partner[d] in kids[up]]
            kids[up].insert(kids[up].index(before[-1]) + 1 if before else 0, x)
    return Tree.ordered(labels, kids, counts)[0]


def fold(trees: list[tuple[int, str]]) -> str:
    """The wrapper of (pages, tree) rows, the most frequent trees first."""
    out = None
    for n, text in sorted(trees, key=lambda t: (-t[0], t[1])):
        t = Tree.read(text)
        if n != 1:
            t.counts = [n * k for k in t.counts]
        out = t if out is None else merge(out, t)
    return out.text


def root_of(tree: Tree, mass: list[float], alone: bool) -> tuple[int, set[int]]:
    """(root of the content, headings beside the way to it). ``alone``: an only article or main part is the content."""
    weight = [float(x) for x in mass]
    for i in range(len(weight) - 1, 0, -1):
        weight[tree.parents[i]] += weight[i]
    tags = [x.split(".", 1)[0] for x in tree.labels]
    if alone:
        for tag in ("article", "main"):
            found = [i for i, t in enumerate(tags) if t == tag and weight[i] > 0]
            if len(found) == 1:
                return found[0], set()
    v, beside = 0, set()
    while True:
        if tags[v] == "article":
            return v, set()
        heavy = max(tree.kids[v], default=None, key=lambda k: weight[k])
        if heavy is None or weight[heavy] <= 0 or weight[heavy] < MOST * (weight[v] - sum(weight[k] for k in tree.kids[v] if tags[k] in HEADINGS)) or tags[heavy] in LEAVES:
            return v, beside
        beside.update(k for k in tree.kids[v] if tags[k] in HEADINGS)
        v = heavy


def below(tree: Tree, root: int, beside: set[int]) -> list[bool]:
    """Which nodes belong to the content."""
    out = [False] * len(tree.labels)
    for i, p in enumerate(tree.parents):
        out[i] = i == root or i in beside or (p >= 0 and out[p])
    return out


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Wrapper:
    """A host's wrapper, and what is known of its nodes' texts (JSON: pages, slots, template)."""

    def __init__(self, text: str):
        text, _, known = text.partition("\n\n")
        known = json.loads(known) if known else {}
        self.tree, self.pages, self.seen = Tree.read(text), known.get("pages", 0), {}
        self.template = {(t["slot"], t["text"]) for t in known.get("template", ())}
        mass = [0.0] * len(self.tree.labels)
        for s in known.get("slots", ()):
            mass[s["slot"]] = s["mass"]
        self.content = below(self.tree, *root_of(self.tree, mass, False))

    def slots(self, tree: Tree) -> list[int]:
        """The wrapper's node for each of a page's nodes; what the wrapper hasn't is where its parent is."""
        key = "\n".join(f"{p} {x}" for p, x in zip(tree.parents, tree.labels))
        if key not in self.seen:
            if len(self.seen) > 500:
                self.seen.clear()
            out = match(self.tree, tree)[1]
            for i, x in enumerate(out):
                if x < 0:
                    out[i] = out[tree.parents[i]]
            self.seen[key] = out
        return self.seen[key]


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    if not html:
        return ""
    tree, blocks = parse(html)
    if wrapper is not None and wrapper.pages >= LEAST_PAGES:
        slot = wrapper.slots(tree)
        inside = [(slot[n], text) for n, text, _ in blocks if wrapper.content[slot[n]]]
        kept = [text for n, text in inside if (n, hash_of(text)) not in wrapper.template]
        if 2 * sum(map(len, kept)) < sum(len(text) for _, text in inside):
            kept = [text for _, text in inside]
        if kept:
            return "\n".join(kept)
    mass = [0.0] * len(tree.labels)
    for n, text, links in blocks:
        mass[n] += max(0, len(text) - 2 * links)
    content = below(tree, *root_of(tree, mass, True))
    return "\n".join(text for n, text, _ in blocks if content[n])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper: one row a host."""

    def make_trees():
        trees: Counter = Counter()
        size = 0

        def out():
            nonlocal size
            cols = {"host": [h for h, _ in trees], "tree": [t for _, t in trees], "n": list(trees.values())}
            trees.clear()
            size = 0
            return cols

        class Kernel:
            def __call__(self, c):
                nonlocal size
                for host, html in zip(c["host"], c["html"]):
                    key = (host, parse(html)[0].text)
                    size += len(key[1]) if key not in trees else 0
                    trees[key] += 1
                    if size > 20_000_000:
                        yield out()

            def close(self):
                return (out(),)

        return Kernel()

    def make_fold():
        def kernel(c):
            return {"host": c["host"][:1], "n": [1], "tree": [fold(list(zip(c["n"], c["tree"])))]}

        return kernel

    trees = map_batches(pages.filter("html is not null").select("host", "html"), make_trees, "host string, tree string, n long", text="html")
    trees = trees.groupBy("host", "tree").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(SALTS)))
    parts = map_groups(trees, ["host", "salt"], make_fold, "host string, n long, tree string")
    return map_groups(parts, ["host"], make_fold, "host string, n long, tree string").select("host", F.col("tree").alias("wrapper"))


def on_pages(pages: DataFrame, hosts: DataFrame, make, schema: str) -> DataFrame:
    """What the kernel makes of the pages (columns, and the rule of each one's host). hosts: host, rule. Small tables
    are broadcast; beyond, each host's rule goes once to each of SALTS shares of its pages, before them in order."""
    spark = pages.sparkSession
    if (hosts.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0) <= SMALL:
        shared = spark.sparkContext.broadcast({r["host"]: r["rule"] for r in hosts.collect()})

        def make_known():
            known, kernel = shared.value, make()
            return lambda c: kernel(c, [known.get(h) for h in c["host"]])

        return map_batches(pages, make_known, schema, text="html")

    def make_next():
        kernel, now = make(), (None, None)

        def run(c):
            nonlocal now
            rules, at = [], []
            for i, (host, rule) in enumerate(zip(c["host"], c["rule"])):
                if rule is not None:
                    now = (host, rule)
                else:
                    at.append(i)
                    rules.append(now[1] if now[0] == host else None)
            return kernel({k: [v[i] for i in at] for k, v in c.items()}, rules)

        return run

    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    heads = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    both = salted.unionByName(heads, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("rule").isNull())
    return map_batches(both, make_next, schema, text="html")


@lru_cache(maxsize=256)
def _wrapper(text: str | None) -> Wrapper | None:
    return Wrapper(text) if text else None


def texts_of(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, slot, text (hash), size, links, pages: the different pages with the text at that node of the wrapper. In
    slot -1 each different page is a text of its own."""

    def make():
        def kernel(c, rules):
            out = {k: [] for k in ("host", "slot", "text", "size", "links", "page")}
            for host, html, rule in zip(c["host"], c["html"], rules):
                tree, blocks = parse(html)
                slot = _wrapper(rule).slots(tree)
                page = hash_of("\n".join(text for _, text, _ in blocks))
                each = {(slot[n], hash_of(text)): (len(text), links) for n, text, links in blocks} | {(-1, page): (0, 0)}
                for (n, text), (size, links) in each.items():
                    for k, v in zip(out, (host, n, text, size, links, page)):
                        out[k].append(v)
            yield out

        return kernel

    rows = on_pages(pages.filter("html is not null"), wrappers.withColumnRenamed("wrapper", "rule"), make, "host string, slot int, text long, size long, links long, page long")
    different = rows.groupBy("host", "slot", "text", "page").agg(F.max("size").alias("size"), F.max("links").alias("links"))
    return different.groupBy("host", "slot", "text").agg(F.max("size").alias("size"), F.max("links").alias("links"), F.count("*").alias("pages"))


def learn(pages: DataFrame) -> DataFrame:
    """host, rule: the wrapper; and pages (different ones), slots (slot, mass: varying text outside links), template (slot, text) as JSON."""
    wrappers = stored(induce(pages))
    texts = stored(texts_of(pages, wrappers))
    per_host = texts.filter("slot < 0").groupBy("host").agg(F.count("*").alias("n"))
    if (per_host.agg(F.sum(F.length("host") + 8)).first()[0] or 0) <= SMALL:
        per_host = F.broadcast(per_host)
    t = texts.filter("slot >= 0").join(per_host, "host")
    constant = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= CONSTANT * F.col("n"))
    mass = F.sum(F.when(~constant, F.greatest(F.lit(0), F.col("size") - 2 * F.col("links")) * F.col("pages")).otherwise(0))
    slots = t.groupBy("host", "slot").agg(mass.alias("mass"), F.collect_list(F.when(constant, F.struct("slot", "text"))).alias("template"))
    known = slots.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "mass"))).alias("slots"), F.array_sort(F.flatten(F.collect_list("template"))).alias("template"))
    known = per_host.join(known, "host", "left").select("host", F.to_json(F.struct(F.col("n").alias("pages"), "slots", "template")).alias("known"))
    return stored(wrappers.join(known, "host").select("host", F.concat("wrapper", F.lit("\n\n"), "known").alias("rule")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    p = with_only(pages, page_id="long", url="string", html="string").withColumn("host", host_of())

    def make():
        def kernel(c, rules):
            text = [extract(html, _wrapper(rule)) for html, rule in zip(c["html"], rules)]
            yield {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": [len(t) for t in text]}

        return kernel

    return on_pages(p, learn(p), make, "page_id long, url string, text string, n_chars long")
