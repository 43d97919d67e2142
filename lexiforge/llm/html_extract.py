"""Main text of web pages by wrapper induction.

For each host a few exemplar pages (PER_HOST of different content by hash, a documented bound) are
aligned by simple tree matching.  Texts that stand at an aligned place of all exemplars are template;
others are slots.  The content root is the element that holds most of the slots' text outside
menus, adverts, forms and the like, the page's article element where the slots have one.  Every
page of the host is then cut by its host's wrapper: blocks of the content root, without template
text and without elements that are noise by their kind or name.  A page in which the root is not
found, and a host with one page, use the wrapper induced over pages of many hosts, then the page's
own article elements, then its densest element.

Runs of like siblings count once in the matching, so it takes small trees.  Inside an article
element, what all exemplars share is template only if at least SURE of them agree and it is a
TEMPLATE_SHARE of each at most: copies of one article on a host have more than that in common.
Menus and adverts often differ from page to page, so their kind or name still decides there.  Formulas
(MathML) and labels of drawings are text; annotations and descriptions that repeat them are not.

Nulls: a null html is an empty page, with an empty text; a null url is a host of its own.  Repeated
rows are extracted each.  Empty table: empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, stage, texts_of
from .dom import Block, Node, path_of, read

#: Exemplars per host and for the wrapper over many hosts.
PER_HOST, OVERALL = 8, 48
#: Exemplars that must agree on template text inside an article, and its share of theirs at most.
SURE, TEMPLATE_SHARE = 4, 0.3
#: Elements that hold an article's text, beside which its root may lie.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure section time".split())
#: Hosts (some kB each) up to which their wrappers are broadcast.
MAX_BROADCAST_HOSTS = 20_000


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


class Tree:
    """A page's tree with runs of like siblings folded into one node, so that the children of a node
    have different names."""

    __slots__ = ("children", "name", "nodes", "path")

    def __init__(self, name: str, path: str, nodes: list[int]):
        self.name, self.path, self.nodes, self.children = name, path, nodes, []


def folded(nodes: list[Node]) -> Tree:
    root = Tree("#", "", [0])
    todo = [root]
    while todo:
        tree = todo.pop()
        groups: dict[str, list[int]] = {}
        for k in tree.nodes:
            for c in nodes[k].children:
                groups.setdefault(nodes[c].name, []).append(c)
        tree.children = [Tree(name, f"{tree.path}/{name}" if tree.path else name, got) for name, got in groups.items()]
        todo += tree.children
    return root


def heaviest_rise(places: list[int], weights: list[int]) -> list[int]:
    """Which of the places, all different, make the heaviest ascending subsequence."""
    rank = {p: k + 1 for k, p in enumerate(sorted(places))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)  # prefix maxima, as a Fenwick tree
    back = []
    for k, (p, w) in enumerate(zip(places, weights, strict=True)):
        at, top = rank[p] - 1, (0, -1)
        while at:
            top = max(top, best[at])
            at &= at - 1
        back.append(top[1])
        at = rank[p]
        while at < len(best):
            best[at] = max(best[at], (top[0] + w, k))
            at += at & -at
    at, top = len(places), (0, -1)
    while at:
        top = max(top, best[at])
        at &= at - 1
    out, k = [], top[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching: the largest number of node pairs that keep parents and the order of
    siblings, and the pairs.  Children have different names, so those of a pair meet by name, and the
    order leaves the heaviest ascending part of them.  Pairs are visited without recursion."""
    if a.name != b.name:
        return 0, []
    order, inner = [(a, b)], []
    for x, y in order:
        place = {t.name: k for k, t in enumerate(y.children)}
        common = [(t, place[t.name]) for t in x.children if t.name in place]
        inner.append((len(order), [p for _, p in common]))
        order += [(t, y.children[p]) for t, p in common]
    weight, kept = [1] * len(order), [[] for _ in order]
    for k in range(len(order) - 1, -1, -1):
        start, places = inner[k]
        kept[k] = [start + i for i in heaviest_rise(places, weight[start : start + len(places)])] if places else []
        weight[k] += sum(weight[i] for i in kept[k])
    pairs, todo = [], [0]
    while todo:
        k = todo.pop()
        pairs.append(order[k])
        todo += kept[k]
    return weight[0], pairs


def _texts(nodes: list[Node], tree: Tree) -> list[str]:
    return [t for k in tree.nodes for t in nodes[k].texts]


def induce(pages: list[str]) -> dict | None:
    """A wrapper {root, constant} of pages that share a template; None if they can't be compared.

    root: the content root's path.  constant: by path, the texts that all pages have there."""
    read_pages = [read(p) for p in dict.fromkeys(pages) if p]
    trees = [(nodes, folded(nodes)) for nodes, _ in read_pages]
    if len(trees) < 2:
        return None
    nodes0, first = trees[0]
    seen: dict[str, int] = defaultdict(int)
    shared: dict[str, set[str]] = {}
    varying: dict[str, int] = defaultdict(int)
    main: set[str] = set()
    many: set[str] = set()
    for nodes, tree in trees[1:]:
        for x, y in match(first, tree)[1]:
            seen[x.path] += 1
            mine, other = _texts(nodes0, x), _texts(nodes, y)
            same = set(mine) & set(other)
            shared[x.path] = shared[x.path] & same if x.path in shared else same
            if len(x.nodes) > 1 or len(y.nodes) > 1:
                many.add(x.path)
            if all(nodes0[k].noise for k in x.nodes):
                continue
            if any(nodes0[k].main for k in x.nodes):
                main.add(x.path)
            varying[x.path] += sum(len(t) for t in other if t not in same) + sum(len(t) for t in mine if t not in same)
    everywhere = len(trees) - 1
    constant = {p: t for p, t in shared.items() if t and seen[p] == everywhere}
    if not _template_in(main, constant, trees):
        constant = {p: t for p, t in constant.items() if p not in main}
    slots = {p: n for p, n in varying.items() if n}
    if any(p in main for p in slots):
        slots = {p: n for p, n in slots.items() if p in main}
    if not slots:
        return None
    return {"root": _content_root(slots, main, many), "constant": {p: sorted(t) for p, t in constant.items()}}


def _template_in(main: set[str], constant: dict[str, set[str]], trees: list[tuple[list[Node], Tree]]) -> bool:
    """Whether what all pages have inside their articles is template: enough pages agree, and it is the
    lesser part of each.  Copies of one article agree on more."""
    if len(trees) < SURE:
        return False
    for nodes, tree in trees:
        whole = same = 0
        todo = [tree]
        while todo:
            t = todo.pop()
            todo += t.children
            if t.path in main:
                for text in _texts(nodes, t):
                    whole += len(text)
                    same += len(text) * (text in constant.get(t.path, ()))
        if same > TEMPLATE_SHARE * whole:
            return False
    return True


def _content_root(slots: dict[str, int], main: set[str], many: set[str]) -> str:
    """The article as a whole if the slots are in one; else the deepest element with nine tenths of the
    slots' text, or above it where like elements or an article's other parts stand beside it."""
    held: dict[str, int] = defaultdict(int)
    for p, n in slots.items():
        parts = p.split("/")
        for k in range(1, len(parts) + 1):
            held["/".join(parts[:k])] += n
    total = sum(slots.values())
    fit = [p for p, n in held.items() if 10 * n >= 9 * total]
    inside = [p for p in fit if p in main]
    if inside:
        return min(inside, key=lambda p: p.count("/"))
    root = max(fit, key=lambda p: p.count("/")) if fit else ""
    while "/" in root:
        up = root.rpartition("/")[0]
        beside = {p[len(up) + 1 :].split("/")[0].partition(".")[0] for p in slots if p.startswith(f"{up}/") and p != root and not p.startswith(f"{root}/")}
        if not (root in slots or root in many or (beside and beside <= TEXTUAL)):
            break
        root = up
    return root


def _under(nodes: list[Node], tops: set[int]) -> list[bool]:
    inside = [False] * len(nodes)
    for k, node in enumerate(nodes):
        inside[k] = k in tops or (node.parent >= 0 and inside[node.parent])
    return inside


def _articles(nodes: list[Node], blocks: list[Block]) -> list[int]:
    """The page's article elements; of those on several paths, those of the path with the most text."""
    tops = {k for k, n in enumerate(nodes) if n.main and not n.noise and not nodes[n.parent].main}
    if len(tops) < 2:
        return sorted(tops)
    owner = [-1] * len(nodes)
    for k, n in enumerate(nodes):
        owner[k] = k if k in tops else owner[n.parent] if n.parent >= 0 else -1
    size: dict[str, int] = defaultdict(int)
    paths = {k: path_of(nodes, k) for k in tops}
    for b in blocks:
        if owner[b.node] >= 0:
            size[paths[owner[b.node]]] += len(b.text)
    best = max(paths.values(), key=lambda p: (size[p], -min(k for k in tops if paths[k] == p)))
    return sorted(k for k in tops if paths[k] == best)


def _densest(nodes: list[Node], blocks: list[Block]) -> set[int]:
    score: dict[int, float] = defaultdict(float)
    for b in blocks:
        if nodes[b.node].noise:
            continue
        plain = max(0, len(b.text) - 2 * b.link)
        parent = max(0, nodes[b.node].parent)
        score[parent] += plain
        score[max(0, nodes[parent].parent)] += plain / 3
        score[b.node] += plain / 2
    return {max(score, key=lambda k: (score[k], -k))} if score else set()


def extract(page: str, wrappers: list[dict]) -> str:
    """The page's main text by the first wrapper whose content root it has: all elements at the root's path,
    in page order."""
    nodes, blocks = read(page)
    tops: set[int] = set()
    used: dict = wrappers[0] if wrappers else {}
    paths: dict[int, str] = {}
    for w in wrappers:
        last = w["root"].rpartition("/")[2]
        at = [k for k, n in enumerate(nodes) if n.name == last and not n.noise and path_of(nodes, k) == w["root"]] if last else []
        if at:
            tops, used = set(at), w
            break
    if not tops:
        tops = set(_articles(nodes, blocks)) or _densest(nodes, blocks)
    inside = _under(nodes, tops)
    constant = used.get("constant", {})
    out = []
    for b in blocks:
        node = nodes[b.node]
        if node.noise or not inside[b.node]:
            continue
        if constant:
            path = paths.setdefault(b.node, path_of(nodes, b.node))
            if b.text in constant.get(path, ()):
                continue
        out.append(b.text)
    return " ".join(out)


@lru_cache(maxsize=4096)
def _parsed(raw: str) -> dict:
    w = json.loads(raw)
    w["constant"] = {p: frozenset(t) for p, t in w["constant"].items()}
    return w


def extract_pages(pages: DataFrame, per_host: int = PER_HOST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # Exemplars come by the hash of their content, so that copies of a page count once.
    named = rows.select("host", F.xxhash64("html").alias("h"))
    picked = named.groupBy("host", F.pmod("h", F.lit(per_host)).alias("turn")).agg(F.min("h").alias("h")).select(F.col("host").alias("p_host"), F.col("h").alias("p_h"))
    picked = stage(picked, "exemplar-keys")
    small = broadcast_if_small(picked, picked.count(), 500_000)
    exemplars = rows.withColumn("h", F.xxhash64("html")).join(small, (F.col("host") == F.col("p_host")) & (F.col("h") == F.col("p_h"))).select("host", "h", "html")
    exemplars = stage(exemplars.dropDuplicates(["host", "h"]), "exemplars")

    def per(pdf: pd.DataFrame) -> pd.DataFrame:
        w = induce(pdf.sort_values("h")["html"].fillna("").tolist())
        return pd.DataFrame({"w_host": pdf["host"].iloc[:1], "wrapper": [json.dumps(w) if w else None]})

    wrappers = stage(exemplars.groupBy("host").applyInPandas(per, "w_host string, wrapper string"), "wrappers")
    # The wrapper over many hosts is made of a bounded number of pages, in one group.
    several = exemplars.orderBy("h").limit(OVERALL).groupBy(F.lit("").alias("host")).applyInPandas(lambda pdf: per(pdf), "w_host string, wrapper string").first()
    general = json.loads(several["wrapper"]) if several and several["wrapper"] else None
    if general:
        general["constant"] = {}  # what pages of many hosts have in common by chance is no template
    joined = rows.join(broadcast_if_small(wrappers, wrappers.count(), MAX_BROADCAST_HOSTS), F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = []
            for page, raw in zip(texts_of(part, "html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                own = [_parsed(raw)] if raw else []
                texts.append(extract(page, own + ([general] if general else [])))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
