"""Main text of web pages: gradient-boosted trees over DOM-node features, and a decoding of the tree without contradictions.

A tolerant reader builds the element tree. Each node has features of its subtree (text, links, tags, density, commas), of its attributes' tokens, its
depth, its siblings and its ancestors; boosted trees, fitted here on PAGES made-up pages whose parts are known, give the odds that the node is main
text. Decoding chooses for each node whether its whole subtree is main text, none of it is, or its children decide, so as to maximise the nodes'
log-likelihood: no descendant of a wholly chosen or wholly rejected node can say otherwise.

A null or empty page, and one without main text, gives the empty text. Pages of any length are read whole; unclosed and stray tags are closed or skipped
as browsers do, an unfinished tag ends the page. Character references are decoded, white space within a block becomes one space, blocks are trimmed and
joined in page order by two line feeds; nothing else is dropped. Equal pages give equal texts; an empty table gives an empty table; input columns
pass through unless an output column has their name.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import fields, map_rows, texts

#: Made-up pages that the trees are fitted on (a bound of the sample), trees, their depth, shrinkage, histogram bins, and the cost of a mixed node.
PAGES, TREES, DEPTH, RATE, BINS, MIXED, SEED = 500, 50, 4, 0.3, 32, 1.0, 11

# Elements of HTML.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe object select textarea button canvas audio video head title".split())
TO_THE_END = set("script style textarea title iframe".split())  # these hold raw text up to the end of the page where no end tag follows
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Groups of tokens in class, id and role attributes.
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination",
    "head": "header masthead topbar banner logo brand branding",
    "foot": "footer colophon copyright bottom legal contentinfo",
    "side": "sidebar aside rail widget widgets complementary secondary",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice gdpr modal popup overlay alert newsletter subscribe signup",
    "comment": "comment comments reply replies discussion disqus respond reader",
    "share": "share social related recommended more trending popular tags meta",
    "form": "form search login contact field",
    "main": "article content main post entry story text body prose maincontent",
}
_GROUP_OF = {t: k for k, g in enumerate(GROUPS.values()) for t in g.split()}
TAGS = "div section article main nav header footer aside form ul ol li p a b span h1 h2 h3 h4 table tr td blockquote pre figure figcaption dl dt dd fieldset label body".split()
_TAG_NO = {t: k + 1 for k, t in enumerate(TAGS)}
_KINDS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label"}, {"li", "ul", "ol", "dl"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "tr", "td", "th", "tbody"}]

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}

_NESTS = {t: re.compile(rf"<{t}(?=[\s/>])([^>]*)>", re.I) for t in ("svg", "object", "template")}


def _end(name: str, page: str, pos: int) -> re.Match | None:
    """The end tag of an element whose start tag ends at pos; of elements that can hold their like, the one that goes with it."""
    end, deep, at = _RAW_END[name].search(page, pos), 0, pos
    while end and name in _NESTS:
        deep += sum(not m[1].endswith("/") for m in _NESTS[name].finditer(page, at, end.start()))
        if not deep:
            break
        deep, at = deep - 1, end.end()
        end = _RAW_END[name].search(page, at) or end
        if end.end() <= at:  # fewer end tags than start tags: the last one it is
            break
    return end


class Tree:
    """Elements in page order; texts: (element, decoded text) or (-1, None) for a border of blocks, in page order."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.groups, self.depth = [-1], ["html"], [0], [0]
        self.texts: list[tuple[int, str | None]] = []
        stack, pos, out = [0], 0, self.texts
        hidden, unclosed = [False], set()
        tag = self.tag
        while pos < len(page):
            m = _TOKEN.search(page, pos)
            if m is None or m.start() > pos:
                part = html.unescape(page[pos : m.start() if m else len(page)])
                if part and not part.isspace():
                    out.append((stack[-1], part))
                elif part:
                    out.append((stack[-1], " "))
                if hidden[stack[-1]] and part:
                    out.pop()
                if m is None:
                    break
            pos = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m.group().startswith("<![CDATA[") and not hidden[stack[-1]]:
                    out.append((stack[-1], m.group()[9:].removesuffix("]]>")))
                continue
            block = name in BLOCKS
            if block:
                out.append((-1, None))
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            attrs = m[3] if m[3] is not None else m[6] or ""
            if name in VOID or name == "html":
                if name in ("br", "hr"):
                    out.append((stack[-1], " "))
                continue
            if name in RAW:
                if not attrs.endswith("/") or name != "svg":
                    if name == "head":
                        continue
                    end = None if name in unclosed else _end(name, page, pos)
                    if end or name in TO_THE_END:
                        pos = end.end() if end else len(page)
                        continue
                    # without an end tag an element like others, whose texts don't count
                    unclosed.add(name)
                else:
                    continue
            if block:
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if tag[stack[k]] in BLOCKS:
                        break
            if name in CLOSES:
                closed, bar = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] in bar:
                        break
                    if tag[stack[k]] in closed:
                        del stack[k:]
                        if name != "tr":
                            break
            groups = 0
            if attrs:
                for a in _ATTR.finditer(attrs):
                    for t in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()):
                        if t in _GROUP_OF:
                            groups |= 1 << _GROUP_OF[t]
            self.parent.append(stack[-1])
            tag.append(name)
            hidden.append(hidden[stack[-1]] or name in RAW)
            self.groups.append(groups)
            self.depth.append(self.depth[stack[-1]] + 1)
            stack.append(len(tag) - 1)

    def features(self) -> np.ndarray:
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, commas, links, words, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for at, x in self.texts:
            if x and x != " ":
                chars[at] += len(x)
                commas[at] += x.count(",") + x.count(".")
                words[at] += x.count(" ") + 1
        own = list(chars)
        tags, paras, anchors, kids, place, same = [1] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        kinds, up_groups = [0] * n, [0] * n
        counts: dict[tuple[int, str], int] = {}
        for v in range(1, n):
            p, t = parent[v], tag[v]
            place[v] = kids[p]
            kids[p] += 1
            counts[p, t] = counts.get((p, t), 0) + 1
            bits = 0
            for k, kind in enumerate(_KINDS):
                if t in kind:
                    bits |= 1 << k
            kinds[v] = kinds[p] | bits
            up_groups[v] = up_groups[p] | self.groups[v]
        run = 0
        for v in range(n):
            before[v] = run
            run += own[v]
            if v:
                same[v] = counts[parent[v], tag[v]]
        for v in range(n - 1, 0, -1):
            p = parent[v]
            if tag[v] == "a":
                links[v] = chars[v]
                anchors[v] += 1
            elif tag[v] == "p":
                paras[v] += 1
            chars[p] += chars[v]
            commas[p] += commas[v]
            links[p] += links[v]
            words[p] += words[v]
            tags[p] += tags[v]
            paras[p] += paras[v]
            anchors[p] += anchors[v]
        up = np.array(parent)
        up[0] = 0
        c, t = np.array(chars, float), np.array(tags, float)
        total = max(1.0, c[0])
        kind, grp, grp_up = np.array(kinds), np.array(self.groups), np.array(up_groups)
        number = np.array([_TAG_NO.get(x, 0) for x in tag])
        sib, pos = np.maximum(1, np.array(kids))[up], np.array(place)
        cols = [number, number[up], np.array(self.depth), np.log1p(c), c / total, c / t, np.array(links) / np.maximum(1.0, c), np.array(commas) / np.maximum(1.0, np.array(words)), np.log1p(np.array(words)), np.array(paras), np.array(anchors), np.array(kids), sib, pos / sib, np.array(same) / sib, np.array(before) / total, c / np.maximum(1.0, c[up]), np.log1p(np.array(own))]
        cols += [(kind >> k) & 1 for k in range(len(_KINDS))]
        cols += [(grp >> k) & 1 for k in range(len(GROUPS))] + [(grp_up >> k) & 1 for k in range(len(GROUPS))]
        return np.stack(cols, 1).astype(np.float64)

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Whether each element's own text is main text."""
        n = len(self.tag)
        yes = -np.logaddexp(0, -odds)
        no = -np.logaddexp(0, odds)
        y, x = yes.tolist(), no.tolist()
        all_in, all_out, mixed = list(y), list(x), [0.0] * n
        own = [max(a, b) for a, b in zip(y, x)]
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            all_in[p] += all_in[v]
            all_out[p] += all_out[v]
            mixed[p] += max(all_in[v], all_out[v], mixed[v] + own[v] - MIXED)
        state = [0] * n  # 1: wholly, -1: not at all, 0: mixed
        for v in range(n):
            above = state[self.parent[v]] if v else 0
            if above:
                state[v] = above
            else:
                free = mixed[v] + own[v] - MIXED
                state[v] = 1 if all_in[v] >= max(all_out[v], free) else -1 if all_out[v] >= free else 0
        return [s > 0 or (s == 0 and y[v] > x[v]) for v, s in enumerate(state)]

    def text(self, chosen: list[bool]) -> str:
        blocks, now = [], []
        for at, x in [*self.texts, (-1, None)]:
            if at < 0:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif chosen[at]:
                now.append(x)
        return "\n\n".join(blocks)


# ---- boosted trees ----


class Boosted:
    """Logistic gradient boosting with histogram splits; trees of one depth as arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        n, d = b.shape
        self.start = float(np.log(max(1e-6, y.mean()) / max(1e-6, 1 - y.mean())))
        odds, self.trees = np.full(n, self.start), []
        flat = b + np.arange(d) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                for k in range(2**level):
                    at = 2**level - 1 + k
                    on = np.flatnonzero(node == at)
                    if len(on) < 20:
                        continue
                    keys = flat[on].ravel()
                    sg = np.bincount(keys, np.repeat(g[on], d), d * BINS).reshape(d, BINS).cumsum(1)
                    sh = np.bincount(keys, np.repeat(h[on], d), d * BINS).reshape(d, BINS).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[:, -1] = -1
                    for j, e in enumerate(self.edges):
                        gain[j, len(e) :] = -1
                    j, s = divmod(int(gain.argmax()), BINS)
                    if gain[j, s] > 1e-3:
                        feature[at], cut[at] = j, self.edges[j][s]
                f = feature[node]
                node = 2 * node + 1 + (x[np.arange(n), f] >= cut[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            odds += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, r = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[r, feature[node]] >= cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


# ---- made-up pages ----


class _Pages:
    """Pages whose main parts lie between marks in the text: words of the main text begin with MARK."""

    MARK = "\ue000"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, least: int, most: int, main: bool = False) -> str:
        r = self.r
        n = int(least * (most / least) ** r.random())
        w = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n)]
        return (self.MARK if main else "") + " ".join(w) + r.choice([".", ""])

    def attr(self, groups: str, often: float = 0.8) -> str:
        r = self.r
        if r.random() > often:
            return r.choice(["", f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"', ' class="row"', ' class="wrap"'])
        t = r.choice([x for g in groups.split() for x in GROUPS[g].split()])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "site-", "page-", "box "])}{t}"'

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" ", " | "]).join(items)

    def rejected(self) -> str:
        r, kind = self.r, self.r.choice(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share"])
        if kind == "nav":
            t = r.choice(["nav", "nav", "div", "table"])
            if t == "table":
                return "<table><tr>" + "".join(f'<td><a href="/{k}">{self.words(1, 3)}</a></td>' for k in range(r.randint(3, 7))) + "</tr></table>"
            return f"<{t}{self.attr('menu', 0.3 if t == 'nav' else 0.95)}>{self.links(r.randint(3, 9))}</{t}>"
        if kind in ("header", "footer", "aside"):
            t = r.choice([kind, kind, "div"])
            group = {"header": "head", "footer": "foot", "aside": "side"}[kind]
            inner = r.choice([self.words(2, 30), f"<p>{self.words(3, 40)}</p>", f"<h2>{self.words(1, 4)}</h2>{self.links(r.randint(2, 6))}", "&copy; " + self.words(3, 20), f"<h3>{self.words(1, 4)}</h3><p>{self.words(5, 60)}</p>"])
            return f"<{t}{self.attr(group, 0.3 if t == kind else 0.95)}>{inner}</{t}>"
        if kind == "form":
            return f"<form{self.attr('form', 0.4)}><label>{self.words(1, 4)}</label><input name=q><p>{self.words(2, 15)}</p></form>"
        if kind == "comments":
            t = r.choice(["section", "div", "ol", "ul"])
            inner = "li" if t in ("ol", "ul") else "div"
            return f"<{t}{self.attr('comment', 0.97)}>" + "".join(f"<{inner}{self.attr('comment', 0.6)}><b>{self.words(1, 2)}</b><p>{self.words(3, 50)}</p></{inner}>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        group = {"ad": "ad", "notice": "notice", "share": "share"}[kind]
        inner = r.choice([self.words(3, 40), f"<p>{self.words(3, 40)}</p>", self.links(r.randint(2, 5)), f"<a href=/x>{self.words(2, 10)}</a>"])
        return f"<div{self.attr(group, 0.97)}>{inner}</div>"

    def passage(self) -> str:
        r, kind = self.r, self.r.random()
        t = lambda a, b: self.words(a, b, True)
        if kind < 0.66:
            x = t(1, 150)
            if r.random() < 0.25:
                return f"<p><b>{x}<br>"
            if r.random() < 0.2:
                x += f' <a href="/y">{t(1, 5)}</a> {t(2, 20)}'
            return f"<p>{x}</p>" if r.random() < 0.9 else f"<p>{x}"
        if kind < 0.76:
            return f"<h2>{t(1, 8)}</h2>"
        if kind < 0.85:
            return f"<{(l := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{t(1, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{l}>"
        if kind < 0.9:
            return f"<blockquote><p>{t(5, 40)}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{t(1, 4)}</td><td>{t(1, 4)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return r.choice([f"<pre>{t(3, 30)}</pre>", f"<figure><img src=a><figcaption>{t(2, 12)}</figcaption></figure>"])

    def page(self) -> str:
        r = self.r
        h = r.choice(["h1", "h1", "h1", "h2"])
        title = [f"<{h}>{self.words(2, 12, True)}</{h}>"] * (r.random() < 0.85)
        apart = title if r.random() < 0.2 else []  # a title above the text's own element
        inside = ([] if apart else title) + [self.passage() for _ in range(int(30 ** r.random()))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inside.insert(r.randint(min(1, len(inside)), len(inside)), self.rejected())
        body = "".join(inside)
        t = r.choice(["article", "article", "article", "main", "div", "section", "div", "div", ""])
        if t:
            body = f"<{t}{self.attr('main', 0.2 if t in ('article', 'main') else 0.6)}>{body}</{t}>"
        if apart:
            body = f"<div{self.attr('main', 0.3)}>{apart[0]}{body}{self.rejected() if r.random() < 0.3 else ''}</div>"
        if r.random() < 0.3:
            body = f"<div{self.attr('main', 0.5)}>{body}{self.rejected() if r.random() < 0.4 else ''}</div>"
        before, after = "".join(self.rejected() for _ in range(r.randint(0, 3))), "".join(self.rejected() for _ in range(r.randint(0, 3)))
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{before}{body}{after}{end}"


@lru_cache(maxsize=1)
def fit() -> Boosted:
    """Fitted on the driver on PAGES made-up pages; the same in every run."""
    make, xs, ys = _Pages(SEED), [], []
    for _ in range(PAGES):
        tree = Tree(make.page())
        good, bad = np.zeros(len(tree.tag)), np.zeros(len(tree.tag))
        for at, text in tree.texts:
            if text and not text.isspace():
                (good if _Pages.MARK in text else bad)[at] += 1
        tree.texts = [(a, t.replace(_Pages.MARK, "") if t else t) for a, t in tree.texts]
        for v in range(len(tree.tag) - 1, 0, -1):
            good[tree.parent[v]] += good[v]
            bad[tree.parent[v]] += bad[v]
        on = good + bad > 0
        xs.append(tree.features()[on])
        ys.append((good > 0)[on] & (bad == 0)[on])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    features = [t.features() for t in trees]
    odds = model.odds(np.concatenate(features))
    ends = np.cumsum([len(f) for f in features])
    return [t.text(t.decode(o)) for t, o in zip(trees, np.split(odds, ends[:-1]))]


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (code points)."""
    shared = df.sparkSession.sparkContext.broadcast(fit())

    def make():
        model = shared.value

        def run(batch):
            found = main_texts(texts(batch, html_col), model)
            return found, [len(x) for x in found]

        return run

    return map_rows(df, make, fields("text string, n_chars long"), keep=keep, needs=[html_col])
