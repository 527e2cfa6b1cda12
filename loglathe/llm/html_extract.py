"""Main text of web pages by site style trees.

The pages of one host are merged into a tree whose nodes are paths of elements (tag and class, digits as
#). `style_tree` gathers for each node how its instances present their children (style nodes) and which
texts they hold on how many different pages. A presentation's importance is the entropy of its variants,
to the base of the pages that have it; that of content is 1 minus the mean entropy of its texts over the
host's pages, so text that every page repeats counts 0 and text of one page 1. The composite importance
of a node is the mean of its content's and of all presentations and contents of its branch. A shared
tree merges all hosts; a host's figures are drawn to it with the weight of `SHARED_PAGES` pages, so a
host with one page is judged by the shared tree and a large one by itself. What one page alone shows has
the importance `UNKNOWN`.

`extract` keeps a block of text if its node's importance, times a prior, reaches `LOW`. Priors come from
tags and names: `PRIOR` has those of plain nodes, of names that hint at something else than main text
(`form-guide`), of text beside `article` and `main`, and of elements and names that mean nothing else
(`nav`, `sidebar`). The last is not final either: where a branch so named holds `MAJOR` of its host's text
and a page would be left empty without it (a form around the whole page), it counts as plain.

Defined cases: null and empty pages give empty texts; pages without a host are one host; copies of a
page count once; where nothing else would be left of a page, content of `article` and `main` stays whatever
its importance. Broken markup
never fails: unknown end tags are passed over, open elements end with the page, and where the end tag of
an element whose content is no markup is missing, script, style, textarea and title take the rest of the
page and others nothing. Pages may be of any length; columns that clash with `out` are replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ensure_checkpoint_dir, free_name

#: Blocks stay whose importance times their prior reaches LOW.
LOW = 0.25
#: The shared tree counts as so many pages of a host; a branch with so much of a host's text is its main one.
SHARED_PAGES, MAJOR = 3, 0.8
#: The importance of what only one page shows: the prior decides.
UNKNOWN = 0.5
#: What an element says of its text, from worst to best.
NEVER, NOISE, HINT, PLAIN, CONTENT = range(5)
#: Priors of blocks by the worst of their elements; beside content for plain blocks on pages that have some.
PRIOR = {NOISE: 0.2, HINT: 0.5, PLAIN: 1.0}
BESIDE = 0.334
#: Verdicts of so many nodes (16 MB) are broadcast at most; with more, pages shuffle to those of their host.
BROADCAST_NODES = 1_000_000
#: Pages with a host's verdicts beside them that a Python worker gets at once.
JOINED_ROWS = 64

#: Elements by their part in a page.
NEVER_TAGS = frozenset("script style noscript template iframe object svg canvas button select textarea head title audio video map".split())
NOISE_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose content is no markup here; the first four reach to the end of the page if nothing ends them.
ENDLESS_TAGS = frozenset(("script", "style", "textarea", "title"))
RAW_TAGS = ENDLESS_TAGS | {"noscript", "iframe", "template", "svg"}
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Names of classes, ids and roles of what isn't main text.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register search comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations popular trending widget widgets copyright legal disclaimer pagination pager tags complementary contentinfo form".split()
)
#: Words that add nothing to such a name (`site-footer`), and names of main text.
LAYOUT_NAMES = frozenset("container wrapper wrap left right site page global main area list section block box top bottom item items links link inner outer row col column primary secondary post blog bar body text slot unit zone panel group thread".split())
CONTENT_NAMES = frozenset("content article story entry post main".split())
#: A start tag that closes an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
KEEPS_P = frozenset(("option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"))

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*?)>?\Z", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PREFIX = re.compile(r"^(?:has|no|with|without|is|show|hide)[-_]")
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _named(name: str, tag: str) -> int:
    """What one class, id or role says."""
    if _PREFIX.match(name):
        return PLAIN
    parts = [x for x in (_DIGITS.sub("", y).lower() for y in _SPLIT.split(name)) if x]
    noise = [x for x in parts if x in NOISE_NAMES]
    if not noise:
        return PLAIN
    if tag not in HEADINGS and all(x in NOISE_NAMES or x in LAYOUT_NAMES for x in parts):
        return NOISE
    return HINT if parts[0] in noise or parts[-1] in noise else PLAIN


def _judge(tag: str, attrs: str, in_content: bool) -> tuple[int, str]:
    """What an element says of its text, and the node's name: tag and class."""
    own = NEVER if tag in NEVER_TAGS else NOISE if tag in NOISE_TAGS and not (tag == "header" and in_content) else CONTENT if tag in CONTENT_TAGS else PLAIN
    if not attrs or attrs.isspace():
        return own, tag
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    label = f"{tag}.{_DIGITS.sub('#', found.get('class', ''))}"
    if own == NEVER or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return NEVER, label
    if tag in ("html", "body"):
        return PLAIN, label
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split()
    said = [_named(x, tag) for x in names]
    if tag in CONTENT_TAGS:  # an article is what it says, but for one of the readers
        readers = {"comment", "comments", "reply", "replies"}
        return (NOISE if any(readers & set(_SPLIT.split(x.lower())) for x in names) else CONTENT), label
    worst = min(said, default=PLAIN)
    if worst == NOISE and in_content and all(x.lower() in ("header", "masthead") for x, k in zip(names, said, strict=True) if k == NOISE):
        worst = PLAIN
    if worst == HINT and any(x.lower() in CONTENT_NAMES for x in names):
        worst = PLAIN
    if min(worst, own) < PLAIN:
        return min(worst, own), label
    if found.get("role", "").lower() in ("main", "article") or found.get("itemprop") == "articleBody":
        return CONTENT, label
    return own, label


@dataclass(slots=True)
class Node:
    key: int
    tag: str
    up: Node | None
    says: int  # of itself
    content: bool  # inside an article or main
    worst: int  # of itself and all above
    children: list[int] = field(default_factory=list)


class Parser:
    """Pages to nodes and blocks of text; keys of paths are remembered for a worker's life, to a bound."""

    def __init__(self) -> None:
        self.keys: dict[tuple[int, str], int] = {}

    def key(self, up: int, name: str) -> int:
        import xxhash

        k = self.keys.get((up, name))
        if k is None:
            if len(self.keys) > 100_000:
                self.keys.clear()
            self.keys[up, name] = k = xxhash.xxh3_64_intdigest(f"{up}>{name}") >> 1
        return k

    def parse(self, page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
        """All block elements in page order, and the blocks of text with their nodes."""
        root = Node(self.key(0, ""), "", None, PLAIN, False, PLAIN)
        nodes, blocks, text, stack = [root], [], [], [root]
        at, end = 0, len(page)
        missing: set[str] = set()  # of these no end tag is left, so none need be looked for

        def flush() -> None:
            if text:
                joined = " ".join(_html.unescape("".join(text)).split())
                if joined:
                    blocks.append((stack[-1], joined))
                text.clear()

        while at < end:
            m = _TOKEN.search(page, at)
            if not m:
                text.append(page[at:])
                break
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            close, tag, attrs = m.group(1), m.group(2), m.group(3)
            if tag is None:
                raw = m.group()
                t = None if raw.startswith(("<!", "<?")) else _TAG.match(raw)
                if not t or not raw.endswith(">"):
                    continue
                close, tag, attrs = t.groups()
            tag = tag.lower()
            top = stack[-1]
            if close:
                if tag in INLINE_TAGS and not any(n.tag == tag for n in stack[1:]):
                    continue
                if any(n.tag == tag for n in stack[1:]):
                    flush()
                    while stack.pop().tag != tag:
                        pass
                elif tag not in VOID_TAGS:
                    flush()
                continue
            if tag in VOID_TAGS:
                if tag == "br":
                    text.append(" ")
                elif tag == "hr":
                    flush()
                continue
            says, name = _judge(tag, attrs, top.content)
            if tag in INLINE_TAGS and says != NEVER:
                continue
            flush()
            if tag in CLOSES or tag not in INLINE_TAGS and tag not in KEEPS_P:
                group = CLOSES.get(tag, ()) or ("p",)
                if tag == "p" or tag not in CLOSES:
                    if top.tag == "p":
                        stack.pop()
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in group:
                            del stack[i:]
                            break
                        if stack[i].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                            break
            top = stack[-1]
            node = Node(self.key(top.key, name), tag, top, says, top.content or says == CONTENT, min(top.worst, says, PLAIN))
            top.children.append(node.key)
            nodes.append(node)
            if attrs.endswith("/") and tag not in ("p", "div", "li", *ENDLESS_TAGS):
                continue
            if tag in RAW_TAGS:
                found = None if tag in missing else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = found.end() if found else end if tag in ENDLESS_TAGS else at
                if not found and tag not in ENDLESS_TAGS:
                    missing.add(tag)
                continue
            stack.append(node)
        flush()
        return nodes, blocks


#: Added to a verdict, an importance in hundredths, for a branch with most of its host's text.
MAIN_BRANCH, DEFAULT = 1000, int(UNKNOWN * 100)


def main_text(nodes: list[Node], blocks: list[tuple[Node, str]], verdicts: dict[int, int] | None = None) -> str:
    """The blocks of a parsed page that stay, by the verdicts of nodes; without one their importance is unknown."""
    v = verdicts or {}

    def stay(plain: bool) -> list[str]:
        """With `plain`, noise that is its host's main branch counts as plain."""
        rows = []
        for n, t in blocks:
            worst = n.worst
            if plain and worst == NOISE:
                worst = min(PLAIN if x.says == NOISE and v.get(x.key, 0) >= MAIN_BRANCH else min(x.says, PLAIN) for x in _path(n))
            if worst > NOISE:
                rows.append((n, t, PRIOR[worst], v.get(n.key, DEFAULT) % MAIN_BRANCH / 100))
        inside = any(n.content for n, *_ in rows)
        found = [t for n, t, prior, x in rows if x * (min(prior, BESIDE) if inside and not n.content else prior) >= LOW]
        return found or [t for n, t, *_ in rows if n.content]

    return " ".join(stay(False) or stay(True))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _hash(x: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x) >> 1


#: Kinds of observations: a presentation, a text, a page that has the node, and characters below noise.
SHAPE, TEXT, PAGE, MASS = range(4)
#: The site of the tree of all hosts.
SHARED = -1


def style_tree(pages: DataFrame, host: str, page: str) -> tuple[DataFrame, DataFrame]:
    """(site, node, importance, main) of the nodes of all hosts' trees, and (site, n), every host's number of pages.

    Only hashes and counts are shuffled, pre-aggregated; no host's rows come together in one task.
    """

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser()
        names = ["site", "node", "kind", "v", "sig", "chars", "up"]

        def frame(out: list[tuple], mass: dict[tuple[int, int], int]) -> pd.DataFrame:
            out += [(site, node, MASS, 0, 0, n, None) for (site, node), n in mass.items()]
            told: set[tuple[int, int]] = set()  # the path goes with one row of each node only
            rows = []
            for x in out:
                first = x[:2] not in told
                told.add(x[:2])
                rows.append((*x[:6], x[6]() if first and x[6] else None))
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            out: list[tuple] = []
            mass: dict[tuple[int, int], int] = {}
            for h, text in zip(batch["h"], batch["t"], strict=True):
                nodes, blocks = parser.parse(text or "")
                sig, site = _hash(text or ""), _hash(h)
                out.append((site, 0, PAGE, 0, sig, 0, None))
                here: set[int] = set()

                def see(n: Node, kind: int, v: int, here=here, out=out, site=site, sig=sig) -> None:
                    def path() -> list[int]:
                        return [x.key for x in _path(n)]

                    if n.key not in here:
                        here.add(n.key)
                        out.append((site, n.key, PAGE, 0, sig, 0, path))
                    out.append((site, n.key, kind, v, sig, 0, path))

                for n in nodes[1:]:
                    if n.worst > NOISE and n.children:
                        see(n, SHAPE, _hash(repr(n.children)))
                for n, t in blocks:
                    if n.worst > NOISE:
                        see(n, TEXT, _hash(t))
                    if n.worst > NEVER:
                        mass[site, 0] = mass.get((site, 0), 0) + len(t)
                        for x in _path(n):
                            if x.says == NOISE:
                                mass[site, x.key] = mass.get((site, x.key), 0) + len(t)
                if len(out) > 50_000:
                    yield frame(out, mass)
                    out, mass = [], {}
            yield frame(out, mass)

    seen = pages.select(F.col(host).alias("h"), F.col(page).alias("t")).mapInPandas(observe, "site long, node long, kind int, v long, sig long, chars long, up array<long>")
    c = seen.groupBy("site", "node", "kind", "v").agg(F.count_distinct("sig").alias("c"), F.sum("chars").alias("chars"), F.first("up", ignorenulls=True).alias("up"))
    ensure_checkpoint_dir(pages.sparkSession)
    c = c.checkpoint()  # one row for each text of each host's tree; pages are parsed once for it
    all_sites = c.groupBy("node", "kind", "v").agg(F.sum("c").alias("c"), F.sum("chars").alias("chars"), F.first("up", ignorenulls=True).alias("up"))
    c = c.unionByName(all_sites.withColumn("site", F.lit(SHARED).cast("long")))
    # of each node: pages, mean content, mean presentation and the characters below noise
    logs = F.sum(F.when(F.col("kind") == TEXT, F.log("c"))), F.sum(F.when(F.col("kind") == SHAPE, F.col("c") * F.log("c")))
    n = {k: F.sum(F.when(F.col("kind") == kind, F.col("c"))) for k, kind in (("pages", PAGE), ("shapes", SHAPE))}
    per = c.groupBy("site", "node").agg(n["pages"].alias("pages"), n["shapes"].alias("shapes"), F.count(F.when(F.col("kind") == TEXT, 1)).alias("texts"), logs[0].alias("logc"), logs[1].alias("clogc"), F.sum("chars").alias("chars"), F.first("up", ignorenulls=True).alias("up"))
    many = F.col("pages") > 1
    own = F.when(F.col("texts") > 0, F.when(many, F.greatest(F.lit(0.0), 1 - F.col("logc") / (F.col("texts") * F.log("pages")))).otherwise(1.0))
    entropy = F.log("shapes") - F.col("clogc") / F.col("shapes")
    shape = F.when(F.col("shapes") > 0, F.when(many, F.least(F.lit(1.0), entropy / F.log("pages"))).otherwise(1.0))
    per = per.withColumn("own", own).withColumn("shape", shape)
    half = F.coalesce(F.col("shape") * 0.5, F.lit(0.0)) + F.coalesce("own", F.lit(0.0))
    weight = F.when(F.col("shape").isNotNull(), 0.5).otherwise(0.0) + F.when(F.col("own").isNotNull(), 1.0).otherwise(0.0)
    branch = per.where("up is not null and pages is not null").select("site", F.explode("up").alias("node"), half.alias("imp"), weight.alias("w"))
    branch = branch.groupBy("site", "node").agg((F.sum("imp") / F.sum("w")).alias("composite"))
    whole = per.where("node = 0").select("site", F.col("chars").alias("whole"), F.col("pages").alias("n"))
    tree = per.where("node <> 0").select("site", "node", "pages", "own", "chars").join(branch, ["site", "node"], "left").join(whole, "site")
    tree = tree.select("site", "node", F.coalesce("pages", F.lit(0)).alias("pages"), ((F.coalesce("own", "composite") + F.col("composite")) / 2).alias("imp"), F.when(F.col("whole") > 0, F.col("chars") / F.col("whole")).otherwise(0.0).alias("share"), "n").checkpoint()
    def drawn(x: str, to: Column, n: Column) -> Column:
        n = F.greatest(n - 1, F.lit(0))
        return (F.coalesce(F.col(x), F.lit(0.0)) * n + to * SHARED_PAGES) / (n + SHARED_PAGES)

    shared = tree.where(F.col("site") == SHARED).select("node", drawn("imp", F.lit(UNKNOWN), F.col("pages")).alias("imp_all"), F.col("share").alias("share_all"))
    each = tree.where(F.col("site") != SHARED).join(shared, "node")
    each = each.select("site", "node", drawn("imp", F.col("imp_all"), F.col("pages")).alias("importance"), (drawn("share", F.col("share_all"), F.col("n")) >= MAJOR).alias("main"))
    return each, whole.where(F.col("site") != SHARED).select("site", "n")


def _path(n: Node) -> list[Node]:
    out = [n]
    while out[-1].up is not None and out[-1].up.up is not None:
        out.append(out[-1].up)
    return out


def _rules(nodes: np.ndarray, codes: np.ndarray) -> dict[int, int]:
    return dict(zip(nodes.tolist(), codes.tolist(), strict=True))


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each whole page."""
    spark = pages.sparkSession
    bound_batches(spark)
    pages = pages.drop(out) if out not in (url, page) else pages
    h = free_name(pages, "host")
    pages = pages.withColumn(h, host_of(F.col(url)))
    tree, sites = style_tree(pages, h, page)
    code = F.floor(F.col("importance") * 100 + 1e-6).cast("int") + F.when(F.col("main"), MAIN_BRANCH).otherwise(0)
    # of other nodes the prior decides as it does of unknown ones
    verdicts = tree.where((F.col("importance") < UNKNOWN) | (F.col("importance") >= LOW / BESIDE) | F.col("main")).select("site", "node", code.alias("code")).checkpoint()
    if verdicts.limit(BROADCAST_NODES + 1).count() > BROADCAST_NODES:
        return _extract_joined(pages, sites, verdicts, h, page, out).drop(h)
    t = verdicts.orderBy("site").toArrow()
    found, starts = np.unique(t["site"].to_numpy(), return_index=True)
    nodes, codes = np.split(t["node"].to_numpy(), starts[1:]), np.split(t["code"].to_numpy(), starts[1:])
    shared = spark.sparkContext.broadcast(dict(zip(found.tolist(), zip(nodes, codes, strict=False), strict=False)))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parser, rules = Parser(), {}
        for texts, hosts in batches:
            got = []
            for t, x in zip(texts, hosts, strict=True):
                if x not in rules:
                    if len(rules) > 1000:
                        rules.clear()
                    nodes_codes = shared.value.get(_hash(x))
                    rules[x] = _rules(*nodes_codes) if nodes_codes else {}
                got.append(main_text(*parser.parse(t or ""), rules[x]))
            yield pd.Series(got, dtype="object")

    return pages.withColumn(out, run(F.col(page), F.col(h))).drop(h)


#: Pages of a host that meet its verdicts in one task, and hosts at most whose pages are dealt over several.
HOST_PAGES, HOT_HOSTS = 5_000, 200_000


def _extract_joined(pages: DataFrame, sites: DataFrame, verdicts: DataFrame, h: str, page: str, out: str) -> DataFrame:
    """extract, where all verdicts are too many to broadcast: pages meet those of their host by a join, dealt
    over several tasks for the hosts with the most pages."""
    site, part, parts, rules = (free_name(pages, x) for x in ("site", "part", "parts", "rules"))

    @F.pandas_udf("long")
    def site_of(hosts: pd.Series) -> pd.Series:
        return pd.Series([_hash(x) for x in hosts], dtype="int64")

    hot = sites.where(F.col("n") > HOST_PAGES).orderBy(F.desc("n"), "site").limit(HOT_HOSTS).select("site", F.ceil(F.col("n") / HOST_PAGES).cast("int").alias("k")).checkpoint()  # 12 bytes each
    lists = verdicts.groupBy("site").agg(F.collect_list(F.struct("node", "code")).alias(rules)).join(F.broadcast(hot), "site", "left")
    lists = lists.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).select(F.col("site").alias(site), part, rules)
    rows = pages.withColumn(site, site_of(F.col(h))).join(F.broadcast(hot.select(F.col("site").alias(site), F.col("k").alias(parts))), site, "left")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(page), F.coalesce(parts, F.lit(1))).cast("int")).join(lists, [site, part], "left")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parser = Parser()
        for texts, lists in batches:
            yield pd.Series([main_text(*parser.parse(t or ""), {} if x is None else {y["node"]: y["code"] for y in x}) for t, x in zip(texts, lists, strict=True)], dtype="object")

    bound_batches(pages.sparkSession, JOINED_ROWS)
    return rows.withColumn(out, run(F.col(page), F.col(rules))).drop(site, part, parts, rules)
