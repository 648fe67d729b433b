"""Main-text extraction with a site style tree.

All pages of a host are merged into one style tree: a node is the way of elements to a block, with their classes, ids
and roles. For each node two distributions are counted: presentation (the runs of child elements seen in it) and content (the
texts directly in it; a text that is links alone counts by that, not by its words, so a menu is the same menu on every page). The
node's importance is the larger normalised entropy of the two, 1 below ``min_seen`` occurrences: what looks and reads
the same on every page is near 0. What elements and names say is a prior that shifts it: +1 in an article or main element, -0.5 in
navigation, headers, footers, sidebars, adverts, notices, forms, comments and what is hidden, and beside the main element of a
page that has one. The branches left out of every page of the host are those whose nodes all stay at or below
``min_importance``; a node above it keeps its own text. Scripts, styles and the like are not text.

A name counts if all its words do ("related-posts", not "related-work"), not on parts of tables and not after
"has", "with" or "no"; an article or main element inside such a name, or inside a form, is still the main text.

Counts are aggregated in the task, then by host, node and value, then as sums of c log c, so a host
with a third of all pages is no hot group. The low nodes go back to the pages as a
broadcast while they number at most ``broadcast_rows``, else by joins on host and node, each page with its own nodes.

Defined cases: null html has no text; a null or odd URL is a host of its own name ("" if null);
equal rows give equal rows; unclosed and misnested tags end with the block that holds them, an unclosed quote ends at the
next ">"; a page of which the tree would leave nothing (a host that repeats one page) keeps what is not boilerplate by its priors;
a page without text gives an empty text; an empty table gives no rows; other columns are ignored. Time is linear in a page's length.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import Column, DataFrame, functions as F

OPEN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select canvas audio video xmp noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
OUTSIDE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
CELLS = ("td", "th", "table")
#: what a block ends, and what it does not reach across
CLOSED = {t: ("p", *CLOSES.get(t, ())) for t in BLOCKS}
BOUNDS = {t: (*OUTSIDE.get(t, ()), *(() if t in CLOSES else CELLS)) for t in BLOCKS}
TABLE = frozenset("table thead tbody tfoot tr td th".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav aside footer dialog menu search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
BOILERPLATE_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer copyright sidebar sidenav aside related share sharing social ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup comment comments disqus respond reply replies pagination pager login search toolbar skip".split())
NEUTRAL_NAMES = frozenset("area articles bar bars block bottom box buttons container content footer form global group header icons inner item items left link links list main media message outer page panel post posts primary right secondary section site slot thread top unit widget widgets wrap wrapper".split())
NEGATIONS = frozenset("has with no without not".split())
MAIN, NEUTRAL, WEAK, STRONG = 1, 0, -1, -2  # priors; names and forms are weak
SHIFTS = {MAIN: 1.0, NEUTRAL: 0.0, WEAK: -0.5, STRONG: -0.5}
TOP = 0x9E3779B97F4A7C15


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _named_boilerplate(names: str) -> bool:
    for token in names.split():
        words = [w.lower() for w in WORD.findall(token)]
        if words and words[0] not in NEGATIONS and any(w in BOILERPLATE_NAMES for w in words) and all(w in BOILERPLATE_NAMES or w in NEUTRAL_NAMES for w in words):
            return True
    return False


def _style(tag: str, inside: str) -> tuple[str, int | None]:
    """An element's name in the tree, and the prior that its own tag and attributes give (None: that of the element above)."""
    a = _attributes(inside) if inside.strip(" /\n\t") else {}
    role = a.get("role", "").lower()
    names = sorted({w.lower() for w in WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")})
    style = ".".join([tag, *names, *[x for x in ("hidden",) if x in a], *([role] if role else [])])
    if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower():
        return style, STRONG
    if names and tag not in ("html", "body") and tag not in TABLE and _named_boilerplate(f"{a.get('class', '')} {a.get('id', '')}"):
        return style, WEAK
    if tag in MAIN_TAGS or role == "main":
        return style, MAIN
    return style, WEAK if tag == "form" else None


def _signed(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Page:
    """One pass over a page. blocks: [node, prior, text, is links alone]; looks: node -> runs of child elements."""

    def __init__(self, page: str):
        from xxhash import xxh64_intdigest

        self.hash = lambda node, style: xxh64_intdigest(style.encode("utf-8", "surrogatepass"), node)
        self.blocks: list[list] = []
        self.looks: dict[int, list] = {}
        #: tag, is a block, node, prior, in main, index of the nearest block
        self.stack: list[tuple] = [("", True, TOP, NEUTRAL, False, 0)]
        self.at: dict[str, list[int]] = {}  # tag -> its places in the stack
        self.styles: dict[tuple[str, str], tuple] = {}
        self.words: list[str] = []
        self.linked, self.plain = False, False
        self._read(page)
        if any(b[1] == MAIN for b in self.blocks):
            for b in self.blocks:
                b[0] = self.hash(b[0], "|main")
                b[1] = WEAK if b[1] == NEUTRAL else b[1]  # beside the main element
            self.looks = {self.hash(n, "|main"): c for n, c in self.looks.items()}

    def _flush(self) -> None:
        text = "".join(self.words)
        self.words.clear()
        if "&" in text:
            text = html_lib.unescape(text)
        text = " ".join(text.split())
        if text:
            block = self.stack[self.stack[-1][5]]
            self.blocks.append([block[2], block[3], text, self.linked and not self.plain])
        self.linked = self.plain = False

    def _say(self, text: str) -> None:
        top = self.stack[-1]
        if top[1] or top[3] >= NEUTRAL or self.stack[top[5]][3] < NEUTRAL:  # else it stands in an inline advert or the like
            self.words.append(text)
            if text.strip():
                if self.at.get("a"):
                    self.linked = True
                else:
                    self.plain = True

    def _close(self, to: int) -> None:
        if self.stack[-1][5] >= to:
            self._flush()
        for k in range(len(self.stack) - 1, to - 1, -1):
            self.at[self.stack[k][0]].pop()
        del self.stack[to:]

    def _last(self, tags: tuple[str, ...]) -> int:
        found = 0
        for t in tags:
            if (places := self.at.get(t)) and places[-1] > found:
                found = places[-1]
        return found

    def _read(self, page: str) -> None:
        low, at, quotes = page.lower(), 0, True
        if len(low) != len(page):  # a letter that grows when lowered
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
        last = page.rfind(">")
        while (start := page.find("<", at)) >= 0:
            m = OPEN.match(page, start + 1)
            odd = not m and page.startswith(("!", "?"), start + 1)
            if not m and not odd:
                self._say(page[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self._say(page[at:start])
            if odd:
                for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if page.startswith(begin, start):
                        stop = page.find(end, start + len(begin) if begin != "<!--" else start + 2)
                        at = len(page) if stop < 0 else stop + len(end)
                        break
                continue
            if start > last:  # no tag ends here
                self._say(page[start:])
                at = len(page)
                break
            end = m.end()
            while quotes and (stop := STOP.search(page, end)):
                if stop[0] == ">":
                    end = stop.start()
                    break
                end = page.find(stop[0], stop.end()) + 1
                if not end:
                    break
            else:
                end = 0
            if not end or page[end : end + 1] != ">":
                quotes, end = False, page.find(">", m.end())  # one broken quote, and quotes count no more on this page
            inside, at = page[m.end() : end], end + 1
            at = self._tag(page, low, m[2].lower(), bool(m[1]), inside, at)
        if at < len(page):
            self._say(page[at:])
        self._flush()

    def _tag(self, page: str, low: str, tag: str, closing: bool, inside: str, at: int) -> int:
        block, stack = tag in BLOCKS, self.stack
        if closing:
            k = self._last((tag,))
            if k and (block or k > stack[-1][5]):  # an inline end does not cross a block
                self._close(k)
            return at
        if tag in RAW:
            if inside.endswith("/"):
                return at
            stop = low.find(f"</{tag}", at)
            stop = page.find(">", stop) if stop >= 0 else -1
            return stop + 1 if stop >= 0 else len(page)
        if tag == "hr":
            self._flush()
        if tag in VOID:
            if tag == "br":
                self.words.append(" ")
            return at
        if block:
            self._flush()
            k = self._last(CLOSED[tag])
            if k and k > self._last(BOUNDS[tag]):
                self._close(k)
        _, _, node, prior, in_main, nearest = stack[-1]
        if (known := self.styles.get((tag, inside))) is None:
            known = self.styles[tag, inside] = _style(tag, inside)
        style, own = known
        if tag == "header" and not in_main:
            own = STRONG
        if own is not None and prior != STRONG:
            prior = own
        runs = self.looks.setdefault(node, [])
        if runs and runs[-1][0] == style:
            runs[-1][1] += 1
        else:
            runs.append([style, 1])
        self.at.setdefault(tag, []).append(len(stack))
        if block:
            stack.append((tag, True, self.hash(node, style), prior, in_main or prior == MAIN, len(stack)))
        else:
            stack.append((tag, False, node, prior, in_main, nearest))
        return at

    def counted(self):
        """(node, prior, kind, value): kind 0: its runs of children, 1: a text in it; nodes with text alone."""
        priors = {b[0]: b[1] for b in self.blocks}
        for node, prior in priors.items():
            yield node, prior, 0, _signed(" ".join(f"{s}*{n}" for s, n in self.looks.get(node, ())))
        for node, prior, text, links in self.blocks:
            yield node, prior, 1, 0 if links else _signed(text)

    def main_text(self, low) -> str:
        kept = [b[2] for b in self.blocks if b[0] not in low]
        return "\n".join(kept or [b[2] for b in self.blocks if b[1] >= NEUTRAL])


def main_text(page: str | None) -> str:
    """The main text of a page of which no other of its host is known: all importances are 1."""
    p = _Page(page or "")
    return p.main_text({b[0] for b in p.blocks if 1 + SHIFTS[b[1]] <= 0.5})


def _host() -> Column:
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.coalesce(F.nullif(name, F.lit("")), "url", F.lit(""))


def _as_long(node: int) -> int:
    return node - (1 << 64) if node >> 63 else node


def style_counts(pages: DataFrame, flush_at: int = 200_000) -> DataFrame:
    """(host, node, prior, kind, value, n): kind 0: the hash of a node's runs of children, 1: of a text in it."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts: Counter = Counter()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

        def table():
            cols = list(zip(*((*k, n) for k, n in counts.items())))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["host", "node", "prior", "kind", "value", "n"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((host, _as_long(node), prior, kind, value) for node, prior, kind, value in _Page(page.as_py() or "").counted())
                if len(counts) > flush_at:
                    yield table()
        if counts:
            yield table()

    found = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, node long, prior int, kind int, value long, n long")
    return found.groupBy("host", "node", "kind", "value").agg(F.max("prior").alias("prior"), F.sum("n").alias("n"))


def importances(pages: DataFrame, min_seen: int = 8) -> DataFrame:
    """(host, node, prior, seen, importance) of every node that holds text."""
    sums = style_counts(pages).groupBy("host", "node", "kind").agg(F.max("prior").alias("prior"), F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0)
    nodes = sums.select("host", "node", "prior", "m", entropy.alias("e")).groupBy("host", "node").agg(F.max("prior").alias("prior"), F.max("m").alias("seen"), F.max("e").alias("e"))
    return nodes.select("host", "node", "prior", "seen", F.when(F.col("seen") >= min_seen, F.col("e")).otherwise(1.0).alias("importance"))


def low_branches(pages: DataFrame, min_importance: float = 0.5, min_seen: int = 8) -> DataFrame:
    """(host, node): what is left out of each host's pages."""
    shift = F.create_map(*[F.lit(x) for k, v in SHIFTS.items() for x in (k, v)])[F.col("prior")]
    return importances(pages, min_seen).where(F.col("importance") + shift <= min_importance).select("host", "node")


def _with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """rows (…, host, html, k) with ``low``: those of the page's own nodes that are low, by joins on host and node; no array
    is longer than the nodes of one page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k, host, node = [], [], []
            for key, name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                nodes = {_as_long(b[0]) for b in _Page(page.as_py() or "").blocks}
                k += [key] * len(nodes)
                host += [name] * len(nodes)
                node += nodes
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(host, pa.string()), pa.array(node, pa.int64())], names=["k", "host", "node"])

    nodes = rows.select("k", "host", "html").mapInArrow(run, "k long, host string, node long").distinct()
    return rows.join(nodes.join(low, ["host", "node"]).groupBy("k").agg(F.collect_set("node").alias("low")), "k", "left")


def extract(pages: DataFrame, min_importance: float = 0.5, min_seen: int = 8, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    from .shared import materialise

    low = materialise(low_branches(pages, min_importance, min_seen), "branches")
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    if low.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(low.groupBy("host").agg(F.collect_list("node").alias("low"))), "host", "left")
    else:
        rows = _with_low(rows.withColumn("k", F.xxhash64("host", "html")), low)
    rows = rows.select("page_id", "url", "html", "low")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen: dict = {}
            texts = []
            for page, gone in zip(batch.column(2), batch.column(3)):
                names = gone.as_py() or ()
                key = (len(names), names[0], names[-1]) if names else ()
                if seen.get("key") != key or seen["names"] != names:
                    seen = {"key": key, "names": names, "set": {x % (1 << 64) for x in names}}
                texts.append(_Page(page.as_py() or "").main_text(seen["set"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
