"""Main text of pages by equivalence-class template deduction.

Tokens of a page are its elements, each known by its path from the root (tags, classes and ids, digits
levelled; containers of one name also by their turn, so that equal tags can play different roles), and its
text blocks, each with its place.  Over the distinct pages of a host every token has an
occurrence vector (how often it stands on each page); tokens with equal vectors form an equivalence class.
A token is valid in its class when the token of the class around it, and the one before it in there, are the
same on every page, so valid classes are ordered and nested; they make up the host's template.

What is left between template tokens are the slots.  A slot's text is what varies: blocks that are no template
token themselves.  On every page the main element is found by descending from the root, from a template
element to the one inside it that holds most of the slot text outside links, as long as that is at
least half; shares are the host's, over the pages that have the element, drawn towards the share that
elements of the same name hold in all hosts, which decides where a host has few pages.  The slots inside the
main element are the main text, but for elements that are mostly links over the host's pages, elements of
another purpose by their tag, and elements named as comments, adverts or notices: nothing in their
counts tells these from parts of an article, so here names decide.

Three passes read the pages where they lie: vectors, then validity and shares, then slots.  Vectors are compared
by a sum of hashes of (page, count), and all sums are partially aggregated: no host's pages are ever gathered,
however many it has.  A template holds tokens that stand on at least ``SUPPORT`` of a host's pages, so it is
no longer than a few pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: An element is a template token from this share of a host's distinct pages on.
SUPPORT = 0.05
#: A text block is one from this share on, and from three pages on: two pages that share a passage are no template.
TEXT_SUPPORT, TEXT_PAGES = 0.8, 3
#: The share of a name over all hosts counts as much as this many characters of the host's own.
PRIOR = 2000.0
#: Templates are sent to all executors up to this many bytes; beyond, pages are dealt by host and salt.
BROADCAST_BYTES = 32 << 20
SALTS = 32

# Elements without text, and those whose text runs to the end of the page when they are not closed.
RAW = {"script", "style", "noscript", "textarea", "iframe", "template", "svg", "math", "object", "canvas", "head", "title"}
RAW_TO_END = {"script", "style", "noscript", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that can hold an article; the others are parts of one.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "header", "aside", "footer", "nav", "form"}
LISTS = {"ul", "ol", "dl", "menu", "div", "section", "table", "p"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OTHER_PURPOSE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "label", "option"}
NAMED_OUT = {"comment", "comments", "respond", "replies", "disqus", "ad", "ads", "advert", "adverts", "advertisement", "notice", "notices", "cookie", "cookies", "consent", "newsletter", "sponsored"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])(?P<rawattrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def naming(tag: str, attrs: str) -> tuple[str, bool]:
    """The name under which the template knows an element, and whether its attributes put it out of an article."""
    name, out = tag, False
    if attrs.strip():
        for key, *values in ATTR.findall(attrs):
            value, key = next((v for v in values if v), "").lower(), key.lower()
            if key in ("class", "id"):
                name += ("." if key == "class" else "#") + DIGITS.sub("0", value)
                out = out or not NAMED_OUT.isdisjoint(SPLIT.split(value))
            elif key == "role":
                out = out or value in ROLES_OUT
            else:
                out = out or key == "hidden" or value == "true"
    return name, out


class Page:
    """A parsed page: elements in order of their opening tags, and its text blocks."""

    __slots__ = ("tags", "names", "keys", "parents", "outs", "blocks")

    def __init__(self) -> None:
        self.tags, self.names, self.keys, self.parents, self.outs = ["#root"], [0], [0], [-1], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, elements before its end

    def block_keys(self) -> list[int]:
        return [hashed(f"{self.keys[e]}\x00{text}") for e, text, _, _ in self.blocks]


def parse(page: str) -> Page:
    out = Page()
    stack = [0]  # open elements
    buffer: list[str] = []
    linked: list[str] = []  # the part of the buffer that is in links
    turns: dict[tuple[int, str], int] = {}  # containers of a name in an element so far
    links = 0

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                owner = next(e for e in reversed(stack) if out.tags[e] not in INLINE)
                out.blocks.append((owner, text, min(len(text), len(" ".join(entities.unescape("".join(linked)).split()))), len(out.tags)))
            buffer.clear()
            linked.clear()

    def close(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            links -= out.tags[e] == "a"
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        text = m["text"]
        if text is not None:
            buffer.append(text)
            if links > 0:
                linked.append(text)
            continue
        if m["raw"] is not None:
            tag = m["raw"].lower()
            if not m["rawattrs"].rstrip().endswith("/"):
                closed = CLOSING[tag].search(page, at)
                at = closed.end() if closed else end if tag in RAW_TO_END else at
            if tag not in ("svg", "math"):
                flush()
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if out.tags[stack[i]] == tag), None)
            if depth is not None:
                close(depth)
            continue
        if not inline:
            # a paragraph ends where the next block begins, an item where the next one does
            depth = next((i for i in range(len(stack) - 1, -1, -1) if out.tags[stack[i]] not in INLINE), 0)
            if depth and (out.tags[stack[depth]] == "p" or (out.tags[stack[depth]] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                close(depth)
        attrs = m["attrs"]
        name, named_out = naming(tag, attrs)
        e, parent = len(out.tags), stack[-1]
        out.tags.append(tag), out.names.append(hashed(name)), out.parents.append(parent), out.outs.append(named_out)
        nth = turns[parent, name] = turns.get((parent, name), 0) + 1 if tag in CONTAINERS else 0
        out.keys.append(out.keys[parent] if inline else hashed(f"{out.keys[parent]}/{name}/{nth}"))
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(e)
            links += tag == "a"
    flush()
    return out


def shares(page: Page, texts: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element the slot text outside links, the slot text in links, and slot text of headings, all inside it."""
    free, linked, heads = (np.zeros(len(page.tags)) for _ in range(3))
    for (e, text, in_links, _), key in zip(page.blocks, page.block_keys()):
        if key in texts:
            continue
        free[e] += len(text) - in_links
        linked[e] += in_links
        if page.tags[e] in HEADINGS:
            heads[e] += len(text)
    for e in range(len(page.tags) - 1, 0, -1):
        p = page.parents[e]
        free[p] += free[e]
        linked[p] += linked[e]
        heads[p] += heads[e]
    return free, linked, heads


class Template:
    """A host's template: share of slot text and of links by element, and its text blocks."""

    def __init__(self, keys: list[int] = (), share: list[float] = (), links: list[float] = (), texts: list[int] = ()) -> None:
        self.share, self.links, self.texts = dict(zip(keys, share)), dict(zip(keys, links)), set(texts)

    def main(self, page: Page, texts: set[int]) -> tuple[int, np.ndarray, np.ndarray]:
        """The main element, and per element its text outside and in links."""
        free, linked, heads = shares(page, texts)
        once = Counter(page.keys)
        children: dict[int, list[int]] = {}
        nearest = [0] * len(page.tags)  # the innermost candidate around an element
        for e in range(1, len(page.tags)):
            above = nearest[page.parents[e]]
            nearest[e] = above
            if page.tags[e] in CONTAINERS and once[page.keys[e]] == 1:
                children.setdefault(above, []).append(e)
                nearest[e] = e
        whole = free[0]
        part = lambda e: self.share[page.keys[e]] if page.keys[e] in self.share else (free[e] / whole if whole else 0.0)
        at, held = 0, 1.0
        while children.get(at):
            best = max(children[at], key=lambda e: (part(e), -e))
            if part(best) < 0.5 * held or not part(best) or heads[at] - heads[best] > 0:
                break
            at, held = best, part(best)
        return at, free, linked

    def extract(self, page: Page) -> str:
        """The blocks that fill slots of the main element; all its blocks where no slot is filled."""
        for texts in (self.texts, set()):
            main, free, linked = self.main(page, texts)
            inside = np.zeros(len(page.tags), bool)
            inside[main] = True
            for e in range(main + 1, len(page.tags)):
                if inside[page.parents[e]]:
                    tag, total = page.tags[e], free[e] + linked[e]
                    links = self.links.get(page.keys[e], linked[e] / total if total else 0.0)
                    inside[e] = not (page.outs[e] or tag in OTHER_PURPOSE or (tag in LISTS and links >= 0.5))
            got = [text for (e, text, _, _), key in zip(page.blocks, page.block_keys()) if inside[e] and key not in texts]
            if got or not texts:
                return "\n\n".join(got)
        return ""


def main_text(page: str | None) -> str:
    """The main text of a page that is alone on its host."""
    return Template().extract(parse(page or ""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, is_text, n): the tokens of every page; equal pages have equal ``page``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, marks, tokens, texts, ns = [], [], [], [], []
            for i, raw in enumerate(batch.column(1)):
                page = parse(raw.as_py() or "")
                mark = hashed(raw.as_py() or "")
                # inline elements share their parent's path, which is counted by its block elements only
                counts = Counter((k, False) for k, t in zip(page.keys, page.tags) if t not in INLINE)
                counts.update((k, True) for k in page.block_keys())
                for (token, is_text), n in counts.items():
                    hosts.append(i), marks.append(mark), tokens.append(token), texts.append(is_text), ns.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hosts, pa.int32())), pa.array(marks, pa.int64()), pa.array(tokens, pa.int64()), pa.array(texts, pa.bool_()), pa.array(ns, pa.int32())], ["host", "page", "token", "is_text", "n"])

    return pages.select("host", "html").mapInArrow(lean(run), "host string, page long, token long, is_text boolean, n int")


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, class): the tokens of a host's equivalence classes, class 0 for page counts.

    ``class`` hashes the occurrence vector.
    """
    tokens = page_tokens(pages).distinct()
    mask = F.lit((1 << 40) - 1).cast("long")
    vector = F.sum(F.xxhash64("page", "n").bitwiseAND(mask))
    per_token = staged(tokens.groupBy("host", "token", "is_text").agg(F.count("*").alias("on_pages"), vector.alias("class")), "tokens")
    # the root, token 0, stands on every page
    host_pages = per_token.where("token = 0 AND NOT is_text").select(F.col("host").alias("h"), F.col("on_pages").alias("pages"))
    common = per_token.where("token <> 0").join(host_pages, F.col("host") == F.col("h"))
    enough = F.when(F.col("is_text"), (F.col("on_pages") >= F.col("pages") * TEXT_SUPPORT) & (F.col("on_pages") >= TEXT_PAGES)).otherwise(F.col("on_pages") >= F.col("pages") * SUPPORT)
    return staged(common.where(enough).select("host", "token", "is_text", F.xxhash64("class", "on_pages").alias("class")), "classes")


def with_template(pages: DataFrame, found: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the columns of ``found``, one row a host; a hot host is dealt out by salt."""
    found = found.withColumnRenamed("host", "t_host")
    if size <= most:
        return pages.join(F.broadcast(found), F.col("host") == F.col("t_host"), "left").drop("t_host")
    salted = found.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col("host") == F.col("t_host")) & (F.col("salt") == F.col("t_salt")), "left").drop("t_host", "t_salt", "salt")


def valid_tokens(pages: DataFrame, classes: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(host, token, is_text, name, free, base, linked): template tokens, and over their pages their slot text.

    ``base`` is all slot text outside links of the pages that have the token.
    """
    per_host = classes.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes"), F.collect_list("is_text").alias("is_text"))
    size = classes.count() * 17
    joined = with_template(pages, per_host, size, most).select("host", "html", "tokens", "classes", "is_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[int, int, bool], list] = {}
            hosts: dict[str, int] = {}
            known: dict[int, tuple[dict[int, int], set[int]]] = {}
            for i, (host, raw) in enumerate(zip(batch.column(0), batch.column(1))):
                h = hosts.setdefault(host.as_py(), i)
                if h not in known:
                    tokens, cls, is_text = (batch.column(c)[i].as_py() or [] for c in (2, 3, 4))
                    known[h] = dict(zip(tokens, cls)), {t for t, x in zip(tokens, is_text) if x}
                classes_, texts = known[h]
                page = parse(raw.as_py() or "")
                free, linked, _ = shares(page, texts)
                before: dict[tuple[int, int], int] = {}  # class and token around: the token before
                blocks = page.block_keys()
                events = [(e, False, k, e) for e, (k, t) in enumerate(zip(page.keys, page.tags)) if t not in INLINE and e]
                events += [(place - 0.5, True, k, e) for (e, _, _, place), k in zip(page.blocks, blocks)]
                events.sort(key=lambda v: v[0])
                first: dict[tuple[int, int], int] = {}
                seen: set[int] = set()
                for _, is_text, key, e in events:
                    c = classes_.get(key)
                    if c is None:
                        continue
                    p = page.parents[e] if not is_text else e
                    while p > 0 and (page.tags[p] in INLINE or classes_.get(page.keys[p]) != c):
                        p = page.parents[p]
                    place = c, page.keys[p] if p > 0 else 0
                    head = first.setdefault(place, key)
                    sign = xxhash.xxh64_intdigest(f"{place[1]} {before.get(place, 0) if key != head else 0}") >> 1
                    before[place] = key
                    row = rows.get((h, key, is_text))
                    if row is None:
                        row = rows[h, key, is_text] = [sign, sign, 0 if is_text else page.names[e], 0.0, 0.0, 0.0, 0]
                    row[0], row[1] = min(row[0], sign), max(row[1], sign)
                    if not is_text:
                        row[3] += free[e]
                        row[5] += linked[e]
                        row[6] += 1
                        if key not in seen:
                            seen.add(key)
                            row[4] += free[0]
            at = pa.array([k[0] for k in rows], pa.int32())
            columns = list(zip(*rows.values())) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([k[1] for k in rows], pa.int64()), pa.array([k[2] for k in rows], pa.bool_()), *(pa.array(v, t) for v, t in zip(columns, kinds))],
                ["host", "token", "is_text", "lo", "hi", "name", "free", "base", "linked", "n"],
            )

    got = joined.mapInArrow(lean(run), "host string, token long, is_text boolean, lo long, hi long, name long, free double, base double, linked double, n long")
    total = [F.sum(c).alias(c) for c in ("free", "base", "linked")]
    per = got.groupBy("host", "token", "is_text").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("name").alias("name"), *total)
    return staged(per.where("lo = hi").drop("lo", "hi"), "template")


def templates(pages: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """(host, keys, share, links, texts): every host's template, and its bytes."""
    valid = valid_tokens(pages, token_classes(pages), most)
    elements = valid.where(~F.col("is_text"))
    own = F.when(F.col("base") > 0, F.least(F.lit(1.0), F.col("free") / F.col("base"))).otherwise(F.lit(0.0))
    prior = elements.groupBy(F.col("name").alias("p_name")).agg(F.avg(own).alias("prior"))
    share = (F.least("free", "base") + PRIOR * F.col("prior")) / (F.col("base") + PRIOR)
    links = F.when(F.col("free") + F.col("linked") > 0, F.col("linked") / (F.col("free") + F.col("linked"))).otherwise(F.lit(0.0))
    weighed = elements.join(prior, F.col("name") == F.col("p_name")).select("host", "token", share.cast("float").alias("share"), links.cast("float").alias("links"), F.lit(False).alias("is_text"))
    every = weighed.unionByName(valid.where("is_text").select("host", "token", F.lit(0.0).cast("float").alias("share"), F.lit(0.0).cast("float").alias("links"), "is_text"))
    pick = lambda c, text: F.collect_list(F.when(F.col("is_text") == text, F.col(c)))
    found = staged(every.groupBy("host").agg(pick("token", False).alias("keys"), pick("share", False).alias("share"), pick("links", False).alias("links"), pick("token", True).alias("texts")), "templates")
    size = found.agg(F.sum(F.size("keys") * 16 + F.size("texts") * 8 + F.length("host") + 16)).first()[0] or 0
    return found, int(size)


def extract(pages: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html, ...) -> page_id, url, text, n_chars, one row per input row.

    Null and empty html give an empty text; a null url is a host of its own; repeated pages count once
    for the classes and each get their text; pages of any length are read whole; an empty table gives an empty
    result; other columns are ignored.
    """
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found, size = templates(keyed, most)
    joined = with_template(keyed, found, size, most).select("page_id", "url", "html", "host", "keys", "share", "links", "texts")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Template] = {}
            texts = []
            for i, (raw, host) in enumerate(zip(batch.column(2), batch.column(3))):
                name = host.as_py()
                if name not in known:
                    known[name] = Template(*(batch.column(c)[i].as_py() or () for c in range(4, 8)))
                texts.append(known[name].extract(parse(raw.as_py() or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(lean(run), schema)
