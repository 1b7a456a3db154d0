"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with the tags, classes, ids and roles
above it.  Features are those ancestors and measures of the text (length, links, sentence ends, capitals,
place in the page).  The field has two labels, main text or not; it is trained by gradient ascent on the
conditional likelihood (forward-backward) of labelled pages and decoded by Viterbi.

Labelled pages.  A bounded sample (``SAMPLE`` pages of at most ``LONGEST`` characters, by hash) of the
pages that mark their one article as such gives blocks whose labels are known.  Each is used as it is, and once laid
out anew (``_laid_out``): its paragraphs under other containers and class names, among menus, headers, notices, forms,
adverts, sidebars, footers and reader comments filled with the sample's own words, so that the
field weighs names and texts and does not lean on one tag alone.

Results.  One row per page.  Null or empty html, and pages without main text, give an empty string.
Broken markup is read as far as it goes: unclosed elements end with their parents, an unclosed comment, script or
style runs to the end of the page, an unclosed picture or frame to the next block.  A tag whose quotes don't close
ends at its first ">".  The time is in proportion to the page, however deep or broken.  Formulas, buttons and
objects give their text.  Nothing is dropped from a main block or capped.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import prepare, streamed

SAMPLE, LONGEST, DIM, ROUNDS = 250, 60_000, 1 << 13, 120

# HTML element classes (fixed by the language)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of LITERAL hold no tags either.
SKIPPED = frozenset("script style noscript template title textarea select svg iframe canvas".split())
LITERAL = frozenset("script style title textarea".split())
#: Unclosed, these end where a block opens; the other skipped elements end with their parents.
NO_BLOCKS = frozenset("title textarea select svg iframe".split())
#: An opening tag ends the open elements named, if one is the innermost block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that labels are read from.
LANDMARKS = frozenset("article nav aside form footer".split())

_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"""=\s*(["'])|>""")
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class Path:
    """An element and those above it, which it shares with its neighbours; ``fresh`` are the features they don't have."""
    __slots__ = ("above", "tag", "depth", "fresh", "within")

    def __init__(self, above: "Path | None", tag: str, fresh: tuple[str, ...]):
        self.above, self.tag, self.fresh = above, tag, fresh
        self.depth = above.depth + 1 if above else 0
        self.within = (above.within if above else frozenset()) | (LANDMARKS & {tag})

    def features(self) -> list[str]:
        return [f"depth {min(self.depth, 8)}", *[f"own {self.tag}"] * (self.depth > 0)]


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> str:
    """Words of the class, id and role of a tag."""
    if not attributes or not attributes.strip():
        return ""
    out = []
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("hidden", "aria-hidden"):
            out.append("hidden" if value != "false" else "")
        elif key in ("class", "id", "role", "itemprop"):
            out.extend(_WORD.findall(value))
    return " ".join(sorted(set(filter(None, out))))


class Tags:
    """Tags of a page from the left, each place read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.endless: set[int] = set()                                    # quotes from which no end of a tag is reached
        self.missing: set[str] = set()                                    # elements without a closing tag from here on

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", tag, attributes) of the next tag; comments and declarations have no tag."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = start + 4
                for short in (">", "->"):
                    if page.startswith(short, end):
                        return start, end + len(short), "", "", ""
                end = page.find("-->", end)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if start > self.last:
                # no tag ends any more; a comment may still begin
                at = start + 1
                continue
            m = _OPEN.match(page, start + 1)
            if m:
                end = self._end(m.end())
                return start, end, m[1], m[2].lower(), page[m.end(): end - 1]
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, "", "", ""
            at = start + 1

    def _end(self, at: int) -> int:
        """Behind the ">" that ends a tag; if its quotes don't close, behind the first one."""
        first, passed = at, []
        while True:
            m = _QUOTE.search(self.page, at)
            if m and m[0] == ">":
                return m.end()
            close = self.page.find(m[1], m.end()) if m and m.start() not in self.endless else -1
            if close < 0:
                self.endless.update(passed)
                if m:
                    self.endless.add(m.start())
                return self.page.find(">", first) + 1
            passed.append(m.start())
            at = close + 1

    def closing(self, tag: str, at: int) -> int:
        """Where the closing tag begins, or -1."""
        if tag in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        if m:
            return m.start()
        self.missing.add(tag)
        return -1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page, in page order."""
    out: list[Block] = []
    top = Path(None, "", ())
    stack: list[tuple[str, Path, int]] = []                               # (tag, path, place of the innermost block)
    places: dict[str, list[int]] = {}                                     # of the open elements, by tag
    known: set[str] = set()                                               # features of the open elements
    skipped: list[str] = []                                               # open elements from a skipped one on
    within: Counter[str] = Counter()                                      # the same, by tag
    parts: list[str] = []
    linked = 0

    def path() -> Path:
        return stack[-1][1] if stack else top

    def innermost() -> int:
        return stack[-1][2] if stack else -1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path(), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def push(tag: str, names: str) -> None:
        above = path()
        if tag in BLOCKS or names:
            fresh = tuple(f for f in [f"in {tag}", *(f"named {n}" for n in names.split())] if f not in known)
            known.update(fresh)
            above = Path(above, tag, fresh)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, above, len(stack) if tag in BLOCKS else innermost()))

    def pop_from(place: int) -> None:
        while len(stack) > place:
            tag, own, _ = stack.pop()
            places[tag].pop()
            if own is not path():
                known.difference_update(own.fresh)

    def opened(tag: str) -> int:
        """Place of the element that a closing tag ends, or -1: no inline tag ends a block."""
        found = places.get(tag)
        return found[-1] if found and (tag in BLOCKS or found[-1] > innermost()) else -1

    page = page or ""
    tags = Tags(page)
    at, end = 0, len(page)
    while at < end:
        found = tags.next(at)
        raw = page[at: found[0] if found else end]
        if raw and not skipped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if places.get("a"):
                linked += len(text)
        if not found:
            break
        _, at, closes, tag, attributes = found
        if not tag:
            continue
        if skipped and closes and within[tag]:
            while True:
                last = skipped.pop()
                within[last] -= 1
                if last == tag:
                    break
            continue
        if skipped and (opened(tag) >= 0 if closes else tag in BLOCKS and tag not in ("option", "optgroup") and skipped[0] in NO_BLOCKS and not within["foreignobject"]):
            skipped.clear()
            within.clear()
        if not closes:
            alone = attributes.rstrip().endswith("/")
            if tag in LITERAL and not alone:
                close = tags.closing(tag, at)
                if close >= 0 or tag in ("script", "style"):
                    at = (page.find(">", close) + 1 if close >= 0 else 0) or end
                    continue
            if tag in VOID:
                if skipped:
                    continue
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if skipped or tag in SKIPPED:
                if not alone:
                    skipped.append(tag)
                    within[tag] += 1
                continue
            if tag in BLOCKS:
                flush()
                # a block ends an open paragraph, and an item the item before it
                k = innermost()
                if k >= 0 and (stack[k][0] == "p" or stack[k][0] in ENDS.get(tag, ())):
                    pop_from(k)
            elif alone:
                continue
            push(tag, _names(attributes))
        elif not skipped:
            k = opened(tag)
            if k >= 0:
                if innermost() >= k:
                    flush()
                pop_from(k)
    flush()
    return out


@lru_cache(1 << 16)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIM


def path_features(path: Path) -> list[int]:
    found = path.features()
    while path:
        found.extend(path.fresh)
        path = path.above
    return [_hash(f) for f in found]


def text_features(b: Block, place: float) -> list[int]:
    t, n = b.text, len(b.text)
    words = t.count(" ") + 1
    return [_hash(f) for f in (
        "bias", f"chars {min(n.bit_length(), 12)}", f"words {min(words.bit_length(), 8)}", f"linked {b.linked * 4 // max(n, 1)}",
        f"end {t[-1] in '.!?:;\"”»'}", f"stops {min(t.count('. ') + t.count('? ') + t.count('! '), 4)}", f"commas {min(t.count(','), 4)}",
        f"sign {any(c in t for c in '©·»«•')}", f"place {int(place * 4)}")]


class Field:
    """Weights of features by label, and of transitions; label 1 is main text."""

    def __init__(self, weight: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.weight, self.step, self.start = weight, step, start
        self.each = weight.tolist()

    def _add(self, total: tuple[float, float], features) -> tuple[float, float]:
        x, y = total
        for f in features:
            u, v = self.each[_hash(f)]
            x, y = x + u, y + v
        return x, y

    def scores(self, bs: list[Block]) -> np.ndarray:
        out = np.empty((len(bs), 2))
        known: dict[Path | None, tuple[float, float]] = {None: (0.0, 0.0)}
        for i, b in enumerate(bs):
            ahead, p = [], b.path
            while p not in known:
                ahead.append(p)
                p = p.above
            for q in reversed(ahead):
                known[q] = self._add(known[q.above], q.fresh)
            out[i] = self._add(known[b.path], b.path.features()) + self.weight[text_features(b, i / len(bs))].sum(axis=0)
        return out

    def decode(self, bs: list[Block]) -> list[int]:
        """Most likely labels (Viterbi)."""
        if not bs:
            return []
        s = self.scores(bs).tolist()
        (a, b), (c, d) = self.step.tolist()
        x, y = s[0][0] + self.start[0], s[0][1] + self.start[1]
        back = []
        for u, v in s[1:]:
            back.append((x + a < y + c, x + b < y + d))
            x, y = max(x + a, y + c) + u, max(x + b, y + d) + v
        label = int(y > x)
        out = [label]
        for from_ in reversed(back):
            label = int(from_[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        bs = blocks(page)
        return "\n".join(b.text for b, y in zip(bs, self.decode(bs)) if y)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, ridge: float = 1e-4, rate: float = 0.2) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps; forward-backward over all pages at once."""
    pages = [(b, y) for b, y in pages if b]
    weight, step, start = np.zeros((DIM, 2)), np.zeros((2, 2)), np.zeros(2)
    if not pages:
        return Field(weight, step, start)
    feats, owner, row = [], [], 0
    longest = max(len(b) for b, _ in pages)
    mask, gold = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest), int)
    for k, (bs, ys) in enumerate(pages):
        for i, b in enumerate(bs):
            f = path_features(b.path) + text_features(b, i / len(bs))
            feats.extend(f)
            owner.extend([row] * len(f))
            row += 1
        mask[k, : len(bs)], gold[k, : len(bs)] = True, ys
    feats, owner = np.array(feats), np.array(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    truth = np.zeros((len(pages), longest, 2))
    truth[..., 1], truth[..., 0] = gold * mask, (1 - gold) * mask
    total = [np.full(w.shape, 1e-6) for w in (weight, step, start)]
    for _ in range(rounds):
        s = np.zeros((len(pages), longest, 2))
        s[mask] = np.add.reduceat(weight[feats], first, axis=0)
        f, g = np.empty_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0] + start
        for t in range(1, longest):
            f[:, t] = np.where(mask[:, t, None], np.logaddexp(f[:, t - 1, :1] + step[0], f[:, t - 1, 1:] + step[1]) + s[:, t], f[:, t - 1])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = s[:, t + 1] + g[:, t + 1]
            live = mask[:, t + 1]
            joint = f[:, t, :, None] + step[None] + ahead[:, None, :] - z[:, None, None]
            expected = np.exp(np.where(live[:, None, None], joint, -np.inf))
            pairs += (truth[live, t, :, None] * truth[live, t + 1, None, :]).sum(axis=0) - expected.sum(axis=0)
            g[:, t] = np.where(live[:, None], np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:]), 0.0)
        miss = (truth - np.exp(f + g - z[:, None, None]) * mask[..., None])
        grad = np.zeros_like(weight)
        np.add.at(grad, feats, miss[mask][owner])
        for w, d, acc in zip((weight, step, start), (grad, pairs, miss[:, 0].sum(axis=0)), total):
            d = d / len(pages) - ridge * w
            acc += d * d
            w += rate * d / np.sqrt(acc)
    return Field(weight, step, start)


# names that pages give to the parts of their layout, for pages laid out anew
MAIN = "content main post entry article-body story text page-content post-content entry-content body-text maintext".split()
PARTS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs site-menu".split(),
    "header": "header masthead site-header topbar banner logo branding".split(),
    "footer": "footer site-footer colophon copyright bottom legal".split(),
    "aside": "sidebar widget related recommended popular side rail trending".split(),
    "div": "ad ads advert advertisement sponsor sponsored promo promotion notice cookie-notice consent alert popup modal newsletter subscribe share social tags".split(),
    "section": "comments comment reader-comments responses discussion comment-list reply".split(),
    "form": "form search login signup contact subscribe-form".split(),
}


def _laid_out(title: str, body: list[str], other: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page made of these texts, and its labels; main blocks are marked while it is read."""
    esc = lambda t: entities.escape(t, quote=False)
    mark = ""
    words = " ".join(other).split() or ["more"]
    some = lambda a, b: esc(" ".join(rng.choice(words) for _ in range(rng.randint(a, b))))
    para = lambda: esc(rng.choice(body)) if rng.random() < 0.5 and body else some(8, 40)

    def part(kind: str, inside: bool = False) -> str:
        name = rng.choice(PARTS[kind])
        tag = kind if rng.random() < 0.6 else "div"
        attr = f' {rng.choice(["class", "id"])}="{name}"' if tag == "div" or rng.random() < 0.6 else ""
        if kind in ("nav", "aside") and rng.random() < 0.7:
            text = "<ul>" + "".join(f'<li><a href="/x">{some(1, 5)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
            if kind == "aside":
                text = f"<h3>{some(1, 4)}</h3>" + text + (f"<p>{some(5, 25)}</p>" if rng.random() < 0.5 else "")
        elif kind == "section":
            text = f"<h3>{some(1, 3)}</h3>" + "".join(f'<div class="comment"><span>{some(1, 2)}</span><p>{para()}</p></div>' for _ in range(rng.randint(1, 4)))
        elif kind == "form":
            text = f'<label>{some(1, 4)}</label><input name="q"><p>{some(3, 12)}</p>'
        elif kind == "footer":
            text = rng.choice([f"&copy; {some(2, 8)} &middot; {some(3, 12)}", f"<p>{some(4, 16)}</p>", f"<p>&copy; {some(2, 6)}</p><ul><li><a href='/y'>{some(1, 3)}</a></li></ul>"])
        elif kind == "header":
            text = f"<div>{some(1, 4)}</div><p>{some(3, 9)}</p>"
        else:
            text = rng.choice([some(3, 20), f"<p>{some(5, 30)}</p>", f"<h4>{some(1, 4)}</h4><p>{para()}</p>"])
        return f"<{tag}{attr}>{text}</{tag}>"

    lines = [f"<h1>{mark}{esc(title)}</h1>"] if title else []
    for k, t in enumerate(body):
        kind = rng.choice(["p", "p", "p", "p", "p", "h2", "blockquote", "li"]) if k else "p"
        lines.append(f"<ul><li>{mark}{esc(t)}</li></ul>" if kind == "li" else f"<{kind}>{mark}{esc(t)}</{kind}>")
        if rng.random() < 0.06:
            lines.append(part(rng.choice(["div", "aside", "form"]), True))
    main, name = rng.choice(["article", "main", "div", "section", "td", "article", "div"]), rng.choice(MAIN)
    attr = f' {rng.choice(["class", "id"])}="{name}"' if main in ("div", "section") or rng.random() < 0.4 else ""
    text = f"<{main}{attr}>{''.join(lines)}</{main}>"
    if main == "td":
        text = f"<table><tr>{'<td>' + part('aside') + '</td>' if rng.random() < 0.5 else ''}{text}</tr></table>"
    before = [part(k) for k in ("header", "nav", "div") if rng.random() < 0.7]
    after = [part(k) for k in ("div", "section", "aside", "form", "footer") if rng.random() < 0.6]
    rng.shuffle(before)
    bs = blocks(f"<html><body>{''.join(before)}{text}{''.join(after)}</body></html>")
    ys = [int(b.text.startswith(mark)) for b in bs]
    for b in bs:
        b.text = b.text.removeprefix(mark)
    return bs, ys


def labelled(pages: list[str], layouts: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages that mark one article, as they are and laid out anew."""
    out = []
    for page in pages:
        bs = blocks(page)
        ys = [int(b.path.within == {"article"}) for b in bs]
        if not any(ys) or len(re.findall(r"<article\b", page, re.I)) != 1:
            continue
        out.append((bs, ys))
        main = [b for b, y in zip(bs, ys) if y]
        title = main[0].text if main[0].path.tag in ("h1", "h2") else ""
        for k in range(layouts):
            rng = random.Random(zlib.crc32(page.encode("utf-8", "surrogatepass")) + k)
            out.append(_laid_out(title, [b.text for b in main[bool(title):]], [b.text for b, y in zip(bs, ys) if not y], rng))
    return out


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """The field, from at most ``sample`` pages that mark an article; of none, all blocks are equal and nothing is main."""
    own = pages.where(F.col(html_col).rlike("(?i)<article[ >]") & (F.length(html_col) <= longest)).select(F.xxhash64(html_col).alias("k"), F.col(html_col).alias("h"))
    # the tasks send hashes; pages are fetched by the last hash of the sample, each text once
    last = own.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    some = own.where(F.col("k") <= F.lit(last)).groupBy("k").agg(F.min("h").alias("h")).orderBy("k")
    return fit(labelled([r.h for r in some.collect()]))                    # at most sample * longest characters


@streamed
def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    field = Field(*model.value)
    for batch in batches:
        texts = [field.extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; ``field`` defaults to one trained on ``pages``."""
    prepare(pages.sparkSession)
    field = field or train(pages)
    model = pages.sparkSession.sparkContext.broadcast((field.weight, field.step, field.start))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(partial(_extract, model=model), "page_id long, url string, text string, n_chars long")
