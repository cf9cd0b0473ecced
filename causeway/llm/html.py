"""Main text of web pages by wrappers inferred from pages of the same host.

A page is a stream of tokens: opening and closing block elements (tag and class) and texts. For a host, the streams of its
pages are aligned into one union-free regular expression. Opening tokens that all pages have stay, elements that repeat, and
runs of several elements that repeat, become repeated groups, what some pages lack becomes optional, and every text is a slot.
As opening and closing tokens pair, alignment goes level by level: the elements and texts inside two
elements that meet are aligned with each other. It goes pairwise over distinct streams, of which a task sees
about `ALIGNED` at most: where a host has more, shares of them are aligned first, then what the shares gave, and so on. So a
host with a third of all pages is worked on by many tasks.

Each page is then matched with its host's expression, which gives the slot of each of its texts. What pages have in a slot tells
what it is: a slot is open if its text differs, or if one page alone has it, copies (pages with the same text outside menus and
the like) being one; else it is constant. A page's main text is that of the slots

* under article and main elements, open or constant, on pages that have such slots;
* else of the slots that are mostly not links: the open ones, and the constant ones that stand in one element with them,
  or in lists, tables and quotations of that element. These elements are what the page has for an article; body and html are none.

Elements that are menus, headers and footers of the page, sidebars, notices, adverts, forms, comments, scripts and styles are no
part of the stream; class and id tell sidebars, notices and so on, but not of article and main elements, nor of what holds a page's
only ones. Inside an article, sections called related, shared and the like stay unless they are mostly links or hold articles of
their own. A page gives its main texts, in page order, a line each. What pages have in a slot is compared by 64 bits of BLAKE2b
of the whole text, which for a repeated slot is that of all repeats.

Defined cases: null or empty html gives an empty text; a url without a host belongs to the host "";
a page whose host has one page only is its own wrapper; unclosed and wrongly nested elements close with
what contains them; elements more than `DEPTH` deep count as parts of the one above, but menus, forms and the like among them are left out; very long
pages are parsed whole; a <br> is white space; of several ways to match a wrapper the leftmost counts; rows that repeat a page
are kept; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import html as html_
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from causeway.llm import text as T
from causeway.storage import stored

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object"}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select button label".split()
)
#: Elements that a new block of the named kinds ends.
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ENDS |= {f"h{i}": {f"h{j}" for j in range(1, 7)} | {"p"} for i in range(1, 7)}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside form head menu dialog button select label fieldset".split())
_MAIN = frozenset(("article", "main"))
_PARTS = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|cookies?|consent|notices?|gdpr|comments?|disqus|respond|replies|nav\w*|menu|breadcrumbs?|footer|header|masthead|social|share|sharing|related|recommend\w*|newsletter|subscribe|signup|popup|modal|widget|toolbar|login|search"
_MARKED = re.compile(rf"(?:^|[\s_-])(?:{_PARTS})(?:$|[\s_-])", re.I)
#: Classes that say how an element or what is in it looks, and those that hold a page's content: neither makes it a menu, notice and so on.
_STATE = re.compile(r"(?:has|no|not|with|without|is|show|hide)[_-].*|.*[_-](?:open|opened|closed|fixed|sticky|enabled|disabled|on|off|active|visible|hidden)", re.I)
_CONTENT = re.compile(r"(?:.*[_-])?(?:content|article|post|entry|story|page|layout|wrapper|container)", re.I)
_HEADS = re.compile(r"(?:.*[_-])?(?:header|masthead|banner)(?:[_-].*)?", re.I)
#: Classes that count inside an article only where the element is mostly links or holds an article.
_WEAK = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|share|sharing|social|promo\w*|widget|toolbar|search|login)(?:$|[\s_-])", re.I)
#: Elements whose texts stand in what is around them.
_INNER = frozenset("ul ol li dl dt dd table tbody thead tfoot tr td th blockquote figure figcaption details summary pre caption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: Longest repeated group, distinct streams that one task aligns at a time, and elements inside each other that an expression tells apart: what is deeper
#: stands in the last of them, text by text, but for what is never main text, which is left out at any depth.
REPEATS, ALIGNED, DEPTH = 4, 512, 150


def _space(text: str) -> str:
    return " ".join(text.split())


def _marks(names: list[str], inside: bool) -> list[str]:
    """The classes and id of an element that make it a menu, notice and so on; inside an article its header is none."""
    words = [x for x in names if _MARKED.search(x) and not _STATE.fullmatch(x) and not (inside and _HEADS.fullmatch(x))]
    return [] if any(_CONTENT.fullmatch(x) and not _MARKED.search(x) for x in names) else words


class Element:
    """A block element with what is in it: elements, and texts with how many of their characters are in links."""

    __slots__ = ("label", "tag", "bad", "good", "mark", "weak", "holds", "inside")

    def __init__(self, label: str, tag: str, bad: bool = False, good: bool = False, mark: bool = False, weak: bool = False) -> None:
        self.label, self.tag, self.bad, self.good, self.mark, self.weak = label, tag, bad, good, mark, weak
        self.holds, self.inside = False, []

    def texts(self) -> Iterator[tuple[str, int]]:
        for x in self.inside:
            if isinstance(x, Element):
                yield from x.texts()
            else:
                yield x


def parsed(html: str) -> Element:
    """The block elements and texts of a page, without those that are never main text."""
    root = Element("", "")
    stack: list[tuple[str, Element | None]] = [("", root)]  # links have no element of their own
    open_: list[Element] = [root]
    pieces, linked, links, mains = [], 0, 0, 0
    plain = False  # an article or main element stands outside all that classes mark

    def flush() -> None:
        nonlocal pieces, linked
        if pieces and (text := _space(html_.unescape("".join(pieces)))):
            open_[-1].inside.append((text, min(linked, len(text))))
        pieces, linked = [], 0

    def close(n: int) -> None:
        nonlocal links, mains
        flush()
        for _, e in stack[n:]:
            if e is None:
                links -= 1
            else:
                mains -= e.good
                open_.pop()
        del stack[n:]

    at, lower = 0, None
    while at < len(html):
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            pieces.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag not in _BLOCK and tag != "a":
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), None)
            if depth is None:
                continue
            if tag == "a":
                stack.pop(depth)
                links -= 1
            else:
                close(depth)
        elif tag in _RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{tag}", at)
            end = len(html) if end < 0 else end
            at = html.find(">", end) + 1 if html.find(">", end) >= 0 else len(html)
        elif tag == "br" or tag in _VOID and tag != "hr":
            pieces.append(" ")
        elif tag == "a":
            stack.append(("a", None))
            links += 1
        elif tag in _BLOCK:
            flush()
            last = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] is not None), None)
            while last is not None and tag in _ENDS.get(stack[last][0], ()):
                close(last)
                last = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] is not None), None)
            if tag == "hr" or m[3].endswith("/"):
                continue
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
            inside = mains > 0
            bad = tag in _NEVER or attributes.get("role", "").lower() in _ROLES or (tag == "header" and not inside)
            good = not bad and (tag in _MAIN or attributes.get("role", "").lower() == "main")
            marks = _marks(names, inside) if names and not bad and not good and tag not in ("body", "html") else []
            label = tag + ("." + re.sub(r"\d+", "0", attributes["class"].split()[0]) if attributes.get("class", "").split() else "")
            e = Element(label, tag, bad, good, bool(marks), inside and all(_WEAK.search(x) for x in marks))
            if good:
                for x in open_:
                    x.holds = True
                if not inside and not any(x.bad for x in open_):
                    plain = plain or not any(x.mark for x in open_)
            if len(open_) < DEPTH:
                open_[-1].inside.append(e)
                open_.append(e)
            else:
                around = open_[DEPTH - 1]
                if open_[-1] is around and (bad or marks):
                    around.inside.append(e)
                    open_.append(e)
                else:
                    open_.append(open_[-1])
            stack.append((tag, e))
            mains += good
    close(1)
    _prune(root, plain)
    return root


def _prune(e: Element, plain: bool) -> int:
    """Drops what is never main text, and elements without text; the number of texts that are left."""
    n, kept = 0, []
    for x in e.inside:
        if isinstance(x, Element):
            if x.bad or (x.mark and not x.weak and not (x.holds and not plain)):
                continue
            own = _prune(x, plain)
            if not own or (x.mark and x.weak and (x.holds or sum(k for _, k in x.texts()) * 2 > sum(len(t) for t, _ in x.texts()))):
                continue
            n += own
        else:
            n += 1
        kept.append(x)
    e.inside = kept
    return n


# A page's item is (label, uses): "#" and its texts, or an element and, for each repeat, the items in it; "(a b)" is a run of several items that
# repeats, with the items of each repeat. An expression is a list of [kind, label, expression of what is inside]; kind is "" (once), "?" (optional),
# "+" or "*" (repeated). A star before a label marks article and main elements.

Items = list[tuple[str, list]]
Expression = list[list]


def fold(inside: list) -> Items:
    """What is in an element, with its immediate repeats of up to REPEATS items as groups; elements that share less than half of
    the kinds of things in them are no repeats of each other."""
    out: Items = []
    before: set[str] = set()  # kinds of things in the last item
    for x in inside:
        label, use = (("*" if x.good else "") + x.label, fold(x.inside)) if isinstance(x, Element) else ("#", x)
        kinds = {own for own, _ in use} if label != "#" else set()
        if out and out[-1][0] == label and 2 * len(kinds & before) >= len(kinds | before):
            out[-1][1].append(use)
            before |= kinds
        else:
            out.append((label, [use]))
            before = kinds
    for size in range(2, REPEATS + 1):
        labels, done, i = [x[0] for x in out], [], 0
        while i < len(out):
            unit, n = labels[i : i + size], 1
            while len(unit) == size and labels[i + n * size : i + (n + 1) * size] == unit:
                n += 1
            if n > 1 and len(set(unit)) > 1:
                done.append((f"({' '.join(unit)})", [out[i + k * size : i + (k + 1) * size] for k in range(n)]))
                i += n * size
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def shape(items: Items) -> Expression:
    """The expression of some items alone."""
    return [["+" if len(uses) > 1 else "", label, [] if label == "#" else reduce(align, map(shape, uses))] for label, uses in items]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common part, the first way.

    row[i] has a bit for each place j of b, counted from its end: 0 where the longest common part of a[i:] and b[j:] is one longer than that of
    b[j + 1:]. A row follows from the one below by a few operations on whole rows, so long lists cost a bit for each pair.
    """
    n, places, row = len(b), {}, [(1 << len(b)) - 1]
    full = row[0]
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << (n - 1 - j)
    for x in reversed(a):
        under = row[-1]
        same = under & places.get(x, 0)
        row.append(((under + same) | (under - same)) & full)
    row.reverse()
    found, i, j = [], 0, 0
    while i < len(a) and j < n:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
            continue
        rest = (1 << (n - j)) - 1
        if (row[i] & rest).bit_count() == (row[i + 1] & rest).bit_count():  # as much without a[i]
            i += 1
        else:
            j += 1
    return found


def align(a: Expression, b: Expression) -> Expression:
    """The expression that covers both: common items in order, with what is inside them aligned, the rest optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*_common([e[1] for e in a], [e[1] for e in b]), (len(a), len(b))]:
        out += [[{"": "?", "+": "*"}.get(kind, kind), label, inside] for kind, label, inside in (*a[i:x], *b[j:y])]
        if x < len(a):
            kinds = a[x][0] + b[y][0]
            many, some = any(k in kinds for k in "+*"), any(k in kinds for k in "?*")
            out.append(["*" if many and some else "+" if many else "?" if some else "", a[x][1], align(a[x][2], b[y][2])])
        i, j = x + 1, y + 1
    return out


def match(found: list[tuple[str, bool]], expression: Expression) -> list[int]:
    """The place in the expression of each of some (label, repeats), the leftmost way; the expression covers them."""
    ends, way, dead, i, j = (len(found), len(expression)), [], set(), 0, 0
    while (i, j) != ends:
        fits = i < ends[0] and j < ends[1] and found[i][0] == expression[j][1] and (not found[i][1] or expression[j][0] in ("+", "*"))
        if fits and (i + 1, j + 1) not in dead:
            way.append((i, j))
            i, j = i + 1, j + 1
        elif j < ends[1] and expression[j][0] in ("?", "*") and (i, j + 1) not in dead:
            way.append((i, j))
            j += 1
        elif way:
            dead.add((i, j))
            i, j = way.pop()
        else:
            raise ValueError("the expression does not cover the page")
    return [j for (i, j), (after, _) in zip(way, [*way[1:], ends], strict=False) if after > i]


class Wrapper:
    """An expression, with its slots (its texts, numbered through), the elements that they are in, and which hold main text."""

    def __init__(self, expression: str, main: list[int] | None = None) -> None:
        self.expression: Expression = json.loads(expression)
        self.main = frozenset(main or ())
        self.starred: list[bool] = []
        self.around: list[list[int]] = []  # of each slot its element and what that stands in, up to what is no list or table
        self.first: dict[int, int] = {}  # id of an expression -> the number of its first slot
        self._count(self.expression, [(-1, "html")], False)

    def _count(self, expression: Expression, over: list[tuple[int, str]], starred: bool) -> None:
        self.first[id(expression)] = len(self.starred)
        for item in expression:
            _, label, inside = item
            if label == "#":
                self.starred.append(starred)
                own, chain = len(over) - 1, []
                while own >= 0:
                    chain.append(over[own][0])
                    if len(chain) > 1 and over[own][1] not in _INNER:
                        break
                    own -= 1
                self.around.append([x for x in chain if x >= 0])
            else:
                tag = label.lstrip("*").split(".")[0]
                number = -1 if tag in ("html", "body") else id(item)
                self._count(inside, over if label.startswith("(") else [*over, (number, tag)], starred or label.startswith("*"))

    def texts(self, items: Items) -> list[tuple[int, str, int]]:
        """(slot, text, characters in links) of a page's texts, in page order."""
        out: list[tuple[int, str, int]] = []
        self._texts(items, self.expression, out)
        return out

    def _texts(self, items: Items, expression: Expression, out: list) -> None:
        at, slot, j = match([(label, len(uses) > 1) for label, uses in items], expression), self.first[id(expression)], 0
        for (label, uses), to in zip(items, at, strict=True):
            while j < to:
                slot += 1 if expression[j][1] == "#" else _slots_in(expression[j][2])
                j += 1
            for use in uses:
                if label == "#":
                    out.append((slot, *use))
                else:
                    self._texts(use, expression[to][2], out)

    def slots(self, stream: str) -> list[int]:
        """The slot of each text of a stream's expression."""
        out: list[int] = []

        def walk(own: Expression, expression: Expression) -> None:
            at, slot, j = match([(label, kind in ("+", "*")) for kind, label, _ in own], expression), self.first[id(expression)], 0
            for (_, label, inside), to in zip(own, at, strict=True):
                while j < to:
                    slot += 1 if expression[j][1] == "#" else _slots_in(expression[j][2])
                    j += 1
                if label == "#":
                    out.append(slot)
                else:
                    walk(inside, expression[to][2])

        walk(json.loads(stream), self.expression)
        return out

    def chosen(self, seen: dict[int, tuple[bool, int, int]]) -> list[int]:
        """The slots of main text; seen: of each slot whether it is open, its characters and those in links."""
        content = [s for s, (is_open, chars, linked) in seen.items() if not self.starred[s] and is_open and linked * 2 <= chars]
        articles = {e for s in content for e in (self.around[s][0:1] + self.around[s][-1:])}
        near = [s for s, (is_open, chars, linked) in seen.items() if not self.starred[s] and not is_open and linked * 2 <= chars and articles.intersection(self.around[s])]
        return sorted({*content, *near, *(s for s in seen if self.starred[s])})

    def text(self, page: str) -> str:
        found = self.texts(fold(parsed(page).inside))
        starred = any(self.starred[slot] for slot, _, _ in found)
        return "\n".join(text for slot, text, _ in found if slot in self.main and self.starred[slot] == starred)


def _slots_in(expression: Expression) -> int:
    return sum(1 if label == "#" else _slots_in(inside) for _, label, inside in expression)


def _key(*texts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(texts).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _slot_texts(items: Items, stream: Expression) -> list[list[tuple[str, int]]]:
    """A page's texts in each slot of its own expression."""
    wrapper = Wrapper(json.dumps(stream))
    out: list[list[tuple[str, int]]] = [[] for _ in wrapper.starred]
    for slot, text, linked in wrapper.texts(items):
        out[slot].append((text, linked))
    return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            items = fold(parsed(page or "").inside)
            stream = shape(items)
            own = _slot_texts(items, stream)
            content = _key(*(t for x in own for t, _ in x))
            rows.append({"host": host, "stream": json.dumps(stream), "content": content, "own": [{"text": _key(*(t for t, _ in x)), "chars": sum(len(t) for t, _ in x), "linked": sum(n for _, n in x)} for x in own]})
        yield pa.RecordBatch.from_pylist(rows, schema=_STREAM)


_STREAM = pa.schema([("host", pa.string()), ("stream", pa.string()), ("content", pa.int64()), ("own", pa.list_(pa.struct([("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])))])
_STREAM_SQL = "host string, stream string, content bigint, own array<struct<text: bigint, chars: bigint, linked: bigint>>"


class _Wrappers(dict):
    """What a task has met lately, by key."""

    def of(self, key, make):
        if key not in self:
            if len(self) > 1000:
                self.clear()
            self[key] = make()
        return self[key]


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages (host, stream, content, own, expression) of a batch have in each slot of their host's expression that can be main text of theirs."""
    met, places = _Wrappers(), _Wrappers()
    for batch in T.slices(batches):
        counts: dict[tuple[str, int], list] = {}
        for host, stream, content, own, expression in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wrapper = met.of(host, lambda: Wrapper(expression))  # noqa: B023
            at = places.of((host, stream), lambda: wrapper.slots(stream))  # noqa: B023
            starred = any(wrapper.starred[slot] for slot in at)
            for slot, x in zip(at, own, strict=True):
                if wrapper.starred[slot] != starred:
                    continue
                c = counts.setdefault((host, slot), [0, 0, content, content, x["text"], x["text"]])
                c[:] = c[0] + x["chars"], c[1] + x["linked"], min(c[2], content), max(c[3], content), min(c[4], x["text"]), max(c[5], x["text"])
        columns = [[h for h, _ in counts], [s for _, s in counts], *([c[i] for c in counts.values()] for i in range(6))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)


_COUNTS = pa.schema([("host", pa.string()), ("slot", pa.int32()), *((c, pa.int64()) for c in ("chars", "linked", "first", "last", "low", "high"))])


def _main_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, expression, main) of (host, expression, seen)."""
    for batch in batches:
        main = []
        for expression, seen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            main.append(Wrapper(expression).chosen({x["slot"]: (x["open"], x["chars"], x["linked"]) for x in seen or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.list_(pa.int32()))], names=["host", "expression", "main"])


def _aligned(streams: list[str]) -> str:
    return json.dumps(reduce(align, map(json.loads, sorted(set(streams)))))


def _merge(column_in: str, columns_out: tuple[str, ...]):
    def rows(key, table):
        merged = _aligned(table.column(column_in).to_pylist())
        return pa.Table.from_pylist([dict(zip(columns_out, (key[0].as_py(), merged), strict=True))], schema=pa.schema([(c, pa.string()) for c in columns_out]))

    return rows


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, main) of pages (url, html): the expression as JSON, and its slots of main text."""
    read = stored(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_streams, _STREAM_SQL))
    level = stored(read.select("host", "stream").distinct())
    while level.groupBy("host").count().filter(F.col("count") > ALIGNED).limit(1).count():
        shares = level.groupBy("host").agg(F.ceil(F.count("*") / (ALIGNED // 2)).alias("shares"))
        dealt = level.join(shares, "host").withColumn("share", F.pmod(F.xxhash64("stream"), "shares"))
        level = stored(dealt.groupBy("host", "share").applyInArrow(_merge("stream", ("host", "stream")), "host string, stream string").distinct())
    whole = stored(level.groupBy("host").applyInArrow(_merge("stream", ("host", "expression")), "host string, expression string"))
    matched = read.join(whole, "host").select("host", "stream", "content", "own", "expression").mapInArrow(_slot_counts, "host string, slot int, chars long, linked long, first long, last long, low long, high long")
    counts = matched.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))
    is_open = (F.col("first") == F.col("last")) | (F.col("low") != F.col("high"))
    seen = counts.groupBy("host").agg(F.collect_list(F.struct("slot", is_open.alias("open"), "chars", "linked")).alias("seen"))
    return whole.join(seen, "host", "left").select("host", "expression", "seen").mapInArrow(_main_slots, "host string, expression string, main array<int>")


def _main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = _Wrappers()
    for batch in T.slices(batches):
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
        texts = [met.of(host, lambda: Wrapper(expression, main)).text(page or "") for page, host, expression, main in rows]  # noqa: B023
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html, ...)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = stored(wrappers(pages))
    matched = pages.withColumn("host", host_of(F.col("url"))).join(found, "host", "left")
    return matched.select("page_id", "url", "html", "host", "expression", "main").mapInArrow(_main_text, _RESULT)


_RESULT = Ty.StructType([Ty.StructField("page_id", Ty.LongType()), Ty.StructField("url", Ty.StringType()), Ty.StructField("text", Ty.StringType()), Ty.StructField("n_chars", Ty.LongType())])
