"""Main texts of web pages by union-free regular expressions, inferred from the pages of each host.

A page becomes a well-formed stream of block elements and texts.  Equal neighbours in it fold into
repeated groups, so that pages of one template give few different skeletons, which Spark counts.  The
skeletons of a host are aligned one after another: elements that both have are merged, what only one
side has becomes optional, neighbours that become alike become a repeated group, texts become slots.
The result is the wrapper of the host.  Hot hosts are cut into salted parts, whose wrappers are aligned
like skeletons; rows are streamed in order, so no task holds the skeletons of a host.

Then every page is read by its host's wrapper, and Spark sums what its slots hold: pages, characters,
characters in links, and the smallest and largest hash of the texts, which are equal for text that
belongs to the template.  A slot is boilerplate if its elements say so (menus, footers, forms and so on),
if it holds links, or if it is text of the template; the rest of the region with most of the text is main.
Extraction reads every page a last time and keeps the texts of those slots.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Parts of a host whose skeletons are aligned apart, before the parts are.
SALT = 64
#: Longest repeated group, deepest element (deeper ones count as part of it), most nodes of a wrapper (the rarest
#: optional parts go first; pages keep the text of parts that no wrapper node stands for).
GROUP, DEEPEST, NODES = 6, 150, 2000
#: Bytes of wrappers up to which they are broadcast to the pages.
BROADCAST_BYTES = 16 << 20
#: Pages that show that a text belongs to the template, and the share of the host's pages that have it.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Share of link characters from which a slot is a menu; share of a region's text from which a part is the region.
LINKS, REGION = 0.5, 0.7

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
NO_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An element that opens ends those named last, up to the nearest of the second list.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
HEAD = frozenset("base link meta title style script noscript template".split())
REPEATED = frozenset("li p tr td th dt dd option h1 h2 h3 h4 h5 h6 #".split())
CONTAINERS = frozenset("div section td table tbody tr center main article dl body form fieldset".split())
OUT = frozenset("head nav footer aside form script style noscript template button select option textarea datalist svg math canvas object audio video dialog menu iframe label legend".split())
#: Words of class, id and role.
OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu
    menubar breadcrumb breadcrumbs sidebar footer contentinfo complementary search searchbox login signin signup subscribe subscription newsletter popup modal overlay share sharing
    social related recommended recommendations pagination pager toolbar widget widgets tags tagcloud skip copyright masthead""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses feedback".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)|([^>]*))>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_UNSHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _label(name: str, attributes: str) -> str:
    """The element's name with its classes, id and role; digits as 0, a hidden element ends with '!'."""
    if not attributes or attributes.isspace():
        return name
    words, unshown = set(), ""
    for m in _ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "style":
            unshown = "!" if _UNSHOWN.search(value) else unshown
        elif what == "hidden" or what == "aria-hidden":
            unshown = "!" if what == "hidden" or value.lower() == "true" else unshown
        else:
            words.update(re.sub(r"\d+", "0", w).lower() for w in html.unescape(value).split())
    return ".".join([name, *sorted(words)]) + unshown


class Page:
    """Block elements and texts of one page: a node is [label, nodes], a text is ["#", text, characters in links]."""

    def __init__(self, source: str):
        self.root: list = ["body", []]
        self.stack, self.names = [self.root], ["body"]
        self.open: Counter = Counter(["body"])
        self.text: list[str] = []
        self.linked = self.links = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.stack[-1][1].append(["#", said, min(self.linked, len(said))])
            self.text, self.linked = [], 0

    def _say(self, said: str, raw: bool = False) -> None:
        said = said if raw or "&" not in said else html.unescape(said)
        self.text.append(said)
        if self.links:
            self.linked += len(said.strip())

    def _close(self, depth: int) -> None:
        self._flush()
        self.open.subtract(self.names[depth:])
        del self.stack[depth:], self.names[depth:]
        if depth < self.links:  # a link ends with the element that holds it
            self.links = 0

    def _end(self, which: tuple, within: tuple) -> None:
        for at in range(len(self.names) - 1, 0, -1):
            if self.names[at] in within:
                return
            if self.names[at] in which:
                return self._close(at)

    def _open(self, name: str, attributes: str) -> None:
        self._flush()
        if self.open["head"] and name not in HEAD:
            self._close(self.names.index("head"))
        if name in NO_P and self.names[-1] == "p":
            self._close(len(self.names) - 1)
        if name in ENDS:
            self._end(*ENDS[name])
        if name in VOID or name in ("html", "body"):
            return
        node = [_label(name, attributes), []]
        if len(self.stack) < DEEPEST:
            self.stack[-1][1].append(node)
            self.stack.append(node)
        else:  # too deep: part of the element above
            self.stack.append(self.stack[-1])
        self.names.append(name)
        self.open[name] += 1

    def _read(self, source: str) -> None:
        at, low, last = 0, None, source.rfind(">") + 1
        while m := _TAG.search(source, at, last):
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                if m[1]:
                    self._say(m[1], raw=True)
                elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                    return
                continue
            name, attributes = name.lower(), m[4] if m[4] is not None else m[5] or ""
            if name == "br":
                self._say("\n", raw=True)
            elif name == "a":
                self.links = 0 if m[2] else len(self.stack)
            elif name in INLINE or name == "wbr" or name == "img":
                continue
            elif m[2]:
                if self.open[name] and name != "body":
                    self._close(next(k for k in range(len(self.names) - 1, 0, -1) if self.names[k] == name))
                elif name in NO_P or name == "body":
                    self._flush()
            else:
                self._open(name, attributes)
                if name in RAW:  # nothing inside is markup, nothing of it is main text
                    low = source.lower() if low is None and not source.isascii() else low or source.lower()
                    end = low.find(f"</{name}", at) if len(low) == len(source) else _find(source, f"</{name}", at)
                    at = len(source) if end < 0 else end
                    last = max(last, at)
        rest = source[at:]
        cut = re.search(r"<[A-Za-z/!?]", rest)  # a tag that never ends
        if rest:
            self._say(rest[: cut.start()] if cut else rest)


def _find(source: str, what: str, at: int) -> int:
    m = re.compile(re.escape(what), re.I).search(source, at)
    return m.start() if m else -1


# Union-free regular expressions --------------------------------------------------------------------
# An item is (label, bits, pages, items); label "#" is a text slot, "(" a group.
OPTIONAL, REPEATS = 1, 2


def _kids(item: tuple) -> frozenset:
    return frozenset(x[0] for x in item[3])


def _alike(a: tuple, b: tuple) -> bool:
    """Two elements of one label that may stand for each other."""
    if a[0] != b[0]:
        return False
    if a[0].partition(".")[0] in REPEATED:
        return True
    x, y = _kids(a), _kids(b)
    return 2 * len(x & y) >= len(x | y)


def _merge(a: tuple, b: tuple, bits: int = 0) -> tuple:
    items = a[3] if a[3] == b[3] else tuple(_align(a[3], b[3]))
    return (a[0], a[1] | b[1] | bits, max(a[2], b[2]) if bits else a[2] + b[2], items)


def _fold(items: Iterable[tuple]) -> list[tuple]:
    """Groups that follow themselves become repeated groups."""
    out: list[tuple] = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            for g in range(1, min(GROUP, len(out) - 1) + 1):
                if len(out) >= 2 * g and all(_alike(x, y) for x, y in zip(out[-g:], out[-2 * g : -g])):
                    both = [_merge(x, y, REPEATS if g == 1 else 0) for x, y in zip(out[-2 * g : -g], out[-g:])]
                    out[-2 * g :] = both if g == 1 else [("(", REPEATS, both[0][2], tuple(both))]
                    again = True
                    break
                head = out[-g - 1]
                if g > 1 and head[0] == "(" and len(head[3]) == g and all(_alike(x, y) for x, y in zip(head[3], out[-g:])):
                    out[-g - 1 :] = [("(", head[1] | REPEATS, head[2], tuple(_merge(x, y) for x, y in zip(head[3], out[-g:])))]
                    again = True
                    break
    return out


def _optional(items: Iterable[tuple]) -> list[tuple]:
    return [(x[0], x[1] | OPTIONAL, x[2], x[3]) for x in items]


def _align(a: tuple, b: tuple) -> list[tuple]:
    """One expression for both sequences: the nearest match of either side resolves a mismatch."""
    once = {x[0] for x in a if sum(y[0] == x[0] for y in a) == 1} & {x[0] for x in b if sum(y[0] == x[0] for y in b) == 1}

    def match(x: tuple, y: tuple) -> bool:
        return x[0] == y[0] and (x[0] in once or _alike(x, y))

    def group(items: tuple, at: int, of: tuple) -> bool:
        return of[0] == "(" and [x[0] for x in items[at : at + len(of[3])]] == [x[0] for x in of[3]]

    out: list[tuple] = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if match(x, y):
            out.append(_merge(x, y))
            i, j = i + 1, j + 1
        elif group(b, j, x):
            out.append((x[0], x[1], x[2] + y[2], tuple(_merge(p, q) for p, q in zip(x[3], b[j:]))))
            i, j = i + 1, j + len(x[3])
        elif group(a, i, y):
            out.append((y[0], y[1], x[2] + y[2], tuple(_merge(p, q) for p, q in zip(a[i:], y[3]))))
            i, j = i + len(y[3]), j + 1
        else:
            in_b = next((k for k in range(j + 1, len(b)) if match(x, b[k])), None)
            in_a = next((k for k in range(i + 1, len(a)) if match(a[k], y)), None)
            if in_b is not None and (in_a is None or in_b - j <= in_a - i):
                out += _optional(b[j:in_b])
                j = in_b
            elif in_a is not None:
                out += _optional(a[i:in_a])
                i = in_a
            else:
                out += _optional([x, y])
                i, j = i + 1, j + 1
    return _fold(out + _optional([*a[i:], *b[j:]]))


def _size(items: tuple) -> int:
    return sum(1 + _size(x[3]) for x in items)


def _counts(items: tuple, optional: bool = False) -> Iterator[int]:
    for x in items:
        if optional or x[1] & OPTIONAL:
            yield x[2]
        yield from _counts(x[3], optional or bool(x[1] & OPTIONAL))


def _without_rare(items: tuple, least: int, optional: bool = False) -> tuple:
    return tuple(
        (x[0], x[1], x[2], _without_rare(x[3], least, optional or bool(x[1] & OPTIONAL))) for x in items if x[2] > least or not (optional or x[1] & OPTIONAL)
    )


def skeleton(node: list) -> tuple:
    """The items of a page's element, with repeated groups folded."""
    return tuple(_fold(("#", 0, 1, ()) if x[0] == "#" else (x[0], 0, 1, skeleton(x)) for x in node[1]))


def aligned(known: tuple | None, new: tuple) -> tuple:
    """The wrapper of all that ``known`` and ``new`` stand for, bounded in size."""
    if known is None:
        return new
    out = tuple(_align(known, new)) if known != new else tuple(_merge(x, y) for x, y in zip(known, new))
    while _size(out) > NODES and (rare := list(_counts(out))):
        out = _without_rare(out, sorted(rare)[len(rare) // 4])
    return out


def _weighed(items: list, n: int) -> tuple:
    return tuple((x[0], x[1], x[2] * n, _weighed(x[3], n)) for x in items)


def dumped(items: tuple) -> str:
    return json.dumps(items, separators=(",", ":"), ensure_ascii=False)


# Reading pages by wrappers ---------------------------------------------------------------------------
class Slot:
    """A node of a wrapper: its number in preorder, its label, and its parts by label."""

    def __init__(self, label: str, items: list, numbers: Iterator[int], up: Slot | None = None):
        self.number, self.label, self.up = next(numbers), label, up
        self.parts: dict[str, list[Slot]] = {}
        self.all: list[Slot] = []
        for x in _flat(items):
            part = Slot(x[0], x[3], numbers, self)
            self.parts.setdefault(x[0], []).append(part)
            self.all.append(part)


def _flat(items: list) -> Iterator[list]:
    for x in items:
        if x[0] == "(":
            yield from _flat(x[3])
        else:
            yield x


def wrapper(told: str) -> Slot:
    return Slot("body", json.loads(told), iter(range(1 << 30)))


def read_by(node: list, slot: Slot | None, above: tuple = ()) -> Iterator[tuple[Slot | None, tuple, str, int]]:
    """(slot, labels of elements that no slot stands for, text, characters in links) of each text, in page order.

    Of several slots of one label the first alike one from the last match on is taken, else the most alike.
    Texts inside an element without a slot have the slot of the nearest element that has one.
    """
    last = -1
    for x in node[1]:
        some = slot.parts.get(x[0], []) if slot is not None and not above else []
        part = some[0] if some else None
        if len(some) > 1:
            labels = {y[0] for y in x[1]} if x[0] != "#" else set()
            likeness = [len(labels & s.parts.keys()) / max(1, len(labels | s.parts.keys())) for s in some]
            later = [k for k, s in enumerate(some) if s.number >= last and (x[0] == "#" or likeness[k] >= 0.5)]
            part = some[later[0]] if later else max(zip(likeness, [-k for k in range(len(some))], some), key=lambda z: z[:2])[2]
        if part is not None:
            last = part.number
        if x[0] == "#":
            yield (part if part is not None else slot), above if part is not None else (*above, "#"), x[1], x[2]
        elif part is not None:
            yield from read_by(x, part)
        else:
            yield from read_by(x, slot, (*above, x[0]))


def _words(label: str) -> set[str]:
    return {w for token in label.rstrip("!").split(".")[1:] for w in [token, *re.split(r"[^a-z]+", token)]}


def is_out(label: str, inside_article: bool = False) -> str:
    """Why an element of this label is no main text: 'word', 'comments' or 'element'; '' if nothing says so."""
    name, words = label.rstrip("!").partition(".")[0], _words(label)
    if words & COMMENT_WORDS:
        return "comments"
    if label.endswith("!") or name in OUT or (name == "header" and not inside_article):
        return "form" if name == "form" else "element"
    return "word" if words & OUT_WORDS or ("header" in words and not inside_article) else ""


def main_slots(root: Slot, seen: dict[int, tuple[int, int, int, bool]], pages: int) -> tuple[list[int], list[int]]:
    """(main slots, all slots that nothing speaks against); ``seen``: pages, characters, characters in links, template text.

    Classes and forms around most of the text speak against nothing, but comments do.
    """
    texts: list[Slot] = []
    mass: dict[int, int] = {}

    def gather(slot: Slot) -> int:
        own = 0
        for part in slot.all:
            if part.label == "#":
                texts.append(part)
                n, chars, linked, _ = seen.get(part.number, (0, 0, 0, False))
                own += max(0, chars - linked)
            else:
                own += gather(part)
        mass[slot.number] = own
        return own

    whole = gather(root)

    def against(slot: Slot) -> bool:
        path, inside = [], False
        up = slot.up
        while up is not None and up.up is not None:
            path.append(up)
            up = up.up
        for node in reversed(path):
            why = is_out(node.label, inside)
            if why and not (why in ("word", "form") and mass[node.number] > 0.6 * whole):
                return True
            inside = inside or node.label.partition(".")[0] in ("article", "main")
        return False

    clear = [t for t in texts if not against(t)]
    clear = [t for t in clear if not (t.number in seen and seen[t.number][2] > LINKS * seen[t.number][1])]
    fresh = [t for t in clear if not (t.number in seen and seen[t.number][3] and seen[t.number][0] >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * pages))]
    good = fresh if any(t.number in seen for t in fresh) else clear
    weight: dict[int, int] = {}
    for t in good:
        n, chars, linked, _ = seen.get(t.number, (0, 0, 0, False))
        up = t.up
        while up is not None:
            weight[up.number] = weight.get(up.number, 0) + max(0, chars - linked)
            up = up.up
    told = weight.get(root.number, 0)

    def under(slot: Slot, tops: set[int]) -> bool:
        up = slot.up
        while up is not None:
            if up.number in tops:
                return True
            up = up.up
        return False

    def named(slot: Slot) -> Iterator[Slot]:
        for part in slot.all:
            name, words = part.label.partition(".")[0], _words(part.label)
            if name in ("article", "main") or words & {"main", "articlebody"}:
                yield part
            yield from named(part)

    marked = [s for s in named(root) if weight.get(s.number, 0) > 0]
    articles = [s for s in marked if s.label.partition(".")[0] == "article"]
    tops: set[int] = set()
    for some in (articles, marked):
        chosen = {s.number for s in some}
        held = sum(weight[s.number] for s in some if not under(s, chosen))
        if held and held >= (0.5 if some is articles else 0.2) * told:
            tops = chosen
            break
    if not tops:
        at = root
        while nxt := next((p for p in at.all if p.label.partition(".")[0] in CONTAINERS and weight.get(p.number, 0) >= REGION * max(1, weight.get(at.number, 0))), None):
            at = nxt
        tops = {at.number}
    return [t.number for t in good if under(t, tops)], [t.number for t in good]


def main_text(page: Page, root: Slot | None, main: frozenset[int], good: frozenset[int]) -> str:
    """The texts of the main slots, or of all good ones where a page has none; texts without a slot go with the
    nearest element that has one, unless their own elements speak against them."""
    first, second = [], []
    holds = {}

    def within(slot: Slot, chosen: frozenset[int]) -> bool:
        key = (slot.number, chosen is main)
        if key not in holds:
            holds[key] = any(p.number in chosen for p in slot.all)
        return holds[key]

    for slot, above, text, _ in read_by(page.root, root):
        if above and any(is_out(x, True) for x in above):
            continue
        if slot is None:
            first.append(text)
        elif not above:
            if slot.number in main:
                first.append(text)
            elif slot.number in good:
                second.append(text)
        elif within(slot, main):
            first.append(text)
        elif within(slot, good):
            second.append(text)
    return " ".join(first or second)


# Spark ---------------------------------------------------------------------------------------------
def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _skeletons(pages: DataFrame) -> DataFrame:
    """(host, told, n): skeletons and how many pages of the host have them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = (host, dumped(skeleton(Page(source.as_py()).root)))
                found[key] = found.get(key, 0) + 1
                if len(found) >= 2000:
                    yield out(found)
                    found = {}
        if found:
            yield out(found)

    def out(found: dict[tuple, int]) -> pa.RecordBatch:
        hosts, told = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(told, pa.string()), pa.array(list(found.values()), pa.int64())], names=["host", "told", "n"])

    return pages.select("host", "html").mapInArrow(read, "host string, told string, n long").groupBy("host", "told").agg(F.sum("n").alias("n"))


def _one_for_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """(host, told, n): the rows of each key aligned in order, as they stream by."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, pages = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([dumped(known)], pa.string()), pa.array([pages], pa.int64())], names=["host", "told", "n"])

        for batch in batches:
            for *mine, told, n, one in zip(*(c.to_pylist() for c in batch.columns)):
                if mine != now:
                    if known is not None:
                        yield out()
                    now, known, pages = mine, None, 0
                known, pages = aligned(known, _weighed(json.loads(told), n if one else 1)), pages + n
        if known is not None:
            yield out()

    ordered = rows.repartition(*key).sortWithinPartitions(*key, *order).select(*key, "told", "n", "one")
    return ordered.mapInArrow(align, "host string, told string, n long")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, told, n): the wrapper of each host of ``pages`` (host, html), and its pages; written."""
    salted = _skeletons(pages).withColumns({"part": F.pmod(F.xxhash64("told"), F.lit(SALT)), "one": F.lit(True)})
    parts = _one_for_each(salted, ["host", "part"], [F.desc("n"), "told"]).withColumn("one", F.lit(False))
    return materialize(_one_for_each(parts, ["host"], [F.desc("n"), "told"]), "wrappers")


def _cached() -> callable:
    known: dict[str, Slot] = {}

    def get(told: str) -> Slot:
        if told not in known:
            if len(known) >= 500:
                known.clear()
            known[told] = wrapper(told)
        return known[told]

    return get


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _with(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages with the columns of their host's wrapper, which are broadcast if their bytes are few."""
    size = wrappers.agg(F.coalesce(F.sum(F.length("told") + 64), F.lit(0))).first()[0]
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host")


def slot_statistics(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, slot, pages, chars, linked, fixed): what the text slots of all pages of a host hold."""
    columns = ("host", "slot", "pages", "chars", "linked", "low", "high", "first", "last")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, found = _cached(), {}
        for batch in batches:
            for host, source, told in zip(*(c.to_pylist() for c in batch.columns)):
                mine: dict[int, list] = {}
                whole = 0
                for slot, above, text, linked in read_by(Page(source).root, get(told)):
                    h = _digest(text)
                    whole ^= h
                    if not above:
                        x = mine.setdefault(slot.number, [0, 0, h, h])
                        x[:] = x[0] + len(text), x[1] + linked, min(x[2], h), max(x[3], h)
                for number, (chars, linked, low, high) in mine.items():
                    y = found.setdefault((host, number), [0, 0, 0, low, high, whole, whole])
                    y[:] = y[0] + 1, y[1] + chars, y[2] + linked, min(y[3], low), max(y[4], high), min(y[5], whole), max(y[6], whole)
                if len(found) >= 50_000:
                    yield out(found)
                    found = {}
        if found:
            yield out(found)

    def out(found: dict) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in found.items()]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(columns))

    schema = "host string, slot int, pages long, chars long, linked long, low long, high long, first long, last long"
    parts = _with(pages.select("host", "html"), wrappers.select("host", "told")).select("host", "html", "told").mapInArrow(read, schema)
    return parts.groupBy("host", "slot").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        # one text on pages that differ in others
        ((F.min("low") == F.max("high")) & (F.min("first") != F.max("last"))).alias("fixed"),
    )


def choose_slots(wrappers: DataFrame, statistics: DataFrame) -> DataFrame:
    """(host, told, main, good): numbers of slots; a host has NODES rows of statistics at most."""
    lists = statistics.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "linked", "fixed")).alias("seen"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, told, n, seen in zip(*(c.to_pylist() for c in batch.columns)):
                got = main_slots(wrapper(told), {x["slot"]: (x["pages"], x["chars"], x["linked"], x["fixed"]) for x in seen or []}, n)
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([told]), *(pa.array([x], pa.list_(pa.int32())) for x in got)], names=["host", "told", "main", "good"])

    joined = wrappers.join(lists, "host", "left").select("host", "told", "n", "seen")
    return joined.mapInArrow(choose, "host string, told string, main array<int>, good array<int>")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of the main text of every page.

    Null and empty html gives an empty text, as do pages without any text outside menus and the like.  Null
    urls and urls without '://' share one empty host.  Repeated rows are pages each and give equal texts.
    A host's only page is read by the wrapper that its own repetitions give.  Other columns are not read.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("html"))
    full = rows.where(F.length("html") > 0)
    wrappers = infer_wrappers(full)
    chosen = materialize(choose_slots(wrappers, slot_statistics(full, wrappers)), "wrapper-slots")
    kind = rows.schema["k"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _cached()
        for batch in batches:
            texts = []
            for body, told, main, good in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                texts.append(main_text(Page(body), get(told), frozenset(main), frozenset(good)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k", "u", "text"])

    found = _with(full, chosen).select("k", "u", "html", "told", "main", "good").mapInArrow(read, f"k {kind}, u string, text string")
    empty = rows.where(F.length("html") == 0).select("k", "u", F.lit("").alias("text"))
    return found.unionAll(empty).select(F.col("k").alias(key), F.col("u").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
