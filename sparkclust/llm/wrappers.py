"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of tags and texts. The pages of a host are aligned one after
another with the host's wrapper, a union-free regular expression over that stream: every
element has an ordered content model in which each kind of child (tag with class and id) stands
once. What an alignment finds different is resolved without alternatives:
* a child that some page lacks becomes optional,
* a child that comes again becomes a repeated group, with all that stands between its places,
* children that come in another order than before become one repeated group with all between them,
* a text that differs between pages becomes a slot; one that never does is a template text.
Because a kind of child stands once, the longest common subsequence of a model and the children of an
element follows from a lookup for each child, and wrappers of parts of a host merge the same way. Each task folds the pages it reads into one wrapper per host, so a host
of any size costs a few kilobytes per task, merged in two steps.

The wrapper then rules what to extract from every page of the host:
* the article element, if the page has one; or the main element, unless it is known by name only, has no slots
  and holds less text than the slots elsewhere; or else the lowest element around all slots that hold text outside links.
* Outside such a region, menus, headers, footers, sidebars, notices, adverts and comments are known by element, role,
  class and id. Inside it no name drops a text, but for comments and adverts named as nothing else: a box named like one of the
  others (a *suspect*), or a header in a main element, goes only where the wrapper shows a template, the same text
  on all pages that have it, two at least. Forms, menus and the like go by their element anywhere.
* In a main element and in a region around slots, boxes of template texts (the same on at least two different pages and on more
  than half of them) that stand before the first or after the last slot in the ordered model go; in a region around
  slots, boxes of links, too. Texts in a box with a slot, headings and paragraphs stay.
Copies of a page count once, so a host of identical pages has no slots between pages and keeps its text.

A host may name elements anew on every page (``post-some-title``). A wrapper of more than ``MAX_NODES`` paths folds the names
that one page alone has into ``tag.*``, so its size is bounded by the names that pages share.

Blocks are the texts between block-level tags. Character references are decoded, white space
inside a block becomes one space, blocks are joined by one line feed.

Defined results
* null or empty html: empty text. Null or odd urls: such pages form one host with an empty name.
* broken markup (unclosed or stray tags, cut pages) is read like browsers do, to its end; very long pages whole.
* repeated rows and copies of a page get equal texts; an empty table gives an empty result.
* no article found on a page: all its blocks outside the dropped elements and links.
* extra columns are kept by ``extract``; the new column is ``text``.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .encoding import text_slices

# Elements of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul caption iframe noscript template".split()
)
CONTAINER = set("article aside blockquote body dd details dialog div dl fieldset figure footer form header html li main nav ol section table td th ul".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg".split())
DROPPED = set("head nav footer aside form script style noscript template iframe svg button select textarea option label dialog menu canvas object audio video fieldset input xmp noembed noframes".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Parts of class and id names that mark what is no article text.
DROPPED_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar ad ads advert adverts advertisement "
    "advertisements adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended comment comments disqus reply replies respond pagination pager widget "
    "toolbar search form copyright disclaimer skip".split()
)
ARTICLE_NAMES = set("article articlebody post entry story content main body text".split())
#: Names that are comments or adverts wherever they stand, if no other words but the last set are in them.
COMMENT_NAMES = set("comment comments disqus reply replies respond".split())
ADVERT_NAMES = set("ad ads advert adverts advertisement advertisements adbox adsense sponsored promo sidebar newsletter cookie cookies consent gdpr".split())
FILLING_NAMES = set("reader readers user list section area box block thread item wrapper container slot banner unit zone widget notice signup form".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
NORMAL, DROP, MAIN, ARTICLE, SUSPECT = range(5)
#: Paths of a wrapper beyond which names of single pages are folded.
MAX_NODES = 1000
#: Different pages on which a text has to be the same to be a template.
TEMPLATE_PAGES = 2


def kind_of(tag: str, attrs: str) -> tuple[str, int]:
    """The name of an element in content models, and what it is."""
    a = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(attrs)} if attrs else {}
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    name = ".".join([tag, *sorted({re.sub(r"\d+", "9", n).replace("/", "|") for n in names})])
    role = a.get("role", "").lower()
    if tag in DROPPED or role in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return name, DROP
    parts = [p for p in ({p.lower() for p in _PART.findall(n)} for n in names) if p]
    named = tag not in ("html", "body", "main")
    sure = COMMENT_NAMES | ADVERT_NAMES
    if named and any(p & sure and p <= sure | FILLING_NAMES for p in parts):
        return name, DROP
    if tag == "article" or a.get("itemprop", "").lower() == "articlebody":
        return name, ARTICLE
    # a name such as content-with-sidebar belongs to the content
    if named and any(p & DROPPED_NAMES and not (p & {"with", "has", "no", "without"}) for p in parts):
        return name, SUSPECT
    if tag == "main" or role == "main" or (named and any(p <= ARTICLE_NAMES for p in parts)):
        return name, MAIN
    return name, NORMAL


class Pages:
    """Reads pages; paths of block elements are numbered, the numbers shared by all pages."""

    def __init__(self):
        self.kinds: dict[tuple[str, str], tuple[str, int]] = {}
        self.numbers: dict[tuple[int, str], int] = {}
        self.paths: list[str] = [""]

    def _path(self, parent: int, name: str) -> int:
        got = self.numbers.get((parent, name))
        if got is None:
            got = self.numbers[parent, name] = len(self.paths)
            self.paths.append(f"{self.paths[parent]}/{name}")
        return got

    def blocks(self, page: str) -> tuple[list[tuple], list[int]]:
        """Blocks (path number, text, characters in links, dropped, level, suspect) and the paths of elements met.

        ``level`` is the strongest of NORMAL, MAIN and ARTICLE around the block; what a name makes suspect is dropped outside
        article and main, and a header is dropped outside them and suspect in main.
        """
        blocks: list[tuple] = []
        opened: list[int] = []
        stack: list[tuple] = []  # tag, path, dropped, level, link, suspect
        path, dropped, level, link, suspect = 0, False, NORMAL, False, False
        parts: list[str] = []
        in_links = 0
        at, end = 0, len(page)

        def flush():
            nonlocal in_links
            if parts:
                text = " ".join(_html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    blocks.append((path, text, in_links, dropped, level, suspect))
                in_links = 0

        def pop_to(k: int):
            nonlocal path, dropped, level, link, suspect
            if any(s[0] in BLOCK for s in stack[k:]):
                flush()
            del stack[k:]
            _, path, dropped, level, link, suspect = stack[-1] if stack else ("", 0, False, NORMAL, False, False)

        def find(tag: str, stop) -> int:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    return k
                if stack[k][0] in stop:
                    return -1
            return -1

        while at < end:
            m = _TAG.search(page, at)
            text_end = m.start() if m else end
            if text_end > at:
                piece = page[at:text_end]
                parts.append(piece)
                if link:
                    in_links += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                k = find(tag, CONTAINER if tag not in CONTAINER else ())
                if k >= 0:
                    pop_to(k)
                elif tag in BLOCK:
                    flush()
                continue
            if tag == "br" or tag == "wbr":
                parts.append(" " if tag == "br" else "")
                continue
            block = tag in BLOCK
            if block:
                k = find("p", CONTAINER)
                if k >= 0:
                    pop_to(k)
                if tag in _CLOSES_SAME:
                    for same in ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,):
                        k = find(same, _CLOSES_SAME[tag])
                        if k >= 0:
                            pop_to(k)
                elif tag == "body":
                    k = find("head", ())
                    if k >= 0:
                        pop_to(k)
                flush()
            elif tag == "option":
                k = find("option", ("select",))
                if k >= 0:
                    pop_to(k)
            kind = self.kinds.get((tag, attrs))
            if kind is None:
                if len(self.kinds) > 100_000:  # a memory of what attributes mean; emptied, never refused
                    self.kinds.clear()
                kind = self.kinds[tag, attrs] = kind_of(tag, attrs)
            if block:
                path_now = self._path(path, kind[0])
                opened.append(path_now)
            if tag in VOID or (attrs.endswith("/") and not block):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            doubtful = kind[1] == SUSPECT or (tag == "header" and level != ARTICLE)
            gone = dropped or kind[1] == DROP or (doubtful and level == NORMAL)
            inner = max(level, kind[1]) if kind[1] in (MAIN, ARTICLE) else level
            stack.append((tag, path_now if block else path, gone, inner, link or tag == "a", suspect or doubtful))
            _, path, dropped, level, link, suspect = stack[-1]
        flush()
        return blocks, opened


def page_groups(children: list[str]) -> list[list]:
    """The children of one element as ordered groups [names, repeated]: what lies between two places of a name is one group."""
    last = {name: k for k, name in enumerate(children)}
    groups, k = [], 0
    while k < len(children):
        end, at = last[children[k]], k
        while at < end:
            at += 1
            end = max(end, last[children[at]])
        groups.append([list(dict.fromkeys(children[k : end + 1])), end > k])
        k = end + 1
    return groups


def merge_groups(model: list[list], groups: list[list]) -> list[list]:
    """Align ``groups`` with an ordered content model; each name stands in one group of either.

    Names in both in the same order match, new ones go between their neighbours, and names in another order
    make one repeated group of all from the first to the last of them.
    """
    place = {name: k for k, (names, _) in enumerate(model) for name in names}
    new: dict[int, list] = {}  # groups that come after a group of the model
    joined = list(range(len(model)))  # the last group that is one with this
    extra: dict[int, list] = {}
    repeated = [r for _, r in model]
    at = -1
    for names, again in groups:
        hit = [place[n] for n in names if n in place]
        if not hit:
            new.setdefault(at, []).append([list(names), again])
            continue
        low, high = min(hit), max(hit)
        if low <= at:  # another order, or the same group again behind new names
            high = max(high, at)
            for more, _ in new.pop(high, []):
                extra.setdefault(low, []).extend(more)
                again = True
        fresh = [n for n in names if n not in place]
        extra.setdefault(low, []).extend(fresh)
        joined[low] = max(joined[low], high)
        repeated[low] |= bool(again or low < high)
        at = max(at, high)
    out, k = [list(g) for g in new.get(-1, [])], 0
    while k < len(model):
        end, names, again, j = joined[k], [], False, k
        while j <= end:
            end = max(end, joined[j])
            names += [*model[j][0], *extra.get(j, [])]
            again |= repeated[j]
            if j < end:
                names += [n for g, _ in new.get(j, []) for n in g]
            j += 1
        out += [[names, again or end > k], *new.get(end, [])]
        k = end + 1
    return out


def folded(path: str, known: set[str]) -> str:
    """``path`` with names that aren't ``known`` (but for plain tags) as ``tag.*``."""
    return "/".join(n if "." not in n or n in known else n.partition(".")[0] + ".*" for n in path.split("/"))


class Wrapper:
    """Content models of a host: path -> [pages with it, repeated, pages with text, text or slot, characters, link characters, level, dropped, texts of a page or slot, suspect].

    ``order`` has the ordered content model of every path: groups [names of children, repeated].
    """

    def __init__(self, pages: int = 0, nodes: dict | None = None, order: dict | None = None, known: list[str] | None = None):
        self.pages, self.nodes, self.order = pages, nodes or {}, order or {}
        self.known = known  # once folded: the names that stay as they are
        self.seen: set[tuple] = set()  # child sequences that are aligned already

    def align(self, blocks: list[tuple], opened: list[int], paths: list[str]):
        """Resolve one page against the wrapper."""
        self.pages += 1
        if self.known is not None:
            names = set(self.known)
            paths = {p: folded(paths[p], names) for p in {*opened, *(b[0] for b in blocks)}}
        times: dict[int, int] = {}
        for p in opened:
            times[p] = times.get(p, 0) + 1
        for p, n in times.items():
            node = self.nodes.setdefault(paths[p], [0, 0, 0, None, 0, 0, NORMAL, 0, None, 0])
            node[0] += 1
            if n > 1:
                node[1] = 1
        self._align_children([paths[p] for p in opened])
        texts: dict[int, list] = {}
        for p, text, links, dropped, level, suspect in blocks:
            raw = text.encode("utf-8", "replace")
            crc = zlib.crc32(raw)
            t = texts.setdefault(p, [crc, 0, 0, level, dropped, 0, suspect])
            if t[0] != crc:
                t[0] = -1
            t[1] += len(text)
            t[2] += links
            t[5] = zlib.crc32(raw + b"\n", t[5])
        for p, (crc, chars, links, level, dropped, whole, suspect) in texts.items():
            node = self.nodes.setdefault(paths[p], [self.pages, 0, 0, None, 0, 0, NORMAL, 0, None, 0])
            node[3] = crc if not node[2] or node[3] == crc else -1
            node[8] = whole if not node[2] or node[8] == whole else -1
            node[2] += 1
            node[4] += chars
            node[5] += links
            node[6], node[7], node[9] = level, int(dropped), int(suspect)
        if self.known is None and len(self.nodes) > MAX_NODES:
            self.fold()

    def _align_children(self, opened: list[str]):
        """Align the ordered children of each element of a page; ``opened`` has their paths in page order."""
        children: dict[str, list[str]] = {}
        ended = []
        for path in opened:
            box, _, name = path.rpartition("/")
            children.setdefault(box, []).append(name)
            if path in children:  # another element of this path begins
                ended.append((path, children.pop(path)))
        for path, names in [*ended, *children.items()]:
            if (path, *names) not in self.seen:
                if len(self.seen) >= 1000:  # a memory of what would change nothing
                    self.seen.clear()
                self.seen.add((path, *names))
                self.order[path] = merge_groups(self.order.get(path, []), page_groups(names))

    def merge(self, other: "Wrapper"):
        if self.known is not None or other.known is not None:  # both speak of folded names from here on
            shared = sorted({*(self.known or self._shared()), *(other.known or other._shared())})
            self._rename(shared)
            other._rename(shared)
        self.pages += other.pages
        for path, groups in other.order.items():
            self.order[path] = merge_groups(self.order.get(path, []), groups)
        for path, o in other.nodes.items():
            self._add_node(path, o)
        if self.known is None and len(self.nodes) > MAX_NODES:
            self.fold()

    def _add_node(self, path: str, o: list):
        node = self.nodes.get(path)
        if node is None:
            self.nodes[path] = list(o)
            return
        if o[2]:
            node[3] = o[3] if not node[2] or node[3] == o[3] else -1
            node[8] = o[8] if not node[2] or node[8] == o[8] else -1
            node[6], node[7], node[9] = o[6], o[7], o[9]
        node[0] += o[0]
        node[1] |= o[1]
        node[2] += o[2]
        node[4] += o[4]
        node[5] += o[5]

    def _shared(self) -> set[str]:
        """Names of elements that more than one page has, under whatever path (a page with a name under two paths counts twice)."""
        pages: dict[str, int] = {}
        for path, n in self.nodes.items():
            name = path.rpartition("/")[2]
            pages[name] = pages.get(name, 0) + n[0]
        return {name for name, k in pages.items() if k > 1}

    def fold(self):
        """Fold the names that a single page has into ``tag.*``; what is left is bounded by the names that pages share."""
        self._rename(sorted(self._shared()))

    def _rename(self, known: list[str]):
        names = set(known)
        nodes, order = self.nodes, self.order
        self.known, self.nodes, self.order = known, {}, {}
        self.seen.clear()
        for path, n in nodes.items():
            self._add_node(folded(path, names), n)
        for path, groups in order.items():
            to = folded(path, names)
            # children that now share a name are one repeated group with all between them
            flat = [(folded("/" + c, names)[1:], again) for g, again in groups for c in g]
            twice = page_groups([c for c, _ in flat])
            again = {c for c, r in flat if r}
            self.order[to] = merge_groups(self.order.get(to, []), [[g, r or bool(again & set(g))] for g, r in twice])

    def regex(self) -> str:
        """The wrapper as a union-free regular expression over tags, ``#text`` slots and template texts."""
        children: dict[str, list[str]] = {}
        for path in self.nodes:
            children.setdefault(path.rpartition("/")[0], []).append(path)

        def show(path: str, around: int) -> str:
            n = self.nodes[path]
            name = path.rpartition("/")[2]
            inner = ("#text " if n[3] == -1 else "#same " if n[2] else "") + "".join(show(c, n[0]) for c in children.get(path, []))
            group = f"<{name}> {inner}</{name}> "
            if n[1] or n[0] < around:
                return f"({group}){'+' if n[1] and n[0] >= around else '*' if n[1] else '?'} "
            return group

        return "".join(show(c, self.pages) for c in children.get("", [])).strip()

    def expression(self) -> str:
        """Like ``regex``, with children in aligned order: what has no fixed order is one repeated group of optionals."""

        def show(path: str, around: int, single: bool = True, again: bool = False) -> str:
            n = self.nodes[path]
            name = path.rpartition("/")[2]
            inner = "#text " if n[3] == -1 else "#same " if n[2] else ""
            for names, repeated in self.order.get(path, []):
                parts = "".join(show(f"{path}/{c}", n[0], len(names) == 1, repeated) for c in names)
                inner += parts if len(names) == 1 else f"( {parts})* "
            group = f"<{name}> {inner}</{name}> "
            if not single:
                return f"({group})? "
            if again or n[0] < around:
                return f"({group}){'+' if again and n[0] >= around else '*' if again else '?'} "
            return group

        return "".join(show(f"/{c}", self.pages, len(names) == 1, repeated) for names, repeated in self.order.get("", []) for c in names).strip()

    def _region(self, story: list[str]) -> tuple[str, set[str], dict[str, int], list[int]]:
        """The lowest element around the slots in ``story``, its children that hold them, and where its children and those stand."""
        boxes = [p.split("/")[:-1] for p in story]
        depth = next((k for k, names in enumerate(zip(*boxes)) if len(set(names)) > 1), min(map(len, boxes)))
        region = "/".join(boxes[0][:depth])
        around = {"/".join(p.split("/")[: depth + 1]) for p in story}
        place = {f"{region}/{name}": k for k, (names, _) in enumerate(self.order.get(region, [])) for name in names}
        return region, around, place, [place[b] for b in around if b in place]

    def _beside(self, region, around, place, slots, nodes: dict, links_too: bool) -> list[str]:
        """Paths in ``region`` to skip: boxes of template texts before its first or after its last slot (and of links)."""
        skip = []
        for p, n in nodes.items():
            if not (p + "/").startswith(region + "/") or p == region:
                continue
            box = "/".join(p.split("/")[: region.count("/") + 2])
            links = links_too and 2 * n[5] >= n[4]
            same = n[8] != -1 and n[2] >= TEMPLATE_PAGES and 2 * n[2] > self.pages
            boxed = p != box or re.match("[^.]*", box.rpartition("/")[2])[0] in CONTAINER
            outside = not slots or not min(slots) <= place.get(box, -1) <= max(slots)
            if box not in around and (links or (same and boxed and outside)):
                skip.append(p)
        return skip

    def rules(self) -> dict:
        """What is picked from the host's pages: the kind of region, the region around the slots, paths to skip there and suspects to skip."""
        kept = {p: n for p, n in self.nodes.items() if n[2] and not n[7]}
        story = [p for p, n in kept.items() if n[3] == -1 and n[4] > 2 * n[5]]
        # slots that differ between pages count before those that differ only inside a page
        story = [p for p in story if kept[p][8] == -1] or story
        level = max((n[6] for n in kept.values()), default=NORMAL)
        if level == MAIN and not any(n[6] == MAIN and n[8] == -1 for n in kept.values()):
            # named as the main part, but the same on all pages: the slots decide if they hold more
            if sum(kept[p][4] for p in story if kept[p][8] == -1) > sum(n[4] for n in kept.values() if n[6] == MAIN):
                level = NORMAL
        region, skip = None, []
        # pages of a host may differ: what a main element loses is ruled even if some pages have an article
        main = {p: n for p, n in kept.items() if n[6] == MAIN}
        told = [p for p in story if p in main and kept[p][8] == -1]
        if level != NORMAL and told:
            skip = self._beside(*self._region(told), main, False)
        elif level == NORMAL and story:
            where = self._region(story)
            region, skip = where[0], self._beside(*where, kept, True)
        template = [p for p, n in kept.items() if n[9] and n[6] != NORMAL and n[8] != -1 and n[2] >= TEMPLATE_PAGES]
        out = {"skip": skip, "level": level, "region": region, "template": template}
        return out if self.known is None else out | {"known": self.known}


def page_text(blocks: list[tuple], paths: list[str], rules: dict) -> str:
    if "known" in rules:
        names = set(rules["known"])
        paths = {n: folded(paths[n], names) for n in {b[0] for b in blocks}}
    live = [b for b in blocks if not b[3]]
    skip, template = set(rules.get("skip", ())), set(rules.get("template", ()))
    top = max((b[4] for b in live), default=NORMAL)
    if top > NORMAL and (top == ARTICLE or rules.get("level") != NORMAL):
        picked = [b[1] for b in live if b[4] >= top and not (b[5] and paths[b[0]] in template) and not (top == MAIN and paths[b[0]] in skip)]
    else:
        region = rules.get("region")
        picked = [b[1] for b in live if region is not None and (paths[b[0]] + "/").startswith(region + "/") and paths[b[0]] not in skip]
        if not picked:
            picked = [b[1] for b in live if 2 * b[2] <= len(b[1])]
    return "\n".join(picked)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Wrappers held by a task before it hands them on for merging.
MAX_HOSTS = 2000


#: Up to this many pages with copies are marked by a broadcast of their hashes; more by a shuffle join.
MAX_BROADCAST_COPIES = 500_000


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) with one row of each set of copies; only pages that have copies are shuffled."""
    key = F.xxhash64("host", "html")
    twice = materialize(pages.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "page-copies")
    n = twice.count()
    if not n:
        return pages
    if n <= MAX_BROADCAST_COPIES:
        twice = F.broadcast(twice)
    keyed = pages.withColumn("key", key)
    on = F.col("key") == F.col("_key")
    once = keyed.join(twice, on, "left_semi").dropDuplicates(["key"])
    return keyed.join(twice, on, "left_anti").union(once).select("host", "html")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, rules as JSON) for every host of ``pages``."""

    def fold(frames):
        import pyarrow as pa

        reader, hosts = Pages(), {}

        def batch():
            w = [json.dumps([x.pages, x.nodes, x.order, x.known]) for x in hosts.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array(w, pa.string())], ["host", "wrapper"])

        for f in text_slices(frames, "html"):
            for host, page in zip(f.column("host").to_pylist(), f.column("html").to_pylist()):
                hosts.setdefault(host, Wrapper()).align(*reader.blocks(page or ""), reader.paths)
                if len(hosts) > MAX_HOSTS or len(reader.paths) > 500_000:
                    yield batch()
                    reader, hosts = Pages(), {}
        yield batch()

    parts = distinct_pages(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))).mapInArrow(fold, "host string, wrapper string")

    def merge(keyed, frame):
        import pandas as pd

        whole = Wrapper()
        for w in frame["wrapper"]:
            whole.merge(Wrapper(*json.loads(w)))
        return pd.DataFrame([(keyed[0], json.dumps([whole.pages, whole.nodes, whole.order, whole.known]), json.dumps(whole.rules()))], columns=["host", "wrapper", "rules"])

    # first within (host, 32 parts), then within the host
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    some = salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string, rules string")
    return some.groupBy("host").applyInPandas(merge, "host string, wrapper string, rules string")


#: Up to this many bytes of rules of all hosts are broadcast; more are joined by a shuffle, the pages of a host in SALTS parts.
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 16


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each in a last column ``text`` (in place of a column of that name)."""
    rules = materialize(infer_wrappers(pages, url_col, html_col).select(F.col("host").alias("_host"), "rules"), "page-rules")
    size = rules.agg(F.sum(F.length("_host") + F.length("rules"))).first()[0] or 0
    keep = [c for c in pages.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in keep if c != html_col]).alias("row")
    packed = pages.select(row, F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= MAX_BROADCAST_BYTES:
        joined = packed.join(F.broadcast(rules), F.col("host") == F.col("_host"), "left")
    else:
        salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = packed.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    joined = joined.select("row", "html", "rules")

    def run(frames):
        import pyarrow as pa

        reader, known = Pages(), {}
        for f in text_slices(frames, "html"):
            out = []
            for page, rule in zip(f.column("html").to_pylist(), f.column("rules").to_pylist()):
                if len(reader.paths) > 500_000:
                    reader = Pages()
                if rule not in known:
                    known = known if len(known) < MAX_HOSTS else {}
                    known[rule] = json.loads(rule or "{}")
                blocks, _ = reader.blocks(page or "")
                out.append(page_text(blocks, reader.paths, known[rule]))
            yield pa.RecordBatch.from_arrays([f.column("row"), f.column("html"), pa.array(out, pa.string())], ["row", "html", "text"])

    done = joined.mapInArrow(run, joined.select("row", "html").schema.add("text", "string"))
    return done.select(*[F.col("html").alias(c) if c == html_col else F.col("row")[c].alias(c) for c in keep], "text")


def op5_wrappers(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
