"""Arrow helper: an HTML text to a flat list of blocks.

Nesting needs a reader, so this is the one step outside the JVM. It only finds the
blocks and their inline text; what a block looks like in Markdown is decided by
Column expressions in ``markdown``.

A page becomes parallel arrays of events (start, end, text); ``close`` holds the end of every
start, so that an element is a range of events and leaving one out is a jump. No tree is built and
nothing recurses. Which reader takes an element is looked up by its tag.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
#: Start tags that end an open element: the elements they end, and those they cannot reach through.
IMPLIED = {
    "p": (frozenset(["p"]), frozenset()),
    "td": (frozenset(["td", "th"]), frozenset(["table"])), "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
START, END, TEXT = range(3)
#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 64


def slices(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """A batch, few rows after few; an empty one gives one empty slice."""
    for i in range(0, max(len(columns[0]), 1), SLICE_ROWS):
        yield [c.slice(i, SLICE_ROWS) for c in columns]


def in_slices(read: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``read`` over a batch, few rows after few: a batch holds some ten thousand rows, and as Python objects many times its bytes."""
    return pa.concat_arrays([read(*part) for part in slices(*columns)])


@dataclass(frozen=True)
class Profile:
    """What a site's pages skip and which elements they know."""

    skip_tags: frozenset
    skip_classes: frozenset
    removed_tags: frozenset = frozenset()
    removed_classes: frozenset = frozenset()
    removed_class_parts: tuple = ()
    removed_ids: frozenset = frozenset()
    roots: tuple = ()  # (kind, value), see ``_is_root``; () takes the whole text
    root_min_text: int = 0
    body_removed_tags: frozenset = frozenset()  # also removed where only the body is left as root
    class_match: str = "exact"
    inline_data_images: bool = True
    nested_lists: bool = False
    definition_lists: bool = False
    code_prefixes: tuple = ("language-",)


# One token: comment, declaration, end tag, or start tag with its attributes. Possessive
# repeats keep a broken tag from being tried again and again.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"""
    r"""<([a-zA-Z][^\s/>]*)((?:[\s/]*+[^\s/>=<]++(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*))?+)*+)[\s/=]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""([^\s/>=<]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]*)))?+""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style")}


class Events:
    """Start, end and text events of a page; every start has its end."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.name: list[str] = []  # tag of a start or end, text of a text
        self.attrs: list[dict | None] = []
        self.close: list[int] = []

    def __len__(self) -> int:
        return len(self.kind)

    def add(self, kind: int, name: str, attrs: dict | None = None) -> int:
        self.kind.append(kind)
        self.name.append(name)
        self.attrs.append(attrs)
        self.close.append(-1)
        return len(self.kind) - 1

    def classes(self, at: int) -> list[str]:
        return self.attrs[at].get("class", "").split()

    def starts(self, at: int, end: int):
        """Starts of elements inside a range, in document order."""
        return (i for i in range(at, end) if self.kind[i] == START)

    def first(self, at: int, end: int, *tags: str) -> int | None:
        return next((i for i in self.starts(at, end) if self.name[i] in tags), None)

    def strings(self, at: int, end: int) -> list[str]:
        return [self.name[i] for i in range(at, end) if self.kind[i] == TEXT]

    def text(self, at: int, end: int) -> str:
        return "".join(self.strings(at, end))

    def tight(self, at: int, end: int) -> str:
        return "".join(s.strip() for s in self.strings(at, end))

    def parts(self, at: int, end: int):
        """Direct parts of a range: texts, and elements by their starts."""
        while at < end:
            yield at
            at = self.close[at] + 1 if self.kind[at] == START else at + 1

    def without(self, gone) -> Events:
        """The same events without the elements that ``gone`` names."""
        kept, at, open_at = Events(), 0, []
        while at < len(self):
            if self.kind[at] == START and gone(at):
                at = self.close[at] + 1
                continue
            new = kept.add(self.kind[at], self.name[at], self.attrs[at])
            if self.kind[at] == START:
                open_at.append(new)
            elif self.kind[at] == END:
                kept.close[open_at.pop()] = new
            at += 1
        return kept


def read_events(html: str) -> Events:
    """Events of a text: an end tag closes up to its start; some starts close open elements (``IMPLIED``).

    Comments, declarations and the content of scripts, styles and templates give no text.
    """
    events, position, silent = Events(), 0, 0
    stack: list[int] = []

    def leave(depth: int) -> None:
        nonlocal silent
        while len(stack) > depth:
            at = stack.pop()
            silent -= events.name[at] in SILENT
            events.close[at] = events.add(END, events.name[at])

    def close(tags: frozenset, walls: frozenset = frozenset()) -> None:
        """End the outermost open element of the tags that no wall hides, or the innermost one if there is no wall."""
        found = None
        for depth in range(len(stack) - 1, -1, -1):
            name = events.name[stack[depth]]
            if name in walls:
                break
            if name in tags:
                found = depth
                if not walls:
                    break
        if found is not None:
            leave(found)

    def add_text(text: str) -> None:
        if text and not silent:
            events.add(TEXT, unescape(text) if "&" in text else text)

    while match := _TOKEN.search(html, position):
        add_text(html[position:match.start()])
        position = match.end()
        if match[1]:
            close(frozenset([match[1].lower()]))
        elif match[2]:
            tag = match[2].lower()
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            found = _ATTRIBUTE.finditer(match[3]) if match[3] else ()
            at = events.add(START, tag, {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in found})
            stack.append(at)
            silent += tag in SILENT
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, position)
                position = end.start() if end else len(html)
            if tag in _RAW_END or tag in VOID or match[0].endswith("/>"):
                leave(len(stack) - 1)
    add_text(html[position:])
    leave(0)
    return events


def _removed(events: Events, profile: Profile):
    def gone(at: int) -> bool:
        attrs = events.attrs[at]
        if events.name[at] in profile.removed_tags or attrs.get("id") in profile.removed_ids:
            return True
        names = [c.lower() for c in events.classes(at)] if "class" in attrs else ()
        return any(c in profile.removed_classes or any(p in c for p in profile.removed_class_parts) for c in names)

    return gone


def _is_root(events: Events, at: int, kind: str, value) -> bool:
    """``tag``, ``id`` and ``role`` are equal to the value; ``class`` holds it; ``div`` is a div whose
    classes hold one of several values; ``any`` is an element whose classes do."""
    attrs = events.attrs[at]
    if kind == "tag":
        return events.name[at] == value
    if kind in ("id", "role"):
        return attrs.get(kind) == value
    if "class" not in attrs or kind == "div" and events.name[at] != "div":
        return False
    values = (value,) if kind == "class" else value
    return any(v in c.lower() for c in events.classes(at) for v in values)


def root_of(events: Events, profile: Profile) -> tuple[int, int, bool] | None:
    """Range of the first root by the profile's order with enough text, else of the body; and whether it is the body."""
    for kind, value in profile.roots:
        at = next((i for i in events.starts(0, len(events)) if _is_root(events, i, kind, value)), None)
        if at is not None and len(events.tight(at, events.close[at])) >= profile.root_min_text:
            return at, events.close[at] + 1, False
    body = events.first(0, len(events), "body")
    return None if body is None else (body + 1, events.close[body], True)


class Blocks:
    """Columns ``kind, level, text, extra, rows`` of the blocks of many documents."""

    def __init__(self) -> None:
        self.columns: tuple[list, ...] = ([], [], [], [], [])
        self.readers = {
            **{f"h{n}": self.heading for n in range(1, 7)}, "p": self.paragraph, "blockquote": self.quote, "ul": self.listing,
            "ol": self.listing, "pre": self.code, "img": self.picture, "figure": self.figure, "table": self.table,
            "hr": self.rule, "dl": self.definitions,
        }

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, kind, text="", level=0, extra="", rows=None):
        for column, value in zip(self.columns, (kind, level, text, extra, rows)):
            column.append(value)

    def read(self, html: str, profile: Profile) -> None:
        """Append the blocks of one document."""
        self.profile = profile
        self.events = events = read_events(html)
        if profile.removed_tags or profile.removed_classes or profile.removed_ids or profile.removed_class_parts:
            self.events = events = events.without(_removed(events, profile))
        found = root_of(events, profile) if profile.roots else (0, len(events), False)
        if found is None:
            return
        at, end, body = found
        gone = profile.body_removed_tags if body else ()
        while at < end:
            kind, name = events.kind[at], events.name[at]
            if kind == TEXT:
                if name.strip():
                    self.add("line", name.strip())
            elif kind == START:
                stop = events.close[at]
                reader = self.readers.get(name)
                if name in gone or self.skipped(at) or reader is not None and reader(at, stop):
                    at = stop
            at += 1

    def skipped(self, at: int) -> bool:
        profile = self.profile
        if self.events.name[at] in profile.skip_tags:
            return True
        if "class" not in self.events.attrs[at]:
            return False
        names = [c.lower() for c in self.events.classes(at)]
        if profile.class_match == "substring":
            return any(c in " ".join(names) for c in profile.skip_classes)
        return not profile.skip_classes.isdisjoint(names)

    def source(self, at: int) -> str:
        """Usable source of an image."""
        src = self.events.attrs[at].get("src", "")
        return src if self.profile.inline_data_images or not src.startswith("data:") else ""

    def inline(self, at: int, end: int, lists: bool = True) -> str:
        """Inline markup of a range; without ``lists`` the lists inside it are left out."""
        events, out = self.events, []
        for i in events.parts(at, end):
            name, stop = events.name[i], events.close[i]
            if events.kind[i] == TEXT:
                out.append(name)
            elif name in MARKS:
                inner = events.text(i, stop).strip()
                out.append(inner and MARKS[name] + inner + MARKS[name])
            elif name == "a":
                label, href = events.tight(i, stop), events.attrs[i].get("href")
                out.append(f"[{label}]({href})" if label and href else label)
            elif name == "img":
                src = self.source(i)
                out.append(src and f"![{events.attrs[i].get('alt', '')}]({src})")
            elif name == "br":
                out.append("\n")
            elif lists or name not in ("ul", "ol"):
                out.append(events.text(i, stop))
        return "".join(out)

    # Readers: append the blocks of an element, and say whether it is done with.

    def heading(self, at: int, stop: int) -> bool:
        self.add("heading", self.events.tight(at, stop), level=int(self.events.name[at][1]))
        return True

    def paragraph(self, at: int, stop: int) -> bool:
        self.add("paragraph", self.inline(at + 1, stop, not self.profile.nested_lists))
        return True

    def quote(self, at: int, stop: int) -> bool:
        self.add("quote", self.events.tight(at, stop), extra=" ".join(self.events.classes(at)))
        return True

    def code(self, at: int, stop: int) -> bool:
        inner = self.events.first(at + 1, stop, "code")
        names = () if inner is None else self.events.classes(inner)
        langs = [c[len(p):] for c in names for p in self.profile.code_prefixes if c.startswith(p)]
        whole = (at, stop) if inner is None else (inner, self.events.close[inner])
        self.add("code", self.events.text(*whole), extra=langs[0] if langs else "")
        return True

    def picture(self, at: int, stop: int) -> bool:
        if src := self.source(at):
            self.add("image", self.events.attrs[at].get("alt", ""), extra=src)
        return True

    def figure(self, at: int, stop: int) -> bool:
        events = self.events
        image, caption = events.first(at + 1, stop, "img"), events.first(at + 1, stop, "figcaption")
        if image is None:
            return False
        shown = bool(self.source(image))
        framed = shown or self.profile.inline_data_images  # else a figure without a usable image leaves nothing
        if shown:
            self.add("gap")
            self.picture(image, image)
        if framed and caption is not None:
            self.add("caption", events.tight(caption, events.close[caption]))
        if framed:
            self.add("gap")
        return True

    def table(self, at: int, stop: int) -> bool:
        """Rows by the nearest open row, so that a nested table adds rows of its own."""
        events, rows, open_rows = self.events, [], []
        for i in range(at + 1, stop):
            if events.name[i] == "tr" and events.kind[i] == START:
                rows.append([])
                open_rows.append(rows[-1])
            elif events.name[i] == "tr" and events.kind[i] == END:
                open_rows.pop()
            elif events.kind[i] == START and events.name[i] in ("td", "th") and open_rows:
                open_rows[-1].append(events.tight(i, events.close[i]))
        self.add("table", rows=[r for r in rows if r])
        return True

    def rule(self, at: int, stop: int) -> bool:
        self.add("rule")
        return True

    def definitions(self, at: int, stop: int) -> bool:
        if not self.profile.definition_lists:
            return False
        self.add("gap")
        for i in self.events.parts(at + 1, stop):
            if self.events.kind[i] == START and self.events.name[i] == "dt":
                self.add("term", self.events.tight(i, self.events.close[i]))
            elif self.events.kind[i] == START and self.events.name[i] == "dd":
                self.add("definition", self.inline(i + 1, self.events.close[i], not self.profile.nested_lists).strip())
        self.add("gap")
        return True

    def listing(self, at: int, stop: int) -> bool:
        """Items of a list and, where the profile nests, of the last list inside each item.

        Open lists wait on a stack with the items still to come.
        """
        events, nests = self.events, self.profile.nested_lists
        self.add("gap")
        waiting = [(events.name[at] == "ol", self.entries(at, stop))]
        while waiting:
            ordered, entries = waiting[-1]
            number, item = next(entries, (0, None))
            if item is None:
                waiting.pop()
                continue
            end, inner = events.close[item], None
            text = self.inline(item + 1, end, not nests)
            if nests:
                inner = max((i for i in events.parts(item + 1, end) if events.name[i] in ("ul", "ol") and events.kind[i] == START), default=None)
                own = [self.inline_part(i) for i in events.parts(item + 1, end) if i != inner]
                text = " ".join(p for p in own if p) or text
            self.add("item", text.strip(), level=len(waiting) - 1, extra=f"{number}." if ordered else "-")
            if inner is not None:
                waiting.append((events.name[inner] == "ol", self.entries(inner, events.close[inner])))
        self.add("gap")
        return True

    def entries(self, at: int, stop: int):
        """Numbered items directly in a list."""
        found = (i for i in self.events.parts(at + 1, stop) if self.events.kind[i] == START and self.events.name[i] == "li")
        return iter(enumerate(found, 1))

    def inline_part(self, at: int) -> str:
        """A part of a nesting item: text as it is, of an element what stands in it, of a list nothing."""
        events = self.events
        if events.kind[at] == TEXT:
            return events.name[at].strip()
        if events.name[at] in ("ul", "ol"):
            return ""
        return self.inline(at + 1, events.close[at], False).strip()


def element_paragraphs(html: str, selectors: list[str]) -> list[list[str] | None]:
    """For each selector the paragraph texts of the first element it names, or None if there is none.

    A selector is a tag (``article``), a class (``.story``), an id (``#text``) or ``""`` for the whole page.
    """
    events, found = read_events(html), []
    for selector in selectors:
        at, end = 0, len(events)
        if selector:
            kind, name = selector[0], selector.lstrip(".#")
            at = next((i for i in events.starts(0, end) if (
                name in events.classes(i) if kind == "." else events.attrs[i].get("id") == name if kind == "#" else events.name[i] == name)), None)
            end = None if at is None else events.close[at]
        found.append(None if at is None else [
            events.text(i, events.close[i]).strip() for i in events.starts(at, end) if events.name[i] == "p"])
    return found
