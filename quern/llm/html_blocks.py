"""Cut raw HTML into leaf blocks: runs of text between block-level tags, each with the path of tags above it.

The reader forgives what browsers forgive: unclosed and stray tags, raw-text elements, comments, a page that ends
inside a tag.  Character references are decoded, and any white space becomes one blank.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# A comment, a declaration or instruction, or a tag; one that never closes runs to the end of the page, unless a
# quote is to blame, in which case the first ">" closes it.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*+(?:"[^"]*"|'[^']*'))*+[^>"']*+>|[^>]*(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
# Elements whose content is no markup.  None of them holds text to read but ``xmp``, which is shown as it stands; they
# end no block that they stand in.
_RAW = {"script", "style", "title", "textarea", "template", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_CLOSES_ITSELF = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]  # tag names and the words of class, id and role, outermost first
    text: str
    linked: int  # code points inside links


def _words(name: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (name,)
    found = [name]
    for kind, value in _ATTRIBUTE.findall(attributes):
        found += [f"{kind.lower()[0]}:{word}" for word in _NAME.findall(value.lower())]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    """All text blocks of a page in order; none for NULL and empty pages."""
    if not page:
        return []
    out: list[Block] = []
    names: list[str] = []
    tokens: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, path
        if not parts:
            if text.isspace():
                return
            path = tuple(word for level in tokens for word in level)
        parts.append(text)
        if "a" in names:
            linked += len(text)

    def close(count: int) -> None:
        del names[len(names) - count:], tokens[len(tokens) - count:]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        tag = _MARKUP.match(page, lt)
        if tag is None:  # a "<" that opens nothing is text
            add("<")
            at = lt + 1
            continue
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        inline = name in _INLINE or name not in _BLOCK
        if not inline:
            flush()
        if tag[1]:
            for back in range(1, len(names) + 1):
                if names[-back] == name:
                    close(back)
                    break
                # A stray end tag of an inline element closes nothing beyond the block it stands in.
                if inline and names[-back] in _BLOCK:
                    break
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            if name == "xmp":
                flush()
                add(html.escape(page[at:end.start() if end else size]))
                flush()
            at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ") if parts else None
            continue
        if name in _VOID:
            continue
        if not inline:
            for back in range(1, len(names) + 1):
                if names[-back] == "p":
                    close(back)
                    break
                if names[-back] in _BLOCK:
                    break
            for back in range(1, len(names) + 1):
                if names[-back] in _CLOSES_ITSELF.get(name, ()):
                    close(back)
                    break
                if names[-back] in _HOLDS.get(name, _BLOCK):
                    break
        names.append(name)
        tokens.append(_words(name, tag[3]))
    flush()
    return out


_BLOCK = set(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul video audio br".split()
) - {"br"}
