"""Main-text extraction: a recurrent labeller reads the blocks of a page and marks those of the article.

Each block is a leaf of the page: its tag path (names and the words of class, id and role) and its words are hashed
into two sparse vectors, next to a few plain numbers.  A bidirectional LSTM, in numpy, runs over all blocks of the
page in both directions, so every block is judged with the whole document in view.

There are no marked pages to learn from.  The network learns from a bounded sample of the pages themselves, marked by
the names that page authors use (``nav``, ``footer``, ``ad``, ...), and from rearrangements of their blocks: the same
paragraphs and phrases inside other containers, with menus, notices, forms, comments and adverts put around and
between them.  What it learns from names it applies to pages without them, by words, lengths, links and order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat, sample
from quern.llm.html_blocks import Block, blocks

PATH_BINS, WORD_BINS = 1024, 64
# Word bins and plain numbers of a block.
DENSE = WORD_BINS + 12
# Path words that page authors put on what is not the article, and on what is.
AWAY = set(
    "nav header footer aside form menu dialog button select head figure-ad ad ads advert advertisement advertising adsense banner promo "
    "promotion promoted sponsor sponsored sponsors sidebar side rail widget widgets navbar navigation breadcrumb breadcrumbs cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "follow related recommended recommendations more trending popular comments comment respond reply replies discussion disqus copyright "
    "legal disclaimer toolbar topbar masthead site-header pagination pager tags skip tracking outbrain taboola contentinfo complementary".split()
)
ARTICLE = set("article main content post entry story body text articlebody".split())


@dataclass(frozen=True)
class Plan:
    """``pages`` and ``page_chars`` bound the training sample: so many pages of at most so many characters."""

    pages: int = 240
    page_chars: int = 40_000
    variants: int = 3
    hidden: int = 20
    epochs: int = 9
    batch: int = 32
    rate: float = 8e-3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    paths: np.ndarray  # PATH_BINS x 8h: both directions' gates side by side
    rest: np.ndarray  # (WORD_BINS + numbers + 1) x 8h
    turn: tuple[np.ndarray, np.ndarray]  # h x 4h, forward and backward
    out: np.ndarray  # 2h + 1


def _bin(word: str) -> int:
    h = 2166136261
    for letter in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ letter) * 16777619) & 0xFFFFFFFF
    return h % PATH_BINS


class _Bins(dict):
    """Hash bins of path words, kept within limits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = _bin(word)
        return found


def _deepest(path: tuple[str, ...], names: set[str]) -> int:
    """Where in a path the last of some words stands; -1 if none does."""
    for at in range(len(path) - 1, -1, -1):
        if path[at].split(":")[-1] in names:
            return at
    return -1


def _places(path: tuple[str, ...]) -> tuple[int, int]:
    """Where the last word of boilerplate and the last of the article stand; the header of an article is part of it."""
    main = _deepest(path, ARTICLE)
    away = _deepest(path, AWAY)
    if away >= 0 and path[away] == "header" and "article" in path[:away]:
        away = _deepest(tuple(word for word in path if word != "header"), AWAY)
    return away, main


def page_features(pages: list[list[Block]], bins: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path bins of all blocks in a row, how many each has, and the dense part; blocks of all pages follow each other."""
    all_blocks = [b for page in pages for b in page]
    ids, counts = [], np.zeros(len(all_blocks), np.int64)
    for at, block in enumerate(all_blocks):
        found = {bins[word] for word in set(block.path)}
        # The tag the text stands in, and the one above it, count for themselves once more.
        tags = [word for word in block.path[-8:] if ":" not in word]
        found.update(bins[f"{k}<{word}"] for k, word in enumerate(tags[:-3:-1]))
        ids.extend(found)
        counts[at] = len(found)
    data, offsets = flat.utf8(pa.array([b.text for b in all_blocks], pa.large_string()))
    n = len(all_blocks)
    dense = np.zeros((n, DENSE), np.float32)
    for lo, hi in flat.runs(offsets):
        part = offsets[lo:hi + 1] - offsets[lo]
        hashes, owner = flat.word_hashes(data[offsets[lo]:offsets[hi]], part, gaps=flat.NO_TERM)
        words = np.bincount(owner, minlength=hi - lo)
        place = owner * WORD_BINS + (hashes >> np.uint64(58)).astype(np.int64) % WORD_BINS
        table = np.bincount(place, minlength=(hi - lo) * WORD_BINS).reshape(hi - lo, WORD_BINS)
        dense[lo:hi, :WORD_BINS] = np.sqrt(table / np.maximum(words, 1)[:, None])
        dense[lo:hi, WORD_BINS] = np.log1p(words) / 4
    sizes = np.array([len(b.text) for b in all_blocks])
    ends = np.array([b.text[-1] in ".!?:;…\"'" for b in all_blocks], dtype=float)
    at = WORD_BINS + 1
    dense[:, at] = np.log1p(sizes) / 6
    dense[:, at + 1] = [min(b.linked / max(len(b.text), 1), 1) for b in all_blocks]
    dense[:, at + 2] = ends
    dense[:, at + 3] = [("©" in b.text[:200]) for b in all_blocks]
    dense[:, at + 4] = sizes > 80
    dense[:, at + 5] = [len(b.path) / 16 for b in all_blocks]
    lengths = np.array([len(p) for p in pages], np.int64)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    dense[:, at + 6] = (np.arange(n) - first) / np.maximum(np.repeat(lengths, lengths) - 1, 1)
    dense[:, at + 7] = 1.0
    for k, block in enumerate(all_blocks):
        away, main = _places(block.path)
        dense[k, at + 8:at + 11] = away >= 0, main >= 0, away > main
    return np.array(ids, np.int64), counts, dense


def _project(model: Model, ids: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """What the gates of both directions get from each block; every block has at least one path bin or none."""
    out = dense @ model.rest
    some = np.flatnonzero(counts)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    for lo in range(0, len(some), 4096):
        part = some[lo:lo + 4096]
        a, b = begin[part[0]], begin[part[-1]] + counts[part[-1]]
        out[part] += np.add.reduceat(model.paths[ids[a:b]], begin[part] - a)
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(z: np.ndarray, turn: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction over (time, batch, 4h); returns the states and what the way back needs."""
    steps, batch, wide = z.shape
    h = wide // 4
    state, cell = np.zeros((batch, h), z.dtype), np.zeros((batch, h), z.dtype)
    states, kept = np.zeros((steps, batch, h), z.dtype), []
    for t in range(steps):
        g = z[t] + state @ turn
        i, f, o = _gate(g[:, :h]), _gate(g[:, h:2 * h] + 1), _gate(g[:, 2 * h:3 * h])
        c = np.tanh(g[:, 3 * h:])
        on = mask[t][:, None]
        new = f * cell + i * c
        squashed = np.tanh(new)
        kept.append((i, f, o, c, cell, state, squashed, on))
        cell = np.where(on, new, cell)
        state = np.where(on, o * squashed, state)
        states[t] = state
    return states, kept


def _back(grad: np.ndarray, turn: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for the gates' inputs and the recurrent weights, from those of the states."""
    steps, batch, h = grad.shape
    dz, dturn = np.zeros((steps, batch, 4 * h), grad.dtype), np.zeros_like(turn)
    dstate, dcell = np.zeros((batch, h), grad.dtype), np.zeros((batch, h), grad.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, c, cell, state, squashed, on = kept[t]
        total = dstate + grad[t]
        do = total * squashed * on
        dnew = (total * o * (1 - squashed ** 2) + dcell) * on
        g = np.concatenate((dnew * c * i * (1 - i), dnew * cell * f * (1 - f), do * o * (1 - o), dnew * i * (1 - c ** 2)), axis=1)
        dz[t] = g
        dturn += state.T @ g
        dstate = np.where(on, g @ turn.T, total)
        dcell = np.where(on, dnew * f, dcell)
    return dz, dturn


def _grid(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where block k of each page stands in the row of all blocks: forward, backward, and which places are real."""
    steps, lengths = max(lengths), np.array(lengths)
    first = np.cumsum(lengths) - lengths
    t = np.arange(steps)[:, None]
    mask = t < lengths
    return np.where(mask, first + t, 0), np.where(mask, first + lengths - 1 - t, 0), mask


def logits(model: Model, z: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Log-odds of every block, pages batched together; ``z`` comes from ``_project``."""
    h = z.shape[1] // 8
    ahead, behind, mask = _grid(lengths)
    out = np.full(len(z), model.out[-1], z.dtype)
    for place, turn, gates, weights in ((ahead, model.turn[0], z[:, :4 * h], model.out[:h]), (behind, model.turn[1], z[:, 4 * h:], model.out[h:2 * h])):
        states, _ = _run(gates[place], turn, mask)
        out[place[mask]] += states[mask] @ weights
    return out


def _away(block: Block) -> bool | None:
    """What the names on the path say: True for boilerplate, False for the article, None if they say nothing."""
    away, main = _places(block.path)
    if away >= 0:
        return True
    return False if main >= 0 else None


_MAIN = [
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content"><div class="post-body">{}</div></div>',
    '<section class="article">{}</section>', '<div class="entry-content">{}</div>', "<main><article>{}</article></main>", "<div><div>{}</div></div>",
    '<div role="main">{}</div>', '<td class="story">{}</td>', '<div class="page"><article class="post">{}</article></div>', "<section>{}</section>",
]
_CONTAINERS = (
    "ad ads advert advertisement banner promo sponsored sidebar widget menu navbar breadcrumb cookie-notice cookie-banner consent notice alert popup "
    "newsletter subscribe share social related recommended comments comment copyright legal toolbar pagination tags login search teaser box"
).split()
_NOTICES = (
    "We use cookies to improve your experience. Accept|Subscribe to our newsletter|Sign up for updates|Share this article|Advertisement|Sponsored content|"
    "All rights reserved.|Privacy policy|Terms of use|Related articles|Read more|Leave a comment|Log in|Follow us|Your email address|Send|Contact"
).split("|")
_TEASERS = "You may also like|More from us|Read next|Recommended for you|Latest stories|Popular now|More stories|In other news".split("|")


def rearranged(page: list[Block], phrases: list[str], rng: np.random.Generator) -> str:
    """A page of the same paragraphs in other containers; private-use characters mark the two kinds of blocks."""
    main = [b.text for b in page if _away(b) is False] or phrases[:1]

    def one(of: list[str]) -> str:
        return of[rng.integers(len(of))]

    def pick() -> str:
        return one(phrases if rng.random() < 0.6 else _NOTICES)

    no, yes = "\ue000", "\ue001"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{no}{pick()[:30]}</a></li>' for _ in range(n)) + "</ul>"

    def junk() -> str:
        kind = rng.integers(0, 10)
        n = int(rng.integers(2, 7))
        name = one(_CONTAINERS)
        if kind == 0:
            return f"<nav>{links(n)}</nav>"
        if kind == 1:
            return f'<div class="{name}">{links(n)}</div>'
        if kind == 2:
            return f'<div class="{name}">{no}{pick()}</div>'
        if kind == 3:
            return f"<aside><h3>{no}{pick()[:40]}</h3><p>{no}{pick()}</p></aside>"
        if kind == 4:
            return f'<form action="/go"><label>{no}{pick()[:40]}</label><input type="text"><button>{no}{pick()[:20]}</button></form>'
        if kind == 5:
            comments = "".join(f'<div class="comment"><b>{no}{pick()[:20]}</b><p>{no}{pick()}</p></div>' for _ in range(n))
            where = one(["comments", "responses", "discussion"])
            return f'<section class="{where}" id="{where}"><h2>{no}{pick()[:30]}</h2>{comments}</section>'
        if kind == 6:
            return f'<div id="{name}"><p>{no}{pick()}</p><p>{no}{pick()[:60]}</p></div>'
        # Teasers without a name: a heading over linked titles.
        if kind == 7:
            level = int(rng.integers(2, 5))
            return f"<section><h{level}>{no}{one(_TEASERS)}</h{level}>{links(n)}</section>"
        if kind == 8:
            teasers = "".join(f'<div><h3><a href="#">{no}{pick()[:50]}</a></h3><p>{no}{pick()[:80]}</p></div>' for _ in range(n))
            return f"<div><h2>{no}{one(_TEASERS)}</h2>{teasers}</div>"
        return f"<section class=\"{name}\"><h4>{no}{pick()[:40]}</h4>{links(n)}</section>"

    def cell() -> str:
        return yes + one(main)[:int(rng.integers(2, 40))].replace("<", "&lt;")

    def table() -> str:
        width = int(rng.integers(2, 5))
        rows = "".join("<tr>" + "".join(f"<{tag}>{cell()}</{tag}>" for _ in range(width)) + "</tr>" for tag in ["th"] + ["td"] * int(rng.integers(1, 6)))
        return f"<table>{rows}</table>"

    def figure() -> str:
        return f'<figure><img src="x"><figcaption>{cell()}</figcaption></figure>'

    body = []
    heading = rng.random() < 0.25
    for k, text in enumerate(main):
        if k == 0 and heading:
            body.append(f"<header><h1>{yes}{text.replace('<', '&lt;')}</h1><p>{cell()}</p></header>")
            continue
        tag = "h1" if k == 0 else "p" if rng.random() < 0.8 else one(["h2", "blockquote", "li", "pre", "td", "dd", "figcaption", "h3", "div"])
        body.append(f"<{tag}>{yes}{text.replace('<', '&lt;')}</{tag}>")
        if rng.random() < 0.15:
            items = "".join(f"<li>{yes}{one(main)[:int(rng.integers(10, 90))]}</li>" for _ in range(rng.integers(2, 5)))
            body.append(f"<ul>{items}</ul>" if rng.random() < 0.7 else f"<ol>{items}</ol>")
        if rng.random() < 0.08:
            body.append(table() if rng.random() < 0.6 else figure())
        if rng.random() < 0.15:
            body.append(junk())
    before = [f"<header>{no}{pick()[:50]}{links(4)}</header>"] if rng.random() < 0.6 else []
    before += [junk() for _ in range(rng.integers(0, 4))]
    after = [junk() for _ in range(rng.integers(0, 4))]
    if rng.random() < 0.8:
        after.append(f"<footer><p>{no}© {pick()}</p></footer>")
    shell = "<article>{}</article>" if heading else one(_MAIN)
    return "<body>" + "".join(before) + shell.format("".join(body)) + "".join(after) + "</body>"


def _lesson(page: list[Block]) -> tuple[list[Block], np.ndarray]:
    """Marked blocks of a rearranged page, without their marks."""
    marks = np.array([b.text.startswith("\ue001") for b in page], dtype=float)
    return [Block(b.path, b.text.lstrip("\ue000\ue001") or ".", b.linked) for b in page], marks


def train(pages: DataFrame, id_col: str, html_col: str, plan: Plan = Plan()) -> Model:
    """Learn from a bounded sample of the pages; with no usable page, from rearranged stock phrases alone."""
    n = pages.count()
    rows = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= plan.page_chars) & (sample.share_of(F.col(id_col)) < plan.pages * 2 / max(n, 1)))
    texts = [row[0] for row in rows.select(html_col).distinct().orderBy(F.xxhash64(html_col), html_col).limit(plan.pages).collect()]
    return fit([blocks(text) for text in texts], plan)


def fit(pages: list[list[Block]], plan: Plan = Plan()) -> Model:
    rng = np.random.default_rng(plan.seed)
    phrases = sorted({b.text for page in pages for b in page if len(b.text) > 1}) or ["Lorem ipsum.", "Dolor sit amet, consectetur."]
    lessons = []
    for page in pages or [[]]:
        known = [(b, _away(b)) for b in page]
        if known and any(mark is False for _, mark in known):
            lessons.append(([b for b, _ in known], np.array([1.0 if mark is False else 0.0 for _, mark in known])))
        for _ in range(plan.variants if pages else 60):
            lesson = _lesson(blocks(rearranged(page, phrases, rng)))
            if lesson[0]:
                lessons.append(lesson)
    h, bins = plan.hidden, _Bins()
    weights = [
        rng.normal(0, 0.05, (PATH_BINS, 8 * h)), rng.normal(0, 0.1, (DENSE, 8 * h)),
        rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), rng.normal(0, 0.2, 2 * h + 1),
    ]
    weights = [w.astype(np.float32) for w in weights]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(plan.epochs):
        order = rng.permutation(len(lessons))
        # Pages of about the same length go together.
        order = np.concatenate([sorted(part, key=lambda k: len(lessons[k][0])) for part in np.array_split(order, max(1, len(order) // (8 * plan.batch)))])
        for chosen in rng.permutation(np.arange(0, len(order), plan.batch)):
            part = [lessons[k] for k in order[chosen:chosen + plan.batch]]
            ids, counts, dense = page_features([p for p, _ in part], bins)
            grads = _gradients(weights, ids, counts, dense, [len(p) for p, _ in part], np.concatenate([y for _, y in part]))
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad ** 2
                weights[k] = weights[k] - plan.rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    paths, rest, ahead, behind, out = weights
    return Model(paths, rest, (ahead, behind), out)


def _gradients(weights: list[np.ndarray], ids, counts, dense, lengths: list[int], marks: np.ndarray) -> list[np.ndarray]:
    paths, rest, ahead_w, behind_w, out = weights
    model = Model(paths, rest, (ahead_w, behind_w), out)
    z = _project(model, ids, counts, dense)
    h = z.shape[1] // 8
    ahead, behind, mask = _grid(lengths)
    forward, kept_f = _run(z[:, :4 * h][ahead], ahead_w, mask)
    backward, kept_b = _run(z[:, 4 * h:][behind], behind_w, mask)
    states = np.zeros((len(z), 2 * h), z.dtype)
    states[ahead[mask], :h], states[behind[mask], h:] = forward[mask], backward[mask]
    score = states @ out[:-1] + out[-1]
    slope = ((_gate(score) - marks) / len(marks)).astype(z.dtype)
    dout = np.append(states.T @ slope, slope.sum())
    dstates = slope[:, None] * out[:-1]
    dz = np.zeros_like(z)
    turns = []
    for place, cut, kept, turn in ((ahead, slice(0, h), kept_f, ahead_w), (behind, slice(h, 2 * h), kept_b, behind_w)):
        grad = np.where(mask[:, :, None], dstates[:, cut][place], 0)
        back, dturn = _back(grad, turn, kept)
        columns = slice(0, 4 * h) if cut.start == 0 else slice(4 * h, 8 * h)
        dz[:, columns][place[mask]] = back[mask]
        turns.append(dturn)
    marked = np.zeros((PATH_BINS, len(z)), z.dtype)
    marked[ids, np.repeat(np.arange(len(z)), counts)] = 1
    return [marked @ dz, dense.T @ dz, *turns, dout]


# Blocks, and cells of the padded grid, that go through the network together.
BATCH_BLOCKS, BATCH_CELLS = 6000, 24_000


def main_texts(pages: list[str | None], model: Model, bins: dict[str, int]) -> list[str]:
    """The main text of every page: its marked blocks, two line ends between them."""
    cut = [blocks(page) for page in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    while order:
        group: list[int] = []
        total = 0
        while order and (not group or (total + len(cut[order[0]]) <= BATCH_BLOCKS and len(cut[order[0]]) * (len(group) + 1) <= BATCH_CELLS)):
            total += len(cut[order[0]])
            group.append(order.pop(0))
        ids, counts, dense = page_features([cut[k] for k in group], bins)
        found = logits(model, _project(model, ids, counts, dense), [len(cut[k]) for k in group]) > 0
        at = 0
        for k in group:
            marks = found[at:at + len(cut[k])]
            out[k] = "\n\n".join(b.text for b, mark in zip(cut[k], marks, strict=True) if mark)
            at += len(cut[k])
    return out


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str, model: Model) -> DataFrame:
    """``(id, url, text, n_chars)`` of every whole page; NULL, empty and text-free pages have an empty text."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [pages.schema[name].dataType.simpleString() for name in (id_col, url_col)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = main_texts(part.column(2).to_pylist(), shipped.value, bins)
                yield pa.record_batch({
                    "id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(text) for text in texts], pa.int64()),
                })

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        rows, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    )
