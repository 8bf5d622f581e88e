"""Plain one-process versions of the operators."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

KINDS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0


VALID = {
    "email": lambda value: True, "ip": lambda value: all(int(part) <= 255 for part in value.split(".")), "card": luhn,
    "phone": lambda value: 9 <= sum(c.isdigit() for c in value) <= 15,
}


def personal_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    found = [
        (m.start(), k, m.end(), kind) for k, (kind, pattern) in enumerate(KINDS) for m in pattern.finditer(text or "") if VALID[kind](m[0])
    ]
    return sorted(found)


def entities(start: int, kind: int, end: int, text: str) -> set[tuple]:
    """The value of a span and the group of the value."""
    value = text[start:end].lower()
    digits = "".join(c for c in value if c in "0123456789")
    group = [value.split("@")[-1], ".".join(value.split(".")[:3]), digits[:6], digits[:5]][kind]
    return {("value", kind, value if kind < 2 else digits), ("group", kind, group)}


def co_occurrence(texts: list[str | None]) -> tuple[Counter, Counter, Counter, int]:
    """n_te by (term, entity), n_t by term, n_e by entity, and n, over distinct texts."""
    n_te, n_t, n_e = Counter(), Counter(), Counter()
    distinct = {text or "" for text in texts}
    for text in distinct:
        terms = {term.lower() for term in re.findall(r"[^\W_]+", text)}
        held = set().union(*(entities(a, kind, b, text) for a, kind, b, _ in personal_spans(text)))
        n_t.update(terms)
        n_e.update(held)
        n_te.update((term, entity) for term in terms for entity in held)
    return n_te, n_t, n_e, len(distinct)


def term_spans(texts: list[str | None], plan) -> list[list[str]]:
    """Of each text, the terms that disclose an entity in it, where they stand outside base spans."""
    n_te, n_t, n_e, n = co_occurrence(texts)

    def tells(term: str, entity: tuple) -> bool:
        both = n_te[term, entity]
        if min(both, n_e[entity]) < plan.min_texts or both < plan.min_disclosure * n_t[term]:
            return False
        bits, most = math.log2(both * n / (n_t[term] * n_e[entity])), math.log2(n / n_e[entity])
        return bits > 0 and bits >= min(plan.min_bits, plan.min_share * most)

    found = []
    for text in texts:
        text = text or ""
        base = personal_spans(text)
        held = set().union(*(entities(a, kind, b, text) for a, kind, b, _ in base))
        found.append([
            m[0] for m in re.finditer(r"[^\W_]+", text)
            if not any(a < m.end() and m.start() < b for a, _, b, _ in base) and any(tells(m[0].lower(), e) for e in held)
        ])
    return found


def shingle_set(text: str | None, size: int) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def near_groups(rows: list[tuple[int, str | None]], size: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """id -> (set size, smallest reachable id), from an inverted index of all shingles."""
    sets = {key: shingle_set(text, size) for key, text in rows}
    holders = defaultdict(list)
    for key, shingles in sets.items():
        for shingle in shingles:
            holders[shingle].append(key)
    parent = {key: key for key in sets}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for key, shingles in sets.items():
        for other, n in Counter(o for s in shingles for o in holders[s] if o > key).items():
            if 100 * n >= percent * (len(shingles) + len(sets[other]) - n):
                a, b = find(key), find(other)
                parent[max(a, b)] = min(a, b)
    return {key: (len(shingles), find(key)) for key, shingles in sets.items()}


def best_score(text: str, scores: dict[str, float], unknown: float) -> float:
    """Score of the best segmentation, by trying every piece at every place."""
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, scores))
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + unknown
        for start in range(max(0, end - longest), end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
    return best[-1]


def lexical_ranks(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item, rank, document, score), by scoring every document for every item."""
    def terms(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    held = [(key, Counter(found)) for key, text in docs if (found := terms(text))]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(term for _, c in held for term in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, counts in held:
            m = 100 - 50 + (50 * sum(counts.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in wanted if t in counts
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda row: row[:3])[:k], 1)]
    return out


def collocations(rows: list[tuple], longest: int, least: int, absorbed: int, first: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score), by counting every phrase and comparing it with all longer ones."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(a for phrase, a in f.items() if len(phrase) == 1)
        candidates = {phrase: a for phrase, a in f.items() if len(phrase) > 1 and a >= least}
        inside: dict[tuple, int] = defaultdict(int)
        for longer, a in candidates.items():
            for size in range(2, len(longer)):
                for k in range(len(longer) - size + 1):
                    part = longer[k:k + size]
                    inside[part] = max(inside[part], a)
        kept = []
        for phrase, a in candidates.items():
            if 100 * inside[phrase] >= absorbed * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out
