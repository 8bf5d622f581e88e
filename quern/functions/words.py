"""Worker-side word helpers.  Spark partitions the rows; these work on one Arrow batch at a time."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc

# --- English stemming after the published Porter2 description -------------------------------
# Fixed values of that description: irregular words and suffix lists.
IRREGULAR_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "al", "er", "ic",
)

_REGION1 = re.compile(r"(gener|commun|arsen)|.*?[aeiouy][^aeiouy]")
_REGION2 = re.compile(r".*?[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_SUFFIX2 = re.compile("(" + "|".join(sorted(STEP2, key=len, reverse=True)) + ")$")
_SUFFIX3 = re.compile("(" + "|".join(sorted(STEP3, key=len, reverse=True)) + ")$")
_SUFFIX4 = re.compile("(" + "|".join(STEP4) + "|[st]ion)$")


def stem(word: str) -> str:
    """English stem of one lower-case word."""
    if len(word) < 3:
        return word
    if word in IRREGULAR_STEMS:
        return IRREGULAR_STEMS[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)

    # A consonant "Y" counts as a non-vowel, so both regions can be read off once.
    head = _REGION1.match(word)
    r1 = head.end() if head else len(word)
    tail = _REGION2.match(word, r1)
    r2 = tail.end() if tail else len(word)

    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word, 0, len(word) - 2):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word

    # Past tense, gerund.
    ending = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", word)
    if ending and ending[1].startswith("eed"):
        if ending.start() >= r1:
            word = word[:ending.start()] + "ee"
    elif ending and _VOWEL.search(word, 0, ending.start()):
        word = word[:ending.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT_END.search(word):
            word += "e"

    # Final y after a consonant that is not the first letter.
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)

    found = _SUFFIX2.search(word)
    if found:
        if found.start() >= r1:
            word = word[:found.start()] + STEP2[found[1]]
    elif word.endswith("ogi"):
        if len(word) - 3 >= r1 and word.endswith("logi"):
            word = word[:-1]
    elif word.endswith("li") and len(word) - 2 >= r1 and re.search(r"[cdeghkmnrt]li$", word):
        word = word[:-2]

    found = _SUFFIX3.search(word)
    if found:
        if found.start() >= r1:
            word = word[:found.start()] + STEP3[found[1]]
    elif word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]

    found = _SUFFIX4.search(word)
    if found:
        cut = found.start() + 1 if found[1] in ("sion", "tion") else found.start()
        if cut >= r2:
            word = word[:cut]

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stem_phrase(phrase: str) -> str:
    return " ".join(stem(token) for token in phrase.split())


# --- Dictionary-form lookup ------------------------------------------------------------------
# The suffix rules of the public morphological lookup, per part of speech.
DETACH_NOUN = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
    ("shes", "sh"), ("men", "man"), ("ies", "y"),
)
DETACH_VERB = (
    ("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""),
)


class SortedWords:
    """Words in byte order, in one buffer: about ten bytes a word more than its letters.

    ``find`` is a binary search; equal words are kept, so that a second list can hold a value for each.
    """

    def __init__(self, values: pa.Array) -> None:
        values = values.cast(pa.large_binary())
        self.n, self.ends = len(values), values.buffers()[1].to_pybytes()[8 * values.offset:] if len(values) else b""
        self.letters = values.buffers()[2].to_pybytes() if len(values) and values.buffers()[2] is not None else b""

    def word(self, at: int) -> bytes:
        end = self.ends[8 * at:8 * at + 16]
        return self.letters[int.from_bytes(end[:8], "little"):int.from_bytes(end[8:], "little")]

    def find(self, word: bytes) -> int:
        """Where ``word`` stands first, or would stand."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.word(middle) < word:
                low = middle + 1
            else:
                high = middle
        return low

    def array(self) -> pa.Array:
        buffers = [None, pa.py_buffer(self.ends or bytes(8)), pa.py_buffer(self.letters)]
        return pa.Array.from_buffers(pa.large_binary(), self.n, buffers).cast(pa.large_string()).cast(pa.string())

    def __contains__(self, word: str) -> bool:
        raw = word.encode()
        at = self.find(raw)
        return at < self.n and self.word(at) == raw


def form_finder(lexicon: dict[str, SortedWords], irregular: tuple[SortedWords, SortedWords] | None, order: str):
    """Dictionary form of a word: the parts of speech in ``order`` until one changes it.

    ``irregular`` holds, sorted together, ``word NUL pos`` and the form that the word then has.
    """
    known: dict[str, str] = {}
    rules = {"n": DETACH_NOUN, "v": DETACH_VERB}

    def exceptions(word: str, pos: str) -> list[str]:
        out: list[str] = []
        if irregular is not None:
            keys, forms = irregular
            raw = f"{word}\0{pos}".encode()
            at = keys.find(raw)
            while at < keys.n and keys.word(at) == raw:
                out.append(forms.word(at).decode())
                at += 1
        return out

    def find(word: str, pos: str) -> str:
        made = [(0, form) for form in exceptions(word, pos)] or [
            (nth, word[: len(word) - len(ending)] + replacement)
            for nth, (ending, replacement) in enumerate(rules[pos], 1) if word.endswith(ending)
        ]
        listed = [(len(form), nth, form.encode(), form) for nth, form in [(0, word), *made] if form in lexicon[pos]]
        return min(listed)[3] if listed else word

    def lemma(word: str) -> str:
        if word not in known:
            form = word
            for pos in order:
                form = find(word, pos)
                if form != word:
                    break
            known[word] = form
        return known[word]

    return lemma


def listed_forms(tokens: pa.Array, lexicon: dict[str, SortedWords], order: str) -> pa.Array:
    """What :func:`form_finder` finds without irregular words, for an array of distinct words at once."""
    import numpy as np

    out = np.asarray(tokens.to_numpy(zero_copy_only=False), object)
    open_ = np.ones(len(tokens), bool)
    for pos in order:
        # Candidates in the order of the rules; of the shortest that are listed the first counts.
        made, owners = [tokens], [np.arange(len(tokens))]
        for ending, replacement in {"n": DETACH_NOUN, "v": DETACH_VERB}[pos]:
            at = np.flatnonzero(pc.ends_with(tokens, ending).to_numpy(zero_copy_only=False))
            stems = pc.utf8_slice_codeunits(tokens.take(pa.array(at)), 0, -len(ending))
            made.append(pc.binary_join_element_wise(stems, replacement, ""))
            owners.append(at)
        forms, owner = pa.concat_arrays([part.cast(pa.string()) for part in made]), np.concatenate(owners)
        hit = np.flatnonzero(pc.is_in(forms, value_set=lexicon[pos].array()).to_numpy(zero_copy_only=False))
        forms, owner = forms.take(pa.array(hit)), owner[hit]
        best = np.lexsort((hit, pc.utf8_length(forms).to_numpy(zero_copy_only=False), owner))
        first = best[np.r_[True, owner[best][1:] != owner[best][:-1]]] if len(best) else best
        first = first[open_[owner[first]]]
        changed = np.asarray(forms.take(pa.array(first)).to_numpy(zero_copy_only=False), object)
        places = owner[first]
        open_[places[changed != out[places]]] = False
        out[places] = changed
    return pa.array(out, pa.string())


def known_forms(tokens: pa.Array, listed: SortedWords, forms: SortedWords) -> pa.Array:
    """The form that stands beside a listed word; others stay as they are."""
    at = pc.index_in(tokens, value_set=listed.array())
    return pc.coalesce(forms.array().take(at), tokens)


def map_phrase_words(lists: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Change the distinct words of a list column of phrases, split at blanks; list boundaries and NULLs are kept."""
    def changed(phrases: pa.Array) -> pa.Array:
        coded = phrases.dictionary_encode()
        parted = pc.split_pattern(coded.dictionary, " ")
        tokens = parted.values.dictionary_encode()
        spelled = change(tokens.dictionary).take(tokens.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(parted.offsets, spelled), " ")
        return joined.take(coded.indices)

    return _map_lists(lists, changed)


# --- Terms of token lists -----------------------------------------------------------------------
# Tokens whose n-grams are counted in one go.
COUNTED_TOKENS = 1 << 21


def counted_grams(batches: Iterable[pa.RecordBatch], smallest: int, largest: int, names: tuple[str, str, str]) -> Iterable[pa.RecordBatch]:
    """Rows ``(key, term, tf)``, one for each distinct n-gram of a list of tokens, of batches ``(key, tokens)``."""
    import numpy as np

    for batch in batches:
        lists = batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUNTED_TOKENS, "right")))
            owner, terms, tf = gram_counts(lists.slice(lo, hi - lo), smallest, largest)
            if len(owner):
                yield pa.record_batch([batch.column(0).take(pa.array(owner + lo)), terms, tf], names=list(names))
            lo = hi


def run_peaks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """``(term, run, most)`` of rows ``(term, run, weight)``: the largest weight of rows of a term and run that follow each other."""
    import numpy as np

    for batch in batches:
        if len(batch):
            first = _firsts(batch, ("term", "run"))
            most = np.maximum.reduceat(batch.column("weight").to_numpy(zero_copy_only=False), first)
            yield pa.record_batch([batch.column(name).take(pa.array(first)) for name in ("term", "run")] + [pa.array(most)], names=["term", "run", "most"])


def term_runs(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """``(term, df, total_tf)`` of rows ``(term, tf)``: the number of rows of a term that follow each other, and their sum."""
    import numpy as np

    for batch in batches:
        if len(batch):
            first = _firsts(batch, ("term",))
            total = np.add.reduceat(batch.column("tf").to_numpy(zero_copy_only=False).astype(np.int64), first)
            df = np.diff(np.r_[first, len(batch)])
            yield pa.record_batch([batch.column("term").take(pa.array(first)), pa.array(df), pa.array(total)], names=["term", "df", "total_tf"])


def _firsts(batch: pa.RecordBatch, names: tuple[str, ...]):
    """Where the values of some columns without NULLs differ from those of the row before."""
    import numpy as np

    fresh = np.ones(len(batch), bool)
    fresh[1:] = False
    for name in names:
        column = batch.column(name)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


def gram_counts(lists: pa.Array, smallest: int, largest: int) -> tuple:
    """``(list, n-gram, count)`` of the distinct n-grams of each list, joined by blanks; NULL lists have none.

    Rows of one n-gram come together: so a shuffle compresses them best.
    """
    import numpy as np

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = len(coded.dictionary) or 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Grams of one more word are a gram and the next word; numbers of grams stay below the number of tokens.
    grams, firsts = codes, [codes]
    owners, terms, counts = [], [], []
    for n in range(1, largest + 1):
        if n > 1:
            span = len(owner) - n + 1
            if span <= 0:
                break
            firsts = [part[:span] for part in firsts] + [codes[n - 1:]]
            grams = grams[:span] * base + codes[n - 1:]
            within = owner[:span] == owner[n - 1:]
        else:
            within = np.ones(len(owner), bool)
        at = np.flatnonzero(within)
        if n >= smallest and len(at):
            most = int(grams.max()) + 1
            if most * len(sizes) < 1 << 62:
                # One number for gram and list; sorting it counts both.
                first, tf = _runs(grams[at] * len(sizes) + owner[at])
            else:
                order = np.lexsort((owner[at], grams[at]))
                a, b = owner[at][order], grams[at][order]
                cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                first, tf = order[cuts], np.diff(np.r_[cuts, len(order)])
            place = at[first]
            spelled = [coded.dictionary.take(pa.array(part[place])) for part in firsts]
            owners.append(owner[place])
            terms.append(spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, " "))
            counts.append(tf)
        if n < largest and n > 1:
            grams = np.unique(grams, return_inverse=True)[1]
    if not owners:
        return np.zeros(0, np.int64), pa.array([], pa.string()), pa.array([], pa.int32())
    return np.concatenate(owners), pa.concat_arrays(terms), pa.array(np.concatenate(counts).astype(np.int32))


def _runs(values) -> tuple:
    """Where each distinct value stands, in order of values, and how often."""
    import numpy as np

    order = np.argsort(values)
    ordered = values[order]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order[cuts], np.diff(np.r_[cuts, len(values)])


# --- Batch plumbing ---------------------------------------------------------------------------
def map_words(values: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Apply ``change`` to each distinct string of a flat Arrow column."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    changed = pa.array([None if w is None else change(w) for w in coded.dictionary.to_pylist()], pa.string())
    return changed.take(coded.indices)


def map_word_lists(lists: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The same for a list column; list boundaries and NULL lists are kept."""
    return _map_lists(lists, lambda flat: map_words(flat, change))


def _map_lists(lists: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = change(lists.flatten())
    lengths = pc.list_value_length(lists).to_pylist()
    offsets, at = [], 0
    for n in lengths:
        offsets.append(None if n is None else at)
        at += n or 0
    offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def unescape(text: str) -> str:
    return html.unescape(text) if "&" in text else text


# --- Microdata ----------------------------------------------------------------------------------
# Which attribute carries an item property's value.
VALUE_ATTRIBUTES = {
    "meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src",
    "embed": "src", "iframe": "src", "source": "src", "track": "src", "video": "src",
    "object": "data", "time": "datetime", "data": "value", "meter": "value",
}
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Element:
    """One element of a page: its attributes, and its texts and elements in order."""

    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.parts = tag, attributes, []

    def text(self) -> str:
        """All text below, in order; walked without recursion, since pages nest as deep as they like."""
        out, left = [], [iter(self.parts)]
        while left:
            part = next(left[-1], None)
            if part is None:
                left.pop()
            elif isinstance(part, str):
                out.append(part)
            else:
                left.append(iter(part.parts))
        return " ".join("".join(out).split())


class _TreeReader(HTMLParser):
    """The elements of a page as a tree; an end tag closes all that was opened since its start."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Element("", {})]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attributes: dict[str, str] = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        element = _Element(tag, attributes)
        self.open[-1].parts.append(element)
        if tag not in VOID_TAGS:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return


class _Items:
    """Items of a page.  ``itemref`` adds the properties of other elements; a cycle of references ends where it closes."""

    def __init__(self, root: _Element) -> None:
        self.scopes: list[tuple[_Element, bool]] = []  # with whether it stands as a property in another item
        self.by_id: dict[str, _Element] = {}
        self.referred: set[int] = set()
        left = [(iter(root.parts), False)]
        while left:
            part = next(left[-1][0], None)
            if part is None:
                left.pop()
            elif not isinstance(part, str):
                inside = left[-1][1]
                if part.attributes.get("id"):
                    self.by_id.setdefault(part.attributes["id"], part)
                if "itemscope" in part.attributes:
                    self.scopes.append((part, inside and bool(part.attributes.get("itemprop", "").split())))
                    inside = True
                left.append((iter(part.parts), inside))

    def found(self) -> list[dict]:
        """All items that are no property of another, in the order of the page."""
        built = [(element, self.item(element, ())) for element, held in self.scopes if not held]
        return [item for element, item in built if id(element) not in self.referred]

    def item(self, element: _Element, within: tuple[int, ...]) -> dict:
        types = element.attributes.get("itemtype", "").split()
        item: dict = {"properties": {}}
        if types:
            item = {"type": types[0] if len(types) == 1 else types, **item}
            if element.attributes.get("itemid", "").strip():
                item["id"] = element.attributes["itemid"].strip()
        within, used = (*within, id(element)), {id(element)}
        for name in element.attributes.get("itemref", "").split():
            if name in self.by_id:
                self._collect(item["properties"], [self.by_id[name]], within, used, True)
        self._collect(item["properties"], element.parts, within, used, False)
        return item

    def _collect(self, properties: dict, parts: list, within: tuple[int, ...], used: set[int], referred: bool) -> None:
        """Add the properties of some elements and what is in them; an element counts once for an item."""
        left = [iter(parts)]
        while left:
            part = next(left[-1], None)
            if part is None:
                left.pop()
            elif not isinstance(part, str) and id(part) not in used:
                used.add(id(part))
                names = part.attributes.get("itemprop", "").split()
                if "itemscope" not in part.attributes:
                    if names:
                        attribute = VALUE_ATTRIBUTES.get(part.tag)
                        known = part.attributes.get(attribute) if attribute else None
                        _add(properties, names, part.text() if known is None else known.strip())
                    left.append(iter(part.parts))
                elif names:
                    if referred:
                        self.referred.add(id(part))
                    if id(part) not in within:
                        _add(properties, names, self.item(part, within))


def _add(properties: dict, names: Iterable[str], value: object) -> None:
    for name in names:
        if name not in properties:
            properties[name] = value
        elif isinstance(properties[name], list):
            properties[name].append(value)
        else:
            properties[name] = [properties[name], value]


def microdata_items(page: str) -> list[dict]:
    reader = _TreeReader()
    reader.feed(page)
    reader.close()
    return _Items(reader.open[0]).found()


def sparse_dots(left_keys: pa.Array, left: pa.Array, right_keys: pa.Array, right: pa.Array) -> pa.Array:
    """Inner products of sparse vectors; the keys of each are sorted and distinct."""
    import numpy as np

    def parts(lists: pa.Array, kind: type) -> tuple[np.ndarray, list[int]]:
        return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind), np.asarray(lists.offsets).tolist()

    (ak, ends_a), (a, _), (bk, ends_b), (b, _) = parts(left_keys, np.int64), parts(left, np.float64), parts(right_keys, np.int64), parts(right, np.float64)
    base_a, base_b, out = ends_a[0], ends_b[0], np.zeros(len(left_keys))
    for at in range(len(out)):
        one, two = slice(ends_a[at] - base_a, ends_a[at + 1] - base_a), slice(ends_b[at] - base_b, ends_b[at + 1] - base_b)
        short, long, weights, others = (ak[one], bk[two], a[one], b[two]) if one.stop - one.start <= two.stop - two.start else (bk[two], ak[one], b[two], a[one])
        if len(short):
            place = np.minimum(np.searchsorted(long, short), len(long) - 1)
            same = long[place] == short
            out[at] = weights[same] @ others[place[same]]
    return pa.array(out)
