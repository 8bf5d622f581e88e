"""Personal data: base patterns by kind, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card and telephone numbers.  Protected entities are their values (numbers
by their digits) and the groups these belong to: the domain of an address, the first three parts of an IP address, the
first six digits of a card, the first five of a telephone number.  So a value that stands in one text alone is still
judged with others of its group.  The corpus tells which terms reveal an entity: among all distinct texts, how many hold
the term (``n_t``), the entity (``n_e``), and both, wherever they stand (``n_te``).  A term discloses the entity if the
two share enough texts, ``n_te / n_t`` reaches the disclosure threshold, and the pointwise mutual information
``log2(n_te * N / (n_t * n_e))`` is above 0 and reaches a number of bits or a share of ``log2(N / n_e)``, which is the
most that any term can have.  So entities that stand in many texts are judged too; only of one that stands in all
texts a term says nothing.  Such terms become spans of kind ``term`` wherever they stand in a text with the entity,
outside its base spans; ``sanitise`` removes those that give the entity away almost surely and puts a general word for
the others.  Texts without a base span are never touched.

Everything is DataFrame work: positions come from the lengths of the pieces between matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import lookup_join
from quern.sources.tables import store

# Linear-time forms of the patterns: what a repeated part took is never given back where that cannot change a match,
# and a match begins at the start of a run or where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# Runs of fewer than 12 digits would be dropped after the match.
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Plan:
    """``min_share``: share of the most information possible that is enough even below ``min_bits``."""

    min_texts: int = 2
    min_disclosure: float = 0.5
    sure_disclosure: float = 0.9
    min_bits: float = 4.0
    min_share: float = 0.5
    # Hashes of candidate terms up to this many are sent to every executor, some 50 MB; terms themselves may have any length.
    # Beyond it every word of every text moves to its term.
    broadcast_terms: int = 1_000_000


def _spans(text: Column, pattern: Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches, in code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, 0)
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"),
    )

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        return F.struct(
            end.alias("at"),
            F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("spans"),
        )

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("value"))
    return F.aggregate(pairs, zero, step, lambda done: done["spans"])


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((n - at) % 2 == 1, twice).otherwise(digit)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)


_BASE = (
    (EMAIL, lambda text: F.contains(text, F.lit("@")), None),
    (IP, lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _ip),
    (CARD, lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _luhn),
    (PHONE, lambda text: F.contains(text, F.lit("+")), _phone),
)


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end, value>>`` of the base kinds, by start, then kind (its place in ``KINDS``)."""

    def of_kind(kind: int, pattern: str, possible, valid) -> Column:
        found = _spans(text, F.lit(pattern))
        if valid is not None:
            found = F.filter(found, lambda span: valid(span["value"]))
        found = F.transform(found, lambda span: F.struct(
            span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end"), span["value"].alias("value")
        ))
        return F.when(possible(text), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))

    return F.array_sort(F.concat(*(of_kind(kind, *rule) for kind, rule in enumerate(_BASE))))


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``base`` and ``text_key``, which tells distinct texts apart; both only where there is a span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("base", base_spans(text)).withColumn(
        "text_key", F.when(F.size("base") > 0, F.concat_ws(":", F.xxhash64(text), F.length(text)))
    )


def _entities(span: Column) -> Column:
    """What a base span stands for: its value and the group of the value."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = (
        F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 3))
        .when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    )
    return F.array(F.concat_ws(":", kind, F.when(kind <= 1, value).otherwise(digits)), F.concat_ws("/", kind, group))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def counts(docs: DataFrame, holding: DataFrame, text: Column, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """``(text_key, entity, term)`` of the texts in ``holding``, and ``(entity, term, n_te, n_t, n_e, n)`` of what may disclose.

    Left out are entities and pairs in fewer than ``min_texts`` texts, and terms whose share cannot reach the threshold.
    """
    entities = store(holding.select("text_key", F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity")), "pii-entities")
    several = store(entities.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= plan.min_texts), "pii-judged")
    judged = lookup_join(entities, several, ["entity"]).groupBy("text_key").agg(F.collect_list("entity").alias("entities"))
    words = holding.join(judged, "text_key").select("text_key", "entities", F.explode(_terms(text)).alias("term"))
    words = store(words, "pii-words")
    both = words.select("text_key", F.explode("entities").alias("entity"), "term")
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= plan.min_texts)
    # A term's texts are at least those that hold it and any judged entity, which rules most common words out at once.
    anywhere = words.groupBy("term").agg(F.count("*").alias("n_held"))
    pairs = pairs.join(anywhere, "term").where(F.col("n_te") >= plan.min_disclosure * F.col("n_held")).drop("n_held")
    pairs = store(pairs, "pii-pairs")
    held = _texts_holding(docs, text, store(pairs.select("term").distinct(), "pii-terms"), plan)
    n_texts = docs.select(*_key(text)).distinct().agg(F.count("*").alias("n"))
    return both, pairs.join(held, "term").join(several, "entity").join(F.broadcast(n_texts))


def disclosing(docs: DataFrame, text_col: str, plan: Plan = Plan()) -> DataFrame:
    """``(text_key, terms)``: the terms of each distinct text that disclose an entity in it.

    ``terms`` is ``array<struct<start, kind, end, sure>>``; it holds no more than the text's own words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    holding = with_base(docs.select(text.alias(text_col)), text_col).where("text_key IS NOT NULL")
    holding = store(holding.dropDuplicates(["text_key"]), "pii-texts")
    both, counted = counts(docs, holding, text, plan)
    disclosure = F.col("n_te") / F.col("n_t")
    bits = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    enough = F.least(F.lit(plan.min_bits), plan.min_share * F.log2(F.col("n") / F.col("n_e")))
    strong = counted.where((disclosure >= plan.min_disclosure) & (bits > 0) & (bits >= enough)).select(
        "entity", "term", (disclosure >= plan.sure_disclosure).alias("sure")
    )
    strong = store(strong, "pii-strong")
    found = both.join(strong, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("sure").alias("sure"))
    found = found.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "sure"))).alias("sure_of"))
    # Words as they are written in the text; a word has letters and digits only, so it is its own pattern.
    forms = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TERM), 0), lambda form: F.map_contains_key("sure_of", F.lower(form))))
    rows = store(holding.join(found, "text_key").select("text_key", text.alias("text"), "base", "sure_of", forms.alias("forms")), "pii-forms")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("forms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    free = F.filter(_spans(F.col("text"), pattern), lambda term: (
        ~F.exists("base", lambda base: (base["start"] < term["end"]) & (term["start"] < base["end"]))
    ))
    return rows.select("text_key", F.transform(free, lambda term: F.struct(
        term["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), term["end"].alias("end"),
        F.element_at("sure_of", F.lower(term["value"])).alias("sure"),
    )).alias("terms"))


def _key(text: Column) -> tuple[Column, Column]:
    """What tells distinct texts apart, as two numbers."""
    return F.xxhash64(text).alias("text_hash"), F.length(text).alias("text_length")


def _texts_holding(docs: DataFrame, text: Column, wanted: DataFrame, plan: Plan) -> DataFrame:
    """``(term, n_t)``: distinct texts of the whole corpus that hold each wanted term."""
    words = docs.select(*_key(text), F.explode(_terms(text)).alias("term"))
    if wanted.count() <= plan.broadcast_terms:
        # A hash that another term shares lets that term through, which then meets no pair.
        hashes = F.broadcast(wanted.select(F.xxhash64("term").alias("term_hash")).distinct())
        words = words.withColumn("term_hash", F.xxhash64("term")).join(hashes, "term_hash", "left_semi").drop("term_hash")
    else:
        words = words.join(wanted.hint("shuffle_merge"), "term", "left_semi")
    return words.distinct().groupBy("term").agg(F.count("*").alias("n_t"))


def _equals(kind: int):
    return lambda found: found == kind


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(
        ":", F.element_at(names, span["kind"] + 1), span["start"].cast("string"), span["end"].cast("string")
    )), ",")


def report(docs: DataFrame, id_col: str, text_col: str, plan: Plan = Plan()) -> DataFrame:
    """Counts and spans of every document: ``id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans``.

    NULL and empty texts have no spans; repeated rows are reported each.
    """
    terms = store(disclosing(docs, text_col, plan), "pii-found")
    rows = store(with_base(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text"), "pii-base")
    # Only rows with spans have a key; the others need not move.
    marked = rows.where("text_key IS NOT NULL").join(terms, "text_key", "left")
    rest = rows.where("text_key IS NULL")
    both = marked.unionByName(rest, allowMissingColumns=True)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,sure:boolean>>")
    terms_of = F.coalesce("terms", none)
    plain = F.transform("base", lambda span: F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end")))
    extra = F.transform(terms_of, lambda span: F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end")))
    counts = [
        F.size(F.filter(F.transform("base", lambda span: span["kind"]), _equals(kind))).cast("long").alias(f"n_{name}")
        for kind, name in enumerate(KINDS[:-1])
    ]
    return both.select(
        "id", *counts, F.size(terms_of).cast("long").alias("n_term"),
        F.sha2(_listed(plain), 256).alias("base_sha256"), _listed(F.array_sort(F.concat(plain, extra))).alias("spans"),
    )


def sanitise(docs: DataFrame, text_col: str, plan: Plan = Plan()) -> DataFrame:
    """``docs`` with every base span replaced by its kind in brackets and disclosing terms removed or generalised.

    Overlapping spans are replaced together, under the kind of the first.  Other columns and rows stay as they are;
    so do texts without a base span, NULL and empty ones included.
    """
    terms = store(disclosing(docs, text_col, plan), "pii-found")
    columns = docs.columns
    # Working names that no column of the table has.
    base, key, found = (_unused(columns, name) for name in ("base", "text_key", "terms"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    possible = F.lit(False)
    for _, test, _ in _BASE:
        possible = possible | test(text)
    marked = docs.withColumn(base, F.when(possible, base_spans(text)))
    clean = marked.where(F.coalesce(F.size(base), F.lit(0)) <= 0).select(*columns)
    marked = marked.where(F.size(base) > 0).withColumn(key, F.concat_ws(":", F.xxhash64(text), F.length(text)))
    marked = marked.join(terms.select(F.col("text_key").alias(key), F.col("terms").alias(found)), key, "left")
    none = F.array().cast("array<struct<start:int,end:int,with:string>>")
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("with"))),
        F.coalesce(F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.when(s["sure"], "").otherwise("[TERM]").alias("with")
        )), none),
    ))

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, span["with"])).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return clean.unionByName(marked.withColumn(text_col, cleaned).select(*columns))


def _unused(columns: list[str], name: str) -> str:
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name
