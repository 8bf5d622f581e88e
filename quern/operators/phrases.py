"""Autocomplete: phrases, completions and words, and ranked suggestions for a batch of queries.

Completions form a trie.  A node with more phrases than a list holds has its list stored: the best phrases below it,
merged from the lists of its children.  What begins with any other prefix is a short range of the sorted phrases, and
is read from there.  So a prefix costs about one list, however many phrases it has.

Words are posting lists over phrases numbered by rank.  A rare stem has rows; a frequent one has bitmaps of 32,768
numbers each.  Several stems are intersected from the rows of the rare ones, which are then looked up in the bitmaps of
the others, or by the bitmaps alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text
from quern.operators.retrieve import best_rows
from quern.operators.skew import BROADCAST_ROWS, broadcast_if_small, settle
from quern.sources.tables import store

DEFAULT_LIMIT = 15
# Up to this many distinct keys of a batch travel as literals; beyond it the join alone finds the same rows.
PUSHED_KEYS = 500


# Up to this many prefixes travel as literals.
PUSHED_PREFIXES = 100
# Phrases of a stored list; longer answers are read from the phrases themselves.
LISTED = 100
# Levels of the trie that one job handles.
STRIDE = 8
# Phrases of a stem from which on it has bitmaps instead of rows.
BITMAP_ROWS = 4096


@dataclass(frozen=True)
class PhraseIndex:
    """``phrases(phrase, cnt, sources, stemmed)`` and ``spoken(word, phrase, cnt)``, in ranges of their first column.

    ``lists`` and ``word_lists`` ``(prefix, phrase, cnt, rank)`` have the best ``listed`` phrases of every prefix, of a
    phrase or a word in it, that has more; they are missing where none has.  ``stems(stem, number, phrase, cnt)`` has the
    phrases of rare stems, ``bitmaps(stem, bucket, bits)`` those of frequent ones (missing without any), and
    ``numbered(number, phrase, cnt)`` what the numbers stand for: they follow count and alphabet.
    """

    phrases: DataFrame
    documents: DataFrame
    spoken: DataFrame
    numbered: DataFrame
    stems: DataFrame
    bitmaps: DataFrame | None
    lists: DataFrame | None
    word_lists: DataFrame | None
    listed: int = LISTED

    @property
    def prefixes(self) -> DataFrame:
        return prefix_table(self.phrases)

    @property
    def words(self) -> DataFrame:
        return word_table(self.phrases)


def training_phrases(records: DataFrame, id_col: str, title_col: str, names_col: str) -> DataFrame:
    """``(doc_id, pos, text, source)``: the title, then each ingredient name; blank phrases go."""
    title = F.array(F.struct(F.col(title_col).alias("text"), F.lit("title").alias("source")))
    names = F.transform(names_col, lambda name: F.struct(name.alias("text"), F.lit("ingredient").alias("source")))
    listed = records.select(F.col(id_col).alias("doc_id"), F.posexplode(F.concat(title, names)).alias("pos", "entry"))
    normal = listed.select("doc_id", "pos", text.normal_phrase(F.col("entry.text")).alias("text"), "entry.source")
    return normal.where(F.col("text") != "")


def phrase_counts(documents: DataFrame) -> DataFrame:
    """``(phrase, cnt, sources, first)``; ``first`` is where the phrase appears first."""
    return documents.groupBy(F.col("text").alias("phrase")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )


def one_per_stem(counted: DataFrame) -> DataFrame:
    """Keep the most frequent phrase of each fully stemmed form; earlier appearance decides ties."""
    stemmed = counted.withColumn("stemmed", text.stem_phrase(F.col("phrase")))
    best = Window.partitionBy("stemmed").orderBy(F.desc("cnt"), "first")
    return stemmed.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == 1).drop("nth", "first")


def prefix_table(phrases: DataFrame) -> DataFrame:
    """``(prefix, phrase, cnt)`` for every character prefix."""
    cuts = F.transform(F.sequence(F.lit(1), F.length("phrase")), lambda n: F.substr(F.col("phrase"), F.lit(1), n))
    return phrases.select(F.explode(cuts).alias("prefix"), "phrase", "cnt")


def word_table(phrases: DataFrame) -> DataFrame:
    """``(stem, phrase, cnt)`` for every distinct word stem of a phrase."""
    return phrases.select(F.explode(F.array_distinct(F.split("stemmed", " "))).alias("stem"), "phrase", "cnt")


def spoken_table(phrases: DataFrame) -> DataFrame:
    """``(word, phrase, cnt)`` for every distinct word of a phrase."""
    found = F.filter(F.array_distinct(F.split("phrase", " ")), lambda word: word != "")
    return phrases.select(F.explode(found).alias("word"), "phrase", "cnt")


def _cuts(key: str, lengths: Column) -> Column:
    """The prefixes of the given lengths that a text has."""
    fitting = F.filter(lengths, lambda n: n <= F.length(key))
    return F.transform(fitting, lambda n: F.substr(F.col(key), F.lit(1), n))


def _levels(low: int, high: int) -> Column:
    return F.array(*[F.lit(n) for n in range(low, high + 1)])


def _heavy_nodes(entries: DataFrame, key: str, listed: int, name: str) -> list[DataFrame]:
    """``prefix`` of every node with more than ``listed`` entries, in strides of levels from the root on.

    A node has no more than its parent, so only what lies below the deepest heavy nodes is counted on.
    """
    found: list[DataFrame] = []
    under = entries
    while True:
        low = len(found) * STRIDE + 1
        nodes = under.select(F.explode(_cuts(key, _levels(low, low + STRIDE - 1))).alias("prefix"))
        nodes = store(nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > listed).select("prefix"), f"{name}-heavy")
        if nodes.isEmpty():
            return found
        found.append(nodes)
        deepest = nodes.where(F.length("prefix") == low + STRIDE - 1)
        under = entries.withColumn("prefix", F.substr(F.col(key), F.lit(1), F.lit(low + STRIDE - 1))).join(deepest, "prefix", "left_semi").drop("prefix")


def completion_lists(entries: DataFrame, key: str, listed: int = LISTED, name: str = "lists") -> DataFrame | None:
    """``(prefix, phrase, cnt, rank)``: the best ``listed`` phrases of every prefix of ``key`` that more entries have.

    ``entries`` holds ``key``, ``phrase`` and ``cnt``.  Every entry enters at its deepest heavy node; from there on only
    the lists of nodes move up, stride by stride.  A phrase that reaches a node by several keys is listed once.
    """
    strides = _heavy_nodes(entries, key, listed, name)
    if not strides:
        return None
    heavy = reduce(DataFrame.unionByName, strides)
    cut = entries.select(F.col(key).alias("_key"), "phrase", "cnt").select("phrase", "cnt", F.explode(_cuts("_key", _levels(1, len(strides) * STRIDE))).alias("prefix"), "_key")
    homes = cut.join(heavy, "prefix", "left_semi").groupBy("_key", "phrase", "cnt").agg(F.max(F.length("prefix")).alias("home"))
    homes = store(homes.select(F.expr("left(_key, home)").alias("prefix"), "phrase", "cnt"), f"{name}-homes")
    out, below = [], None
    for at in reversed(range(len(strides))):
        low, high = at * STRIDE + 1, (at + 1) * STRIDE
        rows = homes.where(F.length("prefix").between(low, high))
        if below is not None:
            rows = rows.unionByName(below.where(F.length("prefix") == high + 1).select("prefix", "phrase", "cnt"))
        rows = rows.select("phrase", "cnt", F.explode(_cuts("prefix", _levels(low, high))).alias("node")).withColumnRenamed("node", "prefix")
        if key != "phrase":
            rows = rows.distinct()
        below = store(best_rows(rows, "prefix", [F.desc("cnt"), F.col("phrase")], listed, "phrase"), f"{name}-level")
        out.append(below)
    lists = reduce(DataFrame.unionByName, out).select("prefix", "phrase", "cnt", "rank")
    return store(lists.repartitionByRange("prefix", "rank"), name, ["prefix", "rank"])


def _stem_postings(numbered: DataFrame, bitmap_rows: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of rare stems, and bitmaps of frequent ones."""
    rows = numbered.select(F.explode(F.array_distinct(F.split("stemmed", " "))).alias("stem"), "number", "phrase", "cnt")
    frequent = store(rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bitmap_rows).select("stem"), f"{name}-frequent")
    bitmaps = None
    rare = rows
    if not frequent.isEmpty():
        rare = rows.join(frequent, "stem", "left_anti")
        dense = rows.select("stem", _bucket(F.col("number")).alias("bucket"), F.bitmap_bit_position(F.col("number") + 1).alias("position"))
        dense = dense.join(frequent, "stem", "left_semi").groupBy("stem", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        bitmaps = store(dense.repartitionByRange("stem", "bucket"), f"{name}-bitmaps", ["stem", "bucket"])
    return store(rare.repartitionByRange("stem", "number"), f"{name}-stems", ["stem", "number"]), bitmaps


def _bucket(number: Column) -> Column:
    return F.bitmap_bucket_number(number + 1)


def build_phrase_index(documents: DataFrame, name: str = "phrases", listed: int = LISTED, bitmap_rows: int = BITMAP_ROWS) -> PhraseIndex:
    """Train on ``(doc_id, pos, text, source)`` rows and write the tables.

    ``listed`` and ``bitmap_rows`` change what queries read, never what they find.
    """
    # The phrases come out of a grouping that is read once; their ranges are cut from the written rows.
    counted = store(one_per_stem(phrase_counts(documents)), f"{name}-counted")
    phrases = store(counted.repartitionByRange("phrase"), f"{name}-phrases", ["phrase"])
    ranked = counted.select("phrase", "cnt", "stemmed").repartitionByRange(F.desc("cnt"), F.col("phrase")).sortWithinPartitions(F.desc("cnt"), "phrase")
    numbered = store(ranked.withColumn("number", F.monotonically_increasing_id()), f"{name}-numbered")
    stems, bitmaps = _stem_postings(numbered, bitmap_rows, name)
    spoken = store(spoken_table(phrases).repartitionByRange("word", "phrase"), f"{name}-spoken", ["word", "phrase"])
    return PhraseIndex(
        phrases, documents, spoken, numbered.drop("stemmed"), stems, bitmaps,
        completion_lists(phrases, "phrase", listed, f"{name}-lists"), completion_lists(spoken, "word", listed, f"{name}-word-lists"), listed,
    )


def phrase_facts(index: PhraseIndex) -> DataFrame:
    """``(fact, n)``: training rows, phrases, prefix entries, word entries."""
    facts = []
    for fact, table in (
        ("documents", index.documents), ("phrases", index.phrases),
        ("prefix_entries", index.prefixes), ("word_entries", index.words),
    ):
        facts.append(table.agg(F.lit(fact).alias("fact"), F.count(F.lit(1)).alias("n")))
    first, *others = facts
    for other in others:
        first = first.unionByName(other)
    return first


# --- Queries --------------------------------------------------------------------------------------------------
def prepare_queries(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(query_id, q, tokens, lead, last, stemmed_q, stems)`` of a query table."""
    normal = queries.select(F.col(id_col).alias("query_id"), text.normal_query(F.col(text_col)).alias("q"))
    normal = normal.withColumn("tokens", F.filter(F.split("q", " "), lambda token: token != ""))
    parted = normal.select(
        "query_id", "q", "tokens", F.get("tokens", F.size("tokens") - 1).alias("last"),
        F.array_join(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))), " ").alias("lead"),
    )
    stemmed = parted.withColumn("stem_lead", text.stem_phrase(F.col("lead")))
    single = F.size("tokens") == 1
    return stemmed.withColumns(
        {
            "stemmed_q": F.when(single, text.stem_phrase(F.col("q"))).otherwise(F.concat_ws(" ", "stem_lead", "last")),
            "stems": F.filter(F.array_distinct(F.split("stem_lead", " ")), lambda stem: stem != ""),
        }
    )


def _hinted(keys: DataFrame, few: bool) -> DataFrame:
    """Broadcast keys that are known to be few; count the others first."""
    return F.broadcast(keys) if few else broadcast_if_small(keys)


@dataclass(frozen=True)
class Asked:
    """The distinct keys of a small batch of queries, to be pushed to the tables as literals."""

    prefixes: frozenset[str]
    stems: frozenset[str]
    words: frozenset[str]
    tails: frozenset[str]


def asked_keys(rows: list[dict]) -> Asked:
    """What a batch of prepared queries will look up."""
    found = [row for row in rows if row["tokens"]]
    several = [row for row in found if len(row["tokens"]) > 1]
    return Asked(
        frozenset(key for row in found for key in (row["q"], row["stemmed_q"])),
        frozenset(stem for row in several for stem in row["stems"]),
        frozenset(row["q"] for row in found if len(row["tokens"]) == 1),
        frozenset(" ".join(row["tokens"][at:]) for row in several for at in range(1, len(row["tokens"]))),
    )


def _only(table: DataFrame, column: str, keys: frozenset[str] | None) -> DataFrame:
    """Rows with one of the keys, if these are few enough to be literals; the join that follows needs no others."""
    return table if keys is None or len(keys) > PUSHED_KEYS else table.where(F.col(column).isin(*sorted(keys)))


def _begun(table: DataFrame, column: str, keys: DataFrame, few: bool, pushed: frozenset[str] | None) -> DataFrame:
    """Every row of a table whose ``column`` begins with the ``prefix`` of a key, with the key."""
    lengths = F.sequence(F.lit(1), F.length(column))
    if pushed is not None:
        if not pushed:
            return table.where(F.lit(False)).select("phrase", "cnt", F.col(column).alias("prefix")).join(keys, "prefix")
        if len(pushed) <= PUSHED_PREFIXES:
            table = table.where(reduce(Column.__or__, [F.startswith(F.col(column), F.lit(key)) for key in sorted(pushed)]))
        lengths = F.array(*[F.lit(n) for n in sorted({len(key) for key in pushed})])
    rows = table.select("phrase", "cnt", F.explode(_cuts(column, lengths)).alias("prefix"))
    return rows.join(_hinted(keys, few), "prefix")


def heavy_among(lists: DataFrame | None, keys: frozenset[str] | None) -> frozenset[str] | None:
    """Which of a few prefixes have a stored list."""
    if lists is None or keys is None or len(keys) > PUSHED_KEYS:
        return None
    return frozenset(row.prefix for row in lists.where((F.col("rank") == 1) & F.col("prefix").isin(*sorted(keys))).select("prefix").collect())


def _completed(
    lists: DataFrame | None, table: DataFrame, column: str, keys: DataFrame, few: bool, pushed: frozenset[str] | None
) -> DataFrame:
    """As :func:`_begun`, but of prefixes with a stored list only that."""
    if lists is None:
        return _begun(table, column, keys, few, pushed)
    heavy = heavy_among(lists, pushed)
    listed = _only(lists, "prefix", heavy).join(_hinted(keys, few), "prefix").select("phrase", "cnt", *keys.columns)
    light = keys.join(lists.where(F.col("rank") == 1).select("prefix"), "prefix", "left_anti")
    rest = _begun(table, column, light, few, None if heavy is None else pushed - heavy)
    return listed.unionByName(rest.select(*listed.columns))


def prefix_matches(
    index: PhraseIndex, prepared: DataFrame, few: bool = False, asked: Asked | None = None, limit: int | None = None
) -> DataFrame:
    """Tier 1: phrases that start with the query.  Tier 2: with its words but the last one stemmed.

    With a ``limit``, here and in the other tiers: at least the best so many of each, all that a merged answer needs.
    """
    direct = F.struct(F.lit(1).alias("tier"), F.col("q").alias("prefix"))
    stemmed = F.when(F.col("stemmed_q") != F.col("q"), F.struct(F.lit(2).alias("tier"), F.col("stemmed_q").alias("prefix")))
    keys = prepared.where(F.size("tokens") > 0).select("query_id", F.inline(F.array_compact(F.array(direct, stemmed))))
    lists = index.lists if limit is not None and limit <= index.listed else None
    found = _completed(lists, index.phrases, "phrase", keys, few, asked and asked.prefixes)
    return found.select("query_id", "tier", "phrase", "cnt")


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def _set_numbers(rows: DataFrame) -> DataFrame:
    """The numbers that the bitmap ``bits`` of a ``bucket`` holds, one row each."""
    filled = F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda at: F.substr(F.col("bits"), at + 1, F.lit(1)) != F.lit(b"\0"))
    bytes_ = rows.where(F.bitmap_count("bits") > 0).withColumn("_at", F.explode(filled))
    each = bytes_.withColumn("_position", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("_at") * 8 + k)))
    each = each.where(_bit(F.col("bits"), F.col("_position")))
    return each.withColumn("number", (F.col("bucket") - 1) * 32768 + F.col("_position")).drop("bits", "bucket", "_at", "_position")


def phrase_word_matches(
    index: PhraseIndex, prepared: DataFrame, few: bool = False, asked: Asked | None = None, limit: int | None = None
) -> DataFrame:
    """Tier 3, several words: every complete word by stem, and some word that starts with the last."""
    stems = asked and asked.stems
    several = prepared.where(F.size("tokens") >= 2)
    keys = several.select("query_id", F.explode("stems").alias("stem"), F.size("stems").alias("needed"), "last")
    rows = _only(index.stems, "stem", stems).join(_hinted(keys, few), "stem")
    rare = rows.groupBy("query_id", "number", "needed", "last").agg(
        F.count(F.lit(1)).alias("found"), F.first("phrase").alias("phrase"), F.first("cnt").alias("cnt")
    )
    if index.bitmaps is None:
        full = rare.where(F.col("found") == F.col("needed"))
    else:
        bitmaps = _only(index.bitmaps, "stem", stems)
        dense = keys.join(_only(bitmaps.select("stem"), "stem", stems).distinct(), "stem", "left_semi")
        n_dense = dense.groupBy("query_id").agg(F.count(F.lit(1)).alias("dense"))
        rare = rare.join(n_dense, "query_id", "left").withColumn("dense", F.coalesce("dense", F.lit(0)))
        rare = rare.where(F.col("found") + F.col("dense") == F.col("needed"))
        # Rows of the rare stems first; each is looked up in the bitmaps of the frequent ones.
        looked = rare.where(F.col("dense") > 0).join(dense.select("query_id", "stem"), "query_id").withColumn("bucket", _bucket(F.col("number")))
        looked = looked.join(bitmaps, ["stem", "bucket"]).where(_bit(F.col("bits"), F.bitmap_bit_position(F.col("number") + 1)))
        held = looked.groupBy("query_id", "number", "phrase", "cnt", "last", "dense").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == F.col("dense"))
        # Frequent stems alone: whole bitmaps are intersected.
        both = bitmaps.join(_hinted(dense, few), "stem").groupBy("query_id", "bucket", "needed", "last").agg(
            F.count(F.lit(1)).alias("found"), F.bitmap_and_agg("bits").alias("bits")
        )
        numbers = _set_numbers(both.where(F.col("found") == F.col("needed")).select("query_id", "last", "bucket", "bits"))
        columns = ["query_id", "phrase", "cnt", "last"]
        full = rare.where(F.col("dense") == 0).select(*columns).unionByName(held.select(*columns)).unionByName(
            index.numbered.join(numbers, "number").select(*columns)
        )
    begins = F.exists(F.split("phrase", " "), lambda word: F.startswith(word, F.col("last")))
    return full.where(begins).select("query_id", F.lit(3).alias("tier"), "phrase", "cnt")


def word_prefix_matches(
    index: PhraseIndex, prepared: DataFrame, few: bool = False, asked: Asked | None = None, limit: int | None = None
) -> DataFrame:
    """Tier 3, one word: any word of the phrase starts with the query."""
    single = prepared.where(F.size("tokens") == 1).select("query_id", F.col("q").alias("prefix"))
    lists = index.word_lists if limit is not None and limit <= index.listed else None
    found = _completed(lists, index.spoken, "word", single, few, asked and asked.words)
    return found.select("query_id", F.lit(3).alias("tier"), "phrase", "cnt").distinct()


def trailing_matches(
    index: PhraseIndex, prepared: DataFrame, few: bool = False, asked: Asked | None = None, limit: int | None = None
) -> DataFrame:
    """Tier 4: the longest run of last words that some phrase starts with."""
    several = prepared.where(F.size("tokens") >= 2)
    slices = F.transform(
        F.sequence(F.lit(1), F.size("tokens") - 1),
        lambda n: F.struct(
            n.alias("words"),
            F.array_join(F.slice(F.col("tokens"), F.size("tokens") - n + 1, n), " ").alias("prefix"),
        ),
    )
    keys = several.select("query_id", F.inline(slices)).withColumn("tier", F.lit(4))
    lists = index.lists if limit is not None and limit <= index.listed else None
    hits = _completed(lists, index.phrases, "phrase", keys, few, asked and asked.tails)
    longest = hits.groupBy("query_id").agg(F.max("words").alias("words"))
    return hits.join(longest, ["query_id", "words"], "left_semi").select("query_id", "tier", "phrase", "cnt")


def merge_tiers(matches: DataFrame, limit: int) -> DataFrame:
    """Each phrase once, in its first tier; inside a tier by count, then alphabetically."""
    first = matches.groupBy("query_id", "phrase").agg(F.min("tier").alias("tier"), F.max("cnt").alias("cnt"))
    return best_rows(first, "query_id", [F.col("tier"), F.desc("cnt"), F.col("phrase")], limit, "phrase")


def most_frequent(index: PhraseIndex, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """What a blank query gets."""
    return index.phrases.orderBy(F.desc("cnt"), "phrase").limit(limit)


def suggest(
    index: PhraseIndex, queries: DataFrame | str, limit: int = DEFAULT_LIMIT,
    id_col: str = "query_id", text_col: str = "query",
) -> DataFrame:
    """``(query_id, rank, text, source)`` for one query text or a table of queries."""
    one = isinstance(queries, str)
    if one:
        queries = index.phrases.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(queries).alias("query"))
        id_col, text_col = "query_id", "query"
    # Both intermediate tables are as small as the batch; without them every tier would repeat the
    # stemming and the last tier would repeat the others.
    prepared, asked = settle(prepare_queries(queries, id_col, text_col), "suggest-queries", one)
    tokens = None if asked is None else asked["tokens"].to_pylist()
    few = tokens is not None and sum(map(len, tokens)) <= BROADCAST_ROWS
    keys = None if asked is None else asked_keys(asked.to_pylist())
    found = (
        prefix_matches(index, prepared, few, keys, limit)
        .unionByName(phrase_word_matches(index, prepared, few, keys, limit))
        .unionByName(word_prefix_matches(index, prepared, few, keys, limit))
    )
    ranked, hits = settle(merge_tiers(found, limit), "suggest-matches", one)
    if asked is None or hits is None or not set(asked["query_id"].to_pylist()) <= set(hits["query_id"].to_pylist()):
        unmatched = prepared.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
        tails = merge_tiers(trailing_matches(index, unmatched, few, keys, limit), limit)
        ranked, hits = settle(ranked.unionByName(tails), "suggest-ranked", one)
    if tokens is None or 0 in map(len, tokens):
        # A blank query gets the same few phrases as any other blank query.
        place = F.row_number().over(Window.orderBy(F.desc("cnt"), "phrase"))
        top = most_frequent(index, limit).withColumns({"rank": place, "tier": F.lit(0)})
        blank = prepared.where(F.size("tokens") == 0).select("query_id", F.lit(0).alias("tier"))
        shown = blank.join(F.broadcast(top), "tier").select("query_id", "phrase", "tier", "cnt", "rank")
        ranked, hits = settle(ranked.unionByName(shown), "suggest-ranked", one)
    named_phrases = None if hits is None else frozenset(hits["phrase"].to_pylist())
    labelled = _only(index.phrases, "phrase", named_phrases).select("phrase", F.array_join("sources", ", ").alias("source"))
    named = labelled.join(ranked, "phrase")
    return named.select("query_id", "rank", F.col("phrase").alias("text"), "source", "tier")
