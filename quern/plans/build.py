"""The whole job: pages to catalog, quarantine and index tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import audit, catalog, harvest, normalize, phrases, records, tfidf
from quern.sources.csv_tables import text_documents
from quern.sources.tables import store


@dataclass(frozen=True)
class Corpus:
    clean: DataFrame
    quarantine: DataFrame
    counts: DataFrame
    catalog: DataFrame


def recipe_records(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", name: str = "corpus"
) -> DataFrame:
    """Pages to flat records.  Every step is row-local, so nothing is shuffled up to here.

    Harvested pages and extracted recipes are written in between: a later filter then reads a column
    instead of being pushed down together with a copy of all that computes it.
    """
    harvested = store(harvest.harvest(pages, id_col, html_col), f"{name}-harvested")
    found = store(harvest.extract_recipes(harvested, id_col), f"{name}-extracted")
    recipes = found.where(F.col("source").isNotNull())
    recipes = records.process_instructions(records.parse_ingredients(recipes))
    return records.structure_records(records.as_documents(recipes))


def build_corpus(
    pages: DataFrame, image_template: str, id_col: str = "page_id", html_col: str = "html", name: str = "corpus"
) -> Corpus:
    """Clean rows, quarantine and counts over one written table of checked records, and the catalog, written by id."""
    structured = store(recipe_records(pages, id_col, html_col, name), f"{name}-records")
    kept = records.keep_first(structured).withColumn("ord", F.col("recipe_id"))
    checked = store(audit.with_errors(kept), f"{name}-checked")
    clean = audit.clean_rows(checked)
    stored = catalog.store_by_id(catalog.build_catalog(clean, image_template), f"{name}-catalog")
    return Corpus(clean, audit.anomalies(checked), audit.anomaly_counts(checked), stored)


def text_index(clean: DataFrame, lexicon: DataFrame, name: str = "text") -> tfidf.TextIndex:
    """Index of the normalised text of clean records."""
    names = F.transform(F.from_json("ingredients", "array<struct<name:string>>"), lambda item: item["name"])
    listed = clean.withColumns({"names": names, "sentences": F.from_json("instructions", "array<string>")})
    normal = normalize.normalise_records(listed, "names", "sentences", lexicon, "recipe_id")
    return tfidf.build_index(text_documents(normal), "doc_id", "text", name=name)


def search_index(rows: DataFrame, name: str = "search", max_features: int | None = None) -> tfidf.TextIndex:
    """The catalog's own index: stemmed title, three times over, and ingredient names; all terms unless limited."""
    boosted = tfidf.boosted_text(catalog.search_corpus(rows), "title", "ingredients_text")
    return tfidf.build_index(boosted, "id", "text", tfidf.STEMS, max_features=max_features, name=name)


def suggestion_index(rows: DataFrame, name: str = "suggest") -> phrases.PhraseIndex:
    """Autocomplete tables from catalog titles and ingredient names."""
    named = rows.withColumn("names", F.transform("ingredients", lambda item: item["name"]))
    return phrases.build_phrase_index(phrases.training_phrases(named, "id", "title", "names"), name)
