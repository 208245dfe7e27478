"""Schemas of catalogue data.  Attributes with several values are arrays without nulls."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType(), False)

#: The five attributes that hold several values.
LIST_COLUMNS = ["keywords", "themes", "categories", "spatial_coverage", "temporal_coverage"]

DATASETS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("url", "title", "description", "provider")]
    + [T.StructField(c, _TEXTS) for c in LIST_COLUMNS]
    + [T.StructField("full_description_hash", T.StringType())]
)
DISTRIBUTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "dataset_url", "url", "file_format")])
JUDGMENTS = T.StructType([T.StructField("query", T.StringType()), T.StructField("url", T.StringType()), T.StructField("ranking", T.IntegerType())])

#: Source columns and their names here, of datasets and of distributions.
DATASET_NAMES = {
    "název": "title",
    "popis": "description",
    "datová_sada": "url",
    "klíčová_slova": "keywords",
    "téma": "themes",
    "poskytovatel": "provider",
    "prostorové_pokrytí": "spatial_coverage",
    "časové_pokrytí": "temporal_coverage",
}
DISTRIBUTION_NAMES = {"název": "title", "datová_sada": "dataset_url", "přístupovéUrl": "url", "formátSouboru": "file_format"}
#: Source columns that carry nothing of use.
IRRELEVANT_COLUMNS = [
    "kategorie_hvd_IRI",
    "kategorie_hvd_název",
    "je_součástí_IRI",
    "periodicita_aktualizace_IRI",
    "periodicita_aktualizace",
    "téma_IRI",
    "poskytovatel_IRI",
    "prostorové_pokrytí",
    "právní_předpis",
]
#: The closed vocabulary of categories, and what stands for none of them.
CATEGORIES = [
    "Zemědělství, rybolov, lesnictví a výživa",
    "Vzdělávání, kultura a sport",
    "Životní prostředí",
    "Energie",
    "Doprava",
    "Věda a technika",
    "Hospodářství a finance",
    "Populace a společnost",
    "Zdraví",
    "Vláda a veřejný sektor",
    "Regiony a města",
    "Spravedlnost, právní systém a veřejná bezpečnost",
    "Mezinárodní otázky",
]
OTHER_CATEGORY = "Jiné"
