"""Whole heading records from XML: every kind in one scan, and records that are held in a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import parse_month, publication_date, xml_unescape
from loomgraph.sources.files import ARTICLE, DATE, article_columns

# The fields of the XML records.
NAME = "STRUCT<String: STRING>"
QUALIFIER = f"STRUCT<QualifierUI: STRING, QualifierName: {NAME}>"
#: Columns of a record, of its headings (mapped and indexed), its concepts, their relations and terms, and the elements that they are made of.
HEADINGS = {"ui": "DescriptorReferredTo.DescriptorUI: STRING", "name": f"DescriptorReferredTo.DescriptorName: {NAME}", "qualifiers": f"QualifierReferredTo: ARRAY<{QUALIFIER}>"}
RELATIONS = {"ui": "Concept2UI: STRING", "name": "_RelationName: STRING"}
TERMS = {"ui": "TermUI: STRING", "name": "String: STRING", "preferred": "_ConceptPreferredTermYN: STRING"}
CONCEPTS = {
    "ui": "ConceptUI: STRING", "name": f"ConceptName: {NAME}", "preferred": "_PreferredConceptYN: STRING", "regno": "RegistryNumber: STRING", "cas_name": "CASN1Name: STRING", "note": "ScopeNote: STRING",
    "related": "RelatedRegistryNumberList: STRUCT<RelatedRegistryNumber: ARRAY<STRING>>", "relations": "ConceptRelationList: STRUCT<ConceptRelation: ARRAY<{relation}>>", "terms": "TermList: STRUCT<Term: ARRAY<{term}>>",
}
RECORD = {
    "ui": "DescriptorUI STRING, QualifierUI STRING, SupplementalRecordUI STRING", "name": f"DescriptorName {NAME}, QualifierName {NAME}, SupplementalRecordName {NAME}", "created": f"DateCreated {DATE}", "revised": f"DateRevised {DATE}",
    "established": f"DateEstablished {DATE}", "annotation": "Annotation STRING", "note": "Note STRING", "freq": "Frequency INT", "tree_numbers": "TreeNumberList STRUCT<TreeNumber: ARRAY<STRING>>",
    "allowed": f"AllowableQualifiersList STRUCT<AllowableQualifier: ARRAY<STRUCT<QualifierReferredTo: STRUCT<QualifierUI: STRING, QualifierName: {NAME}>, Abbreviation: STRING>>>",
    "mapped": "HeadingMappedToList STRUCT<HeadingMappedTo: ARRAY<{heading}>>", "indexed": "IndexingInformationList STRUCT<IndexingInformation: ARRAY<{heading}>>", "concepts": "ConceptList STRUCT<Concept: ARRAY<{concept}>>", "bad": "_bad STRING",
}
PARTS = {"headings": HEADINGS, "relations": RELATIONS, "terms": TERMS, "concepts": CONCEPTS}
#: All columns, and those that the nodes and the edges of a record graph are made of.
ALL = ("kind", *RECORD, *[f"{part}.{c}" for part, fields in PARTS.items() for c in fields])
_LISTS = ("ui", "mapped", "indexed", "concepts", "headings.ui", "concepts.ui", "concepts.relations", "concepts.terms", "relations.ui", "terms.ui")
NODES = ("name", "kind", *_LISTS, "concepts.name", "terms.name")
EDGES = (*_LISTS, "headings.qualifiers", "concepts.preferred", "relations.name", "terms.preferred")
ACTION = f"DescriptorReferredTo STRUCT<DescriptorUI: STRING, DescriptorName: {NAME}>, PharmacologicalActionSubstanceList STRUCT<Substance: ARRAY<STRUCT<RecordUI: STRING, RecordName: {NAME}>>>, _bad STRING"
KINDS = {"Descriptor": "Descriptor", "Qualifier": "Qualifier", "Supplemental": "SupplementalDescriptor"}
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, xml) of the descriptor, qualifier and supplemental records of the files below a path, in one scan that Spark splits.

    Files are read as texts that end where a tag ends in ``Record>``; one that ends in an end tag is a record, with its start tag in it or (without attributes) cut off with the text before.
    What comes before a record (declarations, a document type with what it refers to) is not looked at.
    """
    value = F.coalesce("value", F.lit(""))  # never null, so that no filter on nulls is put before what is made of it
    ends = reduce(Column.__or__, [F.endswith("value", F.lit(f"</{tag}")) for tag in KINDS])
    texts = spark.read.option("lineSep", "Record>").text(path).filter(ends).select(value.alias("value"), F.substring_index(value, "</", -1).alias("tag"))
    texts = texts.withColumn("opened", F.regexp_extract("value", r"(?s)<(?:Descriptor|Qualifier|Supplemental)Record\s.*", 0))
    whole = F.when(F.col("opened") != "", F.col("opened")).otherwise(F.concat(F.lit("<"), "tag", F.lit("Record>"), "value"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return texts.select(kinds[F.col("tag")].alias("kind"), F.concat(whole, F.lit("Record>")).alias("xml"))


def _list(c: Column, empty: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{empty}>"))


def _schema(columns: Sequence[str]) -> str:
    """The elements that some columns of a record are made of. The parser's work grows with the elements that it is to find, not only with the text."""
    found = {part: [f for c, f in fields.items() if f"{part}.{c}" in columns] for part, fields in PARTS.items()}
    referred = [f.partition(".")[2] for f in found["headings"] if f.startswith("DescriptorReferredTo.")]
    heading = [*([f"DescriptorReferredTo: STRUCT<{', '.join(referred)}>"] if referred else []), *[f for f in found["headings"] if not f.startswith("DescriptorReferredTo.")]]
    struct = lambda fields: f"STRUCT<{', '.join(fields)}>"
    concept = struct(found["concepts"]).format(relation=struct(found["relations"]), term=struct(found["terms"]))
    return ", ".join(f.format(heading=struct(heading), concept=concept) for c, f in RECORD.items() if c in columns)


def _struct(part: str, columns: Sequence[str], made: dict[str, Callable[[], Column]]) -> Column:
    return F.struct(*[c().alias(name) for name, c in made.items() if f"{part}.{name}" in columns])


def _headings(c: str, columns: Sequence[str]) -> Column:
    one = lambda h: _struct("headings", columns, {
        "ui": lambda: F.regexp_replace(h["DescriptorReferredTo"]["DescriptorUI"], r"^\*", ""), "name": lambda: h["DescriptorReferredTo"]["DescriptorName"]["String"],
        "qualifiers": lambda: F.transform(_list(h["QualifierReferredTo"], QUALIFIER), lambda q: F.coalesce(q["QualifierName"]["String"], q["QualifierUI"])),
    })
    return F.transform(c, one)


def _concepts(columns: Sequence[str]) -> Column:
    relation = lambda r: _struct("relations", columns, {"ui": lambda: r["Concept2UI"], "name": lambda: r["_RelationName"]})
    term = lambda t: _struct("terms", columns, {"ui": lambda: t["TermUI"], "name": lambda: t["String"], "preferred": lambda: t["_ConceptPreferredTermYN"] == "Y"})
    held = lambda part: f"STRUCT<{', '.join(f for c, f in PARTS[part].items() if f'{part}.{c}' in columns)}>"
    one = lambda c: _struct("concepts", columns, {
        "ui": lambda: c["ConceptUI"], "name": lambda: c["ConceptName"]["String"], "preferred": lambda: F.coalesce(c["_PreferredConceptYN"] == "Y", F.lit(False)), "regno": lambda: F.nullif(c["RegistryNumber"], F.lit("0")), "cas_name": lambda: c["CASN1Name"],
        "note": lambda: c["ScopeNote"], "related": lambda: _list(c["RelatedRegistryNumberList"]["RelatedRegistryNumber"], "string"),
        "relations": lambda: F.transform(F.filter(_list(c["ConceptRelationList"]["ConceptRelation"], held("relations")), lambda r: r["Concept2UI"] != c["ConceptUI"]), relation), "terms": lambda: F.transform(_list(c["TermList"]["Term"], held("terms")), term),
    })
    return F.transform("r.ConceptList.Concept", one)


def _date(c: str) -> Column:
    return publication_date(F.col(f"r.{c}.Year"), parse_month(F.col(f"r.{c}.Month")), F.col(f"r.{c}.Day"))


def parsed_records(rows: DataFrame, xml_col: str, kind_col: str, columns: Sequence[str] = ALL) -> DataFrame:
    """The columns of a record (ui, name, kind, created, revised, established, annotation, note, freq, tree_numbers, allowed, mapped, indexed, concepts) for each text of a column, and ``bad``: the text of one that
    isn't well formed (its other columns but kind are null); null texts give no row. With ``columns`` only those, in the same order (what lists hold is named with their part; relations need their ui and that of the concept); ``NODES`` and ``EDGES`` have those of graphs.

    A registry number 0 is none; a relation counts for the concept that is not its second; a ``*`` before a ui is no part of it; what a record doesn't say is null, and absent lists within concepts are empty.
    """
    found = rows.filter(F.col(xml_col).isNotNull()).select(F.col(kind_col).alias("kind"), F.from_xml(xml_col, _schema(columns), PERMISSIVE if "bad" in columns else {"mode": "PERMISSIVE"}).alias("r"))
    first = lambda field: F.coalesce(*[F.col(f"r.{p}{field}") for p in ("Descriptor", "Qualifier", "SupplementalRecord")])
    allowed = lambda q: F.struct(q["QualifierReferredTo"]["QualifierUI"].alias("ui"), q["QualifierReferredTo"]["QualifierName"]["String"].alias("name"), q["Abbreviation"].alias("abbr"))
    made = {
        "ui": lambda: first("UI"), "name": lambda: first("Name.String"), "kind": lambda: F.col("kind"), "created": lambda: _date("DateCreated"), "revised": lambda: _date("DateRevised"), "established": lambda: _date("DateEstablished"), "annotation": lambda: F.col("r.Annotation"),
        "note": lambda: F.col("r.Note"), "freq": lambda: F.col("r.Frequency"), "tree_numbers": lambda: F.col("r.TreeNumberList.TreeNumber"), "allowed": lambda: F.transform("r.AllowableQualifiersList.AllowableQualifier", allowed),
        "mapped": lambda: _headings("r.HeadingMappedToList.HeadingMappedTo", columns), "indexed": lambda: _headings("r.IndexingInformationList.IndexingInformation", columns), "concepts": lambda: _concepts(columns), "bad": lambda: F.col("r._bad"),
    }
    return found.select(*[c().alias(name) for name, c in made.items() if name in columns])


def heading_records(spark: SparkSession, path: str, columns: Sequence[str] = ALL) -> DataFrame:
    """All records of the files below a path, of every kind, with what ``record_graph`` takes and more (or some ``columns``); those that aren't well formed have only their kind and ``bad``."""
    return parsed_records(record_texts(spark, path), "xml", "kind", columns)


def action_records(spark: SparkSession, path: str) -> DataFrame:
    """(ui, name, substances: array of ui and name, bad) of pharmacological actions."""
    texts = spark.read.option("lineSep", "</PharmacologicalAction>").text(path).select(F.regexp_extract("value", r"(?s)<PharmacologicalAction[\s>].*", 0).alias("x")).filter("x != ''")
    found = texts.select(F.from_xml(F.concat("x", F.lit("</PharmacologicalAction>")), ACTION, PERMISSIVE).alias("a"))
    substances = F.transform("a.PharmacologicalActionSubstanceList.Substance", lambda s: F.struct(s["RecordUI"].alias("ui"), s["RecordName"]["String"].alias("name")))
    return found.select(F.col("a.DescriptorReferredTo.DescriptorUI").alias("ui"), F.col("a.DescriptorReferredTo.DescriptorName.String").alias("name"), substances.alias("substances"), F.col("a._bad").alias("bad"))


def articles_of(rows: DataFrame, xml_col: str) -> DataFrame:
    """rows with the columns of an article (pmid, title, …) in place of its text, and ``bad``: the text of one that isn't well formed. A null text has nulls."""
    found = rows.withColumn("_a", F.from_xml(xml_col, f"{ARTICLE}, _bad STRING", PERMISSIVE))
    kept = [c for c in rows.columns if c != xml_col]
    return found.select(*kept, "_a.*").select(*kept, *article_columns(), F.col("_bad").alias("bad"))


def resolved_xml(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the fields of a schema in place of a service's answer: XML that may stand escaped in a page, with a document type before it. Answers that aren't well formed, and null ones, have nulls."""
    found = rows.withColumn("_x", F.from_xml(F.trim(xml_unescape(F.col(column))), schema, {"mode": "PERMISSIVE"}))
    return found.select(*[c for c in rows.columns if c != column], "_x.*")
