"""File sources: XML, OBO, delimited and HTML files as DataFrames, all through Spark's readers."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import labelled_text, parse_month, publication_date, thousands_int

# Field types of the XML records.
DATE = "STRUCT<Year: INT, Month: STRING, Day: INT>"
TERM = "STRUCT<TermUI: STRING, String: STRING>"
CONCEPT = f"STRUCT<ConceptUI: STRING, ConceptName: STRUCT<String: STRING>, RegistryNumber: STRING, ScopeNote: STRING, _PreferredConceptYN: STRING, TermList: STRUCT<Term: ARRAY<{TERM}>>>"
DESCRIPTOR = (
    f"DescriptorUI STRING, DescriptorName STRUCT<String: STRING>, DateCreated {DATE}, DateRevised {DATE}, TreeNumberList STRUCT<TreeNumber: ARRAY<STRING>>, "
    f"ConceptList STRUCT<Concept: ARRAY<{CONCEPT}>>"
)
QUALIFIER = "QualifierUI STRING, QualifierName STRUCT<String: STRING>, Annotation STRING, TreeNumberList STRUCT<TreeNumber: ARRAY<STRING>>"
SUPPLEMENTAL = "SupplementalRecordUI STRING, SupplementalRecordName STRUCT<String: STRING>, Note STRING, Frequency INT, HeadingMappedToList STRUCT<HeadingMappedTo: ARRAY<STRUCT<DescriptorReferredTo: STRUCT<DescriptorUI: STRING>>>>"
ACTION = "DescriptorReferredTo STRUCT<DescriptorUI: STRING, DescriptorName: STRUCT<String: STRING>>, PharmacologicalActionSubstanceList STRUCT<Substance: ARRAY<STRUCT<RecordUI: STRING, RecordName: STRUCT<String: STRING>>>>"
NAMED = "STRUCT<_VALUE: STRING, _UI: STRING, _MajorTopicYN: STRING>"
ARTICLE = (
    "MedlineCitation STRUCT<PMID: STRUCT<_VALUE: BIGINT>, Article: STRUCT<ArticleTitle: STRING, Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>, "
    f"Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: {DATE}>>>, ChemicalList: STRUCT<Chemical: ARRAY<STRUCT<NameOfSubstance: {NAMED}>>>, "
    f"MeshHeadingList: STRUCT<MeshHeading: ARRAY<STRUCT<DescriptorName: {NAMED}, QualifierName: ARRAY<{NAMED}>>>>>, "
    "PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>"
)
STUDY = "nct_id STRING, title STRING, status STRING, study_results STRING, condition ARRAY<STRING>, phase ARRAY<STRING>, enrollment INT, study_types STRING"


def xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of one tag; compressed files are read as they are, and external DTDs aren't followed."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _date(c: str) -> Column:
    return publication_date(F.col(f"{c}.Year"), parse_month(F.col(f"{c}.Month")), F.col(f"{c}.Day"))


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """ui, name, created, revised, tree_numbers, concepts of descriptor records; a registry number 0 is none."""
    concepts = F.transform("ConceptList.Concept", lambda c: F.struct(
        c["ConceptUI"].alias("ui"), c["ConceptName"]["String"].alias("name"), (c["_PreferredConceptYN"] == "Y").alias("preferred"),
        F.nullif(c["RegistryNumber"], F.lit("0")).alias("regno"), c["ScopeNote"].alias("note"), F.transform(c["TermList"]["Term"], lambda t: F.struct(t["TermUI"].alias("ui"), t["String"].alias("name"))).alias("terms"),
    ))
    rows = xml(spark, path, "DescriptorRecord", DESCRIPTOR)
    return rows.select(F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("name"), _date("DateCreated").alias("created"), _date("DateRevised").alias("revised"), F.col("TreeNumberList.TreeNumber").alias("tree_numbers"), concepts.alias("concepts"))


def qualifiers(spark: SparkSession, path: str) -> DataFrame:
    return xml(spark, path, "QualifierRecord", QUALIFIER).select(F.col("QualifierUI").alias("ui"), F.col("QualifierName.String").alias("name"), F.col("Annotation").alias("annotation"), F.col("TreeNumberList.TreeNumber").alias("tree_numbers"))


def supplements(spark: SparkSession, path: str) -> DataFrame:
    mapped = F.transform("HeadingMappedToList.HeadingMappedTo", lambda m: F.regexp_replace(m["DescriptorReferredTo"]["DescriptorUI"], r"^\*", ""))
    return xml(spark, path, "SupplementalRecord", SUPPLEMENTAL).select(F.col("SupplementalRecordUI").alias("ui"), F.col("SupplementalRecordName.String").alias("name"), F.col("Note").alias("note"), F.col("Frequency").alias("freq"), mapped.alias("mapped"))


def actions(spark: SparkSession, path: str) -> DataFrame:
    return xml(spark, path, "PharmacologicalAction", ACTION).select(F.col("DescriptorReferredTo.DescriptorUI").alias("ui"), F.col("DescriptorReferredTo.DescriptorName.String").alias("name"), F.col("PharmacologicalActionSubstanceList.Substance.RecordUI").alias("substances"))


def preferred_concept(concepts: Column) -> Column:
    return F.get(F.filter(concepts, lambda c: c["preferred"]), F.lit(0))


def mesh_entries(spark: SparkSession, descriptor_path: str, qualifier_path: str, supplement_path: str) -> DataFrame:
    """ui, name, kind, tree_numbers of all kinds of records in one table."""
    kinds = [(descriptors(spark, descriptor_path), "Descriptor"), (qualifiers(spark, qualifier_path), "Qualifier"), (supplements(spark, supplement_path).withColumn("tree_numbers", F.array().cast("array<string>")), "SupplementalDescriptor")]
    out = None
    for rows, kind in kinds:
        part = rows.select("ui", "name", F.lit(kind).alias("kind"), "tree_numbers")
        out = part if out is None else out.unionByName(part)
    return out


def tree_rows(entries: DataFrame) -> DataFrame:
    """ui, quoted name, tree number: one row a tree number."""
    return entries.select("ui", F.concat(F.lit('"'), "name", F.lit('"')).alias("name"), F.explode("tree_numbers").alias("tree_number"))


def article_columns() -> list[Column]:
    """The columns of an article from the fields of its record."""
    c, a = "MedlineCitation", "MedlineCitation.Article"
    ids = F.map_from_entries(F.transform("PubmedData.ArticleIdList.ArticleId", lambda x: F.struct(x["_IdType"], x["_VALUE"])))
    headings = F.transform(f"{c}.MeshHeadingList.MeshHeading", lambda h: F.struct(
        h["DescriptorName"]["_UI"].alias("descriptor"), (h["DescriptorName"]["_MajorTopicYN"] == "Y").alias("major"), F.coalesce(F.transform(h["QualifierName"], lambda q: q["_UI"]), F.array().cast("array<string>")).alias("qualifiers")))
    return [
        F.col(f"{c}.PMID._VALUE").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.transform(f"{a}.Abstract.AbstractText", lambda t: labelled_text(t["_Label"], t["_VALUE"])).alias("abstract"),
        F.col(f"{a}.Journal.Title").alias("journal"), _date(f"{a}.Journal.JournalIssue.PubDate").alias("date"), ids["doi"].alias("doi"), ids["pmc"].alias("pmc"), headings.alias("headings"),
        F.transform(f"{c}.ChemicalList.Chemical", lambda x: x["NameOfSubstance"]["_UI"]).alias("chemicals"),
    ]


def articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract (labelled parts), journal, date, doi, pmc, headings, chemicals."""
    return xml(spark, path, "PubmedArticle", ARTICLE).select(*article_columns())


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """id, name, synonyms, is_a, xref, alt_id of the [Term] stanzas; the last needs no blank line after it."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value").startswith("[Term]"))
    lines = stanza.select(F.xxhash64("value").alias("k"), F.posexplode(F.split("value", "\n"))).filter(F.instr("col", ":") > 1)
    fields = lines.select("k", "pos", F.substring_index("col", ":", 1).alias("key"), F.trim(F.regexp_replace("col", "^[^:]*:", "")).alias("v"))
    many = lambda key: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("key") == key, F.struct("pos", "v"))))), lambda x: x["v"])
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("v"))).alias(key)
    grouped = fields.groupBy("k").agg(one("id"), one("name"), many("synonym").alias("synonym"), many("is_a").alias("is_a"), many("xref").alias("xref"), many("alt_id").alias("alt_id"))
    return grouped.select("id", "name", F.transform("synonym", lambda s: F.regexp_extract(s, '"([^"]+)', 1)).alias("synonyms"), F.transform("is_a", lambda s: F.trim(F.substring_index(s, "!", 1))).alias("is_a"), "xref", "alt_id")


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """Named string columns of a delimited file; rows with another number of fields are left out."""
    rows = spark.read.text(path)
    parts = F.split("value", "\\|" if sep == "|" else sep, -1)
    out = rows.select(parts.alias("p")).filter(F.size("p") == len(columns)).select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])
    return out.filter(~F.lower(columns[0]).isin(columns[0].lower(), f"#{columns[0].lower()}")) if header else out


def semantic_types(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, ["abbr", "id", "name"], "|")


def find_semantic_type(types: DataFrame, text: str) -> DataFrame:
    return types.filter((F.lower("abbr") == text.lower()) | (F.lower("id") == text.lower())).orderBy("abbr", "id").limit(1)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """disease id (db:id), name, phenotype, xref, type of a tab file without header; more columns are ignored."""
    rows = spark.read.option("sep", "\t").csv(path)
    return rows.select(F.concat_ws(":", "_c0", "_c1").alias("disease"), F.col("_c2").alias("name"), F.col("_c4").alias("phenotype"), F.col("_c5").alias("xref"), F.col("_c6").alias("type"))


def phenotype_genes(spark: SparkSession, path: str) -> DataFrame:
    """phenotype and gene symbol; the first line is a header."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, gene = rows.columns[0], rows.columns[3]
    return rows.select(F.col(f"`{first}`").alias("phenotype"), F.col(f"`{gene}`").alias("gene"))


def studies(spark: SparkSession, path: str) -> DataFrame:
    """Interventional studies."""
    return xml(spark, path, "study", STUDY).filter(F.lower("study_types") == "interventional").filter("nct_id is not null")


def interventions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    if len(rows.columns) != 5:
        raise ValueError(f"{len(rows.columns)} columns in place of 5")
    nct, unii = rows.columns[0], rows.columns[2]
    return rows.select(F.col(f"`{nct}`").alias("nct_id"), F.col(f"`{unii}`").alias("unii")).filter("unii != 'FAKE_FOR_PLACEBO'").distinct()


def html_conditions(rows: DataFrame, column: str) -> DataFrame:
    """(name, count) of bracketed anchors ``[<a …">NAME</a> … "COUNT …]``."""
    body = r'\[<a [^>]*>([^<]*)</a>[^\]"]*"([0-9,]+)'
    found = F.regexp_extract_all(F.col(column), F.lit(rf"({body})"), 1)
    each = rows.select(F.explode(found).alias("a"))
    return each.select(F.regexp_extract("a", body, 1).alias("name"), thousands_int(F.regexp_extract("a", body, 2)).alias("count"))


def pmid_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("pmid")).filter("pmid is not null")


def zipped_lines(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(path, member, seq, value) of the lines of all files in the zip archives below a path, read in blocks; an archive is one task's. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as lines:
                            text, at = io.TextIOWrapper(lines, "utf-8", "replace", newline="\n"), 0
                            while some := [line.rstrip("\r\n") for line in text.readlines(block)]:
                                n = len(some)
                                yield pa.record_batch([pa.array([file] * n), pa.array([member] * n), pa.array(range(at, at + n), pa.int64()), pa.array(some)], ["path", "member", "seq", "value"])
                                at += n

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, seq long, value string")


def unii_names(spark: SparkSession, path: str) -> DataFrame:
    """(unii, name, seq) of the rows with four fields (name, type, unii, preferred name) of zipped tab files, in their order."""
    rows = zipped_lines(spark, path).select("seq", F.split("value", "\t", -1).alias("p")).filter("size(p) = 4")
    return rows.select(F.get("p", F.lit(2)).alias("unii"), F.get("p", F.lit(0)).alias("name"), "seq")


def file_registry(spark: SparkSession, path: str) -> DataFrame:
    """path, sha1 and length of the files below a path; a left-anti join with the table of loaded ones gives those to load."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"), "length")


def unloaded(registry: DataFrame, loaded: DataFrame) -> DataFrame:
    return registry.join(loaded.filter("count > 0").select("sha1"), "sha1", "left_anti")


def json_pages(spark, folder: str, schema: str) -> DataFrame:
    """Rows of stored pages of a service: every JSON file of a folder, with an array of objects each, in whatever store Spark reads."""
    return spark.read.schema(schema).json(folder, multiLine=True)
