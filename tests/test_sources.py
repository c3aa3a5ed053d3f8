import datetime
import gzip

from loomgraph.sources import files as S

DESCRIPTORS = """<?xml version="1.0"?><DescriptorRecordSet>
<DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Asthma</String></DescriptorName><DateCreated><Year>1999</Year><Month>01</Month><Day>02</Day></DateCreated>
<TreeNumberList><TreeNumber>C08.1</TreeNumber><TreeNumber>C20.2</TreeNumber></TreeNumberList>
<ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M1</ConceptUI><ConceptName><String>Asthma</String></ConceptName><RegistryNumber>0</RegistryNumber>
<TermList><Term><TermUI>T1</TermUI><String>Asthma</String></Term><Term><TermUI>T2</TermUI><String>Bronchial Asthma</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
</DescriptorRecordSet>"""
QUALIFIERS = "<Q><QualifierRecord><QualifierUI>Q1</QualifierUI><QualifierName><String>therapy</String></QualifierName></QualifierRecord></Q>"
SUPPLEMENTS = "<S><SupplementalRecord><SupplementalRecordUI>S1</SupplementalRecordUI><SupplementalRecordName><String>x</String></SupplementalRecordName><HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D1</DescriptorUI></DescriptorReferredTo></HeadingMappedTo></HeadingMappedToList></SupplementalRecord></S>"
ARTICLES = """<A><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract>
<Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year><Month>Mar</Month></PubDate></JournalIssue></Journal></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">Asthma</DescriptorName><QualifierName UI="Q1" MajorTopicYN="N">therapy</QualifierName></MeshHeading><MeshHeading><DescriptorName UI="D9" MajorTopicYN="N">No</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></A>"""
OBO = '''format-version: 1.2

[Term]
id: HP:1
name: All
alt_id: HP:9

[Term]
id: HP:2
name: Wheeze
synonym: "wheezing" EXACT []
synonym: "whistle" RELATED []
is_a: HP:1 ! All
xref: UMLS:C1'''


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_mesh(spark, tmp_path):
    d = S.descriptors(spark, put(tmp_path / "d.xml", DESCRIPTORS)).first()
    assert (d["ui"], d["created"], d["tree_numbers"], d["concepts"][0]["regno"]) == ("D1", datetime.date(1999, 1, 2), ["C08.1", "C20.2"], None)
    assert [t["name"] for t in d["concepts"][0]["terms"]] == ["Asthma", "Bronchial Asthma"]
    s = S.supplements(spark, put(tmp_path / "s.xml", SUPPLEMENTS)).first()
    assert s["mapped"] == ["D1"]
    with gzip.open(tmp_path / "q.xml.gz", "wt") as f:
        f.write(QUALIFIERS)
    entries = S.mesh_entries(spark, str(tmp_path / "d.xml"), str(tmp_path / "q.xml.gz"), str(tmp_path / "s.xml"))
    assert {(r["ui"], r["kind"]) for r in entries.collect()} == {("D1", "Descriptor"), ("Q1", "Qualifier"), ("S1", "SupplementalDescriptor")}
    assert sorted(tuple(r) for r in S.tree_rows(entries).collect()) == [("D1", '"Asthma"', "C08.1"), ("D1", '"Asthma"', "C20.2")]


def test_articles(spark, tmp_path):
    a = S.articles(spark, put(tmp_path / "a.xml", ARTICLES)).first()
    assert (a["pmid"], a["abstract"], a["date"], a["doi"], a["pmc"]) == (12, ["AIM: a", "b"], datetime.date(2001, 3, 1), "10.1/x", "PMC1")
    assert [(h["descriptor"], h["major"], h["qualifiers"]) for h in a["headings"]] == [("D1", True, ["Q1"]), ("D9", False, [])]


def test_obo(spark, tmp_path):
    rows = {r["id"]: r for r in S.obo_terms(spark, put(tmp_path / "h.obo", OBO)).collect()}
    assert rows["HP:2"]["synonyms"] == ["wheezing", "whistle"] and rows["HP:2"]["is_a"] == ["HP:1"] and rows["HP:1"]["alt_id"] == ["HP:9"]


def test_delimited(spark, tmp_path):
    types = S.semantic_types(spark, put(tmp_path / "t.txt", "aapp|T116|Protein\nbad|row\nacty|T052|Activity\n"))
    assert types.count() == 2 and S.find_semantic_type(types, "t052").first()["abbr"] == "acty"
    a = S.annotations(spark, put(tmp_path / "a.tab", "OMIM\t1\tName\t\tHP:1\tPMID:1\tIEA\n")).first()
    assert (a["disease"], a["phenotype"], a["type"]) == ("OMIM:1", "HP:1", "IEA")
    g = S.phenotype_genes(spark, put(tmp_path / "g.txt", "id\tname\tgid\tsymbol\nHP:1\tx\t3\tABC\n")).first()
    assert tuple(g) == ("HP:1", "ABC")
    i = S.interventions(spark, put(tmp_path / "i.tsv", "nct\ta\tunii\tb\tc\nN1\t\tU1\t\t\nN1\t\tU1\t\t\nN2\t\tFAKE_FOR_PLACEBO\t\t\n"))
    assert [tuple(r) for r in i.collect()] == [("N1", "U1")]
    assert [r["pmid"] for r in S.pmid_list(spark, put(tmp_path / "p.txt", "12\nx\n 13 \n")).collect()] == [12, 13]


def test_studies_and_html(spark, tmp_path):
    xml = "<r><study><nct_id>N1</nct_id><phase>1</phase><phase>2</phase><study_types>Interventional</study_types></study><study><nct_id>N2</nct_id><study_types>Observational</study_types></study></r>"
    rows = S.studies(spark, put(tmp_path / "s.xml", xml)).collect()
    assert [(r["nct_id"], r["phase"]) for r in rows] == [("N1", ["1", "2"])]
    html = spark.createDataFrame([('[<a href="x">Asthma</a>, "1,234 studies"], [<a href="y">Flu</a>, "7"]',)], "h string")
    assert [tuple(r) for r in S.html_conditions(html, "h").collect()] == [("Asthma", 1234), ("Flu", 7)]


def test_registry(spark, tmp_path):
    put(tmp_path / "x.bin", "abc")
    files = S.file_registry(spark, str(tmp_path / "x.bin"))
    assert files.first()["sha1"] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    loaded = spark.createDataFrame([("a9993e364706816aba3e25717850c26c9cd0d89d", 3)], "sha1 string, count long")
    assert S.unloaded(files, loaded).count() == 0 and S.unloaded(files, loaded.limit(0)).count() == 1


def test_pages(spark, tmp_path):
    import json

    for n, rows in enumerate([[{"id": 1}, {"id": 2}], [{"id": 3}]]):
        put(tmp_path / f"{n}.json", json.dumps(rows))
    assert sorted(r["id"] for r in S.json_pages(spark, str(tmp_path), "id int").collect()) == [1, 2, 3]
