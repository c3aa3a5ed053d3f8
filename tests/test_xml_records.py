import datetime

from loomgraph.operators import records as M
from loomgraph.sources import records as N

MIXED = """<?xml version="1.0"?><!DOCTYPE X SYSTEM "none.dtd"><DescriptorRecordSet LanguageCode="eng">
<DescriptorRecord DescriptorClass = "1"><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Asthma &amp; co</String></DescriptorName><DateCreated><Year>1999</Year><Month>01</Month><Day>02</Day></DateCreated>
<AllowableQualifiersList><AllowableQualifier><QualifierReferredTo><QualifierUI>Q1</QualifierUI><QualifierName><String>therapy</String></QualifierName></QualifierReferredTo><Abbreviation>TH</Abbreviation></AllowableQualifier></AllowableQualifiersList>
<TreeNumberList><TreeNumber>C08.1</TreeNumber></TreeNumberList>
<ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M1</ConceptUI><ConceptName><String>Asthma</String></ConceptName><CASN1Name>cas</CASN1Name><RegistryNumber>0</RegistryNumber>
<RelatedRegistryNumberList><RelatedRegistryNumber>R1</RelatedRegistryNumber><RelatedRegistryNumber>R2</RelatedRegistryNumber></RelatedRegistryNumberList>
<ConceptRelationList><ConceptRelation RelationName="NRW"><Concept1UI>M1</Concept1UI><Concept2UI>M2</Concept2UI></ConceptRelation><ConceptRelation RelationName="BRD"><Concept1UI>M3</Concept1UI><Concept2UI>M1</Concept2UI></ConceptRelation></ConceptRelationList>
<TermList><Term ConceptPreferredTermYN="Y" IsPermutedTermYN="N"><TermUI>T1</TermUI><String>Asthma</String></Term><Term ConceptPreferredTermYN="N"><TermUI>T2</TermUI><String>Wheeze</String></Term></TermList></Concept>
<Concept><ConceptUI>M2</ConceptUI></Concept></ConceptList></DescriptorRecord>
<SupplementalRecord><SupplementalRecordUI>S1</SupplementalRecordUI><SupplementalRecordName><String>x</String></SupplementalRecordName><Note>n</Note><Frequency>3</Frequency>
<HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D1</DescriptorUI><DescriptorName><String>Asthma</String></DescriptorName></DescriptorReferredTo><QualifierReferredTo><QualifierUI>Q1</QualifierUI><QualifierName><String>therapy</String></QualifierName></QualifierReferredTo></HeadingMappedTo></HeadingMappedToList>
<IndexingInformationList><IndexingInformation><DescriptorReferredTo><DescriptorUI>D9</DescriptorUI></DescriptorReferredTo></IndexingInformation></IndexingInformationList></SupplementalRecord>
<QualifierRecord>
<QualifierUI>Q1</QualifierUI><QualifierName><String>therapy</String></QualifierName><Annotation>a</Annotation></QualifierRecord>
<SupplementalRecord SCRClass="1"><SupplementalRecordUI>S2</Supplemental<broken></SupplementalRecord>
</DescriptorRecordSet>"""
ACTIONS = """<P><PharmacologicalAction>
<DescriptorReferredTo><DescriptorUI>D1</DescriptorUI><DescriptorName><String>act</String></DescriptorName></DescriptorReferredTo>
<PharmacologicalActionSubstanceList><Substance><RecordUI>S1</RecordUI><RecordName><String>x</String></RecordName></Substance><Substance><RecordUI>S7</RecordUI></Substance></PharmacologicalActionSubstanceList></PharmacologicalAction></P>"""


def test_all_kinds_in_one_scan(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.xml").write_text(MIXED)
    (tmp_path / "r" / "none.xml").write_text("")
    (tmp_path / "a.xml").write_text(ACTIONS)
    records, actions = N.heading_records(spark, str(tmp_path / "r")), N.action_records(spark, str(tmp_path / "a.xml"))
    rows = {r["ui"]: r for r in records.collect()}
    assert {u: r["kind"] for u, r in rows.items()} == {"D1": "Descriptor", "S1": "SupplementalDescriptor", "Q1": "Qualifier", None: "SupplementalDescriptor"}
    d, s, bad = rows["D1"], rows["S1"], rows[None]
    assert (d["name"], d["created"], d["tree_numbers"], d["bad"], [tuple(x) for x in d["allowed"]]) == ("Asthma & co", datetime.date(1999, 1, 2), ["C08.1"], None, [("Q1", "therapy", "TH")])
    c = d["concepts"][0]
    assert (c["ui"], c["preferred"], c["regno"], c["cas_name"], c["related"], [tuple(x) for x in c["relations"]], [tuple(x) for x in c["terms"]]) == ("M1", True, None, "cas", ["R1", "R2"], [("M2", "NRW")], [("T1", "Asthma", True), ("T2", "Wheeze", False)])
    assert (d["concepts"][1]["preferred"], d["concepts"][1]["terms"], d["concepts"][1]["relations"]) == (False, [], [])
    assert (s["note"], s["freq"], [tuple(x) for x in s["mapped"]], [tuple(x) for x in s["indexed"]]) == ("n", 3, [("D1", "Asthma", ["therapy"])], [("D9", None, [])])
    assert rows["Q1"]["annotation"] == "a" and "broken" in bad["bad"] and bad["concepts"] is None
    assert [tuple(x) for x in actions.first()["substances"]] == [("S1", "x"), ("S7", None)]

    nodes, edges = M.record_graph(records.filter("bad is null"), actions)  # from files to the graph
    assert {(r["ui"], r["name"], r["kind"]) for r in nodes.collect()} >= {("D1", "Asthma & co", "Descriptor"), ("M1", "Asthma", "Concept"), ("M2", None, "Concept"), ("T2", "Wheeze", "Term"), ("S1", "x", "SupplementalDescriptor"), ("D9", None, None), ("S7", None, None)}
    assert {(r["src"], r["dst"], r["type"], r["scope"]) for r in edges.collect()} == {
        ("D1", "M1", "concept", None), ("D1", "M2", "concept", None), ("M2", "M1", "concept", "NRW"), ("M1", "T1", "term", None), ("M1", "T2", "term", None), ("S1", "D1", "mapped", None), ("S1", "D9", "indexed", None), ("D1", "S1", "substance", None), ("D1", "S7", "substance", None)}


def test_records_in_columns(spark):
    rows = spark.createDataFrame([(1, None, "Qualifier"), (2, "<QualifierRecord><QualifierUI>Q</QualifierUI></QualifierRecord>", "Qualifier"), (3, "", "Qualifier"), (4, "<a", None)], "k int, x string, kind string")
    assert sorted((r["ui"] or "", r["bad"]) for r in N.parsed_records(rows, "x", "kind").collect() if r["ui"] or r["bad"]) == [("", "<a"), ("Q", None)]
    articles = {r["k"]: r for r in N.articles_of(rows.drop("kind"), "x").collect()}
    assert len(articles) == 4 and articles[4]["bad"] == "<a" and articles[1]["pmid"] is None and articles[1]["bad"] is None
    assert N.articles_of(rows.limit(0), "x").collect() == [] == N.parsed_records(rows.limit(0), "x", "kind").collect()
    got = N.resolved_xml(spark.createDataFrame([(1, "<!DOCTYPE x><pre>&lt;r&gt;&lt;a&gt;5&lt;/a&gt;&lt;/r&gt;</pre>"), (2, None), (3, "<oops")], "k int, x string"), "x", "a INT")
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, None), (3, None)]


def test_zipped_lines(spark, tmp_path):
    import zipfile

    from loomgraph.operators import trials as R
    from loomgraph.sources import files as S

    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "names.zip", "w") as z:
        z.writestr("a.txt", "Aspirin\tof\tU1\tASPIRIN\r\nAcetyl\tcn\tU1\tASPIRIN\nbad line\nÉ\tx\tU2\ty\n\nlast\tx\tU3\ty")
        z.writestr("empty.txt", "")
    rows = S.zipped_lines(spark, str(tmp_path / "z"), block=8).collect()
    assert [r["value"] for r in rows] == ["Aspirin\tof\tU1\tASPIRIN", "Acetyl\tcn\tU1\tASPIRIN", "bad line", "É\tx\tU2\ty", "", "last\tx\tU3\ty"] and [r["seq"] for r in rows] == list(range(6))
    assert sorted(map(tuple, R.first_names(S.unii_names(spark, str(tmp_path / "z"))).collect())) == [("U1", "Aspirin"), ("U2", "É"), ("U3", "last")]


def test_studies_and_interventions(spark):
    from loomgraph.operators import trials as R

    studies = spark.createDataFrame([("N1", None, "b"), ("N1", "t", "z"), ("N1", "t", "a"), (None, "x", "y"), ("N2", None, None)], "nct_id string, title string, status string")
    known = spark.createDataFrame([("N2",), ("N2",), (None,)], "nct_id string")
    assert sorted(map(tuple, R.add_studies(known, studies).collect())) == [("N1", "t", "a", True), ("N2", None, None, False)]
    rows = spark.createDataFrame([("N1", "U1"), ("N1", "U1"), ("N9", "U1"), ("N2", None), (None, "U1")], "nct_id string, unii string")
    assert [tuple(r) for r in R.with_interventions(studies, rows).collect()] == [("N1", "U1")] and R.add_studies(known, studies.limit(0)).collect() == []


def test_conditions_share_sets_of_concepts(spark):
    from loomgraph.operators import trials as R

    trials = spark.createDataFrame([("N1", "a"), ("N1", "b"), ("N1", "a"), ("N2", "a"), ("N3", "c"), (None, "a")], "nct_id string, item string")
    links = spark.createDataFrame([("a", "C1", "umls", None), ("b", "C2", "umls", None), ("b", "C2", "umls", None), ("c", "C3", "umls", 0.5), ("a", "D1", "mesh", None)], "item string, ui string, kind string, score double")
    atoms = spark.createDataFrame([("C1", "s2"), ("C1", "s1"), ("C1", "s1"), ("C9", "x")], "cui string, scui string")
    assert sorted(map(repr, R.condition_concepts(trials, links, atoms).collect())) == sorted(map(repr, [
        R_row for R_row in spark.createDataFrame([("N1", ["C1", "C2"], ["s1", "s2"]), ("N2", ["C1"], ["s1", "s2"]), (None, ["C1"], ["s1", "s2"])], "nct_id string, umls array<string>, mesh array<string>").collect()]))


def test_sets_of_concepts_hold_their_trials(spark):
    """Sets beside their trials, whatever the parts; entries of a set aren't shuffled with its trials."""
    from loomgraph.operators import trials as R

    trials = spark.createDataFrame([(f"N{i}", f"i{i % 3}") for i in range(300)] + [(f"N{i}", "i1") for i in range(0, 300, 9)], "nct_id string, item string")
    links = spark.createDataFrame([("i0", "C0", "umls", None), ("i1", "C1", "umls", None), ("i2", "C9", "umls", None)], "item string, ui string, kind string, score double")
    atoms = spark.createDataFrame([("C0", "b"), ("C0", "a"), ("C1", "b"), ("C1", None), (None, "z")], "cui string, scui string")
    mesh = {("C0",): ["a", "b"], ("C0", "C1"): ["a", "b"], ("C1",): ["b"], ("C9",): []}
    want = {f"N{i}": (f"C{(0, 1, 9)[i % 3]}", "C1") if i % 9 == 0 else (f"C{(0, 1, 9)[i % 3]}",) for i in range(300)}
    for parts in (1, 3):
        rows = R.condition_sets(trials, links, atoms, parts).collect()
        assert {tuple(r["umls"]): r["mesh"] for r in rows} == mesh and len(rows) > 4
        assert sorted((t, tuple(r["umls"])) for r in rows for t in r["trials"]) == sorted(want.items())


def test_entries_of_sets_do_not_pass_the_driver(spark):
    """A set's entries are the same for many parts, so they are shuffled to these, not broadcast, though few rows hold them."""
    from loomgraph.operators import trials as R

    trials = spark.createDataFrame([(f"N{i}", f"i{i % 3}") for i in range(60)], "nct_id string, item string")
    links = spark.createDataFrame([(f"i{i}", f"C{i}", "umls", None) for i in range(3)], "item string, ui string, kind string, score double")
    atoms = spark.createDataFrame([(f"C{i % 2}", f"s{i:03}") for i in range(40)], "cui string, scui string")
    found = R.condition_sets(trials, links, atoms, 5)
    rows = found.collect()
    assert {tuple(r["umls"]): r["mesh"] for r in rows} == {("C0",): [f"s{i:03}" for i in range(0, 40, 2)], ("C1",): [f"s{i:03}" for i in range(1, 40, 2)], ("C2",): []}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_the_columns_that_are_asked_for_are_parsed(spark, tmp_path):
    """Nodes and edges from the columns that they are made of are those from whole records; each text is searched once."""
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.xml").write_text(MIXED)
    (tmp_path / "a.xml").write_text(ACTIONS)
    path, actions = str(tmp_path / "r"), N.action_records(spark, str(tmp_path / "a.xml"))
    whole, some, rows = N.heading_records(spark, path), {c: N.heading_records(spark, path, c) for c in (N.NODES, N.EDGES)}, lambda df: sorted(map(repr, df.collect()))
    assert rows(M.record_nodes(some[N.NODES], actions)) == rows(M.record_graph(whole, actions)[0]) and rows(M.record_edges(some[N.EDGES], actions)) == rows(M.record_graph(whole, actions)[1])
    assert rows(N.heading_records(spark, path, ("kind", "ui", "bad"))) == rows(whole.select("ui", "kind", "bad")) and some[N.EDGES].count() == 4
    for df in some.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1 and "ScopeNote" not in df._jdf.queryExecution().analyzed().toString() and plan.count("from_xml") == 1
