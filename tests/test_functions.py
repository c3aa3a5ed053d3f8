import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


CASES = [
    (lambda: S.to_ascii(F.lit("Étüde αβ ≥5 ß ₂ ¹ 日×°")), "Etude [alpha][beta] >=5 ss {_2} {^1} [.]x{^o}"),
    (lambda: S.escape_query(F.lit('a+b (c)')), "a\\+b \\(c\\)"),
    (lambda: S.escape_query(F.lit('"a+b"')), '"a+b"'),
    (lambda: S.tree_prefixes(F.lit("D02.455.426")), ["D02", "D02.455", "D02.455.426"]),
    (lambda: S.tree_parent(F.lit("D02.455.426")), "D02.455"),
    (lambda: S.tree_parent(F.lit("D02")), None),
    (lambda: S.last_token(F.lit("a/b/c"), "/"), "c"),
    (lambda: S.last_token(F.lit("/abc"), "/"), "/abc"),
    (lambda: S.last_token(F.lit("abc"), "/"), "abc"),
    (lambda: S.strip_pipe(F.lit("C1|C2")), "C1"),
    (lambda: S.strip_pipe(F.lit("|C2")), "|C2"),
    (lambda: S.unquote(F.lit('a"b"')), "ab"),
    (lambda: S.quoted(F.lit('x "y z" "w"')), "y z"),
    (lambda: F.to_json(S.extract_ids(F.lit("see pmid:12 and HPO:x1"))), '[{"namespace":"PMID","value":"12","number":12},{"namespace":"HPO","value":"x1"}]'),
    (lambda: S.strip_comment(F.lit("HP:1 ! name")), "HP:1"),
    (lambda: F.to_json(S.namespace_split(F.lit("pmid:12"))), '{"namespace":"PMID","value":"12","number":12}'),
    (lambda: S.percent_decode(F.lit("a%20b%22")), 'a b"'),
    (lambda: S.trim_holder(F.lit("Drug, LICENSE HOLDER UNSPECIFIED, X")), "Drug"),
    (lambda: S.before_last_space(F.lit("Kinase X inhibitor")), "Kinase X"),
    (lambda: S.strip_star(F.lit("*D1")), "D1"),
    (lambda: S.labelled_text(F.lit("AIM"), F.lit("t")), "AIM: t"),
    (lambda: S.labelled_text(F.lit(""), F.lit("t")), "t"),
    (lambda: S.xml_unescape(F.lit("<!DOCTYPE x><pre>&lt;a&gt;</pre>")), "<a>"),
    (lambda: F.to_json(S.field_split(F.lit("name: a: b"))), '{"key":"name","value":"a: b"}'),
    (lambda: S.field_split(F.lit(": b")), None),
    (lambda: S.thousands_int(F.lit("1,234")), 1234),
    (lambda: S.parse_month(F.lit("Mar")), 2),
    (lambda: S.parse_month(F.lit("3")), 2),
    (lambda: S.parse_month(F.lit("spring")), None),
    (lambda: S.publication_date(F.lit(2001), F.lit(None).cast("int"), F.lit(None).cast("int")), datetime.date(2001, 1, 1)),
    (lambda: S.page_number(F.lit(25), F.lit(10)), 3),
    (lambda: S.flat_compact(F.array(F.array(F.lit(1), F.lit(None)), F.array(F.lit(2)))), [1, 2]),
    (lambda: S.put_all(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))), {"a": "1", "b": "3"}),
    (lambda: S.put_if_absent(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2")), {"a": "1"}),
    (lambda: S.visible(F.create_map(F.lit("_h"), F.lit("1"), F.lit("a"), F.lit("2"))), {"a": "2"}),
    (lambda: S.json_props(F.lit('{"a": 1, "b": "x"}')), {"a": "1", "b": "x"}),
    (lambda: S.id_from_uri(F.lit("http://h/targets(123)"), "targets"), 123),
    (lambda: S.node_type(F.lit("CHEM")), "drug"),
    (lambda: S.node_type(F.lit("")), "UNKNOWN"),
    (lambda: S.is_cui(F.lit("c0012")), True),
    (lambda: S.sha1_hex(F.lit("a")), "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalar(spark, i):
    make, want = CASES[i]
    assert one(spark, make()) == want
