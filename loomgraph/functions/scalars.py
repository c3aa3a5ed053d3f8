"""Scalar functions as Column builders; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that have one ASCII character, by that character.
ONE_TO_ONE = {
    "A": "ÅÄÂÃ", "a": "åàáäã", "C": "Ç", "c": "ç", "E": "ÊÈÉ", "e": "ëéèĕę", "i": "ĭï", "L": "£", "l": "ł", "N": "Ñ", "n": "ñ", "O": "ÖÓ", "o": "öôøóō",
    "s": "ş", "U": "Ü", "u": "üúμ", "x": "×", "~": "∼", "*": "•·", "'": "´", "-": "–", "<": "〈", ">": "〉",
}
# The characters that have several.
ONE_TO_MANY = {
    "ß": "ss", "°": "{^o}", "≈": "[approx]", "α": "[alpha]", "β": "[beta]", "γ": "[gamma]", "δ": "[delta]", "Δ": "[DELTA]", "ε": "[epsilon]", "κ": "[kappa]", "Κ": "[KAPPA]",
    "λ": "[lambda]", "Μ": "[MU]", "ν": "[nu]", "π": "[pi]", "ρ": "[rho]", "σ": "[sigma]", "Σ": "[SIGMA]", "∑": "[SIGMA]", "τ": "[tau]", "φ": "[phi]", "Φ": "[phi]", "ψ": "[psi]",
    "ω": "[omega]", "Ω": "[OMEGA]", "±": "+/-", "≥": ">=", "≧": ">=", "≤": "<=", "≦": "<=", "⩽": "<=", "♀": "[maternal]", "♂": "[paternal]", "₀": "{_0}", "₁": "{_1}", "₂": "{_2}",
    "₄": "{_4}", "₅": "{_5}", "¹": "{^1}", "²": "{^2}", "³": "{^3}", "©": "(c)", "®": "(R)", "™": "[tm]", "‰": "[permil]", "℃": "[celsius]", "€": "[euro]", "˙": "{^*}",
}


def to_ascii(c: Column) -> Column:
    """ASCII form of a text; what has none becomes ``[.]``. (The source's slip for a subscript five is corrected.)"""
    plain = F.translate(c, "".join(ONE_TO_ONE.values()), "".join(k * len(v) for k, v in ONE_TO_ONE.items()))
    spelled = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ONE_TO_MANY.items(), plain)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(spelled, r"[^\x00-\x7F]", "[.]")).otherwise(c)


def escape_query(c: Column) -> Column:
    """Full-text query with its operators escaped; a quoted phrase stays as it is."""
    return F.when(c.startswith('"'), c).otherwise(F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1"))


def tree_prefixes(c: Column) -> Column:
    """``a.b.c`` -> [a, a.b, a.b.c]."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def tree_parent(c: Column) -> Column:
    """``a.b.c`` -> a.b; null at the top."""
    return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", ""))


def last_token(c: Column, separator: str) -> Column:
    """What follows the last separator; the whole text if the separator doesn't occur after its first character."""
    return F.when(F.length(F.substring_index(c, separator, -1)) < F.length(c) - 1, F.substring_index(c, separator, -1)).otherwise(c)


def strip_pipe(c: Column) -> Column:
    """What precedes the first ``|``, if anything does."""
    return F.when(F.instr(c, "|") > 1, F.substring_index(c, "|", 1)).otherwise(c)


def unquote(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def quoted(c: Column) -> Column:
    """The first quoted part; null without one."""
    return F.nullif(F.regexp_extract(c, '"([^"]+)', 1), F.lit(""))


def extract_ids(c: Column) -> Column:
    """All ``(PMID|HPO|ORCID):token`` of a text as structs of namespace (upper case), value, and number if it is one."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)((?:PMID|HPO|ORCID):[\w\-]+)"), 1)
    value = lambda x: F.substring_index(x, ":", -1)
    return F.transform(found, lambda x: F.struct(F.upper(F.substring_index(x, ":", 1)).alias("namespace"), value(x).alias("value"), value(x).try_cast("long").alias("number")))


def strip_comment(c: Column) -> Column:
    """What precedes ``!``, trimmed."""
    return F.trim(F.substring_index(c, "!", 1))


def namespace_split(c: Column) -> Column:
    """``ns:value`` -> (NS, value, number for numeric vocabularies)."""
    parts = F.split(c, ":", 2)
    ns = F.upper(F.get(parts, F.lit(0)))
    return F.struct(ns.alias("namespace"), F.get(parts, F.lit(1)).alias("value"), F.when(ns.isin("SNOMEDCT_US", "PMID"), F.get(parts, F.lit(1)).try_cast("long")).alias("number"))


def percent_decode(c: Column) -> Column:
    return F.url_decode(c)


def percent_encode(c: Column) -> Column:
    return F.url_encode(c)


def trim_holder(c: Column) -> Column:
    return F.regexp_replace(c, r", LICENSE HOLDER UNSPECIFIED.*$", "")


def join_values(c: Column, separator: str = ";") -> Column:
    return F.array_join(c, separator)


def before_last_space(c: Column) -> Column:
    return F.regexp_replace(c, " [^ ]*$", "")


def strip_star(c: Column) -> Column:
    return F.regexp_replace(c, r"^\*", "")


def labelled_text(label: Column, text: Column) -> Column:
    return F.concat_ws(": ", F.nullif(label, F.lit("")), text)


def xml_unescape(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!DOCTYPE[^>]*>", ""), r"</?pre>", "")
    return F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def field_split(c: Column) -> Column:
    """``key: value`` -> (key, value); null where no colon follows a key."""
    return F.when(F.instr(c, ":") > 1, F.struct(F.substring_index(c, ":", 1).alias("key"), F.trim(F.regexp_replace(c, r"^[^:]*:", "")).alias("value")))


def thousands_int(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def same_fold(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_month(c: Column) -> Column:
    """Month from 0: of a three-letter name in any case, or of a number from 1; null for anything else."""
    name = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i)])
    number = c.try_cast("int") - 1
    return F.coalesce(name[F.lower(F.trim(c))], F.when(number.between(0, 11), number))


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """Month from 0, with 0 as default; day with 1 as default."""
    return F.make_date(year, F.coalesce(month, F.lit(0)) + 1, F.coalesce(day, F.lit(1)))


def year_of(c: Column) -> Column:
    return F.year(c)


def from_epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c)


def to_epoch_ms(c: Column) -> Column:
    return F.unix_millis(c)


def dotted_date(c: Column) -> Column:
    return F.date_format(c, "yyyy.MM.dd")


def long_date(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy")


def match_score(match: Column, text: Column) -> Column:
    return match / F.length(text)


def page_number(skip: Column, top: Column) -> Column:
    return (F.floor(skip / top) + 1).cast("int")


def flat_compact(c: Column) -> Column:
    return F.array_compact(F.flatten(c))


def first_of(c: Column) -> Column:
    return F.get(c, F.lit(0))


def appended(c: Column, value: Column) -> Column:
    return F.array_append(c, value)


def put(props: Column, key: str, value: Column) -> Column:
    """The map with a key set; a key that it has is replaced."""
    return F.map_concat(F.map_filter(props, lambda k, _: k != key), F.create_map(F.lit(key), value))


def put_all(old: Column, new: Column) -> Column:
    """Both maps, the new one's values where a key is in both; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(new, k)), new)


def put_if_absent(props: Column, key: str, value: Column) -> Column:
    return F.when(F.map_contains_key(props, key), props).otherwise(F.map_concat(props, F.create_map(F.lit(key), value)))


def visible(props: Column) -> Column:
    """Properties whose keys don't begin with ``_``, in the order of the keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(props, lambda k, _: ~k.startswith("_")))))


def add_tags(tags: Column, new: Column) -> Column:
    return F.array_union(tags, new)


def json_text(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_long(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("long")


def json_has(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).isNotNull()


def json_fields(c: Column) -> Column:
    return F.json_object_keys(c)


def json_props(c: Column) -> Column:
    """All fields of a JSON object as text."""
    return F.from_json(c, "map<string,string>")


def sha1_hex(c: Column) -> Column:
    return F.sha1(c)


def id_from_uri(c: Column, kind: str) -> Column:
    """The number in ``…/kind(123)``."""
    return F.regexp_extract(c, rf"/{kind}\((\d+)\)", 1).try_cast("long")


def uri(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


# Semantic groups and the node types they stand for.
GROUP_TYPES = {"CHEM": "drug", "DISO": "disease", "GENE": "gene"}


def node_type(group: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GROUP_TYPES.items() for x in pair])
    return F.coalesce(known[group], F.nullif(group, F.lit("")), F.lit("UNKNOWN"))


def other_side(subject: Column, obj: Column, concept: Column) -> Column:
    return F.when(subject == concept, obj).otherwise(subject)


def is_cui(c: Column) -> Column:
    return c.rlike("^[cC][0-9]+$")
