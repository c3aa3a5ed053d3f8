"""SQL of the queries that SQL can express, beside those of ``queries``."""

from __future__ import annotations

#: crc32 of a string, nibble by nibble of its bytes; the sixteen values are those of the reflected polynomial 0xEDB88320.
NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def crc32(value: str) -> str:
    code = f"lower(hex(encode({value})))"
    swapped = f"list_transform(range(1, length({code}) + 1), lambda i: instr('0123456789abcdef', substr({code}, i + 1 - 2 * ((i + 1) % 2), 1)) - 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {swapped}), lambda c, x: xor(c >> 4, {NIBBLES}[(xor(c, x) & 15) + 1])))"


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar)::varchar || ':' || {f}::varchar, '-')" for f in fields) + ")"


MERKLE = f"""
    with recursive
    hashed as (select doc_id, source, {_leaf("text")} as leaf, {_leaf("replace(text, chr(10), '')")} as other, doc_id is not null and ({crc32("doc_id::varchar")}) % 2 = 0 as hit from documents),
    leaves as (select row_number() over () as id, doc_id, source, leaf, case when hit then other else leaf end as seen, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as spot,
        count(*) over (partition by source) as n from hashed),
    nodes as (select source, 0 as level, spot as i, leaf as h, n from leaves
        union all select source, level + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from nodes where n > 1 group by source, level, i // 3, n),
    subroots as (select source, level, h as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
    tops as (select 0 as level, place as i, subroot as h, n from subroots
        union all select level + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from tops where n > 1 group by level, i // 3, n),
    steps as (select source, level, i, n, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
        from nodes window w as (partition by source, level, i // 3 order by i)),
    top_steps as (select level, i, n, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
        from tops window w as (partition by level, i // 3 order by i)),
    paths as (select id, s.level as k, l, r from leaves join steps s on s.source is not distinct from leaves.source and s.n > 1 and s.i = spot // cast(pow(3, s.level) as bigint)
        union all select id, u.level + t.level, l, r from leaves join subroots u on u.source is not distinct from leaves.source join top_steps t on t.n > 1 and t.i = place // cast(pow(3, t.level) as bigint)),
    proofs as (select id, string_agg(l || r, '' order by k) as proof, list({{'l': l, 'r': r}} order by k) as path from paths group by id),
    folded as (select leaves.*, coalesce(proof, '') as proof, list_reduce(list_prepend({{'l': seen, 'r': ''}}, coalesce(path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l as folded_root from leaves left join proofs using (id))
    select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, folded_root, folded_root = t.h as verified, f.source
    from folded f join subroots u on u.source is not distinct from f.source join tops t on t.n = 1
"""

VARIANTS = f"""
    with recursive
    runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as raw from documents),
    lowered as (select coalesce(doc_id::varchar, '') || ':' || run as name, run from (select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from runs where length(raw) >= 7)),
    hashed as (select run, {crc32("name")} as h, count from (select name, run, count(*) as count from lowered group by all)),
    made as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, count from hashed),
    words as (select word, cast(sum(count) as bigint) as n from made where length(word) >= 7 group by word having sum(count) >= 2),
    holes as (select word, n, p, substr(word, 1, cast(p as integer)) || substr(word, cast(p as integer) + 2) as hole from (select word, n, unnest(range(length(word))) as p from words)),
    near as (select a.word, b.word as other from holes a join holes b on a.p = b.p and a.hole = b.hole and a.word != b.word
        union select h.word, w.word from holes h join words w on w.word = h.hole union select w.word, h.word from holes h join words w on w.word = h.hole),
    best as (select near.word, cast(count(*) as bigint) as n_near, first(other order by w.n desc, other) as other, first(w.n order by w.n desc, other) as other_n from near join words w on w.word = near.other group by near.word),
    forms as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * words.n then other end as form, case when other_n >= 10 * words.n then other_n end as form_n from words left join best using (word)),
    chain as (select word, word as at, form as next from forms union all select chain.word, f.word, f.form from chain join forms f on f.word = chain.next)
    select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word and c.next is null
"""
