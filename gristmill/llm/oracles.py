"""DuckDB SQL with the same rows as queries of this subpackage."""

from __future__ import annotations

from gristmill.llm.mixing import MAX_EPOCHS, TEMPERATURE, UNITS
from gristmill.llm.secret_scan import ACCESS, ASSIGN, BLANK_LINE, COMPLETED_BY, HEX, KINDS, LINK_GAP, WEAK
from gristmill.llm.substring_dedup import WINDOW


def _parts(kind: str, pattern: str, group: int = 0, value: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
      select rid, '{kind}' as kind, n, g, m, {value} as ok from (
        select rid, unnest(range(1, len(ms) + 1)) as n, unnest(gs[:len(ms)]) as g, unnest(ms) as m, unnest(vs) as v from (
          select rid, string_split_regex(text, '{quoted}') as gs, regexp_extract_all(text, '{quoted}', 0) as ms,
                 regexp_extract_all(text, '{quoted}', {group}) as vs from d))"""


def secret_scan_sql() -> str:
    """The scan with the interval join as a join: any completing part in the scope that is near enough."""
    parts = [_parts("assign", ASSIGN, 2, "length(v) >= 12"), _parts("access", ACCESS), _parts("hex", HEX)]
    for kind, pattern in WEAK.items():
        value = "regexp_full_match(v, '[A-Za-z0-9+/]{40}') and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]')"
        parts.append(_parts(kind, pattern, 0, value if kind == "bare_key" else "true"))
    parts.append(_parts("break", BLANK_LINE))
    completes = " or ".join(f"(a.kind = '{k}' and b.kind in ({', '.join(repr(x) for x in of)}))" for k, of in COMPLETED_BY.items())
    rank = "list_position([" + ", ".join(repr(k) for k in KINDS) + "], kind)"
    said = "string_agg(kind || ':' || s || ':' || e, ',' order by s, " + rank + ", e)"
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    p as ({' union all '.join(parts)}),
    placed as (select rid, kind, ok, (sum(length(g) + length(m)) over w)::bigint as e, length(m) as size from p
      window w as (partition by rid, kind order by n rows between unbounded preceding and current row)),
    spans as (select rid, kind, e - size as s, e from placed where ok),
    scoped as (select *, sum((kind = 'break')::int) over (partition by rid order by s, e, kind rows between unbounded preceding and current row) as scope from spans),
    linked as (select distinct a.rid, a.kind, a.s, a.e from scoped a join scoped b on a.rid = b.rid and a.scope = b.scope and ({completes})
      and (a.s, a.e, a.kind) <> (b.s, b.e, b.kind) and b.s - a.e <= {LINK_GAP} and a.s - b.e <= {LINK_GAP}),
    base as (select rid, kind, s, e from scoped where kind in ('assign', 'access', 'hex')),
    of_base as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
      count(*) filter (where kind = 'hex') as n_hex, {said} as said from base group by rid),
    of_all as (select rid, {said} as said, count(*) as n from (select * from base union all select * from linked) group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(b.said, '')) as base_sha256, coalesce(a.said, '') as spans,
      coalesce(a.n, 0) - coalesce(n_assign + n_access + n_hex, 0) as n_linked
    from d left join of_base b on d.rid = b.rid left join of_all a on d.rid = a.rid"""


def substring_dedup_sql() -> str:
    return rf"""
    with d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
    win as (select rid, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as k from (select *, unnest(range(1, len(ws) - {WINDOW - 2})) as i from d)),
    least as (select k, min(doc_id) as m from win group by k),
    gone as (select distinct rid, i + j as p from (select rid, i, unnest(range(0, {WINDOW})) as j from win join least using (k) where m < doc_id)),
    islands as (select rid, min(p) - 1 as a, max(p) as b from (select rid, p, p - row_number() over (partition by rid order by p) as island from gone) group by rid, island),
    removed as (select rid, sum(b - a)::bigint as n, string_agg(a || ':' || b, ',' order by a) as said from islands group by rid),
    kept as (select rid, string_agg(word, ' ' order by p) as t from (select rid, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d) w
      where not exists (select 1 from gone g where g.rid = w.rid and g.p = w.p) group by rid)
    select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256, coalesce(said, '') as removed
    from d left join removed r on d.rid = r.rid left join kept k on d.rid = k.rid"""


def sharding_sql(n_shards: int = 40, seed: int = 42) -> str:
    """The shards with plain windows; CRC-32 byte by byte, by a table that its polynomial gives."""
    return f"""
    with t as (select list(c order by i) as crc from (select i, list_reduce(list_concat([i], range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    d as (select doc_id, coalesce(source::varchar, '') as source, regexp_extract_all(hex(coalesce(text, '')), '..') as h from documents),
    b as (select doc_id, source, len(h) as n_bytes,
      [16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1 for x in h] as bytes from d),
    c as (select doc_id, source, n_bytes + 16 as size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as text_crc32 from b, t),
    k as (select *, md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || text_crc32::varchar) as key from c),
    r as (select *, row_number() over (partition by source order by key, doc_id, size) - 1 as rank, count(*) over (partition by source) as n_source, count(*) over () as n from k),
    p as (select *, row_number() over (order by (2 * rank + 1)::double / (2 * n_source), source, rank) - 1 as place from r),
    s as (select *, (place * {n_shards}) // n as shard from p)
    select doc_id, source, size, text_crc32, 'rows' as law, shard::int as shard, place - (shard * n + {n_shards - 1}) // {n_shards} as slot, null::int as grown_shard from s"""


def mixing_sql(block_rows: int = 16, seed: int = 42) -> str:
    """The stream of the mixture, its schedule worked out slot by slot from the first on."""
    return f"""
    with recursive c as (select coalesce(source, '') as s, count(*) as n from documents group by 1),
    w as (select s, n, pow(n, {TEMPERATURE}) as w from c),
    x as (select s, n, (floor(least(w / n, (select min(w / n) from w) * {MAX_EPOCHS}) * n * {UNITS}) + 1)::hugeint as w from w),
    t as (select list(s order by s) as names, list(w order by s) as ws, sum(w)::hugeint as total,
      max(((n + {block_rows - 1}) // {block_rows} * (select sum(w) from x) + w - 1) // w)::bigint as length from x),
    e as (select -1::bigint as slot, [1::hugeint for x in ws] as js, 0::bigint as pick from t union all
      select slot + 1, [case when i = p then js[i] + 1 else js[i] end for i in range(1, len(js) + 1)], p from (
        select slot, js, list_min([struct_pack(d := (js[i] * total + ws[i] - 1) // ws[i], i := i) for i in range(1, len(js) + 1)
          if ((js[i] - 1) * total) // ws[i] <= slot + 1]).i as p from e, t where slot < length - 1)),
    timed as (select slot, names[pick] as s, pick, row_number() over (partition by pick order by slot) - 1 as block from e, t where slot >= 0),
    d as (select doc_id, coalesce(source, '') as s, row_number() over (partition by coalesce(source, '') order by md5('{seed}:' || coalesce(doc_id::varchar, '')), doc_id) - 1 as rank from documents),
    taken as (select s, n, w, (select count(*) from timed where timed.s = x.s) * {block_rows} as taken from x),
    k as (select doc_id, s, n, w, rank, unnest(range(0, (taken - rank - 1) // n + 1)) as epoch from d join taken using (s)),
    b as (select *, (rank + epoch * n) as k, (rank + epoch * n) // {block_rows} as block from k)
    select doc_id, s as source, epoch, block, slot, ((block::hugeint * total) // w)::bigint as release,
      (((block + 1)::hugeint * total + w - 1) // w)::bigint as deadline, slot * {block_rows} + k % {block_rows} as position
    from b join timed using (s, block), t"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def minhash_sql() -> str:
    """The links by counting common shingles of each pair of different texts, and the smallest doc_id reached by following them."""
    return rf"""
    with recursive d as (select row_number() over () as rid, doc_id,
      coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
    s as (select rid, doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])) end as ks from d),
    t as (select min(rid) as t, ks, len(ks) as n from s where len(ks) > 0 group by ks),
    x as (select t, n, unnest(ks) as k from t),
    pairs as (select a.t as a, b.t as b from x a join x b on a.k = b.k and a.t < b.t group by a.t, b.t, a.n, b.n
      having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    e as (select a, b from pairs union all select b, a from pairs),
    reach as (select t as a, t as b from t union select reach.a, e.b from reach join e on reach.b = e.a),
    of_row as (select s.rid, s.doc_id, len(s.ks)::bigint as n_shingles, t.t from s left join t on s.ks = t.ks),
    least as (select r.a as t, min(o.doc_id) as m from reach r join of_row o on o.t = r.b group by r.a)
    select doc_id, n_shingles, case when n_shingles = 0 then doc_id else m end as component_id,
      doc_id is not distinct from case when n_shingles = 0 then doc_id else m end as kept
    from of_row left join least using (t)"""


def spelling_sql() -> str:
    """Words by the same checksum, worked out byte by byte; neighbours by the patterns and the words that lack each letter."""
    return f"""
    with recursive c as (select list(c order by i) as crc from (select i, list_reduce(list_concat([i], range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    r as (select doc_id, run, count(*) as n from (select coalesce(doc_id::varchar, '') as doc_id,
      unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents) group by 1, 2),
    h as (select run, n, regexp_extract_all(hex(doc_id || ':' || run), '..') as h from r),
    b as (select run, n, [16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1 for x in h] as bytes from h),
    k as (select run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as crc from b, c),
    w as (select case when crc % 97 = 0 then substr(run, 1, (crc % length(run))::bigint) || substr(run, (crc % length(run))::bigint + 2) else run end as word, n from k),
    v as (select word, sum(n)::bigint as n from w where length(word) >= 5 group by word having sum(n) >= 3),
    cut as (select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as pattern, substr(word, 1, i - 1) || substr(word, i + 1) as short
      from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
    indel as (select distinct cut.word, cut.n, v.word as near, v.n as near_n from cut join v on v.word = cut.short),
    near as (select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.pattern = b.pattern and a.word <> b.word
      union all select * from indel union all select near, near_n, word, n from indel),
    ranked as (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, encode(near)) as place from near),
    f as (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * v.n then near end as form,
      case when near_n >= 2 * v.n then near_n end as form_n from v left join ranked on ranked.word = v.word and place = 1),
    chain as (select word, word as root, 0 as step from f union all select chain.word, f.form, step + 1 from chain join f on f.word = chain.root where f.form is not null)
    select f.word, n, n_near, form, form_n, root from f join (select word, max_by(root, step) as root from chain group by word) using (word)"""


def search_sql(top: int = 10) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    cut = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{term}')"
    return f"""
    with d as (select row_number() over () as rid, doc_id, {cut} as ws from documents),
    n as (select rid, doc_id, len(ws) as n from d where len(ws) > 0),
    total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from n),
    i as (select row_number() over () as iid, item_id, {cut} as ws from (select distinct item_id, text from benchmark)),
    q as (select iid, item_id, term, count(*) as q from (select iid, item_id, unnest(ws) as term from i) group by 1, 2, 3),
    p as (select rid, term, count(*) as tf from (select rid, unnest(ws) as term from d) where term in (select term from q) group by 1, 2),
    df as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from p, total group by term),
    s as (select iid, item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
      from q join p using (term) join df using (term) join n using (rid), total group by iid, item_id, rid, doc_id)
    select item_id, rank::int as rank, doc_id, score from (
      select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= {top}"""
