"""DuckDB SQL for the queries that SQL can express."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""

DECONTAMINATE = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null and text is not null),
b2 as (select item, w, least(13, len(w)) as n from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g from b2, unnest(range(1, len(w) - n + 2)) as r(i)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from d, lens, unnest(range(1, len(w) - n + 2)) as r(i)),
hit as (select doc_id, item, i, dw.n as n from dw join bw using (n, g)),
words as (select distinct doc_id, i + j as p from hit, unnest(range(0, n)) as r(j)),
c as (select doc_id, count(*) as n_hit from words group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""


def url_reputation(rules: list[tuple[str, str]], two_label: list[str], z: float, threshold: float, weakest: float, strongest: float) -> str:
    cases = []
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        cases.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')", text, says))
    rule = " ".join(f"when {c} then '{t}'" for c, t, _ in cases)
    said = " ".join(f"when {c} then '{s}'" for c, _, s in cases)
    two = ", ".join(f"'{x}'" for x in two_label)

    def strength(units: str) -> str:
        return f"""(select coalesce(case when rho > 0 then least({strongest}, greatest({weakest}, 1 / rho - 1)) else {strongest} end, {strongest}) from (
          select (sum(n * pow(k / n - m, 2)) / nullif(sum(n * m * (1 - m)), 0) * sum(n) - (count(*) - 1)) / nullif(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0) as rho
          from (select n::double as n, k::double as k, m from {units} where n > 0)))"""

    return rf"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
l as (select doc_id as page_id, count(*) as n, sum(case when quality = 1 then 1 else 0 end) as k from labels where quality is not null group by 1),
h0 as (select host, coalesce(sum(n), 0)::bigint as n, coalesce(sum(k), 0)::bigint as k from p left join l using (page_id) group by 1),
h1 as (select *, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g'), '.') as a, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') as name from h0),
h2 as (select host, n, k, name, a, regexp_full_match(name, '[0-9]+(\.[0-9]+){{3}}') as ip, array_to_string(a[-2:], '.') in ({two}) as two from h1),
h as (select host, n, k, case when ip then '' when two then array_to_string(a[-2:], '.') else a[-1] end as suffix, case when ip then name when two then array_to_string(a[-3:], '.') else array_to_string(a[-2:], '.') end as domain from h2),
d as (select domain, suffix, sum(n)::bigint as n, sum(k)::bigint as k from h group by all),
s as (select suffix, sum(n)::bigint as n, sum(k)::bigint as k from d group by all),
su as (select *, coalesce((select sum(k)::double / nullif(sum(n), 0)::double from s), 0.5) as m from s),
ss as (select {strength("su")} as w),
sp as (select suffix, (k + w * m) / (n + w) as m from su, ss),
du as (select d.*, sp.m from d join sp using (suffix)),
ds as (select {strength("du")} as w),
dp as (select domain, suffix, (k + w * m) / (n + w) as m from du, ds),
hu as (select h.*, dp.m from h join dp using (domain, suffix)),
hs as (select {strength("hu")} as w),
hp as (select host, (k + w * m) / (n + w) as m, n + w as weight from hu, hs)
select page_id, host, path, case {rule} end as rule,
  coalesce(case {said} end, case when m - {z} * sqrt(m * (1 - m) / (weight + 1)) >= {threshold} then 'allow' else 'block' end) as verdict
from p left join hp using (host)
"""


# --- SimHash: XXH64 in unsigned integers of 64 bits, products taken modulo 2 ** 64 in wider ones ----------------------

# The primes of XXH64.
_PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
_WORD = "18446744073709551616::uhugeint"


def _times(a: str, b: str | int) -> str:
    return f"((({a})::uhugeint * ({b})::uhugeint) % {_WORD})::ubigint"


def _plus(a: str, b: str | int) -> str:
    return f"((({a})::uhugeint + ({b})::uhugeint) % {_WORD})::ubigint"


def _turn(name: str, bits: int) -> str:
    return f"xor((({name}::uhugeint * {1 << bits}::uhugeint) % {_WORD})::ubigint, {name} >> {64 - bits})"


def _little_endian(place: str, size: int) -> str:
    """Bytes from a place (0, 1, ...) on, of the text whose hex digits are in hx."""
    return "('0x' || " + " || ".join(f"substr(hx, 2 * ({place}) + {1 + 2 * k}, 2)" for k in reversed(range(size))) + ")::ubigint"


def simhash(seed: int, words: int, radius: int) -> str:
    """Fingerprints and components as the contract defines them. Recursions: 32 bytes a step (s32), then 8, 4 or 1 (tail), and
    from fingerprint to fingerprint (reach)."""
    p1, p2, p3, p4, p5 = _PRIMES
    word = 1 << 64
    text = f"regexp_extract_all(translate(text, {_AZ}), '[^\\x20\\x09-\\x0D]+')"
    four = (1, 2, 3, 4)
    begin = ", ".join(f"{v % word}::ubigint as v{i}" for i, v in zip(four, (seed + p1 + p2, seed + p2, seed, seed - p1), strict=True))
    lanes = ", ".join(f"{_plus(f'v{i}', _times(_little_endian(f'pos + {8 * (i - 1)}', 8), p2))} as x{i}" for i in four)
    turned = ", ".join(f"{_turn(f'x{i}', 31)} as r{i}" for i in four)
    merged = ", ".join(
        f"b{i} as (select g, hx, n, pos, v1, v2, v3, v4, {_plus(_times(f'xor(h, {_times(_turn(f'm{i}', 31), p1)})', p1), p4)} as h from (select *, {_times(f'v{i}', p2)} as m{i} from b{i - 1}))" for i in four
    )
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    half = lambda first: f"coalesce(list_sum(list_transform(range(32), lambda b: case when 2 * k[b + {first + 1}] > m then 1::bigint << b else 0::bigint end)), 0)::hugeint"
    return f"""
with recursive d as (select doc_id, coalesce({text}, []) as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle}) end) as g from d),
u as (select g, hex(encode(g)) as hx, octet_length(encode(g))::bigint as n from (select distinct g from s)),
s32 as (select g, hx, n, 0::bigint as pos, {begin} from u where n >= 32
  union all select g, hx, n, pos + 32, {", ".join(_times(f"r{i}", p1) for i in four)} from (select g, hx, n, pos, {turned} from (select g, hx, n, pos, {lanes} from s32 where n - pos >= 32))),
b0 as (select g, hx, n, pos, v1, v2, v3, v4, {_plus(_plus(_turn("v1", 1), _turn("v2", 7)), _plus(_turn("v3", 12), _turn("v4", 18)))} as h from s32 where n - pos < 32),
{merged},
tail as (select g, hx, n, pos, {_plus("h", "n")} as h from (select g, hx, n, pos, h from b4 union all select g, hx, n, 0, {(seed + p5) % word}::ubigint from u where n < 32)
  union all select g, hx, n, pos + k, case k when 8 then {_plus(_times(_turn("y", 27), p1), p4)} when 4 then {_plus(_times(_turn("y", 23), p2), p3)} else {_times(_turn("y", 11), p1)} end from
    (select g, hx, n, pos, k, case k when 8 then xor(h, {_times(_turn("z", 31), p1)}) when 4 then xor(h, {_times("z", p1)}) else xor(h, {_times("z", p5)}) end as y from
      (select g, hx, n, pos, h, k, case k when 8 then {_times(_little_endian("pos", 8), p2)} when 4 then {_little_endian("pos", 4)} else {_little_endian("pos", 1)} end as z from
        (select *, case when n - pos >= 8 then 8 when n - pos >= 4 then 4 else 1 end as k from tail where pos < n)))),
f1 as (select g, {_times("xor(h, h >> 33)", p2)} as h from tail where pos = n), f2 as (select g, {_times("xor(h, h >> 29)", p3)} as h from f1), f as (select g, xor(h, h >> 32) as h from f2),
c as (select doc_id, [{", ".join(f"sum((h >> {b}) & 1::ubigint)" for b in range(64))}] as k, count(*) as m from s join f using (g) group by 1),
p as (select doc_id, ({half(32)} * 4294967296::hugeint + {half(0)})::ubigint as fp from d left join c using (doc_id)),
e as (select distinct fp from p), l as (select x.fp as a, y.fp as b from e x, e y where bit_count(xor(x.fp, y.fp)::hugeint) <= {radius}),
reach as (select fp, fp as to_ from e union select reach.fp, l.b from reach join l on l.a = to_),
least as (select reach.fp, min(doc_id) as component_id from reach join p on p.fp = to_ group by 1)
select doc_id, lpad(lower(to_hex(fp)), 16, '0') as fingerprint, component_id from p join least using (fp)
"""
