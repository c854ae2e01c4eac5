"""SQL that must give the rows of the queries SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

WARC = r"""
with p as (select page_id, url, coalesce(html, '') as body from pages),
d as (select *, strlen(body) as size, sha1(body) as digest from p),
g as (select digest, max(page_id) as answered from d where size >= 1000 group by digest)
select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
    case when answered > page_id then 'revisit' else 'response' end as record_type,
    case when answered > page_id then answered end as refers_to,
    nullif(regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '%20', 'g'), '') as uri, cast(null as varchar) as problem
from d left join g using (digest)"""

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) as w from documents),
s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)),
        lambda i: array_to_string(w[i:i + 2], chr(1))))) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
link as (select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id
    having 100 * count(*) >= 85 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, link.b from reach join link on link.a = reach.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select a as doc_id, min(b) as component_id from reach group by a) left join n using (doc_id)"""

CHATS = """
with c as (select conv_id, list(struct_pack(role := role, body := text) order by turn, role, text) as l
    from conversations where conv_id is not null group by conv_id),
same as (select l, min(conv_id) as conv_id, count(*) as n_copies from c group by l),
inside as (select distinct l[1:k] as l from (select l, unnest(range(1, len(l))) as k from c))
select conv_id, len(l) as n_turns, n_copies, array_to_string(list_transform(l, lambda t: '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10)
    || replace(replace(coalesce(t.body, ''), '<|im_start|>', '<|im_start| >'), '<|im_end|>', '<|im_end| >') || '<|im_end|>' || chr(10)), '') as rendered
from same where not exists (select 1 from inside where inside.l = same.l)"""

LINE_RULES = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) as lines from documents),
windows as (select doc_id, i, count(*) over (partition by doc_id, w[i:i + 2]) as times
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
repeated as (select doc_id, count(distinct i + k) as n_repeat_words from windows cross join (values (0), (1), (2)) as v(k)
    where times > 1 group by doc_id),
line as (select doc_id, host, regexp_extract_all(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), {_WORDS}) as words from (select doc_id, host, unnest(lines) as x from d)),
often as (select host, words from line group by host, words having count(distinct doc_id) > 20
    and count(distinct doc_id) > 0.1 * (select count(*) from d where d.host = line.host)),
removed as (select doc_id, sum(len(words)) as n from line semi join often using (host, words) group by doc_id),
counted as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, cast(coalesce(removed.n, 0) as bigint) as n_removed_words
    from d left join repeated using (doc_id) left join removed using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * n_removed_words <= n_words as kept from counted"""

CONTAINMENT = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
ds as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s
    from d where len(w) > 0),
bs as (select item_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s
    from b where len(w) > 0),
n as (select item_id, count(*) as n from bs group by item_id)
select doc_id, item_id, n as n_item_members, count(*) as n_shared, count(*) / n as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n having count(*) >= n * 0.8"""


URL_FILTER = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as named, rest from u),
p as (select page_id, translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(named) + 1), '^[^?#]*') as path from h),
r(rule_host, rule_path, rule_verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) as verdict
    from p join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fits using (page_id)"""


CONVERSATION_TRIE = """
with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]),
    lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) as t),
h as (select c, c - c % 5 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x))),
    lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 9 as h
    from (select distinct conv_id as c from conversations where conv_id is not null), t),
o as (select conv_id as c, list(struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) order by turn nulls first,
    coalesce(role, ''), coalesce(text, '')) as l from conversations where conv_id is not null group by conv_id),
r as (select h.c, coalesce(b.l[1:h], []) || coalesce(o.l[h + 1:], []) as l from h join o on o.c = h.c left join o as b on b.c = h.base),
p as (select c, l[1:d] as k, d, len(l) as n from (select c, l, unnest(range(0, len(l) + 1)) as d from r)),
node as (select k, d, min(c) as c, count(*) as n, (count(*) - 1) * coalesce(max(strlen(k[d].body)), 0) as own,
    coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = n), '') as ends from p group by k, d),
kids as (select k[1:d - 1] as k, count(*) as n_children from node where d > 0 group by 1),
above as (select k[1:unnest(range(0, d + 1))] as k, own, k not in (select k from kids) as leaf from node),
sums as (select k, sum(own) as saved, count(*) filter (leaf) as leaves from above group by k)
select node.c as conv_id, node.d as depth, up.c as parent_conv_id, node.n as n_convs, coalesce(n_children, 0) as n_children,
    leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(node.ends) as ends_sha256
from node join sums using (k) left join kids using (k) left join node as up on up.k = node.k[1:node.d - 1] and up.d = node.d - 1"""
