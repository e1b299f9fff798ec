"""SQL of the conversation operators, for DuckDB on the same tables: plain shortest paths and string prefixes, no search, no digests."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (the polynomial is a fixed value)."""
    bits = f"flatten(list_transform(str_split({text}, ''), lambda ch: list_transform(range(8), lambda j: ((ascii(ch) >> j) & 1)::bigint)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def repair_sql() -> str:
    """Forward over rows, at most two turns put in before each; a state keeps its cheapest edits, first in ASCII order.

    A row of ``best`` is a conversation, the number of rows done, what stands last (0 nothing, 1 s, 2 u, 3 a), cost and edits.
    """
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(key)} % 20 as kind from conversations
), damaged as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then replace(replace(replace(text, '.', ''), '!', ''), '?', '') else text end as text, copy
  from keyed, (values (1), (2)) as copies(copy)
  where kind <> 0 and (copy = 1 or kind = 3)
), rows as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as n from damaged
), marked as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as initial,
         row_number() over (partition by conv_id, role, text order by n) > 1 as again,
         lead(left(role, 1)) over (partition by conv_id order by n) as next_initial, lead(n) over (partition by conv_id order by n) as next_n
  from rows
), coded as (
  select *, case when body = '' then 'b' when again then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault from marked
), ids as (select distinct conv_id from conversations),
counts as (
  select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count(*) filter (fault = 'b') as blank,
         count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (next_n is not null and initial || next_initial not in ('su', 'ua', 'au')) as illegal, max(n) as n
  from coded group by conv_id
), moves as (
  -- puts: how many turns go in before the row; from what stands last to what stands last then
  select state, puts, case when puts = 0 then state when (state in (0, 1, 3)) = (puts % 2 = 1) then 2 else 3 end as reached
  from (values (0), (1), (2), (3)) as s(state), (values (0), (1), (2)) as p(puts)
), best as (
  select conv_id, 0::bigint as n, 0 as state, 0::bigint as cost, '' as audit from ids
  union all
  select conv_id, n, state, cost, audit from (
    select *, row_number() over (partition by conv_id, state order by cost, audit) as place from (
      select b.conv_id, c.n, e.edit, b.cost + 5 * m.puts + case e.edit when 'D' then 2 when 'R' then 1 else 0 end + case when e.edit <> 'D' and c.fault = 't' then 5 else 0 end as cost,
             b.audit || repeat('I', m.puts) || e.edit as audit,
             case when e.edit = 'D' then m.reached
                  when e.edit = 'R' then case when m.reached = 2 then 3 else 2 end
                  when c.initial = 's' and m.reached = 0 then 1
                  when c.initial = 'u' and m.reached <> 2 then 2
                  when c.initial = 'a' and m.reached = 2 then 3 end as state
      from best b join coded c on c.conv_id is not distinct from b.conv_id and c.n = b.n + 1
      join moves m on m.state = b.state, (values ('D'), ('K'), ('R')) as e(edit)
      where e.edit = 'D' or c.fault not in ('b', 'd')
    ) where state is not null
  ) where place = 1
), ended as (
  select b.conv_id, b.cost + 5 * m.puts as cost, b.audit || repeat('I', m.puts) as audit,
         row_number() over (partition by b.conv_id order by b.cost + 5 * m.puts, b.audit || repeat('I', m.puts)) as place
  from best b left join counts c on c.conv_id is not distinct from b.conv_id join moves m on m.state = b.state
  where b.n = coalesce(c.n, 0) and m.reached in (0, 3)
), chosen as (select conv_id, cost, audit from ended where place = 1
), letters as (
  select conv_id, audit, unnest(range(1, length(audit) + 1)) as spot from chosen
), edits as (
  select conv_id, spot, audit[spot] as edit, spot - length(replace(left(audit, spot), 'I', '')) as puts, length(replace(left(audit, spot), 'I', '')) as n from letters
), written as (
  select e.conv_id, e.spot, e.edit, c.role, coalesce(c.text, '') as text, row_number() over (partition by e.conv_id order by e.spot) as place,
         first_value(case when e.edit = 'K' and c.initial = 's' then 1 else 0 end) over (partition by e.conv_id order by e.spot) as headed
  from edits e left join coded c on c.conv_id is not distinct from e.conv_id and c.n = e.n and e.edit <> 'I' where e.edit <> 'D'
), texts as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || case edit when 'I' then '' else text end, chr(10) order by spot) as repaired
  from written group by conv_id
)
select i.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated,
       coalesce(c.illegal, 0)::bigint as illegal, h.cost::bigint as cost, h.audit, sha256(coalesce(t.repaired, '')) as repaired_sha256
from ids i left join counts c on c.conv_id is not distinct from i.conv_id join chosen h on h.conv_id is not distinct from i.conv_id
left join texts t on t.conv_id is not distinct from i.conv_id
"""


def prefixes_sql() -> str:
    """Prefixes as strings; subtrees by comparing every node with all of its ancestors."""
    return f"""
with ordered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as n
  from conversations where conv_id is not null
), ids as (
  select conv_id, conv_id - conv_id % 20 as base, {crc32_sql("conv_id::varchar")} % 4 as heads from (select distinct conv_id from ordered)
), rebuilt as (
  select i.conv_id, 0 as own, o.n, o.role, o.text from ids i join ordered o on o.conv_id = i.base and o.n <= i.heads
  union all
  select i.conv_id, 1, o.n, o.role, o.text from ids i join ordered o on o.conv_id = i.conv_id and o.n > i.heads
), numbered as (
  select conv_id, row_number() over (partition by conv_id order by own, n) as depth, role, text from rebuilt
), paths as (
  select conv_id, depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (partition by conv_id order by depth) as path,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (partition by conv_id order by depth rows between unbounded preceding and 1 preceding) as parent,
         len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words
  from numbered
  union all
  select conv_id, 0, '', null, 0 from ids
), lengths as (
  select conv_id, max(depth) as depth from paths group by conv_id
), nodes as (
  select path, depth, case when depth > 0 then coalesce(max(parent), '') end as parent, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words from paths group by path, depth
), ends as (
  select p.path, p.depth, string_agg(p.conv_id::varchar, ',' order by p.conv_id) as ids from paths p join lengths l using (conv_id, depth) group by p.path, p.depth
), children as (
  select parent as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2
), under as (
  -- a node's ancestors are the prefixes of its smallest member
  select p.path, p.depth, sum((n.n_convs - 1) * n.words) as saved_tokens, count(*) filter (c.n_children is null) as n_leaves
  from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth left join children c on c.path = n.path and c.depth = n.depth
  group by p.path, p.depth
)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n_children, 0)::bigint as n_children,
       t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join under t on t.path = n.path and t.depth = n.depth left join nodes u on u.path = n.parent and u.depth = n.depth - 1
left join children c on c.path = n.path and c.depth = n.depth left join ends e on e.path = n.path and e.depth = n.depth
"""
