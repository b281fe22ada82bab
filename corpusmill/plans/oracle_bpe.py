"""SQL text that learns and applies a byte-pair vocabulary, one merge per common table."""

from __future__ import annotations

WORD_PATTERN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"


def merge_tables(texts: str, vocab_size: int, rounds: int) -> str:
    """Common tables ``words``, ``merges``, ``vocab`` and ``word_pieces`` over the query ``texts``.

    ``rounds`` must be at least the number of merges; further rounds change nothing.
    """
    parts = [
        f"""
words as materialized (
  select word, count(*) as n
  from (select unnest(regexp_extract_all(text, '{WORD_PATTERN}')) as word from ({texts}))
  group by word),
chars as materialized (select distinct unnest(string_split(word, '')) as ch from words),
v0 as materialized (select unicode(ch) as sym, ch as str from chars),
s0 as materialized (
  select word, n,
    array_to_string(list_transform(string_split(word, ''), lambda c: ' ' || unicode(c) || ' '), '') as s
  from words)"""
    ]
    for i in range(rounds):
        parts.append(f"""
p{i} as materialized (
  select l, r from (
    select string_split(z, '  ')[1]::int as l, string_split(z, '  ')[2]::int as r, n from (
      select unnest(list_transform(list_zip(a[:-2], a[2:]), lambda z: z[1] || '  ' || z[2])) as z, n
      from (select string_split(trim(s), '  ') as a, n from s{i} where contains(s, '  '))))
  where (select count(*) from v{i}) < {vocab_size - 3}
  group by l, r order by sum(n) desc, l, r limit 1),
m{i} as materialized (
  select p.l, p.r, a.str as lstr, b.str as rstr, o.sym is null as is_new, coalesce(o.sym, {0x110000 + i}) as sym
  from p{i} p join v{i} a on a.sym = p.l join v{i} b on b.sym = p.r left join v{i} o on o.str = a.str || b.str),
v{i + 1} as materialized (select sym, str from v{i} union all select sym, lstr || rstr from m{i} where is_new),
s{i + 1} as materialized (
  select word, n, case when l is null then s else replace(s, ' ' || l || '  ' || r || ' ', ' ' || sym || ' ') end as s
  from s{i} left join m{i} on true)""")
    united = " union all ".join(f"select {i} as i, lstr, rstr from m{i}" for i in range(rounds))
    parts.append(f"""
merges as materialized (
  select (row_number() over (order by i) - 1)::int as rank, lstr as "left", rstr as "right", lstr || rstr as merged
  from ({united})),
ids as materialized (select sym, str, (row_number() over (order by sym) + 2)::int as token_id from v{rounds}),
vocab as materialized (
  select token_id, str as token, false as is_special from ids
  union all values (0, '<|unknown|>', true), (1, '<|im_start|>', true), (2, '<|im_end|>', true)),
word_pieces as materialized (
  select u.word, u.n, list(ids.token_id order by u.pos) as pieces
  from (select word, n, unnest(syms)::int as sym, generate_subscripts(syms, 1) as pos
        from (select word, n, string_split(trim(s), '  ') as syms from s{rounds})) u
  join ids on ids.sym = u.sym
  group by u.word, u.n)""")
    return ",".join(parts)


def encoded_docs(texts: str) -> str:
    """Common table ``encoded(split, doc_id, ids)`` for the query ``texts(split, doc_id, text)``."""
    return f"""
placed as materialized (
  select split, doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos
  from (select split, doc_id, regexp_extract_all(text, '{WORD_PATTERN}') as words from ({texts}))),
encoded as materialized (
  select split, doc_id, flatten(list(pieces order by pos)) as ids
  from placed join word_pieces using (word) group by split, doc_id)"""
