"""Fragments of DuckDB SQL that the queries' SQL shares."""

from __future__ import annotations

from loomtext.functions.bm25 import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens(text: str) -> str:
    return f"list_filter(string_split(lower(regexp_replace({text}, '[^A-Za-z]+', ' ', 'g')), ' '), lambda t: t <> '' and length(t) < 128 and t not in ({STOP}))"


def dim(term: str) -> str:
    return f"(list_reduce(list_prepend(5381::bigint, list_transform(string_split({term}, ''), lambda x: ascii(x)::bigint)), lambda h, x: xor((h * 33) & 4294967295::bigint, x)) % 65536 + 1)::int"


def idf(n: str, df: str) -> str:
    return f"(case when {df} is null then ln(2::double) when {df} <= 0 then 0::double else ln(1::double + (greatest({n}, {df}) - {df} + 0.5::double) / ({df} + 0.5::double)) end)"


def weight(idf_: str, tf: str, length: str, mean: str) -> str:
    return f"({idf_} * {tf}::double * 2.2::double / ({tf}::double + 1.2::double * (0.25::double + 0.75::double * {length}::double / {mean})))"


def strip(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '( )[^\x00-\x7F]+', '\1', 'g'), '\A[^\x00-\x7F]+', ''), '[^\x00-\x7F]+', ' ', 'g')"


#: n documents as chunks: terms t, their counts tf, document frequencies df, one row of statistics st.
INDEX = f"""t as (select doc_id id, length(text) // 4 token_count, unnest({tokens('text')}) term from documents),
tf as (select id, token_count, term, count(*) tf from t group by all),
df as (select term, count(distinct id) doc_freq from t group by term),
st as (select greatest(count(*), 1) n, case when avg(length(text) // 4) > 0 then avg(length(text) // 4) else 1::double end avg_len from documents)"""

VECTORS = f"""{INDEX},
vec as (select id, dim, round(sum(w), 6) w from (
  select id, {dim('term')} dim, {weight(idf('n', 'doc_freq'), 'tf', 'greatest(token_count, 1)', 'avg_len')} w from tf join df using (term), st)
  where w > 0 group by id, dim having round(sum(w), 6) > 0)"""


def query_vector(text: str, name: str = "q") -> str:
    """CTEs up to {name}(dim, w) of one query text."""
    return f"""{name}t as (select distinct unnest({tokens(text)}) term),
{name}s as (select term, doc_freq, greatest(n, coalesce(max(doc_freq) over (), 0)) n, avg_len, count(*) over () len from {name}t left join df using (term), st),
{name} as (select dim, round(sum(w), 6) w from (select {dim('term')} dim, {weight(idf('n', 'doc_freq'), '1', 'len', 'avg_len')} w from {name}s) where w > 0 group by dim having round(sum(w), 6) > 0)"""


def chunked(source: str, name: str, size: int, overlap: int, trim: bool = False) -> str:
    """CTEs up to {name}(source_id, chunk_index, content, token_count) of {source}(id, text), cut by tokens.

    After stripping, bytes are characters, so that string functions find the same cuts as a
    chunker on bytes. The query needs WITH RECURSIVE.
    """
    body = "trim(text, ' ')" if trim else "text"
    return rf"""{name}_in as (select id, {strip(body)} body from {source} where {body} is not null and {body} <> ''),
{name}_run as (
  select id, 0 place, body rest, null::varchar piece from {name}_in where body <> ''
  union all
  select id, place + 1, case when step >= n then '' else regexp_replace(substr(rest, step + 1), '\A[ \t\n\r]+', '') end, substr(rest, 1, cut)
  from (
    select *, case when whole or not ({overlap} > 0 and {overlap} < k) then cut
        else least(back + coalesce(nullif(strpos(translate(substr(rest, back + 1, cut - back), chr(10) || chr(9), '  '), ' '), 0) - 1, cut - back), cut) end step
    from (
      select *, (cut + 3) // 4 k, least(((cut + 3) // 4 - {overlap}) * 4, cut) back
      from (
        select *, case when whole or goal >= n then n when good <= 0 then goal else good end cut
        from (
          select *, case when strpos(led, chr(10) || chr(10)) > 0 then greatest(low - 1, 0) + strpos(led, chr(10) || chr(10))
              when stop <> '' then greatest(low - 1, 0) + strpos(led, stop)
              when gap <> '' then low + strpos(near, gap) - 1 else goal end good
          from (
            select *, regexp_extract(led, '[.?!][ \n]') stop, regexp_extract(near, '[ \n]') gap
            from (
              select *, substr(rest, greatest(low - 1, 0) + 1, least(goal + 50, n) - greatest(low - 1, 0)) led, substr(rest, low + 1, least(goal + 50, n) - low) near
              from (
                select *, greatest(goal - 50, 0) low
                from (select *, length(rest) n, least({size} * 4, length(rest)) goal, place = 0 and (length(rest) + 3) // 4 <= {size} whole from {name}_run where rest <> ''))))))))),
{name} as (select id source_id, place chunk_index, piece content, (length(piece) // 4)::int token_count from {name}_run where place > 0)"""


DOCS = "docs as (select doc_id id, text from documents)"
