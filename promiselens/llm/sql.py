"""DuckDB SQL of the queries that SQL can express. Whole lines and windows are compared, not hashes."""

from promiselens.llm.quality_rules import LineLimits
from promiselens.llm.warc import BASE32

_LIMITS = LineLimits()

# documents -> quality_verdict(doc_id, host, ..., kept), with the lists of lines; {docs} is the table to judge.
QUALITY = rf"""
quality_docs as (
  select doc_id, source as host, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    list_filter(list_transform(string_split(
      regexp_replace(lower(coalesce(text, '')), '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as normal
  from {{docs}}),
quality_lines as (
  select doc_id, host, body, line, len(string_split(line, ' ')) as w
  from (select doc_id, host, body, unnest(normal) as line from quality_docs)
  where len(string_split(line, ' ')) >= {_LIMITS.min_line_words}),
quality_frequent as (
  select l.host, l.line from (select host, line, count(distinct body) as n from quality_lines group by all) l
  join (select host, count(distinct body) as size from quality_docs group by all) h on l.host is not distinct from h.host
  where l.n > {_LIMITS.max_documents} and l.n * 100.0 > h.size * {_LIMITS.max_share_percent}),
quality_removed as (
  select doc_id, count(*) as n_lines, sum(w) as n_words, list(distinct l.line) as dropped
  from quality_lines l join quality_frequent f on l.host is not distinct from f.host and l.line = f.line group by doc_id),
quality_windows as (
  select doc_id, i, count(*) over (partition by doc_id, win) as times
  from (select doc_id, i, array_to_string(words[i:i + 7], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from quality_docs where len(words) >= 8))),
quality_repeats as (
  select doc_id, count(distinct i + step) as n
  from (select doc_id, i, unnest(range(0, 8)) as step from quality_windows where times > 1) group by doc_id),
quality_verdict as (
  select d.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    len(words) < 20 or 100 * coalesce(r.n, 0) > 30 * len(words) as base_failed,
    coalesce(m.n_lines, 0)::bigint as n_lines_removed, coalesce(m.n_words, 0)::bigint as n_words_removed, m.dropped,
    not base_failed and 100 * (len(words) - coalesce(m.n_words, 0)) >= {_LIMITS.min_left_percent} * len(words) as kept
  from quality_docs d left join quality_repeats r using (doc_id) left join quality_removed m using (doc_id))
"""

# benchmark, {docs} -> contamination(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)
CONTAMINATION = r"""
contamination_docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from {docs}),
contamination_items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
contamination_spans as (
  select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as win
  from (select item_id, words, least(13, len(words)) as n, unnest(range(1, len(words) - least(13, len(words)) + 2)) as i
        from contamination_items where len(words) > 0)),
contamination_found as (
  select doc_id, i, w.n, item_id
  from (select doc_id, l.n, i, array_to_string(words[i:i + l.n - 1], ' ') as win
        from (select doc_id, words, l.n, unnest(range(1, len(words) - l.n + 2)) as i
              from contamination_docs, (select distinct n from contamination_spans) l where len(words) >= l.n) l) w
  join contamination_spans s on s.n = w.n and s.win = w.win),
contamination_hits as (
  select doc_id, count(distinct i + step) as n_hit from
  (select doc_id, i, unnest(range(0, n)) as step from contamination_found) group by doc_id),
contamination_ids as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from contamination_found) group by doc_id),
contamination as (
  select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
  from contamination_docs d left join contamination_hits h using (doc_id) left join contamination_ids i using (doc_id))
"""

# Letters in either case are spelled out, as some engines fold other letters onto them.
_KEYS = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in _KEYS)
_VALUE = r"[A-Za-z0-9+/_.=-]+"
_PATTERNS = [
    ("assign", rf"""(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?({_VALUE})""", 1, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]+)", 1, 16),
    ("private_key", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1),
    ("repo_token", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    ("web_token", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
]
_MATCHES = " union all ".join(
    f"select doc_id, {rank} as rank, '{kind}' as kind, {least} as least, regexp_extract_all(body, '{pattern}') as ms, "
    f"regexp_extract_all(body, '{pattern}', {group}) as own, string_split_regex(body, '{pattern}') as gaps from secret_docs"
    for rank, (kind, pattern, group, least) in enumerate(_PATTERNS)
)

# {docs} -> secret_spans(doc_id, rank, kind, start, stop)
SECRETS = f"""
secret_docs as (select doc_id, coalesce(text, '') as body from {{docs}}),
secret_matches as ({_MATCHES.replace("{", "{{").replace("}", "}}")}),
secret_each as (
  select doc_id, rank, kind, least, unnest(ms) as m, unnest(own) as o, unnest(gaps[1:len(ms)]) as gap, unnest(range(len(ms))) as i
  from secret_matches where len(ms) > 0),
secret_placed as (
  select *, sum(length(gap) + length(m)) over (partition by doc_id, rank order by i) as stop from secret_each),
secret_spans as (
  select doc_id, rank, kind, (stop - length(m))::bigint as start, stop::bigint as stop from secret_placed where length(o) >= least)
"""

_DIGITS = " || ".join(
    f"substr('{BASE32}', ((('0x' || substr(h, {5 * k + 1}, 5))::int >> {shift}) & 31) + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)


def _escaped(text: str, more: tuple[tuple[str, str], ...] = ()) -> str:
    for a, b in (("'\\'", "'\\\\'"), ("'###'", "'\\h'"), ("'</turn>'", "'\\t'"), *more):
        text = f"replace({text}, {a}, {b})"
    return text


# documents -> audit_prices(lang, source, term, n, p, lang_p) of every source and kept term, audit_groups(lang, source).
AUDIT = r"""
audit_docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
audit_groups as (select distinct lang, source from audit_docs),
audit_terms as (select row, lang, source, unnest(terms) as term from audit_docs),
audit_kept as (
  select lang, term, count(*) as n from audit_terms group by all having count(distinct row) >= 3),
audit_langs as (select lang, count(*)::hugeint as terms, sum(n) as total from audit_kept group by all),
audit_counts as (
  select lang, source, term, count(*) as n from audit_terms semi join audit_kept using (lang, term) group by all),
audit_totals as (select lang, source, sum(n) as total from audit_counts group by all),
audit_prices as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.terms) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.terms) as lang_p
  from audit_groups g join audit_kept k using (lang) join audit_langs l using (lang)
  left join audit_counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join audit_totals t on t.lang = g.lang and t.source = g.source),
audit_sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from audit_prices a join audit_prices b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
audit_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from audit_groups a join audit_groups b on a.lang = b.lang and a.source <> b.source
  left join audit_sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
audit_excess as (
  select lang, source, 'term' as part, term as item, ((p - lang_p) * (p - lang_p) // lang_p)::bigint as value
  from audit_prices where n > 0 and p > lang_p)
"""

SQL = {
    "op1_quality_rules": f"with {QUALITY.format(docs='documents')} select * exclude (dropped) from quality_verdict",
    "op3_decontaminate": f"with {CONTAMINATION.format(docs='documents')} select * from contamination",
    "op4_secrets": f"""with {SECRETS.format(docs="documents")}
        select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
          count(*) filter (kind = 'hex') as n_hex,
          sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3), '')) as base_sha256,
          coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank), '') as spans
        from secret_docs d left join secret_spans s using (doc_id) group by d.doc_id""",
    "op5_warc": f"""with p as (select page_id, coalesce(html, '') as body from pages),
        g as (select *, max(page_id) over (partition by body) as largest, sha1(body) as h from p)
        select page_id, strlen(body)::bigint as payload_bytes, {_DIGITS} as payload_digest,
          case when page_id = largest then 'response' else 'revisit' end as record_type,
          case when page_id <> largest then largest end as refers_to from g""",
    "op11_divergence": f"""with {AUDIT},
        audit_ranked as (
          select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
          from (select * from audit_pairs union all select * from audit_excess))
        select * from audit_ranked where part = 'pair' or rank <= 200""",
    "op9_chat": f"""with turns as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations
          union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        measured as (select *, 14 + length({_escaped("said")})
          + length({_escaped("role", (("':'", "'\\c'"), ("chr(10)", "'\\n'")))}) as n from turns)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' order by turn, role, said)) as turns_sha256,
          coalesce(sum(length(said)) filter (role = 'assistant'), 0)::bigint as loss_chars,
          sha256(coalesce(string_agg(said, '' order by turn, said) filter (role = 'assistant'), '')) as loss_sha256,
          sum(n)::bigint as formatted_chars
        from measured group by conv_id""",
}
