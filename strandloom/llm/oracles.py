"""DuckDB SQL of the operators that SQL can express: quality rules, chat formatting and phrases.

The others have none: greedy pieces, chains, MinHash posteriors, alignments, boosted trees, token
ids, local searches, linked spans, propagation, runs and byte pairs are tested against brute force instead.
"""

from __future__ import annotations

from strandloom.llm.quality import ALPHA, DELTA, RULES

_SPACE = r"[\x20\x09-\x0D]"
_GRID = ", ".join(f"('{r.measure}', {place}, {cutoff}::double)" for r in RULES for place, cutoff in enumerate(r.grid))
_VALUE = "case g.measure " + " ".join(f"when '{r.measure}' then l.{r.measure}" for r in RULES) + " end"
_HIT = ", ".join(f"case when r.{r.measure} >= (select cutoff from chosen c where c.stratum = r.stratum and c.measure = '{r.measure}') then '{r.measure}' end" for r in RULES)
_RATES = ", ".join(r.measure for r in RULES)
_PART = ALPHA / len(RULES)

QUALITY = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, '') stratum, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') words,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
windows as (select rid, i, array_to_string(words[i:i + 7], ' ') gram from (select rid, words, unnest(range(1, len(words) - 6)) i from w where len(words) >= 8)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) c from windows) where c > 1),
covered as (select rid, cast(sum(least(8, coalesce(nx - i, 8))) as bigint) n from (select rid, i, lead(i) over (partition by rid order by i) nx from twice) group by rid),
m as (select w.rid, doc_id, stratum, cast(len(words) as bigint) n_words, cast(length(regexp_replace(t, '{_SPACE}', '', 'g')) as bigint) word_chars,
 cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words, len(lines) n_lines
 from w left join covered c on c.rid = w.rid),
r as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, n_symbols::double / greatest(word_chars, 1) symbol_rate, n_dup_lines::double / greatest(n_lines, 1) dup_line_rate,
 n_repeat_words::double / greatest(n_words, 1) repeat_rate, word_chars::double / greatest(n_words, 1) long_word_rate from m),
truth as (select doc_id, max(quality) quality from labels where quality is not null group by 1),
good as (select r.* from r join truth using (doc_id) where quality = 1 and not base_failed),
grid(measure, place, cutoff) as (values {_GRID}),
counts as (select stratum, g.measure, place, cutoff, count(*) n, count(*) filter ({_VALUE} >= cutoff) k from good l, grid g group by all),
tested as (select *, case when k < n * {_PART} then list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_PART}) + (n - i) * ln(1 - {_PART}))))
 <= {DELTA} / (select {len(RULES)} * count(distinct stratum) from counts) else false end proven from counts),
chosen as (select stratum, measure, arg_max(cutoff, place) cutoff from (select *, bool_and(proven) over (partition by stratum, measure order by place) ok from tested) where ok group by 1, 2),
judged as (select *, case when base_failed then 'base' else coalesce({_HIT}) end rejected_by from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by is null as kept, rejected_by, {_RATES} from judged
"""

_TOKEN = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\t\n\x0b\f\r \p{L}\p{M}\p{N}]"
_CONTROL = r"</?s>|\[/?(?:SYS|INST|ROLE)\]"


def _escaped(text: str) -> str:
    """Length of an escaped text: a backslash more for each backslash and each control string."""
    return f"(length({text}) + length(regexp_replace({text}, '[^\\\\]', '', 'g')) + len(regexp_extract_all({text}, '{_CONTROL}')))"


#: Windows of 2048 tokens with at most 512 of repeated history; only their lengths are needed.
CHAT = f"""
with rows as (select conv_id, turn, role, text from conversations
 union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
base as (select cast(conv_id as bigint) conv_id, coalesce(turn, -1) turn, coalesce(role, '') as role, coalesce(text, '') body from rows),
sized as (select *, len(regexp_extract_all(body, '{_TOKEN}')) + 2 cost,
 case role when 'system' then 5 when 'user' then 6 when 'assistant' then 7 else 13 + {_escaped('role')} end + {_escaped('body')} + 4 shown from base),
placed as (select *, row_number() over o - 1 place, sum(cost) over (o rows between unbounded preceding and current row) - cost as begun, first(role) over o = 'system' has_system, first(cost) over o lead_cost, first(shown) over o lead_shown
 from sized window o as (partition by conv_id order by turn, role, body)),
a as (select *, case when has_system then lead_cost else 0 end system_cost, has_system and place = 0 is_lead from placed),
b as (select *, greatest(case when 2048 - system_cost - 512 >= 512 then 2048 - system_cost - 512 else least(2048 - system_cost, 512) end, 1) room, greatest(begun - system_cost, 0) gone from a),
c as (select *, case when is_lead then 0 else gone // room end grid, case when is_lead then false else gone + cost > (gone // room + 1) * room end own from b),
windows as (select conv_id, grid, own, min(place) first_place, min(gone) first_gone, sum(case when is_lead then 0 else cost end) new_cost, any_value(system_cost) system_cost, any_value(has_system) has_system, any_value(lead_shown) lead_shown, sum(shown) shown from c group by 1, 2, 3),
h as (select *, case when first_place = 0 then 0 else least(512, greatest(2048 - system_cost - new_cost, 0)) end history from windows),
past as (select h.conv_id, h.grid, h.own, sum(c.shown) shown from h join c on c.conv_id is not distinct from h.conv_id and not c.is_lead and h.history > 0 and c.place < h.first_place and c.gone >= h.first_gone - h.history group by 1, 2, 3),
chars as (select h.conv_id, cast(sum(3 + h.shown + coalesce(p.shown, 0) + case when h.has_system and h.first_place > 0 then h.lead_shown else 0 end) as bigint) formatted_chars
 from h left join past p on p.conv_id is not distinct from h.conv_id and p.grid = h.grid and p.own = h.own group by 1),
digest as (select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by place)) turns_sha256,
 coalesce(string_agg(body, '' order by place) filter (role = 'assistant'), '') loss from placed group by 1)
select d.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from digest d join chars c on d.conv_id is not distinct from c.conv_id
"""

ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY, "op8_chat_formatting": CHAT}

#: Phrases of pieces, counted by language; cuts scored in 128-bit numbers.
_PIECES = """with t as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents where text is not null),
w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') w from t),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest([1, 2, 3]) k))),
f as (select lang, k, phrase, count(*) f from g group by 1, 2, 3),
n as (select lang, cast(sum(f) as bigint) n from f where k = 1 group by 1),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1 and f >= 10),
cuts as (select lang, k, phrase, a, j, array_to_string(w[1:j], ' ') l, array_to_string(w[j + 1:], ' ') r from (select *, unnest(range(1, k)) j from c)),
s as (select c.lang, c.k, c.phrase, c.a, c.j, x.f l, y.f r, cast((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as bigint) score from cuts c
 join f x on x.lang = c.lang and x.phrase = c.l and x.k = c.j join f y on y.lang = c.lang and y.phrase = c.r and y.k = c.k - c.j),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, phrase, max(a) longer from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from c where k = 3) group by 1, 2),
kept as (select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where longer is null or 100 * longer < 50 * b.a)"""

ORACLES["op12_phrase_collocations"] = _PIECES + " select lang, rank, phrase, a, l, r, n, score from kept join n using (lang) where rank <= 2000"
