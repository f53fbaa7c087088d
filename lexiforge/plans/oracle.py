"""DuckDB SQL for plans.queries: the same results by another engine.

RE2 has no look-around and no back-references, so splits mark the boundary with a control
character first, and lists use lambdas.
"""

from __future__ import annotations

from lexiforge.functions.normalize import FRONT, PAIRS, TAIL, char_class
from lexiforge.functions.profiles import INVISIBLE, JA, JAPANESE, JAPANESE_BROAD, LATIN, LATIN_LETTERS, SCRIPT_MARKS, WS, ngram_chars
from lexiforge.functions.scoring import PRIORITY
from lexiforge.operators.tokenizers import JAPANESE_RUNS
from lexiforge.operators.userdict import POS_MAP, POS_PRIORITY
from lexiforge.plans import japanese as J
from lexiforge.plans.queries import ACCENTED, ENTITIES, FINGERPRINT, WORD


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def count(x: str, members: str) -> str:
    return f"length(regexp_replace({x}, {q(f'[^{members}]+')}, '', 'g'))"


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(f'[{INVISIBLE}]+')}, '', 'g'), {q(f'[{SCRIPT_MARKS}]+')}, '', 'g')"


def full_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def paragraphs(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace({x}, '\\n{{2,}}', chr(10)||chr(10), 'g'), '[ \\t]+', '　', 'g'), chr(10)||chr(10)), lambda p: p <> '')"


def after_terminator(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([。.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"


def on_punctuation(x: str) -> str:
    marked = f"regexp_replace({x}, '([。．！？!?]+)[{WS}]*([^{WS}。．！？!?])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"


def penalty(x: str, narrow: str, ends: str) -> str:
    visible = f"(length({x}) - {count(x, WS)})"
    return (
        f"(0.25::double * ((length({x}) - length(replace({x}, '[...]', ''))) / 5)::int + 0.05::double * (length({x}) - length(replace({x}, '「', '')))"
        f" + case when {visible} > 0 then 1 - {count(x, narrow)}::double / {visible} else 0.0 end"
        f" + case when regexp_matches({x}, '[{ends}]$') then 0.0 else 0.5 end)"
    )


def valid(x: str, script: str, broad: str, low: int, high: int) -> str:
    visible = f"(length({x}) - {count(x, WS)})"
    return (
        f"(regexp_matches({x}, '[{script}]') and not (regexp_matches({x}, '^[ぁ-んァ-ン一-龯]+[{WS}]+[A-ZＭＳLR]([{WS}]|$)')"
        f" or ((contains({x}, '行き方') or contains({x}, '入手方法') or contains({x}, '戦闘開始時')) and length({x}) < 20))"
        f" and (length({x}) - length(replace({x}, '[...]', ''))) / 5 <= 2"
        f" and case when {visible} > 0 then {count(x, broad)}::double / {visible} >= 0.55 else true end"
        f" and length({x}) between {low} and {high})"
    )


def indent(x: str) -> str:
    lead = f"regexp_extract({x}, '^[ \\t　]*')"
    return f"(length({lead}) + 3 * {count(lead, chr(9))} + {count(lead, '　')})"


def mode(x: str) -> str:
    raw = f"list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} <> '')"
    widths = f"list_transform({raw}, lambda l: {indent('l')})"
    full = full_lines(x)
    return f"""(select case
      when len(w) >= 4 and len(list_distinct(w)) >= 2 and len(list_filter(range(2, len(w) + 1), lambda i: w[i] > w[i - 1]))::double / (len(w) - 1) >= 0.25 then 'indented_continuation'
      when n >= 5 and total::double / n <= 45 and short::double / n > 0.7 and closed::double / n < 0.4 then 'line_dialogue'
      when n >= 3 and total::double / n <= 50 and short::double / n > 0.8 then 'sentence_list'
      else 'paragraph' end
      from (select w, len(f) n, list_sum(list_transform(f, lambda l: length(l))) total, len(list_filter(f, lambda l: length(l) <= 40)) short, len(list_filter(f, lambda l: regexp_matches(l, '[。！？]$'))) closed
            from (select {widths} w, {full} f)))"""


DOCS = "docs as (select doc_id file_id, coalesce(source, '[no tag]') tag, text from documents where text is not null)"


def exploded(source: str, lists: str, keys: str, name: str) -> str:
    """Rows (keys, ord, name) of a list column, ordinals from 0."""
    return f"select {keys}, unnest(range(0, len(x)))::int ord, unnest(x) {name} from (select {keys}, {lists} x from {source})"


CLEANED = f"cleaned as (select file_id, tag, {clean('text')} text from docs)"
MODED = f"moded as materialized (select file_id, tag, text, {mode('text')} mode from cleaned)"
SENTENCES = (
    f"sents as materialized (select file_id, tag, unnest(range(0, len(x)))::int sent_ord, unnest(x) text from (select file_id, tag, flatten(list_transform("
    f"case when mode = 'paragraph' then flatten(list_transform({paragraphs('text')}, lambda p: {after_terminator('p')})) else {full_lines('text')} end, lambda s: {on_punctuation('s')})) x from moded))"
)
STOPS = ", ".join(map(q, LATIN.stop_words))
USEFUL = (
    f"toks as (select file_id, tag, sent_ord, unnest(range(0, len(x))) tok_ord, unnest(x) surface from (select file_id, tag, sent_ord, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+') x from sents)),"
    f" useful as materialized (select *, lower(surface) lemma, row_number() over (partition by file_id order by sent_ord, tok_ord) pos_no from toks where length(lower(surface)) >= {LATIN.min_lemma} and lower(surface) not in ({STOPS}))"
)
PLACES = "places as materialized (select file_id, lemma, count(*) frequency, min(pos_no)::double / max(n_file) place, min(struct_pack(f := file_id, s := sent_ord, t := tok_ord)) seen_at, min(tag) tag from (select *, max(pos_no) over (partition by file_id) n_file from useful) group by file_id, lemma)"
LEXICON = "lex as materialized (select lemma, sum(frequency)::bigint frequency, avg(place) idx, count(*)::int index_count, list_sort(list_distinct(list(tag))) tags, min(seen_at) seen_at from places group by lemma)"
BASE = f"with {DOCS}, {CLEANED}, {MODED}, {SENTENCES}"
TOKENS = f"{BASE}, {USEFUL}, {PLACES}, {LEXICON}"
#: Order statistic: the frequency at place floor(n * (100 - keep) / 100).
THRESHOLD = "(select greatest({low}, (list_sort(list(frequency)))[greatest(0, (count(*) * (100 - {keep})) // 100) + 1]) from {table})"
WORDS = (
    f"{TOKENS}, kept as (select * from lex where frequency >= {THRESHOLD.format(low=4, keep=98, table='lex')}),"
    " raws as (select *, (0.7::double * ln(1 + frequency) / ln(1 + (select max(frequency) from kept)) + 0.3::double * pow(1 - idx, 1.5)) * case when len(tags) >= 10 then 1.0::double else 0.1::double + 0.9::double * (greatest(len(tags), 1) - 1) / 9 end raw from kept),"
    " words as materialized (select *, round(round(raw / (select max(raw) from raws) * 1000, 2), 1) score from raws)"
)
VALID = f"vals as (select file_id, sent_ord, tag, text from sents where {valid('text', LATIN.script, LATIN.broad, LATIN.min_length, LATIN.max_length)})"
SEGMENTS = f"{VALID}, segs as materialized (select u.file_id, u.sent_ord, u.lemma, max_by(u.surface, u.tok_ord) surface, min(u.tok_ord) first_tok, any_value(v.text) text, any_value(v.tag) tag from useful u join vals v using (file_id, sent_ord) group by u.file_id, u.sent_ord, u.lemma)"
STATS = (
    f"{WORDS}, {SEGMENTS}, scored as (select s.*, w.score from segs s left join words w using (lemma)),"
    " stats as materialized (select *, count(score) over seg n_known, count(*) over seg n_total, coalesce(sum(round(score * 10)::bigint) over seg / (count(score) over seg * 10), 0)::double mean, coalesce(var_pop(score) over seg, 0) variance, rank() over (partition by file_id, sent_ord order by score desc nulls last) - 1 too_hard from scored window seg as (partition by file_id, sent_ord))"
)
FIT = (
    f"{STATS}, cands as (select *, round(round(variance / 100000 + (n_total - n_known)::double / n_total * 0.9::double + abs(length(text) - 25)::double / 15 + greatest(0, 6 - n_known) * 0.5::double"
    f" + {penalty('text', LATIN.narrow, LATIN.terminators)} + abs(mean - score) / (select max(score) from words) * 1.5::double + too_hard::double / n_total * 0.9::double, 9), 6) fitness, text as key from stats where score is not null),"
    " uniq as (select lemma, key, arg_min(struct_pack(text := text, tag := tag, surface := surface, mean := mean, fitness := fitness), struct_pack(a := fitness, b := file_id, c := sent_ord)) x, min(struct_pack(f := file_id, s := sent_ord)) first_seen from cands group by lemma, key),"
    " ranked as materialized (select lemma, row_number() over (partition by lemma order by x.fitness, first_seen) pos, x from uniq)"
)
#: Every word's examples: the three best, then further sentences in text order.
ATTACHED = f"""{FIT}, prim as (select lemma, pos, x.text as text, x.tag as tag, x.surface surface, round(round(x.mean::decimal(18, 6), 2), 1)::double score from ranked where pos <= 3),
    have as (select lemma, count(*) have from prim group by lemma),
    need as (select w.lemma, w.score, coalesce(h.have, 0) have from words w left join have h using (lemma) where coalesce(h.have, 0) < 3),
    tx as (select s.lemma, s.text, arg_min(s.surface, struct_pack(f := s.file_id, s := s.sent_ord)) surface, arg_min(s.tag, struct_pack(f := s.file_id, s := s.sent_ord)) tag, min(struct_pack(f := s.file_id, s := s.sent_ord)) seen_at, any_value(n.score) score, any_value(n.have) have from segs s join need n using (lemma) group by s.lemma, s.text),
    fr as (select *, row_number() over (partition by lemma order by seen_at) n from tx where not exists (select 1 from prim p where p.lemma = tx.lemma and p.text = tx.text)),
    att as materialized (select lemma, pos, text, tag, surface, score from prim union all select lemma, have + n, text, tag, surface, round(-score, 1) from fr where n <= 3 - have)"""
SHOWN = "(case when strpos(text, surface) > 0 then substr(text, 1, strpos(text, surface) - 1) || '<span class=''highlight''>' || surface || '</span>' || substr(text, strpos(text, surface) + length(surface)) else text end || '<br><span class=''tag sentence-tag''>' || coalesce(tag, 'None') || ' - ' || score::varchar || '</span>')"
ITEMS = f"items as (select item_id i, regexp_extract_all(lower(text), {q(WORD)}) w from benchmark)"
PRI = " + ".join(["case when {m} ~ '^nf[+-]?[0-9]{{1,8}}$' then (49 - substr({m}, 3)::int) * 100 else 0 end", *(f"case when {{m}} = '{k}' then {v} else 0 end" for k, v in PRIORITY.items())])
M1, M2 = "('nf' || lpad((i % 48 + 1)::varchar, 2, '0'))", "(case when i % 2 = 0 then 'ichi1' else 'news2' end)"
P12, P2 = f"({PRI.format(m=M1)} + {PRI.format(m=M2)})", f"({PRI.format(m=M2)})"
GLOSS = "list_filter(list_transform(range(0, i % 3 + 1), lambda k: struct_pack(k := k, g := case when k % 2 = 0 then (w[1] || k::varchar) || '; ' || w[2] end)), lambda e: e.g is not null)"
DICTIONARY = (
    f"{ITEMS}, forms as (select i, unnest(list_distinct([w[1], w[2], w[3], w[4]])) form, w from items where len(w) >= 4),"
    f" prio as (select form, i entry_ord, (case when form = w[1] then {P12} else 0 end) + (case when form = w[3] then {P2} else 0 end) priority, i % 3 + 1 n_senses, w,"
    f" array_to_string(list_transform({GLOSS}, lambda e: case when i % 3 > 0 then (e.k + 1)::varchar || '. ' else '' end || e.g), '<br>') definition from forms),"
    " dict as materialized (select form, entry_ord, priority::int priority, n_senses::int n_senses, definition, w[3] first_reading from (select *, row_number() over (partition by form order by priority desc, n_senses desc, entry_ord) r from prio) where r = 1)"
)
FINISHED = (
    f"{ATTACHED}, {DICTIONARY}, defined as (select w.*, d.definition, coalesce(d.definition, '') = '' invalid from words w left join dict d on d.form = w.lemma),"
    f" html as (select lemma, count(*) n, string_agg({SHOWN}, '<br><br>' order by pos) html from att group by lemma),"
    " rows_ as (select d.lemma word, d.score, d.lemma reading, printf('%.2f', d.idx) as \"index\", d.frequency, coalesce(d.definition, '') definition, array_to_string(d.tags, ' ') tags, 'sentences: ' || coalesce(h.n, 0)::varchar n_sentences, coalesce(h.html, 'no sentences :(') html, d.invalid from defined d left join html h using (lemma))"
)
DEFINED = f"{WORDS}, {DICTIONARY}, defined as (select w.*, d.definition, coalesce(d.definition, '') = '' invalid from words w left join dict d on d.form = w.lemma)"
PLAIN = f"{DOCS}, plain as (select file_id, tag, unnest(regexp_extract_all(lower(text), {q(WORD)})) word from docs), freq as (select word, count(*) frequency, count(distinct tag) n_sources from plain group by word)"
CHANGES = (
    f"with {PLAIN}, new as (select word e, frequency::varchar f, ['new', 's' || n_sources::varchar] tags from freq where frequency >= 4),"
    f" seen as (select item_id, unnest(range(0, len(w))) i, unnest(w) w from (select item_id, regexp_extract_all(lower(text), {q(WORD)}) w from benchmark)),"
    " old as (select w expression, max(item_id * 100000 + i) note_id, arg_max((item_id % 7)::varchar, item_id * 100000 + i) f, ['old', 's20'] tags from seen group by w),"
    " both_ as (select coalesce(expression, e) expression, note_id, e, old.f old_f, new.f new_f, old.tags old_t, new.tags new_t from old full outer join new on expression = e),"
    " changes as materialized ("
    " select 'delete' op, note_id, expression, '' tags, null frequency from both_ where e is null"
    " union all select 'add', null, expression, array_to_string(list_sort(new_t), ' '), new_f from both_ where note_id is null"
    " union all select 'updateFields', note_id, expression, '', new_f from both_ where note_id is not null and e is not null and old_f <> new_f"
    " union all select 'addTags', note_id, expression, array_to_string(list_sort(list_filter(new_t, lambda t: not list_contains(old_t, t))), ' '), null from both_ where note_id is not null and e is not null and len(list_filter(new_t, lambda t: not list_contains(old_t, t))) > 0"
    " union all select 'removeTags', note_id, expression, array_to_string(list_sort(list_filter(old_t, lambda t: not list_contains(new_t, t))), ' '), null from both_ where note_id is not null and e is not null and len(list_filter(old_t, lambda t: not list_contains(new_t, t))) > 0)"
)
KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRA = "".join(chr(ord(c) - 0x60) for c in KATA)


#: Runs of four and more equal characters become three: a character goes if the three before it equal it.
RUNS = "array_to_string(list_transform(list_filter(list_zip(cs, range(1, len(cs) + 1)), lambda e: not (e[2] > 3 and cs[e[2] - 1] = e[1] and cs[e[2] - 2] = e[1] and cs[e[2] - 3] = e[1])), lambda e: e[1]), '')"


def ends_cut(t: str, p: str) -> str:
    """A text less a lone bracket at either end, or less a pair that occurs once and wraps it."""
    o, c = f"{p}[1]", f"{p}[2]"
    n = lambda x: f"(length({t}) - length(replace({t}, {x}, '')))"
    wrapped = f"(starts_with({t}, {o}) and ends_with({t}, {c}) and {n(o)} = 1 and {n(c)} = 1)"
    front = f"(case when {wrapped} or (starts_with({t}, {o}) and {n(c)} = 0) then 1 else 0 end)"
    back = f"(case when {wrapped} or (ends_with({t}, {c}) and {n(o)} = 0) then 1 else 0 end)"
    return f"substr({t}, 1 + {front}, greatest(0, length({t}) - {front} - {back}))"


def normalised(source: str, spaced: bool = False) -> str:
    """CTEs from ``source`` (file_id, sent_ord, text) to norm, white space taken out, or made one blank."""
    gap = f"regexp_replace(text, '[{WS}]+', '{' ' if spaced else ''}', 'g')"
    gap = strip(gap) if spaced else gap
    brackets = char_class("".join(PAIRS))
    tail = "t3"
    for pattern, shown in TAIL:
        tail = f"regexp_replace({tail}, {q(pattern)}, {q(shown)}, 'g')"
    pairs = f"[{', '.join(map(q, PAIRS))}]"
    ends = f"(length(regexp_extract(t1, '^{brackets}*')) + length(regexp_extract(t1, '{brackets}*$')))"
    return (
        f"n1 as materialized (select file_id, sent_ord, regexp_replace(regexp_replace(nfc_normalize({gap}), '→+', '', 'g'), '^{char_class(FRONT)}+', '') t1 from {source}),"
        f" n2 as materialized (select file_id, sent_ord, case when {ends} > 0 then list_reduce(list_concat([t1], flatten(list_transform(range(0, {ends}), lambda i: {pairs}))), lambda t, p: {ends_cut('t', 'p')}) else t1 end t2 from n1),"
        f" n3 as (select file_id, sent_ord, {RUNS} t3 from (select file_id, sent_ord, string_split(t2, '') cs from n2)),"
        f" norm as (select file_id, sent_ord, {tail} as text from n3)"
    )


#: The whole plan: everything above over normalised sentences, with readings of the dictionary.
MINED = FINISHED.replace(
    SENTENCES,
    SENTENCES.replace("sents as materialized", "raw_sents as materialized") + f", {normalised('raw_sents', True)}, sents as materialized (select n.file_id, s.tag, n.sent_ord, n.text from norm n join raw_sents s using (file_id, sent_ord) where length(n.text) >= 5 and {count('n.text', LATIN.core)} >= 2)",
)
MINED = MINED.replace("select w.*, d.definition,", "select w.*, d.first_reading, d.definition,").replace("d.lemma reading", "coalesce(d.first_reading, d.lemma) reading")


#: The documents and their distinct words in Japanese script.
JA_TEXT = "case doc_id % 4 " + " ".join(f"when {i} then translate(text, {q(J.LETTERS)}, {q(t)})" for i, t in enumerate(J.TEXTS)) + " end"
JA_DOCS = f"(select doc_id id, {JA_TEXT} text from documents where text is not null)"
LOWER = J.ascii_lowercase
JA_WORD = f"case (length(latin) + unicode(latin)) % 8 when 7 then translate(latin, '{LOWER}', '{J.WORDS[7]}') || 'ー' when 6 then substr(translate(latin, '{LOWER}', '{J.WORDS[6]}'), 1, 1) " + " ".join(f"when {i} then translate(latin, '{LOWER}', '{J.WORDS[i]}')" for i in range(6)) + " end"
JA_WORDS = f"(select latin, {JA_WORD} word from (select distinct unnest(regexp_extract_all(lower(text), {q(WORD)})) latin from documents))"
JA_MARKED = "case (id + ord) % 12 when 0 then '名前>' || piece when 1 then piece || '[...]' when 2 then '「' || piece when 3 then '行き方 ' || substr(piece, 1, 8) when 4 then substr(piece, 1, 4) when 5 then '名前>' || substr(piece, 1, 12) when 6 then substr(piece, 1, 3) || ' Ｍ ' || substr(piece, 1, 9) when 7 then piece || '[...][...][...]' when 8 then substr(piece, 1, 40) || '。' when 9 then substr(piece, 1, 30) else piece end"
POS_PAIRS = "[" + ", ".join(f"['{a}', '{b}']" for a, b in J.POS_PAIRS) + f"][(length(latin) * 7 + unicode(latin)) % {len(J.POS_PAIRS)} + 1]"


def picked(names: tuple[str, ...]) -> str:
    every = f"[{', '.join(map(q, names))}]"
    return f"([{', '.join(f'{every}[(item_id * 7 + {j} * 5) % {len(names)} + 1]' for j in range(3))}])[1:item_id % 4]"


POS_CASE = " ".join(f"when {q(k)} then {q(','.join(v))}" for k, v in POS_MAP.items())
PRIO_CASE = " ".join(f"when {q(p)} then {i}" for i, p in enumerate(POS_PRIORITY))
SPACED = "regexp_replace(text, '[.] ', '.' || chr(10), 'g')"
LAID = (
    f"laid as (select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then {SPACED} else"
    f" array_to_string(list_transform(list_filter(string_split({SPACED}, chr(10)), lambda l: l <> ''), lambda x, i: repeat(' ', ((i - 1) % 3)::int) || x), chr(10)) end text from documents)"
)
GRAMS = "select distinct substr(r, s::int, k::int) candidate from (select r, s, unnest(range({low}, least({high}, length(r) - s + 1) + 1)) k from (select r, unnest(range(1, length(r) - {low} + 2)) s from (select distinct unnest(regexp_extract_all(text, '[{members}]+')) r from {source})))"
HIT = "regexp_extract(text, '[A-Za-z]{4,}')"


def split_pieces(rows: str) -> str:
    return exploded(rows, on_punctuation("text"), "id", "piece")


def kana_fold(rows: str) -> str:
    return f"select id, translate(text, '{KATA}', '{HIRA}') folded from {rows}"


def quality_ja(rows: str, keys: str = "id") -> str:
    body = strip("substr(text, strpos(text, '>') + 1)")
    return f"select {keys}, round({penalty('text', JAPANESE, '。！？')}, 6) penalty, {valid('text', JAPANESE, JAPANESE_BROAD, 10, 50)} valid, length(text) >= 5 and {count('text', chr(0x3040) + '-' + chr(0x309F))} >= 2 keep, case when contains(text, '>') and regexp_matches({body}, '[\\x{{4e00}}-\\x{{9fff}}]') then {body} else text end as key from {rows}"


def priority_scores(rows: str, key: str = "id") -> str:
    return f"select {key}, coalesce(list_sum(list_transform(pri, lambda m: {PRI.format(m='m')})), 0)::int points from {rows}"


def resolved_pos(rows: str) -> str:
    return f"""select id, (list_sort(list_filter(list_transform(pos, lambda p, i: struct_pack(r := coalesce(case split_part(case p {POS_CASE} end, ',', 1) {PRIO_CASE} end, {len(POS_PRIORITY)}), i := i, m := case p {POS_CASE} end)), lambda e: e.m is not null)))[1].m resolved,
            len(list_filter(pos, lambda p: not starts_with(p, 'noun'))) = 0 nouns, len(list_filter(pos, lambda p: not (starts_with(p, 'noun') or contains(p, 'verb')))) = 0 verbs_or_nouns, len(list_filter(pos, lambda p: starts_with(p, 'expressions'))) > 0 expression from {rows}"""


def costs(rows: str) -> str:
    return f"select id, e, case when e then 500 * length(text)::int - 1000 + case when regexp_matches(text, '^[ぁ-んー]+$') then case when length(text) < 3 then 1000 else 500 end else 0 end else 1750 * length(text)::int end cost, regexp_matches(text, '^[ぁ-んー]+$') hiragana from {rows}, (values (true), (false)) as f(e)"


def is_useless(p1: str = "p1", p2: str = "p2") -> str:
    return f"(lemma = '' or regexp_matches(lemma, '^\\p{{Nd}}+$') or regexp_matches(lemma, '^[a-zA-ZÀ-ÿ''-]+$') or not regexp_matches(lemma, '[{JAPANESE}]') or regexp_matches(lemma, '[っゃゅょァィゥェォッャュョー]$') or {p1} in ('助詞', '記号', '補助記号', '感動詞', '接頭辞', '接尾辞', '代名詞') or ({p1} = '名詞' and {p2} in ('固有名詞', '代名詞')) or regexp_matches(lemma, '^[ぁ-んァ-ン]$') or regexp_matches(lemma, '^[ァ-ンー]+$'))"


def useless(rows: str) -> str:
    return f"select id, {is_useless()} useless from {rows}"


def mined_ja() -> str:
    """MINED with the Japanese classes, runs and rules over the documents in Japanese script."""
    kept = lambda p: f"length(n.text) >= 5 and {count('n.text', p)} >= 2"
    word = "lower(surface)"
    changes = {
        DOCS: DOCS.replace(", text from", f", {JA_TEXT} text from"),
        normalised("raw_sents", True): normalised("raw_sents"),
        kept(LATIN.core): kept(JA.core),
        "'[A-Za-zÀ-ÖØ-öø-ÿ]+'": q(JAPANESE_RUNS.pattern),
        f"length({word}) >= {LATIN.min_lemma} and {word} not in ({STOPS})": "not " + is_useless("'名詞'", "'普通名詞'").replace("lemma", word),
        valid("text", LATIN.script, LATIN.broad, LATIN.min_length, LATIN.max_length): valid("text", JAPANESE, JAPANESE_BROAD, JA.min_length, JA.max_length),
        penalty("text", LATIN.narrow, LATIN.terminators): penalty("text", JAPANESE, JA.terminators),
        ITEMS: f"items as (select item_id i, regexp_extract_all(translate(text, {q(J.LETTERS)}, {q(J.TEXTS[2])}), {q(JAPANESE_RUNS.pattern)}) w from benchmark)",
        "coalesce(d.first_reading, d.lemma) reading": f"translate(coalesce(d.first_reading, d.lemma), '{KATA}', '{HIRA}') reading",
    }
    out = MINED
    for latin, own in changes.items():
        if latin not in out:
            raise ValueError(f"not in the mining plan's SQL: {latin[:60]}")
        out = out.replace(latin, own)
    return out


def oracle_sql() -> dict[str, str]:
    mined_rows = """ select case when invalid then 'dropped' else 'kept' end status, word, score, reading, "index", frequency, definition, tags, n_sentences, html from rows_"""
    mined_examples = " select case when d.invalid then 'dropped' else 'kept' end status, d.lemma word, d.score, a.text sentence, a.tag, null::varchar origin, a.surface surface_form, (row_number() over (partition by a.lemma order by a.pos) - 1)::int pos from att a join defined d using (lemma)"
    return {
        "word_frequency": f"with {PLAIN} select word, frequency, n_sources from freq",
        "word_scores": f"{WORDS} select lemma word, frequency, len(tags)::int n_tags, round(idx, 6) mean_index, score from words",
        "clean_text": f"select doc_id, {clean('chr(65279) || chr(123) || text || chr(8203) || chr(62) || chr(8210) || chr(7) || chr(8943)')} cleaned from documents",
        "line_sentences": f"with {DOCS} {exploded('docs', full_lines('text'), 'file_id', 'line')}",
        "paragraph_sentences": f"with {DOCS} {exploded('docs', f'flatten(list_transform({paragraphs("text")}, lambda p: {after_terminator("p")}))', 'file_id', 'piece')}",
        "punct_split": f"with {DOCS} {exploded('docs', on_punctuation('text'), 'file_id', 'piece')}",
        "punct_split_ja": split_pieces(JA_DOCS),
        "kana_fold": kana_fold(JA_DOCS),
        "source_tags": "with p as (select doc_id, '/corpus/[' || source || ']/' || doc_id::varchar || case when doc_id % 3 = 0 then '.txt' else '[x].srt' end path from documents), b as (select doc_id, case when doc_id % 5 = 0 then regexp_replace(path, '[\\[\\]]', '', 'g') else path end path from p) select doc_id, coalesce(nullif(regexp_extract(path, '\\[(.+?)\\]', 1), ''), '[no tag]') tag from b",
        "sentence_quality": f"{BASE} select file_id, sent_ord, round({penalty('text', LATIN.narrow, LATIN.terminators)}, 6) penalty, length(text)::int n_chars from sents",
        "sentence_quality_ja": quality_ja(f"(select id, ord, {JA_MARKED} text from ({split_pieces(JA_DOCS)}))", "id, ord"),
        "layout_mode": f"with {LAID} select doc_id, {mode('text')} mode from laid",
        "indent_join": f"""with {LAID}, ls as (select doc_id, unnest(range(0, len(x))) i, unnest(x) l from (select doc_id, list_filter(string_split(text, chr(10)), lambda l: {strip('l')} <> '') x from laid)),
            st as (select *, {indent('l')} w from ls), fl as (select *, case when w < lag(w) over (partition by doc_id order by i) then 1 else 0 end fresh from st),
            gr as (select *, sum(fresh) over (partition by doc_id order by i) g from fl) select doc_id, g::int ord, string_agg({strip('l')}, '' order by i) sentence from gr group by doc_id, g""",
        "dialogue_mode": f"with talks as (select conv_id, string_agg(text, chr(10) order by turn, text) text from conversations group by conv_id) select conv_id, {mode('text')} mode, len({full_lines('text')})::int n_lines from talks",
        "page_lines": f"select page_id, len({full_lines(clean('html'))})::int n_lines, length({clean('html')})::int n_chars from pages",
        "extract_sentences": f"{BASE} select file_id, sent_ord, text from sents",
        "normalise_sentences": f"{BASE}, {normalised('sents')} select file_id, sent_ord, text from norm where length(text) >= 5 and {count('text', LATIN.core)} >= 2",
        "valid_sentences": f"{BASE}, {VALID} select file_id, sent_ord, tag from vals",
        "useful_tokens": f"{TOKENS} select file_id, count(*) n_useful, sum(pos_no)::bigint pos_sum, count(distinct lemma) n_lemmas from useful group by file_id",
        "build_lexicon": f"{TOKENS} select lemma, frequency, index_count, round(idx, 6) mean_index, lemma reading, seen_at.f first_file, seen_at.s::int first_sent from lex",
        "tag_sets": f"{TOKENS} select lemma, array_to_string(tags, ' ') tags from lex",
        "token_position_index": f"{TOKENS} select file_id, lemma, frequency, round(place, 9) place from places",
        "sentence_lemma_map": f"{TOKENS}, {SEGMENTS} select file_id, sent_ord, string_agg(lemma || '=' || surface, ' ' order by first_tok) lemma_surfaces from segs group by file_id, sent_ord",
        "frequency_threshold": f"{TOKENS} select 98 keep_percent, {THRESHOLD.format(low=4, keep=98, table='lex')} threshold union all select 50, {THRESHOLD.format(low=1, keep=50, table='lex')} union all select 10, {THRESHOLD.format(low=1, keep=10, table='lex')}",
        "filter_frequency": f"{TOKENS}, placed as (select lemma, frequency, row_number() over (order by frequency) r, count(*) over () n from lex), marked as (select lemma, frequency, max(case when r = n * 90 // 100 + 1 then frequency end) over () least_one from placed) select lemma, frequency from marked where frequency >= greatest(1, least_one)",
        "tag_diversity": f"{TOKENS} select lemma, round(case when len(tags) >= 10 then 1.0::double else 0.1::double + 0.9::double * (greatest(len(tags), 1) - 1) / 9 end, 6) factor from lex",
        "priority_scores": priority_scores(f"(select item_id, {picked(J.PRIORITY_MARKS)} pri from benchmark)", "item_id"),
        "nearest_rank": "select source, (list_sort(list(length(text)::double)))[least(count(*) * 9 // 10, count(*) - 1) + 1] p90 from documents group by source",
        "dictionary_scan": f"""with {ITEMS}, ents as (select (row_number() over (order by i) - 1)::bigint entry_ord, i, w, {M1} m1, {M2} m2,
            case when i % 2 = 0 then '{ENTITIES["n"]}|{ENTITIES["v1"]}' else 'a & b <c>' end pos, case when i % 5 = 0 then '{ENTITIES["uk"]}' else '' end misc from items where len(w) >= 4)
            select entry_ord, concat(w[1], ':', m1, '|', m2, '|', w[2], ':') kanji, concat(w[3], ':', m2, '|', w[4], ':') reading,
            array_to_string(list_transform(range(0, i % 3 + 1), lambda k: case when k % 2 = 0 then w[1] || k::varchar || '|' || w[2] else '' end || '/' || pos || '/' || misc), '|') senses, pos from ents""",
        "dictionary_index": f"with {DICTIONARY} select form, count(*) n_entries from prio group by form",
        "dictionary_ties": f"with {ITEMS}, forms as (select i, unnest(list_distinct([w[1], w[2], w[3], w[4]])) form from items where len(w) >= 4) select form, i entry_ord, least(2, i % 3 + 1)::int n_senses from (select form, i, rank() over (partition by form order by least(2, i % 3 + 1) desc) r from forms) where r = 1",
        "dictionary_best_entry": f"with {DICTIONARY} select * from dict",
        "definitions_join": f"{DEFINED} select lemma, definition, invalid, score from defined",
        "invalid_words": f"{DEFINED} select lemma word, lemma reading, array_to_string(tags, ' ') tags from defined where invalid",
        "sentence_stats": f"{STATS} select file_id, sent_ord, lemma, score, n_known, n_total, too_hard::int too_hard, round(mean, 6) mean, round(variance, 6) variance from stats",
        "attach_examples": f"{FIT} select lemma, pos::int pos, x.text as text, x.tag as tag, x.surface surface_form, round(round(x.mean::decimal(18, 6), 2), 1)::double score from ranked where pos <= 3",
        "attach_fallback": f"""{FIT}, prim as (select lemma, x.text as text from ranked where pos <= 1), have as (select lemma, count(*) have from prim group by lemma),
            need as (select w.lemma, w.score, coalesce(h.have, 0) have from words w left join have h using (lemma) where coalesce(h.have, 0) < 3),
            tx as (select s.lemma, s.text, arg_min(s.surface, struct_pack(f := s.file_id, s := s.sent_ord)) surface, min(struct_pack(f := s.file_id, s := s.sent_ord)) seen_at, any_value(n.score) score, any_value(n.have) have from segs s join need n using (lemma) group by s.lemma, s.text),
            fr as (select *, row_number() over (partition by lemma order by seen_at) n from tx where not exists (select 1 from prim p where p.lemma = tx.lemma and p.text = tx.text))
            select lemma, (have + n)::int pos, text, surface surface_form, -score score from fr where n <= 3 - have""",
        "kept_rows": f'{FINISHED} select word, score, reading, "index", frequency, definition, tags, n_sentences, html from rows_ where not invalid',
        "dropped_rows": f'{FINISHED} select word, score, reading, "index", frequency, tags, n_sentences, html from rows_ where invalid',
        "sentence_rows": f"{FINISHED} select case when d.invalid then 'dropped' else 'kept' end status, d.lemma word, d.score, a.text sentence, a.tag, a.surface surface_form, (row_number() over (partition by a.lemma order by a.pos) - 1)::int pos from att a join defined d using (lemma)",
        "mined_words": MINED + mined_rows,
        "mined_words_ja": mined_ja() + mined_rows,
        "mined_sentences": MINED + mined_examples,
        "mined_sentences_ja": mined_ja() + mined_examples,
        "highlight_html": f"select doc_id, case when {HIT} <> '' then substr(text, 1, strpos(text, {HIT}) - 1) || '<span class=''highlight''>' || {HIT} || '</span>' || substr(text, strpos(text, {HIT}) + length({HIT})) else text end || '<br><span class=''tag sentence-tag''>' || coalesce(source, 'None') || ' - 1.5</span>' html from documents",
        "sync_changes": f"{CHANGES} select op, note_id, expression, tags, frequency from changes",
        "note_changes": f"""{FINISHED}, want as materialized (select d.lemma e, d.lemma reading, d.definition meaning, round(d.idx, 4)::varchar idx, d.frequency f, d.frequency::varchar frequency, d.score::varchar score, coalesce(h.html, '') html, d.tags t, ('0x' || md5(d.lemma)[1:8])::bigint number from defined d left join html h using (lemma) where not d.invalid),
            seen_ as (select item_id, unnest(range(0, len(w))) i, unnest(w) w from (select item_id, regexp_extract_all(lower(text), {q(WORD)}) w from benchmark)),
            gone as (select w, max(item_id * 100000 + i) note_id from seen_ where w not in (select e from want) group by w),
            old as (select *, list_concat(['extra'], t[2:]) old_t from want where f % 4 <> 3)
            select 'delete' op, note_id, w expression, '' tags, null::varchar reading, null::varchar meaning, null::varchar "index", null::varchar frequency, null::varchar score, null::varchar sentence_md5 from gone
            union all select 'add', null, e, array_to_string(list_sort(t), ' '), reading, meaning, idx, frequency, score, md5(html) from want where f % 4 = 3
            union all select 'updateFields', number, e, '', reading, meaning, idx, frequency, score, md5(html) from old where f % 4 in (1, 2)
            union all select 'addTags', number, e, array_to_string(list_sort(list_filter(t, lambda x: not list_contains(old_t, x))), ' '), null, null, null, null, null, null from old where f % 4 = 2 and len(list_filter(t, lambda x: not list_contains(old_t, x))) > 0
            union all select 'removeTags', number, e, 'extra', null, null, null, null, null, null from old where f % 4 = 2""",
        "sync_summary": f"{CHANGES} select count(*) filter (where op = 'add') added, count(distinct note_id) filter (where op in ('updateFields', 'addTags', 'removeTags')) updated, count(*) filter (where op = 'delete') deleted from changes",
        "sync_batches": f"{CHANGES} select op, batch, count(*) n, min(expression) first_expression from (select op, expression, ((row_number() over (partition by op order by expression, note_id) - 1) // 50)::int batch from changes) group by op, batch",
        "ngram_candidates": f"with {DOCS} {GRAMS.format(low=2, high=20, members=ACCENTED, source='docs')}",
        "ngram_candidates_latin": f"with {DOCS} {GRAMS.format(low=2, high=20, members=LATIN_LETTERS, source='docs')}",
        "ngram_candidates_ja": GRAMS.format(low=2, high=20, members=ngram_chars(), source=JA_DOCS),
        "user_dictionary": f"""with {DICTIONARY}, seen as materialized (select distinct unnest(regexp_extract_all(text, '[{LATIN_LETTERS}]+')) r from documents),
            cands as (select form, entry_ord, first_reading, length(form)::int n from dict d where length(form) between 7 and 20 and exists (select 1 from seen where contains(r, d.form)))
            select form word, case when entry_ord % 3 = 2 then 500 * n - 1000 else 1750 * n end cost, case when entry_ord % 3 = 1 then '動詞' else '名詞' end p0, case when entry_ord % 3 = 1 then '一般' else '普通名詞' end p1, first_reading reading from cands where entry_ord % 4 <> 3""",
        "pos_resolution": resolved_pos(f"(select item_id id, {picked(J.POS_NAMES)} pos from benchmark)"),
        "userdict_cost": costs(f"(select latin id, word text from {JA_WORDS})"),
        "content_keys": f"with {DOCS} select file_id, sha256(array_to_string(x, chr(10)) || chr(0) || '{FINGERPRINT}') content_key from (select file_id, {full_lines('text')} x from docs) where len(x) > 0",
        "cache_misses": f"with {DOCS}, k as (select file_id, sha256(array_to_string(x, chr(10)) || chr(0) || '{FINGERPRINT}') content_key from (select file_id, {full_lines('text')} x from docs) where len(x) > 0) select file_id, content_key from k where content_key not in (select content_key from k where file_id in (select doc_id from labels))",
        "token_cache_runs": f"""{BASE}, ks as (select file_id, sha256(array_to_string(list(text order by sent_ord), chr(10)) || chr(0) || 'regex:[A-Za-zÀ-ÖØ-öø-ÿ]+') k, count(*) n, sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+'))) t from sents group by file_id),
            ke as (select file_id, coalesce(k, sha256(chr(0) || 'regex:[A-Za-zÀ-ÖØ-öø-ÿ]+')) k, coalesce(n, 0) n, coalesce(t, 0)::bigint t from docs left join ks using (file_id))
            select file_id, n n_sentences, t n_tokens, k not in (select k from ke where file_id in (select doc_id from labels)) fresh from ke""",
        "lexicon_update": f"{TOKENS} select lemma, frequency, index_count, round(idx, 6) mean_index, array_to_string(tags, ' ') tags, seen_at.f first_file, seen_at.s::int first_sent from lex",
        "useless_lemmas": useless(f"(select latin id, word lemma, p[1] p1, p[2] p2 from (select latin, word, {POS_PAIRS} p from {JA_WORDS}))"),
    }
