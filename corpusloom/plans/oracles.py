"""The registered queries as SQL, stated independently of the Spark code."""

from __future__ import annotations

from corpusloom.operators.batching import ROUNDS
from corpusloom.plans import fixtures as fx

S = fx.SEQ_LEN
W = S + 1

# The piece pattern without look-ahead: a mark before the last white space of a run that
# ends at text lets the run stop there.
PIECES = (
    r"regexp_extract_all(regexp_replace({t}, '(\s)(\S)', chr(1)||'\1\2', 'g'), "
    r"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+')"
)

DIRTY = """dirty as (select doc_id, case when doc_id % 17 = 0 then null when doc_id % 13 = 0 then ' ' || chr(10) || '  ' || chr(10)
  when doc_id % 11 = 0 then regexp_replace(text, '^([^ ]* )', '\\1<|EOT|>') else text end as text from documents)"""

# Not blank: some character besides white space.
KEPT = "regexp_matches(coalesce(text, ''), '[^ \\n\\t\\r]')"


def bytes_of(source: str, columns: str = "doc_id") -> str:
    """One row per UTF-8 byte plus 3, and the closing 0, of every document."""
    return f"""doc_ids as (select {columns}, list_append([('0x' || h)::int + 3 for h in
  regexp_extract_all(hex(encode(coalesce(text, ''))), '..')], 0) ids from {source})"""


def tokens_of(by: str = "", order: str = "doc_id") -> str:
    """Positions along ``order``, counted anew in each ``by`` group."""
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""starts as (select *, len(ids) n, (sum(len(ids)) over ({part} order by {order} rows unbounded preceding) - len(ids))::bigint as start from doc_ids),
toks as (select {lead}start + unnest(range(len(ids))) as pos, unnest(ids) as id from starts)"""


def windows_of(by: str, stride: int) -> str:
    lead = f"{by}, " if by else ""
    shared = f"union all select {lead}pos // {stride} - 1, pos, id from toks where pos % {stride} = 0 and pos > 0" if stride < W else ""
    return f"""wins as (select {lead}w as "window", string_agg(id::varchar, ' ' order by pos) tokens,
  string_agg(case when pos < w * {stride} + {S} then id::varchar end, ' ' order by pos) x,
  string_agg(case when pos > w * {stride} then id::varchar end, ' ' order by pos) y
  from (select {lead}pos // {stride} as w, pos, id from toks {shared}) group by all having count(*) = {W})"""


BYTE_TOKENS = f"{bytes_of('documents')}, {tokens_of()}"

REGION = f"""region as (select count(*)::bigint total, (count(*) - {fx.EVAL_STEPS * fx.BATCH * W})::bigint train_end from toks)"""

TRAIN_WINDOWS = f"""shard_size as (select train_end // {fx.SHARDS} t, total, train_end from region),
places as (select pos // t as shard, (pos % t) // {W} as w, pos % t as spot, id from toks, shard_size
  where pos < t * {fx.SHARDS} and (pos % t) // {W} < t // {W}),
wins as (select shard, w as "window", string_agg(id::varchar, ' ' order by spot) tokens from places group by all)"""



def _permutation_step(x: str, source: str) -> str:
    """One application of the seeded permutation to column ``x`` of rows with ``shard, window, n, a, b``."""
    sql = f"select *, {x} // b as l, {x} % b as r from {source}"
    for k in range(ROUNDS):
        moved, fixed, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        shift = f"('0x' || md5(({fx.SEED} + shard)::varchar || ':{k}:' || {fixed}::varchar)[1:13])::bigint"
        sql = f"select * replace (({moved} + {shift}) % {side} as {moved}) from ({sql})"
    return f'select shard, "window", n, a, b, l * b + r as x from ({sql})'


BATCHES = f"""counted as (select shard, "window", count(*) over (partition by shard) as n from wins),
sides as (select shard, "window"::bigint as "window", n, ceil(sqrt(n))::bigint as a from counted),
grid as materialized (select *, (n + a - 1) // a as b from sides),
walk as (with recursive walked as (
  {_permutation_step('"window"', 'grid')}
  union all
  {_permutation_step('x', '(select * from walked where x >= n)')}
) select * from walked),
order_keys as (select shard, "window", x as place from walk where x < n),
fed as (select (shard // {fx.WORKERS})::int as rank, (shard % {fx.WORKERS})::int as worker, "window",
  place // {fx.BATCH} as batch, (place % {fx.BATCH})::int as slot from order_keys),
turns as (select rank, worker, batch, row_number() over (partition by rank order by batch, worker) - 1 as feed,
  count(*) over (partition by rank) as rank_batches from (select distinct rank, worker, batch from fed))"""

STORE_PARTS = f"""parts as (select min(start)::bigint as start, sum(n)::bigint n_tokens from starts group by start // {fx.PART_TOKENS})"""

SIZE_LABEL = """case when {b} > 1024.0*1024*1024 then printf('%.1f GB', {b} / (1024.0*1024*1024))
  when {b} > 1024.0*1024 then printf('%.1f MB', {b} / (1024.0*1024)) else printf('%.1f KB', {b} / 1024.0) end"""

# Words, alphabet and symbol strings; a symbol is chr(256 + id).
WORDS = f"""words as (select w, count(*)::bigint n from (select unnest({PIECES.format(t='text')}) w from documents) group by w)"""
ALPHABET = """seen as (select distinct ('0x' || unnest(regexp_extract_all(hex(encode(w)), '..')))::int as byte from words),
alpha as (select byte, case when byte between 33 and 126 or byte between 161 and 172 or byte >= 174 then byte
  when byte <= 32 then 256 + byte when byte <= 160 then 256 + byte - 94 else 323 end as code from seen),
letters as (select byte, code, 2 + row_number() over (order by code) as id from alpha),
lettermap as (select map(list(printf('%02X', byte)), list(chr((256 + id)::int))) m, count(*) k from letters)"""


def symbols(source: str) -> str:
    return f"""symbols as (select w, n, coalesce(list_aggregate([m[h] for h in regexp_extract_all(hex(encode(w)), '..')], 'string_agg', ''), '') s
  from {source}, lettermap)"""


# Pieces next to a special token may not occur in training; they are merged along.
ALL_WORDS = "all_words as (select w, n from words union all select distinct piece, 0 from placed where piece not in (select w from words) and not special)"


def training(source: str = "words") -> str:
    """One merge per recursion step, replayed on every word."""
    extra = f", {ALL_WORDS}" if source == "all_words" else ""
    return f"""{WORDS}{extra}, {ALPHABET}, {symbols(source)},
state as (
  select 0 as step, w, n, s, ''::varchar as pair from symbols
  union all
  (with pairs as (select substr(s, i, 2) pr, sum(n) cnt from (select s, n, unnest(range(1, length(s))) i from state) group by 1),
   best as (select pr from pairs where cnt >= 2 order by cnt desc, pr limit 1)
   select step + 1, w, n, replace(s, best.pr, chr((256 + 3 + k + step)::int)), best.pr
   from state, best, lettermap where 3 + k + step < {fx.VOCAB_SIZE})
),
merges as materialized (select step, (ascii(substr(pair, 1, 1)) - 256)::int l, (ascii(substr(pair, 2, 1)) - 256)::int r
  from (select distinct step, pair from state where step > 0)),
final as materialized (select w, [(ascii(c) - 256)::int for c in string_split(s, '') if c <> ''] ids
  from state where step = (select max(step) from state))"""


def encoded(source: str, eot: bool) -> str:
    """Ids of the texts of ``source``, special tokens split off first."""
    tail = "list_append(flatten(list(coalesce(f.ids, case when p.special then [0] else [] end) order by p.seg, p.pos)), 0)" if eot else \
        "flatten(list(coalesce(f.ids, case when p.special then [0] else [] end) order by p.seg, p.pos))"
    return f"""coded as (select p.doc_id, {tail} ids from placed p left join final f on f.w = p.piece group by p.doc_id),
out as (select d.doc_id, coalesce(array_to_string(ids, ' '), '{0 if eot else ''}') ids from {source} d left join coded using (doc_id))"""


PLACED = f"""segs as (select doc_id, unnest(parts) seg_text, unnest(range(len(parts))) seg from
  (select doc_id, string_split(regexp_replace(coalesce(text, ''), '<\\|EOT\\|>', chr(2) || chr(3) || chr(2), 'g'), chr(2)) parts from src)),
placed0 as (select doc_id, seg, seg_text, case when seg_text = chr(3) then [seg_text] else {PIECES.format(t='seg_text')} end pieces from segs),
placed as (select doc_id, seg, unnest(pieces) piece, unnest(range(len(pieces))) pos, seg_text = chr(3) special from placed0)"""

EVENTS_LOG = 'log as (select event_id as step, value as loss, ts from events)'
ROUTING = "routes as (select event_id // 100 as step, (user_id % 4)::int as layer, event_type as expert from events)"
EXPERT_ROWS = "(select unnest([" + ", ".join(f"'{e}'" for e in fx.EXPERTS) + "]) as expert)"

ROUTED = """vec as (select vec_id, label, embedding::double[] e from embeddings),
cells as (select label, unnest(e) v, unnest(range(len(e))) dim from vec),
gate as (select label as grp, list(m order by dim) g from (select label, dim, avg(v) m from cells group by all) group by label),
normed as (select vec_id, [x / sqrt(ms + 1e-6) for x in e] e from (select vec_id, e, list_sum([x * x for x in e]) / len(e) ms from vec)),
scored as (select vec_id, grp, list_dot_product(e, g) s, list_dot_product(e, g) + 0.1 * (grp % 3) b from normed, gate),
top2 as (select *, row_number() over (partition by vec_id order by b desc, grp) - 1 as place from scored qualify place < 2),
routed as (select vec_id, place::int as place, grp::int as grp, exp(s - max(s) over v) / sum(exp(s)) over v * exp(max(s) over v) as weight from top2 window v as (partition by vec_id))"""

DISTRIBUTION = """scores as (select user_id, event_type, count(*) - 12 as score from events group by all),
seen as (select distinct user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 3),
logits as (select s.user_id, s.event_type, (case when k.user_id is null then s.score::double when s.score < 0 then s.score * 1.2::double else s.score / 1.2::double end) / 0.8::double as logit
  from scores s left join seen k on k.user_id = s.user_id and k.event_type = s.event_type),
kept as (select * from logits qualify rank() over (partition by user_id order by logit desc) <= 3)"""

# Linear in the rows: one fold per user over the ordered steps.
DECAY = """steps as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) rn,
  -(greatest(value / 100, 0) + ln(1 + exp(-abs(value / 100)))) as la from events),
pairs as (select t.user_id, t.event_id, sum(exp(t.cl - s.cl) * s.value) h from
  (select *, sum(la) over (partition by user_id order by rn) cl from steps) t join
  (select *, sum(la) over (partition by user_id order by rn) cl from steps) s
  on s.user_id = t.user_id and s.rn <= t.rn group by all)"""

DECAY_OUT = f"with {DECAY} select user_id, event_id, round(h, 6) as h, round(h, 6) as readout from pairs"
INTERVAL = f"""with {EVENTS_LOG} select (step // {fx.LOG_EVERY} + 1) * {fx.LOG_EVERY} as step, round(sum(loss) / {fx.LOG_EVERY}, 6) as loss
  from log group by step // {fx.LOG_EVERY} having max((step + 1) % {fx.LOG_EVERY} = 0)"""
PACK = f"""with {DIRTY}, ranked as (select *, ((row_number() over (order by doc_id) - 1) % {fx.SHARDS})::int as shard from dirty),
  held as (select * from ranked where {KEPT}), {bytes_of('held', 'shard, doc_id')}, {tokens_of('shard')}, {windows_of('shard', S)}
  select shard, "window", tokens from wins"""
CHUNKS = f"with {BYTE_TOKENS}, {windows_of('', W)}"
FILES = f"(select doc_id, text, (doc_id % {fx.FILES})::int as file_rank, doc_id // {fx.FILES} as row, (doc_id % {fx.FILES} % {fx.FILE_WORKERS})::int as worker from documents)"
APPEND_EOT = f"""with recursive src as (select doc_id, text from documents), {PLACED}, {training()}, {encoded('src', True)} select doc_id, ids from out"""

ORACLES: dict[str, str] = {
    "corpus_scan": "select doc_id, text from documents",
    "file_select": f"select file_rank, row, doc_id from {FILES}",
    "corpus_stream": "select doc_id, text from documents",
    "stream_backpressure": f"select count(*) as docs, {-(-fx.FILES // 3)} as micro_batches from documents",
    "token_sink": f"with {BYTE_TOKENS}, {STORE_PARTS} select start, n_tokens, 2 * n_tokens as bytes from parts",
    "token_merge": f"""with files as {FILES}, {bytes_of('files', 'worker, file_rank, row')}, {tokens_of('worker', 'file_rank, row')},
      parts as (select worker, min(start)::bigint lo, sum(n)::bigint n_tokens from starts group by worker, start // {fx.PART_TOKENS}),
      bases as (select worker, sum(t) over (order by worker) - t as base from (select worker, sum(n_tokens) t from parts group by worker))
      select worker, (lo + base)::bigint as start, n_tokens, 2 * n_tokens as bytes from parts join bases using (worker)""",
    "token_source": f'{CHUNKS} select "window", tokens from wins',
    "stream_sink": f'{CHUNKS} select "window", tokens from wins',
    "stream_source": f'{CHUNKS} select "window", tokens from wins',
    "file_inventory": f"with {BYTE_TOKENS}, {STORE_PARTS} select start, 2 * n_tokens as length, {SIZE_LABEL.format(b='(2 * n_tokens)')} as size from parts",
    "write_mode": f"""with {BYTE_TOKENS}, sums as (select sum(n)::bigint tokens, (2 * sum(n))::bigint bytes from starts)
      select tokens, bytes, {SIZE_LABEL.format(b='bytes')} as size, 2 as bytes_per_token, action, attempt
      from sums, (values ('written', 0), ('kept', 1), ('written', 2)) v(action, attempt)""",
    "vocab_store_roundtrip": f"""with recursive {training()} select token, id, (select 3 + max(k) + count(*) from merges, lettermap)::bigint as vocab_size
      from (values ('<|EOT|>', 0), ('<|PAD|>', 1), ('<|BOT|>', 2)) v(token, id)""",
    "text_default": f"with {DIRTY} select doc_id, coalesce(text, '') as text from dirty",
    "blank_filter": f"with {DIRTY} select doc_id, text from dirty where {KEPT}",
    "first_n_sample": "select doc_id, text from documents order by doc_id limit 500",
    "row_round_robin": f"with {DIRTY}, r as (select *, row_number() over (order by doc_id) - 1 as row from dirty) select doc_id, row, (row % {fx.SHARDS})::int as shard from r where {KEPT}",
    "file_round_robin": f"select doc_id, worker, file_rank, row from {FILES}",
    "pretokenize": f"select doc_id, unnest(range(len(p)))::int as pos, unnest(p) as piece from (select doc_id, {PIECES.format(t='text')} p from documents)",
    "word_count": f"with {WORDS} select w, n from words",
    "alphabet": f"with {WORDS}, {ALPHABET} select byte, code from alpha",
    "pair_count": f"""with {WORDS}, {ALPHABET}, {symbols('words')}, pairs as (select substr(s, i, 2) pr, sum(n)::bigint cnt
      from (select s, n, unnest(range(1, length(s))) i from symbols) group by 1)
      select ascii(substr(pr, 1, 1)) - 256 as left_id, ascii(substr(pr, 2, 1)) - 256 as right_id, cnt from pairs order by cnt desc, pr limit 64""",
    "bpe_train": f"with recursive {training()} select (step - 1)::int as rank, l as left_id, r as right_id, (2 + k + step)::int as new_id from merges, lettermap",
    "vocab_assemble": f"""with recursive {training()},
      base as (select ['<|EOT|>', '<|PAD|>', '<|BOT|>'] || list(chr(code::int) order by id) t from letters),
      spell as (select 0 as done, t from base union all select done + 1, list_append(t, t[l + 1] || t[r + 1]) from spell join merges on step = done + 1),
      whole as (select t from spell order by done desc limit 1)
      select unnest(range(len(t)))::int as id, unnest(t) as token, unnest([i < 3 for i in range(len(t))]) as is_special from whole""",
    "encode_docs": f"with recursive {DIRTY}, src as (select * from dirty), {PLACED}, {training('all_words')}, {encoded('src', False)} select doc_id, ids from out",
    "append_eot": APPEND_EOT,
    "decode_ids": f"with {DIRTY} select doc_id, replace(coalesce(text, ''), '<|EOT|>', '') as text from dirty",
    "encode_stats": f"""with files as {FILES}, sized as (select worker, octet_length(encode(text)) + 1 as n from files)
      select worker, sum(n)::bigint as tokens, count(*) as docs, round(sum(n) * 2 / (1024.0 * 1024 * 1024), 6) as gib, 2 as bytes_per_token
      from sized group by rollup (worker)""",
    "encode_progress": f"""with b as (select event_id as batch, ts, 2000 as docs, floor(value * 100)::bigint as tokens from events),
      c as (select batch, (sum(docs) over w)::bigint total_docs, (sum(tokens) over w)::bigint total_tokens,
        epoch_us(ts) / 1e6 - epoch_us(first(ts) over w) / 1e6 as e from b window w as (order by batch rows unbounded preceding)),
      d as (select *, case when e > 0 then total_tokens / e end as rate from c)
      select batch, total_docs, total_tokens, round(e, 6) as elapsed, round(rate, 6) as tok_per_sec, round(total_tokens / {fx.MAX_TOKENS} * 100, 6) as pct,
        round(case when rate > 0 then ({fx.MAX_TOKENS} - total_tokens) / rate else 0.0 end, 6) as eta_seconds from d""",
    "dtype_choice": f"with {WORDS} select count(*) + 3 as vocab_size, case when count(*) + 3 > 65536 then 4 else 2 end as bytes_per_token from words",
    "global_offsets": f"with {BYTE_TOKENS} select doc_id, start, n::bigint as n from starts",
    "pack_overlap": PACK,
    "chunk_fixed": f'{CHUNKS} select "window", tokens from wins',
    "shift_targets": f'{CHUNKS} select "window", x, y from wins',
    "budget_cap": f"""with files as {FILES}, sized as (select *, octet_length(encode(text)) + 1 as n, row // 20 as b from files),
      per_batch as (select worker, file_rank, b, sum(n) t from sized group by all),
      prior as (select *, sum(t) over (partition by worker order by file_rank, b) - t as before from per_batch),
      kept as (select s.* from sized s join prior p on p.worker = s.worker and p.file_rank = s.file_rank and p.b = s.b
        where p.before < {int(fx.MAX_TOKENS * 1.2 / fx.FILE_WORKERS)}),
      placed as (select *, (sum(n) over (order by worker, file_rank, row rows unbounded preceding) - n)::bigint as start from kept)
      select doc_id, worker, start, least(n, {fx.MAX_TOKENS} - start)::bigint as n from placed where start < {fx.MAX_TOKENS}""",
    "hashed_offsets": """with k as (select doc_id, ('0x' || md5(doc_id::varchar)[1:15])::bigint as k, octet_length(encode(text)) + 1 as n from documents)
      select doc_id, (sum(n) over (order by k rows unbounded preceding) - n)::bigint as start, n::bigint as n from k""",
    "budget_cap_stream": f"""with sized as (select doc_id, octet_length(encode(text)) + 1 as n, doc_id // 50 as b from documents),
      prior as (select b, sum(t) over (order by b) - t as before from (select b, sum(n) t from sized group by b))
      select doc_id, n::bigint as n from sized join prior using (b) where before < {fx.MAX_TOKENS}""",
    "contiguous_shards": f'with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS} select shard, "window", tokens from wins',
    "tail_split": f"""with {BYTE_TOKENS}, {REGION},
      marked as (select doc_id, case when start + i < train_end then 'train' else 'eval' end as split, start + i as pos
        from (select doc_id, start, unnest(range(n)) i from starts), region)
      select doc_id, split, min(pos)::bigint as start, count(*) as n from marked group by all""",
    "seeded_shuffle": f'with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS}, {BATCHES} select shard, "window", place from order_keys',
    "batches": f"""with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS}, {BATCHES}
      select rank, worker, "window", batch, slot, feed from fed join turns using (rank, worker, batch)""",
    "training_feed": f"""with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS}, {BATCHES}
      select rank, feed, slot, array_to_string(string_split(tokens, ' ')[:{S}], ' ') as x, array_to_string(string_split(tokens, ' ')[2:], ' ') as y
      from fed join turns using (rank, worker, batch) join wins on wins.shard = fed.rank * {fx.WORKERS} + fed.worker and wins."window" = fed."window"
      """,
    "eval_take_n": f"""with {BYTE_TOKENS}, {REGION}, tail as (select (pos - train_end) // {W} as w, pos, id from toks, region where pos >= train_end),
      evals as (select w, string_agg(id::varchar, ' ' order by pos) tokens from tail group by w having count(*) = {W})
      select w // {fx.BATCH} as batch, (w % {fx.BATCH})::int as slot, tokens from evals where w // {fx.BATCH} < 1""",
    "epoch_schedule": f"""with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS}, {BATCHES},
      n as (select unnest(range({3_000 * fx.GRAD_ACCUM})) as i)
      select i // {fx.GRAD_ACCUM} as step, rank, (i % {fx.GRAD_ACCUM})::int as micro, i // rank_batches as epoch, feed, worker, batch
      from n join turns on turns.feed = i % turns.rank_batches""",
    "feed_resume": f"""with {BYTE_TOKENS}, {REGION}, {TRAIN_WINDOWS}, {BATCHES},
      begin as (select greatest(0, max(rank_batches) // {fx.GRAD_ACCUM} - {fx.RESUME_STEPS // 2}) as s from turns where rank = 0),
      n as (select unnest(range(s * {fx.GRAD_ACCUM}, (s + {fx.RESUME_STEPS}) * {fx.GRAD_ACCUM})) as i from begin),
      due as (select i // {fx.GRAD_ACCUM} as step, rank, (i % {fx.GRAD_ACCUM})::int as micro, i // rank_batches as epoch, feed, worker, batch
        from n join turns on turns.feed = i % turns.rank_batches)
      select step, rank, micro, epoch, feed, slot, tokens from due join fed using (rank, worker, batch)
      join wins on wins.shard = due.rank * {fx.WORKERS} + due.worker and wins."window" = fed."window"
      """,
    "budget_report": f"""with t as (select sum(octet_length(encode(text)) + 1)::bigint n from documents), c as (select {fx.BATCH * fx.GRAD_ACCUM * fx.RANKS * S}::bigint st)
      select st as step_tokens, (20000 // {fx.RANKS})::bigint as steps, (20000 // {fx.RANKS}) * st as training_tokens, n as corpus_tokens,
        round((20000 // {fx.RANKS}) * st / n, 6) as epochs from t, c""",
    "interval_loss": INTERVAL,
    "throughput": f"""with {EVENTS_LOG}, c as (select step, count(*) over (order by step rows unbounded preceding) * {fx.BATCH * fx.GRAD_ACCUM * S} as seen,
        epoch_us(ts) / 1e6 - epoch_us(timestamp '{fx.RUN_STARTED}') / 1e6 as e from log)
      select step + 1 as step, seen as tokens_seen, round(case when e > 0 then seen / e else 0.0 end, 6) as tok_per_sec from c where (step + 1) % {fx.LOG_EVERY} = 0""",
    "step_latency": f"with {EVENTS_LOG} select step, round((epoch_us(ts) - epoch_us(lag(ts) over (order by step))) / 1000.0::double, 6) as step_ms from log",
    "eval_mean": """with l as (select event_id // 4 as step, avg(value) as m from events group by 1)
      select s.step, round(coalesce(m, 0), 6) as eval_loss from range((select max(event_id) // 4 + 6 from events)) s(step) left join l on l.step = s.step""",
    "lr_schedule": f"""with {EVENTS_LOG}, e as (select step, case when step < 500 then 6e-4 * (step + 1) / 500 when step >= 8000 then 6e-5
        else 6e-5 + 0.5 * (6e-4 - 6e-5) * (1 + cos(pi() * (step - 500) / 7500)) end as lr from log)
      select step, round(lr, 12) as expected_lr, abs(6e-4 - lr) > 1e-9 as deviates from e""",
    "cadence_filter": f"with {EVENTS_LOG} select step, round(loss, 6) as loss from log where (step + 1) % {fx.LOG_EVERY} = 0 and (step + 1) % 250 = 0",
    "expert_load": f"""with {ROUTING}, counts as (select layer, expert, count(*) c from routes group by all),
      grid as (select layer, x.expert, coalesce(c, 0)::bigint n from (select unnest(range({fx.LAYERS}))::int layer) l cross join {EXPERT_ROWS} x left join counts using (layer, expert)),
      t as (select *, sum(n) over l as total, stddev_samp(n) over l as sd, max(n) over l as top, avg(n) over l as m from grid window l as (partition by layer))
      select layer, expert, n, round(n / total, 6) as share, round(sd / total, 6) as utilization_std, round(top / m, 6) as max_load_ratio from t where total > 0""",
    "load_bias": f"""with {ROUTING}, counts as (select step, layer, expert, count(*) c from routes group by all),
      grid as (select step, layer, x.expert, coalesce(c, 0)::bigint n, total from (select step, layer, sum(c) total from counts group by all) t
        cross join {EXPERT_ROWS} x left join counts using (step, layer, expert))
      select step, layer, expert, n, round(-0.001::double * sum(sign(n - total / {len(fx.EXPERTS)})) over (partition by layer, expert order by step), 6) as bias from grid""",
    "topk_routing": f"with {ROUTED} select vec_id, place, grp, round(weight, 6) as weight from routed",
    "topk_routing_blocks": f"with {ROUTED} select vec_id, place, grp, round(weight, 6) as weight from routed",
    "weighted_combine": f"""with {ROUTED}, vals as (select label::int as grp, avg(vec_id) as value from embeddings group by label)
      select vec_id, round(sum(weight * value) + first(vec_id) * 0.5::double, 6) as combined from routed join vals using (grp) group by vec_id""",
    "heldout_ce": f"""with {BYTE_TOKENS}, {REGION},
      train as (select pos, id from toks, region where pos < train_end // {W} * {W}),
      held as (select pos - train_end as pos, id from toks, region where pos >= train_end),
      big as (select a.id p, b.id q, count(*) n from train a join train b on b.pos = a.pos + 1 where a.pos % {W} < {S} group by all),
      ctx as (select p, sum(n) c from big group by p),
      want as (select a.id p, b.id q from held a join held b on b.pos = a.pos + 1 where a.pos % {W} < {S})
      select count(*) as targets, round(avg(-ln((coalesce(n, 0) + 1) / (coalesce(c, 0) + {fx.BYTE_VOCAB})::double)), 6) as loss
      from want left join big using (p, q) left join ctx using (p)""",
    "candidate_sampling": f"""with {DISTRIBUTION}, e as (select *, exp(logit - max(logit) over (partition by user_id)) x from kept)
      select user_id, event_type, round(logit, 6) as logit, round(x / sum(x) over (partition by user_id), 6) as p from e""",
    "candidate_draw": f"""with {DISTRIBUTION}, e as (select *, exp(logit - max(logit) over (partition by user_id)) x from kept),
      d as (select user_id, event_type, x / sum(x) over (partition by user_id) p,
        (('0x' || substr(md5('{fx.SEED}:' || user_id || ':' || event_type), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double u from e)
      select user_id, arg_max(event_type, ln(p) - ln(-ln(u))) as event_type from d group by user_id""",
    "decayed_state": DECAY_OUT,
    "stream_encode": APPEND_EOT,
    "stream_encode_capped": f"""with coded as ({APPEND_EOT}), sized as (select doc_id, len(string_split(ids, ' ')) as n, doc_id // {fx.STREAM_ROWS} as b from coded),
      prior as (select b, sum(t) over (order by b) - t as before from (select b, sum(n) t from sized group by b))
      select doc_id, n::bigint as n from sized join prior using (b) where before < {fx.STREAM_TOKENS}""",
    "stream_pack": PACK,
    "stream_interval": INTERVAL,
    "stream_decayed_state": DECAY_OUT,
    "training_windows": f"""with recursive src as (select doc_id, text from documents), {PLACED}, {training()},
      coded as (select p.doc_id, list_append(flatten(list(f.ids order by p.seg, p.pos)), 0) ids from placed p join final f on f.w = p.piece group by p.doc_id),
      doc_ids as (select d.doc_id, coalesce(c.ids, [0]) ids from src d left join coded c using (doc_id)), {tokens_of()}, {windows_of('', W)}
      select "window", x, y from wins""",
}
