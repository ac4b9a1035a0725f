"""DuckDB SQL oracles, one per registered query.

Each string restates the query from the base tables with plain SQL so that
it is an independent check of the Spark plan.  Shared CTEs restate the
role bindings of ``plans/bindings.py``.
"""

from __future__ import annotations

LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id,
         CASE WHEN event_type IN ('error', 'signup') THEN 'val' ELSE 'train' END AS split,
         CAST(floor((day(ts) - 1) / 7) + 1 AS INTEGER) AS epoch,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
         ts AS time, ln(1 + value) AS loss
  FROM events)"""

CFG = """cfg AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) END AS optimizer,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 10000 END AS learning_rate,
         CAST(c_nationkey % 5 + 1 AS INTEGER) AS depth,
         CAST(16 * (c_custkey % 4 + 1) AS INTEGER) AS width,
         CAST(c_nationkey % 3 + 1 AS DOUBLE) / 10 AS train_frac,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'sweep_b' ELSE 'sweep_a' END AS exp_name
  FROM customer)"""

# Savitzky-Golay hat matrix (window 51, degree 3) from discrete orthogonal
# polynomials on -25..25: H[p][k] = sum_j q_j(x_p) q_j(x_k) / |q_j|^2.
HAT = """pts AS (SELECT i AS idx, CAST(i - 25 AS DOUBLE) AS x FROM range(0, 51) t(i)),
poly AS (SELECT idx, 1.0 AS q0, x AS q1, x * x - 650.0 / 3 AS q2, x * x * x - 1949.0 / 5 * x AS q3 FROM pts),
nrm AS (SELECT sum(q0 * q0) AS n0, sum(q1 * q1) AS n1, sum(q2 * q2) AS n2, sum(q3 * q3) AS n3 FROM poly),
hat AS (SELECT a.idx AS p, b.idx AS k,
               a.q0 * b.q0 / n0 + a.q1 * b.q1 / n1 + a.q2 * b.q2 / n2 + a.q3 * b.q3 / n3 AS h
        FROM poly a, poly b, nrm)"""


def smoothed(src: str, keys: str, value: str, out: str) -> str:
    """CTE body fragment: W2 + P7 of ``value`` over ``src`` per ``keys`` (comma list)."""
    jk = " AND ".join(f"y.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    bk = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    sk = " AND ".join(f"sm.{k.strip()} IS NOT DISTINCT FROM n.{k.strip()}" for k in keys.split(","))
    return f"""{out}_num AS (SELECT *, step - 1 AS rn, count(*) OVER (PARTITION BY {keys}) AS n,
                      max(step) OVER (PARTITION BY {keys}) AS max_step FROM {src}),
{out}_blk AS (SELECT *, least(greatest(rn - 25, 0), n - 51) AS s FROM {out}_num WHERE n >= 51),
{out}_sm AS (SELECT {bk}, b.step,
              CASE WHEN count(y.{value}) = 51 THEN sum(hat.h * y.{value}) END AS raw_sm,
              any_value(b.max_step) AS max_step
       FROM {out}_blk b JOIN hat ON hat.p = b.rn - b.s
       JOIN {out}_num y ON {jk} AND y.rn = b.s + hat.k
       GROUP BY {bk}, b.step),
{out} AS (SELECT n.* EXCLUDE (rn, n, max_step),
                 CASE WHEN n.step BETWEEN 30 AND sm.max_step - 30 THEN sm.raw_sm END AS smoothed_{value}
        FROM {out}_num n LEFT JOIN {out}_sm sm ON {sk} AND sm.step = n.step)"""


def _best(src: str, key: str, metric: str, better: str) -> str:
    order = "ASC" if better == "lower" else "DESC"
    return f"""(SELECT {key}, step AS best_{metric}_step, {metric} AS best_{metric} FROM (
    SELECT {key}, step, {metric}, row_number() OVER (PARTITION BY {key} ORDER BY {metric} {order}, step ASC) AS r
    FROM {src} WHERE {metric} IS NOT NULL AND NOT isnan({metric})) WHERE r = 1)"""


ORACLE: dict[str, str] = {}

ORACLE["best_steps"] = f"""
WITH {LOG}, {CFG}, {HAT}, {smoothed('log', 'run_id', 'loss', 'smo')},
runs AS (SELECT DISTINCT run_id FROM log),
b1 AS {_best('smo', 'run_id', 'loss', 'lower')},
b2 AS {_best('smo', 'run_id', 'smoothed_loss', 'lower')}
SELECT runs.run_id, cfg.optimizer, round(cfg.learning_rate, 6) AS learning_rate, cfg.depth, cfg.width,
       b1.best_loss_step, round(b1.best_loss, 6) AS best_loss,
       b2.best_smoothed_loss_step, round(b2.best_smoothed_loss, 6) AS best_smoothed_loss
FROM runs JOIN cfg ON cfg.id IS NOT DISTINCT FROM runs.run_id
LEFT JOIN b1 ON b1.run_id = runs.run_id
LEFT JOIN b2 ON b2.run_id = runs.run_id
"""

J = """j AS (SELECT * FROM log JOIN cfg ON log.run_id IS NOT DISTINCT FROM cfg.id)"""


def _flat(sep: str) -> str:
    s = sep
    return f"""WITH {CFG}
SELECT id, depth AS "trainer{s}epochs", 'mlp' AS "model{s}architecture", 64 AS "model{s}input_dim",
       10 AS "model{s}output_dim", depth AS "model{s}depth", width AS "model{s}width",
       optimizer AS "optimizer{s}name", round(learning_rate, 6) AS "optimizer{s}learning_rate",
       'embeddings' AS "loader{s}dataset", round(train_frac, 6) AS "loader{s}train_frac",
       exp_name AS "loader{s}sweep{s}name"
FROM cfg"""


ORACLE["flatten_configs"] = _flat(".")
ORACLE["unflatten_configs"] = _flat("/")

ORACLE["name_suffix"] = "SELECT c_custkey, right(c_name, 4) AS name_suffix FROM customer"

ORACLE["lr_filter"] = f"""WITH {LOG}, {CFG}, {J}
SELECT run_id, step, round(learning_rate, 6) AS learning_rate, exp_name, round(loss, 6) AS loss
FROM j WHERE NOT (coalesce(learning_rate >= 0.5, false) AND coalesce(exp_name <> 'sweep_b', true))"""

ORACLE["fill_optimizer"] = f"WITH {CFG} SELECT id, coalesce(optimizer, 'sgd') AS optimizer FROM cfg"

ORACLE["present_smoothed"] = f"""WITH {LOG}, {HAT}, {smoothed('log', 'run_id', 'loss', 'smo')}
SELECT run_id, step, round(smoothed_loss, 6) AS smoothed_loss FROM smo
WHERE smoothed_loss IS NOT NULL AND NOT isnan(smoothed_loss)"""

ORACLE["param_counts"] = f"""WITH {CFG}
SELECT id, depth, width,
       CAST(64 * width + width + depth * (width * width + width) + width * 10 + 10 AS BIGINT) AS total_params
FROM cfg"""

ORACLE["rescaled_features"] = """SELECT vec_id,
  list_transform(range(64), lambda j: round(CAST(embedding[(j % 16) * 4 + j // 16 + 1] AS DOUBLE) / 255, 6) + 0.0) AS features
FROM embeddings"""

ORACLE["join_logs_configs"] = f"""WITH {LOG}, {CFG}, {J}
SELECT run_id, step, split, round(loss, 6) AS loss, optimizer, round(learning_rate, 6) AS learning_rate,
       depth, width FROM j"""


def _facet(keys: list[str], drop_null: bool) -> str:
    where = ("WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys)) if drop_null else ""
    sel = ", ".join(f"round({k}, 6) AS {k}" if k in ("train_frac", "learning_rate") else k for k in keys)
    return f"""WITH {LOG}, {CFG}, {J}
SELECT {sel}, count(*) AS n_rows, count(DISTINCT run_id) AS n_series, min(step) AS first_step,
       max(step) AS last_step, round(avg(loss), 6) AS mean_value
FROM j {where} GROUP BY {', '.join(keys)}"""


ORACLE["facet_train_frac"] = _facet(["train_frac", "width", "depth"], True)
ORACLE["facet_optimizer_lr"] = _facet(["optimizer", "learning_rate"], False)

ORACLE["distinct_counts"] = f"""WITH {LOG}, {CFG}, {J}
SELECT CAST(count(DISTINCT width) + max(CASE WHEN width IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_width,
       CAST(count(DISTINCT depth) + max(CASE WHEN depth IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_depth,
       CAST(count(DISTINCT optimizer) + max(CASE WHEN optimizer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_optimizer
FROM j"""

ORACLE["single_width_check"] = f"""WITH {CFG}
SELECT round(train_frac, 6) AS train_frac, depth, count(DISTINCT width) AS n_values
FROM cfg GROUP BY train_frac, depth HAVING count(DISTINCT width) > 1"""

ORACLE["best_per_run_split"] = f"""WITH {LOG}
SELECT run_id, split, step AS best_loss_step, round(loss, 6) AS best_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, split ORDER BY loss, step) AS r
  FROM log WHERE loss IS NOT NULL AND NOT isnan(loss)) WHERE r = 1"""

ORACLE["run_elapsed"] = f"""WITH {LOG}
SELECT run_id, round((epoch_us(arg_max(time, step)) - epoch_us(arg_min(time, step))) / 1e6, 6) AS elapsed_sec
FROM log GROUP BY run_id"""


def chunk_ctes(src: str, flush: int, agg: int) -> str:
    """CTEs k1..k3 assigning (island, fg, chunk) to each record of ``src``."""
    fg = f"(rn - st) // {flush}" if flush else "0"
    return f"""k1 AS (SELECT *, row_number() OVER w - 1 AS rn,
       CASE WHEN row_number() OVER w > 1 AND split IS DISTINCT FROM lag(split) OVER w THEN 1 ELSE 0 END AS chg
     FROM {src} WINDOW w AS (PARTITION BY run_id ORDER BY step)),
k2 AS (SELECT *, sum(chg) OVER w2 AS island, max(CASE WHEN chg = 1 OR rn = 0 THEN rn END) OVER w2 AS st
     FROM k1 WINDOW w2 AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k3 AS (SELECT *, {fg} AS fg, ((rn - st) - ({fg}) * {flush}) // {agg} AS chunk FROM k2)"""


ORACLE["log_summary"] = f"""WITH {LOG}, {chunk_ctes('log', 20, 7)}
SELECT run_id AS logger_id, count(*) AS n_steps, arg_max(step, step) AS step,
       strftime(arg_max(time, step), '%Y-%m-%d %H:%M:%S.%f') AS time, arg_max(epoch, step) AS epoch,
       run_id, arg_max(split, step) AS split, round(avg(loss), 6) AS loss_mean,
       round(stddev_samp(loss), 6) AS loss_std, round(exp(avg(loss)), 6) AS perplexity
FROM k3 GROUP BY run_id, island, fg, chunk"""

ELOG = """e1 AS (SELECT vec_id, vec_id // 10 AS batch, label,
                  list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings),
e2 AS (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                 - logits[label + 1] AS ce,
              CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1.0 ELSE 0.0 END AS correct
       FROM e1),
elog AS (SELECT CAST(batch // 10 AS VARCHAR) AS run_id,
                CASE WHEN batch % 4 = 3 THEN 'val' ELSE 'train' END AS split, 1 AS epoch,
                batch + 1 AS step, make_timestamp(CAST((1704067200 + batch) * 1000000 AS BIGINT)) AS time,
                avg(ce) AS loss
         FROM e2 GROUP BY batch)"""

ORACLE["log_summary_accuracy"] = f"""WITH {ELOG}, {chunk_ctes('elog', 4, 3)},
rec AS (SELECT run_id AS logger_id, count(*) AS n_steps, arg_max(step, step) AS step,
       strftime(arg_max(time, step), '%Y-%m-%d %H:%M:%S.%f') AS time, arg_max(epoch, step) AS epoch,
       run_id, arg_max(split, step) AS split, round(avg(loss), 6) AS loss_mean,
       round(stddev_samp(loss), 6) AS loss_std, island, fg, chunk
       FROM k3 GROUP BY run_id, island, fg, chunk),
smp AS (SELECT k3.run_id, island, fg, chunk, avg(e2.correct) AS am, stddev_samp(e2.correct) AS asd
        FROM k3 JOIN e2 ON e2.batch + 1 = k3.step GROUP BY k3.run_id, island, fg, chunk)
SELECT logger_id, n_steps, step, time, epoch, rec.run_id, split, loss_mean, loss_std,
       round(am, 6) AS accuracy_mean, round(asd, 6) AS accuracy_std
FROM rec JOIN smp ON rec.run_id = smp.run_id AND rec.island = smp.island AND rec.fg = smp.fg
 AND rec.chunk = smp.chunk"""

ORACLE["union_sweeps"] = f"""WITH {LOG}
SELECT run_id, step, CASE WHEN day(time) <= 15 THEN epoch END AS epoch, round(loss, 6) AS loss,
       CASE WHEN day(time) <= 15 THEN 'first_half' ELSE 'second_half' END AS sweep_name FROM log"""

ORACLE["distinct_lrs"] = f"""WITH {CFG}
SELECT round(learning_rate, 6) AS learning_rate FROM (
  SELECT DISTINCT learning_rate FROM cfg WHERE exp_name = 'sweep_b' AND learning_rate < 0.5)"""

ORACLE["nth_from_end"] = f"""WITH {LOG}, {HAT}, {smoothed('log', 'run_id', 'loss', 'smo')}
SELECT run_id, step AS step_at, round(smoothed_loss, 6) AS smoothed_loss_at FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM smo) WHERE r = 31"""

ORACLE["first_in_group"] = f"""WITH {LOG}, {CFG}, {J}
SELECT depth, run_id AS first_run_id, width AS first_width FROM (
  SELECT *, row_number() OVER (PARTITION BY depth ORDER BY step, run_id, width) AS r FROM j) WHERE r = 1"""

ORACLE["report_head"] = f"""WITH {LOG}, {CFG},
b AS (SELECT run_id, step AS best_loss_step, loss AS best_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, step) AS r FROM log
  WHERE loss IS NOT NULL AND NOT isnan(loss)) WHERE r = 1)
SELECT run_id, depth, width, round(best_loss, 6) AS best_loss, best_loss_step
FROM b JOIN cfg ON b.run_id = cfg.id WHERE depth >= 3 ORDER BY best_loss, run_id LIMIT 30"""


# ---------------------------------------------------------------- text

def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Python's whitespace characters, for DuckDB's trim().
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
SEP = "chr(10) || chr(9)"

# The punctuation characters that are words of their own, escaped for a class.
_PUNCT = r""",.'"!#$%^&*(){}\[\];:<>/?\\|`~\-_=+"""
_WORD = _lit(f"[{_PUNCT}{WS_CHARS}]|[^{_PUNCT}{WS_CHARS}]+")


def occ_ctes(p: str, table: str, keys: list[str]) -> str:
    ks = ", ".join(keys)
    return f"""{p}_norm AS (SELECT {ks}, trim(text, {_lit(WS_CHARS)}) AS t FROM {table}),
{p}_occ AS (SELECT {ks}, u.w AS word, u.pos AS pos FROM (
   SELECT {ks}, unnest(list_transform(regexp_extract_all(t, {_WORD}), lambda x, i: {{'w': x, 'pos': i - 1}})) AS u
   FROM {p}_norm))"""


def bpe_ctes(p: str, table: str, key: str, k: int) -> str:
    """Word table, alphabet and k one-at-a-time merge rounds, unrolled."""
    out = [occ_ctes(p, table, [key]),
           f"""{p}_wf AS (SELECT word, count(*) AS freq FROM {p}_occ GROUP BY word),
{p}_ch AS (SELECT u.ch AS ch, {key} AS o1, pos AS o2, u.cp AS o3 FROM (
   SELECT {key}, pos, unnest(list_transform(regexp_extract_all(word, '(?s).'), lambda x, i: {{'ch': x, 'cp': i}})) AS u
   FROM {p}_occ)),
{p}_alpha AS (SELECT ch AS token, CAST(row_number() OVER (ORDER BY o1, o2, o3) + 2 AS INTEGER) AS id FROM (
   SELECT *, row_number() OVER (PARTITION BY ch ORDER BY o1, o2, o3) AS r FROM {p}_ch) WHERE r = 1),
{p}_s0 AS (SELECT chr(9) || array_to_string(regexp_extract_all(word, '(?s).'), {SEP}) || chr(10) AS sym, freq
   FROM {p}_wf WHERE length(word) > 1)"""]
    for i in range(k):
        out.append(f"""{p}_pc{i} AS (SELECT u.l AS l, u.r AS r, sum(freq) AS cnt FROM (
   SELECT unnest(list_transform(range(1, len(sy)), lambda j: {{'l': sy[j], 'r': sy[j + 1]}})) AS u, freq
   FROM (SELECT string_split(substr(sym, 2, length(sym) - 2), {SEP}) AS sy, freq FROM {p}_s{i})) GROUP BY 1, 2),
{p}_m{i} AS (SELECT {i} AS rank, l, r FROM {p}_pc{i} ORDER BY cnt DESC, l, r LIMIT 1),
{p}_s{i + 1} AS (SELECT replace(sym, chr(9) || m.l || {SEP} || m.r || chr(10), chr(9) || m.l || m.r || chr(10)) AS sym,
   freq FROM {p}_s{i} JOIN {p}_m{i} m ON true)""")
    union = " UNION ALL ".join(f"SELECT * FROM {p}_m{i}" for i in range(k))
    out.append(f"""{p}_merges AS (SELECT CAST(rank AS INTEGER) AS rank, l AS "left", r AS "right", l || r AS merged
   FROM ({union})),
{p}_vocab AS (SELECT 0 AS id, '[PAD]' AS token UNION ALL SELECT 1, '[UNK]' UNION ALL SELECT 2, '[EOS]'
   UNION ALL SELECT id, token FROM {p}_alpha
   UNION ALL SELECT CAST((SELECT count(*) FROM {p}_alpha) + 3 + rank AS INTEGER), merged FROM {p}_merges)""")
    return ",\n".join(out)


def encode_ctes(q: str, table: str, keys: list[str], p: str) -> str:
    """Greedy lowest-rank, leftmost merge per distinct word (recursive), then ids per text."""
    ks = ", ".join(keys)
    return f"""{occ_ctes(q, table, keys)},
{q}_mp AS (SELECT rank, chr(9) || "left" || {SEP} || "right" || chr(10) AS pat,
   chr(9) || "left" || "right" || chr(10) AS rep FROM {p}_merges),
{q}_e(word, sym, it) AS (
   SELECT word, chr(9) || array_to_string(regexp_extract_all(word, '(?s).'), {SEP}) || chr(10), 0
   FROM (SELECT DISTINCT word FROM {q}_occ)
   UNION ALL
   SELECT word, sym, it FROM (
     SELECT e.word, "left"(e.sym, position(mp.pat IN e.sym) - 1) || mp.rep
              || substr(e.sym, position(mp.pat IN e.sym) + length(mp.pat)) AS sym,
            e.it + 1 AS it, row_number() OVER (PARTITION BY e.word ORDER BY mp.rank) AS rk
     FROM {q}_e e JOIN {q}_mp mp ON position(mp.pat IN e.sym) > 0) WHERE rk = 1),
{q}_fin AS (SELECT word, arg_max(sym, it) AS sym FROM {q}_e GROUP BY word),
{q}_tok AS (SELECT word, u.t AS token, u.i AS ti FROM (
   SELECT word, unnest(list_transform(string_split(substr(sym, 2, length(sym) - 2), {SEP}),
                                      lambda x, i: {{'t': x, 'i': i}})) AS u FROM {q}_fin)),
{q}_ids AS (SELECT {', '.join('o.' + k for k in keys)}, o.pos, tk.ti, tk.token, coalesce(v.id, 1) AS id
   FROM {q}_occ o JOIN {q}_tok tk ON tk.word = o.word LEFT JOIN {p}_vocab v ON v.token = tk.token),
{q}_out AS (SELECT {', '.join('c.' + k for k in keys)},
   coalesce(list(i.id ORDER BY i.pos, i.ti) FILTER (WHERE i.id IS NOT NULL), []) AS ids,
   coalesce(string_agg(CASE WHEN i.id = 1 THEN '[UNK]' ELSE i.token END, '' ORDER BY i.pos, i.ti)
            FILTER (WHERE i.id IS NOT NULL), '') AS txt
   FROM {table} c LEFT JOIN {q}_ids i ON {' AND '.join(f'i.{k} = c.{k}' for k in keys)}
   GROUP BY {', '.join('c.' + k for k in keys)})"""


_K = 8
_DOC = bpe_ctes("d", "documents", "doc_id", _K)

ORACLE["normalized_text"] = f"""SELECT doc_id, CAST(length(trim(text, {_lit(WS_CHARS)})) AS BIGINT) AS n_chars,
  md5(trim(text, {_lit(WS_CHARS)})) AS text_md5 FROM documents"""

ORACLE["word_freq"] = f"""WITH {occ_ctes('d', 'documents', ['doc_id'])}
SELECT word, count(*) AS freq FROM d_occ GROUP BY word"""

ORACLE["alphabet"] = f"WITH {_DOC} SELECT token, id FROM d_alpha"

ORACLE["pair_counts"] = f"""WITH {bpe_ctes('d', 'documents', 'doc_id', 1)}
SELECT l AS "left", r AS "right", CAST(cnt AS BIGINT) AS "count" FROM d_pc0"""

ORACLE["top_pair"] = f"""WITH {bpe_ctes('d', 'documents', 'doc_id', 1)}
SELECT l AS "left", r AS "right", CAST(cnt AS BIGINT) AS "count" FROM d_pc0 ORDER BY cnt DESC, l, r LIMIT 1"""

ORACLE["bpe_merges"] = f"WITH {_DOC} SELECT * FROM d_merges"
ORACLE["bpe_vocab"] = f"WITH {_DOC} SELECT CAST(id AS INTEGER) AS id, token FROM d_vocab"

_CONV = encode_ctes("c", "conversations", ["conv_id", "turn"], "d")

ORACLE["encode_conversations"] = f"""WITH RECURSIVE {_DOC}, {_CONV}
SELECT conv_id, turn, CAST(ids || [2] AS INTEGER[]) AS ids FROM c_out"""

ORACLE["decode_conversations"] = f"""WITH RECURSIVE {_DOC}, {_CONV}
SELECT conv_id, turn, txt || '[EOS]' AS text FROM c_out"""

ORACLE["encoded_lengths"] = f"""WITH RECURSIVE {_DOC}, {_CONV}
SELECT conv_id, turn, CAST(len(ids) + 1 AS INTEGER) AS n_tokens FROM c_out"""

ORACLE["round_trip_documents"] = f"""SELECT doc_id, CAST(length(trim(text, {_lit(WS_CHARS)})) AS BIGINT) AS n_chars,
  md5(trim(text, {_lit(WS_CHARS)})) AS text_md5 FROM documents"""

ORACLE["round_trip_documents_1000"] = ORACLE["round_trip_documents"]

ORACLE["vocab_overlap"] = f"""WITH {_DOC}, {bpe_ctes('b', 'benchmark', 'item_id', _K)}
SELECT token FROM d_vocab INTERSECT SELECT token FROM b_vocab"""


# ---------------------------------------------------------------- ranks

ORACLE["make_batches"] = """SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS position,
  CAST((row_number() OVER (ORDER BY vec_id) - 1) // 64 AS BIGINT) AS batch FROM embeddings"""

ORACLE["step_schedule"] = """WITH cnt AS (SELECT count(*) AS n, CAST(ceil(count(*) / 64.0) AS BIGINT) AS per FROM embeddings),
g AS (SELECT e.epoch, b.batch, cnt.n, cnt.per FROM range(3) e(epoch), cnt, range(CAST((SELECT per FROM cnt) AS BIGINT)) b(batch))
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(batch AS INTEGER) AS batch, CAST(epoch * per + batch + 1 AS BIGINT) AS step,
  CAST(least(64, n - batch * 64) AS BIGINT) AS n_samples, (epoch * per + batch + 1) % 5 = 0 AS validate FROM g"""

ORACLE["epoch_shuffle"] = """WITH ex AS (SELECT vec_id, e.epoch FROM embeddings, range(3) e(epoch)),
r AS (SELECT vec_id, CAST(epoch AS INTEGER) AS epoch,
  CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || vec_id), '42:' || epoch || ':' || vec_id) - 1 AS BIGINT) AS position
  FROM ex)
SELECT vec_id, epoch, position, CAST(position // 64 AS BIGINT) AS batch FROM r"""

ORACLE["stride_sample"] = """SELECT event_id, user_id FROM (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r % 100 = 0"""

ORACLE["head_events"] = "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25"

ORACLE["range_events"] = """SELECT event_id, event_type FROM (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r >= 1000 AND r < 1050"""

ORACLE["subset_by_index"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"

_BATCH = f"""{_DOC}, {_CONV},
cb AS (SELECT conv_id, turn, ids || [2] AS ids, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS position
       FROM c_out),
cb2 AS (SELECT *, position // 16 AS batch, max(len(ids)) OVER (PARTITION BY position // 16) AS ml FROM cb),
cb3 AS (SELECT conv_id, turn, position, CAST(batch AS BIGINT) AS batch,
        CAST(ids || list_transform(range(ml - len(ids)), lambda x: 0) AS INTEGER[]) AS ids FROM cb2)"""

ORACLE["encode_batch"] = f"WITH RECURSIVE {_BATCH} SELECT conv_id, turn, batch, ids FROM cb3"

ORACLE["flatten_labels"] = f"""WITH RECURSIVE {_BATCH}
SELECT batch, CAST(count(*) AS INTEGER) AS n_rows, CAST(len(flatten(list(ids ORDER BY position))) AS INTEGER) AS n_labels,
  flatten(list(ids ORDER BY position)) AS labels FROM cb3 GROUP BY batch"""


# ---------------------------------------------------------------- vectors

_L10 = "list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))"

ORACLE["argmax_logits"] = f"""SELECT vec_id, label, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred
FROM (SELECT vec_id, label, {_L10} AS l FROM embeddings)"""

ORACLE["softmax_logits"] = f"""SELECT vec_id, list_transform(l, lambda x: round(exp(x - list_max(l))
  / list_sum(list_transform(l, lambda y: exp(y - list_max(l)))), 6) + 0.0) AS probs
FROM (SELECT vec_id, {_L10} AS l FROM embeddings)"""

ORACLE["mean_cross_entropy"] = f"""WITH {ELOG}
SELECT round(avg(ce), 6) + 0.0 AS loss, count(*) AS n_rows FROM e2 WHERE label <> 0"""

ORACLE["layer_norm"] = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, x, list_avg(x) AS m FROM v),
s2 AS (SELECT vec_id, x, m, sqrt(list_sum(list_transform(x, lambda y: (y - m) * (y - m))) / (len(x) - 1)) AS sd FROM s)
SELECT vec_id, CASE WHEN len(x) > 1 AND sd > 0 THEN list_transform(x, lambda y: round((y - m) / sd, 6) + 0.0) END AS normed
FROM s2"""

ORACLE["relu_features"] = """SELECT vec_id,
  list_transform(CAST(embedding AS DOUBLE[]), lambda y: round(greatest(y, 0.0), 6) + 0.0) AS features FROM embeddings"""


def _split_ctes(fractions, names, seed, table, key, cols):
    fr = list(fractions) + [round(1 - sum(fractions), 3)]
    labels = list(names) + ["remainder"]
    m = len(fr)
    fl = [f"CAST(floor(n * CAST({g} AS DOUBLE)) AS BIGINT)" for g in fr]
    left = f"(n - ({' + '.join(fl)}))"
    size = [f"({fl[i]} + {left} // {m} + CASE WHEN {i} < {left} % {m} THEN 1 ELSE 0 END)" for i in range(m)]
    cum = ["0"] + [" + ".join(size[: i + 1]) for i in range(m - 1)]
    case = " ".join(f"WHEN r >= {cum[i]} AND r < {cum[i]} + {size[i]} THEN '{labels[i]}'" for i in range(m))
    return f"""base AS (SELECT {cols}, row_number() OVER (ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)),
                                     '{seed}:' || CAST({key} AS VARCHAR)) - 1 AS r FROM {table}),
cnt AS (SELECT count(*) AS n FROM {table}),
lab AS (SELECT base.*, CASE {case} END AS split FROM base, cnt)"""


ORACLE["random_split"] = f"""WITH {_split_ctes([0.8, 0.1], ['train', 'val'], 42, 'embeddings', 'vec_id', 'vec_id, label')}
SELECT vec_id, label, split FROM lab WHERE split <> 'remainder'"""

ORACLE["evaluate_splits"] = f"""WITH {ELOG}, {_split_ctes([0.8, 0.1], ['train', 'val'], 42, 'embeddings', 'vec_id', 'vec_id')},
bt AS (SELECT lab.vec_id, split, (row_number() OVER (PARTITION BY split ORDER BY lab.vec_id) - 1) // 64 AS batch
       FROM lab WHERE split <> 'remainder')
SELECT split, CAST(bt.batch AS BIGINT) AS batch, count(*) AS n_samples, round(avg(ce), 6) + 0.0 AS loss,
       round(avg(correct), 6) + 0.0 AS accuracy
FROM bt JOIN e2 ON e2.vec_id = bt.vec_id GROUP BY split, bt.batch"""

ORACLE["score_centroids"] = """WITH xs AS (SELECT vec_id, label, u.i AS i, u.v AS v FROM (
   SELECT vec_id, label, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda v, i: {'v': v, 'i': i})) AS u
   FROM embeddings)),
c AS (SELECT label, i, avg(v) AS cv FROM xs GROUP BY label, i),
sc AS (SELECT xs.vec_id, c.label, sum(xs.v * c.cv) AS s FROM xs JOIN c ON c.i = xs.i GROUP BY xs.vec_id, c.label),
fl AS (SELECT v.vec_id, k.label, greatest(coalesce(sc.s, 0.0), 0.0) AS s
       FROM (SELECT DISTINCT vec_id FROM embeddings) v CROSS JOIN range(10) k(label)
       LEFT JOIN sc ON sc.vec_id = v.vec_id AND sc.label = k.label),
agg AS (SELECT vec_id, list(s ORDER BY label) AS l FROM fl GROUP BY vec_id)
SELECT vec_id, list_transform(l, lambda x: round(x, 6) + 0.0) AS logits,
       CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred FROM agg"""

ORACLE["embed_tokens"] = f"""WITH RECURSIVE {_DOC}, {_CONV},
t AS (SELECT conv_id, turn, unnest(list_transform(ids || [2], lambda x, i: {{'id': x, 'pos': i - 1}})) AS u FROM c_out)
SELECT conv_id, turn, CAST(u.pos AS INTEGER) AS pos, CAST(u.id AS INTEGER) AS token_id, e.embedding AS vector
FROM t JOIN embeddings e ON e.vec_id = u.id"""

# ---------------------------------------------------------------- sweeps

_AX = """r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS pr FROM region),
n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pn FROM nation),
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS pb FROM (SELECT DISTINCT p_brand FROM part)),
sz AS (SELECT (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM b) AS nb)"""

ORACLE["grid_expand"] = f"""WITH {_AX}
SELECT CAST((pr * nn + pn) * nb + pb + 1 AS BIGINT) AS run_id, r_name, n_nationkey, p_brand FROM r, n, b, sz"""

ORACLE["grid_paired"] = f"""WITH {_AX}
SELECT CAST(pr * nn + pn + 1 AS BIGINT) AS run_id, r_name, n_nationkey, n_regionkey FROM r, n, sz"""

_STATE = """st AS (SELECT CAST(user_id AS VARCHAR) AS run_id,
  CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'finished'
       WHEN event_type = 'error' THEN 'failed' ELSE 'new' END AS state,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"""

ORACLE["run_states"] = f"WITH {_STATE} SELECT run_id, state FROM st WHERE r = 1"
ORACLE["pending_runs"] = f"WITH {_STATE} SELECT run_id, state FROM st WHERE r = 1 AND state = 'new'"

ORACLE["default_params"] = f"""WITH {CFG}
SELECT id, coalesce(optimizer, 'sgd') AS optimizer, round(coalesce(learning_rate, 0.001), 6) + 0.0 AS learning_rate,
       128 AS train_batch, 1024 AS val_batch FROM cfg"""

ORACLE["series_labels"] = f"""WITH {CFG}
SELECT id, 'd' || depth || '_w' || width AS model_label, coalesce(optimizer, 'None') || '_' || depth AS opt_label,
       printf('%04d', CAST(id AS BIGINT) + 1) AS run_dir FROM cfg"""

ORACLE["json_fields"] = """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(json_object('run_id', CAST(user_id AS VARCHAR), 'step', event_id) AS VARCHAR) AS record FROM events"""

# ---------------------------------------------------------------- sources

ORACLE["jsonl_logs"] = f"""WITH {LOG}
SELECT run_id, split, epoch, step, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time, round(loss, 6) + 0.0 AS loss
FROM log"""

ORACLE["jsonl_configs"] = _flat(".")

ORACLE["sweep_run_table"] = f"""WITH {_AX}
SELECT CAST((pr * nn + pn) * nb + pb + 1 AS BIGINT) AS run_id, printf('%04d', (pr * nn + pn) * nb + pb + 1) AS run_dir,
  'new' AS state, 'grid' AS experiment, r_name AS "config.data.r_name", n_nationkey AS "config.data.n_nationkey",
  p_brand AS "config.model.p_brand" FROM r, n, b, sz"""

ORACLE["page_file_names"] = r"""SELECT page_id, fn AS file_name, CASE WHEN len(parts) >= 2 THEN parts[-2] END AS item_id,
  parts[-1] AS category FROM (
  SELECT page_id, fn, string_split(regexp_extract(fn, '^(.+?)(\.[^.]*)?$', 1), '_') AS parts FROM (
    SELECT page_id, replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '_') AS fn FROM pages))"""

ORACLE["stream_log_summary"] = ORACLE["log_summary"]
ORACLE["stream_log_summary_accuracy"] = ORACLE["log_summary_accuracy"]
ORACLE["stream_log_summary_shuffled"] = ORACLE["log_summary"]
#: The run's latest record of the later half passes every earlier step.
ORACLE["stream_rejected_records"] = f"""WITH {LOG},
p AS (SELECT run_id, max(step) AS passed FROM log WHERE day(time) > 15 GROUP BY run_id)
SELECT log.run_id, split, epoch, step, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time
FROM log JOIN p ON log.run_id = p.run_id WHERE day(time) <= 15 AND step <= passed"""
ORACLE["log_summary_user_metric"] = f"""WITH {LOG}, {chunk_ctes('log', 20, 7)}
SELECT run_id AS logger_id, count(*) AS n_steps, arg_max(step, step) AS step,
       strftime(arg_max(time, step), '%Y-%m-%d %H:%M:%S.%f') AS time, arg_max(epoch, step) AS epoch,
       run_id, arg_max(split, step) AS split, round(avg(loss), 6) AS loss_mean, round(stddev_samp(loss), 6) AS loss_std,
       round(min(loss), 6) AS loss_min, round(max(loss), 6) AS loss_max, round(avg(abs(loss)), 6) AS loss_size
FROM k3 GROUP BY run_id, island, fg, chunk"""
ORACLE["log_summary_user_metric_skew_safe"] = ORACLE["log_summary_user_metric"]
ORACLE["stream_log_summary_user_metric"] = ORACLE["log_summary_user_metric"]
ORACLE["stream_join_configs"] = ORACLE["join_logs_configs"]

ORACLE["append_summaries"] = ORACLE["log_summary"]

ORACLE["samples_train"] = f"""WITH {_split_ctes([0.5], ['train'], 42, 'embeddings', 'vec_id', 'vec_id, label')}
SELECT vec_id AS id, label FROM lab WHERE split = 'train'"""
ORACLE["log_summary_skew_safe"] = ORACLE["log_summary"]
ORACLE["best_steps_skew_safe"] = ORACLE["best_steps"]
ORACLE["nth_from_end_skew_safe"] = ORACLE["nth_from_end"]

ORACLE["token_ids"] = f"""WITH {_DOC}, {occ_ctes('c', 'conversations', ['conv_id', 'turn'])}
SELECT w.word AS token, CAST(coalesce(v.id, 1) AS INTEGER) AS id
FROM (SELECT DISTINCT word FROM c_occ) w LEFT JOIN d_vocab v ON v.token = w.word"""

ORACLE["chunk_field_lists"] = f"""WITH {LOG}, {chunk_ctes('log', 20, 7)}
SELECT run_id, CAST(island AS BIGINT) AS island, CAST(fg AS BIGINT) AS flush_group, CAST(chunk AS BIGINT) AS chunk,
       list(round(loss, 6) + 0.0 ORDER BY step) AS losses, list(step ORDER BY step) AS steps
FROM k3 GROUP BY run_id, island, fg, chunk"""

ORACLE["relayout_pages"] = r"""SELECT category, count(*) AS n_files, CAST(sum(length(html)) AS BIGINT) AS n_bytes FROM (
  SELECT html, nullif(string_split(regexp_extract(fn, '^(.+?)(\.[^.]*)?$', 1), '_')[-1], '') AS category FROM (
    SELECT html, replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '_') AS fn FROM pages))
GROUP BY category"""

# ---------------------------------------------------------------- sweep read path, sinks, collation

SWEEPS = f"""mlog AS (SELECT * EXCLUDE (loss), loss AS loss_mean, exp(-loss) AS accuracy_mean FROM log),
{smoothed('mlog', 'run_id', 'loss_mean', 'sl')}, {smoothed('sl', 'run_id', 'accuracy_mean', 'sa')},
sweeps AS (SELECT cfg.exp_name AS sweep_name, sa.run_id, sa.step, sa.epoch AS epoch_x, cfg.depth AS epoch_y, cfg.optimizer, cfg.depth,
       cfg.width, loss_mean, CASE WHEN cfg.exp_name = 'sweep_a' THEN accuracy_mean END AS accuracy_mean, smoothed_loss_mean,
       CASE WHEN cfg.exp_name = 'sweep_a' THEN smoothed_accuracy_mean END AS smoothed_accuracy_mean
     FROM sa JOIN cfg ON sa.run_id IS NOT DISTINCT FROM cfg.id)"""

_METRIC_BEST = [("loss_mean", "lower"), ("accuracy_mean", "higher"), ("smoothed_loss_mean", "lower"), ("smoothed_accuracy_mean", "higher")]

ORACLE["sweep_read"] = f"""WITH {LOG}, {CFG}, {HAT}, {SWEEPS}
SELECT sweep_name, run_id, step, epoch_x, epoch_y, optimizer, round(loss_mean, 6) + 0.0 AS loss_mean,
       round(accuracy_mean, 6) + 0.0 AS accuracy_mean, round(smoothed_loss_mean, 6) + 0.0 AS smoothed_loss_mean,
       round(smoothed_accuracy_mean, 6) + 0.0 AS smoothed_accuracy_mean FROM sweeps"""

ORACLE["sweep_best"] = f"""WITH {LOG}, {CFG}, {HAT}, {SWEEPS},
{', '.join(f'b_{m} AS {_best("sweeps", "run_id", m, d)}' for m, d in _METRIC_BEST)}
SELECT sweep_name, run_id, {', '.join(f'best_{m}_step, round(best_{m}, 6) + 0.0 AS best_{m}' for m, _ in _METRIC_BEST)}
FROM (SELECT DISTINCT sweep_name, run_id FROM sweeps) {' '.join(f'LEFT JOIN b_{m} USING (run_id)' for m, _ in _METRIC_BEST)}"""

ORACLE["sweep_series"] = f"""WITH {LOG}, {CFG}, {HAT}, {SWEEPS}, b AS {_best('sweeps', 'run_id', 'loss_mean', 'lower')}
SELECT optimizer, depth, run_id, step, round(smoothed_loss_mean, 6) + 0.0 AS smoothed_loss_mean, best_loss_mean_step,
       round(best_loss_mean, 6) + 0.0 AS best_loss_mean
FROM sweeps LEFT JOIN b USING (run_id) WHERE optimizer IS NOT NULL AND depth IS NOT NULL"""

ORACLE["facet_series_null"] = f"""WITH {LOG}, {CFG}, {J}
SELECT optimizer, round(learning_rate, 6) + 0.0 AS learning_rate, run_id, step, round(loss, 6) + 0.0 AS loss FROM j"""

ORACLE["log_summary_pandas_metric"] = f"""WITH {LOG}, {chunk_ctes('log', 20, 7)}
SELECT run_id AS logger_id, count(*) AS n_steps, arg_max(step, step) AS step,
       strftime(arg_max(time, step), '%Y-%m-%d %H:%M:%S.%f') AS time, arg_max(epoch, step) AS epoch,
       run_id, arg_max(split, step) AS split, round(avg(loss), 6) AS loss_mean, round(stddev_samp(loss), 6) AS loss_std,
       round(max(loss), 6) AS loss_max, round(median(loss), 6) AS loss_median
FROM k3 GROUP BY run_id, island, fg, chunk"""

ORACLE["materialised_features"] = f"""WITH {_split_ctes([0.8, 0.1], ['train', 'val'], 42, 'embeddings', 'vec_id', 'vec_id, embedding')}
SELECT vec_id, split, list_transform(CAST(embedding AS DOUBLE[]), lambda y: round(greatest(y / 255, 0.0), 6) + 0.0) AS features
FROM lab WHERE split <> 'remainder'"""

ORACLE["sorted_vocab"] = ORACLE["bpe_vocab"]

ORACLE["corpus_splits"] = """SELECT doc_id, CASE WHEN lang = 'en' THEN 'train' ELSE 'validation' END AS split,
  CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents"""

ORACLE["collated_batches"] = """SELECT CAST(vec_id_rank // 64 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n_rows,
  list(vec_id ORDER BY vec_id) AS vec_id, list(label ORDER BY vec_id) AS label
FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS vec_id_rank FROM embeddings) GROUP BY 1"""

ORACLE["grid_nested"] = f"""WITH {_AX}, rn AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS po FROM region)
SELECT CAST((po * nb + pb) * nn + pn + 1 AS BIGINT) AS run_id, r_name AS "data/region", p_brand AS "model/brand",
  CAST(n_nationkey AS INTEGER) AS "trainer/steps" FROM rn, n, b, sz"""

ORACLE["sweep_train_schedule"] = """WITH n AS (SELECT count(*) FILTER (WHERE vec_id % 5 <> 0) AS train, count(*) FILTER (WHERE vec_id % 5 = 0) AS val FROM embeddings),
s AS (SELECT train, val, CAST(ceil(train / 128.0) AS BIGINT) AS per, unnest(range(1, 2 * CAST(ceil(train / 128.0) AS BIGINT) + 1)) AS step FROM n),
r AS (SELECT unnest([1, 2, 3, 4]) AS run_id)
SELECT CAST(run_id AS BIGINT) AS run_id, 'train' AS split, CAST((step - 1) // per AS INTEGER) AS epoch, step, CAST(least(128, train - ((step - 1) % per) * 128) AS BIGINT) AS n_samples FROM s, r
UNION ALL SELECT CAST(run_id AS BIGINT), 'val', CAST((step - 1) // per AS INTEGER), step, val FROM s, r WHERE step % 3 = 0"""

ORACLE["jsonl_logs_whole"] = f"""WITH {LOG} SELECT run_id, split, epoch, step, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time, round(loss, 6) AS loss
FROM log WHERE step % 17 NOT IN (0, 1)"""
ORACLE["jsonl_logs_broken"] = f"""WITH {LOG} SELECT '{{"run_id":"' || run_id || '","step":' || CASE WHEN step % 17 = 0 THEN CAST(step AS VARCHAR) ELSE '"x' || step || '"}}' END AS line
FROM log WHERE step % 17 IN (0, 1)"""

ORACLE["score_centroids_tables"] = ORACLE["score_centroids"]
