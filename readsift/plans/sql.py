"""DuckDB SQL for the queries of ``readsift.plans.queries``."""

from __future__ import annotations

import math

from readsift.config import IndexSettings
from readsift.functions import kernel, stats
from readsift.operators import models
from readsift.plans.queries import BINARY, BY_LANGUAGE, CLASSIFY, DEHOST, TO_FIT

S = IndexSettings()


def _bases(c: str) -> str:
    return f"translate(regexp_replace(lower(COALESCE({c}, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _hashes(source: str) -> str:
    """CTEs up to m(src, key, h): the distinct minimisers of source(src, key, s). k-mer hashes grow by doubling."""
    k, width, seed = S.kmer_size, S.window_size - S.kmer_size + 1, kernel.SEED
    assert k == 19
    win = "(PARTITION BY src, key ORDER BY i)"
    step = lambda name, of, n: f"""
{name} AS (SELECT *, f{n} * {5**n} + lead(f{n}, {n}) OVER {win} AS f{2 * n}, r{n} + {5**n} * lead(r{n}, {n}) OVER {win} AS r{2 * n} FROM {of}),"""  # noqa: E731
    return f"""
src AS ({source}),
d0 AS (SELECT src, key, unnest(range(len(s))) AS i, unnest(string_split(translate(s, 'ACGNT', '01234'), '')) AS c FROM src WHERE len(s) >= {k}),
d1 AS (SELECT src, key, i, CAST(c AS BIGINT) AS f1, CAST(translate(c, '01234', '42130') AS BIGINT) AS r1 FROM d0),{step("d2", "d1", 1)}{step("d4", "d2", 2)}{step("d8", "d4", 4)}{step("d16", "d8", 8)}
d19 AS (SELECT src, key, i, f16 * 125 + lead(f2, 16) OVER {win} * 5 + lead(f1, 18) OVER {win} AS f,
               r16 + {5**16} * lead(r2, 16) OVER {win} + {5**18} * lead(r1, 18) OVER {win} AS r FROM d16),
x AS (SELECT src, key, i, least(xor(CAST(f AS UBIGINT), CAST('{seed}' AS UBIGINT)), xor(CAST(r AS UBIGINT), CAST('{seed}' AS UBIGINT))) AS x FROM d19 WHERE f IS NOT NULL),
y AS (SELECT src, key, i, min(x) OVER w AS u, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY src, key ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)),
m AS (SELECT DISTINCT src, key, CAST(CAST(u AS HUGEINT) - 18446744073709551616 AS BIGINT) AS h FROM y WHERE n = {width} OR i = 0)"""


_READS = f"SELECT -1 AS src, doc_id AS key, {_bases('text')} AS s FROM documents WHERE text IS NOT NULL"
_PAGE = "CASE regexp_extract(COALESCE(html, ''), 'lang=\"([a-z]+)\"', 1) WHEN 'en' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 WHEN 'fr' THEN 5 ELSE 6 END"
_REFS = f"""SELECT 0 AS src, row_number() OVER () AS key, {_bases('text')} AS s FROM benchmark
UNION ALL SELECT 1, row_number() OVER (), {_bases('text')} FROM conversations
UNION ALL SELECT {_PAGE}, row_number() OVER (), {_bases('html')} FROM pages"""
_INDEX = "idx AS (SELECT DISTINCT CAST(src AS INTEGER) AS bin, h FROM m WHERE src >= 0)"
_STATS = f"""WITH {_hashes(_REFS)}, {_INDEX},
st AS (
  SELECT CAST(b AS INTEGER) AS bin, (SELECT count(*) FROM src WHERE src.src = b) AS n_records, (SELECT count(*) FROM idx WHERE idx.bin = b) AS n_hashes
  FROM range(7) t(b)
)"""
_ALL = f"WITH {_hashes(_READS + ' UNION ALL ' + _REFS)}, {_INDEX}, rh AS (SELECT key AS read_ord, h FROM m WHERE src = -1)"


def _scores(categories: list[str]) -> str:
    """CTEs up to sc: one row per read and category."""
    names = sorted(set(categories))
    values = ", ".join(f"({i}, {names.index(c)})" for i, c in enumerate(categories))
    return f"""{_ALL},
cat(bin, category_idx) AS (VALUES {values}),
rd AS (SELECT doc_id AS read_ord, CAST(len({_bases('text')}) AS BIGINT) AS length, CAST(10 + n_chars % 20 AS DOUBLE) AS mean_quality FROM documents WHERE text IS NOT NULL AND len({_bases('text')}) > 0),
nh AS (SELECT read_ord, (SELECT count(*) FROM rh WHERE rh.read_ord = rd.read_ord) AS num_hashes FROM rd),
hb AS (SELECT read_ord, bin, count(*) AS hits FROM rh JOIN idx USING (h) GROUP BY ALL),
best AS (
  SELECT read_ord, category_idx, bin AS best_bin, hits AS count FROM (
    SELECT rd.read_ord, cat.category_idx, cat.bin, COALESCE(hb.hits, 0) AS hits,
           row_number() OVER (PARTITION BY rd.read_ord, cat.category_idx ORDER BY COALESCE(hb.hits, 0) DESC, cat.bin) AS place
    FROM rd CROSS JOIN cat LEFT JOIN hb ON hb.read_ord = rd.read_ord AND hb.bin = cat.bin
  ) WHERE place = 1
),
uq AS (
  SELECT read_ord, c AS category_idx, count(*) AS unique_count FROM (
    SELECT rh.read_ord, rh.h, min(best.category_idx) AS c FROM rh JOIN idx USING (h) JOIN best ON best.read_ord = rh.read_ord AND best.best_bin = idx.bin
    GROUP BY rh.read_ord, rh.h HAVING count(*) = 1
  ) GROUP BY ALL
),
sc AS (
  SELECT read_ord, category_idx, num_hashes, best_bin, count, COALESCE(unique_count, 0) AS unique_count,
         CASE WHEN num_hashes > 0 THEN count / CAST(num_hashes AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END AS prop,
         CASE WHEN num_hashes > 0 THEN COALESCE(unique_count, 0) / CAST(num_hashes AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END AS unique_prop
  FROM best JOIN nh USING (read_ord) LEFT JOIN uq USING (read_ord, category_idx)
)"""


_LONG = "SELECT read_ord, category_idx, num_hashes, best_bin, count, unique_count, round(prop, 6) AS prop, round(unique_prop, 6) AS unique_prop FROM sc"
_CANDIDATES = """,
top AS (SELECT read_ord, max(unique_prop) AS top, count(*) FILTER (unique_prop > 0.15) AS above FROM sc WHERE num_hashes > 0 GROUP BY read_ord),
pos AS (SELECT read_ord, CASE WHEN count(*) = 1 THEN min(category_idx) END AS pos FROM sc JOIN top USING (read_ord) WHERE unique_prop = top AND top > 0 GROUP BY read_ord),
cand AS (
  SELECT sc.read_ord, sc.category_idx, CASE WHEN sc.category_idx IS NOT DISTINCT FROM pos THEN 'pos' ELSE 'neg' END AS side, unique_prop AS value
  FROM sc JOIN top USING (read_ord) LEFT JOIN pos USING (read_ord)
  WHERE CASE WHEN sc.category_idx IS NOT DISTINCT FROM pos THEN above = 1 ELSE unique_prop > 0 AND (above = 0 OR (above = 1 AND pos IS NOT NULL)) END
)"""


def _density(dist: str, side: str, x: str) -> str:
    if dist == "kde":
        return _kernel_density(side, x)
    if dist == "gamma":
        shape, loc, scale = models.GAMMA[side]
        return f"CASE WHEN {x} - {loc} > 0 THEN exp(({shape} - 1) * ln({x} - {loc}) - ({x} - {loc}) / {scale} - {math.lgamma(shape) + shape * math.log(scale)!r}) ELSE 0.0 END"
    a, b = models.BETA[side]
    c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return f"CASE WHEN {x} > 0 AND {x} < 1 THEN exp({c!r} + ({a} - 1) * ln({x}) + ({b} - 1) * ln(1 - {x})) ELSE 0.0 END"


def _kernel_density(side: str, x: str) -> str:
    held = models.prior("kde")[side]
    values = ", ".join(map(repr, held.sample))
    return f"(list_sum(list_transform([{values}], lambda v: exp(-0.5 * pow(({x} - v) / {held.h}, 2)))) / {math.sqrt(2 * math.pi) * held.h * len(held.sample)!r})"


def _trained(dist: str) -> str:
    """CTEs up to pr by models fitted to the first reads of each category and side, where there are TO_FIT of them."""
    sides = ", ".join(f"({c}, '{s}')" for c in range(len(set(BINARY))) for s in ("pos", "neg"))
    if dist == "beta":
        given = " ".join(f"WHEN '{s}' THEN {{{i}}}" for i, s in enumerate(("pos", "neg")))
        pick = lambda k: f"CASE side {given.format(models.BETA['pos'][k], models.BETA['neg'][k])} END"
        fitted = f"""CASE WHEN n >= {TO_FIT} AND c IS NOT NULL THEN mean * c ELSE {pick(0)} END AS p1, CASE WHEN n >= {TO_FIT} AND c IS NOT NULL THEN (1 - mean) * c ELSE {pick(1)} END AS p2, 0.0 AS loc
  FROM (SELECT *, CASE WHEN variance > 0 AND variance < mean * (1 - mean) THEN mean * (1 - mean) / variance - 1 END AS c FROM mo)"""
        density = "CASE WHEN x > 0 AND x < 1 THEN exp(lgamma(p1 + p2) - lgamma(p1) - lgamma(p2) + (p1 - 1) * ln(x) + (p2 - 1) * ln(1 - x)) ELSE 0.0 END"
    elif dist == "kde":
        fitted = "0.0 AS p1, 0.0 AS p2, 0.0 AS loc, n, h FROM (SELECT *, CASE side " + " ".join(f"WHEN '{s}' THEN {models.KDE[s][3]}" for s in ("pos", "neg")) + " END AS h FROM mo)"
        prior = " ".join(f"WHEN '{s}' THEN {_kernel_density(s, 'x')}" for s in ("pos", "neg"))
        own = f"(SELECT avg(exp(-0.5 * pow((x - value) / h, 2))) / (h * {math.sqrt(2 * math.pi)!r}) FROM few WHERE few.category_idx = ft.category_idx AND few.side = ft.side)"
        density = f"CASE WHEN n >= {TO_FIT} THEN {own} ELSE CASE side {prior} END END"
    else:
        given = " ".join(f"WHEN '{s}' THEN {{{i}}}" for i, s in enumerate(("pos", "neg")))
        pick = lambda k: f"CASE side {given.format(models.GAMMA['pos'][k], models.GAMMA['neg'][k])} END"
        fitted = f"""CASE WHEN n >= {TO_FIT} AND s > 0 THEN shape ELSE {pick(0)} END AS p1, CASE WHEN n >= {TO_FIT} AND s > 0 THEN mean / shape ELSE {pick(2)} END AS p2,
         CASE WHEN side = 'neg' AND n < {TO_FIT} THEN COALESCE(mean, 0) - {models.GAMMA['neg'][0]} * {models.GAMMA['neg'][2]} ELSE 0.0 END AS loc
  FROM (SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS shape FROM (SELECT *, ln(mean) - mean_log AS s FROM mo))"""
        density = "CASE WHEN x - loc > 0 THEN exp((p1 - 1) * ln(x - loc) - (x - loc) / p2 - lgamma(p1) - p1 * ln(p2)) ELSE 0.0 END"
    return f"""{_CANDIDATES},
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_idx, side ORDER BY read_ord) AS place FROM cand) WHERE place <= {TO_FIT}),
sides(category_idx, side) AS (VALUES {sides}),
mo AS (SELECT category_idx, side, count(value) AS n, avg(value) AS mean, avg(ln(value)) AS mean_log, COALESCE(var_samp(value), 0) AS variance FROM sides LEFT JOIN few USING (category_idx, side) GROUP BY ALL),
ft AS (SELECT category_idx, side, {fitted}),
de AS (SELECT read_ord, category_idx, side, num_hashes, x, {density} AS d FROM (SELECT read_ord, category_idx, num_hashes, CASE WHEN num_hashes > 0 THEN unique_prop ELSE 0.0 END AS x FROM sc) JOIN ft USING (category_idx)),
bo AS (SELECT read_ord, category_idx, any_value(num_hashes) AS num_hashes, any_value(x) AS x, max(CASE WHEN side = 'pos' THEN CASE WHEN x = 1 THEN 1.0 ELSE d END END) AS p, max(CASE WHEN side = 'neg' THEN d END) AS n FROM de GROUP BY read_ord, category_idx)
SELECT read_ord, category_idx, round(CASE WHEN num_hashes > 0 THEN p / (300 * exp(-300 * x) + p + n) ELSE 0.0 END, 5) AS probability FROM bo"""


def _likely(dist: str) -> str:
    positive = f"CASE WHEN unique_prop = 1 THEN 1.0 ELSE {_density(dist, 'pos', 'unique_prop')} END"
    return f""",
pr AS (SELECT *, CASE WHEN num_hashes > 0 THEN p / (300 * exp(-300 * unique_prop) + p + n) ELSE 0.0 END AS probability
       FROM (SELECT *, CASE WHEN num_hashes > 0 THEN {positive} END AS p, CASE WHEN num_hashes > 0 THEN {_density(dist, 'neg', 'unique_prop')} END AS n FROM sc))"""


def _good(s) -> str:
    return f"rd.mean_quality >= {s.min_quality} AND rd.length >= 140"


_HOST = f"""{_scores(BINARY)}{_likely('beta')},
pairs AS (
  SELECT h.read_ord, h.num_hashes, h.unique_prop AS uh, o.unique_prop AS uo, h.probability AS ph, o.probability AS po,
         CAST(least(255, CASE WHEN h.num_hashes > 0 AND h.unique_prop < o.unique_prop THEN o.unique_count - h.unique_count ELSE h.unique_count - o.unique_count END) AS INTEGER) AS confidence
  FROM pr h JOIN pr o USING (read_ord) WHERE h.category_idx = 0 AND o.category_idx = 1
),
called AS (
  SELECT rd.read_ord, rd.length, rd.mean_quality, num_hashes, confidence,
         CASE WHEN num_hashes = 0 OR NOT ({_good(DEHOST)}) OR confidence < {DEHOST.confidence} THEN NULL
              WHEN uh > uo AND uh - uo > {DEHOST.min_proportion_diff} AND ph > po AND ph - po > {DEHOST.min_probability_diff} THEN 'human'
              WHEN uh < {DEHOST.host_unique_prop_lo_threshold} AND uo > uh AND uo - uh > {DEHOST.min_proportion_diff} AND po > ph AND po - ph > {DEHOST.min_probability_diff} THEN 'microbe' END AS call
  FROM rd JOIN pairs USING (read_ord)
)"""
_NAMES = ", ".join(f"'{c}'" for c in sorted(set(BY_LANGUAGE)))
_EVENTS = "WITH e AS (SELECT event_type, (value + 1) / (value + 1000) AS value FROM events), t AS (SELECT event_type, count(*) AS n, avg(value) AS mean, avg(ln(value)) AS mean_log, var_samp(value) AS variance FROM e GROUP BY event_type)"
_BITS = f"CAST(least({S.bits}, ceil(-(n_hashes * {S.num_hash}) / {math.log(1 - math.exp(math.log(S.max_fpr) / S.num_hash))!r})) AS BIGINT)"
_SMALL = stats.capacity(12_000, S.max_fpr, S.num_hash)

ORACLES = {
    "minimisers_distinct": f"WITH {_hashes(_READS)} SELECT key AS read_ord, h FROM m",
    "kmer_window_min": f"WITH {_hashes('SELECT 0 AS src, item_id AS key, ' + _bases('text') + ' AS s FROM benchmark WHERE text IS NOT NULL')} SELECT key AS item_id, h FROM m",
    "bin_stats": f"{_STATS} SELECT * FROM st",
    "bins_by_size": f"{_STATS} SELECT *, CAST(row_number() OVER (ORDER BY n_hashes, bin) AS INTEGER) AS place FROM st",
    "max_bin": f"{_STATS} SELECT max(n_hashes) AS max_num_hashes FROM st",
    "bloom_sizing": f"{_STATS} SELECT bin, n_hashes, CASE WHEN n_hashes > 0 THEN {_BITS} ELSE 0 END AS bits FROM st",
    "bloom_capacity": f"{_STATS} SELECT *, CAST({_SMALL} AS BIGINT) AS max_num_hashes FROM st WHERE n_hashes > {_SMALL}",
    "membership_probe": f"{_ALL} SELECT read_ord, h, COALESCE(string_agg(CAST(bin AS VARCHAR), ',' ORDER BY bin), '') AS bins FROM rh LEFT JOIN idx USING (h) GROUP BY read_ord, h",
    "hits_per_bin": f"{_ALL} SELECT read_ord, bin, count(*) AS hits FROM rh JOIN idx USING (h) GROUP BY ALL",
    "hits_per_bin_local": f"{_ALL} SELECT read_ord, bin, count(*) AS hits FROM rh JOIN idx USING (h) GROUP BY ALL",
    "category_scores": f"{_scores(BINARY)} {_LONG}",
    "category_scores_by_language": f"{_scores(BY_LANGUAGE)} {_LONG}",
    "training_candidates": f"{_scores(BINARY)}{_CANDIDATES} SELECT read_ord, category_idx, side, round(value, 6) AS value FROM cand",
    "training_first_n": f"{_scores(BINARY)}{_CANDIDATES} SELECT read_ord, category_idx, side, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY category_idx, side ORDER BY read_ord) AS place FROM cand) WHERE place <= {TO_FIT}",
    "gamma_fit": f"{_EVENTS}, s AS (SELECT *, ln(mean) - mean_log AS s FROM t), g AS (SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS shape FROM s) SELECT event_type, n, round(mean, 6) AS mean, round(shape, 6) AS shape, round(mean / shape, 6) AS scale FROM g",
    "beta_fit": f"{_EVENTS}, c AS (SELECT *, CASE WHEN variance > 0 AND variance < mean * (1 - mean) THEN mean * (1 - mean) / variance - 1 END AS c FROM t) SELECT event_type, n, round(variance, 6) AS variance, round(mean * c, 6) AS alpha, round((1 - mean) * c, 6) AS beta FROM c",
    "kde_bandwidth": f"{_EVENTS} SELECT event_type, round(0.9 * least((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34, stddev_samp(value)) * pow(count(*), -0.2), 6) AS h FROM e GROUP BY event_type",
    "kde_density": "WITH s AS (SELECT s_nationkey, s_acctbal / 10000 AS v FROM supplier WHERE s_acctbal IS NOT NULL), a AS (SELECT c_nationkey, round(avg(c_acctbal) / 10000, 6) AS x FROM customer GROUP BY c_nationkey) SELECT c_nationkey, x, round(sum(exp(-0.5 * ((x - v) / 0.1) * ((x - v) / 0.1))) / (sqrt(2 * pi()) * 0.1 * count(*)), 6) AS density FROM a JOIN s ON s_nationkey = c_nationkey GROUP BY c_nationkey, x",
    "gamma_score": f"{_scores(BINARY)}{_likely('gamma')} SELECT read_ord, category_idx, round(probability, 6) AS probability FROM pr",
    "kde_score": f"{_scores(BINARY)}{_likely('kde')} SELECT read_ord, category_idx, round(probability, 6) AS probability FROM pr",
    "trained_gamma": f"{_scores(BINARY)}{_trained('gamma')}",
    "trained_kde": f"{_scores(BINARY)}{_trained('kde')}",
    "assignment_lines": f"""{_HOST}
SELECT concat_ws(chr(9), any_value(CASE WHEN call IS NULL THEN 'U' ELSE 'C' END), 'doc' || read_ord, any_value(COALESCE(call, '')), any_value(length), any_value(pr.num_hashes), any_value(printf('%.6g', mean_quality)), any_value(confidence), '0',
  string_agg(concat_ws(':', (['human', 'microbe'])[category_idx + 1], count, printf('%.6g', prop), printf('%.6g', unique_prop), printf('%.6g', probability)) || ' ', '' ORDER BY category_idx)) AS value
FROM called JOIN pr USING (read_ord) GROUP BY read_ord""",
    "trained_beta": f"{_scores(BINARY)}{_trained('beta')}",
    "filter_contains_hits": f"{_ALL} SELECT read_ord, bin, count(*) AS hits, true AS contained FROM rh JOIN idx USING (h) GROUP BY ALL",
    "minimisers_of_items": f"""WITH RECURSIVE {_hashes('SELECT 0 AS src, item_id AS key, ' + _bases('text') + ' AS s FROM benchmark WHERE text IS NOT NULL')},
n AS (SELECT key, max(i) AS last FROM x GROUP BY key),
pos AS (SELECT key, i, x FROM x),
e(key, place, i, v) AS (
  SELECT key, 0, max(i), any_value(v) FROM (SELECT key, i, x AS v, min(x) OVER (PARTITION BY key) AS low FROM pos WHERE i < {S.window_size - S.kmer_size + 1}) WHERE v = low GROUP BY key
  UNION ALL
  SELECT key, place + 1, CASE WHEN drop_at IS NOT NULL THEN drop_at ELSE next_at END, (SELECT x FROM pos WHERE pos.key = f.key AND pos.i = CASE WHEN drop_at IS NOT NULL THEN drop_at ELSE next_at END)
  FROM (
    SELECT e.key, place, min(p.i) FILTER (p.x < e.v AND p.i < e.i + least({S.window_size - S.kmer_size + 1}, last + 1)) AS drop_at, arg_min(p.i, (p.x, -p.i)) AS next_at, any_value(e.i + least({S.window_size - S.kmer_size + 1}, last + 1) <= last) AS more
    FROM e JOIN n USING (key) JOIN pos p ON p.key = e.key AND p.i > e.i AND p.i <= e.i + least({S.window_size - S.kmer_size + 1}, last + 1)
    GROUP BY e.key, place
  ) f WHERE drop_at IS NOT NULL OR more
)
SELECT key AS item_id, place, CAST(CAST(v AS HUGEINT) - 18446744073709551616 AS BIGINT) AS h FROM e""",
    "optimize_layout": f"""WITH RECURSIVE {_STATS.removeprefix('WITH ')},
cat(bin, category) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(BINARY))}),
line AS (SELECT bin, category, n_hashes, row_number() OVER (ORDER BY n_hashes, bin) AS place, max(n_hashes) OVER () / 2.0 AS half FROM st JOIN cat USING (bin)),
fold(place, bin, bucket, free, hb, hs, mb, ms) AS (
  SELECT CAST(0 AS BIGINT), -1, -1, 0, -1, CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT)
  UNION ALL
  SELECT next, g.b, CASE WHEN new THEN free ELSE last END, CASE WHEN new THEN free + 1 ELSE free END,
         CASE WHEN g.category = 'human' THEN CASE WHEN new THEN free ELSE last END ELSE hb END, CASE WHEN g.category = 'human' THEN CASE WHEN new THEN g.n_hashes ELSE held + g.n_hashes END ELSE hs END,
         CASE WHEN g.category = 'microbe' THEN CASE WHEN new THEN free ELSE last END ELSE mb END, CASE WHEN g.category = 'microbe' THEN CASE WHEN new THEN g.n_hashes ELSE held + g.n_hashes END ELSE ms END
  FROM (SELECT f.*, l.bin AS b, l.category, l.n_hashes, CASE WHEN l.category = 'human' THEN f.hb ELSE f.mb END AS last, CASE WHEN l.category = 'human' THEN f.hs ELSE f.ms END AS held,
               (CASE WHEN l.category = 'human' THEN f.hb ELSE f.mb END) < 0 OR (CASE WHEN l.category = 'human' THEN f.hs ELSE f.ms END) + l.n_hashes >= l.half AS new, l.place AS next
        FROM fold f JOIN line l ON l.place = f.place + 1) g
),
ly AS (SELECT bin, bucket FROM fold WHERE place > 0)
SELECT bucket AS bin, CAST(sum(n_records) AS BIGINT) AS n_records, (SELECT count(DISTINCT h) FROM idx JOIN ly l ON l.bin = idx.bin WHERE l.bucket = ly.bucket) AS n_hashes FROM ly JOIN st USING (bin) GROUP BY bucket""",
    "read_quality": """WITH q AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[^!-~]', '', 'g') AS q FROM documents),
l AS (SELECT doc_id, [ascii(c) - 33 for c in string_split(q, '') if c <> ''] AS a, [ascii(c) - 33 for c in string_split(left(q, 100), '') if c <> ''] AS b FROM q)
SELECT doc_id, round(CASE WHEN len(a) > 0 THEN list_sum(a) / len(a) ELSE 0 END, 6) AS single, round(CASE WHEN len(a) > 0 THEN (list_sum(a) + list_sum(b)) / (len(a) + len(b)) ELSE 0 END, 6) AS paired FROM l""",
    "normalised_bases": """WITH s AS (SELECT doc_id, regexp_replace(replace(upper(regexp_replace(COALESCE(text, ''), '[^A-Za-z]', '', 'g')), 'U', 'T'), '[^ACGT]', 'N', 'g') AS s FROM documents)
SELECT doc_id, CAST(length(s) AS BIGINT) AS length, md5(s) AS digest FROM s""",
    "paired_hashes": f"""WITH t AS (SELECT conv_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS src, {_bases("arg_min(text, turn)")} AS s FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant') GROUP BY conv_id, role), {_hashes('SELECT src, conv_id AS key, s FROM t')}
SELECT conv_id AS read_ord, CAST((SELECT count(*) FROM m WHERE m.key = conv_id) AS INTEGER) AS n, CAST(sum(len(s)) AS BIGINT) AS length FROM t GROUP BY conv_id""",
    "beta_score": f"{_scores(BINARY)}{_likely('beta')} SELECT read_ord, category_idx, round(probability, 6) AS probability FROM pr",
    "call_host": f"{_HOST} SELECT read_ord, length, confidence, call FROM called",
    "call_category": f"""{_scores(BY_LANGUAGE)}{_likely('beta')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_ord ORDER BY unique_count DESC, category_idx) AS place FROM pr),
two AS (SELECT a.read_ord, a.num_hashes, a.category_idx AS first, a.unique_count - b.unique_count AS lead, a.probability AS p1, b.probability AS p2, a.count - b.count AS more, a.prop - b.prop AS share
        FROM ranked a JOIN ranked b USING (read_ord) WHERE a.place = 1 AND b.place = 2)
SELECT read_ord, length, CAST(least(255, lead) AS INTEGER) AS confidence,
       CASE WHEN num_hashes > 0 AND {_good(CLASSIFY)} AND ((p2 = 0 AND p1 > 0) OR (least(255, lead) > {CLASSIFY.confidence} AND p1 > p2)) AND more >= 0 AND share >= 0 THEN ([{_NAMES}])[first + 1] END AS call
FROM rd JOIN two USING (read_ord)""",
    "result_rollup": f"{_HOST} SELECT category, (SELECT count(*) FROM called WHERE COALESCE(call, 'unclassified') = category) AS n FROM (VALUES ('human'), ('microbe'), ('unclassified')) v(category)",
    "assignment_rows": f"""{_HOST} SELECT CASE WHEN call IS NULL THEN 'U' ELSE 'C' END AS status, 'doc' || read_ord AS read_id, call, length, pr.num_hashes, mean_quality, confidence,
  (['human', 'microbe'])[category_idx + 1] AS category, count, round(prop, 6) AS prop, round(unique_prop, 6) AS unique_prop, round(probability, 6) AS probability
FROM called JOIN pr USING (read_ord)""",
    "extract_human": f"{_HOST} SELECT read_ord, 'doc' || read_ord AS id, CAST(length AS INTEGER) AS n FROM called WHERE call = 'human'",
    "read_features": f"SELECT doc_id AS read_ord, 'doc' || doc_id AS id, CAST(len({_bases('text')}) AS BIGINT) AS length, CAST(10 + n_chars % 20 AS DOUBLE) AS mean_quality FROM documents WHERE text IS NOT NULL AND len({_bases('text')}) > 0",
    "pair_join": f"""WITH t AS (SELECT conv_id, role, arg_min(text, turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
SELECT a.conv_id AS read_ord, a.conv_id || '/1' AS id, CAST(len({_bases('a.t')}) AS INTEGER) AS n1, CAST(len({_bases('b.t')}) AS INTEGER) AS n2
FROM t a JOIN t b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant'""",
}
