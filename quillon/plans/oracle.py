"""SQL equivalents of the catalogue, written independently of the Spark plans.

Patterns keep RE2's plain word boundary, which is ASCII as ECMAScript's is.
"""

from __future__ import annotations

from ..functions import lexicon
from ..functions.scalars import DEMO_NAMES  # noqa: F401  (fixed values are shared, logic is not)
from .fixtures import AS_OF, PHRASES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(phrases: tuple, text: str) -> str:
    found = ", ".join(f"regexp_extract({text}, {_q(p.sql)}, 0)" for p in phrases)
    return f"list_filter([{found}], lambda x: x <> '')"


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


TS = f"TIMESTAMP '{AS_OF}'"
SAID = f"[{', '.join(map(_q, PHRASES))}]"
PHRASE = lambda key: f"{SAID}[(({key}) % {len(PHRASES)}) + 1]"
TEXTS = f"texts AS (SELECT doc_id, source, {PHRASE('doc_id')} || ' ' || coalesce(text, '') AS text FROM documents)"

VERDICTS = f"""
hits AS MATERIALIZED (SELECT k, text, {_hits(lexicon.OPEN, "text")} AS o, {_hits(lexicon.CLOSED, "text")} AS c FROM said),
chosen AS (SELECT *, CASE WHEN len(c) > len(o) THEN c ELSE o END AS t FROM hits),
verdicts AS MATERIALIZED (SELECT k, text,
  CASE WHEN len(o) = 0 AND len(c) = 0 THEN 'unclear' WHEN len(c) > len(o) THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN len(o) = 0 AND len(c) = 0 THEN 0.3::DOUBLE WHEN len(o) > 0 AND len(c) > 0 THEN 0.6::DOUBLE
       ELSE least(0.8::DOUBLE + greatest(len(o), len(c)) * 0.05::DOUBLE, 0.95::DOUBLE) END AS confidence,
  {_distinct("t")} AS triggers FROM chosen)"""

AGE = lambda t: f"((epoch_ms({TS}) - epoch_ms({t})) / 86400000.0::DOUBLE)"
TW = lambda t: f"(CASE WHEN {AGE(t)} < 7 THEN 1.0 WHEN {AGE(t)} < 30 THEN 0.8 WHEN {AGE(t)} < 90 THEN 0.5 ELSE 0.3 END)::DOUBLE"
SCORE = "CASE status WHEN 'open' THEN confidence WHEN 'closed' THEN -confidence ELSE 0.0 END"
LIKELY = lambda s, c: f"(CASE {s} WHEN 'open' THEN {c} WHEN 'closed' THEN 1.0::DOUBLE - {c} ELSE 0.4::DOUBLE + {c} * 0.2::DOUBLE END)"


def _first(phrases: tuple, text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_q(p.sql)}, 0), '')" for p in phrases) + ")"


def bullet(text: str, weight: str, name: bool) -> tuple[str, str, str]:
    """SQL of status, confidence and trigger of a decisive phrase."""
    o, c = _first(lexicon.NAME_OPEN if name else lexicon.TEXT_OPEN, text), _first(lexicon.NAME_CLOSED if name else lexicon.TEXT_CLOSED, text)
    base, ok = ("0.95::DOUBLE", "true") if name else ("0.9::DOUBLE", f"{weight} >= 0.5")
    on = f"({ok}) AND coalesce({c}, {o}) IS NOT NULL"
    return f"CASE WHEN {on} THEN CASE WHEN {c} IS NOT NULL THEN 'closed' ELSE 'open' END END", f"CASE WHEN {on} THEN {base} * {weight} END", f"CASE WHEN {on} THEN coalesce({c}, {o}) END"


def words(text: str, status: str) -> str:
    pick = f"CASE WHEN {status} = 'open' THEN {_hits(lexicon.TRIGGER_OPEN, text)} ELSE {_hits(lexicon.TRIGGER_CLOSED, text)} END"
    return _distinct(f"({pick})")


COMPONENTS = f"""
latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey),
components AS MATERIALIZED (
  SELECT c_custkey AS profile_id, 'display_name' AS kind, 0::BIGINT AS pos, CASE WHEN c_custkey % 3 = 0 THEN {PHRASE("c_custkey")} ELSE c_name END AS text, NULL::TIMESTAMP AS event_time, false AS is_pinned, false AS date_present FROM customer
  UNION ALL SELECT c_custkey, 'bio', 0, CASE WHEN c_custkey % 4 <> 3 THEN {PHRASE("c_custkey * 7 + 18")} ELSE '' END, NULL, false, false FROM customer
  UNION ALL SELECT c_custkey, 'commission_status', 0, CASE c_custkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE '' END, NULL, false, false FROM customer
  UNION ALL SELECT o_custkey, 'journal', k, {PHRASE("k")}, {TS} - to_days((k % 120)::INT), false, true FROM latest
  UNION ALL SELECT o_custkey, 'gallery', l_orderkey * 8 + l_linenumber, {PHRASE("l_orderkey * 8 + l_linenumber")},
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 11 <> 0 THEN {TS} - to_days(((l_orderkey * 8 + l_linenumber) % 100)::INT) END, false, (l_orderkey * 8 + l_linenumber) % 22 <> 0
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT user_id, 'post', event_id, {PHRASE("event_id")}, ts, event_id % 7 = 0, true FROM events)"""

_name = bullet("text", "1.0::DOUBLE", True)
_text = bullet("text", "w", False)
ITEMS = f"""
said AS (SELECT DISTINCT text AS k, text FROM components WHERE text <> ''), {VERDICTS},
weighed AS (SELECT c.*, v.status AS ms, v.confidence AS mc, v.triggers, {TW("event_time")} AS tw,
  (CASE WHEN kind IN ('gallery', 'post') AND NOT date_present THEN 1.0 WHEN kind = 'bio' THEN 1.0 ELSE {TW("event_time")} END)::DOUBLE AS w
  FROM components c JOIN verdicts v ON v.k = c.text),
-- decisive phrases once for each text and weight
kinds AS (SELECT DISTINCT text, w FROM weighed),
bullets AS MATERIALIZED (SELECT text, w, {_name[0]} AS ns, {_name[1]} AS nc, {_name[2]} AS nt, {_text[0]} AS ts, {_text[1]} AS tc, {_text[2]} AS tt FROM kinds),
told AS (SELECT x.*, CASE kind WHEN 'display_name' THEN ns WHEN 'commission_status' THEN NULL ELSE ts END AS bs,
  CASE kind WHEN 'display_name' THEN nc WHEN 'commission_status' THEN NULL ELSE tc END AS bc, CASE kind WHEN 'display_name' THEN nt WHEN 'commission_status' THEN NULL ELSE tt END AS trigger
  FROM weighed x JOIN bullets b ON b.text = x.text AND b.w = x.w),
items AS MATERIALIZED (SELECT *, coalesce(bs, ms) AS status, coalesce(bc, mc) AS confidence, bs IS NOT NULL AS is_bullet,
  CASE coalesce(bs, ms) WHEN 'open' THEN coalesce(bc, mc) WHEN 'closed' THEN -coalesce(bc, mc) ELSE 0.0::DOUBLE END AS s FROM told)"""

GALLERY = """sum(s * tw) / count(*) AS gallery_s, (CASE WHEN max(tw) > 0.5 THEN 0.15 ELSE 0.1 END)::DOUBLE AS gallery_w, max(confidence) AS gallery_c"""
EW = "(tw * CASE WHEN is_pinned AND status <> 'unclear' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END)"
POSTS = f"""sum(s * {EW}) / sum({EW}) AS post_s,
 (CASE WHEN max(tw) > 0.5 THEN 0.15 ELSE 0.1 END)::DOUBLE * CASE WHEN bool_or(is_pinned AND status <> 'unclear') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS post_w, max(confidence) AS post_c"""
GROUP_STATUS = lambda s: f"CASE WHEN {s} > 0.2 THEN 'open' WHEN {s} < -0.2 THEN 'closed' ELSE 'unclear' END"


def _single(kind: str, with_bullet: float, without: float) -> str:
    w = f"(CASE WHEN is_bullet THEN {with_bullet} ELSE {without} END)::DOUBLE" + (" * tw" if kind == "journal" else "")
    return f"{kind}_ AS (SELECT profile_id, s, {w} AS w, confidence, status, is_bullet, trigger, text FROM items WHERE kind = '{kind}')"


ENSEMBLE = f"""WITH {COMPONENTS}, {ITEMS},
{_single("display_name", 0.4, 0.3)}, {_single("bio", 0.5, 0.4)}, {_single("commission_status", 0.2, 0.2)}, {_single("journal", 0.3, 0.2)},
g AS (SELECT profile_id, {GALLERY} FROM items WHERE kind = 'gallery' GROUP BY profile_id),
p AS (SELECT profile_id, {POSTS} FROM items WHERE kind = 'post' GROUP BY profile_id),
ids AS (SELECT DISTINCT profile_id FROM items),
joined AS (SELECT ids.profile_id, d.s AS ds, d.w AS dw, b.s AS bs, b.w AS bw, k.s AS ks, k.w AS kw, j.s AS js, j.w AS jw, g.*, p.*, d.confidence AS dc, b.confidence AS bc, k.confidence AS kc, j.confidence AS jc,
  d.text AS dt, b.text AS bt,
  CASE WHEN b.is_bullet THEN {{'status': b.status, 'confidence': b.confidence, 'trigger': b.trigger}} WHEN d.is_bullet THEN {{'status': d.status, 'confidence': d.confidence, 'trigger': d.trigger}}
       WHEN j.is_bullet THEN {{'status': j.status, 'confidence': j.confidence, 'trigger': j.trigger}} END AS bullet
  FROM ids LEFT JOIN display_name_ d USING (profile_id) LEFT JOIN bio_ b USING (profile_id) LEFT JOIN commission_status_ k USING (profile_id) LEFT JOIN journal_ j USING (profile_id)
  LEFT JOIN g USING (profile_id) LEFT JOIN p USING (profile_id)),
summed AS (SELECT *, coalesce(dw, 0) + coalesce(bw, 0) + coalesce(kw, 0) + coalesce(jw, 0) + coalesce(gallery_w, 0) + coalesce(post_w, 0) AS total,
  coalesce(ds * dw, 0) + coalesce(bs * bw, 0) + coalesce(ks * kw, 0) + coalesce(js * jw, 0) + coalesce(gallery_s * gallery_w, 0) + coalesce(post_s * post_w, 0) AS signed,
  coalesce(greatest(dc, bc, kc, jc, gallery_c, post_c), 0) AS highest FROM joined),
scored AS (SELECT *, CASE WHEN total > 0 THEN signed / total ELSE 0 END AS score FROM summed),
decided AS (SELECT *, greatest(0, least(1, abs(score) * 0.7::DOUBLE + highest * 0.3::DOUBLE)) AS mixed,
  CASE WHEN bullet IS NOT NULL THEN bullet.status WHEN score > 0.15 THEN 'open' WHEN score < -0.2 THEN 'closed' ELSE 'unclear' END AS status, coalesce(dt, '') || ' ' || coalesce(bt, '') AS said FROM scored)
SELECT profile_id, status, round(CASE WHEN bullet IS NOT NULL THEN bullet.confidence WHEN status = 'unclear' THEN least(mixed, 0.7::DOUBLE) ELSE mixed END, 9) AS confidence, round(score, 9) AS score, bullet IS NOT NULL AS has_bullet,
  array_to_string(CASE WHEN bullet IS NOT NULL THEN [bullet.trigger] ELSE {words("said", "status")} END, '|') AS triggers FROM decided"""

FOLD = f"""WITH {COMPONENTS}, said AS (SELECT DISTINCT text AS k, text FROM components WHERE text <> ''), {VERDICTS},
v AS (SELECT c.*, status, confidence, triggers FROM components c JOIN verdicts ON k = c.text),
ids AS (SELECT DISTINCT profile_id FROM v),
best AS (SELECT profile_id, kind, arg_max({{'s': status, 'c': confidence, 't': triggers}}, (confidence, -pos)) AS b FROM v
  WHERE kind IN ('display_name', 'bio', 'commission_status', 'gallery') OR (kind = 'journal' AND epoch_ms({TS}) - epoch_ms(event_time) < 2592000000) OR (kind = 'post' AND is_pinned) GROUP BY profile_id, kind),
wide AS (SELECT profile_id, max(b) FILTER (kind = 'display_name') AS n, max(b) FILTER (kind = 'bio') AS b, max(b) FILTER (kind = 'commission_status') AS k,
  max(b) FILTER (kind = 'journal') AS j, max(b) FILTER (kind = 'gallery') AS g, max(b) FILTER (kind = 'post') AS p FROM best GROUP BY profile_id),
s0 AS (SELECT *, CASE WHEN n.c > 0.7 THEN n.s ELSE 'unclear' END AS s, CASE WHEN n.c > 0.7 THEN n.c ELSE 0.0 END AS h FROM ids LEFT JOIN wide USING (profile_id)),
s1 AS (SELECT * REPLACE (CASE WHEN b.c > h THEN b.s ELSE s END AS s, CASE WHEN b.c > h THEN b.c ELSE h END AS h) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN k.c > h THEN k.s ELSE s END AS s, CASE WHEN k.c > h THEN k.c ELSE h END AS h) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN j.c > h THEN j.s ELSE s END AS s, CASE WHEN j.c > h THEN j.c ELSE h END AS h) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN g.c > h * 0.8::DOUBLE THEN g.s ELSE s END AS s) FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN p.c > 0.7 THEN p.s ELSE s END AS s, CASE WHEN p.c > 0.7 THEN p.c ELSE h END AS h) FROM s4),
t AS (SELECT *, list_concat(CASE WHEN n.c > 0.7 THEN n.t ELSE [] END, coalesce(b.t, []), coalesce(k.t, []), coalesce(j.t, [])) AS all_t FROM s5)
SELECT profile_id, s AS status, h AS confidence, array_to_string({_distinct("all_t")}[:5], '|') AS triggers FROM t"""

PLATFORM_A = f"""a AS (SELECT c_custkey AS id, 'furaffinity' AS platform, 'Maker' || lpad(c_custkey::VARCHAR, 6, '0') AS username,
  CASE WHEN c_custkey % 5 = 0 THEN 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') ELSE c_name END AS display_name,
  CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'unclear' END AS status, (c_custkey * 37 % 101) / 100.0::DOUBLE AS confidence, {TS} - to_days((c_custkey % 50)::INT) AS last_updated, c_custkey AS seq FROM customer)"""
PLATFORM_B = f"""b AS (SELECT s_suppkey AS id, 'bluesky' AS platform, 'maker' || lpad(s_suppkey::VARCHAR, 6, '0') || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.bsky.social' ELSE '_art' END AS username, s_name AS display_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status, (s_suppkey * 53 % 101) / 100.0::DOUBLE AS confidence, {TS} - to_days((s_suppkey % 40)::INT) AS last_updated, s_suppkey AS seq FROM supplier)"""


def _similar(x: str, y: str) -> str:
    n = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    a, b = n(x), n(y)
    return f"""({a} <> '' AND {b} <> '' AND ({a} = {b} OR ((contains({a}, {b}) OR contains({b}, {a}))
      AND least(length({a}), length({b})) / greatest(length({a}), length({b}))::DOUBLE >= CASE WHEN least(length({a}), length({b})) < 6 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END)))"""


PAIRS = f"""pairs AS MATERIALIZED (SELECT a.id AS a_id, b.id AS b_id, a.seq AS a_seq, b.seq AS b_seq FROM a, b WHERE {_similar("a.username", "b.username")} OR {_similar("a.display_name", "b.display_name")})"""
BEST = """mutual AS (SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY b_seq, b_id) AS x, row_number() OVER (PARTITION BY b_id ORDER BY a_seq, a_id) AS y FROM pairs) WHERE x = 1 AND y = 1)"""
RANK = lambda s: f"(CASE {s} WHEN 'open' THEN 3 WHEN 'unclear' THEN 2 WHEN 'closed' THEN 1 ELSE 0 END)"
MERGED = f"""WITH {PLATFORM_A}, {PLATFORM_B}, {PAIRS}, {BEST},
j AS (SELECT a.*, b.id AS bid, b.platform AS bp, b.username AS bu, b.display_name AS bd, b.status AS bs, b.confidence AS bc, b.last_updated AS bl
  FROM a LEFT JOIN mutual ON a.id = a_id FULL JOIN b ON b.id = b_id),
w AS (SELECT *, coalesce(({RANK("bs")}, bc, bl, 0) > ({RANK("status")}, confidence, last_updated, 1) AND bid IS NOT NULL AND id IS NOT NULL, false) OR id IS NULL AS new FROM j)
SELECT CASE WHEN new THEN bu ELSE username END AS username, CASE WHEN new THEN bd ELSE display_name END AS display_name, CASE WHEN new THEN bs ELSE status END AS status,
  CASE WHEN new THEN bc ELSE confidence END AS confidence, CASE WHEN new THEN bl ELSE last_updated END AS last_updated,
  array_to_string(list_filter(CASE WHEN new THEN [bp, platform] ELSE [platform, bp] END, lambda x: x IS NOT NULL), '|') AS platforms FROM w"""

RESULTS = f"""{PLATFORM_A}, results AS MATERIALIZED (SELECT *, id % 7 = 0 AS merged, CASE WHEN id % 7 = 0 THEN ['furaffinity', 'bluesky'] ELSE ['furaffinity'] END AS platforms,
  CASE WHEN id % 7 = 0 THEN ({LIKELY("status", "confidence")} + {LIKELY("(CASE WHEN id % 2 = 0 THEN 'open' ELSE 'closed' END)", "((id * 11 % 101) / 100.0::DOUBLE)")}) / 2 ELSE {LIKELY("status", "confidence")} END AS likelihood,
  [{PHRASE("id")}, 'queue'] AS triggers, CASE WHEN id % 13 = 0 THEN 'ftp://x' ELSE 'https://www.example.com/user/' || lower(username) END AS profile_url FROM a)"""

_seconds = f"floor((epoch_ms({TS}) - epoch_ms(t)) / 1000.0::DOUBLE)::BIGINT"
RELATIVE = f"""CASE WHEN t IS NULL THEN 'never' WHEN {_seconds} < 60 THEN 'just now' WHEN {_seconds} // 60 < 60 THEN ({_seconds} // 60)::VARCHAR || 'm ago' WHEN {_seconds} // 3600 < 24 THEN ({_seconds} // 3600)::VARCHAR || 'h ago'
 WHEN {_seconds} // 86400 < 7 THEN ({_seconds} // 86400)::VARCHAR || 'd ago' WHEN {_seconds} // 604800 < 4 THEN ({_seconds} // 604800)::VARCHAR || 'w ago'
 WHEN {_seconds} // 2592000 < 12 THEN ({_seconds} // 2592000)::VARCHAR || 'mo ago' ELSE ({_seconds} // 31536000)::VARCHAR || 'y ago' END"""
SHORT = f"""CASE WHEN {_seconds} // 60 < 1 THEN 'just now' WHEN {_seconds} // 60 < 60 THEN ({_seconds} // 60)::VARCHAR || 'm ago' WHEN {_seconds} // 3600 < 24 THEN ({_seconds} // 3600)::VARCHAR || 'h ago' ELSE ({_seconds} // 86400)::VARCHAR || 'd ago' END"""

#: Arrivals of both platforms and a second look at every fourth customer, one step after the other.
ARRIVALS = """WITH first AS (
  SELECT c_custkey AS k, 'Maker' || lpad(c_custkey::VARCHAR, 6, '0') AS username, 'furaffinity' AS platform,
    CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'unclear' END AS status, ((c_custkey * 37) % 101) / 100.0::DOUBLE AS confidence, -(c_custkey % 50) AS age
  FROM customer),
second AS (
  SELECT s_suppkey AS k, 'maker' || lpad(s_suppkey::VARCHAR, 6, '0') || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.bsky.social' ELSE '_art' END AS username, 'bluesky' AS platform,
    CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status, ((s_suppkey * 53) % 101) / 100.0::DOUBLE AS confidence, -(s_suppkey % 40) AS age
  FROM supplier),
third AS (
  SELECT k, username, platform, CASE WHEN k % 3 = 1 THEN 'open' ELSE 'unclear' END AS status, ((k * 29) % 101) / 100.0::DOUBLE AS confidence FROM first WHERE k % 4 = 0),
ranks AS (SELECT 'open' AS status, 3 AS r UNION ALL SELECT 'unclear', 2 UNION ALL SELECT 'closed', 1),
met AS (
  SELECT f AS f, s AS s, s.k IS NOT NULL AND (rs.r, s.confidence, s.age) > (rf.r, f.confidence, f.age) AS new_wins
  FROM first f LEFT JOIN second s ON s.k = f.k AND (f.k % 3 <> 1 OR f.k % 5 = 0)
  JOIN ranks rf ON rf.status = f.status LEFT JOIN ranks rs ON rs.status = s.status),
merged AS (
  SELECT f.k AS id, CASE WHEN new_wins THEN s ELSE f END AS base, s.k IS NOT NULL AS two,
    CASE WHEN s.k IS NULL THEN 'furaffinity' WHEN new_wins THEN 'bluesky|furaffinity' ELSE 'furaffinity|bluesky' END AS platforms, f.status AS on_first, s.status AS on_second
  FROM met),
looked AS (
  SELECT merged.*, t AS t, t.k IS NOT NULL AND base.platform = 'furaffinity' AND t.confidence > base.confidence AS updated, t.k IS NOT NULL AND base.platform = 'bluesky' AS apart
  FROM merged LEFT JOIN third t ON t.k = merged.id)
SELECT id, base.username AS username, CASE WHEN updated THEN t.platform ELSE base.platform END AS platform, CASE WHEN updated THEN t.status ELSE base.status END AS status,
  CASE WHEN updated THEN t.confidence ELSE base.confidence END AS confidence, platforms,
  CASE WHEN two THEN 'bluesky=' || on_second || '|furaffinity=' || CASE WHEN updated THEN t.status ELSE on_first END WHEN updated THEN 'furaffinity=' || t.status ELSE '' END AS platform_data
FROM looked
UNION ALL SELECT 2000000 + id, t.username, t.platform, t.status, t.confidence, 'furaffinity', '' FROM looked WHERE apart
UNION ALL SELECT 1000000 + k, username, platform, status, confidence, 'bluesky', '' FROM second WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.s.k = second.k)"""
