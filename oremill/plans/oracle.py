"""SQL for the queries of the core operators."""

from __future__ import annotations

SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _id(column: str) -> str:
    trimmed = f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"CASE WHEN regexp_full_match({trimmed}, '[A-Za-z0-9_-]{{22}}') THEN {trimmed} END"


RV = f"""rv AS (SELECT review_id, any_value(u) AS user_id, any_value(b) AS business_id, any_value(stars) AS stars, any_value(date) AS date, any_value(text) AS text
 FROM (SELECT *, {_id("user_id")} AS u, {_id("business_id")} AS b FROM review) WHERE review_id IS NOT NULL GROUP BY 1)"""
RT = f"""rt AS (SELECT u AS user_id, b AS business_id, max(stars) AS stars FROM (SELECT *, {_id("user_id")} AS u, {_id("business_id")} AS b FROM review)
 WHERE u IS NOT NULL AND b IS NOT NULL AND stars BETWEEN 1 AND 5 AND NOT isnan(stars) GROUP BY 1, 2)"""
BZ = f"""bz AS (SELECT b AS business_id, max(categories) AS categories, max(upper(trim(state))) AS state
 FROM (SELECT *, {_id("business_id")} AS b FROM business) WHERE b IS NOT NULL GROUP BY 1)"""
SX = f"""sx AS (SELECT u AS user_id, b AS business_id FROM (SELECT {_id("user_id")} AS u, {_id("business_id")} AS b FROM sample_data) WHERE u IS NOT NULL AND b IS NOT NULL)"""
SW = "sw AS (SELECT DISTINCT lower(trim(value)) AS word FROM stopwords WHERE value IS NOT NULL)"
EB = "eb AS (SELECT DISTINCT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS basket, event_type AS item FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL)"
SUPPORT = "sup AS (SELECT greatest(1, CAST(ceil(count(DISTINCT basket) / 20.0) AS BIGINT)) AS s FROM eb)"

WORDS = f"""tok AS (SELECT unnest(string_split(lower(text), ' ')) AS t FROM rv WHERE text IS NOT NULL),
wd AS (SELECT translate(t, '([,.!?:;])', '') AS word FROM tok WHERE t <> '')"""

CONTENT = f"""tx AS (SELECT DISTINCT business_id, user_id, text FROM rv WHERE business_id IS NOT NULL AND text IS NOT NULL),
tk AS (SELECT business_id, unnest(regexp_split_to_array(lower(text), '[{SPACE}]+')) AS t FROM tx),
dw AS (SELECT business_id, word, count(*) AS n FROM (SELECT business_id, translate(t, '([,.!?:;])01"23456789-\\&', '') AS word FROM tk WHERE t <> '')
 WHERE word <> '' AND word NOT IN (SELECT word FROM sw) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS businesses FROM dw GROUP BY 1), tp AS (SELECT business_id, max(n) AS top FROM dw GROUP BY 1),
nn AS (SELECT count(DISTINCT business_id) AS total FROM rv),
sc AS (SELECT business_id, word, round(CAST(n AS DOUBLE) / top * log2(CAST(total AS DOUBLE) / businesses), 6) AS score FROM dw JOIN df USING (word) JOIN tp USING (business_id), nn),
rk AS (SELECT business_id, word, score, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, word) AS rank FROM sc)"""
USERS = """vis AS (SELECT DISTINCT user_id, business_id FROM rv WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
uc AS (SELECT user_id, word, count(*) AS n FROM vis JOIN (SELECT * FROM rk WHERE rank <= 200) USING (business_id) GROUP BY 1, 2),
up AS (SELECT user_id, word, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, word) AS rank FROM uc)"""


def _sets(size: int, scope: str = "") -> str:
    """Itemsets of one size with their support, items in order."""
    names = [f"e{i}" for i in range(size)]
    joins = " ".join(f"JOIN eb {n} ON {n}.basket = e0.basket AND {n}.item > {p}.item" for p, n in zip(names, names[1:], strict=False))
    items = " || ',' || ".join(f"{n}.item" for n in names)
    return f"SELECT {scope}{items} AS itemset, CAST({size} AS BIGINT) AS size, count(*) AS support FROM eb e0 {joins} GROUP BY ALL"


FREQUENT = "fr AS (SELECT itemset, size, support FROM (" + " UNION ALL ".join(_sets(k) for k in range(1, 6)) + "), sup WHERE support >= s)"
CANDIDATES = (
    "pn AS (SELECT basket % 4 AS pid, count(DISTINCT basket) AS n FROM eb GROUP BY 1), tot AS (SELECT sum(n) AS total FROM pn), ca AS (SELECT DISTINCT itemset, size FROM ("
    + " UNION ALL ".join(_sets(k, "e0.basket % 4 AS pid, ") for k in range(1, 6))
    + ") JOIN pn USING (pid), sup, tot WHERE support >= ceil(CAST(s * n AS DOUBLE) / total))"
)


def _frequent(condition: str = "true") -> str:
    return f"WITH {EB}, {SUPPORT}, {FREQUENT} SELECT * FROM fr WHERE {condition}"


# Level by level: a set grows by a frequent business behind its last one, and is kept in its baskets if 10 of them hold it.
LEVELS = """dp AS (SELECT DISTINCT user_id, business_id FROM source WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
one AS (SELECT user_id, business_id FROM dp QUALIFY count(*) OVER (PARTITION BY business_id) >= 10),
held(user_id, itemset, tail, size) AS (SELECT user_id, business_id, business_id, CAST(1 AS BIGINT) FROM one UNION ALL
 (SELECT h.user_id, h.itemset || ',' || o.business_id, o.business_id, h.size + 1 FROM held h JOIN one o ON o.user_id = h.user_id AND o.business_id > h.tail
 QUALIFY count(*) OVER (PARTITION BY h.itemset, o.business_id) >= 10))
SELECT itemset, size, count(*) AS support FROM held GROUP BY 1, 2"""

INDEX = "ix AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS j FROM (SELECT DISTINCT user_id FROM rt)), mm AS (SELECT count(*) AS m FROM ix)"
MINHASH = f"""WITH {RT}, {INDEX}, h AS (SELECT user_id, band, (((band * ((5 * j + 2) % m) + band * (((3 * j + 3) % 26189) % m) + band * band) % 26189) % m) AS v
 FROM ix, mm, range(1, 50) AS r(band)), sg AS (SELECT business_id AS id, band, min(v) AS hash FROM rt JOIN h USING (user_id) GROUP BY 1, 2)"""


#: Band, a1, b1, a2 and b2 of the seeded family with seed 0 (fixed values).
SEEDED = """
    (1, 15683, 34019, 79357, 76481), (2, 15791, 36241, 78277, 16229), (3, 15901, 24061, 76481, 40387), (4, 16007, 38737, 75367, 35251),
    (5, 16103, 27739, 74441, 37123), (6, 16229, 31963, 74507, 51473), (7, 16361, 22699, 74159, 39887), (8, 16453, 17401, 67523, 27277),
    (9, 16573, 17401, 67211, 75367), (10, 16691, 16979, 66463, 56437), (11, 16787, 23789, 65881, 46049), (12, 16889, 66463, 64921, 53681),
    (13, 16979, 17483, 64301, 27961), (14, 17041, 16979, 62137, 74159), (15, 17137, 16691, 61643, 64301), (16, 17231, 28661, 60107, 37171),
    (17, 17333, 48847, 60089, 16979), (18, 17401, 31963, 59119, 36901), (19, 17483, 28307, 58757, 54983), (20, 17581, 58757, 56827, 22549),
    (21, 17707, 46957, 56437, 37123), (22, 17827, 71023, 54983, 41413), (23, 17923, 24061, 53681, 16453), (24, 18041, 46957, 51899, 15791),
    (25, 18127, 16889, 51341, 67523), (26, 18223, 35251, 51473, 66463), (27, 22549, 61643, 51839, 56827), (28, 22699, 15683, 51197, 54983),
    (29, 23189, 39461, 48847, 28661), (30, 23297, 23549, 46957, 74159), (31, 23431, 28843, 46399, 66463), (32, 23549, 16573, 46049, 18127),
    (33, 23789, 51197, 43973, 23189), (34, 24061, 23431, 41413, 17483), (35, 24371, 46399, 40387, 71809), (36, 24181, 16889, 39887, 16787),
    (37, 27277, 28307, 39461, 40387), (38, 27551, 38737, 38737, 17041), (39, 27739, 27739, 37123, 46957), (40, 27961, 27551, 37171, 66463)
"""


def _seeded(source: str = "rt") -> str:
    """Signatures of the users of a table of ratings."""
    return f"""ix AS (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS j FROM (SELECT DISTINCT business_id FROM {source})), mm AS (SELECT count(*) AS m FROM ix),
co(band, a1, b1, a2, b2) AS (VALUES {SEEDED}),
h AS (SELECT business_id, band, ((band * ((a1 * j + b1) % m) + band * ((a2 * j + b2) % m) + band * band) % 10259) % m AS v FROM ix, mm, co),
sg AS (SELECT user_id AS id, band, min(v) AS hash FROM {source} JOIN h USING (business_id) GROUP BY 1, 2)"""


#: Ratings of users with at least three businesses.
RT3 = "rt3 AS (SELECT user_id, business_id FROM rt QUALIFY count(*) OVER (PARTITION BY user_id) >= 3)"


JACCARD = f"""WITH {RT}, n AS (SELECT business_id AS b, count(*) AS n FROM rt GROUP BY 1),
c AS (SELECT x.business_id AS b1, y.business_id AS b2, count(*) AS c FROM rt x JOIN rt y ON x.user_id = y.user_id AND x.business_id < y.business_id GROUP BY 1, 2)
SELECT b1, b2, round(CAST(c AS DOUBLE) / (p.n + q.n - c), 6) AS sim FROM c JOIN n p ON p.b = b1 JOIN n q ON q.b = b2 WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= 0.05"""


def _model(left: str, right: str, member: str, group: str) -> str:
    return f"""kk AS (SELECT {member} AS id, count(*) AS k FROM rt GROUP BY 1 HAVING count(*) >= 3), kr AS (SELECT rt.*, k FROM rt JOIN kk ON kk.id = rt.{member}),
pr AS (SELECT x.{member} AS {left}, y.{member} AS {right}, count(*) AS n, any_value(x.k) AS k1, any_value(y.k) AS k2, sum(x.stars) AS sx, sum(y.stars) AS sy,
 sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy, sum(x.stars * y.stars) AS sxy
 FROM kr x JOIN kr y ON x.{group} = y.{group} AND x.{member} < y.{member} GROUP BY 1, 2 HAVING count(*) >= 3),
mo AS (SELECT {left}, {right}, n, k1, k2, sxy - sx * sy / n AS top, round((sxy - sx * sy / n) / (sqrt(sxx) * sqrt(syy)), 6) AS sim FROM pr)"""


ITEMS = f"WITH {RT}, {_model('b1', 'b2', 'business_id', 'user_id')}"
PEOPLE = f"WITH {RT}, {_model('u1', 'u2', 'user_id', 'business_id')}, um AS (SELECT u1, u2, sim FROM mo WHERE top > 1e-9 AND sim > 0 AND CAST(n AS DOUBLE) / (k1 + k2 - n) >= 0.01)"
IM = f"""im AS (SELECT least(x, y) AS b1, greatest(x, y) AS b2, max(sim) AS sim FROM (SELECT {_id("b1")} AS x, {_id("b2")} AS y, sim FROM item_model)
 WHERE x IS NOT NULL AND y IS NOT NULL AND x <> y AND sim IS NOT NULL AND NOT isnan(sim) GROUP BY 1, 2)"""
BY_ITEM = f"""WITH {RT}, {IM}, nb AS (SELECT b1 AS id, b2 AS other, sim FROM im WHERE sim > 0 UNION ALL SELECT b2, b1, sim FROM im WHERE sim > 0),
mt AS (SELECT w.user_id, w.business_id, r.stars, nb.sim, row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY nb.sim DESC, nb.other) AS k
 FROM rt w JOIN rt r ON r.user_id = w.user_id JOIN nb ON nb.id = w.business_id AND nb.other = r.business_id)
SELECT user_id, business_id, round(sum(stars * sim) / sum(sim), 6) AS stars FROM mt WHERE k <= 3 GROUP BY 1, 2 HAVING sum(stars * sim) / sum(sim) >= 0"""
BY_USER = f"""{PEOPLE}, nb AS (SELECT u1 AS id, u2 AS other, sim FROM um UNION ALL SELECT u2, u1, sim FROM um),
mt AS (SELECT w.user_id, w.business_id, nb.other, r.stars, nb.sim, row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY nb.sim DESC, nb.other) AS k
 FROM rt w JOIN nb ON nb.id = w.user_id JOIN rt r ON r.user_id = nb.other AND r.business_id = w.business_id),
t AS (SELECT * FROM mt WHERE k <= 11), ln AS (SELECT DISTINCT user_id, other FROM t),
cm AS (SELECT ln.user_id, ln.other, avg(o.stars) AS mean_other FROM ln JOIN rt m ON m.user_id = ln.user_id JOIN rt o ON o.user_id = ln.other AND o.business_id = m.business_id GROUP BY 1, 2),
own AS (SELECT user_id, avg(stars) AS mean_own FROM rt GROUP BY 1),
sm AS (SELECT t.user_id, business_id, sum((stars - mean_other) * sim) / sum(sim) AS shift FROM t JOIN cm ON cm.user_id = t.user_id AND cm.other = t.other GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT sm.user_id, business_id, round(mean_own + shift, 6) AS stars FROM sm JOIN own USING (user_id) WHERE mean_own + shift >= 0"""

GRAPH = f"""{SX}, dp AS (SELECT DISTINCT user_id, business_id FROM sx), en AS (SELECT user_id FROM dp GROUP BY 1 HAVING count(*) >= 3), kp AS (SELECT * FROM dp JOIN en USING (user_id)),
ed AS (SELECT x.user_id AS src, y.user_id AS dst FROM kp x JOIN kp y ON x.business_id = y.business_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 3),
sy AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed)"""


def _labels(rounds: int = 5) -> str:
    text = f"WITH {GRAPH}, l0 AS (SELECT DISTINCT src AS id, src AS label FROM sy)"
    for i in range(1, rounds + 1):
        text += f""", v{i} AS (SELECT dst AS id, label, count(*) AS n FROM sy JOIN l{i - 1} ON l{i - 1}.id = src GROUP BY 1, 2),
l{i} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM v{i}) WHERE k = 1)"""
    return text + f" SELECT id, label FROM l{rounds}"


COMPONENTS = f"WITH RECURSIVE {GRAPH}, re(id, far) AS (SELECT DISTINCT src, src FROM sy UNION SELECT re.id, sy.dst FROM re JOIN sy ON sy.src = re.far), cc AS (SELECT id, min(far) AS community FROM re GROUP BY 1)"


def _betweenness(levels: int = 16) -> str:
    """Distances and numbers of shortest paths level by level; then each edge's share in the paths of all pairs."""
    text = f"WITH {GRAPH}, w0 AS (SELECT DISTINCT src AS s, src AS t, 0 AS d, 1.0::DOUBLE AS n FROM sy)"
    for i in range(1, levels + 1):
        seen = f"SELECT s, t FROM w{i - 1}" + (f" UNION ALL SELECT s, t FROM w{i - 2}" if i > 1 else "")
        text += f", w{i} AS (SELECT s, dst AS t, {i} AS d, sum(n) AS n FROM w{i - 1} JOIN sy ON sy.src = w{i - 1}.t WHERE (s, dst) NOT IN ({seen}) GROUP BY 1, 2)"
    every = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(levels + 1))
    return text + f""", sp AS MATERIALIZED ({every}), bt AS (SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, sum(a.n * b.n / c.n) / 2 AS value
 FROM sy e JOIN sp a ON a.t = e.src JOIN sp b ON b.s = e.dst JOIN sp c ON c.s = a.s AND c.t = b.t AND c.d = a.d + 1 + b.d GROUP BY 1, 2)"""


MODULARITY = f"""{COMPONENTS}, de AS (SELECT src AS id, count(*) AS k FROM sy GROUP BY 1), ks AS (SELECT community, sum(k) AS k FROM de JOIN cc USING (id) GROUP BY 1), e AS (SELECT count(*) AS e FROM ed)
SELECT round(0.5 * (1 - 0.5 * sum(CAST(k AS DOUBLE) * k) / (4.0 * any_value(e) * any_value(e))), 6) AS value FROM ks, e"""


def _baskets(key: str, item: str, more: str = "") -> str:
    return f"WITH {SX} SELECT {key} AS basket, count(DISTINCT {item}) AS size, string_agg(DISTINCT {item}, ',' ORDER BY {item}) AS items FROM sx GROUP BY 1{more}"


def _listed(rows: str, order: str) -> str:
    """A JSON list of the texts j of some rows."""
    return f"(SELECT '[' || coalesce(string_agg(j, ', ' ORDER BY {order}), '') || ']' FROM ({rows}))"


TOP_WORDS = f"{SW}, {WORDS}, tops AS (SELECT word, count(*) AS n FROM wd WHERE word NOT IN (SELECT word FROM sw) GROUP BY 1 ORDER BY n DESC, word LIMIT 20)"
TOP_USERS = "SELECT user_id, count(*) AS n FROM rv WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20"
EXPLORATION = f"""WITH {RV}, {TOP_WORDS}, us AS ({TOP_USERS})
SELECT '{{"A": ' || (SELECT count(*) FROM rv) || ', "B": ' || (SELECT count(*) FROM rv WHERE contains(date, '2014')) || ', "C": ' || (SELECT count(DISTINCT user_id) FROM rv) || ', "D": ' ||
 {_listed("SELECT '[' || to_json(user_id) || ', ' || n || ']' AS j, n, user_id FROM us", "n DESC, user_id")} || ', "E": ' || {_listed("SELECT to_json(word) AS j, n, word FROM tops", "n DESC, word")} || '}}' AS value"""
AVERAGES = f"""{BZ}, ct AS (SELECT business_id, trim(c) AS category FROM (SELECT business_id, unnest(string_split(categories, ',')) AS c FROM bz WHERE categories IS NOT NULL) WHERE trim(c) <> ''),
av AS (SELECT category, round(avg(stars), 6) AS avg_stars FROM rv JOIN ct USING (business_id) WHERE stars BETWEEN 1 AND 5 AND NOT isnan(stars) GROUP BY 1)"""
PARTITIONS = """cs AS (SELECT list_sum(list_transform(string_split(business_id, ''), lambda c: ascii(c))) % 8 AS partition FROM rv WHERE business_id IS NOT NULL),
ps AS (SELECT CAST(r.p AS INTEGER) AS partition, count(cs.partition) AS rows FROM range(8) AS r(p) LEFT JOIN cs ON cs.partition = r.p GROUP BY 1)"""
BUSY = "SELECT business_id, count(*) AS n FROM rv WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > 50"


def _report_lines(block: int, title: str, rows: str) -> str:
    """(block, size, part, line) of one block of the itemset report."""
    shown = "'(' || chr(39) || replace(itemset, ',', chr(39) || ', ' || chr(39)) || chr(39) || ')'"
    return f"""SELECT {block} AS block, 0 AS size, 0 AS part, '{title}' AS line UNION ALL SELECT {block}, size, 1, string_agg({shown}, ',' ORDER BY string_split(itemset, ',')) FROM {rows} GROUP BY size
 UNION ALL SELECT DISTINCT {block}, size, 0, '' FROM {rows} WHERE size > 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "review_total": f"WITH {RV} SELECT count(*) AS total FROM rv",
        "reviews_in_year": f"WITH {RV} SELECT count(*) AS total FROM rv WHERE contains(date, '2014')",
        "distinct_users": f"WITH {RV} SELECT count(DISTINCT user_id) AS total FROM rv",
        "top_users": f"WITH {RV} {TOP_USERS}",
        "top_words": f"WITH {RV}, {TOP_WORDS} SELECT * FROM tops",
        "top_words_not_empty": f"WITH {RV}, {SW}, {WORDS} SELECT word, count(*) AS n FROM wd WHERE word <> '' AND word NOT IN (SELECT word FROM sw) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
        "exploration_report": EXPLORATION,
        "category_avg_stars": f"WITH {RV}, {AVERAGES} SELECT * FROM av",
        "category_report": f"""WITH {RV}, {AVERAGES}, best AS (SELECT * FROM av ORDER BY avg_stars DESC, category LIMIT 20)
SELECT '{{"result": ' || {_listed("SELECT '[' || to_json(category) || ', ' || to_json(avg_stars) || ']' AS j, avg_stars, category FROM best", "avg_stars DESC, category")} || '}}' AS value""",
        "partition_sizes_custom": f"WITH {RV}, {PARTITIONS} SELECT * FROM ps",
        "partition_report": f"""WITH {RV}, {PARTITIONS}, busy AS ({BUSY})
SELECT '{{"n_partitions": ' || (SELECT count(*) FROM ps) || ', "n_items": ' || {_listed("SELECT CAST(rows AS VARCHAR) AS j, partition FROM ps", "partition")} || ', "result": ' ||
 {_listed("SELECT '[' || to_json(business_id) || ', ' || n || ']' AS j, business_id FROM busy", "business_id")} || '}}' AS value""",
        "businesses_over_n": f"WITH {RV} {BUSY}",
        "state_pairs": f"WITH {RV}, {BZ} SELECT user_id, business_id FROM rv WHERE user_id IS NOT NULL AND business_id IN (SELECT business_id FROM bz WHERE state = 'NV')",
        "baskets_by_user": _baskets("user_id", "business_id"),
        "baskets_by_item": _baskets("business_id", "user_id"),
        "baskets_min_size": _baskets("user_id", "business_id", " HAVING count(DISTINCT business_id) > 3"),
        "frequent_singles": _frequent("size = 1"),
        "frequent_pairs": _frequent("size = 2"),
        "frequent_triples": _frequent("size = 3"),
        "frequent_all": _frequent(),
        "frequent_businesses": f"WITH RECURSIVE {RV}, source AS (SELECT * FROM rv), {LEVELS}",
        "frequent_state_businesses": f"WITH RECURSIVE {SX}, source AS (SELECT * FROM sx), {LEVELS}",
        "son_candidates": f"WITH {EB}, {SUPPORT}, {CANDIDATES} SELECT * FROM ca",
        "itemset_report": f"""WITH {EB}, {SUPPORT}, {FREQUENT}, {CANDIDATES}, rows AS ({_report_lines(0, "Candidates:", "ca")} UNION ALL SELECT 1, -1, 0, '' UNION ALL {_report_lines(1, "Frequent Itemsets:", "fr")})
SELECT CAST(row_number() OVER (ORDER BY block, size, part) AS INTEGER) AS no, line FROM rows""",
        "minhash_signatures": f"{MINHASH} SELECT id, CAST(band AS INTEGER) AS band, hash FROM sg",
        "lsh_pairs": f"{MINHASH} SELECT DISTINCT x.id AS b1, y.id AS b2 FROM sg x JOIN sg y ON x.band = y.band AND x.hash = y.hash AND x.id < y.id",
        "jaccard_pairs": JACCARD,
        "user_signatures": f"WITH {RT}, {_seeded()} SELECT id, band, hash FROM sg",
        "word_document_frequency": f"WITH {RV}, {SW}, {CONTENT} SELECT word, businesses FROM df",
        "business_profile": f"WITH {RV}, {SW}, {CONTENT} SELECT * FROM rk WHERE rank <= 200",
        "tfidf_top": f"WITH {RV}, {SW}, {CONTENT} SELECT * FROM rk WHERE rank <= 10",
        "user_profile": f"WITH {RV}, {SW}, {CONTENT}, {USERS} SELECT * FROM up WHERE rank <= 200",
        "content_scores": f"""WITH {RV}, {SW}, {CONTENT}, {USERS}, bp AS (SELECT business_id, word FROM rk WHERE rank <= 200), us AS (SELECT user_id, word FROM up WHERE rank <= 200),
nu AS (SELECT user_id, count(*) AS nu FROM us GROUP BY 1), nb AS (SELECT business_id, count(*) AS nb FROM bp GROUP BY 1),
co AS (SELECT user_id, business_id, count(*) AS n FROM vis JOIN bp USING (business_id) JOIN us USING (user_id, word) GROUP BY 1, 2)
SELECT rv.user_id, rv.business_id, round(n / (sqrt(nu) * sqrt(nb)), 6) AS sim FROM rv JOIN co USING (user_id, business_id) JOIN nu USING (user_id) JOIN nb USING (business_id) WHERE n / (sqrt(nu) * sqrt(nb)) >= 0.01""",
        "item_similarity": f"{ITEMS} SELECT b1, b2, sim FROM mo WHERE top > 1e-9 AND sim > 0",
        "user_similarity": f"{PEOPLE} SELECT u1, u2, sim FROM um",
        "user_lsh_pairs": f"WITH {RT}, {RT3}, {_seeded('rt3')} SELECT DISTINCT x.id AS u1, y.id AS u2 FROM sg x JOIN sg y ON x.band = y.band AND x.hash = y.hash AND x.id < y.id",
        "user_similarity_minhash": f"{PEOPLE}, {RT3}, {_seeded('rt3')} SELECT DISTINCT u1, u2, sim FROM um JOIN sg x ON x.id = u1 JOIN sg y ON y.id = u2 AND y.band = x.band AND y.hash = x.hash",
        "predict_item_based": BY_ITEM,
        "predict_user_based": BY_USER,
        "graph_edges": f"WITH {GRAPH} SELECT src, dst FROM ed",
        "graph_vertices": f"WITH {GRAPH} SELECT DISTINCT src AS id FROM sy",
        "graph_degrees": f"WITH {GRAPH} SELECT src AS id, count(*) AS degree FROM sy GROUP BY 1",
        "label_propagation": _labels(),
        "label_community_report": f"""{_labels().replace(" SELECT id, label FROM l5", "")}
SELECT string_agg(chr(39) || id || chr(39), ', ' ORDER BY id) AS line FROM l5 GROUP BY label""",
        "connected_components": f"{COMPONENTS} SELECT id, community FROM cc",
        "edge_betweenness": f"{_betweenness()} SELECT src, dst, round(value, 6) AS value FROM bt",
        "betweenness_report": f"{_betweenness()} SELECT '(' || chr(39) || src || chr(39) || ', ' || chr(39) || dst || chr(39) || '), ' || CAST(round(value, 6) AS VARCHAR) AS line FROM bt",
        "edge_removal_first_round": f"{_betweenness()} SELECT src, dst FROM bt WHERE value < (SELECT max(value) FROM bt) * (1 - 1e-9)",
        "modularity_of_components": MODULARITY,
    }
