"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

#: White space that the SQL side trims and splits at (fixed values).
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _id(column: str) -> str:
    trimmed = f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"CASE WHEN regexp_full_match({trimmed}, '[A-Za-z0-9_-]{{22}}') THEN {trimmed} END"


RATINGS = f"rp AS (SELECT DISTINCT u, b FROM (SELECT {_id('user_id')} AS u, {_id('business_id')} AS b FROM review) WHERE u IS NOT NULL AND b IS NOT NULL)"

_DROPPED = "translate(nfc_normalize(lower(text)), '([,.!?:;])01\"23456789-\\&' || chr(8203) || chr(65279) || chr(173), '')"
TERMS = f"""r AS (SELECT review_id, any_value(business_id) AS business_id, any_value(text) AS text FROM review WHERE review_id IS NOT NULL GROUP BY 1),
t AS (SELECT review_id, {_id('business_id')} AS b, unnest(regexp_split_to_array({_DROPPED}, '[{SPACE}]+')) AS term FROM r),
w AS (SELECT * FROM t WHERE term <> '')"""

P1 = f"""WITH {TERMS},
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT review_id) AS records FROM w GROUP BY 1),
n AS (SELECT count(DISTINCT review_id) AS total FROM w),
m AS (SELECT term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records,
 CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * (SELECT total FROM n) THEN 'common' END AS mark FROM c)
"""

P3 = f"""WITH {RATINGS},
n AS (SELECT b, count(*) AS n FROM rp GROUP BY 1), total AS (SELECT count(DISTINCT u) AS total FROM rp),
c AS (SELECT x.b AS b1, y.b AS b2, count(*) AS c FROM rp x JOIN rp y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT b1, b2, c, n1.n AS n1, n2.n AS n2, total FROM c JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2, total)
"""

P4 = f"""WITH {RATINGS}, n AS (SELECT b, count(*) AS n FROM rp GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT x.b AS b1, y.b AS b2, count(*) AS c FROM rp x JOIN rp y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT b1, b2 FROM c JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2 WHERE 2 * c >= n1.n + n2.n - c"""

P5 = f"""WITH {TERMS}, s AS (SELECT DISTINCT lower(trim(value)) AS term FROM stopwords),
big AS (SELECT b FROM w WHERE b IS NOT NULL GROUP BY 1 HAVING count(DISTINCT review_id) >= 5),
c AS (SELECT b, term, count(*) AS n FROM w WHERE b IS NOT NULL AND term NOT IN (SELECT term FROM s WHERE term IS NOT NULL) GROUP BY 1, 2),
total AS (SELECT count(DISTINCT b) AS total FROM c), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT b, max(n) AS top FROM c GROUP BY 1),
sc AS (SELECT c.b, c.term, round(CAST(n AS DOUBLE) / top * log2(CAST(total AS DOUBLE) / df), 6) AS score FROM c JOIN x USING (b) JOIN df USING (term) JOIN big ON big.b = c.b, total)
SELECT b AS business_id, term FROM (SELECT b, term, row_number() OVER (PARTITION BY b ORDER BY score DESC, term) AS k FROM sc) WHERE k <= 3"""

# Probabilities by differences of log gammas, which have enough places at this size; every term of the tails is a row.
P5_ENRICHED = f"""WITH {TERMS}, s AS (SELECT DISTINCT lower(trim(value)) AS term FROM stopwords),
big AS (SELECT b FROM w WHERE b IS NOT NULL GROUP BY 1 HAVING count(DISTINCT review_id) >= 5),
c AS (SELECT b, term, count(*) AS n FROM w WHERE b IS NOT NULL AND term NOT IN (SELECT term FROM s WHERE term IS NOT NULL) GROUP BY 1, 2),
dr AS (SELECT b, sum(n)::BIGINT AS draws FROM c GROUP BY 1), o AS (SELECT term, sum(n)::BIGINT AS marked FROM c GROUP BY 1), z AS (SELECT sum(n)::BIGINT AS size FROM c),
u AS (SELECT b, term, n, draws, marked, size FROM c JOIN dr USING (b) JOIN o USING (term) JOIN big USING (b), z),
combo AS (SELECT DISTINCT n, draws, marked, size FROM u),
x AS (SELECT n, draws, marked, size, unnest(range(n, least(draws, marked) + 1)) AS i FROM combo),
l AS (SELECT n, draws, marked, size, lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(size - marked + 1) - lgamma(draws - i + 1) - lgamma(size - marked - draws + i + 1)
 - lgamma(size + 1) + lgamma(draws + 1) + lgamma(size - draws + 1) AS lp FROM x WHERE draws - i <= size - marked),
y AS (SELECT n, draws, marked, size, max(lp) AS top FROM l GROUP BY ALL),
p AS (SELECT n, draws, marked, size, round(least(0, any_value(top) + ln(sum(exp(lp - top)))), 9) AS log_p FROM l JOIN y USING (n, draws, marked, size) GROUP BY ALL),
pl AS (SELECT b, term, n, log_p, row_number() OVER (PARTITION BY b ORDER BY log_p, n DESC, term) AS place, count(*) OVER (PARTITION BY b) AS m FROM u JOIN p USING (n, draws, marked, size)),
q AS (SELECT b, term, n, place, least(0, min(log_p + ln(m / place)) OVER (PARTITION BY b ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS log_q FROM pl)
SELECT b AS business_id, term, n, round(-log_q / ln(10), 6) + 0.0 AS score, CAST(place AS INTEGER) AS place FROM q WHERE place <= 3"""

P6 = f"""WITH m AS (SELECT {_id('b1')} AS b1, {_id('b2')} AS b2, sim FROM item_model WHERE sim IS NOT NULL AND NOT isnan(sim)),
p AS (SELECT b1, b2, max(sim) AS sim FROM m WHERE b1 IS NOT NULL AND b2 IS NOT NULL GROUP BY 1, 2)
SELECT b1, b2 FROM (SELECT b1, b2, row_number() OVER (PARTITION BY b1 ORDER BY sim DESC, b2) AS k FROM p) WHERE k <= 5"""


P7 = f"""WITH RECURSIVE sx AS (SELECT DISTINCT u, b FROM (SELECT {_id('user_id')} AS u, {_id('business_id')} AS b FROM sample_data) WHERE u IS NOT NULL AND b IS NOT NULL),
e AS (SELECT u AS x, b AS y FROM sx UNION SELECT b, u FROM sx),
reached(member_id, far) AS (SELECT DISTINCT x, x FROM e UNION SELECT member_id, e.y FROM reached JOIN e ON e.x = reached.far)
SELECT member_id, min(far) AS group_id FROM reached GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{P1} SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p1_terms": f"{P1} SELECT * FROM m",
        "p3_found": f"{P3} SELECT b1, b2 FROM p WHERE c * total >= 3 * n1 * n2",
        "p3_pairs": f"{P3} SELECT b1, b2, c, n1, n2, round(c * CAST(total AS DOUBLE) / (n1 * n2), 6) AS lift FROM p",
        "p4_found": P4,
        "p5_found": P5,
        "p5_enriched": P5_ENRICHED,
        "p6_found": P6,
        "p7_found": P7,
    }
