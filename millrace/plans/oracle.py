"""DuckDB SQL for the registered queries, over views of the tables' own names."""

from __future__ import annotations

from millrace.operators.sketch import BLOOM_A, BLOOM_B, BLOOM_BITS, FM_A, FM_B, FM_GROUP, FM_P, PRIME
from millrace.operators.similarity import MODULUS, coefficients
from millrace.plans.settings import (
    EDGE_THRESHOLD, JACCARD, K_MEANS, LSH_BANDS, LSH_JACCARD, PARTITIONS, SAMPLE_SIZE, STOPWORDS, SUPPORT_SHARE, SWAPPED_SUPPORT, USER_BANDS, YEAR,
)

REVIEWS = """reviews AS (
  SELECT o_custkey AS user_id, l_partkey AS business_id, CAST(CAST(l_quantity AS INTEGER) % 5 + 1 AS DOUBLE) AS stars,
         o_orderdate AS date, l_orderkey AS order_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

BUSINESSES = """categories AS (
  SELECT p_partkey AS business_id, unnest(string_split(p_type || ', ' || p_brand, ', ')) AS category FROM part WHERE p_size > 25)"""


def ratings(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT user_id AS u, business_id AS i, avg(stars) AS r FROM reviews WHERE {where} GROUP BY 1, 2)"


MEMBERS = "members AS (SELECT DISTINCT user_id AS u, business_id AS i FROM reviews)"
TOP_CATEGORIES = "SELECT category, round(mean_stars, 6) AS mean_stars FROM means ORDER BY means.mean_stars DESC, category ASC NULLS FIRST LIMIT 20"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def pearson(name: str, source: str, owner: str, by: str, candidates: str = "") -> str:
    """A table (a, b, sim) of positive Pearson pairs."""
    near = f"JOIN {candidates} c ON c.a = x.{owner} AND c.b = y.{owner}" if candidates else ""
    return f"""{name}_sums AS (
  SELECT x.{owner} AS a, y.{owner} AS b, count(*) AS n, sum(x.r) AS sx, sum(y.r) AS sy, sum(x.r * x.r) AS xx, sum(y.r * y.r) AS yy, sum(x.r * y.r) AS xy
  FROM {source} x JOIN {source} y ON x.{by} = y.{by} AND x.{owner} < y.{owner} {near} GROUP BY 1, 2 HAVING count(*) >= 3),
{name}_parts AS (SELECT a, b, xy - sx * sy / n AS c, xx - sx * sx / n AS vx, yy - sy * sy / n AS vy FROM {name}_sums),
{name} AS (SELECT a, b, c / (sqrt(vx) * sqrt(vy)) AS sim FROM {name}_parts WHERE c > 1e-9 AND vx > 1e-9 AND vy > 1e-9)"""


def lsh(name: str, source: str, owner: str, member: str, bands: int, threshold: float | None) -> str:
    """A table (a, b[, sim]) of LSH candidates, with their Jaccard where there is a threshold."""
    values = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients(bands)))
    text = f"""{name}_signed AS (
  SELECT {owner} AS o, band, min(({member} * fa + fb) % {MODULUS}) AS sig FROM {source}, (VALUES {values}) f(band, fa, fb) GROUP BY 1, 2),
{name}_near AS (SELECT DISTINCT x.o AS a, y.o AS b FROM {name}_signed x JOIN {name}_signed y ON x.band = y.band AND x.sig = y.sig AND x.o < y.o)"""
    if threshold is None:
        return text
    return text + f""",
{name}_sizes AS (SELECT {owner} AS o, count(DISTINCT {member}) AS n FROM {source} GROUP BY 1),
{name} AS (
  SELECT c.a, c.b, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS sim
  FROM {name}_near c JOIN {source} x ON x.{owner} = c.a JOIN {source} y ON y.{owner} = c.b AND y.{member} = x.{member}
  JOIN {name}_sizes p ON p.o = c.a JOIN {name}_sizes q ON q.o = c.b
  GROUP BY 1, 2 HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= {threshold})"""


JACCARD_PAIRS = f"""pair_sizes AS (SELECT u, count(*) AS n FROM members GROUP BY 1),
pairs AS (
  SELECT x.u AS a, y.u AS b, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS sim
  FROM members x JOIN members y ON x.i = y.i AND x.u < y.u JOIN pair_sizes p ON p.u = x.u JOIN pair_sizes q ON q.u = y.u
  GROUP BY 1, 2 HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= {JACCARD})"""

WORDS = f"""words AS (
  SELECT source AS business, word, count(*) AS freq
  FROM (SELECT source, unnest(string_split(lower(translate(text, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')), ' ')) AS word FROM documents)
  WHERE word NOT IN ({STOP}, '') AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1, 2),
scored AS (
  SELECT w.business, w.word, w.freq, round(w.freq / max(w.freq) OVER (PARTITION BY w.business) * log2((SELECT count(DISTINCT word) FROM words) / df.df), 6) AS tfidf
  FROM words w JOIN (SELECT word, count(*) AS df FROM words GROUP BY 1) df ON df.word = w.word),
profile AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY business ORDER BY tfidf DESC, word) <= 200)"""

USERS = """visits AS (SELECT doc_id % 50 AS "user", source AS business, doc_id FROM documents),
users AS (
  SELECT "user", word, sum(freq) AS n FROM visits JOIN profile USING (business) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY sum(freq) DESC, word) <= 200)"""

EDGES = f"""edges AS (
  SELECT x.u AS a, y.u AS b FROM members x JOIN members y ON x.i = y.i AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {EDGE_THRESHOLD}),
links AS (SELECT a AS s, b AS t FROM edges UNION ALL SELECT b, a FROM edges),
nodes AS (SELECT DISTINCT s AS node FROM links)"""
GRAPH = f"{REVIEWS}, {MEMBERS}, {EDGES}"

COMPONENTS = """reach(node, r) AS (SELECT node, node FROM nodes UNION SELECT l.t, reach.r FROM reach JOIN links l ON l.s = reach.node WHERE reach.r < l.t),
comps AS (SELECT node, min(r) AS component FROM (SELECT * FROM reach UNION ALL SELECT node, node FROM nodes) GROUP BY 1)"""


def labels(rounds: int) -> str:
    parts = ["l0 AS (SELECT node, node AS c FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"l{k} AS (SELECT s AS node, c FROM (SELECT l.s, p.c, count(*) AS n FROM links l JOIN l{k - 1} p ON p.node = l.t GROUP BY 1, 2) "
            "QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, c) = 1)"
        )
    return ", ".join(parts)


BYTES = "list_transform(range(1, length(hex(encode(v))) + 1, 2), lambda i: CAST('0x' || substr(hex(encode(v)), i, 2) AS BIGINT))"


def fold(modulus: str) -> str:
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), {BYTES}), lambda acc, x: (acc * 256 + x) % {modulus})"


BITS = " UNION ".join(f"SELECT (({a} * x + {b}) % {PRIME}) % {BLOOM_BITS} AS bit FROM hashed" for a, b in zip(BLOOM_A, BLOOM_B))
BLOOM = f"hashed AS (SELECT {fold(str(PRIME))} AS x FROM (SELECT DISTINCT c_name AS v FROM customer WHERE c_custkey % 2 = 0 AND length(c_name) > 0)), bits AS ({BITS})"


def fm(source: str, key: str, form: str) -> str:
    """Flajolet-Martin over a table ``source`` of distinct (key, v)."""
    values = ", ".join(f"({i}, {a}, {b}, {p})" for i, (a, b, p) in enumerate(zip(FM_A, FM_B, FM_P)))
    each = "r * r" if form == "square" else "pow(2, r)"
    middle = len(FM_A) // (2 * FM_GROUP)
    return f"""functions(f, fa, fb, fp) AS (VALUES {values}),
zeros AS (
  SELECT {key}, f, max(length(bin(h)) - length(rtrim(bin(h), '0'))) AS r
  FROM (SELECT {key}, f, ((fa * {fold("fp")} + fb) % fp) % {BLOOM_BITS} AS h FROM {source}, functions) GROUP BY 1, 2),
means AS (SELECT {key}, f // {FM_GROUP} AS g, avg(CAST({each} AS DOUBLE)) AS m FROM zeros GROUP BY 1, 2),
middles AS (SELECT {key}, m FROM means QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY m) = {middle + 1})
SELECT {key}, n_distinct, round(m, 6) AS estimate FROM middles JOIN (SELECT {key}, count(*) AS n_distinct FROM {source} GROUP BY 1) USING ({key})"""


DAYS = "days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS v FROM events WHERE user_id IS NOT NULL)"


def slid(value: str) -> str:
    """Distinct values in windows of an hour every twenty minutes."""
    start = "time_bucket(INTERVAL 20 minutes, ts) - INTERVAL 20 minutes * k"
    return f"slid AS (SELECT DISTINCT strftime({start}, '%Y-%m-%d %H:%M:%S') AS window_start, CAST({value} AS VARCHAR) AS v FROM events, range(3) t(k) WHERE {value} IS NOT NULL)"


POINTS = "dims AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


FIRSTS = f"firsts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS c FROM (SELECT min(vec_id) AS id FROM embeddings GROUP BY embedding ORDER BY id LIMIT {K_MEANS}))"

ASSIGNED = f"""{POINTS}, {FIRSTS}, c0 AS (SELECT c, pos, v FROM firsts JOIN dims USING (id)),
a0 AS (SELECT id, c, dist FROM (SELECT d.id, e.c, sqrt(sum((d.v - e.v) * (d.v - e.v))) AS dist FROM dims d JOIN c0 e USING (pos) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, c) = 1)"""

#: Lloyd as a recursion: a row is a round with all its centres, and rounds go on while some coordinate moves.
LLOYD = f"""pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {FIRSTS},
rounds(r, centres, moved) AS (
  SELECT 0, (SELECT list(e ORDER BY c) FROM firsts JOIN pts USING (id)), true
  UNION ALL
  SELECT r + 1, n.centres, list_max(list_transform(range(1, len(n.centres) + 1), lambda k: list_distance(n.centres[k], o.centres[k]))) > 1e-11
  FROM rounds o, LATERAL (
    SELECT list(coalesce(m.v, o.centres[k]) ORDER BY k) AS centres
    FROM range(1, len(o.centres) + 1) t(k) LEFT JOIN (
      SELECT k, list(v ORDER BY pos) AS v FROM (
        SELECT k, pos, avg(e[pos]) AS v FROM (
          SELECT e, list_position(far, list_min(far)) AS k FROM (SELECT e, list_transform(o.centres, lambda x: list_distance(e, x)) AS far FROM pts)
        ), range(1, len(e) + 1) d(pos) GROUP BY k, pos) GROUP BY k) m USING (k)) n
  WHERE o.moved AND o.r < 1000),
last AS (SELECT centres FROM rounds ORDER BY r DESC LIMIT 1),
ends AS (SELECT id, list_transform(centres, lambda x: list_distance(e, x)) AS far FROM pts, last)"""


def _mod64(x: str) -> str:
    return f"CAST(({x}) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _times(x: str, factor: int) -> str:
    return _mod64(f"CAST({x} AS UHUGEINT) * {factor}::UHUGEINT")


def _turn(x: str, bits: int) -> str:
    return f"(CAST({_times(x, 1 << bits)} AS UHUGEINT) + CAST({x} // {1 << (64 - bits)}::UBIGINT AS UHUGEINT))"


def hashed_rows(table: str, key: str, columns: str) -> str:
    """``hashed``: columns and h, the 64-bit xxHash with seed 42 of a key that is not negative, step by step; its constants are fixed values."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    steps = [f"x0 AS (SELECT {columns}, {_times(key, p2)} AS h FROM {table})"]
    forms = [
        f"xor({_times('u', p1)}, {(42 + p5 + 8) % (1 << 64)}::UBIGINT)", _mod64(f"CAST({_times('u', p1)} AS UHUGEINT) + {p4}::UHUGEINT"),
        _times("xor(h, h // 8589934592::UBIGINT)", p2), _times("xor(h, h // 536870912::UBIGINT)", p3), "xor(h, h // 4294967296::UBIGINT)",
    ]
    turns = {0: 31, 1: 27}
    for i, form in enumerate(forms):
        turned = f"(SELECT *, CAST({_turn('h', turns[i])} AS UBIGINT) AS u FROM x{i})" if i in turns else f"x{i}"
        steps.append(f"{'hashed' if i == 4 else f'x{i + 1}'} AS (SELECT {columns}, {form} AS h FROM {turned})")
    return ", ".join(steps)


#: Hashes are ordered as signed integers.
SAMPLED = f"{hashed_rows('events', 'event_id', 'event_id, event_type')}, sampled AS (SELECT event_id, event_type FROM hashed ORDER BY h < 9223372036854775808::UBIGINT, h, event_id LIMIT {SAMPLE_SIZE})"

BRANDS = f"""baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
least AS (SELECT greatest(1, CAST(ceil(count(DISTINCT basket) * {SUPPORT_SHARE} / 1000) AS BIGINT)) AS s FROM baskets)"""


def itemset_sql(baskets: str, basket: str, item: str, support: str) -> str:
    """Frequent itemsets of up to four items, which is as many as there are."""
    joins, out = "", []
    for k in range(1, 5):
        names = [f"t{j}" for j in range(1, k + 1)]
        joins = f"{baskets} t1" + "".join(f" JOIN {baskets} t{j} ON t{j}.{basket} = t1.{basket} AND t{j}.{item} > t{j - 1}.{item}" + (f" AND t{j}.{item} IN (SELECT {item} FROM singles)" if j else "") for j in range(2, k + 1))
        text = " || ',' || ".join(f"CAST({n}.{item} AS VARCHAR)" for n in names)
        out.append(f"SELECT {k} AS size, {text} AS items, count(*) AS freq FROM {joins} WHERE t1.{item} IN (SELECT {item} FROM singles) GROUP BY 2 HAVING count(*) >= {support}")
    return f"singles AS (SELECT {item} FROM {baskets} GROUP BY 1 HAVING count(*) >= {support}) " + " UNION ALL ".join(out)


CF_SPLIT = ratings("train", "order_id % 10 <> 0") + ", tests AS (SELECT DISTINCT user_id AS u, business_id AS i FROM reviews WHERE order_id % 10 = 0)"
BOTH = "both_ways AS (SELECT a AS x, b AS y, sim FROM model UNION ALL SELECT b, a, sim FROM model)"

ORACLE_SQL: dict[str, str] = {
    "category_avg": f"WITH {REVIEWS}, {BUSINESSES}, means AS (SELECT category, avg(stars) AS mean_stars FROM reviews LEFT JOIN categories USING (business_id) GROUP BY 1) {TOP_CATEGORIES}",
    "category_avg_inner": f"WITH {REVIEWS}, {BUSINESSES}, means AS (SELECT category, avg(stars) AS mean_stars FROM reviews JOIN categories USING (business_id) GROUP BY 1) {TOP_CATEGORIES}",
    "review_stats": f"WITH {REVIEWS} SELECT count(*) AS n_reviews, count(*) FILTER (year(date) = {YEAR}) AS n_reviews_year, count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_businesses FROM reviews",
    "mentions_of_year": f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews WHERE contains(CAST(date AS VARCHAR), '{YEAR}')",
    "count_by_year": f"WITH {REVIEWS} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM reviews GROUP BY 1",
    "top_users": f"WITH {REVIEWS} SELECT user_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top_words": f"WITH w AS (SELECT translate(unnest(string_split(lower(text), ' ')), '([,.!?:;])', '') AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word NOT IN ({STOP}, '') GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
    "count_over": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    "itemsets_brands": f"WITH {BRANDS}, {itemset_sql('baskets', 'basket', 'item', '(SELECT s FROM least)')}",
    "itemsets_orders": f"WITH baskets AS (SELECT DISTINCT p_brand AS basket, CAST(l_orderkey AS VARCHAR) AS item FROM lineitem JOIN part ON l_partkey = p_partkey), {itemset_sql('baskets', 'basket', 'item', str(SWAPPED_SUPPORT))}",
    "jaccard_pairs": f"WITH {REVIEWS}, {MEMBERS}, {JACCARD_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "lsh_candidates": f"WITH {REVIEWS}, {MEMBERS}, {lsh('near', 'members', 'i', 'u', USER_BANDS, None)} SELECT a, b FROM near_near",
    "lsh_pairs": f"WITH {REVIEWS}, {MEMBERS}, {lsh('near', 'members', 'i', 'u', LSH_BANDS, LSH_JACCARD)} SELECT a, b, round(sim, 6) AS sim FROM near",
    "item_pearson": f"WITH {REVIEWS}, {ratings('rated')}, {pearson('model', 'rated', 'i', 'u')} SELECT a, b, round(sim, 6) AS sim FROM model",
    "user_pearson": f"WITH {REVIEWS}, {ratings('rated')}, {lsh('near', 'rated', 'u', 'i', USER_BANDS, 0.01)}, {pearson('model', 'rated', 'u', 'i', 'near')} SELECT a, b, round(sim, 6) AS sim FROM model",
    "tfidf_profile": f"WITH {WORDS} SELECT business, word, freq, tfidf FROM profile",
    "user_profile": f'WITH {WORDS}, {USERS} SELECT "user", word, CAST(n AS BIGINT) AS n FROM users',
    "content_score": f"""WITH {WORDS}, {USERS}, tests AS (SELECT DISTINCT "user", business FROM visits),
nb AS (SELECT business, count(*) AS nb FROM profile GROUP BY 1),
shared AS (SELECT t."user", t.business, count(*) AS k FROM tests t JOIN users u ON u."user" = t."user" JOIN profile p ON p.business = t.business AND p.word = u.word GROUP BY 1, 2)
SELECT "user", business, round(k / nb, 6) AS score FROM shared JOIN nb USING (business) WHERE k / nb >= 0.01""",
    "item_cf_predict": f"""WITH {REVIEWS}, {CF_SPLIT}, {pearson('model', 'train', 'i', 'u')}, {BOTH},
best AS (
  SELECT t.u, t.i, r.r, m.sim FROM tests t JOIN both_ways m ON m.x = t.i JOIN train r ON r.u = t.u AND r.i = m.y
  QUALIFY row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(m.sim, 9) DESC, m.y) <= 10)
SELECT u AS "user", i AS item, round(sum(r * sim) / sum(sim), 5) AS stars FROM best GROUP BY 1, 2 HAVING sum(r * sim) / sum(sim) > 0""",
    "user_cf_predict": f"""WITH {REVIEWS}, {CF_SPLIT}, {lsh('near', 'train', 'u', 'i', USER_BANDS, 0.01)}, {pearson('model', 'train', 'u', 'i', 'near')}, {BOTH},
avgs AS (SELECT u, avg(r) AS mean FROM train GROUP BY 1),
best AS (
  SELECT t.u, t.i, r.r - v.mean AS d, m.sim FROM tests t JOIN both_ways m ON m.x = t.u JOIN train r ON r.u = m.y AND r.i = t.i JOIN avgs v ON v.u = m.y
  QUALIFY row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(m.sim, 9) DESC, m.y) <= 10),
moved AS (SELECT u, i, sum(d * sim) / sum(sim) AS shift FROM best GROUP BY 1, 2)
SELECT t.u AS "user", t.i AS item, round(mean + coalesce(shift, 0), 5) AS stars FROM tests t JOIN avgs ON avgs.u = t.u LEFT JOIN moved ON moved.u = t.u AND moved.i = t.i WHERE mean + coalesce(shift, 0) > 0""",
    "bloom_bits": f"WITH {BLOOM} SELECT bit FROM bits",
    "bloom_probe": f"""WITH {BLOOM}, names AS (SELECT c_custkey AS id, c_name AS v FROM customer UNION ALL SELECT * FROM (VALUES (-1, ''), (-2, 'Zoë Müller'), (-3, '顧客'), (-4, NULL))),
probed AS (SELECT id, v, CASE WHEN length(v) > 0 THEN {fold(str(PRIME))} END AS x FROM names)
SELECT id, v IS NULL OR v = '' OR ({" AND ".join(f"(({a} * x + {b}) % {PRIME}) % {BLOOM_BITS} IN (SELECT bit FROM bits)" for a, b in zip(BLOOM_A, BLOOM_B))}) AS present FROM probed""",
    "fm_reference": f"WITH {DAYS}, {fm('days', 'day', 'square')}",
    "fm_standard": f"WITH {DAYS}, {fm('days', 'day', 'power')}",
    "reservoir_sample": f"WITH {SAMPLED} SELECT event_id, event_type FROM sampled",
    "reservoir_top": f"WITH {SAMPLED}, counts AS (SELECT event_type, count(*) AS n FROM sampled GROUP BY 1) SELECT event_type, n FROM counts QUALIFY dense_rank() OVER (ORDER BY n DESC) <= 3",
    "top_frequencies": """WITH tags AS (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part), counts AS (SELECT tag, count(*) AS n FROM tags WHERE regexp_full_match(tag, '[A-Za-z]+') GROUP BY 1)
SELECT tag, n FROM counts QUALIFY dense_rank() OVER (ORDER BY n DESC) <= 3""",
    "sliding_distinct": f"WITH {slid('user_id')} SELECT window_start, count(*) AS n FROM slid GROUP BY 1",
    "sliding_fm": f"WITH {slid('event_type')}, {fm('slid', 'window_start', 'square')}",
    "kmeans": f"WITH RECURSIVE {LLOYD} SELECT id, CAST(list_position(far, list_min(far)) - 1 AS INTEGER) AS cluster, round(list_min(far), 6) AS distance FROM ends",
    "kmeans_assign": f"WITH {ASSIGNED} SELECT id, CAST(c AS INTEGER) AS cluster, round(dist, 6) AS distance FROM a0",
    "cluster_stats": f"""WITH {POINTS} SELECT label AS cluster, count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(sum(v), 5) AS total, round(sum(v * v), 5) AS squares
FROM dims JOIN embeddings ON vec_id = id GROUP BY label, pos""",
    "copurchase_edges": f"WITH {GRAPH} SELECT a, b FROM edges",
    "jaccard_edges": f"WITH {REVIEWS}, {MEMBERS}, {JACCARD_PAIRS} SELECT a, b FROM pairs",
    "graph_degrees": f"WITH {GRAPH} SELECT s AS node, count(*) AS degree FROM links GROUP BY 1",
    "label_propagation": f"WITH {GRAPH}, {labels(5)} SELECT node, c AS community FROM l5",
    "connected_components": f"WITH RECURSIVE {GRAPH}, {COMPONENTS} SELECT node, component FROM comps",
    "modularity": f"""WITH RECURSIVE {GRAPH}, {COMPONENTS}, m AS (SELECT count(*) AS m FROM edges), deg AS (SELECT s AS node, count(*) AS k FROM links GROUP BY 1),
parts AS (SELECT component, sum(k) AS k FROM deg JOIN comps USING (node) GROUP BY 1),
inside AS (SELECT p.component, count(*) AS e FROM edges JOIN comps p ON p.node = a JOIN comps q ON q.node = b WHERE p.component = q.component GROUP BY 1)
SELECT round(sum((2 * coalesce(e, 0) - k * k / (2.0 * m)) / (2 * m)), 6) AS modularity FROM parts LEFT JOIN inside USING (component), m""",
    "edge_betweenness": f"""WITH RECURSIVE {GRAPH},
walk(root, node, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT w.root, l.t, w.d + 1 FROM walk w JOIN links l ON l.s = w.node WHERE w.d < 40),
levels AS (SELECT root, node, min(d) AS d FROM walk GROUP BY 1, 2),
paths(root, node, d, p) AS (
  SELECT root, node, d, [node] FROM levels WHERE d = 0
  UNION ALL SELECT x.root, l.t, v.d, list_append(x.p, l.t) FROM paths x JOIN links l ON l.s = x.node JOIN levels v ON v.root = x.root AND v.node = l.t AND v.d = x.d + 1),
shares AS (SELECT p, 1.0 / count(*) OVER (PARTITION BY root, node) AS w FROM paths),
steps AS (SELECT p[k] AS s, p[k + 1] AS t, w FROM shares, range(1, 41) r(k) WHERE k < len(p))
SELECT least(s, t) AS a, greatest(s, t) AS b, round(sum(w) / 2, 6) AS betweenness FROM steps GROUP BY 1, 2""",
}
ORACLE_SQL["category_avg_early"] = ORACLE_SQL["category_avg_inner"]
ORACLE_SQL["son_itemsets"] = ORACLE_SQL["itemsets_brands"]

ORACLE_SQL["graph_links"] = f"WITH {GRAPH} SELECT s AS src, t AS dst FROM links"
ORACLE_SQL["graph_vertices"] = f"WITH {GRAPH} SELECT node FROM nodes"
ORACLE_SQL["modularity_unhalved"] = ORACLE_SQL["modularity"].replace("k * k / (2.0 * m)", "k * k / (1.0 * m)")
ORACLE_SQL["content_cosine"] = f"""WITH {WORDS}, {USERS}, tests AS (SELECT DISTINCT "user", business FROM visits),
nb AS (SELECT business, count(*) AS nb FROM profile GROUP BY 1), nu AS (SELECT "user", count(*) AS nu FROM users GROUP BY 1),
shared AS (SELECT t."user", t.business, count(*) AS k FROM tests t JOIN users u ON u."user" = t."user" JOIN profile p ON p.business = t.business AND p.word = u.word GROUP BY 1, 2)
SELECT "user", business, round(k / (sqrt(nb) * sqrt(nu)), 6) AS score FROM shared JOIN nb USING (business) JOIN nu USING ("user") WHERE k / (sqrt(nb) * sqrt(nu)) >= 0.01"""
ORACLE_SQL["tfidf_by_documents"] = ORACLE_SQL["tfidf_profile"].replace("count(DISTINCT word) FROM words", "count(DISTINCT business) FROM words")
ORACLE_SQL["minhash_signatures"] = f"WITH {REVIEWS}, {MEMBERS}, {lsh('near', 'members', 'i', 'u', USER_BANDS, None)} SELECT o AS item, band, sig FROM near_signed"
ORACLE_SQL["event_fields"] = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"
ORACLE_SQL["top_tags_by_type"] = """WITH c AS (SELECT p_type, tag, count(*) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1, 2)
SELECT p_type, tag, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS rank FROM c) WHERE rank <= 3"""
ORACLE_SQL["json_lines_round_trip"] = f"WITH {REVIEWS} SELECT stars, count(*) AS n, sum(user_id) AS users, sum(business_id) AS businesses FROM reviews GROUP BY 1"
ORACLE_SQL["item_cf_saved"] = ORACLE_SQL["item_cf_predict"]
ORACLE_SQL["content_saved"] = ORACLE_SQL["content_score"]
ORACLE_SQL["edge_list_csv"] = ORACLE_SQL["copurchase_edges"]
ORACLE_SQL["partition_by_id"] = f"WITH {REVIEWS} SELECT CAST(p AS INTEGER) AS partition, count(user_id) AS n FROM range({PARTITIONS}) t(p) LEFT JOIN reviews ON business_id % {PARTITIONS} = p GROUP BY 1"
ORACLE_SQL["partition_totals"] = f"WITH {REVIEWS} SELECT {PARTITIONS}::BIGINT AS partitions, count(*) AS n FROM reviews"
ORACLE_SQL["bfr_totals"] = 'SELECT k + 1 AS "round", count(*) AS n_points FROM embeddings, range(5) t(k) WHERE vec_id % 5 <= k GROUP BY 1'
ORACLE_SQL["hll_within_error"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS n_distinct, true AS within FROM events GROUP BY 1"
ORACLE_SQL["lsh_recall"] = f"""WITH {REVIEWS}, {MEMBERS}, sizes AS (SELECT i, count(*) AS n FROM members GROUP BY 1),
pairs AS (SELECT x.i AS a, y.i AS b FROM members x JOIN members y ON x.u = y.u AND x.i < y.i JOIN sizes p ON p.i = x.i JOIN sizes q ON q.i = y.i
  GROUP BY 1, 2 HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= {LSH_JACCARD})
SELECT count(*) AS n_pairs, true AS reached FROM pairs"""
