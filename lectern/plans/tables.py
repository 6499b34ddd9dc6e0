"""Queries over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import graph, joins, merge, scoring, sequences
from lectern.plans.documents import read
from lectern.session import materialise


def _initialled(df, key, nation, alias):
    """Names such as `C. Japan` for the rows of a table."""
    initial = F.chr(65 + F.col(key) % 26)
    return df.select(F.col(nation).alias("nationkey"), F.concat(initial, F.lit(". "), F.col("n_name")).alias(alias))


def author_style_diff(spark, sf_dir):
    """Author differences between the customers' and the suppliers' segments of each nation."""
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda key, balance: F.concat(F.lit("Ann Name"), F.chr(65 + F.floor(F.abs(F.col(balance))).cast("int") % 26))
    bib = c.groupBy("n_name").agg(F.array_sort(F.collect_set(name("c_custkey", "c_acctbal"))).alias("bib"))
    rec = s.groupBy("n_name").agg(F.array_sort(F.collect_set(name("s_suppkey", "s_acctbal"))).alias("rec"))
    d = bib.join(rec, "n_name").withColumn("d", joins.author_diff(F.col("bib"), F.col("rec")))
    return d.select("n_name", F.array_join("d.only_bib", ";").alias("only_bib"), F.array_join("d.only_record", ";").alias("only_record"))


AUTHOR_STYLE_DIFF = """
WITH b AS (SELECT DISTINCT n_name, 'Ann Name' || chr(CAST(65 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 26 AS INTEGER)) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT DISTINCT n_name, 'Ann Name' || chr(CAST(65 + CAST(floor(abs(s_acctbal)) AS INTEGER) % 26 AS INTEGER)) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT DISTINCT n_name FROM b INTERSECT SELECT DISTINCT n_name FROM r),
ob AS (SELECT n_name, string_agg(x, ';' ORDER BY x) AS v FROM (SELECT * FROM b EXCEPT SELECT * FROM r) GROUP BY n_name),
orr AS (SELECT n_name, string_agg(x, ';' ORDER BY x) AS v FROM (SELECT * FROM r EXCEPT SELECT * FROM b) GROUP BY n_name)
SELECT n_name, coalesce(ob.v, '') AS only_bib, coalesce(orr.v, '') AS only_record FROM n LEFT JOIN ob USING (n_name) LEFT JOIN orr USING (n_name)
"""


def name_form_mismatch(spark, sf_dir):
    """Customers whose initial no supplier of their nation has."""
    n = read(spark, sf_dir, "nation")
    c = _initialled(read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_custkey", "c_nationkey", "name")
    s = _initialled(read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "s_nationkey", "name")
    bib = c.groupBy("nationkey").agg(F.array_sort(F.collect_set("name")).alias("bib"))
    rec = s.groupBy("nationkey").agg(F.array_sort(F.collect_set("name")).alias("rec"))
    return bib.join(rec, "nationkey").select("nationkey", F.explode(joins.name_form_mismatches(F.col("bib"), F.col("rec"))).alias("name"))


NAME_FORM_MISMATCH = """
WITH c AS (SELECT DISTINCT c_nationkey AS nationkey, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS i, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT DISTINCT s_nationkey AS nationkey, chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS i FROM supplier)
SELECT c.nationkey, i || '. ' || n_name AS name FROM c WHERE nationkey IN (SELECT nationkey FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.nationkey = c.nationkey AND s.i = c.i)
"""


def set_diff_report(spark, sf_dir):
    """Order priorities that a customer took up or dropped from one half of the years to the other."""
    o = read(spark, sf_dir, "orders")
    mid = F.year("o_orderdate") >= 1997
    g = o.groupBy("o_custkey").agg(F.collect_set(F.when(~mid, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(mid, F.col("o_orderpriority"))).alias("b"))
    d = merge.set_difference(F.col("a"), F.col("b"))
    return g.select("o_custkey", F.array_join(d, ",").alias("diff")).where("diff <> ''")


SET_DIFF_REPORT = """
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE year(o_orderdate) < 1997),
b AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE year(o_orderdate) >= 1997),
d AS (SELECT o_custkey, '-' || p AS x FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, '+' || p FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT o_custkey, string_agg(x, ',' ORDER BY x) AS diff FROM d GROUP BY o_custkey
"""


def semi_cascade(spark, sf_dir):
    r = read(spark, sf_dir, "region").where("r_name = 'ASIA'")
    n = read(spark, sf_dir, "nation")
    n = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_semi")
    c = read(spark, sf_dir, "customer")
    c = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi")
    o = read(spark, sf_dir, "orders")
    o = o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


SEMI_CASCADE = """
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN
  (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))) GROUP BY o_orderstatus
"""


def anti_dangling(spark, sf_dir):
    """Orders that no line refers to, parts that none uses, and lines before their order."""
    o, l, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    unused = o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti").select(F.lit("unused-order").alias("kind"), F.col("o_orderkey").alias("id"))
    parts = p.join(l, p["p_partkey"] == l["l_partkey"], "left_anti").select(F.lit("unused-part").alias("kind"), F.col("p_partkey").alias("id"))
    forward = l.join(o, (l["l_orderkey"] == o["o_orderkey"]) & (l["l_shipdate"] < o["o_orderdate"])).select(F.lit("forward").alias("kind"), F.col("l_orderkey").alias("id")).distinct()
    return unused.unionByName(parts).unionByName(forward)


ANTI_DANGLING = """
SELECT 'unused-order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'unused-part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT 'forward', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
"""


def full_outer_agreement(spark, sf_dir):
    """Whether customers' and suppliers' balances agree in sign, by nation."""
    c = read(spark, sf_dir, "customer").where("c_acctbal < 5000").groupBy(F.col("c_nationkey").alias("nation")).agg((F.avg("c_acctbal") > 2000).alias("outcome"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg((F.avg("s_acctbal") > 7500).alias("outcome"))
    return joins.full_outer_agreement(c, s, "nation", "outcome")


FULL_OUTER_AGREEMENT = """
WITH a AS (SELECT c_nationkey AS nation, avg(c_acctbal) > 2000 AS v FROM customer WHERE c_acctbal < 5000 GROUP BY 1),
b AS (SELECT s_nationkey AS nation, avg(s_acctbal) > 7500 AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, a.v AS outcome_a, b.v AS outcome_b, CASE WHEN a.nation IS NULL THEN 'only_b' WHEN b.nation IS NULL THEN 'only_a' ELSE 'both' END AS side,
  CASE WHEN a.nation IS NOT NULL AND b.nation IS NOT NULL THEN a.v = b.v END AS agree FROM a FULL JOIN b ON a.nation = b.nation
"""


def asof_last_before(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    out = joins.asof_last_before(buys, signups, ["user_id"], "ts", "ts", ["ts", "signup_id"])
    return out.select("event_id", "user_id", "signup_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("right_ts").cast("timestamp"))).alias("waited_us"))


ASOF_LAST_BEFORE = """
SELECT p.event_id, p.user_id, arg_max(s.event_id, (s.ts, s.event_id)) AS signup_id, epoch_us(p.ts) - epoch_us(max(s.ts)) AS waited_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON s.user_id = p.user_id AND s.ts <= p.ts
GROUP BY p.event_id, p.user_id, p.ts
"""


def interval_locate(spark, sf_dir):
    """Clicks within six hours after a signup of the same user."""
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("t").alias("start"), (F.col("t") + 21600).alias("end"))
    points = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    found = joins.interval_locate(points, spans, "t", "start", "end", 21600, ["user_id"])
    return found.groupBy("event_id").agg(F.count("signup_id").alias("spans"), F.min("signup_id").alias("first_span"))


INTERVAL_LOCATE = """
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT c.event_id, count(s.event_id) AS spans, min(s.event_id) AS first_span FROM (SELECT * FROM e WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') s ON s.user_id = c.user_id AND c.t >= s.t AND c.t < s.t + 21600 GROUP BY c.event_id
"""


def coupling_pairs(spark, sf_dir):
    return joins.coupling_pairs(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


COUPLING_PAIRS = """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT x.o AS a, y.o AS b, count(*) AS shared FROM l x JOIN l y ON x.p = y.p AND x.o < y.o GROUP BY 1, 2 HAVING count(*) >= 2
"""


def coupling_components(spark, sf_dir):
    """Clusters of orders that share two parts or more, with a cluster's size and median date, dated before undated."""
    pairs = coupling_pairs(spark, sf_dir)
    comp = graph.connected_components(pairs, "a", "b")
    o = read(spark, sf_dir, "orders")
    j = comp.join(o, comp["id"] == o["o_orderkey"])
    return j.groupBy("component_id").agg(F.count("*").alias("members"), F.max("id").alias("last_member"), F.median(F.year("o_orderdate")).alias("median_year"))


COUPLING_COMPONENTS = f"""
WITH RECURSIVE p AS ({COUPLING_PAIRS}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT component_id, count(*) AS members, max(id) AS last_member, median(year(o_orderdate)) AS median_year FROM c JOIN orders ON id = o_orderkey GROUP BY component_id
"""


def reach_closure(spark, sf_dir):
    """What can be reached from a part by steps from its number to a seventh of it."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 7).cast("long").alias("dst")).where("src <> dst")
    return graph.reachable(p)


REACH_CLOSURE = """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 7 AS dst FROM part WHERE p_partkey <> p_partkey // 7),
r(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src)
SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY src, dst
"""


def chain_islands(spark, sf_dir):
    """Runs of rising values in each user's events, and whether all later rows of a run are confirmed."""
    e = read(spark, sf_dir, "events")
    chains = sequences.chain_ids(e, ["user_id"], ["ts", "event_id"], "value")
    chains = chains.withColumn("severity", F.when(F.col("event_type") == "error", "CRITICAL").otherwise("MINOR")).withColumn("confirmed", F.col("event_type").isin("view", "click"))
    by, order = ["user_id", "chain_id"], ["ts", "event_id"]
    marked = sequences.supersede(chains.withColumn("after", sequences.rows_after(by, order)), by, order)
    return marked.groupBy("user_id").agg(F.max("chain_id").alias("chains"), (F.max("after") + 1).alias("longest"), F.count_if("demoted").alias("demoted"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


CHAIN_ISLANDS = """
WITH a AS (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS b FROM events),
c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM a),
d AS (SELECT *, count(*) OVER (PARTITION BY user_id, chain) - row_number() OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) AS after,
  coalesce(min(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, chain ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ok FROM c)
SELECT user_id, CAST(max(chain) AS BIGINT) AS chains, max(after) + 1 AS longest, count(*) FILTER (event_type = 'error' AND ok = 1) AS demoted, count(*) FILTER (event_type = 'error' AND ok = 0) AS critical FROM d GROUP BY user_id
"""


def lead_licence(spark, sf_dir):
    """A user's turn takes the first word of the assistant's turn that follows."""
    c = read(spark, sf_dir, "conversations")
    c = c.withColumn("licence", F.when(F.col("role") == "system", F.lit("system"))).withColumn("word", F.regexp_extract("text", "[A-Za-z]+", 0))
    c = c.withColumn("own", F.coalesce("licence", F.when(F.col("role") == "assistant", F.col("word"))))
    out = sequences.licence_ahead(c, ["conv_id"], ["turn", "role", "text"], "own", F.col("role") == "assistant", "granted")
    return out.select("conv_id", "turn", "role", "granted")


LEAD_LICENCE = """
WITH c AS (SELECT *, CASE WHEN role = 'system' THEN 'system' WHEN role = 'assistant' THEN regexp_extract(text, '[A-Za-z]+') END AS own FROM conversations)
SELECT conv_id, turn, role, coalesce(own, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(own) OVER w END) AS granted FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
"""


def counter_numbering(spark, sf_dir):
    """Numbers of the user's turns in each conversation, and ids made unique by a suffix."""
    c = read(spark, sf_dir, "conversations")
    n = sequences.number_within(c, ["conv_id"], ["turn", "role", "text"], F.col("role") == "user", "number")
    n = n.withColumn("stem", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("role")))
    return sequences.suffix_repeats(n, "stem", ["turn", "text"], "id").select("conv_id", "turn", "role", "number", "id")


COUNTER_NUMBERING = """
WITH n AS (SELECT *, CASE WHEN role = 'user' THEN count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) END AS number,
  conv_id || '/' || role AS stem, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations)
SELECT conv_id, turn, role, number, stem || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS id FROM n
"""


def interval_coverage(spark, sf_dir):
    """Seconds of each user's time that one-day spans from their events cover, overlaps once."""
    e = read(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a")).withColumn("z", F.col("a") + 86400)
    return sequences.covered_length(e, ["user_id"], "a", "z")


INTERVAL_COVERAGE = """
WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events),
d AS (SELECT user_id, a, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS b FROM e)
SELECT user_id, CAST(sum(least(86400, coalesce(b - a, 86400))) AS BIGINT) AS covered FROM d GROUP BY user_id
"""


def gap_rollup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ladder = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    out = scoring.rollup_counts(o, "o_orderstatus", "o_orderpriority", ladder)
    return out.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), *[F.col(f"`{p}`").alias(f"n{k}") for k, p in enumerate(ladder, 1)])


GAP_ROLLUP = """
SELECT coalesce(o_orderstatus, 'ALL') AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS n1, count(*) FILTER (o_orderpriority = '2-HIGH') AS n2, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS n3,
  count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n4, count(*) FILTER (o_orderpriority = '5-LOW') AS n5 FROM orders GROUP BY ROLLUP (o_orderstatus)
"""


def distinct_obligation(spark, sf_dir):
    """First line of each (order, flag, part) among those not established; established ones don't use up the key."""
    l = read(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'")
    first = merge.first_by(l, ["l_orderkey", "l_returnflag", "l_partkey"], ["l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"])
    return first.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


DISTINCT_OBLIGATION = """
WITH f AS (SELECT l_orderkey, l_returnflag, l_partkey, min(l_linenumber) AS k FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1, 2, 3)
SELECT l_returnflag, count(*) AS n, CAST(sum(k) AS BIGINT) AS lines, count(DISTINCT l_orderkey) AS orders FROM f GROUP BY 1
"""


def running_budget(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("cost", F.round(F.col("value") * 100).cast("long"))
    out = sequences.within_budget(e, ["user_id"], ["ts", "event_id"], "cost", 50000)
    return out.groupBy("user_id").agg(F.count_if(F.col("status") == "run").alias("run"), F.count_if(F.col("status") == "unverified").alias("unverified"))


RUNNING_BUDGET = """
WITH b AS (SELECT user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT user_id, count(*) FILTER (spent < 50000) AS run, count(*) FILTER (spent >= 50000) AS unverified FROM b GROUP BY user_id
"""


def circuit_breaker(spark, sf_dir):
    """Events as requests to a user's host: how many come after three errors or signups in a row."""
    e = read(spark, sf_dir, "events")
    out = sequences.breaker(e, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "signup"))
    return out.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("open").alias("refused"))


CIRCUIT_BREAKER = """
WITH f AS (SELECT user_id, ts, event_id, event_type IN ('error', 'signup') AS f FROM events),
t AS (SELECT *, f AND coalesce(lag(f) OVER w, FALSE) AND coalesce(lag(f, 2) OVER w, FALSE) AS trip FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT user_id, coalesce(max(CASE WHEN trip THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM t)
SELECT user_id, count(*) AS attempts, count(*) FILTER (open = 1) AS refused FROM o GROUP BY user_id
"""


def first_definitions(spark, sf_dir):
    """First price of each part's lines, and how many later lines have another."""
    l = read(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))
    return merge.first_definitions(l, "l_partkey", "l_discount", "seq")


FIRST_DEFINITIONS = """
WITH f AS (SELECT l_partkey, arg_min(l_discount, (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS d FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, any_value(d) AS l_discount, count(*) FILTER (l_discount <> d) AS conflicts FROM lineitem JOIN f USING (l_partkey) GROUP BY l_partkey
"""


def ratio_note(spark, sf_dir):
    """Each nation's customers as a percentage of the customers of its region, halves to even, with shown counts."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    per = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name", "n_regionkey").agg(F.count("*").alias("k"), F.sum(F.col("c_custkey") * 1000).alias("big"))
    region = per.groupBy("n_regionkey").agg(F.sum("k").alias("total"))
    j = per.join(region, "n_regionkey")
    return j.select("n_name", scoring.ratio_percent(F.col("k"), F.col("total")).alias("pct"), F.regexp_extract(X.format_count("big"), "[A-Z]?$", 0).alias("unit"))


RATIO_NOTE = """
WITH p AS (SELECT n_name, n_regionkey, count(*) AS k, sum(c_custkey * 1000) AS big FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, CAST(round_even(100.0 * k / sum(k) OVER (PARTITION BY n_regionkey), 0) AS BIGINT) AS pct,
  CASE WHEN big >= 1e9 THEN 'B' WHEN big >= 1e6 THEN 'M' WHEN big >= 1e3 THEN 'K' ELSE '' END AS unit FROM p
"""


def cycle_members(spark, sf_dir):
    """Nations on a cycle of the relation: some customer's nation to the next one by number in a ring of each region."""
    n = read(spark, sf_dir, "nation")
    ring = n.select(F.col("n_nationkey").alias("src"), F.when(F.col("n_nationkey") % 3 == 2, F.col("n_nationkey") - 2).otherwise(F.col("n_nationkey") + 1).alias("dst"))
    return graph.on_cycle(materialise(ring.where("dst < 25"), "ring"))


CYCLE_MEMBERS = """
WITH RECURSIVE e AS (SELECT * FROM (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey - 2 ELSE n_nationkey + 1 END AS dst FROM nation) WHERE dst < 25),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src AS id FROM r WHERE src = dst
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (author_style_diff, AUTHOR_STYLE_DIFF), (name_form_mismatch, NAME_FORM_MISMATCH), (set_diff_report, SET_DIFF_REPORT), (semi_cascade, SEMI_CASCADE),
        (anti_dangling, ANTI_DANGLING), (full_outer_agreement, FULL_OUTER_AGREEMENT), (asof_last_before, ASOF_LAST_BEFORE), (interval_locate, INTERVAL_LOCATE),
        (coupling_pairs, COUPLING_PAIRS), (coupling_components, COUPLING_COMPONENTS), (reach_closure, REACH_CLOSURE), (chain_islands, CHAIN_ISLANDS),
        (lead_licence, LEAD_LICENCE), (counter_numbering, COUNTER_NUMBERING), (interval_coverage, INTERVAL_COVERAGE), (gap_rollup, GAP_ROLLUP),
        (distinct_obligation, DISTINCT_OBLIGATION), (running_budget, RUNNING_BUDGET), (circuit_breaker, CIRCUIT_BREAKER), (first_definitions, FIRST_DEFINITIONS),
        (ratio_note, RATIO_NOTE), (cycle_members, CYCLE_MEMBERS),
    )
}
