"""Search, joins, set operations, networks, retrieval and incremental work over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import retrieval as M
from ..sources import readers
from ..streaming import ingest
from .registry import query

query("c1_cohort_predicate", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")(lambda t: t.documents.where("lang = 'en' and source = 'src1'").select("doc_id", "source", "n_chars"))
query("c2_library_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_size BETWEEN 5 AND 30")(lambda t: t.part.where(F.contains(F.lower("p_name"), F.lit("ring")) & F.col("p_size").between(5, 30)).select("p_partkey", "p_name"))
query("c3_history", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%00001%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10")(lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_name").ilike("%00001%")).orderBy(F.desc("o_orderdate"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "c_name", "o_totalprice"))
query("c5_label_census", "SELECT count(*) FILTER (text ILIKE '%th%') AS th, count(*) FILTER (text ILIKE '%(%') AS paren, count(*) AS n FROM conversations")(lambda t: t.conversations.agg(F.count_if(F.col("text").ilike("%th%")).alias("th"), F.count_if(F.col("text").ilike("%(%")).alias("paren"), F.count("*").alias("n")))
query("c6_collab_predicate", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers > 1"))
query("d1_star_join", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")(lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
query("d2_outer_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")(lambda t: t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")))
query("d3_left_terms", "SELECT vec_id, label, p_name FROM embeddings LEFT JOIN part ON label = p_partkey")(lambda t: t.embeddings.join(t.part, F.col("label") == F.col("p_partkey"), "left").select("vec_id", "label", "p_name"))
query("d4_join_to_counts", "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, n FROM orders JOIN n ON o_orderkey = l_orderkey")(lambda t: t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n"))
query("d5_pending_work", "WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM s WHERE status IN ('click', 'view')) s ON c_custkey = user_id")(lambda t: ingest.pending(t.customer.select(F.col("c_custkey").alias("source")), t.events.select(F.col("user_id").alias("source"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("finished")), done=("click", "view")).withColumnRenamed("source", "c_custkey"))
query("d6_upsert", "SELECT p_partkey, CASE WHEN l.l_partkey IS NULL THEN 'new' WHEN l.q < 100 THEN 'update' ELSE 'skip' END AS action FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) l ON p_partkey = l_partkey")(lambda t: t.part.join(t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")), F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.when(F.col("l_partkey").isNull(), "new").when(F.col("q") < 100, "update").otherwise("skip").alias("action")))


#: Line items whose pairs of suppliers are made and counted in one task.
_JOINED = 250_000


def _edges(t):
    lines = t.lineitem.where("l_orderkey is not null").select("l_orderkey", "l_suppkey")
    lines = C.in_parts(lines, "l_orderkey", t.lineitem.count(), _JOINED).distinct()
    a, b = (lines.select("l_orderkey", F.col("l_suppkey").alias(x)) for x in "xy")
    pairs = a.join(b, "l_orderkey").where("x < y")
    return C.network(pairs.select(F.format_string("Supplier%d", "x").alias("x"), F.format_string("Supplier%d", "y").alias("y")), "x", "y")


_EDGES = "WITH s AS (SELECT DISTINCT l_orderkey, 'supplier' || l_suppkey AS s, l_suppkey AS k FROM lineitem), e AS (SELECT least(a.s, b.s) AS a, greatest(a.s, b.s) AS b, count(*) AS weight FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.k < b.k GROUP BY ALL)"
query("e23_network", f"{_EDGES} SELECT * FROM e")(_edges)
query("e23_centrality", f"{_EDGES}, d AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY node) SELECT node, degree, weight, round(degree / (count(*) OVER () - 1), 6) AS centrality FROM d")(lambda t: C.degrees(_edges(t)))
query("d18_cross_cohort", f"{_EDGES}, c AS (SELECT 'supplier' || s_suppkey AS s, s_nationkey AS n FROM supplier) SELECT x.n = y.n AS same, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN c x ON e.a = x.s JOIN c y ON e.b = y.s GROUP BY same")(lambda t: _cross(t))


def _cross(t):
    c = t.supplier.select(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("s"), F.col("s_nationkey").alias("n"))
    joined = _edges(t).join(c.select(F.col("s").alias("a"), F.col("n").alias("x")), "a").join(c.select(F.col("s").alias("b"), F.col("n").alias("y")), "b")
    return joined.groupBy((F.col("x") == F.col("y")).alias("same")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


query("e22_collab_summary", "WITH o AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k, avg(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT o_orderpriority, count(*) FILTER (k = 1) AS solo, count(*) FILTER (k > 1) AS collab, round(avg(q) FILTER (k > 1) - avg(q) FILTER (k = 1), 6) AS delta FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority HAVING count(*) FILTER (k > 1) > 0")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("k"), F.avg("l_quantity").alias("q")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count_if(F.col("k") == 1).alias("solo"), F.count_if(F.col("k") > 1).alias("collab"), F.round(F.avg(F.when(F.col("k") > 1, F.col("q"))) - F.avg(F.when(F.col("k") == 1, F.col("q"))), 6).alias("delta")).where("collab > 0"))
query("e29_label_census", "SELECT role, count(*) AS n FROM conversations GROUP BY role ORDER BY n DESC, role LIMIT 100")(lambda t: t.conversations.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(100))
query("e32_catalogue", "SELECT coalesce(CAST(year(o_orderdate) AS VARCHAR), 'Unknown') AS year, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")(lambda t: t.orders.groupBy(F.coalesce(F.year("o_orderdate").cast("string"), F.lit("Unknown")).alias("year")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")))
query("e34_generations", "SELECT c_mktsegment, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")(lambda t: t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total")))
query("e35_suggested", "SELECT p_type, coalesce(round(avg(CASE WHEN p_size > 25 THEN p_size END)), 100) AS suggested FROM part GROUP BY p_type")(lambda t: t.part.groupBy("p_type").agg(F.coalesce(F.round(F.avg(F.when(F.col("p_size") > 25, F.col("p_size")))), F.lit(100.0)).alias("suggested")))
query("g1_null_safe_sort", "SELECT p_partkey, p_brand FROM part ORDER BY coalesce(p_brand, ''), lower(coalesce(p_name, '')), p_partkey LIMIT 100")(lambda t: t.part.orderBy(F.coalesce("p_brand", F.lit("")), F.lower(F.coalesce("p_name", F.lit(""))), "p_partkey").limit(100).select("p_partkey", "p_brand"))
query("g2_top_aggregate", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 10")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("s")).orderBy(F.desc("s"), "l_suppkey").limit(10).select("l_suppkey", F.round("s", 2).alias("total")))
query("g4_page", "SELECT page_id, url FROM pages ORDER BY lower(url), page_id LIMIT 20 OFFSET 10")(lambda t: t.pages.orderBy(F.lower("url"), "page_id").offset(10).limit(20).select("page_id", "url"))
query("h1_union", "SELECT o_custkey AS id, 'order' AS kind FROM orders UNION ALL SELECT user_id, 'event' FROM events")(lambda t: t.orders.select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind")).unionByName(t.events.select(F.col("user_id").alias("id"), F.lit("event").alias("kind"))))
query("h2_intersection", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")(lambda t: t.orders.select(F.col("o_custkey").alias("id")).intersect(t.events.select("user_id")))
query("h3_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda t: t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.select("o_custkey")))
query("h4_set_equality", "SELECT conv_id, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS both_only FROM conversations GROUP BY conv_id")(lambda t: t.conversations.groupBy("conv_id").agg((F.sort_array(F.collect_set("role")) == F.array(F.lit("assistant"), F.lit("user"))).alias("both_only")))
query("m2_section_documents", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id HAVING count(*) >= 2")(lambda t: t.conversations.where(F.trim("text") != "").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"), F.count("*").alias("n")).where("n >= 2"))
query("m3_topics")(lambda t: M.topics(t.embeddings, "vec_id", "embedding", 8))
query("m6_prompt_seeds", "SELECT o_orderkey, concat_ws(' - ', CAST(year(o_orderdate) AS VARCHAR), o_orderpriority) AS seed FROM orders")(lambda t: t.orders.select("o_orderkey", F.concat_ws(" - ", F.year("o_orderdate").cast("string"), "o_orderpriority").alias("seed")))
_GRAMS = r"w AS (SELECT k, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM c), g AS (SELECT k, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT k, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS t FROM tf GROUP BY term ORDER BY t DESC, term LIMIT 5000), x AS (SELECT k, term, tf * (ln((1 + (SELECT count(DISTINCT k) FROM tf)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)), v AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM x), dots AS (SELECT a.k AS item_id, -b.k - 1 AS doc_id, round(sum(a.x * b.x), 6) AS cosine FROM v a JOIN v b USING (term) WHERE a.k >= 0 AND b.k < 0 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS INTEGER) AS rank FROM dots)"
query("m1_similar_documents", f"WITH c AS (SELECT item_id AS k, text FROM benchmark UNION ALL SELECT -doc_id - 1, text FROM documents), {_GRAMS} SELECT item_id, cosine, rank FROM r WHERE rank <= 5")(lambda t: _similar(t).select("item_id", "cosine", "rank"))


def _similar(t):
    both = t.benchmark.select(F.col("item_id").alias("k"), "text").unionAll(t.documents.select(-F.col("doc_id") - 1, "text"))
    v = M.tfidf(M.ngrams(both, "k", "text"), "k", 5000)
    return M.similar(v.where("k >= 0").withColumnRenamed("k", "item_id"), v.where("k < 0").withColumn("doc_id", -F.col("k") - 1).drop("k"), "item_id", "doc_id", draft_terms=M.ngrams(t.benchmark, "item_id", "text").count())


query("a13_pages")(lambda t: readers.pages(t.pages))
query("t8_title_mismatch", r"SELECT page_id, NOT list_has_any(regexp_extract_all(lower(url), '[a-z]+'), regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+')) AS mismatch FROM pages")(lambda t: t.pages.select("page_id", (~F.arrays_overlap(F.regexp_extract_all(F.lower("url"), F.lit("[a-z]+"), 0), F.regexp_extract_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("[a-z]+"), 0))).alias("mismatch")))
query("b29_category", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND contains(p_type, 'ECONOMY') THEN 'both' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_type, 'ECONOMY') THEN 'economy' ELSE 'other' END AS category FROM part")(lambda t: t.part.select("p_partkey", F.when(F.contains("p_name", F.lit("ring")) & F.contains("p_type", F.lit("ECONOMY")), "both").when(F.contains("p_name", F.lit("ring")), "ring").when(F.contains("p_type", F.lit("ECONOMY")), "economy").otherwise("other").alias("category")))
query("b13_cohort", "SELECT doc_id, coalesce(CASE source WHEN 'src1' THEN 'north' WHEN 'src2' THEN 'south' END, CASE lang WHEN 'en' THEN 'english' ELSE 'other' END) AS cohort FROM documents")(lambda t: t.documents.join(F.broadcast(t.spark.createDataFrame([("src1", "north"), ("src2", "south")], "source string, known string")), "source", "left").select("doc_id", F.coalesce("known", F.when(F.col("lang") == "en", "english").otherwise("other")).alias("cohort")))

