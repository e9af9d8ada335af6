"""Queries over the driver's tables, one or more per operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.api import open_star, q
from triplane.operators import idoc, index, kv, search, vectors
from triplane.streaming import log
from triplane.transact import db_with, tx_log, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def datalog(name: str, tables: str, form: str, sql: str, *inputs: object, digits: dict[str, int] | None = None) -> None:
    """Registers a query in the query language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q(form, open_star(spark, sf_dir, *tables.split()), *inputs)
        return df.select(*(F.round(c, digits[c]).alias(c) if digits and c in digits else F.col(f"`{c}`") for c in df.columns))

    QUERIES[name], SQL[name] = run, sql


def native(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers a query over DataFrames."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- patterns, sources, bindings ---
datalog("pattern_constant", "customer", '[:find ?c ?n :where [?c :customer/mktsegment "BUILDING"] [?c :customer/name ?n]]', "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
datalog("pattern_has_attribute", "nation", "[:find ?e :where [?e :nation/name]]", "SELECT CAST(n_nationkey AS BIGINT) AS e FROM nation WHERE n_name IS NOT NULL")
datalog("pattern_star", "orders", "[:find ?o ?s ?p :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?p] [?o :orders/orderpriority ?r] [(> ?p 300000.0)]]", "SELECT DISTINCT o_orderkey AS o, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_totalprice > 300000.0")
datalog("pattern_entity_constant", "customer", "[:find ?n ?b :where [7 :customer/name ?n] [7 :customer/acctbal ?b]]", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7")
datalog("pattern_attribute_variable", "region", "[:find ?e ?a ?v :where [?e ?a ?v]]", "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS e, ':region/name' AS a, r_name AS v FROM region UNION SELECT CAST(r_regionkey AS BIGINT), ':region/regionkey', CAST(r_regionkey AS VARCHAR) FROM region")
datalog("pattern_lookup_ref", "region nation", '[:find ?n :where [?k :nation/regionkey [:region/regionkey 2]] [?k :nation/name ?n]]', "SELECT DISTINCT n_name AS n FROM nation WHERE n_regionkey = 2")
datalog("join_forward_ref", "orders customer", "[:find ?o ?n :where [?o :orders/custkey ?c] [?c :customer/name ?n] [?o :orders/orderstatus \"P\"]]", "SELECT DISTINCT o_orderkey AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
datalog("join_reverse_ref", "orders customer nation", '[:find ?o :where [?k :nation/name "NATION_3"] [?c :customer/nationkey ?k] [?o :orders/custkey ?c]]', "SELECT DISTINCT o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
datalog("join_value_equality", "supplier customer", "[:find ?s ?c :where [?s :supplier/nationkey ?k] [?c :customer/nationkey ?k] [?c :customer/mktsegment \"MACHINERY\"]]", "SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'MACHINERY'")
datalog("join_theta", "supplier", "[:find ?a ?b :where [?a :supplier/acctbal ?x] [?b :supplier/acctbal ?y] [?a :supplier/nationkey ?k] [?b :supplier/nationkey ?k] [(< ?x ?y)]]", "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_acctbal < b.s_acctbal")
datalog("join_product", "region", "[:find ?a ?b :where [?a :region/name] [?b :region/name] [(not= ?a ?b)]]", "SELECT DISTINCT CAST(a.r_regionkey AS BIGINT) AS a, CAST(b.r_regionkey AS BIGINT) AS b FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey")
datalog("join_five_tables", "lineitem orders customer nation region", '[:find ?rn (count ?l) :where [?l :lineitem/orderkey ?o] [?o :orders/custkey ?c] [?c :customer/nationkey ?k] [?k :nation/regionkey ?r] [?r :region/name ?rn]]', "SELECT r_name AS rn, count(*) AS count_l FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
datalog("input_scalar", "orders", "[:find ?o :in $ ?least :where [?o :orders/totalprice ?p] [(>= ?p ?least)]]", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_totalprice >= 400000.0", 400000.0)
datalog("input_collection", "customer", "[:find ?c ?s :in $ [?s ...] :where [?c :customer/mktsegment ?s]]", "SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", ["BUILDING", "MACHINERY"])
datalog("input_tuple", "customer", "[:find ?c :in $ [?s ?b] :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?a] [(> ?a ?b)]]", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000.0", ["BUILDING", 5000.0])
datalog("input_relation", "nation", "[:find ?n ?w :in $ [[?k ?w]] :where [?e :nation/nationkey ?k] [?e :nation/name ?n]]", "SELECT DISTINCT n_name AS n, w FROM nation JOIN (VALUES (1, 'one'), (2, 'two')) t(k, w) ON n_nationkey = k", [[1, "one"], [2, "two"]])
datalog("input_empty_collection", "nation", "[:find ?k :in $ [?k ...] :where [?k :nation/name _]]", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation WHERE false", [])
datalog("input_lookup_refs", "nation", "[:find ?n :in $ [?k ...] :where [?k :nation/name ?n]]", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (2, 3)", [[":nation/nationkey", 2], [":nation/nationkey", 3], [":nation/nationkey", 999]])
datalog("find_collection", "customer", "[:find [?s ...] :where [_ :customer/mktsegment ?s]]", "SELECT DISTINCT c_mktsegment AS s FROM customer")
datalog("find_scalar", "customer", "[:find ?n . :where [11 :customer/name ?n]]", "SELECT c_name AS n FROM customer WHERE c_custkey = 11")
datalog("find_tuple", "nation", "[:find [?n ?r] :where [4 :nation/name ?n] [4 :nation/regionkey ?r]]", "SELECT n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_nationkey = 4")
datalog("find_keys", "nation", "[:find ?e ?n :keys id name :where [?e :nation/name ?n]]", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
# --- boolean and set operators ---
datalog("or_clause", "orders", '[:find ?o :where (or [?o :orders/orderstatus "P"] [?o :orders/orderpriority "1-URGENT"])]', "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
datalog("or_join_clause", "orders customer", '[:find ?c :where (or-join [?c] (and [?o :orders/custkey ?c] [?o :orders/totalprice ?p] [(> ?p 450000.0)]) [?c :customer/mktsegment "FURNITURE"])]', "SELECT o_custkey AS c FROM orders WHERE o_totalprice > 450000.0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'")
datalog("not_clause", "orders customer", "[:find ?c :where [?c :customer/name] (not [_ :orders/custkey ?c])]", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
datalog("not_some_left", "orders customer", "[:find ?c :where [?c :customer/mktsegment \"BUILDING\"] (not [?o :orders/custkey ?c] [?o :orders/orderstatus \"P\"] [?o :orders/orderpriority \"1-URGENT\"])]", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
datalog("not_nested", "orders customer nation", "[:find ?c :where [?c :customer/nationkey ?k] (not [?k :nation/regionkey ?r] [(< ?r 2)] (not [?c :customer/mktsegment \"BUILDING\"]))]", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_regionkey < 2 AND c_mktsegment <> 'BUILDING')")
datalog("not_join_clause", "orders customer", "[:find ?c :where [?c :customer/acctbal ?b] [(> ?b 0.0)] (not-join [?c] [?o :orders/custkey ?c] [?o :orders/totalprice ?p] [(> ?p 200000.0)])]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 0.0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000.0)")
datalog("set_semantics", "orders", "[:find ?s ?p :where [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p]]", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
# --- aggregates ---
datalog("aggregate_all", "orders", "[:find ?s (sum ?p) (avg ?p) (min ?p) (max ?p) (count ?p) :with ?o :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?p]]", "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS sum_p, round(avg(o_totalprice), 4) AS avg_p, min(o_totalprice) AS min_p, max(o_totalprice) AS max_p, count(*) AS count_p FROM orders GROUP BY 1", digits={"sum_p": 2, "avg_p": 4})
datalog("aggregate_spread", "customer", "[:find ?s (median ?b) (variance ?b) (stddev ?b) :with ?c :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?b]]", "SELECT c_mktsegment AS s, round(median(c_acctbal), 4) AS median_b, round(var_pop(c_acctbal), 2) AS variance_b, round(stddev_pop(c_acctbal), 4) AS stddev_b FROM customer GROUP BY 1", digits={"median_b": 4, "variance_b": 2, "stddev_b": 4})
datalog("aggregate_without_with", "lineitem", "[:find (sum ?q) :where [?l :lineitem/quantity ?q]]", "SELECT round(sum(q), 2) AS sum_q FROM (SELECT DISTINCT l_quantity AS q FROM lineitem)", digits={"sum_q": 2})
datalog("aggregate_count_distinct", "orders", "[:find ?s (count-distinct ?c) :with ?o :where [?o :orders/orderstatus ?s] [?o :orders/custkey ?c]]", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS count_distinct_c FROM orders GROUP BY 1")
datalog("aggregate_top_n", "supplier", "[:find ?k (max 3 ?b) (min 2 ?b) :with ?s :where [?s :supplier/nationkey ?k] [?s :supplier/acctbal ?b]]", "SELECT CAST(s_nationkey AS BIGINT) AS k, list_sort(list_slice(list_reverse_sort(list(s_acctbal)), 1, 3)) AS max_3_b, list_slice(list_sort(list(s_acctbal)), 1, 2) AS min_2_b FROM supplier GROUP BY 1")
datalog("aggregate_distinct", "orders", "[:find ?s (distinct ?p) :where [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p]]", "SELECT o_orderstatus AS s, list_sort(list(DISTINCT o_orderpriority)) AS distinct_p FROM orders GROUP BY 1")
datalog("aggregate_expression", "orders", "[:find ?s (/ (sum ?p) (count ?o)) :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?p]]", "SELECT o_orderstatus AS s, round(sum(p) / count(o), 4) AS expr FROM (SELECT DISTINCT o_orderstatus, o_totalprice AS p, o_orderkey AS o FROM orders) GROUP BY 1", digits={"expr": 4})
datalog("aggregate_having", "orders", "[:find ?c (count ?o) :where [?o :orders/custkey ?c] :having [(> (count ?o) 15)]]", "SELECT o_custkey AS c, count(*) AS count_o FROM orders GROUP BY 1 HAVING count(*) > 15")
datalog("aggregate_empty", "orders", '[:find (count ?o) :where [?o :orders/orderstatus "none"]]', "SELECT count(*) AS count_o FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0")
datalog("aggregate_n_input", "orders", "[:find ?s (max ?n ?p) :in $ ?n :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?p]]", "SELECT o_orderstatus AS s, list_sort(list_slice(list_reverse_sort(list(DISTINCT o_totalprice)), 1, 4)) AS max_n_p FROM orders GROUP BY 1", 4)
datalog("nested_query_correlated", "customer", "[:find ?c ?b :where [?c :customer/mktsegment ?s] [(q [:find (max ?x) :in $ ?s :where [?d :customer/mktsegment ?s] [?d :customer/acctbal ?x]] $ ?s) [[?b]]] [?c :customer/acctbal ?b]]", "SELECT c_custkey AS c, c_acctbal AS b FROM customer JOIN (SELECT c_mktsegment AS s, max(c_acctbal) AS m FROM customer GROUP BY 1) ON c_mktsegment = s WHERE c_acctbal = m")
datalog("nested_query", "customer", "[:find ?c ?b :where [(q [:find (max ?x) :where [_ :customer/acctbal ?x]] $) [[?b]]] [?c :customer/acctbal ?b]]", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)")
# --- order and paging ---
datalog("order_limit", "customer", "[:find ?c ?b :where [?c :customer/acctbal ?b] :order-by [?b :desc ?c :asc] :limit 20]", "SELECT c_custkey AS c, c_acctbal AS b FROM customer ORDER BY b DESC, c LIMIT 20")
datalog("order_offset", "customer", "[:find ?c ?n :where [?c :customer/name ?n] :order-by [0 :asc] :offset 10 :limit 5]", "SELECT c_custkey AS c, c_name AS n FROM customer ORDER BY c LIMIT 5 OFFSET 10")
datalog("flagship", "orders customer nation", "[:find ?n (sum ?p) :with ?o :where [?o :orders/custkey ?c] [?o :orders/totalprice ?p] [?c :customer/nationkey ?k] [?k :nation/name ?n] [(> ?p 1000.0)] :order-by [1 :desc] :limit 5]", "SELECT n_name AS n, round(sum(o_totalprice), 2) AS sum_p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000.0 GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 5", digits={"sum_p": 2})
# --- functions and predicates ---
datalog("fn_compare_chain", "customer", "[:find ?c :where [?c :customer/acctbal ?b] [(< 100.0 ?b 900.0)] [(!= ?c 3)]]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 100.0 AND c_acctbal < 900.0 AND c_custkey <> 3")
datalog("fn_arithmetic", "customer", "[:find ?c ?x ?y ?z :where [?c :customer/nationkey ?k] [(+ ?k 7 1) ?x] [(* ?x 2) ?y] [(- ?y ?c) ?z]]", "SELECT c_custkey AS c, CAST(c_nationkey AS BIGINT) + 8 AS x, (CAST(c_nationkey AS BIGINT) + 8) * 2 AS y, (CAST(c_nationkey AS BIGINT) + 8) * 2 - c_custkey AS z FROM customer")
datalog("fn_division", "part", "[:find ?p ?q ?r ?m :where [?p :part/size ?s] [(quot ?s 7) ?q] [(rem ?s 7) ?r] [(mod ?s -7) ?m]]", "SELECT p_partkey AS p, CAST(p_size // 7 AS BIGINT) AS q, CAST(p_size % 7 AS BIGINT) AS r, CAST(((p_size % -7) + -7) % -7 AS BIGINT) AS m FROM part")
datalog("fn_big_numbers", "nation", "[:find ?k ?q ?r ?m :where [?k :nation/nationkey ?n] [(+ ?n 9007199254740993) ?b] [(quot ?b 1) ?q] [(rem ?b 10) ?r] [(mod ?b -10) ?m] [(== ?b ?q)] [(not= ?b 9007199254740994)]]", "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT + 9007199254740993 AS q, (n_nationkey::BIGINT + 9007199254740993) % 10 AS r, CASE (n_nationkey::BIGINT + 9007199254740993) % 10 WHEN 0 THEN 0 ELSE (n_nationkey::BIGINT + 9007199254740993) % 10 - 10 END AS m FROM nation WHERE n_nationkey <> 1")
datalog("fn_equal_kinds", "customer", "[:find ?c :where [?c :customer/nationkey ?k] [?c :customer/acctbal ?b] [(= ?k 3)] [(not= ?b 3)] [(== ?k 3.0)]]", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3")
datalog("fn_false_and_nil", "customer", "[:find ?c :where [?c :customer/acctbal ?b] [(> ?b 0.0) ?t] [(false? ?t)] [(not (nil? ?b))]]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal <= 0")
datalog("fn_parity", "customer", "[:find ?c ?d :where [?c :customer/custkey ?k] [(even? ?k)] [(inc ?k) ?d] [(pos? ?k)]]", "SELECT c_custkey AS c, c_custkey + 1 AS d FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 0")
datalog("fn_min_max", "part", "[:find ?p ?a ?b :where [?p :part/size ?s] [(max ?s 25) ?a] [(min ?s 10) ?b]]", "SELECT p_partkey AS p, CAST(greatest(p_size, 25) AS BIGINT) AS a, CAST(least(p_size, 10) AS BIGINT) AS b FROM part")
datalog("fn_strings", "part", '[:find ?p ?x ?y ?n :where [?p :part/name ?s] [(str ?s "-" ?p) ?x] [(subs ?s 1 4) ?y] [(count ?s) ?n]]', "SELECT p_partkey AS p, p_name || '-' || p_partkey AS x, substr(p_name, 2, 3) AS y, length(p_name) AS n FROM part")
datalog("fn_regex", "nation", '[:find ?n ?m :where [_ :nation/name ?n] [(re-find "[1-2][0-9]" ?n) ?m]]', "SELECT DISTINCT n_name AS n, regexp_extract(n_name, '[1-2][0-9]') AS m FROM nation WHERE regexp_matches(n_name, '[1-2][0-9]')")
datalog("fn_re_matches", "nation", '[:find ?n :where [_ :nation/name ?n] [(re-matches "NATION_[0-9]" ?n)]]', "SELECT n_name AS n FROM nation WHERE regexp_full_match(n_name, 'NATION_[0-9]')")
datalog("fn_like", "nation", '[:find ?n :where [_ :nation/name ?n] [(like ?n "NATION!_1%")]]', "SELECT n_name AS n FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
datalog("fn_not_like", "nation", '[:find ?n :where [_ :nation/name ?n] [(not-like ?n "%2_")]]', "SELECT n_name AS n FROM nation WHERE n_name NOT LIKE '%2_'")
datalog("fn_in", "orders", '[:find ?o :where [?o :orders/orderpriority ?p] [(in ?p ["1-URGENT" "2-HIGH"])] [?o :orders/orderstatus ?s] [(not-in ?s ["O"])]]', "SELECT o_orderkey AS o FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('O')")
datalog("fn_logic", "customer", "[:find ?c :where [?c :customer/acctbal ?b] [?c :customer/nationkey ?k] [(or (and (> ?b 9000.0) (< ?k 10)) (not (>= ?b 0.0)))]]", "SELECT c_custkey AS c FROM customer WHERE (c_acctbal > 9000.0 AND c_nationkey < 10) OR NOT c_acctbal >= 0.0")
datalog("fn_collection_binding", "region", "[:find ?r ?x :where [?r :region/name] [(range 1 4) [?x ...]]]", "SELECT CAST(r_regionkey AS BIGINT) AS r, x FROM region, (SELECT unnest([1, 2, 3])::BIGINT AS x)")
datalog("fn_tuple_binding", "nation", '[:find ?n ?x ?y :where [_ :nation/name ?n] [(count ?n) ?c] [(vector ?c ?n) [?x ?y]]]', "SELECT n_name AS n, length(n_name) AS x, n_name AS y FROM nation")
datalog("fn_relation_binding", "nation", "[:find ?n ?w :where [(ground [[1 10] [2 20]]) [[?k ?w]]] [?k :nation/name ?n]]", "SELECT n_name AS n, w::BIGINT AS w FROM nation JOIN (VALUES (1, 10), (2, 20)) t(k, w) ON n_nationkey = k")
datalog("fn_compare_function", "customer", "[:find ?c ?x :where [?c :customer/acctbal ?b] [(compare ?b 5000.0) ?x]]", "SELECT c_custkey AS c, CAST(CASE WHEN c_acctbal < 5000.0 THEN -1 WHEN c_acctbal > 5000.0 THEN 1 ELSE 0 END AS BIGINT) AS x FROM customer")
datalog("fn_get_else", "documents labels", "[:find ?d ?t :where [?d :documents/lang ?l] [(get-else $ ?d :labels/toxic -1) ?t]]", "SELECT d.doc_id AS d, CAST(coalesce(toxic, -1) AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
datalog("fn_missing", "documents labels", "[:find ?d :where [?d :documents/lang] [(missing? $ ?d :labels/toxic)]]", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)")
datalog("fn_get_some", "documents labels", "[:find ?d ?a ?v :where [?d :documents/lang] [(get-some $ ?d :labels/quality :documents/n_chars) [?a ?v]]]", "SELECT d.doc_id AS d, CASE WHEN quality IS NOT NULL THEN ':labels/quality' ELSE ':documents/n_chars' END AS a, CAST(coalesce(quality, n_chars) AS BIGINT) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
datalog("fn_java_methods", "nation", '[:find ?n ?l :where [_ :nation/name ?n] [(.endsWith ?n "1")] [(.toLowerCase ?n) ?l]]', "SELECT n_name AS n, lower(n_name) AS l FROM nation WHERE n_name LIKE '%1'")
datalog("fn_text_library", "nation", '[:find ?x :where [_ :nation/name ?n] [(clojure.string/replace ?n "NATION" "N") ?r] [(clojure.string/lower-case ?r) ?x]]', "SELECT DISTINCT lower(replace(n_name, 'NATION', 'N')) AS x FROM nation")
datalog("fn_sign_tests", "customer", "[:find ?c :where [?c :customer/acctbal ?b] [?c :customer/nationkey ?k] [(neg? ?b)] [(zero? ?k)]]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0 AND c_nationkey = 0")
datalog("fn_odd_complement", "nation", "[:find ?k :where [?k :nation/name] [((complement even?) ?k)]]", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey % 2 = 1")
datalog("fn_differ", "nation", "[:find ?k :where [?k :nation/regionkey ?r] [(-differ? ?k ?r 1 1)]]", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey <> 1 OR n_regionkey <> 1")
datalog("fn_re_seq", "nation", '[:find ?n ?x :where [_ :nation/name ?n] [(re-seq "[0-9]" ?n) [?x ...]]]', "SELECT DISTINCT n_name AS n, unnest(regexp_extract_all(n_name, '[0-9]')) AS x FROM nation")
datalog("fn_map_lookup", "nation", '[:find ?k ?v :where [?k :nation/regionkey ?r] [(str "r" ?r) ?s] [(get {"r1" "one" "r2" "two"} ?s) ?v]]', "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_regionkey WHEN 1 THEN 'one' ELSE 'two' END AS v FROM nation WHERE n_regionkey IN (1, 2)")
datalog("fn_apply", "embeddings", "[:find ?e ?n ?m :where [?e :embeddings/embedding ?v] [(count ?v) ?n] [(apply max ?v) ?x] [(>= ?x 0.0)] [(not-empty ?v) _] [(quot ?n 2) ?m]]", "SELECT vec_id AS e, CAST(len(embedding) AS BIGINT) AS n, CAST(len(embedding) // 2 AS BIGINT) AS m FROM embeddings WHERE list_max(embedding) >= 0")
datalog("fn_keyword_parts", "nation", '[:find ?n ?x ?y :where [_ :nation/name ?n] [(keyword "nation" ?n) ?k] [(name ?k) ?x] [(namespace ?k) ?y]]', "SELECT n_name AS n, n_name AS x, 'nation' AS y FROM nation")
datalog("fn_printing", "nation", '[:find ?n ?x ?y :where [?k :nation/name ?n] [(print-str ?n ?k) ?x] [(pr-str ?n ?k) ?y]]', "SELECT n_name AS n, n_name || ' ' || n_nationkey AS x, '\"' || n_name || '\" ' || n_nationkey AS y FROM nation")
datalog("fn_identity_tests", "customer", "[:find ?c :where [?c :customer/name ?n] [?c :customer/acctbal ?b] [(some? ?n)] [(> ?b 9000.0) ?t] [(true? ?t)] [(identity ?b) ?x] [(identical? ?x ?b)]]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000.0")
datalog("fn_set_and_range", "region", "[:find ?r ?x :where [?r :region/name] [(range 10 0 -5) [?x ...]]]", "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(x AS BIGINT) AS x FROM region, (SELECT unnest([10, 5]) AS x)")
datalog("source_collection", "nation", "[:find ?n ?t :in $ $b :where [?k :nation/name ?n] [$b ?k ?t]]", "SELECT n_name AS n, t FROM nation JOIN (VALUES (1, 'a'), (2, 'b')) v(k, t) ON n_nationkey = k", [[1, "a"], [2, "b"]])
# --- rules ---
_PLACE = "[[(in-region ?c ?r) [?c :customer/nationkey ?n] [?n :nation/regionkey ?r]]]"
datalog("rule_inlined", "customer nation", "[:find ?c :in $ % :where (in-region ?c 1)]", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", _PLACE)
datalog("rule_branches", "customer supplier", "[:find ?e :in $ % :where (rich ?e)]", "SELECT c_custkey AS e FROM customer WHERE c_acctbal > 9000.0 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000.0", "[[(rich ?e) [?e :customer/acctbal ?b] [(> ?b 9000.0)]] [(rich ?e) [?e :supplier/acctbal ?b] [(> ?b 9000.0)]]]")
datalog("rule_recursive", "nation", "[:find ?x ?y :in $ % :where (chain ?x ?y) [(< ?x 6)]]", "WITH RECURSIVE s AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 3 AS BIGINT) AS b FROM nation), t(x, y) AS (SELECT a, b FROM s UNION SELECT t.x, s.b FROM t JOIN s ON t.y = s.a) SELECT x, y FROM t WHERE x < 6", "[[(step ?x ?y) [?x :nation/name] [(+ ?x 3) ?y]] [(chain ?x ?y) (step ?x ?y)] [(chain ?x ?y) (chain ?x ?t) (step ?t ?y)]]")
datalog("rule_mutual", "nation", "[:find ?x :in $ % :where (even-step ?x)]", "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey % 4 = 0", "[[(even-step ?x) [?x :nation/nationkey ?k] [(= ?k 0)]] [(even-step ?x) (odd-step ?y) [(+ ?y 2) ?x] [?x :nation/name]] [(odd-step ?x) (even-step ?y) [(+ ?y 2) ?x] [?x :nation/name]]]")
datalog("rule_negated_some_left", "customer orders", "[:find ?c :in $ % :where [?c :customer/mktsegment \"BUILDING\"] (not (urgent ?c))]", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000.0)", '[[(urgent ?c) [?o :orders/custkey ?c] [?o :orders/orderpriority "1-URGENT"] [?o :orders/totalprice ?p] [(> ?p 300000.0)]]]')
datalog("rule_negated", "customer orders", "[:find ?c :in $ % :where [?c :customer/name] (not (ordered ?c))]", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "[[(ordered ?c) [_ :orders/custkey ?c]]]")


# --- index access and key-value tables ---
def _one(spark: SparkSession, kind: str, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], kind)


@native("index_datoms", "SELECT CAST(n_nationkey AS BIGINT) AS e, ':nation/name' AS a, n_name AS v FROM nation WHERE n_name = 'NATION_5'")
def _datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.datoms(open_star(spark, sf_dir, "nation"), ":ave", ":nation/name", "NATION_5")


@native("index_seek", "SELECT c_custkey AS e, ':customer/acctbal' AS a, c_acctbal AS v FROM customer WHERE c_acctbal >= 9500.0")
def _seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.seek_datoms(open_star(spark, sf_dir, "customer"), ":ave", ":customer/acctbal", 9500.0)


@native("index_rseek", "SELECT c_custkey AS e, ':customer/acctbal' AS a, c_acctbal AS v FROM customer WHERE c_acctbal <= -500.0 ORDER BY v DESC, e DESC LIMIT 10")
def _rseek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rseek_datoms(open_star(spark, sf_dir, "customer"), ":ave", ":customer/acctbal", -500.0, n=10)


@native("index_range", "SELECT p_partkey AS e, ':part/size' AS a, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size BETWEEN 10 AND 12")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_range(open_star(spark, sf_dir, "part"), ":part/size", 10, 12)


@native("index_counts", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS priorities, (SELECT max(o_orderkey) FROM orders) AS top")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "orders")
    return _one(spark, "n long, priorities long, top long", n=index.count_datoms(db, a=":orders/orderstatus", v="F"), p=index.cardinality(db, ":orders/orderpriority"), t=index.max_eid(db))


def _kv(spark: SparkSession, sf_dir: str) -> kv.Dbi:
    return kv.Dbi(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))


def _lists(spark: SparkSession, sf_dir: str) -> kv.ListDbi:
    return kv.ListDbi(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")).distinct())


native("kv_range", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey >= 10 AND c_custkey < 50")(lambda s, d: _kv(s, d).range([":closed-open", 10, 50]))
native("kv_range_back", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey <= 90 ORDER BY k DESC LIMIT 7")(lambda s, d: _kv(s, d).get_first_n(7, [":at-most-back", 90]))
native("kv_rank", "SELECT c_custkey AS k, c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer")(lambda s, d: _kv(s, d).ranked())
native("kv_filter", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey > 20 AND c_acctbal < 0")(lambda s, d: _kv(s, d).range_filter(lambda k, v: v < 0, [":greater-than", 20]))
native("kv_keep", "SELECT c_custkey * 2 AS x FROM customer WHERE c_acctbal > 9000")(lambda s, d: _kv(s, d).range_keep(lambda k, v: F.when(v > 9000, k * 2)))
native("kv_transact", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (1, 2) UNION ALL SELECT 2, 7.5")(lambda s, d: _kv(s, d).transact([(":put", 2, 1.5), (":del", 1), (":put", 2, 7.5)]).df)
native("kv_list_range", "SELECT DISTINCT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey BETWEEN 5 AND 25 AND o_orderkey > 100")(lambda s, d: _lists(s, d).list_range([":closed", 5, 25], [":greater-than", 100]))
native("kv_list_counts", "SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")(lambda s, d: _lists(s, d).df.groupBy("k").agg(F.count("*").alias("n")))
native("kv_list_count", "SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_custkey = 7")(lambda s, d: _one(s, "n long", n=_lists(s, d).list_count(7)))
native("index_search", "SELECT CAST(n_nationkey AS BIGINT) AS e, ':nation/regionkey' AS a, CAST(n_regionkey AS BIGINT) AS v FROM nation WHERE n_regionkey = 2")(lambda s, d: index.search_datoms(open_star(s, d, "nation"), a=":nation/regionkey", v=2))


# --- pull ---
@native("pull_references", "SELECT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS nation, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def _pull_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = '[:find ?c (pull ?c [{:customer/nationkey [:db/id :nation/name]}]) :where [?c :customer/mktsegment "BUILDING"]]'
    at = F.col("pull_c").getField(":customer/nationkey")
    return q(form, open_star(spark, sf_dir, "customer", "nation")).select("c", at.getField(":db/id").alias("nation"), at.getField(":nation/name").alias("name"))


@native("pull_flat", "SELECT c_custkey AS c, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_acctbal > 8000")
def _pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = q("[:find ?c (pull ?c [:customer/name [:customer/mktsegment :as segment]]) :where [?c :customer/acctbal ?b] [(> ?b 8000)]]", open_star(spark, sf_dir, "customer"))
    return df.select("c", F.col("pull_c").getField(":customer/name").alias("name"), F.col("pull_c").getField("segment").alias("segment"))


@native("pull_reverse", "SELECT n_nationkey::BIGINT AS k, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _pull_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = q("[:find ?k (pull ?k [(limit :customer/_nationkey nil)]) :where [?k :nation/name]]", open_star(spark, sf_dir, "nation", "customer"))
    return df.select("k", F.size(F.col("pull_k").getField(":customer/_nationkey")).cast("long").alias("n")).where("n > 0")


# --- search, vectors, documents ---
def _term_sql(words: list[str], top: int) -> str:
    marks = ", ".join(f"'{w}'" for w in words)
    stop = ", ".join(f"'{w}'" for w in sorted(search.STOP_WORDS))
    return f"""WITH w AS (SELECT doc_id AS doc, unnest(string_split_regex(lower(text), '[\\s:/.;,!=?"''()\\[\\]{{}}|<>&@#^*\\\\~`]+')) AS term FROM documents),
    t AS (SELECT doc, term, count(*) AS tf FROM w WHERE term <> '' AND length(term) < 128 AND term NOT IN ({stop}) GROUP BY ALL),
    norm AS (SELECT doc, count(*) AS norm FROM t GROUP BY 1), df AS (SELECT term, count(*) AS df FROM t WHERE term IN ({marks}) GROUP BY 1),
    s AS (SELECT t.doc, count(*) AS n, sum(log10((SELECT count(*) FROM norm) / df) * (1 + log10(tf))) / any_value(norm) AS score FROM t JOIN df USING (term) JOIN norm ON norm.doc = t.doc GROUP BY 1)
    SELECT doc, round(score, 6) AS score FROM s ORDER BY n DESC, score DESC, doc LIMIT {top}"""


def _documents(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.kept(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text"), "documents.text")


def _words(spark: SparkSession, sf_dir: str) -> search.Index:
    """The documents' words as regular expressions bound them."""
    return search.kept(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text"), "documents.text by words", search.words)


native("search_terms", _term_sql(["license", "idiot", "version"], 10))(lambda s, d: search.search(_documents(s, d), "license idiot version", 10).withColumn("score", F.round("score", 6)))
native("search_boolean", "SELECT DISTINCT doc_id AS doc FROM documents WHERE regexp_matches(text, '(?i)\\blicense\\b') AND NOT regexp_matches(text, '(?i)\\bmit\\b')")(lambda s, d: search.search(_words(s, d), [":and", "license", [":not", "mit"]], None).select("doc"))
native("search_phrase", "SELECT doc_id AS doc FROM documents WHERE regexp_matches(text, '(?i)\\bgeneral public license\\b')")(lambda s, d: search.search(_words(s, d), {":phrase": "general public license"}, None).select("doc"))

_NEAR = {"euclidean": "list_sum(list_transform(list_zip(e, t), lambda x: (x[1] - x[2]) * (x[1] - x[2])))", "cosine": "1 - list_sum(list_transform(list_zip(e, t), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(t, lambda x: x * x)))", "dot-product": "1 - list_sum(list_transform(list_zip(e, t), lambda x: x[1] * x[2]))"}
for _metric, _sql in _NEAR.items():

    def _near(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        query = rows.where("vec_id = 3").first().embedding
        return vectors.neighbors(rows, "embedding", query, 10, metric, key="vec_id").select("vec_id", (F.round("dist", 4) + 0.0).alias("dist"))

    native(f"vector_{_metric.replace('-', '_')}", f"WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3) AS t FROM embeddings) SELECT vec_id, round({_sql}, 4) + 0.0 AS dist FROM d ORDER BY {_sql}, vec_id LIMIT 10")(_near)


@native("idoc_match", "SELECT event_id AS e FROM events WHERE json_extract(props, '$.k')::BIGINT = 69")
def _idoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q("[:find ?e :where [(idoc-match $ :events/props {:k 69}) [[?e _ _]]]]", open_star(spark, sf_dir, "events"))


@native("idoc_match_pattern", "SELECT event_id AS e, event_type AS t FROM events WHERE json_extract(props, '$.k')::BIGINT = 69 AND event_type <> 'view'")
def _idoc_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q('[:find ?e ?t :where [?e :events/event_type ?t] [(not= ?t "view")] [(idoc-match $ :events/props {:k 69}) [[?e _ _]]]]', open_star(spark, sf_dir, "events"))


@native("fulltext_pattern", "SELECT doc_id AS d, lang AS l FROM documents WHERE regexp_matches(text, '(?i)\\blicense\\b') AND lang = 'en'")
def _fulltext_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "documents")
    db.indexes[":documents/text"] = _words(spark, sf_dir)
    return q('[:find ?d ?l :where [?d :documents/lang ?l] [(= ?l "en")] [(fulltext $ :documents/text "license" {:top nil}) [[?d _ _]]]]', db)


@native("vector_pattern", f"WITH d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3) AS t FROM embeddings) SELECT vec_id AS e, CAST(label AS BIGINT) AS l FROM (SELECT * FROM d ORDER BY {_NEAR['euclidean']}, vec_id LIMIT 40)")
def _vector_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "embeddings")
    query = [float(x) for x in db.tables["embeddings"].where("e = 3").first().embedding]
    return q("[:find ?e ?l :in $ ?v :where [?e :embeddings/label ?l] [(vec-neighbors $ :embeddings/embedding ?v {:top 40}) [[?e _ _]]]]", db, query)


@native("vector_all_queries", f"""WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, {_NEAR['cosine'].replace('list_zip(e, t)', 'list_zip(b.e, a.e)').replace('list_transform(e,', 'list_transform(b.e,').replace('list_transform(t,', 'list_transform(a.e,')} AS dist FROM d a, d b WHERE a.vec_id % 20 = 0)
    SELECT query, id, round(dist, 4) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS n FROM p) WHERE n <= 10""")
def _vector_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vectors.nearest(rows, "embedding", rows.where("vec_id % 20 = 0"), "vec_id", 10, "cosine").select("query", "id", (F.round("dist", 4) + 0.0).alias("dist"))


@native("idoc_range", "SELECT event_id AS e FROM events WHERE json_extract(props, '$.k')::BIGINT > 90")
def _idoc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return idoc.filtered(rows, F.col("props"), "{:k (> 90)}").select(F.col("event_id").alias("e"))


@native("idoc_get", "SELECT event_id AS e, json_extract_string(props, '$.k') AS k FROM events")
def _idoc_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("e"), idoc.get(F.col("props"), "k").alias("k"))


@native("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", "event_type")


# --- transactions ---
_NATIONS = "[:find ?e ?n ?r :where [?e :nation/name ?n] [?e :nation/regionkey ?r]]"


@native("transact_add", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 3 THEN 'RENAMED' ELSE n_name END AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation UNION ALL SELECT 40, 'ADDED', 2")
def _transact_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "nation")
    return q(_NATIONS, db_with(db, [[":db/add", 3, ":nation/name", "RENAMED"], {":db/id": 40, ":nation/name": "ADDED", ":nation/regionkey": 2}]))


@native("transact_retract", "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_nationkey NOT IN (5, 6)")
def _transact_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "nation")
    return q(_NATIONS, db_with(db, [[":db/retractEntity", 5], [":db/retract", 6, ":nation/name"]]))


@native("transact_upsert", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 7 THEN 'SEVEN' ELSE n_name END AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation")
def _transact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(_NATIONS, db_with(open_star(spark, sf_dir, "nation"), [{":nation/nationkey": 7, ":nation/name": "SEVEN"}]))


@native("transact_report", "SELECT CAST(1 AS BIGINT) AS tx, CAST(3 AS BIGINT) AS e, ':nation/name' AS a, n_name AS v, false AS added FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, 3, ':nation/name', 'X', true")
def _transact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_log(spark, [with_(open_star(spark, sf_dir, "nation"), [[":db/add", 3, ":nation/name", "X"]])])


import triplane.queries_more  # noqa: E402, F401  registers its queries
