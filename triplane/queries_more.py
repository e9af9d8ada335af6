"""More queries over the driver's tables: operators whose results come to the driver, change tables or go through files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.api import answer, connect, entity, open_star, q
from triplane.functions.aggregates import CUSTOM
from triplane.functions.registry import REGISTRY
from triplane.operators import analysis, idoc, index, kv, pull, search, vectors
from triplane.queries import _NEAR, _kv, _lists, _one, datalog, native
from triplane.sources import files
from triplane.storage import shared_folder
from triplane.streaming import log
from triplane.transact import Connection, db_with, with_


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/queries/{uuid.uuid4().hex}"


def _listed(spark: SparkSession, kind: str, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), kind)


# --- key-value tables ---
native("kv_get_value", "SELECT c_acctbal AS v FROM customer WHERE c_custkey = 5")(lambda s, d: _one(s, "v double", v=_kv(s, d).get_value(5)))
native("kv_key_range", "SELECT c_custkey AS k FROM customer WHERE c_custkey BETWEEN 3 AND 9")(lambda s, d: _kv(s, d).key_range([":closed", 3, 9]).select("k"))
native("kv_counts", "SELECT count(*) AS n, least(count(*), 4) AS capped, count(*) FILTER (c_acctbal < 0) AS few FROM customer WHERE c_custkey >= 20")(
    lambda s, d: _one(s, "n long, capped long, few long", n=_kv(s, d).range_count([":at-least", 20]), capped=_kv(s, d).key_range_count([":at-least", 20], 4), few=_kv(s, d).range_filter_count(lambda k, v: v < 0, [":at-least", 20]))
)
native("kv_rank_of", "SELECT (SELECT count(*) FROM customer WHERE c_custkey < 7) AS rank, c_custkey AS k FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 4")(lambda s, d: _one(s, "rank long, k long", rank=_kv(s, d).get_rank(7), k=_kv(s, d).get_by_rank(4).k))
native("kv_first", "SELECT max(c_custkey) AS last, min(c_custkey) AS first FROM customer")(lambda s, d: _one(s, "last long, first long", last=_kv(s, d).get_first([":all-back"]).k, first=_kv(s, d).get_first().k))
native("kv_some", "SELECT min(c_custkey) AS k, min(c_custkey) * 10 AS x FROM customer WHERE c_acctbal > 5000")(
    lambda s, d: _one(s, "k long, x long", k=_kv(s, d).get_some(lambda k, v: v > 5000).k, x=_kv(s, d).range_some(lambda k, v: F.when(v > 5000, k * 10)))
)


@native("kv_visit", "SELECT c_custkey AS k FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 5")
def _visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[tuple] = []
    _kv(spark, sf_dir).visit(lambda k, v: seen.append((k,)) or len(seen) < 5, [":greater-than", 10])
    return _listed(spark, "k long", seen)


native("kv_sample", "SELECT CAST(10 AS BIGINT) AS n")(lambda s, d: _one(s, "n long", n=_kv(s, d).sample(10).join(_kv(s, d).df, ["k", "v"]).distinct().count()))
native("kv_list_get", "SELECT DISTINCT o_orderkey AS v FROM orders WHERE o_custkey = 7")(lambda s, d: _lists(s, d).get_list(7))
native("kv_list_change", "SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) + 2 AS n, CAST(0 AS BIGINT) AS gone FROM orders WHERE o_custkey = 7")(
    lambda s, d: _one(s, "n long, gone long", n=_lists(s, d).put_list_items(7, [-1, -2, -3]).del_list_items(7, [-2]).list_count(7), gone=_lists(s, d).del_list_items(7).list_count(7))
)
native("kv_list_near", "SELECT min(o_orderkey) AS near, count(*) > 0 AS here FROM orders WHERE o_custkey = 7 AND o_orderkey >= 100")(
    lambda s, d: _one(s, "near long, here boolean", near=_lists(s, d).near_list(7, 100), here=_lists(s, d).in_list(7, _lists(s, d).near_list(7, 100)))
)
native("kv_list_filter", "SELECT DISTINCT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey < 9 AND o_orderkey % 2 = 0")(lambda s, d: _lists(s, d).list_range_filter(lambda k, v: v % 2 == 0, [":less-than", 9]))
native("kv_list_keep", "SELECT DISTINCT o_custkey * 1000000 + o_orderkey AS x FROM orders WHERE o_custkey < 9 AND o_orderkey % 2 = 0")(lambda s, d: _lists(s, d).list_range_keep(lambda k, v: F.when(v % 2 == 0, k * 1000000 + v), [":less-than", 9]))
native("kv_list_range_counts", "SELECT count(*) AS n, count(*) FILTER (v % 3 = 0) AS thirds FROM (SELECT DISTINCT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey BETWEEN 2 AND 30 AND o_orderkey > 50)")(
    lambda s, d: _one(s, "n long, thirds long", n=_lists(s, d).list_range_count([":closed", 2, 30], [":greater-than", 50]), t=_lists(s, d).list_range_filter_count(lambda k, v: v % 3 == 0, [":closed", 2, 30], [":greater-than", 50]))
)
native("kv_list_first", "SELECT DISTINCT o_custkey AS k, o_orderkey AS v FROM orders ORDER BY k DESC, v LIMIT 3")(lambda s, d: _lists(s, d).list_range_first_n(3, [":all-back"]))


@native("kv_list_visit", "SELECT DISTINCT o_orderkey AS v FROM orders WHERE o_custkey = 7 ORDER BY v LIMIT 3")
def _visit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[tuple] = []
    _lists(spark, sf_dir).visit_list(lambda v: seen.append((v,)) or len(seen) < 3, 7)
    return _listed(spark, "v long", seen)


@native("kv_folder", "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey WHEN 3 THEN 'three' ELSE n_name END AS v FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 77, 'more'")
def _kv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    store = kv.open_kv(spark, folder)
    store.open_dbi("nations", "long", "string")
    store.transact_kv("nations", [(":put", r.n_nationkey, r.n_name) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()])  # 25 rows
    store.transact_kv_async("nations", [(":put", 3, "three"), (":del", 4)]).result()
    with store.with_transaction_kv() as tx:
        tx.transact_kv("nations", [(":put", 77, "more")])
    with store.with_transaction_kv() as tx:
        tx.transact_kv("nations", [(":put", 78, "never")])
        tx.abort_transact_kv()
    return kv.open_kv(spark, folder).dbis["nations"].df.select("k", "v")


native("kv_hexify", "SELECT upper(hex(encode('key ñ'))) AS x, 'key ñ' AS back")(lambda s, d: _one(s, "x string, back string", x=kv.hexify("key ñ"), back=kv.unhexify(kv.hexify("key ñ"))))

# --- index access and bulk loads ---
native("index_entid", "SELECT CAST(3 AS BIGINT) AS e, CAST(count(*) AS BIGINT) AS attributes FROM (DESCRIBE nation)")(
    lambda s, d: _one(s, "e long, attributes long", e=index.entid(open_star(s, d, "nation"), (":nation/nationkey", 3)), a=len(index.schema(open_star(s, d, "nation"))))
)
native("index_opts", "SELECT 'nation' AS tables, CAST(3 AS BIGINT) AS attributes")(lambda s, d: (lambda o: _one(s, "tables string, attributes long", t=",".join(o[":tables"]), a=o[":attributes"]))(index.opts(open_star(s, d, "nation"))))
native("index_analyze", "SELECT ':nation/name' AS a, count(*) AS facts, min(n_name) AS least, max(n_name) AS greatest FROM nation")(lambda s, d: index.analyze(open_star(s, d, "nation"), ":nation/name").select("a", "facts", "least", "greatest"))

_NATION = {":name": {":db/valueType": ":db.type/string"}, ":region": {":db/valueType": ":db.type/ref"}, ":tag": {":db/valueType": ":db.type/string", ":db/cardinality": ":db.cardinality/many"}}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of nations as rows ``e, a, v``."""
    cell = lambda a, v: F.struct(F.lit(a).alias("a"), F.col(v).cast("string").alias("v"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("odd", F.when(F.col("n_nationkey") % 2 == 1, "odd"))
    return rows.select(F.col("n_nationkey").cast("long").alias("e"), F.explode(F.array(cell(":name", "n_name"), cell(":region", "n_regionkey"), cell(":tag", "n_name"), cell(":tag", "odd"))).alias("x")).select("e", "x.a", "x.v").where("v is not null")


@native("bulk_init", "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_nationkey % 2 = 1")
def _init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q('[:find ?e ?n ?r :where [?e :name ?n] [?e :region ?r] [?e :tag "odd"]]', files.init_db(_facts(spark, sf_dir), _NATION))


@native("bulk_fill", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 2 THEN 'changed' ELSE n_name END AS n FROM nation UNION ALL SELECT 99, 'new'")
def _fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _listed(spark, "e long, a string, v string", [(2, ":name", "changed"), (99, ":name", "new"), (2, ":tag", "x")])
    return q("[:find ?e ?n :where [?e :name ?n]]", files.fill_db(files.init_db(_facts(spark, sf_dir), _NATION), more))


def _through(write: Callable[[Any, str], None], read: Callable[[SparkSession, str], Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        write(files.init_db(_facts(spark, sf_dir), _NATION), folder)
        return q("[:find ?e ?n ?r ?t :where [?e :name ?n] [?e :region ?r] [?e :tag ?t]]", read(spark, folder))

    return run


_ALL = "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS n, CAST(n_regionkey AS BIGINT) AS r, t FROM nation, (SELECT unnest(CASE WHEN n.n_nationkey % 2 = 1 THEN [n.n_name, 'odd'] ELSE [n.n_name] END) AS t, n.n_nationkey AS k FROM nation n) WHERE k = n_nationkey"
native("dump_and_load", _ALL)(_through(files.dump, files.load))
native("dump_as_text", _ALL)(_through(files.dump_text, files.load_text))
native("copy_database", _ALL)(_through(files.dump, lambda s, f: files.copy(files.load(s, f), _folder(s))))


@native("csv_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || ', \"quoted\"' AS n FROM nation")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.concat("n_name", F.lit(', "quoted"')).alias("n"))
    files.write_csv(rows, folder, header=True)
    return files.read_csv(spark, folder, header=True, schema="k long, n string")


# --- functions ---
REGISTRY.register("doubled", lambda x: x * 2)
CUSTOM["spread"] = lambda c: F.max(c) - F.min(c)
datalog("fn_rand_int", "nation", "[:find ?k :where [?k :nation/name] [(rand-int 10) ?x] [(<= 0 ?x 9)] [(rand) ?y] [(< ?y 1.0)]]", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation")
datalog("fn_udf", "nation", '[:find ?k ?x :where [?k :nation/regionkey ?r] [(udf "doubled" ?r) ?x]]', "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) * 2 AS x FROM nation")
datalog("fn_input_function", "nation", "[:find ?k ?x :in $ ?f ?p :where [?k :nation/regionkey ?r] [(?f ?r) ?x] [(?p ?x)]]", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) + 5 AS x FROM nation WHERE n_regionkey > 1", lambda r: r + 5, lambda x: x > 6)
datalog("fn_found_groups", "nation", '[:find ?n ?x :where [_ :nation/name ?n] [(re-find "([A-Z]+)_([0-9])" ?n) [_ _ ?x]]]', "SELECT n_name AS n, regexp_extract(n_name, '([A-Z]+)_([0-9])', 2) AS x FROM nation")
datalog("fn_by_name", "nation", "[:find ?k ?x ?y :where [?k :nation/regionkey ?r] [(doubled ?r) ?x] [(clojure.core/inc ?x) ?y]]", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) * 2 AS x, CAST(n_regionkey AS BIGINT) * 2 + 1 AS y FROM nation")
datalog("fn_text_places", "nation", '[:find ?n ?a ?b ?c ?d :where [_ :nation/name ?n] [(clojure.string/index-of ?n "N" 1) ?a] [(clojure.string/last-index-of ?n "N") ?b] [(clojure.string/replace-first ?n "N" "M") ?c] [(.indexOf ?n "zz") ?d]]', "SELECT n_name AS n, CAST(instr(substr(n_name, 2), 'N') AS BIGINT) AS a, CAST(length(n_name) - instr(reverse(n_name), 'N') AS BIGINT) AS b, 'M' || substr(n_name, 2) AS c, CAST(-1 AS BIGINT) AS d FROM nation")
datalog("fn_more_methods", "nation", '[:find ?n ?x ?y ?z :where [_ :nation/name ?n] [(.matches ?n "NATION_1.*")] [(.charAt ?n 7) ?x] [(.replaceAll ?n "[0-9]+" "#") ?y] [(.concat ?y "!") ?z] [(.equalsIgnoreCase ?y "nation_#")]]', "SELECT n_name AS n, substr(n_name, 8, 1) AS x, regexp_replace(n_name, '[0-9]+', '#', 'g') AS y, regexp_replace(n_name, '[0-9]+', '#', 'g') || '!' AS z FROM nation WHERE n_name LIKE 'NATION_1%'")
datalog("aggregate_custom", "customer", "[:find ?s (spread ?b) :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?b]]", "SELECT c_mktsegment AS s, round(max(c_acctbal) - min(c_acctbal), 2) AS spread_b FROM customer GROUP BY 1", digits={"spread_b": 2})
datalog("aggregate_input_function", "customer", "[:find ?s (aggregate ?f ?b) :in $ ?f :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?b]]", "SELECT c_mktsegment AS s, max(c_acctbal) AS aggregate_f_b FROM customer GROUP BY 1", F.max)
native("aggregate_sample", "SELECT c_mktsegment AS s, CAST(3 AS BIGINT) AS n, CAST(5 AS BIGINT) AS m FROM customer GROUP BY 1")(
    lambda s, d: q("[:find ?s (sample 3 ?c) (rand 5 ?c) :where [?c :customer/mktsegment ?s]]", open_star(s, d, "customer")).select("s", F.size(F.array_distinct(F.col("sample_3_c"))).cast("long").alias("n"), F.size("rand_5_c").cast("long").alias("m"))
)
datalog("source_scoped", "nation", "[:find ?n :in $ $b :where [?k :nation/name ?n] (not-join [?k] [$b ?k ?t])]", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (1, 2)", [[1, "a"], [2, "b"]])

# --- rules ---
datalog("rule_predicate_argument", "customer", "[:find ?c :in $ % ?p :where (fits ?p ?c)]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9500", "[[(fits ?p ?c) [?c :customer/acctbal ?b] [(?p ?b)]]]", lambda b: b > 9500)
_STEPS = "[[(step ?x ?y) [?x :nation/name] [(+ ?x 3) ?y] [?y :nation/name]] [(chain ?x ?y) (step ?x ?y)] [(chain ?x ?y) (chain ?x ?t) (step ?t ?y)]]"
_STEPS_SQL = "WITH RECURSIVE s AS (SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 3), t(x, y) AS (SELECT a, b FROM s UNION SELECT t.x, s.b FROM t JOIN s ON t.y = s.a) "
datalog("rule_seeded", "nation", "[:find ?y :in $ % :where (chain 4 ?y)]", _STEPS_SQL + "SELECT y FROM t WHERE x = 4", _STEPS)
datalog("rule_stratified", "nation", "[:find ?k :in $ % :where [?k :nation/name] (not (chain 1 ?k))]", _STEPS_SQL + "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey NOT IN (SELECT y FROM t WHERE x = 1)", _STEPS)


# --- full text ---
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")


def _small(spark: SparkSession, sf_dir: str) -> search.Index:
    """An index of the part table's names: two or more words each."""
    return search.build(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_type", "p_brand", F.concat(F.lit("size"), "p_size")).alias("text")))


native("search_add_remove", "SELECT p_partkey AS doc FROM part WHERE p_size = 7 AND p_partkey <> 5 UNION SELECT 900001")(
    lambda s, d: search.search(_small(s, d).add(_listed(s, "doc long, text string", [(900001, "new size7"), (5, "nothing")])).remove(900002), "size7", None).select("doc")
)
native("search_negation", "SELECT p_partkey AS doc FROM part WHERE p_size <> 7")(lambda s, d: search.search(_small(s, d), [":not", "size7"], None).select("doc"))
native("search_proximity", "SELECT p_partkey AS doc FROM part WHERE p_size IN (7, 8)")(lambda s, d: search.search(_small(s, d), "size7 size8", None, proximity=True).select("doc"))
native("search_doc_filter", "SELECT p_partkey AS doc FROM part WHERE p_size = 7 AND p_partkey % 2 = 1")(lambda s, d: search.search(_small(s, d), "size7", None, doc_filter=lambda c: c % 2 == 1).select("doc"))
native("search_prefix_analyzer", "SELECT p_partkey AS doc FROM part WHERE starts_with(CAST(p_size AS VARCHAR), '1')")(
    lambda s, d: search.search(search.build(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("size"), "p_size").alias("text")), analysis.create_analyzer(filters=[analysis.lower_case, analysis.prefixes])), "size1", None).select("doc")
)


@native("fulltext_datoms", "SELECT CAST(n_nationkey AS BIGINT) AS e, ':nation/name' AS a, n_name AS v, CAST(0 AS BIGINT) AS place FROM nation WHERE n_name IN ('NATION_3', 'NATION_4')")
def _fulltext_datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.fulltext_datoms(open_star(spark, sf_dir, "nation"), "nation_3 nation_4", [":nation/name"], {":top": None})
    return rows.select("e", "a", "v", F.get("offsets", F.lit(0))["places"][0].cast("long").alias("place"))


@native("fulltext_after_change", "SELECT CAST(n_nationkey AS BIGINT) AS e FROM nation WHERE n_name = 'NATION_3' OR n_nationkey = 9")
def _fulltext_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "nation")
    search.index_of(db, ":nation/name")
    return q('[:find ?e :where [(fulltext $ :nation/name "nation_3 other") [[?e _ _]]]]', db_with(db, [[":db/add", 9, ":nation/name", "other"]]))


# --- vectors ---
def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that each metric takes: bits, shares and places."""
    x = F.col("embedding").cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v))
    shares = F.transform(F.array(total), lambda t: F.transform(x, lambda v: F.abs(v) / t))[0]  # the total once a vector, not once an element
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", x.alias("plain"), F.transform(x, lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("bits"), shares.alias("shares"), F.array(x[0] * 40, x[1] * 90).alias("places"))


_D = """WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), v AS (SELECT vec_id, x AS plain, list_transform(x, lambda y: CASE WHEN y > 0 THEN 1 ELSE 0 END::DOUBLE) AS bits,
    list_transform(x, lambda y: abs(y) / list_sum(list_transform(x, lambda z: abs(z)))) AS shares, [x[1] * 40, x[2] * 90] AS places FROM r), d AS (SELECT vec_id, {0} AS e, (SELECT {0} FROM v WHERE vec_id = 3) AS t FROM v),
    m AS (SELECT vec_id, {1} AS dist FROM d) SELECT vec_id, round(dist, 4) + 0.0 AS dist FROM m ORDER BY dist, vec_id LIMIT 10"""
_BOTH, _E, _T = "list_sum(list_transform(list_zip(e, t), lambda y: y[1] * y[2]))", "list_sum(e)", "list_sum(t)"
_MORE = {
    "hamming": ("bits", f"{_E} + {_T} - 2 * {_BOTH}"), "jaccard": ("bits", f"1 - {_BOTH} / ({_E} + {_T} - {_BOTH})"), "tanimoto": ("bits", f"1 - {_BOTH} / ({_E} + {_T} - {_BOTH})"), "sorensen": ("bits", f"1 - 2 * {_BOTH} / ({_E} + {_T})"),
    "pearson": ("plain", f"1 - (len(e) * {_BOTH} - {_E} * {_T}) / sqrt((len(e) * list_sum(list_transform(e, lambda y: y * y)) - {_E} * {_E}) * (len(e) * list_sum(list_transform(t, lambda y: y * y)) - {_T} * {_T}))"),
    "divergence": ("shares", "sqrt(greatest(list_sum(list_transform(list_zip(e, t), lambda y: ((CASE WHEN y[1] > 0 THEN y[1] * ln(y[1] / ((y[1] + y[2]) / 2)) ELSE 0 END) + (CASE WHEN y[2] > 0 THEN y[2] * ln(y[2] / ((y[1] + y[2]) / 2)) ELSE 0 END)) / 2)), 0))"),
    "haversine": ("places", "2 * asin(sqrt(pow(sin((radians(t[1]) - radians(e[1])) / 2), 2) + cos(radians(e[1])) * cos(radians(t[1])) * pow(sin((radians(t[2]) - radians(e[2])) / 2), 2)))"),
}


def _metric(name: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _derived(spark, sf_dir)
        found = vectors.nearest(rows, column, rows.where("vec_id = 3"), "vec_id", 10, name)
        return found.select(F.col("id").alias("vec_id"), (F.round("dist", 4) + 0.0).alias("dist"))

    return run


for _name, (_column, _sql) in _MORE.items():
    native(f"vector_{_name}", _D.replace("{0}", _column).replace("{1}", _sql))(_metric(_name, _column))


@native("vector_index", f"WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3) AS t FROM embeddings WHERE vec_id NOT IN (3, 4)) SELECT vec_id AS id, round({_NEAR['cosine']}, 4) + 0.0 AS dist FROM d ORDER BY {_NEAR['cosine']}, vec_id LIMIT 5")
def _vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    folder = _folder(spark)
    vectors.VectorIndex.create(spark, 64, ":cosine").add(rows).remove(3, 4).save(folder)
    query = [float(x) for x in rows.where("id = 3").first().vector]
    return vectors.VectorIndex.load(spark, folder).search(query, 5).select("id", (F.round("dist", 4) + 0.0).alias("dist"))


native("vector_quantized", "SELECT vec_id, CAST(round(least(greatest(embedding[1], -1), 1) * 127) AS TINYINT) AS first FROM embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", vectors.quantize(F.col("embedding"), "int8")[0].alias("first"))
)


# --- documents ---
def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("e"),
        F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"), F.array(F.col("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey")).alias("tags"))).alias("doc"),
    )


for _name, _form, _where in (
    ("map", '{:home {:segment "BUILDING" :nation 3}}', "c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    ("boolean", '[:or {:home {:nation (< 2)}} [:not {:home {:segment "BUILDING"}}]]', "c_nationkey < 2 OR c_mktsegment <> 'BUILDING'"),
    ("array", '{:tags "n7"}', "c_nationkey = 7"),
    ("wildcard", '{:? {:nation 5}}', "c_nationkey = 5"),
    ("path", "(<= 3 [:* :nation] 4)", "c_nationkey BETWEEN 3 AND 4"),
    ("kinds", "{:home {:nation 3.0}}", "false"),
):
    native(f"idoc_{_name}", f"SELECT c_custkey AS e FROM customer WHERE {_where}")(lambda s, d, form=_form: idoc.filtered(_docs(s, d), F.col("doc"), form).select("e"))
native("idoc_patch", "SELECT c_custkey AS e, CAST(c_nationkey + 1 AS VARCHAR) AS n, CAST(3 AS BIGINT) AS tags FROM customer WHERE c_custkey < 50")(
    lambda s, d: _docs(s, d).where("e < 50").select("e", idoc.patched(F.col("doc"), [[":update", [":home", ":nation"], ":inc"], [":update", ":tags", ":conj", "more"], [":unset", ":name"]]).alias("p")).select("e", idoc.get(F.col("p"), "home", "nation").alias("n"), F.size(F.from_json(idoc.get(F.col("p"), "tags"), "array<string>")).cast("long").alias("tags"))
)
native("idoc_formats", "SELECT unnest(['{\"a\": {\"b\": 1}}', '{\"head\": \"body\"}', '{\"x\": [1, 2]}']) AS doc")(
    lambda s, d: _listed(s, "doc string", [(idoc.normalize("{:a {:b 1}}", "edn"),), (idoc.normalize("# Head\nbody", "markdown"),), (idoc.normalize('{"x": [1, 2]}'),)])
)


# --- pull and entities ---
@native("pull_wildcard", "SELECT CAST(r_regionkey AS BIGINT) AS r, r_name AS name, CAST(r_regionkey AS BIGINT) AS key FROM region")
def _pull_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q("[:find ?r (pull ?r [*]) :where [?r :region/name]]", open_star(spark, sf_dir, "region"))
    return found.select("r", F.col("pull_r").getField(":region/name").alias("name"), F.col("pull_r").getField(":region/regionkey").alias("key"))


@native("pull_nested", "SELECT c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey < 40")
def _pull_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[:find ?c (pull ?c [{:customer/nationkey [:nation/name {:nation/regionkey [:region/name]}]}]) :where [?c :customer/custkey ?k] [(< ?k 40)]]"
    nation = F.col("pull_c").getField(":customer/nationkey")
    return q(form, open_star(spark, sf_dir, "customer", "nation", "region")).select("c", nation.getField(":nation/name").alias("nation"), nation.getField(":nation/regionkey").getField(":region/name").alias("region"))


@native("pull_options", "SELECT CAST(n_nationkey AS BIGINT) AS e, upper(n_name) AS shout, 'none' AS other FROM nation WHERE n_nationkey < 4")
def _pull_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "nation", "labels")
    trees = pull.pull_many(db, ["db/id", [":nation/name", ":as", "shout", ":xform", str.upper], [":labels/toxic", ":default", "none", ":as", "other"]][1:], [0, 1, 2, 3])
    return _listed(spark, "e long, shout string, other string", [(i, t["shout"], "none") for i, t in enumerate(trees)])


@native("pull_recursive_find", "WITH RECURSIVE t(x, y, n) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT x, y + 3, n + 1 FROM t WHERE y + 3 < 25 AND n < 2) SELECT CAST(x AS BIGINT) AS e, CAST(max(y) AS BIGINT) AS last FROM t GROUP BY x HAVING x < 22")
def _pull_recursive_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("e"))
    steps = rows.select("e", F.lit(":next").alias("a"), (F.col("e") + 3).cast("string").alias("v")).where("e + 3 < 25")
    db = files.init_db(steps, {":next": {":db/valueType": ":db.type/ref"}})
    found = q("[:find ?e (pull ?e [:db/id {:next 2}]) :where [?e :next]]", db)
    at = lambda *way: F.get_json_object("pull_e", "$" + "".join(f"['{w}']" for w in way)).cast("long")
    return found.select("e", F.coalesce(at(":next", ":next", ":db/id"), at(":next", ":db/id")).alias("last"))


@native("pull_recursive", "WITH RECURSIVE t(x, n) AS (SELECT 1, 0 UNION ALL SELECT x + 3, n + 1 FROM t WHERE x + 3 < 25) SELECT CAST(x AS BIGINT) AS e, CAST(n AS BIGINT) AS level FROM t")
def _pull_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("e"))
    steps = rows.select("e", F.lit(":next").alias("a"), (F.col("e") + 3).cast("string").alias("v")).where("e + 3 < 25")
    db = files.init_db(steps, {":next": {":db/valueType": ":db.type/ref"}})
    tree, out = pull.pull(db, "[:db/id {:next ...}]", 1), []
    while tree:
        out.append((tree[":db/id"], len(out)))
        tree = tree.get(":next")
    return _listed(spark, "e long, level long", out)


native("entity_touch", "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")(
    lambda s, d: (lambda x: _one(s, "e long, name string, region string", e=x.touch()[":db/id"], n=x[":nation/name"], r=x[":nation/regionkey"][":region/name"]))(entity(open_star(s, d, "nation", "region"), 7))
)
native("entity_reverse", "SELECT CAST(n_nationkey AS BIGINT) AS e FROM nation WHERE n_regionkey = 2")(lambda s, d: _listed(s, "e long", [(x.id,) for x in entity(open_star(s, d, "nation", "region"), 2)[":nation/_regionkey"]]))
native("entity_edits", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 7 THEN 'seven' ELSE n_name END AS n FROM nation")(
    lambda s, d: (lambda db: q("[:find ?e ?n :where [?e :nation/name ?n]]", db_with(db, [entity(db, 7).assoc(":nation/name", "seven")])))(open_star(s, d, "nation"))
)


# --- transactions ---
@native("transact_cas", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 3 THEN 'swapped' ELSE n_name END AS n FROM nation")
def _cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_star(spark, sf_dir, "nation")
    try:
        db_with(db, [[":db/cas", 3, ":nation/name", "other", "never"]])
    except ValueError:
        db = db_with(db, [[":db/cas", 3, ":nation/name", entity(db, 3)[":nation/name"], "swapped"]])
    return q("[:find ?e ?n :where [?e :nation/name ?n]]", db)


@native("transact_function", "SELECT CAST(n_nationkey AS BIGINT) AS e, CASE n_nationkey WHEN 3 THEN n_name || '!' ELSE n_name END AS n FROM nation")
def _function(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout = lambda db, e: [[":db/add", e, ":nation/name", entity(db, e)[":nation/name"] + "!"]]
    return q("[:find ?e ?n :where [?e :nation/name ?n]]", db_with(open_star(spark, sf_dir, "nation"), [[":db.fn/call", shout, 3]]))


def _people(spark: SparkSession) -> Connection:
    from triplane.transact import create_conn

    return create_conn(spark, {":email": {":db/unique": ":db.unique/identity", ":db/valueType": ":db.type/string"}, ":boss": {":db/valueType": ":db.type/ref"}, ":parts": {":db/valueType": ":db.type/ref", ":db/cardinality": ":db.cardinality/many", ":db/isComponent": True}, ":n": {":db/valueType": ":db.type/long"}, ":key": {":db/tupleAttrs": [":email", ":n"]}})


@native("transact_tempids", "SELECT * FROM (VALUES ('a@x', 'b@x'), ('b@x', 'b@x')) t(email, boss)")
def _tempids(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _people(spark)
    conn.transact([{":db/id": "one", ":email": "a@x", ":boss": -7}, {":db/id": -7, ":email": "b@x"}, [":db/add", -7, ":boss", -7]])
    return conn.db and q("[:find ?email ?boss :where [?e :email ?email] [?e :boss ?b] [?b :email ?boss]]", conn.db)


@native("transact_components", "SELECT * FROM (VALUES ('keep', CAST(4 AS BIGINT))) t(email, n)")
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _people(spark)
    ids = conn.transact([{":db/id": -1, ":email": "whole", ":n": 1, ":parts": [{":n": 2, ":parts": [{":n": 3}]}]}, {":email": "keep", ":n": 4, ":boss": -1}]).tempids
    conn.transact([[":db/retractEntity", ids[-1]]])
    left = q("[:find ?n :where [_ :n ?n]]", conn.db)
    return q("[:find ?email ?n :where [?e :email ?email] [?e :n ?n] (not [?e :boss])]", conn.db).join(left, "n").select("email", "n")


@native("transact_composite", "SELECT ['a@x', '2'] AS t")
def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _people(spark)
    conn.transact([{":email": "a@x", ":n": 1}])
    conn.transact([{":email": "a@x", ":n": 2}])
    return q("[:find ?t :where [_ :key ?t]]", conn.db)


@native("transact_schema", "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS n, CAST(1 AS BIGINT) AS more FROM nation WHERE n_nationkey = 2")
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = Connection(files.init_db(_facts(spark, sf_dir), _NATION))
    conn.update_schema({":more": {":db/valueType": ":db.type/long"}}, rename={":name": ":called"})
    conn.transact([[":db/add", 2, ":more", 1]])
    return q("[:find ?e ?n ?more :where [?e :called ?n] [?e :more ?more]]", conn.db)


@native("transact_listen", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), ':n', '5', true), (1, ':n', '5', false), (1, ':n', '6', true)) t(e, a, v, added)")
def _listen(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn, heard = _people(spark), []
    key = conn.listen(lambda r: heard.extend((e, a, str(v), added) for e, a, v, added in r.tx_data if a == ":n"))
    conn.transact([{":db/id": 1, ":n": 5}])
    conn.transact([{":db/id": 1, ":n": 6}])
    conn.unlisten(key)
    conn.transact([{":db/id": 1, ":n": 7}])
    return _listed(spark, "e long, a string, v string, added boolean", heard)


@native("transact_async", "SELECT i::VARCHAR || '@x' AS email, i AS n FROM range(5) t(i)")
def _async(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _people(spark)
    for f in [conn.transact_async([{":email": f"{i}@x", ":n": i}]) for i in range(5)]:
        f.result()
    conn.close()
    return q("[:find ?email ?n :where [?e :email ?email] [?e :n ?n]]", conn.db)


@native("transact_nested", "SELECT 'a@x' AS email")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = _people(spark)
    with conn.transaction() as tx:
        tx.transact([{":email": "a@x"}])
    with conn.transaction() as tx:
        tx.transact([{":email": "b@x"}])
        tx.abort()
    return q("[:find ?email :where [_ :email ?email]]", conn.db)


@native("connect_stored", "SELECT 'a@x' AS email, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'c@x', 3")
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = _folder(spark), {":email": {":db/unique": ":db.unique/identity", ":db/valueType": ":db.type/string"}, ":n": {":db/valueType": ":db.type/long"}}
    conn = connect(spark, folder, schema)
    conn.transact([{":email": "a@x", ":n": 1}, {":email": "b@x", ":n": 1}])
    conn.transact([{":email": "a@x", ":n": 2}, [":db/retractEntity", [":email", "b@x"]]])
    again = connect(spark, folder)
    again.transact([{":email": "c@x", ":n": 3}])
    return q("[:find ?email ?n :where [?e :email ?email] [?e :n ?n]]", connect(spark, folder).db)


native("transact_patch_document", "SELECT CAST(1 AS BIGINT) AS e, '2' AS k")(
    lambda s, d: (lambda db: q("[:find ?e ?k :where [?e :doc ?d] [(idoc-get ?d :k) ?k]]", db_with(db, [[":db.fn/patchIdoc", 1, ":doc", [[":update", [":k"], ":inc"]]]])))(files.init_db(_listed(s, "e long, a string, v string", [(1, ":doc", '{"k": 1}')]), {":doc": {":db/valueType": ":db.type/idoc"}}))
)


# --- logs and streams ---
@native("log_tail", "SELECT CAST(2 AS BIGINT) AS tx, CAST(3 AS BIGINT) AS e, ':nation/name' AS a, 'Y' AS v, true AS added UNION ALL SELECT 2, 3, ':nation/name', 'X', false")
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.transact import tx_log

    folder, seen = _folder(spark), []
    first = with_(open_star(spark, sf_dir, "nation"), [[":db/add", 3, ":nation/name", "X"]])
    log.append_log(tx_log(spark, [first, with_(first.db_after, [[":db/add", 3, ":nation/name", "Y"]])]), f"{folder}/log")
    log.listen(log.tail_log(spark, f"{folder}/log", 2), lambda df, _: seen.extend(map(tuple, df.collect())), f"{folder}/checkpoint").awaitTermination(120)
    return _listed(spark, log.SCHEMA, seen)


def _streamed(made: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a stream over the events table, when it has read all of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, name = _folder(spark), f"stream_{uuid.uuid4().hex}"
        rows = spark.read.parquet(f"{sf_dir}/events.parquet")
        rows.write.parquet(f"{folder}/events")
        stream = made(spark.readStream.schema(rows.schema).parquet(f"{folder}/events").withColumn("ts", F.col("ts").cast("timestamp")))
        stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(300)
        return spark.table(name).withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in ("start", "end")})

    return run


native("stream_windows_live", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")(_streamed(lambda df: log.windowed(df, "ts", "1 hour", "event_type")))
native("stream_sessions", """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", event_type, count(*) AS n FROM s GROUP BY event_type, k""")(lambda s, d: log.sessions(s.read.parquet(f"{d}/events.parquet"), "ts", "10 minutes", "event_type"))
native("query_answer", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")(lambda s, d: _one(s, "n long", n=len(answer("[:find ?k :where [?k :nation/name] :timeout 600000]", open_star(s, d, "nation")))))
