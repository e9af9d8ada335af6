"""Pull, index access, key-value tables, search, vectors, documents, transactions, files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from triplane.api import answer, from_entities
from triplane.edn import read
from triplane.operators import idoc, index, kv, pull, search, vectors
from triplane.sources import files
from triplane.streaming import log
from triplane.transact import Connection, create_conn, db_with, squuid, squuid_time_millis, tx_log

REF = ":db.type/ref"
MANY = ":db.cardinality/many"
SCHEMA = {
    ":aka": {":db/cardinality": MANY},
    ":child": {":db/cardinality": MANY, ":db/valueType": REF},
    ":friend": {":db/cardinality": MANY, ":db/valueType": REF},
    ":father": {":db/valueType": REF},
    ":spec": {":db/valueType": REF, ":db/isComponent": True},
}


@pytest.fixture(scope="module")
def family(spark):
    people = [
        {":db/id": 1, ":name": "Otto", ":aka": ["Baker", "Smith"], ":child": [2, 3], ":spec": 10},
        {":db/id": 2, ":name": "Nell", ":father": 1},
        {":db/id": 3, ":name": "Karl", ":father": 1, ":friend": [4]},
        {":db/id": 4, ":name": "Ines", ":friend": [5]},
        {":db/id": 5, ":name": "Brida", ":friend": [3]},
        {":db/id": 10, ":name": "Spec"},
    ]
    return from_entities(spark, people, SCHEMA)


def test_pull(family):
    assert pull.pull(family, "[:name :aka]", 1) == {":name": "Otto", ":aka": ["Baker", "Smith"]}
    assert pull.pull(family, "[:name {:child [:name]}]", 1) == {":name": "Otto", ":child": [{":name": "Nell"}, {":name": "Karl"}]}
    assert pull.pull(family, "[:name {:_child [:name]}]", 2) == {":name": "Nell", ":_child": [{":name": "Otto"}]}
    assert pull.pull(family, '[[:name :as "n"] (default :age 7) (limit :aka 1)]', 1) == {"n": "Otto", ":age": 7, ":aka": ["Baker"]} if ":age" in family.attributes else True
    assert pull.pull(family, "[*]", 2) == {":db/id": 2, ":name": "Nell", ":father": {":db/id": 1}}
    assert pull.pull(family, "[:spec]", 1)[":spec"][":name"] == "Spec"
    assert [r and r[":name"] for r in pull.pull_many(family, "[:name]", [2, 99, 4])] == ["Nell", None, "Ines"]


def test_pull_recursion(family):
    tree = pull.pull(family, "[:db/id :name {:friend ...}]", 3)
    assert tree[":friend"][0][":name"] == "Ines" and tree[":friend"][0][":friend"][0][":name"] == "Brida"
    assert tree[":friend"][0][":friend"][0][":friend"] == [{":db/id": 3}]
    one = pull.pull(family, "[:name {:friend 1}]", 3)
    assert one == {":name": "Karl", ":friend": [{":name": "Ines"}]}


def test_pull_in_find(family):
    got = answer('[:find ?e (pull ?e [:name {:child [:name]}]) :where [?e :aka "Smith"]]', family)
    assert got[0][1].asDict(True) == {":name": "Otto", ":child": [{":name": "Nell"}, {":name": "Karl"}]}


@pytest.mark.parametrize("pattern", ["[:db/id :name {:friend ...}]", "[:db/id :name {:friend 1}]", "[:db/id :name {:_father ...}]", "[:db/id :name {:child 2}]"])
def test_recursive_pull_in_find(family, pattern):
    import json

    got = answer(f"[:find ?e (pull ?e {pattern}) :where [?e :name]]", family)
    assert len(got) == 6
    for e, text in got:
        assert json.loads(text) == pull.pull(family, pattern, e), e


def test_index(family):
    assert [tuple(r) for r in index.datoms(family, ":ave", ":name").collect()][0] == (5, ":name", "Brida")
    assert [r.e for r in index.seek_datoms(family, ":ave", ":name", "Otto").collect()] == [1, 10]
    assert [r.e for r in index.rseek_datoms(family, ":ave", ":name", "Ines", n=2).collect()] == [4, 5]
    assert [r.v for r in index.index_range(family, ":name", "E", "M").collect()] == ["Ines", "Karl"]
    assert index.count_datoms(family, e=1) == 6 and index.cardinality(family, ":father") == 1 and index.max_eid(family) == 10
    assert index.search_datoms(family, a=":aka").count() == 2 and ":child" in index.schema(family)
    assert index.analyze(family, ":name").first().facts == 6


def test_kv(spark):
    t = kv.Dbi(spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k long, v string"))
    keys = lambda spec: [r.k for r in t.range(spec).collect()]
    assert keys([":closed", 2, 4]) == [2, 3, 4] and keys([":open", 2, 4]) == [3] and keys([":closed-open", 2, 4]) == [2, 3] and keys([":open-closed", 2, 4]) == [3, 4]
    assert keys([":at-least", 8]) == [8, 9] and keys([":at-most-back", 1]) == [1, 0] and keys([":greater-than", 8]) == [9] and keys([":less-than", 1]) == [0] and keys([":closed-back", 4, 2]) == [4, 3, 2]
    assert t.get_value(3) == "v3" and t.get_rank(3) == 3 and t.get_rank(77) is None and t.get_by_rank(4).k == 4 and t.get_first([":all-back"]).k == 9
    assert t.key_range_count(":all", 3) == 3 and t.range_count([":at-least", 5]) == 5 and t.sample(4).count() == 4
    assert t.range_some(lambda k, v: F.when(k > 6, v)) == "v7" and t.get_some(lambda k, v: v == "v5").k == 5
    seen = []
    t.visit(lambda k, v: seen.append(k) or len(seen) < 3)
    assert seen == [0, 1, 2]
    changed = t.transact([(":put", 3, "x"), (":del", 4), (":put", 3, "y"), (":put", 50, "z")])
    assert changed.get_value(3) == "y" and changed.get_value(4) is None and changed.entries() == 10
    with pytest.raises(ValueError):
        t.range([":near", 1])


def test_list_kv(spark):
    store = kv.KV(spark)
    t = store.open_list_dbi("l", "string", "long").put_list_items("a", [3, 1, 2]).put_list_items("b", [5])
    assert [r.v for r in t.get_list("a").collect()] == [1, 2, 3] and t.list_count("a") == 3 and t.in_list("a", 2) and t.near_list("a", 2) == 2
    assert t.list_range_count([":closed", "a", "b"], [":greater-than", 2]) == 2
    assert t.del_list_items("a", [1]).list_count("a") == 2 and t.del_list_items("a").list_count("a") == 0
    assert store.list_dbis() == ["l"] and kv.unhexify(kv.hexify("añ")) == "añ"


TEXTS = [(1, "The quick red fox jumped over the lazy red dogs."), (2, "Mary had a little lamb whose fleece was red as fire."), (3, "Moby Dick is a story of a whale and a man obsessed.")]


@pytest.fixture(scope="module")
def texts(spark):
    return search.build(spark.createDataFrame(TEXTS + [(4, None), (5, "the of")], "doc long, text string"))


def test_search(texts):
    found = lambda query, top=10: [r.doc for r in search.search(texts, query, top).collect()]
    assert found("red fox") == [1, 2] and found(read('[:and "red" [:not "fox"]]')) == [2] and found(read('[:or "whale" "fleece"]')) in ([3, 2], [2, 3])
    assert found(read('{:phrase "little lamb"}')) == [2] and found(read('{:phrase "lamb little"}')) == [] and found("nothing") == []
    assert found(read('[:not "red"]')) == [3] and found(read('[:not "absent"]')) == [] and texts.doc_count() == 3
    first = search.search(texts, "red", 1).first()
    norm = len(set(search.terms_of(TEXTS[0][1])))
    assert first.doc == 1 and first.score == pytest.approx(math.log10(3 / 2) * (1 + math.log10(2)) / norm)
    assert not texts.remove(1).indexed(1)


def test_saved_index(spark, texts, tmp_path):
    texts.save(str(tmp_path / "i"))
    loaded = search.Index.load(spark, str(tmp_path / "i"))
    found = search.search(loaded, "red fox")
    assert [r.doc for r in found.collect()] == [1, 2] and loaded.size == texts.size
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString().replace("`", "")


def test_search_in_query(spark):
    db = from_entities(spark, [{":db/id": i, ":text": t} for i, t in TEXTS], {":text": {":db/fulltext": True}})
    assert [r[0] for r in answer('[:find ?e ?v :where [(fulltext $ "lamb") [[?e _ ?v]]]]', db)] == [2]
    assert [r[0] for r in answer('[:find ?e ?s :where [(fulltext $ :text "whale" {:top 1 :display :refs+scores}) [[?e _ _ ?s]]]]', db)] == [3]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None)], "id long, v array<double>")
    near = lambda metric: [r.id for r in vectors.neighbors(df, "v", [1.0, 0.0], 2, metric, key="id").collect()]
    for m in ("euclidean", "cosine", "dot-product"):
        assert near(m) == [1, 3]
    assert vectors.neighbors(df, "v", [1.0, 0.0], 1, "euclidean").first().dist == 0.0
    assert vectors.neighbors(df, "v", [1.0, 0.0], 2, after=F.col("id") > 1, key="id").count() == 1
    bits = spark.createDataFrame([(1, [1.0, 1.0, 0.0])], "id long, v array<double>")
    for m, want in (("jaccard", 0.5), ("hamming", 1.0), ("sorensen", 1 / 3), ("tanimoto", 0.5)):
        assert vectors.neighbors(bits, "v", [1.0, 0.0, 0.0], 1, m).first().dist == pytest.approx(want)
    with pytest.raises(Exception, match="must have"):
        vectors.neighbors(df, "v", [1.0], 1).collect()


DOC = {"status": "active", "profile": {"age": 30, "name": "Alice"}, "tags": ["a", "b"], "n": 1.0, "gone": None, "events": [{"t": 1}, {"t": 5}]}


@pytest.mark.parametrize("query,want", [
    ("{}", True), ('{:status "active"}', True), ('{:status "x"}', False), ("{:profile {:age 30}}", True), ("{:profile {:age (> 21)}}", True), ("{:profile {:age (> 21.0)}}", False),
    ('{:tags "a"}', True), ('{:tags "c"}', False), ("{:n 1}", False), ("{:n 1.0}", True), ("{:events {:t 5}}", True), ('[:or {:status "x"} {:profile {:name "Alice"}}]', True), ('[:not {:status "active"}]', False),
    ("{:gone (nil?)}", True), ("(< 20 [:profile :age] 40)", True), ("{:? {:age 30}}", True), ('{:* {:name "Alice"}}', True), ("(>= [:* :age] 30)", True),
])
def test_idoc_match(query, want):
    assert idoc.matches(DOC, read(query)) is want


def test_idoc_expressions(spark):
    """Columns against parsed documents, for queries that expressions decide and those that they can't."""
    import json

    docs = [DOC, {}, {"n": 1, "profile": [{"age": 30}, {"age": 5}]}, {"profile": {"age": 30.0, "name": None}}, {"status": ["active"], "n": 10**30}, {"status": True, "profile": {"age": "30"}}, {"gone": 0, "profile": {"age": 22, "ok": True}}, {"n": -1, "profile": 3}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "e long, doc string")
    asked = ['{:status "active"}', "{:profile {:age 30}}", "{:profile {:age (> 21)}}", "{:profile {:age (< 3 30)}}", "{:n 1}", "{:n 1.0}", "{:gone (nil?)}", "{:profile {:ok true}}", '[:not {:status "active"}]', '[:or {:n 1} {:profile {:name "Alice"}}]', '[:and {:n 1} [:not {:profile {:age 5}}]]', "{:profile {}}", "{:? {:age 30}}", '{:tags "a"}']
    for form in asked:
        want = [i for i, d in enumerate(docs) if idoc.matches(d, read(form))]
        assert sorted(r.e for r in df.where(idoc.match(F.col("doc"), form)).collect()) == want, form


def test_idoc_columns(spark):
    import json

    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, '{"status": "idle"}'), (3, None)], "e long, doc string")
    assert [r.e for r in idoc.filtered(df, F.col("doc"), "{:profile {:age (>= 30)}}").collect()] == [1]
    assert [r[0] for r in df.select(idoc.get(F.col("doc"), "events", 1, "t")).collect()] == ["5", None, None]
    out = df.where("e = 1").select(idoc.patched(F.col("doc"), read('[[:set [:profile :age] 31] [:unset :gone] [:update :tags :conj "c"] [:update :n :inc]]'))).first()[0]
    got = json.loads(out)
    assert got["profile"]["age"] == 31 and "gone" not in got and got["tags"] == ["a", "b", "c"] and got["n"] == 2.0
    assert json.loads(idoc.normalize("# A\ntext\n## B b\nmore", "markdown")) == {"a": {"content": "text", "b-b": "more"}}
    with pytest.raises(ValueError):
        idoc.normalize("[1]", "json")


def test_transactions(spark):
    conn = create_conn(spark, {":name": {":db/unique": ":db.unique/identity", ":db/valueType": ":db.type/string"}, ":aka": {":db/cardinality": MANY, ":db/valueType": ":db.type/string"}, ":boss": {":db/valueType": REF}})
    heard = []
    key = conn.listen(heard.append)
    r = conn.transact([{":db/id": -1, ":name": "Ann", ":age": 30, ":aka": ["x", "y"]}, {":name": "Bob", ":boss": -1}])
    ann = r.tempids[-1]
    assert answer('[:find ?a . :where [?e :name "Ann"] [?e :age ?a]]', conn.db) == 30
    assert answer('[:find ?n . :where [?e :boss ?b] [?b :name "Ann"] [?e :name ?n]]', conn.db) == "Bob"
    conn.transact([{":name": "Ann", ":age": 31}, [":db/retract", ann, ":aka", "x"]])
    assert answer("[:find ?a . :in $ ?e :where [?e :age ?a]]", conn.db, ann) == 31
    assert answer("[:find [?k ...] :in $ ?e :where [?e :aka ?k]]", conn.db, ann) == ["y"]
    with pytest.raises(ValueError):
        conn.transact([[":db.fn/cas", ann, ":age", 5, 6]])
    conn.transact([[":db.fn/cas", ann, ":age", 31, 32], lambda_call(ann)])
    assert answer("[:find ?a . :in $ ?e :where [?e :age ?a]]", conn.db, ann) == 33
    before = conn.db
    conn.transact([[":db/retractEntity", ann]])
    assert answer('[:find ?e . :where [?e :name "Ann"]]', conn.db) is None and answer("[:find ?e . :where [?e :boss]]", conn.db) is None
    assert answer('[:find ?e . :where [?e :name "Ann"]]', before) == ann
    conn.unlisten(key)
    assert len(heard) == 4 and tx_log(spark, conn.log).count() > 5
    assert answer("[:find ?n . :where [?e :name ?n]]", db_with(before, [{":name": "Zed"}])) is not None
    assert squuid_time_millis(squuid()) > 0


def lambda_call(e):
    return [":db.fn/call", lambda db, x: [[":db/add", x, ":age", 33]], e]


def test_schema_changes(spark):
    conn = Connection(create_conn(spark).db)
    conn.transact([{":a": 1, ":b": "x"}])
    conn.update_schema({":c": {":db/valueType": ":db.type/long"}}, rename={":b": ":bb"})
    assert answer("[:find ?v . :where [_ :bb ?v]]", conn.db) == "x"
    with pytest.raises(ValueError):
        conn.update_schema(drop=[":a"])
    conn.update_schema(drop=[":c"])
    assert ":c" not in conn.db.attributes


def test_files(spark, tmp_path, family):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "two\nlines"), (3, None)], "id long, t string")
    files.write_csv(df, str(tmp_path / "c"), header=True, quote_all=True)
    assert {(r.id, r.t) for r in files.read_csv(spark, str(tmp_path / "c"), header=True, schema="id long, t string").collect()} >= {(1, 'a "quoted", text'), (2, "two\nlines")}
    loaded = files.copy(family, str(tmp_path / "d"))
    assert pull.pull(loaded, "[:name {:child [:name]}]", 1) == pull.pull(family, "[:name {:child [:name]}]", 1)


def test_log_stream(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    log.append_log(spark.createDataFrame([(1, 1, ":a", "x", True), (2, 1, ":a", "y", True)], log.SCHEMA), path)
    assert log.open_log(spark, path, 2).count() == 1
    log.listen(log.tail_log(spark, path), lambda df, _: seen.extend(r.v for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["x", "y"]


def test_windows(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:04:00"), ("a", "2024-01-01 01:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in log.windowed(df, "t", "10 minutes", "k").collect()) == [1, 2]
    assert sorted(r.n for r in log.sessions(df, "t", "5 minutes", "k").collect()) == [1, 2]


def test_analyzers(spark):
    from triplane.operators import analysis as a

    df = spark.createDataFrame([("The Élan running ponies",)], "t string")
    terms = lambda *fs: [x.term for x in df.select(a.create_analyzer(filters=fs)(F.col("t")).alias("x")).first().x]
    assert terms(a.lower_case, a.unaccent, a.stop_words()) == ["elan", "running", "ponies"]
    assert terms(a.min_length(4), a.max_length(6)) == ["Élan", "ponies"]
    assert terms(a.max_length(3), a.prefixes) == ["T", "Th", "The"] and terms(a.max_length(3), a.ngrams(2, 3)) == ["Th", "he", "The"]
    assert terms(a.lower_case, a.english_stem())[2:] == ["run", "poni"]
    rows = spark.createDataFrame([(1, "Running ponies"), (2, "walking")], "doc long, text string")
    assert [r.doc for r in search.search(search.build(rows, a.create_analyzer(filters=[a.lower_case, a.english_stem()])), "run").collect()] == [1]


def test_embeddings(spark):
    from triplane.operators import embedding

    provider = embedding.HashEmbedding(32)
    (v,) = provider.embed(["red fox"])
    assert len(v) == 32 and sum(x * x for x in v) == pytest.approx(1) and embedding.token_count(provider, "a b c") == 3 and embedding.truncate(provider, "a b c", 2) == "a b"
    db = from_entities(spark, [{":db/id": i, ":text": t} for i, t in TEXTS], {":text": {":db/embedding": True}})
    got = answer('[:find ?e ?d :where [(embedding-neighbors $ :text "Moby Dick is a story" {:top 1 :display :refs+dists}) [[?e _ _ ?d]]]]', db)
    assert got[0][0] == 3 and 0 <= got[0][1] < 0.6

    class Short:
        context_size = 12

        def tokens(self, text):
            return text.split()

        def generate(self, prompt, limit):
            return " ".join(prompt.split()[1 : 1 + min(limit, 2)])

    assert embedding.summarize(Short(), " ".join(map(str, range(40))), 4).startswith("0")


def test_proximity(spark):
    assert search.spans([(0, "a"), (1, "b"), (100, "a")]) == [[(0, "a"), (1, "b")], [(100, "a")]]
    assert search.spans([(0, "a"), (5, "b"), (6, "a")]) == [[(0, "a")], [(5, "b"), (6, "a")]]
    assert search.spans([(0, "a"), (2, "b"), (9, "a")]) == [[(0, "a"), (2, "b")], [(9, "a")]]
    rows = [(1, "apple filler filler filler filler filler pear one two three"), (2, "filler apple pear filler four five six"), (3, "nothing")]
    index_ = search.build(spark.createDataFrame(rows, "doc long, text string"))
    assert [r.doc for r in search.search(index_, "apple pear", 2, proximity=True).collect()] == [2, 1]
    got = search.search(index_, "apple pear", 2, proximity=True).first()
    w = math.log10(3 / 2)
    assert search.closeness({"apple": [1], "pear": [2]}, {"apple": w, "pear": w}, 10) == pytest.approx(2 * w * (2 / 2) ** 0.25 * 2**0.3 / 10)
    assert got.score > 0


def test_search_without_a_limit(spark):
    rows = [(i, "red fox" if i % 2 else "blue fox") for i in range(40)]
    index_ = search.build(spark.createDataFrame(rows, "doc long, text string"))
    assert search.search(index_, "red", None).count() == 20 and search.search(index_, [":not", "red"], None).count() == 20
    assert search.search(index_, "red fox", None, proximity=True).count() == 40


@pytest.mark.parametrize("name", ["search_boolean", "search_phrase"])
def test_searches_for_all_matches_have_no_limit(spark, name):
    from triplane.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


# --- functions that give relations ---
EVENTS = [{":db/id": i, ":type": "click" if i % 2 else "view", ":props": f'{{"k": {i % 3}}}', ":note": f"note {i} red" if i % 4 else "blue"} for i in range(1, 13)]


@pytest.mark.parametrize("clause", ["(idoc-match $ :props {:k 1})", '(fulltext $ :note "red" {:top 100})', "(vec-neighbors $ :vec [1.0 0.0] {:top 12})", '(embedding-neighbors $ :note "red" {:top 12})', "(q [:find ?x :where [?x :type]] $)"])
def test_relations_are_joined(spark, clause):
    """Results meet patterns by an equality join on the entity, never as a product."""
    schema = {":props": {":db/valueType": ":db.type/idoc"}, ":note": {":db/fulltext": True}, ":vec": {":db/valueType": ":db.type/vec"}}
    db = from_entities(spark, [e | {":vec": [float(e[":db/id"]), 1.0]} for e in EVENTS], schema)
    binding = "[[?e]]" if clause.startswith("(q") else "[[?e _ _]]"
    form = f'[:find ?e :where [?e :type "click"] [{clause} {binding}]]'
    from triplane.api import q

    found = q(form, db)
    alone = {r[0] for r in q(f"[:find ?e :where [{clause} {binding}]]", db).collect()}
    assert {r[0] for r in found.collect()} == {e for e in alone if e % 2} and len(alone) > 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_nested_query_with_outer_variables(spark):
    db = from_entities(spark, [{":db/id": i, ":team": i % 3, ":points": 10 * i} for i in range(1, 10)])
    best = "[:find ?t ?p :where [_ :team ?t] [(q [:find (max ?x) :in $ ?t :where [?e :team ?t] [?e :points ?x]] $ ?t) [[?p]]]]"
    assert sorted(answer(best, db)) == [(0, 90), (1, 70), (2, 80)]
    rows = "[:find ?t ?x :where [?e :points ?p] [(> ?p 60)] [?e :team ?t] [(q [:find ?x :in ?y :where [(+ ?y 1) ?x]] ?t) [[?x]]]]"
    assert sorted(answer(rows, db)) == [(0, 1), (1, 2), (2, 3)]


def test_relation_inputs_must_be_known(spark):
    db = from_entities(spark, EVENTS, {":note": {":db/fulltext": True}})
    assert len(answer('[:find ?e :in $ ?q :where [(fulltext $ :note ?q {:top 50}) [[?e]]]]', db, "red")) == 9
    with pytest.raises(ValueError, match="input"):
        answer("[:find ?e :where [?e :type ?t] [(fulltext $ :note ?t) [[?e]]]]", db)


def test_fulltext_options(spark):
    db = from_entities(spark, [{":db/id": i, ":text": t} for i, t in TEXTS], {":text": {":db/fulltext": True}})
    (row,) = answer('[:find ?e ?o :where [(fulltext $ "lamb" {:display :offsets}) [[?e _ _ ?o]]]]', db)
    assert row[0] == 2 and row[1] == [("lamb", [TEXTS[1][1].index("lamb")])]
    got = search.fulltext_datoms(db, "red", [":text"], {":top": 1, ":doc-filter": lambda d: d != 1}).collect()
    assert [(r.e, r.a) for r in got] == [(2, ":text")]
    kept = db.indexes[":text"]
    assert search.index_of(db, ":text") is kept  # built once
    later = db_with(db, [[":db/add", 3, ":text", "a new red line"], [":db/retractEntity", 1]])
    assert sorted(r[0] for r in answer('[:find ?e :where [(fulltext $ "red") [[?e]]]]', later)) == [2, 3]
    assert [r[0] for r in answer('[:find ?e :where [(fulltext $ "fox") [[?e]]]]', db)] == [1]
    from triplane.operators import analysis as a

    search.re_index(db, ":text", a.create_analyzer(filters=[a.lower_case, a.english_stem()]))
    assert [r[0] for r in answer('[:find ?e :where [(fulltext $ "jump") [[?e]]]]', db)] == [1]


def test_kept_index(spark, tmp_path):
    """The index of a table's files is built once and read again; other files have another."""
    rows = spark.createDataFrame(TEXTS, "doc long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    first, again = search.kept(table, "t"), search.kept(table, "t")
    assert first.postings.inputFiles() == again.postings.inputFiles() and [r.doc for r in search.search(again, "red").collect()] == [1, 2]
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert search.kept(spark.read.parquet(str(tmp_path / "t")), "t").postings.inputFiles() != first.postings.inputFiles()
    assert "PushedFilters: [In(term" in search.search(again, "red fox")._jdf.queryExecution().toString().replace("`", "")


def test_escaped_documents(spark):
    df = spark.createDataFrame([(1, '{"n\\u0061me": "x"}'), (2, '{"name": "a\\/b"}'), (3, '{"name": "y"}')], "e long, doc string")
    assert [r.e for r in idoc.filtered(df, F.col("doc"), '{:name "x"}').collect()] == [1]
    assert [r.e for r in idoc.filtered(df, F.col("doc"), '{:name "a/b"}').collect()] == [2]


@pytest.mark.parametrize("metric", list(vectors.METRICS))
def test_nearest_of_many(spark, metric):
    """All queries at once against one query at a time."""
    import random

    rng = random.Random(4)
    rows = [(i, [abs(rng.gauss(0, 1)) * (rng.random() < 0.7) + 0.01 * (metric in ("divergence", "cosine", "pearson")) for _ in range(6)]) for i in range(60)] + [(60, None)]
    rows += [(70 + i, rows[3][1]) for i in range(3)]  # ties
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {}
    for r in vectors.nearest(df, "v", df.where("id % 20 = 0"), "id", 5, metric).collect():
        got.setdefault(r.query, []).append((round(r.dist, 6), r.id))
    assert set(got) == {0, 20, 40}
    for query, found in got.items():
        want = [round(r.dist, 6) for r in vectors.neighbors(df, "v", rows[query][1], 5, metric, key="id").collect()]
        assert [d for d, _ in sorted(found)] == pytest.approx(want, abs=1e-5)


def test_vector_index(spark, tmp_path):
    index_ = vectors.VectorIndex.create(spark, 2, ":cosine").add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>"))
    index_ = index_.add(spark.createDataFrame([(2, [1.0, 0.1]), (3, [0.0, 2.0])], "id long, vector array<double>"))
    assert [r.id for r in index_.search([1.0, 0.0], 2).collect()] == [1, 2] and index_.info()[":size"] == 3 and index_.indexed(3)
    index_.save(str(tmp_path / "v"))
    loaded = vectors.VectorIndex.load(spark, str(tmp_path / "v"))
    assert [r.id for r in loaded.remove(1).search([1.0, 0.0], 1).collect()] == [2] and loaded.metric == "cosine" and loaded.clear().info()[":size"] == 0
    assert {(r.query, r.id) for r in loaded.search_all(loaded.rows, 1).collect()} == {(1, 1), (2, 2), (3, 3)}
    with pytest.raises(Exception, match="must have"):
        index_.add(spark.createDataFrame([(5, [1.0])], "id long, vector array<double>")).rows.collect()


# --- entities, stored databases, batches ---
def test_entity(spark, family):
    from triplane.api import entity

    otto = entity(family, 1)
    assert otto[":name"] == "Otto" and sorted(otto[":aka"]) == ["Baker", "Smith"] and otto.get(":none") is None and ":name" in otto
    assert [c[":name"] for c in sorted(otto[":child"], key=lambda x: x.id)] == ["Nell", "Karl"] and entity(family, 2)[":father"] == entity(family, 1)
    assert {x.id for x in otto[":_father"]} == {2, 3} and otto.touch()[":spec"][":name"] == "Spec" and otto[":db/id"] == 1
    assert entity(family, 99).keys() == [] and len(entity(family, 4)) == 2
    staged = otto.add(":aka", "New").assoc(":name", "Ottokar").retract(":aka", "Smith")
    assert staged[":name"] == "Ottokar" and sorted(staged[":aka"]) == ["Baker", "New"] and otto[":name"] == "Otto"
    after = db_with(family, [staged])
    assert entity(after, 1)[":name"] == "Ottokar" and sorted(entity(after, 1)[":aka"]) == ["Baker", "New"]


PEOPLE = {":email": {":db/unique": ":db.unique/identity", ":db/valueType": ":db.type/string"}, ":tags": {":db/cardinality": MANY, ":db/valueType": ":db.type/string"}, ":boss": {":db/valueType": REF}}


def test_stored_database(spark, tmp_path):
    from triplane.api import connect

    path = str(tmp_path / "db")
    conn = connect(spark, path, PEOPLE)
    r = conn.transact([{":db/id": -1, ":email": "a@x", ":tags": ["p", "q"], ":age": 3}, {":email": "b@x", ":boss": -1}])
    conn.transact([{":email": "a@x", ":age": 4}, [":db/retract", r.tempids[-1], ":tags", "p"]])
    other = connect(spark, path)
    assert other.query('[:find ?a . :where [?e :email "a@x"] [?e :age ?a]]') == 4 and other.pull("[:tags]", r.tempids[-1]) == {":tags": ["q"]}
    other.transact([[":db/retractEntity", r.tempids[-1]]])
    with pytest.raises(Exception, match="[Ee]xist"):  # the first connection has not seen that transaction
        conn.transact([{":email": "c@x"}])
    again = connect(spark, path, {":more": {":db/valueType": ":db.type/long"}})
    assert again.query("[:find [?m ...] :where [_ :email ?m]]") == ["b@x"] and again.query("[:find ?e . :where [?e :boss]]") is None and ":more" in again.db.attributes
    again.compact()
    again.clear()
    assert connect(spark, path).query("[:find ?e . :where [?e :email]]") is None
    again.close()
    with pytest.raises(ValueError):
        again.transact([{":email": "d@x"}])


def test_transactions_within(spark):
    conn = create_conn(spark, PEOPLE)
    with conn.transaction() as tx:
        tx.transact([{":email": "a@x", ":age": 1}])
        tx.transact([{":email": "a@x", ":age": 2}])
        assert tx.query("[:find ?a . :where [_ :age ?a]]") == 2 and ":age" not in conn.db.attributes
    assert conn.query("[:find ?a . :where [_ :age ?a]]") == 2 and len(conn.log) == 2
    with conn.transaction() as tx:
        tx.transact([{":email": "b@x"}])
        tx.abort()
    with pytest.raises(RuntimeError), conn.transaction() as tx:
        tx.transact([{":email": "c@x"}])
        raise RuntimeError
    assert conn.query("[:find [?m ...] :where [_ :email ?m]]") == ["a@x"]


def test_async_transactions(spark):
    conn, heard = create_conn(spark, PEOPLE), []
    waiting = [conn.transact_async([{":email": f"{i}@x"}], heard.append) for i in range(6)]
    waiting.append(conn.transact_async([[":db.fn/cas", 1, ":email", "no", "yes"]]))
    assert all(f.result(120).tx_data for f in waiting[:6])
    with pytest.raises(ValueError):
        waiting[6].result(120)
    assert len(conn.query("[:find [?m ...] :where [_ :email ?m]]")) == 6 and len(heard) == 6
    conn.close()


def test_batches_read_at_once(spark):
    """The jobs of a batch don't grow with its facts."""
    conn = create_conn(spark, PEOPLE)
    conn.transact([{":email": f"{i}@x", ":tags": ["t"], ":age": i} for i in range(40)])
    jobs = []

    def count(n):
        spark.sparkContext.setJobGroup(f"batch-{n}", "")
        after = db_with(conn.db, [{":email": f"{i}@x", ":age": i + 100, ":tags": ["u"]} for i in range(n)] + [[":db/retract", i + 20, ":tags", "t"] for i in range(1, n)])
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(found)
        return after

    count(2)
    after = count(18)
    assert jobs[1] <= jobs[0] + 1
    assert answer('[:find ?a . :where [?e :email "7@x"] [?e :age ?a]]', after) == 107 and len(answer("[:find ?e :where [?e :tags]]", after)) == 23
    assert len(answer('[:find ?e :where [?e :tags "t"]]', after)) == 23


def test_composite_tuples(spark):
    conn = create_conn(spark, {":a": {":db/valueType": ":db.type/string"}, ":b": {":db/valueType": ":db.type/long"}, ":a+b": {":db/tupleAttrs": [":a", ":b"]}})
    r = conn.transact([{":db/id": -1, ":a": "x", ":b": 2}])
    assert conn.query("[:find ?t . :in $ ?e :where [?e :a+b ?t]]", r.tempids[-1]) == ["x", "2"]
    conn.transact([[":db/add", r.tempids[-1], ":b", 3]])
    assert conn.query("[:find ?t . :in $ ?e :where [?e :a+b ?t]]", r.tempids[-1]) == ["x", "3"]


def test_components_and_references_go(spark):
    schema = {":part": {":db/valueType": REF, ":db/cardinality": MANY, ":db/isComponent": True}, ":see": {":db/valueType": REF}, ":links": {":db/valueType": REF, ":db/cardinality": MANY}}
    db = from_entities(spark, [{":db/id": 1, ":n": "a", ":part": [2]}, {":db/id": 2, ":n": "b", ":part": [3]}, {":db/id": 3, ":n": "c"}, {":db/id": 4, ":n": "d", ":see": 3, ":links": [1, 5]}, {":db/id": 5, ":n": "e"}], schema)
    from triplane.transact import with_

    report = with_(db, [[":db/retractEntity", 1]])
    assert sorted(answer("[:find [?n ...] :where [_ :n ?n]]", report.db_after)) == ["d", "e"]
    assert answer("[:find ?x . :where [4 :see ?x]]", report.db_after) is None and answer("[:find [?x ...] :where [4 :links ?x]]", report.db_after) == [5]
    assert {tuple(r) for r in report.cut_references.collect()} == {(4, ":see", "3"), (4, ":links", "1")}
    assert tx_log(spark, [report]).where("not added and e = 4").count() == 2


# --- numbers and draws ---
def test_exact_numbers(spark):
    big = 9007199254740993
    db = from_entities(spark, [{":db/id": 1, ":n": big, ":m": big - 1, ":x": 1.0, ":i": 1}])
    ask = lambda form: answer(f"[:find ?r . :where [1 :n ?n] [1 :m ?m] [1 :x ?x] [1 :i ?i] [{form} ?r]]", db)
    assert ask("(quot ?n 1)") == big and ask("(rem ?n 2)") == 1 and ask("(mod ?n -2)") == -1 and ask("(quot -7 2)") == -3 and ask("(quot ?x 2)") == 0.0
    holds = lambda form: answer(f"[:find ?e . :where [?e :n ?n] [?e :m ?m] [?e :x ?x] [?e :i ?i] [{form}]]", db) == 1
    assert not holds("(== ?n ?m)") and holds("(== ?x ?i)") and not holds("(= ?x ?i)") and holds("(= ?i 1)") and holds("(not= ?x ?i)") and not holds("(= ?n ?m)")


def test_ranked_and_drawn(spark):
    db = from_entities(spark, [{":db/id": i, ":g": i % 2, ":v": i} for i in range(1, 41)])
    got = dict((g, (a, b)) for g, a, b in answer("[:find ?g (min 3 ?v) (max 2 ?v) :where [?e :g ?g] [?e :v ?v]]", db))
    assert got == {0: ([2, 4, 6], [38, 40]), 1: ([1, 3, 5], [37, 39])}
    for g, s, r, one in answer("[:find ?g (sample 4 ?v) (rand 30 ?v) (rand ?v) :where [?e :g ?g] [?e :v ?v]]", db):
        assert len(set(s)) == 4 and len(r) == 30 and all(x % 2 == g for x in [*s, *r, one]) and len(set(r)) > 4
    assert answer("[:find (max 2 ?v) . :where [_ :v ?v]]", db) == [39, 40] and answer("[:find (sample 90 ?v) . :where [_ :v ?v] [(< ?v 4)]]", db) and len(answer("[:find (sample 90 ?v) . :where [_ :v ?v]]", db)) == 40
    from triplane.api import explain

    assert "WindowGroupLimit" in explain("[:find ?g (max 2 ?v) :where [?e :g ?g] [?e :v ?v]]", db)


def test_found_groups(spark):
    db = from_entities(spark, [{":db/id": 1, ":s": "ab12cd"}])
    assert answer('[:find ?r . :where [_ :s ?s] [(re-find "([a-z]+)([0-9]+)" ?s) ?r]]', db) == ["ab12", "ab", "12"]
    assert answer('[:find ?r . :where [_ :s ?s] [(re-find "[0-9]+" ?s) ?r]]', db) == "12"


def test_line_items_have_a_place(spark):
    from triplane.api import open_star, q

    db = open_star(spark, "/root/testdata/sf0.001", "lineitem")
    found = q("[:find ?l ?q :where [?l :lineitem/quantity ?q] [(> ?q 49.0)]]", db)
    plan = found._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,_tmp_metadata_row_index:bigint>" in plan and "GreaterThan(l_quantity,49.0)" in plan
    assert q("[:find (count ?l) . :where [?l :lineitem/orderkey]]", db).first()[0] == db.tables["lineitem"].count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from triplane.storage import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_kv_in_a_folder(spark, tmp_path):
    path = str(tmp_path / "kv")
    store = kv.open_kv(spark, path)
    store.open_dbi("a", "long", "string")
    store.open_list_dbi("l", "string", "long")
    for i in range(4):
        store.transact_kv("a", [(":put", i, f"v{i}"), (":del", i - 2)])
    store.transact_kv("l", [(":put-list", "x", [3, 1]), (":put", "y", 2), (":del", "x"), (":put-list", "x", [7]), (":del-list", "y", [9])])
    again = kv.open_kv(spark, path)
    assert again.list_dbis() == ["a", "l"] and [tuple(r) for r in again.dbis["a"].range().collect()] == [(2, "v2"), (3, "v3")]
    assert [tuple(r) for r in again.dbis["l"].list_range().collect()] == [("x", 7), ("y", 2)]
    with again.with_transaction_kv() as tx:
        tx.transact_kv("a", [(":put", 9, "nine")])
        assert tx.dbis["a"].get_value(9) == "nine" and again.dbis["a"].get_value(9) is None
    with again.with_transaction_kv() as tx:
        tx.transact_kv("a", [(":del", 9)])
        tx.abort_transact_kv()
    again.transact_kv_async("a", [(":put", 10, "ten")]).result(60)
    other = kv.open_kv(spark, path).copy(str(tmp_path / "copy"))
    assert other.dbis["a"].get_value(9) == "nine" and other.dbis["a"].get_value(10) == "ten" and other.stat("a")["entries"] == 4
    again.clear_dbi("a")
    again.drop_dbi("l")
    assert kv.open_kv(spark, path).list_dbis() == ["a"] and kv.open_kv(spark, path).dbis["a"].entries() == 0
    again.close_kv()
    with pytest.raises(ValueError):
        again.transact_kv("a", [(":put", 1, "x")])


def test_facts_in_bulk(spark, tmp_path):
    schema = {":name": {":db/valueType": ":db.type/string"}, ":n": {":db/valueType": ":db.type/long"}, ":tags": {":db/valueType": ":db.type/string", ":db/cardinality": MANY}, ":see": {":db/valueType": REF}}
    facts = spark.createDataFrame([(1, ":name", 'a "b"\n\\c'), (1, ":n", "5"), (1, ":tags", "x"), (1, ":tags", "y"), (2, ":name", "d"), (2, ":see", "1")], "e long, a string, v string")
    db = files.init_db(facts, schema)
    assert answer("[:find ?n ?m :where [?e :see ?o] [?e :name ?n] [?o :n ?m]]", db) == [("d", 5)]
    more = files.fill_db(db, spark.createDataFrame([(1, ":n", "6"), (3, ":name", "new"), (1, ":tags", "x"), (1, ":tags", "z")], "e long, a string, v string"))
    assert sorted(answer("[:find ?e ?n :where [?e :n ?n]]", more)) == [(1, 6)] and sorted(answer("[:find [?t ...] :where [1 :tags ?t]]", more)) == ["x", "y", "z"]
    files.dump_text(more, str(tmp_path / "d"))
    loaded = files.load_text(spark, str(tmp_path / "d"))
    for a in schema:
        assert sorted(map(tuple, loaded.scan(a).collect())) == sorted(map(tuple, more.scan(a).collect()))


def test_pull_visitor(family):
    seen = []
    pull.pull(family, "[:name {:_child [:name]} *]", 2, lambda *x: seen.append(x))
    assert (":db.pull/attr", 2, ":name", None) in seen and (":db.pull/reverse", None, ":child", 2) in seen and (":db.pull/wildcard", 2, None, None) in seen and (":db.pull/attr", 1, ":name", None) in seen


def test_english_stems():
    from triplane.operators.stemming import english

    known = {
        "consign": "consign", "consigned": "consign", "consistency": "consist", "consolation": "consol", "consolingly": "consol", "conspicuously": "conspicu", "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "knightly": "knight", "knitting": "knit",
        "generously": "generous", "communication": "communic", "running": "run", "ponies": "poni", "hopping": "hop", "hoping": "hope", "caresses": "caress", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "cries": "cri", "ties": "tie", "agreed": "agre", "happily": "happili",
        "nationalization": "nation", "sensational": "sensat", "relativity": "relat", "happy": "happi", "by": "by", "say": "say", "sky": "sky", "dying": "die", "news": "news", "succeeded": "succeed", "controlling": "control", "adjustable": "adjust", "bowling": "bowl", "hopefulness": "hope",
    }
    assert {w: english(w) for w in known} == known


def test_service(spark, tmp_path):
    import json

    from triplane.service import Service

    service = Service(spark, limit=2)
    ask = lambda op, **args: json.loads(json.dumps(service.handle(json.dumps({"op": op, "args": args}))))
    conn = ask("connect", path=str(tmp_path / "d"), schema='{":n" {":db/valueType" ":db.type/long"}}')["result"]
    sent = ask("transact", conn=conn, data='[{:db/id -1 :n 5 :s "x"} {:n 6} {:n 7}]')
    assert sent["ok"] and ask("q", conn=conn, query="[:find ?n . :where [_ :n ?n] [(< ?n 6)]]") == {"ok": True, "result": 5}
    found = ask("q", conn=conn, query="[:find ?e ?n :in $ ?least :where [?e :n ?n] [(>= ?n ?least)]]", inputs=[1])["result"]
    assert found["truncated"] and len(found["rows"]) == 2 and found["columns"] == ["e", "n"]
    first = sent["result"]["tempids"]["-1"]
    assert ask("pull", conn=conn, pattern="[:s]", id=first)["result"] == {":s": "x"} and ask("entity", conn=conn, id=first)["result"][":n"] == 5 and ask("count-datoms", conn=conn, a=":n")["result"] == 3
    store = ask("open-kv")["result"]
    assert ask("open-dbi", kv=store, name="t", key="long")["ok"] and ask("transact-kv", kv=store, name="t", txs=[[":put", 1, "a"], [":put", 2, "b"]])["ok"]
    assert ask("get-range", kv=store, name="t", range=[":at-least", 2])["result"]["rows"] == [[2, "b"]] and ask("list-dbis", kv=store)["result"] == ["t"]
    bad = ask("q", conn=conn, query="[:find ?x :where [?e :absent ?x]]")
    assert not bad["ok"] and "absent" in bad["error"] and not ask("nothing")["ok"] and ask("close", handle=conn)["ok"]


def test_postings_are_made_document_by_document(spark):
    rows = spark.createDataFrame([*TEXTS, (77, "red fox red"), (78, "the"), (79, None)], "doc long, text string")
    made = search.postings(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Aggregate", "Sort ", "Join", "Window"))
    assert sorted((r.term, r.tf, r.positions, r.norm) for r in made.where("doc = 77").collect()) == [("fox", 1, [1], 2), ("red", 2, [0, 2], 2)]
    assert made.where("doc > 77").isEmpty()


def test_an_id_with_more_texts_is_one_document(spark):
    made = search.build(spark.createDataFrame([(1, "red fox"), (1, "red hen"), (2, "red"), (None, "red")], "doc long, text string"))
    assert sorted((r.doc, r.term, r.tf, r.positions, r.norm) for r in made.postings.collect()) == [(1, "fox", 1, [1], 3), (1, "hen", 1, [1], 3), (1, "red", 2, [0, 0], 3), (2, "red", 1, [0], 1)]
    assert made.size == 2


ODD_WORDS = ["license mitöst", "License, mitten", "the LICENSE-MIT", "my-license x", "a_license", "license mit_x", "general public license", "General Public\nLicense", "general  public license", "a general, public license", "«general public license»", "gno-general public license.", "generals public license", None, ""]


@pytest.mark.parametrize("name", ["search_boolean", "search_phrase", "fulltext_pattern"])
def test_words_are_bounded_as_in_sql(spark, tmp_path, name):
    import duckdb

    from triplane.queries import QUERIES, SQL

    spark.createDataFrame([(i, t, "en") for i, t in enumerate(ODD_WORDS)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duck.execute(SQL[name]).fetchall())


def test_shares_take_a_vectors_total_once(spark):
    from triplane import queries_more

    rows = queries_more._derived(spark, "/root/testdata/sf0.001").select("shares")
    assert "/ aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum(rows.first().shares) == pytest.approx(1)


def test_prefixes_are_indexed_without_a_shuffle(spark):
    from triplane.operators import analysis as a

    rows = spark.createDataFrame([(i, f"size{i}") for i in range(30)], "doc long, text string")
    made = search.postings(rows, a.create_analyzer(filters=[a.lower_case, a.prefixes]))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("term = 'size1'").count() == 11
