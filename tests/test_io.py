"""Readers, writers, workspaces, jobs, command line, streaming."""

import json

import pytest
from kinweave import cli
from kinweave.functions.ids import AND_START, OR_START, RECURRENT_START
from kinweave.operators.clustering import Parameters
from kinweave.plans import experiments, pipelines
from kinweave.sources import readers, sinks
from kinweave.sources.workspace import Workspace, clean_path
from kinweave.streaming import counts as streaming


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def lines(df):
    return [r.value for r in df.collect()]


def test_text_readers(spark, put):
    assert readers.text_dataset(spark, "file:///no/such", "a long") is None and readers.scalar(spark, "file:///no/such") is None
    assert rows(readers.text_dataset(spark, put("e", "1 2 0.5\n3 4 1.0\n"), "a long, b long, w double")) == [(1, 2, 0.5), (3, 4, 1.0)]
    assert readers.scalar(spark, put("n", "17\n")) == "17"
    assert [r.tokens for r in readers.tokenised_lines(spark, put("t", " a  b c \nd\n")).collect()] == [["a", "b", "c"], ["d"]]
    assert [r.tokens for r in readers.tokenised_lines(spark, put("t", "It's A-b\nd\n"), clean=True).collect()] == [["it", "s", "a", "b"]]
    assert rows(readers.ngram_file(spark, put("g", "3,a,b\nbad\n2,c,d,e\n"))) == [(["a", "b"], 3), (["c", "d", "e"], 2)]
    assert rows(readers.bigram_file(spark, put("b", "3,a,b\nx\n2,c,d\n"))) == [("a", "b", 3), ("c", "d", 2)]
    assert rows(readers.bigram_file(spark, put("b2", "a,b,1\n"), count_last=True)) == [("a", "b", 1)]
    assert rows(readers.graph_edges(spark, put("ge", "((1,2),0.5)\n"))) == [(1, 2, 0.5)] and rows(readers.graph_vertices(spark, put("gv", "(1, x,0.5)\n"))) == [(1, "x", 0.5)]
    assert lines(readers.tweets(spark, put("tw", "Text: hi\nOrigin: x\nTime: 3\n")).withColumnRenamed("text", "value")) == ["hi", "x"]
    assert rows(readers.yearly_ngrams(spark, put("y", "a b\t1990\t3\na b\t1991\t4\na_N b\t1990\t3\nc\t1990\t1\n"))) == [(["a", "b"], 7)]
    assert rows(readers.labelled_examples(spark, put("l", "x\ta b a\n")).select("class_id", "tokens")) == [("x", ["a", "b"])]
    assert rows(readers.interaction_pairs(spark, put("p", "A\t1\t2\tB\nA\t1\t2\tA\n"))) == [("A", "B"), ("B", "A")]


def test_word_pairs(spark, put):
    assert rows(readers.word_pairs(spark, put("ws", "Word 1,Word 2,Human\nlove , sex,6.77\n"), "WS-353")) == [("love", "sex", 6.77)]
    assert rows(readers.word_pairs(spark, put("sl", "word1\tword2\tPOS\tSimLex999\nold\tnew\tA\t1.58\n"), "SIMLEX-999")) == [("old", "new", 1.58)]
    assert rows(readers.word_pairs(spark, put("men", "sun sunlight 50.0\n"), "MEN")) == [("sun", "sunlight", 50.0)]
    assert readers.word_pairs(spark, "x", "nope").count() == 0


def test_ratings_and_hierarchy(spark, put):
    blocks = readers.rating_blocks(spark, put("blocks", "7|2\n1\t90\t5\t10:00\n2\t90\t5\t10:01\n8|1\n3\t50\t6\t11:00\n"))
    flat = readers.ratings(spark, put("flat", "1\t90\t5\t10:00\t7\n2\t90\t5\t10:01\t7\n3\t50\t6\t11:00\t8\n"))
    assert rows(blocks) == rows(flat)
    assert rows(readers.hierarchy(spark, put("h", "1|2|None|5|6\n"))) == [(1, 2, None, [5, 6])]
    items, parents = readers.product_metadata(spark, put("am", "Id: 1\n  title: T\n |A[10]|B[11]|C[12]\nId: 2\n  title: U\n |A[10]\n"))
    assert rows(items) == [("1", "T"), ("2", "U")] and rows(parents) == [("11", "10"), ("12", "11")]


def test_graph_files(spark, put):
    doc = {"nodes": [{"name": "a", "group": 0}, {"name": "b", "group": 0}], "links": [{"source": 0, "target": 1, "value": 0.5}, {"source": 0, "target": 1, "value": 1.0}]}
    assert rows(readers.graph_json(spark, put("j", json.dumps(doc)))) == [("a", "b", 0.5)]
    assert rows(readers.graph_text(spark, put("gt", "0.5 a b\n1.0 a c\n\n0.2 x y\n"))) == [("a", "b", 0.5)]
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.1)], "src long, dst long, weight double")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "concept_id long, label string")
    got = json.loads(lines(sinks.graph_json(*sinks.graph_nodes_links(e, names, top=2)))[0])
    assert got == {"nodes": [{"name": n, "group": 0} for n in "abc"], "links": [{"source": 0, "target": 1, "value": 0.9}, {"source": 1, "target": 2, "value": 0.8}]}
    groups = spark.createDataFrame([(1, 5), (2, 5)], "concept_id long, cluster_id long")
    got = json.loads(lines(sinks.graph_json(*sinks.graph_nodes_links(e, names, groups, top=3)))[0])
    assert [n["group"] for n in got["nodes"]] == [5, 5] and len(got["links"]) == 1
    assert lines(sinks.top_edge_lines(e, names, 2)) == ["0.9 a b", "0.8 b c"]
    assert lines(sinks.cluster_csv(e, names, groups)[0]) == ["1,a,5", "2,b,5"]
    assert lines(sinks.cluster_lines(groups, names)) == ["5: a b"]
    hist = spark.createDataFrame([(0, 0.0, 2), (1, 1.0, 0)], "bin int, left double, n long")
    assert lines(sinks.histogram_lines(hist)) == ["0.0 1.0", "2 0"]


def test_nested_names_and_trees(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "concept_id long, label string")
    rec = spark.createDataFrame([(RECURRENT_START, 3, 2)], "rec_id long, concept_id long, n long")
    o, n = OR_START, AND_START
    g = spark.createDataFrame([(1, n), (2, n), (n, o), (RECURRENT_START, o), (o, o + 1), (99, o + 1)], "child_id long, parent_id long")
    got = {r.concept_id: r.name for r in sinks.nested_names(names, g, rec).collect()}
    assert got[n] == "[a,b]" and got[o] == "([a,b],c^2)" and got[o + 1] == "(([a,b],c^2),<99>)"
    ors = spark.createDataFrame([(1, o), (2, o), (o, o + 1), (3, o + 1)], "child_id long, parent_id long")
    sims = spark.createDataFrame([(1, 2, 0.75), (3, o, 0.5)], "src long, dst long, weight double")
    assert {r.concept_id: r.tree for r in sinks.newick(ors, sims, names).collect()} == {o: "(a:0.25,b:0.25);", o + 1: "(c:0.5,(a:0.25,b:0.25):0.5);"}
    assert lines(sinks.recurrent_lines(rec, names)) == ["c^2"]


def test_workspace(spark, tmp_path):
    assert clean_path("x") == clean_path("x/") == "x/"
    for form in ("parquet", "text"):
        path = f"file://{tmp_path}/{form}"
        ws = Workspace.load(spark, path, form)
        assert ws["concepts"] is None
        ands = spark.createDataFrame([(1, AND_START)], "child_id long, parent_id long")
        ws = ws.write(concepts=spark.createDataFrame([(1, "a")], "concept_id long, label string"), and_concepts=ands)
        ws = ws.write(concepts=ws["concepts"].unionByName(ws["concepts"]))
        again = Workspace.load(spark, path, form)
        assert again["concepts"].count() == 2 and rows(again["and-concepts"]) == [(1, AND_START)] and again["contexts"] is None
        assert again.inspect()["contexts"] is None
        again.write_parameters({"a": 1})
        assert Workspace.load(spark, path, form, swapped=True)["and-concept-lengths"] is not None
    with pytest.raises(KeyError):
        ws["nope"]


TEXT = "\n".join(["the cat sat on the mat", "the dog sat on the rug", "a cat and a dog", "the the cat"] * 5)


def test_jobs_end_to_end(spark, put, tmp_path, capsys):
    src, path = put("text", TEXT), f"file://{tmp_path}/ws"
    ws = pipelines.textfile_to_context_counts(Workspace(spark, path), src, 3, 2)
    assert ws["count"].first().n > 0 and ws["recurrent-concepts"].count() >= 1
    s = pipelines.GraphSettings("condprob", max_in=10)
    ws = pipelines.contexts_to_graphs(ws, s)
    assert ws["correlations"].count() > 0 and ws["similarities"].count() > 0
    ws = pipelines.cluster_vertices(ws, "mutualmax")
    assert ws["similarity-clusters"].count() > 0
    assert len(pipelines.export(ws, "graphs", "json", top=10)) == 2 and pipelines.export(ws, "concepts")
    assert set(pipelines.statistics(ws)) == {"correlations", "similarities"}
    ws = pipelines.contexts_to_concepts(ws, s, "mutualmax", Parameters())
    assert ws["and-concepts"].count() > 0
    for args in (["contexts", "-p", path + "2", "-if", src, "-ws", "3"], ["graphs", "-p", path + "2", "-cf", "condprob"], ["cluster", "-p", path + "2", "-cl", "edges", "-msm", "0.1"], ["inspect", "-p", path + "2"], ["statistics", "-p", path + "2"], ["export", "-p", path + "2", "-d", "graphs"]):
        assert cli.main(args, spark) == 0
    assert "context-counts" in capsys.readouterr().out
    text = pipelines.textfile_to_contexts(Workspace(spark, f"file://{tmp_path}/ws3"), src, 2, window=2, recurrent_min=1, unique=True)
    assert text["context-counts"].count() > 0 and text["recurrent-concepts"].count() >= 1
    back = pipelines.ngramfile_to_context_counts(Workspace(spark, f"file://{tmp_path}/ws4"), path + "/3-grams", 2)
    assert back["count"].first().n == Workspace.load(spark, path)["count"].first().n


def test_experiments_and_benchmarks(spark, put):
    b = readers.bigram_file(spark, put("bi", "\n".join(f"{3 + (i * j) % 5},w{i},w{j}" for i in range(8) for j in range(8) if i != j)))
    sims = pipelines.bigram_similarities(b)
    assert 0 < sims.count() <= 28
    for how in ("pmi", "npmi"):
        pipelines.bigram_similarities(b, edge_range=(-9, 9), how=how).count()
    pairs = spark.createDataFrame([("w1", "w2", 1.0), ("w2", "w3", 2.0), ("w3", "zz", 3.0)], "a string, b string, score double")
    labels = spark.createDataFrame([(f"w{i}", f"w{i}") for i in range(8)], "concept_id string, label string")
    scored, rho = pipelines.word_pair_benchmark(pairs, sims, labels)
    assert scored.where("weight is null").count() == 1 and rho.first().n == 2
    e = spark.createDataFrame([(i, j, 1.0 / (1 + (i * j) % 4)) for i in range(6) for j in range(6) if i != j], "src long, dst long, weight double")
    err = experiments.similarity_errors(e, [2, 5], 10).where("bound is not null and error > 2 * bound + 1e-9")
    assert err.count() == 0
    assert experiments.in_degree_sweep(e, [1, 3]).count() == 2 and experiments.similarity_sweep(e, [0.3]).count() == 1
    assert [r["max_in"] for r in experiments.runtimes(e, [1])] == [1]
    keyed = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "i long, j long, score double")
    assert experiments.word_similarity_sweep(e, keyed, [5]).first().n == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2)], "context_id long, concept_id long")
    a.coalesce(1).write.parquet(f"file://{src}")
    stream = spark.readStream.schema(a.schema).parquet(f"file://{src}")
    out = f"file://{tmp_path}/out"
    q = streaming.fold_pair_counts(stream, out, f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(streaming.folded_pairs(spark, out)) == [(1, 2, 2, 2, 2)]
    q = streaming.concept_stream(stream).writeStream.outputMode("complete").format("memory").queryName("concepts_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("concepts_seen")) == [(1, 2), (2, 2)]
