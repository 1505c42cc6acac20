import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tempoloom import ChunkParams, Engine, QueryParams
from tempoloom.functions.vectorfn import dimension
from tempoloom.plans import context
from tempoloom.sources import extract, files, workspace
from tempoloom.streaming.merge import append_mentions

TEXTS = {
    "2023-09": "Northwind Motors opened a plant in Poland. Northwind Motors hired Dana Reed.",
    "2023-12": "Northwind Motors sold batteries to Blue Harbor. Dana Reed left Northwind Motors.",
    "2024-03": "Blue Harbor bought batteries from Northwind Motors. Prices in Poland fell.",
    "2024-05": "Dana Reed joined Blue Harbor. Blue Harbor moved to Norway.",
    "2024-06": "Blue Harbor reported profits in Norway.",
}


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([(f"doc{i}", t, d, i) for i, (d, t) in enumerate(TEXTS.items())], "doc_id string, text string, date string, doc_ord long")
    e = Engine(spark, chunks=ChunkParams(min_tokens=0))
    e.insert(docs)
    e.build()
    return e


def test_question(engine):
    r = engine.query("What did Blue Harbor do in Norway?", QueryParams(top_k=8, similarity_threshold=0.2, final_max_tokens=2000))
    assert r.error is None and {x["name"] for x in r.entities} & {"Blue Harbor", "Norway"}
    assert r.relations and r.chunks and "Blue Harbor" in r.answer and "### Entities" in r.answer
    assert r.token_stats["entities_count"] == len(r.entities) and r.token_stats["total_tokens"] <= 2000
    scores = [x["score"] for x in r.entities]
    assert scores == sorted(scores, reverse=True) and len(r.entities) <= 8


def test_time_range(engine):
    r = engine.query("Blue Harbor batteries", QueryParams(time_range=("2024-03",), temporal_expansion_mode="strict", similarity_threshold=0.1))
    assert {x["date"] for x in r.entities} == {"2024-03"} and "2024-02, 2024-03, 2024-04" in r.answer
    assert engine.query("x", QueryParams(time_range=("2024-13",))).error
    assert engine.query("x", QueryParams(temporal_expansion_mode="no")).error


def test_braces_and_links(engine):
    assert "{time}" in engine.query("Why {time} in Norway?").answer
    assert engine.build_temporal_links() == 0
    s = engine.stats()
    assert s["stored_chunks"] == 5 and s["temporal_edges"] > 0 and s["num_nodes"] == s["entity_nodes"]


def test_saved_and_loaded(engine, spark, tmp_path):
    engine.save(str(tmp_path / "w"))
    other = Engine(spark)
    there = other.load(str(tmp_path / "w"))
    assert there["nodes"] and there["edge_centrality"] and not there["documents"]
    assert other.stats() == engine.stats()
    q = QueryParams(similarity_threshold=0.2)
    assert [x["node_id"] for x in other.query("Norway", q).entities] == [x["node_id"] for x in engine.query("Norway", q).entities]
    n, e = engine.tables["nodes"], engine.tables["edges"]
    g = workspace.export_graphml(n, e, str(tmp_path / "g"))
    x = workspace.export_gexf(n, e, str(tmp_path / "g"))
    import xml.dom.minidom

    for p, tag in ((g, "node"), (x, "edge")):
        text = "\n".join(r.value for f in sorted(__import__("glob").glob(f"{p}/part-*")) for r in [type("R", (), {"value": open(f).read()})])
        assert len(xml.dom.minidom.parseString(text).getElementsByTagName(tag)) == (n if tag == "node" else e).count()
    workspace.export_json(n, e, str(tmp_path / "j"))
    n2, e2 = workspace.import_json(spark, str(tmp_path / "j"), n.schema, e.schema)
    assert n2.count() == n.count() and e2.filter("is_temporal").count() == e.filter("is_temporal").count()
    (tmp_path / "nl.json").write_text(json.dumps({"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "a"}]}))
    assert [d.count() for d in workspace.import_node_link(spark, str(tmp_path / "nl.json"))] == [1, 1]
    (tmp_path / "bad").mkdir()
    with pytest.raises(FileNotFoundError):
        workspace.save(str(tmp_path / "bad"), {"nodes": n})
        workspace.load(spark, str(tmp_path / "bad"))


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "report_2024Q1.txt").write_text("two words\nhere", encoding="utf-8-sig")
    (d / "latin.md").write_bytes("café 2023-07-09".encode("latin-1"))
    (d / "a.json").write_text(json.dumps({"text": "from text", "n": 1}))
    (d / "b.json").write_text(json.dumps(["x", "y"]))
    (d / "c.json").write_text("{broken")
    (d / "empty.txt").write_text(" ")
    (d / "skip.xyz").write_text("no")
    (d / "x.pdf").write_bytes(b"%PDF")
    (d / "sub" / "latin.md").write_text("again")
    with zipfile.ZipFile(d / "w.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    f = files.scan(spark, str(d))
    docs = files.documents(f)
    got = {r.path.split("/in/")[1]: r for r in docs.collect()}
    assert set(got) == {"report_2024Q1.txt", "latin.md", "a.json", "b.json", "c.json", "empty.txt", "x.pdf", "sub/latin.md", "w.docx"}
    assert got["report_2024Q1.txt"].text == "two words\nhere" and got["report_2024Q1.txt"].date == "2024-03" and (got["report_2024Q1.txt"].lines, got["report_2024Q1.txt"].words) == (2, 3)
    assert got["latin.md"].text == "café 2023-07-09" and got["latin.md"].date == "2023-07" and got["latin.md"].doc_id != got["sub/latin.md"].doc_id
    assert got["a.json"].text == "from text" and got["b.json"].text == "x\ny" and got["w.docx"].text == "One\nTwo"
    assert all(got[k].error for k in ("c.json", "empty.txt", "x.pdf")) and got["a.json"].error is None
    s = files.ingest_stats(docs).first()
    assert (s.files, s.failed, s.formats) == (9, 3, ["docx", "json", "md", "txt"])
    assert {r.path.split("/in/")[1] for r in files.unread(f, docs).collect()} == {"c.json", "empty.txt", "x.pdf"}
    assert files.scan(spark, str(d), "*.md", recursive=False).count() == 1
    with pytest.raises(Exception):
        files.scan(spark, str(tmp_path / "none"))


def test_answers_of_models(spark):
    ok = '{"entities":[{"entity_name":"A"},{"entity_type":"T","entity_description":"d"}],"relationships":[{"source_entity":"A","target_entity":"B"}]}'
    rows = [("c0", "d", "2024-01", 1, 0, "x" * 300, ok), ("c1", "d", "2024-01", 1, 1, "t", "not json"), ("c2", "d", "2024-01", 1, 2, "t", None)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, date string, doc_ord long, chunk_index int, content string, answer string")
    assert [(r.name, r.type, r.description) for r in extract.entity_mentions(df).orderBy("ord").collect()] == [("A", "Other", ""), ("", "T", "d")]
    r = extract.relation_mentions(df).collect()
    assert len(r) == 1 and r[0].keywords == "related" and r[0].evidence == "x" * 200 + "..."

    def fails(system, text):
        if text == "t":
            raise RuntimeError("down")
        return ok

    assert [r.answer is None for r in extract.asked(df.drop("answer"), fails).orderBy("chunk_id").collect()] == [False, True, True]
    assert extract.fill("{a} {b}", a="{b}", b="x") == "{b} x" and len(extract.entity_types()) == 8


def test_budgets():
    b = context.budgets(1000, QueryParams(final_max_tokens=11_000, entity_max_tokens=2000))
    assert (b.available, b.entity, b.relation, b.chunk) == (10_000, 2000, 3000, 5000)
    assert context.joined("", "", "") == context.EMPTY and context.joined("e", "", "c") == "### Entities\ne\n\n### Document Chunks\nc"


def test_estimate(engine, spark):
    n = engine.tables["nodes"].withColumn("score", F.lit(1.0))
    r = engine.tables["edges"].withColumns({"score": F.lit(1.0), "type": F.lit("t"), "source": F.col("src"), "target": F.col("dst")})
    x = context.estimate(n, r, engine.tables["chunks"], 7).first()
    assert x.total == x.entities + x.relations + x.chunks + 7 and x.chunks == sum(len(t) // 4 for t in TEXTS.values())
    assert dimension() == 64 and dimension(lambda t: None) == 384


def test_stream(spark, tmp_path):
    schema = "doc_id string, content string, date string, doc_ord long, chunk_index int, chunk_id string"
    src = tmp_path / "src"
    spark.createDataFrame([("d", "Ann met Bob.", "2024-01", 1, 0, "d_chunk_0")], schema).write.parquet(str(src))

    def mentions(df):
        a = extract.asked(df)
        return extract.entity_mentions(a), extract.relation_mentions(a)

    for i in (1, 2):
        append_mentions(spark.readStream.schema(schema).parquet(str(src)), mentions, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/entity_mentions")).count() == 2 * i
        spark.createDataFrame([("e", "Cid met Dee.", "2024-02", 2, 0, "e_chunk_0")], schema).write.mode("append").parquet(str(src))
    assert spark.read.parquet(str(tmp_path / "out/relation_mentions")).filter(F.col("source") == "Cid").count() == 1


DOCS = "doc_id string, text string, date string, doc_ord long"


def test_inserts_after_loading_and_again(spark, tmp_path):
    rows = [(f"doc{i}", t, d, i) for i, (d, t) in enumerate(TEXTS.items())]
    path = str(tmp_path / "w")
    one = Engine(spark, chunks=ChunkParams(min_tokens=0))
    one.insert(spark.createDataFrame(rows[:3], DOCS))
    one.build()
    one.save(path)
    two = Engine(spark, chunks=ChunkParams(min_tokens=0))
    assert two.load(path)["entity_mentions"]
    two.insert(spark.createDataFrame(rows[2:], DOCS))  # the third again
    two.build()
    two.save(path)  # onto what it was loaded from
    whole = Engine(spark, chunks=ChunkParams(min_tokens=0))
    whole.insert(spark.createDataFrame(rows + [("doc0", "Older words.", "2023-09", -1)], DOCS))
    whole.build()
    three = Engine(spark)
    three.load(path)
    assert three.stats() == two.stats() == whole.stats()
    ids = lambda e: sorted(r.node_id + r.description for r in e.tables["nodes"].collect())
    assert ids(three) == ids(whole)
    assert workspace.prune(spark, path) == 1 and ids(three) == ids(whole)
    two.insert(spark.createDataFrame([("doc0", "Quiet Lake opened.", "2024-01", 9)], DOCS))
    two.build()
    assert two.stats()["stored_chunks"] == 5 and "Quiet Lake__2024-01" in {r.node_id for r in two.tables["nodes"].collect()}
    assert not two.tables["nodes"].filter("date = '2023-09'").count()


def test_failing_calls_and_missing_chunks(engine, spark):
    def fails(*_):
        raise RuntimeError("down")

    e = Engine(spark, keywords=fails, answer=fails)
    e.tables = {k: v for k, v in engine.tables.items() if k != "chunks"}
    r = e.query("Norway")
    assert r.answer == "" and "down" in r.error and r.keywords["low_level_keywords"] == [] and r.chunks == []
    ask = extract.model_keywords(lambda system, q: 'Here: {"high_level_keywords": ["trade", "trade", 3], "low_level_keywords": ["Norway"]}')
    assert ask("x") == (["trade"], ["Norway"]) and extract.model_keywords(fails)("x") == extract.model_keywords(lambda s, q: "no")("x") == ([], [])
    top = engine.search("Norway", 2, {"date": "2024-06"}).collect()
    assert len(top) == 2 and top[0]["name"] == "Norway" and top[0]["score"] >= top[1]["score"]


def test_ontology_and_prompts(spark, tmp_path):
    f = tmp_path / "o.json"
    f.write_text(json.dumps({"entity_types": {"SHIP": {"description_en": "a vessel", "examples": ["Ann"]}, "PORT": "a harbour"}}))
    o = extract.read_ontology(str(f))
    assert extract.entity_types(o) == [("SHIP", "a vessel", ["Ann"]), ("PORT", "a harbour", [])] and extract.stats(ontology=o)["entity_types"] == 2
    df = spark.createDataFrame([("x",)], "content string")
    assert extract.asked(df, lambda system, text: system, o, "Kinds: {types}").first().answer == "Kinds: SHIP (a vessel), PORT (a harbour)"


def test_files_into_the_engine(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a_2024-03.txt").write_text("Blue Harbor met Dana Reed.")
    (d / "b.json").write_text("{broken")
    log = str(tmp_path / "log")
    e = Engine(spark, chunks=ChunkParams(min_tokens=0))
    first = e.insert_files(str(d), log)
    assert (first["read"], first["failed"]) == (1, 1) and first["seconds"] > 0
    (d / "b.json").write_text(json.dumps({"text": "Quiet Lake met Blue Harbor. March 2024"}))
    again = e.insert_files(str(d), log)
    assert (again["files"], again["read"]) == (1, 1) and e.tables["chunks"].count() == 2
    assert e.insert_files(str(d), log)["files"] == 0
    s = files.ingest_stats(files.read_log(spark, log)).first()
    assert (s.files, s.read, s.dates) == (2, 2, 1) and s.seconds > 0 and s.max_seconds >= s.mean_seconds


def test_times_after_other_digits(spark):
    from tempoloom.functions.timefn import find_time, to_month

    names = {"doc_1234_2024-03.txt": "2024-03", "id20241_Q2 2023.md": "2023-06", "notes Feb 2022.txt": "2022-02", "99999 sept 2021": None, "x_12345": None, "Sep_2021": "2021-09", "May 2020": "2020-05"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.m for r in df.select("n", to_month(find_time(F.col("n"), F.lit(""))).alias("m")).collect()} == names
