"""Files of people and services: odd rows, malformed records, and what a project keeps when a write fails."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import config, documents, notes, project, tables, vectors, works


def test_front_matter():
    text = 'a: 1\nb: "x: y"\nc:\n  - one\n  - k: v\n    l: [1, "two, three", true]\nd:\n  e: |\n    first\n    second\n  f: null\ng: 1.5 # note\nh: {}\n'
    assert notes.read_front_matter(text) == {"a": 1, "b": "x: y", "c": ["one", {"k": "v", "l": [1, "two, three", True]}], "d": {"e": "first\nsecond", "f": None}, "g": 1.5, "h": {}}
    assert notes.read_front_matter("- title: T\n  doi: 10.1/x\n- title: U\n") == [{"title": "T", "doi": "10.1/x"}, {"title": "U"}]
    with pytest.raises(ValueError):
        notes.read_front_matter("a: 1\n   : : b\nc")


def test_notes_without_front_matter_are_empty():
    for text in (None, "", "# only a heading\n", "---\nbroken\n---\n\n## Method summary\nHow.\n"):
        note = notes.parse_note(text)
        assert note["paper_id"] is None and note["authors"] == [] and note["schema_version"] == 2
    assert notes.parse_note("---\nbroken\n---\n\n## Method summary\nHow.\n\n## Problem statement\nWhy\n")["method_summary"] == "How."
    assert notes.parse_note("---\npaper_id: 7\nschema_version: 3\n---\n")["schema_version"] == 3
    assert notes.parse_note("---\npaper_id: 7\n---\n")["schema_version"] == 1
    bad = notes.unsupported({"sample_size": {"value": 1}, "claims": [{"provenance": {"mechanism": "m"}}, {}], "population": {"language": [{}], "system_domain": None}})
    assert bad == ["claims[1]", "population.language[0]", "sample_size"]


def test_topic_and_query_bank():
    topic = config.read_topic("title: Gears of war\ncontact_email: REPLACE_ME\nyear_min: 2010\ndescription: |\n  One.\n  Two.\ncategories:\n  - replace_with_yours\n  - drives\nmethod_families:\n  - survey\ntarget_includes: 40\n")
    assert (topic.title, topic.contact_email, topic.year_min, topic.year_max, topic.description) == ("Gears of war", "", 2010, "present", "One.\nTwo.")
    assert (topic.categories, topic.method_families, topic.entity_types, topic.target_includes) == (["drives"], ["survey"], [], 40)
    assert config.read_topic(None) == config.Topic()
    bank = config.read_query_bank("# x\n\n## Query bank\n\n```text\n# note\ngear AND wheel\nExample topic one\n\nmesh\n```\n\n## Manual additions\n\n```yaml\n- title: T\n  year: 2001\n- venue: none\n```\n```yaml\n: broken\n```\n")
    assert bank.queries == ["gear AND wheel", "mesh"] and [(a["title"], a["year"], a["doi"]) for a in bank.additions] == [("T", 2001, "")]
    assert config.read_query_bank("") == config.QueryBank()


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b'id,name,note\r\n1,"a ""b"", c","two\r\nlines"\r\n,,\r\n2,short\r\n')
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "in.csv")).orderBy("id").collect()]
    assert got == [("1", 'a "b", c', "two\nlines"), ("2", "short", "")]
    rows = spark.createDataFrame([(1, 'q"', None), (2, "a,b", "plain"), (3, "x\ny", "")], "id int, a string, b string")
    tables.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*")).read_text()
    assert written == 'id,a,b\n1,"q""",\n2,"a,b",plain\n3,"x\ny",\n'
    assert sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out")).collect()) == [("1", 'q"', ""), ("2", "a,b", "plain"), ("3", "x\ny", "")]


def test_malformed_vectors_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h", [1.0, 2.0]), ("b", "h", None)], "id string, hash string, embedding array<float>")
    vectors.write_vectors(rows, str(tmp_path / "v"), "m")
    (tmp_path / "v" / "part-extra.txt").write_text("\n".join(["not json", '{"id": "c"}', json.dumps({"id": "d", "hash": "h", "vector": "AAAA"}), json.dumps({"id": "e", "hash": "h", "vector": "!!"}), "[1]", ""]))
    assert [(r.id, r.embedding) for r in vectors.read_vectors(spark, str(tmp_path / "v")).collect()] == [("a", [1.0, 2.0])]
    stamp = json.loads(spark.read.text(str(tmp_path / "v.stamp")).first()["value"])
    assert stamp == {"model": "m", "dtype": "float32", "dim": 2}


def test_a_failed_write_leaves_all_tables(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "p"))
    one = spark.createDataFrame([(1, "x")], "paper_id int, v string")
    p.write(a=one, b=one)
    bad = one.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        p.write(a=one.withColumn("v", F.lit("new")), b=bad)
    assert [r.v for r in p.read("a").collect()] == ["x"] and p.tables() == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        p.read("c")
    chunks = spark.createDataFrame([(1, "1:0"), (2, "2:0")], "paper_id int, chunk_id string")
    p.write(chunks=chunks, sections=chunks.select("chunk_id"))
    p.remove_papers(spark.createDataFrame([(1,)], "paper_id int"), ["a", "chunks"], "chunks", ("sections",))
    assert p.read("a").count() == 0 and [r.chunk_id for r in p.read("sections").collect()] == ["2:0"]


def test_exports_of_another_version_are_refused(spark, tmp_path, monkeypatch):
    p = project.Project(spark, str(tmp_path / "p"))
    p.write(a=spark.range(2))
    p.export(str(tmp_path / "e"))
    monkeypatch.setattr(project, "SCHEMA_VERSION", 99)
    with pytest.raises(ValueError, match="schema version"):
        p.import_(str(tmp_path / "e"))


def test_provenance_needs_a_mechanism(spark):
    with pytest.raises(ValueError):
        project.with_provenance(spark.range(1), "")
    facts, rows = project.with_provenance(spark.range(50).repartition(5), "m", first_id=10, confidence=0.5)
    assert sorted(r.prov_id for r in facts.collect()) == list(range(10, 60)) == sorted(r.prov_id for r in rows.collect())


def test_numbers_leave_out_those_in_use(spark):
    used = spark.createDataFrame([("002",), ("3",), ("7",), ("x",), (None,)], "paper_id string")
    rows = spark.createDataFrame([(c,) for c in "abcdef"], "name string")
    assert [r.paper_id for r in project.numbered_ids(rows, used, "name").orderBy("name").collect()] == ["001", "004", "005", "006", "008", "009"]


def test_stored_answers_are_read_by_partition(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"results": [{"id": f"https://openalex.org/W{i}", "title": "t", "abstract_inverted_index": {"b": [1], "a": [0]}}]}))
    answers = works.read_answers(spark, [str(tmp_path / f"{i}.json") for i in range(2)])
    got = works.works_to_candidates(works.openalex_works(answers), "q").orderBy("url").collect()
    assert [(r.url, r.abstract, r.authors, r.pdf_url) for r in got] == [("https://openalex.org/W0", "a b", "", ""), ("https://openalex.org/W1", "a b", "", "")]


def test_html_and_tei():
    page = "<title>T</title><h1>A <b>b</b></h1><p>one<p>two<br>three<script>no</script><ul><li>i</ul>"
    assert [b[:3] for b in documents.html_blocks(page)] == [("title", 0, "T"), ("head", 1, "A b"), ("p", 0, "one"), ("p", 0, "two three"), ("li", 0, "i")]
    assert documents.html_blocks(None) == [] and documents.tei_blocks("<a") == [] and documents.tei_blocks(None) == []


def test_numbered_ids_meet_no_pairs(spark):
    rows, used = spark.range(40).selectExpr("format_string('n%02d', id) as name"), spark.range(100).where("id % 3 = 0 or id between 20 and 40").selectExpr("string(id) as paper_id")
    taken, free, n = {i for i in range(100) if i % 3 == 0 or 20 <= i <= 40}, [], 1
    while len(free) < 40:
        free += [f"{n:03d}"] * (n not in taken)
        n += 1
    got = project.numbered_ids(rows, used, "name")
    assert [r.paper_id for r in got.orderBy("name").collect()] == free
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
