import pytest

from termloom.sources import files as S
from termloom.sources import tables as K


def test_concept_terms(spark):
    c = spark.createDataFrame([("1", "1"), ("9", "0")], "id string, active string")
    rows = [(1, "1", "1", "en", S.FSN, "Infarct (disorder)"), (2, "1", "1", "en", S.SYNONYM, "Attack"), (3, "1", "1", "en", S.SYNONYM, "Attack"), (4, "1", "1", "sv", S.SYNONYM, "x"), (5, "0", "1", "en", S.SYNONYM, "old"), (6, "1", "9", "en", S.FSN, "gone"), (7, "1", "1", "en", S.SYNONYM, " ")]
    d = spark.createDataFrame(rows, "pos long, active string, conceptId string, languageCode string, typeId string, term string")
    got = S.concept_terms(c, d).collect()
    assert [(r["sctid"], r["fsn"], r["synonyms"]) for r in got] == [("1", "Infarct (disorder)", ["Attack"])]
    assert S.concept_terms(c, d, spark.createDataFrame([("2",)], "id string")).count() == 0


def test_release_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.find_release_file(spark, str(tmp_path), "x_*.txt")
    folder = tmp_path / "Snapshot" / "Terminology"
    folder.mkdir(parents=True)
    f = folder / "sct2_Description_Snapshot-en_INT_20260101.txt"
    f.write_text("\t".join(S.DESCRIPTION_COLUMNS) + "\n" + "\t".join(["1", "2", "1", "m", "5", "en", S.FSN, 'Diameter 5 " catheter (object)', "c"]) + "\n" + "\t".join(["2", "2", "1", "m", "6", "en", S.FSN, "Plain (finding)", "c"]) + "\n")
    path = S.find_release_file(spark, str(tmp_path), "sct2_Description_*.txt")
    assert S.release_id(path) == "INT_20260101"
    assert {r["term"] for r in S.read_tsv(spark, path, S.DESCRIPTION_COLUMNS).collect()} == {'Diameter 5 " catheter (object)', "Plain (finding)"}
    (folder / "sct2_Description_Snapshot-en_INT_20260201.txt").write_text("x\n")
    with pytest.raises(ValueError):
        S.find_release_file(spark, str(tmp_path), "sct2_Description_*.txt")


def test_tmx(spark, tmp_path):
    f = tmp_path / "x.tmx"
    f.write_text('<?xml version="1.0"?><tmx><body><tu><tuv xml:lang="en"><seg>Heart</seg></tuv><tuv xml:lang="et"><seg>Süda</seg></tuv></tu><tu><tuv xml:lang="en"><seg>Only</seg></tuv></tu></body></tmx>')
    assert [(r["en"], r["target"]) for r in S.read_tmx(spark, str(f)).collect()] == [("Heart", "Süda")]


def test_glossary(spark):
    lines = spark.createDataFrame([(1, "heart; cor  심장"), (2, "HEART  염통"), (3, "no hangul  here"), (4, "x")], "pos long, value string")
    assert {(r["en"], r["target"]) for r in S.glossary_lines(lines).collect()} == {("heart", "심장"), ("cor", "심장")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b\nc')], "id string, t string")
    S.write_csv(df, str(tmp_path / "o"))
    assert S.read_csv(spark, str(tmp_path / "o"), ["id", "t"]).first()["t"] == 'a "q", b\nc'


def test_registry(spark, tmp_path):
    r = K.Registry(spark, str(tmp_path / "reg"))
    r.publish("datasets", "one", spark.range(3), {"parent": None})
    with pytest.raises(FileExistsError):
        r.publish("datasets", "one", spark.range(1))
    r.publish("datasets", "two", spark.range(4), {"parent": "one"})
    assert r.lineage("datasets", "two") == ["two", "one"] and r.read("datasets", "one").count() == 3
    with pytest.raises(ValueError):
        r.publish("datasets", "../x", spark.range(1))


def test_resume_and_status(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "k string")
    done = spark.createDataFrame([("a", "ERROR: x")], "k string, t string")
    assert [r["k"] for r in K.resume_by_key(todo, done, "k").collect()] == ["b"]
    assert [K.status(*x) for x in ((None, 1), (0, 0), (5, None), (5, 3), (5, 5))] == ["not_built", "no_pairs", "missing", "partial", "ready"]
    a = K.content_digest(todo)
    assert a == K.content_digest(todo.orderBy("k", ascending=False)) and a != K.content_digest(done.select("k"))


def test_crawl(spark):
    pages = spark.createDataFrame([("a", '<a href="b">'), ("b", '<a href="a"> <a href="c">'), ("c", ""), ("d", "")], "url string, html string")
    assert {r["url"] for r in S.crawl(pages, spark.createDataFrame([("a",)], "url string")).collect()} == {"a", "b", "c"}
