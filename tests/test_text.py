from pyspark.sql import functions as F

from termloom.functions import replies as R
from termloom.functions import similarity as S
from termloom.functions import text as T


def one(spark, value, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(value.alias("x")).first()["x"]


def test_tags(spark):
    assert one(spark, T.semantic_tag(F.lit("Heart (disorder)"))) == "disorder"
    assert one(spark, T.semantic_tag(F.lit("Heart"))) == ""
    assert one(spark, T.strip_tag_last(F.lit("A (b) (c)"))) == "A (b)"
    assert one(spark, T.strip_tag_end(F.lit("A (b) (c)"))) == "A (b)"
    term, tag = T.parse_fsn(F.lit("Heart attack (disorder)"))
    assert (one(spark, term), one(spark, tag)) == ("Heart attack", "disorder")


def test_norms(spark):
    assert one(spark, T.norm_text(F.lit(" a b\t"))) == "ab"
    assert one(spark, T.without_space(F.lit("a\tb \n c"))) == "abc"
    assert one(spark, T.normalize_key(F.lit("X-Ray, of  É arm"))) == "x ray of arm"
    assert one(spark, T.corpus_normalize(F.lit("See http://a.b/c or É-9 me@x.org!"))) == "see or é"
    assert one(spark, T.light_normalize(F.lit("a \t b\r\n\n\n\nc"))) == "a b\n\nc"
    assert one(spark, T.markdown_strip(F.lit("a `b` [c](d) ![e](f)"))) == "a b c e"
    assert one(spark, T.text_or_empty(F.lit(None).cast("string"))) == ""


def test_sections_and_noise(spark):
    lines = F.array(*map(F.lit, ["# Intro", "one", "## References", "x", "### deep", "y", "# Next", "two"]))
    assert one(spark, T.skip_sections(lines)) == ["# Intro", "one", "# Next", "two"]
    lines = F.array(*map(F.lit, ["BIBLIOGRAPHY", "x", "SOME HEADER", "y"]))
    assert one(spark, T.skip_sections(lines)) == ["SOME HEADER", "y"]
    for text, noise in [("12", True), ("page 3 of 9", True), ("www.x.org", True), ("-----", True), ("tel +372 555 1234", True), ("plain words", False), ("", False), ("Main street 5", True)]:
        assert one(spark, T.is_layout_noise(F.lit(text))) is noise, text


def test_chunks(spark):
    text = F.lit("short\n\n" + "a" * 50 + "\n\n" + "\n".join(["b" * 45] * 20))
    assert [len(x) for x in one(spark, T.paragraphs(text))] == [50] + [45] * 20


def test_template(spark):
    assert one(spark, T.render_template("A {{context}} B {{extra}}", {"context": F.lit("CTX"), "extra": F.lit("E")})) == "A CTX B E"
    try:
        T.render_template("{{nope}}", {})
        raise AssertionError
    except ValueError:
        pass


def test_glossary(spark):
    keys = F.array(*map(F.lit, ["knee", "left knee", "knees", "arm"]))
    assert one(spark, T.glossary_hits(F.lit("X-ray of left knee"), keys)) == ["left knee"]
    assert one(spark, T.longest_form(F.lit("abcd"), ["a", "bc", "cd", "x"])) == "bc"
    assert one(spark, T.longest_form(F.lit("zzz"), ["a"])) is None


def test_chrf(spark):
    assert round(one(spark, S.chrf(F.lit("abc"), F.lit("abd"))), 4) == 38.8889
    assert round(one(spark, S.chrf(F.lit("ab"), F.lit("abc"))), 4) == 63.6364
    assert one(spark, S.chrf(F.lit(""), F.lit("abc"))) == 0
    assert round(one(spark, S.chrf(F.lit("a b c d e f"), F.lit("abcdef"))), 4) == 100
    best = one(spark, S.best_chrf(F.lit("ab"), F.array(F.lit("x"), F.lit("ab"), F.lit("ab "))))
    assert best["reference"] == "ab" and round(best["chrf"], 4) == 100


def test_similarities(spark):
    assert round(one(spark, S.char_similarity(F.lit("가 나 다"), F.lit("가나라"))), 6) == 0.666667
    assert one(spark, S.char_jaccard(F.lit("Ab c"), F.lit("abd"))) == 0.5
    assert one(spark, S.token_jaccard(F.lit(""), F.lit(""))) == 0
    assert round(one(spark, S.difflib_ratio(F.lit("abcd"), F.lit("bcde"))), 6) == 0.75
    assert one(spark, S.exact_match(F.lit("a b"), F.array(F.lit("x"), F.lit("ab"))))
    assert abs(one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.7071067) < 1e-6


def test_replies(spark):
    assert one(spark, R.best_index(F.lit("BEST: 1 or\nBEST: 2\nREASON: ok"), F.lit(3))) == 2
    assert one(spark, R.best_index(F.lit("BEST: 9"), F.lit(3))) is None
    assert one(spark, R.reason(F.lit("BEST: 2\nREASON: ok"))) == "ok"
    assert one(spark, R.score(F.lit("<think>SCORE: 1</think> so 7 then 8.5"))) == 8.5
    assert one(spark, R.label(F.lit('{"label": "minor"}'), ["CORRECT", "MINOR"])) == "MINOR"
    assert one(spark, R.confidence(F.lit("confidence: 9"))) == 5
    assert one(spark, R.verdict(F.lit("WINNER: tie"))) == "tie"
    assert one(spark, R.first_line_bare(F.lit('"Term."\nnote'))) == "Term"


def test_sentence_chunks(spark):
    got = one(spark, T.sentence_chunks(F.lit("Aa aa. Bb bb. Cc cc. Dd dd."), 14, 7))
    assert got == ["Aa aa. Bb bb.", "Bb bb. Cc cc.", "Cc cc. Dd dd."]
    assert one(spark, T.sentence_chunks(F.lit(""))) == []


def test_lines_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## References\ny\n# B\nz ")], "doc_id long, text string")
    found = docs.select(T.skip_sections(T.split_lines(T.markdown_strip(F.col("text")))).alias("x"))
    assert found.first()["x"] == ["# A", "x", "# B", "z "]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)```.*?```") == 1
    noise = docs.select(T.is_layout_noise(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert noise.count("\\u3000]+$") == 1


def test_normalised_texts(spark):
    for text, want in [("一" * 5000 + " a.b+c@d.ee, x@y", "一" * 5000 + " x y"), ("a@b.c+q@d.ef", ""), (".me@x.org Σ1Σ", "σ σ"), ("a　-  b", "a b")]:
        got = one(spark, T.corpus_normalize(F.lit(text)))
        assert got == want, (text[-20:], got)
    assert one(spark, T.strip(F.lit("　 a b\n"))) == "a b"
    assert one(spark, T.split_lines(F.lit("a\r\n"))) == ["a"]
    assert one(spark, T.split_lines(F.lit("a\n\n"))) == ["a", ""]
    assert one(spark, T.header_of(F.lit("ÜLDINE OSA")))["is_header"] is True
    assert one(spark, T.header_of(F.lit("STRAßE")))["is_header"] is False


def test_texts_without_what_a_pattern_needs(spark):
    for text, want in [("Wwww.X.org a", "w a"), ("a WWW.x.org", "a"), ("wWW.é b", "b"), ("HTTPS://q r", "r"), ("a\r\nb\rc", "a b c"), ("now. view", "now view"), ("www. a", "www a"), ("www", "www"), ("", "")]:
        got = one(spark, T.corpus_normalize(F.lit(text)))
        assert got == want, (text, got)


def test_frequent_chunks_are_counted_by_name(spark):
    """Ids that repeat or are missing, chunks that normalise to one text or to none; texts are not shuffled."""
    from termloom.operators import corpus

    rows = [(1, "Aa 1|b"), (1, "aa|aa"), (2, "AA!|c"), (2, "b|--"), (3, "--|d"), (None, "d"), (None, None), (4, None), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = F.split("text", r"\|")
    found = corpus.frequent_texts(docs, raw, 2)
    assert {(r["norm"], r["n"]) for r in found.collect()} == {("aa", 2), ("b", 3), ("", 2)} and found.count() == 3
    assert {(r["norm"], r["n"]) for r in corpus.frequent_texts(docs, raw, 1).collect()} == {("aa", 2), ("b", 3), ("", 2), ("c", 1), ("d", 1)}


def test_boilerplate_texts_are_not_shuffled(spark, sf):
    import __spark_entry__ as entry

    found = entry.queries()["chunk_df_boilerplate"](spark, sf)
    found.collect()
    assert "hashpartitioning(norm" not in found._jdf.queryExecution().executedPlan().toString()
