"""Scalar functions on hand-checked values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.chunking import count_tokens
from quarry.operators.index import tokenise
from quarry.providers import HashEmbedder, ScriptedGenerator, Unavailable, provider, structured, structured_chat


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", float: "double"}
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int")
    return row.select(column.alias("v")).first().v


TEXTS = ["向量库BM25", "", None, "Hello, world! it's", "ａｂＣ１ ไทย 한국어 𠀀x", "日本 語a1", "a_b-c", "ÀÉ ß"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_in_the_jvm_equal_those_in_python(spark, text):
    assert one(spark, X.tokens(F.col("t")), t=text) == tokenise(text)


def test_tokens_and_counts(spark):
    assert tokenise("向量库BM25") == ["向", "量", "库", "向量", "量库", "bm25"]
    for text, n in (("向量库BM25，ok", 6), ("abcde", 2), ("", 0), ("（全角）", 4)):
        assert one(spark, X.token_count(F.col("t")), t=text) == n == count_tokens(text)


def test_cleaning(spark):
    assert one(spark, X.sanitize(F.col("t")), t="a\x00b\tc\x0b\n") == "ab\tc\n"
    assert one(spark, X.fold(F.col("t")), t=" a  　b\n c ") == "a b c"
    assert one(spark, X.text_hash(F.col("t")), t=" a  b ") == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, X.chunk_hash(F.col("t"), "v1", "m", 8), t="a  b") == hashlib.sha256("a b\x1fv1\x1fm\x1f8".encode()).hexdigest()
    assert one(spark, X.node_id(F.col("d"), F.col("o")), d=7, o=3) == hashlib.sha1(b"7:3").hexdigest()[:16]


@pytest.mark.parametrize(("text", "lang"), [("中文字符" * 5, "zh"), ("plain", "en"), ("", "en"), ("abcdefgh中", "mixed")])
def test_language(spark, text, lang):
    assert one(spark, X.language(F.col("t")), t=text) == lang


def test_query_tests(spark):
    assert one(spark, X.mixed_language_term(F.col("t")), t="什么是 Transformer")
    assert not one(spark, X.mixed_language_term(F.col("t")), t="什么是 BERT") and not one(spark, X.mixed_language_term(F.col("t")), t="Transformer")
    assert one(spark, X.mostly_cjk(F.col("t")), t="这是一段很长的中文文字 abc") and not one(spark, X.mostly_cjk(F.col("t")), t="短文")
    assert one(spark, X.needs_translation(F.col("t")), t="한국") and not one(spark, X.needs_translation(F.col("t")), t="abc")
    assert one(spark, X.translation_guard(F.col("t"), F.lit(' "what is it" ')), t="它是什么") == "what is it"
    assert one(spark, X.translation_guard(F.col("t"), F.lit("仍是")), t="它") is None
    assert one(spark, X.keyword_salad(F.col("t")), t="粒球 分类 复杂 时间") and not one(spark, X.keyword_salad(F.col("t")), t="粒球 分类 复杂 时间 吗")
    assert one(spark, X.rewrite_guard(F.col("t"), F.lit("x" * 60)), t="ab") == "ab"


def test_clip_and_split(spark):
    assert one(spark, X.clip(F.col("t"), 10), t="abc。defgh。ijklmnop") == "abc。defgh。"
    assert one(spark, X.clip(F.col("t"), 10), t="ab。cdefghijklmnop") == "ab。cdefghi"
    assert one(spark, X.clip(F.col("t"), 10), t=None) == ""
    assert one(spark, X.split_keep(F.col("t")), t="a。b!\n c;d") == ["a。", "b!", " c;", "d"]


def plain_quote(answer, content, window=60):
    def grams(t):
        t = "".join(t.split())
        return {t[i : i + 2] for i in range(len(t) - 1)}

    a = grams(answer)
    if not a:
        return content[:window]
    best, at = -1, 0
    for p in range(0, max(len(content) - window, 0) + 1, window // 3):
        g = grams(content[p : p + window])
        if g and len(g & a) / len(g) > best:
            best, at = len(g & a) / len(g), p
    return content[at : at + window]


@pytest.mark.parametrize("content", ["short", "", "x " * 90 + "the needle is here in the text " + "y " * 70, "中文内容" * 40])
def test_best_quote(spark, content):
    for answer in ("the needle is here", "中文", "", "a"):
        assert one(spark, X.best_quote(F.col("a"), F.col("c")), a=answer, c=content) == plain_quote(answer, content)


def test_citations_labels_and_keys(spark):
    assert one(spark, X.citations(F.col("t")), t="a [3] b [1][3] [x]") == [3, 1]
    assert one(spark, X.label(F.col("t"), F.lit("S"), F.lit(2), F.lit(4)), t="T") == "T · S · p2-4"
    assert one(spark, X.label(F.col("t"), F.lit(""), F.lit(2), F.lit(2)), t="T") == "T · p2"
    assert one(spark, X.evidence_key(F.col("t")), t="O(n²) Times!") == "on2times"
    assert one(spark, X.highlight_terms(F.col("t")), t="ab 向量库 x") == ["ab", "向量", "量库"]
    assert one(spark, X.title_of_uri(F.col("t")), t="/a/b/My file.v2.pdf?x=1") == "My file.v2"
    assert one(spark, X.furniture_key(F.col("t")), t="- Page 12 of 30 -") == "page#of#"
    assert one(spark, X.is_junk(F.col("t")), t="short") and one(spark, X.is_reference_entry(F.col("t")), t="vol. 3, pp. 4") and one(spark, X.is_glued(F.col("t")), t="a" * 20)


def test_times_and_delays(spark):
    assert [one(spark, X.backoff_seconds(F.col("n")), n=n) for n in range(9)] == [5, 5, 10, 20, 40, 80, 160, 300, 300]
    assert one(spark, X.minutes(F.col("t")), t="09:05") == 545 and one(spark, X.minutes(F.col("t")), t="24:00") is None
    assert one(spark, X.hhmm(F.col("n")), n=545) == "09:05"


def test_tables(spark):
    cells = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1\n2")))
    assert one(spark, X.table_markdown(cells)) == "| a\\|b | c |\n| --- | --- |\n| 1 2 |  |"
    assert one(spark, X.table_markdown(F.array(F.array(F.lit(" "))))) is None
    assert one(spark, X.markdown_cells(F.col("t")), t="| a | b |\n|---|:-:|\n| 1 |  |") == [["a", "b"], ["1", ""]]


def test_vectors(spark):
    assert one(spark, X.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, X.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, X.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11


def test_providers(spark):
    e = HashEmbedder(16)
    want = [0.0] * 16
    for w in ("a", "b", "b"):
        want[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 16] += 1
    assert e.vector("A b B") == pytest.approx([x / sum(y * y for y in want) ** 0.5 for x in want])
    df = spark.createDataFrame([(1, "A b B"), (2, None)], "id int, t string")
    got = {r.id: r.dense for r in e.embed(df, "t").collect()}
    assert got[1] == pytest.approx(e.vector("A b B")) and got[2] == [0.0] * 16
    with pytest.raises(Unavailable):
        provider("generator", "none").chat([])
    with pytest.raises(ValueError):
        provider("generator", "other")
    assert structured('```json\n{"verdict": "ok"}\n```', {"verdict": str}) == {"verdict": "ok"}
    model = ScriptedGenerator([{"content": "no json"}, {"content": '{"verdict": "ok"}'}])
    assert structured_chat(model, [], {"verdict": str}) == {"verdict": "ok"} and len(model.seen) == 2
