import pytest
from pyspark.sql import functions as F

from waymark.functions import text as T


def value(spark, col):
    return spark.range(1).select(col).head()[0]


def test_tokens(spark):
    assert value(spark, T.tokens(F.lit("U.S. Route 66, 1926!"))) == ["u", ".", "s", ".", "route", "66", ",", "1926", "!"]
    assert value(spark, T.tokens(F.lit("\u00e9"), decompose=True)) == ["e\u0301"]


@pytest.mark.parametrize(("answers", "body", "want"), [(["New York"], "in new york city", True), (["York New"], "in new york", False), ([""], "x", False), (["a", "b"], "c b", True)])
def test_has_answer(spark, answers, body, want):
    assert value(spark, T.has_answer(F.array(*map(F.lit, answers)), F.lit(body))) is want


@pytest.mark.parametrize(("p", "a", "f1"), [("the New York Yankees", "Yankees", 0.5), ("the", "a", 1.0), ("no no no", "no", 0.5), ("", "x", 0.0), ("a b c d", "c d e f", 2 * 2 / 7)])
def test_f1(spark, p, a, f1):
    assert value(spark, T.token_f1(F.lit(p), F.lit(a))) == pytest.approx(f1)


def test_normalize(spark):
    assert value(spark, T.normalize_answer(F.lit("The  U.S. Army!"))) == "us army"
    assert value(spark, T.normalize_answer(F.lit("éthe a"))) == "éthe"
    assert value(spark, T.exact_match(F.lit("An Apple."), F.array(F.lit("apple")))) == 1.0


@pytest.mark.parametrize(("reply", "want"), [('\n  Answer: "Paris"\nmore', "Paris"), ("", ""), (None, ""), ("'\"x\"'", "x"), ("Search query: a: b", "a: b")])
def test_first_line(spark, reply, want):
    assert value(spark, T.first_line(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize(("reply", "want"), [("Reasoning: x\nAnswer: no\nANSWER: yes\nz", "yes"), ("a\nb\n\n", "b"), ("", ""), ("Reasoning. answer:\n", "")])
def test_final_answer(spark, reply, want):
    assert value(spark, T.final_answer(F.lit(reply))) == want


@pytest.mark.parametrize(("q", "w", "want"), [("a b", None, False), ("a b", " ", False), ("a b", "A  B", False), ("a b", "a b?", True)])
def test_rewrite_usable(spark, q, w, want):
    assert value(spark, T.rewrite_usable(F.lit(q), F.lit(w).cast("string"))) is want


def test_features(spark):
    f = T.query_features(F.lit("Which is older, Big Ben or the Eiffel Tower in 1900?"))
    got = spark.range(1).select(*[v.alias(k) for k, v in f.items()]).head()
    assert (got.n_words, got.n_capitals, got.has_digit, got.wh_which, got.wh_other, got.n_cues) == (11, 4, 1, 1, 0, 2)


def test_yes_no_and_prompt(spark):
    yes = lambda *x: value(spark, T.is_yes_no(F.array(*map(F.lit, x))))
    assert yes("Yes", "yes") and not yes("yes", "no") and not yes("maybe")
    p = F.array(F.struct(F.lit("T").alias("title"), F.lit("x").alias("text")))
    assert value(spark, T.message("Do.", F.lit("q?"), p, "\nAnswer:")) == "Do.\n\nPassage 1 (T): x\n\nQuestion: q?\nAnswer:"


def test_composed_and_decomposed_letters_are_the_same(spark):
    composed, apart = "caf\u00e9 M\u00fcller", "cafe\u0301 Mu\u0308ller"
    rows = [(a, t, hit) for a, t, hit in [(["M\u00fcller"], apart, True), (["Mu\u0308ller"], composed, True), (["caf\u00e9 mu\u0308ller"], composed, True), (["muller"], composed, False), ([], composed, False), (["", None], composed, False)]]
    df = spark.createDataFrame(rows, "a array<string>, t string, hit boolean")
    assert all(r.got == r.hit for r in df.select("hit", T.has_answer(F.col("a"), F.col("t")).alias("got")).collect())
    leak = spark.createDataFrame([(["M\u00fcller"], apart, "who?"), (["M\u00fcller"], apart, composed)], "a array<string>, p string, q string")
    assert [r[0] for r in leak.select(T.leaks_answer(F.col("p"), F.col("q"), F.col("a"))).collect()] == [True, False]


def test_all_pairs_of_quotes_go(spark):
    rows = [("\"'\"'\"'x'\"'\"'\"", "x"), ("\" 'a' \"", "a"), ("'it's'", "it's"), ("\"a' b\"", "a' b"), ("''", ""), ("'", "'"), ("plain", "plain")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.select(T.first_line(F.col("t")).alias("got")).collect()] == [w for _, w in rows]
