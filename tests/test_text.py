import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx, vector
from corvane.functions.stem import stem, stem_tokens


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in cols.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text, n", [("hello world", 2), ("hello_world", 1), ("hello-world", 2), ("func(x, y)", 3), ("CamelCase", 1), ("snake_case_name", 1), ("123numbers456", 1), ("", 0), (None, 0)])
def test_split_words(spark, text, n):
    assert len(one(spark, tx.split_words("t"), t=text)) == n


def test_tokenize(spark):
    assert one(spark, tx.tokenize("t"), t="the quick brown Fox a I go to") == ["quick", "brown", "fox", "go"]
    assert one(spark, tx.tokenize("t"), t="É à") == ["é"] + ["à"]
    assert one(spark, tx.count_tokens("t"), t="hello world this is a test") == 7
    assert one(spark, tx.count_tokens("t"), t="") == 0


@pytest.mark.parametrize("word, want", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("is", "is"), ("été", "été")])
def test_stem(word, want):
    assert stem(word) == want


def test_stem_column(spark):
    assert one(spark, stem_tokens(tx.tokenize("t")), t="running dogs are playing") == ["run", "dog", "plai"]


def test_paths(spark):
    assert one(spark, tx.path_tokens("p"), p="/src/My-app/user_store.GO") == ["src", "my", "app", "user", "store", "go"]
    assert one(spark, tx.detect_language("p"), p="/a.b/c") == "unknown"
    assert one(spark, tx.detect_language("p"), p="x.hpp") == "cpp"
    assert one(spark, tx.short_path("p"), p="a/b/c.txt") == "c.txt"


def test_lines(spark):
    assert one(spark, tx.line_slice(tx.lines_of("t"), F.lit(0), F.lit(2)), t="a\nb\nc") == "a\nb"
    assert one(spark, tx.line_slice(tx.lines_of("t"), F.lit(4), F.lit(9)), t="a\nb\nc") == ""
    assert one(spark, tx.full_lines("t"), t="a\nb\n") == ["a", "b"]


def test_formats(spark):
    assert one(spark, tx.format_duration("n"), n=3725) == "1h2m"
    assert one(spark, tx.format_duration("n"), n=61) == "1m1s"
    assert one(spark, tx.json_in("t"), t='say {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, tx.json_in("t"), t="none") == "none"


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    got = row.select(vector.cosine("a", "b"), vector.cosine("a", "z"), vector.cosine("a", "s")).first()
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == (0.0, 0.0)
    text = one(spark, vector.mock_embedding("t", 5), t="aéb")
    assert text == pytest.approx([0.097, 0.233, 0.0, 0.098, 0.0], abs=1e-6)
    assert one(spark, vector.mock_embedding("t", 3), t="") == [0.0, 0.0, 0.0]


def test_displayed_numbers(spark):
    """Whole thousands; less than a second; two digits as C and Go print them, from the exact binary value."""
    import random

    rng = random.Random(4)
    numbers = [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(400)] + [k / 8 for k in range(200)] + [k / 200 for k in range(400)] + [0.0, 0.005, 0.015, 1e-9, 2.5e-3, 1.005, 2.675, 1e14, 123456789.125, -1.125, -0.004]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(2)
    assert all(r.t == f"{r.x:.2f}".replace("-0.00", "-0.00") for r in frame.select("x", tx.two_digits("x").alias("t")).collect())
    frame = spark.createDataFrame([(n,) for n in (0, 999, 1000, 1250, 1999, 999_999, 1_000_000, 2_999_999)], "n long")
    assert [r[0] for r in frame.select(tx.format_number("n")).collect()] == ["0", "999", "1k", "1k", "1k", "999k", "1M", "2M"]
    frame = spark.createDataFrame([(0.4,), (1.0,), (59.9,), (60.0,), (3725.0,)], "s double")
    assert [r[0] for r in frame.select(tx.format_duration("s")).collect()] == ["<1s", "1s", "59s", "1m0s", "1h2m"]


def test_tokens_by_one_pattern(spark):
    """The pattern leaves out what a filter on lower-cased words would."""
    odd = ["K a KK x", "İ İn the THE The_ thé", "é Aé ñ 日 本語 ٣ ٣٤", "AND and-or it's I'm a1 1a _ __ the1 Ofthe of", "ΑΣ'Α ſo ſ", "", None]
    frame = spark.createDataFrame([(t,) for t in odd], "text string")
    stop = F.array(*[F.lit(w) for w in tx.STOPWORDS])
    plain = F.filter(F.transform(tx.split_words("text"), F.lower), lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w))
    assert all(r.a == r.b for r in frame.select(plain.alias("a"), tx.tokenize("text").alias("b")).collect())
