"""Scalar functions on small literal frames."""

import html

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import difference
from shelfsense.functions import coerce, lists, prompts, scoring, similarity, text
from shelfsense.registry.oracles import ORACLES
from shelfsense.registry.queries import QUERIES


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if not isinstance(v, tuple) else v[1]}" for k, v in values.items())
    row = tuple(v[0] if isinstance(v, tuple) else v for v in values.values())
    return spark.createDataFrame([row], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("$1,299.00", 1299.0), ("from 12.99", None), ("", None), ("  ", None), (" 3.5 ", 3.5), ("1e3", 1000.0), ("1.5f", None), ("nan", None), (None, None),
])
def test_to_float(spark, value, expected):
    assert one(spark, coerce.to_float(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value, expected", [("4.7", 4), ("-4.7", -4), ("x", None), ("1588687728923.0", 1588687728923), ("inf", None), ("$5", None)])
def test_to_int(spark, value, expected):
    assert one(spark, coerce.to_int(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value, expected", [("Y", True), ("no", False), ("maybe", None), ("0", False), ("2", True), (" TRUE ", True), (None, None)])
def test_to_bool(spark, value, expected):
    assert one(spark, coerce.to_bool(F.col("v"), numeric=True), v=value) is expected


def test_plain_bool_takes_known_words_only(spark):
    assert one(spark, coerce.to_bool(F.col("v")), v="2") is None
    assert one(spark, coerce.verified_flag(F.col("v")), v=None) == 0


def reference_clean(value):
    import re

    keep = html.unescape(value or "")
    keep = re.sub(r"<[^>]+>", " ", keep)
    keep = "".join(c for c in keep if c not in text.REMOVED_PUNCTUATION)
    return re.sub(r"\s+", " ", re.sub(r"([!?])", r" \1 ", keep)).strip()


@pytest.mark.parametrize("value", [
    None, "", " \t\xa0 ", "a!?b", "&amp;lt;b&gt; x", "<b>Hi</b>,there you", "“curly” it's 5*4", "tab\tnew\nline\x1cend", "caf\xe9 &eacute; &copy x",
])
def test_clean_review_text(spark, value):
    assert one(spark, text.clean_review_text(F.col("v")), v=value) == reference_clean(value)


@pytest.mark.parametrize("value", ["", "  ", "one", " a  b\tc ", "x\xa0y", "  a　b", "a\x1cb", None])
def test_token_count(spark, value):
    assert one(spark, text.token_count(F.col("v")), v=value) == len((value or "").split())


def test_snippet(spark):
    out = one(spark, text.snippet(F.col("v"), 20), v="a" * 300)
    assert len(out) == 20 and out.endswith("...")
    assert one(spark, text.snippet(F.col("v"), 20), v="  hello  ") == "hello"


def test_distinct_texts(spark):
    out = one(spark, text.distinct_texts(F.col("v")), v=(["A  b", "a B", " ", None, "c"], "array<string>"))
    assert out == ["A b", "c"]


@pytest.mark.parametrize("tokens, expected", [(0, 0.0), (10, 0.5), (19, 0.95), (20, 1.0), (100, 1.0), (200, 0.5), (299, 0.2), (300, 0.2), (1000, 0.2)])
def test_length_score(spark, tokens, expected):
    assert one(spark, scoring.length_score(F.col("n")), n=(tokens, "int")) == pytest.approx(expected)


def test_quality_of_a_single_review(spark):
    frame = spark.createDataFrame([(9,)], "n int")
    score = scoring.quality(F.lit(0.0), F.lit(True), scoring.length_score(F.col("n")))
    assert frame.select(score).first()[0] == pytest.approx(0.435)


@pytest.mark.parametrize("rating, training, serving", [
    (5.0, "positive", "positive"), (4.0, "positive", "positive"), (3.0, "neutral", "neutral"), (2.0, "negative", "negative"),
    (3.5, "negative", None), (2.5, "negative", None), (1.0, "negative", "negative"),
])
def test_two_rating_rules(spark, rating, training, serving):
    frame = spark.createDataFrame([(rating,)], "r double")
    assert tuple(frame.select(scoring.training_label(F.col("r")), scoring.rating_label(F.col("r"))).first()) == (training, serving)


@pytest.mark.parametrize("value, expected", [
    ('["a", " ", "b "]', ["a", "b"]), ("['x', 'y']", ["x", "y"]), ("plain text", ["plain text"]), ("[]", []), (None, []), ("  ", []), ("[broken", ["[broken"]),
    ("[2023] Model X", ["[2023] Model X"]), ('["a"] and more text', ['["a"] and more text']), ('["a", null, true, 3]', ["a", "None", "True", "3"]),
    ("['a', None]", ["a", "None"]), ("""['it\\'s', "b, c", 'd "e"',]""", ["it's", "b, c", 'd "e"']), ("{'a': 1}", ["{'a': 1}"]),
])
def test_parse_list(spark, value, expected):
    assert one(spark, lists.parse_list(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value, first, leading", [
    ("https://a/1.jpg", "https://a/1.jpg", "https://a/1.jpg"), ('["x", "http://a/2"]', "http://a/2", None), ('["http://a/2"]', "http://a/2", "http://a/2"),
    ('[{"thumb": "http://t"}]', "http://t", None), ('{"hi_res": "http://h", "url": "u"}', "http://h", None), ("[]", None, None), ("none", None, None), (None, None, None),
    ('[{"large": "https://a"}, "https://b"]', "https://a", None), ('[["x", ["https://n"]], "https://b"]', "https://n", None),
    ("[{'large': None, 'thumb': 'https://t'}, 'https://b']", "https://t", None), ('[{"large": ""}, "https://b"]', "https://b", None),
])
def test_images(spark, value, first, leading):
    assert one(spark, lists.first_image(F.col("v")), v=value) == first
    assert one(spark, lists.leading_image(F.col("v")), v=value) == leading


def test_prompts(spark):
    reviews = (["good", "fine"], "array<string>")
    out = one(spark, prompts.dataset_prompt(F.lit(""), F.lit(None).cast("string"), F.lit("neutral"), F.col("v")), v=reviews)
    assert out.startswith("Summarize the main neutral customer feedback for this product.\n\nProduct title: Unknown product\nCategory: Unknown category\n\nReviews:\n1. good\n2. fine\n\nRequirements:")
    empty = one(spark, prompts.insight_prompt(F.lit("T"), F.lit("C"), F.lit(" Positive "), F.col("v")), v=([], "array<string>"))
    assert "main positive customer" in empty and prompts.NO_REVIEWS in empty
    assert one(spark, prompts.placeholder_summary(F.col("v"), F.lit("neutral"), F.lit(2)), v="p") == (
        "Placeholder neutral summary generated from 2 representative reviews.")


def test_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    good = ([("user", "q1"), ("assistant", " a "), ("user", " q2 ")], kind)
    for messages, valid, user in [
        (good, True, "q2"), (([("user", "q")], kind), False, "q"), (([("user", "q"), ("assistant", " ")], kind), False, "q"),
        (([(None, "q"), ("assistant", "a")], kind), False, None), ((None, kind), False, None),
    ]:
        assert one(spark, prompts.messages_valid(F.col("v")), v=messages) is valid
        assert one(spark, prompts.last_of_role(F.col("v"), "user"), v=messages) == user


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"),
    ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
    ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("sky", "sky"), ("probate", "probat"), ("cease", "ceas"),
    ("dying", "die"), ("lying", "lie"), ("died", "die"), ("dies", "die"), ("enjoy", "enjoy"), ("news", "news"), ("spied", "spi"), ("skies", "sky"),
])
def test_porter_stem(word, stem):
    assert similarity.porter_stem(word) == stem


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_equals_table_method():
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert similarity.lcs_length(a, b) == brute_lcs(a, b)


def test_json_keeps_null_fields(spark):
    from shelfsense.functions.coerce import to_json_text

    assert one(spark, to_json_text(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))), v="") == '{"a":1,"b":null}'


def test_blocks_give_the_same_alignment(spark, monkeypatch):
    frame = spark.range(7).select(F.array(F.sin("id"), F.cos("id")).alias("v"), F.lit(1).alias("n")).agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n"))
    other = frame.select("v", "n", F.reverse("v").alias("w"), F.reverse("n").alias("m"))
    whole = other.select(similarity.soft_alignment("v", "n", "w", "m").alias("s")).first()["s"]
    assert abs(whole["f1"] - 1) < 1e-9


def test_closed_references_only(spark, tmp_path):
    value = "<b>a &amp</b> &copy; &ampx; &#233; &#xe9; &nosuch; &copy"
    assert one(spark, text.decode_entities(F.col("v"), closed=True), v=value) == "<b>a &amp</b> © &ampx; é é &nosuch; &copy"
    assert one(spark, text.decode_entities(F.col("v")), v=value) == html.unescape(value)
    rows = [(1, "u", "<title>one &amp</title><p>two &amp; &quot;three&quot; &copy; four&amp"), (2, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert difference(spark, con, QUERIES["clean_text_pages"], ORACLES["clean_text_pages"], str(tmp_path)) is None
