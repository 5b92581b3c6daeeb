import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from selvage.config import ConfigError, Settings
from selvage.functions import digest, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name,expected", [("lossDate", ["loss", "date"]), ("HTTPServerURL", ["http", "server", "url"]), ("loss_date", ["loss", "date"]), ("a.b-c__D", ["a", "b", "c", "d"]), ("", []), ("claim2Ref", ["claim2", "ref"])])
def test_tokens(spark, name, expected):
    assert one(spark, text.tokens(F.lit(name))) == expected


@pytest.mark.parametrize("word,stem", [("policies", "policy"), ("amounts", "amount"), ("boxes", "box"), ("loss", "loss"), ("sum", "sum"), ("settling", "settl"), ("closed", "clos"), ("ring", "ring"), ("need", "need"), ("ties", "tie")])
def test_lemma(spark, word, stem):
    assert one(spark, text.lemma(F.lit(word))) == stem


def test_head_and_expansion(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, text.head(words("loss", "date"))) == "date"
    assert one(spark, text.head(words("amount", "x"), text.type_nouns())) == "amount"
    assert one(spark, text.head(words("a", "b"), text.type_nouns())) == "b"
    assert one(spark, text.head(F.array().cast("array<string>"))) == ""
    assert one(spark, text.expanded(words("amt", "dttm", "codes"))) == ["amount", "dateTime", "code"]


def test_slug_title_collapsed(spark):
    assert one(spark, text.slug(F.lit("git"), F.lit("us"), F.lit("//A b/C.yaml//"))) == "git-us-a-b-c-yaml"
    assert len(one(spark, text.slug(F.lit("git"), F.lit("us"), F.lit("x" * 300)))) == 200
    assert one(spark, text.title(F.lit("o'neil mcX 3rd"))) == "o'neil mcX 3rd".title()
    assert one(spark, text.collapsed(F.lit(" a\t\n b "))) == "a b"


@pytest.mark.parametrize("a,b,expected", [((0, 10), (5, 15), 5 / 15), ((None, None), (0, 1), None), ((0, None), (0, None), 1.0), ((0, 5), (0, None), 0.0), ((3, 3), (3, 3), 1.0), ((0, 1), (5, 6), 0.0), ((None, 5), (None, 7), 1.0)])
def test_interval(spark, a, b, expected):
    got = one(spark, similarity.interval(*[F.lit(x).cast("double") for x in (*a, *b)]))
    assert got == expected or math.isclose(got, expected)


def test_constraints(spark):
    def of(*pairs):
        return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("expression")) for k, e in pairs]) if pairs else F.array().cast("array<struct<kind:string,expression:string>>")

    check = lambda a, b: one(spark, similarity.constraints(of(*a), of(*b)))
    assert check([], []) == 0.5 and check([("pattern", "x")], []) == 0.3
    assert check([("pattern", "x")], [("length", "minLength=1")]) == 0.0
    assert check([("pattern", "x")], [("pattern", "x")]) == 1.0
    assert math.isclose(check([("range", "minimum=0"), ("range", "maximum=10")], [("range", "minimum=5"), ("range", "maximum=15")]), 1 / 3)
    assert math.isclose(check([("range", "minimum=0"), ("range", "maximum=10"), ("pattern", "x")], [("range", "minimum=5"), ("range", "maximum=15"), ("pattern", "y")]), 1 / 6)


def test_sets_paths_vectors_types(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    assert one(spark, similarity.jaccard(words("a", "b"), words("b", "c"))) == 1 / 3
    assert one(spark, similarity.jaccard(words(), words())) == 0
    assert one(spark, similarity.path(F.lit("a.b"), F.lit(None).cast("string"))) == 0
    assert one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, similarity.types(F.lit("string"), F.lit("date"))) == 0.55 and one(spark, similarity.types(F.lit("date"), F.lit("string"))) == 0.55
    assert one(spark, similarity.types(F.lit("array"), F.lit("date"))) == 0 and one(spark, similarity.types(F.lit("array"), F.lit("array"))) == 1
    assert one(spark, similarity.enumerations(words("a"), words("A", "b"))) == 0.5 and one(spark, similarity.enumerations(words(), words("a"))) is None


@pytest.mark.parametrize("key", [b"k" * 16, bytes(range(32)), b"x" * 100])
def test_hmac(spark, key):
    assert one(spark, digest.hmac_sha256(key, F.lit("Läbel:value"))) == hmac.new(key, "Läbel:value".encode(), hashlib.sha256).hexdigest()


def test_keys_and_canonical_json(spark):
    with pytest.raises(ValueError):
        digest.key_of("zz")
    with pytest.raises(ValueError):
        digest.key_of("00")
    assert one(spark, digest.canonical(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_settings():
    assert Settings().with_overrides(link=0.8).link == 0.8
    for bad in ({"relevance_drop": 0.9}, {"review": 0.9}, {"block_max": 1}):
        with pytest.raises(ConfigError):
            Settings(**bad)
