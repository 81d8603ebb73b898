import posixpath
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import matching, metrics, naming, urls

SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NAMES = st.lists(st.text(st.sampled_from("aB9 .-_/*%\\\né"), max_size=12), min_size=1, max_size=30)


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize("text, slug", [("Hello World 123!@#", "hello-world-123"), ("Test with spaces", "test-with-spaces"), ("Special!@#Chars$%^&*()", "special-chars"), ("", ""), ("  É  ", ""), ("a\tb", "a-b")])
def test_slug(spark, text, slug):
    assert values(spark, [text], naming.slugify(F.col("x"))) == [(slug,)]


@SOME
@given(NAMES)
def test_slugs_like_python(spark, texts):
    wanted = [(re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", t.strip().lower())),) for t in texts]
    assert values(spark, texts, naming.slugify(F.col("x"))) == wanted


def test_path_parts(spark):
    texts = ["a/b/Foo.TAR.gz", ".bashrc", "a.", "a..b", "..", "dir/", "", "x/.y.z/"]
    got = values(spark, texts, naming.stem(F.col("x")), naming.extension(F.col("x")))
    assert got == [("Foo.TAR", ".gz"), (".bashrc", ""), ("a", "."), ("a.", ".b"), ("..", ""), ("dir", ""), ("", ""), (".y", ".z")]


@SOME
@given(st.lists(st.text(st.sampled_from("ab./ "), max_size=10), min_size=1, max_size=30))
def test_base_names_like_python(spark, texts):
    assert values(spark, texts, naming.base_name(F.col("x"))) == [(posixpath.basename(t.rstrip("/")),) for t in texts]


def test_generated_names(spark):
    def name(original, field, mime):
        return naming.generated_name(F.lit(original).cast("string"), F.lit(field).cast("string"), F.lit(mime).cast("string"), F.col("x"))

    got = values(spark, ["x"], name("Test File Name 123.JPG", "pic ture", "image/png"), name("noextension", "f", "text/plain"), name(None, "f", None), name("é.png", " ", "image/png"), name("../../etc/passwd", "../up", "image/png"))[0]
    mark = got[1].removeprefix("noextension-")
    assert re.fullmatch("[0-9a-f]{4}", mark)
    assert got == (f"pic-ture-test-file-name-123-{mark}.jpg", f"noextension-{mark}", f"file-{mark}", f"{mark}.png", f"up-passwd-{mark}")


def test_converted_name_and_type(spark):
    assert values(spark, ["a.b.PNG"], naming.converted_name(F.col("x"), F.lit("JPG")), naming.output_mimetype(F.lit("JPG"))) == [("a.b.jpg", "image/jpg")]


def wildcard(key, name):
    return re.fullmatch("[^\\n\\r\\u2028\\u2029]*".join(map(re.escape, key.split("*"))), name) is not None if "*" in key else key == name


@SOME
@given(NAMES, st.text(st.sampled_from("aB9.*%_\\"), max_size=6))
def test_wildcards_like_python(spark, texts, key):
    assert values(spark, texts, matching.matches(F.col("x"), key)) == [(wildcard(key, t),) for t in texts]


def test_exact_keys_come_first(spark):
    keys = ["a*", "*", "ab"]
    assert values(spark, ["ab", "ac", "b", None], matching.match_key(F.col("x"), keys)) == [("ab",), ("a*",), ("*",), (None,)]
    assert values(spark, ["ab", "a*"], matching.match_key(F.col("x"), keys, wildcards=False)) == [("ab",), ("a*",)]


def test_image_predicates(spark):
    kinds = ["image/png", "imagexyz", "Image/png", None, "image/bmp"]
    got = values(spark, kinds, matching.is_image(F.col("x")), matching.is_convertible(F.col("x")), matching.is_unsupported(F.col("x"), F.lit(False)))
    assert got == [(True, True, False), (True, False, True), (False, False, False), (False, False, False), (True, False, True)]


def test_routes(spark):
    def route(cloud, output, keep=False):
        return matching.route(F.col("x"), F.lit(keep), F.lit(cloud), F.lit(output))

    got = values(spark, ["image/png", "text/plain", "image/bmp"], route(True, "disk"), route(False, "disk"), route(False, "memory"), route(False, "memory", True))
    assert got == [
        ("cloud_convert", "disk_convert", "memory_convert", "memory_passthrough"),
        ("cloud_passthrough", "disk_passthrough", "memory_passthrough", "memory_passthrough"),
        ("skipped", "skipped", "skipped", "memory_passthrough"),
    ]


def test_tier_is_strict(spark):
    assert values(spark, ["x"], *[matching.backup_tier(F.lit(n), 10) for n in (10, 11)]) == [("memory", "disk")]


def test_savings(spark):
    def both(a, b):
        return metrics.savings_ratio(F.lit(a), F.lit(b)), metrics.guarded_savings(F.lit(a), F.lit(b))

    assert values(spark, ["x"], *both(100, 25), *both(0, 5), *both(10, -1)) == [(0.75, 0.75, None, None, 1.1, None)]
    assert metrics.shown(1.005, 2) == "1.00" and metrics.shown(2.5, 0) == "3"
    assert metrics.savings_line("a", 2048, 1024) == "a: 2.00 KB -> 1.00 KB, saved 50.0 %"
    assert metrics.savings_line("a", 0, 0).endswith("n/a")


def test_urls(spark):
    key, none = F.lit("k"), F.lit("")
    got = values(spark, ["x"], urls.s3_url(F.lit("b"), F.lit("r"), key), urls.s3_url(F.lit("b"), F.lit("r"), key, F.lit("cdn")), urls.gcs_url(F.lit("b"), key, none))
    assert got == [("https://b.s3.r.amazonaws.com/k", "cdn/k", "https://storage.googleapis.com/b/k")]


def test_resource_types(spark):
    def kind(mime, name):
        return urls.resource_type(F.lit(mime).cast("string"), F.lit(name).cast("string"))

    got = values(spark, ["x"], kind("IMAGE/png", "a"), kind("video/x", "a"), kind("text/plain", "a"), kind(None, "a.PDF"), kind(None, "a.JPG"), kind("", None), kind(None, "noext"))
    assert got == [("image", "video", "raw", "raw", "auto", "auto", "raw")]


def test_folders_stay_below_the_root():
    assert naming.resolve_dir("/up/loads ", "/r") == "/r/up/loads"
    assert naming.resolve_dir("./a/../b", "/r") == "/r/b"
    assert naming.resolve_dir("C:\\x", "/r") == "C:\\x"
    for bad in ("", "  ", None):
        with pytest.raises(TypeError):
            naming.resolve_dir(bad, "/r")
    for bad in ("..", "a/../../b", "/../x", "..\\x"):
        with pytest.raises(ValueError):
            naming.resolve_dir(bad, "/r")
