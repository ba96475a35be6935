import pytest
from pyspark.sql import functions as F

from shoal.functions import config, text, validate
from shoal.functions.search import subsequence_score, subsequence_score_col
from shoal.operators.search import ranked_search


def values(spark, kind, rows, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    ("needle", "label", "score"),
    [("", "Split Right", 0), ("sr", "Split Right", 5), ("rs", "Split", None), ("zzz", "Split Right", None), ("SR", "split right", 5), ("ne", "New Tab", 0), ("ne", "Nord Elsewhere", 4), ("zoom", "Zoom In", 0), ("zoom", "Reset Zoom", 6), ("a.", "xa.b", 1)],
)
def test_score(spark, needle, label, score):
    df = spark.createDataFrame([(label, needle)], "label string, needle string")
    assert df.select(subsequence_score(F.col("label"), needle)).first()[0] == score
    assert df.select(subsequence_score_col(F.col("label"), F.col("needle"))).first()[0] == score


def test_ranked_search_orders_ties_by_label_and_ordinal(spark):
    df = spark.createDataFrame([(1, "xa beta"), (2, "xa Alpha"), (3, "xa alpha"), (4, "zz"), (5, None)], "o int, label string")
    assert [r.o for r in ranked_search(df, "label", "o", "xa").collect()] == [3, 2, 1]
    many = spark.range(500).selectExpr("id as o", "concat('Command ', id) as label")
    assert ranked_search(many, "label", "o", "command").count() == ranked_search(many, "label", "o", "").count() == 60


def test_validators(spark):
    ok = "123e4567-e89b-42d3-a456-426614174000"
    assert values(spark, "string", [ok, "", "word", "../x", ok.replace("-4", "-1"), ok.upper(), None, ok + "\n"], validate.is_uuid_v4(F.col("v"))) == [True] + [False] * 7
    assert values(spark, "string", ["a" * 1048576, "a" * 1048577, "😀" * 262145, None], validate.within_bytes(F.col("v"))) == [True, False, False, False]
    assert values(spark, "double", [80.0, 0.0, -1.0, 1e9, 80.5, float("nan"), float("inf"), None], validate.valid_dimensions(F.col("v"), F.lit(24))) == [True] + [False] * 7
    assert values(spark, "string", [None, "/tmp", "a\0b", "", "x" * 4097], validate.valid_directory(F.col("v"))) == [True, True, False, False, False]
    urls = ["https://a.example", "http://a.example/x?y", "mailto:a@b.example", "javascript:x", "file:///etc", "smb://h", "data:text/html,x", "", "not a url", "vbscript:x", None, "https://" + "a" * 2050, "https://"]
    assert values(spark, "string", urls, validate.safe_url(F.col("v"))) == [True] * 3 + [False] * 10
    assert values(spark, "double", [None, 1.0, 9.0], validate.clamp(F.col("v"), 2, 5)) == [None, 2.0, 5.0]


def test_text(spark):
    assert values(spark, "string", ["\x1b]0;a\x07b\0\x7f", "x" * 5000, None], text.clean_title(F.col("v"))) == ["]0;ab", "x" * 512, ""]
    assert values(spark, "string", ["/a%20b+c", "/%zz", "/%FF", None], text.percent_decoded(F.col("v"))) == ["/a b+c", None, None, None]
    assert values(spark, "string", ["x\x1b]7;file://h/a%20b\x07y", "\x1b]7;file://h/c\x1b\\", "no", "\x1b]7;file://h/open"], text.announced_directory(F.col("v"))) == ["/a b", "/c", None, None]
    assert values(spark, "string", ["/a/b", "C:\\x\\y.exe", "z"], text.basename(F.col("v"))) == ["b", "y.exe", "z"]
    assert values(spark, "string", ["/a", "C:\\x"], text.file_url(F.col("v"))) == ["file:///a", "file:///C:/x"]
    assert values(spark, "double", [-0.5, 0.5, 2.4], text.rounded_half_up(F.col("v"))) == [0.0, 1.0, 2.0]


def test_settings(spark):
    def got(raw, field):
        return values(spark, "string", raw, config.coerced(F.col("v"))[field])

    assert got(["{}", "null", '"s"', "42", "[]", "true", "not json", None], "fontSize") == [14] * 8
    assert got(['{"fontSize": 9999}', '{"fontSize": -5}', '{"fontSize": 14.7}', '{"fontSize": "huge"}', '{"fontSize": 1e999}', '{"fontSize": null}'], "fontSize") == [72, 6, 15, 14, 14, 14]
    assert got(['{"scrollback": 10}', '{"scrollback": 1e9}'], "scrollback") == [100, 200000]
    assert got(['{"lineHeight": 9}', '{"lineHeight": 1.25}'], "lineHeight") == [3.0, 1.25]
    assert got(['{"cursorBlink": "yes"}', '{"cursorBlink": false}'], "cursorBlink") == [True, False]
    assert got(['{"cursorStyle": "block"}', '{"cursorStyle": "laser"}'], "cursorStyle") == ["block", "bar"]
    assert got(['{"shell": "/bin/zsh"}', '{"shell": "/bin/zsh -l"}', '{"shell": 42}', '{"shell": "\\t/x\\n"}'], "shell") == ["/bin/zsh", None, None, "/x"]
    assert got(['{"shellArgs": ["-l"]}', '{"shellArgs": "x"}', '{"shellArgs": [1, 2]}'], "shellArgs") == [["-l"], None, None]
    assert got(['{"lastSession": ["/tmp", 42, "", null]}', '{"lastSession": "x"}'], "lastSession") == [["/tmp"], []]
    hundred = '{"shellArgs": [%s], "lastSession": [%s]}' % (",".join(['"a"'] * 100), ",".join(['"b"'] * 50))
    assert [len(x) for x in got([hundred], "shellArgs") + got([hundred], "lastSession")] == [32, 20]
    assert got(['{"theme": "%s"}' % ("x" * 513), '{"theme": "Nord", "evil": 1}'], "theme") == ["auto", "Nord"]


def test_settings_read_strict_json_and_the_last_of_equal_keys(spark):
    rows = ['{"fontSize":20,"fontSize":30}', '{"fontSize":20} x', '{"fontSize":20}{"fontSize":30}', '{"fontSize":20},{}', "{'fontSize':20}", '{"fontSize":1e999}', '{"fontSize":NaN}', ' {"fontSize" : 20 } ', "", None]
    assert values(spark, "string", rows, config.coerced(F.col("v"))["fontSize"]) == [30, 14, 14, 14, 14, 14, 14, 20, 14, 14]


def test_asserted_ids_end_the_query(spark):
    good = "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert values(spark, "string", [good], validate.asserted_uuid(F.col("v"))) == [good]
    with pytest.raises(Exception, match="not a version 4 uuid"):
        values(spark, "string", [good + "\n"], validate.asserted_uuid(F.col("v")))
