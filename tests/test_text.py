from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import jsonx
from inkloom.functions import text as T


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[c] for c in names)], ", ".join(f"{c} string" for c in names)).select(expr.alias("x")).first()[0]


def test_normalise(spark):
    n = lambda s: one(spark, T.normalise(F.col("a")), a=s)
    assert n("We trof-\nfen het goed") == "We troffen het goed"
    assert n("# comment\nhello   world") == "hello world"
    assert n("café") == "café"
    assert n("sa­men") == "samen"
    assert n("") == ""
    assert n(None) is None


def test_rates(spark):
    c = lambda r, h: one(spark, T.cer(F.col("r"), F.col("h")), r=r, h=h)
    w = lambda r, h: one(spark, T.wer(F.col("r"), F.col("h")), r=one(spark, T.normalise(F.col("r"), True, True), r=r), h=one(spark, T.normalise(F.col("h"), True, True), h=h))
    assert c("Lieve Vader", "Lieve Vader") == 0
    assert abs(c("Lieve Vader", "Lieve Vadur") - 1 / 11) < 1e-9
    assert c("", "") == 0 and c("", "a") == 1
    assert w("Lieve Vader, Moeder en Han", "lieve vader moeder en han") == 0
    assert abs(w("een twee drie", "een twee") - 1 / 3) < 1e-9
    assert w("een twee drie", "een twee vier vijf") == 2 / 3


def test_wer_equals_brute_force(spark):
    def dp(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    pairs = []

    @settings(max_examples=60, database=None)
    @given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=12), st.lists(st.sampled_from("abcdx"), max_size=12))
    def collect(a, b):
        pairs.append((" ".join(a), " ".join(b)))

    collect()
    rows = spark.createDataFrame(pairs, "r string, h string").select("r", "h", T.wer(F.col("r"), F.col("h")).alias("x")).collect()
    for r in rows:
        a, b = r["r"].split(), r["h"].split()
        assert abs(r["x"] - dp(a, b) / len(a)) < 1e-9


def test_names(spark):
    ref = "Ik zag Harry en Frits in Middelburg. Morgen niet."
    x = lambda r, h: one(spark, T.name_recall(F.col("r"), F.col("h")), r=r, h=h)
    assert x(ref, "Ik zag Harry en Frits in Middelburg") == 1
    assert abs(x(ref, "Ik zag Harry en Fritz in Middelburg") - 2 / 3) < 1e-9
    assert x("geen namen hier", "x") is None


def test_file_names(spark):
    for s, letter, page in [("1945-03-15_p1", "1945-03-15", 1), ("L042_p12_extra", "L042", 12), ("IMG_20260906_123456", None, None)]:
        assert one(spark, T.letter_of(F.col("s")), s=s) == letter
        assert one(spark, T.page_of(F.col("s")), s=s) == page
    assert one(spark, T.stem(F.col("s")), s=".hidden") == ".hidden"
    assert one(spark, T.stem(F.col("s")), s="a.b.jpg") == "a.b"


def test_dates(spark):
    x = lambda s: str(one(spark, T.loose_date(F.col("s")), s=s))
    assert [x(s) for s in ("1945-03-15", "1945-03-15 later", "1945-03", "1945", "1945-02-30", "1945-13", "mei")] == ["1945-03-15", "1945-03-15", "1945-03-01", "1945-01-01", "None", "None", "None"]


def test_json_lines(spark):
    j = lambda s: [tuple(r) for r in one(spark, jsonx.parse_lines(F.col("s")), s=s)]
    good = '{"lines":[{"n":1,"text":"a","confidence":"high"},{"n":2,"text":"b"}]}'
    assert j(good) == [(1, "a", "high"), (2, "b", "medium")]
    assert j("```json\n" + good + "\n```") == j(good)
    assert j("regel een\nregel twee\n") == [(1, "regel een", "medium"), (2, "regel twee", "medium")]
    assert j('{"lines":["a","b"]}') == [(1, "a", "medium"), (2, "b", "medium")]
    assert j('{"lines":[{"n":"2","text":"a"}]}') == [(2, "a", "medium")]
    assert len(j('{"lines":[]}')) == 1 and len(j('{"lines":null}')) == 1
    assert j('{"lines":[{"n":null,"text":"a"}]}')[0][0] == 1
    assert j("a\n\nb") == [(1, "a", "medium"), (3, "b", "medium")]


def test_gold_json(spark):
    s = one(spark, jsonx.gold_json(F.col("s")), s="# note\nline one\n\nline two\n")
    assert '"n":2' in s and "note" not in s
    assert '"n":2' in one(spark, jsonx.gold_json(F.col("s")), s="a\r\n\u00a0\n\t# x\u2028b")


def test_reply_check(spark):
    ok = lambda s: one(spark, jsonx.well_formed(F.col("s")), s=s)
    assert ok('{"lines":[{"n":1,"text":"a","confidence":"low"}]}') and ok('{"lines":[]}')
    assert not any(ok(s) for s in ('{"lines":[{"n":1,"text":"a"}]}', '{"lines":[{"n":1,"text":"a","confidence":"x"}]}', '{"lines":[{"n":"1.5","text":"a","confidence":"low"}]}', "a", "", None, '{"x":1}'))


def test_reply_recovery(spark):
    got = lambda s: one(spark, jsonx.recovered(F.col("s")), s=s)
    r = '{"type":"result","is_error":false,"result":"hi","total_cost_usd":0.5,"usage":{"input_tokens":5,"output_tokens":4},"modelUsage":{"m":{}},"structured_output":{"lines":[]}}'
    assert tuple(got(r)) == (False, '{"lines": []}', "m", 5, 4, 0.5) == tuple(got("log line\n" + r)) == tuple(got('[{"type":"x"},' + r + ',{"type":"y"}]'))
    assert got('{"is_error":true,"result":"no"}')["is_error"] and got("nothing") is None and got(None) is None
