"""Column functions against fixed cases and Python's own behaviour."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import answers, pricing, text, times
from inkwell.functions.evaluation import RULES, add_rule, scored

EDGES = [
    "áb x\u00a0", "½ ² ③", "snake_case don't", "日本語。", "", "a\u200bb\u00adc\ue000d", "tab\there\nline\r", "x\x1cy\x85z",
    "Hello<script>", "Hello\x00World", "Hello, world: (test) 1+1=2", "a\u2028b\u3000c",
]


def test_token_count(column):
    assert column(text.token_count, ["áb x\u00a0", "½ ² ③", "snake_case don't", "日本語。", "", None]) == [2, 3, 4, 2, 0, 0]
    assert column(text.token_count, EDGES) == [len(re.findall(r"\w+|[^\w\s]", t)) for t in EDGES]


def test_word_count_and_words(column):
    assert column(text.word_count, EDGES) == [len(t.split()) for t in EDGES]
    assert column(text.words, EDGES) == [t.split() for t in EDGES]


def test_sanitize(column):
    kept = ["".join(c for c in t if (c.isprintable() or c in "\n\r\t") and c not in "<>") for t in EDGES]
    assert column(text.sanitize, EDGES) == kept
    assert column(text.sanitize, ["Hello<script>", "Hello\x00World"]) == ["Helloscript", "HelloWorld"]


def test_strip(column):
    padded = ["  a b ", "\u00a0\u3000x\n", "", " \t", "x"]
    assert column(text.strip, padded) == [t.strip() for t in padded]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é_1.,!\n\t<>\u00a0\u200b", max_size=30), min_size=1, max_size=20))
def test_text_functions_agree_with_python(column, texts):
    assert column(text.token_count, texts) == [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]
    assert column(text.words, texts) == [t.split() for t in texts]
    assert column(text.strip, texts) == [t.strip() for t in texts]


def test_statistics(column):
    source = "class A:\n  def f(self): pass\n\ndef g():\n    x = 'class B'\r\n  class C: pass"
    assert column(text.line_count, ["a\nb\n", "", source]) == [3, 1, 6]
    for word in ("class", "def"):
        want = len(re.findall(rf"^\s*{word}\s+\w+", source, re.MULTILINE))
        assert column(lambda c: text.definition_count(c, word), [source]) == [want]
    assert column(text.content_hash, ["abc", "abc", "abcd", "é"]) == [
        hashlib.md5(t.encode()).hexdigest() for t in ("abc", "abc", "abcd", "é")
    ]


def test_file_types(column):
    names = "document.pdf file.docx script.py archive.zip index.html notes.txt sheet.xlsx book.xls A.DOC noext a.b.TSX".split()
    want = "pdf docx py zip code txt excel excel docx txt code".split()
    assert column(text.file_type, names) == want
    assert column(lambda c: text.file_type(c, archives=False), ["archive.zip"]) == ["txt"]


def test_archive_member_rules(column):
    names = ["a/b.md", "x.xlsx", "y.java", "z.TXT", "q.txt.gz", "bin.exe", ".txt", "noext", "r.xls", "d/e.docx"]
    assert column(text.member_is_text, names) == [True, False, True, True, True, False, True, False, False, True]
    assert column(text.member_type, ["a.pdf", "b.doc", "c.py", "d.ts", "e.xlsx", "f.zip"]) == [
        "pdf", "docx", "py", "code", "txt", "txt",
    ]


def test_preview(column):
    assert column(text.preview, ["a" * 5000, "b" * 5001]) == ["a" * 5000, "b" * 5000 + "... (truncated)"]


def test_fixed_text_rounds_like_python(column):
    values = [0.0, 0.05, 0.25, 0.35, 1.05, 1.15, 31.25, 59.95, 99.99, 1234.5678, 2.675, 1e6 + 0.05, 0.1 + 0.2]
    for digits in (1, 2, 4):
        got = column(lambda c: text.fixed_text(c, digits), values, "double")
        assert got == [f"{v:.{digits}f}" for v in values]


def test_poll_interval(column):
    assert column(times.poll_interval_seconds, ["30s", "5M", "1h", "10", "", None, "x5s"]) == [
        30, 300, 3600, None, None, None, None,
    ]


def test_format_time(column):
    values = ["2024-01-01T00:00:00Z", None, "garbage", "2024-01-01T02:00:00+02:00", "1704067200", "2024-01-01T10:11:12.5"]
    assert column(times.format_time, values) == [
        "2024-01-01 00:00:00", "N/A", "N/A", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 10:11:12",
    ]
    assert column(lambda c: times.format_time(c, "HH:mm", "America/New_York"), ["2024-01-01T12:00:00Z"]) == ["07:00"]


def test_completion_time(column):
    got = column(lambda c: times.completion_time(c, F.lit(90)), ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "no"])
    assert got == ["2024-01-01 01:30:00 UTC", "2024-01-01 01:30:00 ", "Unknown"]


def test_elapsed_text(column):
    assert column(times.elapsed_text, [0.0, 59.94, 60.0, 63.0, 69.0, 3599.0, 5400.0], "double") == [
        "0.0 seconds", "59.9 seconds", "1.0 minutes", "1.1 minutes", "1.1 minutes", "60.0 minutes", "1.5 hours",
    ]


def test_older_than(column):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    values = ["2024-01-01T00:00:00", "2023-12-31T23:59:59", "unreadable", None]
    assert column(lambda c: times.older_than(c, as_of), values) == [False, True, False, False]


def test_stable_id(column):
    made = column(lambda c: times.stable_id("batch", F.timestamp_seconds(F.lit(1704067200)), c), ["a", "a", "b"])
    assert made[0] == made[1] != made[2]
    assert re.fullmatch(r"batch_1704067200_[0-9a-f]{12}", made[0])


def test_price_order(column):
    models = ["o1-pro", "o1-mini", "gpt-4o-mini", "gpt-4-turbo", "GPT-3.5-Turbo", "o3-mini"]
    assert column(lambda c: pricing.price_key(F.lower(c)), models) == [
        "o1-pro", "o1-mini", "gpt-4o", "gpt-4", "gpt-3.5-turbo", "default",
    ]
    run = lambda c: pricing.price_of(c, "input", pricing.RUN_PRICES, pricing.RUN_DEFAULT)
    assert [float(p) for p in column(run, models)] == [0, 0, 30, 30, 0, 0]


def test_structured(column):
    cases = {
        '{"summary":"x","key_points":["a","b"]}': True,
        '{"summary":1,"key_points":["a"]}': False,
        '{"summary":"x"}': False,
        "not json": False,
        '{"summary":"x","key_points":[1]}': False,
        '{"summary":"x","key_points":"a"}': False,
        '{"summary":"x","key_points":["a",null]}': False,
        '{"summary":"x","key_points":["a",1]}': False,
        '{"summary":"x","key_points":[null]}': False,
        '{"summary":"x","key_points":[]}': True,
        "[1]": False,
        '{"summary":"x","key_points":["a"],"more":{"b":1}}': True,
    }
    got = column(answers.parse_structured, list(cases))
    assert [r["valid"] for r in got] == list(cases.values())
    assert got[0]["key_points"] == ["a", "b"] and got[3]["error"] == "Invalid JSON"
    assert got[1]["error"] == "Response does not match schema"
    assert column(answers.parse_structured, [None])[0]["valid"] is False


def test_classify_error(column):
    messages = ["Error 401", "Authentication failed", "bad API KEY", "429 slow", "400 no such model", "400 bad", "Not Found", "404", "boom"]
    assert column(answers.classify_error, messages) == [
        "authentication", "authentication", "authentication", "rate_limit", "invalid_model", "bad_request",
        "not_found", "not_found", "other",
    ]


def test_retries(column):
    assert column(lambda c: answers.retryable(c, F.lit(0)), [429, 500, 502, 503, 504, 400, 200, None], "int") == [
        True, True, True, True, True, False, False, False,
    ]
    assert column(lambda c: answers.retryable(F.lit(429), c), [0, 2, 3], "int") == [True, True, False]
    assert column(answers.retry_delay, [0, 1, 2], "int") == [1.0, 2.0, 4.0]
    assert column(answers.poll_backoff, [1, 2, 5], "int") == [10.0, 20.0, 160.0]


def verdicts(column, name, criteria, values):
    return [tuple(r) for r in column(lambda c: scored(name, c, criteria), values)]


def test_keyword_rule(column):
    tide = "High water at NOON, low water by evening"
    assert verdicts(column, "keyword", {"keywords": ["noon", "High"]}, [tide]) == [(True, 1.0, "found 2/2 keywords")]
    assert verdicts(column, "keyword", {"keywords": ["storm"]}, ["Calm seas today"]) == [(False, 0.0, "found 0/1 keywords")]
    assert verdicts(column, "keyword", {"keywords": ["water", "storm"]}, [tide]) == [(False, 0.5, "found 1/2 keywords")]
    assert verdicts(column, "keyword", {"keywords": []}, [tide]) == [(True, 1.0, "no keywords specified")]


def test_keyword_rule_takes_an_array_column(spark):
    df = spark.createDataFrame([("a b", ["a", "C"]), ("x", [])], "r string, k array<string>")
    got = df.select(scored("keyword", F.col("r"), {"keywords": F.col("k")}).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(False, 0.5, "found 1/2 keywords"), (True, 1.0, "no keywords specified")]


def test_regex_and_length_rules(column):
    assert verdicts(column, "regex", {"pattern": r"berth [A-F]\d"}, ["moored at berth C7"])[0][:2] == (True, 1.0)
    assert verdicts(column, "regex", {"pattern": r"[0-9]{3}"}, ["berth C7"])[0][:2] == (False, 0.0)
    assert verdicts(column, "regex", {"pattern": ""}, ["x"]) == [(True, 1.0, "no pattern specified")]
    assert verdicts(column, "length", {"min_length": 3}, ["abcd", "ab"]) == [(True, 4.0, "length=4"), (False, 2.0, "length=2")]
    assert verdicts(column, "length", {"max_length": 3}, ["abcd", ""]) == [(False, 4.0, "length=4"), (True, 0.0, "length=0")]


def test_registry(column):
    with pytest.raises(ValueError, match="no rule is called 'rhyme'; known are keyword, length, regex"):
        scored("rhyme", F.col("v"), {})

    def shout(response, _):
        return F.struct((F.upper(response) == response).alias("passed"))

    add_rule("shout", shout)
    try:
        for rule in ("shout", shout):
            assert [r[0] for r in column(lambda c: scored(rule, c, {}), ["A", "a"])] == [True, False]
    finally:
        del RULES["shout"]
