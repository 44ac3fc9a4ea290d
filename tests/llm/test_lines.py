"""Repeated lines against a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.llm import lines
from tests.llm.conftest import as_rows

FOLD = str.maketrans(lines.UPPER, lines.UPPER.lower())


def plain(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    cut = [(i, (t or "").split("\n")) for i, t in rows]

    def key(line):
        return line.strip(lines.BLANK).translate(FOLD)

    for i, parts in cut:
        for line in parts:
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, parts in cut:
        kept = [
            x for x in parts
            if len(holders.get(key(x), ())) < least_docs or i is not None and i == max(holders[key(x)])
        ]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(spark, rows, **limits):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keep string, _at int")
    out = lines.drop_repeated_lines(table.repartition(5), **limits)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_examples(spark):
    a, b = "This line stands in many documents.", "and this one only in a pair of them"
    rows = [
        (1, f"{a}\nown\n{b}"), (2, f"  {a.upper()}\t\n{a}\nown"), (3, f"{a}\r\n{b}"), (4, f"x\n{a}\n\n{a} "),
        (5, None), (6, ""), (7, "\n"), (8, "short\nshort"), (9, "short"), (10, "short"),
        # A repeated row, one id with two texts, and no id at all.
        (1, f"{a}\nown\n{b}"), (3, f"{a}\nother"), (None, f"{a}\n{b}"), (None, None),
        # Nineteen code points, though more bytes; and letters that only full folding would join.
        *[(20 + i, "é" * 19) for i in range(3)], (30, "É" * 20), (31, "é" * 20), (32, "é" * 20),
        *[(40 + i, "\x1f" + "u" * 19 + "\x1f") for i in range(3)],
    ]
    out = got(spark, rows)
    assert out == plain(rows)
    assert (4, 4, 0, f"x\n{a}\n\n{a} ") in out and (2, 3, 2, "own") in out and (None, 2, 1, b) in out


@pytest.mark.parametrize("parts", [2, 4096])
def test_random_texts(spark, monkeypatch, parts):
    """Small alphabets make many ties; with few parts nothing, with many every frequent line is cut."""
    monkeypatch.setattr(lines, "PARTS", parts)
    random.seed(parts)
    common = [f"line number {i} of the common ones" for i in range(8)]
    rows = []
    for i in range(400):
        text = [random.choice(common[:1] * 6 + common) + random.choice(["", " ", "\t"]) for _ in range(random.randrange(6))]
        rows.append((random.choice([i, i, i, 7, None]), "\n".join(text + [f"own {i}"] * random.randrange(2))))
    rows += rows[:5]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, least_chars=1, least_docs=1) == plain(rows, 1, 1)


def test_long_text_and_bitmaps(spark):
    many = [f"a line that is long enough {i}" for i in range(20_000)]
    rows = [(1, "\n".join(many)), (2, "\n".join(many[::2])), (3, "\n".join(many[::2])), (4, "x" * 300_000)]
    assert got(spark, rows) == plain(rows)
    table = spark.createDataFrame(rows[:3] + [(9, many[1] + "\n" + many[0])], "doc_id long, text string")
    maps = {r["_doc"]: r for r in lines.keep_bitmaps(table).collect()}
    assert set(maps) == {1, 2, 3} and maps[2]["keep"] == [] and maps[3]["n_dropped"] == 1
    assert [tuple(x) for x in maps[3]["keep"]] == [(1, 9999)]


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_rows(lines.drop_repeated_lines(odd).select(F.struct("*"))) == sorted(repr(r) for r in map(_as_row, plain(rows)))
    assert lines.drop_repeated_lines(none).count() == 0


def _as_row(values):
    from pyspark.sql import Row

    inner = Row("doc_id", "n_lines", "n_dropped", "kept")(*values)
    return Row("struct(doc_id, n_lines, n_dropped, kept)")(inner)


def test_ranges_are_walked_without_a_second_exchange(spark, monkeypatch):
    """One exchange of rows by ranges serves both windows; no Python takes part."""
    plans = []

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return df

    monkeypatch.setattr(lines, "written", kept)
    table = spark.createDataFrame([(1, "x" * 30)], "doc_id long, text string")
    lines.drop_repeated_lines(table)
    walked = dict(plans)["repeated-lines"]
    assert walked.count("Window") == 2 and "Python" not in walked and "Arrow" not in walked
    assert walked.count("rangepartitioning(_h") == 1
    assert walked.split("Window")[-1].count("hashpartitioning") == 0
