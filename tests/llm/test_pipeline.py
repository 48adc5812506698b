"""The stages of the corpus pipeline on hard cases, against plain versions in Python."""

import corpus_pipeline
import pytest
from tests.llm.test_operators import BASE, _prose, _words
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def _table(spark, rows):
    """One row per (id, text); ``source`` names the row, so results can be told apart where ids repeat."""
    return spark.createDataFrame([(i, t, "en", f"row {k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)


def _rows(df):
    return sorted(int(r.source.split()[1]) for r in df.select("source").collect())


def _kept_rows(rows, size=5, percent=80):
    """Of each group of near copies the row with the smallest id, null last; of equal ids any one."""
    sets = [{tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if (w := _words(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    groups = [[i for i in range(len(rows)) if group[i] == g] for g in sorted(set(group))]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [[i for i in g if key(i) == min(map(key, g))] for g in groups]


def test_near_dedup_decides_by_row(spark):
    near = BASE.replace(" a", " b", 1) + " tail"
    rows = [
        (1, BASE), (None, BASE), (None, _prose(21, 80)), (None, _prose(22, 80)),  # a null-id copy beside unique null-id rows
        (5, near), (5, _prose(23, 80)), (5, _prose(24, 80)),  # a repeated id, one of its texts a copy
        (7, _prose(25, 200)), (7, _prose(25, 200) + " end"), (7, _prose(25, 200)),  # near and equal copies under one id
        (None, _prose(26, 200)), (None, _prose(26, 200) + " end"),  # near copies without any id
        (8, None), (8, None), (9, ""), (None, None), (-3, "x"), (-4, "x"),
    ]
    got = _rows(corpus_pipeline.near_dedup(spark, _table(spark, rows).repartition(3), ""))
    groups = _kept_rows(rows)
    assert len(got) == len(groups)
    assert all(len(set(got) & set(g)) == 1 for g in groups)
