"""Features of tracks and rules as data."""

import itertools

import pytest
from pyspark.sql import functions as F

from lamina.operators import features as ft
from lamina.operators import tracks as tr

CHECK = {"MFM": 352, "FM": 176, "C64": 92, "APPLE": 24, "AMIGA": 8192}


@pytest.mark.parametrize("encoding", tr.ENCODINGS)
def test_features_of_clean_and_hurt_tracks(spark, encoding):
    size = tr.SIZES[encoding]
    rows = [(t, s, bytes((t * 7 + s * 3 + i * 5) % 256 for i in range(size)).hex().upper()) for t in range(3) for s in range(4)] + [(1, 2, "41" * size)]
    df = spark.createDataFrame(rows, "track long, sector long, data string")
    cells = tr.encode(df, encoding, F.when((F.col("track") == 2) & (F.col("sector") > 1), CHECK[encoding]))
    got = {r["track"]: r for r in ft.features(cells.unionByName(spark.createDataFrame([(9, ""), (8, None)], "track long, cells string")), encoding).collect()}
    assert [(got[t]["headers"], got[t]["duplicates"], got[t]["bad"], got[t]["bad_headers"]) for t in (0, 1, 2, 8, 9)] == [(4, 0, 0, 0), (5, 1, 0, 0), (4, 0, 2, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    length = {r["track"]: len(r["cells"]) for r in cells.collect()}
    assert all(got[t]["cells"] == n and 0 < got[t]["gap"] < n for t, n in length.items()) and got[8]["gap"] == 0


def test_rules_equal_their_reading(spark):
    values = list(itertools.product([0, 3], repeat=3))
    names = ["cells", "ones", "gap", "headers", "duplicates", "bad", "bad_headers"]
    table = spark.createDataFrame([(i, "M", *v, 0, 0, 0, None) for i, v in enumerate(values)], "track long, machine string, " + ", ".join(f"{n} long" for n in names))
    rules = {
        "A": [("all", "cells", 1), ("all", "ones", 1)], "B": [("any", "cells", 1), ("any", "gap", 1)], "C": [("none", "cells", 1)], "D": [("all", "cells", 1), ("any", "ones", 1), ("any", "gap", 1), ("none", "ones", 4)],
        "E": [("all", "cells", 1), ("none", "gap", 1)], "F": [("all", "bad_headers", 0)], "G": [("any", "cells", 4)]}
    data = [("M", r, 50, *t) for r, terms in rules.items() for t in terms] + [("OTHER", "Z", 99, "all", "cells", 0)]
    got = {(r["track"], r["rule"]) for r in ft.hits(table, spark.createDataFrame(data, "machine string, rule string, conf int, kind string, feature string, least long"), "machine").collect()}
    want = set()
    for i, v in enumerate(values):
        row = dict(zip(["cells", "ones", "gap"], v, strict=True)) | {"bad_headers": None}
        for r, terms in rules.items():
            holds = {k: [row[f] is not None and row[f] >= least for kind, f, least in terms if kind == k] for k in ("all", "any", "none")}
            if all(holds["all"]) and (any(holds["any"]) or not holds["any"]) and not any(holds["none"]):
                want.add((i, r))
    assert got == want
