import json
import math
import re

import pandas as pd
import pytest

from levelcast.llm import licenses
from levelcast.llm.queries import op10_licenses

from .fixtures import awkward, clashing, empty

FAMILIES = [licenses.UNKNOWN, *licenses.TEMPLATES]


def grams(text):
    w = [x.strip(" ").rstrip(".") for x in re.sub("[^a-z0-9.]+", " ", text.lower()).split(" ")]
    w = [x for x in w if x]
    return set(w) | {f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)}


@pytest.fixture(scope="module")
def model(spark):
    return json.loads(licenses.trained(spark))


def judge(line, model):
    """(family, p, similar, confirmed) in plain Python."""
    g = grams(line)
    at = [i for i, v in enumerate(model["vocab"]) if v in g]
    z = [(c["b"] + sum(c["w"][i] for i in at)) / model["heat"] for c in model["model"]]
    e = [math.exp(v - max(z)) for v in z]
    p = [v / sum(e) for v in e]
    k = p.index(max(p))
    family = FAMILIES[k]
    similar = max((len(g & grams(t)) / len(grams(t)) for t in licenses.TEMPLATES.get(family, [])), default=0.0)
    return family, p[k], similar, family != licenses.UNKNOWN and p[k] >= licenses.LEAST_P and similar >= licenses.LEAST_SIMILAR


def brute(text, model):
    lines = (text or "").split("\n")
    return [(i, *judge(x, model)) for i, x in enumerate(lines) if any(c in x.lower() for c in licenses.CUES)]


TEXTS = [
    "Licensed under the Apache License, Version 2.0. foo bar " + "x " * 300, "The apache license plate", "Read the license.\nLicensed under CC BY-SA 4.0\nSPDX-License-Identifier: GPL-3.0-only",
    "I have a license to drive in the public domain", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Copyright (c) 2020 Someone", "LICENSED UNDER THE MIT LICENSE.", "lizenz", "", None,
]


def test_against_plain_python(spark, model):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.found_paragraphs(docs).collect():
        want = brute(TEXTS[r.doc_id], model)
        assert len(r.l_found) == len(want)
        for got, (line, family, p, similar, sure) in zip(r.l_found, want, strict=True):
            assert (got.line, got.family, got.confirmed) == (line, family, sure)
            assert got.p == pytest.approx(p) and got.similar == pytest.approx(similar)


def test_families(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.license_report(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == ["Apache-2.0", "", "CC-BY-SA-4.0,GPL-3.0", "", "MIT", "BSD", "", "MIT", "", "", ""]


WRAPPED = {
    "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "GPL-3.0": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or",
    "MIT": "// Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software and associated documentation\n// files (the \"Software\"), to deal in the Software",
}


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_headers(spark, family):
    text = "import os\n\n" + WRAPPED[family] + "\n\nx = 1"
    got = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.families, got.n_licenses, got.findings) == (family, 1, f"2:{family}")


def test_family_names_are_cues(spark):
    docs = spark.createDataFrame([(0, "Released under the GNU GPL version 3"), (1, "CC BY 4.0"), (2, "the gnu ran over the hill")], "doc_id long, text string")
    assert {r.doc_id: r.families for r in licenses.license_report(docs).collect()} == {0: "GPL-3.0", 1: "CC-BY-4.0", 2: ""}


def test_the_model_is_sparse_and_right_on_held_examples(model):
    weights = [w for c in model["model"] for w in c["w"]]
    assert sum(w == 0 for w in weights) > len(weights) / 4
    held = licenses.examples()[1]
    right = sum(FAMILIES.index(judge(t, model)[0]) == y for y, t in held)
    assert right / len(held) > 0.9


def test_query(spark, model):
    found = op10_licenses(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    assert len(found) == len(docs)
    for i, t in docs.text.items():
        want = brute(t, model)
        sure = [w for w in want if w[4]]
        assert found.n_candidates[i] == len(want) and found.n_licenses[i] == len(sure) and found.n_unknown[i] == len(want) - len(sure)
        assert found.findings[i] == ",".join(f"{w[0]}:{w[1]}" for w in sure)


def test_awkward_rows(spark):
    docs = awkward(spark)
    plain, wide = (sorted(map(str, licenses.license_report(d).collect())) for d in (docs, clashing(docs)))
    assert len(plain) == docs.count() and plain == wide
    for r in licenses.license_report(docs).filter("doc_id in (100, 101, 102)").collect():
        assert (r.n_candidates, r.n_licenses, r.n_unknown, r.families, r.findings) == (0, 0, 0, "", "")
    assert licenses.license_report(empty(spark)).count() == 0


def test_the_plan_is_native(spark):
    plan = licenses.license_report(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
