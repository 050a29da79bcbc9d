"""License scan: a sparse word n-gram logistic regression over paragraphs, confirmed by templates.

Everything runs in DataFrame and SQL expressions. The multinomial regression (one class per
licence family and one for unknown text) is trained by proximal gradient descent inside one
SQL expression over the examples, L1-penalised so that most n-grams weigh nothing; its
temperature is calibrated on examples with words left out, which the training has not seen.
Lines that hold a cue word of some template are scored; the family with the highest
probability is reported if it beats the unknown class and the least probability, and if the
line contains enough of one of the family's templates. So are overlapping windows of the lines
of a paragraph (up to a line without letters or digits; comment marks are no words), since
headers are wrapped; a window counts only if it is confirmed and none of its lines is by itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"
#: Wordings by family, fixed values: the public short forms of each licence.
TEMPLATES = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "spdx license identifier apache 2.0", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "spdx license identifier mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "spdx license identifier gpl 3.0", "released under the gnu gpl version 3 license", "gnu gpl version 3"],
    "LGPL": ["licensed under the gnu lesser general public license", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2.1"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd 3 clause license", "licensed under the bsd license", "spdx license identifier bsd 3 clause"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "spdx license identifier isc"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "Public-Domain": ["this is free and unencumbered software released into the public domain", "released into the public domain without any copyright", "dedicated to the public domain under cc0 1.0 universal license"],
}
#: Text that uses the same words and grants nothing, fixed values.
OTHER = [
    "he renewed his driving license at the office", "the license plate of the car was new", "they were licensed to sell food", "a fishing license is required here",
    "the apache tribe lived in the south", "an apache helicopter version", "she studied at mit in boston", "the public library is free", "version 2.0 of the game is out",
    "permission to leave was granted by the teacher", "copyright law is hard to read", "all rights reserved", "the copyright notice was torn", "the software comes without warranty",
    "the general public was not told", "the foundation was published in the spring", "a work of art under the bridge", "the domain name is public", "redistribution of wealth and land",
    "terms and conditions apply to this offer", "read the license before you open the box", "this license has expired", "the license fee is due", "the bar lost its liquor license",
    "the creative team released a new film", "the warranty covers two years", "please copy and distribute the leaflet", "mit der lizenz", "sous licence", "bajo licencia", "permission denied by the server",
]
#: Parts of lower-cased text, one of which every template has.
CUES = ("licen", "copyright", "redistribut", "public domain", "permission", "gnu ", "gpl", "cc by", "cc-by", "creative commons", "mozilla", "spdx")
#: Lines of a window of a wrapped paragraph; a window starts at every line.
WINDOW = 6
#: Training: iterations, step, L1 penalty. Calibration: temperatures tried.
STEPS, RATE, L1 = 60, 2.0, 2e-4
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
#: Least probability of a family, and least share of a template's n-grams in the paragraph.
LEAST_P, LEAST_SIMILAR = 0.5, 0.6


def ngrams(text: str) -> str:
    """SQL for the different words and word bigrams of a text expression, lower-cased, punctuation off."""
    words = f"filter(split(regexp_replace(lower({text}), '[^a-z0-9.]+', ' '), ' '), q -> rtrim('.', q) != '')"
    words = f"transform({words}, q -> rtrim('.', q))"
    pairs = "transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat(w[i - 1], '_', coalesce(w[i], '')))"
    return f"transform(array({words}), w -> array_distinct(concat(w, if(size(w) > 1, {pairs}, cast(array() as array<string>)))))[0]"


def examples() -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(class, text) for training and for calibration; class 0 is unknown, the families follow."""
    train, check = [], []
    words: set[str] = set()
    for y, (family, texts) in enumerate(TEMPLATES.items(), 1):
        for text in texts:
            w = text.split()
            words.update(w)
            train += [(y, text), (y, "notice " + text), (y, text + " see the file for details")]
            check += [(y, " ".join(w[:i] + w[i + 1 :])) for i in range(0, len(w), 4)]
    train += [(0, t) for t in OTHER[::2]] + [(0, w) for w in sorted(words)] + [(0, "")]
    check += [(0, t) for t in OTHER[1::2]] + [(0, " ".join(OTHER[i].split()[:4])) for i in range(0, len(OTHER), 2)]
    return train, check


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _scores(w: str, x: str) -> str:
    """SQL for the classes' scores: bias and the weights of the n-gram numbers ``x``."""
    return f"transform({w}, c -> c.b + aggregate({x}, 0D, (a, i) -> a + element_at(c.w, i)))"


def _softmax(z: str) -> str:
    return f"transform(array({z}), z -> transform(array(transform(z, v -> exp(v - array_max(z)))), e -> transform(e, v -> v / aggregate(e, 0D, (a, u) -> a + u)))[0])[0]"


_MODELS: dict[str, str] = {}


def trained(spark: SparkSession) -> str:
    """The model as JSON (vocabulary, weights, temperature); trained once per application."""
    app = spark.sparkContext.applicationId
    if app not in _MODELS:
        _MODELS[app] = _fitted(spark)
    return _MODELS[app]


def _fitted(spark: SparkSession) -> str:
    train, check = examples()
    kind = "array<struct<y:int,t:string>>"
    pack = lambda rows: _literal([{"y": y, "t": t} for y, t in rows], kind)
    base = spark.range(1).select(pack(train).alias("train"), pack(check).alias("held"))
    base = base.select(*[F.expr(f"transform({c}, e -> named_struct('y', e.y, 'g', {ngrams('e.t')}))").alias(c) for c in ("train", "held")])
    base = base.withColumn("vocab", F.expr("array_sort(array_distinct(flatten(transform(train, e -> e.g))))"))
    number = "transform(array_intersect(e.g, vocab), g -> cast(array_position(vocab, g) as int))"
    base = base.select("vocab", *[F.expr(f"transform({c}, e -> named_struct('y', e.y, 'x', {number}))").alias(c) for c in ("train", "held")])
    base = common.staged(base, "license-examples")
    base = base.withColumn("rows", F.expr("transform(sequence(1, size(vocab)), v -> filter(transform(train, (e, n) -> if(array_contains(e.x, v), n + 1, 0)), n -> n > 0))"))
    classes = len(TEMPLATES) + 1
    # each class weighs alike: an example counts for the number of examples over its class's own
    share = "transform(sequence(0, %d), c -> size(filter(train, e -> e.y = c)))" % (classes - 1)
    base = common.staged(base.withColumn("share", F.expr(share)), "license-rows")
    wrong = f"transform(train, e -> transform({_softmax(_scores('m', 'e.x'))}, (p, c) -> (p - if(c = e.y, 1D, 0D)) / element_at(share, e.y + 1) / {classes}))"
    shrink = lambda v: f"transform(array({v}), s -> signum(s) * greatest(abs(s) - {RATE * L1}D, 0D))[0]"
    weight = shrink(f"v - {RATE}D * aggregate(element_at(rows, k + 1), 0D, (a, n) -> a + element_at(element_at(r, n), j + 1))")
    step = f"transform(array({wrong}), r -> transform(m, (c, j) -> named_struct('b', c.b - {RATE}D * aggregate(r, 0D, (a, g) -> a + element_at(g, j + 1)), 'w', transform(c.w, (v, k) -> {weight}))))[0]"
    start = f"transform(sequence(1, {classes}), c -> named_struct('b', 0D, 'w', transform(vocab, v -> 0D)))"
    base = common.staged(base.withColumn("model", F.expr(f"aggregate(sequence(1, {STEPS}), {start}, (m, t) -> {step})")), "license-model")
    heat = lambda t: f"aggregate(held, 0D, (a, e) -> a - ln(greatest(1e-12D, element_at({_softmax('transform(' + _scores('model', 'e.x') + f', u -> u / {t}D)')}, e.y + 1))))"
    loss = ", ".join(f"named_struct('loss', {heat(t)}, 't', {t}D)" for t in TEMPERATURES)
    live = "filter(sequence(1, size(vocab)), i -> exists(model, c -> element_at(c.w, i) != 0))"
    best = base.withColumn("heat", F.expr(f"array_min(array({loss})).t")).withColumn("live", F.expr(live))
    out = best.select("heat", F.expr("transform(live, i -> element_at(vocab, i))").alias("vocab"), F.expr("transform(model, c -> named_struct('b', c.b, 'w', transform(live, i -> element_at(c.w, i))))").alias("model"))
    return out.select(F.to_json(F.struct("heat", "vocab", "model"))).first()[0]


MODEL = "struct<heat:double,vocab:array<string>,model:array<struct<b:double,w:array<double>>>>"


def found_paragraphs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and ``l_found``: its candidate lines and confirmed windows, judged.

    Each is a struct of line (from 0; of a window the first), family, p (of the family), similar (the largest share
    of one of the family's templates) and confirmed. Null and empty texts have none.
    """
    common.missing_columns(docs, "text", *keep)
    families = [UNKNOWN, *TEMPLATES]
    grams = docs.sparkSession.range(1).select(_literal([{"t": t} for texts in TEMPLATES.values() for t in texts], "array<struct<t:string>>").alias("a")).select(F.expr(f"transform(a, e -> {ngrams('e.t')})")).first()[0]
    owner = [i for i, texts in enumerate(TEMPLATES.values(), 1) for _ in texts]
    model = F.from_json(F.lit(trained(docs.sparkSession)), MODEL)
    wide = docs.select(*keep, F.col("text").cast("string").alias("l_text"))
    has = " or ".join(f"contains(lower(l_text), '{c}')" for c in CUES)
    scored = lambda x, size: f"named_struct('line', i, 'size', {size}, 'g', if(lower({x}) rlike '{'|'.join(CUES)}', {ngrams(x)}, null))"
    nothing = "cast(array() as array<struct<line:int,size:int,g:array<string>>>)"
    wide = wide.withColumn("l_split", F.expr(f"if({has.replace('l_text', "translate(l_text, '\n', ' ')")}, split(l_text, '\\n'), cast(array() as array<string>))"))
    end = "cast(array_position(transform(q, z -> lower(z) rlike '[a-z0-9]'), false) as int)"
    window = f"transform(array(slice(l_split, i + 1, {WINDOW})), q -> slice(q, 1, if({end} = 0, {WINDOW}, {end} - 1)))[0]"
    joined = f"transform(array({window}), q -> if(size(q) > 1, {scored("array_join(q, ' ')", 'size(q)')}, null))[0]"
    lines = f"filter(concat(transform(l_split, (x, i) -> {scored('x', '1')}), transform(l_split, (x, i) -> {joined})), s -> s.g is not null)"
    wide = wide.withColumn("l_lines", F.coalesce(F.expr(lines), F.expr(nothing))).drop("l_text", "l_split")
    wide = wide.withColumn("l_model", model).withColumn("l_templates", _literal([{"y": y, "g": g} for y, g in zip(owner, grams, strict=True)], "array<struct<y:int,g:array<string>>>")).withColumn("l_names", _literal(families, "array<string>"))
    number = "transform(array_intersect(s.g, l_model.vocab), g -> cast(array_position(l_model.vocab, g) as int))"
    heated = "transform(" + _scores("l_model.model", number) + ", u -> u / l_model.heat)"
    judged = f"transform(l_lines, s -> named_struct('line', s.line, 'size', s.size, 'g', s.g, 'p', {_softmax(heated)}))"
    wide = wide.withColumn("l_judged", F.expr(judged))
    similar = "array_max(transform(filter(l_templates, t -> t.y = n), t -> size(array_intersect(t.g, s.g)) / size(t.g)))"
    named = f"transform(l_judged, s -> transform(array(cast(array_position(s.p, array_max(s.p)) as int) - 1), n -> named_struct('line', s.line, 'size', s.size, 'family', element_at(l_names, n + 1), 'p', array_max(s.p), 'similar', coalesce({similar}, 0D)))[0])"
    found = f"transform({named}, s -> named_struct('line', s.line, 'size', s.size, 'family', s.family, 'p', s.p, 'similar', s.similar, 'confirmed', s.family != '{UNKNOWN}' and s.p >= {LEAST_P}D and s.similar >= {LEAST_SIMILAR}D))"
    wide = wide.withColumn("l_all", F.expr(found))
    # a window gives way to a line of its own that says the same, and to a window over it that says more of it, or as much and begins later
    same = "l_all, o -> o.confirmed and o.family = s.family and if(o.size = 1, o.line between s.line and s.line + s.size - 1, o.line < s.line + s.size and s.line < o.line + o.size and (o.similar > s.similar or (o.similar = s.similar and o.line > s.line)))"
    found = f"array_sort(transform(filter(l_all, s -> s.size = 1 or (s.confirmed and not exists({same}))), s -> named_struct('line', s.line, 'family', s.family, 'p', s.p, 'similar', s.similar, 'confirmed', s.confirmed)))"
    return wide.select(*keep, F.coalesce(F.expr(found), F.expr("cast(array() as array<struct<line:int,family:string,p:double,similar:double,confirmed:boolean>>)")).alias("l_found"))


def license_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_candidates, n_licenses, n_unknown, families, findings.

    families: the different confirmed families, sorted and comma-joined; findings: line:family
    of each confirmed paragraph. Null and empty texts have none; repeated rows are reported
    alike; an empty table gives no rows; other columns are ignored.
    """
    rows = found_paragraphs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sure = "filter(l_found, s -> s.confirmed)"
    return rows.select(
        "doc_id",
        F.size("l_found").cast("long").alias("n_candidates"),
        F.expr(f"cast(size({sure}) as long)").alias("n_licenses"),
        F.expr(f"cast(size(l_found) - size({sure}) as long)").alias("n_unknown"),
        F.expr(f"array_join(array_sort(array_distinct(transform({sure}, s -> s.family))), ',')").alias("families"),
        F.expr(f"array_join(transform({sure}, s -> concat(s.line, ':', s.family)), ',')").alias("findings"),
    )
