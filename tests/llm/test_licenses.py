"""Licence notices: base places against regular words, labels against every diagonal tried by hand."""

import math
import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts():
    from barloom.llm.licenses import NOTICES
    rng = random.Random(4)
    common = "the a of under license with and or software version 2 public terms mit cc by nc".split()
    out = [None, "", " \n", "under the MIT license", "Under the\nmit—license", "underthe mit license", "UNDER_THE MIT-LICENSE under the mit license, under the mit license",
           "Apache License, Version 2.0", "apache license version 20", "ſ under the mit license é", "CC BY-NC 4.0", "cc by", "cc by cc by nc by nc", "mit " * 500, "under the " * 300 + "mit license",
           "apache license version 2 " * 400, "x" * 9000, "é1 cc by nc é2"]
    out += [" ".join(rng.choices(common, k=rng.randint(3, 400))) for _ in range(60)]
    for label, text, keys in NOTICES:
        words = text.split()
        out += [text, f"some words before {text} and behind", " ".join(w for w in words if rng.random() > 0.1), " ".join(x for w in words for x in ([w, "etc"] if rng.random() < 0.1 else [w])),
                " ".join(rng.sample(words, len(words))), text + " " + rng.choice(NOTICES)[1]]
    return out


def by_hand(all_texts, templates, least=0.6, rare=6):
    split_texts = [split(t) for t in all_texts]
    licence = {w for t in templates for w in t.words}
    df = {w: sum(w in set(ws) for ws in split_texts) for w in licence}
    weight = {w: math.log((1 + len(split_texts)) / (1 + df[w])) + 1e-3 for w in licence}
    rows = []
    for ws in split_texts:
        base = sorted((i, PHRASES[p]) for p in PHRASES for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split())
        best = {label: 1.0 for _, label in base}
        for t in templates:
            if t.base or not all(w in ws for a, b in t.keys for w in t.words[a:b]):
                continue
            mine = sorted({w for w in ws if w in t.words}, key=lambda w: (-weight[w], w))[:rare]
            for d in range(-len(t.words), len(ws)):
                near = [w for w in mine if any(0 <= d + s + p < len(ws) and ws[d + s + p] == w == t.words[p] for p in range(len(t.words)) for s in range(t.slack + 1))]
                starts = any(0 <= d + p < len(ws) and ws[d + p] == t.words[p] in mine for p in range(len(t.words)))
                if not starts or len(near) < math.ceil(len(mine) * 3 / 4):
                    continue
                if not all(any(d + s + a >= 0 and tuple(ws[d + s + a:d + s + b]) == t.words[a:b] for s in range(t.slack + 1)) for a, b in t.keys):
                    continue
                held = sum(weight[w] for p, w in enumerate(t.words) if any(0 <= d + s + p < len(ws) and ws[d + s + p] == w for s in range(t.slack + 1)))
                score = min(held / sum(weight[w] for w in t.words), 1.0)
                if score >= least:
                    best[t.label] = max(best.get(t.label, 0.0), score)
        rows.append((len(ws), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})),
                     ",".join(sorted(best)), max(best.values(), default=0.0)))
    return rows


def test_against_every_diagonal(spark):
    from barloom.llm.licenses import licenses, templates
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id int, text string, n_words int, labels string").repartition(3)
    want = by_hand(rows, templates())
    got = {r.doc_id: tuple(r)[1:7] + (r.score,) for r in licenses(docs).collect()}
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i][:6] == w[:6], (i, rows[i])
        assert abs(got[i][6] - w[6]) < 1e-9
    assert sum(w[1] for w in want) > 400 and len({x for w in want for x in w[5].split(",")}) > 12


def test_notices_and_clean_texts(spark):
    from barloom.llm.licenses import licenses
    clean = ["Er kam mit license plates under the arm.", "Public domain stories of the GNU.", "Permission is hereby granted.", "Redistribution of income and use of forms."]
    marked = {"Distributed under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
              "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This is free and unencumbered software released into the public domain.": "unlicense",
              "/* Redistribution and use in source and binary forms, with or\n * without modification, are permitted provided that\n * the following conditions are met: */": "bsd"}
    rows = [*clean, *marked, *[f"filler {i} of words and more" for i in range(300)]]
    got = {r.text_id: (r.labels, r.score) for r in licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).withColumnRenamed("doc_id", "text_id").collect()}
    assert [got[i] for i in range(len(clean))] == [("", 0.0)] * len(clean)
    assert [got[len(clean) + i][0] for i in range(len(marked))] == list(marked.values())


def test_messy(spark, messy, nothing):
    from barloom.llm.licenses import licenses
    rows = messy.select("doc_id", "text").collect()
    want = sorted((r.doc_id is None, r.doc_id, len(split(r.text)), 0) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_base) for r in licenses(messy).collect()) == want
    assert licenses(nothing).count() == 0


def test_key_phrase_must_stand_in_template():
    import pytest

    from barloom.llm.licenses import template
    with pytest.raises(ValueError):
        template("x", "some words", ["other words"])
