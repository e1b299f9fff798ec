"""The pipeline's stages, each on what the one before kept."""

import re

import corpus_pipeline

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
        kept.append(docs.toPandas())
    start, good, single, clean, mixed, packed = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    marked = start.doc_id.map(labels)
    stays = start.doc_id.isin(good.doc_id)
    assert stays[marked == 1].mean() > 0.99 and stays[marked == 0].mean() < 0.1
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in zip(good.doc_id, good.text.str.lower().map(WORD.findall))}
    alone = sorted(single.doc_id)
    assert all(not (a and b) or 100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(map(sets.get, alone)) for b in map(sets.get, alone[:i]))
    gone = set(good.doc_id) - set(alone)
    assert all(any(100 * len(sets[g] & s) >= 80 * len(sets[g] | s) for d, s in sets.items() if d != g) for g in gone)
    assert list(sorted(clean.doc_id)) == alone and not clean.text.str.contains(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{6}").any()
    assert set(mixed.doc_id) <= set(alone) and (mixed.n_chars == mixed.text.str.len()).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and set(packed.doc_id) == set(mixed.doc_id)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_row_of_each_group(spark, messy, nothing):
    """Nulls, repeated rows and ids: of every component the row of the least doc_id (nulls last), once."""
    from barloom.llm.jaccard import one_of_each
    rows = messy.collect()
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = [None if not s else (r.doc_id is None, r.doc_id) for r, s in zip(rows, sets)]
    least = sorted((min((want[i] for i in range(len(rows)) if group[i] == g), key=lambda k: (k[0], k[1] or 0))[1] is None,
                    min((want[i] for i in range(len(rows)) if group[i] == g), key=lambda k: (k[0], k[1] or 0))[1]) for g in {g for g, s in zip(group, sets) if s})
    empty = [r for r, s in zip(rows, sets) if not s]
    got = one_of_each(messy)
    assert got.columns == messy.columns
    got = got.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if shingles(r.text)) == least
    assert len(got) == len(least) + len(empty)
    assert one_of_each(nothing).count() == 0


def test_stages_on_odd_rows(spark, messy, nothing, tmp_path):
    """Every stage takes nulls, empty and long texts, repeated rows and columns with clashing names, and empty tables."""
    for name, start in (("messy", messy), ("nothing", nothing)):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            assert i == 4 or docs.columns == start.columns
            if i == 2:
                assert not docs.where("text like '%password = abcdef12%'").count()
        assert (docs.count() > 0) == (name == "messy")
