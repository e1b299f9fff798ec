"""The sample that the factorisation machine is fitted on."""

import zlib


def test_one_document_of_each_doc_id(spark, monkeypatch):
    from barloom.llm import quality
    known = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5][:20]
    rows = [(d, f"document number {d} with some words of its own", i) for i, d in enumerate(known)]
    rows += [(known[0], f"short {i}", i) for i in range(300)] + [(known[1], None, i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    labels = spark.createDataFrame([(d, d % 2) for d in known], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda y, at, places, values, stats, *a: seen.append(list(zip(y.tolist(), at[:-1].tolist(), places[at[:-1]].tolist(), stats.tolist()))))
    for table in (docs, docs.repartition(7)):
        quality.train(table, labels, sample=20)
    assert [len(s) for s in seen] == [20, 20] and seen[0] == seen[1]
    assert sorted(r[0] for r in seen[0]) == sorted(d % 2 for d in known)


def test_bound_of_features(spark, monkeypatch):
    from barloom.llm import quality
    known = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5][:20]
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{i}" for i in range(50))) for d in known], "doc_id int, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in known], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda y, at, places, values, stats, *a: seen.append((len(y), at.tolist(), len(places), len(values), len(stats))))
    for most in (10**6, 275, 10):
        quality.train(docs, labels, most=most)
    (all_, at, n, *_), (some, at2, n2, *_), (none, at3, n3, *_) = seen
    assert all_ == 20 and n == at[-1] > 900 and some == 5 and n2 == at2[-1] <= 275 and (none, at3, n3) == (0, [0], 0)
