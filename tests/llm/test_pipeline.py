"""The pipeline: every stage's decisions, and the packing of what is left."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import awkward, frame


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash", "decontamination", "packing"]
    out = stages["language_id"](spark, docs, sf)
    assert out.columns == docs.columns and out.count() == len(left)
    last = {}
    for d, t in left.items():
        last[t] = max(d, last.get(t, d))
    left = {d: t for d, t in left.items() if last[t] == d}
    out = stages["exact_dedup"](spark, out, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(left)
    keep = {c for _, _, c in brute.near(list(left.items()))}
    left = {d: t for d, t in left.items() if d in keep}
    out = stages["simhash"](spark, out, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(left)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.decontaminate(list(left.items()), items) if r[5]}
    left = {d: t for d, t in left.items() if d not in bad}
    out = stages["decontamination"](spark, out, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(left)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns: every row is decided by itself."""
    passage = awkward()[9][1]
    rows = awkward() + [(None, passage), (3, "x y z, again and again"), (3, "x y z, again and again"), (None, "without an id"), (None, "without an id"), (77, "clean " * 30), (77, passage + " and more"), (78, "Re.")]
    docs = frame(spark, rows)
    spark.createDataFrame([(99, passage), (100, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages, pairs = dict(corpus_pipeline.STAGES), lambda df: [(r.doc_id, r.text) for r in df.collect()]
    least = lambda d: (d is None, d or 0)

    out = stages["language_id"](spark, docs, str(tmp_path))
    left = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    assert out.columns == docs.columns and Counter(pairs(out)) == Counter(left)

    out = stages["exact_dedup"](spark, out, str(tmp_path))
    largest = {}
    for d, t in left:
        largest[t] = max(largest.get(t, (-1,)), (-1,) if d is None else (d,))
    left = [(None if d == (-1,) else d[0], t) for t, d in largest.items()]
    assert out.columns == docs.columns and Counter(pairs(out)) == Counter(left)

    out = stages["simhash"](spark, out, str(tmp_path))
    groups = defaultdict(list)
    for (d, t), (*_, g) in zip(left, brute.near_groups(left), strict=True):
        groups[g].append((d, t))
    of = {row: g for g, members in groups.items() for row in members}
    left = pairs(out)
    assert out.columns == docs.columns and Counter(of[row] for row in left) == Counter(list(groups))
    assert all(least(row[0]) == min(least(d) for d, _ in groups[of[row]]) for row in left)

    out = stages["decontamination"](spark, out, str(tmp_path))
    clean = [row for row, hit in zip(left, brute.decontaminate(left, [(99, passage)]), strict=True) if not hit[5]]
    assert out.columns == docs.columns and Counter(pairs(out)) == Counter(clean) and (None, "without an id") in clean

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in clean)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
