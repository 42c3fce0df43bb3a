"""The pipeline on a small corpus with planted cases; each stage works on what its predecessor kept."""

import random

import corpus_pipeline
from opslake.llm.common import written

DOC = "doc_id long, text string, lang string, source string, n_chars long"


VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 6)) for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    good = [(i, prose(rng, rng.randrange(60, 200))) for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(60, 200)).split())) for i in range(60)]
    copies = [(300, good[0][1]), (301, good[1][1] + " ")]
    item = prose(rng, 40)
    leaks = [(400, prose(rng, 50) + " " + item + " " + prose(rng, 50))]
    passage = prose(rng, 60)
    repeats = [(500, prose(rng, 80) + " " + passage), (501, passage + " " + prose(rng, 80))]
    rows = [(i, t, "en", "s", len(t)) for i, t in [*good, *bad, *copies, *leaks, *repeats]]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in [*good, *bad]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    after_quality, after_near, after_substring, after_leaks = ids
    assert len(after_quality & set(range(200, 260))) <= 3 and len(after_quality & set(range(120))) >= 117
    assert after_near == after_quality - {300, 301}
    assert after_substring == after_near and after_leaks == after_substring - {400}
    left = {r.doc_id: r.text for r in docs.collect()}
    assert passage[:40] not in left[500] and len(left[500].split()) == 80 == len(left[501].split())
    assert left[5] == good[5][1]

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == after_leaks
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096
