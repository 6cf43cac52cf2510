import random

import cases
import corpus_pipeline

BAD = ["nasty", "vilely", "vilest"]


def corpus():
    rng = random.Random(9)
    rows, labels, kept = [], [], []
    for i in range(300):
        w = cases.words(rng, rng.randint(20, 60)).split()
        junk, toxic = i % 6 == 0, i % 6 == 1
        if toxic:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        t = " ".join(w)
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t))
        labels.append((i, int(not junk), int(toxic)))
        if not junk and not toxic:
            kept.append(i)
    rows += [(1000 + i, rows[i][1] + " tail") for i in kept[:30]]
    return rows, labels, kept


def test_each_decision_takes_effect(spark, tmp_path):
    rows, labels, kept = corpus()
    cases.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, [{r[0] for r in rows}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    junk, toxic = {i for i, q, _ in labels if not q}, {i for i, _, t in labels if t}
    assert not ids[1] & junk and len(ids[1] & toxic) > 0.9 * len(toxic) and set(kept) <= ids[1]
    assert not ids[2] & toxic and set(kept) <= ids[2]
    assert ids[3] == set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[3]


def test_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_texts_pass_every_stage(spark, tmp_path):
    cases.odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark, [(i, 1, 0) for i in (2, 4, 5, 7, 8, 10, -5, 1 << 40)] + [(11, 0, 0), (None, 1, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
