import random
import re

import cases
import duckdb
from harness import compare

from firnline.llm import licenses, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        out.append((i or 0, len(w), len(at), min(at)[0] if at else -1, max(at)[0] if at else -1, ",".join(sorted({x for _, x in at}))))
    return sorted(out)


def scan(spark, rows):
    return licenses.scan(cases.table(spark, rows)).collect()


def base_of(got):
    return sorted((r.doc_id or 0, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in got)


def test_base_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["under the MIT", "license", "Apache License, Version 2", "CC BY-NC 4.0", "cc by", "nc", "under", "the", "mit", "x", "2"]
    rows = cases.odd_texts() + [(100 + i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    assert base_of(scan(spark, rows)) == brute(rows)
    assert scan(spark, []) == []


def test_passages_with_gaps_are_found_and_others_are_not(spark):
    full = next(t for label, t in licenses.TEMPLATES if label == "mit")
    w = full.split()
    rows = [
        (1, "intro " + full + " outro"),
        (2, " ".join(w[:20] + ["inserted", "words"] + w[20:])),
        (3, " ".join(w[:12] + w[14:])),
        (4, " ".join(w[: len(w) // 4])),
        (5, " ".join(x for k in range(0, len(w), 6) for x in w[k : k + 6] + ["filler"] * 30)),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (7, "the software is here"),
    ]
    labels = {r.doc_id: (r.labels, r.score) for r in scan(spark, rows)}
    assert [labels[i][0] for i in range(1, 8)] == ["mit", "mit", "mit", "", "", "gpl-3", ""]
    assert labels[1][1] == 1 and 0.5 <= labels[2][1] < 1 and labels[7][1] == 0


def test_base_labels_stay(spark):
    r = scan(spark, [(1, "under the MIT license under the mit license, Apache License Version 2")])[0]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 0, 8, "apache-2,mit", 1.0)
    assert set(r.base_labels.split(",")) <= set(r.labels.split(","))


def test_licenses_of_like_words_are_told_apart(spark):
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl-2")
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 2."),
        (2, gpl),
        (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
        (4, "licensed under the apache license version 1 1"),
        (5, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (6, "This work is licensed under a Creative Commons Attribution 3.0 International License"),
        (7, "Licensed under the Apache License, Version 2.0"),
    ]
    labels = {r.doc_id: r.labels for r in scan(spark, rows)}
    assert [labels[i] for i in range(1, 8)] == ["gpl-2", "gpl-2", "cc-by-sa", "", "", "cc-by", "apache-2"]


NOTICES = [
    "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 1.1", "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.",
    "This work is licensed under a Creative Commons Attribution 3.0 International License", "under the MIT license, CC BY-NC, CC BY NC",
]


def test_sql_has_the_rules_of_the_operator(spark, tmp_path):
    rng = random.Random(9)
    texts = [f"{'word ' * rng.randint(0, 5)}{n} {'tail ' * rng.randint(0, 4)}" for n in NOTICES for _ in range(3)] + [" ".join(rng.sample(NOTICES, 3)) for _ in range(40)]
    texts += [t for _, t in licenses.TEMPLATES] + [" ".join(w for w in t.split() if rng.random() > 0.08) for _, t in licenses.TEMPLATES for _ in range(5)] + ["", None]
    path = str(tmp_path)
    cases.table(spark, list(enumerate(texts))).select("doc_id", "text").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    r = compare(spark, con, "op10", queries.queries()["op10_license_scan"], queries.oracle_sql()["op10_license_scan"], path)
    assert r["ok"], r["why"]
    got = queries.queries()["op10_license_scan"](spark, path)
    assert {x for r in got.collect() for x in r["labels"].split(",")} >= {"gpl-2", "gpl-3", "apache-2", "cc-by-sa", "cc-by-nc", "cc-by", "mit", "bsd", "isc"}
