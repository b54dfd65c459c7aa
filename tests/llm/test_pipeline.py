"""Each stage of the pipeline against plain Python, on its own input; then run() as a whole."""

import collections
import os
import random

import pytest

import corpus_pipeline as P
from lodestrata.llm import pii
from lodestrata.llm.common import saved


def _documents():
    rng = random.Random(12)
    words = {"en": "the and of house man with that this there going", "fr": "le la les de maison jardin avec dans pour enfant"}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(words[lang].split()) + rng.choice(["", "", "s", ","]) for _ in range(rng.randint(20, 200)))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    near = rows[5][1].split()
    near[7] = "other"
    rows.append((100, rows[5][1], "en", "src1", rows[5][4]))
    rows.append((101, rows[8][1] + " write to a@b.com now", "en", "src1", 0))
    rows.append((102, None, "en", "src1", None))
    rows.append((103, "12 34 !!", "en", "src2", 8))
    rows.append((104, "call +1 (555) 010-9999 or the man at 10.0.0.1 there", "en", "src2", 51))
    return rows


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the vocabulary")
def test_stages_and_run(spark, tmp_path):
    rows = _documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    done = {}
    for name, stage in P.STAGES:
        before = docs.columns
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        done[name] = docs.collect()
        assert name == "packing" or docs.columns == before
    ids = lambda name: {r.doc_id for r in done[name]}
    assert {r[0] for r in rows} - ids("language_id") == {102, 103}
    gone = ids("language_id") - ids("near_duplicates")
    assert 100 in gone and gone <= {100, 101} and len(done["near_duplicates"]) == len(ids("near_duplicates"))
    assert ids("personal_data") == ids("near_duplicates")
    for r in done["personal_data"]:
        assert r.n_chars == len(r.text) and "10.0.0.1" not in r.text and "+1 (555)" not in r.text
    assert not any(x.n_email + x.n_ip + x.n_card + x.n_phone for x in pii.op2(spark.createDataFrame(done["personal_data"])).collect())
    words = collections.Counter(w for r in done["personal_data"] for w in r.text.split())
    mixed = collections.Counter(w for r in done["mixing"] for w in r.text.split())
    assert all(mixed[w] <= 2 * n for w, n in words.items()) and set(mixed) <= set(words)
    assert abs(sum(mixed.values()) - 1.5 * sum(words.values())) <= 4 * 64
    assert sum(r.length for r in done["packing"]) >= sum(len(r.text.split()) for r in done["mixing"])
    assert all(r.offset + r.length <= 2048 for r in done["packing"])
    whole = P.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, done["packing"]))
