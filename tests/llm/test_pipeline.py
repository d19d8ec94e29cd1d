"""The pipeline and its stages against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from graphloom.llm import bpe, language_id, mixing
from tests.llm.test_operators import DOCS, brute_components, brute_print, odd_rows


def test_stages_decide_as_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language_id"](spark, docs, small)
    rows = identified.collect()
    assert identified.columns == docs.columns and len(rows) >= 0.99 * docs.count() and all(language_id.has_letter(r.text) for r in rows)

    once = stages["exact_dedup"](spark, identified, small)
    want = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        want[key] = min(want.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(v[1] for v in want.values())

    near = stages["simhash_near_dedup"](spark, once, small)
    kept = once.collect()
    found = brute_components([r.doc_id for r in kept], [brute_print(r.text) for r in kept])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(found.values()))

    mixed = stages["mixing"](spark, near, small)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    # the sources' words are those of the mix
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, source = Counter(), {r.doc_id: r.source for r in near.collect()}
    for r in mixed.collect():
        got[r.source] += words(r.text)
    plan = mixing.mix(near).collect()
    want = Counter()
    for r in plan:
        want[source[r.doc_id]] += r.taken
    assert +got == +want

    last = stages["byte_level_bpe"](spark, mixed, small)
    text = {r.doc_id: r.text for r in near.collect()}
    merger = bpe.Merger(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for r in last.collect():
        ids = next(iter(merger.encode([text[r.doc_id]])))
        assert r.ids == ids and r.n_tokens == len(np.frombuffer(ids, "<u4")) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert Counter(r.doc_id for r in last.collect()) == times


def test_run_and_odd_documents(spark, tmp_path):
    schema = DOCS + ", _copies int, kept boolean, _0 string, stays int, lang_pred int, _hash int"
    for name, rows in (("odd", odd_rows()), ("empty", [])):
        spark.createDataFrame([(*r, 1, True, "x", 2, 3, 4) for r in rows], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and (out.count() > 0) == bool(rows)
