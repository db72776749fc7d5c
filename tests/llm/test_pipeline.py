"""The pipeline's stages against brute force, each on what its predecessor kept."""

import importlib.util
import re
from collections import defaultdict

import pytest

from patchwright.llm import pii, toxicity
from patchwright.llm.common import table

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def test_stages(spark, small):
    import corpus_pipeline as P
    from test_decontaminate import brute as contaminated
    from test_jaccard_join import brute as classes
    from test_pii import plain_match

    docs = table(spark, small, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    bench = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    stages = dict(P.STAGES)
    clean = stages["toxicity"](spark, docs, small).cache()
    model = toxicity.fit(docs, table(spark, small, "labels"))
    assert ids(clean) == {r["doc_id"] for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    single = stages["near_duplicates"](spark, clean, small).cache()
    assert ids(single) == {i for i, c, _ in classes(pairs(clean)) if i == c}
    pure = stages["decontamination"](spark, single, small).cache()
    assert ids(pure) == {r[0] for r in contaminated(pairs(single), bench) if not r[5]}
    private = stages["pii"](spark, pure, small).cache()
    form = re.compile(pii.ANY, re.ASCII)
    assert dict(pairs(private)) == {i: form.sub(lambda m: plain_match(m[0], pii.key_of(spark)), t) for i, t in pairs(pure)}
    for df in (clean, single, pure, private):
        assert df.columns == docs.columns
    rows = stages["packing"](spark, private, small).collect()
    assert {r["doc_id"] for r in rows} == ids(private)
    text = defaultdict(str)
    for r in sorted(P.run(spark, small).collect(), key=lambda r: r["piece"]):
        text[r["doc_id"]] += r["text"]
    assert text == dict(pairs(private)), "the run's pieces hold the pseudonyms"
    assert sum(text[i] != t for i, t in pairs(pure)) > 5


def test_stages_on_odd_rows(spark, small, odd):
    import corpus_pipeline as P

    docs = odd
    for _, stage in P.STAGES:
        docs = stage(spark, docs, small)
    assert {r["doc_id"] for r in docs.collect()} >= {2, 3, 4, 6}
