"""Stages that remove or repeat rows tell documents apart by id and text, and pass clean ones without a shuffle."""

from collections import Counter

import corpus_pipeline
from cantoria.llm import decontaminate, mixing
from tests.llm.conftest import prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_decontamination_by_id_and_text_with_a_full_bitmap(spark):
    item = prose(3, 30)
    docs = [(1, prose(10, 90) + " " + item, "en", "a", 1), (1, prose(11, 90), "en", "a", 1), (None, item, "en", "a", 1), (None, prose(12, 50), "en", "a", 1)]
    docs += [(i, prose(100 + i, 40) + (" " + item if i % 3 == 0 else ""), "en", "b", 1) for i in range(2, 60)] + [(70, None, "en", "a", 1), (71, "", "en", "a", 1)]
    frame, items = spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = Counter(d for d in docs if item not in (d[1] or ""))
    for bits in (6, 24):  # 64 bits are all set: every document takes the exact way
        assert Counter(map(tuple, decontaminate.decontaminate(frame, items, bits=bits).collect())) == want


def test_mixing_repeats_each_document_by_its_own_plan(spark):
    docs = [(None if i % 4 == 0 else i % 7, prose(i, 20 + i), "en", f"s{i % 3}", 1) for i in range(80)]
    frame = spark.createDataFrame(docs, DOC).repartition(4)
    got = Counter(r.text for r in corpus_pipeline.mix_sources(spark, frame, "").collect())
    sizes = Counter()
    for r in mixing.mix_plan(frame).collect():
        sizes[r.source] += r.copies * r.size
    taken = Counter()
    for _, text, _, source, _ in docs:
        assert got[text] <= 2
        taken[source] += got[text] * len(text.split())
    assert taken == sizes
