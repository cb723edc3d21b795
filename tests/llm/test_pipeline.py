import math
from collections import Counter

import corpus_pipeline as pipeline
from brute import base_spans, fingerprint, groups
from conftest import EDGE_ROWS, frame

from scorelens.llm import decontaminate, quality
from scorelens.session import settle

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    kept = {}
    for name, stage in pipeline.STAGES:
        kept[name] = before = docs.collect()
        docs = settle(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
        if name == "quality":
            scores = quality.quality_scores(
                spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
            ).collect()
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in scores if r.score >= 0.5)
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            assert len(good & {r.doc_id for r in after}) >= 0.98 * len(good & {r.doc_id for r in before})
        elif name == "near_duplicates":
            roots = groups([fingerprint(r.text) for r in before])
            least = {}
            for r, root in zip(before, roots):
                least[root] = min(least.get(root, math.inf), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        elif name == "decontamination":
            items = [decontaminate.normalised(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [r for r in before if not any(i in decontaminate.normalised(r.text.encode()) for i in items)]
            assert {r.doc_id for r in after} <= {r.doc_id for r in clean} and len(after) >= len(clean) - 2
        elif name == "personal_data":
            assert len(after) == len(before) and not any(base_spans(r.text) for r in after)
            texts = {r.doc_id: r.text for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
            assert all(r.text == texts[r.doc_id] for r in after if not base_spans(texts[r.doc_id]))
        else:
            length = Counter()
            for r in after:
                length[r.doc_id] += r.length
            assert length.keys() == {r.doc_id for r in before}
            assert max(Counter({s: n for s, n in sum_by(after).items()}).values()) <= 2048
    assert pipeline.run(spark, SF).count() == len(after)


def sum_by(rows):
    total = Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    return total


def test_odd_rows_pass_every_stage(spark):
    for rows in (EDGE_ROWS, []):
        docs = frame(spark, rows)
        for name, stage in pipeline.STAGES[:-1]:
            if name != "quality":
                docs = settle(stage(spark, docs, SF), f"odd-{name}")
                assert docs.columns == frame(spark, []).columns
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
