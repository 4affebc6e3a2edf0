"""The flow's two searches make no row a pair or a shared slot."""

from __future__ import annotations

from corpusloom.operators.flow import Flow
from corpusloom.plans import flow


def test_searches_of_the_flow_are_block_wise(spark, tiny, monkeypatch):
    plans = []

    def seen(self, questions, batch, account=None):
        asked = questions.where("question <> ''")
        plans.extend(search(asked)._jdf.queryExecution().optimizedPlan().toString() for search in self.searches)

    monkeypatch.setattr(Flow, "run_batch", seen)
    flow._flow(spark, tiny)
    assert len(plans) == 2 * len(flow.LATER)
    for plan in plans:
        assert "FlatMapCoGroupsInArrow" in plan
        assert not [line for line in plan.split("\n") if "Join Inner" in line and "idx" in line]


def test_batches_read_stored_points_and_questions_only(spark, tiny, monkeypatch):
    """No step of a batch joins documents and embeddings anew, and no search carries texts."""
    read, hits, written = [], [], Flow._written

    def seen(self, rows, name, batch):
        read.extend(rows.inputFiles())
        if name.startswith("hits-"):
            hits.append(rows.columns)
        return written(self, rows, name, batch)

    monkeypatch.setattr(Flow, "_written", seen)
    flow._flow(spark, tiny)
    assert read and not [f for f in read if f.startswith(f"file://{tiny}/")]
    assert len(hits) == 2 * len(flow.LATER) and not [c for c in hits if {"text", "source"} & set(c)]
