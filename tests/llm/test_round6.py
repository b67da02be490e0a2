"""Fixes of the round after r05."""

import random

from morphospark.llm import suffix_dedup
from morphospark.llm.common import Workspace


def test_suffix_dedup_leaves_one_table_a_turn(spark, monkeypatch):
    rng = random.Random(1)
    shared = "".join(rng.choices("abcdefgh ", k=400))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=100)) + shared + "".join(rng.choices("abcdefgh ", k=100))) for i in range(40)]
    staged, stage = [], Workspace.stage

    def noted(self, df, label, *args):
        staged.append(label)
        return stage(self, df, label, *args)

    monkeypatch.setattr(Workspace, "stage", noted)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 4000).collect()
    assert len(got) == 40 and all(r.n_spans == 1 and 400 <= r.n_removed < 410 for r in got)
    turns = [x for x in staged if x.startswith("turn")]
    assert len(turns) > 1 and turns == [f"turn{i}" for i in range(len(turns))]
    assert [x for x in staged if not x.startswith(("turn", "level", "hits"))] == [
        "anchors", "placed", "own", "groups", "counted", "cut"]
