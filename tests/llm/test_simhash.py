"""What SimHash links hold in memory and how many partitions their rounds have."""

import tracemalloc

import numpy as np

from graphloom.llm import simhash


def test_near_copies_are_compared_in_small_blocks():
    """Three thousand fingerprints that are all near their neighbours: some megabytes at a time."""
    prints = np.uint64(0x0123456789ABCDEF) ^ np.arange(3_000, dtype=np.uint64)
    tracemalloc.start()
    links = sum(1 for _ in simhash.entry_links(prints, prints[:0], 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == len(prints) - 1
    assert peak < 32_000_000


def test_few_links_go_round_in_few_partitions(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(simhash, "checkpointed", lambda df, plain=simhash.checkpointed: sizes.append(out := plain(df)) or out)
    rows = [(i, f"common words of a text that is long enough {'x' * (i % 7)}") for i in range(40)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.component_id for r in found.collect()} <= set(range(7))
    rounds = [df.rdd.getNumPartitions() for df in sizes if df.columns == ["u", "v"]]
    assert rounds and set(rounds) == {1}
