"""Operator 4: all links of a document are counted, also those between texts that hang together through others."""

from __future__ import annotations

import random

import pytest

from strandloom.llm import jaccard
from test_operators import brute_classes


@pytest.mark.parametrize("block", [4096, 7])
def test_links_by_brute_force(spark, block):
    r = random.Random(23)
    base = [f"b{r.random()}" for _ in range(120)]
    rows, w = [], list(base)
    for i in range(60):  # a loose group: many pairs lie around the threshold
        v = list(base)
        for _ in range(r.randint(0, 3)):
            v[r.randrange(120)] = f"w{r.random()}"
        rows.append((i, " ".join(v)))
    for i in range(60, 110):  # a chain that drifts away
        w = list(w)
        w[r.randrange(120)] = f"d{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 110][1]) for i in range(110, 120)] + [(120, "ab cd"), (121, "ab cd"), (122, ""), (123, None), (124, "alone here")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == brute_classes(rows)
