"""Links at the least number of keypoints: classes leave out none that a search of each query finds."""

from __future__ import annotations

import numpy as np
from test_media_copies import drawn
from test_media_shared_parts import links


def test_links_at_the_edge_against_a_search_of_each_query(spark):
    rng = np.random.default_rng(8)
    bases = rng.normal(0, 0.125, (5, 64))
    vectors = [b + rng.normal(0, 0.125 * noise, 64) for b in bases for noise in (0, 0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.5)]
    images = [(i, drawn(v)) for i, v in enumerate(vectors)]
    queries = [(1000 + i, drawn(v, 5, 3, 40, 42, 0.8, -12.0)) for i, v in enumerate(vectors) if i % 8 < 5]
    queries += [(i + 1000, p) for i, p in queries[:3]]
    got, every, classes = links(spark, images, queries)
    assert every <= got and len({q for q, _ in every}) == len(queries)
    assert {i // 8 for q, i in got if q % 1000 < 8} == {0}
    assert classes[2000] == classes[1000] and len(set(classes.values())) < len(classes)
