"""Features among siblings on parents with many children."""

import pytest

from millrace.llm import html


@pytest.mark.parametrize("n_links, n_paragraphs", [(3, 5), (0, 60), (50, 70), (200, 1)])
def test_sibling_features_count_all_children(n_links, n_paragraphs):
    page = "<article>" + "<a href='/'>x</a>" * n_links + "<p>Some text.</p>" * n_paragraphs + "</article>"
    nodes = html.parsed(page)
    made = html.features(nodes, len(page))
    place, alike = (made[2:, html.FEATURES.index(f)].tolist() for f in ("place_among_siblings", "alike_siblings"))
    n = n_links + n_paragraphs
    assert place == pytest.approx([k / n for k in range(n)])
    assert alike == pytest.approx([n_links / n] * n_links + [n_paragraphs / n] * n_paragraphs)
