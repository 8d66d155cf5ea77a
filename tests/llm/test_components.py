import numpy as np
import pytest

from tidegauge.llm import common, components


def labels_of(links):
    label = {x: x for pair in links for x in pair}
    while True:
        after = {x: min([label[x], *(label[b] for a, b in links if a == x), *(label[a] for a, b in links if b == x)]) for x in label}
        if after == label:
            return label
        label = after


def found_links():
    """A long chain, a star, circles and chance links, with repeats and links of a node with itself."""
    rng = np.random.default_rng(5)
    chain = [(1000 + int(a), 1000 + int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(rng.permutation(40)))]
    star = [(2**40, 2**40 + i) for i in range(1, 30)]
    chance = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)]
    return chain + star + chance + chance[:5] + [(7, 7), (-3, 5), (5, -3)]


@pytest.mark.parametrize("few", [0, 60, 200_000])
def test_components(spark, monkeypatch, few):
    """By rounds, by rounds and then in one task, and in one task; few links need few tables."""
    monkeypatch.setattr(components, "FEW_LINKS", few, raising=False)
    written, write = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df, *a: written.append(a) or write(df, *a))
    links = found_links()
    got = components.merge_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = labels_of([(a, b) for a, b in links if a != b])
    assert len(got) == len(want) and {r.node: r.label for r in got} == want
    assert few < 200_000 or len(written) == 2


def test_components_of_no_links(spark):
    assert components.merge_components(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()


def test_freed_native_memory_is_given_back(spark, monkeypatch):
    """A release asks the JVM for it, and the JVM of the tests has the command."""
    asked, trim = [], common.trimmed
    monkeypatch.setattr(common, "trimmed", lambda s: asked.append(trim(s)))
    common.release(spark.range(1))
    assert len(asked) == 1 and "rim" in asked[0]
