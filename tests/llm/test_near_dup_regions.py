"""Near-duplicates in crowded regions: links across the parts into which a region is divided."""

from __future__ import annotations

from hippolake.llm import near_dups


def test_borderline_links_in_a_crowded_region(spark):
    """700 near copies; 300 more texts hang on one of them each, at exactly 80 of 100, and on nothing else."""
    base = [f"word{i}" for i in range(400)]

    def member(k: int) -> list[str]:
        at = k % 340
        return [*base[:at], f"own{k}", *base[at + 1 :]]

    texts = [" ".join(member(k)) for k in range(700)]
    texts += [" ".join([*member(k)[:-44], *(f"tail{k}x{i}" for i in range(44))]) for k in range(300)]
    sets = [set(near_dups.shingles(t, 5).tolist()) for t in texts]
    for k in range(300):
        linked = [j for j in range(len(sets)) if j != 700 + k and 100 * (s := len(sets[j] & sets[700 + k])) >= 80 * (len(sets[j]) + len(sets[700 + k]) - s)]
        assert linked == [k]

    rows = near_dups.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 1000 and [r.doc_id for r in rows if r.component_id != 0] == []
