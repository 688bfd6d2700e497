"""The pipeline's stages on a small table, each against what it must do to its own input."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from .helpers import docs
from .test_operators import brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in d.collect()}
    for name, stage in cp.STAGES[:-1]:
        before = d.count()
        d = spark.createDataFrame(stage(spark, d, SF).toArrow())
        assert d.columns == cp.COLUMNS and 0 < d.count() <= before
    kept = [(r.doc_id, r.text) for r in d.collect()]
    assert len({i for i, _ in kept}) == len(kept) and all(i in seen for i, _ in kept)
    packed = cp.STAGES[-1][1](spark, d, SF).collect()
    words = {i: len(t.split()) for i, t in kept}
    assert {r.doc_id for r in packed} == set(words) and all(sum(r.length for r in packed if r.doc_id == i) == n for i, n in list(words.items())[:20])


def test_near_duplicates_leave_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(4, base), (2, base), (2, base), (3, base.replace("w150", "other")), (9, "quite another text with words of its own"), (1, None), (5, "")]
    got = sorted((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs(spark, rows), SF).collect())
    assert [i for i, _ in got] == [1, 2, 9]


def test_near_duplicates_are_found(spark):
    """Of planted pairs at a similarity of 0.8 or a little more, nine in ten at least go, and no document of its own does."""
    import numpy as np

    rng, rows, planted = np.random.default_rng(8), [], 0
    for k in range(300):
        n = int(rng.integers(60, 500))
        words = [f"v{x}" for x in rng.integers(0, 3000, n)]
        rows.append((10 * k, " ".join(words)))
        if k % 2:
            at = int(0.1 * n)  # a tenth of the words are others, in one piece: 0.8 or more of the shingles of either are shared
            rows.append((10 * k + 1, " ".join(words[: n - at] + [f"n{k}x{i}" for i in range(at)])))
            planted += 1
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    near = {i for i in sets if i % 10 and 5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1])}
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs(spark, rows), SF).collect()}
    assert len(near) > 100 and len(near - kept) >= 0.9 * len(near) and set(sets) - near <= kept


def test_near_duplicates_of_rows_without_ids(spark):
    rows = [(None, "a text"), (None, "a text"), (None, "another"), (3, "own words"), (3, "own words"), (3, "other words")]
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs(spark, rows), SF).collect()), key=str)
    assert got == sorted([(None, "a text"), (None, "another"), (3, "own words"), (3, "other words")], key=str)


def test_repeated_passages_equal_brute_force(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"a b {passage} c"), (2, f"d\n{passage} e"), (3, passage), (4, "kept  as\nit is"), (5, None)]
    got = {r.doc_id: r for r in cp.drop_repeated_passages(spark, docs(spark, rows), SF).collect()}
    assert {i: n for i, _, n, _ in brute_repeats(rows)} == {1: 0, 2: 70, 3: 70, 4: 0, 5: 0}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "d e" and got[2].n_chars == 3 and got[4].text == "kept  as\nit is"


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_empty_and_awkward_tables(spark, stage):
    assert stage(spark, docs(spark).limit(0), SF).count() == 0
    out = stage(spark, docs(spark), SF)
    assert out.count() > 0 and len(out.columns) == len(set(out.columns))


def test_run(spark):
    assert cp.run(spark, SF).where(F.col("length") > 0).count() > 0
