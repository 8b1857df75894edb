"""The registered queries against their SQL, and the pipeline against a plain version of itself."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SMALL, compare, connected  # noqa: E402
from test_operators import plain_components, plain_contamination  # noqa: E402

import corpus_pipeline  # noqa: E402
from transcripta.llm import queries, shared, sql  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return connected()


@pytest.mark.parametrize("name", sorted(sql.oracles()))
def test_query_equals_sql(spark, db, name):
    compare(spark, db, queries.queries()[name], sql.oracles()[name])


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output over the small documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = shared.settled(stage(spark, docs, SMALL), "test-stage")
        out[stage.__name__] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()})
        assert after.columns == docs.columns, name
        docs = after
    return out


def test_stages_only_lose_rows(stages):
    for name, (before, after) in stages.items():
        assert 0 < len(after) <= len(before) and set(after) <= set(before), name
        assert all(r.n_chars == len(r.text) for r in after.values()), name


def test_quality_stage_follows_labels(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    right = [(d in after) == bool(labels[d]) for d in before if d in labels]
    assert sum(right) / len(right) > 0.95


def test_line_stage_drops_only_lines_with_a_partner(stages):
    before, after = stages["lines"]

    def grams(x):
        x = x.strip(" ").lower()
        return frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset({x})

    every = Counter(g for r in before.values() for x in r.text.split("\n") if len(x.strip()) >= 20 and (g := grams(x)))
    gone = Counter()
    for d, r in before.items():
        left = Counter(after[d].text.split("\n")) if d in after else Counter()
        gone.update(grams(x) for x in (Counter(r.text.split("\n")) - left).elements() if len(x.strip()) >= 20)
    assert gone
    for g in gone:
        assert every[g] > 1 or any(h != g and 100 * len(g & h) >= 80 * len(g | h) for h in every)
    stay = Counter(grams(x) for r in after.values() for x in r.text.split("\n") if len(x.strip()) >= 20)
    assert max(stay.values()) == 1


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    plain = plain_components([(d, r.text) for d, r in before.items()], 5, 80, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    assert set(after) == {d for d, (_, first) in plain.items() if d == first}


def test_decontamination_stage_leaves_no_passage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = plain_contamination([(d, r.text) for d, r in before.items()], items)
    assert set(after) == {d for d, (words, hit, *_) in plain.items() if hit <= 0.2 * words}
    assert all(after[d].text == before[d].text for d in after if not plain[d][1])
    assert not any(x[1] for x in plain_contamination([(d, r.text) for d, r in after.items()], items).values())
