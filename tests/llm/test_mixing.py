import random

from hypothesis import given, settings
from hypothesis import strategies as st

from caselens.llm import mixing

SCHEMA = "doc_id long, text string, source string, slot string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_a_frame_never_strays_by_a_block(weights):
    slots = {f"s{i}": w for i, w in enumerate(weights)}
    order, frame = mixing.schedule(slots), sum(weights)
    seen = dict.fromkeys(slots, 0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] * frame - t * n) < frame for x, n in slots.items())
    assert seen == slots


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 90), st.floats(0.1, 9)), min_size=1))
def test_phases_place_each_block_once(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    plan = mixing.phases(blocks, {s: w for s, (_, w) in sources.items()}, 32)
    used, done = set(), {}
    for source, _, first, last, slots, frame, base, offsets in plan:
        assert first == done.get(source, 0)
        done[source] = last
        for b in range(first, last):
            i, k = divmod(b - first, slots)
            used.add(base + i * frame + offsets[k])
    assert done == {s: n for s, n in blocks.items() if n}
    assert used == set(range(sum(blocks.values())))


def test_positions(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(400), rng.choice(["a", "a", "a", "b", "c", None]), "clash") for i in range(500)]
    rows += [(500, None, "b", ""), (501, "", "b", ""), (7, "again", "b", ""), (None, "none", "c", ""), (502, "y" * 5000, "c", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.positions(docs, block_bytes=1000, frame=16).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    order = sorted(got, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in got)
    again = mixing.positions(docs.repartition(5), block_bytes=1000, frame=16).collect()
    assert {(r["doc_id"], r["slot"]) for r in got if r["doc_id"] != 7} == {(r["doc_id"], r["slot"]) for r in again if r["doc_id"] != 7}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.positions(docs).count() == 0 and mixing.mixed(docs).count() == 0
