"""Properties that hold for any input."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.functions.chains import greedy_chain
from locusloom.functions.sequences import find_monomers
from locusloom.operators import hotkeys
from locusloom.sources.records import RecordGrammar, parse_text

FIELD = st.text(st.characters(codec="utf-8", exclude_characters="\n\r"), max_size=12)


def quoted(s):
    return '"' + s.replace('"', '""') + '"'


@given(st.lists(st.tuples(FIELD, st.booleans()), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_written_fields_are_read_back(fields):
    text = "\t".join(quoted(f) if q or "\t" in f or f.startswith('"') else f for f, q in fields)
    got = list(RecordGrammar(text, "bed", multiline=False).records())
    if not text.strip() or text.startswith(("#", "track", "browser")):
        assert got == []
    else:
        assert [r[1] for r in got] == [[f for f, _ in fields]] and got[0][2] is None


@given(st.text(st.sampled_from('ab\t"\n\r1chr+-#'), max_size=200), st.booleans())
@settings(max_examples=500, deadline=None)
def test_any_text_is_parsed_to_its_end(text, multiline):
    rows = list(parse_text(text, "bed", multiline))
    offsets = [r["rec_off"] for r in rows]
    assert offsets == sorted(set(offsets)) and all(0 <= r.get("error_off", 0) <= len(text) for r in rows)


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 60)), max_size=15), st.integers(0, 40), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_chains_are_ordered_and_start_with_the_longest(hits, dist, pct):
    iv = [(b, b + n) for b, n in hits]
    chain = greedy_chain(iv, dist, pct)
    assert len(set(chain)) == len(chain) and bool(chain) == bool(iv)
    if chain:
        assert max(n for _, n in hits) == max(iv[i][1] - iv[i][0] for i in chain)


@given(st.text(st.sampled_from("AAAC"), max_size=120), st.booleans())
@settings(max_examples=200, deadline=None)
def test_monomers_are_disjoint_and_rich(seq, backward):
    found = find_monomers(seq, "A", backward=backward)
    assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert all(0 <= b < e <= len(seq) for b, e in found)


def test_quantiles_of_many_keys_by_salted_joins(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-1000, 1000)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = sorted(tuple(r) for r in hotkeys.exact_quantiles(df, "k", "v", [0.25, 0.75], 4).fillna("none").collect())
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in hotkeys.exact_quantiles(df, "k", "v", [0.25, 0.75], 4).fillna("none").collect()) == want
